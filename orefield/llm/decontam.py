"""Benchmark decontamination with a broadcast hash set of normalised n-grams.

The items' windows of consecutive words are hashed into a sorted set, which is
broadcast in blocks of bounded size: as many passes over the documents are
made as there are blocks, one for any usual benchmark.  A pass scans the
windows of whole documents, looks their hashes up, verifies each hit on its
words, and marks the words of the window.  There is no shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from orefield.llm import common as c
from orefield.llm.common import U64

WINDOW_WORDS = 10
#: Bytes of item text in a block that is broadcast; its index holds about 28 bytes for each word besides.
BLOCK_BYTES = 8 << 20

_FILTER_BITS = 20


class WindowIndex:
    """The windows of a block of items, in arrays: for each length, their hashes in ascending order; of each, its item and its words' place in the items' words."""

    def __init__(self, items: list[tuple[str | None, str]], window: int):
        self.names = [item for item, _ in items]
        parts: dict[int, list[tuple[np.ndarray, ...]]] = {}
        words_of: list[np.ndarray] = []
        held = 0
        for row, rows, data, offsets in c.text_blocks(pa.array([text for _, text in items], pa.string())):
            low = c.LOWER[data]
            starts, ends, first = c.word_bounds(low, offsets, c.ALNUM_OR_WIDE)
            words = c.word_hashes(low, starts, ends)
            sizes = ends - starts
            at = np.cumsum(sizes + 1) - sizes - 1  # of each word, among all words joined by spaces
            joined = np.full(int(sizes.sum()) + len(sizes), 0x20, np.uint8)
            joined[c.ragged(at, sizes)] = low[c.ragged(starts, sizes)]
            n = np.diff(first)
            for k in np.unique(np.minimum(n[n > 0], window)).tolist():
                own = np.flatnonzero(n >= window if k == window else n == k)
                begins = c.ragged(first[:-1][own], n[own] - k + 1)
                item = np.repeat(row + own, n[own] - k + 1)
                last = begins + k - 1
                parts.setdefault(k, []).append((c.window_hashes(words, k)[begins], item.astype(np.uint32), (held + at[begins]).astype(np.uint32), (at[last] + sizes[last] - at[begins]).astype(np.uint32)))
            words_of.append(joined)
            held += len(joined)
        self.words = np.concatenate(words_of).tobytes() if words_of else b""
        self.hashes, self.places, self.filters = {}, {}, {}
        for k in sorted(parts):
            h, item, begin, size = (np.concatenate(x) for x in zip(*parts.pop(k), strict=True))
            order = np.lexsort((begin, item, h))
            h, item, begin, size = h[order], item[order], begin[order], size[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (item[1:] != item[:-1])  # an item names a window once
            self.hashes[k], self.places[k] = h[new], (item[new], begin[new], size[new])
            self.filters[k] = np.zeros(1 << _FILTER_BITS, bool)
            self.filters[k][h >> U64(64 - _FILTER_BITS)] = True

    def items_of(self, k: int, place: int, words: bytes) -> set[str | None]:
        """The items with a window of these words, whose hash's first entry is at place."""
        h, (item, begin, size) = self.hashes[k], self.places[k]
        out, i = set(), place
        while i < len(h) and h[i] == h[place]:
            if self.words[begin[i] : int(begin[i]) + int(size[i])] == words:
                out.add(self.names[item[i]])
            i += 1
        return out


def scan(index: WindowIndex, column: pa.Array) -> Iterator[tuple[int, np.ndarray, set, np.ndarray, np.ndarray]]:
    """Of each text: number of words, which words are hit, the items, and the words' first and last bytes (in the text)."""
    for _, rows, data, offsets in c.text_blocks(column):
        low = c.LOWER[data]
        starts, ends, first = c.word_bounds(low, offsets, c.ALNUM_OR_WIDE)
        words = c.word_hashes(low, starts, ends)
        hit = np.zeros(len(words), bool)
        last = np.repeat(first[1:], np.diff(first))  # of each word's text, the end
        found: dict[int, set] = {}
        for k, known in index.hashes.items():
            windows = c.window_hashes(words, k)
            at = np.flatnonzero(index.filters[k][windows >> U64(64 - _FILTER_BITS)])
            at = at[at + k <= last[at]]
            place = np.minimum(np.searchsorted(known, windows[at]), len(known) - 1)
            same = known[place] == windows[at]
            at, place = at[same], place[same]
            of_text = np.searchsorted(first, at, side="right") - 1
            for i, p, d in zip(at.tolist(), place.tolist(), of_text.tolist(), strict=True):
                items = index.items_of(k, p, b" ".join(low[starts[j] : ends[j]].tobytes() for j in range(i, i + k)))
                if items:
                    hit[i : i + k] = True
                    found.setdefault(d, set()).update(items)
        for d in range(rows):
            a, b = first[d], first[d + 1]
            yield b - a, hit[a:b], found.get(d, set()), starts[a:b] - offsets[d], ends[a:b] - offsets[d]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_bytes: int) -> list:
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).where("text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    out = []
    for i in range(n):  # each collects a block of bounded size
        rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i).collect()
        out.append(spark.sparkContext.broadcast(WindowIndex([(r.item, r.text) for r in rows], window)))
    return out


def _marked(docs: DataFrame, text_col: str, benchmark: DataFrame, item_col: str, item_text_col: str, window: int, block_bytes: int, finish, schema) -> DataFrame:
    """finish(batch, columns) of each batch of docs with three more columns: the number of words, a byte for each word that tells whether it is hit, and the items.

    schema is the result's.  The last block's pass finishes its batches itself,
    so that a task has one Python worker.
    """
    c.importable(docs.sparkSession)
    words, hits, items = c.free_names(docs, "words", "hits", "items")
    docs = docs.withColumns({words: F.lit(None).cast("long"), hits: F.lit(None).cast("binary"), items: F.lit(None).cast("array<string>")})
    at = docs.columns.index(text_col)

    def over(block, last):
        def run(batches):
            for batch in batches:
                n, hits, items = [], [], []
                before = zip(batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1), strict=True)
                for (words, hit, found, _, _), (old, names) in zip(scan(block.value, batch.column(at)), before, strict=True):
                    if old.is_valid:
                        hit = hit | np.frombuffer(old.as_py(), bool)
                        found = found | set(names.as_py())
                    n.append(int(words))
                    hits.append(hit.tobytes())
                    items.append(sorted(found - {None}))
                own = [pa.array(n, pa.int64()), pa.array(hits, pa.binary()), pa.array(items, pa.list_(pa.string()))]
                batch = pa.RecordBatch.from_arrays([*batch.columns[:-3], *own], names=batch.schema.names)
                yield finish(batch) if last else batch

        return c.tidy(run)

    blocks = _blocks(benchmark, item_col, item_text_col, window, block_bytes)
    for i, block in enumerate(blocks[:-1]):
        docs = c.map_rows(c.written(docs, "marked") if i else docs, over(block, False), docs.schema)
    return c.map_rows(c.written(docs, "marked") if len(blocks) > 1 else docs, over(blocks[-1], True), schema)


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items) of each row of docs.

    Words are maximal runs of digits, letters and non-ASCII characters, A-Z in
    lower case.  A window is that many consecutive words of an item; an item of
    fewer is one window.  A null text, of a document or an item, has no words.
    An item without an id marks words but isn't named; repeated items count
    once.  Repeated documents have a row each.  Other columns are not looked at.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def finish(batch):
        marks = batch.num_columns - 3
        hit = [int(np.frombuffer(x.as_py(), bool).sum()) for x in batch.column(marks + 1)]
        items = batch.column(marks + 2).to_pylist()
        sha = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(marks), pa.array(hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(sha, pa.string()), pa.array([x > 0 for x in hit], pa.bool_()), batch.column(marks + 2)], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items"])

    out = f"doc_id {own.schema['doc_id'].dataType.simpleString()}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>"
    return _marked(own, "text", benchmark, item_col, item_text_col, window, block_bytes, finish, out)


def without_hits(text: str | None, hits: np.ndarray) -> str | None:
    """text without each run of hit words and what stands between them."""
    if text is None or not hits.any():
        return text
    raw = text.encode()
    data = c.LOWER[np.frombuffer(raw, np.uint8)]
    starts, ends, _ = c.word_bounds(data, np.array([0, len(data)]), c.ALNUM_OR_WIDE)
    edge = np.diff(np.concatenate([[0], hits.astype(np.int8), [0]]))
    out, at = [], 0
    for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
        out.append(raw[at : starts[a]])
        at = ends[b - 1]
    return b"".join([*out, raw[at:]]).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", remove: str = "documents", window: int = WINDOW_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without contaminated documents (remove="documents") or without their hit passages (remove="spans").

    All columns, whatever they are called, and all rows without a hit stay as they are.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove: documents or spans, not {remove!r}")
    at = docs.columns.index(text_col)

    def finish(batch):
        hits = [np.frombuffer(x.as_py(), bool) for x in batch.column(batch.num_columns - 2)]
        own = list(batch.columns[:-3])
        if remove == "spans":
            own[at] = pa.array([without_hits(t.as_py(), h) for t, h in zip(own[at], hits, strict=True)], own[at].type)
        batch = pa.RecordBatch.from_arrays(own, names=batch.schema.names[:-3])
        return batch if remove == "spans" else batch.filter(pa.array([not h.any() for h in hits], pa.bool_()))

    return _marked(docs, text_col, benchmark, item_col, item_text_col, window, block_bytes, finish, docs.schema)
