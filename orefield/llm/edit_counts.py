"""Edit-aware token counts: segment trees over the pre-token pieces of each document.

A document is cut into pieces that are encoded independently (see tokens): its
pre-tokens, or parts of them that no merge can join.  Blocks of pieces are the
leaves of a tree whose nodes hold the characters and tokens below them.  An
edit descends the tree to the last border before it, and the first one after
it, that it can't move, encodes that stretch anew, and updates the sums above
the blocks it changed.  The count afterwards is that of encoding the whole
edited text.  Trees are kept in a table beside their texts (count_trees), from
which later edits start without encoding anything but their own stretches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from orefield.llm import common as c
from orefield.llm.tokens import Encoder, encoder

BLOCK_PIECES = 32


class CountTree:
    """Token counts of one text under edits."""

    def __init__(self, enc: Encoder, text: str, pieces: tuple[np.ndarray, np.ndarray] | None = None):
        """pieces: the characters and the tokens of each piece, if known from a store; else text is encoded."""
        self.enc = enc
        self.encoded = 0  # characters that edits made it encode again
        self._build(text, *(pieces or measure(enc, [text])[0]))

    def _build(self, text: str, sizes: np.ndarray, counts: np.ndarray) -> None:
        self.n_pieces = len(sizes)
        self._text, self._sizes, self._counts = text, np.asarray(sizes, np.int64), np.asarray(counts, np.int64)
        starts = np.arange(0, max(self.n_pieces, 1), BLOCK_PIECES)
        self._blocks: dict[int, tuple[str, list[int], list[int]]] = {}  # of those that edits have touched
        self._leaves = len(starts)
        self._size = 1 << max(0, (self._leaves - 1).bit_length())
        some = self.n_pieces > 0
        chars = np.add.reduceat(self._sizes, starts) if some else np.zeros(1, np.int64)
        self._begin = np.concatenate([[0], np.cumsum(chars)])
        self.chars = self._tree(chars)
        self.tokens = self._tree(np.add.reduceat(self._counts, starts) if some else np.zeros(1, np.int64))

    def _tree(self, leaves: np.ndarray) -> list[int]:
        level = np.zeros(self._size, np.int64)
        level[: len(leaves)] = leaves
        levels = [level]
        while len(level) > 1:
            level = level.reshape(-1, 2).sum(axis=1)
            levels.append(level)
        return [0, *np.concatenate(levels[::-1]).tolist()]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def _block(self, i: int) -> tuple[str, list[int], list[int]]:
        if i not in self._blocks:
            a, b = i * BLOCK_PIECES, min((i + 1) * BLOCK_PIECES, len(self._sizes))
            self._blocks[i] = self._text[self._begin[i] : self._begin[i + 1]], self._sizes[a:b].tolist(), self._counts[a:b].tolist()
        return self._blocks[i]

    @property
    def pieces(self) -> int:
        return self.n_pieces + sum(len(n) - min(BLOCK_PIECES, self.n_pieces - i * BLOCK_PIECES) for i, (_, n, _) in self._blocks.items())

    def whole(self) -> tuple[str, np.ndarray, np.ndarray]:
        """The text as it stands, and the characters and tokens of its pieces."""
        if not self._blocks:
            return self._text, self._sizes, self._counts
        own = [self._block(i) for i in range(self._leaves)]
        return "".join(x[0] for x in own), np.array([n for x in own for n in x[1]], np.int64), np.array([n for x in own for n in x[2]], np.int64)

    def _find(self, at: int) -> tuple[int, int, int]:
        """Block, piece in it, and start of the piece that holds the character at; the last piece if none does."""
        node, start = 1, 0
        while node < self._size:
            node *= 2
            if at >= start + self.chars[node] and self.chars[node + 1]:
                start += self.chars[node]
                node += 1
        i = node - self._size
        _, sizes, _ = self._block(i)
        for k, n in enumerate(sizes):
            if at < start + n or k == len(sizes) - 1:
                return i, k, start
            start += n
        return i, 0, start

    def open(self, start: int, end: int, new: str) -> str:
        """The stretch to encode for an edit that replaces the characters from start to end (clamped to the text) by new."""
        start = min(max(start, 0), self.chars[1])
        end = min(max(end, start), self.chars[1])
        # a border depends on one character before it and two after it
        i, k, at = self._find(max(start - 2, 0))
        j, m, until = self._find(end)
        while True:
            _, sizes, _ = self._block(j)
            until += sizes[m] if sizes else 0
            text, own, _ = self._block(j)
            last = sum(own[: m + 1])
            # white space at the end of a stretch would be taken for the end of the text
            if until >= self.chars[1] or not text[last - 1].isspace():
                break
            j, m, until = self._find(until)
        old = "".join(self._block(b)[0] for b in range(i, j + 1))
        first = self._block(i)[1]
        skip = sum(first[:k])  # characters of the first block before the stretch
        stretch = old[skip : skip + until - at]
        text = stretch[: start - at] + new + stretch[end - at :]
        self._open = i, k, j, m, text
        self.encoded += len(text)
        return text

    def close(self, sizes: np.ndarray, counts: np.ndarray) -> int:
        """Put the pieces of the stretch that was opened in its place; returns the count of the whole text."""
        i, k, j, m, text = self._open
        for b in range(i, j + 1):
            own, s, n = self._block(b)
            lo, hi = k if b == i else 0, m + 1 if b == j else len(s)
            head, tail = sum(s[:lo]), sum(s[:hi])
            if b == i:
                self._blocks[b] = own[:head] + text + own[tail:], s[:lo] + list(sizes) + s[hi:], n[:lo] + list(counts) + n[hi:]
            else:
                self._blocks[b] = own[:head] + own[tail:], s[:lo] + s[hi:], n[:lo] + n[hi:]
            self._update(b)
        if len(self._blocks[i][1]) > 16 * BLOCK_PIECES:
            self._build(*self.whole())
        return self.total

    def edit(self, start: int, end: int, new: str) -> int:
        """Replace the characters from start to end (clamped to the text) by new; returns the count of the whole text."""
        ((sizes, counts),) = measure(self.enc, [self.open(start, end, new)])
        return self.close(sizes.tolist(), counts.tolist())

    def _update(self, i: int) -> None:
        _, sizes, counts = self._blocks[i]
        node = i + self._size
        chars, tokens = sum(sizes) - self.chars[node], sum(counts) - self.tokens[node]
        while node:
            self.chars[node] += chars
            self.tokens[node] += tokens
            node //= 2


def measure(enc: Encoder, texts: list[str] | pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """The characters and the tokens of the pieces of each text."""
    out = []
    for rows, first, sizes, counts in enc.pieces(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())):
        out += [(sizes[first[d] : first[d + 1]], counts[first[d] : first[d + 1]]) for d in range(rows)]
    return out


def count_trees(docs: DataFrame, definition: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_tokens, tree) of each row of docs: a store of trees for edit_counts.

    tree holds the characters and the tokens of the pieces, compressed.  A null
    text is empty.  Repeated rows have a row each; other columns are not looked at.
    """
    c.importable(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(definition)

    def run(batches):
        enc, press = encoder(shared.value), zstandard.ZstdCompressor()
        for batch in batches:
            own = measure(enc, batch.column(1))
            trees = [press.compress(c.join_arrays(c.narrow(sizes), c.narrow(counts))) for sizes, counts in own]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([int(n.sum()) for _, n in own], pa.int64()), pa.array(trees, pa.binary())], names=["doc_id", "text", "n_tokens", "tree"])

    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return own.mapInArrow(c.tidy(run, keep=True), f"doc_id {own.schema['doc_id'].dataType.simpleString()}, text string, n_tokens long, tree binary")


def edit_counts(docs: DataFrame, definition: str, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits", tree_col: str | None = None, with_trees: bool = False) -> DataFrame:
    """(doc_id, n_tokens, n_after, n_pieces, n_chars, encoded_chars[, text, tree]) of each row of docs.

    edits is an array of (start, end, text), in code points of the text as the
    edits before have left it; places beyond the text are moved to its ends, a
    null place is 0, a null text, of the document or an edit, is empty, and
    null edits are none.  n_after counts the edited text, which n_pieces and
    n_chars describe; encoded_chars is what the edits made the operator encode
    again.  tree_col names the trees of a store (count_trees), from which the
    edits start without encoding the text; a null tree is made anew.
    with_trees adds the edited texts and their trees: a store for later edits.
    Repeated rows have a row each; other columns are not looked at.
    """
    c.importable(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(definition)

    def run(batches):
        enc, press, unpress = encoder(shared.value), zstandard.ZstdCompressor(), zstandard.ZstdDecompressor()
        for batch in batches:
            new = batch.column(2).is_null().to_numpy(zero_copy_only=False)
            made = iter(measure(enc, batch.column(1).filter(pa.array(new))))
            own = [CountTree(enc, text.as_py() or "", tuple(c.split_arrays(unpress.decompress(raw.as_py()))) if raw.is_valid else next(made)) for text, raw in zip(batch.column(1), batch.column(2), strict=True)]
            before = [t.total for t in own]
            edits = [x or [] for x in batch.column(3).to_pylist()]
            for k in range(max(map(len, edits), default=0)):  # the k-th edits of all texts are encoded together
                turn = [(t, e[k] or {"start": 0, "end": 0, "text": ""}) for t, e in zip(own, edits, strict=True) if len(e) > k]
                stretches = [t.open(e["start"] or 0, e["end"] or 0, e["text"] or "") for t, e in turn]
                for (t, _), (sizes, counts) in zip(turn, measure(enc, stretches), strict=True):
                    t.close(sizes.tolist(), counts.tolist())
            out = [before, [t.total for t in own], [t.pieces for t in own], [t.chars[1] for t in own], [t.encoded for t in own]]
            columns = [batch.column(0), *(pa.array(x, pa.int64()) for x in out)]
            if with_trees:
                whole = [t.whole() for t in own]
                columns += [pa.array([x[0] for x in whole], pa.string()), pa.array([press.compress(c.join_arrays(c.narrow(x[1]), c.narrow(x[2]))) for x in whole], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    tree = F.col(tree_col) if tree_col else F.lit(None)
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), tree.cast("binary").alias("tree"), F.col(edits_col).cast("array<struct<start:long,end:long,text:string>>").alias("edits"))
    schema = f"doc_id {own.schema['doc_id'].dataType.simpleString()}, n_tokens long, n_after long, n_pieces long, n_chars long, encoded_chars long" + ", text string, tree binary" * with_trees
    names = [x.split()[0] for x in schema.split(", ")]
    return own.mapInArrow(c.tidy(run, keep=True), schema)


def revisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with three edits of each text, at places hashed from its id: a replacement, a deletion and an insertion."""
    length = F.coalesce(F.length(text_col), F.lit(0))
    place = lambda k: F.pmod(F.xxhash64(F.col(id_col), F.lit(k)), length + 1)
    edit = lambda k, n, text: F.struct(place(k).alias("start"), (place(k) + n).alias("end"), F.lit(text).alias("text"))
    return docs.withColumn("edits", F.array(edit(1, 12, "as amended in 2024"), edit(2, 20, ""), edit(3, 0, "\n\n  Note: see above.")))
