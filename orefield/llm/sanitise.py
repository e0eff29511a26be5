"""Information-theoretic sanitisation of personal data.

Patterns find the protected entities.  Words of the documents that hold an
entity are candidates for revealing it: over the whole corpus, the number of
documents that hold the entity, the word, and both give the pointwise mutual
information of word and entity, as a share of the entity's own information.  At
1 the word never occurs without the entity.  Words above a threshold are
generalised to a placeholder, above a higher one removed.  A pair in few
documents may be chance, so its mutual information is taken as a share of the
pair's information, which is the entity's own where the word is in all of its
documents: an entity of one document counts in full.

One pass over the texts finds the mentions and counts the documents of every
word; the words of documents with entities are packed by range of their hashes
and merged with the counts of that range.  Words of one task are aggregated
before they are dealt out, so a frequent word costs a row for each task.
Entities of the same documents are counted as one.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from orefield.llm import common as c
from orefield.llm.common import U64

KINDS = ("email", "ip", "card", "phone", "term")
#: Words on either side of a mention that are marked if they reveal it.
NEAR_WORDS = 8
#: Documents from which on a pair counts as a share of the entity's information; with fewer, of the pair's.
SUPPORT = 3
#: Shares of an entity's information from which a word that gives it away is generalised, or removed.
GENERALISE, REMOVE = 0.6, 0.9
#: Distinct words of documents that a task holds before it deals them out.
FLUSH = 1_500_000

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a run of digits that fails from its first digit fails from all, so it is tried once
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of local part, @ and dotted domain, in linear time: from each @ to both sides."""
    out, least, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > least and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            least = m.end()
        else:
            least = max(least, at + 1)  # no later match can hold this @
        at = text.find("@", max(least, at + 1))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, x in enumerate(reversed(digits)):
        d = int(x) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches, sorted; kinds by their place in KINDS."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            if all(len(x) <= 3 and int(x or 0) <= 255 for x in (y.lstrip("0") for y in m[0].split("."))):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(x.isdigit() for x in m[0]) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def written_spans(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _entity(kind: int, value: str) -> str:
    """An entity's name: equal for spellings that differ in case or separators only."""
    return KINDS[kind] + ":" + (value.lower() if kind < 2 else "".join(x for x in value if x.isdigit()))


#: Bytes of documents that a bucket of words is for, and the most buckets.
BUCKET_BYTES, MOST_BUCKETS = 32 << 20, 16384

_FOUND = "doc_id long, doc long, spans string, counts array<long>, entities array<string>, text string, p int, blob binary"


def _find(buckets: int):
    names = ["doc_id", "doc", "spans", "counts", "entities", "text", "p", "blob"]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.string())

    def run(batches):
        seen: list[np.ndarray] = []
        held = 0

        def flush():
            nonlocal seen, held
            if not seen:
                return
            h, n = np.unique(np.concatenate(seen), return_counts=True)
            cuts = np.searchsorted(c.range_bucket(h, buckets), np.arange(buckets + 1))
            own = np.flatnonzero(np.diff(cuts))
            blobs = [c.join_arrays(np.diff(h[cuts[b] : cuts[b + 1]], prepend=U64(0)), c.narrow(n[cuts[b] : cuts[b + 1]])) for b in own]
            seen, held = [], 0
            yield pa.RecordBatch.from_arrays([*(pa.nulls(len(own), t) for t in kinds), pa.array(own.astype(np.int32)), pa.array(blobs, pa.binary())], names=names)

        for batch in batches:
            at = 0
            for _, rows, data, offsets in c.text_blocks(batch.column(2)):
                low = c.LOWER[data]
                starts, ends, first = c.word_bounds(low, offsets, c.ALNUM_OR_WIDE)
                words = c.word_hashes(low, starts, ends)
                out = {"spans": [], "counts": [], "entities": [], "text": []}
                for d in range(rows):
                    x = _distinct(words[first[d] : first[d + 1]])
                    seen.append(x)
                    held += len(x)
                    text = data[offsets[d] : offsets[d + 1]].tobytes().decode()
                    spans = base_spans(text)
                    out["spans"].append(written_spans(spans))
                    out["counts"].append([sum(k == kind for _, k, _ in spans) for kind in range(4)])
                    out["entities"].append(list(dict.fromkeys(_entity(k, text[a:b]) for a, k, b in spans)))
                    out["text"].append(text if spans else None)
                own = [batch.column(0).slice(at, rows), batch.column(1).slice(at, rows), *(pa.array(x, t) for x, t in zip(out.values(), kinds[2:], strict=True))]
                yield pa.RecordBatch.from_arrays([*own, pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], names=names)
                at += rows
                if held >= FLUSH:
                    yield from flush()
        yield from flush()

    return run


def _distinct(words: np.ndarray) -> np.ndarray:
    x = np.sort(words)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def _read_spans(spans: str) -> list[tuple[int, int, int]]:
    return [(int(a), KINDS.index(k), int(b)) for k, a, b in (x.split(":") for x in spans.split(",") if x)]


def _free_words(texts: pa.Array, spans: list[str]):
    """(row, hashes, starts, ends) of the words of each text that no base span covers; starts and ends in code points."""
    for lo, rows, data, offsets in c.text_blocks(texts):
        low = c.LOWER[data]
        starts, ends, first = c.word_bounds(low, offsets, c.ALNUM_OR_WIDE)
        words = c.word_hashes(low, starts, ends)
        for d in range(rows):
            own = slice(int(first[d]), int(first[d + 1]))
            opens = (data[offsets[d] : offsets[d + 1]] & 0xC0) != 0x80  # a code point's first byte
            points = np.concatenate([[0], np.cumsum(opens)])
            a, b = points[starts[own] - offsets[d]], points[ends[own] - offsets[d]]
            free = np.ones(len(a), bool)
            for x, _, y in _read_spans(spans[lo + d]):
                free[np.searchsorted(b, x, side="right") : np.searchsorted(a, y)] = False
            yield lo + d, words[own][free], a[free], b[free]


def _pair_words(buckets: int):
    """Free words of documents with their classes of entities, by range of words: (p, words' counts as null, pairs)."""

    def run(batches):
        docs, classes, words = [], [], []
        held = 0

        def flush():
            nonlocal docs, classes, words, held
            h, row = np.concatenate(words), np.repeat(np.arange(len(words)), [len(x) for x in words])
            order = np.argsort(h, kind="stable")
            h, row = h[order], row[order]
            cuts = np.searchsorted(c.range_bucket(h, buckets), np.arange(buckets + 1))
            of_bucket, blobs = np.flatnonzero(np.diff(cuts)), []
            for p in of_bucket:
                k = slice(cuts[p], cuts[p + 1])
                own, of = np.unique(row[k], return_inverse=True)
                each = [x for r in own for x in classes[r]]
                blobs.append(c.join_arrays(np.diff(h[k], prepend=U64(0)), c.narrow(of), np.array([docs[r] for r in own], np.int64), c.narrow(np.array([len(classes[r]) for r in own])), np.array([x["class"] for x in each], np.int64), c.narrow(np.array([x["held"] for x in each]))))
            docs, classes, words, held = [], [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(of_bucket.astype(np.int32)), pa.nulls(len(blobs), pa.binary()), pa.array(blobs, pa.binary())], names=["p", "blob", "pairs"])

        for batch in batches:
            of_doc = batch.column(0).to_pylist()
            of_class = batch.column(3).to_pylist()
            for k, h, _, _ in _free_words(batch.column(1), batch.column(2).to_pylist()):
                docs.append(of_doc[k])
                classes.append(of_class[k])
                words.append(_distinct(h))
                held += len(words[-1])
                if held >= FLUSH:
                    yield from flush()
        if held:
            yield from flush()

    return run


def shares(n: int, both: np.ndarray, held: np.ndarray, docs: np.ndarray, support: int = SUPPORT) -> np.ndarray:
    """Mutual information of word and entity, as a share of the entity's information, or of the pair's where that has few documents."""
    return np.log(both * float(n) / (held * docs.astype(float))) / np.log(n / np.where(both >= support, held, both))


def _strong_words(n: int, support: int, generalise: float, remove: float):
    """(doc, words) of a range of words: those that disclose an entity of the document, and whether they are to be removed."""

    def run(batches):
        hs, ns, held_by = [], [], []
        for batch in batches:
            for x, y in zip(batch.column(1), batch.column(2), strict=True):
                if x.is_valid:
                    h, k = c.split_arrays(x.as_py())
                    hs.append(np.cumsum(h, dtype=U64))
                    ns.append(k.astype(np.int64))
                else:
                    held_by.append(y.as_py())
        if not held_by:
            return
        words, docs = np.concatenate(hs), np.concatenate(ns)
        order = np.argsort(words, kind="stable")
        words, docs = words[order], docs[order]
        first = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]]))
        words, docs = words[first], np.add.reduceat(docs, first)
        # a word in more documents than this times held ** g has a share below g of any entity, whatever they have in common
        g = max(generalise, 0.0)
        most = float(n) ** (1 - g) * (1 + 1e-9)
        found = []
        for raw in held_by:
            h, row, doc, size, of_class, held = c.split_arrays(raw)
            at = np.searchsorted(words, np.cumsum(h, dtype=U64))
            size, held = size.astype(np.int64), held.astype(np.int64)
            begin = np.cumsum(size) - size
            can = docs[at] <= most * (np.maximum.reduceat(held, begin) ** g)[row]
            at, row = at[can], row[can]
            k = size[row]
            each = np.repeat(begin[row] - (np.cumsum(k) - k), k) + np.arange(k.sum())
            found.append((np.repeat(at, k), np.repeat(doc[row], k), of_class[each], held[each]))
        at, doc, of_class, held = (np.concatenate(x) for x in zip(*found, strict=True))
        if not len(at):
            return
        order = np.lexsort((of_class, at))
        at, doc, of_class, held = at[order], doc[order], of_class[order], held[order]
        first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (of_class[1:] != of_class[:-1])]))
        both = np.diff(np.append(first, len(at)))
        share = np.repeat(shares(n, both, held[first], docs[at[first]], support), both)
        own = share >= generalise
        at, doc, share = at[own], doc[own], share[own]
        order = np.lexsort((-share, at, doc))
        at, doc, share = at[order], doc[order], share[order]
        best = np.concatenate([[True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])])[: len(at)]
        at, doc, share = at[best], doc[best], share[best]
        cuts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1], [True]])) if len(doc) else np.zeros(1, np.int64)
        for lo in range(0, len(cuts) - 1, 10000):
            part = cuts[lo : lo + 10001]
            blobs = [c.join_arrays(words[at[a:b]], (share[a:b] >= remove).astype(np.uint8)) for a, b in zip(part, part[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(doc[part[:-1]]), pa.array(blobs, pa.binary())], names=["doc", "words"])

    return run


def disclosures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> tuple[DataFrame, DataFrame]:
    """(found, strong): found has a row for each row of docs, with its base spans, and its text if it has any; strong (doc, words) the hashes of its words that disclose one of its entities."""
    spark = docs.sparkSession
    c.importable(spark)
    buckets = c.buckets_for(docs, BUCKET_BYTES, MOST_BUCKETS)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("doc"), F.col(text_col).cast("string").alias("text"))
    table = c.written(own.mapInArrow(_find(buckets), _FOUND), "found")
    found = table.where("blob is null").select("doc_id", "doc", "spans", "counts", "text")
    n = max(found.count(), 2)
    mentions = table.where("blob is null and text is not null").select("doc", F.explode("entities").alias("entity")).distinct()
    # entities of the same documents have the same words and shares: one class stands for them all
    entities = mentions.groupBy("entity").agg(F.count("*").alias("held"), F.bit_xor(F.xxhash64("doc")).alias("set")).where(F.col("held") * 2 <= n)
    classes = mentions.join(entities, "entity").select("doc", F.xxhash64("set", "held").alias("class"), "held").distinct().groupBy("doc").agg(F.collect_list(F.struct("class", "held")).alias("classes"))
    # equal texts under one id count once
    texts = found.where("text is not null").select("doc", "text", "spans").dropDuplicates(["doc"]).join(classes, "doc")
    pairs = texts.select("doc", "text", "spans", "classes").mapInArrow(_pair_words(buckets), "p int, blob binary, pairs binary")
    counts = table.where("blob is not null").select("p", "blob", F.lit(None).cast("binary").alias("pairs"))
    strong = pairs.unionByName(counts).repartitionById(buckets, F.col("p")).mapInArrow(_strong_words(n, support, generalise, remove), "doc long, words binary")
    return found, strong


def sanitise_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **thresholds) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_terms, n_removed, actions) of each row of docs.

    spans are kind:start:end in code points, by start, then kind; base ones
    stand whatever the corpus says, and words that disclose an entity of the
    document are added with kind term.  actions are start:end:what, what being
    redact, generalise or remove.  A null text is empty.  A document counts
    once for a word or an entity, a repeated row of equal id and text once for
    a pair; both copies get the same spans.  A null id counts as the empty
    text.  Other columns are not looked at.  No rows: no rows.
    """
    found, strong = disclosures(docs, id_col, text_col, **thresholds)
    added = strong.groupBy("doc").agg(F.collect_list("words").alias("words"))

    def run(batches):
        for batch in batches:
            spans, strong_of = batch.column(1).to_pylist(), batch.column(4).to_pylist()
            terms: list[list[tuple[int, int, bool]]] = [[] for _ in spans]
            for k, h, starts, ends in _free_words(batch.column(3), spans):
                if strong_of[k]:
                    words, removed = (np.concatenate(x) for x in zip(*map(c.split_arrays, strong_of[k]), strict=True))
                    order = np.argsort(words)
                    words, removed = words[order], removed[order]
                    at = np.minimum(np.searchsorted(words, h), len(words) - 1)
                    own = np.flatnonzero(words[at] == h)
                    terms[k] = list(zip(starts[own].tolist(), ends[own].tolist(), removed[at[own]].astype(bool).tolist(), strict=True))
            out = []
            for x, own in zip(spans, terms, strict=True):
                what = {(a, b): "remove" if r else "generalise" for a, b, r in own}
                every = sorted([*_read_spans(x), *((a, 4, b) for a, b, _ in own)])
                out.append((hashlib.sha256(x.encode()).hexdigest(), written_spans(every), len(own), sum(y == "remove" for y in what.values()), ",".join(f"{a}:{b}:{what[a, b] if k == 4 else 'redact'}" for a, k, b in every)))
            counts = batch.column(2).to_pylist()
            cols = [pa.array([x[k] for x in counts], pa.int64()) for k in range(4)]
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols, *(pa.array([o[k] for o in out], t) for k, t in enumerate(kinds))], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_terms", "n_removed", "actions"])

    rows = found.join(added, "doc", "left").select("doc_id", "spans", "counts", "text", "words")
    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_terms long, n_removed long, actions string")


def applied(text: str | None, actions: str) -> str | None:
    """text with its spans redacted ([PII]), generalised ([TERM]) or removed."""
    if text is None or not actions:
        return text
    out, at = [], 0
    for x in actions.split(","):
        a, b, what = x.split(":")
        a, b = int(a), int(b)
        if b <= at:
            continue
        out += [text[at : max(a, at)], {"redact": "[PII]", "generalise": "[TERM]", "remove": ""}[what]]
        at = b
    return "".join([*out, text[at:]])


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **thresholds) -> DataFrame:
    """docs with sanitised texts; all rows and other columns, whatever they are called, stay.  Ids identify rows: rows that share one must share the text."""
    key, what = c.free_names(docs, "doc", "actions")
    actions = sanitise_spans(docs, id_col, text_col, **thresholds).where("actions <> ''").select(F.col("doc_id").alias(key), F.col("actions").alias(what)).distinct()
    joined = docs.join(actions, c.own(id_col).cast("long").eqNullSafe(F.col(key)), "left")
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            own = list(batch.columns[:-1])
            own[at] = pa.array([applied(t.as_py(), a.as_py() or "") for t, a in zip(own[at], batch.column(batch.num_columns - 1), strict=True)], own[at].type)
            yield pa.RecordBatch.from_arrays(own, names=batch.schema.names[:-1])

    return c.map_rows(joined.select(*map(c.own, docs.columns), what), run, docs.schema)
