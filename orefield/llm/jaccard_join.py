"""N-gram Jaccard join by a size-aware split into light and heavy sets.

Documents become sets of hashed word shingles; documents with the same set
form one class.  A pass over all (shingle, class) pairs finds how many classes
hold each shingle; a shingle of one class only can't be shared and is dropped.
Since two sets of similarity t share at least t times the size of either, a
class that is left with fewer shared shingles than that has no partner.

Of the classes left, those whose subsets are few (light) enumerate all subsets
of the sizes that a partner would have to share; two that meet at a subset
are linked as they stand.  All others (heavy) scan inverted lists of the
rarest shingles of each set, among which any partner must be met, and each
candidate is verified on whole sets.  A set is light where enumerating costs
no more than scanning its lists would, and at most MAX_SUBSETS rows.

Lists that share sets are scanned together, as one cohort, so that each set is
sent there once.  Scanning counts common shingles of all sets of a block at
once, by a product of the block's membership matrices; a cohort of many sets
is cut into blocks, which meet in cells.  A cell gives a forest of its links,
never its pairs.  A cohort beyond MOST_COHORT, which only chains of unrelated
lists could make, is scanned list by list instead.

Shingles and classes are 64-bit hashes: among n of them a false match has a
probability of about n*n / 2**65.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from orefield.llm import common as c
from orefield.llm.common import U64
from orefield.llm.components import classes_of, components, least_of_component, parted, told

SHINGLE_WORDS = 5
PERCENT = 80
#: Most subsets that a light set may enumerate.
MAX_SUBSETS = 64
#: Sets of a block; columns of a membership matrix that are multiplied at once; sets of a cohort.
BLOCK, COLUMNS, MOST_COHORT = 256, 4096, 50_000
#: Shingles that a task gathers before it deals them out.
FLUSH = 1_000_000
#: Shingles that are sorted at once when they are merged.
SORTED = 250_000

#: Bytes of documents that a bucket of shingles, or of classes, is for, and the most buckets.
BUCKET_BYTES, MOST_BUCKETS = 32 << 20, 16384

_DEALT = "p int, doc_id long, n long, key long, blob binary"
_MERGED = "p int, doc_id long, n long, key long, blob binary"
_SETS = "key long, n long, light boolean, shared binary, prefix array<long>, subsets array<struct<lo:long,hi:long,h:long>>"


def shingle_sets(column: pa.Array, k: int):
    """The sorted distinct shingle hashes of each text."""
    for _, rows, data, offsets in c.text_blocks(column):
        low = c.LOWER[data]
        starts, ends, first = c.word_bounds(low, offsets, c.NOT_SPACE)
        words = c.word_hashes(low, starts, ends)
        windows = c.window_hashes(words, k)
        for d in range(rows):
            a, b = first[d], first[d + 1]
            if b - a >= k:
                x = np.sort(windows[a : b - k + 1])
                keep = np.empty(len(x), bool)
                keep[0] = True
                np.not_equal(x[1:], x[:-1], out=keep[1:])
                yield x[keep]
            else:
                yield c.window_hashes(words[a:b], b - a) if b > a else words[:0]


def set_key(s: np.ndarray) -> int:
    return int(c.mix(np.array([c.mix(s ^ U64(0xA5A5A5A55A5A5A5A)).sum(dtype=U64) + U64(len(s))], U64)).view(np.int64)[0])


def _deal(k: int, buckets: int):
    def run(batches):
        sets, keys, held = [], [], 0

        def flush():
            nonlocal sets, keys, held
            if not held:
                return
            sizes = np.array([len(s) for s in sets])
            key, h = np.array(keys, np.int64), np.concatenate(sets)
            doc = np.repeat(np.arange(len(sets)), sizes)
            order = np.argsort(h)
            h, doc = h[order], doc[order]
            cuts = np.searchsorted(c.range_bucket(h, buckets), np.arange(buckets + 1))
            p, blobs = [], []
            for b in np.flatnonzero(np.diff(cuts)):
                part = h[cuts[b] : cuts[b + 1]]
                own, at = np.unique(doc[cuts[b] : cuts[b + 1]], return_inverse=True)
                p.append(b)
                blobs.append(c.join_arrays(np.diff(part, prepend=U64(0)), c.narrow(at), key[own], c.narrow(sizes[own])))
            sets, keys, held = [], [], 0
            none = pa.nulls(len(p), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), none, none, none, pa.array(blobs, pa.binary())], names=["p", "doc_id", "n", "key", "blob"])

        for batch in batches:
            own, sizes = [], []
            for s in shingle_sets(batch.column(1), k):
                own.append(set_key(s))
                sizes.append(len(s))
                if len(s):
                    sets.append(s)
                    keys.append(own[-1])
                    held += len(s)
                if held >= FLUSH:
                    yield from flush()
            own = np.array(own, np.int64)
            rows = batch.column(0).cast(pa.int64()).fill_null(0).to_numpy().view(U64)  # not by class alone: copies may be many
            yield pa.RecordBatch.from_arrays(
                [pa.array(c.range_bucket(c.mix(own.view(U64) ^ c.mix(rows)), buckets).astype(np.int32)), batch.column(0).cast(pa.int64()), pa.array(np.array(sizes, np.int64)), pa.array(own), pa.nulls(len(own), pa.binary())],
                names=["p", "doc_id", "n", "key", "blob"],
            )
        yield from flush()

    return run


def _repeated(parts: list[tuple[np.ndarray, ...]], buckets: int):
    """The shingles of parts that two classes hold at least, dealt by class."""
    h = np.concatenate([x[0] for x in parts])
    if not len(h):
        return
    key = np.concatenate([x[2][x[1]] for x in parts])
    n = np.concatenate([x[3][x[1]].astype(np.uint32) for x in parts])
    order = np.lexsort((key, h))
    h, key, n = h[order], key[order], n[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (key[1:] != key[:-1])  # copies count once
    h, key, n = h[new], key[new], n[new]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    held = np.diff(np.append(first, len(h)))
    df = np.repeat(held, held)
    keep = df > 1
    h, key, n, df = h[keep], key[keep], n[keep], df[keep]
    order = np.argsort(key.view(U64), kind="stable")
    h, key, n, df = h[order], key[order], n[order], df[order]
    cuts = np.searchsorted(c.range_bucket(key.view(U64), buckets), np.arange(buckets + 1))
    p, blobs = [], []
    for b in np.flatnonzero(np.diff(cuts)):
        a, z = cuts[b], cuts[b + 1]
        own, first, at = np.unique(key[a:z], return_index=True, return_inverse=True)
        p.append(b)
        blobs.append(c.join_arrays(h[a:z], c.narrow(at), own, c.narrow(n[a:z][first]), c.narrow(df[a:z])))
    none = pa.nulls(len(p), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), none, none, none, pa.array(blobs, pa.binary())], names=["p", "doc_id", "n", "key", "blob"])


def _merge(buckets: int):
    """Of a range of shingles: those of two classes at least, dealt by class, with their numbers of classes."""

    def run(batches):
        parts = []  # (hashes in ascending order, number of each one's class, classes, their sizes)
        for batch in batches:
            blob = batch.column(4)
            yield batch.filter(blob.is_null())
            for x in blob:
                if x.is_valid:
                    h, at, key, n = c.split_arrays(x.as_py())
                    parts.append((np.cumsum(h, dtype=U64), at, key, n))
        if not parts:
            return
        # by ranges of hashes, so that little is sorted and copied at once
        ranges = max(1, sum(len(x[0]) for x in parts) // SORTED)
        low, high = min(int(x[0][0]) for x in parts), max(int(x[0][-1]) for x in parts)
        ends = [np.searchsorted(x[0], np.array([low + (high - low) * k // ranges for k in range(1, ranges)], U64)) for x in parts]
        ends = [np.concatenate([[0], e, [len(x[0])]]) for e, x in zip(ends, parts, strict=True)]
        for k in range(ranges):
            own = [(x[0][e[k] : e[k + 1]], x[1][e[k] : e[k + 1]], x[2], x[3]) for x, e in zip(parts, ends, strict=True)]
            yield from _repeated(own, buckets)

    return run


def least_overlap(n: int, m: int, percent: int) -> int:
    """Fewest common elements of sets of n and m elements whose similarity reaches percent."""
    return -(-percent * (n + m) // (100 + percent))


def _subset_sizes(n: int, r: int, percent: int) -> list[tuple[int, int]]:
    """(m, common size) for each size m of a partner; r of the n elements are shared with anything."""
    out = []
    for m in range(max(1, -(-percent * n // 100)), 100 * n // percent + 1):
        k = least_overlap(n, m, percent)
        if k <= min(n, m, r) and not k == n == m:  # those are one class
            out.append((m, k))
    return out


def _select(percent: int, max_subsets: int):
    """Per class: what it can share, rarest first; its prefix of inverted lists; its subsets if it is light."""

    def run(batches):
        parts = [c.split_arrays(x.as_py()) for batch in batches for x in batch.column(0)]
        if not parts:
            return
        h = np.concatenate([p[0] for p in parts])
        key = np.concatenate([p[2][p[1]] for p in parts])
        n = np.concatenate([p[3][p[1]].astype(np.int64) for p in parts])
        df = np.concatenate([p[4].astype(np.int64) for p in parts])
        parts.clear()
        order = np.lexsort((h, df, key))
        h, key, n, df = h[order], key[order], n[order], df[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        r = np.diff(np.append(first, len(h)))
        need = -(-percent * n[first] // 100)
        out: dict[str, list] = {x: [] for x in ("key", "n", "light", "shared", "prefix", "subsets")}
        for i in np.flatnonzero(r >= need):
            a, size, shared, least = first[i], int(n[first[i]]), int(r[i]), int(need[i])
            prefix = shared - least + 1
            own, sizes, cost = h[a : a + shared], [], 0
            if size <= 4 * max_subsets:
                sizes = _subset_sizes(size, shared, percent)
                cost = sum(comb(shared, k) for _, k in sizes)
            light = bool(sizes) and cost <= min(max_subsets, int(df[a : a + prefix].sum()))
            subsets = []
            if light:
                mixed = c.mix(own ^ U64(0x5851F42D4C957F2D))
                for m, k in sizes:
                    sums = mixed[np.array(list(combinations(range(shared), k)), np.int64)].sum(axis=1, dtype=U64)
                    subsets += [{"lo": min(size, m), "hi": max(size, m), "h": int(x)} for x in c.mix(sums + U64(k)).view(np.int64)]
            for x, v in zip(out, (int(key[a]), size, light, c.join_arrays(own), own[:prefix].view(np.int64), subsets), strict=True):
                out[x].append(v)
            if len(out["key"]) >= 500:
                yield _sets_batch(out)
                out = {x: [] for x in out}
        if out["key"]:
            yield _sets_batch(out)

    return run


def _sets_batch(out: dict[str, list]) -> pa.RecordBatch:
    subset = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64()), ("h", pa.int64())]))
    kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.list_(pa.int64()), subset)
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))


def _cell_links(keys: np.ndarray, n: np.ndarray, side: np.ndarray, sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links among sets, or between the two sides of them."""
    sizes = np.array([len(x) for x in sets])
    _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    column = (np.cumsum(count > 1) - 1)[token]  # a token of one set here is in no intersection
    keep = count[token] > 1
    row, column = row[keep], column[keep]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    a, b = np.flatnonzero(side == side.min()), np.flatnonzero(side == side.max())
    common = np.zeros((len(a), len(b)))
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        i, j = np.searchsorted(column, [lo, lo + COLUMNS])
        held = np.zeros((len(sets), min(COLUMNS, int(column[-1]) + 1 - lo)), np.float32)
        held[row[i:j], column[i:j] - lo] = 1
        common += held[a] @ held[b].T  # whole numbers below 2**24, so exact
    i, j = np.nonzero(100 * common >= percent * (n[a][:, None] + n[b][None, :] - common))
    i, j = a[i], b[j]
    i, j = i[i != j], j[i != j]
    root = np.arange(len(sets))
    while True:
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        low = low[low]
        if (low == root).all():
            break
        root = low
    own = np.flatnonzero(root != np.arange(len(sets)))
    return keys[own], keys[root[own]]


def _scan(percent: int):
    """Links of each cell of rows sorted by (g, cell); a cell is of bounded size."""

    def of(held):
        if sum(map(len, held)) < 2:
            return
        t = pa.Table.from_batches(held)
        a, b = _cell_links(t["key"].to_numpy(), t["n"].to_numpy(), t["x"].to_numpy(), [c.split_arrays(x)[0] for x in t["shared"].to_pylist()], percent)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(batches):
        held, name = [], None
        for batch in batches:
            if not len(batch):
                continue
            cell = np.stack([batch.column(x).to_numpy() for x in ("g", "cell")], axis=1)
            cuts = [0, *(np.flatnonzero((cell[1:] != cell[:-1]).any(axis=1)) + 1).tolist(), len(batch)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if tuple(cell[i]) != name:
                    yield from of(held)
                    held, name = [], tuple(cell[i])
                held.append(batch.slice(i, j - i))
        yield from of(held)

    return run


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE_WORDS, percent: int = PERCENT, max_subsets: int = MAX_SUBSETS) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of docs.

    Two rows link when their sets of k-word shingles have a Jaccard similarity
    of percent / 100 or more; component_id is the least id reachable by links.
    A text of fewer than k words is one shingle; without words, or null, it has
    none and links with nothing.  Rows of equal text are linked, also when they
    share an id; a null id stays null and is not a component's name unless all
    ids of the component are null.  Other columns are not looked at.  No rows:
    no rows.
    """
    spark = docs.sparkSession
    c.importable(spark)
    parts = c.buckets_for(docs, BUCKET_BYTES, MOST_BUCKETS)
    dealt = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(c.tidy(_deal(k, parts)), _DEALT)
    merged = c.written(dealt.repartitionById(parts, F.col("p")).mapInArrow(c.tidy(_merge(parts)), _MERGED), "shared")
    meta = merged.where("blob is null").select("doc_id", "n", "key")
    blobs = merged.where("blob is not null").select("p", "blob")
    sets = c.written(blobs.repartitionById(parts, F.col("p")).select("blob").mapInArrow(c.tidy(_select(percent, max_subsets)), _SETS), "sets")

    # light: all who meet at a subset of sizes (lo, hi) are linked, lo with hi
    met = sets.where("light").select("key", "n", F.explode("subsets").alias("s")).select("key", "n", "s.*")
    of = lambda size: F.min(F.when(F.col("n") == F.col(size), F.col("key")))
    hubs = met.groupBy("lo", "hi", "h").agg(of("lo").alias("a"), of("hi").alias("b"), F.count("*").alias("c")).where("c > 1 and a is not null and b is not null")
    light = met.join(hubs, ["lo", "hi", "h"]).select("key", F.when(F.col("n") == F.col("lo"), F.col("b")).otherwise(F.col("a")).alias("hub")).where("key <> hub").select(F.least("key", "hub").alias("a"), F.greatest("key", "hub").alias("b")).distinct()

    # heavy: lists that any heavy set is in, joined where they share sets
    lists = sets.select("key", "light", F.explode("prefix").alias("h"))
    hub = lists.groupBy("h").agg(F.min("key").alias("hub"), F.count("*").alias("c"), F.min("light").alias("light")).where("c > 1 and not light").select("h", "hub")
    entries = c.written(lists.join(hub, "h").select("key", "h", "hub"), "lists")
    cohorts = c.written(components(entries.select("key", "hub"), "key", "hub").select(F.col("node").alias("key"), F.col("component").alias("g")), "cohorts")
    large = cohorts.groupBy("g").agg(F.count("*").alias("c")).where(F.col("c") > MOST_COHORT).select("g")
    listed = entries.join(cohorts.join(large, "g", "left_semi"), "key").select("key", F.col("h").alias("g"))
    grouped = c.written(cohorts.join(large, "g", "left_anti").select("key", "g").unionByName(listed), "grouped")
    blocks = grouped.groupBy("g").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    cells = grouped.join(blocks, "g").withColumn("x", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("g", (F.least("x", "y") * F.col("blocks") + F.greatest("x", "y")).alias("cell"), "x", "key").join(sets.select("key", "n", "shared"), "key")
    heavy = cells.repartition(max(parts, c.buckets_for(sets, BUCKET_BYTES, MOST_BUCKETS)), "g", "cell").sortWithinPartitions("g", "cell").mapInArrow(c.tidy(_scan(percent)), "a long, b long")
    all_links = c.written(heavy.unionByName(light), "links")

    of_class = components(all_links, "a", "b").select(F.col("node").alias("key"), "component")
    meta = parted(meta, "doc_id")
    return told(meta, least_of_component(classes_of(meta.where("n > 0"), "doc_id"), of_class)).select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """docs without the rows whose id isn't their component's least; all columns are kept, whatever they are called.

    Rows without words and rows without an id are kept; rows that share an id
    are kept or dropped alike.  The ids that go are written first, so Spark
    knows their size and broadcasts them only if they are few.
    """
    (name,) = c.free_names(docs, "gone")
    gone = jaccard_components(docs, id_col, text_col, **kw).where("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(c.written(gone.coalesce(c.partitions(docs.sparkSession)), "gone"), c.own(id_col) == F.col(name), "left_anti")
