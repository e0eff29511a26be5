"""Near-duplicate vectors through a pivot-permutation index.

Every vector is described by its nearest pivots, in order.  Pivots come from a
bounded sample; every vector is indexed.  Inverted lists hold the vectors by
pairs of their first pivots, so that whoever meets in a list shares two pivots
at least; more shared pivots may be asked for.  Each candidate is verified by
its cosine.  A pair that shares several lists counts in the one of its two
lowest shared pivots only.

Equal vectors of a label are one entry.  A list is worked on in blocks of
bounded size, all against all; it gives link counts and a spanning forest of
its links, never its pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from orefield.llm import common as c
from orefield.llm.components import classes_of, components, least_of_component, parted, told

COSINE = 0.98
#: Nearest pivots that describe a vector, and how many two vectors must share (2 at least).
NEAREST, SHARED = 7, 2
#: Vectors that pivots are chosen from.
SAMPLE = 8192
#: Entries of a list that are compared at once.
BLOCK = 1024
#: Numbers of pivots; the least that makes the lists of the largest label short is taken.
PIVOTS = (64, 128, 256, 512, 1024, 2048, 4096)
SHORT = 64
APART = 0.8


def choose_pivots(sample: np.ndarray, k: int) -> np.ndarray:
    """k unit vectors, each the one of the sample that is farthest from those before; random ones where none is left with a cosine below APART to all: copies of each other, as pivots, would tell neighbours apart."""
    rng = np.random.default_rng(11)
    out = [sample[0]]
    nearest = sample @ out[0]
    while len(out) < min(k, len(sample)):
        i = int(nearest.argmin())
        if nearest[i] > APART:
            break
        out.append(sample[i])
        nearest = np.maximum(nearest, sample @ out[-1])
    more = rng.normal(size=(k - len(out), sample.shape[1]))
    return np.vstack([*out, *more / np.linalg.norm(more, axis=1, keepdims=True)])


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # no overflow of squares
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def nearest_pivots(rows: np.ndarray, pivots: np.ndarray, m: int) -> np.ndarray:
    """Of each unit vector, the m nearest pivots in order."""
    return np.argsort(-(rows @ pivots.T), axis=1, kind="stable")[:, :m]


def _masks(perms: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros((len(perms), k // 64), np.uint64)
    for j in range(perms.shape[1]):
        np.bitwise_or.at(out, (np.arange(len(perms)), perms[:, j] // 64), np.uint64(1) << (perms[:, j] % 64).astype(np.uint64))
    return out


def _below(b: int, k: int) -> np.ndarray:
    return np.array([(1 << max(0, min(64, b - 64 * w))) - 1 for w in range(k // 64)], np.uint64)


_POSTS = "bucket long, lo int, hi int, side int, key long, weight long, kind int, vector binary"


def _post(pivots_of, k: int, m: int):
    """A row for each list of each vector: its bucket, and the pair of pivots that names it."""

    def run(batches):
        for batch in batches:
            keys, labels, weights, vectors = batch.columns
            lengths = vectors.value_lengths().to_numpy()
            for dim in np.unique(lengths):
                own = np.flatnonzero(lengths == dim)
                flat = vectors.take(pa.array(own)).flatten()
                kind = np.float32 if pa.types.is_float32(flat.type) else np.float64
                raw = flat.to_numpy().astype(kind).reshape(len(own), dim)
                perms = np.sort(nearest_pivots(unit(raw), pivots_of(int(dim)), m), axis=1)
                blobs = [r.tobytes() for r in raw]
                label = labels.take(pa.array(own)).to_numpy()
                key, weight = keys.take(pa.array(own)).to_numpy(), weights.take(pa.array(own)).to_numpy()
                for i, j in combinations(range(perms.shape[1]), 2):
                    lo, hi = perms[:, i].astype(np.int32), perms[:, j].astype(np.int32)
                    bucket = c.mix(label.view(np.uint64) ^ (lo.astype(np.uint64) << np.uint64(20)) ^ (hi.astype(np.uint64) << np.uint64(4)) ^ np.uint64(int(dim) << 40)).view(np.int64)
                    n = len(own)
                    yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(lo), pa.array(hi), pa.array((c.mix(key.view(np.uint64)) >> np.uint64(33)).astype(np.int32)), pa.array(key), pa.array(weight), pa.array(np.full(n, raw.itemsize, np.int32)), pa.array(blobs, pa.binary())], names=["bucket", "lo", "hi", "side", "key", "weight", "kind", "vector"])

    return run


def _links_of(rows: list[pa.Table | pa.RecordBatch], pivots_of, k: int, m: int, shared: int, cosine: float):
    """Link counts and a forest of the links of one cell: rows of one list, or of two blocks of it."""
    t = pa.Table.from_batches(rows)
    key, weight, side = t["key"].to_numpy(), t["weight"].to_numpy(), t["x"].to_numpy()
    raw = np.frombuffer(b"".join(t["vector"].to_pylist()), np.float32 if t["kind"][0].as_py() == 4 else np.float64).reshape(len(t), -1)
    x = unit(raw)
    hi = t["hi"][0].as_py()
    two = side.min() != side.max()
    a = np.flatnonzero(side == side.min())
    b = np.flatnonzero(side == side.max())
    near = x[a] @ x[b].T >= cosine
    i, j = np.nonzero(near)
    i, j = a[i], b[j]
    if not two:
        keep = i < j
        i, j = i[keep], j[keep]
    if not len(i):
        return None
    masks = _masks(nearest_pivots(x, pivots_of(x.shape[1]), m), k)
    both = masks[i] & masks[j]
    keep = (np.bitwise_count(both & _below(hi, k)).sum(axis=1) == 1) & (np.bitwise_count(both).sum(axis=1) >= shared)
    i, j = i[keep], j[keep]
    if not len(i):
        return None
    n = np.bincount(i, weight[j], len(t)) + np.bincount(j, weight[i], len(t))
    root = np.arange(len(t))
    while True:
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        low = low[low]
        if (low == root).all():
            break
        root = low
    own = np.flatnonzero(n)
    return pa.RecordBatch.from_arrays([pa.array(key[own]), pa.array(n[own].astype(np.int64)), pa.array(key[root[own]])], names=["key", "n", "root"])


def _verify(pivots_of, k: int, m: int, shared: int, cosine: float):
    """Cells in a row, sorted by (bucket, cell); a cell is of bounded size."""

    def run(batches):
        held, name = [], None
        for batch in batches:
            if not len(batch):
                continue
            cell = np.stack([batch.column(x).to_numpy() for x in ("bucket", "cell")], axis=1)
            cuts = [0, *(np.flatnonzero((cell[1:] != cell[:-1]).any(axis=1)) + 1).tolist(), len(batch)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if name is not None and tuple(cell[a]) != name:
                    out = _links_of(held, pivots_of, k, m, shared, cosine) if sum(map(len, held)) > 1 else None
                    if out is not None:
                        yield out
                    held = []
                name = tuple(cell[a])
                held.append(batch.slice(a, b - a))
        if sum(map(len, held)) > 1 and (out := _links_of(held, pivots_of, k, m, shared, cosine)) is not None:
            yield out

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, nearest: int = NEAREST, shared: int = SHARED, pivots: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of vectors.

    Two rows link when the index finds them, their labels are equal and not
    null, their vectors are equally long and their cosine, in double
    precision, is at least cosine.  A vector that is null, empty, zero, or
    holds a null or non-finite number links with nothing.  n_links counts rows,
    equal ones included; component_id is the least id reachable (null ids are
    passed over), the row's own without links; kept tells whether the two are
    equal (null for a null id).  Other columns are not looked at.
    """
    spark = vectors.sparkSession
    c.importable(spark)
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = F.coalesce(F.col("l").isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("v"), F.col(label_col).cast("string").alias("l"))
    rows = rows.select("vec_id", "v", "l", F.when(valid, F.xxhash64("l", "v")).alias("key"))
    meta = rows.select("vec_id", "key")
    entries = rows.where("key is not null").groupBy("key").agg(F.count("*").alias("weight"), F.first(F.struct("l", "v")).alias("e"))
    entries = c.written(entries.select("key", F.xxhash64("e.l").alias("label"), "weight", F.col("e.v").alias("v")), "entries")

    largest = entries.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    lists = nearest * (nearest - 1) // 2
    k = pivots or next((x for x in PIVOTS if largest * lists / (x * (x - 1) / 2) <= SHORT), PIVOTS[-1])
    sample = [r.v for r in entries.orderBy(F.xxhash64("key", F.lit(3)), "key").limit(SAMPLE).select("v").collect()]
    fitted = {}
    if sample:
        dim = max(set(map(len, sample)), key=lambda n: (sum(len(x) == n for x in sample), n))
        fitted[dim] = choose_pivots(unit(np.array([x for x in sample if len(x) == dim])), k)
    known = spark.sparkContext.broadcast(fitted)

    def pivots_of(dim: int) -> np.ndarray:
        if dim not in known.value:  # vectors of a length that the sample has fewer of
            known.value[dim] = unit(np.random.default_rng(dim).normal(size=(k, dim)))
        return known.value[dim]

    posts = entries.mapInArrow(_post(pivots_of, k, nearest), _POSTS)
    names = entries.mapInArrow(_post(pivots_of, k, nearest), _POSTS).groupBy("bucket").agg(F.count("*").alias("c")).where(F.col("c") > 1)
    # a list of c entries has its blocks by hash of the entry; a cell is two of them, or one
    names = names.withColumn("blocks", F.ceil(F.col("c") / BLOCK).cast("int"))
    own = posts.join(names.select("bucket", "blocks"), "bucket").withColumn("x", F.pmod("side", "blocks"))
    own = own.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    own = own.withColumn("cell", F.least("x", "y") * F.col("blocks") + F.greatest("x", "y"))
    cells = own.select("bucket", "cell", "x", "hi", "key", "weight", "kind", "vector").repartition(c.partitions(spark), "bucket", "cell").sortWithinPartitions("bucket", "cell")
    links = c.written(cells.mapInArrow(_verify(pivots_of, k, nearest, shared, cosine), "key long, n long, root long"), "links")

    counts = links.groupBy("key").agg(F.sum("n").alias("n"))
    named = components(links, "key", "root").select(F.col("node").alias("key"), "component")
    about = entries.select("key", "weight").join(counts, "key", "left").select("key", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    meta = parted(meta, "vec_id")
    classes = classes_of(meta.where("key is not null"), "vec_id")
    full = told(meta, about.join(least_of_component(classes, named), "key")).withColumn("component_id", F.coalesce("least", "vec_id"))
    return full.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
