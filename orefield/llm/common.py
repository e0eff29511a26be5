"""Shared pieces: scratch tables, vectorised word hashing, block packing.

Word hashing works on the UTF-8 bytes of a whole Arrow column at once.  The
hash of a word is a polynomial over its bytes, read off prefix sums modulo
2**64 (the base is odd, so it has an inverse and a word's hash doesn't depend
on where it stands).  Hashes are 64 bits wide; two different words among n
collide with probability of about n*n / 2**65.
"""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from orefield.sources.scratch import shared_path as scratch_path, written  # noqa: F401

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_CODES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | U64(1)

#: Bytes handled at once; a longer document is handled alone.
BLOCK_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Word classes as tables over (lower-cased) bytes; bytes of non-ASCII letters are 128 and above.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM_OR_WIDE = np.zeros(256, bool)
ALNUM_OR_WIDE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def importable(spark: SparkSession) -> None:
    """Send this package to the executors of a cluster, once per context."""
    sc = spark.sparkContext
    if sc.master.startswith("local[") or sc.master == "local" or getattr(sc, "_orefield_sent", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = os.path.join(tempfile.mkdtemp(prefix="orefield-"), "orefield.zip")
    with zipfile.ZipFile(out, "w") as z:
        for d, _, names in os.walk(top):
            for n in names:
                if n.endswith(".py"):
                    p = os.path.join(d, n)
                    z.write(p, os.path.relpath(p, os.path.dirname(top)))
    sc.addPyFile(out)
    sc._orefield_sent = True


#: Called where a worker turns to another operator, to give back what it remembers for its last one.
forgetters: list = []


def forget() -> None:
    for f in forgetters:
        f()


def trim() -> None:
    """Give memory that Python no longer uses back to the machine: workers live on and idle beside other stages' workers."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def tidy(run, keep: bool = False):
    """run over Arrow batches, in a worker that first forgets what others remembered (unless keep) and trims its memory before and after."""

    def own(batches):
        if not keep:
            forget()
            trim()
        try:
            yield from run(batches)
        finally:
            trim()

    return own


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def buckets_for(df: DataFrame, bucket_bytes: int, most: int) -> int:
    """Buckets of about bucket_bytes for what df reads, where Spark knows its size: as many as there are shuffle partitions at least, and most at most."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    size = sum(x for x in sizes if x < 1 << 62)  # more stands for an unknown size
    return max(partitions(df.sparkSession), min(most, -(-size // bucket_bytes)))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until no column of df has it."""
    taken, out = {x.lower() for x in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def own(name: str) -> Column:
    """A column by its literal name, dots and quotes included."""
    return F.col(f"`{name.replace('`', '``')}`")


def map_rows(df: DataFrame, run, schema: StructType | str) -> DataFrame:
    """mapInArrow by places of columns, whatever they are called (the method itself takes dots in names for fields)."""
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    names = schema.names

    def named(batches):
        for batch in run(batches):
            yield pa.RecordBatch.from_arrays(batch.columns, names=names)

    return df.toDF(*(f"c{k}" for k in range(len(df.columns)))).mapInArrow(named, schema)


def ragged(begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers begins, begins + 1, ... of each run of counts."""
    ends = np.cumsum(counts)
    return np.repeat(begins - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)


# ---------------------------------------------------------------- texts as bytes

def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES):
    """(first row, rows, bytes, offsets) of runs of rows of about limit bytes; null counts as empty."""
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    if column.null_count:  # bytes below a null are not promised to be none
        ok = column.is_valid().to_numpy(zero_copy_only=False)
        lengths = np.where(ok, np.diff(offsets), 0)
        if lengths.sum() != offsets[-1] - offsets[0]:
            column = column.fill_null("")
            yield from text_blocks(column, limit)
            return
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        a, b = offsets[lo], offsets[hi]
        yield lo, hi - lo, data[a:b], offsets[lo : hi + 1] - a
        lo = hi


_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, BLOCK_BYTES + 1)
        for k, b in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, b, U64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=U64)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def word_bounds(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of each text, and the number of the first word of each text (one more at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = table[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words of (lower-cased) bytes."""
    power, inverse = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTE_CODES[data] * power[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts])


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive entries; the caller drops windows that cross texts."""
    if len(words) < k:
        return np.zeros(0, U64)
    out = np.zeros(len(words) - k + 1, U64)
    for j in range(k):
        out *= U64(_BASE)
        out += words[j : j + len(out)]
    return mix(out ^ U64(k))


# ---------------------------------------------------------------- packed integers

def pack(values: np.ndarray) -> bytes:
    """Bytes of an integer array, all first bytes first, then all second bytes, and so on: easier to compress."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T.tobytes() if len(values) else b""


def unpack(raw: memoryview | bytes, dtype, n: int) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size).reshape(size, n).T).view(dtype).reshape(n)


def range_bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """Number of the bucket, of equally wide ones, that a 64-bit hash falls in; ascending with the hash."""
    return ((h >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)


_DTYPES = [np.dtype(x) for x in ("u1", "u2", "u4", "u8", "i8")]


def narrow(values: np.ndarray) -> np.ndarray:
    """The values in the smallest unsigned type of 1, 2 or 4 bytes that holds them."""
    top = int(values.max()) if len(values) else 0
    return values.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32)


def join_arrays(*arrays: np.ndarray) -> bytes:
    """Integer arrays as one value: their number, each one's type and length, then their packed bytes."""
    head = [np.uint32(len(arrays)).tobytes()]
    for a in arrays:
        head.append(np.uint8(_DTYPES.index(a.dtype)).tobytes() + np.uint32(len(a)).tobytes())
    return b"".join([*head, *map(pack, arrays)])


def split_arrays(raw: bytes) -> list[np.ndarray]:
    view, out = memoryview(raw), []
    k = int(np.frombuffer(view, np.uint32, 1)[0])
    at = 4 + 5 * k
    for i in range(k):
        dtype = _DTYPES[view[4 + 5 * i]]
        n = int.from_bytes(view[5 + 5 * i : 9 + 5 * i], "little")
        out.append(unpack(view[at:], dtype, n))
        at += n * dtype.itemsize
    return out
