"""Token ids in a binary format of shuffled planes.

A file set is a Parquet table of frames.  A frame holds the ids of whole
documents, one after the other, cut into blocks of BLOCK_IDS; each block is
transposed into byte planes (all lowest bytes first) or bit planes, each plane
is compressed with zstandard, and the frame's chunk index gives the offset and
length of every plane.  Frames are numbered in ascending order of documents;
beside them stands an index table of the frames with their first document,
position and length.  Frames are written by Spark's own writer, so a task that
is lost and run again leaves one copy, and any store will do.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from orefield.llm import common as c
from orefield.llm.tokens import encoder

BLOCK_IDS = 16384
#: Ids after which a frame is closed; a longer document has a frame of its own.
FRAME_IDS = 65536
LEVEL = 3

_FRAMES = "part int, frame int, first long, n_ids long, n_docs int, kind string, docs binary, chunks binary, planes binary"


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The planes of a block of unsigned 32-bit ids: 4 of bytes or 32 of bits, lowest first."""
    rows = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(len(ids), 4)
    if kind == "bytes":
        return [rows[:, k].tobytes() for k in range(4)]
    bits = np.unpackbits(rows, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    if kind == "bytes":
        return np.stack([np.frombuffer(p, np.uint8, n) for p in planes], axis=1).copy().view("<u4").reshape(n)
    bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
    return np.packbits(bits, axis=1, bitorder="little").view("<u4").reshape(n)


def to_frame(ids: np.ndarray, kind: str = "bytes", block: int = BLOCK_IDS, level: int = LEVEL) -> tuple[bytes, bytes]:
    """(chunk index, planes): the index has, for each plane of each block, its offset and length, after the block size."""
    press = zstandard.ZstdCompressor(level=level)
    planes = [press.compress(p) for i in range(0, len(ids), block) for p in to_planes(ids[i : i + block], kind)]
    lengths = np.array([len(p) for p in planes], np.int64)
    return c.join_arrays(np.array([block], np.uint32), (np.cumsum(lengths) - lengths).astype(np.uint64), lengths.astype(np.uint32)), b"".join(planes)


def from_frame(chunks: bytes, planes: bytes, n: int, kind: str = "bytes") -> np.ndarray:
    block, offsets, lengths = c.split_arrays(chunks)
    each = 4 if kind == "bytes" else 32
    view, press, out = memoryview(planes), zstandard.ZstdDecompressor(), []
    for k, i in enumerate(range(0, n, int(block[0]))):
        own = range(k * each, (k + 1) * each)
        out.append(from_planes([press.decompress(view[int(offsets[j]) : int(offsets[j]) + int(lengths[j])]) for j in own], min(int(block[0]), n - i), kind))
    return np.concatenate(out) if out else np.zeros(0, "<u4")


def write_tokens(docs: DataFrame, path: str, definition: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", kind: str = "bytes", specials: bool = False) -> None:
    """Write the ids of every whole text, each with end_id after it, in ascending order of id to path.

    definition is the text of a tokenizers file.  With specials, the written
    names of its special tokens are those tokens, as the library reads them by
    default; else they are text, so that a text can't forge one.  Null ids come first and stay
    null; a null text is empty; rows that share an id stand side by side, in an
    order that depends on their texts only.  Other columns are not looked at.
    No rows: tables without rows.
    """
    spark = docs.sparkSession
    c.importable(spark)
    shared = spark.sparkContext.broadcast(definition)

    def run(batches):
        from pyspark import TaskContext

        part, frame, first = TaskContext.get().partitionId(), 0, 0
        enc = encoder(shared.value)
        ids: list[np.ndarray] = []
        keys: list[pa.Array] = []
        sizes: list[np.ndarray] = []
        held = 0

        def close():
            nonlocal frame, first, held, ids, keys, sizes
            flat = np.concatenate(ids)
            key = pa.concat_arrays(keys)
            chunks, planes = to_frame(flat, kind)
            index = c.join_arrays(key.fill_null(0).to_numpy(), key.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8), np.concatenate(sizes).astype(np.uint32))
            row = [[part], [frame], [first], [len(flat)], [len(key)], [kind], [index], [chunks], [planes]]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=[x.split()[0] for x in _FRAMES.split(", ")])
            frame, first, held, ids, keys, sizes = frame + 1, first + len(flat), 0, [], [], []

        for batch in batches:
            row = 0
            for rows, own, n in enc.encode(batch.column(1), specials):
                own, n = np.insert(own.astype(np.uint32), np.cumsum(n), end_id), n + 1
                ends = np.cumsum(n)
                at = 0
                while at < rows:  # the rows up to the one that fills a frame
                    begin = ends[at - 1] if at else 0
                    to = min(rows, int(np.searchsorted(ends, begin + FRAME_IDS - held)) + 1)
                    ids.append(own[begin : ends[to - 1]])
                    keys.append(batch.column(0).slice(row + at, to - at))
                    sizes.append(n[at:to])
                    held += int(ends[to - 1] - begin)
                    at = to
                    if held >= FRAME_IDS:
                        yield from close()
                row += rows
        if keys:
            yield from close()

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # a hash parts rows that share an id; equal rows may stand in either order
    ordered = own.repartitionByRange(c.partitions(spark), "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    ordered.mapInArrow(c.tidy(run, keep=True), _FRAMES).write.parquet(f"{path}/frames")
    frames = spark.read.schema(_FRAMES).parquet(f"{path}/frames").select("part", "frame", "first", "n_ids", "n_docs")
    # one row for each partition that was written
    totals = frames.groupBy("part").agg(F.sum("n_ids").alias("n"), F.count("*").alias("frames"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), "n", "frames")
    totals.write.parquet(f"{path}/parts")
    spark.read.schema(totals.schema).parquet(f"{path}/parts").select("part", "start").join(frames, "part").select("part", "frame", (F.col("start") + F.col("first")).alias("start"), "n_ids", "n_docs").write.parquet(f"{path}/index")


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document of a file set, decoded from its planes.

    start is the number of ids before the document.
    """

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                part, frame, first, n, _, kind, docs, chunks, planes = (x[i].as_py() for x in batch.columns)
                ids = from_frame(chunks, planes, n, kind)
                key, valid, sizes = c.split_arrays(docs)
                ends = np.cumsum(sizes.astype(np.int64))
                own = [ids[z - s : z] for z, s in zip(ends, sizes, strict=True)]
                out = [pa.array(key, mask=valid == 0), pa.array(np.full(len(key), part, np.int32)), pa.array(first + ends - sizes), pa.array(sizes.astype(np.int64)), pa.array([zlib.crc32(x.tobytes()) for x in own], pa.int64())]
                names = ["doc_id", "part", "at", "n_tokens", "ids_crc32"]
                if with_ids:
                    out.append(pa.array(own, pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names=names)

    ids = ", ids array<long>" if with_ids else ""
    docs = spark.read.schema(_FRAMES).parquet(f"{path}/frames").mapInArrow(run, "doc_id long, part int, at long, n_tokens long, ids_crc32 long" + ids)
    parts = spark.read.schema("part int, start long").parquet(f"{path}/parts")  # as many rows as partitions were written
    docs = docs.join(F.broadcast(parts), "part").withColumn("start", F.col("start") + F.col("at"))
    return docs.select("doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids)
