"""Streaming sources: sockets, replayed files and random bits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def socket_lines(spark: SparkSession, host: str = "localhost", port: int = 9999) -> DataFrame:
    """Lines from a socket; for development only, as a socket can't be read twice."""
    return spark.readStream.format("socket").option("host", host).option("port", port).load()


def replayed_files(spark: SparkSession, path: str, schema: T.StructType | str, files_per_batch: int = 1, kind: str = "parquet") -> DataFrame:
    """Files of a folder as a stream, oldest first, so many in each batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(kind).load(path)


def write_replay(events: DataFrame, path: str, time_column: str, interval_seconds: int) -> int:
    """Write events as one Parquet file for each interval of their time that has any; returns the number of files.

    replayed_files() then yields an interval in each batch, as a generator on a
    socket would that sleeps between intervals.  One job writes all files, an
    interval in each task.  Files are replayed in the order of their times of
    modification, which are set afterwards, so the store must keep them.
    Events without a time are left out.
    """
    spark = events.sparkSession
    at = F.floor(F.unix_timestamp(F.col(time_column)) / interval_seconds)
    own = events.where(F.col(time_column).isNotNull())
    low, high = own.agg(F.min(at), F.max(at)).first()
    if low is None:
        own.limit(0).write.parquet(path)
        return 0
    own.repartitionById(high - low + 1, (at - low).cast("int")).sortWithinPartitions(time_column).write.parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = sorted((f for f in fs.listStatus(where) if f.getPath().getName().startswith("part-")), key=lambda f: f.getPath().getName())
    now = max(f.getModificationTime() for f in files)
    kept = 0
    for f in files:  # an empty range of times still has the first task's file
        if f.getPath().getName().startswith("part-00000") and not spark.read.schema(events.schema).parquet(f.getPath().toString()).limit(1).count():
            fs.delete(f.getPath(), False)
            continue
        fs.setTimes(f.getPath(), now - 1000 * (len(files) - kept), -1)
        kept += 1
    return kept


def random_bits(spark: SparkSession, rows_per_second: int = 10, ones: float = 0.2, seed: int = 0) -> DataFrame:
    """(timestamp, seq, bit): an endless stream of bits that are 1 with a probability of ones."""
    rate = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    draw = F.pmod(F.xxhash64("value", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rate.select("timestamp", F.col("value").alias("seq"), (draw < ones).cast("int").alias("bit"))
