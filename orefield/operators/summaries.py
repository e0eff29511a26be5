"""Summaries of ordered events in batch: windows of the last elements, DGIM, decay and reservoirs.

Places in the order come from relational.numbered(), so no task sorts all
events.  The streaming counterparts are in orefield.streaming.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from orefield.operators.relational import numbered, place, top

WINDOWS = (5, 25, 50, 100, 256)
DECAY = 1e-6


def ordered(events: DataFrame, time: str, tie: str) -> DataFrame:
    """events with seq: 0, 1, 2, ... by time, then tie."""
    return numbered(events, time, [tie], "seq")


def exact_window_counts(bits: DataFrame, windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """(window, ones): how many of the last window elements are 1; bits has seq and bit."""
    n = bits.agg(F.count("*").alias("n"))  # one row
    last = bits.crossJoin(F.broadcast(n)).where(F.col("seq") >= F.col("n") - max(windows))
    return last.agg(*(F.coalesce(F.sum(F.when(F.col("seq") >= F.col("n") - w, F.col("bit"))), F.lit(0)).alias(f"w{w}") for w in windows)).select(F.explode(F.array(*(F.struct(F.lit(w).alias("window"), F.col(f"w{w}").cast("long").alias("ones")) for w in windows))).alias("x")).select("x.*")


def _levels(ones: int) -> list[int]:
    """How many newer ones each level of buckets has before it, of so many in all.

    Each size has one or two buckets, so their numbers are the digits of ones
    in bijective base 2, lowest first: level l begins after all lower digits.
    """
    out, before, size = [], 0, 1
    while ones > 0:
        digit = 2 if ones % 2 == 0 else 1
        out.append(before)
        before, size, ones = before + size * digit, size * 2, (ones - digit) // 2
    return out


def dgim_buckets(bits: DataFrame) -> DataFrame:
    """(level, bucket, ones, last): the DGIM buckets after all bits, newest first; last is the place of a bucket's newest one.

    A closed form: the bucket of a one follows from how many ones came after
    it.  bits has seq and bit.
    """
    ones = numbered(bits.where("bit = 1"), "seq", [], "i")
    m = bits.where("bit = 1").count()
    starts = _levels(m) or [0]
    own = ones.withColumn("rank", F.lit(m - 1) - F.col("i")).withColumn("level", place(F.col("rank"), starts[1:]))
    bucket = F.floor((F.col("rank") - F.element_at(F.array(*(F.lit(x).cast("long") for x in starts)), F.col("level") + 1)) / F.pow(F.lit(2.0), F.col("level"))).cast("long")
    return own.groupBy("level", bucket.alias("bucket")).agg(F.count("*").alias("ones"), F.max("seq").alias("last"))


def dgim_counts(bits: DataFrame, windows: tuple[int, ...] = WINDOWS, whole_oldest: bool = False) -> DataFrame:
    """(window, ones): DGIM's estimate of the ones among the last window elements.

    The buckets whose newest one is in the window count in full, the oldest of
    them by half, rounded up (a single one is in the window for certain);
    whole_oldest counts it in full and by half, rounded down.
    """
    n = bits.agg(F.count("*").alias("n"))  # one row
    rows = dgim_buckets(bits).crossJoin(F.broadcast(n)).crossJoin(F.broadcast(bits.sparkSession.createDataFrame([(w,) for w in windows], "window int")))
    inside = rows.where(F.col("last") >= F.col("n") - F.col("window")).groupBy("window").agg(F.sum("ones").alias("s"), F.min(F.struct("last", "ones"))["ones"].alias("oldest"))
    estimate = F.col("s") + F.floor(F.col("oldest") / 2) if whole_oldest else F.col("s") - F.col("oldest") + F.ceil(F.col("oldest") / 2)
    every = bits.sparkSession.createDataFrame([(w,) for w in windows], "window int")
    return every.join(inside, "window", "left").select("window", F.coalesce(estimate, F.lit(0)).cast("long").alias("ones"))


def decayed_weights(elements: DataFrame, c: float = DECAY) -> DataFrame:
    """(element, weight): the sum over an element's arrivals of (1 - c) to the number of arrivals after each; elements has seq, element.

    The first arrival of all decays once more, as a stream would have it that
    starts from an empty window.
    """
    n = elements.agg(F.count("*").alias("n"))  # one row
    age = F.col("n") - 1 - F.col("seq") + (F.col("seq") == 0).cast("long")
    return elements.crossJoin(F.broadcast(n)).groupBy("element").agg(F.sum(F.pow(F.lit(1.0 - c), age)).alias("weight"))


def reservoir(rows: DataFrame, key: str, size: int = 1000, seed: int = 0) -> DataFrame:
    """A uniform sample of size rows: those of the smallest hashes; the same in every run and order."""
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    return top(rows.withColumn("__draw", draw), size, "__draw").drop("__draw")
