"""Relational operators that the mining ones are made of.

Each is one declarative expression; Spark picks broadcast or shuffle joins by
the sizes it knows, and splits skewed partitions of shuffle joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def semi(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of left that have a partner."""
    return left.join(right.select(*keys), keys, "left_semi")


def anti(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of left that have none; null keys have none."""
    return left.join(right.select(*keys), keys, "left_anti")


def top(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first n rows of an order, by a heap in each task."""
    return df.orderBy(*order).limit(n)


def top_per_group(df: DataFrame, group: list[str], n: int, *order: Column | str) -> DataFrame:
    """The first n rows of each group.  Tasks cut their part of a group before it is shuffled."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank")


def hashed_sample(df: DataFrame, key: str, share: float, seed: int = 0) -> DataFrame:
    """About that share of rows, the same for equal keys in every run."""
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long")
    return df.where(draw < int(share * (1 << 32)))


def chunked(df: DataFrame, key: str, n: int, name: str = "chunk") -> DataFrame:
    """df with a number in [0, n) that parts it at random, without repetition."""
    return df.withColumn(name, F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))


def having_more_than(df: DataFrame, keys: list[str], threshold: int, name: str = "n") -> DataFrame:
    """Counts of keys that are above the threshold."""
    return df.groupBy(*keys).agg(F.count("*").alias(name)).where(F.col(name) > threshold)


def first_label(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key."""
    return top_per_group(df, [key], 1, *order)


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as there are threads, if its input has fewer.

    For operators that compute much on each row; a large input has enough
    partitions, and is not moved.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def place(x: Column, cuts: list) -> Column:
    """How many of the ascending numbers in cuts are at most x, by bisection; that of null is 0."""

    def among(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(x >= F.lit(cuts[middle]), among(middle + 1, high)).otherwise(among(low, middle))

    return among(0, len(cuts))


def numbered(df: DataFrame, order: str, ties: list[str], name: str = "position", pieces: int | None = None) -> DataFrame:
    """df with 0, 1, 2, ... in ascending order of a number or timestamp, then of ties, nulls first.

    Ranges of the order (approximate quantiles) are counted, and numbered on
    their own from what is before them: no task sees more than a range.
    """
    spark = df.sparkSession
    pieces = pieces or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    kind = df.schema[order].dataType.typeName()
    key = (F.unix_micros(F.col(order).cast("timestamp")) if kind.startswith("timestamp") or kind == "date" else F.col(order)).cast("double")
    cuts = df.agg(F.percentile_approx(key, [k / pieces for k in range(1, pieces)], pieces * 100)).first()[0] or []
    cuts = sorted(set(cuts))
    ranged = df.withColumn("__key", key).withColumn("__range", F.when(F.col("__key").isNull(), -1).otherwise(place(F.col("__key"), cuts))).drop("__key")
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("__range").count().select("__range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start"))  # a row for each range
    local = F.row_number().over(Window.partitionBy("__range").orderBy(order, *ties))
    return ranged.withColumn("__local", local).join(F.broadcast(starts), "__range").withColumn(name, F.col("__start") + F.col("__local") - 1).drop("__range", "__start", "__local")
