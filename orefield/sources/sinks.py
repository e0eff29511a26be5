"""Sinks: timestamped dumps, top keys, JSON and metrics."""

from __future__ import annotations

import logging
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

log = logging.getLogger("orefield")


def timestamped(directory: str, name: str = "", now: datetime | None = None) -> str:
    """directory/name and the present second, as a path for one run's results."""
    at = (now or datetime.now()).strftime("%Y-%m-%dT%H-%M-%S")
    return f"{directory.rstrip('/')}/{f'{name} {at}'.strip()}"


def dump(df: DataFrame, directory: str, name: str = "", kind: str = "parquet") -> str:
    """Write df to a timestamped folder and return its path."""
    path = timestamped(directory, name)
    df.write.format(kind).save(path)
    log.info("wrote %s", path)
    return path


def top_keys(df: DataFrame, key: str, count: str, path: str, n: int = 10) -> None:
    """The n keys of highest count, ties by key, one on a line."""
    top = df.orderBy(F.desc(count), key).limit(n)
    top.select(F.col(key).cast("string").alias("value")).coalesce(1).write.text(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def write_metrics(spark: SparkSession, path: str, **metrics: float) -> None:
    """One row of named numbers, as JSON."""
    spark.createDataFrame([tuple(float(x) for x in metrics.values())], ", ".join(f"`{k}` double" for k in metrics)).coalesce(1).write.json(path)


def show_batches(df: DataFrame, n: int = 10, order: list | None = None, trigger: dict | None = None):
    """Start a stream that prints the first n rows of each batch's result, in an order; returns the running query."""

    def show(batch: DataFrame, number: int) -> None:
        rows = (batch.orderBy(*order) if order else batch).limit(n)
        log.info("batch %d\n%s", number, rows._show_string(n, False))

    return df.writeStream.outputMode("update").foreachBatch(show).trigger(**(trigger or {"availableNow": True})).start()
