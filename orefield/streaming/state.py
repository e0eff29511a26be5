"""Stateful stream summaries: reservoirs, DGIM and decaying windows.

State is kept for each value of a key that the caller names, so streams of
many keys are spread; within a batch, rows are taken in the order of one
or more sequence columns, since a batch itself has no order.  State lives in Spark's
checkpointed store and survives batches and executors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from orefield.operators.summaries import DECAY, WINDOWS


def _places(seq: str | tuple[str, ...]) -> list[Column]:
    return [F.col(x).cast("long").alias(f"seq{k}") for k, x in enumerate((seq,) if isinstance(seq, str) else seq)]


def _in_order(batches: Iterator[pd.DataFrame], column: str) -> np.ndarray:
    """A column's values in the order of the sequence columns, the first of them foremost."""
    parts = list(batches)
    rows = parts[0] if len(parts) == 1 else pd.concat(parts)
    keys = [rows[x].to_numpy() for x in rows.columns if x.startswith("seq")]
    return rows[column].to_numpy()[np.lexsort(keys[::-1])]


class Dgim:
    """Buckets of ones in a stream of bits: one or two of each size, newest first in each level."""

    def __init__(self, levels: list[list[int]] | None = None, n: int = 0):
        self.levels = levels or []
        self.n = n

    def push(self, bit: int) -> None:
        if bit:
            carry: int | None = self.n
            for level in self.levels:
                level.insert(0, carry)
                carry = None
                if len(level) < 3:
                    break
                oldest, older = level.pop(), level.pop()  # two merge; the newer one's time stands
                carry = max(oldest, older)
            if carry is not None:
                self.levels.append([carry])
        self.n += 1

    def estimate(self, window: int) -> int:
        """Ones among the last window bits: buckets inside in full, the oldest of them by half, rounded up."""
        sizes = [1 << k for k, level in enumerate(self.levels) for last in level if last >= self.n - window]
        return sum(sizes) - sizes[-1] + (sizes[-1] + 1) // 2 if sizes else 0


def dgim_stream(bits: DataFrame, key: str = "key", seq: str | tuple[str, ...] = "seq", bit: str = "bit", windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """(key, n, window, ones): after each batch, the estimates for the keys in it."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, sizes, n = state.get if state.exists else ([], [], 0)
        cuts = np.cumsum([0, *sizes])
        d = Dgim([list(times[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], n)
        for x in _in_order(batches, "bit"):
            d.push(int(x))
        state.update(([int(t) for level in d.levels for t in level], [len(level) for level in d.levels], d.n))
        yield pd.DataFrame({"key": k[0], "n": d.n, "window": list(windows), "ones": [d.estimate(w) for w in windows]})

    own = bits.select(F.col(key).cast("string").alias("key"), *_places(seq), F.col(bit).cast("int").alias("bit"))
    return own.groupBy("key").applyInPandasWithState(step, "key string, n long, window int, ones long", "times array<long>, sizes array<int>, n long", "update", GroupStateTimeout.NoTimeout)


def decayed_stream(elements: DataFrame, key: str = "key", seq: str | tuple[str, ...] = "seq", element: str = "element", c: float = DECAY, least: float = 0.0) -> DataFrame:
    """(key, n, element, weight): after each batch, all weights of the keys in it; weights below least are dropped from the state.

    The first arrival of a key decays once more, as in decayed_weights().
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names, weights, n = state.get if state.exists else ([], [], 0)
        held = dict(zip(names, weights, strict=True))
        rows = _in_order(batches, "element")
        m = len(rows)
        # what was held decays by m arrivals; an arrival by those after it
        held = {e: w * (1 - c) ** m for e, w in held.items()}
        age = (m - 1 - np.arange(m)).astype(float)
        if n == 0 and m:
            age[0] += 1
        for e, w in zip(rows, ((1 - c) ** age).tolist(), strict=True):
            held[e] = held.get(e, 0.0) + w
        held = {e: w for e, w in held.items() if w >= least}
        state.update((list(held), list(held.values()), n + m))
        yield pd.DataFrame({"key": k[0], "n": n + m, "element": list(held), "weight": list(held.values())})

    own = elements.select(F.col(key).cast("string").alias("key"), *_places(seq), F.col(element).cast("string").alias("element"))
    return own.where("element is not null").groupBy("key").applyInPandasWithState(step, "key string, n long, element string, weight double", "names array<string>, weights array<double>, n long", "update", GroupStateTimeout.NoTimeout)


def reservoir_stream(elements: DataFrame, key: str = "key", seq: str | tuple[str, ...] = "seq", element: str = "element", size: int = 1000, seed: int = 0) -> DataFrame:
    """(key, n, element): after each batch, a uniform sample of at most size elements seen of the keys in it (Algorithm R).

    The draw for the n-th element is a hash of seed and n, modulo n + 1 (its
    32 bits favour low places by less than n in 2**32), so a batch that is run
    again samples alike.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sample, n = state.get if state.exists else ([], 0)
        sample = list(sample)
        for e in _in_order(batches, "element"):
            if n < size:
                sample.append(e)
            else:
                j = int(hashlib.md5(f"{seed}:{n}".encode()).hexdigest()[:8], 16) % (n + 1)
                if j < size:
                    sample[j] = e
            n += 1
        state.update((sample, n))
        yield pd.DataFrame({"key": k[0], "n": n, "element": sample})

    own = elements.select(F.col(key).cast("string").alias("key"), *_places(seq), F.col(element).cast("string").alias("element"))
    return own.where("element is not null").groupBy("key").applyInPandasWithState(step, "key string, n long, element string", "sample array<string>, n long", "update", GroupStateTimeout.NoTimeout)


def most_frequent(sampled: DataFrame, n: int = 5) -> DataFrame:
    """(key, rank, element, n_sampled): the n most frequent elements of each key's sample, ties by element; sampled has key and element."""
    counts = sampled.groupBy("key", "element").agg(F.count("*").alias("n_sampled"))
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("n_sampled"), "element"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= n).select("key", F.col("rank").cast("long"), "element", "n_sampled")


def run_to_end(stream: DataFrame, write, checkpoint: str) -> None:
    """Process all that is there, one micro-batch after the other; write(batch, number) gets each one's rows."""
    stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
