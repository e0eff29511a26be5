"""Summaries of the event stream, in batch and by stateful streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from orefield.operators import summaries as ops
from orefield.plans.registry import query, table
from orefield.sources.scratch import shared_path, written
from orefield.sources.streams import replayed_files, write_replay
from orefield.streaming import state

#: Decay per arrival.
C = 0.001

_SEQ = "seqs AS (SELECT event_type, (event_type = 'purchase')::INT AS bit, row_number() OVER (ORDER BY ts, event_id) - 1 AS seq, count(*) OVER () AS n FROM events)"
_DECAY = f"SELECT event_type AS element, round(sum(pow(1 - {C}, n - 1 - seq + (seq = 0)::INT)), 4) AS weight FROM seqs GROUP BY 1"
_WINDOWS = "windows AS (SELECT unnest([5, 25, 50, 100, 256]) AS win)"
_DGIM = f"""WITH RECURSIVE {_SEQ}, {_WINDOWS}, ones AS (SELECT seq, n, count(*) OVER () AS m, row_number() OVER (ORDER BY seq DESC) - 1 AS rank FROM seqs WHERE bit = 1),
levels AS (
  SELECT 0 AS level, 1::BIGINT AS size, 0::BIGINT AS before, (SELECT count(*) FROM ones)::BIGINT AS m
  UNION ALL SELECT level + 1, size * 2, before + size * (CASE WHEN m % 2 = 0 THEN 2 ELSE 1 END), (m - CASE WHEN m % 2 = 0 THEN 2 ELSE 1 END) // 2 FROM levels WHERE m > 0
), buckets AS (
  SELECT level, (rank - before) // size AS bucket, count(*) AS ones, max(seq) AS last, any_value(n) AS n FROM ones JOIN levels ON levels.m > 0 AND rank >= before AND rank < before + size * (CASE WHEN levels.m % 2 = 0 THEN 2 ELSE 1 END) GROUP BY 1, 2
), inside AS (SELECT win, sum(ones) AS s, arg_min(ones, last) AS oldest FROM windows JOIN buckets ON last >= n - win GROUP BY win)
SELECT win::INT AS "window", coalesce(s - oldest + (oldest + 1) // 2, 0)::BIGINT AS ones FROM windows LEFT JOIN inside USING (win)"""


def _ordered(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    # written, as each summary reads it several times
    return written(ops.ordered(events, "ts", "event_id").select("seq", F.col("event_type").alias("element"), (F.col("event_type") == "purchase").cast("int").alias("bit")), "ordered")


@query(f"WITH {_SEQ} {_DECAY}")
def decayed_weights(spark, sf_dir):
    return ops.decayed_weights(_ordered(spark, sf_dir), C).withColumn("weight", F.round("weight", 4))


@query(f"WITH {_SEQ}, {_WINDOWS} SELECT win::INT AS \"window\", coalesce(sum(bit), 0)::BIGINT AS ones FROM windows LEFT JOIN seqs ON seq >= n - win GROUP BY win")
def exact_window_counts(spark, sf_dir):
    return ops.exact_window_counts(_ordered(spark, sf_dir))


@query(_DGIM)
def dgim_counts(spark, sf_dir):
    return ops.dgim_counts(_ordered(spark, sf_dir))


@query("SELECT event_id, event_type FROM (SELECT * FROM events ORDER BY md5('0:' || event_id::VARCHAR) LIMIT 1000)")
def reservoir(spark, sf_dir):
    return ops.reservoir(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id")


#: Micro-batches of the streaming queries; elements of a user's sample.
BATCHES, SAMPLE = 4, 20
#: Events of a file of the replay, about: what one task sorts.
FILE = 500_000

_USERS = "seqs AS (SELECT user_id AS key, event_type, (event_type = 'purchase')::INT AS bit, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, count(*) OVER (PARTITION BY user_id) AS n FROM events)"
_USER_DGIM = f"""WITH RECURSIVE {_USERS}, {_WINDOWS}, ones AS (SELECT key, seq, n, count(*) OVER (PARTITION BY key) AS m, row_number() OVER (PARTITION BY key ORDER BY seq DESC) - 1 AS rank FROM seqs WHERE bit = 1),
levels AS (
  SELECT key, 0 AS level, 1::BIGINT AS size, 0::BIGINT AS before, max(m)::BIGINT AS m FROM ones GROUP BY key
  UNION ALL SELECT key, level + 1, size * 2, before + size * (CASE WHEN m % 2 = 0 THEN 2 ELSE 1 END), (m - CASE WHEN m % 2 = 0 THEN 2 ELSE 1 END) // 2 FROM levels WHERE m > 0
), buckets AS (
  SELECT o.key, level, (rank - before) // size AS bucket, count(*) AS ones, max(seq) AS last, any_value(n) AS n FROM ones o JOIN levels l ON o.key = l.key AND l.m > 0 AND rank >= before AND rank < before + size * (CASE WHEN l.m % 2 = 0 THEN 2 ELSE 1 END) GROUP BY 1, 2, 3
), inside AS (SELECT key, win, sum(ones) AS s, arg_min(ones, last) AS oldest FROM windows JOIN buckets ON last >= n - win GROUP BY 1, 2)
SELECT k.key::VARCHAR AS key, win::INT AS "window", coalesce(s - oldest + (oldest + 1) // 2, 0)::BIGINT AS ones FROM (SELECT DISTINCT key FROM seqs) k CROSS JOIN windows LEFT JOIN inside USING (key, win)"""
_SAMPLED = f"""{_USERS}, placed AS (
  SELECT key, seq, event_type, CASE WHEN seq < {SAMPLE} THEN seq ELSE ('0x' || substr(md5('0:' || seq::VARCHAR), 1, 8))::BIGINT % (seq + 1) END AS place FROM seqs
), sampled AS (SELECT key::VARCHAR AS key, place, arg_max(event_type, seq) AS element, max(seq) AS seq FROM placed WHERE place < {SAMPLE} GROUP BY 1, 2)"""


def _stream(spark, sf_dir):
    """Events by user, replayed in BATCHES micro-batches of one file each, or of as many as hold FILE events."""
    events, path = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type"), shared_path(spark, "replay")
    low, high, n = events.agg(F.min(F.unix_timestamp("ts")), F.max(F.unix_timestamp("ts")), F.count("*")).first()
    files = -(-n // ((BATCHES - 1) * FILE)) or 1
    # files follow each other in time, so a batch of several is in order, whichever they are
    write_replay(events, path, "ts", max(1, -(-(high + 1 - low) // ((BATCHES - 1) * files))))
    stream = replayed_files(spark, path, events.schema, files)
    return stream.select(F.col("user_id").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id", F.col("event_type").alias("element"), (F.col("event_type") == "purchase").cast("int").alias("bit"))


def _last(spark, stream):
    """The rows of each key's last batch."""
    path = shared_path(spark, "rows")

    def write(batch, number):  # by number, so that a batch that is run again leaves one copy
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    state.run_to_end(stream, write, shared_path(spark, "checkpoint"))
    rows = spark.read.parquet(path).drop("batch")
    return rows.join(rows.groupBy("key").agg(F.max("n").alias("n")), ["key", "n"])


@query(f"WITH {_USERS} SELECT key::VARCHAR AS key, event_type AS element, round(sum(pow(1 - {C}, n - 1 - seq + (seq = 0)::INT)), 4) AS weight FROM seqs GROUP BY 1, 2")
def stream_decayed(spark, sf_dir):
    return _last(spark, state.decayed_stream(_stream(spark, sf_dir), seq=("at", "event_id"), c=C)).select("key", "element", F.round("weight", 4).alias("weight"))


@query(_USER_DGIM)
def stream_dgim(spark, sf_dir):
    return _last(spark, state.dgim_stream(_stream(spark, sf_dir), seq=("at", "event_id"))).select("key", "window", F.col("ones").cast("long").alias("ones"))


@query(f"WITH {_SAMPLED} SELECT s.key, n, element FROM sampled s JOIN (SELECT DISTINCT key::VARCHAR AS key, n FROM seqs) c ON s.key = c.key")
def stream_reservoir(spark, sf_dir):
    return _last(spark, state.reservoir_stream(_stream(spark, sf_dir), seq=("at", "event_id"), size=SAMPLE)).select("key", "n", "element")


@query(f"""WITH {_SAMPLED}, counts AS (SELECT key, element, count(*) AS n_sampled FROM sampled GROUP BY 1, 2)
SELECT key, k AS rank, element, n_sampled FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n_sampled DESC, element) AS k FROM counts) WHERE k <= 5""")
def stream_most_frequent(spark, sf_dir):
    sampled = _last(spark, state.reservoir_stream(_stream(spark, sf_dir), seq=("at", "event_id"), size=SAMPLE))
    return state.most_frequent(sampled)
