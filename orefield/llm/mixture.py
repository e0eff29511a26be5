"""Mixing sources to target weights by exact cuts in hash-random order.

Every document gets a hash-random key, which orders its source.  Sources share
all words by weight, up to a number of epochs over their own; a source's
target is so many whole epochs and a part of one.  The part ends inside a
source's order: keys are ranged into buckets of bounded size, sums of buckets
(aggregated before they are shuffled) lead to the bucket of the cut, and only
that bucket's rows are sorted.  The cut is one row for each source, so deciding
on documents needs no shuffle of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from orefield.llm.common import free_names, own, written

WEIGHTS = (5, 2, 1)
EPOCHS = 3
#: Rows that a bucket of keys holds at least, on average; for large sources the square root of their rows.
BUCKET_ROWS = 200
#: Sources up to which their cuts are broadcast.
MOST_BROADCAST = 20_000

_WORD = r"[^\x20\x09-\x0D]+"


def size_of(text_col: str = "text") -> Column:
    """Number of words: runs of anything but white space; null has none."""
    return F.coalesce(F.regexp_count(own(text_col).cast("string"), F.lit(_WORD)), F.lit(0)).cast("long")


def key_of(id_col: Column, size: Column) -> Column:
    """Hash-random key, the same for rows that share id and size."""
    return F.md5(F.concat_ws(":", F.coalesce(id_col.cast("string"), F.lit("")), size.cast("string")))


def _bucket(key: Column, buckets: Column) -> Column:
    return F.shiftright(F.conv(F.substring(key, 1, 8), 16, 10).cast("long") * buckets, 32)


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """sources (source, source_size, ...) with the target of each: one row for each source.

    In the order of code points, null last, sources weigh as weights says,
    repeating, and share the sum of all sizes; a target stops at epochs times
    its source's size, and the excess is shared again by weight.
    """
    place = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(place) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sources.withColumn("weight", weight).withColumn("most", F.lit(epochs) * F.col("source_size")).withColumn("ratio", F.col("most") / F.col("weight"))
    # the sources that are stopped are first in the order of most / weight
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, all_rows = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(1))
    left = F.sum("source_size").over(all_rows) - F.coalesce(F.sum("most").over(before), F.lit(0))
    weighs = F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    rows = rows.withColumn("level", left / weighs)
    level = F.min(F.when(F.col("level") < F.col("ratio"), F.struct("ratio", "source", "level"))).over(all_rows)["level"]
    rows = rows.withColumn("level", F.coalesce(level, F.lit(0.0)))
    return rows.withColumn("target", F.least(F.col("most").cast("double"), F.col("level") * F.col("weight"))).drop("weight", "most", "ratio", "level")


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def cuts(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, target, epochs, cut_key, cut_words) of each source of sized (source, size, key).

    Documents are taken epochs times each; once more those of smaller keys
    than cut_key; and cut_words words of each with that key.
    """
    stats = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    goal = F.floor(F.col("target") + 0.5).cast("long")
    buckets = F.least(F.ceil(F.col("n") / F.greatest(F.lit(BUCKET_ROWS), F.sqrt("n"))), F.lit(1 << 30)).cast("long")
    stats = targets(stats, weights, epochs).select("*", F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0).cast("long").alias("epochs"), buckets.alias("buckets"))
    stats = written(stats.withColumn("rest", F.when(F.col("source_size") > 0, goal - F.col("epochs") * F.col("source_size")).otherwise(0)), "sources")
    s = stats.select(F.col("source").alias("s"), "buckets", "rest")
    ranged = sized.join(s, _same(F.col("source"), F.col("s"))).withColumn("bucket", _bucket(F.col("key"), F.col("buckets")))
    sums = ranged.groupBy("s", "bucket").agg(F.sum("size").alias("b"), F.max("rest").alias("rest"))
    until = F.sum("b").over(Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    at = sums.withColumn("until", until).where("until > rest and until - b <= rest").select(F.col("s").alias("t"), F.col("bucket").alias("k"), (F.col("rest") - (F.col("until") - F.col("b"))).alias("into"))
    inside = ranged.join(at, _same(F.col("s"), F.col("t")) & (F.col("bucket") == F.col("k")))
    keys = inside.groupBy("s", "key").agg(F.sum("size").alias("g"), F.count("*").alias("m"), F.max("into").alias("into"))
    until = F.sum("g").over(Window.partitionBy("s").orderBy("key").rowsBetween(Window.unboundedPreceding, 0))
    cut = keys.withColumn("until", until).where("until > into and until - g <= into").select("s", F.col("key").alias("cut_key"), F.floor((F.col("into") - (F.col("until") - F.col("g"))) / F.col("m")).cast("long").alias("cut_words"))
    out = stats.join(cut, _same(F.col("source"), F.col("s")), "left")
    return out.select("source", "source_size", "target", "epochs", F.coalesce("cut_key", F.lit("")).alias("cut_key"), F.coalesce("cut_words", F.lit(0)).alias("cut_words"))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    rows = docs.select(own(id_col).alias("doc_id"), own(source_col).cast("string").alias("source"), size_of(text_col).alias("size"))
    return written(rows.withColumn("key", key_of(F.col("doc_id"), F.col("size"))), "sized")


def _few(found: DataFrame) -> DataFrame:
    """found, written; to be broadcast if its rows, one for each source, are few enough."""
    found = written(found, "cuts")
    return F.broadcast(found) if found.count() <= MOST_BROADCAST else found


def _part() -> Column:
    return F.when(F.col("key") < F.col("cut_key"), F.col("size")).when(F.col("key") == F.col("cut_key"), F.col("cut_words")).otherwise(0)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies, part) of each row of docs.

    copies is how many times the whole document is taken, part how many words
    of it are taken once more: fewer than all only where a source is cut.  Null
    is a source, and a null id an id like any other; a null text has size 0
    and is never taken.  Rows that share id, size and source, where the cut
    falls among them, are cut alike, each to its share.  Equal calls decide
    alike.  Other columns are not looked at.  No rows: no rows.
    """
    sized = _sized(docs, id_col, text_col, source_col)
    found = _few(cuts(sized, weights, epochs)).withColumnRenamed("source", "s")
    out = sized.join(found, _same(F.col("source"), F.col("s")))
    whole = (F.col("size") > 0) & (F.col("key") < F.col("cut_key"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + _part()).alias("taken"), F.when(F.col("size") > 0, F.col("epochs") + whole.cast("long")).otherwise(0).alias("copies"), F.when(whole, F.lit(0)).otherwise(_part()).alias("part"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """docs as the mix takes them: each row as often as it is taken; where a source is cut, with its first words only.

    All columns are kept, whatever they are called; the text is the only one
    that changes.  Documents without words are not taken.
    """
    sized = _sized(docs, id_col, text_col, source_col)
    size, key, take, *cut = free_names(docs, "size", "key", "take", "source", "epochs", "cut_key", "cut_words")
    found = _few(cuts(sized, weights, epochs)).select(*(F.col(x).alias(y) for x, y in zip(("source", "epochs", "cut_key", "cut_words"), cut, strict=True)))
    source, epochs_of, cut_key, cut_words = map(F.col, cut)
    rows = docs.withColumn(size, size_of(text_col)).withColumn(key, key_of(own(id_col), F.col(size)))
    rows = rows.join(found, _same(own(source_col).cast("string"), source)).where(F.col(size) > 0)
    times = epochs_of + (F.col(key) < cut_key).cast("long")
    part = F.when(F.col(key) == cut_key, cut_words).otherwise(0)
    whole = F.array_repeat(F.lit(-1).cast("long"), times.cast("int"))
    rows = rows.withColumn(take, F.explode(F.when(part > 0, F.concat(whole, F.array(part))).otherwise(whole)))
    words = F.split(own(text_col), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    text = F.when(F.col(take) < 0, own(text_col)).otherwise(F.array_join(F.slice(words, F.lit(1), F.greatest(F.col(take), F.lit(0)).cast("int")), ""))
    return rows.select(*(text.alias(x) if x == text_col else own(x) for x in docs.columns))


SQL = """
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents
), keyed AS (
  SELECT *, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || CAST(size AS VARCHAR)) AS key FROM sized
), stats AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM keyed GROUP BY source
), weighted AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS weight, 3 * source_size AS most FROM stats
), levelled AS (
  SELECT *, most::DOUBLE / weight::DOUBLE AS ratio,
    (sum(source_size) OVER () - coalesce(sum(most) OVER w, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0))::DOUBLE AS level
  FROM weighted WINDOW w AS (ORDER BY most::DOUBLE / weight::DOUBLE, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), goals AS (
  SELECT source, source_size, least(most::DOUBLE, coalesce((SELECT arg_min(level, ratio) FROM levelled WHERE level < ratio), 0.0) * weight) AS target FROM levelled
), budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END AS epochs,
    CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT % source_size ELSE 0 END AS rest FROM goals
), placed AS (
  SELECT k.*, b.source_size, b.target, b.epochs, b.rest, count(*) OVER g AS m, sum(k.size) OVER g AS of_key,
    sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS until
  FROM keyed k JOIN budgets b ON k.source IS NOT DISTINCT FROM b.source WINDOW g AS (PARTITION BY k.source, k.key)
), parted AS (
  SELECT *, CASE WHEN until <= rest THEN size WHEN until - of_key <= rest THEN ((rest - (until - of_key)) // m)::BIGINT ELSE 0 END AS part FROM placed
)
SELECT doc_id, size, source_size, target, (epochs * size + part)::BIGINT AS taken,
  CASE WHEN size > 0 THEN epochs + (until <= rest)::INT ELSE 0 END::BIGINT AS copies,
  (CASE WHEN until <= rest THEN 0 ELSE part END)::BIGINT AS part
FROM parted
"""
