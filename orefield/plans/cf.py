"""Collaborative filtering over customers' brands: a rating is the mean quantity of an order line, over ten."""

from __future__ import annotations

from pyspark.sql import functions as F

from orefield.operators import cf as ops
from orefield.plans.registry import query, table
from orefield.sources.scratch import written

_RATINGS = "ratings AS (SELECT o_custkey AS u, p_brand AS item, avg(l_quantity) / 10 AS r FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"
_SUMS = f"{_RATINGS}, sums AS (SELECT item, count(*) AS n, sum(r) AS s, sum(r * r) AS q, sum(r) / count(*) AS m FROM ratings GROUP BY item), users AS (SELECT count(DISTINCT u)::DOUBLE AS u FROM ratings)"
_BOTH = f"{_SUMS}, pairs AS (SELECT x.item AS i, y.item AS j, sum(x.r * y.r) AS d, count(*) AS c, sum(x.r) AS sx, sum(y.r) AS sy FROM ratings x JOIN ratings y ON x.u = y.u AND x.item < y.item GROUP BY 1, 2)"
_SIMILAR = f"""{_BOTH}, similar_items AS (
  SELECT i, j, CASE WHEN den > 1e-12 THEN num / sqrt(den) ELSE 0 END AS similarity FROM (
    SELECT i, j, d - b.m * a.s - a.m * b.s + u * a.m * b.m AS num, (a.q - 2 * a.m * a.s + u * a.m * a.m) * (b.q - 2 * b.m * b.s + u * b.m * b.m) AS den
    FROM pairs JOIN sums a ON i = a.item JOIN sums b ON j = b.item CROSS JOIN users))"""
_BASED = """based AS (
  SELECT r.u, r.item, r.r, bu + bi - mean AS b FROM ratings r JOIN (SELECT u, avg(r) AS bu FROM ratings GROUP BY u) x ON r.u = x.u JOIN (SELECT item, avg(r) AS bi FROM ratings GROUP BY item) y ON r.item = y.item
  CROSS JOIN (SELECT avg(bi) AS mean FROM (SELECT avg(r) AS bi FROM ratings GROUP BY item)))"""
_PREDICTED = f"""{_SIMILAR}, {_BASED}, either AS (SELECT i AS item, j AS other, similarity FROM similar_items WHERE similarity > 0 UNION ALL SELECT j, i, similarity FROM similar_items WHERE similarity > 0),
near AS (SELECT a.u, a.item, s.similarity, o.r - o.b AS residual, row_number() OVER (PARTITION BY a.u, a.item ORDER BY round(s.similarity, 9) DESC, s.other) AS k
  FROM based a JOIN based o ON a.u = o.u AND a.item <> o.item JOIN either s ON s.item = a.item AND s.other = o.item),
predicted AS (SELECT b.u, b.item, b.r, b.b + coalesce(step, 0) AS p FROM based b LEFT JOIN (SELECT u, item, sum(similarity * residual) / sum(similarity) AS step FROM near WHERE k <= 4 GROUP BY u, item) s ON b.u = s.u AND b.item = s.item)"""


def _ratings(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("user"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("item"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    return written(lines.join(parts, "l_partkey").join(orders, "l_orderkey").groupBy("user", "item").agg((F.avg("l_quantity") / 10).alias("rating")), "ratings")


@query(f"WITH {_SIMILAR} SELECT i, j, round(similarity, 5) AS similarity FROM similar_items")
def cf_similarity(spark, sf_dir):
    return ops.item_similarity(_ratings(spark, sf_dir)).withColumn("similarity", F.round("similarity", 5))


@query(f"""WITH {_BOTH} SELECT i, j, round(CASE WHEN den > 1e-12 THEN num / sqrt(den) ELSE 0 END, 5) AS similarity FROM (
  SELECT i, j, d - b.m * sx - a.m * sy + c * a.m * b.m AS num, (a.q - a.n * a.m * a.m) * (b.q - b.n * b.m * b.m) AS den FROM pairs JOIN sums a ON i = a.item JOIN sums b ON j = b.item)""")
def cf_similarity_rated(spark, sf_dir):
    return ops.item_similarity(_ratings(spark, sf_dir), centre_missing=False).withColumn("similarity", F.round("similarity", 5))


@query(f'WITH {_RATINGS}, {_BASED} SELECT u AS "user", item, round(r, 5) AS rating, round(b, 5) AS baseline FROM based')
def cf_baseline(spark, sf_dir):
    return ops.baselines(_ratings(spark, sf_dir)).select("user", "item", F.round("rating", 5).alias("rating"), F.round("baseline", 5).alias("baseline"))


@query(f'WITH {_PREDICTED} SELECT u AS "user", item, round(r, 5) AS rating, round(p, 5) AS predicted FROM predicted')
def cf_predict(spark, sf_dir):
    ratings = _ratings(spark, sf_dir)
    return ops.predictions(ratings, ops.item_similarity(ratings)).select("user", "item", F.round("rating", 5).alias("rating"), F.round("predicted", 5).alias("predicted"))


@query(f"WITH {_PREDICTED} SELECT count(*) AS n, round(sqrt(avg((r - p) * (r - p))), 6) AS rmse, round(avg(CASE WHEN round_even(round(r, 9), 0) = round_even(round(p, 9), 0) THEN 1.0 ELSE 0.0 END), 4) AS precision FROM predicted")
def cf_eval(spark, sf_dir):
    ratings = _ratings(spark, sf_dir)
    predicted = ops.predictions(ratings, ops.item_similarity(ratings)).withColumns({"rating": F.round("rating", 9), "predicted": F.round("predicted", 9)})
    return ops.evaluation(predicted).select("n", F.round("rmse", 6).alias("rmse"), F.round("precision", 4).alias("precision"))
