"""Frequent itemsets and rules over the part names of orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from orefield.operators import itemsets as ops
from orefield.plans.registry import query, table
from orefield.sources.scratch import written

#: Shares of all orders that items and pairs, and triples, must exceed.
PAIRS, TRIPLES = 0.0025, 0.0004
MEASURES = ("confidence", "interest", "lift", "std_lift", "std_lift_count")

_BASKETS = "lines AS (SELECT DISTINCT l_orderkey AS basket, p_name AS item FROM lineitem JOIN part ON l_partkey = p_partkey), supports AS (SELECT item, count(*) AS support FROM lines GROUP BY item), n AS (SELECT count(DISTINCT basket)::DOUBLE AS n FROM lines)"
_PAIR_SQL = f"{_BASKETS}, pairs AS (SELECT a.item AS i1, b.item AS i2, count(*) AS support FROM lines a JOIN lines b ON a.basket = b.basket AND a.item < b.item GROUP BY 1, 2 HAVING count(*) > {PAIRS} * (FROM n))"
_TRIPLE_SQL = f"""{_PAIR_SQL}, triples AS (
  SELECT a.item AS i1, b.item AS i2, c.item AS i3, count(*) AS support FROM lines a JOIN lines b ON a.basket = b.basket AND a.item < b.item JOIN lines c ON a.basket = c.basket AND b.item < c.item
  GROUP BY 1, 2, 3 HAVING count(*) > {TRIPLES} * (FROM n)), kept AS (
  SELECT * FROM triples WHERE (i1, i2) IN (SELECT (i1, i2) FROM pairs) AND (i1, i3) IN (SELECT (i1, i2) FROM pairs) AND (i2, i3) IN (SELECT (i1, i2) FROM pairs))"""
_MEASURED = """
SELECT key, support, round(confidence, 6) AS confidence, round(confidence - p, 6) AS interest, round(lift, 6) AS lift,
  round((lift - greatest(s / n + p - 1, 1 / n) / (s / n * p)) / (1 / (s / n * p) - greatest(s / n + p - 1, 1 / n) / (s / n * p)), 6) AS std_lift,
  round((lift - greatest(s + p - 1, 1 / n) / (s * p)) / (1 / (s * p) - greatest(s + p - 1, 1 / n) / (s * p)), 6) AS std_lift_count
FROM (SELECT *, confidence / p AS lift FROM (SELECT key, support, s::DOUBLE AS s, support / s AS confidence, c / n AS p, n FROM ({0}) CROSS JOIN n))"""


def _counted(sets):
    """Baskets, written, as several counts read them; and the numbers of them that pairs and triples must exceed."""
    sets = written(sets, "baskets")
    n = sets.count()
    return sets, PAIRS * n, TRIPLES * n


def _baskets(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey"))
    sets = ops.baskets(lines.join(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey"), "l_orderkey", "p_name")
    return _counted(sets)


def _rounded(df):
    return df.select("key", "support", *(F.round(x, 6).alias(x) for x in MEASURES))


@query(f"WITH {_BASKETS} SELECT item, support FROM supports WHERE support > {PAIRS} * (FROM n)")
def item_support(spark, sf_dir):
    sets, pairs, _ = _baskets(spark, sf_dir)
    return ops.item_support(sets, pairs)


@query(f"WITH {_PAIR_SQL}" + _MEASURED.format("SELECT i1 || ',' || i2 AS key, pairs.support, x.support AS s, y.support AS c FROM pairs JOIN supports x ON i1 = x.item JOIN supports y ON i2 = y.item"))
def itemset_pairs(spark, sf_dir):
    sets, pairs, _ = _baskets(spark, sf_dir)
    return _rounded(ops.rules(sets, ops.pair_support(sets, pairs), ops.item_support(sets, pairs)))


@query(f"WITH {_TRIPLE_SQL}" + _MEASURED.format("SELECT kept.i1 || ',' || kept.i2 || ',' || i3 AS key, kept.support, x.support AS s, y.support AS c FROM kept JOIN pairs x ON kept.i1 = x.i1 AND kept.i2 = x.i2 JOIN supports y ON i3 = y.item"))
def itemset_triples(spark, sf_dir):
    sets, pairs, triples = _baskets(spark, sf_dir)
    return _rounded(ops.rules(sets, ops.triple_support(sets, pairs, triples), ops.pair_support(sets, pairs)))


@query(f"WITH {_TRIPLE_SQL} SELECT key, std_lift_count FROM (" + _MEASURED.format("SELECT kept.i1 || ',' || kept.i2 || ',' || i3 AS key, kept.support, x.support AS s, y.support AS c FROM kept JOIN pairs x ON kept.i1 = x.i1 AND kept.i2 = x.i2 JOIN supports y ON i3 = y.item") + ") WHERE std_lift_count > 0.2 ORDER BY std_lift_count, key")
def rules_above(spark, sf_dir):
    return itemset_triples(spark, sf_dir).where("std_lift_count > 0.2").select("key", "std_lift_count").orderBy("std_lift_count", "key")


@query("""
WITH lines AS (
  SELECT l_orderkey AS basket, p_brand AS item, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos FROM lineitem JOIN part ON l_partkey = p_partkey
), supports AS (SELECT item FROM lines GROUP BY item HAVING count(*) > 4)
SELECT a.item AS i1, b.item AS i2, count(*) AS support FROM lines a JOIN lines b ON a.basket = b.basket AND a.pos < b.pos
WHERE a.item IN (FROM supports) AND b.item IN (FROM supports) GROUP BY 1, 2 HAVING count(*) > 4
""")
def ordered_pairs(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("pos"))
    named = lines.join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_partkey")
    return ops.pair_support(ops.ordered_baskets(named, "l_orderkey", "pos", "p_brand"), 4)
