"""Relational queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from orefield.functions import scalars
from orefield.operators import relational as rel
from orefield.plans.registry import query, table


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def semi_join(spark, sf_dir):
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return rel.semi(table(spark, sf_dir, "customer"), urgent, ["c_custkey"]).select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def anti_join(spark, sf_dir):
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").withColumnRenamed("o_custkey", "c_custkey")
    return rel.anti(table(spark, sf_dir, "customer"), urgent, ["c_custkey"]).select("c_custkey", "c_name")


@query("""
SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R'
  AND (l_partkey, l_suppkey) NOT IN (SELECT (l_partkey, l_suppkey) FROM lineitem WHERE l_returnflag = 'A')
""")
def anti_join_composite(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    keys = ["l_partkey", "l_suppkey"]
    return rel.anti(lines.where("l_returnflag = 'R'").select(*keys), lines.where("l_returnflag = 'A'"), keys).distinct()


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 6")
def having_count(spark, sf_dir):
    return rel.having_more_than(table(spark, sf_dir, "orders"), ["o_custkey"], 6)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_orders(spark, sf_dir):
    return rel.top(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 10, F.desc("o_totalprice"), "o_orderkey")


@query("""
SELECT p_brand, p_partkey, p_retailprice FROM (
  SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS k FROM part
) WHERE k <= 4
""")
def top_per_brand(spark, sf_dir):
    return rel.top_per_group(table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_retailprice"), ["p_brand"], 4, F.desc("p_retailprice"), "p_partkey")


@query("SELECT event_id, user_id FROM events WHERE ('0x' || substr(md5('0:' || event_id::VARCHAR), 1, 8))::BIGINT < 42949672")
def hashed_sample(spark, sf_dir):
    return rel.hashed_sample(table(spark, sf_dir, "events"), "event_id", 0.01).select("event_id", "user_id")


@query("""
SELECT k, 'union' AS kind FROM (SELECT l_suppkey AS k FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 49 UNION SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)
UNION ALL SELECT k, 'difference' FROM (SELECT s_suppkey AS k FROM supplier EXCEPT SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 49)
UNION ALL SELECT k, 'intersection' FROM (SELECT s_suppkey AS k FROM supplier WHERE s_acctbal < 0 INTERSECT SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 49)
""")
def set_operations(spark, sf_dir):
    returned = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity > 49").select(F.col("l_suppkey").alias("k"))
    suppliers = table(spark, sf_dir, "supplier")
    every, poor = suppliers.select(F.col("s_suppkey").alias("k")), suppliers.where("s_acctbal < 0").select(F.col("s_suppkey").alias("k"))
    kinds = {"union": returned.union(poor).distinct(), "difference": every.subtract(returned), "intersection": poor.intersect(returned)}
    out = [df.withColumn("kind", F.lit(kind)) for kind, df in kinds.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("""
SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) WHERE k = 1
""")
def first_event(spark, sf_dir):
    return rel.first_label(table(spark, sf_dir, "events"), "user_id", "ts", "event_id").select("user_id", "event_type", "event_id")


@query("SELECT event_type, count(DISTINCT user_id) AS users, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def distinct_users(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("users"), F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("SELECT round(sum(n), 2) AS total, round(avg(mean), 4) AS mean_of_means FROM (SELECT sum(l_quantity) AS n, avg(l_quantity) AS mean FROM lineitem GROUP BY l_partkey)")
def mean_of_means(spark, sf_dir):
    parts = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("n"), F.avg("l_quantity").alias("mean"))
    return parts.agg(F.round(F.sum("n"), 2).alias("total"), F.round(F.avg("mean"), 4).alias("mean_of_means"))


@query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS position FROM events")
def numbered_events(spark, sf_dir):
    return rel.numbered(table(spark, sf_dir, "events").select("event_id", "ts"), "ts", ["event_id"]).select("event_id", F.col("position").cast("long"))


@query("SELECT o_orderkey, round_even(o_totalprice / 1000, 0) AS thousands, strftime(o_orderdate, '%H:%M:%S') AS clock, (hour(o_orderdate) * 3600 + minute(o_orderdate) * 60 + second(o_orderdate))::INT AS seconds FROM orders")
def rounding_and_clock(spark, sf_dir):
    clock = F.date_format("o_orderdate", "HH:mm:ss")
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.half_even(F.col("o_totalprice") / 1000).alias("thousands"), clock.alias("clock"), scalars.seconds_of_day(clock).alias("seconds"))


@query("""
SELECT p_partkey, regexp_replace(p_name || ',' || p_brand || ',' || p_type, ',[^,]*$', '') AS antecedent, regexp_extract(p_name || ',' || p_brand || ',' || p_type, '[^,]*$') AS consequent,
  substr(p_name, 1, 1) AS initial, (('0x' || substr(md5(p_name), 1, 8))::BIGINT % 100000000)::BIGINT AS hash FROM part
""")
def key_functions(spark, sf_dir):
    key = scalars.joined_key(F.col("p_name"), F.col("p_brand"), F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", scalars.antecedent(key).alias("antecedent"), scalars.consequent(key).alias("consequent"), scalars.first_char(F.col("p_name")).alias("initial"), scalars.string_hash(F.col("p_name")).alias("hash"))
