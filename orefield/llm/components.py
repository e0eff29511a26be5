"""Connected components of an edge table by alternating star contractions.

Each round replaces every node's links by links to the least node next to it,
first on the side of larger nodes, then on the side of smaller ones, until
nothing changes; it takes a number of rounds that is logarithmic in practice.
Nothing but counters reaches the driver.  A node with very many links costs a
partial aggregate and a join that Spark splits, never one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from orefield.llm.common import written

#: Parts that the rows of a key are dealt into when they are told about it.
PARTS = 16


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): for each node of an edge, the least node reachable from it.

    Self loops, repeated edges and null ends are allowed; the latter are
    ignored.  A node without edges has no row.  No edges: no rows.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    e = written(e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    last = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        e = written(small.where("u <> v").distinct(), "stars")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.countDistinct("u")).first()
        if now == last:
            break
        last = now
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(nodes.select(F.col("component").alias("node"), "component").distinct())


def parted(rows: DataFrame, of: str) -> DataFrame:
    """rows with part: a number below PARTS, by a hash of the column of."""
    return rows.withColumn("part", F.coalesce(F.pmod(F.xxhash64(of), F.lit(PARTS)), F.lit(0)).cast("int"))


def classes_of(rows: DataFrame, of: str) -> DataFrame:
    """(key, least, parts) of parted rows (key, part, of): the least of each key, and the parts that it has rows in."""
    parts = rows.groupBy("key", "part").agg(F.min(of).alias("least"))
    return parts.groupBy("key").agg(F.min("least").alias("least"), F.collect_list("part").alias("parts"))


def told(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Parted rows with the facts (key, parts, ...) of their keys, null where there are none: a key of very many rows is told in parts."""
    return rows.join(facts.withColumn("part", F.explode("parts")).drop("parts"), ["key", "part"], "left").drop("part")


def least_of_component(classes: DataFrame, of_class: DataFrame) -> DataFrame:
    """classes (key, least, ...) with the least one of the class's component in of_class (key, component), if it has any.

    Null is passed over.  The classes of a component are dealt into parts,
    which are asked for their least and told the component's: a component of
    very many classes isn't one task's.
    """
    linked = parted(classes.select("key", "least").join(of_class, "key"), "key")
    best = classes_of(linked.select(F.col("component").alias("key"), "part", "least"), "least").withColumnsRenamed({"key": "component", "least": "better"})
    best = best.withColumn("part", F.explode("parts")).drop("parts")
    better = linked.join(best, ["component", "part"]).select("key", "better")
    return classes.join(better, "key", "left").withColumn("least", F.coalesce("better", "least")).drop("better")
