"""Clusters of the embedding vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from orefield.functions import scalars
from orefield.operators import clustering as ops
from orefield.operators.graph import adjusted_rand
from orefield.plans.registry import query, table
from orefield.sources import readers
from orefield.sources.scratch import shared_path

_DIMS = "dims AS (SELECT vec_id, label, unnest(range(0, len(embedding))) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings)"
_CENTRES = f"{_DIMS}, centres AS (SELECT label AS cluster, dim, avg(x) AS m FROM dims GROUP BY label, dim)"
_NEAREST = f"""{_CENTRES}, distances AS (SELECT vec_id, cluster, sqrt(sum((x - m) * (x - m))) AS dist FROM dims JOIN centres USING (dim) GROUP BY vec_id, cluster),
nearest AS (SELECT vec_id, cluster, dist FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, cluster) AS k FROM distances) WHERE k = 1)"""
_GEOMETRY = f"""{_CENTRES}, radii AS (SELECT cluster, max(d) AS radius FROM (SELECT vec_id, cluster, sqrt(sum((x - m) * (x - m))) AS d FROM dims JOIN centres ON label = cluster AND dims.dim = centres.dim GROUP BY vec_id, cluster) GROUP BY cluster),
diameters AS (SELECT a.label AS cluster, max(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS diameter FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <= b.vec_id GROUP BY 1),
shapes AS (SELECT r.cluster::BIGINT AS cluster, n, radius, diameter, n / (radius * radius) AS density FROM radii r JOIN diameters d ON r.cluster = d.cluster JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY label) c ON r.cluster = c.label)"""


def _points(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "label")


def _labelled(spark, sf_dir):
    return _points(spark, sf_dir).withColumn("cluster", F.col("label").cast("long"))


def _assigned(spark, sf_dir):
    points = _points(spark, sf_dir)
    return ops.assign(points, ops.collected(ops.nearest_centroid(points, "label")))


@query(f"WITH {_CENTRES} SELECT cluster::BIGINT AS cluster, dim::INT AS dim, round(m, 6) AS m FROM centres")
def nearest_centroid(spark, sf_dir):
    means = ops.nearest_centroid(_points(spark, sf_dir), "label")
    return means.select(F.col("cluster").cast("long"), F.posexplode("centroid").alias("dim", "m")).withColumn("m", F.round("m", 6))


@query(f"WITH {_DIMS} SELECT label::BIGINT AS cluster, dim::INT AS dim, count(*) AS n, round(sum(x), 5) AS total, round(sum(x * x), 5) AS squares FROM dims GROUP BY 1, 2")
def cluster_summaries(spark, sf_dir):
    return ops.summaries(_labelled(spark, sf_dir)).select("cluster", "dim", "n", F.round("total", 5).alias("total"), F.round("squares", 5).alias("squares"))


@query(f"WITH {_NEAREST} SELECT vec_id, cluster::BIGINT AS cluster, round(dist, 5) AS dist FROM nearest")
def cluster_assign(spark, sf_dir):
    return _assigned(spark, sf_dir).select(F.col("id").alias("vec_id"), "cluster", F.round("dist", 5).alias("dist"))


@query(f"WITH {_GEOMETRY} SELECT cluster, n, round(radius, 4) AS radius, round(diameter, 4) AS diameter, round(density, 3) AS density FROM shapes")
def cluster_geometry(spark, sf_dir):
    return ops.geometry(_labelled(spark, sf_dir)).select("cluster", "n", F.round("radius", 4).alias("radius"), F.round("diameter", 4).alias("diameter"), F.round("density", 3).alias("density"))


@query(f"WITH {_GEOMETRY} SELECT " + ", ".join(f"round({f}({x}), 3) AS {f}_{x}" for x in ("radius", "diameter", "density") for f in ("min", "max", "avg")) + " FROM shapes")
def cluster_spread(spark, sf_dir):
    one = ops.spread(ops.geometry(_labelled(spark, sf_dir)))
    return one.select(*(F.round(x, 3).alias(x) for x in one.columns))


@query(f"WITH {_NEAREST} SELECT cluster::BIGINT AS cluster, label AS category, count(*) AS n FROM nearest JOIN embeddings USING (vec_id) GROUP BY 1, 2")
def cluster_profile(spark, sf_dir):
    return ops.profile(_assigned(spark, sf_dir), "label")


@query(f"WITH {_NEAREST} SELECT cluster::BIGINT AS cluster, " + ", ".join(f'count(*) FILTER (WHERE label = {x}) AS "{x}"' for x in range(10)) + " FROM nearest JOIN embeddings USING (vec_id) GROUP BY 1")
def cluster_pivot(spark, sf_dir):
    return ops.pivoted(ops.profile(_assigned(spark, sf_dir), "label"), list(range(10)))


_RAND = """s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM t) AS x, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM t GROUP BY a)) AS a, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM t GROUP BY b)) AS b, (SELECT sum(n) FROM t) AS n)
SELECT round((x - a * b / (n * (n - 1) / 2)) / ((a + b) / 2 - a * b / (n * (n - 1) / 2)), 6) AS ari FROM s"""


#: Lines of a circle in its file, so that no task writes or reads all members of one.
LINES = 256


@query(f"WITH {_NEAREST}, t AS (SELECT label AS a, cluster AS b, count(*) AS n FROM nearest JOIN embeddings USING (vec_id) GROUP BY 1, 2), {_RAND}")
def rand_by_vertex(spark, sf_dir):
    """Predicted clusters against the true ones of a circles file, joined by vertex."""
    path = shared_path(spark, "circles")
    members = _points(spark, sf_dir).groupBy("label", F.pmod(F.xxhash64("id"), F.lit(LINES)).alias("line")).agg(F.array_join(F.collect_list(F.col("id").cast("string")), "\t").alias("m"))
    members.select(F.concat_ws("\t", F.concat(F.lit("circle"), F.col("label")), "m").alias("value")).write.text(path)
    true = readers.read_circles(spark, path).select(F.col("node").alias("id"), F.col("label").alias("a"))
    return adjusted_rand(_assigned(spark, sf_dir).select("id", F.col("cluster").alias("b")).join(true, "id")).select(F.round("ari", 6).alias("ari"))


@query(f"""WITH {_DIMS}, stats AS (SELECT label, dim, avg(x) AS m, sqrt(greatest(sum(x * x) / count(*) - avg(x) * avg(x), 0)) AS s FROM dims GROUP BY 1, 2)
SELECT vec_id, round(sqrt(sum(pow(CASE WHEN s > 0 THEN (x - m) / s ELSE x - m END, 2))), 4) AS dist FROM dims JOIN stats USING (label, dim) GROUP BY vec_id""")
def mahalanobis(spark, sf_dir):
    points = _labelled(spark, sf_dir)
    stats = ops.summaries(points).groupBy("cluster").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("dim", "total", "squares"))).alias("d"))
    column = lambda name: F.transform("d", lambda x: x[name])
    stats = stats.select("cluster", F.transform("d", lambda x: x["total"] / F.col("n")).alias("m"), scalars.deviation(F.col("n"), column("total"), column("squares")).alias("s"))
    return points.join(stats, "cluster").select(F.col("id").alias("vec_id"), F.round(scalars.mahalanobis(F.col("v"), F.col("m"), F.col("s")), 4).alias("dist"))


@query("""
WITH t AS (SELECT label AS a, vec_id % 9 AS b, count(*) AS n FROM embeddings WHERE label IS NOT NULL GROUP BY 1, 2),
s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM t) AS x, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM t GROUP BY a)) AS a, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM t GROUP BY b)) AS b, (SELECT sum(n) FROM t) AS n)
SELECT round((x - a * b / (n * (n - 1) / 2)) / ((a + b) / 2 - a * b / (n * (n - 1) / 2)), 6) AS ari FROM s
""")
def adjusted_rand_index(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("a"), (F.col("vec_id") % 9).alias("b"))
    return adjusted_rand(rows).select(F.round("ari", 6).alias("ari"))


@query('SELECT vec_id, dim::INT AS dim, round(x, 6) AS x FROM (SELECT vec_id, unnest(range(0, 61)) AS dim, unnest(embedding[2:7] || embedding[9:63])::DOUBLE AS x FROM embeddings)')
def masked_vectors(spark, sf_dir):
    """Vectors without their first, eighth and last dimension."""
    own = _points(spark, sf_dir).select(F.col("id").alias("vec_id"), scalars.masked(F.col("v"), [0, 7, 63]).alias("v"))
    return own.select("vec_id", F.posexplode("v").alias("dim", "x")).withColumn("x", F.round("x", 6))


@query()
def kmeans(spark, sf_dir):
    return ops.kmeans(_points(spark, sf_dir).drop("label"), 9)[0].select(F.col("id").alias("vec_id"), "cluster", F.round("dist", 4).alias("dist"))


#: Clusters and rounds of k-means from a fixed start: the first vectors.
LLOYD, ROUNDS = 6, 3
_ROUND = """, a{0} AS (SELECT vec_id, cluster, dist FROM (SELECT vec_id, cluster, sqrt(sum((x - m) * (x - m))) AS dist, row_number() OVER (PARTITION BY vec_id ORDER BY sqrt(sum((x - m) * (x - m))), cluster) AS k FROM dims JOIN c{0} USING (dim) GROUP BY vec_id, cluster) WHERE k = 1),
c{1} AS (SELECT c.cluster, c.dim, coalesce(avg(d.x), any_value(c.m)) AS m FROM c{0} c LEFT JOIN (SELECT cluster, dim, x FROM a{0} JOIN dims USING (vec_id)) d ON c.cluster = d.cluster AND c.dim = d.dim GROUP BY 1, 2)"""


@query(f"WITH {_DIMS}, c0 AS (SELECT k - 1 AS cluster, dim, x AS m FROM dims JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS k FROM embeddings) USING (vec_id) WHERE k <= {LLOYD})" + "".join(_ROUND.format(r, r + 1) for r in range(ROUNDS + 1)) + f" SELECT vec_id, cluster::BIGINT AS cluster, round(dist, 4) AS dist FROM a{ROUNDS}")
def kmeans_rounds(spark, sf_dir):
    points = _points(spark, sf_dir).drop("label")
    start = [(k, r.v) for k, r in enumerate(points.orderBy("id").limit(LLOYD).collect())]
    return ops.lloyd(points, start, ROUNDS)[0].select(F.col("id").alias("vec_id"), "cluster", F.round("dist", 4).alias("dist"))


@query(f"""WITH {_DIMS}, stats AS (SELECT label, dim, avg(x) AS m, sqrt(greatest(sum(x * x) / count(*) - avg(x) * avg(x), 0)) AS s FROM dims WHERE vec_id % 2 = 0 GROUP BY 1, 2),
scored AS (SELECT vec_id, stats.label AS cluster, sqrt(sum(pow((x - m) / CASE WHEN s > 0 THEN s ELSE 1 END, 2))) AS dist FROM dims JOIN stats USING (dim) WHERE vec_id % 2 = 1 GROUP BY 1, 2)
SELECT vec_id, cluster::BIGINT AS cluster, round(dist, 4) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, cluster) AS k FROM scored) WHERE k = 1 AND dist < 1.2 * sqrt(64)""")
def bfr_assign(spark, sf_dir):
    """One round of assignment: odd vectors to the summaries of the labels of even ones."""
    points = _labelled(spark, sf_dir)
    known = ops.totals(points.where("id % 2 = 0"))
    near, _ = ops.bfr_step(points.drop("cluster", "label").where("id % 2 = 1"), sorted(known, key=lambda r: r["cluster"]), 1.2 * 64**0.5)
    return near.select(F.col("id").alias("vec_id"), "cluster", F.round("dist", 4).alias("dist"))


@query()
def bfr(spark, sf_dir):
    return ops.bfr(_points(spark, sf_dir).drop("label"), 9, 4)[0].select(F.col("id").alias("vec_id"), "cluster", F.round("dist", 4).alias("dist"))


@query()
def ward(spark, sf_dir):
    points = _points(spark, sf_dir).drop("label")
    found = ops.ward(points, 9) if points.where("v is not null").count() <= ops.MOST_WARD else ops.ward_of_large(points, 9)
    return found.select(F.col("id").alias("vec_id"), "cluster")
