"""Tables written as text and read back by the readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from orefield.plans.registry import query, table
from orefield.sources import readers, sinks
from orefield.sources.scratch import shared_path


@query("SELECT length(line) AS width, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL) GROUP BY 1")
def text_lines(spark, sf_dir):
    path = shared_path(spark, "lines")
    table(spark, sf_dir, "documents").where("text is not null").select("text").write.text(path)
    return readers.read_lines(spark, path).groupBy(F.length("value").alias("width")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def csv_quoted(spark, sf_dir):
    path, part = shared_path(spark, "csv"), table(spark, sf_dir, "part")
    part.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    return readers.read_csv(spark, path, part.schema)


@query("SELECT p_partkey, p_name, p_size FROM part WHERE p_partkey % 7 NOT IN (0, 1)")
def csv_malformed(spark, sf_dir):
    """Lines with too few fields, or words where a number belongs, are dropped."""
    path, part = shared_path(spark, "malformed"), table(spark, sf_dir, "part")
    good = F.to_csv(F.struct("p_partkey", "p_name", "p_size"))
    few, words = F.concat_ws(",", "p_partkey", "p_name"), F.to_csv(F.struct("p_partkey", "p_name", "p_brand"))
    kind = F.col("p_partkey") % 7
    part.select(F.when(kind == 0, few).when(kind == 1, words).otherwise(good).alias("value")).write.text(path)
    return readers.read_csv(spark, path, part.select("p_partkey", "p_name", "p_size").schema, header=False)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def dumped_table(spark, sf_dir):
    """A table in a folder named by the time, read back."""
    path = sinks.dump(table(spark, sf_dir, "nation"), shared_path(spark, "dump"), "nation", "json")
    return spark.read.schema(table(spark, sf_dir, "nation").schema).json(path)


@query("SELECT p_name AS line FROM (SELECT p_name, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 ORDER BY n DESC, p_name LIMIT 10)")
def top_key_lines(spark, sf_dir):
    """The ten most frequent parts as lines of a file."""
    path = shared_path(spark, "top")
    names = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    sinks.top_keys(names.groupBy("p_name").agg(F.count("*").alias("n")), "p_name", "n", path)
    return readers.read_lines(spark, path).select(F.col("value").alias("line"))


@query("SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean FROM events GROUP BY 1")
def json_dump(spark, sf_dir):
    """A result as JSON lines, read back."""
    path = shared_path(spark, "json_lines")
    stats = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"))
    sinks.write_json(stats, path)
    return spark.read.schema(stats.schema).json(path)


def _with_preamble(spark, sf_dir, name, preamble):
    """A CSV file of parts under the lines of a preamble."""
    path = shared_path(spark, name)
    rows = table(spark, sf_dir, "part").select("p_partkey", F.to_csv(F.struct("p_partkey", "p_name", "p_brand")).alias("value"))
    head = spark.createDataFrame([(k - len(preamble), x) for k, x in enumerate(preamble)], "p_partkey long, value string")
    head.unionByName(rows).coalesce(1).sortWithinPartitions("p_partkey").select("value").write.text(path)  # one file, as the source has it
    return path


@query("SELECT p_partkey, p_name, p_brand FROM part")
def csv_after_rows(spark, sf_dir):
    path = _with_preamble(spark, sf_dir, "preamble", ["parts,,", "id,name,brand", "1,not a part,"])
    return readers.read_csv_skipping(spark, path, "p_partkey long, p_name string, p_brand string", 3)


@query("SELECT p_partkey::VARCHAR AS id, p_name AS name, p_brand AS brand FROM part")
def csv_two_headers(spark, sf_dir):
    path = _with_preamble(spark, sf_dir, "headers", ["part,part,part", "id,name,brand", ",,"])
    return readers.read_csv_headed(spark, path, 1, 3)


@query("SELECT c_custkey::VARCHAR AS key, c_mktsegment AS segment FROM customer")
def csv_naive(spark, sf_dir):
    path = shared_path(spark, "fields")
    table(spark, sf_dir, "customer").select(F.concat_ws(",", "c_custkey", "c_mktsegment", "c_nationkey").alias("value")).write.text(path)
    return readers.read_fields(spark, path, ["key", "segment"])


@query("SELECT event_id, event_type, user_id FROM events")
def tsv(spark, sf_dir):
    path, events = shared_path(spark, "tsv"), table(spark, sf_dir, "events").select("event_id", "event_type", "user_id")
    events.write.option("sep", "\t").csv(path)
    return readers.read_tsv(spark, path, events.schema)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def json_documents(spark, sf_dir):
    path, nation = shared_path(spark, "json"), table(spark, sf_dir, "nation")
    nation.agg(F.to_json(F.collect_list(F.struct("*"))).alias("value")).write.text(path)  # one small document: an array of all
    return readers.read_json(spark, path, nation.schema)


@query("SELECT o_custkey AS node, unnest(list(DISTINCT o_orderkey)) AS friend FROM orders GROUP BY o_custkey")
def adjacency_lists(spark, sf_dir):
    path = shared_path(spark, "adjacency")
    lists = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.collect_set("o_orderkey"), ",").alias("l"))
    lists.select(F.concat_ws("\t", "o_custkey", "l").alias("value")).write.text(path)
    return readers.read_adjacency(spark, path).select("node", F.explode("friends").alias("friend"))
