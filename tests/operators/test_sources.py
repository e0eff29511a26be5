from pyspark.sql import functions as F

from orefield.sources import readers, sinks, streams


def put(tmp_path, name, content):
    path = tmp_path / name
    path.write_text(content)
    return str(path)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_fields_and_csv(spark, tmp_path):
    path = put(tmp_path, "a.csv", 'id,name\n1,"a,b"\n2,"say ""x"""\nbad\nx,y\n')
    assert rows(readers.read_fields(spark, path, ["a", "b"]))[1:2] == [("1", '"a')]
    assert rows(readers.read_csv(spark, path, "id int, name string")) == [(1, "a,b"), (2, 'say "x"')]
    assert rows(readers.read_tsv(spark, put(tmp_path, "a.tsv", '1\t"q\n2\t\n'), "id int, t string")) == [(1, '"q'), (2, None)]


def test_preamble(spark, tmp_path):
    path = put(tmp_path, "p.csv", 'x,track\n,title\nid,\n3,"a, b"\n4,c\n')
    assert rows(readers.read_csv_after_preamble(spark, path, "id int, t string", "id")) == [(3, "a, b"), (4, "c")]


def test_graphs(spark, tmp_path):
    assert rows(readers.read_adjacency(spark, put(tmp_path, "adj", "1\t2,3\n2\t\nno tab\n"))) == [(1, [2, 3]), (2, [])]
    assert rows(readers.read_circles(spark, put(tmp_path, "c", "circle0\t7\t8\n"))) == [("circle0", 0, 7), ("circle0", 1, 8)]
    assert rows(readers.read_edges(spark, put(tmp_path, "e", "1 2\n\n2 1\n"))) == [(1, 2), (2, 1)]
    assert rows(readers.read_features(spark, put(tmp_path, "f", "1 0 1 1\n"))) == [(1, [0, 1, 1])]
    assert rows(readers.read_json(spark, put(tmp_path, "j.json", '[{"k": 1},\n {"k": 2}]'), "k int")) == [(1,), (2,)]
    assert rows(readers.from_rows(spark, [(1,)], "k int")) == [(1,)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", 2), ("a", 2), ("c", 1)], "k string, n int")
    path = sinks.dump(df, f"file://{tmp_path}/out", "rules")
    assert "rules 2" in path and spark.read.parquet(path).count() == 3
    sinks.top_keys(df, "k", "n", f"file://{tmp_path}/top", 2)
    assert [r.value for r in spark.read.text(f"file://{tmp_path}/top").collect()] == ["a", "b"]
    sinks.write_json(df, f"file://{tmp_path}/json")
    assert spark.read.json(f"file://{tmp_path}/json").count() == 3


def test_replay_and_batches(spark, tmp_path):
    events = spark.createDataFrame([(k, k * 30) for k in range(6)], "id long, s long").select("id", F.timestamp_seconds("s").alias("ts"))
    assert streams.write_replay(events, f"file://{tmp_path}/replay", "ts", 60) == 3
    stream = streams.replayed_files(spark, f"file://{tmp_path}/replay", events.schema)
    seen = []
    stream.writeStream.foreachBatch(lambda batch, k: seen.append(sorted(r.id for r in batch.collect()))).trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start().awaitTermination()
    assert seen == [[0, 1], [2, 3], [4, 5]]
    query = sinks.show_batches(streams.replayed_files(spark, f"file://{tmp_path}/replay", events.schema), 2, ["id"])
    query.awaitTermination()
    assert streams.random_bits(spark).isStreaming and streams.socket_lines.__doc__


def test_replay_with_gaps(spark, tmp_path):
    events = spark.createDataFrame([(0, 1000), (1, 1010), (2, 1300), (3, 1301), (4, 1250), (5, None)], "id long, s long").select("id", F.timestamp_seconds("s").alias("ts"))
    assert streams.write_replay(events, f"file://{tmp_path}/replay", "ts", 60) == 3
    seen = []
    streams.replayed_files(spark, f"file://{tmp_path}/replay", events.schema).writeStream.foreachBatch(lambda batch, k: seen.append(sorted(r.id for r in batch.collect()))).trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start().awaitTermination()
    assert seen == [[0, 1], [4], [2, 3]]
    assert streams.write_replay(events.limit(0), f"file://{tmp_path}/none", "ts", 60) == 0


def test_preamble_by_rows(spark, tmp_path):
    path = put(tmp_path, "p.csv", 'x,y\nid,"the, name"\n7,skipped\n3,"a, b"\n4,"say ""c"""\nz,d\n')
    assert rows(readers.read_csv_skipping(spark, path, "id int, t string", 3)) == [(3, "a, b"), (4, 'say "c"'), (None, "d")]
    headed = readers.read_csv_headed(spark, path, 1, 3)
    assert headed.columns == ["id", "the, name"] and headed.count() == 3
    lines = spark.range(20000).selectExpr("concat(id, ',x') as value")
    lines.coalesce(1).sortWithinPartitions("value").write.text(f"file://{tmp_path}/many")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        many = readers.read_csv_skipping(spark, f"file://{tmp_path}/many", "id long, t string", 5)
        assert many.rdd.getNumPartitions() > 3 and many.count() == 19995
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_files_of_each_graph(spark, tmp_path):
    for g in (0, 1):
        (tmp_path / f"graph={g}").mkdir()
        (tmp_path / f"graph={g}" / "e").write_text(f"{g} 5\n")
    assert sorted(rows(readers.read_edges(spark, str(tmp_path), "graph"))) == [(0, 0, 5), (1, 1, 5)]


def test_lines_from_a_socket(spark, tmp_path):
    import socket
    import threading
    import time

    server = socket.create_server(("localhost", 0))

    def serve():
        peer, _ = server.accept()
        peer.sendall(b"one\ntwo\nthree\n")
        time.sleep(20)
        peer.close()

    threading.Thread(target=serve, daemon=True).start()
    seen = []
    lines = streams.socket_lines(spark, "localhost", server.getsockname()[1])
    query = lines.writeStream.foreachBatch(lambda batch, k: seen.extend(r.value for r in batch.collect())).option("checkpointLocation", f"{tmp_path}/c").start()
    until = time.time() + 15
    while len(seen) < 3 and time.time() < until:
        time.sleep(0.2)
    query.stop()
    server.close()
    assert seen == ["one", "two", "three"]


def test_random_bits(spark, tmp_path):
    import time

    bits = []
    query = streams.random_bits(spark, 2000, 0.2).writeStream.foreachBatch(lambda batch, k: bits.extend((r.seq, r.bit) for r in batch.collect())).option("checkpointLocation", f"{tmp_path}/c").start()
    until = time.time() + 20
    while len(bits) < 3000 and time.time() < until:
        time.sleep(0.2)
    query.stop()
    assert sorted(k for k, _ in bits) == list(range(len(bits))) and len(bits) >= 3000
    assert abs(sum(b for _, b in bits) / len(bits) - 0.2) < 0.05


def test_metrics(spark, tmp_path):
    sinks.write_metrics(spark, f"file://{tmp_path}/m", rmse=0.5, seconds=2)
    assert spark.read.json(f"file://{tmp_path}/m").first().asDict() == {"rmse": 0.5, "seconds": 2.0}


def test_no_machine_local_folder_on_a_cluster():
    import pytest

    from orefield.sources import scratch

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        scratch.shared_dir(Session())


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
