"""Registered queries against their SQL, and the pipeline against its parts."""

import math
import os

import duckdb
import pytest

from orefield.llm import queries

NAMES = sorted(queries.queries())


@pytest.fixture(scope="module")
def duck(tiny):
    con = duckdb.connect()
    for name in os.listdir(tiny):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{tiny}/{name}'")
    return con


def plain(x):
    return round(x, 6) if isinstance(x, float) and not math.isnan(x) else x


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, tiny, duck, name):
    df = queries.queries()[name](spark, tiny)
    want = duck.sql(queries.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=str)
    assert got == sorted((tuple(plain(dict(zip(want.columns, r))[c]) for c in order) for r in want.fetchall()), key=str)


@pytest.mark.parametrize("name, table, key", [("op1", "documents", "doc_id"), ("op2", "documents", "doc_id"), ("op3", "documents", "doc_id"), ("op4", "embeddings", "vec_id"), ("op8", "pages", "page_id"), ("op9", "documents", "doc_id")])
def test_a_row_for_each_input_row(spark, tiny, name, table, key):
    full = next(x for x in NAMES if x.startswith(f"{name}_"))
    got = sorted(r[key] for r in queries.queries()[full](spark, tiny).select(key).collect())
    assert got == sorted(r[key] for r in spark.read.parquet(f"{tiny}/{table}.parquet").select(key).collect())


def test_pipeline(spark, tiny):
    """Each stage does to its whole input what its operator says, checked in plain Python."""
    import corpus_pipeline as p
    from orefield.llm import langid
    from tests.llm.test_text_operators import brute_components, brute_hits

    assert [n for n, _ in p.STAGES] == ["language id", "n-gram jaccard join", "benchmark decontamination", "mixing sources", "token output"]
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()]
    columns = docs.columns
    one = p.identify_language(spark, docs, tiny).cache()
    ok = {r.doc_id for r in langid.identify(docs, langid.train(docs)).collect() if r.accepted}
    assert {r.doc_id for r in one.collect()} == ok and len(ok) > 0.97 * docs.count()
    two = p.drop_near_duplicates(spark, one, tiny).cache()
    rows = [(r.doc_id, r.text) for r in one.collect()]
    assert sorted(r.doc_id for r in two.collect()) == sorted({c for _, _, c in brute_components(rows)})
    three = p.drop_benchmark_leaks(spark, two, tiny).cache()
    rows = [(r.doc_id, r.text) for r in two.collect()]
    assert sorted(r.doc_id for r in three.collect()) == sorted(x[0] for x in brute_hits(rows, items) if not x[5])
    four = p.mix_sources(spark, three, tiny).cache()
    words = lambda df: sum(len(r.text.split()) for r in df.collect())
    assert abs(words(four) - words(three)) <= 40
    assert one.columns == two.columns == three.columns == four.columns == columns
    five = p.write_token_ids(spark, four, tiny)
    assert five.count() == four.count()
    assert p.run(spark, tiny).count() == five.count()
