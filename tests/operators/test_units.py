import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from orefield.functions import scalars
from orefield.operators import cf, clustering, graph, itemsets, lsh, relational, summaries, text
from orefield.streaming import state


def one(spark, column, **values):
    names = list(values)
    kinds = {int: "long", float: "double", str: "string", list: "array<double>"}
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {kinds[type(values[n])]}" for n in names))
    return df.select(column.alias("x")).first().x


# ------------------------------------------------------------------ rules

@pytest.mark.parametrize("s, confidence, interest, lift, std", [(13, 0.7692307692307693, 0.3068521284540702, 1.6636381990712699, 0.21482265749073584), (17, 0.7647058823529411, 0.3023272415762421, 1.6538520920179094, 0.2239227690134212)])
def test_published_rules(spark, s, confidence, interest, lift, std):
    p = confidence - interest
    got = one(spark, F.array(F.col("c") / F.col("p"), itemsets.standardised_lift(F.col("c") / F.col("p"), F.col("s"), F.col("p"), F.lit(1e9))), c=confidence, p=p, s=float(s))
    assert got == pytest.approx([lift, std], rel=1e-9)


def test_itemsets_against_counting(spark):
    rng = random.Random(1)
    rows = [(b, f"i{rng.randrange(12)}") for b in range(60) for _ in range(rng.randrange(1, 7))] + [(None, "i1"), (3, None)]
    sets = itemsets.baskets(spark.createDataFrame(rows, "b long, i string"), "b", "i")
    own = {}
    for b, i in rows:
        if b is not None and i is not None:
            own.setdefault(b, set()).add(i)
    pairs = Counter(p for v in own.values() for p in combinations(sorted(v), 2))
    assert {(r.i1, r.i2): r.support for r in itemsets.pair_support(sets, 3).collect()} == {p: n for p, n in pairs.items() if n > 3}
    triples = Counter(p for v in own.values() for p in combinations(sorted(v), 3))
    want = {t: n for t, n in triples.items() if n > 1 and all(pairs[p] > 3 for p in combinations(t, 2))}
    assert {(r.i1, r.i2, r.i3): r.support for r in itemsets.triple_support(sets, 3, 1).collect()} == want
    found = itemsets.pair_support(sets, 0).collect()  # support never grows with the set
    single = {r.item: r.support for r in itemsets.item_support(sets, 0).collect()}
    assert all(r.support <= min(single[r.i1], single[r.i2]) for r in found)


def test_ordered_baskets_count_instances(spark):
    rows = [(1, 0, "b"), (1, 1, "a"), (1, 2, "b")]
    sets = itemsets.ordered_baskets(spark.createDataFrame(rows, "b long, p int, i string"), "b", "p", "i")
    assert {(r.i1, r.i2): r.support for r in itemsets.pair_support(sets, 0).collect()} == {("b", "a"): 1, ("b", "b"): 1, ("a", "b"): 1}


# ------------------------------------------------------------------ text

def test_shingles(spark):
    shingles = lambda t: set(one(spark, text.shingles(F.col("t")), t=t))
    assert shingles("abcdefg") == set()
    assert shingles("ABCDEFGH") == {"abcdefgh"}
    assert shingles("abcdefghij") == {"abcdefgh", "abcdefghi", "bcdefghij"}
    assert shingles("a\nb\nc\nd\ne") == {"a\nb\nc\nd\n", "a\nb\nc\nd\ne"}


def test_bigrams_and_starts(spark):
    docs = spark.createDataFrame([("The the cat of mad dog",), ("Mad dog!",), (None,), ("",)], "text string")
    assert {r.bigram: r.n for r in text.word_bigrams(docs).collect()} == {"the,the": 1, "the,cat": 1, "mad,dog": 2}
    docs = spark.createDataFrame([("Some same word words words é",)], "text string")
    assert {r.initial: r.n_words for r in text.unique_starts(docs).collect()} == {"s": 2, "w": 2}


def test_similar_documents(spark):
    base = "the quick brown fox jumps over the lazy dog while the cat sleeps in the warm sun of the late afternoon"
    docs = spark.createDataFrame([(1, base), (2, base + "!"), (3, "entirely different words here with nothing shared at all"), (4, base), (5, "short"), (6, None)], "doc_id long, text string")
    signed = lsh.classes(lsh.signatures(docs)).cache()
    assert {r.doc_id: r.class_id for r in signed.collect()} == {1: 1, 2: 2, 3: 3, 4: 1}
    scored = lsh.similar_pairs(signed, lsh.candidates(signed))
    (r,) = scored.collect()
    assert (r.a, r.b) == (1, 2) and 0.8 < r.similarity <= 1
    assert [x.partner for x in lsh.similar_to(scored, 2, 0.5, 1.01).collect()] == [1]
    exact = spark.createDataFrame([(1, 2, 0.97), (1, 3, 0.01), (7, 8, 0.9)], "a long, b long, jaccard double")
    rates = lsh.error_rates(lsh.candidates(signed), exact, 0.8).first()
    assert (rates.n_found, rates.n_true, rates.false_positive, rates.false_negative) == (1, 2, 0.0, 0.5)
    with pytest.raises(ValueError):
        lsh.candidates(signed, 30, 5)
    assert lsh.candidates(signed, 20, 5, least=True).count() >= 1


# ------------------------------------------------------------------ scalars

@settings(max_examples=20, deadline=None)
@given(st.lists(st.integers(0, 9), max_size=6), st.lists(st.integers(0, 9), max_size=6))
def test_jaccard_is_symmetric(spark, a, b):
    df = spark.createDataFrame([(a, b)], "a array<int>, b array<int>")
    x, y = df.select(scalars.set_jaccard(F.col("a"), F.col("b")), scalars.set_jaccard(F.col("b"), F.col("a"))).first()
    assert x == y == (len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 0)


def test_scalars(spark):
    assert one(spark, scalars.half_even(F.col("x")), x=2.5) == 2 and one(spark, scalars.half_even(F.col("x")), x=3.5) == 4
    assert one(spark, scalars.seconds_of_day(F.col("x")), x="01:02:03") == 3723 and one(spark, scalars.seconds_of_day(F.col("x")), x="1:2") is None
    assert one(spark, scalars.antecedent(F.col("x")), x="a,b,c") == "a,b" and one(spark, scalars.consequent(F.col("x")), x="a,b,c") == "c"
    assert one(spark, scalars.euclidean(F.col("x"), F.col("y")), x=[0.0, 3.0], y=[4.0, 0.0]) == 5
    assert one(spark, scalars.bit_jaccard(F.col("x"), F.col("y")), x=[0.0, 0.0], y=[0.0, 0.0]) == 0
    assert one(spark, scalars.masked(F.col("x"), [0, 2]), x=[1.0, 2.0, 3.0]) == [2.0]
    assert one(spark, scalars.mahalanobis(F.col("x"), F.col("c"), F.col("s")), x=[2.0, 1.0], c=[0.0, 0.0], s=[2.0, 0.0]) == pytest.approx(2**0.5)


# ------------------------------------------------------------------ collaborative filtering

def test_similarity_against_dense_vectors(spark):
    rng = np.random.default_rng(1)
    users, items = 12, 6
    m = np.where(rng.random((users, items)) < 0.6, rng.integers(1, 6, (users, items)), 0).astype(float)
    rows = [(u, i, float(m[u, i])) for u in range(users) for i in range(items) if m[u, i]]
    ratings = spark.createDataFrame(rows, "user long, item long, rating double")
    for r in cf.item_similarity(ratings).collect():
        a, b = m[:, r.i], m[:, r.j]
        a, b = a - a[a > 0].mean(), b - b[b > 0].mean()
        assert r.similarity == pytest.approx(a @ b / np.sqrt((a @ a) * (b @ b)))
    for r in cf.item_similarity(ratings, centre_missing=False).collect():
        a = np.where(m[:, r.i] > 0, m[:, r.i] - m[m[:, r.i] > 0, r.i].mean(), 0)
        b = np.where(m[:, r.j] > 0, m[:, r.j] - m[m[:, r.j] > 0, r.j].mean(), 0)
        den = np.sqrt((a @ a) * (b @ b))
        assert r.similarity == pytest.approx(a @ b / den if den > 1e-6 else 0)


# ------------------------------------------------------------------ clustering

def test_ward_against_plain_agglomeration():
    rng = np.random.default_rng(2)
    for n, k in ((12, 3), (20, 4), (5, 5), (6, 1)):
        x = rng.normal(size=(n, 3))
        sets = [[i] for i in range(n)]
        cost = lambda a, b: len(a) * len(b) / (len(a) + len(b)) * ((x[a].mean(0) - x[b].mean(0)) ** 2).sum()
        while len(sets) > k:
            a, b = min(combinations(sets, 2), key=lambda p: cost(*p))
            sets = [s for s in sets if s not in (a, b)] + [a + b]
        label = clustering.ward_labels(x, k)
        assert {frozenset(np.flatnonzero(label == j).tolist()) for j in set(label)} == {frozenset(s) for s in sets}


def blobs(spark, n=90):
    rng = np.random.default_rng(3)
    rows = [(k, (rng.normal(size=3) * 0.1 + (k % 3) * 5).tolist()) for k in range(n)]
    return spark.createDataFrame([*rows, (n, None)], "id long, v array<double>")


def test_clusterings_find_separate_groups(spark):
    points = blobs(spark)
    for found in (clustering.kmeans(points, 3)[0], clustering.bfr(points, 3, 3)[0], clustering.ward(points, 3), clustering.bisecting(points, 3)[0]):
        rows = [(r.id % 3, r.cluster) for r in found.where("v is not null").collect()]
        assert len(rows) == 90 and len(set(rows)) == 3
    with pytest.raises(ValueError):
        clustering.ward(spark.range(clustering.MOST_WARD + 1).select("id", F.array(F.col("id").cast("double")).alias("v")), 2)


def test_geometry(spark, monkeypatch):
    monkeypatch.setattr(clustering, "BLOCK", 3)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(20, 2))
    df = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)] + [(99, [0.0, 0.0], 2)], "id long, v array<double>, cluster long")
    out = {r.cluster: r for r in clustering.geometry(df).collect()}
    assert out[1].radius == pytest.approx(np.linalg.norm(x - x.mean(0), axis=1).max())
    assert out[1].diameter == pytest.approx(max(np.linalg.norm(a - b) for a, b in combinations(x, 2)))
    assert out[2].radius == 0 and out[2].diameter == 0 and out[2].density is None


# ------------------------------------------------------------------ graphs

def test_recommendations(spark):
    edges = graph.undirected(spark.createDataFrame([(1, 2), (2, 3), (3, 4), (2, 4), (5, 5), (None, 1)], "src long, dst long"))
    assert {(r.a, r.b): r.mutual for r in graph.recommendations(edges).collect()} == {(1, 3): 1, (3, 1): 1, (1, 4): 1, (4, 1): 1}


def test_pairs_of_hubs_in_cells(spark, monkeypatch):
    rng = random.Random(8)
    rows = {(rng.randrange(4), rng.randrange(60)) for _ in range(150)}
    want = {}
    for u in range(4):
        own = sorted(v for x, v in rows if x == u)
        for i, a in enumerate(own):
            for b in own[i + 1 :]:
                want[a, b] = want.get((a, b), 0) + 1
    df = spark.createDataFrame(sorted(rows), "u long, v long")
    monkeypatch.setattr(graph, "HUB", 7)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert {(r.a, r.b): r.n for r in graph.pair_counts(df, "u", "v").collect()} == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    few = spark.createDataFrame(df.collect(), df.schema).limit(1000)
    assert {(r.a, r.b): r.n for r in graph.pair_counts(few, "u", "v").collect()} == want


def test_exact_pairs_against_all_pairs(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcd ") for _ in range(rng.choice([5, 9, 40, 80]))) for _ in range(25)]
    texts = base + [x[: len(x) // 2] + "z" + x[len(x) // 2 :] for x in base] + [x + "ab" for x in base] + [None, ""]
    sets = [{(t or "")[:8]} | {t[i : i + 9] for i in range(len(t) - 8)} if t and len(t) >= 8 else set() for t in texts]
    want = {(i, j): len(a & b) / len(a | b) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and a & b and len(a & b) >= 0.5 * len(a | b)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {(r.a, r.b): r.jaccard for r in lsh.exact_pairs(docs, 0.5).collect()} == pytest.approx(want)
    assert len(want) > 20


def test_signatures_hash_every_shingle(spark):
    text = "Ünïcode ŤEXT with 👍 and more of it"
    low = text.lower()

    def poly(x):
        h = 0
        for ch in x:
            h = (h + ord(ch)) * lsh.BASE % 100_000_000
        return h

    hashes = {poly(low[:8]), *(poly(low[i : i + 9]) for i in range(len(low) - 8))}
    assert set(lsh.shingle_hashes(text).tolist()) == hashes
    out = lsh.signatures(spark.createDataFrame([(1, text), (2, None), (3, "short"), (4, "eight ch")], "doc_id long, text string")).collect()
    assert {r.doc_id: r.signature for r in out} == {1: [min((a * h + b) % lsh.MODULUS for h in hashes) for a, b in lsh.coefficients()], 4: [(a * poly("eight ch") + b) % lsh.MODULUS for a, b in lsh.coefficients()]}


def test_bfr_keeps_single_points_apart(spark):
    rng = random.Random(1)
    rows = [(k, [rng.gauss(10 * (k % 3), 0.3), rng.gauss(0, 0.3)]) for k in range(300)] + [(1000 + k, [500.0 * (k + 1), -900.0 * k]) for k in range(6)]
    points = spark.createDataFrame(rows, "id long, v array<double>")
    found, summaries_ = clustering.bfr(points, 3, 4)
    assert found.count() == 306 and sum(r["n"] for r in summaries_) == 306


def test_spectrum_of_two_cliques(spark):
    pairs = [(a, b) for s in (0, 10) for a, b in combinations(range(s, s + 5), 2)] + [(0, 10)]
    edges = graph.undirected(spark.createDataFrame(pairs, "src long, dst long")).select(F.lit(1).alias("graph"), "src", "dst", F.lit(1.0).alias("weight"))
    found = graph.eigenpairs(graph.laplacian(edges), 2).cache()
    gaps = {r["rank"]: r.gap for r in graph.eigengaps(found).collect()}
    assert gaps[0] is None and 0 < gaps[1] < 1
    labels = graph.spectral_clusters(found, 2).select("node", "cluster", (F.col("node") >= 10).alias("truth"))
    assert graph.adjusted_rand(labels, "cluster", "truth").first().ari == pytest.approx(1.0)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=4, max_size=20))
def test_rand_index_ignores_names(spark, labels):
    rows = spark.createDataFrame([(x, 7 - x) for x in labels], "a int, b int")
    assert graph.adjusted_rand(rows).first().ari == pytest.approx(1.0)


# ------------------------------------------------------------------ order and streams

def test_numbered(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(50) if k % 9 else None, k) for k in range(500)]
    out = relational.numbered(spark.createDataFrame(rows, "t int, k int"), "t", ["k"]).collect()
    want = {k: i for i, (_, k) in enumerate(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])))}
    assert {r.k: r.position for r in out} == want


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 1), max_size=300), st.integers(1, 300))
def test_dgim_is_within_half(bits, window):
    d = state.Dgim()
    for b in bits:
        d.push(b)
    true = sum(bits[-window:])
    assert abs(d.estimate(window) - true) <= 0.5 * true + 1e-9
    assert all(1 <= len(level) <= 2 for level in d.levels)


@pytest.mark.parametrize("n", [0, 1, 2, 37, 400])
def test_dgim_in_closed_form(spark, n):
    rng = random.Random(n)
    bits = [int(rng.random() < 0.4) for _ in range(n)]
    d = state.Dgim()
    for b in bits:
        d.push(b)
    df = spark.createDataFrame(list(enumerate(bits)), "seq long, bit int")
    assert {r.window: r.ones for r in summaries.dgim_counts(df).collect()} == {w: d.estimate(w) for w in summaries.WINDOWS}
    assert {r.window: r.ones for r in summaries.exact_window_counts(df).collect()} == {w: sum(bits[-w:]) for w in summaries.WINDOWS}


def test_streams_equal_batches(spark, tmp_path):
    rng = random.Random(5)
    rows = [(k, rng.choice("abc"), int(rng.random() < 0.3)) for k in range(300)]
    for i in range(3):  # three files, three micro-batches
        part = rows[i * 100 : (i + 1) * 100]
        rng.shuffle(part)
        spark.createDataFrame(part, "seq long, element string, bit int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    schema = "seq long, element string, bit int"
    every = spark.createDataFrame(rows, schema)

    def last(make, name):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").withColumn("key", F.lit("k"))
        seen = {}
        state.run_to_end(make(stream), lambda batch, k: seen.__setitem__(k, batch.collect()), f"{tmp_path}/{name}")
        assert len([v for v in seen.values() if v]) == 3
        return max(seen.values(), key=lambda v: v[0].n if v else 0)

    weights = {r.element: r.weight for r in last(lambda s: state.decayed_stream(s, c=0.01), "decay")}
    want = {r.element: r.weight for r in summaries.decayed_weights(every, 0.01).collect()}
    assert weights == pytest.approx(want)
    counts = {r.window: r.ones for r in last(state.dgim_stream, "dgim")}
    assert counts == {r.window: r.ones for r in summaries.dgim_counts(every).collect()}
    sample = last(lambda s: state.reservoir_stream(s, size=50), "sample")
    assert len(sample) == 50 and sample[0].n == 300


def test_reservoir_is_stable(spark):
    df = spark.range(500)
    a, b = ({r.id for r in summaries.reservoir(x, "id", 40).collect()} for x in (df, df.repartition(7)))
    assert a == b and len(a) == 40
