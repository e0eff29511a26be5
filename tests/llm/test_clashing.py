"""Tables whose own columns are called as the operators' are: every value stays."""

import numpy as np
from pyspark.sql import functions as F

from orefield.llm import decontam, jaccard_join, langid, mixture, pivot_index, sanitise
from tests.llm.test_other_operators import brute_links

NAMES = "size key take source epochs cut_key cut_words __size __key __take __source __epochs words hits items __words __hits __items gone __gone doc __id actions __actions least component a.b".split()
PASSAGE = "alpha beta gamma delta epsilon zeta eta theta iota kappa"


def table(spark):
    rows = [(k, f"plain words of document {k} that nobody else has {k * 7}", "en", f"s{k % 3}") for k in range(30)]
    rows += [(100, f"see {PASSAGE} here", "en", "s0"), (101, "one two three four five six seven eight nine ten", "en", "s1"), (102, "one two three four five six seven eight nine ten", "en", "s1"), (103, "joe@corp.example.com", "en", None), (104, None, "en", "s2"), (105, "", None, "s2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, src string")
    return docs.select("*", *(F.concat(F.lit(f"{n}-"), F.col("doc_id").cast("string")).alias(n) for n in NAMES))


def unchanged(out, columns, ids=None):
    assert out.columns == columns
    rows = out.collect()
    for r in rows:
        assert [r[n] for n in NAMES] == [f"{n}-{r.doc_id}" for n in NAMES]
    assert ids is None or sorted(r.doc_id for r in rows) == ids
    return {r.doc_id: r.text for r in rows}


def test_all_values_stay(spark):
    docs = table(spark)
    every = sorted(r.doc_id for r in docs.select("doc_id").collect())
    bench = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    unchanged(mixture.mixed(docs, source_col="src"), docs.columns)
    unchanged(mixture.mixed(docs, source_col="source"), docs.columns)
    unchanged(decontam.decontaminate(docs, bench), docs.columns, [x for x in every if x != 100])
    assert unchanged(decontam.decontaminate(docs, bench, remove="spans"), docs.columns, every)[100] == "see  here"
    unchanged(jaccard_join.one_of_each_group(docs), docs.columns, [x for x in every if x != 102])
    assert unchanged(sanitise.sanitised(docs), docs.columns, every)[103].split()[-1] == "[PII]"
    unchanged(langid.accepted(docs, langid.train(docs)), docs.columns)


def test_components_of_near_vectors_against_brute_force(spark):
    """Chains and stars of pairs at cosine 0.98 to 0.985 are found, and nothing below it."""
    rng = np.random.default_rng(9)

    def near(x, cosine):
        n = rng.normal(size=x.shape)
        n -= (n @ x) / (x @ x) * x
        return cosine * x / np.linalg.norm(x) + np.sqrt(1 - cosine**2) * n / np.linalg.norm(n)

    rows = [(k, rng.normal(size=64), k % 2) for k in range(300)]
    for k in range(60):
        x = rows[k][1]
        for j in range(3):
            x = near(x, 0.9801 + 0.005 * rng.random())
            rows.append((1000 + 10 * k + j, x, k % 2 if j < 2 else 1 - k % 2))
    rows += [(3000 + k, near(rows[5][1], 0.979), 1) for k in range(20)]
    rows = [(i, np.array(v, np.float32).tolist(), label) for i, v, label in rows]
    links = brute_links(rows)
    assert len(links) >= 200
    root = list(range(len(rows)))
    for _ in range(8):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    out = {r.vec_id: (r.n_links, r.component_id) for r in pivot_index.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    want = {i: (sum(a == k for a, _ in links), min(rows[j][0] for j in range(len(rows)) if root[j] == root[k])) for k, (i, _, _) in enumerate(rows)}
    assert out == want
