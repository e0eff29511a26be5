import itertools
import json
import random

import numpy as np
import pytest

from orefield.llm import mincut_html, pivot_index
from orefield.llm.components import components
from orefield.llm.preference import preference_pairs

# ------------------------------------------------------------------ components


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 340)] + [(5, 5), (None, 3), (7, None)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    out = {r.node: r.component for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert out == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "src long, dst long")).collect() == []


# ------------------------------------------------------------------ pivot index

VECTORS = "vec_id long, embedding array<float>, label int, key string, weight string"


def brute_links(rows, cosine=0.98):
    ok = lambda v: v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    unit = {k: np.array(v, float) / np.linalg.norm(np.array(v, float)) for k, (_, v, label) in enumerate(rows) if label is not None and ok(v)}
    return {(a, b) for a in unit for b in unit if a != b and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= cosine}


def groups(n=400, dim=64, copies=40):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(n, dim))
    rows = [(k, v.tolist(), k % 3) for k, v in enumerate(base)]
    rows += [(1000 + k, (base[k % 50] + rng.normal(size=dim) * 0.1).tolist(), (k % 50) % 3) for k in range(120)]
    rows += [(2000 + k, (base[7] + rng.normal(size=dim) * 0.07).tolist(), 7 % 3) for k in range(copies)]
    rows += [(3000 + k, base[8].tolist(), 8 % 3) for k in range(5)]
    return rows


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, label, "k", "w") for i, v, label in rows], VECTORS)
    return {r.vec_id: r for r in pivot_index.near_vectors(df, **kw).collect()}


@pytest.mark.parametrize("block", [pivot_index.BLOCK, 16])
def test_recall_and_precision(spark, monkeypatch, block):
    monkeypatch.setattr(pivot_index, "BLOCK", block)
    rows = groups()
    rows = [(i, np.array(v, np.float32).tolist(), label) for i, v, label in rows]
    out, links = run(spark, rows), brute_links(rows)
    found = sum(r.n_links for r in out.values())
    assert found <= len(links) and found >= 0.95 * len(links)
    for k, (i, _, _) in enumerate(rows):
        assert out[i].n_links <= sum(a == k for a, _ in links)
        assert out[i].kept == (out[i].component_id == i)
    assert out[3004].n_links >= 5 and out[3004].component_id == 8


@pytest.mark.parametrize("pivots", pivot_index.PIVOTS)
def test_recall_of_each_number_of_pivots(spark, pivots):
    rows = [(i, np.array(v, np.float32).tolist(), label) for i, v, label in groups()]
    df = spark.createDataFrame([(*r, "k", "w") for r in rows], VECTORS)
    links = brute_links(rows)
    found = sum(r.n_links for r in pivot_index.near_vectors(df, pivots=pivots).collect())
    print("pivots", pivots, "found", found, "of", len(links))
    assert 0.95 * len(links) <= found <= len(links)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1), (6, [None, 1.0], 1), (7, [1.0, 0.0], None), (8, [1.0, 0.0], None), (9, [1.0, 0.0], 1), (10, [2.0, 0.0], 1), (11, [1.0, 0.0], 2), (12, [1.0, 0.0, 0.0], 1), (13, [3e38, 3e38], 1), (14, [1e-38, 1e-38], 1), (9, [1.0, 0.0], 1)]
    df = spark.createDataFrame([(*r, "k", "w") for r in rows], VECTORS)
    out = pivot_index.near_vectors(df).collect()
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in out)
    assert got == [(i, 0, i) for i in range(1, 9)] + [(9, 2, 9), (9, 2, 9), (10, 2, 9), (11, 0, 11), (12, 0, 12), (13, 1, 13), (14, 1, 13)]
    assert pivot_index.near_vectors(df.limit(0)).collect() == []


# ------------------------------------------------------------------ preferences

TURNS = "pair_id long, chosen boolean, turn long, role string, text string, n long, a string"


def render(turns):
    return "".join(f"<|{r or ''}|>\n{t or ''}<|end|>\n" for r, t in turns)


def test_preferences(spark):
    talks = {
        1: ([("user", "hi"), ("assistant", "yes é"), ("user", "so")], [("user", "hi"), ("assistant", "no")]),
        2: ([("user", "x")], [("user", "x")]),
        3: ([("user", "x")], []),
        4: ([(None, "x"), ("assistant", None)], [(None, "x"), ("assistant", "y"), ("assistant", "z")]),
        None: ([("user", "q")], [("user", "r")]),
    }
    rows = [(p, c == 0, k, r, t, 0, "") for p, sides in talks.items() for c, side in enumerate(sides) for k, (r, t) in enumerate(side)]
    rows += [(1, None, 0, "user", "of neither", 0, "")]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, TURNS)
    out = {r.pair_id: r for r in preference_pairs(df).collect()}
    assert set(out) == set(talks)
    for p, (a, b) in talks.items():
        n = len(list(itertools.takewhile(lambda x: x[0] == x[1], zip(a, b))))
        r = out[p]
        assert (r.n_shared, r.n_chosen, r.n_rejected) == (n, len(a), len(b))
        assert (r.prompt, r.chosen, r.rejected) == (render(a[:n]), render(a[n:]), render(b[n:]))
    learned = [r[int(x) : int(y)] for r, s in ((out[4].rejected, out[4].rejected_spans),) for x, y in (z.split(":") for z in s.split(","))]
    assert learned == ["y<|end|>\n", "z<|end|>\n"]
    assert out[1].chosen_spans == "14:27" and out[2].chosen == out[2].rejected == ""
    assert preference_pairs(df.limit(0)).collect() == []


# ------------------------------------------------------------------ HTML

def test_minimum_cut_against_all_labellings():
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randint(0, 8)
        scores = [rng.randint(-9, 9) for _ in range(n)]
        edges = [(i, j, rng.randint(0, 6)) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.4]

        def cost(side, scores=scores, edges=edges):
            return sum(abs(x) for x, a in zip(scores, side) if (x > 0) != a and x) + sum(w for u, v, w in edges if side[u] != side[v])

        assert cost(mincut_html.min_cut(scores, edges)) == min(map(cost, itertools.product([False, True], repeat=n)))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body class="has-sidebar">
<header><h1>Site name</h1><nav><ul><li><a href="/a">Home</a><li><a href='/b>c'>News</a></ul></nav></header>
<div id="cookie-notice">We use cookies to make this site a better place for every one of our readers.</div>
<div class="ad">Buy now, it is a very cheap and a very good thing that you need.</div>
<article><header><h1>The  title</h1></header><p>First para&shy;graph of the&nbsp;article, with <b>bold</b> text &amp; a <a href=x>link</a> in it.<p>Short.
<ul><li>One item of the list<li>Two</ul><p>And a last one<br>that closes the article.</p><!-- <p>comment</p> -->
<section class="comments"><p>I do not agree with any of this, my friend, and I say so here.</p></section></article>
<aside><p>Most read: ten things that you never knew about pages and their blocks.</p></aside>
<form><label>Mail</label><p>Give us your address and we will send you all of our letters.</p></form>
<footer>&copy; 2020 Site name. All rights reserved by those who hold them.</footer></body></html>"""


def test_page():
    assert mincut_html.extract(PAGE) == "The title First para­graph of the article, with bold text & a link in it. Short. One item of the list Two And a last one that closes the article."


@pytest.mark.parametrize("html", ["", "   ", "<", "<p", "<!-- open", "<script>x", "</p></p>", "<a href='x", "&amp", "<b>" * 3000, "<div>" * 3000 + "x", "<p title=it's>" * 200, "<" * 3000])
def test_odd_pages_do_not_fail(html):
    mincut_html.extract(html)


def test_page_without_article_element():
    html = '<body><div class="menu"><a href=1>One</a> <a href=2>Two</a></div><div class="post-content"><h2>Head</h2><p>' + "A long sentence of the article. " * 6 + "</p><p>Short.</p></div><div class='sidebar'><p>" + "Other things to read on this site. " * 4 + "</p></div></body>"
    assert mincut_html.extract(html) == "Head " + ("A long sentence of the article. " * 6).strip() + " Short."


def test_pages_of_a_table(spark):
    rows = [(1, "u", PAGE, "x"), (None, None, None, "x"), (1, "u", PAGE, "x"), (2, "v", "<p>" + "word " * 20000, "x")]
    out = mincut_html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted(r.n_chars for r in out) == sorted([0, len(mincut_html.extract(PAGE)), len(mincut_html.extract(PAGE)), 99999])
    assert json.dumps(sorted(str(r.page_id) for r in out)) == '["1", "1", "2", "None"]'


def test_preferences_of_very_long_conversations(spark):
    rows = [(7, c, k, "assistant" if k % 2 else "user", "w" * (k % 50) + ("" if k < 3000 or c else "!")) for c in (True, False) for k in range(6000)]
    df = spark.createDataFrame(rows, "pair_id long, chosen boolean, turn long, role string, text string").repartition(4)
    (r,) = preference_pairs(df).collect()
    assert (r.n_shared, r.n_chosen, r.n_rejected) == (3000, 6000, 6000)
    spans = [tuple(map(int, x.split(":"))) for x in r.rejected_spans.split(",")]
    assert len(spans) == 1500 and all(r.rejected[a:b] == "w" * (k % 50) + "!<|end|>\n" for (a, b), k in zip(spans, range(3001, 6000, 2)))
