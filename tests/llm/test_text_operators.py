import hashlib
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from orefield.llm import decontam, jaccard_join, langid, mixture, sanitise

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, n long, hub long, __size int"


def docs_of(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, lang, s, 1, "k", 2, 3, 4) for i, t, lang, s in rows], DOCS)


def from_table(spark, tiny):
    return [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]


ODD = [(1001, None, None, None), (1002, "", "en", None), (1003, " \t\n", None, "s"), (1004, "one two", "en", "s"), (1005, "ONE  two", "en", "s"), (1006, "one two", "en", "s"), (None, "one two", None, "s"), (1007, "x" * 70000, "en", "s"), (1008, "a b c d e f g", None, "t"), (1008, "a b c d e f g", None, "t")]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# ------------------------------------------------------------------ n-gram Jaccard join

def shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", lower(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows, percent=80):
    sets = [shingles(t) for _, t, *_ in rows]
    held, root = defaultdict(list), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, s in enumerate(sets):
        for g in s:
            held[g].append(k)
    for a, b in {(a, b) for v in held.values() for a in v for b in v if a < b}:
        n = len(sets[a] & sets[b])
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            root[find(a)] = find(b)
    out = []
    for k, (i, *_) in enumerate(rows):
        own = [rows[j][0] for j in range(len(rows)) if find(j) == find(k) and rows[j][0] is not None]
        out.append((i, len(sets[k]), min(own) if own and sets[k] else i))
    return sorted(out, key=str)


def near_copies(n=60, words=40):
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(words)]
    rows = []
    for k in range(n):
        own = list(base)
        for _ in range(rng.integers(0, 3)):
            own[rng.integers(words)] = f"x{rng.integers(1000)}"
        rows.append((k, " ".join(own[: words - rng.integers(0, 4)]), "en", "s"))
    return rows


def short_sets():
    return [(500 + k, " ".join(f"s{j}" for j in range(9) if j != k), "en", "s") for k in range(9)] + [(600 + k, " ".join(f"s{j}" for j in range(8 + k)), "en", "s") for k in range(6)]


@pytest.mark.parametrize("rows", [ODD, near_copies(), short_sets() + near_copies(30, 16), "table"])
def test_jaccard_components(spark, tiny, rows):
    rows = [*from_table(spark, tiny), *ODD] if rows == "table" else rows
    out = jaccard_join.jaccard_components(docs_of(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=str) == brute_components(rows)


def test_jaccard_blocks_and_large_cohorts(spark, monkeypatch):
    rows = near_copies()
    monkeypatch.setattr(jaccard_join, "BLOCK", 7)
    monkeypatch.setattr(jaccard_join, "MOST_COHORT", 10)
    out = jaccard_join.jaccard_components(docs_of(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=str) == brute_components(rows)


def test_jaccard_light_sets_only(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "_subset_sizes", jaccard_join._subset_sizes)
    rows = [(k, " ".join(f"q{j}" for j in range(9) if j != k % 9) + (" z" * (k % 2)), "en", "s") for k in range(80)]
    out = jaccard_join.jaccard_components(docs_of(spark, rows), max_subsets=5000).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=str) == brute_components(rows)


def test_jaccard_of_nothing(spark):
    assert jaccard_join.jaccard_components(docs_of(spark, [])).collect() == []


def test_one_of_each_group(spark):
    df = docs_of(spark, ODD)
    kept = jaccard_join.one_of_each_group(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1001, 1002, 1003, 1004, None, 1007, 1008, 1008], key=str)


# ------------------------------------------------------------------ decontamination

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute_hits(rows, items, k=10):
    windows = defaultdict(set)
    for i, t in items:
        w = WORD.findall(lower(t))
        for j in range(len(w) - min(k, len(w)) + 1) if w else ():
            windows[tuple(w[j : j + k])].add(i)
    out = []
    for i, t, *_ in rows:
        w, hit, found = WORD.findall(lower(t)), set(), set()
        for n in {len(x) for x in windows}:
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in windows:
                    hit.update(range(j, j + n))
                    found |= windows[tuple(w[j : j + n])]
        names = ",".join(sorted(map(str, found)))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [decontam.BLOCK_BYTES, 3000])
def test_hits(spark, tiny, block):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()] + [(900, "Three short-words"), (901, None), (902, ""), (11, "Three short-words"), (11, "Three short-words")]
    rows = [*from_table(spark, tiny), *ODD, (2000, "so three SHORT, words and three short words", "en", "s"), (2001, f"x {items[3][1]} y", "en", "s")]
    out = decontam.benchmark_hits(docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block)
    assert sorted((tuple(r)[:6] for r in out.collect()), key=str) == brute_hits(rows, items)


@pytest.mark.parametrize("items", [[], [(1, None)], [(1, "?!")]])
def test_no_items_no_hits(spark, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {r.contaminated for r in decontam.benchmark_hits(docs_of(spark, ODD), bench).collect()} == {False}
    assert decontam.decontaminate(docs_of(spark, ODD), bench).count() == len(ODD)


def test_removal(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    rows = [(1, "Say: ALPHA, beta - gamma! End.", "en", "s"), (2, "alpha beta", "en", "s"), (3, None, None, None)]
    df = docs_of(spark, rows)
    assert sorted(r.doc_id for r in decontam.decontaminate(df, bench).collect()) == [2, 3]
    out = {r.doc_id: r.text for r in decontam.decontaminate(df, bench, remove="spans").collect()}
    assert out == {1: "Say: ! End.", 2: "alpha beta", 3: None}
    assert decontam.decontaminate(docs_of(spark, []), bench).collect() == []


# ------------------------------------------------------------------ mixing

def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        left = [s for s in names if s not in capped]
        rest = total - sum(capped.values())
        t = {s: rest * w[s] / sum(w[x] for x in left) for s in left}
        over = [s for s in left if t[s] > most * sizes[s]]
        if not over:
            return t | capped
        capped |= {s: most * sizes[s] for s in over}


@pytest.mark.parametrize("rows", [ODD, "table", [(k, "w " * (k % 40), "en", f"s{k % 5}") for k in range(3000)]])
def test_mix(spark, tiny, rows):
    rows = [*from_table(spark, tiny), *ODD] if rows == "table" else rows
    df = docs_of(spark, rows)
    out = mixture.mix(df).collect()
    size = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += size(t)
    want, source = brute_targets(dict(sizes)), defaultdict(set)
    assert sorted((str(r.doc_id), r.size) for r in out) == sorted((str(i), size(t)) for i, t, *_ in rows)
    taken, goal = defaultdict(int), {}
    for i, t, _, s in rows:
        source[i, size(t)].add(s)
    for r in out:
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size + r.part
        (s,) = source[r.doc_id, r.size]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s])
        taken[s] += r.taken
        goal[s] = r.target
    for s in goal:
        assert abs(taken[s] - goal[s]) <= 2
    again = mixture.mix(df.repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_mixed_rows(spark):
    rows = [(k, f"a{k} b{k}\n c{k}", "en", f"s{k % 3}") for k in range(40)] + ODD
    df = docs_of(spark, rows)
    decided = {(r.doc_id, r.size): r for r in mixture.mix(df).collect()}
    out = mixture.mixed(df)
    assert out.columns == df.columns
    words = defaultdict(int)
    text = {i: t for i, t, *_ in rows}
    for r in out.collect():
        words[r.doc_id] += len(r.text.split())
        assert text[r.doc_id].startswith(r.text)
    for (i, n), r in decided.items():
        if i not in (1008, None):
            assert words[i] == r.taken, (i, n)
    assert mixture.mixed(docs_of(spark, [])).collect() == [] and mixture.mix(docs_of(spark, [])).collect() == []


# ------------------------------------------------------------------ personal data

def brute_base(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and sum(sum(divmod(int(x) * (1 + k % 2), 10)) for k, x in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


PIECES = ["a.b+c@x.example.com", "@", "a@b", "x@y.z", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111", "+1 (555) 123-4567", "+12", "+", "é", " ", "..", "word", "12", "-", "0000001.2.3.255"]


def test_base_spans_against_plain_patterns(spark, tiny):
    rng = np.random.default_rng(3)
    for _ in range(3000):
        text = "".join(PIECES[k] for k in rng.integers(0, len(PIECES), rng.integers(1, 12)))
        assert sanitise.base_spans(text) == brute_base(text), text
    for _, t, *_ in from_table(spark, tiny):
        assert sanitise.base_spans(t or "") == brute_base(t or "")
    for text in ("a" * 200000, "1" * 200000, "1." * 100000, "@" * 100000, "+1" * 50000, "1 " * 100000, "a@" * 50000):
        sanitise.base_spans(text)


def test_terms_that_disclose_are_added(spark):
    rows = [(k, f"filler{k} the other zorblax mail bob@corp.example.com and the rest{k}", "en", "s") for k in range(6)]
    rows += [(100 + k, f"the mail about other text{k} and more rest", "en", "s") for k in range(60)] + ODD
    out = {r.doc_id: r for r in sanitise.sanitise_spans(docs_of(spark, rows)).collect()}
    r = out[0]
    text = rows[0][1]
    spans = [x.split(":") for x in r.spans.split(",")]
    assert [text[int(a) : int(b)] for k, a, b in spans if k == "term"] == ["zorblax"]
    assert r.n_email == 1 and r.n_terms == 1 and r.n_removed == 1
    assert r.base_sha256 == hashlib.sha256(",".join(":".join(x) for x in spans if x[0] != "term").encode()).hexdigest()
    assert out[101].spans == "" and out[1001].spans == ""
    clean = {r.doc_id: r.text for r in sanitise.sanitised(docs_of(spark, rows), generalise=0.5).collect() if r.doc_id is not None}
    assert "zorblax" not in clean[0] and "bob@" not in clean[0] and "[PII]" in clean[0] and clean[101] == rows[7][1]
    assert sanitise.sanitise_spans(docs_of(spark, [])).collect() == []


def test_sanitise_whole_table(spark, tiny):
    rows = from_table(spark, tiny) + ODD
    for r in sanitise.sanitise_spans(docs_of(spark, rows)).collect():
        text = next(t for i, t, *_ in rows if i == r.doc_id) or ""
        base = sanitise.written_spans(brute_base(text))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert ",".join(x for x in r.spans.split(",") if x and not x.startswith("term")) == base
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for _, k, _ in brute_base(text)) for j in range(4)]


def test_entities_of_one_or_two_documents_get_terms(spark, tiny):
    rows = [(9001, "the quuxley wrote to eve@corp.example.com again", "en", "s")]
    rows += [(9002 + k, f"the blixted calls +1 (555) 123-456{k // 2} again", "en", "s") for k in range(2)] + from_table(spark, tiny)
    out = {r.doc_id: r for r in sanitise.sanitise_spans(docs_of(spark, rows)).collect()}
    for i, t, *_ in rows[:3]:
        assert {"9001": "quuxley"}.get(str(i), "blixted") in [t[int(a) : int(b)] for k, a, b in (x.split(":") for x in out[i].spans.split(",")) if k == "term"]
    of_table = [r for i, r in out.items() if i < 9000 and r.n_email + r.n_ip + r.n_card + r.n_phone]
    assert of_table and sum(r.n_terms for r in of_table) > 0


def test_words_far_from_a_mention_count(spark):
    far = " ".join(f"f{k}" for k in range(12))
    rows = [(k, f"zorblax {far} bob@corp.example.com" if k else f"zorblax bob@corp.example.com {far}", "en", "s") for k in range(4)]
    rows += [(100 + k, f"{far} text{k}", "en", "s") for k in range(60)]
    out = {r.doc_id: r for r in sanitise.sanitise_spans(docs_of(spark, rows)).collect()}
    # near the mention in one of four documents, whose count alone gives a share of a third
    assert out[0].actions.startswith("0:7:remove")


def entity_of(kind, value):
    return kind, value.lower() if kind < 2 else re.sub("[^0-9]", "", value)


def brute_terms(rows, generalise=0.6, remove=0.9):
    """Terms (start, end, removed) of each row by its place, counted document by document."""
    n = max(len(rows), 2)
    docs, held, both, own = defaultdict(int), defaultdict(set), defaultdict(set), []
    for i, t, *_ in rows:
        t = t or ""
        spans = brute_base(t)
        every = [(m[0], m.start(), m.end()) for m in WORD.finditer(lower(t))]
        free = [(w, a, b) for w, a, b in every if not any(a < z and b > x for x, _, z in spans)]
        entities = {entity_of(k, t[a:b]) for a, k, b in spans}
        for w in {w for w, *_ in every}:
            docs[w] += 1
        for e in entities:
            held[e].add((i, t))
            for w in {w for w, *_ in free}:
                both[e, w].add((i, t))
        own.append((entities, free))

    def share(e, w):
        h, k = len(held[e]), len(both[e, w])
        return np.log(k * n / (h * docs[w])) / np.log(n / (h if k >= 3 else k)) if 2 * h <= n else -1

    out = []
    for entities, free in own:
        best = {w: max((share(e, w) for e in entities), default=-1) for w in {w for w, *_ in free}}
        out.append([(a, b, bool(best[w] >= remove)) for w, a, b in free if best[w] >= generalise])
    return out


def test_every_occurrence_is_marked(spark, tiny):
    gap = " ".join(f"other{k % 5}" for k in range(30))
    rows = [(5000, f"é zorblax joe@corp.example.com {gap} zorblax Zorblax", "en", "s"), (5001, f"ann@corp.example.com and Joe@corp.example.com {gap} wimbley", "en", "s"), (5002, f"+1 (555) 123-4567 {gap} wimbley ann@corp.example.com", "en", "s")]
    rows += [(5010 + k, f"team@corp.example.com {gap} motto part{k}", "en", "s") for k in range(20)] + ODD
    rows += from_table(spark, tiny)
    expected = sorted(((i, [(f"{a}:{b}", "remove" if r else "generalise") for a, b, r in own]) for (i, *_), own in zip(rows, brute_terms(rows), strict=True)), key=str)
    out = sanitise.sanitise_spans(docs_of(spark, rows)).collect()
    got = sorted(((r.doc_id, [(x.rpartition(":")[0], x.rpartition(":")[2]) for x in r.actions.split(",") if x and not x.endswith(":redact")]) for r in out), key=str)
    assert got == expected
    clean = {r.doc_id: r.text for r in sanitise.sanitised(docs_of(spark, rows)).collect()}
    assert "zorblax" not in lower(clean[5000]) and "wimbley" not in clean[5001] and "motto" not in clean[5012]


# ------------------------------------------------------------------ language

def test_every_language_is_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "EPOCHS", 1)
    rows = [(k, f"word{k % 410} text", f"l{k % 410}", "s") for k in range(410 * 8)]
    model = langid.train(docs_of(spark, rows))
    assert set(model.languages) == {lang for _, _, lang, _ in rows}


def test_language_of_held_out_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(df)
    out = langid.identify(df, model).join(df, "doc_id").collect()
    held = [r for r in out if r.held_out and r.lang_pred != "und"]
    assert len(held) > 200
    assert sum(r.lang_pred == r.lang for r in held) / len(held) >= 0.97
    assert all(0 <= r.score <= 1 for r in out)
    assert sum(r.accepted for r in out) / len(out) > 0.98


def test_language_of_odd_texts(spark, tiny):
    df = docs_of(spark, [*from_table(spark, tiny), *ODD, (3000, "123 !? ...", "en", "s"), (3001, "éé", "fr", "s")])
    model = langid.train(df)
    out = {r.doc_id: r for r in langid.identify(df, model).collect()}
    for i in (1001, 1002, 1003, 3000):
        assert out[i].lang_pred == "und" and out[i].score == 0 and not out[i].accepted
    assert out[3001].lang_pred in ("en", "fr", "de", "es")
    kept = langid.accepted(df, model)
    assert kept.columns == df.columns and not {1001, 1002, 1003, 3000} & {r.doc_id for r in kept.collect()}
    empty = docs_of(spark, [])
    none = langid.train(empty)
    assert langid.identify(empty, none).collect() == []
    assert {r.lang_pred for r in langid.identify(df, none).collect()} == {"und"}


def test_rejection_catches_wrong_predictions(spark):
    """Texts in languages that were never learned can only be named wrongly: nearly all are rejected, and hardly any right prediction is."""
    rng = np.random.default_rng(6)
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(df)
    alphabets = ["абвгдежзиклмнопрстуфхцчшщыэюя", "αβγδεζηθικλμνξοπρστυφχψω", "漢字仮名交換紀錄處理語言日本中国", "qxzjkvwpfgybmcdl", "אבגדהוזחטיכלמנסעפצקרשת"]
    strange = [" ".join("".join(rng.choice(list(a), rng.integers(2, 9))) for _ in range(60)) for a in alphabets for _ in range(20)]
    caught = 1 - np.mean(model.predict(pa.array(strange))[2])
    out = langid.identify(df, model).join(df.select("doc_id", "lang"), "doc_id").where("held_out and lang_pred <> 'und'").collect()
    wrong = [r for r in out if r.lang_pred != r.lang]
    right = [r for r in out if r.lang_pred == r.lang]
    print("strange texts caught", caught, "wrong", len(wrong), "of these caught", sum(not r.accepted for r in wrong), "right", len(right), "of these lost", sum(not r.accepted for r in right))
    assert caught >= 0.95
    assert sum(r.accepted for r in right) >= 0.995 * len(right)
