import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from orefield.llm import bitplanes, common, queries
from orefield.llm.edit_counts import CountTree, count_trees, edit_counts, revisions
from orefield.llm.tokens import Encoder

DEFINITION = open(public_tokenizers.path("byte_bpe_50k.json")).read()
ENCODER = Encoder(DEFINITION)
ODD = ["", " ", "  a", "a  b ", "a\n b\t c", "don't won' t 's", "x  y", "ÀÉ!! wörd,x ... ###", "<|endoftext|> b", "1 2 33, a1!", " 　 z", "a" * 5000, "é" * 300 + " " + "!" * 300]


def encoded(text):
    """The ids of one text through the operator's encoder."""
    return [x for _, ids, _ in ENCODER.encode(pa.array([text])) for x in ids.tolist()]


def whole(text):
    return ENCODER.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ODD)
def test_pieces_encode_as_the_whole(text):
    assert encoded(text) == whole(text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list("ab A.,!'s1\n\t é_²½٣")), max_size=30))
def test_pieces_encode_as_the_whole_on_random_texts(text):
    assert encoded(text) == whole(text)


@pytest.mark.parametrize("kind", ["bytes", "bits"])
@pytest.mark.parametrize("n", [0, 1, 7, 1000])
def test_planes_round_trip(kind, n):
    ids = np.random.default_rng(n).integers(0, 1 << 32, n).astype("<u4")
    chunks, planes = bitplanes.to_frame(ids, kind, block=256)
    assert (bitplanes.from_frame(chunks, planes, n, kind) == ids).all()


def written(spark, tmp_path, rows, kind="bytes"):
    docs = spark.createDataFrame(rows, "doc_id long, text string, part int, at long")
    bitplanes.write_tokens(docs, f"file://{tmp_path}/t", DEFINITION, 2, kind=kind)
    return bitplanes.read_tokens(spark, f"file://{tmp_path}/t", with_ids=True).collect()


@pytest.mark.parametrize("kind", ["bytes", "bits"])
def test_files_hold_all_documents_in_order(spark, tmp_path, kind):
    rows = [(k * 7 % 50, ODD[k % len(ODD)] if k % 5 else None, 1, 2) for k in range(50)] + [(None, "no id", 0, 0), (3, "again", 0, 0), (3, "again", 0, 0)]
    out = written(spark, tmp_path, rows, kind)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens) for r in out) == sorted((i is not None, i or 0, len(whole(t or "")) + 1) for i, t, _, _ in rows)
    at = 0
    for r in sorted(out, key=lambda r: r.start):
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids[-1] == 2
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    keys = [r.doc_id if r.doc_id is not None else -1 for r in sorted(out, key=lambda r: r.start)]
    assert keys == sorted(keys)
    text_of = {i: t or "" for i, t, _, _ in rows if i != 3}
    assert all(r.ids[:-1] == whole(text_of[r.doc_id]) for r in out if r.doc_id in text_of)


def test_no_documents(spark, tmp_path):
    assert written(spark, tmp_path, []) == []


def test_tree_counts_as_encoding_the_edited_text():
    rng = random.Random(1)
    alphabet = "ab  .,!\n'é1"
    for _ in range(150):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 400)))
        tree = CountTree(ENCODER, text)
        assert tree.total == len(whole(text)) and tree.chars[1] == len(text)
        for _ in range(8):
            a = rng.randrange(0, len(text) + 3)
            b = a + rng.choice([0, 0, 1, 3, 40, 500])
            new = "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 2, 30])))
            text = text[:a] + new + text[b:]
            assert tree.edit(a, b, new) == len(whole(text)), repr(text)


def test_edits_touch_their_region_only():
    tree = CountTree(ENCODER, "some words here " * 5000)
    tree.edit(40000, 40010, "else")
    assert tree.encoded < 100


def test_edit_counts_of_odd_rows(spark):
    schema = "doc_id long, text string, edits array<struct<start:long,end:long,text:string>>, n_tokens string"
    rows = [(1, None, None, ""), (2, "a b", [(None, None, None), None, (-5, 900, "c d e")], ""), (2, "a b", [(1, 1, None)], ""), (None, "", [(0, 0, " x")], "")]
    docs = spark.createDataFrame(rows, schema)
    out = sorted((r.doc_id or 0, r.n_tokens, r.n_after) for r in edit_counts(docs, DEFINITION).collect())
    assert out == [(0, 0, 1), (1, 0, 0), (2, 2, 2), (2, 2, 3)]
    assert edit_counts(docs.limit(0), DEFINITION).collect() == []


@given(st.lists(st.integers(0, 2**64 - 1), max_size=50))
def test_packed_arrays_round_trip(values):
    a, b = np.array(values, np.uint64), common.narrow(np.array(values, np.uint64) >> np.uint64(40))
    x, y = common.split_arrays(common.join_arrays(a, b))
    assert (x == a).all() and (y == b).all()


def test_pieces_encode_as_the_whole_for_every_code_point():
    texts = [f"a{chr(x)}b\n{chr(x)} {chr(x)}'s" for x in range(0x20000) if not 0xD800 <= x < 0xE000]
    got = [x for _, ids, n in ENCODER.encode(pa.array(texts)) for x in np.split(ids, np.cumsum(n)[:-1])]
    want = ENCODER.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert all(a.tolist() == b.ids for a, b in zip(got, want, strict=True))


def test_pieces_that_share_a_slot():
    small = Encoder(DEFINITION, slot_bits=2)
    texts = [" ".join(f"w{k * j}x" for k in range(40)) for j in range(30)]
    got = [x.tolist() for _ in range(2) for _, ids, n in small.encode(pa.array(texts)) for x in np.split(ids, np.cumsum(n)[:-1])]
    assert got == [whole(x) for x in texts] * 2


@pytest.mark.parametrize("unit", ["some line\n", "漢字仮名交換紀錄處理語言", "日本語のテキストを処理する", "한국어문장을처리한다", "слово", "a　b\t", "x,y;z-"])
def test_edits_touch_their_region_only_without_spaces(unit):
    text = unit * (24000 // len(unit))
    tree = CountTree(ENCODER, text)
    assert tree.edit(12000, 12004, "字x") == len(whole(text[:12000] + "字x" + text[12004:]))
    assert tree.encoded < 200


def test_tree_of_odd_scripts_counts_as_encoding_the_edited_text():
    rng = random.Random(2)
    alphabet = "a '\n　漢字。中か한é́s 1"
    for _ in range(150):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 200)))
        tree = CountTree(ENCODER, text)
        for _ in range(6):
            a = rng.randrange(0, len(text) + 2)
            b = a + rng.choice([0, 1, 3, 60])
            new = "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 2, 3000])))
            text = text[:a] + new + text[b:]
            assert tree.edit(a, b, new) == len(whole(text)), repr(text)
            assert tree.whole()[0] == text and tree.pieces == len(tree.whole()[1])


def test_edits_start_from_stored_trees(spark):
    rows = [(k, ODD[k % len(ODD)] * 3 if k % 7 else None) for k in range(40)]
    store = count_trees(spark.createDataFrame(rows, "doc_id long, text string"), DEFINITION)
    text_of = {i: t or "" for i, t in rows}
    assert {r.doc_id: (r.text, r.n_tokens) for r in store.collect()} == {i: (t, len(whole(t))) for i, t in text_of.items()}
    once = edit_counts(store.withColumn("edits", F.expr("array(named_struct('start', 2L, 'end', 5L, 'text', 'new'))")), DEFINITION, tree_col="tree", with_trees=True)
    twice = edit_counts(once.drop("n_tokens").withColumn("edits", F.expr("array(named_struct('start', 0L, 'end', 1L, 'text', '字 '))")), DEFINITION, tree_col="tree", with_trees=True)
    for r in twice.collect():
        t = text_of[r.doc_id]
        t = t[:2] + "new" + t[5:]
        t, old = "字 " + t[1:], t
        assert (r.text, r.n_tokens, r.n_after, r.n_chars) == (t, len(whole(old)), len(whole(t)), len(t))


def test_edit_query_against_encoding_the_edited_texts(spark, tiny):
    """The registered query's counts, by brute force: make the edits in plain Python and encode whole texts."""
    texts = {}
    for r in revisions(spark.read.parquet(f"{tiny}/documents.parquet")).select("doc_id", "text", "edits").collect():
        old = new = r.text or ""
        for e in r.edits:
            a = min(max(e["start"], 0), len(new))
            new = new[:a] + e["text"] + new[max(a, min(e["end"], len(new))) :]
        texts[r.doc_id] = len(whole(old)), len(whole(new)), len(new)
    got = {r.doc_id: (r.n_tokens, r.n_after, r.n_chars) for r in queries.op2_edit_counts(spark, tiny).collect()}
    assert got == texts


def test_token_query_against_the_library(spark, tiny):
    rows = sorted((r.doc_id, whole(r.text or "") + [2]) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect())
    want, at = [], 0
    for i, ids in rows:
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in queries.op1_bitplane_tokens(spark, tiny).select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == want


UNTOUCHED = Tokenizer.from_str(DEFINITION)
END = "<|endoftext|>"


def by_library(text):
    """The ids of a text under the library's defaults, special tokens in it included."""
    return UNTOUCHED.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from([END, "<|endof", "text|>", "a", " ", "'s", "é字", "\n", "  b,"]), max_size=9).map("".join)), max_size=6))
def test_special_tokens_as_the_library_reads_them(texts):
    got = [x.tolist() for _, ids, n in ENCODER.encode(pa.array(texts, pa.string()), specials=True) for x in np.split(ids, np.cumsum(n)[:-1])]
    assert got == [by_library(x or "") for x in texts]


def test_special_tokens_that_strip_are_refused():
    odd = Encoder(DEFINITION.replace('"lstrip": false', '"lstrip": true').replace('"lstrip":false', '"lstrip":true'))
    with pytest.raises(ValueError):
        list(odd.encode(pa.array(["a"]), specials=True))


def test_token_query_of_texts_with_special_tokens(spark, tmp_path):
    texts = [f"a  {END}\n b{END}{END}", None, END, "plain text", f"{END} x " * 3000, "", END[:5], END[5:]]
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    want, at = [], 0
    for k, t in enumerate(texts):
        ids = [*by_library(t or ""), 2]
        want.append((k, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = queries.op1_bitplane_tokens(spark, str(tmp_path)).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(tuple(r) for r in got) == want
