"""The registered query of each operator, over its whole table, and its SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The vocabulary file that the queries use, and the id that ends a document.
TOKENIZER, END_ID = "byte_bpe_50k.json", 2


def tokenizer_definition(name: str = TOKENIZER) -> str:
    """The text of a public vocabulary file."""
    import public_tokenizers

    return Path(public_tokenizers.path(name)).read_text()


def op1_bitplane_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orefield.llm import bitplanes, common

    path = common.scratch_path(spark, "tokens")
    bitplanes.write_tokens(_table(spark, sf_dir, "documents"), path, tokenizer_definition(), END_ID, specials=True)
    return bitplanes.read_tokens(spark, path)


def op2_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees of all documents are stored; three edits of each start from the store."""
    from orefield.llm import common
    from orefield.llm.edit_counts import count_trees, edit_counts, revisions

    store = common.written(count_trees(_table(spark, sf_dir, "documents"), tokenizer_definition()), "trees")
    return edit_counts(revisions(store), tokenizer_definition(), tree_col="tree")


def op3_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orefield.llm.sanitise import sanitise_spans

    return sanitise_spans(_table(spark, sf_dir, "documents"))


def op4_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orefield.llm.pivot_index import near_vectors

    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op5_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of conversations 2k and 2k + 1, the even one is chosen."""
    from orefield.llm.preference import preference_pairs

    turns = _table(spark, sf_dir, "conversations").select("turn", "role", "text", F.expr("conv_id div 2").alias("pair_id"), (F.col("conv_id") % 2 == 0).alias("chosen"))
    return preference_pairs(turns)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orefield.llm.decontam import benchmark_hits

    return benchmark_hits(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("items")


def op7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orefield.llm.mixture import mix

    return mix(_table(spark, sf_dir, "documents"))


def op8_mincut_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orefield.llm.mincut_html import main_text

    return main_text(_table(spark, sf_dir, "pages"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orefield.llm import langid

    docs = _table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orefield.llm.jaccard_join import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bitplane_tokens, op2_edit_counts, op3_sanitise, op4_pivot_index, op5_preference, op6_decontaminate, op7_mixture, op8_mincut_html, op9_langid, op10_jaccard_join)}


_DECONTAMINATE_SQL = """
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL
), windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM items WHERE len(w) > 0)
), sizes AS (
  SELECT DISTINCT k FROM windows
), places AS (
  SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS win FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, sizes WHERE len(w) >= k)
), hits AS (
  SELECT p.doc_id, p.k, p.i, x.item FROM places p JOIN windows x ON p.k = x.k AND p.win = x.win
), words AS (
  SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM (SELECT DISTINCT doc_id, k, i FROM hits)) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS l FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(len(d.w), 0)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(i.n, 0)::BIGINT AS n_items, sha256(coalesce(i.l, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM docs d LEFT JOIN words h ON d.doc_id = h.doc_id LEFT JOIN named i ON d.doc_id = i.doc_id
"""


_JACCARD_SQL = """
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM docs WHERE len(w) >= 5)
    UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM docs WHERE len(w) BETWEEN 1 AND 4)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)
), either_way AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached(doc_id, root) AS (
  SELECT doc_id, doc_id FROM docs UNION SELECT e.b, root FROM reached JOIN either_way e ON reached.doc_id = e.a
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, r.root AS component_id
FROM docs d LEFT JOIN sizes s ON d.doc_id = s.doc_id JOIN (SELECT doc_id, min(root) AS root FROM reached GROUP BY doc_id) r ON d.doc_id = r.doc_id
"""


def oracle_sql() -> dict[str, str]:
    from orefield.llm import mixture, preference

    return {"op5_preference": preference.SQL, "op6_decontaminate": _DECONTAMINATE_SQL, "op7_mixture": mixture.SQL, "op10_jaccard_join": _JACCARD_SQL}
