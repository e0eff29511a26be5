"""Preference formatting: a shared prompt and two masked completions.

The longest common prefix of turns of a chosen and a rejected conversation is
rendered once; what follows of either is its completion, with the spans of it
that are to be learned (the assistant's turns).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

OPEN, BREAK, CLOSE = "<|", "|>\n", "<|end|>\n"
LEARNED_ROLE = "assistant"


def _head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), F.coalesce(turn["role"], F.lit("")), F.lit(BREAK))


def _body(turn: Column) -> Column:
    return F.concat(F.coalesce(turn["text"], F.lit("")), F.lit(CLOSE))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t))), "")


def _spans(turns: Column, learned_role: str) -> Column:
    """start:end, in code points of the rendered turns, of what the learned role says, joined by commas; a turn knows where it ends."""
    first = F.get(turns, F.lit(0))
    before = first["end"] - first["size"]
    place = lambda t: F.concat_ws(":", (t["end"] - t["said"] - before).cast("string"), (t["end"] - before).cast("string"))
    return F.array_join(F.transform(F.filter(turns, lambda t: t["role"] == learned_role), place), ",")


def preference_pairs(turns: DataFrame, pair: str = "pair_id", chosen: str = "chosen", turn: str = "turn", role: str = "role", text: str = "text", learned_role: str = LEARNED_ROLE) -> DataFrame:
    """(pair_id, n_shared, n_chosen, n_rejected, prompt, chosen, chosen_spans, rejected, rejected_spans), a row for each pair.

    turns has a row for each turn: the pair, whether it is of the chosen
    conversation (null: of neither, left out), its place, role and text.  Turns
    stand in the order of place, role and text, nulls first; repeated rows are
    repeated turns.  Two turns are equal when role and text are, null like
    null; a null is rendered as empty and never learned.  A pair of which one
    side has no turns has an empty completion there; if both are equal, both
    completions are empty.  A null pair is a pair.  Other columns are not
    looked at.  A conversation, being one text of the result, is gathered in
    one row; turns of many pairs never are.
    """
    own = turns.select(F.col(pair).alias("pair_id"), F.col(chosen).cast("boolean").alias("c"), F.struct(F.col(turn).alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text")).alias("t"))
    # running lengths: a turn's end, from any place, without another pass over the turns before it
    own = own.where("c is not null").withColumn("said", F.length(_body(F.col("t")))).withColumn("size", F.length(_head(F.col("t"))) + F.col("said"))
    until = F.sum("size").over(Window.partitionBy("pair_id").orderBy("c", "t").rowsBetween(Window.unboundedPreceding, 0))
    own = own.withColumn("end", until).select("pair_id", "c", F.struct("t.turn", "t.role", "t.text", "end", "size", "said").alias("t"))
    both = own.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.when(F.col("c"), F.col("t")))).alias("a"), F.array_sort(F.collect_list(F.when(~F.col("c"), F.col("t")))).alias("b"))
    same = F.zip_with("a", "b", lambda x, y: x.isNotNull() & y.isNotNull() & x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]))
    first = F.array_position(same, False)
    both = both.withColumn("n", F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int"))
    rest = lambda x: F.slice(x, F.col("n") + 1, F.greatest(F.size(x) - F.col("n"), F.lit(0)))
    both = both.select("pair_id", "n", "a", "b", F.slice("a", F.lit(1), F.col("n")).alias("p"), rest(F.col("a")).alias("x"), rest(F.col("b")).alias("y"))
    return both.select(
        "pair_id", F.col("n").cast("long").alias("n_shared"), F.size("a").cast("long").alias("n_chosen"), F.size("b").cast("long").alias("n_rejected"), _rendered(F.col("p")).alias("prompt"),
        _rendered(F.col("x")).alias("chosen"), _spans(F.col("x"), learned_role).alias("chosen_spans"), _rendered(F.col("y")).alias("rejected"), _spans(F.col("y"), learned_role).alias("rejected_spans"),
    )


#: For the query: of conversations 2k and 2k + 1, the even one is chosen.
SQL = """
WITH turns AS (
  SELECT conv_id // 2 AS pair_id, conv_id % 2 = 0 AS c, role, text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i,
    '<|' || coalesce(role, '') || '|>' || chr(10) AS head, coalesce(text, '') || '<|end|>' || chr(10) AS body
  FROM conversations
), sides AS (
  SELECT pair_id, count(*) FILTER (WHERE c) AS n_chosen, count(*) FILTER (WHERE NOT c) AS n_rejected FROM turns GROUP BY pair_id
), shared AS (
  SELECT s.pair_id, least(n_chosen, n_rejected, coalesce(min(d.i) - 1, least(n_chosen, n_rejected))) AS n_shared, any_value(n_chosen) AS n_chosen, any_value(n_rejected) AS n_rejected
  FROM sides s LEFT JOIN (
    SELECT a.pair_id, a.i FROM turns a JOIN turns b ON a.pair_id = b.pair_id AND a.i = b.i AND a.c AND NOT b.c
    WHERE a.role IS DISTINCT FROM b.role OR a.text IS DISTINCT FROM b.text
  ) d ON s.pair_id = d.pair_id GROUP BY s.pair_id, n_chosen, n_rejected
), rest AS (
  SELECT t.*, sum(length(head) + length(body)) OVER (PARTITION BY t.pair_id, c ORDER BY t.i) AS until
  FROM turns t JOIN shared s ON t.pair_id = s.pair_id AND t.i > s.n_shared
), made AS (
  SELECT pair_id, c, string_agg(head || body, '' ORDER BY i) AS out,
    string_agg((until - length(body))::BIGINT::VARCHAR || ':' || until::BIGINT::VARCHAR, ',' ORDER BY i) FILTER (WHERE role = 'assistant') AS spans
  FROM rest GROUP BY pair_id, c
), prompts AS (
  SELECT t.pair_id, string_agg(head || body, '' ORDER BY i) AS prompt FROM turns t JOIN shared s ON t.pair_id = s.pair_id AND t.i <= s.n_shared AND t.c GROUP BY t.pair_id
)
SELECT s.pair_id, s.n_shared::BIGINT AS n_shared, s.n_chosen::BIGINT AS n_chosen, s.n_rejected::BIGINT AS n_rejected, coalesce(p.prompt, '') AS prompt,
  coalesce(a.out, '') AS chosen, coalesce(a.spans, '') AS chosen_spans, coalesce(b.out, '') AS rejected, coalesce(b.spans, '') AS rejected_spans
FROM shared s LEFT JOIN prompts p ON s.pair_id = p.pair_id
LEFT JOIN made a ON s.pair_id = a.pair_id AND a.c LEFT JOIN made b ON s.pair_id = b.pair_id AND NOT b.c
"""
