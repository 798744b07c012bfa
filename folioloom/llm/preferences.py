"""Preference formatting: a chosen and a rejected conversation as one prompt and two masked completions.

A turn renders as ``<|role|>``, a line break, its text, ``<|end|>`` and a line break. The longest common prefix of both
conversations' turns (role and text alike) is rendered once, as the prompt; what is left of each is a completion, and its
mask names the spans to learn: text and end mark of the turns of the assistant.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEARNED = "assistant"


def conversations(turns: DataFrame) -> DataFrame:
    """``(conv_id, turns)``: each conversation's turns as an array of (turn, role, text) in order; nulls come first, equal turns stay."""
    turn = F.struct(F.col("turn").cast("long").alias("turn"), "role", "text")
    return turns.where("conv_id is not null").groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def _head(t: F.Column) -> F.Column:
    return F.concat(F.lit("<|"), F.coalesce(t["role"], F.lit("")), F.lit("|>\n"))


def _body(t: F.Column) -> F.Column:
    return F.concat(F.coalesce(t["text"], F.lit("")), F.lit("<|end|>"))


def rendered(turns: F.Column) -> F.Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t), F.lit("\n"))), "")


def mask(turns: F.Column) -> F.Column:
    """Spans to learn as ``start:end`` in code points of the rendered turns, with commas between."""

    def step(a: F.Column, t: F.Column) -> F.Column:
        start = a["at"] + F.length(_head(t))
        end = start + F.length(_body(t))
        span = F.concat(start.cast("string"), F.lit(":"), end.cast("string"))
        return F.struct((end + 1).alias("at"), F.when(t["role"].eqNullSafe(LEARNED), F.concat(a["spans"], F.array(span))).otherwise(a["spans"]).alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))
    return F.array_join(F.aggregate(turns, start, step)["spans"], ",")


def preferences(pairs: DataFrame) -> DataFrame:
    """``(pair_id, n_prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask)`` from ``(pair_id, chosen, rejected)`` arrays of turns.

    A missing side has a null completion and mask, and the prompt is then empty. Conversations that are equal, or one the
    other's beginning, leave an empty completion.
    """
    both = F.least(F.size("chosen"), F.size("rejected"))
    differ = F.filter(F.sequence(F.lit(0), F.greatest(both - 1, F.lit(0))), lambda k: ~(F.get("chosen", k)["role"].eqNullSafe(F.get("rejected", k)["role"]) & F.get("chosen", k)["text"].eqNullSafe(F.get("rejected", k)["text"])))
    shared = F.when(F.col("chosen").isNull() | F.col("rejected").isNull(), 0).otherwise(F.coalesce(F.array_min(differ), both))
    rows = pairs.withColumn("n", shared.cast("int"))
    rest = lambda side: F.slice(side, F.col("n") + 1, F.greatest(F.size(side), F.lit(1)))
    return rows.select(
        "pair_id",
        F.col("n").cast("long").alias("n_prompt_turns"),
        F.when(F.col("n") > 0, rendered(F.slice("chosen", F.lit(1), F.col("n")))).otherwise("").alias("prompt"),
        rendered(rest("chosen")).alias("chosen"),
        rendered(rest("rejected")).alias("rejected"),
        mask(rest("chosen")).alias("chosen_mask"),
        mask(rest("rejected")).alias("rejected_mask"),
    )


def paired(turns: DataFrame) -> DataFrame:
    """Conversations 2 i (chosen) and 2 i + 1 (rejected) as pair i; turns without a conv_id belong to none."""
    own = conversations(turns).withColumn("pair_id", F.shiftright("conv_id", 1))
    side = lambda odd: F.max(F.when(F.pmod("conv_id", F.lit(2)) == odd, F.col("turns")))
    return own.groupBy("pair_id").agg(side(0).alias("chosen"), side(1).alias("rejected"))


def answered_otherwise(turns: DataFrame) -> DataFrame:
    """``(pair_id, chosen, rejected)``: conversation 2 i, and the same with another answer, the last one of conversation 2 i + 1.

    The other answer stands for conversation 2 i's last turn of the assistant (without one, after all turns), and nothing
    follows it. Without such an answer there is no rejected side. Turns without a conv_id belong to no pair.
    """
    own = conversations(turns).withColumn("pair_id", F.shiftright("conv_id", 1))
    side = lambda odd: F.max(F.when(F.pmod("conv_id", F.lit(2)) == odd, F.col("turns")))
    rows = own.groupBy("pair_id").agg(side(0).alias("chosen"), side(1).alias("other"))
    last = lambda c: F.array_max(F.filter(F.sequence(F.lit(0), F.size(c) - 1), lambda k: F.get(c, k)["role"].eqNullSafe(LEARNED)))
    rows = rows.withColumn("cut", F.coalesce(last("chosen"), F.size("chosen"))).withColumn("at", last("other"))
    before = F.when(F.col("chosen").isNull(), F.slice("other", F.lit(1), F.lit(0))).otherwise(F.slice("chosen", F.lit(1), F.col("cut")))
    rejected = F.when(F.col("at").isNotNull(), F.concat(before, F.slice("other", F.col("at") + 1, F.lit(1))))
    return rows.select("pair_id", "chosen", rejected.alias("rejected"))


SQL = """
WITH s AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k,
    CAST(floor(conv_id / 2.0) AS BIGINT) AS pair_id, conv_id - 2 * CAST(floor(conv_id / 2.0) AS BIGINT) AS odd
  FROM conversations WHERE conv_id IS NOT NULL),
cut AS (SELECT pair_id, coalesce(max(k) FILTER (role = 'assistant'), max(k) + 1) AS cut FROM s WHERE odd = 0 GROUP BY pair_id),
other AS (
  SELECT pair_id, role, text FROM s WHERE odd = 1 AND role = 'assistant'
  QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY k DESC) = 1),
u AS (
  SELECT pair_id, 0 AS side, k, role, text FROM s WHERE odd = 0
  UNION ALL SELECT s.pair_id, 1, s.k, s.role, s.text FROM s JOIN cut USING (pair_id) JOIN other USING (pair_id) WHERE odd = 0 AND k < cut
  UNION ALL SELECT pair_id, 1, coalesce(cut, 1), role, text FROM other LEFT JOIN cut USING (pair_id)),
t AS (SELECT *, '<|' || coalesce(role, '') || '|>' || chr(10) AS head, coalesce(text, '') || '<|end|>' AS body FROM u),
n AS (
  SELECT s.pair_id, coalesce(any_value(m.n0), 0) AS n0, coalesce(any_value(m.n1), 0) AS n1 FROM s
  LEFT JOIN (SELECT pair_id, count(*) FILTER (side = 0) AS n0, count(*) FILTER (side = 1) AS n1 FROM t GROUP BY pair_id) m USING (pair_id) GROUP BY s.pair_id),
d AS (
  SELECT a.pair_id, min(a.k) AS k FROM t a JOIN t b ON a.pair_id = b.pair_id AND a.k = b.k AND a.side = 0 AND b.side = 1
  WHERE a.role IS DISTINCT FROM b.role OR a.text IS DISTINCT FROM b.text GROUP BY a.pair_id),
p AS (SELECT n.*, CASE WHEN n0 = 0 OR n1 = 0 THEN 0 ELSE coalesce(d.k - 1, least(n0, n1)) END AS n_prompt FROM n LEFT JOIN d USING (pair_id)),
c AS (
  SELECT t.*, p.n_prompt, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY t.pair_id, side ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS pos
  FROM t JOIN p USING (pair_id) WHERE t.k > p.n_prompt)
SELECT p.pair_id, CAST(n_prompt AS BIGINT) AS n_prompt_turns,
  coalesce((SELECT string_agg(head || body || chr(10), '' ORDER BY k) FROM t WHERE t.pair_id = p.pair_id AND side = 0 AND k <= n_prompt), '') AS prompt,
  CASE WHEN n0 > 0 THEN coalesce((SELECT string_agg(head || body || chr(10), '' ORDER BY k) FROM c WHERE c.pair_id = p.pair_id AND side = 0), '') END AS chosen,
  CASE WHEN n1 > 0 THEN coalesce((SELECT string_agg(head || body || chr(10), '' ORDER BY k) FROM c WHERE c.pair_id = p.pair_id AND side = 1), '') END AS rejected,
  CASE WHEN n0 > 0 THEN coalesce((SELECT string_agg(CAST(pos AS BIGINT) || ':' || CAST(pos + length(body) AS BIGINT), ',' ORDER BY k) FROM c WHERE c.pair_id = p.pair_id AND side = 0 AND role = 'assistant'), '') END AS chosen_mask,
  CASE WHEN n1 > 0 THEN coalesce((SELECT string_agg(CAST(pos AS BIGINT) || ':' || CAST(pos + length(body) AS BIGINT), ',' ORDER BY k) FROM c WHERE c.pair_id = p.pair_id AND side = 1 AND role = 'assistant'), '') END AS rejected_mask
FROM p
"""
