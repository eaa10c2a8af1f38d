"""Preference formatting: chosen and rejected conversations as one prompt and two masked completions.

The longest common prefix of turns of both conversations is rendered once, as the prompt; what is left of each is its completion. A turn is
rendered as HEAD.format(role) + text + END. A completion's mask lists the spans (start-end, in characters of the completion) that are
trained on: the text and END of its assistant turns. All is done with array functions of Spark SQL; the only shuffle gathers
a conversation's turns.

Defined cases: rows without conv_id are left out; turns are ordered by number, role and text, null numbers last, and repeated rows stay; a
null role reads "unknown" and a null text is empty; equal conversations have empty completions and masks; a conversation without an
assistant turn gives no pair; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: <|role|> and a line feed before a turn, END after it.
HEAD_OPEN, HEAD_CLOSE, END = "<|", "|>\n", "<|end|>\n"


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's (role, text) in order."""
    own = conversations.select(F.col("`conv_id`").alias("conv_id"), F.struct(F.col("`turn`").isNull().alias("last"), F.col("`turn`").alias("turn"), F.coalesce(F.col("`role`"), F.lit("unknown")).alias("role"), F.coalesce(F.col("`text`"), F.lit("")).alias("text")).alias("t")).where("conv_id is not null")
    all_turns = F.sort_array(F.collect_list("t"))
    return own.groupBy("conv_id").agg(F.transform(all_turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def stale_reply_pairs(conversations: DataFrame) -> DataFrame:
    """(conv_id, chosen, rejected): each conversation up to its last assistant turn, against the same with that reply replaced by a stale one:
    the conversation's first reply, or the turn before it where it is the only reply. Turns after the last reply are dropped."""
    last = F.array_max(F.transform(F.col("turns"), lambda t, i: F.when(t["role"] == "assistant", i + 1).otherwise(0)))
    df = turns(conversations).withColumn("n", last).where("n > 0")
    chosen = F.slice("turns", 1, F.col("n"))
    replies = F.filter("turns", lambda t: t["role"] == "assistant")
    before = F.when(F.col("n") > 1, F.element_at("turns", F.greatest(F.col("n") - 1, F.lit(1)))["text"]).otherwise(F.lit(""))
    stale = F.when(F.size(replies) > 1, replies[0]["text"]).otherwise(before)
    rejected = F.concat(F.slice("turns", 1, F.col("n") - 1), F.array(F.struct(F.lit("assistant").alias("role"), stale.alias("text"))))
    return df.select("conv_id", chosen.alias("chosen"), rejected.alias("rejected"))


def _render(ts: Column) -> Column:
    return F.array_join(F.transform(ts, lambda t: F.concat(F.lit(HEAD_OPEN), t["role"], F.lit(HEAD_CLOSE), t["text"], F.lit(END))), "")


def _mask(ts: Column) -> Column:
    def size(t):
        return F.length(t["role"]) + F.length(t["text"]) + len(HEAD_OPEN + HEAD_CLOSE + END)

    def span(t, i):
        start = F.aggregate(F.slice(ts, F.lit(1), i), F.lit(0), lambda n, x: n + size(x)) + F.length(t["role"]) + len(HEAD_OPEN + HEAD_CLOSE)
        return F.when(t["role"] == "assistant", F.concat(start.cast("string"), F.lit("-"), (start + F.length(t["text"]) + len(END)).cast("string")))

    return F.array_join(F.filter(F.transform(ts, span), lambda x: x.isNotNull()), ",")


def format_preferences(pairs: DataFrame) -> DataFrame:
    """(conv_id, n_common, prompt, chosen, rejected, chosen_mask, rejected_mask) of pairs (conv_id, chosen, rejected)."""
    a, b = F.col("chosen"), F.col("rejected")
    shorter = F.least(F.size(a), F.size(b))
    differ = F.filter(F.transform(F.slice(a, F.lit(1), shorter), lambda t, i: F.when(t != F.get(b, i), i)), lambda x: x.isNotNull())
    df = pairs.withColumn("n_common", F.coalesce(F.get(differ, F.lit(0)), shorter))
    rest = lambda c: F.slice(c, F.col("n_common") + 1, F.greatest(F.size(c) - F.col("n_common"), F.lit(0)))
    df = df.select("conv_id", "n_common", F.slice(a, F.lit(1), F.col("n_common")).alias("common"), rest(a).alias("c"), rest(b).alias("r"))
    return df.select("conv_id", "n_common", _render(F.col("common")).alias("prompt"), _render(F.col("c")).alias("chosen"), _render(F.col("r")).alias("rejected"), _mask(F.col("c")).alias("chosen_mask"), _mask(F.col("r")).alias("rejected_mask"))


_SQL_MASK = """coalesce(array_to_string(list_filter(list_transform({ts}, lambda t, i: CASE WHEN t.role = 'assistant' THEN
 CAST(list_sum(list_transform({ts}[1:i], lambda x: length(x.role) + length(x.text) + 13)) - length(t.text) - 8 AS BIGINT)::VARCHAR || '-' ||
 CAST(list_sum(list_transform({ts}[1:i], lambda x: length(x.role) + length(x.text) + 13)) AS BIGINT)::VARCHAR END), lambda x: x IS NOT NULL), ','), '')"""
_SQL_RENDER = "coalesce(array_to_string(list_transform({ts}, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), ''), '')"

#: The whole operator over the table conversations.
ORACLE = f"""
WITH g AS (SELECT conv_id, list({{'role': coalesce(role, 'unknown'), 'text': coalesce(text, '')}} ORDER BY turn IS NULL, turn, coalesce(role, 'unknown'), coalesce(text, '')) AS ts
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
n AS (SELECT conv_id, ts, list_max(list_transform(ts, lambda t, i: CASE WHEN t.role = 'assistant' THEN i ELSE 0 END)) AS n FROM g),
p AS (SELECT conv_id, ts[1:n] AS a, list_concat(ts[1:n-1], [{{'role': 'assistant', 'text': CASE WHEN len(list_filter(ts, lambda t: t.role = 'assistant')) > 1
    THEN list_filter(ts, lambda t: t.role = 'assistant')[1].text WHEN n > 1 THEN ts[n-1].text ELSE '' END}}]) AS b, n FROM n WHERE n > 0),
k AS (SELECT *, coalesce(list_filter(range(1, n + 1), lambda i: a[i] <> b[i])[1] - 1, n) AS n_common FROM p),
r AS (SELECT conv_id, n_common, a[1:n_common] AS common, a[n_common+1:] AS c, b[n_common+1:] AS r FROM k)
SELECT conv_id, CAST(n_common AS INTEGER) AS n_common, {_SQL_RENDER.format(ts="common")} AS prompt, {_SQL_RENDER.format(ts="c")} AS chosen, {_SQL_RENDER.format(ts="r")} AS rejected,
  {_SQL_MASK.format(ts="c")} AS chosen_mask, {_SQL_MASK.format(ts="r")} AS rejected_mask FROM r
"""
