"""Preference formatting of chat turns; DataFrame functions only.

The chosen and the rejected conversation of a pair are compared turn by turn; their longest common prefix is rendered
once as the prompt, and what follows it in each is rendered as a completion whose mask tells which characters are
learned: the text of assistant turns and the end mark after it, but neither role headers nor other roles' turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import read_table

HEAD, MIDDLE, END = "<|", "|>\n", "<|end|>\n"
ASSISTANT = "assistant"
CHOSEN, REJECTED = "chosen", "rejected"


def _header(turn: Column) -> Column:
    return F.concat(F.lit(HEAD), turn["role"], F.lit(MIDDLE))


def _body(turn: Column) -> Column:
    return F.concat(turn["text"], F.lit(END))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_header(t), _body(t))), "")


def _spans(turns: Column) -> Column:
    """Start and end (in characters) of what is learned in a completion."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(state: Column, t: Column) -> Column:
        begin = state["at"] + F.length(_header(t))
        end = begin + F.length(_body(t))
        learned = F.when(t["role"] == ASSISTANT, F.array(F.struct(begin.cast("long").alias("start"), end.cast("long").alias("end")))).otherwise(
            F.array().cast("array<struct<start:bigint,end:bigint>>")
        )
        return F.struct(end.cast("long").alias("at"), F.concat(state["spans"], learned).alias("spans"))

    return F.aggregate(turns, start, step, lambda s: s["spans"])


def format_preferences(turns: DataFrame) -> DataFrame:
    """One row for each pair of ``turns`` (``pair_id, side, turn, role, text``; side is chosen or rejected).

    ``prompt_turns`` turns are common to both sides from the start and rendered as ``prompt``; ``chosen`` and
    ``rejected`` are the completions and ``chosen_mask`` and ``rejected_mask`` the spans of their learned characters.
    Turns are ordered by ``turn``, then role and text; repeated rows of a side count once. A null role is "", a null
    text is "". Where one side is a prefix of the other its completion is empty; identical sides have two empty
    completions. Pairs with one side only, rows without a pair or turn and rows of other sides are left out. A pair is
    one output row, so its turns meet in one place; they are gathered per side before.
    """
    rows = turns.filter(F.col("pair_id").isNotNull() & F.col("turn").isNotNull() & F.col("side").isin(CHOSEN, REJECTED))
    item = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sides = rows.select("pair_id", "side", item.alias("item")).groupBy("pair_id").agg(
        *(F.array_sort(F.collect_set(F.when(F.col("side") == side, F.col("item")))).alias(f"{side}_turns") for side in (CHOSEN, REJECTED))
    )
    sides = sides.filter((F.size("chosen_turns") > 0) & (F.size("rejected_turns") > 0))
    a, b = F.col("chosen_turns"), F.col("rejected_turns")
    shared = F.least(F.size(a), F.size(b))
    same = lambda i: (F.get(a, i)["role"] == F.get(b, i)["role"]) & (F.get(a, i)["text"] == F.get(b, i)["text"])
    first_other = F.array_position(F.transform(F.sequence(F.lit(0), shared - 1), same), False)
    found = sides.withColumn("prompt_turns", F.when(first_other == 0, shared).otherwise(first_other - 1).cast("int"))
    rest = lambda c: F.slice(c, F.col("prompt_turns") + 1, F.size(c))
    found = found.withColumns({"__p": F.slice(a, 1, F.col("prompt_turns")), "__c": rest(a), "__r": rest(b)})
    return found.select(
        "pair_id", "prompt_turns", _render(F.col("__p")).alias("prompt"), _render(F.col("__c")).alias("chosen"), _spans(F.col("__c")).alias("chosen_mask"),
        _render(F.col("__r")).alias("rejected"), _spans(F.col("__r")).alias("rejected_mask"),
    )


def truncated_answers(conversations: DataFrame) -> DataFrame:
    """Pairs made of plain conversations: the rejected side's last assistant turn breaks off after half its words.

    Conversations without an assistant turn have no answer to prefer and give no pair; turns after the last answer are
    left out.
    """
    last = conversations.filter(F.col("role") == ASSISTANT).groupBy("conv_id").agg(F.max("turn").alias("last"))
    kept = conversations.join(last, "conv_id").filter("turn <= last")
    words = F.split(F.col("text"), " ", -1)
    half = F.array_join(F.slice(words, 1, F.floor(F.size(words) / 2).cast("int")), " ")
    cut = F.when((F.col("turn") == F.col("last")) & (F.col("role") == ASSISTANT), half).otherwise(F.col("text"))
    columns = [F.col("conv_id").alias("pair_id"), "turn", "role"]
    return kept.select(*columns, "text", F.lit(CHOSEN).alias("side")).unionByName(kept.select(*columns, cut.alias("text"), F.lit(REJECTED).alias("side")))


def op1_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = format_preferences(truncated_answers(read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))
    spans = lambda c: F.array_join(F.transform(F.col(c), lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return made.select("pair_id", "prompt_turns", "prompt", "chosen", spans("chosen_mask").alias("chosen_mask"), "rejected", spans("rejected_mask").alias("rejected_mask"))


OP1_SQL = """
with l as (select conv_id, max(turn) as last from conversations where role = 'assistant' group by conv_id),
k as (select distinct c.conv_id, c.turn, coalesce(c.role, '') as role, coalesce(c.text, '') as text, l.last from conversations c join l using (conv_id) where c.turn <= l.last),
s as (
  select conv_id, turn, role, text, 'c' as side from k
  union all
  select conv_id, turn, role, case when turn = last and role = 'assistant'
    then array_to_string(string_split(text, ' ')[1 : len(string_split(text, ' ')) // 2], ' ') else text end, 'r' from k
),
n as (select *, row_number() over (partition by conv_id, side order by turn, role, text) as pos from s),
d as (
  select coalesce(a.conv_id, b.conv_id) as conv_id,
    coalesce(min(case when a.pos is null or b.pos is null or a.role <> b.role or a.text <> b.text then coalesce(a.pos, b.pos) end) - 1, count(*)) as p
  from (select * from n where side = 'c') a full join (select * from n where side = 'r') b on a.conv_id = b.conv_id and a.pos = b.pos group by 1
),
r as (
  select n.*, d.p, '<|' || role || '|>' || chr(10) as head, text || '<|end|>' || chr(10) as body from n join d using (conv_id)
),
o as (
  select *, coalesce(sum(case when pos > p then length(head) + length(body) else 0 end) over (partition by conv_id, side order by pos rows between unbounded preceding and 1 preceding), 0) as off from r
)
select conv_id as pair_id, max(p)::int as prompt_turns,
  coalesce(string_agg(head || body, '' order by pos) filter (where side = 'c' and pos <= p), '') as prompt,
  coalesce(string_agg(head || body, '' order by pos) filter (where side = 'c' and pos > p), '') as chosen,
  coalesce(string_agg((off + length(head))::bigint || '-' || (off + length(head) + length(body))::bigint, ',' order by pos) filter (where side = 'c' and pos > p and role = 'assistant'), '') as chosen_mask,
  coalesce(string_agg(head || body, '' order by pos) filter (where side = 'r' and pos > p), '') as rejected,
  coalesce(string_agg((off + length(head))::bigint || '-' || (off + length(head) + length(body))::bigint, ',' order by pos) filter (where side = 'r' and pos > p and role = 'assistant'), '') as rejected_mask
from o group by conv_id
"""
