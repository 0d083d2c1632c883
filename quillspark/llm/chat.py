"""Chat formatting by perspective rotation, in DataFrame functions only.

For every participant of a conversation the dialogue is rendered once with that speaker as the assistant and the
others as named users; system turns stay system turns. Spans tell the characters that the assistant speaks, which are the
ones to learn from.

A dialogue is rendered in segments of at most ``TURNS`` turns, almost always one, so that no row grows without bound; ``most`` sets
another length. System turns stand in the segment where they were spoken. Conversations of that length
are gathered whole, one shuffle, at most TURNS rows each; longer ones are numbered by a distributed sort, so no
conversation of any length meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import Scratch, table
from quillspark.llm.ranks import ranked

TURNS = 256
#: Up to so many ids of long conversations are broadcast.
BROADCAST_LONG = 1_000_000


def _plain(text: Column) -> Column:
    """Without markers: what a speaker says can't end a turn or begin another."""
    return F.replace(text, F.lit("<|im_"), F.lit("< |im_"))


def _rendered(perspective: Column, turns: Column) -> tuple[Column, Column]:
    """Text and spans of an array of (role, text) structs."""

    def header(t: Column) -> Column:
        mine = F.lit("assistant")
        user = F.concat(F.lit("user name="), _plain(F.translate(t["role"], "\r\n", "  ")))
        return F.concat(F.lit("<|im_start|>"), F.when(t["role"] == "system", F.lit("system")).when(t["role"] == perspective, mine).otherwise(user), F.lit("\n"))

    parts = F.transform(turns, lambda t: F.struct((t["role"] == perspective).alias("mine"), F.length(header(t)).alias("head"), F.concat(header(t), _plain(t["text"]), F.lit("<|im_end|>\n")).alias("whole")))
    text = F.array_join(F.transform(parts, lambda p: p["whole"]), "")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        end = acc["at"] + F.length(p["whole"])
        span = F.concat_ws("-", (acc["at"] + p["head"]).cast("string"), (end - 1).cast("string"))
        return F.struct(end.alias("at"), F.when(p["mine"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return text, F.array_join(F.aggregate(parts, start, step)["spans"], ";")


def rotate(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", most: int = TURNS) -> DataFrame:
    """``conv_id, perspective, segment, n_turns, text, spans``: one row per conversation, participant and segment.

    Participants are the distinct roles but ``system``; a null role is the participant "unknown". Turns stand in order of
    number (null last), role, text; ties and repeated rows all stay. A null text is empty; rows with no
    conversation id are one conversation. A conversation of system turns alone has no participant and gives no
    rows, as does an empty table. Spans are ``start-end`` in characters of the text, end exclusive, joined by ";",
    and cover the assistant's words and end marker. A marker inside a text or role is broken up by a space, and line ends in a role
    become spaces. A participant who is silent in a segment has no span there. Other columns are ignored, whatever their names.
    """
    scratch = Scratch(turns.sparkSession, "chat")
    rows = turns.select(
        F.col(id_col).alias("conv_id"), F.col(turn_col).isNull().alias("late"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    long = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select(F.col("conv_id").alias("k"))
    long = scratch.save(long, "long")
    n_long = long.count()
    few = F.broadcast(long) if n_long <= BROADCAST_LONG else long
    same = F.col("conv_id").eqNullSafe(F.col("k"))

    short = rows.join(few, same, "left_anti") if n_long else rows
    whole = short.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("late", "turn", "role", "text"))).alias("turns"))
    names = F.array_distinct(F.transform("turns", lambda t: t["role"]))
    ready = whole.select("conv_id", F.lit(0).alias("segment"), "turns", F.explode(F.filter(names, lambda x: x != "system")).alias("perspective"))
    if n_long:
        placed = ranked(rows.join(few, same, "left_semi"), "conv_id", ["late", "turn", "role", "text"], scratch)
        placed = placed.withColumn("segment", F.floor((F.col("_rank") - 1) / most).cast("int"))
        parts = placed.groupBy("conv_id", "segment").agg(F.sort_array(F.collect_list(F.struct("_rank", "role", "text"))).alias("turns"))
        who = placed.where("role != 'system'").select(F.col("conv_id").alias("k"), F.col("role").alias("perspective")).distinct()
        parts = parts.join(who, same).select("conv_id", "segment", "turns", "perspective")
        pick = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
        ready = ready.withColumn("turns", pick).unionByName(parts.withColumn("turns", pick))
    text, spans = _rendered(F.col("perspective"), F.col("turns"))
    return ready.select("conv_id", "perspective", "segment", F.size("turns").alias("n_turns"), text.alias("text"), spans.alias("spans"))


def op9_chat_formatting(spark, sf_dir: str) -> DataFrame:
    return rotate(table(spark, sf_dir, "conversations"))


OP9_SQL = """
with t as (select conv_id, turn, coalesce(role, 'unknown') as role, coalesce(text, '') as text from conversations),
n as (select *, row_number() over (partition by conv_id order by turn nulls last, role, text) - 1 as r from t),
p as (select distinct conv_id, role as perspective from t where role <> 'system'),
h as (select n.conv_id, p.perspective, n.r, (n.r // 256)::int as segment, n.role = p.perspective as mine, replace(n.text, '<|im_', '< |im_') as text,
    '<|im_start|>' || case when n.role = 'system' then 'system' when n.role = p.perspective then 'assistant' else 'user name=' || replace(replace(replace(n.role, chr(13), ' '), chr(10), ' '), '<|im_', '< |im_') end || chr(10) as head
  from n join p on n.conv_id is not distinct from p.conv_id),
w as (select *, head || text || '<|im_end|>' || chr(10) as whole from h),
o as (select *, sum(length(whole)) over (partition by conv_id, perspective, segment order by r)::bigint as stop from w)
select conv_id, perspective, segment, count(*)::int as n_turns, string_agg(whole, '' order by r) as text,
  coalesce(string_agg((stop - length(whole) + length(head)) || '-' || (stop - 1), ';' order by r) filter (where mine), '') as spans
from o group by conv_id, perspective, segment
"""
