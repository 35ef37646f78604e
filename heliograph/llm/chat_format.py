"""Operator 4, chat formatting: collapse of cumulative snapshots, then rendering.

A log may hold a conversation again after each turn.  Every turn gets a rolling
hash of the turns up to it (two 64-bit values, each the running exclusive-or of
hashes of position, role and text).  A conversation whose last hash is the hash
of an equally long proper prefix of another is dropped by an anti-join, as are
repeats of the same conversation but for the least id; the others are rendered.
All of it is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TEMPLATE = ("<|", "|>\n", "\n<|end|>\n")


def _turns(conversations: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Clean columns, and each turn's place in its conversation from 1: by turn, then role and text; a null turn comes first."""
    source = conversations.select(
        conversations[id_col].alias("conv_id"),
        conversations[turn_col].alias("turn"),
        F.coalesce(conversations[role_col].cast("string"), F.lit("")).alias("role"),
        F.coalesce(conversations[text_col].cast("string"), F.lit("")).alias("text"),
    ).where("conv_id is not null")
    by_turn = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return source.withColumn("place", F.row_number().over(by_turn))


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """Adds ``h1`` and ``h2``, the rolling hashes of the turns up to each place."""
    so_far = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    mark = lambda salt: F.xxhash64(F.lit(salt), "place", F.length("role"), "role", "text")
    return turns.withColumn("h1", F.bit_xor(mark(1)).over(so_far)).withColumn("h2", F.bit_xor(mark(2)).over(so_far))


def maximal(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id`` and ``n_turns`` of the conversations that are no proper prefix of another, the least id of equal ones."""
    hashed = prefix_hashes(_turns(conversations, id_col, turn_col, role_col, text_col)).select("conv_id", "place", "h1", "h2")
    length = hashed.groupBy("conv_id").agg(F.max("place").alias("n_turns"), F.max_by(F.struct("h1", "h2"), "place").alias("last"))
    whole = length.groupBy("n_turns", F.col("last.h1").alias("h1"), F.col("last.h2").alias("h2")).agg(F.min("conv_id").alias("conv_id"))
    prefixes = hashed.join(whole.select("conv_id", "n_turns"), "conv_id").where("place < n_turns").select(F.col("place").alias("n_turns"), "h1", "h2").distinct()
    return whole.join(prefixes, ["n_turns", "h1", "h2"], "left_anti").select("conv_id", "n_turns")


def rendered(
    conversations: DataFrame, template: tuple[str, str, str] = TEMPLATE, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """``conv_id``, ``n_turns`` and ``rendered`` of each maximal conversation.

    ``template``: what stands before a role, between role and text, and after
    the text.  Rows without conversation id are no conversation; a null role or
    text counts as empty, so conversations that differ in that only are equal;
    turns with one number go by role and text; a null number comes first; other
    columns do not matter; an empty table gives an empty result.
    """
    turns = _turns(conversations, id_col, turn_col, role_col, text_col)
    kept = maximal(conversations, id_col, turn_col, role_col, text_col)
    before, between, after = (F.lit(t) for t in template)
    line: Column = F.concat(before, "role", between, "text", after)
    lines = turns.join(kept, "conv_id").groupBy("conv_id", "n_turns").agg(F.sort_array(F.collect_list(F.struct("place", line.alias("line")))).alias("lines"))
    return lines.select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), F.array_join(F.transform("lines", lambda x: x["line"]), "").alias("rendered"))


ORACLE_SQL = r"""
with t as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as place,
         coalesce(role, '') as role, coalesce(text, '') as text
  from conversations where conv_id is not null),
c as (
  select conv_id, count(*) as n_turns, list({'role': role, 'text': text} order by place) as turns,
         string_agg('<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10), '' order by place) as rendered
  from t group by conv_id),
w as (select n_turns, turns, min(conv_id) as conv_id, min(rendered) as rendered from c group by n_turns, turns),
p as (select distinct list_slice(turns, 1, k) as turns from (select turns, unnest(range(1, n_turns)) as k from w))
select conv_id, n_turns, rendered from w where turns not in (select turns from p)
"""
