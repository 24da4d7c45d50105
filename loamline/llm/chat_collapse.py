"""Chat formatting with cumulative-snapshot collapse.

Chat services often log a conversation again after every turn, so a log holds its
prefixes. Each turn gets a rolling hash of all turns up to it; a conversation whose
last hash is the hash of an inner turn of a longer one is a snapshot of it and is
dropped by an anti-join. Of equal conversations the least conv_id stays. Only what
is left is rendered. All steps are DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamline.llm.common import staged

BEGIN, END = "<|im_start|>", "<|im_end|>\n"


def _turn_hash(seed: int) -> Column:
    """Of the turn's place and content; place and content are both in the hash, so sums over a prefix name it."""
    return F.xxhash64(F.lit(seed), F.col("at"), F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text")).cast("decimal(38,0)")


def rolling_hashes(conversations: DataFrame) -> DataFrame:
    """conv_id, at (1-based place), role, text, h (rolling hash of the turns up to it), n (turns).

    Turns are ordered by turn (nulls last), then role and text; equal rows stay separate turns.
    """
    turns = conversations.select("conv_id", "turn", "role", "text")
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_last(), F.col("text").asc_nulls_last())
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turns = turns.withColumn("at", F.row_number().over(order)).withColumn("h1", _turn_hash(1)).withColumn("h2", _turn_hash(2))
    return turns.select("conv_id", "at", "role", "text", F.concat_ws(":", F.sum("h1").over(upto).cast("string"), F.sum("h2").over(upto).cast("string")).alias("h"))


def render(turns: Column) -> Column:
    """ChatML of an array of (at, role, text) in order."""
    one = lambda t: F.concat(F.lit(BEGIN), F.coalesce(t["role"], F.lit("")), F.lit("\n"), F.coalesce(t["text"], F.lit("")), F.lit(END))
    return F.array_join(F.transform(F.array_sort(turns), one), "")


def maximal_chats(conversations: DataFrame) -> DataFrame:
    """The maximal conversations, rendered.

    ``conversations`` needs conv_id, turn, role and text; other columns are ignored.
    Returns conv_id, n_turns, n_copies (equal conversations, itself included) and
    chat (ChatML). A conversation that is a proper prefix of another is left out.
    Null roles and texts render as empty; a null conv_id is one conversation of its
    own and loses to equal ones that have an id. Equal conversations are one with
    n_copies; texts are read whole. A conversation is put in order by one task. An
    empty table gives no rows.
    """
    turns = staged(rolling_hashes(conversations), "turns")
    whole = turns.groupBy("conv_id").agg(F.max("at").alias("n_turns"), F.max_by("h", "at").alias("h"))
    kept = whole.groupBy("n_turns", "h").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    # hashes of inner turns only: a conversation's own last turn is no proper prefix
    last = whole.select(F.col("conv_id").alias("c"), "n_turns")
    inner = turns.select("conv_id", "at", "h").join(last, turns["conv_id"].eqNullSafe(last["c"])).filter("at < n_turns").select(F.col("at").alias("n_turns"), "h").distinct()
    kept = kept.join(inner, ["n_turns", "h"], "left_anti").select(F.col("conv_id").alias("c"), "n_turns", "n_copies")
    chosen = turns.select("conv_id", "at", "role", "text").join(kept, turns["conv_id"].eqNullSafe(kept["c"]))
    out = chosen.groupBy("conv_id").agg(F.first("n_turns").cast("long").alias("n_turns"), F.first("n_copies").alias("n_copies"), F.collect_list(F.struct("at", "role", "text")).alias("turns"))
    return out.select("conv_id", "n_turns", "n_copies", render(F.col("turns")).alias("chat"))
