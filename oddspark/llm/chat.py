"""Chat formatting: logged snapshots collapse to the conversations they grew into.

A rolling hash of a conversation's turns names every prefix of it. A conversation
whose whole is a proper prefix of another was a snapshot of it and goes by an
anti-join on (turns, hash); equal ones are kept once, under the smallest id. What is
left is rendered turn by turn.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Marks around a turn.
OPEN, CLOSE = "<|{role}|>\n", "<|end|>\n"


def turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, at, shown, p1, p2``: numbered turns as they are rendered, with the hash of the turns up to each.

    Turns are ordered by number, then role, then text. A prefix hash is the exclusive
    or of the hashes of (position, turn), twice 64 bits, so it rolls along a window.
    A null role is ``unknown``, a null text empty; a null id is one conversation.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("unknown")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    before, after = OPEN.split("{role}")
    rows = conversations.select(
        "conv_id", "turn", role.alias("role"), text.alias("text"),
        F.concat(F.lit(before), role, F.lit(after), text, F.lit(CLOSE)).alias("shown"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("at", F.row_number().over(order).cast("long"))
    return rows.select(
        "conv_id", "at", "shown",
        F.bit_xor(F.xxhash64("at", "role", "text")).over(upto).alias("p1"),
        F.bit_xor(F.xxhash64(F.lit(1), "text", "role", "at")).over(upto).alias("p2"),
    )


def maximal(rolled: DataFrame) -> DataFrame:
    """``conv_id, n_turns, copies``: conversations that are no proper prefix of another, one of each."""
    whole = rolled.groupBy("conv_id").agg(
        F.max("at").alias("n_turns"), F.max_by("p1", "at").alias("p1"), F.max_by("p2", "at").alias("p2")
    )
    distinct = whole.groupBy("n_turns", "p1", "p2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies"))
    # prefixes combine before the shuffle, so a first turn that a third of all logs share is one row a task
    last = Window.partitionBy("conv_id").orderBy("at")
    proper = rolled.withColumn("_next", F.lead("at").over(last)).where(F.col("_next").isNotNull())
    proper = proper.select(F.col("at").alias("n_turns"), "p1", "p2").distinct()
    return distinct.join(proper, ["n_turns", "p1", "p2"], "left_anti").select("conv_id", "n_turns", "copies")


def collapse(conversations: DataFrame) -> DataFrame:
    """``conv_id, n_turns, copies, rendered`` of each maximal conversation; an empty table gives none."""
    rolled = turns(conversations)
    kept = maximal(rolled).select(F.col("conv_id").alias("_c"), "n_turns", "copies")
    shown = F.transform(F.array_sort(F.collect_list(F.struct("at", "shown"))), lambda t: t["shown"])
    return (
        rolled.join(kept, F.col("conv_id").eqNullSafe(F.col("_c")))
        .groupBy("conv_id", "n_turns", "copies")
        .agg(F.array_join(shown, "").alias("rendered"))
    )


CHECK_SQL = """
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(role, 'unknown'), coalesce(text, '')) AS pos,
         '<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS shown
  FROM conversations
), p AS (
  SELECT conv_id, pos, string_agg(shown, '') OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS upto,
         count(*) OVER (PARTITION BY conv_id) AS n
  FROM t
)
SELECT min(conv_id) AS conv_id, n AS n_turns, count(*) AS copies, upto AS rendered
FROM p c
WHERE pos = n AND NOT EXISTS (SELECT 1 FROM p WHERE p.pos < p.n AND p.pos = c.n AND p.upto = c.upto)
GROUP BY n, upto
"""
