"""Mixing sources to target weights with a low-discrepancy schedule.

Every source's documents are shuffled and laid end to end as one stream of words,
cut into equal blocks. Slots of the mix are van der Corput points: point ``k`` of
``2**p`` equally spaced ones is visited at the time whose bits are those of ``k``
reversed. The cumulative slot counts of the sources cut the points into intervals,
so each source gets its exact number of slots, spread evenly over the schedule.
The slots of a source are ranked in time, and rank ``r`` takes block ``r`` of the
source (modulo its number of blocks: the stream is read again from its start).
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddspark.llm.common import WORD, publish, text_of, word_count

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
#: Words of a block; smaller in small sources, which get at least so many blocks.
BLOCK_WORDS = 256
LEAST_BLOCKS = 64
#: Documents per part of a stream, slots per part of the schedule: what one window sorts.
PART_DOCS = 4096
PART_SLOTS = 65536


def sizes(docs: DataFrame) -> DataFrame:
    """``source, doc_id, size, copies``: equal rows are counted, not kept apart."""
    return (
        docs.select(F.col("source").cast("string").alias("source"), F.col("doc_id").cast("long").alias("doc_id"), word_count(text_of()).alias("size"))
        .groupBy("source", "doc_id", "size")
        .agg(F.count(F.lit(1)).alias("copies"))
    )


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``source, source_size, target`` and the block layout; one row per source.

    Sources in code point order, null last, take the weights in turn. A target above
    ``most`` times its source stops there and the others share the rest by weight:
    with sources ordered by limit over weight, those that stop come first. The
    windows run over one row per source.
    """
    per = sized.groupBy("source").agg(
        F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.sum("copies").alias("source_docs")
    )
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1
    per = per.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), turn.cast("int")))
    per = per.withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    whole = Window.partitionBy()
    order = Window.orderBy(F.col("_cap") / F.col("_w"), F.asc_nulls_last("source"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onwards = order.rowsBetween(0, Window.unboundedFollowing)
    wanted = F.sum("source_size").over(whole) * F.lit(float(share))
    per = per.withColumn("_all", F.least(wanted, F.sum("_cap").over(whole)))
    level = (F.col("_all") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(onwards)
    per = per.withColumn("_stops", F.col("_cap") / F.col("_w") <= level)
    taken = F.sum(F.when(F.col("_stops"), F.col("_cap")).otherwise(0.0)).over(whole)
    open_w = F.sum(F.when(F.col("_stops"), 0.0).otherwise(F.col("_w"))).over(whole)
    target = F.when(F.col("_stops"), F.col("_cap")).otherwise((F.col("_all") - taken) / open_w * F.col("_w"))
    size = F.col("source_size")
    return (
        per.withColumn("target", target)
        .withColumn("block", F.greatest(F.lit(1).cast("long"), F.least(F.lit(BLOCK_WORDS).cast("long"), (size / LEAST_BLOCKS).cast("long"))))
        .withColumn("blocks", F.ceil(size / F.col("block")).cast("long"))
        .withColumn("_rounds", F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0).cast("long"))
        .withColumn("_rest", F.round((F.col("target") - F.col("_rounds") * size) / F.col("block")).cast("long"))
        .withColumn("slots", F.least(F.col("_rounds") * F.col("blocks") + F.col("_rest"), F.lit(int(most)) * F.col("blocks")))
        .select("source", "source_size", "source_docs", "target", "block", "blocks", "slots")
    )


def _reversed_bits(point: Column, bits: Column) -> Column:
    """The last ``bits`` bits of a long in reverse order."""
    text = F.lpad(F.bin(point), bits, F.lit("0"))
    return F.conv(F.reverse(text), 2, 10).cast("long")


def schedule(per_source: DataFrame) -> DataFrame:
    """``slot, source, round, block_no``: the mix in order of ``slot``.

    Slots are made in parts, so that a source with most of them is still spread
    over tasks, and ranked within (source, part of the time), with the counts of
    earlier parts added.
    """
    order = Window.orderBy(F.asc_nulls_last("source"))
    spans = per_source.withColumn("_from", F.sum("slots").over(order) - F.col("slots")).withColumn(
        "_bits", F.greatest(F.lit(1), F.length(F.bin(F.sum("slots").over(Window.partitionBy()))))
    )
    parts = (
        spans.where("slots > 0")
        .select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / PART_SLOTS))).alias("_part"))
        .repartition(int(per_source.sparkSession.conf.get("spark.sql.shuffle.partitions")), "source", "_part")
    )
    low = F.col("_part") * PART_SLOTS
    high = F.least(low + PART_SLOTS, F.col("slots")) - 1
    points = parts.select("source", "blocks", "_bits", F.explode(F.sequence(F.col("_from") + low, F.col("_from") + high)).alias("_point"))
    slots = points.select("source", "blocks", _reversed_bits(F.col("_point"), F.col("_bits")).alias("slot")).withColumn(
        "_when", F.floor(F.col("slot") / PART_SLOTS)
    )
    per_part = slots.groupBy("source", "_when").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("source").orderBy("_when").rowsBetween(Window.unboundedPreceding, -1)
    per_part = per_part.select(
        F.col("source").alias("_s"), F.col("_when").alias("_at"), F.coalesce(F.sum("_n").over(earlier), F.lit(0).cast("long")).alias("_before")
    )
    own = Window.partitionBy("source", "_when").orderBy("slot")
    ranked = (
        slots.withColumn("_own", F.row_number().over(own) - 1)
        .join(per_part, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_when") == F.col("_at")))
        .withColumn("_rank", F.col("_before") + F.col("_own"))
    )
    return ranked.select(
        "slot", "source", F.floor(F.col("_rank") / F.col("blocks")).alias("round"), F.pmod("_rank", "blocks").alias("block_no")
    )


def streams(sized: DataFrame, per_source: DataFrame, seed: int = 29) -> DataFrame:
    """Place of each document in its source's shuffled stream: adds ``at``, its first word.

    Documents are drawn into parts, parts follow each other, and each part is
    ordered by a hash: running sums run within parts only.
    """
    layout = per_source.select(F.col("source").alias("_s"), "source_docs", "source_size", "target", "block", "blocks")
    drawn = sized.join(layout, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    parts = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("source_docs") / PART_DOCS).cast("long"))
    drawn = drawn.withColumn("_draw", F.xxhash64("doc_id", "size", F.lit(seed))).withColumn("_part", F.pmod(F.xxhash64("_draw"), parts))
    sums = drawn.groupBy("source", "_part").agg(F.sum(F.col("size") * F.col("copies")).alias("_n"))
    earlier = Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        F.col("source").alias("_s"), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(earlier), F.lit(0).cast("long")).alias("_before")
    )
    own = Window.partitionBy("source", "_part").orderBy("_draw", F.asc_nulls_last("doc_id"), "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = drawn.withColumn("_own", F.coalesce(F.sum(F.col("size") * F.col("copies")).over(own), F.lit(0).cast("long"))).join(
        sums, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_part") == F.col("_p"))
    )
    return placed.select(
        "source", "doc_id", "size", "copies", "source_size", "target", "block", "blocks", (F.col("_before") + F.col("_own")).alias("at")
    )


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` of every document.

    ``taken`` counts the words of the document that lie in the blocks of its
    source's slots, once for each slot. No block is taken more than ``most`` times.
    Null texts have size 0 and are never taken. Equal rows are parts of one run of
    the stream and each gets its own row. Rank of the source: see ``targets``.
    """
    sized = publish(sizes(docs), "sizes")
    per_source = publish(targets(sized, weights, share, most), "targets")
    uses = schedule(per_source).groupBy(F.col("source").alias("_s"), F.col("block_no").alias("_b")).agg(F.count(F.lit(1)).alias("_uses"))
    placed = streams(sized, per_source).select(
        "*", F.posexplode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_copy", "_n")
    )
    placed = placed.withColumn("at", F.col("at") + F.col("_copy") * F.col("size")).drop("_n", "copies")
    first, last = F.floor(F.col("at") / F.col("block")), F.floor((F.col("at") + F.col("size") - 1) / F.col("block"))
    key = ["source", "doc_id", "_copy", "size", "source_size", "target"]
    parts = placed.where("size > 0").select(*key, "at", "block", F.explode(F.sequence(first, last)).alias("_block"))
    low = F.greatest(F.col("at"), F.col("_block") * F.col("block"))
    high = F.least(F.col("at") + F.col("size"), (F.col("_block") + 1) * F.col("block"))
    taken = (
        parts.withColumn("_words", high - low)
        .join(uses, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_block") == F.col("_b")), "left")
        .groupBy(*key)
        .agg(F.sum(F.col("_words") * F.coalesce("_uses", F.lit(0).cast("long"))).alias("taken"))
    )
    none = placed.where("size = 0").select(*key, F.lit(0).cast("long").alias("taken"))
    return taken.unionByName(none).select("doc_id", "source", "size", "source_size", "target", "taken")


def first_words(text: Column, words: Column) -> Column:
    """The text up to the end of its ``words``-th word; null stays null."""

    @F.pandas_udf("string")
    def head(texts: pd.Series, counts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else _head(t, int(n)) for t, n in zip(texts, counts)], dtype=object)

    return head(text, words)


def _head(text: str, words: int) -> str:
    end = 0
    for _, found in zip(range(words), re.finditer(WORD, text)):
        end = found.end()
    return text[:end]
