"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddspark.llm.common import discard, publish


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the links ``a, b`` (long); the root is the smallest node reachable.

    Each round hangs every node's larger neighbours, then its smaller ones, on the
    smallest it sees. Minima combine before the shuffle, links are never collected,
    and each round is written, so a lost executor costs one round at most. The
    number of rounds grows with the logarithm of the size.
    """
    links = publish(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = _state(links)
    while True:
        around = _both(links)
        least = around.groupBy(F.col("a").alias("_n")).agg(F.least(F.min("b"), F.col("_n")).alias("_m"))
        larger = (
            around.where("b > a").join(least, F.col("a") == F.col("_n")).select(F.col("b").alias("a"), F.col("_m").alias("b"))
        ).distinct()
        least = larger.groupBy(F.col("a").alias("_n")).agg(F.min("b").alias("_m"))
        smaller = larger.join(least, F.col("a") == F.col("_n")).select("a", "b", "_m")
        before, links = links, publish(
            smaller.select(F.explode(F.array(F.struct("a", F.col("_m").alias("b")), F.struct(F.col("b").alias("a"), F.col("_m").alias("b")))).alias("e"))
            .select("e.*")
            .where("a <> b")
            .distinct(),
            "links",
        )
        discard(before)
        now = _state(links)
        if now == state:
            break
        state = now
    roots = links.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
