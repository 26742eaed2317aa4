"""Publishing tables without ever overwriting the path being read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddspark.session import new_table_path


def publish(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write a new version of a table in the shared folder and return it read back.

    A published table is also how lineage is cut: losing an executor afterwards
    costs a read, not a recomputation.
    """
    spark: SparkSession = df.sparkSession
    path = new_table_path(spark, name)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return spark.read.parquet(path)


def publish_scored(scored: DataFrame, name: str = "scored_pairs") -> DataFrame:
    """Stored order: drug, then IC025 descending; ranges of drugs per file so that drug filters prune."""
    ordered = scored.repartitionByRange("drug", "reaction_pt").sortWithinPartitions("drug", F.desc_nulls_last("IC025"), "reaction_pt")
    return publish(ordered, name)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def interaction_json(mentions: DataFrame) -> DataFrame:
    """Nested export form per source drug: one JSON object target -> term, quote."""
    entry = F.struct("target", F.struct("term", "quote"))
    return mentions.groupBy("source").agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(entry)))).alias("mentions"))
