"""Corpus pipeline: documents in, packed training sequences out.

Each stage reads what the one before it wrote and works on all of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddspark.llm import mixing, nearcopies, packing, suffixes, toxicity
from oddspark.llm.common import publish, table, text_of, word_count

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents, with the number of characters as it is now."""
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go; it learns from the labels beside the documents."""
    scored = toxicity.toxicity(docs, table(spark, sf_dir, "labels"), carry=True)
    return scored.where(F.col("predicted") == 0).select("row.*").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays, once if its row repeats.

    Near duplicates share four fifths of their distinct shingles of five words, or are linked by others that do.
    Documents without an id cannot be told apart and stay; texts that share an id are told apart.
    """
    return nearcopies.without_copies(docs.select(*COLUMNS))


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the bytes of passages that stand elsewhere too; documents of which nothing is left go."""
    left = suffixes.remove_repeats(docs.select(*COLUMNS))
    return _documents(left.where((F.col("kept") != "") | (F.col("n_removed") == 0)).withColumn("text", F.col("kept")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: whole copies, and its first words where a source's last round ends.

    Documents that the mix does not take go, those without words among them.
    """
    key = ["doc_id", "source", "size"]
    taken = mixing.mix(docs).groupBy(*(F.col(c).alias(f"_{c}") for c in key)).agg(F.floor(F.avg("taken")).cast("long").alias("_taken"))
    sized = docs.select(*COLUMNS).withColumn("size", word_count(text_of()))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key]
    joined = sized.join(taken, same).where(F.col("_taken") > 0)
    copies = F.floor(F.col("_taken") / F.col("size"))
    rest = F.col("_taken") - copies * F.col("size")
    parts = joined.select(
        *COLUMNS, F.explode(F.concat(F.array_repeat(F.lit(0).cast("long"), copies.cast("int")), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>")))).alias("_words")
    )
    return _documents(parts.withColumn("text", F.when(F.col("_words") == 0, F.col("text")).otherwise(mixing.first_words(F.when(F.col("_words") > 0, F.col("text")), F.col("_words")))))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", remove_repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: A learned classifier and a tokenizer cannot be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = publish(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
