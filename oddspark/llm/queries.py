"""Registered queries of the operators and, where SQL can express them, their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from oddspark.llm import automaton, chat, covertree, filteraudit, fingerprints, mixing, packing, quality, simhash, simplex, suffixes, tokenscan, toxicity
from oddspark.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``f(spark, sf_dir)`` under ``name``."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


@query("op3_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query("op5_simhash")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op6_mixing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


@query("op4_toxicity")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_quality")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op7_suffixes")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffixes.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query("op10_fingerprints")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.chained(table(spark, sf_dir, "documents"))


@query("op1_covertree")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.nearest(table(spark, sf_dir, "embeddings"))


@query("op2_tokencounts")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenscan.token_counts(table(spark, sf_dir, "documents"))


@query("op9_chat", chat.CHECK_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapse(table(spark, sf_dir, "conversations"))


@query("op11_nsimplex", simplex.check_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simplex.cluster(table(spark, sf_dir, "embeddings"))


@query("op12_filteraudit", filteraudit.CHECK_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op13_decontamination", automaton.check_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return automaton.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
