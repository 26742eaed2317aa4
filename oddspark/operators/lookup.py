"""Names to catalogue entries: aliases, exact matches, substrings, strict resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oddspark.functions import text as X
from oddspark.operators.grams import substring_matches
from oddspark.sources.sinks import publish


def alias_dim(catalogue: DataFrame) -> DataFrame:
    """``(alias, drug)`` from a nested catalogue (class, molecules map name -> variants)."""
    molecule = catalogue.select(F.explode("molecules").alias("molecule", "variants"))
    own = molecule.select(F.lower("molecule").alias("alias"), F.col("molecule").alias("drug"))
    variants = molecule.select(F.explode("variants").alias("alias"), F.col("molecule").alias("drug"))
    variants = variants.withColumn("alias", F.lower(F.trim("alias")))
    classes = catalogue.select(F.lower("class").alias("alias"), F.col("class").alias("drug"))
    return classes.unionByName(own).unionByName(variants).where("alias != ''").distinct()


def match_names(queries: DataFrame, names: DataFrame) -> DataFrame:
    """``queries(query, key)`` against ``names(name, key)``: exact if there is one, else every substring hit."""
    exact = queries.join(names, "key").select("query", "key", "name", F.lit(True).alias("exact"))
    rest = queries.join(exact.select("query"), "query", "left_anti").where("key != ''")
    held = substring_matches(rest.select(F.col("key").alias("needle")).distinct(), names.select(F.col("key").alias("word")).distinct())
    partial = rest.join(held, F.col("key") == F.col("needle")).join(names.select("name", F.col("key").alias("word")), "word")
    return exact.unionByName(partial.select("query", "key", "name", F.lit(False).alias("exact")))


def drug_keys(queries: DataFrame, aliases: DataFrame) -> DataFrame:
    """Lower-cased key of each query after brand names are resolved."""
    typed = F.lower(F.trim("query"))
    named = queries.select("query", typed.alias("alias")).join(aliases, "alias", "left")
    return named.groupBy("query").agg(F.lower(F.coalesce(F.min("drug"), F.min("alias"))).alias("key"))


def drug_matches(queries: DataFrame, drugs: DataFrame, aliases: DataFrame) -> DataFrame:
    names = drugs.select(F.col("drug").alias("name"), F.lower("drug").alias("key")).distinct()
    return match_names(drug_keys(queries, aliases), names)


def drug_lookup(scored: DataFrame, queries: DataFrame, aliases: DataFrame) -> DataFrame:
    """All rows of every matching drug, each under its own name, best evidence first."""
    hits = drug_matches(queries, scored.select("drug"), aliases)
    return (
        scored.join(hits.select("query", "exact", F.col("name").alias("drug")), "drug")
        .withColumn("total_reports", F.col("a") + F.col("b"))
        .orderBy("query", F.desc_nulls_last("IC025"), "drug", "reaction_pt")
    )


def reaction_matches(queries: DataFrame, reactions: DataFrame) -> DataFrame:
    keyed = queries.select("query", X.reaction_key(F.col("query")).alias("key"))
    names = reactions.select(F.col("reaction_pt").alias("name"), X.reaction_key(F.col("reaction_pt")).alias("key")).distinct()
    return match_names(keyed, publish(names, "reaction_names"))


def resolve_strict(queries: DataFrame, matches: DataFrame, shown: int | None = None) -> DataFrame:
    """Accept an exact match or a single partial one; otherwise report the candidates."""
    grouped = matches.groupBy("query").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or("exact").alias("exact"), F.min("name").alias("first")
    )
    ranked = matches
    if shown is not None:
        ranked = matches.withColumn("_rn", F.row_number().over(Window.partitionBy("query").orderBy("name"))).where(F.col("_rn") <= shown)
    named = ranked.groupBy("query").agg(F.array_join(F.sort_array(F.collect_list("name")), ", ").alias("candidates"))
    status = (
        F.when(F.col("n").isNull(), "unknown").when(F.col("exact"), "exact").when(F.col("n") == 1, "unique").otherwise("ambiguous")
    )
    out = queries.select("query").distinct().join(grouped, "query", "left").join(named, "query", "left")
    return out.select(
        "query", status.alias("status"), F.coalesce("n", F.lit(0)).alias("matches"),
        F.when(F.col("exact") | (F.col("n") == 1), F.col("first")).alias("resolved"),
        F.when(~F.col("exact") & (F.col("n") > 1), F.col("candidates")).alias("candidates"),
    )


def parse_lists(requests: DataFrame, id_col: str, text_col: str, limit: int) -> DataFrame:
    """Entries of free-text lists: split, de-duplicated ignoring case (first spelling kept), capped.

    ``kept`` is false for entries beyond the cap, so that they can be reported.
    """
    items = requests.select(F.col(id_col).alias("request_id"), F.posexplode(X.split_list(F.col(text_col))).alias("_at", "item"))
    first = items.where("item != ''").groupBy("request_id", F.lower("item").alias("_key")).agg(
        F.min(F.struct("_at", "item")).alias("_first")
    )
    order = Window.partitionBy("request_id").orderBy("_at")
    flat = first.select("request_id", "_first._at", "_first.item")
    return flat.withColumn("pos", F.row_number().over(order)).select(
        "request_id", "pos", "item", (F.col("pos") <= limit).alias("kept")
    )
