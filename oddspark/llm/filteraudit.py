"""Audit of how filters act together: what each removes, alone, after others, and on average over all orders.

Four filters look at one text. The fifth marks a text that a smaller id holds too: an
existential self-join on hash, exact text and smaller id. Ids of all failures are
united, each document becomes a combination of bits, and everything else is a sum over
the combinations of a part.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddspark.llm.common import WORD, in_sketch, publish, sketch_of, text_of

LETTERS = "ABCDE"
BIT = {letter: 1 << i for i, letter in enumerate(LETTERS)}
#: A hash with more than one row in so many is hot; there are at most as many hot ones.
HOT = 1024
KEY = ["doc_id", "part", "h", "check"]


def own_failures(text: Column, min_words: int = 100, distinct: int = 80, capitals: int = 10, marks: str = r"[#$%&*|]") -> Column:
    """Bits A to D of a text: few words, few distinct words (percent), many capitals (percent), a mark in it."""
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    n, different = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    upper = F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    failed = {
        "A": n < min_words,
        "B": different * 100 < n * distinct,
        "C": upper * 100 > F.length(text).cast("long") * capitals,
        "D": text.rlike(marks),
    }
    total = F.lit(0)
    for letter, flag in failed.items():
        total = total + F.when(flag, F.lit(BIT[letter])).otherwise(F.lit(0))
    return total


def later_copies(rows: DataFrame, hashes: DataFrame) -> DataFrame:
    """Of ``doc_id, part, h, check, text`` the rows whose text a smaller id holds too; texts are compared whole.

    Only rows whose hash repeats leave their task, found by a sketch of fixed size (a
    row more does no harm). Copies combine to the least id of a text before the
    shuffle. Rows of a hot hash are dealt over many tasks, each of which gets the least
    id of that text.
    """
    counted = publish(hashes.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most"), "repeated")
    total = hashes.count()
    suspects = in_sketch(rows, sketch_of(counted))
    hot = counted.where(F.col("n") * HOT > total).select("h", F.ceil(F.col("n") * HOT / F.lit(max(1, total))).cast("int").alias("_parts"))
    spread = F.broadcast(hot)  # at most HOT rows of two numbers
    first = suspects.groupBy("h", "text").agg(F.min("doc_id").alias("_first"))
    first = first.join(spread, "h", "left").select(
        "h", "text", "_first", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1)).alias("_deal")
    )
    dealt = suspects.join(spread, "h", "left").withColumn("_deal", F.pmod(F.xxhash64("doc_id"), F.coalesce(F.col("_parts"), F.lit(1))).cast("int"))
    a, b = dealt.alias("a"), first.alias("b")
    same = (F.col("a.h") == F.col("b.h")) & (F.col("a._deal") == F.col("b._deal")) & (F.col("a.text") == F.col("b.text"))
    return a.join(b, same & (F.col("b._first") < F.col("a.doc_id")), "left_semi").select(*KEY)


def effects(spark) -> DataFrame:
    """For each combination of failures, order and step: what the step does to such a document (19,200 rows)."""
    steps = [
        ("".join(order), i + 1, letter, BIT[letter], sum(BIT[b] for b in order[:i]))
        for order in permutations(LETTERS)
        for i, letter in enumerate(order)
    ]
    table = spark.createDataFrame(steps, "filter_order string, step int, letter string, bit int, before int")
    masks = F.explode(F.sequence(F.lit(0), F.lit(2 ** len(LETTERS) - 1)))
    fails, gone = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    return table.withColumn("mask", masks).select(
        "filter_order", "step", "letter", "mask", (~fails & ~gone).alias("_kept"), (fails & ~gone).alias("_removed"),
        (fails & gone).alias("_redundant"), (F.col("mask") == F.col("bit")).alias("_unique"),
    )


def combinations(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n, good, toxic``: documents of each part by their failures, and how many of them are labelled."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text_of().alias("text")
    ).withColumns({"h": F.xxhash64("text"), "check": F.xxhash64(F.lit(1), "text")})
    narrow = publish(rows.withColumn("mask", own_failures(F.col("text"))).drop("text"), "failures")
    copies = later_copies(rows, narrow.select("doc_id", "h"))
    failures = narrow.withColumn("n", F.lit(1)).unionByName(copies.withColumns({"mask": F.lit(BIT["E"]), "n": F.lit(0)}))
    flagged = publish(failures.groupBy(*KEY).agg(F.bit_or("mask").alias("mask"), F.sum("n").alias("n")), "flagged")
    marked = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.coalesce(F.max((F.col("quality") == 1).cast("long")), F.lit(0)).alias("good"), F.coalesce(F.max((F.col("toxic") == 1).cast("long")), F.lit(0)).alias("toxic")
    )
    unnamed = flagged.where(F.col("doc_id").isNull()).withColumns({"good": F.lit(0), "toxic": F.lit(0)})
    named = flagged.where(F.col("doc_id").isNotNull()).join(marked, "doc_id", "left")
    return named.unionByName(unnamed).groupBy("part", "mask").agg(
        F.sum("n").alias("n"), *(F.coalesce(F.sum(F.col("n") * F.col(c)), F.lit(0)).alias(c) for c in ("good", "toxic"))
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a part, order of the filters and step, as counts of documents.

    Null texts are empty, null languages the part with the empty name. Rows count each;
    a text is a copy if a row with a smaller id has it, so rows with equal ids, and rows
    without id, are no copies of each other. Several labels of an id: one that says 1
    counts. No documents: no rows.
    """
    done = combinations(docs, labels).join(F.broadcast(effects(docs.sparkSession)), "mask")

    def total(flag: str, count: str) -> Column:
        return F.sum(F.when(F.col(flag), F.col(count)).otherwise(F.lit(0))).cast("long")

    steps = done.groupBy("part", "filter_order", "step", "letter").agg(
        total("_kept", "n").alias("kept"), total("_removed", "n").alias("removed"), total("_redundant", "n").alias("redundant"),
        total("_unique", "n").alias("unique_fails"), total("_removed", "good").alias("good_lost"), total("_removed", "toxic").alias("toxic_lost"),
    )
    return steps.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "letter"))).drop("letter")


CHECK_SQL = r"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
  w AS (SELECT doc_id, part, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM d),
  f AS MATERIALIZED (SELECT doc_id, part,
    (len(words) < 100)::INT + 2 * (100 * len(list_distinct(words)) < 80 * len(words))::INT
    + 4 * (100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 10 * length(text))::INT
    + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(least < doc_id, false)::INT AS mask FROM w),
  l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
  c AS MATERIALIZED (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
    FROM f LEFT JOIN l ON f.doc_id = l.doc_id GROUP BY part, mask),
  x(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
  o AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
    FROM x a, x b, x c, x d, x e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
  s AS MATERIALIZED (SELECT filter_order, step::INT AS step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before
    FROM o, range(1, 6) r(step)),
  t AS (SELECT part, filter_order, step, bit,
    sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
    FROM c, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM t"""
