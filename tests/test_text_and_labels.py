import random
import re

import pytest
from pyspark.sql import functions as F

from oddspark import constants as K
from oddspark.functions import display as D
from oddspark.functions import text as X
from oddspark.operators import labels as L
from oddspark.operators import lookup
from oddspark.operators.grams import substring_matches
from oddspark.operators.phrases import leftmost_longest, phrase_matches
from oddspark.plans.serving import V


def test_label_rules(spark):
    labels = spark.createDataFrame(
        [("x", "risk of delayed gastric emptying and renal failure", "renal failure", True), ("y", "", "", False)],
        "drug string, text string, boxed string, found boolean",
    )
    pairs = spark.createDataFrame(
        [("x", "RENAL FAILURE"), ("x", "EMPTYING GASTRIC DELAYED"), ("x", "IMPAIRED GASTRIC EMPTYING"), ("x", "NOS"), ("y", "RASH"), ("z", "RASH")],
        "drug string, reaction_pt string",
    )
    got = {(r["drug"], r["reaction_pt"]): (r["label_found"], r["labelled"], r["boxed_warning"]) for r in L.attach_expectedness(pairs, labels).collect()}
    assert got["x", "RENAL FAILURE"] == (True, True, True)
    assert got["x", "EMPTYING GASTRIC DELAYED"] == (True, True, False)
    assert got["x", "IMPAIRED GASTRIC EMPTYING"] == (True, False, False)
    assert got["x", "NOS"] == (True, False, False)
    assert got["y", "RASH"] == (False, None, None) and got["z", "RASH"] == (False, None, None)


def test_phrases_equal_one_alternation_scan(spark):
    rng = random.Random(7)
    terms = ["insulin glargine", "insulin", "aspirin", "beta blocker", "blocker", "things", "thing"]
    words = ["insulin", "glargine", "Aspirins", "beta", "Blockers", "thing", "things", "and", "re-aspirin", "insulinx", "_thing"]
    seps = [" ", " ", " ", "-", ", ", ". "]
    texts = ["".join(w + rng.choice(seps) for w in rng.choices(words, k=25)) for _ in range(40)]
    pattern = re.compile(r"\b(" + "|".join(re.escape(t) for t in sorted(terms, key=len, reverse=True)) + r")s?\b", re.I)
    want = sorted((i, m.group(1).lower(), m.group(1)) for i, t in enumerate(texts) for m in pattern.finditer(t))
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    dictionary = spark.createDataFrame([(t,) for t in terms], "term string")
    hits = leftmost_longest(phrase_matches(rows, "text", dictionary, plural=True), "id")
    assert sorted((r["id"], r["term"], r["found"]) for r in hits.collect()) == want


def test_overlap_scan_of_one_long_piece(spark):
    """A megabyte without a full stop, every hit overlapping the next one, beside a second text under a null key."""
    n = 130_000
    rows = spark.createDataFrame([(1, "alpha beta " * (n // 2)), (None, "beta alpha beta gamma beta"), (3, "")], "id int, text string")
    dictionary = spark.createDataFrame([("alpha beta",), ("beta alpha",), ("beta",), ("beta gamma beta",)], "term string")
    hits = leftmost_longest(phrase_matches(rows, "text", dictionary), "id").groupBy("id", "term").count().collect()
    assert {(r["id"], r["term"]): r["count"] for r in hits} == {(1, "alpha beta"): n // 2, (None, "beta alpha"): 1, (None, "beta gamma beta"): 1}


def test_mentions_through_words_with_accents(spark):
    texts = spark.createDataFrame([("a", 1, "Après la Forêt, étés"), ("b", 1, None)], "drug string, doc_id long, text string")
    entries = spark.createDataFrame([("fr", ["forêt"], None), ("fr", ["après"], None), ("x", ["étéss"], None)], "drug string, variants array<string>, epc string")
    assert [tuple(r) for r in L.mentions(texts, L.term_index(entries)).collect()] == [("a", "fr", "Après", "Après la Forêt, étés")]


def test_mentions_quote_the_sentence(spark):
    texts = spark.createDataFrame([("a", 1, "Starts here with betadrug use. Avoid gammadrugs and class inhibitors. End"), ("a", 2, "betadrug again"), ("betadrug", 1, "betadrug alone")],
        "drug string, doc_id long, text string",
    )
    entries = spark.createDataFrame(
        [("betadrug", ["betadrug"], None), ("gammadrug", ["gammadrug", "gam"], "Class Inhibitor [EPC]")], "drug string, variants array<string>, epc string"
    )
    got = {(r["source"], r["target"]): (r["term"], r["quote"]) for r in L.mentions(texts, L.term_index(entries)).collect()}
    assert got == {
        ("a", "betadrug"): ("betadrug", "Starts here with betadrug use."),
        ("a", "gammadrug"): ("class inhibitor", "Avoid gammadrugs and class inhibitors."),
    }


def test_long_quotes_are_clipped(spark):
    text = "word " * 200
    row = spark.createDataFrame([(text,)], "t string").select(X.clip(F.col("t")).alias("q")).first()["q"]
    assert len(row) <= K.QUOTE_LIMIT and row.endswith("...")


def test_text_functions(spark):
    row = spark.createDataFrame([("a<b>B</b>\n c", "FOURNIER^S", "x?api_key=abc&y", "ok name", "a..b")], "h string, p string, u string, s string, t string").select(
        X.flatten_sections(F.array("h")).alias("flat"), X.norm(F.lit("A--B  c")).alias("norm"), X.display_term(F.col("p")).alias("shown"),
        X.reaction_key(F.lit(" fournier's ")).alias("key"), X.redact(F.col("u")).alias("red"), X.is_safe_query(F.col("s")).alias("ok"),
        X.is_safe_query(F.col("t")).alias("bad"), X.is_safe_query(F.lit("x" * 65)).alias("long"), X.split_list(F.lit("a, b;c\n 1d1 ")).alias("parts"),
    ).first()
    assert row["flat"] == "a B c" and row["norm"] == "a b  c" and row["shown"] == "FOURNIER'S" and row["key"] == "FOURNIERS"
    assert row["red"] == "x?api_key=[hidden]&y" and row["ok"] and not row["bad"] and not row["long"]
    assert row["parts"] == ["a", "b", "c", "1d1"]


def test_display_strings(spark):
    row = spark.range(1).select(
        D.ror_text(F.lit(12.958), F.lit(12.65), F.lit(13.27)).alias("r"), D.comparator_note(F.lit(2.0), F.lit(0.1), F.lit(0.95)).alias("n"),
        D.flag_labels(F.lit(True), F.lit(None).cast("boolean"), F.lit(0.1), F.lit(0.95)).alias("f"),
    ).first()
    assert row["r"] == "12.96 [12.65-13.27]" and row["n"] == "2.0 -> 0.1 among peers (95% less)"
    assert row["f"] == ["burst of reports", "vanishes beside peers"]


def test_strict_resolution(spark):
    drugs = spark.createDataFrame([("atorvastatin",), ("simvastatin",), ("aspirin",)], "drug string")
    aliases = spark.createDataFrame([("lipitor", "atorvastatin")], "alias string, drug string")
    typed = spark.createDataFrame([("Lipitor",), ("statin",), ("aspi",), ("none",), ("a.*n",)], "query string")
    got = {r["query"]: (r["status"], r["resolved"]) for r in lookup.resolve_strict(typed, lookup.drug_matches(typed, drugs, aliases)).collect()}
    assert got == {
        "Lipitor": ("exact", "atorvastatin"), "statin": ("ambiguous", None), "aspi": ("unique", "aspirin"), "none": ("unknown", None), "a.*n": ("unknown", None)
    }


def test_same_drug_cannot_be_compared(spark):
    import pytest

    with pytest.raises(ValueError):
        V.compare_two(spark.range(1), "x", "x")


def test_label_index_against_every_pair_and_document(spark):
    """Words, parts of words, phrases over several words, accents that leave blanks, short terms; each against each document."""
    r = random.Random(2)
    syllables = ["ra", "ment", "or", "t", "de", "pain", "in", "é", "head", "ache", "s", "x"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 3)))
    body = lambda n: " ".join(word() for _ in range(n))
    labels = [(f"d{i % 4}", body(r.randint(0, 25)), body(r.randint(0, 3)), i % 5 != 0) for i in range(24)] + [("d9", "", "", False), ("d8", "a b", "", True)]
    terms = sorted({body(r.randint(1, 3)).upper() for _ in range(150)} | {"É", "T", "ÉT", "PAIN IN", "IN THE", "A B", " ", "-", "DE É RA"})
    docs = spark.createDataFrame(labels, "drug string, text string, boxed string, found boolean").withColumns({c: X.norm(F.col(c)) for c in ("text", "boxed")})
    pairs = spark.createDataFrame([(f"d{d}", t, i) for d in (0, 1, 2, 3, 8, 9, 7) for i, t in enumerate(terms)], "drug string, reaction_pt string, a int")
    hit, boxed = X.label_hits(F.col("reaction_pt"), F.col("text"), F.col("boxed"))
    found = F.coalesce("found", F.lit(False))
    want = pairs.join(docs, "drug", "left").groupBy(*pairs.columns).agg(
        F.bool_or(found).alias("label_found"), F.bool_or(F.when(found, hit)).alias("labelled"), F.bool_or(F.when(found, boxed)).alias("boxed_warning")
    )
    got = L.attach_expectedness(pairs, docs)
    assert got.columns == want.columns
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(got) == rows(want)
    assert {r.labelled for r in got.collect()} == {True, False, None} and got.where("boxed_warning").count() > 20


@pytest.mark.parametrize("n", [0, 300])
def test_substring_matches_are_those_of_all_pairs(spark, n):
    r = random.Random(n)
    text = lambda size: "".join(r.choice("abé \n😀") for _ in range(size))
    words, needles = {text(r.randint(0, 9)) for _ in range(n)}, {text(r.randint(0, 5)) for _ in range(n // 4)}
    got = substring_matches(spark.createDataFrame([(x,) for x in needles], "needle string"), spark.createDataFrame([(x,) for x in words], "word string"))
    assert {(x.needle, x.word) for x in got.collect()} == {(a, b) for a in needles if a for b in words if a in b}


def test_label_look_up_reads_few_documents(spark, monkeypatch):
    """Boxed sections that are part of their texts, as they are in harm_text; each pair against each document, and how many of them are read."""
    r = random.Random(4)
    syllables = ["ra", "ment", "tion", "t", "de", "pain", "in", "é", "head", "with", "s", "x"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 3)))
    body = lambda n: " ".join(word() for _ in range(n))
    texts = [(f"d{i % 2}", body(r.randint(0, 2)), body(r.randint(0, 40))) for i in range(150)]
    docs = spark.createDataFrame([(d, f"{b} {t}", b, True) for d, b, t in texts], "drug string, text string, boxed string, found boolean")
    docs = docs.withColumns({c: X.norm(F.col(c)) for c in ("text", "boxed")})
    terms = sorted({body(r.randint(1, 3)).upper() for _ in range(150)} | {"É", "ÉT", "IN DE", "T IN S", "WITH É", "IN WITH É", "X" * 30})
    pairs = spark.createDataFrame([(f"d{d}", t) for d in (0, 1) for t in terms], "drug string, reaction_pt string")
    hit, boxed = X.label_hits(F.col("reaction_pt"), F.col("text"), F.col("boxed"))
    want = pairs.join(docs, "drug").groupBy("drug", "reaction_pt").agg(F.lit(True).alias("label_found"), F.bool_or(hit).alias("labelled"), F.bool_or(boxed).alias("boxed_warning"))
    plain, read = X.label_hits, spark.sparkContext.accumulator(0)

    def counted(term, text, box):
        def look(t):
            read.add(1)
            return True

        labelled, in_box = plain(term, text, box)
        return labelled & F.udf(look, "boolean")(text), in_box

    monkeypatch.setattr(L.X, "label_hits", counted)
    got = L.attach_expectedness(pairs, docs)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(got) == rows(want)
    assert got.where("labelled").count() > 100 and got.where("boxed_warning").count() > 50
    assert read.value < pairs.join(docs, "drug").count() / 10
