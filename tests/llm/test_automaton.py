"""Decontamination against a plain search for every window."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from oddspark.llm import automaton
from tests.llm.data import DOCS, awkward_rows, docs_of, words

ITEMS = "item_id long, text string"
UPPER = {c: c + 32 for c in range(65, 91)}


def cut(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def brute(rows, items, window=10):
    windows = set()
    for item, text in items:
        w = cut(text)
        n = min(window, len(w))
        windows |= {(item, tuple(w[p : p + n])) for p in range(len(w) - n + 1) if n}
    out = []
    for doc, text, *_ in rows:
        w, hit, found = cut(text), set(), set()
        for item, g in windows:
            for p in range(len(w) - len(g) + 1):
                if tuple(w[p : p + len(g)]) == g:
                    hit |= set(range(p, p + len(g)))
                    found |= {item} - {None}
        ids = sorted(map(str, found))
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def found(spark, rows, items, extra=False, **kw):
    df = docs_of(spark, rows, extra)
    tests = spark.createDataFrame(items, ITEMS).withColumn("words", F.lit("x"))
    return sorted((tuple(r) for r in automaton.contamination(df, tests, **kw).collect()), key=repr)


PASSAGE = words(40, 77)
ITEM_ROWS = [
    (1, PASSAGE), (2, words(12, 78) + " " + " ".join(PASSAGE.split()[5:25])), (3, "one two"), (4, None), (5, " .,;"), (6, "Ünïque"), (7, PASSAGE),
    (None, words(30, 5)), (8, "ha ha ha ha ha ha ha ha ha ha ha ha"), (2, words(15, 79)), (10, "a"), (11, "ha ha ha"),
]


@pytest.mark.parametrize("shard_words", [200_000, 60])
def test_against_brute_force(spark, shard_words):
    rows = awkward_rows() + [
        (30, "x " + PASSAGE.upper() + " y", "en", "a", 1), (31, PASSAGE.replace(" ", "--", 7), "en", "a", 1), (32, " ".join(PASSAGE.split()[3:12]), "en", "a", 1),
        (33, " ".join(PASSAGE.split()[3:13]) + " " + " ".join(PASSAGE.split()[20:31]), "en", "a", 1), (34, "see ünïque one TWO ha ha ha, a", "en", "a", 1),
        (35, "ÜNÏQUE", "en", "a", 1), (36, "\x00a\x7fb", "en", "a", 1), (30, "x " + PASSAGE.upper() + " y", "en", "a", 1),
    ]
    assert found(spark, rows, ITEM_ROWS, extra=True, shard_words=shard_words) == brute(rows, ITEM_ROWS)


def test_few_words_many_repeats(spark):
    """Three words in all, so that every state has many ways on and windows overlap."""
    r = random.Random(4)
    rows = [(i, " ".join(r.choice("abc") for _ in range(r.randint(0, 200))), "en", "a", 1) for i in range(60)]
    items = [(i, " ".join(r.choice("abc") for _ in range(r.randint(0, 14)))) for i in range(40)]
    assert found(spark, rows, items, window=6) == brute(rows, items, 6)
    assert found(spark, rows, items, window=1) == brute(rows, items, 1)


def test_pieces_and_blocks_lose_no_window(spark, monkeypatch):
    """Items longer than a piece and texts longer than a block; the code runs in this process."""
    monkeypatch.setattr(automaton, "BLOCK", 50)
    text = words(300, 9)
    assert [w for part in automaton.words_of(text) for w in part] == [w.encode() for w in cut(text)]
    long = words(4100, 12)
    rows = [(1, " ".join(long.split()[a : a + 10]), "en", "a", 1) for a in (0, 1995, 2000, 3995, 4090)] + [(2, words(50, 13), "en", "a", 1)]
    assert found(spark, rows, [(1, long)]) == brute(rows, [(1, long)])


def test_empty_tables(spark):
    assert found(spark, [], ITEM_ROWS) == []
    rows = awkward_rows()
    assert found(spark, rows, []) == brute(rows, [])


def test_longest_runs_by_the_automaton():
    r = random.Random(8)
    for _ in range(100):
        items = [[r.choice([b"x", b"y", b"z"]) for _ in range(r.randint(1, 12))] for _ in range(3)]
        made = automaton.Automaton(3)
        for n, item in enumerate(items):
            made.add(str(n), item, len(item) < 3)
        runs = {tuple(made.vocab[w] for w in item[a:b]) for item in items for a in range(len(item)) for b in range(a + 1, len(item) + 1)}
        assert sum(made.length[s] - made.length[made.link[s]] for s in range(1, len(made.link))) == len(runs)


def test_spans_and_documents_are_removed(spark):
    ten = " ".join(PASSAGE.split()[:10])
    filler = words(40, 91)
    rows = [
        (1, f"Keep, {ten}; {filler}", "en", "a", 1), (2, f"{ten} x", "en", "a", 1), (3, None, None, None, None), (4, filler, "en", "a", 1),
        (5, f"é{filler}  {PASSAGE}.", "en", "a", 1),
    ]
    df = docs_of(spark, rows, extra=True)
    items = spark.createDataFrame(ITEM_ROWS, ITEMS)
    left = automaton.decontaminate(df, items)
    assert left.columns == df.columns
    assert {r["doc_id"]: r["text"] for r in left.collect()} == {1: f"Keep, ; {filler}", 3: None, 4: filler, 5: f"é{filler}  ."}
    assert {r["doc_id"] for r in automaton.decontaminate(df, items, max_span=11, max_coverage=0.3).collect()} == {1, 2, 3, 4}
    assert automaton.decontaminate(spark.createDataFrame([], DOCS), items).count() == 0
