"""The audit against a plain recount of all orders."""

import re
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from oddspark.llm import common, filteraudit
from tests.llm.data import DOCS, awkward_rows, docs_of, labels_of, words


def brute(rows, labels):
    least = {}
    for i, text, *_ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    good, toxic = ({i for i, *v in labels if i is not None and v[n] == 1} for n in (0, 1))
    docs = []
    for i, text, lang, *_ in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        failed = {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and t in least and least[t] < i,
        }
        docs.append((lang or "", {x for x in failed if failed[x]}, i in good, i in toxic))
    out = {}
    shapley = Counter()
    for part in {d[0] for d in docs}:
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                before = set(order[: step - 1])
                own = [d for d in docs if d[0] == part]
                here = [d for d in own if f in d[1] and not d[1] & before]
                shapley[part, f] += len(here)
                out[part, "".join(order), step] = [
                    sum(not d[1] & (before | {f}) for d in own), len(here), sum(f in d[1] and bool(d[1] & before) for d in own),
                    sum(d[1] == {f} for d in own), sum(d[2] for d in here), sum(d[3] for d in here), f,
                ]
    return {k: (*v[:-1], shapley[k[0], v[-1]]) for k, v in out.items()}


LABELS = [(1, 1, 0), (5, 1, 0), (6, 0, 0), (17, 1, 1), (None, 1, 1), (9, None, None), (10, 1, 0), (10, 1, 1), (20, 1, 1)]


def found(df):
    cols = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in cols) for r in df.collect()}


@pytest.mark.parametrize("extra", [False, True])
def test_audit(spark, extra):
    rows = awkward_rows() + [
        (19, "SHOUT # " * 120, "en", "a", 1), (20, words(120, 4), "", "a", 1), (20, words(80, 4), "en", "a", 1), (21, "ÀÉ " * 100, "fr", "a", 1),
        (None, words(120, 4), "en", "a", 1), (-3, "a\tb\x0bc d", None, "a", 1), (22, "a\tb\x0bc d", None, "a", 1),
    ]
    df = docs_of(spark, rows, extra).withColumns({c: F.lit(1) for c in ("h", "check", "mask", "n")} if extra else {})
    assert found(filteraudit.audit(df, labels_of(spark, LABELS))) == brute(rows, LABELS)


def test_hot_copies_are_dealt(spark, monkeypatch):
    """A third of all rows with one text, and a hash that two texts share, in effect by a sketch of a few bits."""
    monkeypatch.setattr(filteraudit, "HOT", 4)
    monkeypatch.setattr(common, "SKETCH_BITS", 64)
    rows = [(i, words(110, 1) if i % 3 == 0 else words(30, i) if i % 3 == 1 else words(20, i // 9), "en", "a", 1) for i in range(600)]
    assert found(filteraudit.audit(docs_of(spark, rows), labels_of(spark, LABELS))) == brute(rows, LABELS)


def test_equal_hashes_are_told_apart(spark):
    rows = spark.createDataFrame([(1, "", 7, 1, "x"), (2, "", 7, 2, "y"), (3, "", 7, 1, "x"), (4, "", 7, 2, "y"), (5, "", 8, 1, "x")], "doc_id long, part string, h long, check long, text string")
    assert sorted(r["doc_id"] for r in filteraudit.later_copies(rows, rows.select("doc_id", "h")).collect()) == [3, 4]


def test_no_documents(spark):
    assert filteraudit.audit(spark.createDataFrame([], DOCS), labels_of(spark)).count() == 0
