"""Near copies of the pipeline against all pairs of exact similarities."""

import random

import pytest

import corpus_pipeline
from oddspark.llm import nearcopies
from tests.conftest import DATA
from tests.llm.data import docs_of, words


def shingles(text, width=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def similarity(x, y):
    return len(x & y) / len(x | y) if x | y else 1.0


def planted():
    """Copies of three texts with words changed, texts of common lines, and unrelated texts."""
    r, rows = random.Random(1), []
    for base in range(3):
        text = words(240, 50 + base).split()
        rows.append(" ".join(text))
        for changes in (1, 2, 3, 4, 5, 6, 8):
            copy = list(text)
            for at in r.sample(range(5, 235), changes):
                copy[at] += "q"
            rows.append(" ".join(copy))
    line = words(30, 90)
    rows += [line + " " + words(n, 100 + n) for n in range(2, 40)]
    rows += [words(60, 200 + i) for i in range(20)]
    return [(i, t, "en", "a", 0) for i, t in enumerate(rows)]


def components(rows):
    held, root = [shingles(r[1]) for r in rows], list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if similarity(held[i], held[j]) >= 0.8:
                low, high = sorted((top(i), top(j)))
                root[high] = low
    return [top(i) for i in range(len(rows))]


@pytest.mark.parametrize("small", [2, 64])
def test_components_are_those_of_all_pairs(spark, monkeypatch, small):
    monkeypatch.setattr(nearcopies, "SMALL_FILE", small)
    rows = planted()
    got = {r.doc_id: r.component_id for r in nearcopies.near_copies(docs_of(spark, rows)).collect()}
    assert got == {r[0]: c for r, c in zip(rows, components(rows))}


def test_stage_drops_planted_near_copies(spark):
    rows = planted()
    values = [similarity(shingles(rows[0][1]), shingles(rows[i][1])) for i in range(1, 8)]
    assert any(0.8 <= v < 0.85 for v in values) and any(0.85 <= v < 0.95 for v in values)
    got = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs_of(spark, rows), str(DATA)).collect()}
    assert got == {r[0] for r, c in zip(rows, components(rows)) if r[0] == c}


def test_repeated_ids_stand_for_their_own_texts(spark):
    """An id with two texts loses neither to the other; equal rows stay once; rows without id stay."""
    a, b = words(60, 1), words(60, 2)
    near = a.replace(a.split()[50], "zz", 1)
    rows = [(5, a), (5, b), (5, a), (7, near), (7, b), (3, words(50, 3)), (3, words(50, 3)), (None, a), (None, a), (9, None), (2, "")]
    df = docs_of(spark, [(i, t, "en", "a", 0) for i, t in rows])
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, df, str(DATA)).collect()), key=repr)
    assert got == sorted([(5, a), (5, b), (3, words(50, 3)), (None, a), (None, a), (2, "")], key=repr)


def test_no_documents_and_none_without_words(spark):
    assert nearcopies.without_copies(docs_of(spark, [])).count() == 0
    only = docs_of(spark, [(4, None, "en", "a", 0), (3, " ", "en", "a", 0), (None, "", "en", "a", 0)])
    assert sorted((r.doc_id for r in nearcopies.without_copies(only).collect()), key=repr) == [3, None]


def edited(n, changes):
    """One text, and copies of it in which words of their own stand at some places."""
    r, text = random.Random(2), words(150, 7).split()
    rows = [" ".join(text)]
    for i in range(n):
        copy = list(text)
        for at in r.sample(range(8, 142), changes(i)):
            copy[at] += f"q{i}"
        rows.append(" ".join(copy))
    return [(i, t, "en", "a", 0) for i, t in enumerate(rows)]


def test_a_large_group_of_near_copies_does_not_meet_in_pairs(spark, monkeypatch):
    """Copies are linked by SimHash and to the member with the fewest changes; only what is open then meets."""
    compared, inner = [], nearcopies._similar
    monkeypatch.setattr(nearcopies, "_similar", lambda pairs, *rest: compared.append(pairs.count()) or inner(pairs, *rest))
    rows = edited(60, lambda i: 1 + i % 3)
    got = {r.component_id for r in nearcopies.near_copies(docs_of(spark, rows)).collect()}
    assert got == {0}
    assert sum(compared) <= 4 * len(rows)


def test_simhash_links_are_checked_and_lead(spark):
    """What the pigeonring search links is among the pairs; texts with equal sets are one node."""
    rows = edited(12, lambda i: 1)
    prints = nearcopies.signed(docs_of(spark, rows)).select("node", "fp")
    pairs = {tuple(sorted(r)) for r in nearcopies._simhash_pairs(prints).collect()}
    held = {r.node: r.fp for r in prints.collect()}
    assert pairs and all((held[a] ^ held[b]).bit_count() <= 3 for a, b in pairs if (held[a] ^ held[b]) >= 0)


def test_blocks_of_a_file_meet_in_pairs(spark, monkeypatch):
    """A file that is cut into blocks gives the pairs that it gives whole, between different parts only."""
    rows = [(1, node, 10, 0, node % 4) for node in range(40)] + [(2, node, 10, 0, 9) for node in range(40, 60)] + [(3, 70, 10, 0, 1), (3, 71, 30, 0, 2)]
    parted = spark.createDataFrame(rows, "key long, node long, size long, at long, part long")
    expected = {(a, b) for a in range(40) for b in range(a + 1, 40) if a % 4 != b % 4}
    for small, short in ((4096, 64), (4096, 2), (7, 64), (7, 2), (1, 2)):
        monkeypatch.setattr(nearcopies, "SMALL_FILE", small)
        monkeypatch.setattr(nearcopies, "SHORT_FILE", short)
        found = [tuple(sorted(r)) for r in nearcopies._crossed(parted).collect()]
        assert set(found) == expected and len(found) == len(expected)


def test_unlike_texts_that_share_much_are_not_paired(spark, monkeypatch):
    """Three texts with most words in common, not enough of them, met under each shared shingle of their prefixes."""
    crossed, inner = [], nearcopies._crossed
    monkeypatch.setattr(nearcopies, "_crossed", lambda *files: crossed.append(inner(*files).count()) or inner(*files))
    rows = [words(150, 10 * family) + " " + words(50, 10 * family + 1 + i) for family in range(10) for i in range(3)]
    rows = [(i, t, "en", "a", 0) for i, t in enumerate(rows)]
    got = {r.doc_id: r.component_id for r in nearcopies.near_copies(docs_of(spark, rows)).collect()}
    assert got == {r[0]: c for r, c in zip(rows, components(rows))}
    assert crossed[0] <= len(rows)


def test_of_files_with_equal_members_the_first_is_kept(spark):
    files = {5: [(1, 4), (2, 6)], 6: [(1, 0), (2, 3)], 7: [(1, 1), (2, 4), (3, 0)], 8: [(2, 5), (3, 1)], 9: [(2, 7), (3, 4)]}
    met = spark.createDataFrame([(k, n, 10, at) for k, held in files.items() for n, at in held], "key long, node long, size long, at long")
    kept = {(r.key, r.node) for r in nearcopies._first_files(met).collect()}
    assert kept == {(k, n) for k in (6, 7, 8) for n, _ in files[k]}


def test_marks_never_exceed_the_difference():
    import numpy as np

    r = np.random.default_rng(3)
    pool = r.integers(0, 2**63, 30_000).astype(np.uint64)
    sets = [np.unique(pool[a:b]) for a, b in ((0, 300), (0, 300), (20, 310), (0, 370), (200, 500), (0, 1), (3, 4), (0, 9000), (1000, 10_000), (0, 20_000), (2000, 22_000))]
    marks = nearcopies.Marks([nearcopies._mark(s) for s in sets] + [b""])
    i, j = (v.ravel() for v in np.meshgrid(np.arange(len(sets) + 1), np.arange(len(sets) + 1)))
    bound = marks.differ(i, j)
    truth = [0 if len(sets) in (x, y) else len(np.setxor1d(sets[x], sets[y])) for x, y in zip(i, j)]
    assert (bound <= truth).all()
    least = {(x, y): b for x, y, b in zip(i.tolist(), j.tolist(), bound.tolist())}
    assert least[0, 1] == 0 and least[0, 2] == 30 and least[5, 6] == 2 and least[0, 4] > 200 and least[9, 10] > 3000


def test_sets_are_made_and_moved_once_for_both_sides(spark):
    def hold(batches):
        yield from batches

    sets = spark.range(40).selectExpr("id % 20 AS node", "sequence(id % 20, id % 20 + 9) AS held").mapInArrow(hold, "node long, held array<bigint>")
    pairs = spark.range(19).selectExpr("id AS a", "id + 1 AS b")
    from pyspark.sql import functions as F

    found = nearcopies._compared(pairs, sets.groupBy("node").agg(F.first("held").alias("held")))
    assert len(found.collect()) == 19
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in plan or plan.count("MapInArrow") == 1
