"""Dual-tree search: what it prunes on clustered vectors, and scores beyond the precision of a double."""

import numpy as np
import pytest

from oddspark.llm import covertree


def _brute(queries, query_ids, points, point_ids, k):
    scores = queries.astype(object) @ points.T.astype(object)
    held = np.minimum(np.maximum(scores, covertree.LOWEST), covertree.HIGHEST)
    found = []
    for q, row in enumerate(held):
        ranked = sorted((-s, int(i)) for s, i in zip(row, point_ids) if i != query_ids[q])
        found += [(q, i, -s) for s, i in ranked[:k]]
    return found


def test_clustered_vectors_are_pruned():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16)) * 1024
    points = np.floor(np.repeat(centres, 100, axis=0) + rng.normal(size=(4000, 16)) * 10).astype(np.int64)
    ids = rng.permutation(4000)
    queries, query_ids = points[::20], ids[::20]
    got, multiplied = covertree.search(queries, query_ids, points, ids, 10)
    assert got == _brute(queries, query_ids, points, ids, 10)
    assert multiplied < len(queries) * len(points) / 20


@pytest.mark.parametrize("spread", [1, 1000])
def test_leaves_are_small_or_hold_points_far_apart(spread):
    points = np.floor(np.random.default_rng(3).normal(size=(1500, 12)) * spread).astype(np.float64)
    seen = []

    def walk(node):
        distance = lambda rows: np.sqrt(((points[rows] - node.centre) ** 2).sum(axis=1))
        if node.children is None:
            assert distance(node.rows).max() <= node.radius + 1e-6
            if len(node.rows) > covertree.LEAF:
                apart = np.sqrt(((points[node.rows][:, None] - points[node.rows][None]) ** 2).sum(axis=2))
                assert apart[~np.eye(len(apart), dtype=bool)].min() > node.radius / covertree.BASE - 1e-6
            seen.extend(node.rows.tolist())
            return node.rows
        assert len(node.children) > 1
        rows = np.concatenate([walk(child) for child in node.children])
        assert distance(rows).max() <= node.radius + 1e-6
        return rows

    root = covertree.cover_tree(points)
    walk(root)
    assert root.children and sorted(seen) == list(range(1500))
    equal = covertree.cover_tree(np.full((500, 3), 2.0**62))
    assert equal.children is None and len(equal.rows) == 500


def test_scores_beyond_the_precision_of_a_double():
    rng = np.random.default_rng(9)
    close = 2**40 + rng.integers(0, 3, size=(300, 3))
    huge = rng.choice([-(2**63), 2**63 - 1, 2**62, 5], size=(40, 3))
    for points in (close, huge, np.full((200, 3), 2**62 + 1)):
        points = points.astype(np.int64)
        ids = np.arange(len(points)) * 7
        got, _ = covertree.search(points[::10], ids[::10], points, ids, 10)
        assert got == _brute(points[::10], ids[::10], points, ids, 10)


def test_large_components_through_the_query(spark):
    rows = [(i, [float(2**30 + i % 7), float(2**30 - i % 5)]) for i in range(200)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in covertree.nearest(vectors).collect()}
    longs = np.array([[1024 * int(v) for v in e] for _, e in rows], np.int64)
    want = _brute(longs[::100], np.array([0, 100]), longs, np.arange(200), 10)
    assert got == {(100 * q, n % 10 + 1): (i, s) for n, (q, i, s) in enumerate(want)}
