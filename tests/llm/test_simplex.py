"""Centroid clustering against plain k-means in Python integers, and what the simplex filters."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oddspark.llm import simplex

ROWS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType()))])


def floor256(x):
    n, d = float(x).as_integer_ratio()
    return max(-(2**63), min(2**63 - 1, n * 256 // d))


def brute(rows, k, rounds, width):
    kept = [(i, [floor256(x) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))[:k]
    centres = [v for _, v in first]

    def place(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        at = [place(v)[1] for _, v in kept]
        centres = [
            [sum(x) // len(own) for x in zip(*own)] if (own := [v for (_, v), a in zip(kept, at) if a == n]) else c for n, c in enumerate(centres)
        ]
    done = [(i, *reversed(place(v))) for i, v in kept]
    most = 2**63 - 1
    own = {n: sum(min(d, most) for _, a, d in done if a == n) for n in range(len(centres))}
    mark = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, a, min(d, most), min(own[a], most), min(sum(own.values()), most), mark[a]) for i, a, d in done), key=repr)


def found(spark, rows, **kw):
    df = spark.createDataFrame(rows, ROWS).withColumns({c: F.lit("x") for c in ("v", "apex", "cluster", "mark")})
    return sorted((tuple(r) for r in simplex.cluster(df, **kw).collect()), key=repr)


def clustered(n=300, width=8, seed=0):
    r = np.random.default_rng(seed)
    centres = r.normal(0, 1, (12, width))
    return [(i, (centres[i % 12] + r.normal(0, 0.05, width)).tolist()) for i in range(n)]


def test_against_brute_force(spark):
    rows = clustered() + [(300 + i, clustered()[7][1]) for i in range(200)] + [(5, clustered()[9][1]), (None, clustered()[3][1])]
    rows += [(900, None), (901, [None] * 8), (902, [float("nan")] * 8), (903, [float("inf")] * 8), (904, [0.5] * 7), (905, [])]
    assert found(spark, rows, k=20, rounds=4, width=8) == brute(rows, 20, 4, 8)


@pytest.mark.parametrize("size", [2.0**20, 2.0**52, 1e300])
def test_components_beyond_plain_sums(spark, size):
    r = np.random.default_rng(3)
    rows = [(i, (r.normal(0, size, 3)).tolist()) for i in range(40)]
    assert found(spark, rows, k=6, rounds=3, width=3) == brute(rows, 6, 3, 3)


def test_fewer_vectors_than_centroids_equal_ones_and_none(spark):
    rows = [(i, [1.0, 2.0]) for i in range(5)]
    assert found(spark, rows, k=8, rounds=2, width=2) == brute(rows, 8, 2, 2)
    assert found(spark, [], k=8, rounds=2, width=2) == []
    assert found(spark, [(1, [0.1])], k=1, rounds=2, width=1) == brute([(1, [0.1])], 1, 2, 1)


def test_bounds_hold_and_filter(spark):
    """No true distance leaves its bounds, and on clustered vectors few centroids are compared."""
    vectors = (np.array([v for _, v in clustered(600, 16)]) * 256).astype(np.int64)
    centres = vectors[:40]
    s = simplex.simplex_of(centres)
    a, b = s.apexes(vectors), s.apexes(centres)
    lower, upper = simplex.bounds(a, b)
    true = ((vectors[:, None, :] - centres[None]) ** 2).sum(axis=2)
    assert (lower <= true * (1 + 1e-9) + 1e-3).all() and (upper >= true * (1 - 1e-9) - 1e-3).all()
    number, best, compared = simplex.nearest(vectors, a, centres, s)
    assert (number == true.argmin(axis=1)).all() and (best == true.min(axis=1)).all()
    assert compared < 0.25 * true.size
