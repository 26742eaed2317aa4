"""Clustering by centroids, with candidates filtered by n-simplex projection.

A few pivots span a simplex. The distances of a vector to the pivots, measured once and
kept with it, are its apex coordinates over that simplex: one number for each pivot but
the first, and its height above them. Two apexes give a lower bound of the distance of
their vectors (both heights on one side of the simplex) and an upper one (on opposite
sides). A centroid whose lower bound exceeds the least upper bound cannot be the
nearest; only the others are compared, in whole numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddspark.llm.common import publish

LARGEST = 2**63 - 1
PIVOTS = 24


def _size(a) -> int:
    return max(-int(a.min()), int(a.max())) if a.size else 0


def squared(a, b):
    """Exact squared distances of the rows of ``a`` to one vector; Python integers if 64 bits may not do."""
    import numpy as np

    if 4 * max(_size(a), _size(b)) ** 2 * a.shape[1] < 2**62:
        away = a - b
        return np.einsum("ij,ij->i", away, away)
    away = a.astype(object) - b.astype(object)
    return (away * away).sum(axis=1)


@dataclass
class Simplex:
    """Pivots, the inverse of the triangle of their coordinates, and the rounding to allow for."""

    pivots: object
    lengths: object
    inverse: object
    slack: float

    def apexes(self, vectors):
        """Coordinates (rows x pivots) of the vectors; the last one is the height."""
        import numpy as np

        away = np.stack([squared(vectors, p).astype(np.float64) for p in self.pivots], axis=1)
        base = ((away[:, :1] - away[:, 1:] + self.lengths) / 2) @ self.inverse.T
        height = np.sqrt(np.maximum(away[:, 0] - (base**2).sum(axis=1), 0))
        return np.concatenate([base, height[:, None]], axis=1)


def simplex_of(candidates, most: int = PIVOTS) -> Simplex:
    """Simplex over at most ``most`` of the candidates, each next pivot being the one highest above the others.

    Ends early where every candidate lies nearly in the span of the pivots taken, so
    equal or dependent candidates do no harm.
    """
    import numpy as np

    first = candidates[0]
    away = np.stack([squared(candidates, c).astype(np.float64) for c in candidates])
    taken, rows = [0], []
    coords = np.zeros((len(candidates), 0))
    height = away[0].copy()
    while len(taken) < min(most, len(candidates)):
        at = int(np.argmax(height))
        if height[at] <= 1e-4 * max(1.0, away[0].max()):
            break
        own = coords[at]
        side = np.sqrt(height[at])
        new = ((away[0] - away[at] + away[0][at]) / 2 - coords @ own) / side
        rows.append((at, own.copy(), side))
        coords = np.concatenate([coords, new[:, None]], axis=1)
        height = np.maximum(height - new**2, 0)
        taken.append(at)
    triangle = np.zeros((len(rows), len(rows)))
    for i, (_, own, side) in enumerate(rows):
        triangle[i, : len(own)], triangle[i, i] = own, side
    inverse = np.linalg.inv(triangle) if rows else np.zeros((0, 0))
    trust = float(np.linalg.cond(triangle)) if rows else 1.0
    pivots = [first, *(candidates[at] for at, _, _ in rows)]
    return Simplex(pivots, away[0][[at for at, _, _ in rows]], inverse, 1e-13 * (trust**2 + 100) * (1 + len(rows)))


def bounds(apexes, others):
    """Lower and upper bounds of the squared distances of all rows of two sets of apexes."""
    import numpy as np

    lower = (apexes**2).sum(axis=1)[:, None] + (others**2).sum(axis=1)[None, :] - 2 * (apexes @ others.T)
    return np.maximum(lower, 0), np.maximum(lower, 0) + 4 * np.outer(apexes[:, -1], others[:, -1])


def nearest(vectors, apexes, centroids, simplex: Simplex):
    """Number and squared distance of the nearest centroid of each vector, ties to the smaller number, and the pairs compared."""
    import numpy as np

    others = simplex.apexes(centroids)
    lower, upper = bounds(apexes, others)
    slack = simplex.slack * ((apexes**2).sum(axis=1)[:, None] + (others**2).sum(axis=1)[None, :] + 1)
    keep = lower - slack <= (upper + slack).min(axis=1, initial=np.inf)[:, None]
    number = np.full(len(vectors), -1, np.int64)
    best = np.full(len(vectors), LARGEST, np.int64)
    for c in range(len(centroids)):
        rows = np.flatnonzero(keep[:, c])
        away = squared(vectors[rows], centroids[c])
        if away.dtype == object:
            best = best.astype(object)
        better = np.asarray((number[rows] < 0) | (away < best[rows]), bool)
        rows, away = rows[better], away[better]
        number[rows], best[rows] = c, away
    return number, best, int(keep.sum())


def _matrix(column: pa.Array, width: int):
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _lists(matrix) -> pa.Array:
    import numpy as np

    return pa.ListArray.from_arrays(pa.array(np.arange(len(matrix) + 1) * matrix.shape[1], pa.int32()), pa.array(np.ascontiguousarray(matrix).ravel()))


def assign(rows: DataFrame, centroids, simplex: Simplex, width: int, columns: list[str]) -> DataFrame:
    """The rows with ``cluster`` and ``distance`` (squared, at most the largest long) in front."""
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, best, _ = nearest(_matrix(batch.column("v"), width), _matrix(batch.column("apex"), len(simplex.pivots)), centroids, simplex)
            far = pa.array([min(int(d), LARGEST) for d in best], pa.int64()) if best.dtype == object else pa.array(best, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), far, *(batch.column(c) for c in columns)], ["cluster", "distance", *columns])

    return rows.mapInArrow(run, ", ".join(["cluster int", "distance long", *(f"{c} {kinds[c]}" for c in columns)]))


def partial_sums(rows: DataFrame, centroids, simplex: Simplex, width: int) -> DataFrame:
    """``cluster, high, low``: sums over the vectors of each cluster, one row a cluster and batch.

    A sum is high * 2**32 + low, so that sums of either half stay whole numbers. The
    last component counts the vectors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            vectors = _matrix(batch.column("v"), width)
            if not len(vectors):
                continue
            number, _, _ = nearest(vectors, _matrix(batch.column("apex"), len(simplex.pivots)), centroids, simplex)
            order = np.argsort(number, kind="stable")
            found, start = np.unique(number[order], return_index=True)
            counted = np.concatenate([vectors, np.ones((len(vectors), 1), np.int64)], axis=1)[order]
            high, low = (np.add.reduceat(part, start, axis=0) for part in (counted >> 32, counted & 0xFFFFFFFF))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), _lists(high), _lists(low)], ["cluster", "high", "low"])

    return rows.mapInArrow(run, "cluster int, high array<bigint>, low array<bigint>")


def moved(centroids, sums: DataFrame):
    """Centroids at the floor of the exact means of their vectors; those without vectors stay. Their numbers are all that reaches the driver."""
    import numpy as np

    parts = sums.select("cluster", F.posexplode(F.arrays_zip("high", "low")).alias("at", "half"))
    total = [F.sum(F.col(f"half.{half}").cast("decimal(38,0)")).alias(half) for half in ("high", "low")]
    found = {(r["cluster"], r["at"]): int(r["high"]) * 2**32 + int(r["low"]) for r in parts.groupBy("cluster", "at").agg(*total).collect()}
    k, width = centroids.shape
    means = [[found[c, i] // found[c, width] if (c, i) in found else int(centroids[c, i]) for i in range(width)] for c in range(k)]
    return np.array(means, np.int64).reshape(k, width)


def cluster(
    vectors: DataFrame, k: int = 40, rounds: int = 5, width: int = 64, scale: int = 256, pivots: int = PIVOTS, seed: str = "2:"
) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` for each vector that takes part.

    Vectors with exactly ``width`` components, none of them null or non-finite, take
    part; components become floor(scale * x), held within the range of a long. The
    first centroids are the k vectors with the smallest sha256 of ``seed`` and vec_id
    (equal ids: the smaller vector; rows without id cannot be one unless no other is
    left). Fewer vectors than k: as many centroids. Repeated rows count each. Equal
    centroids: the smaller number takes all. Distances and inertias are exact, and
    shown as the largest long where they exceed it. The vectors and their apexes are
    written once; each round reads them and sends a few sums a task. Centroids, k times
    width numbers, are all that passes through the driver.
    """
    import numpy as np

    x = F.transform("embedding", lambda v: v.cast("double"))
    usable = (F.size("embedding") == width) & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) != float("inf")))
    rows = vectors.where(F.col("embedding").isNotNull()).where(usable).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v * scale).cast("long")).alias("v")
    )
    mark = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256)
    first = rows.select("v", mark.alias("mark")).orderBy(F.asc_nulls_last("mark"), "v").limit(k).collect()
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return vectors.sparkSession.createDataFrame([], schema)
    centroids = np.array([r["v"] for r in first], np.int64).reshape(len(first), width)
    simplex = simplex_of(centroids, pivots)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apexes = simplex.apexes(_matrix(batch.column("v"), width))
            yield pa.RecordBatch.from_arrays([*batch.columns, _lists(apexes)], ["vec_id", "v", "apex"])

    kept = publish(rows.mapInArrow(measure, "vec_id long, v array<bigint>, apex array<double>"), "apexes")
    for _ in range(rounds):
        centroids = moved(centroids, partial_sums(kept, centroids, simplex, width))
    done = publish(assign(kept, centroids, simplex, width, ["vec_id"]), "assigned")
    inertia = {r["cluster"]: int(r["s"]) for r in done.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    whole = min(sum(inertia.values()), LARGEST)
    told = [(c, min(s, LARGEST), whole, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in inertia.items()]
    about = vectors.sparkSession.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # one row a centroid: k rows at most
    return done.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def check_sql(k: int = 40, rounds: int = 5, width: int = 64, scale: int = 256, seed: str = "2:") -> str:
    """The same in DuckDB, one block of steps a round."""
    near = """
  d{r} AS MATERIALIZED (SELECT p.row, c.cluster, sum((p.x - c.x) * (p.x - c.x)) AS distance
    FROM parts p JOIN c{r} c ON p.i = c.i GROUP BY p.row, c.cluster),
  a{r} AS MATERIALIZED (SELECT row, arg_min(cluster, (distance, cluster)) AS cluster, min(distance) AS distance FROM d{r} GROUP BY row),"""
    move = """
  m{r} AS MATERIALIZED (SELECT a.cluster, p.i, sum(p.x)::BIGINT AS s, count(*) AS n FROM a{r} a JOIN parts p ON a.row = p.row GROUP BY a.cluster, p.i),
  c{n} AS MATERIALIZED (SELECT c.cluster, c.i, coalesce((m.s - ((m.s % m.n) + m.n) % m.n) // m.n, c.x) AS x
    FROM c{r} c LEFT JOIN m{r} m ON c.cluster = m.cluster AND c.i = m.i),"""
    steps = "".join(near.format(r=r) + move.format(r=r, n=r + 1) for r in range(rounds)) + near.format(r=rounds)
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda v: floor({scale} * v::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = {width}),
  parts AS MATERIALIZED (SELECT row, unnest(range({width})) AS i, unnest(v) AS x FROM kept),
  firsts AS MATERIALIZED (SELECT row, row_number() OVER (ORDER BY sha256('{seed}' || vec_id::VARCHAR) NULLS LAST, v) - 1 AS cluster
    FROM kept QUALIFY cluster < {k}),
  c0 AS MATERIALIZED (SELECT f.cluster, p.i, p.x FROM firsts f JOIN parts p ON f.row = p.row),{steps}
  told AS (SELECT cluster, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY cluster)
SELECT k.vec_id, a.cluster::INT AS cluster, a.distance::BIGINT AS distance,
  sum(a.distance) OVER (PARTITION BY a.cluster)::BIGINT AS cluster_inertia, sum(a.distance) OVER ()::BIGINT AS inertia, t.centroid_sha256
FROM a{rounds} a JOIN kept k ON a.row = k.row JOIN told t ON a.cluster = t.cluster"""
