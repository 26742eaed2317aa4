"""Exact top-k inner products by dual-tree search on cover trees.

Vectors are dealt into blocks at random and queries into groups; every (group, block)
is one small task. There both sides are indexed by cover trees: a node has a centre
and the radius that covers its points, and its children are centres that are further
apart than the radius over ``BASE`` and cover it at that. The query tree is descended with
the data nodes that are still open for its node; a pair goes if the inner product of the
centres plus what the radii can add is below the worst kth score of the queries in the node.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a block and queries of a group.
BLOCK, GROUP = 4096, 2048
#: How much smaller a child's radius is, and the vectors and queries that are compared without a tree.
BASE, LEAF, QUERY_LEAF = 1.3, 32, 4
#: Points that are multiplied at a time.
CHUNK = 512
LOWEST, HIGHEST = -(2**63), 2**63 - 1


class Node:
    __slots__ = ("centre", "norm", "radius", "rows", "children")

    def __init__(self, centre, radius: float, rows, children):
        self.centre, self.radius, self.rows, self.children = centre, radius, rows, children
        self.norm = float((centre @ centre) ** 0.5)


def cover_tree(points, leaf: int = LEAF) -> Node:
    """Tree over the rows of a matrix, built from the top; ``rows`` of a leaf are its points.

    A node is split unless it is small or all its points are equal. Children of one
    point each are one leaf around the centre of their parent.
    """
    import numpy as np

    squares = (points**2).sum(axis=1)

    def far(rows, at: int):
        return np.sqrt(np.maximum(squares[rows] + squares[at] - 2 * (points[rows] @ points[at]), 0))

    def grow(rows, at: int, away) -> Node:
        radius = float(away.max())
        if len(rows) <= leaf or radius == 0 or (points[rows] == points[at]).all():
            return Node(points[at], radius, rows, None)
        cover, left, parts, single = radius / BASE, np.arange(len(rows)), [], []
        centre, dist = at, away
        while True:
            near = dist <= cover
            if near.sum() > 1:
                parts.append((rows[left[near]], centre, dist[near]))
            else:
                single.append(left[near])
            left = left[~near]
            if not len(left):
                break
            centre = int(rows[left[0]])
            dist = far(rows[left], centre)
        children = [grow(*p) for p in parts]
        if single:
            alone = np.concatenate(single)
            children.append(Node(points[at], float(away[alone].max()), rows[alone], None))
        return children[0] if len(children) == 1 else Node(points[at], radius, None, children)

    everything = np.arange(len(points))
    return grow(everything, 0, far(everything, 0))


def search(queries, query_ids, points, point_ids, k: int):
    """``query row, point id, score`` of each query's k best in the block, and the number of pairs multiplied.

    Ties go to smaller ids, a query's own id is left out. ``queries`` and ``points`` hold longs.
    Sums below 2**53 are exact in floating point; larger ones are multiplied as Python
    integers, and scores outside the range of a long are held at its ends.
    """
    import numpy as np

    floats, others_floats = queries.astype(np.float64), points.astype(np.float64)
    exact = np.abs(floats).max(initial=0) * np.abs(others_floats).max(initial=0) * max(1, points.shape[1]) < 2**53
    best: list[list[tuple[int, int]]] = [[] for _ in range(len(queries))]  # (-score, id), sorted
    worst = np.full(len(queries), -np.inf, np.float64 if exact else object)
    multiplied = 0

    def multiply(rows, others):
        if exact:
            return floats[rows] @ others_floats[others].T
        score = queries[rows].astype(object) @ points[others].T.astype(object)
        return np.minimum(np.maximum(score, LOWEST), HIGHEST)

    def visit(rows, others) -> None:
        nonlocal multiplied
        multiplied += len(rows) * len(others)
        score = multiply(rows, others)
        ids = point_ids[others]
        for i in np.flatnonzero((score >= worst[rows][:, None]).any(axis=1)):
            q = rows[i]
            good = np.flatnonzero((score[i] >= worst[q]) & (ids != query_ids[q]))
            if len(good) > k and exact:
                cut = np.partition(score[i][good], len(good) - k)[len(good) - k]
                good = good[score[i][good] >= cut]
            merged = best[q] + list(zip((-score[i][good]).tolist(), ids[good].tolist()))
            merged.sort()
            best[q] = merged[:k]
            if len(best[q]) == k:
                worst[q] = max(worst[q], -best[q][-1][0])

    left, right = cover_tree(floats, QUERY_LEAF), cover_tree(others_floats, LEAF)
    nodes, kids = [right], []
    for node in nodes:
        kids.append(np.arange(len(nodes), len(nodes) + len(node.children or [])))
        nodes.extend(node.children or [])
    centres, radii = np.array([n.centre for n in nodes]), np.array([n.radius for n in nodes])
    norms, inner = np.array([n.norm for n in nodes]), np.array([n.children is not None for n in nodes])

    def bounds(a: Node, at):
        most = centres[at] @ a.centre + a.norm * radii[at] + norms[at] * a.radius + a.radius * radii[at]
        # distances are rounded to about the root of the precision times the longest vector of the node
        slack = 1e-6 * (a.norm + a.radius) * (norms[at] + radii[at]) + 1e-6
        return np.maximum(most + slack, float(LOWEST))

    def seed(a: Node, leaves) -> None:
        """A first worst kth score of each query from the leaves with the likeliest centres."""
        order = leaves[np.argsort(-(centres[leaves] @ a.centre), kind="stable")]
        near = np.concatenate([nodes[i].rows for i in order[: 4 * k]])[: 8 * k]
        score = np.where(point_ids[near] == query_ids[a.rows][:, None], -np.inf, multiply(a.rows, near))
        if score.shape[1] >= k:
            worst[a.rows] = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]

    def below(node: Node):
        return [node] if node.children is None else [leaf for c in node.children for leaf in below(c)]

    def descend(a: Node, at) -> None:
        group = below(a)
        low = worst[np.concatenate([n.rows for n in group])].min()
        while True:
            most = bounds(a, at)
            at, most = at[most >= low], most[most >= low]
            wide = inner[at] & ((radii[at] > a.radius) | (a.children is None))
            if not wide.any():
                break
            at = np.concatenate([at[~wide], *(kids[i] for i in at[wide])])
        for child in a.children or []:
            descend(child, at)
        if a.children is None:
            order = np.argsort(-most, kind="stable")
            held, size = [], 0
            for i in order:
                if not held and most[i] < worst[a.rows].min():
                    return
                held.append(nodes[at[i]].rows)
                size += len(held[-1])
                if size >= CHUNK or i == order[-1]:
                    visit(a.rows, np.concatenate(held))
                    held, size = [], 0

    if exact:
        for leaf in below(left):
            seed(leaf, np.flatnonzero(~inner))
    descend(left, np.array([0]))
    return [(q, i, -s) for q, found in enumerate(best) for s, i in found], multiplied


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each id divisible by ``every`` the k highest scores among all other rows.

    Components become floor(scale * x), held within the range of a long as scores are. Vectors that are null or hold null or
    non-finite components, and rows without id, take no part; only vectors of equal
    length are compared. Repeated rows are candidates each, and one query. Fewer than
    k candidates: all of them.
    """
    x = F.transform("embedding", lambda v: v.cast("double"))
    usable = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall(
        "embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    )
    rows = vectors.where(usable).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v * scale)).alias("v"), F.size("embedding").alias("length")
    )
    queries = rows.where(F.pmod("vec_id", F.lit(every)) == 0).distinct()
    blocks, groups = (max(1, -(-df.count() // size)) for df, size in ((rows, BLOCK), (queries, GROUP)))
    # a block meets every group: the query set against all rows, piece by piece
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(blocks))).withColumn(
        "group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    )
    asked = queries.withColumn("group", F.pmod(F.xxhash64("vec_id", "v"), F.lit(groups)).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    )
    key = ["length", "group", "block"]

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        import numpy as np

        def matrix(t: pa.Table):
            flat = t.column("v").combine_chunks()
            width = t.column("length")[0].as_py()
            return np.asarray(flat.flatten().to_numpy(zero_copy_only=False), np.int64).reshape(t.num_rows, width)

        found = []
        if left.num_rows and right.num_rows:
            ids, hashed = left.column("vec_id").to_numpy(), left.column("mark").to_numpy()
            best, _ = search(matrix(left), ids, matrix(right), right.column("vec_id").to_numpy(), k)
            found = [(int(ids[q]), int(hashed[q]), i, int(s)) for q, i, s in best]
        columns = list(zip(*found)) or [[], [], [], []]
        return pa.table([pa.array(c, pa.int64()) for c in columns], ["query_id", "mark", "vec_id", "score"])

    asked = asked.withColumn("mark", F.xxhash64("v"))
    local = asked.groupBy(*key).cogroup(dealt.groupBy(*key)).applyInArrow(meet, "query_id long, mark long, vec_id long, score long")
    order = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")
    ranked = local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
