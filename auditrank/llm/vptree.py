"""Nearest neighbours by largest inner product in vantage-point trees.

Vectors get one more coordinate, sqrt(M^2 - |x|^2) with M the largest norm of the
table, and queries a 0; then a larger inner product is a smaller Euclidean
distance and the triangle inequality holds.

Rows are dealt to shards by a hash of the id; each shard is made into one tree.
Queries go in blocks; a task takes one tree and one block and walks them
together: at each node the queries that cannot be ruled out go on as an array.
A subtree is skipped if ``gap > factor * radius``, gap being the triangle
inequality's bound and radius the distance of the k-th best so far.  Factor 1 is
exact; a smaller one skips more and may miss some.

Defined results: vectors that are NULL, zero or hold NULL or non-finite
components take no part, nor do rows with a NULL id.  A query gets all
candidates if there are fewer than k.  Ties go to the smaller id.  Rows that
share an id each count; vectors of a length other than the most common one are
an error of the input and take no part.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditrank.llm.frames import rows
from auditrank.session import stage

#: Neighbours of a query.
NEAREST = 20
#: Share of the radius that a bound must exceed to skip a subtree; 1 is exact.
FACTOR = 1.0
#: Vectors of a shard, about, and queries of a block.
SHARD_ROWS = 8_192
BLOCK_ROWS = 1_024
#: Vectors of a leaf.
LEAF_ROWS = 256


class Tree:
    """A vantage-point tree over rows of an array, with each subtree a slice.

    ``nodes``: (vantage row, inner radius, outer radii, slices); leaves are slices.
    """

    def __init__(self, points: np.ndarray, ids: np.ndarray, root: tuple):
        self.points, self.ids, self.root = points, ids, root

    @classmethod
    def grown(cls, points: np.ndarray, ids: np.ndarray, leaf: int = LEAF_ROWS) -> "Tree":
        tree = cls(points, ids, ())
        tree.order, tree.leaf = np.arange(len(points)), leaf
        root = tree._build(0, len(points))
        return cls(points[tree.order], ids[tree.order], root)

    def _build(self, a: int, b: int):
        if b - a <= self.leaf:
            return (a, b)
        own = self.order[a:b]
        # The vantage point is the first row, the others lie nearer or farther
        # than the median distance from it.
        distance = np.sqrt(np.maximum(((self.points[own[1:]] - self.points[own[0]]) ** 2).sum(1), 0))
        ranked = np.argsort(distance, kind="stable")
        middle = len(ranked) // 2
        self.order[a + 1 : b] = own[1:][ranked]
        near, far = distance[ranked[:middle]], distance[ranked[middle:]]
        cut = a + 1 + middle
        radii = (float(d) for d in (near[0], near[-1], far[0], far[-1]))
        return (a, self._build(a + 1, cut), self._build(cut, b), *radii)

    def search(self, queries: np.ndarray, own: np.ndarray, top: "Top", factor: float) -> None:
        self._walk(self.root, queries, np.arange(len(queries)), own, top, factor)

    def _walk(self, node, queries, active, own, top, factor) -> None:
        if not len(active):
            return
        if len(node) == 2:
            a, b = node
            top.offer(active, queries, self.points[a:b], self.ids[a:b], own)
            return
        a, near, far, near_low, near_high, far_low, far_high = node
        dots = queries[active] @ self.points[a]
        top.offer(active, queries, self.points[a : a + 1], self.ids[a : a + 1], own)
        square = (queries[active] ** 2).sum(1) + (self.points[a] ** 2).sum() - 2 * dots
        distance = np.sqrt(np.maximum(square, 0))
        parts = ((near, near_low, near_high), (far, far_low, far_high))
        first = np.abs(distance - near_high) * (distance > near_high) > np.abs(far_low - distance) * (distance < far_low)
        # Queries that lie outside look at the outer part first.
        for swap in (False, True):
            group, at = active[first == swap], distance[first == swap]
            for child, low, high in parts[::-1] if swap else parts:
                gap = np.maximum(np.maximum(low - at, at - high), 0)
                # Rounding must not skip a point on the edge, nor one equal to the worst.
                open_ = gap <= factor * top.radius(group) + top.slack[group]
                self._walk(child, queries, group[open_], own, top, factor)


def products(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Inner products row by row, summed from the first component to the last.

    The order of the sum does not depend on how many rows there are, so equal vectors
    have equal scores wherever they stand.
    """
    return np.cumsum(queries * points, axis=1)[:, -1]


#: Pairs whose products are summed at a time.
_PAIRS = 65_536


class Top:
    """The best products of each query so far, and the distance of the worst of them.

    Matrix products find the candidates, within a bound of their rounding; the scores
    that are kept, compared and returned are those of :func:`products`.  Candidates that
    tie with the worst stay until ids are compared.
    """

    def __init__(self, queries: np.ndarray, limit: float, k: int):
        self.k, self.score = k, np.full((len(queries), k), -np.inf)
        self.id = np.full((len(queries), k), np.iinfo(np.int64).max)
        squares = (queries**2).sum(1)
        self.base = squares + limit**2
        # Twice the rounding of a sum of so many products, and of squares of distances;
        # the root of the latter is what a distance near zero may be wrong by.
        unit = (queries.shape[1] + 8) * np.finfo(float).eps
        self.error = 2 * unit * np.sqrt(squares) * limit
        self.slack = 4 * np.sqrt(unit) * (np.sqrt(squares) + limit)

    def radius(self, active: np.ndarray) -> np.ndarray:
        """Infinite while a query has fewer than k."""
        return np.sqrt(np.maximum(self.base[active] - 2 * self.score[active, -1], 0))

    def offer(self, active: np.ndarray, queries: np.ndarray, points: np.ndarray, ids: np.ndarray, own: np.ndarray) -> None:
        rough = queries[active] @ points.T
        rough[ids[None, :] == own[active, None]] = -np.inf
        # Below the worst kept, or below the k-th of this lot, by more than the error.
        worst = self.score[active, -1]
        if len(ids) > self.k:
            worst = np.maximum(worst, np.partition(rough, -self.k, axis=1)[:, -self.k] - self.error[active])
        likely = (rough >= (worst - self.error[active])[:, None]) & (rough > -np.inf)
        some = likely.any(1)
        active, likely = active[some], likely[some]
        if not len(active):
            return
        row, column = np.nonzero(likely)
        exact = np.full(likely.shape, -np.inf)
        for at in range(0, len(row), _PAIRS):
            r, c = row[at : at + _PAIRS], column[at : at + _PAIRS]
            # The last component is the added one, 0 in a query.
            exact[r, c] = products(queries[active[r], :-1], points[c, :-1])
        score = np.concatenate((self.score[active], exact), axis=1)
        found = np.concatenate((self.id[active], np.broadcast_to(ids, exact.shape)), axis=1)
        found = np.where(score == -np.inf, np.iinfo(np.int64).max, found)
        best = np.lexsort((found, -score), axis=1)[:, : self.k]
        self.score[active] = np.take_along_axis(score, best, 1)
        self.id[active] = np.take_along_axis(found, best, 1)


def _valid(vectors: DataFrame, id_: str, vector: str) -> DataFrame:
    """(id, x): rows whose vector takes part, as doubles."""
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    sound = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    found = vectors.select(F.col(id_).cast("long").alias("id"), x.alias("x")).where(
        F.col("id").isNotNull() & F.col("x").isNotNull()
    )
    return found.where(sound & F.exists("x", lambda v: v != 0)).withColumn("width", F.size("x"))


def _arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a group, in order of id."""
    ids = table.column("id").to_numpy()
    flat = table.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    order = np.argsort(ids, kind="stable")
    return ids[order], flat.reshape(len(ids), -1)[order]


def _block(table: pa.Table) -> pa.Table:
    """A block of queries as one row."""
    ids, points = _arrays(table)
    return pa.table({"q_ids": pa.array([ids.tobytes()]), "q_points": pa.array([points.tobytes()])})


def _shard(limit: float):
    """A shard as one row: its tree over vectors with the added coordinate."""

    def grow(table: pa.Table) -> pa.Table:
        ids, points = _arrays(table)
        rest = np.sqrt(np.maximum(limit**2 - (points**2).sum(1), 0))
        tree = Tree.grown(np.column_stack((points, rest)), ids)
        held = (tree.ids.tobytes(), tree.points.tobytes(), pickle.dumps(tree.root))
        columns = {name: pa.array([x], pa.binary()) for name, x in zip(("ids", "points", "nodes"), held)}
        return pa.table({"shard": table.column("shard")[:1], **columns})

    return grow


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    id_: str = "vec_id",
    vector: str = "embedding",
    k: int = NEAREST,
    factor: float = FACTOR,
) -> DataFrame:
    """(query_id, rank, id, score): each query's k rows of largest inner product."""
    points, asked = _valid(vectors, id_, vector), _valid(queries, id_, vector)
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))
    widths = points.groupBy("width").agg(F.count("*").alias("n"), F.max(norm).alias("norm"))
    most = widths.orderBy(F.desc("n"), "width").first()
    schema = f"query_id long, rank int, {id_} long, score double"
    if most is None:
        return vectors.sparkSession.createDataFrame([], schema)
    width, limit, count = most["width"], float(most["norm"]), most["n"]
    shards = max(1, -(-count // SHARD_ROWS))
    same = F.col("width") == width
    trees = (
        points.where(same).select("id", "x", F.pmod(F.xxhash64("id"), F.lit(shards)).alias("shard"))
        .groupBy("shard").applyInArrow(_shard(limit), "shard long, ids binary, points binary, nodes binary")
    )
    asked = asked.where(same)
    blocks = max(1, -(-asked.count() // BLOCK_ROWS))
    shard = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))
    held = (
        asked.select("id", "x", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).alias("block"))
        .groupBy("block").applyInArrow(_block, "q_ids binary, q_points binary")
        .select("q_ids", "q_points", shard.alias("shard"))
    )
    # A stated query set against all rows: every block meets every shard once.
    met = stage(trees, "trees").join(held, "shard").select("ids", "points", "nodes", "q_ids", "q_points")
    found = met.repartition(shards * blocks).mapInArrow(
        _searcher(width, limit, k, factor), "query_id long, other long, score double"
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "other")
    return (
        found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select("query_id", "rank", F.col("other").alias(id_), "score")
    )


def _searcher(width: int, limit: float, k: int, factor: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches):
            for i in range(batch.num_rows):
                ids, points, nodes, own, asked = (batch.column(c)[i].as_py() for c in range(5))
                own = np.frombuffer(own, np.int64)
                asked = np.frombuffer(asked).reshape(-1, width)
                tree = Tree(
                    np.frombuffer(points).reshape(-1, width + 1), np.frombuffer(ids, np.int64), pickle.loads(nodes)
                )
                wide = np.column_stack((asked, np.zeros(len(asked))))
                top = Top(wide, limit, k)
                tree.search(wide, own, top, factor)
                hit = top.id != np.iinfo(np.int64).max
                yield pa.record_batch(
                    [
                        pa.array(np.repeat(own, hit.sum(1))),
                        pa.array(top.id[hit]),
                        pa.array(top.score[hit]),
                    ],
                    names=["query_id", "other", "score"],
                )

    return run


def report(vectors: DataFrame, every: int = 20) -> DataFrame:
    """Neighbours of the rows whose id is divisible by ``every``, among all others."""
    return nearest(vectors, vectors.where(F.col("vec_id") % every == 0))
