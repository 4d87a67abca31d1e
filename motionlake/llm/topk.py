"""Exact top-k by inner product: a dual-tree search over cover trees.

Candidates are dealt to the nearest of a bounded number of pivots and lie in blocks of about equal size. Each block first
scores the queries among its own rows against itself and against the pivots: the k-th score found there is the one
to beat. Queries of neighbouring pivots make groups. Of every group and block only centre and radius are needed to
bound all their inner products; where the bound leaves a chance, both meet in a task, which holds a few groups and reads
one block after the other. It indexes both by cover trees and descends both together: a pair of nodes is dropped
when no point below can beat the worst k-th score of the queries. Scores are integers, so results are exact; bounds are
loosened by more than floating point can err. No group and no block passes the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motionlake.llm.common import Scratch, in_arrow, require_integer

#: Points of a leaf: few enough to prune, enough for one matrix product.
LEAF = 128
#: Hubs of a level at most.
HUBS = 64
#: Query groups that a task holds, about.
HELD = 8
_LOWEST = np.iinfo(np.int64).min
_NOBODY = np.iinfo(np.int64).max


class Node:
    """A hub (one of its points), how far its points lie from it, and its points or children. Children's hubs stand at
    least `cover` apart, and every point lies within `cover` of its child's hub. Children are made when first asked for."""

    __slots__ = ("_away", "_children", "_x", "cover", "far", "hub", "points")

    def __init__(self, x: np.ndarray, hub: np.ndarray, points: np.ndarray, away: np.ndarray):
        self._x, self.hub, self.points, self._away = x, hub, points, away
        self.far = float(away.max(initial=0.0))
        self.cover = 0.0
        self._children: list[Node] | None = None

    @property
    def children(self) -> list[Node]:
        """Hubs are chosen farthest first, HUBS at most, until all points lie within half of the level above; the distance
        of the next hub that would be chosen both separates and covers. Equal points make a leaf."""
        if self._children is None:
            self._children = []
            if len(self.points) > LEAF and self.far > 0.0:
                own, owner, distances, hubs = self._x[self.points], np.zeros(len(self.points), int), self._away.copy(), [self.hub]
                while len(hubs) < HUBS and distances.max() > self.far / 2:
                    hub = own[distances.argmax()]
                    d = _distances(own, hub)
                    owner[d < distances] = len(hubs)
                    distances = np.minimum(distances, d)
                    hubs.append(hub)
                self.cover = float(distances.max())
                self._children = [Node(self._x, hub, self.points[owner == h], distances[owner == h]) for h, hub in enumerate(hubs)]
        return self._children


def _distances(x: np.ndarray, hub: np.ndarray) -> np.ndarray:
    off = x - hub
    return np.sqrt(np.einsum("ij,ij->i", off, off))


def cover_tree(x: np.ndarray) -> Node:
    """The root over all rows of x, the first one its hub."""
    if not len(x):
        return Node(x, np.zeros(x.shape[1]), np.arange(0), np.zeros(0))
    return Node(x, x[0], np.arange(len(x)), _distances(x, x[0]))


def _balls(nodes: list[Node]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hubs, their norms, radii and numbers of points."""
    hubs = np.array([n.hub for n in nodes])
    return hubs, np.linalg.norm(hubs, axis=1), np.array([n.far for n in nodes]), np.array([len(n.points) for n in nodes])


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of integer rows in 64 bits; larger ones are the largest such number of their sign."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:  # exact in doubles
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 2**62:
        return a @ b.T
    wide = a.astype(object) @ b.astype(object).T
    return np.clip(wide, _LOWEST + 1, np.iinfo(np.int64).max).astype(np.int64)


class Points:
    """Integer vectors in ascending order of their ids, which no two share."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids)
        self.ids, self.x = ids[order], x[order]
        self.doubles = self.x.astype(np.float64)
        self.norm = float(np.linalg.norm(self.doubles, axis=1).max(initial=0.0))
        self.singles = self.doubles.astype(np.float32)
        self.tree = cover_tree(self.doubles)

    def scores(self, rows: np.ndarray, other: Points, others: np.ndarray) -> np.ndarray:
        """Exact inner products. No sum of some of their terms exceeds the product of norms, so that floating point makes
        no error where that is below its whole numbers."""
        most = self.norm * other.norm
        if most < 2**52:
            a, b = (self.singles, other.singles) if most < 2**23 else (self.doubles, other.doubles)
            return a[rows] @ b[others].T
        return _products(self.x[rows], other.x[others])


class Queries(Points):
    """Queries with the k best scores so far and whose they are. `beat`: scores that are known to be reached k times, so that
    lower ones don't matter."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, beat: np.ndarray):
        super().__init__(ids, x)
        self.beat = beat[np.argsort(ids)]
        self.best = np.full((len(ids), k), _LOWEST)
        self.who = np.full((len(ids), k), _NOBODY)

    def least(self, rows: np.ndarray) -> np.ndarray:
        return np.maximum(self.best[rows, -1], self.beat[rows])

    def meet(self, other: Points) -> None:
        """Search these points for all queries; a point of the query's own id is no candidate."""
        if len(self.ids) and len(other.ids):
            self._descend(self.tree, other.tree, other)

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of queries, of their best points, and scores."""
        rows, at = np.nonzero((self.best > _LOWEST) & (self.best >= self.beat[:, None]))
        return self.ids[rows], self.who[rows, at], self.best[rows, at]

    def _descend(self, a: Node, b: Node, other: Points) -> None:
        """Pairs of children, most promising first, unless most of their points have to meet anyway."""
        if bound(a.hub @ b.hub, np.linalg.norm(a.hub), a.far, np.linalg.norm(b.hub), b.far) < self.least(a.points).min():
            return
        above, below = a.children or [a], b.children or [b]
        if len(above) * len(below) > 1:
            (p, p_norm, p_far, p_n), (r, r_norm, r_far, r_n) = _balls(above), _balls(below)
            top = bound(p @ r.T, p_norm[:, None], p_far[:, None], r_norm[None, :], r_far[None, :])
            chance = top >= np.array([float(self.least(c.points).min()) for c in above])[:, None]
            if 2 * (p_n @ chance @ r_n) <= len(a.points) * len(b.points):
                pairs = np.argwhere(chance)
                for i, j in pairs[np.argsort(-top[chance], kind="stable")].tolist():
                    self._descend(above[i], below[j], other)
                return
        self._score(a.points, b.points, other)

    def _score(self, rows: np.ndarray, others: np.ndarray, other: Points) -> None:
        scores, k = self.scores(rows, other, others), self.best.shape[1]
        ids, own = other.ids[others], self.ids[rows]
        at = np.minimum(np.searchsorted(ids, own), len(ids) - 1)
        same = np.flatnonzero(ids[at] == own)
        whole = scores.dtype == np.int64
        scores[same, at[same]] = _LOWEST if whole else -np.inf
        hit = scores >= self.least(rows).astype(scores.dtype)[:, None]
        if whole:
            hit &= scores > _LOWEST
        if np.count_nonzero(hit) > 4 * k * len(rows):  # too many to sort: the k best of each row, ties to the smaller id
            many = np.flatnonzero(hit.sum(1) > k)
            some = scores[many]
            kth = np.partition(some, -k, axis=1)[:, -k, None]
            above, even = some > kth, some == kth
            hit[many] = above | (even & (np.cumsum(even, axis=1) <= k - above.sum(1)[:, None]))
        i, j = np.divmod(np.flatnonzero(hit), len(others))
        if len(i):
            self._offer(rows[i], ids[j], scores[i, j].astype(np.int64))

    def _offer(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        changed, k = np.unique(rows), self.best.shape[1]
        rows = np.concatenate([np.repeat(changed, k), rows])
        ids = np.concatenate([self.who[changed].ravel(), ids])
        scores = np.concatenate([self.best[changed].ravel(), scores])
        order = np.lexsort((ids, ~scores, rows))  # ~: highest first, without overflow; then the smaller id
        rows = rows[order]
        kept = order[np.arange(len(rows)) - np.searchsorted(rows, rows) < k]
        self.best[changed], self.who[changed] = scores[kept].reshape(-1, k), ids[kept].reshape(-1, k)


def bound(product: np.ndarray, a_norm: np.ndarray, a_far: np.ndarray, b_norm: np.ndarray, b_far: np.ndarray, size: Callable = np.abs):
    """No inner product of a point within a_far of one centre and one within b_far of the other is larger. Arrays, or columns
    with Spark's abs as size."""
    top = product + a_norm * b_far + b_norm * a_far + a_far * b_far
    return top + 1e-6 * (size(product) + a_norm * b_norm + size(top)) + 1.0


def integers(vectors: DataFrame, scale: int = 1024, column: str = "embedding") -> DataFrame:
    """vec_id and v, floor(scale * component) of each vector; null vectors and such with null or non-finite parts go.
    Components beyond 64 bits become the largest such number of their sign."""
    parts = F.transform(F.col(column), lambda x: x.cast("double"))
    fine = F.forall(parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col(column).isNotNull()).where(fine)
    return rows.select("vec_id", F.transform(parts, lambda x: F.floor(x * scale)).alias("v"))


def _array(batch: pa.RecordBatch, i: int, column: str) -> np.ndarray:
    return batch.column(column)[i].values.to_numpy(zero_copy_only=False)


def _rows(batch: pa.RecordBatch, i: int, ids: str, vectors: str) -> tuple[np.ndarray, np.ndarray]:
    known = _array(batch, i, ids)
    x = batch.column(vectors)[i].values.flatten().to_numpy().reshape(len(known), -1)
    return known, x if x.shape[1] else np.zeros((len(known), 1), np.int64)


def _placed(vectors: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """vectors with pivot, the number of the nearest one."""

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("v")
            size = np.diff(column.offsets.to_numpy())
            flat = column.flatten().to_numpy().astype(np.float64)
            start = np.cumsum(size) - size
            pivot = np.zeros(len(size), np.int32)
            for d in np.unique(size):
                own = np.flatnonzero(size == d)
                p = pivots[int(d)].astype(np.float64)
                for lo in range(0, len(own), 4096):
                    some = flat[start[own[lo : lo + 4096]][:, None] + np.arange(d)]
                    pivot[own[lo : lo + 4096]] = ((p**2).sum(1)[None, :] - 2 * some @ p.T).argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot)], names=[*batch.schema.names, "pivot"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "v", "d", "is_query")
    return in_arrow(rows, nearest, "vec_id long, v array<long>, d int, is_query boolean, pivot int")


def _with_ball(blocks: DataFrame, ids: str, vectors: str, names: tuple[str, str, str], schema: str) -> DataFrame:
    """Blocks with the mean of their vectors, its norm, and how far they lie from it. schema: of the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            balls = []
            for i in range(batch.num_rows):
                x = _rows(batch, i, ids, vectors)[1].astype(np.float64)
                centre = x.mean(0)
                balls.append((centre, float(np.linalg.norm(centre)), float(_distances(x, centre).max())))
            centres, norms, fars = zip(*balls, strict=True) if balls else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(centres), pa.list_(pa.float64())), pa.array(norms, pa.float64()), pa.array(fars, pa.float64())], names=[*batch.schema.names, *names])

    return in_arrow(blocks, run, f"{schema}, {names[0]} array<double>, {names[1]} double, {names[2]} double")


def _neighbours(points: np.ndarray) -> list[int]:
    """An order in which each point is followed by the nearest one that is left."""
    left, order = np.arange(1, len(points)), [0]
    while len(left):
        pick = int(_distances(points[left], points[order[-1]]).argmin())
        order.append(int(left[pick]))
        left = np.delete(left, pick)
    return order


def _groups(pivots: np.ndarray, asked: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """For each pivot the number of its queries' first group and of their groups; how many groups there are. Neighbouring pivots
    share a group of about `most` queries; a pivot of more has several to itself."""
    first, own, group, held = np.zeros(len(asked), int), np.ones(len(asked), int), 0, 0
    for p in _neighbours(pivots.astype(np.float64)):
        if held and held + asked[p] > most:
            group, held = group + 1, 0
        pieces = max(1, -(-int(asked[p]) // most))
        first[p], own[p] = group, pieces
        group, held = group + pieces - 1, held + int(asked[p]) if pieces == 1 else most
    return first, own, group + 1


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, block: int = 4096, query_block: int = 1024, most_pivots: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: for each query row its k best other rows; ties go to the smaller id.

    vectors: vec_id (an integer) and v, an array of integers. Only vectors of one length are compared. A repeated id
    counts once, with its greatest vector. Without rows or queries the result is empty. Scores beyond 64 bits count as
    the largest such number of their sign. At most `most_pivots` vectors of each length, chosen by a hash of the id,
    are pivots; they and their counts are all that passes the driver. Where bounds leave a chance to all, every group of
    queries meets every block: work grows with queries times rows, memory and what is written with the rows.
    """
    require_integer(vectors, "vec_id")
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    vectors = scratch.write(vectors.groupBy("vec_id").agg(F.max("v").alias("v")).withColumns({"d": F.size("v"), "is_query": F.coalesce(is_query, F.lit(False))}), "vectors")
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    lengths = vectors.groupBy("d").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_query").alias("asked")).collect()  # a row for each length of vectors
    lengths = [x for x in lengths if x.asked]
    if not lengths:
        scratch.drop(vectors)
        return empty
    pivots: dict[int, np.ndarray] = {}
    pivot_ids: dict[int, np.ndarray] = {}
    for length in lengths:
        count = min(most_pivots, max(1, length.n // block), length.n)
        order = F.xxhash64("vec_id", F.lit("pivot"))
        some = vectors.where(F.col("d") == length.d).orderBy(order, "vec_id").limit(count).select("vec_id", "v").collect()
        pivots[length.d] = np.array([r.v for r in some], np.int64).reshape(count, length.d)
        pivot_ids[length.d] = np.array([r.vec_id for r in some], np.int64)

    placed = scratch.write(_placed(vectors.where(F.col("d").isin([x.d for x in lengths])), pivots), "placed")
    scratch.drop(vectors)
    facts = placed.groupBy("d", "pivot").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_query").alias("asked"))
    known = facts.collect()  # a row a pivot
    asked = {d: np.zeros(len(p), np.int64) for d, p in pivots.items()}
    for r in known:
        asked[r.d][r.pivot] = r.asked
    groups = {d: _groups(p, asked[d], query_block) for d, p in pivots.items()}
    n_blocks, n_groups = sum(-(-r.n // block) for r in known), sum(x[2] for x in groups.values())

    sizes = spark.createDataFrame(known, facts.schema).select("d", "pivot", F.ceil(F.col("n") / block).cast("int").alias("pieces"))
    piece = F.pmod(F.xxhash64("vec_id"), F.col("pieces")).cast("int")
    dealt = placed.join(F.broadcast(sizes), ["d", "pivot"]).withColumn("piece", piece).repartition(max(1, n_blocks // 4), "d", "pivot", "piece")  # sizes: a row a pivot
    dealt = dealt.groupBy("d", "pivot", "piece").agg(F.collect_list("vec_id").alias("ids"), F.collect_list("v").alias("vs"), F.collect_list("is_query").alias("asks"))
    schema = "d int, pivot int, piece int, ids array<long>, vs array<array<long>>, asks array<boolean>"
    candidates = scratch.write(_with_ball(dealt, "ids", "vs", ("centre", "norm", "far"), schema), "candidates")
    scratch.drop(placed)

    def seeded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The queries of each block, with the best k-th score among the block and among the pivots."""
        for batch in batches:
            for i in range(batch.num_rows):
                (ids, x), d = _rows(batch, i, "ids", "vs"), batch.column("d")[i].as_py()
                own = np.flatnonzero(_array(batch, i, "asks"))
                own = own[np.argsort(ids[own])]
                if not len(own):
                    continue
                beat = np.full(len(own), _LOWEST)
                if len(pivot_ids[d]) >= k:
                    scores = _products(x[own], pivots[d] if pivots[d].shape[1] else np.zeros((len(pivots[d]), 1), np.int64))
                    scores[ids[own][:, None] == pivot_ids[d][None, :]] = _LOWEST
                    beat = np.partition(scores, -k, axis=1)[:, -k]
                q = Queries(ids[own], x[own], k, beat)
                q.meet(Points(ids, x))
                first, several, _ = groups[d]
                pivot = batch.column("pivot")[i].as_py()
                to = first[pivot] + np.arange(len(own)) % several[pivot]
                columns = [pa.array(np.full(len(own), d), pa.int32()), pa.array(to, pa.int32()), pa.array(q.ids), batch.column("vs")[i].values.take(pa.array(own)), pa.array(q.least(np.arange(len(own))))]
                yield pa.RecordBatch.from_arrays(columns, names=["q_d", "q_group", "vec_id", "v", "beat"])

    queries = in_arrow(candidates.select("d", "pivot", "ids", "vs", "asks"), seeded, "q_d int, q_group int, vec_id long, v array<long>, beat long")
    queries = queries.groupBy("q_d", "q_group").agg(F.collect_list("vec_id").alias("q_ids"), F.collect_list("v").alias("q_vs"), F.collect_list("beat").alias("beat"))
    schema = "q_d int, q_group int, q_ids array<long>, q_vs array<array<long>>, beat array<long>"
    queries = scratch.write(_with_ball(queries, "q_ids", "q_vs", ("q_centre", "q_norm", "q_far"), schema).withColumn("least", F.array_min("beat").cast("double")), "queries")

    product = F.aggregate(F.zip_with("centre", "q_centre", lambda x, y: x * y), F.lit(0.0), lambda x, y: x + y)
    chance = bound(product, F.col("norm"), F.col("far"), F.col("q_norm"), F.col("q_far"), F.abs) >= F.col("least")
    held = queries.repartition(-(-n_groups // HELD), "q_d", "q_group")
    pairs = candidates.drop("asks").join(held.hint("shuffle_replicate_nl"), (F.col("d") == F.col("q_d")) & chance)  # few groups and a block at a time; never a broadcast

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asking: dict[tuple[int, int], Queries] = {}  # HELD, about
        at, points = None, None
        for batch in batches:
            keys, blocks = (list(zip(*(batch.column(c).to_pylist() for c in cs), strict=True)) for cs in (("q_d", "q_group"), ("d", "pivot", "piece")))
            for i in range(batch.num_rows):
                if blocks[i] != at:
                    at, points = blocks[i], Points(*_rows(batch, i, "ids", "vs"))
                if keys[i] not in asking:
                    asking[keys[i]] = Queries(*_rows(batch, i, "q_ids", "q_vs"), k, _array(batch, i, "beat"))
                asking[keys[i]].meet(points)
        for q in asking.values():
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in q.found()], names=["query_id", "vec_id", "score"])

    columns = ["d", "pivot", "piece", "ids", "vs", "q_d", "q_group", "q_ids", "q_vs", "beat"]
    found = in_arrow(pairs.select(*columns), met, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    ranked = scratch.write(ranked, "top")
    scratch.drop_others(ranked)
    return ranked
