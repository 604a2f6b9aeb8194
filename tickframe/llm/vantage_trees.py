"""Nearest neighbours by largest inner product, with vantage-point trees per shard.

Inner product is made a distance by one more coordinate: with M the largest norm, x becomes (x, sqrt(M^2 - |x|^2)) and a
query (q, 0), and the Euclidean distance between them falls as the inner product grows. Rows are dealt to cells by their
nearest pivot, and cells larger than a shard are split by a hash, so a cluster that holds a third of all rows is spread
over many shards. Each shard gets a vantage-point tree; a branch is skipped where the triangle inequality, relaxed by
``factor``, rules it out: at factor 1 the search is exact, above 1 it skips more. It is applied to lifted distances from
the vantage point, and to the vectors as they are: no member of a ball scores more than its centre by over the query's
length times the ball's radius. Equal vectors of a shard are one point with its smallest ids.

A query looks in its home shard first. Its k-th best there bounds what other cells must offer: a cell whose ball lies
beyond the bound is not visited, and the trees of the others begin with that bound. Distances use vectors divided by the
largest component, so no finite vector is out of their range; scores are those of the vectors as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import release, settle

SHARD_ROWS = 32_768
#: Cells at most, and rows that pivots are chosen from; cells need not be many, since large ones are split.
CELLS, PIVOT_ROWS = 256, 4_096
LEAF = 128
QUERY_BLOCK = 1_024
#: Distances closer than this (relative to M) count as equal in pruning, and scores as candidates for an exact look: rough scores are in single precision.
SLACK = 2e-5
RESULT = "query_id long, rank int, vec_id long, score double"


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, summed coordinate by coordinate in double precision: the same wherever a pair stands."""
    total = np.zeros(len(q))
    with np.errstate(over="ignore", invalid="ignore", under="ignore"):
        for j in range(q.shape[1]):
            total += q[:, j] * x[:, j]
    return total


def lift(x: np.ndarray, largest: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(0.0, largest * largest - (x**2).sum(axis=1)))[:, None]], axis=1)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (x**2).sum(axis=1)[:, None] + (y**2).sum(axis=1)[None, :] - 2 * x @ y.T))


@dataclass(frozen=True)
class Node:
    """Members within `ball` of centre, as they are; an inner node has those within radius of its vantage point, lifted, in near, the others in far."""

    centre: np.ndarray
    ball: float
    members: np.ndarray
    vantage: np.ndarray | None = None
    radius: float = 0.0
    near: Node | None = None
    far: Node | None = None


class Tree:
    """A vantage-point tree over points (double rows); ids and uids are those of the points' rows, smallest ids first.

    scale: the largest component of all vectors; largest: the largest norm of the vectors divided by it.
    """

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, uids: np.ndarray, k: int, scale: float, largest: float):
        order = np.lexsort((uids, ids, *vectors.T[::-1])) if len(ids) else np.zeros(0, np.int64)
        vectors = vectors[order]
        new = np.ones(len(ids), bool)
        new[1:] = (vectors[1:] != vectors[:-1]).any(axis=1)
        first = np.nonzero(new)[0]
        size = np.minimum(np.diff(np.append(first, len(ids))), k + 1)  # a point's own query is one of its rows at most
        self.k, self.largest, self.scale, self.scored = k, largest, scale, 0
        self.points = vectors[first]
        self.first = np.cumsum(size) - size
        self.size = size
        rows = order[np.repeat(first - self.first, size) + np.arange(size.sum())]
        self.ids, self.uids = ids[rows], uids[rows]
        scaled = self.points / scale
        self.rough = scaled.astype(np.float32)
        self.lifted = lift(scaled, largest)
        self.root = self._build(np.arange(len(first)))

    def _build(self, members: np.ndarray) -> Node:
        mine = self.lifted[members]
        centre = mine[:, :-1].mean(axis=0) if len(members) else np.zeros(self.lifted.shape[1] - 1)
        out = ((mine[:, :-1] - centre) ** 2).sum(axis=1)
        ball = float(np.sqrt(out.max(initial=0.0)))
        if len(members) <= LEAF:
            return Node(centre, ball, members)
        vantage = mine[int(np.argmax(out))]
        away = np.sqrt(((mine - vantage) ** 2).sum(axis=1))
        # The widest gap in the middle half of the distances, so that clusters stay whole.
        ranked = np.sort(away)[len(away) // 4 : len(away) - len(away) // 4]
        widest = int(np.argmax(np.diff(ranked)))
        radius = float(ranked[widest] + ranked[widest + 1]) / 2
        near = away <= radius
        if near.all() or not near.any():
            return Node(centre, ball, members)
        return Node(centre, ball, members, vantage, radius, self._build(members[near]), self._build(members[~near]))

    def search(self, queries: np.ndarray, own: np.ndarray, factor: float, limit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query's place, score, id) rows of the k best of each query, best first, ties to the smaller id.

        own: the queries' uids, which are left out. limit: a distance that the k-th best is known not to exceed; what
        lies beyond is not wanted.
        """
        scaled = queries / self.scale
        self._rough_queries = scaled.astype(np.float32)
        self._queries, self._own = queries, own
        self._lengths = np.sqrt((scaled**2).sum(axis=1))
        self._norms = self._lengths**2 + self.largest**2
        self._lifted = np.concatenate([scaled, np.zeros((len(queries), 1))], axis=1)
        self._slack = SLACK * (self.largest + self._lengths) ** 2
        self._limit = np.full(len(own), np.inf) if limit is None else limit + self._loose(limit)
        self._best: list[tuple[np.ndarray, np.ndarray, np.ndarray] | None] = [None] * len(own)
        if len(self.points) and len(own):
            self._home = np.zeros(len(own), np.int64)
            self._descend(self.root, np.arange(len(own)))
            self._sweep(self.root, np.arange(len(own)), factor)
        rows = [(np.full(len(b[0]), i), *b[:2]) for i, b in enumerate(self._best) if b is not None]
        return tuple(np.concatenate(x) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))

    def _loose(self, limit: np.ndarray) -> np.ndarray:
        """What a distance may be off by, given the slack in its square."""
        return np.where(np.isfinite(limit), np.sqrt(limit**2 + self._slack) - limit, 0.0)

    def _reach(self, who: np.ndarray) -> np.ndarray:
        """The scaled score that a wanted candidate has at least."""
        return np.where(np.isfinite(self._limit[who]), (self._norms[who] - np.minimum(self._limit[who], 1e150) ** 2) / 2, -np.inf)

    def _look(self, members: np.ndarray, who: np.ndarray) -> None:
        self.scored += len(members) * len(who)
        rough = self._rough_queries[who] @ self.rough[members].T
        reach = self._reach(who)
        new = np.nonzero(reach == -np.inf)[0]
        if len(new) and len(members) > self.k + 1:  # no bound yet: only the best of these members can count
            reach[new] = np.partition(rough[new], len(members) - self.k - 1, axis=1)[:, len(members) - self.k - 1]
        a, b = np.divmod(np.flatnonzero(rough >= (reach - self._slack[who]).astype(np.float32)[:, None]), len(members))
        if not len(a):
            return
        scores = exact_scores(self._queries[who[a]], self.points[members[b]])
        point = members[b]
        # Each point's rows, without the query's own.
        n = self.size[point]
        at = np.repeat(self.first[point] - np.cumsum(n) + n, n) + np.arange(n.sum())
        q, scores, ids, uids = np.repeat(a, n), np.repeat(scores, n), self.ids[at], self.uids[at]
        other = uids != self._own[who[q]]
        q, scores, ids, uids = q[other], scores[other], ids[other], uids[other]
        order = np.lexsort((uids, ids, -scores, q))
        q, scores, ids, uids = q[order], scores[order], ids[order], uids[order]
        cuts = np.append(np.nonzero(np.append(True, q[1:] != q[:-1]))[0], len(q)).tolist() if len(q) else [0]
        for i, lo, hi in zip(who[q[cuts[:-1]]].tolist(), cuts[:-1], cuts[1:], strict=True):
            hi = min(hi, lo + self.k)
            self._add(i, scores[lo:hi], ids[lo:hi], uids[lo:hi])

    def _add(self, i: int, scores: np.ndarray, ids: np.ndarray, uids: np.ndarray) -> None:
        before = self._best[i]
        if before is not None:
            if len(before[0]) == self.k and scores[0] < before[0][-1]:
                return
            scores, ids, uids = (np.concatenate(x) for x in zip(before, (scores, ids, uids), strict=True))
            order = np.lexsort((uids, ids, -scores))[: self.k]
            scores, ids, uids = scores[order], ids[order], uids[order]
        self._best[i] = scores, ids, uids
        if len(scores) == self.k:
            with np.errstate(over="ignore", invalid="ignore"):
                # The k-th best by distances in scaled vectors; sums that overflow bound nothing.
                last = float(scores[-1]) / self.scale / self.scale
            if np.isfinite(last):
                square = max(0.0, self._norms[i] - 2 * last) + self._slack[i]
                self._limit[i] = min(self._limit[i], np.sqrt(square))

    def _descend(self, node: Node, who: np.ndarray) -> None:
        """Each query at the leaf it falls into, for a first bound."""
        while node.vantage is not None and len(who):
            inside = ((self._lifted[who] - node.vantage) ** 2).sum(axis=1) <= node.radius**2
            self._descend(node.near, who[inside])
            node, who = node.far, who[~inside]
        if len(who):
            self._home[who] = id(node)
            self._look(node.members, who)

    def _sweep(self, node: Node, who: np.ndarray, factor: float) -> None:
        """All other leaves that the bounds do not rule out, each once for all its queries."""
        tiny = 1e-9 * (1 + self.largest)
        need = self._reach(who) - self._lifted[who, :-1] @ node.centre
        who = who[need * factor <= self._lengths[who] * node.ball + self._slack[who]]
        if node.vantage is None:
            who = who[self._home[who] != id(node)]
            if len(who):
                self._look(node.members, who)
            return
        beyond = (np.sqrt(((self._lifted[who] - node.vantage) ** 2).sum(axis=1)) - node.radius) * factor
        for child, gap in ((node.near, beyond), (node.far, -beyond)):
            go = who[gap <= self._limit[who] + tiny]
            if len(go):
                self._sweep(child, go, factor)


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id and vector (array<double>) of the rows that take part: not null, not zero, no null or non-finite component.

    Rows without an id take no part either. Components of any finite size count. Other columns are ignored.
    """
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("vector")).filter("id is not null and vector is not null")
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.coalesce(sound & F.exists("vector", lambda x: x != 0), F.lit(False)))


def matrix(column: pa.ListArray) -> np.ndarray:
    """List values of one length as rows."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


def _pivots(rows: DataFrame, cells: int, scale: float, largest: float) -> np.ndarray:
    """So many far-apart points, lifted, of a bounded sample: each next one is the farthest from those before."""
    sample = matrix(rows.select("vector", F.xxhash64("uid").alias("h")).orderBy("h").limit(PIVOT_ROWS).select("vector").toArrow().column(0).combine_chunks())
    points = lift(sample / scale, largest)
    chosen = [points[0]]
    away = ((points - chosen[0]) ** 2).sum(axis=1)
    while len(chosen) < cells and away.max() > 0:
        chosen.append(points[int(np.argmax(away))])
        away = np.minimum(away, ((points - chosen[-1]) ** 2).sum(axis=1))
    return np.array(chosen)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, factor: float = 1.0, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest rows of vectors by inner product, its own row left out.

    vectors: id and vector as usable() gives them. queries: a condition on their id, as a column, which says who asks.
    Vectors of another length than a query's are no candidates of it. Every other row is a candidate, rows that repeat an
    id or a vector too; ties go to the smaller id. Fewer than k other rows give all there are. A score beyond the range
    of doubles is infinite, as the sum is. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    base = settle(vectors.select("id", "vector", queries.alias("asks")).withColumn("uid", F.monotonically_increasing_id()))
    out = None
    for size, n in sorted(tuple(r) for r in base.groupBy(F.size("vector").alias("size")).count().collect()):
        found = _nearest(spark, base.filter(F.size("vector") == size), n, k, factor, shard_rows)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], RESULT) if out is None else out


def _nearest(spark: SparkSession, base: DataFrame, n: int, k: int, factor: float, shard_rows: int) -> DataFrame:
    """nearest for vectors of one length."""
    # A power of two, so that scaling changes no digit; a sum of squares then stays in range.
    scale = float(2.0 ** np.floor(np.log2(base.agg(F.max(F.array_max(F.transform("vector", F.abs)))).first()[0])))
    largest = base.agg(F.max(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + (x / scale) * (x / scale))))).first()[0]
    cells = min(CELLS, -(-n // shard_rows))
    pivots = _pivots(base, cells, scale, largest)

    def deal(batches):
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("vector"))
                away = distances(lift(x / scale, largest), pivots)
                cell = away.argmin(axis=1)
                off = np.sqrt(((x / scale - pivots[cell, :-1]) ** 2).sum(axis=1))
                yield pa.record_batch([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(off)], [*batch.schema.names, "cell", "away"])

    dealt = settle(base.mapInArrow(deal, "id long, vector array<double>, asks boolean, uid long, cell int, away double"))
    told = sorted(tuple(r) for r in dealt.groupBy("cell").agg(F.count("*"), F.max("away")).collect())  # one row per cell
    radii = np.array([r for _, _, r in told])
    centres = pivots[[c for c, _, _ in told], :-1]
    parts = [-(-m // shard_rows) for _, m, _ in told]
    first = np.cumsum([0, *parts])
    shards = int(first[-1])
    where = {c: (int(first[i]), parts[i]) for i, (c, _, _) in enumerate(told)}

    def shard_of(batches):
        for batch in batches:
            cell, uid = batch.column("cell").to_pylist(), batch.column("h").to_pylist()
            yield pa.record_batch([pa.array([where[c][0] + u % where[c][1] for c, u in zip(cell, uid, strict=True)], pa.int32()), *[batch.column(c) for c in ("id", "vector", "asks", "uid")]], ["shard", "id", "vector", "asks", "uid"])

    rows = settle(dealt.withColumn("h", F.xxhash64("uid")).mapInArrow(shard_of, "shard int, id long, vector array<double>, asks boolean, uid long"))
    release(dealt)
    owned = rows.select("shard", F.lit(0).alias("part"), "id", "vector", "uid", F.lit(None).cast("double").alias("limit"))
    asked = rows.filter("asks").select("shard", F.lit(1).alias("part"), "id", "vector", "uid", F.lit(float("inf")).alias("limit"))
    first_answers = settle(_answers(owned.unionByName(asked), shards, k, factor, scale, largest))
    rank = F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("score"), "vec_id"))
    if shards > 1:
        bound = first_answers.groupBy("uid").agg(F.count("*").alias("n"), F.min("score").alias("least")).withColumn("least", F.when(F.col("n") >= k, F.col("least"))).select("uid", "least")
        asking = rows.filter("asks").join(bound, "uid", "left").select("shard", "id", "vector", "uid", "least")

        def visits(batches):
            """Each query at every other shard that may hold one of its nearest."""
            cell_of = np.repeat(np.arange(len(parts)), parts)
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = matrix(batch.column("vector")) / scale
                lengths = np.sqrt((x**2).sum(axis=1))
                slack = SLACK * (largest + lengths) ** 2
                least = batch.column("least").to_numpy(zero_copy_only=False).astype(np.float64) / scale / scale
                least = np.where(np.isfinite(least), least, -np.inf)
                limit = np.sqrt(np.maximum(0.0, lengths**2 + largest**2 - 2 * least) + slack)
                reach = (least[:, None] - x @ centres.T) * factor <= lengths[:, None] * radii[None, :] + slack[:, None]
                q, shard = np.nonzero(reach[:, cell_of])
                other = shard != batch.column("shard").to_numpy()[q]
                q, shard = q[other], shard[other]
                for lo in range(0, len(q), 8192):
                    at = pa.array(q[lo : lo + 8192])
                    yield pa.record_batch([pa.array(shard[lo : lo + 8192].astype(np.int32)), *[batch.column(c).take(at) for c in ("id", "vector", "uid")], pa.array(limit[q[lo : lo + 8192]])], ["shard", "id", "vector", "uid", "limit"])

        going = asking.mapInArrow(visits, "shard int, id long, vector array<double>, uid long, limit double").select("shard", F.lit(1).alias("part"), "id", "vector", "uid", "limit")
        first_answers = first_answers.unionByName(_answers(owned.unionByName(going), shards, k, factor, scale, largest))
    return first_answers.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _answers(laid: DataFrame, shards: int, k: int, factor: float, scale: float, largest: float) -> DataFrame:
    """uid, query_id, vec_id, score: for each query (part 1) its best k of each shard (part 0) it is at."""

    def answer(batches):
        shard, tree = None, None
        held: list[tuple] = []
        asked: list[tuple] = []
        n_asked = 0

        def columns(of: list[tuple]) -> tuple[np.ndarray, ...]:
            return tuple(np.concatenate(x) for x in zip(*of, strict=True))

        def reply():
            nonlocal n_asked
            x, ids, uids, limit = columns(asked)
            asked.clear()
            n_asked = 0
            q, scores, found = tree.search(x, uids, factor, limit)
            if len(q):
                yield pa.record_batch([pa.array(uids[q]), pa.array(ids[q]), pa.array(found), pa.array(scores)], ["uid", "query_id", "vec_id", "score"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, part = batch.column("shard").to_numpy(), batch.column("part").to_numpy()
            x = matrix(batch.column("vector"))
            ids, uids, limit = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "uid", "limit"))
            cuts = [0, *(np.nonzero((keys[1:] != keys[:-1]) | (part[1:] != part[:-1]))[0] + 1).tolist(), len(keys)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if keys[lo] != shard:
                    if asked:
                        yield from reply()
                    shard, tree, held = keys[lo], None, []
                if part[lo] == 0:
                    held.append((x[lo:hi], ids[lo:hi], uids[lo:hi]))
                    continue
                if tree is None:
                    tree = Tree(*columns(held), k, scale, largest)
                    held = []
                for at in range(lo, hi, QUERY_BLOCK):
                    asked.append((x[at : min(hi, at + QUERY_BLOCK)], ids[at : min(hi, at + QUERY_BLOCK)], uids[at : min(hi, at + QUERY_BLOCK)], limit[at : min(hi, at + QUERY_BLOCK)].astype(np.float64)))
                    n_asked += len(asked[-1][0])
                    if n_asked >= QUERY_BLOCK:
                        yield from reply()
        if asked:
            yield from reply()

    placed = laid.repartition(shards, "shard").sortWithinPartitions("shard", "part")
    return placed.mapInArrow(answer, "uid long, query_id long, vec_id long, score double")
