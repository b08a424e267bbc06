"""Nearest neighbours by largest inner product: a vantage-point tree per shard.

Vectors are dealt by region, the nearest of some centres of a bounded sample, and regions are cut into shards.  A query first
searches a shard of its own region; the k-th score it finds there is a floor for all others, and only shards whose region, a ball
around its centre, may hold a better one are searched.  In a shard, vectors get one more coordinate, ``sqrt(M^2 - |x|^2)`` with M
their largest norm, queries a zero: then the largest inner product is the smallest Euclidean distance.  The tree parts vectors by
their distance from a vantage point; a subtree knows the least and greatest distance of its vectors from every vantage point of the
shard and from one of its own, and the triangle inequality bounds how near it can come to a query.  ``factor`` multiplies every such
bound, of a region or a subtree, before it is held against the k-th distance so far: above 1 the search is faster and approximate, at
1 it is exact.  All queries of a block go down the tree together, so the work is in matrix products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, batch, cut, discard, partitions
from .vectors import matrix, usable

#: Vectors of a shard, queries of a block, vectors of a leaf.
SHARD_ROWS, QUERY_ROWS, LEAF = 4096, 4096, 16
#: The subtree that a query scores first holds up to so many times as many vectors as it asks for.
HOME = 3
#: Vantage points of a shard, each the farthest from those before; a subtree has one of its own besides.
VANTAGES = 96
#: Most regions, and the vectors of the sample that their centres come from for each of them.
MOST_REGIONS, PER_REGION = 1024, 8
#: Lists of results that are merged at once.
MERGE = 64
#: Relaxation in production: exact.
FACTOR = 1.0


class _Node:
    """A subtree: its points, how far they lie from each vantage point of the shard and from one of their own, and two halves."""

    __slots__ = ("points", "low", "high", "own", "own_low", "own_high", "kids")

    def __init__(self, x: np.ndarray, away: np.ndarray, points: np.ndarray, leaf: int):
        self.points, self.kids = points, ()
        if not len(points):
            return
        mine, seen = x[points], away[points]
        self.low, self.high = seen.min(0), seen.max(0)
        self.own = mine[((mine - mine.mean(0)) ** 2).sum(1).argmin()]
        d = np.sqrt(((mine - self.own) ** 2).sum(1))
        self.own_low, self.own_high = d.min(), d.max()
        if len(points) <= leaf:
            return
        by = seen[:, seen.std(0).argmax()] if seen.shape[1] and seen.std(0).max() >= d.std() else d  # the vantage point that tells them best apart
        order = np.argsort(by, kind="stable")
        if by[order[0]] == by[order[-1]]:  # all alike: nothing to tell them apart by
            return
        gaps = np.diff(by[order])
        lo = len(order) // 4
        half = lo + int(gaps[lo : len(order) - lo - 1].argmax()) + 1  # the widest gap of the middle half
        self.kids = (_Node(x, away, points[order[:half]], leaf), _Node(x, away, points[order[half:]], leaf))


class Search:
    """The ``k`` best candidates of each query in one shard.  ``visited`` counts query-candidate pairs that were scored."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int = LEAF, vantages: int = VANTAGES):
        self.ids, self.x = ids, x
        norm = (x**2).sum(1)
        self.top = norm.max() if len(x) else 0.0
        wide = np.c_[x, np.sqrt(np.maximum(self.top - norm, 0))]
        away, chosen = np.zeros((len(x), 0)), []
        nearest = ((wide - wide.mean(0)) ** 2).sum(1) if len(x) else np.zeros(0)
        while len(chosen) < min(vantages, len(x)):  # each the farthest from those before
            chosen.append(wide[nearest.argmax()])
            d = ((wide - chosen[-1]) ** 2).sum(1)
            nearest = d if len(chosen) == 1 else np.minimum(nearest, d)
            away = np.c_[away, np.sqrt(d)]
        self.vantages = np.array(chosen).reshape(len(chosen), wide.shape[1])
        self.root = _Node(wide, away, np.arange(len(x)), leaf)
        self.visited = 0

    def query(self, qid: np.ndarray, q: np.ndarray, k: int, factor: float = 1.0, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: none) and scores, best first, ties to the smaller id; a candidate with the query's own id takes no part.
        Candidates below a query's ``floor`` may be left out."""
        self.qid, self.q, self.k, self.factor = qid, q, k, factor
        self.floor = np.full(len(q), -np.inf) if floor is None else floor
        self.qn = (q**2).sum(1)
        self.slack = 1e-12 * np.sqrt(self.qn * max(self.top, 1e-300))
        self.blur = 1e-7 * np.sqrt(self.qn + self.top)  # what rounding may add to a distance
        self.best = np.full((len(q), k), -np.inf)
        self.at = np.full((len(q), k), -1)
        self.seen = self._away(np.arange(len(q)), self.vantages)
        self.kth = np.full(len(q), -np.inf)
        self.home = np.zeros(len(q), np.int64)
        if len(self.x):
            self._descend(self.root, np.arange(len(q)))
            self._down(self.root, np.arange(len(q)))
        score = np.where(self.at >= 0, self._exact(np.repeat(np.arange(len(q)), k), self.at.ravel()).reshape(self.at.shape), -np.inf)
        ids = np.where(self.at >= 0, self.ids[self.at] if len(self.ids) else -1, -1)
        order = np.lexsort((ids, -score), axis=1)
        return np.take_along_axis(ids, order, 1), np.take_along_axis(score, order, 1)

    def _exact(self, rows: np.ndarray, points: np.ndarray) -> np.ndarray:
        """Inner products summed in one order whatever the block, so that equal vectors score alike."""
        return np.add.accumulate(self.q[rows] * self.x[points], axis=1)[:, -1]

    def _far(self, rows: np.ndarray) -> np.ndarray:
        """How far the k-th found, or the floor, is."""
        return np.sqrt(np.maximum(self.qn[rows] + self.top - 2 * np.maximum(self.kth[rows], self.floor[rows]), 0))

    def _away(self, rows: np.ndarray, points: np.ndarray) -> np.ndarray:
        """Distances of queries from vantage points; a query has a zero more."""
        return np.sqrt(np.maximum(self.qn[rows][:, None] + (points**2).sum(1)[None, :] - 2 * self.q[rows] @ points[:, :-1].T, 0))

    def _bound(self, node: _Node, rows: np.ndarray) -> np.ndarray:
        """What the triangle inequality leaves between the queries and every point of a subtree, over all vantage points."""
        seen, own = self.seen[rows], self._away(rows, node.own[None, :])[:, 0]
        least = np.maximum(own - node.own_high, node.own_low - own)
        if seen.shape[1]:
            least = np.maximum(least, np.maximum(seen - node.high, node.low - seen).max(1))
        return np.maximum(least - self.blur[rows], 0) * self.factor

    def _descend(self, node: _Node, rows: np.ndarray) -> None:
        """Score for each query the small subtree whose vantage points it is nearest to: the k-th score there is its first bound."""
        if not len(rows):
            return
        if not node.kids or len(node.points) <= HOME * self.k:
            self.home[rows] = id(node)
            self._score_all(node.points, rows)
            return
        left, right = (self._away(rows, kid.own[None, :])[:, 0] for kid in node.kids)
        self._descend(node.kids[0], rows[left <= right])
        self._descend(node.kids[1], rows[left > right])

    def _down(self, node: _Node, rows: np.ndarray) -> None:
        """Search a subtree for the queries that its bounds let in, but for those that have scored it."""
        rows = rows[self.home[rows] != id(node)]
        if not len(rows):
            return
        if not node.kids:
            self._score_all(node.points, rows)
            return
        for kid in node.kids:
            self._down(kid, rows[self._bound(kid, rows) <= self._far(rows) + self.blur[rows]])

    def _score_all(self, points: np.ndarray, rows: np.ndarray) -> None:
        for lo in range(0, len(points), 1024):
            self._score(points[lo : lo + 1024], rows)

    def _score(self, points: np.ndarray, rows: np.ndarray) -> None:
        s = self.q[rows] @ self.x[points].T
        self.visited += s.size
        s[self.qid[rows][:, None] == self.ids[points][None, :]] = -np.inf
        better = s.max(1) >= np.maximum(self.kth[rows], self.floor[rows]) - self.slack[rows]
        rows, s = rows[better], s[better]
        if not len(rows):
            return
        s = np.c_[self.best[rows], s]
        at = np.c_[self.at[rows], np.broadcast_to(points, (len(rows), len(points)))]
        pick = np.argpartition(s, -self.k, axis=1)[:, -self.k :]
        kth = np.take_along_axis(s, pick, 1).min(1) - self.slack[rows]
        self.best[rows], self.at[rows] = np.take_along_axis(s, pick, 1), np.take_along_axis(at, pick, 1)
        for r in np.flatnonzero(((s >= kth[:, None]) & (at >= 0)).sum(1) > self.k):  # ties at the edge: exactly, and by id
            p = at[r][(s[r] >= kth[r]) & (at[r] >= 0)]
            e = self._exact(np.full(len(p), rows[r]), p)
            e[self.ids[p] == self.qid[rows[r]]] = -np.inf
            o = np.lexsort((self.ids[p], -e))[: self.k]
            self.best[rows[r]], self.at[rows[r]] = e[o], p[o]
        self.at[rows] = np.where(np.isneginf(self.best[rows]), -1, self.at[rows])
        self.kth[rows] = self.best[rows].min(1)


def centres(x: np.ndarray, n: int, rounds: int = 6) -> np.ndarray:
    """``n`` means of a sample's rows by a few rounds of nearest assignment, starting at evenly spaced rows."""
    c = x[np.linspace(0, len(x) - 1, n).astype(int)]
    for _ in range(rounds if n > 1 else 1):
        near = ((c**2).sum(1)[None, :] / 2 - x @ c.T).argmin(1)
        c = np.stack([x[near == i].mean(0) if (near == i).any() else c[i] for i in range(n)])
    return c


def _regions(vectors: DataFrame, points: dict[int, np.ndarray]) -> DataFrame:
    """``(id, v, dim)`` with the region of each vector, its distance from the centre and its norm; lengths without centres have one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, dim = b.column("v"), b.column("dim").to_numpy()
            region, away, norm = np.zeros(len(v), np.int32), np.zeros(len(v)), np.zeros(len(v))
            for d in np.unique(dim):
                rows = np.flatnonzero(dim == d)
                x = matrix(v.take(pa.array(rows)))
                c = points.get(int(d), np.zeros((1, int(d))))
                region[rows] = ((c**2).sum(1)[None, :] / 2 - x @ c.T).argmin(1)
                away[rows] = np.sqrt(((x - c[region[rows]]) ** 2).sum(1))
                norm[rows] = np.sqrt((x**2).sum(1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(region), pa.array(away), pa.array(norm)], [*b.schema.names, "region", "away", "norm"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema.fields)
    return arrow_map(vectors, run, ddl + ", region int, away double, norm double")


_FOUND = "query_id long, dim int, shard long, found array<struct<s:double,id:long>>"


def _search(x: DataFrame, q: DataFrame, k: int, factor: float) -> DataFrame:
    """The best ``k`` of each pair of a query and a shard: ``q`` is ``(dim, shard, block, id, v, floor)``, ``x`` is ``(dim, shard, id,
    v)``.  A shard goes to the blocks that visit it, and each shard and block is one group."""
    none = pa.Table.from_batches([batch(query_id=pa.array([], pa.int64()), dim=pa.array([], pa.int32()), shard=pa.array([], pa.int64()), found=pa.array([], pa.list_(pa.struct([("s", pa.float64()), ("id", pa.int64())]))))])

    def run(t: pa.Table) -> pa.Table:
        ask = t.column("ask").to_numpy()
        ids, v, floor = t.column("id").to_numpy(), t.column("v").combine_chunks(), t.column("floor").to_numpy()
        xi, xv, qi, qv = ids[~ask], matrix(v.filter(pa.array(~ask))), ids[ask], matrix(v.filter(pa.array(ask)))
        if not len(qi) or not len(xi):
            return none
        got, score = Search(xi, xv).query(qi, qv, min(k, len(xi)), factor, floor[ask])
        keep = (got >= 0) & (score >= floor[ask][:, None])
        n = keep.sum(1)
        flat = pa.StructArray.from_arrays([pa.array(-score[keep]), pa.array(got[keep])], ["s", "id"])
        found = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), flat)
        dim, shard = t.column("dim")[0].as_py(), t.column("shard")[0].as_py()
        out = batch(query_id=qi, dim=pa.array([dim] * len(qi), pa.int32()), shard=pa.array([shard] * len(qi), pa.int64()), found=found)
        return pa.Table.from_batches([out.filter(pa.array(n > 0))])

    tile = ["dim", "shard", "block"]
    both = x.select("dim", "shard", "id", "v").join(q.select(*tile).distinct(), ["dim", "shard"]).withColumn("floor", F.lit(0.0)).withColumn("ask", F.lit(False))
    both = both.unionByName(q.select(*tile, "id", "v", "floor").withColumn("ask", F.lit(True)))
    return both.repartition(partitions(x.sparkSession), *tile).groupBy(*tile).applyInArrow(run, _FOUND)


def _merged(found: DataFrame, by: list[str | Column], k: int) -> DataFrame:
    best = F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, k).alias("found")
    return found.groupBy(*by).agg(best)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", factor: float = FACTOR, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """The ``k`` vectors of largest inner product for each query: ``query_id, rank, vec_id, score``.

    A query's own id is no candidate for it; ties go to the smaller id; with fewer candidates than ``k`` all are returned.  Only
    vectors of a query's length are candidates for it.  Vectors or ids that are null, and vectors that are empty, zero or hold
    null or non-finite components, take no part.  Rows that repeat an id and a length count once (the least vector).  Other
    columns are not read.  Empty tables give an empty result.
    """
    pick = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"), F.size(vec_col).alias("dim")).where(usable("v") & F.col("id").isNotNull()).groupBy("id", "dim").agg(F.min("v").alias("v"))
    x = cut(pick(vectors), "vectors")
    q = pick(queries)
    n = x.count()
    regions = min(MOST_REGIONS, max(1, n // shard_rows))
    points: dict[int, np.ndarray] = {}
    if regions > 1:
        by_dim: dict[int, list] = {}
        for r in x.orderBy(F.xxhash64("id"), "id").limit(PER_REGION * regions).select("v").collect():
            by_dim.setdefault(len(r.v), []).append(r.v)
        points = {d: centres(np.array(v, np.float64), min(regions, len(v))) for d, v in by_dim.items()}
    x, old = cut(_regions(x, points), "regions"), x
    discard(old)
    # at most MOST_REGIONS rows for each length of vectors
    ball = x.groupBy("dim", "region").agg(F.count("*").alias("n"), F.max("away").alias("radius"), F.max("norm").alias("top"))
    ball = cut(ball.withColumn("shards", F.ceil(F.col("n") / shard_rows).cast("long")), "balls")
    most = ball.agg(F.coalesce(F.sum("shards"), F.lit(0))).first()[0]
    code = lambda region, part: region.cast("long") * F.lit(1 << 32) + part
    x = x.join(F.broadcast(ball.select("dim", "region", "shards")) if ball.count() <= 2 * MOST_REGIONS else ball.select("dim", "region", "shards"), ["dim", "region"])
    x = x.withColumn("shard", code(F.col("region"), F.pmod(F.xxhash64("id"), F.col("shards"))))
    blocks = max(1, -(-q.count() // query_rows))
    q = q.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    if most > 1:
        q = cut(_regions(q, points), "queries")
        part = F.pmod(F.xxhash64("id"), F.col("shards"))
        home = q.join(ball.select("dim", "region", "shards"), ["dim", "region"]).withColumn("shard", code(F.col("region"), part)).withColumn("floor", F.lit(float("-inf")))
    else:
        home = q.join(x.select("dim", "shard").distinct(), "dim").withColumn("floor", F.lit(float("-inf")))
    found = _search(x, home, k, factor)
    if most > 1:
        found = cut(found, "home")
        floor = found.select(F.col("query_id").alias("id"), "dim", F.col("shard").alias("done"), F.when(F.size("found") == k, -F.element_at("found", -1)["s"]).alias("floor"))
        q = q.join(floor, ["id", "dim"], "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
        visits = _visits(q.drop("region", "away"), ball, points, factor)
        found = found.unionByName(_search(x, visits, k, factor))
        if most > MERGE:
            found = _merged(found, ["query_id", "dim", F.pmod(F.xxhash64("shard"), F.lit(-(-most // MERGE))).alias("part")], k)
    merged = _merged(found, ["query_id"], k)
    return merged.select("query_id", F.posexplode("found").alias("p", "f")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("f.id").alias("vec_id"), (-F.col("f.s")).alias("score"))


def _visits(q: DataFrame, ball: DataFrame, points: dict[int, np.ndarray], factor: float) -> DataFrame:
    """A row per query and shard that may hold a better candidate than the query's floor, but for the shard that is ``done``.

    No vector of a region has an inner product above the query's with the centre plus its norm times the radius, nor above the
    product of the norms; both bounds are held, as distances, against the floor's."""
    balls = ball.groupBy("dim").agg(F.collect_list(F.struct("region", "radius", "top", "shards")).alias("balls"))
    rows = q.join(balls, "dim")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, dim, floor, norm = b.column("v"), b.column("dim").to_numpy(), b.column("floor").to_numpy(), b.column("norm").to_numpy()
            row, region, shards = [], [], []
            for d in np.unique(dim):
                at = np.flatnonzero(dim == d)
                ball = b.column("balls")[int(at[0])].as_py()
                r, radius, top, count = (np.array([x[c] for x in ball]) for c in ("region", "radius", "top", "shards"))
                c = points.get(int(d), np.zeros((1, int(d))))[r]
                qn = norm[at][:, None]
                best = np.minimum(matrix(v.take(pa.array(at))) @ c.T + qn * radius, qn * top)
                m2 = top.max() ** 2
                far = lambda s: np.sqrt(np.maximum(qn**2 + m2 - 2 * s, 0))  # noqa: B023,E731
                keep = far(best) * factor <= far(np.maximum(floor[at][:, None], -1e300)) * (1 + 1e-9) + 1e-9
                keep |= np.isneginf(floor[at])[:, None]
                i, j = np.nonzero(keep)
                row.append(at[i]), region.append(r[j]), shards.append(count[j])
            row, region, shards = (np.concatenate(x) for x in (row, region, shards))
            for lo in range(0, len(row), 4096):
                part = b.select(["id", "dim", "v", "block", "floor", "done"]).take(pa.array(row[lo : lo + 4096]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(region[lo : lo + 4096], pa.int32()), pa.array(shards[lo : lo + 4096], pa.int64())], [*part.schema.names, "region", "shards"])

    element = q.schema["v"].dataType.simpleString()
    out = arrow_map(rows.select("id", "dim", "v", "block", "floor", "done", "norm", "balls"), run, f"id long, dim int, v {element}, block int, floor double, done long, region int, shards long")
    out = out.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)))
    out = out.withColumn("shard", F.col("region").cast("long") * F.lit(1 << 32) + F.col("part"))
    return out.select("id", "dim", "v", "block", "floor", "done", "shard").where("done is null or shard <> done")


def op9_vp_tree_search(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))


OP9_SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 20
"""
