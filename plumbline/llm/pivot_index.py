"""Embedding near-duplicates by a pivot-permutation index.

Reference points (pivots) are spread over a bounded sample by farthest-first choice; their number grows with the table, so that
the lists stay short.  Every vector is described by its ``prefix`` nearest pivots in order, and entered in the inverted list of
each.  In a list, shared pivots are counted through the lists of the other pivots; two vectors of one label that share at least
``shared`` pivots are candidates, and only these are verified, by cosine in double precision, in the list of the first pivot they
share, so each pair is looked at once.  Long lists are cut into blocks, and each pair of blocks is a task of its own; a list
returns per vector its number of links and a root, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, batch, connected_components, cut, discard, local_roots, partitions, with_weighted
from .vectors import matrix, usable

#: Vectors to a pivot, and the least and the greatest number of pivots; they are chosen from a sample of twice their number.
PER_PIVOT, LEAST_PIVOTS, MOST_PIVOTS = 64, 64, 8192
#: Pivots that describe a vector, and how many two candidates share.
PREFIX, SHARED = 8, 2
#: Vectors of a block of a list.
BLOCK = 1024
LEAST = 0.93


def farthest_first(x: np.ndarray, n: int) -> np.ndarray:
    """``n`` of the unit rows of ``x``, each the farthest from those before it, starting at the first."""
    pick, near = [0], x @ x[0]
    while len(pick) < min(n, len(x)):
        i = int(near.argmin())
        if near[i] > 1 - 1e-12:
            break
        pick.append(i)
        near = np.maximum(near, x @ x[i])
    return x[pick]


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x**2).sum(1, keepdims=True))


def permutations(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Numbers of the nearest pivots of each unit row, nearest first, ties to the smaller number."""
    return np.argsort(-(x @ pivots.T).round(12), axis=1, kind="stable")[:, :prefix].astype(np.int32)


def candidates(pivot: int, left: np.ndarray, right: np.ndarray | None, shared: int) -> np.ndarray:
    """Which pairs of two blocks of one pivot's list share at least ``shared`` pivots and none below ``pivot``, as a mask.  The
    blocks are given by their prefixes; without ``right`` the pairs are those of ``left``, each once."""

    def lists(perm: np.ndarray) -> dict[int, np.ndarray]:
        flat = perm.ravel()
        order = np.argsort(flat, kind="stable")
        q, at = np.unique(flat[order], return_index=True)
        return dict(zip(q.tolist(), np.split(order // perm.shape[1], at[1:])))

    own = lists(left)
    other = own if right is None else lists(right)
    count = np.ones((len(left), len(left if right is None else right)), np.uint8)
    for q in own.keys() & other.keys():
        if q > pivot:
            count[np.ix_(own[q], other[q])] += 1
    for q in own.keys() & other.keys():
        if q < pivot:
            count[np.ix_(own[q], other[q])] = 0
    out = count >= shared
    return np.triu(out, 1) if right is None else out


def verified(cand: np.ndarray, v: np.ndarray, rv: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The candidate pairs with cosine >= ``least`` of unit rows, part by part."""
    dense = cand.sum() * 4 > cand.size
    for lo in range(0, len(v), 128):
        a, b = np.nonzero(cand[lo : lo + 128])
        if not len(a):
            continue
        near = (v[lo : lo + 128] @ rv.T)[a, b] if dense else np.einsum("ij,ij->i", v[lo + a], rv[b])
        edge = np.abs(near - least) < 1e-9  # at the threshold itself: in one fixed order of summation
        near[edge] = (v[lo + a[edge]] * rv[b[edge]]).sum(1)
        hit = near >= least
        if hit.any():
            yield lo + a[hit], b[hit]


def pivot_links(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str | None = "label", least: float = LEAST, pivots: int | None = None, prefix: int = PREFIX, shared: int = SHARED) -> DataFrame:
    """Links between vectors of equal label with cosine >= ``least``: one row per input row,
    ``vec_id, n_links, component_id, kept``.

    Equal vectors of a label form a class, of which the smallest id is compared; ``n_links`` counts all rows linked directly.
    ``pivots`` is their number, by default one for ``PER_PIVOT`` classes.  Vectors that are null, empty, zero or hold null or
    non-finite components, and those of a null label, link with nothing and are their own component; only vectors of equal
    length are compared.  A null id links with nothing and is kept.  Rows that repeat an id are one vertex.  Other columns are
    not read.  An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    width = partitions(spark)
    label = F.col(label_col) if label_col else F.lit(0)
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v"), label.alias("label"))
    base = base.withColumn("ok", usable("v") & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    key = [F.xxhash64("label", "v").alias("h"), F.hash("label", "v").alias("g")]  # 96 bits name a class
    reps = base.where("ok").select("vec_id", "v", "label", *key).groupBy("label", "v", "h", "g").agg(F.min("vec_id").alias("node"), F.count("*").alias("weight"))
    reps = cut(reps, "vectors")

    size = reps.agg(F.count("*").alias("n"), F.coalesce(F.sum("weight"), F.lit(0)).alias("rows")).first()
    pivots = pivots or min(MOST_PIVOTS, max(LEAST_PIVOTS, size.n // PER_PIVOT))
    sample = reps.orderBy(F.xxhash64("node", "h"), "node").limit(2 * pivots).select("v").collect()
    by_dim: dict[int, list] = {}
    for r in sample:
        by_dim.setdefault(len(r.v), []).append(r.v)
    points = {d: farthest_first(unit(np.array(x, np.float64)), pivots) for d, x in by_dim.items()}
    # a length that the sample lacks is rare: its vectors get one list

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(0)
            length = v.value_lengths().to_numpy()
            perm: list = [None] * len(v)
            for d in np.unique(length):
                rows = np.flatnonzero(length == d)
                if d in points:
                    p = permutations(unit(matrix(v.take(pa.array(rows)))), points[d], prefix)
                else:
                    p = np.zeros((len(rows), 1), np.int32)
                for r, x in zip(rows, p):
                    perm[r] = x
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(perm, pa.list_(pa.int32()))], ["v", "label", "h", "g", "node", "weight", "perm"])

    kind = reps.schema["label"].dataType.simpleString()
    element = reps.schema["v"].dataType.simpleString()
    index = cut(arrow_map(reps.select("v", "label", "h", "g", "node", "weight"), describe, f"v {element}, label {kind}, h long, g int, node long, weight long, perm array<int>"), "index")
    discard(reps)
    lists = index.withColumn("dim", F.size("v")).withColumn("pivot", F.explode("perm"))
    sizes = cut(lists.groupBy("label", "dim", "pivot").agg(F.count("*").alias("size")).where("size > 1").withColumn("cuts", F.ceil(F.col("size") / BLOCK).cast("int")), "lists")
    lists = with_weighted(lists, sizes, ["label", "dim", "pivot"], "size", prefix * size.n, "inner")
    lists = lists.withColumn("me", F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    tile = ["label", "dim", "pivot", "i", "j"]
    tiles = lists.select("label", "dim", "pivot", F.least("me", "other").alias("i"), F.greatest("me", "other").alias("j"), "me", "node", "weight", "v", "perm")

    def run(t: pa.Table) -> pa.Table:
        pivot, i, j = (t.column(c)[0].as_py() for c in ("pivot", "i", "j"))
        node, weight, me = (t.column(c).to_numpy() for c in ("node", "weight", "me"))
        v, perm = unit(matrix(t.column("v"))), matrix(t.column("perm")).astype(np.int32)
        side = np.argsort(me, kind="stable")
        node, weight, me, v, perm = node[side], weight[side], me[side], v[side], perm[side]
        k = int((me == i).sum())
        links, a, b = np.zeros(len(node), np.int64), [], []
        if k and (i == j or k < len(node)):
            few = min(shared, perm.shape[1])
            cand, right, shift = (candidates(pivot, perm, None, few), v, 0) if i == j else (candidates(pivot, perm[:k], perm[k:], few), v[k:], k)
            for x, y in verified(cand, v[:k], right, least):
                y = y + shift
                np.add.at(links, x, weight[y]), np.add.at(links, y, weight[x])
                a.append(x), b.append(y)
        if not a:
            return pa.Table.from_batches([batch(node=pa.array([], pa.int64()), root=pa.array([], pa.int64()), links=pa.array([], pa.int64()))])
        root = local_roots(np.concatenate(a), np.concatenate(b), len(node))
        keep = links > 0
        return pa.Table.from_batches([batch(node=node[keep], root=node[root[keep]], links=links[keep])])

    found = cut(tiles.repartition(width, *tile).groupBy(*tile).applyInArrow(run, "node long, root long, links long"), "links")
    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    whole = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    of = index.select("h", "g", "node", "weight").join(linked, "node", "left").join(whole, "node", "left")
    of = cut(of.select("h", "g", "weight", F.coalesce("comp", "node").alias("comp"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links")), "classes")
    discard(index), discard(sizes), discard(found)
    rows = base.select("vec_id", *[F.when(F.col("ok"), c).alias(n) for c, n in zip(key, ("h", "g"))])
    out = with_weighted(rows, of, ["h", "g"], "weight", size.rows)
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("comp", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op6_pivot_dedup(spark, sf_dir: str) -> DataFrame:
    return pivot_links(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))


OP6_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach(vec_id, r) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.vec_id, l.b FROM reach JOIN l ON reach.r = l.a),
c AS (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY 1),
d AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY 1)
SELECT c.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN d USING (vec_id)
"""
