"""Prefix trie of conversations by Patricia construction.

Each conversation is a key: the 16-byte hashes of its turns, one after the other.  Keys are sorted over the cluster by key and id,
so that equal and alike conversations are neighbours however many there are.  Every task walks its sorted keys once with a stack and
makes points only where keys branch or end, and leaves; an edge may span many turns.  Aggregates are summed on these points, and when
a point is left its edge is expanded to its unary nodes by sums from the edge's lower end.

Nodes that more than one task may see are prefixes of the first or last key of a task.  Tasks report their share of these, at most two
paths each; the shares are summed by node and the totals of subtrees are gathered along the paths by doubling steps.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, cut, discard, partitions, small

WIDTH = 16
#: Characters of ids that a task gathers before it passes them on as a piece of a longer list.
PIECE = 1 << 16
EMPTY = hashlib.sha256(b"").hexdigest()
_FINAL, _UNDER_SHARED, _SHARED, _IDS = range(4)
_FIELDS = {
    "kind": pa.int32(), "p": pa.binary(), "up": pa.binary(), "conv_id": pa.int64(), "depth": pa.int64(), "parent_conv_id": pa.int64(), "n_convs": pa.int64(),
    "n_children": pa.int64(), "n_leaves": pa.int64(), "saved_tokens": pa.int64(), "ends_sha256": pa.string(), "turn": pa.binary(), "chars": pa.int64(), "ids": pa.string(),
}
_DDL = ", ".join(f"{c} {'string' if pa.types.is_string(t) else 'binary' if pa.types.is_binary(t) else 'int' if t == pa.int32() else 'long'}" for c, t in _FIELDS.items())
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "turn"]


def common(a: bytes, b: bytes) -> int:
    """Turns that two keys share from the start."""
    n = min(len(a), len(b))
    apart = np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)
    return int(apart.argmax() if apart.any() else n) // WIDTH


def paths(key: bytes) -> list[bytes]:
    """A hash of every prefix of a key, that of no turn first."""
    h = hashlib.blake2b(digest_size=16)
    out = [h.digest()]
    for i in range(0, len(key), WIDTH):
        h.update(key[i : i + WIDTH])
        out.append(h.copy().digest())
    return out


@dataclass
class Point:
    depth: int
    shared: bool = False
    n: int = 0
    low: int | None = None
    children: int = 0
    leaves: int = 0
    saved: int = 0
    ends: str | None = EMPTY
    waiting: list = field(default_factory=list)

    def take(self, n: int, low: int) -> None:
        self.n += n
        self.low = low if self.low is None else min(self.low, low)


class Walk:
    """The compressed trie of one task's sorted keys; rows of ``_FIELDS`` come out through ``rows``."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.stack: list[Point] = []
        self.key, self.chars, self.first = None, None, True
        self.ids: list[str] = []
        self.size, self.low, self.passed = 0, None, False

    def add(self, key: bytes, chars: list[int], conv_id: int) -> None:
        """The next conversation in order of key and id."""
        if key != self.key:
            if self.key is not None:
                self._end_group(last=False)
            self._begin(key, chars)
        self.stack[-1].take(1, conv_id)
        self.low = conv_id if self.low is None else self.low
        self.ids.append(str(conv_id))
        self.size += len(self.ids[-1]) + 1
        if self.size > PIECE:
            self._pass_ids()

    def _begin(self, key: bytes, chars: list[int]) -> None:
        depth = len(key) // WIDTH
        if self.key is None:
            self.stack = [Point(d, shared=True) for d in range(depth + 1)]
        else:
            fork = common(self.key, key)
            while self.stack[-1].depth > fork:
                p = self.stack.pop()
                if self.stack[-1].depth < fork:
                    self.stack.append(Point(fork))
                self._close(p, self.stack[-1])
            self.stack.append(Point(depth))
        self.key, self.chars = key, chars

    def _pass_ids(self) -> None:
        self._row(kind=_IDS, p=paths(self.key)[-1], conv_id=self.low, ids=",".join(self.ids))
        self.ids, self.size, self.low, self.passed = [], 0, None, True

    def _end_group(self, last: bool) -> None:
        """The ids of one key are whole unless the key is the task's first or last or its list is long."""
        if self.first or last or self.passed:
            if self.ids:
                self._pass_ids()
            self.stack[-1].ends = None
        else:
            self.stack[-1].ends = hashlib.sha256(",".join(self.ids).encode()).hexdigest()
        self.ids, self.size, self.low, self.passed, self.first = [], 0, None, False, False

    def _row(self, **cells: object) -> None:
        self.rows.append(tuple(cells.get(c) for c in _FIELDS))

    def _turn(self, depth: int) -> bytes | None:
        return self.key[(depth - 1) * WIDTH : depth * WIDTH] if depth else None

    def _close(self, p: Point, parent: Point) -> None:
        """Leave a point: its row, those of the unary nodes on its edge from the lower end upwards, its sums to the parent."""
        if p.shared:
            self._close_shared(p, parent)
            return
        names = None
        leaves = p.leaves if p.children else 1
        saved, children, ends = p.saved, p.children, p.ends
        for depth in range(p.depth, parent.depth, -1):
            saved += (p.n - 1) * self.chars[depth - 1]
            if ends is None:
                names = paths(self.key[: depth * WIDTH])[-1]
            cells = {"p": names if ends is None else None, "conv_id": p.low, "depth": depth, "n_convs": p.n, "n_children": children, "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": ends, "turn": self._turn(depth)}
            if depth > parent.depth + 1:
                self._row(kind=_FINAL, parent_conv_id=p.low, **cells)
            elif parent.shared:
                self._row(kind=_UNDER_SHARED, up=paths(self.key[: parent.depth * WIDTH])[-1], **cells)
            else:
                parent.waiting.append(cells)
            children, ends = 1, EMPTY
        for cells in p.waiting:
            self._row(kind=_FINAL, parent_conv_id=p.low, **cells)
        parent.take(p.n, p.low)
        parent.children, parent.leaves, parent.saved = parent.children + 1, parent.leaves + leaves, parent.saved + saved

    def _close_shared(self, p: Point, parent: Point | None) -> None:
        names = paths(self.key[: p.depth * WIDTH])
        for cells in p.waiting:
            self._row(kind=_UNDER_SHARED, up=names[-1], **cells)
        self._row(
            kind=_SHARED, p=names[-1], up=names[-2] if p.depth else None, conv_id=p.low, depth=p.depth, n_convs=p.n, n_children=p.children, n_leaves=p.leaves, saved_tokens=p.saved,
            ends_sha256=None if p.ends == EMPTY else p.ends, turn=self._turn(p.depth), chars=self.chars[p.depth - 1] if p.depth else 0,
        )
        if parent:
            parent.take(p.n, p.low)

    def finish(self) -> None:
        """What is left is the last key's path: all of its nodes may be shared."""
        if self.key is None:
            return
        self._end_group(last=True)
        have = {p.depth: p for p in self.stack}
        path = [have.get(d) or Point(d) for d in range(len(self.key) // WIDTH + 1)]
        for p in path:
            p.shared = True
        for d in range(len(path) - 1, -1, -1):
            self._close_shared(path[d], path[d - 1] if d else None)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    walk = Walk()
    for b in batches:
        for key, chars, conv_id in zip(*(b.column(c).to_pylist() for c in ("key", "chars", "conv_id"))):
            walk.add(key, chars, conv_id)
        yield from _flush(walk)
    walk.finish()
    yield from _flush(walk)


def _flush(walk: Walk) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(walk.rows), 10_000):
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*walk.rows[i : i + 10_000]), _FIELDS.values())], list(_FIELDS))
    walk.rows = []


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces of ids, which come in order; one piece is held at a time."""
    at, h, done = None, None, []
    for b in batches:
        for p, ids in zip(b.column("p").to_pylist(), b.column("ids").to_pylist()):
            if p != at:
                done += [(at, h.hexdigest())] if h else []
                at, h = p, hashlib.sha256(ids.encode())
            else:
                h.update(b"," + ids.encode())
    done += [(at, h.hexdigest())] if h else []
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done), (pa.binary(), pa.string()))], ["p", "sha"])


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """Nodes of the trie of ``conversations(conv_id long, turns array<struct<token string, chars long>>)``, one row an id, tokens
    MD5 in hex: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens``, ``ends_sha256`` and ``turn``, the last turn's MD5 (null at the root).

    An empty table has no node, not even a root; a conversation without turns, or with null ones, ends at the root.  Rows without
    an id are left out.  A conversation is one row of some 24 bytes a turn; groups of equal conversations, and nodes with very many
    children, are spread over tasks.
    """
    key = F.unhex(F.coalesce(F.array_join(F.transform("turns", lambda x: x["token"]), ""), F.lit(""))).alias("key")
    chars = F.coalesce(F.transform("turns", lambda x: x["chars"].cast("long")), F.array().cast("array<bigint>")).alias("chars")
    table = cut(conversations.where("conv_id is not null").select("conv_id", key, chars), "keys")
    width = partitions(table.sparkSession)
    parts = cut(arrow_map(table.repartitionByRange(width, "key", "conv_id").sortWithinPartitions("key", "conv_id"), _walk, _DDL), "trie")
    discard(table)
    pieces = parts.where(F.col("kind") == _IDS).select("p", "conv_id", "ids").repartition(width, "p").sortWithinPartitions("p", "conv_id")
    shas = cut(arrow_map(pieces, _digest, "p binary, sha string"), "ids")
    shared = _gathered(parts.where(F.col("kind") == _SHARED))
    lows = shared.select(F.col("p").alias("up"), F.col("conv_id").alias("parent_low"))
    nodes = parts.where(F.col("kind").isin(_FINAL, _UNDER_SHARED)).select("p", "up", *NODE).unionByName(shared.select("p", "up", *NODE))
    nodes = nodes.join(small(lows), "up", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "parent_low"))
    ends = F.coalesce("ends_sha256", "sha", F.lit(EMPTY)).alias("ends_sha256")
    return nodes.join(small(shas), "p", "left").select(*[ends if c == "ends_sha256" else F.lower(F.hex(c)).alias(c) if c == "turn" else c for c in NODE])


def _gathered(shares: DataFrame) -> DataFrame:
    """Shared nodes with their totals: shares summed by node, then subtree sums in steps of doubling length up the paths."""
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    same = [F.first(c).alias(c) for c in ("up", "depth", "turn", "chars")]
    nodes = shares.groupBy("p").agg(F.min("conv_id").alias("conv_id"), *sums, F.max("ends_sha256").alias("ends_sha256"), *same)
    nodes = cut(nodes.withColumn("parent_conv_id", F.lit(None).cast("long")), "shared")
    under = nodes.where("up is not null").groupBy(F.col("up").alias("p")).agg(F.count("*").alias("more"))
    nodes = nodes.join(under, "p", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0))).drop("more")
    nodes = nodes.withColumn("n_leaves", F.col("n_leaves") + (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("chars"))
    nodes = cut(nodes.withColumn("far", F.col("up")), "shared")
    while not nodes.where("far is not null").isEmpty():
        below = nodes.where("far is not null").groupBy(F.col("far").alias("p")).agg(F.sum("n_leaves").alias("a"), F.sum("saved_tokens").alias("b"))
        up = nodes.select(F.col("p").alias("far"), F.col("far").alias("farther"))
        nxt = nodes.join(below, "p", "left").join(up, "far", "left")
        add = {"n_leaves": F.col("n_leaves") + F.coalesce("a", F.lit(0)), "saved_tokens": F.col("saved_tokens") + F.coalesce("b", F.lit(0)), "far": F.col("farther")}
        old, nodes = nodes, cut(nxt.withColumns(add).drop("a", "b", "farther"), "shared")
        discard(old)
    return nodes


def turn_lists(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turns)`` of rows ``conv_id, turn, role, text``: turns in order (null first; rows of one turn in order of their
    MD5), each ``(turn, token, chars)``.  A null role or text is empty; rows without a ``conv_id`` are left out; other columns are
    ignored.  Rows that repeat all are turns each."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    token = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), token.alias("token"), F.length(text).cast("long").alias("chars")).alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuilt(lists: DataFrame, every: int = 100, most: int = 5) -> DataFrame:
    """Each conversation with its first turns, 0 to ``most`` by a hash of its id, replaced by those of the one that begins its hundred."""
    base = F.col("conv_id") - F.col("conv_id") % every
    heads = lists.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most).alias("head"))
    own = lists.withColumn("base", base).withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).cast("int"))
    tail = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return own.join(heads, "base", "left").select("conv_id", F.concat(F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("turns", 1, 0)), tail).alias("turns"))


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt(turn_lists(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


OP12_SQL = """
WITH t AS (SELECT conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS token, length(coalesce(text, '')) AS chars
  FROM conversations WHERE conv_id IS NOT NULL),
lists AS (SELECT conv_id, list(token ORDER BY turn NULLS FIRST, token, chars) AS toks, list(chars ORDER BY turn NULLS FIRST, token, chars) AS lens FROM t GROUP BY conv_id),
crc AS (SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda acc, b: list_reduce([xor(acc, b), 1, 1, 1, 1, 1, 1, 1, 1]::BIGINT[], lambda v, one: xor(v >> 1, 3988292384 * (v & one))))) % 6 AS h FROM lists),
built AS (SELECT c.conv_id, list_concat(coalesce(b.toks, [])[1:c.h], c.toks[c.h + 1:]) AS toks, list_concat(coalesce(b.lens, [])[1:c.h], c.lens[c.h + 1:]) AS lens
  FROM crc c LEFT JOIN lists b ON b.conv_id = c.conv_id - c.conv_id % 100),
paths AS (SELECT conv_id, d, len(toks) AS size, md5(array_to_string(toks[1:d], '')) AS p, CASE WHEN d > 0 THEN md5(array_to_string(toks[1:d - 1], '')) END AS up,
    CASE WHEN d > 0 THEN lens[d] ELSE 0 END AS chars, CASE WHEN d > 0 THEN toks[d] END AS turn FROM (SELECT *, unnest(range(0, len(toks) + 1)) AS d FROM built)),
nodes AS (SELECT p, d, min(conv_id) AS conv_id, count(*) AS n, any_value(up) AS up, any_value(chars) AS chars, any_value(turn) AS turn,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE d = size), '')) AS ends FROM paths GROUP BY p, d),
kids AS (SELECT up AS p, count(*) AS k FROM nodes WHERE up IS NOT NULL GROUP BY 1),
full_nodes AS (SELECT nodes.*, coalesce(k, 0) AS k FROM nodes LEFT JOIN kids USING (p)),
subtree AS (SELECT a.p, sum(CASE WHEN f.k = 0 THEN 1 ELSE 0 END) AS leaves, sum((f.n - 1) * f.chars) AS saved
  FROM full_nodes f JOIN paths a ON a.conv_id = f.conv_id AND a.d <= f.d GROUP BY 1)
SELECT f.conv_id, f.d AS depth, u.conv_id AS parent_conv_id, f.n AS n_convs, f.k AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, f.ends AS ends_sha256, f.turn
FROM full_nodes f JOIN subtree USING (p) LEFT JOIN nodes u ON u.p = f.up
"""
