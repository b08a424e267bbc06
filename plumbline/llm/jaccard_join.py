"""N-gram Jaccard join: which documents share at least 80 % of their word shingles.

Method.  A document is the sorted set of 64-bit hashes of its distinct shingles; documents of one set form a class (a
*node*).  Candidates are complete: under one global order of shingles, two sets of Jaccard >= t share a shingle in their
first ``n - ceil(t n) + 1``.  The order puts the shingles whose hash lies in the lowest ``ORDER_SHARE`` of the hash space
first, rarest first by exact document frequency, then the others by hash; so only that share is shuffled to be counted, and
a set whose prefix holds only shingles of its own is finished.  The rest form candidate graphs, cut into *tiles*: sets of one
graph, ordered by size and cut into blocks, each pair of blocks whose sizes may link being one tile.  In a tile, hashed
bitmap signatures bound the overlap from above, ``(n1 + n2 - popcount(xor)) / 2``, within the size band, and an exact
intersection of the sorted arrays decides what is left.  No pair of documents is ever a row: a tile returns, per set, its
number of links and a root.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import arrow_map, batch, blobs, connected_components, cut, deal, discard, local_roots, partitions, small, with_weighted

#: Share of the hash space whose shingles are counted and come first in the global order.
ORDER_SHARE = 0.4
#: Sets in a block; a tile holds two blocks.
BLOCK = 512
#: Distinct sets of one task's million postings in which a shingle is frequent: it then comes last in the global order, and its
#: sets learn that at once, so that no task gathers them.
FREQUENT = 64
_OFTEN = 2**31 - 1
_MOST_WORDS = 256  # of 64 bits in a signature


def _prefix(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """How many first shingles must hold a shared one: n - ceil(n num / den) + 1."""
    return n - -(-n * num // den) + 1


def _node(x: np.ndarray) -> int:
    """A signed 64-bit key of a set of hashes."""
    with np.errstate(over="ignore"):
        m = K.mix64(x)
        h = K.mix64(np.array([m.sum() ^ (np.bitwise_xor.reduce(m) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(len(x))], np.uint64))
    return int(h.view(np.int64)[0])


def text_key(text_col: str) -> Column:
    """What tells the texts of one id apart."""
    return F.xxhash64(F.col(text_col).cast("string"))


def shingle_nodes(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """``(doc_id, text_key, n, node)`` for every row: size and key of its shingle set; an empty set has no node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(len(x), _node(x) if len(x) else None) for _, x in K.shingle_sets(b.column(2), k)]
            yield batch(doc_id=b.column(0), text_key=b.column(1), n=pa.array([g[0] for g in got], pa.int64()), node=pa.array([g[1] for g in got], pa.int64()))

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(text_col).alias("text_key"), F.col(text_col).cast("string").alias("text"))
    return arrow_map(src, run, "doc_id long, text_key long, n long, node long")


def _spread(x: np.ndarray, width: int) -> np.ndarray:
    return ((K.mix64(x) >> np.uint64(20)) % np.uint64(width)).astype(np.int64)


def _post(k: int, width: int, num: int, den: int):
    """Postings of the counted part of each distinct set, packed by target partition: ``kind`` 0 to the partition of the shingle;
    1, those of shingles frequent here, to that of the set; 2, the names of these shingles, to their own partition."""
    top = np.uint64(int(ORDER_SHARE * 2**64))

    def flush(nodes, sizes, toks):
        counts = np.fromiter(map(len, toks), np.int64, len(toks))
        tok = np.concatenate(toks)
        node, n = np.array(nodes, np.int64), np.array(sizes, np.int32)
        owner = np.repeat(np.arange(len(toks), dtype=np.int64), counts)
        name, at, df = np.unique(tok, return_inverse=True, return_counts=True)
        hot = name[df >= FREQUENT]
        often = (df >= FREQUENT)[at]
        rows: list[tuple] = []
        for mine, to, kind in ((~often, _spread(tok, width), 0), (often, _spread(node.view(np.uint64)[owner], width), 1)):
            t, o, x = to[mine], owner[mine], tok[mine]
            order = np.argsort(t * len(toks) + o, kind="stable")
            t, o, x = t[order], o[order], x[order]
            cuts = np.searchsorted(t, np.arange(width + 1))
            for p in np.flatnonzero(np.diff(cuts)):
                i, j = cuts[p], cuts[p + 1]
                own, runs = np.unique(o[i:j], return_counts=True)
                rows.append((p, node[own].tobytes(), n[own].tobytes(), counts[own].astype(np.int32).tobytes(), runs.astype(np.int32).tobytes(), x[i:j].tobytes(), kind))
        to = _spread(hot, width)
        rows += [(p, b"", b"", b"", b"", hot[to == p].tobytes(), 2) for p in np.unique(to)]
        cols = list(zip(*rows))
        return batch(p=pa.array(cols[0], pa.int32()), **{c: pa.array(v, pa.binary()) for c, v in zip(("node", "n", "posted", "runs", "tok"), cols[1:6])}, kind=pa.array(cols[6], pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, sizes, toks, held, seen = [], [], [], 0, set()
        for b in batches:
            for _, x in K.shingle_sets(b.column(0), k):
                if not len(x) or (key := _node(x)) in seen:
                    continue
                if len(seen) < 200_000:  # exact copies met in this task post once; the rest collapse where they meet
                    seen.add(key)
                m = max(int(_prefix(np.int64(len(x)), num, den)), int(np.searchsorted(x, top)))
                nodes.append(key), sizes.append(len(x)), toks.append(x[:m].copy())
                held += m
                if held >= 1 << 20:
                    yield flush(nodes, sizes, toks)
                    nodes, sizes, toks, held = [], [], [], 0
        if held:
            yield flush(nodes, sizes, toks)

    return run


def _shared(width: int):
    """From all postings of some shingles: those that several sets hold, packed by the partition of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, hot = [], [np.zeros(0, np.uint64)]
        for b in batches:
            kind = b.column(6).to_numpy()
            direct = b.filter(pa.array(kind == 1))
            if direct.num_rows:  # on to the set, frequent as they are
                df = [np.full(len(x) // 8, _OFTEN, np.int32).tobytes() for x in direct.column(5).to_pylist()]
                yield pa.RecordBatch.from_arrays([*direct.columns[:6], pa.array(df, pa.binary())], [*direct.schema.names[:6], "df"])
            hot.append(blobs(b.column(5).filter(pa.array(kind == 2)), np.uint64))
            b = b.filter(pa.array(kind == 0))
            if b.num_rows:
                got.append([blobs(b.column(i), t) for i, t in ((1, np.int64), (2, np.int32), (3, np.int32), (4, np.int32), (5, np.uint64))])
        if not got:
            return
        node, n, posted, runs, tok = (np.concatenate(x) for x in zip(*got))
        hot = np.unique(np.concatenate(hot))
        del got
        key, first, own = np.unique(node, return_index=True, return_inverse=True)
        own = np.repeat(own, runs)
        order = np.lexsort((own, tok))
        tok, own = tok[order], own[order]
        keep = np.ones(len(tok), bool)
        keep[1:] = (tok[1:] != tok[:-1]) | (own[1:] != own[:-1])
        tok, own = tok[keep], own[keep]
        head = np.flatnonzero(np.r_[True, tok[1:] != tok[:-1]])
        df = np.diff(np.r_[head, len(tok)])
        many = df
        if len(hot):  # frequent anywhere is frequent everywhere, so that all sets have one order
            at = np.minimum(np.searchsorted(hot, tok[head]), len(hot) - 1)
            many = np.where(hot[at] == tok[head], _OFTEN, df)
        df = np.repeat(many, df)
        tok, own, df = tok[df > 1], own[df > 1], df[df > 1]
        if not len(tok):
            return
        order = np.argsort(own, kind="stable")
        tok, own, df = tok[order], own[order], df[order]
        ids, runs = np.unique(own, return_counts=True)
        to = _spread(key[ids].view(np.uint64), width)
        each = np.repeat(to, runs)
        o1, o2 = np.argsort(to, kind="stable"), np.argsort(each, kind="stable")
        ids, runs, to, tok, df, each = ids[o1], runs[o1], to[o1], tok[o2], df[o2], each[o2]
        c1, c2 = np.searchsorted(to, np.arange(width + 1)), np.searchsorted(each, np.arange(width + 1))
        rows = []
        for p in np.flatnonzero(np.diff(c1)):
            a, t = slice(c1[p], c1[p + 1]), slice(c2[p], c2[p + 1])
            f = first[ids[a]]
            rows.append((p, key[ids[a]].tobytes(), n[f].tobytes(), posted[f].tobytes(), runs[a].astype(np.int32).tobytes(), tok[t].tobytes(), np.minimum(df[t], _OFTEN).astype(np.int32).tobytes()))
        cols = list(zip(*rows))
        yield batch(p=pa.array(cols[0], pa.int32()), **{c: pa.array(v, pa.binary()) for c, v in zip(("node", "n", "posted", "runs", "tok", "df"), cols[1:])})

    return run


def _prefixes(num: int, den: int):
    """Each set's shingles that are both in its prefix and in another set, joined as far as one task knows (see ``_joined``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[blobs(b.column(i), t) for i, t in ((1, np.int64), (2, np.int32), (3, np.int32), (4, np.int32), (5, np.uint64), (6, np.int32))] for b in batches if b.num_rows]
        if not got:
            return
        node, n, posted, runs, tok, df = (np.concatenate(x) for x in zip(*got))
        key, first, own = np.unique(node, return_index=True, return_inverse=True)
        n, posted = n[first].astype(np.int64), posted[first].astype(np.int64)
        own = np.repeat(own, runs)
        order = np.lexsort((tok, df, own))
        tok, own = tok[order], own[order]
        k = np.bincount(own, minlength=len(key))
        need = _prefix(n, num, den) - (posted - k)
        rank = np.arange(len(own)) - np.repeat(np.cumsum(k) - k, k)
        keep = rank < need[own]
        if keep.any():
            yield from _joined(tok[keep].view(np.int64), key[own[keep]], None, None)

    return run


def _joined(tok: np.ndarray, node: np.ndarray, a: np.ndarray | None, b: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Contract what one task knows, the sets of each shingle and edges ``a``-``b`` between sets: a row ``(null, set, root)`` for
    each set that is not its own root, and ``(shingle, root, null)`` once for each shingle, however many sets hold it."""
    ends = [node] if a is None else [node, a, b]
    key, at = np.unique(np.concatenate(ends), return_inverse=True)
    own, x, y = (at, at[:0], at[:0]) if a is None else np.split(at, np.cumsum([len(node), len(a)]))
    name, t = np.unique(tok, return_inverse=True)
    low = np.full(len(name), len(key))
    np.minimum.at(low, t, own)
    root = local_roots(np.concatenate([own, x]), np.concatenate([low[t], y]), len(key))
    moved = np.flatnonzero(root != np.arange(len(key)))
    for i in range(0, len(moved), 1 << 20):
        m = moved[i : i + (1 << 20)]
        yield batch(tok=pa.nulls(len(m), pa.int64()), node=key[m], root=key[root[m]])
    for i in range(0, len(name), 1 << 20):
        m = low[i : i + (1 << 20)]
        yield batch(tok=name[i : i + (1 << 20)], node=key[root[m]], root=pa.nulls(len(m), pa.int64()))


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows of some shingles and some edges as a graph: an edge from each set to the smallest one it is joined to here."""
    got = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
    if not got:
        return
    tab = pa.concat_tables(got)
    edge = tab.column("tok").is_null()
    sets, edges = tab.filter(pc.invert(edge)), tab.filter(edge)
    for b in _joined(*(x.column(c).to_numpy() for x, c in ((sets, "tok"), (sets, "node"), (edges, "node"), (edges, "root")))):
        if b.column("tok").null_count:
            yield batch(a=b.column("node"), b=b.column("root"))


def signature(x: np.ndarray, words: int) -> np.ndarray:
    """A bitmap of ``64 * words`` bits (a power of two) with the bit of each hash set."""
    out = np.zeros(words, np.uint64)
    bit = x >> np.uint64(7)
    np.bitwise_or.at(out, ((bit >> np.uint64(6)) % np.uint64(words)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return out


def tile_links(left: list[np.ndarray], right: list[np.ndarray] | None, num: int, den: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each set of ``left`` the linked sets of ``right`` (or, without ``right``, the later sets of ``left``).  Sets are
    ordered by size in either list."""
    same = right is None
    right = left if same else right
    n = np.fromiter(map(len, right), np.int64, len(right))
    most = max(int(n.max()), max(map(len, left)))
    words = min(_MOST_WORDS, 1 << max(2, int(2 * most - 1).bit_length() - 6))
    sig = np.stack([signature(x, words) for x in right])
    start = np.r_[0, np.cumsum(n)]
    flat = np.concatenate(right)
    for i, x in enumerate(left):
        m = len(x)
        lo, hi = np.searchsorted(n, -(-m * num // den)), np.searchsorted(n, m * den // num, "right")
        lo = max(lo, i + 1) if same else lo
        if lo >= hi:
            continue
        own = sig[i] if same else signature(x, words)
        differ = np.bitwise_count(sig[lo:hi] ^ own).sum(1, dtype=np.int64)
        # t (m + n) / (1 + t) is the least overlap; popcount(xor) never exceeds the symmetric difference
        cand = lo + np.flatnonzero((m + n[lo:hi] - differ) * (num + den) >= 2 * num * (m + n[lo:hi]))
        if not len(cand):
            continue
        c = n[cand]
        at = np.cumsum(c) - c
        y = flat[np.arange(int(c.sum())) + np.repeat(start[cand] - at, c)]
        pos = np.searchsorted(x, y)
        pos[pos == m] = 0
        both = np.add.reduceat((x[pos] == y).astype(np.int64), at)
        hit = cand[both * den >= num * (m + c - both)]
        if len(hit):
            yield i, hit


def _tiles(num: int, den: int):
    """All tiles dealt to one task, one after the other."""

    def emit(out):
        a, b, c = (np.concatenate(x) for x in zip(*out))
        return batch(node=a, root=b, links=c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tab = [b for b in batches if b.num_rows]
        if not tab:
            return
        tab = pa.Table.from_batches(tab)
        comp, i, j, side, node, weight = (tab.column(c).to_numpy() for c in ("comp", "i", "j", "side", "node", "weight"))
        sets = tab.column("tok").combine_chunks()
        sets = sets.chunk(0) if isinstance(sets, pa.ChunkedArray) else sets
        n = np.array([len(x.as_buffer()) for x in sets]) if len(sets) else np.zeros(0)
        order = np.lexsort((node, n, side, j, i, comp))
        out, held = [], 0
        s = 0
        while s < len(order):
            r = order[s]
            e = s
            while e < len(order) and comp[order[e]] == comp[r] and i[order[e]] == i[r] and j[order[e]] == j[r]:
                e += 1
            rows = order[s:e]
            s = e
            arr = [np.frombuffer(sets[int(x)].as_buffer(), np.uint64) for x in rows]
            k = len(rows)
            if i[r] == j[r]:
                a, b, shift = arr, None, 0
            else:
                k = int((side[rows] == 0).sum())
                a, b, shift = arr[:k], arr[k:], k
            if not a or b == [] or len(rows) < 2:
                continue
            links, ea, eb = np.zeros(len(rows), np.int64), [], []
            w = weight[rows]
            for x, hit in tile_links(a, b, num, den):
                hit = hit + shift
                links[x] += w[hit].sum()
                links[hit] += w[x]
                ea.append(np.full(len(hit), x)), eb.append(hit)
            if not ea:
                continue
            # roots by smallest node key, as the components are
            by = np.argsort(node[rows], kind="stable")
            rank = np.empty(len(rows), np.int64)
            rank[by] = np.arange(len(rows))
            root = local_roots(rank[np.concatenate(ea)], rank[np.concatenate(eb)], len(rows))
            keep = links > 0
            out.append((node[rows][keep], node[rows][by[root[rank[keep]]]], links[keep]))
            held += int(keep.sum())
            if held > 100_000:
                yield emit(out)
                out, held = [], 0
        if out:
            yield emit(out)

    return run


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Link documents whose sets of ``shingle``-word shingles have Jaccard similarity >= ``num / den``.

    Returns one row per input row: ``doc_id, n_shingles, component_id, n_links, node, text_key`` - the set's size, the smallest
    doc_id reachable by links (itself included), how many other rows it links with directly, and 64-bit keys of its set and text.

    Null or empty texts have 0 shingles, no links and their own doc_id as component; texts with fewer words than ``shingle``
    have their whole sequence as one shingle.  Rows without a doc_id keep their n_shingles, get a null component_id and link
    with nothing.  Repeated rows are copies of each other.  Other columns are not read, whatever their names.  An empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    width = partitions(spark)
    sets = cut(shingle_nodes(docs, id_col, text_col, shingle), "sets")
    whose = F.col("node").isNotNull() & F.col("doc_id").isNotNull()
    classes = cut(sets.where(whose).groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("weight"), F.first("n").alias("n")), "sizes")
    total = classes.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]

    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(text_col).cast("string").alias("text"))
    packed = "p int, node binary, n binary, posted binary, runs binary, tok binary"
    posts = deal(arrow_map(texts, _post(shingle, width, num, den), packed + ", kind int"), "p")
    shared = deal(arrow_map(posts, _shared(width), packed + ", df binary"), "p")
    prefix = arrow_map(shared, _prefixes(num, den), "tok long, node long, root long")
    graph = arrow_map(prefix.repartition(width, F.coalesce("tok", "node")), _stars, "a long, b long")
    members = cut(connected_components(graph).join(classes, "node"), "members")
    sizes = cut(members.groupBy("comp").agg(F.count("*").alias("size")).where("size > 1").withColumn("w", F.col("size")), "graphs")
    blocks = cut(_blocks(with_weighted(members, sizes, ["comp"], "w", members.count(), "inner"), num, den), "blocks")
    discard(members), discard(sizes)
    want = cut(blocks.select("node", "doc_id").distinct(), "wanted")
    held = cut(_held_sets(docs, want, id_col, text_col, shingle), "held")
    tiles = blocks.join(held, "node").repartition(width, "comp", "i", "j")
    found = cut(arrow_map(tiles.select("comp", "i", "j", "side", "node", "weight", "tok"), _tiles(num, den), "node long, root long, links long"), "links")
    discard(blocks), discard(held), discard(want)

    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    whole = cut(connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))).join(classes.select("node", "doc_id"), "node"), "groups")
    low = cut(whole.groupBy("comp").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("w")), "lowest")
    named = with_weighted(whole.select("node", "comp"), low, ["comp"], "w", whole.count(), "inner").select("node", "component_id")
    of = classes.join(linked, "node", "left").join(named, "node", "left").select("node", "weight", F.coalesce("component_id", "doc_id").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"))
    of = cut(of, "classes")
    discard(found), discard(whole), discard(low), discard(classes)
    own = F.col("doc_id").isNotNull() & F.col("component_id").isNotNull()
    return with_weighted(sets, of, ["node"], "weight", total).select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(own, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(own, F.col("links")).otherwise(F.lit(0)).cast("long").alias("n_links"),
        "node",
        "text_key",
    )


def _blocks(members: DataFrame, num: int, den: int) -> DataFrame:
    """Cut each candidate graph, in order of size, into blocks, and give each pair of blocks that may link its rows.

    A graph of up to ``BLOCK`` sets is one tile.  A larger one is cut into geometric bands of size, and each band by hash into
    blocks of about ``BLOCK`` sets, so no task orders a whole graph; blocks of one band and of neighbouring ones are paired.
    """
    small = members.where(F.col("size") <= BLOCK).select("comp", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), "node", "doc_id", "weight")
    big = members.where(F.col("size") > BLOCK)
    # size bands: sets of band s link only within bands s and s + 1 (geometric with ratio den / num); hashed into blocks in a band
    big = big.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(den / num)) + F.lit(1e-9)).cast("int"))
    per = big.groupBy("comp", "band").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("cuts"))
    nxt = per.select("comp", (F.col("band") - 1).alias("band"), F.col("cuts").alias("above"))
    prv = per.select("comp", (F.col("band") + 1).alias("band"), F.col("cuts").alias("below"))
    per = per.join(nxt, ["comp", "band"], "left").join(prv, ["comp", "band"], "left").na.fill(0, ["above", "below"])
    per = cut(per.withColumn("w", F.col("cuts").cast("long") * BLOCK), "bands")
    weight = per.agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0]
    big = with_weighted(big, per, ["comp", "band"], "w", weight, "inner").withColumn("b", F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int"))
    code = lambda band, b: (band.cast("long") * F.lit(1 << 20) + b).alias("code")
    me = code(F.col("band"), F.col("b"))
    seq = lambda n, band: F.when(F.col(n) > 0, F.transform(F.sequence(F.lit(0), F.col(n) - 1), lambda x: code(F.col("band") + band, x))).otherwise(F.array().cast("array<long>"))
    pairs = big.select("comp", "node", "doc_id", "weight", me.alias("me"), F.explode(F.concat(seq("below", -1), seq("cuts", 0), seq("above", 1))).alias("other"))
    pairs = pairs.select("comp", F.least("me", "other").alias("i"), F.greatest("me", "other").alias("j"), (F.col("me") > F.col("other")).cast("int").alias("side"), "node", "doc_id", "weight")
    return small.select("comp", F.col("i").cast("long"), F.col("j").cast("long"), "side", "node", "doc_id", "weight").unionByName(pairs)


def _held_sets(docs: DataFrame, want: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """``(node, tok)``: the sorted hashes of each wanted set, made anew from the text of its first document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            want = b.column(0).to_numpy()
            rows, toks = [], []
            for r, x in K.shingle_sets(b.column(1), k):
                if len(x) and _node(x) == want[r]:
                    rows.append(want[r]), toks.append(x.tobytes())
            if rows:
                yield batch(node=pa.array(rows, pa.int64()), tok=pa.array(toks, pa.binary()))

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return arrow_map(src.join(small(want), "doc_id").select("node", "text"), run, "node long, tok binary").dropDuplicates(["node"])


def op1_jaccard_join(spark, sf_dir: str) -> DataFrame:
    out = jaccard_links(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_shingles", "component_id", "n_links")
