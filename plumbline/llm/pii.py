"""Personal data by patterns and a skip-chain conditional random field.

Base kinds are patterns (``email``, ``ip``, ``card``, ``phone``).  The field adds mentions that patterns miss, above all those
that repeat or resemble a certain one elsewhere in the same document.  Its nodes are the tokens of a document that hold a
digit or ``@``, or that repeat the local part of an address; neighbouring nodes are joined by chain edges, equal or similar
ones, however far apart, by skip edges to one centre, the evidence among them if there is any.  Nodes inside base spans are
evidence; loopy sum-product message passing, until it settles, infers the others.  Weights are trained by pseudo-likelihood on a bounded sample of documents whose labels are the base spans, to which
weakened repeats of each positive token are added, so that skip potentials have something to carry.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, batch
from .spans import digest, scan

BASE_KINDS = ["email", "ip", "card", "phone"]
#: Kinds of the spans that the field adds, in the order of its labels.
CRF_KINDS = [f"crf_{k}" for k in BASE_KINDS]
KINDS = [*BASE_KINDS, *CRF_KINDS]
N_LABELS = 1 + len(BASE_KINDS)  # 0: none

#: Bounds of the training sample: documents with nodes, by hash of their text, and nodes of each.
SAMPLE_DOCS, SAMPLE_NODES = 2000, 200
#: Hashed unary features.
WIDTH = 1 << 12
#: Messages of a document settle when none changes by ``SETTLED``; damping grows, and only a field that would swing forever is
#: read as it stands after ``ROUNDS``.  Least probability of a label that is reported.
SETTLED, ROUNDS, LEAST = 1e-4, 2000, 0.9

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Tokens: words, cut at quotes, brackets and other marks that hold records together, but not at a comma inside a number.
_WORD = re.compile(r"""(?:[^\x20\x09-\x0D"'<>{}\[\]|;,=]|(?<=[0-9]),(?=[0-9]))+""")
_TRIM = " \t\r\n.,;:!?\"'()[]{}<>"
_ANY = r"@|[0-9]"


def luhn(digits: str) -> bool:
    d = [int(c) for c in reversed(digits)]
    return (sum(d[::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches per kind, those that fail their check dropped."""
    out = []
    done, at = 0, text.find("@")
    while at >= 0:  # each address holds one @: its local part reaches back as far as it can
        s = at
        while s > done and text[s - 1] in _LOCAL:
            s -= 1
        if s < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", s, m.end()))
            done = m.end()
        at = text.find("@", at + 1)
    for m in _IP.finditer(text):
        if all(len(x := p.lstrip("0")) < 4 and int(x or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 10 <= sum(c.isdigit() and c.isascii() for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda x: (x[1], BASE_KINDS.index(x[0]), x[2]))


@dataclass
class Graph:
    """The nodes of one document: token spans, unary features, evidence (-1: none), and edges with their type (0 chain, 1 skip)."""

    spans: list[tuple[int, int]]
    feats: list[list[int]]
    label: list[int]
    edges: list[tuple[int, int, int]]


def _shape(w: str) -> str:
    s = re.sub(r"[a-z]+", "a", re.sub(r"[A-Z]+", "A", w))
    return re.sub(r"[^\x00-\x7f]+", "u", re.sub(r"[0-9]+", lambda m: f"9{min(len(m[0]), 9)}" if len(m[0]) < 4 else "9N", s))


def _hash(*parts: object) -> int:
    return xxhash.xxh32_intdigest("\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass")) % WIDTH


def _features(w: str, before: str, after: str) -> list[int]:
    core = w.strip(_TRIM)
    d = sum(c in "0123456789" for c in w)
    return [
        _hash("bias"), _hash("shape", _shape(core)), _hash("raw", _shape(w)), _hash("digits", min(d, 20)), _hash("length", min(len(w), 24)),
        _hash("before", _shape(before)), _hash("after", _shape(after)), _hash("dots", min(core.count("."), 5)), _hash("at", "@" in w, d > 0),
        _hash("luhn", d >= 13 and luhn("".join(c for c in w if c in "0123456789"))),
    ]


def _keys(w: str) -> list[str]:
    """What makes two tokens equal or similar: their form without punctuation, their digits, an address's local part."""
    core = w.strip(_TRIM).lower()
    keys = ["=" + core] if len(core) >= 4 else []
    d = "".join(c for c in core if c in "0123456789")
    if len(d) >= 6:
        keys += ["#" + d, "~" + d[-7:]]
    if "@" in core:
        keys.append("=" + core.split("@")[0])
    return [k if len(k) <= 64 else xxhash.xxh128_hexdigest(k.encode("utf-8", "surrogatepass")) for k in keys]


def document_graph(text: str, base: list[tuple[str, int, int]]) -> Graph:
    """The field of one document; linear in its length, as each node links, for each key, to the first evidence of each label
    that has the key, wherever it is, or without evidence to the first node that has it: repeats are two skips apart at most."""
    locals_ = {text[s:e].split("@")[0].lower() for k, s, e in base if k == "email"}
    g = Graph([], [], [], [])
    keys: list[list[str]] = []
    b, number, prev_node = 0, -1, -2
    before, pending = "", None

    def add(after: str) -> None:
        w, s, e, label, before, number = pending
        g.spans.append((s, e)), g.label.append(label)
        g.feats.append(_features(w, before, after))
        keys.append(_keys(w))
        if number:
            g.edges.append((len(g.spans) - 2, len(g.spans) - 1, 0))

    for m in _WORD.finditer(text):
        at, end = m.span()
        while at < end:  # parts of the token: inside a base span, and between them
            while b < len(base) and base[b][2] <= at:
                b += 1
            j, stop, label = b, end, -1
            while j < len(base) and base[j][1] < end:
                if base[j][2] > at:
                    if base[j][1] <= at:
                        label, stop = 1 + BASE_KINDS.index(base[j][0]), min(end, base[j][2])
                        break
                    stop = min(stop, base[j][1])
                    break  # spans are in order of their starts
                j += 1
            w = text[at:stop]
            number += 1
            if pending:
                add(w)
                pending = None
            if label > 0 or any(c in "0123456789@" for c in w) or (locals_ and w.strip(_TRIM).lower() in locals_):
                pending = (w, at, stop, label, before, prev_node == number - 1)
                prev_node = number
            before, at = w, stop
    if pending:
        add("")
    evidence: dict[str, dict[int, int]] = {}
    for i, x in enumerate(g.label):
        for key in keys[i] if x > 0 else ():
            evidence.setdefault(key, {}).setdefault(x, i)
    first: dict[str, int] = {}
    for i, own in enumerate(keys):
        for key in own:
            centres = evidence[key].values() if key in evidence else [first.setdefault(key, i)]
            g.edges += [(min(i, j), max(i, j), 1) for j in centres if j != i]
    return g


@dataclass
class Weights:
    unary: np.ndarray  # WIDTH x labels
    edge: np.ndarray  # type x labels x labels, symmetric for skips


def train(graphs: list[Graph], rounds: int = 150, rate: float = 0.5, decay: float = 1e-3, seed: int = 7) -> Weights:
    """Pseudo-likelihood by full-batch adaptive gradient steps.  Each positive node gets a weakened repeat: a node with only its
    length and context features, of the same label, joined to it by a skip edge; as many negatives get one too."""
    rng = np.random.Generator(np.random.PCG64(seed))
    feats, y, edges = [], [], []
    for g in graphs:
        at = len(y)
        feats += g.feats
        y += [max(0, x) for x in g.label]
        edges += [(at + i, at + j, t) for i, j, t in g.edges]
        for i, x in enumerate(g.label):
            if x > 0 or rng.random() < 0.3:
                edges.append((at + i, len(y), 1))
                feats.append([g.feats[i][0], *g.feats[i][3:7]])
                y.append(max(0, x))
    w = Weights(np.zeros((WIDTH, N_LABELS)), np.zeros((2, N_LABELS, N_LABELS)))
    if not y:
        return w
    y_ = np.array(y)
    rows = np.repeat(np.arange(len(y)), [len(f) for f in feats])
    cols = np.concatenate([np.array(f) for f in feats])
    e = np.array(edges, np.int64).reshape(-1, 3)
    target = np.eye(N_LABELS)[y_]
    su, se = np.full_like(w.unary, 1e-6), np.full_like(w.edge, 1e-6)
    for _ in range(rounds):
        z = np.zeros((len(y), N_LABELS))
        np.add.at(z, rows, w.unary[cols])
        for t in (0, 1):
            a, b = e[e[:, 2] == t, 0], e[e[:, 2] == t, 1]
            np.add.at(z, b, w.edge[t][y_[a]])
            np.add.at(z, a, w.edge[t][:, y_[b]].T)
        p = np.exp(z - z.max(1, keepdims=True))
        err = target - p / p.sum(1, keepdims=True)
        gu = -decay * len(y) * w.unary
        np.add.at(gu, cols, err[rows])
        ge = -decay * len(y) * w.edge
        for t in (0, 1):
            a, b = e[e[:, 2] == t, 0], e[e[:, 2] == t, 1]
            np.add.at(ge[t], y_[a], err[b])
            np.add.at(ge[t].T, y_[b], err[a])
        ge[1] = (ge[1] + ge[1].T) / 2
        su += gu**2
        se += ge**2
        w.unary += rate * gu / np.sqrt(su)
        w.edge += rate * ge / np.sqrt(se)
    return w


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


def marginals(w: Weights, graphs: list[Graph], rounds: int = ROUNDS) -> list[np.ndarray]:
    """Label probabilities of every node: loopy sum-product with damping, all documents of a batch at once, each until its own
    messages settle."""
    size = [len(g.spans) for g in graphs]
    at = np.r_[0, np.cumsum(size)]
    n = int(at[-1])
    if not n:
        return [np.zeros((0, N_LABELS)) for _ in graphs]
    z = np.zeros((n, N_LABELS))
    flat = [f for g in graphs for f in g.feats]
    np.add.at(z, np.repeat(np.arange(n), [len(f) for f in flat]), w.unary[np.concatenate([np.array(f) for f in flat])])
    label = np.array([x for g in graphs for x in g.label])
    seen = label > 0
    z[seen] = -30.0
    z[seen, label[seen]] = 0.0
    e = np.array([(at[k] + i, at[k] + j, t) for k, g in enumerate(graphs) for i, j, t in g.edges], np.int64).reshape(-1, 3)
    src, dst = np.r_[e[:, 0], e[:, 1]], np.r_[e[:, 1], e[:, 0]]
    pair = np.concatenate([w.edge[e[:, 2]], w.edge[e[:, 2]].transpose(0, 2, 1)]) if len(e) else np.zeros((0, N_LABELS, N_LABELS))
    back = np.r_[np.arange(len(e), 2 * len(e)), np.arange(len(e))]
    msg = np.zeros((2 * len(e), N_LABELS))
    own = np.repeat(np.arange(len(graphs)), [len(g.edges) for g in graphs])
    own = np.r_[own, own]
    live = np.arange(len(msg))  # messages of documents that have not settled
    for r in range(rounds):
        if not len(live):
            break
        belief = z.copy()
        np.add.at(belief, dst[live], msg[live])
        new = _lse((belief[src[live]] - msg[back[live]])[:, :, None] + pair[live], 1)
        new -= _lse(new, 1)[:, None]
        step = new - msg[live]
        msg[live] += 0.5 / (1 + r / 100) * step
        worst = np.zeros(len(graphs))
        np.maximum.at(worst, own[live], np.abs(step).max(1))
        live = live[worst[own[live]] >= SETTLED]
    np.add.at(z, dst, msg)
    p = np.exp(z - _lse(z, 1)[:, None])
    return [p[at[k] : at[k + 1]] for k in range(len(graphs))]


def added_spans(text: str, base: list[tuple[str, int, int]], g: Graph, p: np.ndarray, least: float = LEAST) -> list[tuple[str, int, int]]:
    """Spans of nodes outside base spans whose label is certain enough; neighbours of one label form one span."""
    out: list[tuple[str, int, int]] = []
    joined = {(i, j) for i, j, t in g.edges if t == 0}
    before = -1
    for i, (s, e) in enumerate(g.spans):
        k = int(p[i].argmax())
        if g.label[i] > 0 or k == 0 or p[i, k] < least:
            continue
        while s < e and text[s] in _TRIM:
            s += 1
        while s < e and text[e - 1] in _TRIM:
            e -= 1
        if s == e or any(x < e and y > s for _, x, y in base):
            continue
        if out and before == i - 1 and (i - 1, i) in joined and out[-1][0] == CRF_KINDS[k - 1]:
            out[-1] = (out[-1][0], out[-1][1], e)
        else:
            out.append((CRF_KINDS[k - 1], s, e))
        before = i
    return out


def _train_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rank, graph = [], []
        for r, text in zip(b.column(0).to_pylist(), b.column(1)):
            text = text.as_py()
            g = document_graph(text, base_spans(text))
            k = min(len(g.spans), SAMPLE_NODES)
            if k:
                rank.append(r)
                graph.append(repr(([(0, 0)] * k, g.feats[:k], g.label[:k], [e for e in g.edges if e[1] < k])))
        if rank:
            yield batch(rank=pa.array(rank, pa.int64()), graph=graph)


def smallest_ranks(ranked: DataFrame, wanted: int) -> DataFrame:
    """The rows of ``ranked(rank, ..)`` whose rank, a hash that is not negative, is below a power of two under which there are at
    least ``wanted`` different ranks (all rows, if there are fewer), one row of each rank: some ``4 * wanted`` at any size of the
    table.  Ranks are counted by their bit length, so 64 counts go to the driver.  Null ranks are left out."""
    bits = F.length(F.bin("rank"))
    per = {r.bits: r.n for r in ranked.where("rank is not null").groupBy(bits.alias("bits")).agg(F.approx_count_distinct("rank").alias("n")).collect()}
    below = 0
    for k in range(1, 64):
        below += per.get(k, 0)
        if below >= 1.25 * wanted:  # the counts are approximate
            ranked = ranked.where(bits <= k)
            break
    return ranked.where("rank is not null").dropDuplicates(["rank"])


def fit_field(docs: DataFrame, text_col: str = "text") -> Weights:
    """Train on the ``SAMPLE_DOCS`` documents with a digit or ``@`` whose text hash is smallest, ``SAMPLE_NODES`` nodes of each at
    most; copies count once.  Null and empty texts take no part; without any node the weights are zero."""
    import ast

    text = F.col(text_col).cast("string")
    ranked = docs.select(F.shiftrightunsigned(F.xxhash64(text), 1).alias("rank"), text.alias("text")).where(F.col("text").rlike(_ANY))
    rows = arrow_map(smallest_ranks(ranked, SAMPLE_DOCS), _train_rows, "rank long, graph string")
    return train([Graph(*ast.literal_eval(r.graph)) for r in rows.orderBy("rank").limit(SAMPLE_DOCS).collect()])


def scan_pii(docs: DataFrame, weights: Weights, text_col: str = "text", out_col: str = "spans") -> DataFrame:
    """``docs`` with ``out_col``, an array of ``(kind, start, end, base)``: code points, end exclusive, by start and then kind.

    Every text is scanned whole, however long; a null or empty one has no spans.  Each row stands alone, so nulls, ties and
    repeats in other columns change nothing, and those columns are kept under their names, but for one called ``out_col``, which
    is replaced.  An empty table gives an empty result.
    """

    def find(col: pa.Array) -> list[list[tuple[str, int, int, bool]]]:
        hit = pc.match_substring_regex(col, _ANY).to_pylist()
        out: list[list] = [[] for _ in hit]
        todo = [i for i, h in enumerate(hit) if h]
        for lo in range(0, len(todo), 256):
            rows = todo[lo : lo + 256]
            texts = [col[i].as_py() for i in rows]
            base = [base_spans(t) for t in texts]
            graphs = [document_graph(t, b) for t, b in zip(texts, base)]
            for i, t, b, g, p in zip(rows, texts, base, graphs, marginals(weights, graphs)):
                found = [(*x, True) for x in b] + [(*x, False) for x in added_spans(t, b, g, p)]
                out[i] = sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))
        return out

    return scan(docs, find, text_col, out_col)


def op7_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digest(scan_pii(docs, fit_field(docs)), "doc_id", BASE_KINDS)
