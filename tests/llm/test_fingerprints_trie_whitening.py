"""Fingerprints, prefix trie and whitening against plain versions, and their odd inputs."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from oracle import DATA, difference
from plumbline.llm import fingerprints, prefix_trie, queries, whitening

DOCS, CONVS, VECS = "doc_id long, text string", "conv_id long, turn long, role string, text string", "vec_id long, embedding array<float>"


@pytest.mark.parametrize("name", ["op11_imatch", "op12_prefix_trie"])
def test_query_equals_sql(spark, name):
    assert difference(spark, queries.QUERIES[name], queries.ORACLE_SQL[name]) is None


# fingerprints -----------------------------------------------------------------------------------------------------------


def words(rng, n):
    return " ".join(f"w{rng.randrange(5000)}" for _ in range(n))


def edited_rows(spark, rows, schema=DOCS):
    docs = spark.createDataFrame(rows, schema)
    lexicon = fingerprints.fit_lexicon(docs)
    return fingerprints.edited_fingerprints(docs, lexicon).collect(), lexicon


def test_edited_texts_and_likeness_by_hand(spark):
    rng = random.Random(2)
    rows = [(i * 3, words(rng, rng.choice([1, 3, 40, 300]))) for i in range(150)] + [(7, None), (8, ""), (10, "été — ½" * 9), (-4, "x" * 300_000)]
    rng.shuffle(rows)
    got, lexicon = edited_rows(spark, rows)
    order = sorted((i, t or "") for i, t in rows)
    assert len(got) == len(rows)
    found = {r.doc_id: r for r in got}
    for k, (i, text) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        n = len(text) // 4
        edited, r = text[: len(text) - n] + after[:n], found[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == fingerprints.fingerprint(text, lexicon) and r.edited_fingerprint == fingerprints.fingerprint(edited, lexicon)
        assert r.near_edited == fingerprints.likeness(r.fingerprint, r.edited_fingerprint)
    long = [r for r in got if r.n_chars > 1000 and r.doc_id >= 0]
    assert np.mean([r.near_edited for r in long]) > 0.55 and max(r.near_next for r in long) < 0.3


def test_lexicon_is_the_band(spark):
    texts = [f"every w{i % 2} x{i % 20} y{i}" for i in range(100)] + [None, ""]
    lexicon = fingerprints.fit_lexicon(spark.createDataFrame(list(enumerate(texts)), DOCS), least=0.02, most=0.25)
    inside = lambda t: bool(lexicon.holds(fingerprints._keys([hashlib.md5(t).digest()]))[0])
    assert [inside(t) for t in (b"every", b"w1", b"x7", b"y3", b"none")] == [False, False, True, False, False] and len(lexicon.keys) == 20


def test_a_lexicon_beyond_its_bound_keeps_a_share_of_hashes(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"a{i} b{i}") for i in range(1000)], DOCS)
    monkeypatch.setattr(fingerprints, "MOST_TERMS", 500)
    assert 400 < len(fingerprints.fit_lexicon(docs).keys) < 600


@pytest.mark.parametrize("held", [0, 700])
def test_terms_beyond_those_that_tasks_hold_count_all_the_same(spark, monkeypatch, held):
    rng = random.Random(8)
    rows = [(i, "every " + words(rng, rng.choice([1, 3, 40, 300]))) for i in range(150)] + [(7, None), (7, ""), (None, "w1 " * 50), (500, "été — ½" * 9)]
    docs = spark.createDataFrame(rows, DOCS)
    whole = fingerprints.fit_lexicon(docs)
    want = sorted(map(str, fingerprints.edited_fingerprints(docs, whole).collect()))
    marks = sorted(map(str, fingerprints.fingerprints(docs, whole).collect()))
    monkeypatch.setattr(fingerprints, "MOST_TERMS", held)
    monkeypatch.setattr(fingerprints, "BLOCK", 2000, raising=False)
    lexicon = fingerprints.fit_lexicon(docs)
    assert sorted(map(str, fingerprints.edited_fingerprints(docs, lexicon).collect())) == want
    assert sorted(map(str, fingerprints.fingerprints(docs, lexicon).collect())) == marks
    assert whole.rest is None
    assert len(lexicon.keys) <= 1.2 * held and len(lexicon.keys) + lexicon.rest.count() == len(whole.keys)
    assert fingerprints.fingerprint(rows[0][1], lexicon) == fingerprints.fingerprint(rows[0][1], whole)


def test_equal_texts_and_equal_sets_of_terms_have_equal_fingerprints(spark):
    rows = [(i, "the same text of some words") for i in range(40)] + [(100, "Words of TEXT, same the; some"), (200, None), (201, ""), (300, "!!!"), (301, "???")]
    got = {r.doc_id: r for r in edited_rows(spark, rows)[0]}
    assert len({got[i].fingerprint for i in [*range(40), 100]}) == 1 and got[3].near_next == 1
    assert got[200].fingerprint == got[201].fingerprint and got[300].fingerprint != got[301].fingerprint and got[300].near_next == 0


def test_repeated_and_null_ids_empty_tables_and_single_rows(spark):
    rows = [(5, f"text {i} of five") for i in range(30)] + [(5, "again")] * 10 + [(None, "no id"), (None, None)]
    got, _ = edited_rows(spark, rows)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert sorted((r.doc_id is None, r.n_chars) for r in got) == sorted((i is None, len(t or "")) for i, t in order)
    assert edited_rows(spark, [])[0] == []
    (one,) = edited_rows(spark, [(1, "only one")])[0]
    assert one.near_edited < 1.01 and one.near_next == 1 and one.edited_sha256 == hashlib.sha256(b"only oon").hexdigest()


def test_fingerprints_keep_other_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", "old", "x"), (2, None, "old", "y")], "doc_id long, text string, fingerprint string, `odd name` string")
    got = fingerprints.fingerprints(docs, fingerprints.fit_lexicon(docs))
    assert got.columns == ["doc_id", "text", "odd name", "fingerprint"] and {r["odd name"] for r in got.collect()} == {"x", "y"}
    assert all(r.fingerprint.count(":") == 2 for r in got.collect())


# prefix trie ------------------------------------------------------------------------------------------------------------


def plain_nodes(rows):
    """(conv_id, depth, parent, n, children, leaves, saved, ends) of every node, from sets of members."""
    lists = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            lists[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    lists = {c: [x[3:] for x in sorted(v)] for c, v in lists.items()}
    built = {}
    for c, own in lists.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(lists.get(c - int(np.fmod(c, 100)), [])[:h] + own[h:])
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[built[c][:d]].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)

    def under(p):
        yield p
        for k in kids[p]:
            yield from under(k)

    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in m if built[c] == p)
        saved = sum((len(members[x]) - 1) * (len(x[-1][1]) if x else 0) for x in under(p))
        out.append((m[0], len(p), members[p[:-1]][0] if p else None, len(m), len(kids[p]), sum(not kids[x] for x in under(p)), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def nodes(spark, rows, schema=CONVS):
    frame = spark.createDataFrame(rows, schema)
    got = prefix_trie.prefix_trie(prefix_trie.rebuilt(prefix_trie.turn_lists(frame))).collect()
    return sorted((tuple(r[c] for c in prefix_trie.NODE[:-1]) for r in got), key=str)


def conversations(rng, n, turns=5, kinds=3):
    return [(c, t, rng.choice(["user", None]), rng.choice(["", "x", "longer", None])) for c in rng.sample(range(-250, 900), n) for t in range(rng.randrange(1, turns + 3)) if rng.random() < 0.95]


@pytest.mark.parametrize("seed", range(3))
def test_nodes_equal_sets_of_members(spark, seed):
    rows = conversations(random.Random(seed), 200)
    assert nodes(spark, rows) == plain_nodes(rows)


def test_copies_over_many_tasks_and_long_lists_of_ids(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 64)
    rows = [(c, t, "user", f"same {t}") for c in range(600) for t in range(3)] + [(c, t, "user", f"{c} {t}" if t > 8 else f"path {t}") for c in range(1000, 1040) for t in range(10)] + [(5000, 0, "user", "alone")]
    assert nodes(spark, rows) == plain_nodes(rows)


def test_turnless_conversations_ties_nulls_and_other_columns(spark):
    rows = [(7, None, None, None), (7, 0, "a", "b"), (7, 0, "a", "b"), (7, 0, "a", "a"), (107, 0, "u", "t"), (None, 1, "u", "t"), (2, 1, "u", "t"), (102, 1, "u", "t")]
    assert nodes(spark, rows) == plain_nodes(rows) and any(r[1] == 0 and r[-1] != prefix_trie.EMPTY for r in nodes(spark, rows))
    wide = [(*r, "z") for r in rows]
    assert nodes(spark, wide, f"{CONVS}, depth string") == plain_nodes(rows)
    assert nodes(spark, []) == []
    bare = prefix_trie.prefix_trie(spark.createDataFrame([(4, None), (None, None), (9, [])], "conv_id long, turns array<struct<token:string,chars:long>>")).collect()
    assert [(r.conv_id, r.depth, r.n_convs, r.n_leaves, r.ends_sha256) for r in bare] == [(4, 0, 2, 1, hashlib.sha256(b"4,9").hexdigest())]


def test_edges_are_expanded_from_their_lower_end():
    walk = prefix_trie.Walk()
    turn = lambda x: hashlib.md5(x.encode()).digest()
    keys = sorted([turn("a"), turn("b") + turn("c") + turn("d"), turn("b") + turn("c") + turn("e"), turn("f")])
    for i, k in enumerate(keys):
        walk.add(k, [10] * (len(k) // 16), i)
    assert len(walk.stack) < 4  # points, not turns
    walk.finish()
    assert len(walk.rows) >= 7


# whitening --------------------------------------------------------------------------------------------------------------


def plain_whitened(x):
    fit = np.unique(x, axis=0)
    values, vectors = np.linalg.eigh(np.cov(fit.T.astype(float), bias=True).reshape(x.shape[1], -1))
    keep = [i for i in np.argsort(-values)[:16] if values[i] > 1e-10 * values.max()]
    return (x - fit.mean(0)) @ vectors[:, keep] / np.sqrt(values[keep]), values[keep] / values.sum(), fit


def integers(vectors):
    return np.floor(64 * np.array(vectors, np.float32).astype(float)).astype(np.int64) + 1_000_000


def whitened(spark, rows, schema=VECS):
    out = defaultdict(dict)
    for r in whitening.whiten(spark.createDataFrame(rows, schema)).collect():
        out[r.vec_id].setdefault(r.component, []).append(r)
    return out


@pytest.mark.parametrize("dims", [1, 3, 24])
def test_whitened_equal_library_solution(spark, dims):
    rng = np.random.default_rng(dims)
    v = rng.normal(size=(400, dims)) @ rng.normal(size=(dims, dims))
    v[100:250] = v[7]
    rows = [(i, x.tolist()) for i, x in enumerate(v.astype(np.float32))]
    got, x = whitened(spark, rows), integers(v)
    z, share, fit = plain_whitened(x)
    mine = np.array([[got[i][k + 1][0].whitened for k in range(z.shape[1])] for i in range(400)])
    assert np.allclose(np.abs(mine), np.abs(z), atol=1e-8) and len(got[0]) == z.shape[1]
    assert all(len({np.sign(a * b) for a, b in zip(mine[:, k], z[:, k]) if abs(b) > 1e-6}) == 1 for k in range(z.shape[1]))
    r = got[3][1][0]
    total = [int(s) for s in fit.sum(0)]
    assert r.n == len(fit) and r.deviation == sum((len(fit) * int(a) - s) ** 2 for a, s in zip(x[3], total)) and r.identity_error < 1e-9
    assert np.allclose([got[0][k + 1][0].explained for k in range(len(share))], share, rtol=1e-8)


def test_states_merge_to_the_state_of_all():
    rng = np.random.default_rng(5)
    x = (rng.integers(-90, 90, (500, 7)) + 1_000_000).astype(np.int64)
    parts = []
    for block in np.split(x, [3, 40, 41, 300]):
        m = whitening.Moments(block[0].copy())
        for row in block:
            m.add(row)
        parts.append(m)
    for m in parts[1:]:
        parts[0].merge(m)
    assert parts[0].n == 500 and parts[0].sums() == x.sum(0).tolist() and np.allclose(parts[0].covariance(), np.cov(x.T, bias=True), rtol=1e-12)


@pytest.mark.parametrize("kind", ["random", "diagonal", "equal", "low rank", "graded"])
def test_eigenvectors(kind):
    rng = np.random.default_rng(1)
    b = rng.normal(size=(20, 20))
    a = {"random": b @ b.T, "diagonal": np.diag(np.arange(20.0)), "equal": 3 * np.eye(20), "low rank": b[:, :4] @ b[:, :4].T, "graded": np.diag(10.0 ** -np.arange(20))}[kind]
    values, vectors = whitening.symmetric_eigen(a)
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], atol=1e-12 * np.abs(a).max()) and np.allclose(vectors @ np.diag(values) @ vectors.T, a, atol=1e-12 * np.abs(a).max())
    assert np.allclose(vectors.T @ vectors, np.eye(20), atol=1e-13)


def test_nulls_lengths_repeats_and_other_columns(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(30)] + [(1, rng.normal(size=4).tolist()), (50, None), (51, [1.0, None, 2.0, 3.0]), (52, [1.0, float("nan"), 2.0, 3.0]), (53, [float("inf")] * 4), (None, [0.5] * 4)]
    got = whitened(spark, rows)
    assert set(got) == {*range(30), None} and len(got[1][1]) == 2 and got[0][1][0].n == 32
    mixed = whitened(spark, rows + [(60, [1.0, 2.0]), (61, [2.0, 1.0]), (62, [0.0, 0.0]), (63, [])])
    assert mixed[60][1][0].n == 3 and mixed[0][1][0].n == 32 and 63 not in mixed
    assert whitened(spark, []) == {} and whitened(spark, [(1, [1.0, 2.0])] * 5) == {} and set(whitened(spark, [(1, [1.0, 2.0]), (2, [3.0, 2.0])])[1]) == {1}
    clash = whitening.whiten(spark.createDataFrame([(i, rng.normal(size=3).tolist(), 1, "k") for i in range(9)], f"{VECS}, x int, n string"))
    assert clash.columns == ["vec_id", "x", "component", "n", "deviation", "whitened", "explained", "identity_error"] and {r.n for r in clash.collect()} == {9}
    huge = whitened(spark, [(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [0.0, 5.0])])
    assert set(huge) == {1, 2, 3} and huge[1][1][0].deviation is None
