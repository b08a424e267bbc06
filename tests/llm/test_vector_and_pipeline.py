"""Vectors, mixing, packing and the pipeline against brute force."""

from __future__ import annotations

import hashlib
import math
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from oracle import DATA
from plumbline.llm import mixing, packing, pivot_index, vp_tree
from plumbline.llm.common import connected_components
from plumbline.llm.secrets import find_secrets

VECS = "vec_id long, embedding array<float>, label int, node string, weight string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, l, "x", None) for i, v, l in rows], VECS)


def clustered(seed=1, n=120, dim=12):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 4, dim))
    x = np.repeat(base, 4, 0) + rng.normal(size=(n, dim)) * rng.choice([0.0, 0.05, 0.3], (n, 1))
    rows = [(i, [float(np.float32(c)) for c in v], int(i % 8 // 4)) for i, v in enumerate(x)]
    bad = [(900, None, 1), (901, [0.0] * dim, 1), (902, [float("nan")] * dim, 1), (903, [float("inf")] + [0.0] * (dim - 1), 1), (904, rows[0][1], None), (905, [], 1)]
    return rows + bad


def test_pivot_index_recall_and_no_false_links(spark):
    rows = clustered()
    got = {r.vec_id: r for r in pivot_index.pivot_links(vectors(spark, rows)).collect()}
    good = {i: (np.array(v), l) for i, v, l in rows if i < 900}
    cos = lambda a, b: float(a @ b / math.sqrt((a @ a) * (b @ b)))
    links = {i: 0 for i in good}
    for i, j in combinations(good, 2):
        if good[i][1] == good[j][1] and cos(good[i][0], good[j][0]) >= 0.93:
            links[i] += 1
            links[j] += 1
    assert all(got[i].n_links <= links[i] for i in good)
    assert sum(got[i].n_links for i in good) >= 0.9 * sum(links.values()) > 0
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in range(900, 906))
    assert pivot_index.pivot_links(vectors(spark, [])).count() == 0


def plain_nearest(rows, k=20):
    good = {i: np.array(v) for i, v, _ in rows if v and np.isfinite(v).all() and any(v)}
    out = {}
    for q in (i for i in good if i % 20 == 0):
        out[q] = sorted(((-float(np.add.accumulate(good[q] * x)[-1]), i) for i, x in good.items() if i != q))[:k]
    return out


def test_vp_tree_is_exact_at_factor_one(spark):
    rows = clustered(2)
    df = vectors(spark, rows)
    for shard in (4096, 25):
        got = {}
        for r in vp_tree.nearest(df, df.where("vec_id % 20 = 0"), shard_rows=shard, query_rows=3).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
        want = plain_nearest(rows)
        assert {q: [i for _, i in v] for q, v in got.items()} == {q: [i for _, i in v] for q, v in want.items()}
    assert vp_tree.nearest(df.limit(0), df.limit(0)).count() == 0


def test_relaxed_factor_prunes_more_and_keeps_recall():
    rng = np.random.default_rng(3)
    x = np.repeat(rng.normal(size=(40, 6)), 50, 0) + rng.normal(size=(2000, 6)) * 0.05
    ids, q = np.arange(2000), x[::20]
    exact, loose = vp_tree.Search(ids, x, 32), vp_tree.Search(ids, x, 32)
    a, _ = exact.query(ids[::20], q, 10, 1.0)
    b, _ = loose.query(ids[::20], q, 10, 1.5)
    assert loose.visited < exact.visited < 100 * 2000
    assert np.mean([len(set(u) & set(v)) / 10 for u, v in zip(a, b)]) >= 0.9


def test_components(spark):
    e = spark.createDataFrame([(5, 4), (4, 3), (3, 9), (20, 21), (7, 7), (None, 1)], "a long, b long")
    assert {r.node: r.comp for r in connected_components(e).collect()} == {3: 3, 4: 3, 5: 3, 9: 3, 20: 20, 21: 20}


# mixing -----------------------------------------------------------------------------------------------------------------


def poisson_inverse(rate, u):
    k, p = 0, math.exp(-rate)
    c = p
    while c < u:
        k += 1
        p *= rate / k
        c += p
    return k


def plain_copies(ids, rate, seed=17):
    u = lambda i: (int(hashlib.md5(f"{seed}|copies|{'' if i is None else i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
    return {i: poisson_inverse(rate, u(i)) for i in ids}


def test_poisson_replication_equals_plain_inversion(spark):
    rows = [(i, "big" if i % 10 else None, f"t{i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, cdf string")
    out = mixing.mix_sources(docs, keep_key=True).collect()
    n = {"big": 360, None: 40}
    w = {s: math.sqrt(c) for s, c in n.items()}
    want = {}
    for s in n:
        want |= plain_copies([i for i, x, _ in rows if x == s], w[s] / sum(w.values()) * 400 / n[s])
    got = {i: 0 for i in want}
    for r in out:
        got[r.doc_id] += 1
    assert got == want and {r.copy for r in out} == set(range(1, max(want.values()) + 1))
    assert mixing.mix_sources(docs, {"big": 0.0}).count() == 0 and mixing.mix_sources(docs.limit(0)).count() == 0


def test_mixing_beyond_the_broadcast_bound_gives_the_same(spark, monkeypatch):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), (F.col("id") % 7).cast("string")).alias("source"))
    a = sorted(map(tuple, mixing.mix_sources(docs, keep_key=True).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(tuple, mixing.mix_sources(docs, keep_key=True).collect())) == a


# packing ----------------------------------------------------------------------------------------------------------------


def padding(lengths, counts, ends):
    return sum(c * (min(e for e in ends if e >= n) - n) for n, c in zip(lengths, counts))


@pytest.mark.parametrize("buckets", [1, 2, 3, 9])
def test_boundaries_are_optimal(buckets):
    rng = np.random.default_rng(4)
    for _ in range(20):
        lengths = np.sort(rng.choice(60, rng.integers(1, 8), False) + 1)
        counts = rng.integers(1, 30, len(lengths))
        ends = packing.boundaries(lengths, counts, buckets)
        best = min(padding(lengths, counts, [*c, lengths[-1]]) for k in range(min(buckets, len(lengths))) for c in combinations(lengths[:-1].tolist(), k))
        assert padding(lengths, counts, ends) == best and len(ends) <= buckets


def test_packing_covers_every_token_once(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ROWS", 7)
    words = [0, 1, 3, 50, 51, 120, 7, 7, 33] * 4
    docs = spark.createDataFrame([(i % 30, " ".join(["w"] * n) if n else None, "x") for i, n in enumerate(words)], "doc_id long, text string, piece string")
    rows = packing.pack(docs, packing.word_count(), max_len=50, buckets=3, budget=100).collect()
    assert sum(r.n_tokens for r in rows) == sum(words) and all(r.n_tokens <= r.bucket_len <= 50 for r in rows)
    batches = {}
    for r in rows:
        batches.setdefault(r.batch_id, []).append(r)
    assert sorted(batches) == list(range(len(batches)))
    for b in batches.values():
        (end,) = {r.bucket_len for r in b}
        assert sorted(r.slot for r in b) == list(range(len(b))) and len(b) <= max(1, 100 // end)
    short = [(b[0].bucket_len) for b in batches.values() if len(b) < max(1, 100 // b[0].bucket_len)]
    assert len(short) == len(set(short))
    assert packing.pack(docs.limit(0), packing.word_count()).count() == 0


# pipeline ---------------------------------------------------------------------------------------------------------------


def test_stages_one_by_one(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "jaccard_dedup", "secret_scan", "source_mix", "packing"]
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, seen[-1], DATA).write.parquet(f"{tmp_path}/{name}")
        seen.append(spark.read.parquet(f"{tmp_path}/{name}"))
    before, lang, dedup, clean, mixed, packed = (x.collect() for x in seen)
    assert all(x.columns == docs.columns for x in seen[:-1])
    letters = {r.doc_id for r in before if r.text and any(c.isalpha() for c in r.text)}
    assert {r.doc_id for r in lang} <= letters and len(lang) >= 0.95 * len(letters)

    from test_text_operators import plain_components

    rows = sorted(lang, key=lambda r: r.doc_id)
    keep = {rows[i].doc_id for i, _, comp, _ in plain_components([r.text for r in rows]) if i == comp}
    assert {r.doc_id for r in dedup} == keep
    assert {r.doc_id for r in clean} == keep and not any(find_secrets(r.text) for r in clean)
    assert all(r.n_chars == len(r.text) for r in clean)
    assert {r.doc_id for r in mixed} <= keep and mixed
    assert sum(r.n_tokens for r in packed) == sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in mixed)


def test_run_returns_packed_rows(spark):
    assert corpus_pipeline.run(spark, DATA).select("doc_id", "piece", "batch_id", "slot").distinct().count() > 0
