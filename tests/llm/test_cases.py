"""Cases that once were lost, and the operators against enumeration and brute force."""

from __future__ import annotations

import base64
import itertools
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from plumbline.llm import jaccard_join, language, packing, pii, pivot_index, secrets, substring_dedup, token_counts, vp_tree
from test_text_operators import KEY, b64, der, frame, number, plain_components, texts_with_copies


def added(text):
    return [x[0] for x in secrets.find_secrets(text) if not x[3]]


def wrap(body, width=64):
    return "\n".join(body[i : i + width] for i in range(0, len(body), width))


# secrets ----------------------------------------------------------------------------------------------------------------


def test_armour_of_any_length_and_up_to_the_next_block():
    big = der(0x30, *[number(x) for x in (0, (1 << 16_000) - 5, 65537, (1 << 15_000) + 7, 11, 13, 7, 5, 3)])
    text = f"-----BEGIN PRIVATE KEY-----\n{' ' * 30_000}{wrap(base64.b64encode(big).decode())}\n-----END PRIVATE KEY-----"
    assert len(text) > 30_000 and added(text) == ["pem"]
    assert added("-----BEGIN PRIVATE KEY-----\n" + f"-----BEGIN PRIVATE KEY-----\n{base64.b64encode(KEY).decode()}\n-----END PRIVATE KEY-----") == ["pem"]


@pytest.mark.parametrize("head", ['{ "alg": "none"}', '{\n "alg":"HS256"}', ' {"alg":"x"}', '{\t"alg":""}', '{"alg":""}'])
def test_token_headers_are_told_by_decoding(head):
    text = f"a {b64(head.encode())}.{b64(b'{}')}.zz b"
    assert added(text) == ["jwt"] and re.search(secrets._ANY, text)


def test_keys_after_a_path_wrapped_or_in_hex():
    body = base64.b64encode(der(0x30, *[number(x) for x in (0, (1 << 1024) - 5, 65537, (1 << 1020) + 7, 11, 13, 7, 5, 3)])).decode()
    raw = base64.b64decode(body)
    assert added(f"path/{body} x") == added(f"k\n{wrap(body)}\nplain words") == added(f"k {wrap(raw.hex(), 60)}\nmore") == ["der"]
    ssh = secrets._MAGIC + b"".join(len(x).to_bytes(4, "big") + x for x in (b"none", b"none", b"")) + b"\0\0\0\1" + b"".join(len(x).to_bytes(4, "big") + x for x in (b"public" * 5, b"private" * 30))
    assert added(f"x {wrap(base64.b64encode(ssh).decode(), 70)}\nplain") == added(f"h {ssh.hex()} z") == ["ssh"]
    assert added(f"s: {base64.b64encode(f'-----BEGIN PRIVATE KEY-----{chr(10)}{wrap(body)}{chr(10)}-----END PRIVATE KEY-----'.encode()).decode()} z") == ["pem"]


def test_long_lists_of_heads_and_of_addresses_take_time_in_proportion():
    for start in (b"\x30\x84\x7f\xff\xff\xff\x02\x01\x00", b"\x30\x83\x0f\xff\xff\x02\x01\x07"):  # longer than the text; no key
        head = base64.b64encode(start + b"\x41" * 39).decode()
        lines = "\n".join([head] * (2_000_000 // (len(head) + 1)))
        began = time.process_time()
        assert added(lines) == []
        assert time.process_time() - began < 10
    text = "/".join(["10.1.2.3"] * 100_000)
    began = time.process_time()
    graph = pii.document_graph(text, pii.base_spans(text))
    assert sum(x > 0 for x in graph.label) == 100_000 and time.process_time() - began < 10


def test_a_key_is_found_after_a_stretch_of_lines_that_is_too_short_for_others():
    body = base64.b64encode(KEY).decode()
    false = base64.b64encode(b"\x30\x82\xff\xf0\x02\x01\x00" + b"\x41" * 41).decode()
    text = "\n".join([false, false, false[:40], "word", *wrap(body).split("\n")])
    assert added(text + " end") == ["der"]


def test_nesting_is_parsed_at_all_depths():
    deep = b"\x05\x00"
    for _ in range(30):
        deep = der(0x30, deep)
    assert secrets.tlv(deep, 0, len(deep)) and secrets.tlv(deep[:-1] + b"\x05", 0, len(deep)) is None


# personal data ----------------------------------------------------------------------------------------------------------


def test_long_tokens_are_nodes_whole_and_cut_at_spans():
    long = "x" * 600 + "12345"
    assert len(pii.document_graph(f"word {long} word", []).spans) == 1
    a, b = "y" * 100 + "7" + "z" * 400, "y" * 100 + "8" + "z" * 400
    assert not set(pii._keys(a)) & set(pii._keys(b))  # tokens alike in their first letters are not equal
    text = '{"a":"anna.berg@example.org","b":"anna.berg","c":"10.0.0.1"}' * 40
    base = pii.base_spans(text)
    g = pii.document_graph(text, base)
    inside = [x for x in g.label if x > 0]
    assert len(inside) == len(base) == 80 and sum(text[s:e] == "anna.berg" for s, e in g.spans) == 40


def exact_marginals(w, g):
    n, k = len(g.spans), pii.N_LABELS
    z = np.array([w.unary[f].sum(0) for f in g.feats])
    p = np.zeros((n, k))
    for y in itertools.product(range(k), repeat=n):
        if any(label > 0 and y[i] != label for i, label in enumerate(g.label)):
            continue
        s = sum(z[i, v] for i, v in enumerate(y) if g.label[i] <= 0) + sum(w.edge[t][y[i], y[j]] for i, j, t in g.edges)
        for i, v in enumerate(y):
            p[i, v] += np.exp(s)
    return p / p.sum(1, keepdims=True)


@pytest.mark.parametrize("edges, close", [([(0, 1, 0), (1, 2, 1), (1, 3, 1), (3, 4, 0)], 1e-3), ([(0, 1, 0), (1, 2, 0), (0, 2, 1), (2, 3, 1)], 0.05)])
def test_marginals_equal_enumeration_on_trees_and_nearly_on_a_loop(edges, close):
    rng = np.random.default_rng(3)
    w = pii.Weights(rng.normal(0, 0.7, (pii.WIDTH, pii.N_LABELS)), rng.normal(0, 0.5, (2, pii.N_LABELS, pii.N_LABELS)))
    w.edge[1] = (w.edge[1] + w.edge[1].T) / 2
    n = 1 + max(max(e[:2]) for e in edges)
    g = pii.Graph([(0, 0)] * n, [[i, 50 + i] for i in range(n)], [2] + [-1] * (n - 1), edges)
    (p,) = pii.marginals(w, [g])
    assert abs(p - exact_marginals(w, g)).max() < close


# passages ---------------------------------------------------------------------------------------------------------------


def test_gaps_are_aligned_by_longest_common_subsequence():
    rng = random.Random(4)
    for _ in range(300):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(12))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            row = [0] + list(itertools.accumulate(range(len(b)), lambda best, j, r=row, x=x: max(best, r[j + 1], r[j] + (b[j] == x)), initial=0))[1:]
        assert substring_dedup.matched_between(np.array(a, np.uint32), np.array(b, np.uint32)) == row[-1]


def found_pairs(spark, texts, least=50):
    rows = substring_dedup.shared_passages(frame(spark, texts)).collect()
    return {i for r in rows if r.end_word - r.start_word >= least for i in (r.doc_id, r.ref_doc_id)}


def test_holders_of_a_passage_are_found_beside_many_that_hold_a_part_of_it(spark):
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(10**6)}"
    texts, want = [], set()
    for _ in range(40):
        p = [word() for _ in range(60)]
        rows = [[*(word() for _ in range(30)), *p, *(word() for _ in range(30))] for _ in range(2)] + [[*(word() for _ in range(40)), *p[20:40], *(word() for _ in range(40))] for _ in range(12)]
        rng.shuffle(rows)
        want |= {len(texts) + i for i, r in enumerate(rows) if all(x in r for x in (p[0], p[-1]))}
        texts += [" ".join(r) for r in rows]
    assert found_pairs(spark, texts) == want


def test_an_edited_passage_is_found_though_each_of_its_seeds_names_others(spark):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(10**6)}"
    texts, want = [], set()
    for _ in range(10):
        p = [word() for _ in range(104)]
        q = [word() if i % 13 == 12 else x for i, x in enumerate(p)]
        rows = [[*(word() for _ in range(30)), *x, *(word() for _ in range(30))] for x in (p, q)]
        rows += [[*(word() for _ in range(50)), *p[i : i + 12], *(word() for _ in range(50))] for i in range(0, 104, 13) for _ in range(30)]
        want.add((len(texts), len(texts) + 1))
        texts += [" ".join(r) for r in rows]
    got = {tuple(sorted((r.doc_id, r.ref_doc_id))) for r in substring_dedup.shared_passages(frame(spark, texts)).collect()}
    assert got == want


def test_a_sentence_of_very_many_texts_makes_no_pairs_to_align_and_a_word_on_end_few_matches():
    rng = np.random.default_rng(4)
    k, n = substring_dedup.SEED, 400
    line = rng.integers(1, 1 << 63, 13, dtype=np.uint64)
    texts = [np.r_[rng.integers(1, 1 << 63, 60, dtype=np.uint64), line, rng.integers(1, 1 << 63, 60, dtype=np.uint64)] for _ in range(n)]
    texts[7] = np.r_[texts[7][:60], line, texts[3][73:]]  # one pair shares what follows, too
    rows = []
    for t in range(n):
        at = np.arange(60, 68, 3, dtype=np.int32)
        seeds = np.array([hash(tuple(texts[t][p : p + k].tolist())) & (1 << 62) - 1 for p in at], np.uint64)
        near = substring_dedup.around(texts[t], at, np.zeros(3, np.int64), np.full(3, len(texts[t])), k, substring_dedup.NEAR)
        rows.append({"node": t, "comp": t, "spans": None, "x": seeds.tobytes(), "y": at.tobytes(), "near": near.tobytes()})
    schema = pa.schema([("node", pa.int64()), ("comp", pa.int64()), ("spans", pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))), *((c, pa.binary()) for c in ("x", "y", "near"))])
    block = substring_dedup._Block(pa.Table.from_pylist(rows, schema))
    none = tuple(np.zeros(0, np.int64) for _ in range(4))
    got = [(int(a), int(b)) for i, j, _, _ in substring_dedup.promising_pairs(block, block, True, none, k, 50) for a, b in zip(i, j)]
    assert (7, 3) in got and len(set(got)) < n  # of 79,800 pairs: others where bytes of words that differ are alike
    seed, own, pos = np.full(700, 9, np.uint64), np.repeat([0, 1], 350), np.tile(np.arange(350, dtype=np.int32), 2)
    keep = np.flatnonzero(substring_dedup.ends_of_runs(seed, own, pos, 8))
    assert {0, 349, 350, 699} <= set(keep.tolist()) and len(keep) <= 2 * (350 // substring_dedup.EVERY + 2)


@pytest.mark.parametrize("rate, least", [(0.1, 0.9), (0.2, 0.6)])
def test_recall_of_edited_passages(spark, rate, least):
    """100 words with a share replaced, lost or doubled; each pair alone."""
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(10**6)}"
    texts = []
    for _ in range(60):
        p = [word() for _ in range(100)]
        q = [x for w in p for x in ([w] if rng.random() >= rate else rng.choice([[word()], [word()], [], [w, word()]]))]
        texts += [" ".join([*(word() for _ in range(80)), *x, *(word() for _ in range(80))]) for x in (p, q)]
    got = found_pairs(spark, texts)
    assert sum(2 * i in got and 2 * i + 1 in got for i in range(60)) >= least * 60


def test_first_look_at_a_batch_of_pairs_equals_that_at_each():
    s, rng = substring_dedup, np.random.default_rng(11)
    rows = []
    for _ in range(300):
        doc, ref = (rng.integers(0, 3, int(rng.integers(30, 200))).astype(np.uint32) for _ in "ab")
        n = rng.integers(1, 4, int(rng.integers(1, 5))).astype(np.int32)
        y, x = (np.sort(rng.integers(0, len(w) - 6, n.sum())).astype(np.int32) for w in (doc, ref))
        rows.append((n, x, y, doc, ref))
    cols = [pa.array([c.tobytes() for c in col], pa.binary()) for col in zip(*rows)]
    b = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array(range(300)), *cols], ["node", "ref", "n", "x", "y", "words", "ref_words"])
    want = []
    for n, x, y, doc, ref in rows:
        ends = np.cumsum(n)
        want.append(s._promising(x, y, list(zip((ends - n).tolist(), ends.tolist())), ref, doc, 6, 50))
    assert 0 < sum(map(bool, want)) < 300
    assert s._first_look(b, 6, 50) == want and s._first_look(b.slice(7, 90), 6, 50) == want[7:97]


def test_exact_passages_equal_brute_force(spark):
    rng = random.Random(2)
    word = lambda: f"w{rng.randrange(10**6)}"
    pool = [[word() for _ in range(rng.randrange(35, 90))] for _ in range(8)]
    texts = [" ".join(sum(([*(word() for _ in range(20)), *rng.choice(pool)] for _ in range(rng.randrange(1, 3))), [])) for _ in range(60)] + [None, "", "a b"]
    windows = [{tuple(w[i : i + 50]) for i in range(len(w) - 49)} for w in ((t or "").split() for t in texts)]
    seen = {}
    for i, x in enumerate(windows):
        for g in x:
            seen.setdefault(g, set()).add(i)
    want = {i for g, x in seen.items() if len(x) > 1 for i in x}
    assert want and want <= found_pairs(spark, texts)
    shared = {i for i, x in enumerate(windows) if len((texts[i] or "").split()) >= 50}
    assert found_pairs(spark, texts) <= shared


def test_a_window_meets_its_partner_among_very_many_holders_of_its_core():
    rng = np.random.default_rng(2)
    n, true = 200_000, 200
    win = (rng.integers(0, 1 << 32, n + 2 * true, dtype=np.uint64).astype(np.uint32) | 1)[:, None]
    win[n : n + true] = win[n + true :]
    order = rng.permutation(len(win))
    x, y = substring_dedup.whole_matches(np.zeros(len(win), np.uint64), np.arange(len(win)), np.zeros(len(win), np.int32), win[order], 50)
    at = np.argsort(order)
    found = {(min(a, b), max(a, b)) for a, b in zip(x.tolist(), y.tolist())}
    want = [tuple(sorted((int(at[n + i]), int(at[n + true + i])))) for i in range(true)]
    assert sum(w in found for w in want) >= true - 1


# shingles, vectors ------------------------------------------------------------------------------------------------------


def test_frequent_shingles_keep_one_order(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "FREQUENT", 3)
    texts = texts_with_copies(seed=5, groups=8, per=7)
    got = sorted(tuple(r)[:4] for r in jaccard_join.jaccard_links(frame(spark, texts)).select("doc_id", "n_shingles", "component_id", "n_links").collect())
    assert got == plain_components(texts)


def planted(n, dim, pairs, seed=1):
    rng = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    x = unit(rng.normal(size=(n, dim)))
    z = rng.normal(size=(pairs, dim))
    z = unit(z - (z * x[:pairs]).sum(1, keepdims=True) * x[:pairs])
    c = rng.uniform(0.931, 0.95, (pairs, 1))
    hot = unit(x[-1] + 0.02 * rng.normal(size=(200, dim)))  # a list of near copies
    return np.vstack([x, unit(c * x[:pairs] + np.sqrt(1 - c**2) * z), hot])


def test_pivot_recall_of_planted_pairs_and_candidates_before_products(spark):
    n, pairs = 10_000, 1000
    x = planted(n, 64, pairs)
    rows = [(i, [float(c) for c in v], 1) for i, v in enumerate(x.astype(np.float32))]
    got = {r.vec_id: r.n_links for r in pivot_index.pivot_links(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert sum(got[i] >= 1 and got[n + i] >= 1 for i in range(pairs)) >= 0.95 * pairs
    near = x @ x[n + pairs :].T >= 0.93
    assert sum(got[n + pairs + j] for j in range(200)) >= 0.9 * (near.sum() - 200)
    assert all(got[i] == 0 for i in range(pairs, n - 1) if not near[i].any())
    pivots = pivot_index.farthest_first(x[:512].astype(float), 160)
    perm = pivot_index.permutations(x[:4000].astype(float), pivots, pivot_index.PREFIX)
    mine = np.flatnonzero((perm == 7).any(1))
    share = pivot_index.candidates(7, perm[mine], None, pivot_index.SHARED).sum() / (len(mine) * (len(mine) - 1) / 2)
    assert share < 0.5  # in a list; others of its pairs are never multiplied


def test_tree_prunes_on_clusters_and_a_relaxed_factor_keeps_recall(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(128, 64))
    x = np.repeat(base, 32, 0) + 0.05 * rng.normal(size=(4096, 64))
    ids, q = np.arange(4096), x[::20]
    truth = np.argsort(-(q @ x.T), axis=1, kind="stable")
    runs = {}
    for factor in (1.0, 1.1):
        s = vp_tree.Search(ids, x)
        got, _ = s.query(np.full(len(q), -1), q, 20, factor)
        runs[factor] = s.visited / (len(q) * 4096), np.mean([len(set(g) & set(t[:20])) / 20 for g, t in zip(got, truth)])
    assert runs[1.0][1] == 1.0 and runs[1.0][0] < 0.2  # share of pairs scored
    assert runs[1.1][1] >= 0.9 and runs[1.1][0] <= runs[1.0][0] / 2


def test_vantage_bounds_prune_wide_clusters_of_unit_vectors():
    rng = np.random.default_rng(0)
    base = rng.normal(size=(128, 64))
    x = np.repeat(base / np.linalg.norm(base, axis=1)[:, None], 32, 0) + 0.05 * rng.normal(size=(4096, 64))
    ids, q = np.arange(4096), x[::20]
    score = q @ x.T
    score[np.arange(len(q)), ids[::20]] = -np.inf
    truth = np.argsort(-score, axis=1, kind="stable")[:, :20]
    runs = {}
    for factor in (1.0, 2.0):
        s = vp_tree.Search(ids, x)
        got, _ = s.query(ids[::20], q, 20, factor)
        runs[factor] = s.visited / (len(q) * 4096), np.mean([len(set(g) & set(t)) / 20 for g, t in zip(got, truth)])
    assert runs[1.0][1] == 1.0 and runs[1.0][0] < 0.7
    assert runs[2.0][1] >= 0.9 and runs[2.0][0] <= runs[1.0][0] / 2


def test_regions_and_floors_keep_the_search_exact(spark):
    rng = np.random.default_rng(8)
    x = np.repeat(rng.normal(size=(20, 16)), 40, 0) + 0.05 * rng.normal(size=(800, 16))
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in vp_tree.nearest(df, df.where("vec_id % 20 = 0"), k=7, shard_rows=50, query_rows=9).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    for i in range(0, 800, 20):
        s = np.add.accumulate(x * x[i], axis=1)[:, -1]
        s[i] = -np.inf
        assert got[i] == np.lexsort((np.arange(800), -s))[:7].tolist()


# language ---------------------------------------------------------------------------------------------------------------


def test_language_sets_equal_enumeration():
    rng = np.random.default_rng(6)
    langs = 6
    own = [[bytes(rng.choice(list(letters), 5)) for _ in range(40)] for letters in (b"abcd", b"efgh", b"ijkl", b"mnop", b"qrst", b"uvwx")]
    grams = lambda w: language._grams(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0]
    counts = np.full((language.BUCKETS, langs), 0.5)
    for i, ws in enumerate(own):
        for w in ws:
            np.add.at(counts[:, i], grams(w), 20)
    model = language.Model([f"l{i}" for i in range(langs)], np.log(counts / counts.sum(0)).astype(np.float32))
    words = [w for ws in own for w in ws]
    lik = [model.logp[grams(w)].sum(0) for w in words]
    data, off = [], [0]
    for mix in ([0], [0, 1], [0, 1, 2, 3, 4], list(range(6))):
        ws = [40 * m + int(rng.integers(40)) for m in mix for _ in range(80)]
        text = b" ".join(words[i] for i in ws)
        data.append(text), off.append(off[-1] + len(text))
        ll = np.array([lik[i] for i in ws])
        ll = np.exp(np.maximum(ll - ll.max(1, keepdims=True), -language.CLIP))

        def fit(members):
            pi = np.full(len(members), 1 / len(members))
            for _ in range(300):
                r = pi * ll[:, members]
                pi = (r / r.sum(1, keepdims=True)).mean(0)
            return np.log((pi * ll[:, members]).sum(1)).sum() - (len(members) - 1) * language.PENALTY * np.log(len(ws))

        top = max((fit(list(m)), m) for k in range(1, langs + 1) for m in itertools.combinations(range(langs), k))
        lang, share, size = language.infer(model, np.frombuffer(b"".join(data), np.uint8)[off[-2] :], np.array([0, len(text)]))
        assert size[0] == len(top[1]) == len(mix) and lang[0] in top[1]


# pipeline ---------------------------------------------------------------------------------------------------------------

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, score double, N_Langs string"


def sentences(seed, n=40):
    rng = random.Random(seed)
    return " ".join(rng.choice(["der", "die", "das", "und", "ist", "nicht", "haus", "baum"]) + str(rng.randrange(900)) for _ in range(n))


def test_stages_on_repeated_ids_nulls_and_clashing_names(spark):
    t, u = sentences(1), sentences(2, 50)
    rows = [(1, t, "de", "a"), (2, t, "de", "a"), (2, u, "de", "b"), (2, u, "de", "b"), (None, u, "de", None), (3, None, "de", "a"), (4, "", "de", "a"), (5, "12 34", None, "b")]
    docs = spark.createDataFrame([(*r, 1, "k", 0.5, "x") for r in rows], DOCS)
    kept = corpus_pipeline.language_id(spark, docs, "")
    assert kept.columns == docs.columns and kept.count() == 5 and {r.score for r in kept.collect()} == {0.5}
    once = corpus_pipeline.jaccard_dedup(spark, docs, "").orderBy("doc_id", "text").collect()
    assert sorted(((r.doc_id, r.text) for r in once), key=str) == sorted([(None, u), (1, t), (2, u), (3, None), (4, ""), (5, "12 34")], key=str)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        assert (out.columns == docs.columns) == (name != "packing") and out.count() > 0
        assert stage(spark, docs.limit(0), "").count() == 0


def test_run_on_an_empty_and_on_a_whole_table(spark, tmp_path):
    docs = spark.createDataFrame([(i, sentences(i % 9, 30 + i % 9), "de", "ab"[i % 2], 1) for i in range(40)] + [(7, "-", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, df in (("empty", docs.limit(0)), ("some", docs)):
        df.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        rows = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert bool(rows) == (name == "some") and all(len(r.text.split()) == r.n_tokens for r in rows)


def test_pieces_joined_are_the_text(spark):
    text = "  " + "\n".join(f"w{i}  x\t" for i in range(700)) + " end "
    rows = sorted(packing.pack_texts(spark.createDataFrame([(1, text), (2, None), (3, " \n"), (4, "a b")], "doc_id long, text string"), max_len=100).collect(), key=lambda r: (r.doc_id, r.piece))
    assert "".join(r.text for r in rows if r.doc_id == 1) == text.lstrip(" ") and [r.text for r in rows if r.doc_id != 1] == ["a b"]
    assert all(len(r.text.split()) == r.n_tokens <= 100 and r.start == 100 * r.piece for r in rows)


# empty tables and very long texts ---------------------------------------------------------------------------------------


def test_scanners_on_empty_tables_and_very_long_texts(spark):
    long = "plain words of a text " * 60_000
    docs = frame(spark, [long + "token = abcdef123456 x@y.org", None, ""])
    model = language.Model(["aa", "bb"], np.log(np.random.default_rng(1).dirichlet(np.ones(language.BUCKETS), 2).T).astype(np.float32))
    w = pii.fit_field(docs)
    for f in (secrets.scan_secrets, lambda d: pii.scan_pii(d, w), token_counts.count_tokens, lambda d: language.identify(d, model), substring_dedup.shared_passages):
        assert f(docs.limit(0)).count() == 0
    (r, *_) = secrets.scan_secrets(docs).orderBy("doc_id").collect()
    assert [(s.kind, s.start - len(long)) for s in r.spans if s.base] == [("assign", 0)]
    (r, *_) = pii.scan_pii(docs, w).orderBy("doc_id").collect()
    assert [(s.kind, s.start - len(long)) for s in r.spans if s.base] == [("email", 21)]
    assert token_counts.count_tokens(docs).orderBy("doc_id").first().n_words == len((long + "token = abcdef123456 x@y.org").split(" "))
    assert language.identify(docs, model).orderBy("doc_id").first().lang_pred in ("aa", "bb")
