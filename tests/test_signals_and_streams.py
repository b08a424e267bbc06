"""Transforms, beams, seeded draws, probes, intervals, commits, nested records and streams against plain versions."""

from __future__ import annotations

import hashlib
import json
import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from oracle import DATA, difference
from plumbline import plans, streaming
from plumbline.operators import arrays, beams, draws, intervals, probes
from plumbline.sources import TABLES, commits, nested
from plumbline.streaming import models


# transforms -------------------------------------------------------------------------------------------------------------


def test_factorised_transform_equals_the_plain_one_at_any_length(spark):
    rng = np.random.default_rng(1)
    series = {n: rng.normal(size=n) + 1j * rng.normal(size=n) for n in (1, 2, 7, 8, 12, 32, 60, 128)}
    rows = [(n, i, float(v.real), float(v.imag), n) for n, s in series.items() for i, v in enumerate(s)]
    df = spark.createDataFrame(rows, "k int, i int, re double, im double, n int")
    got = arrays.spectrum(df, ["k"], "i", "re", "im", "n").collect()
    for n, s in series.items():
        mine = {r.bin: complex(r.re, r.im) for r in got if r.k == n}
        assert sorted(mine) == list(range(n)) and np.allclose([mine[b] for b in range(n)], np.fft.fft(s), atol=1e-9)
    eight = arrays.spectrum(df.where("k = 7"), [], "i", "re", "im", 8, "hann").collect()
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(7) / 7)
    assert np.allclose([complex(r.re, r.im) for r in sorted(eight, key=lambda r: r.bin)], np.fft.fft(series[7] * w, 8), atol=1e-9)


def test_a_cell_becomes_few_rows(spark):
    df = spark.range(4096).select(F.lit(1).alias("k"), F.col("id").alias("i"), F.sin("id").alias("re"), F.lit(0.0).alias("im"))
    plan = arrays.spectrum(df, ["k"], "i", "re", "im", 4096)
    assert plan.count() == 4096
    n1 = int(np.sqrt(4096))
    assert n1 + 4096 // n1 < 200


def plain_modulation(x, hz):
    m = np.abs(x) - np.abs(x).mean()
    n2 = max(16, 1 << (len(x) - 1).bit_length())
    v = np.abs(np.fft.fft(m, n2))[: n2 // 2]
    f = 1 + int(np.argmax(v[1:]))
    bin_hz = n2 / len(x) * hz
    p = v / v.sum()
    second = v[2 * f] / v[f] if 2 * f < len(v) else 0.0
    return f * bin_hz, 10 * np.log10(v.max() / v.mean()), min(second, 10.0), (v[f::f] ** 2).sum() / (v[1:] ** 2).sum(), -(p * np.log2(p)).sum(), (np.arange(len(v)) * bin_hz * p).sum()


def test_modulation_features(spark):
    rng = np.random.default_rng(2)
    series = {k: rng.normal(size=n) + 2j * np.cos(np.arange(n) * 2 * np.pi / 5) for k, n in enumerate((3, 8, 20, 33, 64))}
    df = spark.createDataFrame([(k, i, float(v.real), float(v.imag)) for k, s in series.items() for i, v in enumerate(s)] + [(9, i, 1.0, 0.0) for i in range(10)], "k int, i int, re double, im double")
    got = {r.k: r for r in arrays.modulation_features(df, ["k"], "i", "re", "im", 2.0).collect()}
    assert all(got[0][c] is None for c in ("fundamental_hz", "depth_db", "entropy_bits")) and len(got) == 6
    for k in (1, 2, 3, 4):
        assert np.allclose([got[k][c] for c in ("fundamental_hz", "depth_db", "harmonic_ratio", "harmonic_share", "entropy_bits", "centroid_hz")], plain_modulation(series[k], 2.0), atol=1e-7)
    assert got[9].harmonic_ratio == 0.0 and got[9].depth_db == 0.0  # a constant magnitude has no modulation


def test_threshold_factors():
    assert abs(arrays.k_tail(3.0, 500.0) - np.exp(-3)) < 2e-3 and abs(arrays.k_tail(0.0, 0.8) - 1) < 1e-4
    rng = np.random.default_rng(3)
    noise = rng.exponential(size=2_000_000) * rng.gamma(0.8, 1 / 0.8, 2_000_000)
    assert abs((noise > arrays.k_threshold(1e-2, 0.8)).mean() - 1e-2) < 5e-4
    log_normal = np.exp(0.7 * rng.normal(size=2_000_000))
    assert abs((log_normal > 1 + arrays.log_normal_alpha(1e-2, 0.7)).mean() - 1e-2) < 5e-4
    assert arrays.k_alpha(16, 1e-3, 1e9) == pytest.approx(arrays.cell_average_alpha(16, 1e-3)) and arrays.k_alpha(0, 1e-3, 1.0) == arrays.log_normal_alpha(1e-3, 0.0) == 0.0
    assert arrays.alpha("ca", "weibull", 16, 1e-3, 1.0) == pytest.approx(arrays.cell_average_alpha(16, 1e-3))
    with pytest.raises(ValueError):
        arrays.alpha("go", "k", 16, 1e-3, 1.0)


# beams ------------------------------------------------------------------------------------------------------------------


def test_covariance_and_minimum_variance(spark):
    rng = np.random.default_rng(4)
    x = {k: rng.normal(size=(n, 40)) + 1j * rng.normal(size=(n, 40)) for k, n in ((1, 3), (2, 5))}
    x[3] = np.zeros((2, 6), complex)
    rows = [(k, c, t, float(v.real), float(v.imag)) for k, m in x.items() for c, s in enumerate(m) for t, v in enumerate(s)] + [(1, 0, 99, 1.0, 1.0), (1, 1, 0, None, None)]
    cov = beams.covariance(spark.createDataFrame(rows, "k int, c int, t int, re double, im double"), ["k"], "c", "t", "re", "im")
    got = {(r.k, r.i, r.j): complex(r.re, r.im) for r in cov.collect()}
    for k, m in x.items():
        r = m @ m.conj().T / m.shape[1]
        assert np.allclose([[got[k, i, j] for j in range(len(m))] for i in range(len(m))], r)
    power = {(r.k, r.azimuth): r.power for r in beams.minimum_variance(cov, ["k"], [0.0, 25.0]).collect()}
    for k in (1, 2):
        r = x[k] @ x[k].conj().T / 40
        r = r + np.eye(len(r)) * 1e-2 * np.trace(r).real / len(r)
        for az in (0.0, 25.0):
            a = beams.steering(len(r), 0.5, az)
            assert power[k, az] == pytest.approx(1 / (a.conj() @ np.linalg.solve(r, a)).real)
    assert power[3, 0.0] == pytest.approx(1e-12 / 2)  # nothing but the least loading
    assert (beams.look_power(np.array([[1, 2], [2, 1]], complex), np.ones((1, 2)), 0.0) == 0).all()


# seeded draws -----------------------------------------------------------------------------------------------------------

W64 = (1 << 64) - 1


def mix(z):
    z = (z ^ (z >> 30)) * draws.MIX_1 & W64
    z = (z ^ (z >> 27)) * draws.MIX_2 & W64
    return z ^ (z >> 31)


@pytest.mark.parametrize("seed", [0, 7, 2**63 + 11])
def test_child_seeds_and_shuffles_equal_the_serial_ones(spark, seed):
    got = spark.range(500).select("id", draws.child_seed(seed, F.col("id")).alias("s")).collect()
    assert all(r.s & W64 == mix(seed ^ (r.id * draws.GAMMA & W64)) for r in got)
    for n in (1, 2, 3, 200):
        items, state = list(range(n)), seed ^ draws.SHUFFLE_WORD
        for i in range(n - 1, 0, -1):
            state = (state + draws.GAMMA) & W64
            j = mix(state) % (i + 1)
            items[i], items[j] = items[j], items[i]
        placed = draws.serial_shuffle(spark.range(n), "id", seed).collect()
        assert [r.id for r in sorted(placed, key=lambda r: r.place)] == items


def test_congruential_draws_equal_the_serial_sequence():
    state, want = 12345, []
    for _ in range(10_000):
        state = (draws.LCG_A * state + draws.LCG_C) & W64
        want.append(state)
    assert draws.lcg_states(12345, 0, 10_000).tolist() == want and draws.lcg_states(12345, 777, 50).tolist() == want[777:827]


def test_median_bootstrap_equals_serial_resampling(spark, monkeypatch):
    monkeypatch.setattr(draws, "BLOCK", 100)
    rng = random.Random(5)
    values = {"a": [rng.gauss(0, 1) for _ in range(40)], "b": [1.5, 2.5], "c": [3.0], "d": [1.0] * 9, "e": [rng.random() for _ in range(3)]}
    rows = [(k, i, v) for k, vs in values.items() for i, v in enumerate(vs)] + [("a", 99, None), ("f", 0, None)]
    got = {r.k: r for r in draws.median_bootstrap(spark.createDataFrame(rows, "k string, i int, v double"), "k", ["i"], "v").collect()}
    assert set(got) == set(values)
    for k, vs in values.items():
        if len(vs) < 3:
            want = (np.median(vs),) * 2
        else:
            state = int.from_bytes(hashlib.sha256(",".join(f"{v:.9g}" for v in vs).encode()).digest()[:8], "big")
            medians = []
            for _ in range(64):
                draw = []
                for _ in vs:
                    state = (draws.LCG_A * state + draws.LCG_C) & W64
                    draw.append(vs[state % len(vs)])
                medians.append(np.median(draw))
            want = np.quantile(medians, [0.05, 0.95])
        assert np.allclose((got[k].median_low, got[k].median_high), want)


def test_keys_of_any_size_are_resampled_alike_and_small_ones_in_one_pass(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(k, i, rng.gauss(0, 1)) for k, n in (("a", 70), ("b", 41), ("c", 3), ("d", 2), (None, 5)) for i in range(n)] + [("b", None, 9.0)]
    df, tidy = spark.createDataFrame(rows, "k string, i int, v double"), lambda x: sorted(map(repr, x.collect()))
    one = draws.median_bootstrap(df, "k", ["i"], "v")
    assert one._jdf.queryExecution().executedPlan().toString().count("Exchange") == 0  # all was done before the cut
    want = tidy(one.selectExpr("k", "n", "round(median_low, 9) AS lo", "round(median_high, 9) AS hi"))
    monkeypatch.setattr(draws, "WHOLE", 40)
    assert tidy(draws.median_bootstrap(df, "k", ["i"], "v").selectExpr("k", "n", "round(median_low, 9) AS lo", "round(median_high, 9) AS hi")) == want
    vs = [v for k, _, v in rows if k == "b"]  # rows without an order value are the last
    state, medians = int.from_bytes(hashlib.sha256(",".join(f"{v:.9g}" for v in vs).encode()).digest()[:8], "big"), []
    for i in range(64):
        medians.append(np.median(np.array(vs)[(draws.lcg_states(state, i * len(vs), len(vs)) % np.uint64(len(vs))).astype(int)]))
    got = {r.k: r for r in one.collect()}
    assert np.allclose((got["b"].median_low, got["b"].median_high), np.quantile(medians, [0.05, 0.95])) and got[None].n == 5 and got[None].median_low is None


# probes -----------------------------------------------------------------------------------------------------------------


def plain_auc(x, y, train, test):
    x = (x - x[train].mean(0)) / np.where(x[train].std(0) > 0, x[train].std(0), 1)
    n = train.sum()
    s = np.where(y == 1, n / (2 * y[train].sum()), n / (2 * (n - y[train].sum())))
    a, w = np.c_[x, np.ones(len(x))], np.zeros(x.shape[1] + 1)
    ridge = np.r_[np.ones(x.shape[1]), 0]
    for _ in range(50):
        p = 1 / (1 + np.exp(-a[train] @ w))
        grad = a[train].T @ (s[train] * (p - y[train])) + ridge * w
        hess = (a[train] * (s[train] * p * (1 - p))[:, None]).T @ a[train] + np.diag(ridge) + 1e-9 * np.eye(len(w))
        w = w - np.linalg.solve(hess, grad)
    z, t = (a @ w)[test], y[test]
    up, down = z[t == 1][:, None], z[t == 0][None]
    return ((up > down) + 0.5 * (up == down)).mean()


def test_probes_equal_a_plain_fit(spark):
    rng = np.random.default_rng(6)
    n = 240
    kind, num = rng.integers(0, 3, n), rng.normal(size=n)
    y = (num + 0.8 * (kind == 1) + rng.normal(size=n) > 0.4).astype(int)
    part = np.array(["train", "test", "validation", "train"])[np.arange(n) % 4]
    df = spark.createDataFrame([(int(i), part[i], int(y[i]), f"k{kind[i]}", float(num[i])) for i in range(n)], "id long, split string, label int, kind string, num double")
    design = np.c_[np.eye(3)[kind], num]
    train, test = part == "train", part == "test"
    assert probes.probe_auc(df, probes.Probe("p", "label", ["kind"], ["num"])) == pytest.approx(plain_auc(design, y, train, test), abs=2e-3)
    assert probes.probe_auc(df, probes.Probe("p", "label", [], ["num"])) == pytest.approx(plain_auc(num[:, None], y, train, test), abs=2e-3)
    assert np.isnan(probes.probe_auc(df, probes.Probe("p", "label", numeric=["num"], rows=F.expr("split <> 'train' or label = 1"))))
    shuffled = probes.shuffled_labels(df, "id", "split", "label", 3).collect()
    assert len(shuffled) == n and any(r.label != r.shuffled for r in shuffled)
    for s in ("train", "test", "validation"):
        assert sum(r.label for r in shuffled if r.split == s) == sum(r.shuffled for r in shuffled if r.split == s)


def test_verdicts(spark):
    of = lambda rows: spark.createDataFrame(rows, "probe string, auc double, gated boolean")
    some = of([("a", 0.5, True), ("b", float("nan"), True), ("c", 0.9, False)])
    assert [probes.verdict(some, 0.6, f).first().status for f in (True, False)] == ["fail", "pass"]
    assert probes.verdict(of([("a", 0.7, True)]), 0.6, False).first().asDict() == {"status": "fail", "worst": 0.7, "failed": "a"}


# intervals --------------------------------------------------------------------------------------------------------------


def test_interval_join_equals_pairs(spark):
    rng = random.Random(7)
    make = lambda n: [(rng.choice("ab"), i, s, s + rng.choice([0, 0.3, 2, 50, 4000]) * rng.random()) for i, s in ((i, rng.uniform(-100, 300)) for i in range(n))]
    l, r = make(120), make(100)
    l += [("a", 900, 1.0, None), ("a", 901, 5.0, 4.0), (None, 902, 0.0, 9.0)]
    df = lambda x: spark.createDataFrame(x, "k string, id int, start double, end double")
    got = sorted((x.id, x.right_id) for x in intervals.interval_join(df(l), df(r), ["k"], base=1.0).collect())
    assert got == sorted((a[1], b[1]) for a in l for b in r if a[0] == b[0] and a[3] is not None and a[2] <= a[3] and a[2] <= b[3] and b[2] <= a[3])
    assert intervals.interval_join(df([]), df(r), ["k"]).count() == 0


def test_tolerant_lookup(spark):
    lib = spark.createDataFrame([(0, "w", 1.0, 1e-3, 10.0), (1, "w", 1.004, 1e-3, 11.0), (2, None, 1.0, 1e-3, 12.0)], "e int, noise string, shape double, pfa double, alpha double")
    want = spark.createDataFrame([(1, "w", 1.002, 1e-3), (2, "w", 1.0089, 1e-3), (3, "w", 1.02, 1e-3), (4, None, 1.0, 1.0005e-3), (5, "w", 1.0, 1.1e-3), (6, "w", None, 1e-3), (1, "w", 1.002, 1e-3)], "id int, noise string, shape double, pfa double")
    got = sorted((r.id, r.factor) for r in intervals.tolerant_lookup(want, lib, ["noise"], {"shape": (0.005, False), "pfa": (0.001, True)}, "e", "alpha", "factor").collect())
    assert got == [(1, 10.0), (1, 10.0), (2, 11.0), (3, None), (4, 12.0), (5, None), (6, None)]


# commits, nested records ------------------------------------------------------------------------------------------------


def test_a_failure_between_tables_leaves_the_old_root(spark, tmp_path):
    root = f"file://{tmp_path}/root"
    good = {"a": spark.range(3), "b": spark.range(5)}
    assert commits.write_root(good, root) == 0
    broken = {"a": spark.range(9), "b": spark.range(4).select(F.raise_error(F.lit("lost")).alias("id"))}
    with pytest.raises(Exception, match="lost"):
        commits.write_root(broken, root)
    assert {k: v.count() for k, v in commits.read_root(spark, root).items()} == {"a": 3, "b": 5}
    assert commits.write_root({"a": spark.range(1)}, root) == 1 and set(commits.read_root(spark, root)) == {"a"} and commits.read_root(spark, root, 0)["b"].count() == 5


def test_a_replayed_batch_is_not_written_twice(spark, tmp_path):
    streaming.write_in_batches(spark.range(30).withColumn("at", F.col("id")), f"{tmp_path}/in", "at", [9, 19])
    root, calls = f"file://{tmp_path}/root", []
    split = lambda b: calls.append(1) or {"all": b.select("id")}
    commits.stream_to_root(streaming.replay(spark, f"{tmp_path}/in"), split, root, f"{tmp_path}/one")
    assert len(calls) == 3
    commits.stream_to_root(streaming.replay(spark, f"{tmp_path}/in"), split, root, f"{tmp_path}/two")  # progress was lost: all batches come again
    assert len(calls) == 3 and sorted(r.id for r in commits.read_batches(spark, root, "all").collect()) == list(range(30))


def test_nested_paths(spark):
    docs = [(1, '{"a":1,"b":[true,{"c":"x","d":[]},[2.5]],"e":null}'), (2, "no json"), (3, None), (4, '"plain"'), (5, "{}")]
    got = sorted((r.k, r.path, r.value) for r in nested.explode_paths(spark.createDataFrame(docs, "k int, j string"), "k", "j").collect())
    assert got == [(1, "$.a", "1"), (1, "$.b[0]", "true"), (1, "$.b[1].c", "x"), (1, "$.b[2][0]", "2.5"), (1, "$.e", None), (4, "$", "plain")]


# streams ----------------------------------------------------------------------------------------------------------------


def detector_frames(spark, n=40):
    rng = np.random.default_rng(8)
    rows = [(r, t, *[float(x) for x in (rng.uniform(0, 25), t % 9, rng.uniform(-80, 80), rng.uniform(0, 160), rng.uniform(0, 25), rng.uniform(0, 0.4), rng.uniform(0, 0.4))]) for t in range(n) for r in range(5)]
    return spark.createDataFrame(rows, "record int, tick long, " + ", ".join(f"{c} double" for c in models.FEATURES))


def test_detectors_on_a_stream_equal_those_on_a_table_over_a_restart(spark, tmp_path):
    frames = detector_frames(spark)
    tidy = lambda rows: sorted((r.record, r.tick, r.model, round(r.confidence, 9), r.triggered) for r in rows.collect())
    want = tidy(models.run_models(frames, "record", "tick", 0.45))
    streaming.write_in_batches(frames.where("tick < 30"), f"{tmp_path}/in", "tick", [9, 19])
    live = lambda: streaming.run_to_table(models.models_stream(streaming.replay(spark, f"{tmp_path}/in"), "record", "tick", 0.45), f"{tmp_path}/out")
    rows, progress = live()
    assert sum(p["numInputRows"] > 0 for p in progress) == 3 and tidy(rows) == [w for w in want if w[1] < 30]
    frames.where("tick >= 30").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    assert tidy(live()[0]) == want and sum(w[-1] for w in want) > 5


def test_terms_of_the_feature_tree_are_added_from_the_left(spark):
    def tree(r):
        speed = abs(r.rate_mps)
        x = 0.08 + (0.28 if 35 <= speed <= 75 else 0.04) + (0.24 if 25 <= r.modulation <= 130 else 0.05) + (0.18 if 2 <= r.area <= 18 else 0.04) + max(0.0, min(0.28, (r.snr_db - 4) / 18))
        return max(0.0, min(1.0, x - 0.24 * r.clutter - 0.18 * r.interference))

    rows = detector_frames(spark).withColumn("got", models.confidences()["feature_tree"]).collect()
    assert [r.got for r in rows] == [tree(r) for r in rows]  # to the last bit, as a threshold is


def odd_events(folder):
    """Events with missing values, users and times, of which a user has one at most; and values that are no numbers."""
    c, source = duckdb.connect(), f"{DATA}/events.parquet"
    for t in TABLES:
        if t != "events":
            os.symlink(f"{DATA}/{t}.parquet", f"{folder}/{t}.parquet")
    c.execute(f"""COPY (SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 3 AND user_id > 0 THEN NULL ELSE ts END AS ts, CASE WHEN user_id = 0 THEN NULL ELSE user_id END AS user_id, event_type,
        CASE event_id % 13 WHEN 1 THEN NULL WHEN 2 THEN 'nan'::DOUBLE WHEN 3 THEN 'inf'::DOUBLE WHEN 4 THEN '-inf'::DOUBLE ELSE value END AS value, props FROM '{source}') TO '{folder}/events.parquet' (FORMAT parquet)""")
    return str(folder)


@pytest.mark.parametrize("name", ["detector_models", "detector_stream"])
def test_detectors_on_odd_events_equal_sql(spark, tmp_path, name):
    assert difference(spark, plans.QUERIES[name], plans.ORACLE_SQL[name], odd_events(tmp_path)) is None


def test_frames_of_the_trigger_all_say_so(spark, tmp_path):
    frames = detector_frames(spark).withColumn("tick", F.floor(F.col("tick") / 40)).withColumns({"snr_db": F.lit(25.0), "clutter": F.lit(0.0), "interference": F.lit(0.0)})
    streaming.write_in_batches(frames, f"{tmp_path}/in", "tick", [9])
    rows, _ = streaming.run_to_table(models.models_stream(streaming.replay(spark, f"{tmp_path}/in"), "record", "tick", 0.4), f"{tmp_path}/out")
    tidy = lambda x: sorted((r.record, r.model, r.triggered) for r in x.collect())
    assert tidy(rows) == tidy(models.run_models(frames, "record", "tick", 0.4)) and rows.where("triggered").count() == 600


def test_joined_streams_let_state_go(spark, tmp_path):
    minutes = spark.range(600).select((F.col("id") % 7).alias("k"), F.col("id").alias("n"), F.timestamp_seconds(F.col("id") * 60 + 1_000_000_000).alias("at"))
    for side in ("l", "r"):
        streaming.write_in_batches(minutes.withColumnRenamed("at", f"{side}t").withColumnRenamed("n", f"{side}n"), f"{tmp_path}/{side}", f"{side}n", [149, 299, 449])
    l, r = (streaming.replay(spark, f"{tmp_path}/{s}") for s in "lr")
    rows, progress = streaming.run_to_table(streaming.matched(l, r, ["k"], "lt", "rt", "30 minutes"), f"{tmp_path}/out")
    want = sorted((a, b) for a in range(600) for b in range(a, min(a + 31, 600)) if a % 7 == b % 7)
    assert sorted((x.ln, x.rn) for x in rows.collect()) == want
    held = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]
    assert held[-1] < 300 < 1200  # of both sides' 1,200 rows


def test_progress_is_json(spark, tmp_path):
    spark.range(5).write.parquet(f"{tmp_path}/in")
    rows, progress = streaming.run_to_table(streaming.replay(spark, f"{tmp_path}/in"), f"{tmp_path}/out")
    assert rows.count() == 5 and json.dumps(progress)
