"""Streams of states, bootstrap, quantiles and stores against plain Python."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline import functions as fn
from plumbline import sources, streaming
from plumbline.operators import arrays, audits, graph, joining, prefix, splits, statistics, tracking


def plain_tracks(frames):
    tracks, out, number = [], [], 1
    for f, dets in frames:
        free, new = set(range(len(tracks))), []
        for r, v, snr, c in dets:
            near = sorted((abs(tracks[i]["r"] - r), i) for i in free if abs(tracks[i]["r"] - r) < 280.0)
            if near:
                t = tracks[near[0][1]]
                free.discard(near[0][1])
                t.update(r=t["r"] + 0.45 * (r - t["r"]), v=t["v"] + 0.45 * (v - t["v"]), snr=snr, c=c, age=t["age"] + 1, miss=0)
            else:
                new.append((r, v, snr, c))
        for i in free:
            tracks[i]["miss"] += 1
        tracks = [t for t in tracks if t["miss"] <= 4]
        for r, v, snr, c in new:
            tracks.append(dict(id=number, r=r, v=v, snr=snr, c=c, age=1, miss=0))
            number += 1
        out += [(f, t["id"], round(t["r"], 6), round(t["v"], 6), t["snr"], t["c"], t["age"], t["miss"]) for t in tracks]
    return out


def detections(seed=1):
    rng = np.random.default_rng(seed)
    return {s: [(f, [(float(rng.uniform(0, 3000)), float(rng.normal()), float(k), 0.5 + k / 10) for k in range(rng.integers(1, 4))]) for f in range(30)] for s in ("a", "b", "c")}


def test_tracks_equal_plain_association_in_batch_and_stream(spark, tmp_path):
    sets = detections()
    rows = [(s, f, k, *d) for s, fs in sets.items() for f, ds in fs for k, d in enumerate(ds)]
    df = spark.createDataFrame(rows, "session string, frame long, ord int, range_m double, velocity_mps double, snr_db double, confidence double")
    want = sorted((s, *t) for s, fs in sets.items() for t in plain_tracks(fs))
    tidy = lambda df: sorted((r.session, r.frame, r.track_id, round(r.range_m, 6), round(r.velocity_mps, 6), r.snr_db, r.confidence, r.age_frames, r.misses) for r in df.collect())
    assert tidy(tracking.associate(df, "session", "frame", "ord")) == want and min(w[2] for w in want) == 1
    df.coalesce(1).sortWithinPartitions("session", "frame", "ord").write.parquet(f"{tmp_path}/in")
    stream = streaming.track_stream(streaming.replay(spark, f"{tmp_path}/in").drop("ord"), "session", "frame")
    assert tidy(streaming.run_to_memory(stream, "tracks")) == want


def test_tiers_follow_a_boost_climb_and_cruise(spark):
    speed = [0.0, 10.0, 20.0, 30.0, 34.0, 34.5, 34.6, 35.0, 35.2, *[45.0] * 30, *[5.0] * 8]
    rows = [(r, float(i), v, 100.0) for r in (1, 2) for i, v in enumerate(speed)]
    out = tracking.assign_tiers(spark.createDataFrame(rows, "record int, t double, speed double, altitude double"), "record", "t", "speed", "altitude")
    for r in (1, 2):
        tiers = [x.tier for x in out.where(F.col("record") == r).orderBy("t").collect()]
        runs = [t for i, t in enumerate(tiers) if i == 0 or tiers[i - 1] != t]
        assert runs[0] == "none" and [t for t in runs if t != "none"][:3] == ["boost", "climb", "cruise"] and runs[-1] == "none"


def test_bootstrap_equals_a_plain_one(spark):
    rng = np.random.default_rng(2)
    rows = [(int(g), float(rng.integers(0, 12)) / 12, int(rng.random() < 0.4)) for g in np.repeat(np.arange(25), 4)]
    got = {r.metric: r for r in statistics.bootstrap_ci(spark.createDataFrame(rows, "group_id long, score double, label_id int"), rounds=40).collect()}
    z = statistics._draws(5, np.arange(40)[None, :], np.arange(25)[:, None], 25)
    auc, brier = [], []
    for r in range(40):
        w = np.bincount(z[:, r], minlength=25)
        s, y, k = (np.array(x) for x in zip(*[(s, y, w[g]) for g, s, y in rows if w[g]]))
        pos, neg = k * y, k * (1 - y)
        won = sum(p * (neg[s < t].sum() + neg[s == t].sum() / 2) for t, p in zip(s, pos))
        auc.append(won / pos.sum() / neg.sum()), brier.append((k * (s - y) ** 2).sum() / k.sum())
    for name, v in (("roc_auc", auc), ("brier", brier)):
        assert (got[name].low, got[name].mean, got[name].high) == pytest.approx((np.quantile(v, 0.025), np.mean(v), np.quantile(v, 0.975)))
    assert set(got) == set(statistics.METRICS) and all(r.rounds == 40 for r in got.values())


def test_round_weights_in_parts_count_every_draw(spark, monkeypatch):
    monkeypatch.setattr(statistics, "COUNTED", 3 * statistics.SLICE)
    n = 7 * statistics.SLICE + 5
    got = statistics.round_weights(spark, n, 3, 5).collect()
    assert len(got) == 8 * 3
    for r in range(3):
        packed = [x.w for x in sorted(got, key=lambda x: x.slice) if x.round == r]
        sizes = [min(statistics.SLICE, n - i * statistics.SLICE) for i in range(8)]
        w = np.concatenate([statistics._unpack(x, k, np.uint16) for x, k in zip(packed, sizes)])
        assert (w == np.bincount(statistics._draws(5, np.int64(r), np.arange(n), n), minlength=n)).all()


def test_bootstrap_sends_counts_and_no_draws(spark):
    store = spark.sparkContext._jsc.sc().statusStore()

    def sent() -> int:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        found = store.executorList(False)
        return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))

    rows = spark.range(60_000).selectExpr("id % 20000 AS group_id", "id % 7 / 7 AS score", "cast(id % 3 = 0 AS int) AS label_id")
    before = sent()
    assert {r.rounds for r in statistics.bootstrap_ci(rows).collect()} == {200}
    assert sent() - before < 1.5 * 20_000 * 200  # counts, and rows; draws would be ten bytes each


def test_quantiles_by_rank(spark):
    rng = np.random.default_rng(3)
    rows = [("a", float(x)) for x in rng.integers(0, 9, 101)] + [("b", float(x)) for x in rng.normal(size=40)] + [("c", 4.0), ("a", None), ("d", None)]
    points = [0.0, 0.1, 0.5, 0.77, 1.0]
    got = {r.k: r.q for r in prefix.quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", points).collect()}
    assert set(got) == {"a", "b", "c"}
    for k in got:
        assert got[k] == pytest.approx(np.quantile([v for x, v in rows if x == k and v is not None], points).tolist())


def test_buckets_by_bisection_keep_order(spark):
    df = spark.createDataFrame([(float(i % 97),) for i in range(2000)] + [(None,), (float("nan"),)], "v double")
    rows = prefix.with_buckets(df, "v", buckets=16).collect()
    finite = sorted((r.v, r._bucket) for r in rows if r.v is not None and not math.isnan(r.v))
    assert all(a[1] <= b[1] for a, b in zip(finite, finite[1:])) and len({b for _, b in finite}) == 16
    assert [r._bucket for r in rows if r.v is None] == [0]


def test_stores_refuse_what_does_not_fit(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    row = lambda shape, n: spark.createDataFrame([("x", shape, [1.0] * n)], "name string, shape array<int>, values array<double>")
    with pytest.raises(Exception, match="do not fit"):
        sources.write_tensors(row([2, 2], 3), root)
    sources.write_tensors(row([2, 2], 4), root)
    with pytest.raises(Exception, match="t/x"):
        sources.write_tensors(row([2, 2], 4), root)
    with pytest.raises(ValueError, match="not written"):
        sources.write_csv(spark.createDataFrame([(1, 2)], "a int, b int"), f"{tmp_path}/c", ["a"])
    with pytest.raises(ValueError, match="is not"):
        sources.assert_aligned(spark.createDataFrame([(0, "a")], "p int, k string"), spark.createDataFrame([(0, "b")], "p int, k string"), "p", "k")
    with pytest.raises(KeyError):
        sources.gather(spark.createDataFrame([("z", 1)], "id string, place int"), spark.createDataFrame([("a", 1.0)], "id string, v double"), ["id"], "place")


def test_sequence_with_a_null_fails(spark, tmp_path):
    with pytest.raises(Exception, match="has a null"):
        sources.write_sequence(spark.createDataFrame([(1.0,), (None,)], "a double"), f"{tmp_path}/s")


def test_quota_and_policy_edges(spark):
    assert splits.holdout_quota(100, 10) == (15, 85, 2, 8) and splits.holdout_quota(12, 3) == (5, 7, 2, 1)
    with pytest.raises(ValueError):
        splits.holdout_quota(5, 5)
    names = spark.createDataFrame([("range_m",), ("my_range_x",), ("orange",)], "name string")
    got = audits.policy_violations(names, spark.createDataFrame([("range_m",)], "restricted string"))
    assert {r.name for r in got.collect()} == {"range_m", "my_range_x"}
    assert audits.column_sets(names, ["id"], ["name"]) == (["id"], ["name"])


def test_stable_seed_equals_the_hash(spark):
    want = int.from_bytes(hashlib.blake2b(b"7|fold|x", digest_size=8).digest(), "big") & ((1 << 63) - 1)
    assert spark.range(1).select(fn.stable_seed(F.lit(7), F.lit("fold"), F.lit("x")).alias("s")).first().s == want


@pytest.mark.parametrize("alpha, pick", [(arrays.greatest_of_alpha, max), (arrays.smallest_of_alpha, min)])
def test_factors_of_the_greater_and_smaller_side(alpha, pick):
    rng = np.random.default_rng(4)
    a = alpha(6, 0.05)
    left, right = rng.gamma(6, size=400_000), rng.gamma(6, size=400_000)
    noise = np.maximum(left, right) if pick is max else np.minimum(left, right)
    assert (rng.exponential(size=400_000) > a * noise).mean() == pytest.approx(0.05, abs=0.003)
    assert arrays.weibull_alpha(16, 1e-3, 1.0) == pytest.approx(arrays.cell_average_alpha(16, 1e-3)) and arrays.weibull_alpha(0, 0.1, 2.0) == 0.0


def test_a_shared_folder_is_asked_for_on_a_cluster(monkeypatch):
    class Conf:
        def get(self, *a):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        graph.shared_folder(Session())


def test_nearest_train_beyond_a_block(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(90, 5))
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, v array<double>")
    got = {r.id: r.nearest_id for r in joining.nearest_train(df, F.col("id") % 3 == 0, "id", "v", block=20).collect()}
    train = np.array([i for i in range(90) if i % 3])
    z = (x - x[train].mean(0)) / (x[train].std(0) + 1e-6)
    assert got == {i: int(train[((z[train] - z[i]) ** 2).sum(1).argmin()]) for i in range(0, 90, 3)}


def test_suppression_equals_greedy_order(spark):
    rng = np.random.default_rng(6)
    rows = [(k, int(rng.integers(0, 25)), float(rng.integers(0, 5)) / 2, float(rng.integers(1, 9))) for k in ("a", "b") for _ in range(25)]
    rows = sorted({r[:3]: r for r in rows}.values())
    want = []
    for k in ("a", "b"):
        kept = []
        for r in sorted((r for r in rows if r[0] == k), key=lambda r: (-r[3], r[1], r[2])):
            if not any(abs(r[1] - q[1]) < 3 and abs(r[2] - q[2]) < 0.5 for q in kept):
                kept.append(r)
        want += kept
    got = arrays.suppress(spark.createDataFrame(rows, "g string, start int, gradient double, power double"), ["g"])
    assert sorted((r.g, r.start, r.gradient, r.power) for r in got.collect()) == sorted(want)
    assert arrays.suppress(spark.createDataFrame([], "g string, start int, gradient double, power double"), ["g"]).count() == 0
