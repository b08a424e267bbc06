"""Edge cases of the operators on small fixtures, against plain Python."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline import functions as fn
from plumbline import sources, streaming
from plumbline.operators import arrays, frames, grouping, joining, prefix, ranking, splits, statistics
from plumbline.operators.graph import components

SCORED = "m string, label_id int, score double, ord long"


def scored(spark, rows):
    return spark.createDataFrame([("m", *r, i) for i, r in enumerate(rows)], SCORED)


def plain_auc(rows):
    pos, neg = [s for l, s in rows if l], [s for l, s in rows if not l]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_auc_with_ties(spark):
    rng = np.random.default_rng(1)
    rows = [(int(rng.random() < 0.4), float(rng.integers(0, 5)) / 4) for _ in range(60)]
    assert ranking.roc_auc(scored(spark, rows), ["m"]).first().roc_auc == pytest.approx(plain_auc(rows))


@pytest.mark.parametrize("empty", [None, 0.5])
def test_auc_of_one_class(spark, empty):
    assert ranking.roc_auc(scored(spark, [(1, 0.2), (1, 0.3)]), ["m"], empty=empty).first().roc_auc == empty


def test_metrics_of_an_empty_slice(spark):
    e = scored(spark, [])
    assert ranking.roc_auc(e, ["m"]).count() == ranking.average_precision(e, ["m"]).count() == ranking.roc_curve(e, ["m"]).count() == 0


def test_average_precision_by_row(spark):
    rows = [(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.1)]
    assert ranking.average_precision(scored(spark, rows), ["m"]).first().average_precision == pytest.approx((1 + 2 / 3) / 2)


def test_calibration_score_on_a_bin_edge(spark):
    bins = {r.bin: r.n for r in ranking.calibration_bins(scored(spark, [(1, 0.5), (0, 0.5), (1, 1.0), (0, 0.0)]), ["m"]).collect() if r.n}
    assert bins == {0: 1, 5: 2, 9: 1}


def test_prefix_sums_match_a_running_sum(spark):
    vals = [float(x) for x in np.random.default_rng(2).permutation(200)]
    df = spark.createDataFrame([("k", v, 1) for v in vals], "k string, v double, one long")
    got = {r.v: r.run for r in prefix.prefix_sums(df, ["k"], "v", {"run": "one"}).collect()}
    assert got == {v: i + 1 for i, v in enumerate(sorted(vals))}


def test_row_numbers_are_a_permutation(spark):
    df = spark.range(300).select((F.col("id") % 3).alias("k"), F.hash("id").cast("double").alias("v"))
    got = prefix.row_numbers(df, ["k"], "v").groupBy("k").agg(F.collect_set("row").alias("r")).collect()
    assert all(sorted(x.r) == list(range(1, 101)) for x in got)


def fnv1a(text):
    h = 0xCBF29CE484222325
    for b in text.encode():
        h = (h ^ b) * 0x100000001B3 % 2**64
    return h


def test_fnv_buckets(spark):
    texts = ["", "a", "lang=xx|source=yy", "ünï", "x" * 500]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.b for r in df.select(fn.fnv1a_mod(F.col("t")).alias("b")).collect()] == [fnv1a(t) % 10_000 for t in texts]


def test_hash_split_obeys_hint_and_key(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "b", "test")], "id long, k string, h string")
    got = {r.id: r.split for r in splits.hash_split(df, ["k"], hint="h").collect()}
    b = fnv1a("k=a") % 10_000
    assert got[1] == got[2] == ("train" if b < 7000 else "validation" if b < 8500 else "test") and got[3] == "test"


def test_leakage_report_finds_a_key_in_two_splits(spark):
    df = spark.createDataFrame([("1", "g", "train"), ("2", "g", "test"), ("3", "h", "train"), ("4", None, "test")], "id string, k string, s string")
    (r,) = splits.leakage_report(df, ["k"], "s", "id").collect()
    assert (r.value, r.first_split, r.other_split, r.first_id, r.other_id) == ("g", "train", "test", "1", "2")


def test_wilson_at_zero_trials_and_known_value(spark):
    lo, hi = spark.range(1).select(fn.wilson(F.lit(8.0), F.lit(10.0)).alias("w")).first().w
    assert (lo, hi) == pytest.approx((0.490162, 0.943318), abs=1e-5)


def test_parsing(spark):
    r = spark.createDataFrame([("1.5",), ("x",), (None,)], "t string").select(fn.safe_float(F.col("t"), 0.0).alias("f"), fn.safe_int(F.col("t")).alias("i")).collect()
    assert [x.f for x in r] == [1.5, 0.0, 0.0] and r[1].i == r[2].i == 0


def test_sigmoid_does_not_overflow(spark):
    r = spark.createDataFrame([(-1e4,), (0.0,), (1e4,)], "x double").select(fn.sigmoid(F.col("x")).alias("s")).collect()
    assert [x.s for x in r] == [0.0, 0.5, 1.0]


def test_components_of_a_path_and_a_pair(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99)], "a long, b long")
    got = {r[0]: r[1] for r in components(edges).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[100] == got[99] == 99


def test_wasserstein_and_ks(spark):
    a, b = [0.0, 1.0, 2.0, 3.0], [1.0, 2.0, 3.0, 4.0]
    df = spark.createDataFrame([("k", True, x) for x in a] + [("k", False, x) for x in b], "k string, s boolean, v double")
    w = statistics.wasserstein(df, ["k"], F.col("s"), "v").first()
    k = statistics.kolmogorov_smirnov(df, ["k"], F.col("s"), "v").first()
    assert [x for x in w if isinstance(x, float)][0] == pytest.approx(1.0) and [x for x in k if isinstance(x, float)][0] == pytest.approx(0.25)


def test_runs_and_trigger(spark):
    flags = [0, 1, 1, 0, 1, 1, 1]
    df = spark.createDataFrame([("r", i, float(i), f) for i, f in enumerate(flags)], "r string, i int, t double, f int")
    first = frames.first_trigger(df, ["r"], ["i"], F.col("f") == 1).first()
    assert first.i == 2


def test_circular_mean_wraps(spark):
    got = spark.createDataFrame([(350.0,), (10.0,)], "d double").agg(grouping.circular_mean(F.col("d")).alias("m")).first().m
    assert min(got, 360 - got) == pytest.approx(0.0, abs=1e-9)


def test_last_by_key_and_uniqueness(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("", 3, "z")], "k string, o int, v string")
    assert [tuple(r) for r in joining.last_by_key(df, ["k"], "o").select("k", "v").collect()] == [("a", "y")]
    with pytest.raises(ValueError):
        joining.assert_unique(df, ["k"], "left")


def test_range_semi_join_equals_a_loop(spark):
    rng = np.random.default_rng(3)
    l, r = [(i, float(v)) for i, v in enumerate(rng.uniform(0, 20_000, 80))], [(i, float(v)) for i, v in enumerate(rng.uniform(0, 20_000, 40))]
    a, b = (spark.createDataFrame([("k", *x) for x in t], "k string, id int, v double") for t in (l, r))
    got = {x.id for x in joining.range_semi(a, b, ["k"], "v").select("id").collect()}
    assert got == {i for i, v in l if any(abs(v - w) <= max(150.0, 0.03 * v) for _, w in r)}


def test_order_statistic_factor_solves_its_equation():
    a = arrays.order_statistic_alpha(16, 12, 1e-2)
    assert math.prod((16 - i) / (16 - i + a) for i in range(12)) == pytest.approx(1e-2, rel=1e-6)


def test_sinks_and_scans(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, t string")
    sources.write_csv(df, f"{tmp_path}/c")
    assert sources.csv(spark, f"{tmp_path}/c", "id int, t string").orderBy("id").collect()[1].t is None
    assert sources.csv(spark, f"{tmp_path}/none", "id int", optional=True).count() == 0
    sources.write_jsonl(df, f"{tmp_path}/j")
    assert sources.nonempty_lines(spark, f"{tmp_path}/j") == 2
    with pytest.raises(ValueError):
        sources.write_csv(df, "/etc/x")


def test_tensor_scan(spark, tmp_path):
    d = tmp_path / "root" / "power"
    d.mkdir(parents=True)
    (d / ".zarray").write_text('{"shape": [2, 3], "dtype": "<f4"}')
    (d / "0.raw").write_bytes(np.arange(6, dtype="<f4").tobytes())
    (r,) = sources.tensors(spark, str(tmp_path / "root")).collect()
    assert (r.name, r.shape, r["values"]) == ("power", [2, 3], [0.0, 1.0, 2.0, 3.0, 4.0, 5.0])


def test_frames_round_trip(spark):
    df = spark.createDataFrame([("s", 7, [0, 5, 255])], "session string, seq int, cells array<int>")
    header, cells = sources.decode_frame(bytes(sources.encode_frames(df, ["session", "seq"], "cells").first().frame))
    assert header == {"session": "s", "seq": 7} and cells == bytes([0, 5, 255])


def test_trigger_stream_carries_state_between_batches(spark, tmp_path):
    for k, part in enumerate([[("a", 0, 0.9), ("b", 0, 0.1)], [("a", 1, 0.8), ("b", 1, 0.9)]]):
        pd.DataFrame(part, columns=["rec", "i", "s"]).to_parquet(tmp_path / f"{k}.parquet")
    out = streaming.run_to_memory(streaming.trigger_stream(streaming.replay(spark, str(tmp_path)), "rec", "i", "s", 0.5), "triggers")
    assert [(r.rec, r.i) for r in out.collect()] == [("a", 1)]
