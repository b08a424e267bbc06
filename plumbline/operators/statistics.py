"""Distances between distributions, resampling, log-odds models, and their gates."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .graph import keep, stored
from .prefix import prefix_sums, quantiles, with_buckets
from .ranking import ratio


def _ecdf(df: DataFrame, keys: list[str], side: Column, value: str) -> DataFrame:
    """Per distinct value the two distribution functions; ``side`` is true for the first sample."""
    per = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count_if(side).alias("a"), F.count_if(~side).alias("b"))
    n = per.groupBy(*keys).agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    run = prefix_sums(per, keys, value, {"ca": "a", "cb": "b"})
    run = run.join(n, keys) if keys else run.crossJoin(F.broadcast(n))
    return run.withColumns({"fa": F.when(F.col("na") > 0, F.col("ca") / F.col("na")), "fb": F.when(F.col("nb") > 0, F.col("cb") / F.col("nb"))})


def wasserstein(df: DataFrame, keys: list[str], side: Column, value: str) -> DataFrame:
    """W1 as the integral of the distance between the distribution functions; infinite if either sample is empty.

    By parts: the integral is a sum over neighbouring values, whose gaps are windows inside quantile buckets plus one gap
    between each bucket and the next."""
    e = with_buckets(_ecdf(df, keys, side, value), value).withColumn("_d", F.abs(F.col("fa") - F.col("fb")))
    nxt = F.lead(value).over(Window.partitionBy(*keys, "_bucket").orderBy(value))
    inside = e.withColumn("_g", F.coalesce(F.col("_d") * (nxt - F.col(value)), F.lit(0.0)))
    per = inside.groupBy(*keys, "_bucket").agg(F.sum("_g").alias("_s"), F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.max_by("_d", value).alias("_dl"), F.max("na").alias("na"), F.max("nb").alias("nb"))
    w = Window.partitionBy(*keys).orderBy("_bucket")
    per = per.withColumn("_s", F.col("_s") + F.coalesce(F.col("_dl") * (F.lead("_lo").over(w) - F.col("_hi")), F.lit(0.0)))
    return per.groupBy(*keys).agg(F.when((F.max("na") > 0) & (F.max("nb") > 0), F.sum("_s")).otherwise(F.lit(float("inf"))).alias("w1"))


def wasserstein_grid(df: DataFrame, keys: list[str], side: Column, value: str, points: int = 101) -> DataFrame:
    """Mean distance of quantiles on an even grid."""
    grid = [i / (points - 1) for i in range(points)]
    a, b = (quantiles(df.where(x), keys, value, grid).withColumnRenamed("q", n) for x, n in ((side, "a"), (~side, "b")))
    q = a.join(b, keys) if keys else a.crossJoin(b)
    return q.select(*keys, (F.aggregate(F.zip_with("a", "b", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x) / points).alias("w1_grid"))


def kolmogorov_smirnov(df: DataFrame, keys: list[str], side: Column, value: str) -> DataFrame:
    """Largest distance of the distribution functions, right under ties; NaN if either sample is empty."""
    return _ecdf(df, keys, side, value).groupBy(*keys).agg(F.coalesce(F.max(F.abs(F.col("fa") - F.col("fb"))), F.lit(float("nan"))).alias("ks"))


def overlap_coefficient(df: DataFrame, keys: list[str], side: Column, value: str, bins: int = 40) -> DataFrame:
    """Shared mass of two histograms on their common range; 1 if the range is a point."""
    r = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count_if(side).alias("_na"), F.count_if(~side).alias("_nb"))
    d = df.join(r, keys) if keys else df.crossJoin(F.broadcast(r))
    b = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1))).otherwise(0)
    h = d.groupBy(*keys, b.alias("_b")).agg((F.count_if(side) / F.first("_na")).alias("a"), (F.count_if(~side) / F.first("_nb")).alias("b"))
    return h.groupBy(*keys).agg(F.sum(F.least("a", "b")).alias("overlap"))


def robust_peak(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(greatest - median) / (median absolute deviation + 1e-6), with medians by rank: no task holds a key's values."""
    middle = quantiles(df, keys, value, [0.5]).select(*keys, F.col("q")[0].alias("_m"))
    apart = df.join(middle, keys).select(*keys, F.abs(F.col(value) - F.col("_m")).alias("_d"))
    spread = quantiles(apart, keys, "_d", [0.5]).select(*keys, F.col("q")[0].alias("_mad"))
    top = df.groupBy(*keys).agg(F.max(value).alias("_x"))
    return top.join(middle, keys).join(spread, keys).select(*keys, ((F.col("_x") - F.col("_m")) / (F.col("_mad") + 1e-6)).alias("peak_score"))


#: A prime below 2^31 and multipliers of the draws: integer steps that any engine repeats.
_PRIME, _MIX = 2147483647, (1103515245, 1640531527, 1181783497, 668265263)


def _draws(seed: int, rounds: np.ndarray, index: np.ndarray, n: int) -> np.ndarray:
    """A number below ``n`` from seed, round and index."""
    z = ((index % _PRIME) * _MIX[0] + (rounds * _MIX[1] + seed) % _PRIME) % _PRIME
    for m in _MIX[2:]:
        z = ((z ^ (z >> 15)) * m) % _PRIME
    return z % n


#: Groups whose weights travel together; groups that one task counts; scores that a task adds up before it passes them on.
SLICE, COUNTED, SCORES = 1 << 12, 1 << 26, 1 << 13


def _pack(x: np.ndarray) -> bytes:
    """An array's bytes, those of equal place in a number side by side, compressed."""
    return pa.compress(np.ascontiguousarray(x.reshape(-1).view(np.uint8).reshape(-1, x.itemsize).T).tobytes(), codec="zstd", asbytes=True)


def _unpack(b: bytes, count: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    flat = np.frombuffer(pa.decompress(b, decompressed_size=count * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(flat.reshape(size, count).T).view(kind).reshape(-1)


def round_weights(spark: SparkSession, n: int, rounds: int, seed: int) -> DataFrame:
    """``(slice, round, w)``: how often each of ``n`` numbered groups is drawn in each round, as many draws with replacement as there are groups;
    16-bit counts of ``SLICE`` groups, packed.

    A task makes the draws of a round and counts them where they fall, so no draw is ever sent: only counts are, of two bits each when
    packed.  Beyond ``COUNTED`` groups a round is counted in parts, by tasks that each make its draws and count their part's."""
    parts = -(-n // COUNTED)
    width = min(rounds * parts, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for task in b.column(0).to_pylist():
                r, low = task // parts, task % parts * COUNTED
                w = np.zeros(min(COUNTED, n - low), np.uint16)
                for lo in range(0, n, 1 << 18):
                    z = _draws(seed, np.int64(r), np.arange(lo, min(n, lo + (1 << 18)), dtype=np.int64), n)
                    np.add.at(w, z if parts == 1 else z[(z >= low) & (z < low + len(w))] - low, 1)
                for lo in range(0, len(w), SLICE * 256):
                    mine = range(lo, min(len(w), lo + SLICE * 256), SLICE)
                    packed = [_pack(w[i : i + SLICE]) for i in mine]
                    yield pa.RecordBatch.from_arrays([pa.array([(low + i) // SLICE for i in mine], pa.int64()), pa.array([r] * len(packed), pa.int32()), pa.array(packed, pa.binary())], ["slice", "round", "w"])

    return spark.range(0, rounds * parts, 1, max(1, width)).mapInArrow(count, "slice long, round int, w binary")


METRICS = ["roc_auc", "average_precision", "brier", "ece", "recall_at_fpr"]


def bootstrap_ci(scored: DataFrame, group: str = "group_id", rounds: int = 200, seed: int = 5, low: float = 0.025, high: float = 0.975, fpr: float = 0.01, bins: int = 10) -> DataFrame:
    """Group-block bootstrap: percentile interval and mean of five metrics over rounds of resampled groups: ROC AUC, average
    precision (tied scores are one step), Brier score, calibration error over equal bins, recall at a false-positive rate.

    A row is never repeated by round: slices of groups meet their packed weights, tasks add them up by score, and buckets of
    the score order, each a task, take running sums on matrices of scores x rounds from the totals of the buckets above.
    A metric without positives or negatives in a round leaves the round out."""
    spark = scored.sparkSession
    per = scored.groupBy(group, "score").agg(F.sum("label_id").cast("double").alias("p"), F.sum(1 - F.col("label_id")).cast("double").alias("n"))
    per = per.withColumn("_first", (F.row_number().over(Window.partitionBy(group).orderBy("score")) == 1).cast("int"))
    per, drop = stored(per)
    groups = max(1, per.agg(F.sum("_first")).first()[0] or 0)
    # groups are numbered by id where their rows are
    no = F.col("_no") - 1
    rows = prefix_sums(with_buckets(per, "score", "_b"), [], group, {"_no": "_first"}, then=[F.col("score")])
    rows = rows.select(F.floor(no / SLICE).cast("long").alias("slice"), F.lit(None).cast("int").alias("round"), F.lit(None).cast("binary").alias("w"), (no % SLICE).cast("int").alias("at"), F.col("_b").alias("_bucket"), "score", "p", "n")
    both = rows.unionByName(round_weights(spark, groups, rounds, seed), allowMissingColumns=True)
    both = both.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "slice").sortWithinPartitions("slice", F.col("round").asc_nulls_last())

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A slice's weights, then its rows, slice after slice; one row per bucket and score, or more if there are many."""
        weights, known, sums_p, sums_n = None, {}, None, None

        def flush() -> pa.RecordBatch:
            bucket, s = zip(*known)
            arrays = [pa.array([_pack(x) for x in m[: len(known)]], pa.binary()) for m in (sums_p, sums_n)]
            return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(s, pa.float64()), *arrays], ["_bucket", "score", "p", "n"])

        at_slice = None
        for b in batches:
            slices, given = b.column("slice").to_numpy(zero_copy_only=False), b.column("round").is_valid().to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((slices[1:] != slices[:-1]) | (given[1:] != given[:-1])) + 1
            for lo, hi in zip([0, *edges], [*edges, b.num_rows]):
                if hi == lo:
                    continue
                part, size = b.slice(lo, hi - lo), min(SLICE, groups - int(slices[lo]) * SLICE)
                if given[lo]:
                    if at_slice != slices[lo]:
                        at_slice, weights = slices[lo], np.zeros((size, rounds), np.uint16)
                    for r, w in zip(part.column("round").to_pylist(), part.column("w").to_pylist()):
                        weights[:, r] = _unpack(w, size, np.uint16)
                    continue
                s, bucket = part.column("score").to_numpy(zero_copy_only=False), part.column("_bucket").to_numpy(zero_copy_only=False)
                w = weights[part.column("at").to_numpy(zero_copy_only=False)].astype(float)
                order = np.lexsort((s, bucket))
                s, bucket, w = s[order], bucket[order], w[order]
                first = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) | (bucket[1:] != bucket[:-1])])
                s1, b1 = s[first], bucket[first]
                p1, n1 = (np.add.reduceat(part.column(c).to_numpy(zero_copy_only=False)[order][:, None] * w, first) for c in ("p", "n"))
                if sums_p is None or len(known) + len(s1) > len(sums_p):
                    if known:
                        yield flush()
                    known, sums_p, sums_n = {}, *(np.zeros((max(SCORES, len(s1)), rounds)) for _ in "pn")
                into = np.array([known.setdefault(x, len(known)) for x in zip(b1.tolist(), s1.tolist())])
                sums_p[into] += p1
                sums_n[into] += n1
        if known:
            yield flush()

    sums = keep(both.mapInArrow(combine, "_bucket int, score double, p binary, n binary"))
    drop()

    def by_score(s: np.ndarray, p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(s, kind="stable")
        s = s[order]
        at = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        return s[at], np.add.reduceat(p[order], at), np.add.reduceat(n[order], at)

    def matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p, n = (np.array([_unpack(x, rounds, float) for x in t.column(c).to_pylist()]) for c in ("p", "n"))
        return by_score(t.column("score").to_numpy(), p, n)

    def total(t: pa.Table) -> pa.Table:
        _, p, n = matrix(t)
        return pa.table({"_bucket": pa.array([t.column("_bucket")[0].as_py()], pa.int32()), "tp": pa.array([p.sum(0).tolist()]), "fp": pa.array([n.sum(0).tolist()])})

    # one row per bucket: the totals of the buckets above and of all
    totals = sums.groupBy("_bucket").applyInArrow(total, "_bucket int, tp array<double>, fp array<double>")
    long = totals.select("_bucket", F.posexplode(F.arrays_zip("tp", "fp")).alias("round", "x"))
    above, whole = Window.partitionBy("round").orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("round")
    long = long.select("_bucket", "round", *[F.coalesce(F.sum(f"x.{c}").over(above), F.lit(0.0)).alias(c) for c in ("tp", "fp")], F.sum("x.tp").over(whole).alias("pos"), F.sum("x.fp").over(whole).alias("neg"))
    entry = F.sort_array(F.collect_list(F.struct("round", "tp", "fp", "pos", "neg")))
    long = long.groupBy("_bucket").agg(entry.alias("t")).select("_bucket", *[F.col(f"t.{c}").alias(c) for c in ("tp", "fp", "pos", "neg")])

    def measure(key: tuple, t: pa.Table, before: pa.Table) -> pa.Table:
        s, p, n = matrix(t)
        tp0, fp0, pos, neg = (np.array(before.column(c)[0].as_py()) for c in ("tp", "fp", "pos", "neg"))
        p, n = p[::-1], n[::-1]  # from the top
        s = s[::-1][:, None]
        tp, fp = tp0 + p.cumsum(0), fp0 + n.cumsum(0)
        with np.errstate(invalid="ignore", divide="ignore"):
            won = (p * (neg - fp + n / 2)).sum(0) / (pos * neg)
            ap = np.where(p > 0, p * tp / (tp + fp), 0.0).sum(0) / pos
            brier = (p * (s - 1) ** 2 + n * s**2).sum(0) / (pos + neg)
            reach = np.where((pos > 0) & (neg > 0), np.where(fp / neg <= fpr, tp / pos, 0.0).max(0), np.nan)
        out = [(m, r, -1, float(x), 0.0) for m, v in (("roc_auc", won), ("average_precision", ap), ("brier", brier), ("recall_at_fpr", reach)) for r, x in enumerate(v)]
        at = np.minimum(np.floor(s[:, 0] * bins), bins - 1).astype(int)
        for k in np.unique(at[(s[:, 0] >= 0) & (s[:, 0] <= 1)]):
            mine = at == k
            gap = p[mine].sum(0) - ((p + n)[mine] * s[mine]).sum(0)
            out += [("ece", r, int(k), float(x), float(y)) for r, (x, y) in enumerate(zip(gap, pos + neg))]
        c = list(zip(*out))
        return pa.table({"metric": pa.array(c[0], pa.string()), "round": pa.array(c[1], pa.int32()), "bin": pa.array(c[2], pa.int32()), "v": pa.array(c[3], pa.float64()), "size": pa.array(c[4], pa.float64())})

    parts = sums.groupBy("_bucket").cogroup(long.groupBy("_bucket")).applyInArrow(measure, "metric string, round int, bin int, v double, size double")
    per_bin = parts.groupBy("metric", "round", "bin").agg(F.sum("v").alias("v"), F.max("v").alias("top"), F.max("size").alias("size"))
    v = F.when(F.col("metric") == "recall_at_fpr", F.col("top")).when(F.col("metric") == "ece", F.abs("v") / F.col("size")).otherwise(F.col("v"))
    one = per_bin.groupBy("metric", "round").agg(F.sum(v).alias("v")).where(~F.isnan("v") & F.col("v").isNotNull())
    return one.groupBy("metric").agg(F.percentile("v", low).alias("low"), F.avg("v").alias("mean"), F.percentile("v", high).alias("high"), F.count("v").alias("rounds"))


def log_odds_weights(train: DataFrame, keys: list[str], features: list[str], label: str = "label_id") -> DataFrame:
    """Diagonal Gaussian discriminant per key: w = (mean1 - mean0) / (var + 1e-3) per feature, intercept from the midpoints and a
    Laplace prior; with one class every weight is 0.1 and the intercept 0."""
    y = F.col(label) == 1
    aggs = [F.count_if(y).alias("_p"), F.count_if(~y).alias("_n")]
    for f in features:
        aggs += [F.avg(F.when(y, F.col(f))).alias(f"_m1_{f}"), F.avg(F.when(~y, F.col(f))).alias(f"_m0_{f}"), F.var_pop(f).alias(f"_v_{f}")]
    return _weights(train.groupBy(*keys).agg(*aggs), keys, features, "_p", "_n", lambda f, k: F.col(f"_m{k}_{f}"), lambda f: F.col(f"_v_{f}"))


def _weights(a: DataFrame, keys: list[str], features: list[str], pos: str, neg: str, mean, var) -> DataFrame:
    both = (F.col(pos) > 0) & (F.col(neg) > 0)
    w = {f: F.when(both, (mean(f, 1) - mean(f, 0)) / (var(f) + 1e-3)).otherwise(0.1) for f in features}
    mid = sum((w[f] * (mean(f, 1) + mean(f, 0)) / 2 for f in features), F.lit(0.0))
    b = F.when(both, F.log((F.col(pos) + 1) / (F.col(neg) + 1)) - mid).otherwise(0.0)
    return a.select(*keys, *[w[f].alias(f"w_{f}") for f in features], b.alias("intercept"))


def cross_fit(df: DataFrame, features: list[str], fold: str = "cv_fold", train: Column | None = None) -> DataFrame:
    """Log-odds of every row: training rows by the weights of the other folds, holdout rows by those of all training rows.

    The training rows are read once, into counts, means and squared deviations of each fold and label; a fold's fit joins those
    of the others, of which there are as many as folds."""
    train = F.col("split_role") == "train" if train is None else train
    y = F.col("label_id") == 1
    cells = df.where(train).groupBy(F.col(fold).alias("_f"), y.cast("int").alias("_y")).agg(F.count("*").alias("_c"), *[F.avg(f).alias(f"_m_{f}") for f in features], *[F.var_pop(f).alias(f"_v_{f}") for f in features])
    cells = F.broadcast(cells)  # two rows per fold
    folds = cells.select(F.col("_f").alias("_fold")).distinct().unionByName(df.sparkSession.range(1).select(F.lit(None).cast(dict(df.dtypes)[fold]).alias("_fold")))
    t = folds.join(cells, F.col("_fold").isNull() | (F.col("_fold") != F.col("_f")))
    n = F.sum("_c")
    aggs = [F.coalesce(F.sum(F.when(F.col("_y") == k, F.col("_c"))), F.lit(0)).alias(f"_n{k}") for k in (1, 0)]
    for f in features:
        m, v = F.col(f"_m_{f}"), F.col(f"_v_{f}")
        mean = F.sum(F.col("_c") * m) / n
        aggs += [(F.sum(F.when(F.col("_y") == k, F.col("_c") * m)) / F.sum(F.when(F.col("_y") == k, F.col("_c")))).alias(f"_m{k}_{f}") for k in (1, 0)]
        aggs += [(F.sum(F.col("_c") * (v + m * m)) / n - mean * mean).alias(f"_var_{f}")]
    table = _weights(t.groupBy("_fold").agg(*aggs), ["_fold"], features, "_n1", "_n0", lambda f, k: F.col(f"_m{k}_{f}"), lambda f: F.col(f"_var_{f}"))
    rows = df.withColumn("_own", F.when(train, F.col(fold)))
    z = sum((F.col(f) * F.col(f"w_{f}") for f in features), F.col("intercept"))
    return rows.join(F.broadcast(table), F.col("_own").eqNullSafe(F.col("_fold"))).withColumn("log_odds", z).drop("_own", "_fold", "intercept", *[f"w_{f}" for f in features])


def class_log_likelihoods(df: DataFrame, id_col: str, library: dict[str, dict[str, tuple[float, float]]]) -> DataFrame:
    """Sum of Gaussian log-densities of the features under each class of a small library, its softmax, and the best class."""
    terms = []
    for name, feats in library.items():
        ll = F.lit(0.0)
        for f, (m, s) in feats.items():
            ll = ll - 0.5 * F.pow((F.col(f) - m) / s, 2) - math.log(s) - 0.5 * math.log(2 * math.pi)
        terms.append(F.struct(ll.alias("ll"), F.lit(name).alias("name")))
    rows = df.select(id_col, F.array(*terms).alias("_t"))
    top = F.array_max(F.transform("_t", lambda t: t["ll"]))
    rows = rows.withColumn("_top", top).withColumn("_den", F.aggregate("_t", F.lit(0.0), lambda a, t: a + F.exp(t["ll"] - F.col("_top"))))
    best = F.filter("_t", lambda t: t["ll"] == F.col("_top"))[0]["name"]
    return rows.select(id_col, best.alias("best_class"), (1 / F.col("_den")).alias("posterior"), F.col("_top").alias("log_likelihood"))


def anchored_gate(anchors: DataFrame, observed: DataFrame, least: int = 32, least_anchors: int = 3) -> DataFrame:
    """Anchors ``(feature, target, tolerance)`` against observed ``(feature, value)``: distance of the means; a missing feature is
    infinitely far; under ``least`` samples fails."""
    o = observed.groupBy("feature").agg(F.count("value").alias("samples"), F.avg("value").alias("observed"))
    out = anchors.join(o, "feature", "left").na.fill(0, ["samples"])
    d = F.when(F.col("samples") > 0, F.abs(F.col("observed") - F.col("target"))).otherwise(F.lit(float("inf")))
    return out.withColumn("distance", d).withColumn("passed", (F.col("samples") >= least) & (F.col("distance") <= F.col("tolerance"))).select("feature", "target", "tolerance", "samples", "distance", "passed")


def gates(metrics: DataFrame, rules: dict[str, tuple[str, str, float]]) -> DataFrame:
    """A one-row table of metrics against rules ``name -> (metric, '>=' or '<=', bound)``: missing or NaN fails, an exact 0 counts
    as a value.  One row per rule."""
    out = []
    for name, (metric, op, bound) in rules.items():
        c = F.col(metric).cast("double")
        ok = F.when(F.isnan(c), False).otherwise(F.coalesce(c >= bound if op == ">=" else c <= bound, F.lit(False)))
        out.append(F.struct(F.lit(name).alias("gate"), c.alias("value"), F.lit(float(bound)).alias("bound"), ok.alias("passed")))
    return metrics.select(F.explode(F.array(*out)).alias("g")).select("g.*")


def solver_status(delta: Column, sigma: Column) -> Column:
    """Fail beyond three sigma, warn beyond one, else pass; a missing or non-positive scale fails."""
    return F.when(sigma.isNull() | (sigma <= 0) | delta.isNull(), "fail").when(F.abs(delta) > 3 * sigma, "fail").when(F.abs(delta) > sigma, "warn").otherwise("pass")
