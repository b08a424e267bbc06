"""Joins and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_by_key(df: DataFrame, keys: list[str], ord: str, first: bool = False, drop_blank: bool = True) -> DataFrame:
    """One row per key, the last (or first) by ``ord``: an aggregate, so hot keys combine before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    pick = (F.min_by if first else F.max_by)(F.struct(*rest), F.col(ord)).alias("_row")
    if drop_blank:
        for k in keys:
            df = df.where(F.coalesce(F.col(k).cast("string"), F.lit("")) != "")
    return df.groupBy(*keys).agg(pick).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def overlay(left: DataFrame, right: DataFrame, key: str, ord: str) -> DataFrame:
    """Left join in which a matched right row replaces the left's columns of the same name, blanks and nulls too; of several
    right rows of a key the last counts."""
    r = last_by_key(right, [key], ord).drop(ord).withColumn("_hit", F.lit(True))
    r = r.select(*[F.col(c).alias(f"_r_{c}") if c not in (key, "_hit") else F.col(c) for c in r.columns])
    extra = [c[3:] for c in r.columns if c.startswith("_r_")]
    out = left.join(r, key, "left")
    both = [F.when(F.col("_hit"), F.col(f"_r_{c}")).otherwise(F.col(c)).alias(c) if c in extra else F.col(c) for c in left.columns]
    return out.select(*both, *[F.col(f"_r_{c}").alias(c) for c in extra if c not in left.columns])


def assert_unique(df: DataFrame, keys: list[str], name: str) -> None:
    bad = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
    if bad:
        raise ValueError(f"{name}: key {bad[0].asDict()} is not unique")


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join after checking that the keys are unique on both sides."""
    assert_unique(left, keys, "left")
    assert_unique(right, keys, "right")
    return left.join(right, keys)


def require_all(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join that fails if a left row has no partner."""
    lost = left.join(right, keys, "left_anti").limit(1).collect()
    if lost:
        raise KeyError(f"no partner for {[lost[0][k] for k in keys]}")
    return left.join(right, keys)


def lookup(left: DataFrame, right: DataFrame, keys: list[str], value: str, default: object) -> DataFrame:
    return left.join(right.select(*keys, value), keys, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def fallback_lookup(left: DataFrame, right: DataFrame, tries: list[str], key: str, value: str) -> DataFrame:
    """The value of the first of several left columns that matches ``right``'s key."""
    out = left
    for i, t in enumerate(tries):
        out = out.join(right.select(F.col(key).alias(t), F.col(value).alias(f"_v{i}")), t, "left")
    return out.withColumn(value, F.coalesce(*[f"_v{i}" for i in range(len(tries))])).drop(*[f"_v{i}" for i in range(len(tries))])


def target_encode(rows: DataFrame, train: Column, keys: list[str], label: str, out: str) -> DataFrame:
    """Mean label of the training rows of the same keys; of all training rows for an unseen key; 0 without any."""
    per = rows.where(train).groupBy(*keys).agg(F.avg(label).alias("_mean"))
    all_ = rows.where(train).agg(F.avg(label).alias("_global"))
    return rows.join(per, keys, "left").crossJoin(F.broadcast(all_)).withColumn(out, F.coalesce("_mean", "_global", F.lit(0.0))).drop("_mean", "_global")


def first_match(roots: list[DataFrame], keys: list[str]) -> DataFrame:
    """Rows of several sources in order of preference; of each key those of the first source that has it."""
    all_ = None
    for i, r in enumerate(roots):
        r = r.withColumn("_root", F.lit(i))
        all_ = r if all_ is None else all_.unionByName(r, allowMissingColumns=True)
    best = all_.groupBy(*keys).agg(F.min("_root").alias("_root"))
    return all_.join(best, [*keys, "_root"]).drop("_root")


def range_bins(df: DataFrame, value: str, reach: Column, width: float) -> DataFrame:
    """``df`` once for each bin of ``width`` that ``value +- reach`` touches, as ``_bin``: a range join on bins is an equi-join."""
    lo, hi = F.floor((F.col(value) - reach) / width), F.floor((F.col(value) + reach) / width)
    return df.withColumn("_bin", F.explode(F.sequence(lo, hi)))


def range_semi(left: DataFrame, right: DataFrame, keys: list[str], value: str, floor: float = 150.0, share: float = 0.03, width: float = 150.0) -> DataFrame:
    """Left rows for which some right row of the same keys lies nearer than ``max(floor, share * value)``."""
    reach = F.greatest(F.lit(floor), share * F.abs(F.col(value)))
    l = range_bins(left.withColumn("_reach", reach), value, F.col("_reach"), width)
    r = right.select(*keys, F.col(value).alias("_v"), F.floor(F.col(value) / width).alias("_bin")).distinct()
    return l.join(r, (F.abs(l[value] - r["_v"]) < l["_reach"]) & (l["_bin"] == r["_bin"]) & _same(l, r, keys), "left_semi").drop("_bin", "_reach").distinct()


def _same(l: DataFrame, r: DataFrame, keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & (l[k] == r[k])
    return out


def nearest_within(left: DataFrame, right: DataFrame, id_col: str, value: str, label: str, tolerance: float, default: str) -> DataFrame:
    """The label of the nearest right row by ``|value|`` strictly within ``tolerance``, ties to the smaller label; else ``default``.
    ``left`` rows are told apart by ``id_col``."""
    l = range_bins(left.select(id_col, F.abs(value).alias("_x")), "_x", F.lit(tolerance), tolerance)
    r = right.select(F.abs(value).alias("_y"), F.col(label).alias("_label"), F.floor(F.abs(value) / tolerance).alias("_bin")).distinct()
    near = l.join(r, "_bin").withColumn("_d", F.abs(F.col("_x") - F.col("_y"))).where(F.col("_d") < tolerance)
    best = near.groupBy(id_col).agg(F.min(F.struct("_d", "_label")).alias("_best")).select(id_col, F.col("_best._d").alias("distance"), F.col("_best._label").alias("matched"))
    return left.join(best, id_col, "left").withColumn("matched", F.coalesce("matched", F.lit(default)))


def asof_nearest(left: DataFrame, right: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """For each left row the last right value at or before its time, by one window over both."""
    both = left.withColumn("_side", F.lit(1)).withColumn(value, F.lit(None).cast(dict(right.dtypes)[value])).unionByName(right.select(*keys, time, value).withColumn("_side", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last(value, True).over(w)).where("_side = 1").drop("_side")


def nearest_train(rows: DataFrame, holdout: Column, id_col: str, vec_col: str, block: int = 2048) -> DataFrame:
    """For each holdout vector its nearest training vector by Euclidean distance after scaling every component by the training
    rows' mean and population deviation (+1e-6); ties to the smaller id.  Exact: holdout rows in blocks against blocks of
    training rows, one row per holdout row and block, merged by minimum."""
    import numpy as np
    import pyarrow as pa

    stats = rows.where(~holdout).select(F.posexplode(vec_col).alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), (F.stddev_pop("v") + 1e-6).alias("s"))
    stats = stats.agg(F.sort_array(F.collect_list(F.struct("i", "m", "s"))).alias("stat"))  # one entry per component
    z = F.zip_with(F.col(vec_col), F.col("stat"), lambda v, t: (v.cast("double") - t["m"]) / t["s"])
    scaled = rows.withColumn("_h", holdout).crossJoin(F.broadcast(stats)).select(F.col(id_col).alias("id"), "_h", z.alias("z"))
    n = scaled.groupBy("_h").agg(F.count("*").alias("n")).collect()
    cuts = {r["_h"]: max(1, -(-r["n"] // block)) for r in n}
    each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(cuts.get(k, 1) - 1)))
    part = lambda k: F.pmod(F.xxhash64("id"), F.lit(cuts.get(k, 1))).cast("int")
    q = scaled.where("_h").select("id", "z", part(True).alias("a"), each(False).alias("b"), F.lit(True).alias("ask"))
    t = scaled.where("not _h").select("id", "z", each(True).alias("a"), part(False).alias("b"), F.lit(False).alias("ask"))

    def run(tab: pa.Table) -> pa.Table:
        ask, ids = tab.column("ask").to_numpy(), tab.column("id").to_numpy()
        z = np.stack(tab.column("z").to_numpy()) if len(ids) else np.zeros((0, 1))
        qi, ti = np.flatnonzero(ask), np.flatnonzero(~ask)
        if not len(qi) or not len(ti):
            return pa.table({"id": pa.array([], pa.int64()), "d": pa.array([], pa.float64()), "near": pa.array([], pa.int64())})
        ti = ti[np.argsort(ids[ti], kind="stable")]
        norm = (z[ti] ** 2).sum(1)
        rows, near, dist = [], [], []
        for lo in range(0, len(qi), 256):
            x = z[qi[lo : lo + 256]]
            d = (x**2).sum(1)[:, None] + norm[None, :] - 2 * x @ z[ti].T
            i, j = np.nonzero(d <= d.min(1, keepdims=True) + 1e-9 * (1 + norm.max()))  # the nearest, and what rounding may hide
            e = np.sqrt(((x[i] - z[ti[j]]) ** 2).sum(1))
            order = np.lexsort((j, e, i))
            i, j, e = i[order], j[order], e[order]
            first = np.r_[True, i[1:] != i[:-1]]
            rows.append(qi[lo + i[first]]), near.append(ids[ti[j[first]]]), dist.append(e[first])
        rows = np.concatenate(rows)
        return pa.table({"id": ids[rows], "d": np.concatenate(dist), "near": np.concatenate(near)})

    found = q.unionByName(t).groupBy("a", "b").applyInArrow(run, "id long, d double, near long")
    return found.groupBy("id").agg(F.min(F.struct("d", "near")).alias("m")).select(F.col("id").alias(id_col), F.col("m.near").alias("nearest_id"), F.col("m.d").alias("distance"))
