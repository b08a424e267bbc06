"""Audits: leakage policy on column names, single-feature AUCs, saturation, gaps to references, and comparisons of relations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prefix import quantiles
from .ranking import roc_auc

#: Endings that name a unit; a restricted name counts without them too.
UNITS = ("_mps", "_dbsm", "_db", "_m", "_hz")


def policy_violations(names: DataFrame, denied: DataFrame, column: str = "name", restricted: str = "restricted") -> DataFrame:
    """Names that equal a restricted one or its stem without unit, or hold it as a whole part at their start, end or middle; with the
    restricted names that they match.  Denied names are few; names are split into all runs of their parts, so it is an equi-join."""
    stems = denied.select(F.lower(restricted).alias("_r")).distinct()
    cut = reduce(lambda out, u: F.when(F.col("_r").endswith(u), F.expr(f"left(_r, length(_r) - {len(u)})")).otherwise(out), reversed(UNITS), F.col("_r"))
    stems = stems.select("_r", F.explode(F.array_distinct(F.array("_r", cut))).alias("_stem")).where("_stem <> ''")
    parts = F.split(F.lower(column), "_")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.size("_p")), lambda i: F.transform(F.sequence(i, F.size("_p")), lambda j: F.array_join(F.slice("_p", i, j - i + 1), "_"))))
    named = names.select(column).distinct().withColumn("_p", parts).select(column, F.explode(F.array_distinct(runs)).alias("_stem"))
    return named.join(stems, "_stem").groupBy(column).agg(F.array_join(F.array_sort(F.collect_set("_r")), ",").alias("matches"))


def feature_family(name: Column, rules: list[tuple[str, tuple[str, ...]]], other: str) -> Column:
    """The first family one of whose tokens the name holds."""
    out = F.lit(other)
    for family, tokens in reversed(rules):
        out = F.when(reduce(lambda a, b: a | b, [F.lower(name).contains(t) for t in tokens]), family).otherwise(out)
    return out


def schema_evidence(views: DataFrame, denied: list[str], family: Column) -> DataFrame:
    """From rows ``(view, name)``: per view its columns, those that are denied, and its families, joined in order."""
    bad = F.col("name").isin(denied)
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), "|")
    return views.groupBy("view").agg(F.count("*").alias("columns"), joined(F.when(bad, F.col("name"))).alias("denied"), joined(F.when(~bad, family)).alias("families"))


def single_feature_audit(rows: DataFrame, features: list[str], split: str = "split_role", label: str = "label_id") -> DataFrame:
    """Per feature its absolute AUC (the greater of a and 1 - a) over all rows and per split, and quantiles of both classes.
    Features are unpivoted, so all are one sweep."""
    long = rows.select(label, split, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("score")) for f in features])).alias("x")).select(F.col(label).alias("label_id"), F.col(split).alias("part"), "x.*").where("score is not null")
    both = long.unionByName(long.withColumn("part", F.lit("all")))
    auc = roc_auc(both, ["feature", "part"]).withColumn("auc_abs", F.greatest("roc_auc", 1 - F.col("roc_auc")))
    auc = auc.groupBy("feature").agg(F.map_from_entries(F.collect_list(F.struct("part", "auc_abs"))).alias("auc"))
    q = quantiles(long, ["feature", "label_id"], "score", [0.1, 0.5, 0.9])
    side = lambda y, i: F.max(F.when(F.col("label_id") == y, F.col("q")[i]))
    names = ("q10", "q50", "q90")
    q = q.groupBy("feature").agg(*[side(y, i).alias(f"{n}_{m}") for y, n in ((1, "positive"), (0, "negative")) for i, m in enumerate(names)])
    return auc.join(q, "feature")


def saturation(rows: DataFrame, clamps: dict[str, float]) -> DataFrame:
    """Per clamped column: its median, the share of values at the clamp, and whether the median stays below it."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.lit(float(v)).alias("clamp"), F.col(c).cast("double").alias("v")) for c, v in clamps.items()])).alias("x")).select("x.*")
    med = quantiles(long, ["name"], "v", [0.5]).select("name", F.col("q")[0].alias("median"))
    out = long.groupBy("name", "clamp").agg(F.avg((F.col("v") >= F.col("clamp") - 1e-6).cast("double")).alias("at_clamp"))
    return out.join(med, "name").withColumn("passed", F.col("median") < F.col("clamp") - 1e-6)


def rank_prior(stats: DataFrame, bounds: DataFrame, key: str, cap: float = 0.35, least_width: float = 0.12) -> DataFrame:
    """Quantiles of a measured summary (``min, q10, q50, q90, max, n``) mapped by their rank between least and greatest, kept in
    [0.05, 0.95], into the bounds ``low, high`` of the same key; the offset from the middle shrinks by n / (n + 20), at most by ``cap``."""
    j = stats.join(F.broadcast(bounds), key)
    lo, span = F.col("low"), F.col("high") - F.col("low")
    rank = lambda q: F.when(F.col("max") <= F.col("min"), 0.5).otherwise(F.least(F.lit(0.95), F.greatest(F.lit(0.05), (F.col(q) - F.col("min")) / (F.col("max") - F.col("min")))))
    at = lambda q: lo + rank(q) * span
    j = j.select(key, "n", lo.alias("low"), F.col("high"), at("q10").alias("_a"), at("q50").alias("target_center"), at("q90").alias("_b"), ((F.col("low") + F.col("high")) / 2).alias("reference_center"), F.greatest(span * least_width, F.lit(1e-6)).alias("_w"))
    narrow, mid = F.col("_b") - F.col("_a") < F.col("_w"), (F.col("_a") + F.col("_b")) / 2
    j = j.withColumn("target_q10", F.when(narrow, F.greatest("low", mid - F.col("_w") / 2)).otherwise(F.col("_a"))).withColumn("target_q90", F.when(narrow, F.least("high", mid + F.col("_w") / 2)).otherwise(F.col("_b")))
    shrink = F.least(F.lit(cap), F.col("n") / (F.col("n") + 20.0))
    return j.withColumn("shrinkage", shrink).withColumn("offset", (F.col("target_center") - F.col("reference_center")) * F.col("shrinkage")).drop("_a", "_b", "_w")


def reference_gaps(summary: DataFrame, bounds: DataFrame, key: str) -> DataFrame:
    """Two rows per observable of a summary (``mean, q50``): the distance of its mean from the middle of its reference range, and the
    ratio of its median to it; null where there is no reference."""
    j = summary.join(F.broadcast(bounds), key, "left")
    ref = (F.col("mean_min") + F.col("mean_max")) / 2
    status = F.when(ref.isNull(), "no_reference").when(F.col("mean").between(F.col("mean_min"), F.col("mean_max")), "pass").otherwise("gap")
    row = lambda name, v, gap: F.struct(F.lit(name).alias("metric"), v.alias("measured"), ref.alias("reference"), gap.alias("gap"))
    two = F.explode(F.array(row("mean_gap", F.col("mean"), F.abs(F.col("mean") - ref)), row("q50_ratio", F.col("q50"), F.when(ref != 0, F.col("q50") / ref)))).alias("x")
    return j.select(key, status.alias("status"), two).select(key, "x.*", "status")


def anchor_distance(priors: DataFrame) -> DataFrame:
    """``(target - reference) / scale`` of priors ``target_center, reference_center, target_q10, target_q90``: half the spread of the
    quantiles, or where that is no positive number the greatest of both centres and 1."""
    half = F.abs(F.col("target_q90") - F.col("target_q10")) / 2
    scale = F.when(half > 0, half).otherwise(F.greatest(F.abs("target_center"), F.abs("reference_center"), F.lit(1.0)))
    return priors.withColumn("distance", (F.col("target_center") - F.col("reference_center")) / scale)


def truth_status(candidate: Column, truth: Column, skipped: Column, tolerance: Column, slack: float = 0.5) -> Column:
    """Warn if the truth was skipped; fail if either is not positive; else by the distance in decibels: pass, warn within ``slack``, fail."""
    delta = F.abs(10 * F.log10(candidate) - 10 * F.log10(truth))
    return F.when(skipped, "warn").when((candidate <= 0) | (truth <= 0), "fail").when(delta <= tolerance, "pass").when(delta <= tolerance + slack, "warn").otherwise("fail")


def delta_summary(pairs: DataFrame, status: str = "status", delta: str = "delta_db") -> DataFrame:
    """Counts per status, greatest and root-mean-square difference, and the verdict: fail beyond 1 or with any failure."""
    out = pairs.agg(F.count("*").alias("n"), *[F.count_if(F.col(status) == s).alias(f"n_{s}") for s in ("pass", "warn", "fail")], F.coalesce(F.max(F.greatest(F.col(delta), F.lit(0.0))), F.lit(0.0)).alias("max_delta_db"), F.coalesce(F.sqrt(F.avg(F.pow(delta, 2))), F.lit(0.0)).alias("rms_delta_db"))
    return out.withColumn("passed", (F.col("rms_delta_db") <= 1) & (F.col("n_fail") == 0))


def values_differ(a: DataFrame, b: DataFrame, keys: list[str], value: str, rel: float | None = None, abs_: float = 0.0) -> DataFrame:
    """Keys whose values differ, or that one side lacks: beyond both tolerances, or with ``rel`` None in any bit."""
    j = a.select(*keys, F.col(value).alias("_a")).join(b.select(*keys, F.col(value).alias("_b")), keys, "full")
    if rel is None:
        same = F.hex(F.col("_a").cast("string")) == F.hex(F.col("_b").cast("string"))
    else:
        d = F.abs(F.col("_a") - F.col("_b"))
        same = (d <= abs_) | (d <= rel * F.greatest(F.abs("_a"), F.abs("_b")))
    return j.where(~F.coalesce(same, F.lit(False))).select(*keys, F.col("_a").alias("left_value"), F.col("_b").alias("right_value"))


def id_sets(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """How many distinct ids stand in both relations, in one only, and whether the sets are equal."""
    j = a.select(key).distinct().withColumn("_a", F.lit(True)).join(b.select(key).distinct().withColumn("_b", F.lit(True)), key, "full")
    out = j.agg(F.count_if(F.col("_a") & F.col("_b")).alias("both"), F.count_if(F.col("_b").isNull()).alias("left_only"), F.count_if(F.col("_a").isNull()).alias("right_only"))
    return out.withColumn("equal", (F.col("left_only") == 0) & (F.col("right_only") == 0))


def column_sets(df: DataFrame, required: list[str], denied: list[str]) -> tuple[list[str], list[str]]:
    """Required columns that are missing, and denied ones that are there, in order."""
    return sorted(set(required) - set(df.columns)), sorted(set(denied) & set(df.columns))
