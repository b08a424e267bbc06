"""Aggregations: counts over many dimension sets, summaries, entropies, feature banks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prefix import quantiles


def counts_by(df: DataFrame, keys: list[str]) -> DataFrame:
    """``COUNT(*)`` per key tuple; a missing key is the empty string."""
    return df.groupBy(*[F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) for k in keys]).agg(F.count("*").alias("n"))


def marginals(df: DataFrame, by: list[str], dimensions: list[str], units: dict[str, Column]) -> DataFrame:
    """Independent counts per dimension: the dimension columns are unpivoted and counted once, with one shuffle for all."""
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d).cast("string"), F.lit("")).alias("value")) for d in dimensions])).alias("_d")
    long = df.select(*by, *[c.alias(f"_u{i}") for i, c in enumerate(units.values())], pairs)
    return long.groupBy(*by, F.col("_d.dimension").alias("dimension"), F.col("_d.value").alias("value")).agg(*[F.sum(f"_u{i}").cast("bigint").alias(name) for i, name in enumerate(units)])


def balance_cube(df: DataFrame, keys: list[str]) -> DataFrame:
    """Joint and single counts of the keys by grouping sets; ``level`` names the set."""
    sets = ", ".join([f"({', '.join(keys)})", *[f"({k})" for k in keys]])
    rows = df.select(*[F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) for k in keys])
    case = "CASE " + " ".join(f"WHEN grouping_id() = {sum(1 << (len(keys) - 1 - j) for j in range(len(keys)) if j != i)} THEN '{k}'" for i, k in enumerate(keys)) + " ELSE 'joint' END"
    return df.sparkSession.sql(f"SELECT {', '.join(keys)}, {case} AS level, count(*) AS n FROM {{rows}} GROUP BY GROUPING SETS ({sets})", rows=rows)


def normalised_entropy(df: DataFrame, by: list[str], value: str, single: float = 0.0) -> DataFrame:
    """Shannon entropy of the value counts over its largest possible value, and ``imbalance`` = 1 - entropy.  A single distinct
    value has entropy ``single`` (parity with the historic figure: -1.0)."""
    c = df.groupBy(*by, value).agg(F.count("*").alias("_n"))
    t = c.groupBy(*by).agg(F.sum("_n").alias("_t"), F.count("*").alias("_k"))
    j = c.join(t, by) if by else c.crossJoin(F.broadcast(t))
    p = F.col("_n") / F.col("_t")
    e = j.groupBy(*by).agg(F.sum(-p * F.log2(p + 1e-12)).alias("_e"), F.first("_k").alias("k"))
    ent = F.when(F.col("k") <= 1, F.lit(single)).otherwise(F.col("_e") / F.greatest(F.log2(F.col("k") + 1e-12), F.lit(1e-12)))
    return e.select(*by, "k", ent.alias("entropy")).withColumn("imbalance", 1 - F.col("entropy"))


def feature_bank(frames: DataFrame, keys: list[str], columns: list[str], order: str) -> DataFrame:
    """Per record, whose frames are few enough for one task, and column: mean, population deviation, least, greatest, last, quartiles, trend; NaN counts as missing and a
    statistic without values is 0."""
    out = []
    for c in columns:
        v = F.when(~F.isnan(c), F.col(c))
        t = F.when(v.isNotNull(), F.col(order))
        stats = {"mean": F.avg(v), "std": F.stddev_pop(v), "min": F.min(v), "max": F.max(v), "last": F.max_by(v, t), "q25": F.percentile(v, 0.25), "q75": F.percentile(v, 0.75), "trend": F.max_by(v, t) - F.min_by(v, t)}
        out += [F.coalesce(s, F.lit(0.0)).alias(f"{c}_{k}") for k, s in stats.items()]
    return frames.groupBy(*keys).agg(*out)


def column_stats(df: DataFrame, columns: list[str], where: Column | None = None) -> DataFrame:
    """One row per column: mean, population deviation, least, greatest; by default callers pass the training rows."""
    rows = df.where(where) if where is not None else df
    aggs = [F.struct(F.lit(c).alias("name"), *[F.coalesce(f(c).cast("double"), F.lit(0.0)).alias(n) for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))]) for c in columns]
    return rows.agg(F.array(*aggs).alias("s")).select(F.explode("s").alias("s")).select("s.*")


def group_operating(df: DataFrame, group: str, threshold: float, by: list[str] | None = None) -> DataFrame:
    """Two levels: a group is positive if any row is, and detected if any score reaches the threshold; then counts over groups.
    Blank groups are left out."""
    by = by or []
    g = df.where(F.coalesce(F.col(group).cast("string"), F.lit("")) != "").groupBy(*by, group).agg(F.max("label_id").alias("y"), F.bool_or(F.col("score") >= threshold).alias("hit"))
    y = F.col("y") == 1
    return g.groupBy(*by).agg(*[F.count_if(c).alias(n) for n, c in (("tp", F.col("hit") & y), ("fp", F.col("hit") & ~y), ("tn", ~F.col("hit") & ~y), ("fn", ~F.col("hit") & y))])


def false_alarms(df: DataFrame, family: str, threshold: float, near: float = 0.05) -> DataFrame:
    """Negatives per family: count, false positives, near misses below the threshold, mean, 95th percentile, greatest score."""
    s = F.col("score")
    neg = df.where("label_id = 0")
    out = neg.groupBy(family).agg(F.count("*").alias("n"), F.count_if(s >= threshold).alias("fp"), F.count_if((s >= threshold - near) & (s < threshold)).alias("near_threshold"), F.avg(s).alias("mean_score"), F.max(s).alias("max_score"))
    q = quantiles(neg, [family], "score", [0.95]).select(F.col(family).alias("_family"), F.col("q")[0].alias("p95_score"))
    return out.join(q, F.col(family).eqNullSafe(F.col("_family")), "left").select(family, "n", "fp", "near_threshold", "mean_score", "p95_score", "max_score")


def failure_clusters(rollups: DataFrame, threshold: float) -> DataFrame:
    """From rows ``(model_id, negative_records, false_alarms map)``: per family over all models, its false positives over all
    negatives; rates above the threshold, highest first."""
    fams = rollups.select(F.explode(F.map_keys("false_alarms")).alias("family")).distinct()
    den = rollups.agg(F.sum("negative_records").alias("negatives"))
    fps = rollups.select(F.explode("false_alarms").alias("family", "n")).groupBy("family").agg(F.sum("n").alias("false_positives"))
    out = fams.join(fps, "family").crossJoin(F.broadcast(den)).withColumn("fp_rate", F.when(F.col("negatives") > 0, F.col("false_positives") / F.col("negatives")).otherwise(0.0))
    return out.where(F.col("fp_rate") > threshold).orderBy(F.desc("fp_rate"), "family")


def tier_metrics(df: DataFrame, tiers: list[str]) -> DataFrame:
    """Per tier and label, all of them: records that visited it, those with a detection, the rate."""
    per = df.groupBy("record_id", "label_id", "tier").agg(F.bool_or("detected").alias("hit"))
    got = per.groupBy("tier", "label_id").agg(F.count("*").alias("records"), F.count_if("hit").alias("detected_records"))
    frame = df.sparkSession.createDataFrame([(t, y) for t in tiers for y in (0, 1)], "tier string, label_id int")
    out = frame.join(got, ["tier", "label_id"], "left").na.fill(0)
    return out.withColumn("rate", F.when(F.col("records") > 0, F.col("detected_records") / F.col("records")).otherwise(0.0))


def least_tier(df: DataFrame, group: str, tier: str, ranks: dict[str, int], unknown: str = "unvalidated") -> DataFrame:
    """The lowest tier of each group by rank; one that has no rank counts lowest as ``unknown``."""
    rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv]), F.col(tier)), F.lit(-1))
    m = df.groupBy(group).agg(F.min(F.struct(rank.alias("r"), F.coalesce(F.col(tier), F.lit(unknown)).alias("t"))).alias("m"))
    return m.select(group, F.when(F.col("m.r") < 0, unknown).otherwise(F.col("m.t")).alias("least_tier"))


def circular_mean(deg: Column) -> Column:
    return F.pmod(F.degrees(F.atan2(F.avg(F.sin(F.radians(deg))), F.avg(F.cos(F.radians(deg))))), F.lit(360.0))


def distribution_summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    v = F.when(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), F.col(value))
    out = df.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    out = out.join(quantiles(df.withColumn("_v", v), keys, "_v", [0.1, 0.25, 0.5, 0.75, 0.9]), keys, "left")
    return out.select(*keys, "n", "mean", "std", "min", *[F.col("q")[i].alias(n) for i, n in enumerate(("q10", "q25", "q50", "q75", "q90"))], "max")


def group_counts(df: DataFrame, group: str, by: list[str], positive: Column) -> DataFrame:
    """Distinct groups and distinct groups with a positive row; blank groups are left out.  One row per group first, so no set of
    ids is gathered."""
    g = df.where(F.coalesce(F.col(group).cast("string"), F.lit("")) != "").groupBy(*by, group).agg(F.bool_or(positive).alias("_p"))
    return g.groupBy(*by).agg(F.count("*").alias("groups"), F.count_if("_p").alias("positive_groups"))


def record_summary(frames: DataFrame, keys: list[str], means: list[str], tops: list[str], shares: dict[str, Column]) -> DataFrame:
    """Per record the means of some columns, the greatest of others (0 at least), and the share of frames of each condition."""
    return frames.groupBy(*keys).agg(
        *[F.avg(c).alias(f"mean_{c}") for c in means], *[F.greatest(F.max(c), F.lit(0.0)).alias(f"max_{c}") for c in tops],
        *[F.avg(F.coalesce(x, F.lit(False)).cast("double")).alias(n) for n, x in shares.items()], F.count("*").alias("frames"),
    )


def status_counts(df: DataFrame, conditions: dict[str, Column], newest: str, tier: str) -> DataFrame:
    """One row: how many rows meet each condition, the newest, and the distinct tiers in order."""
    return df.agg(F.count("*").alias("total"), *[F.count_if(c).alias(n) for n, c in conditions.items()], F.max(newest).alias("newest"), F.array_join(F.array_sort(F.collect_set(tier)), ",").alias("tiers"))


def class_rollup(df: DataFrame, tier: str, kind: str) -> DataFrame:
    """Counts per class and per tier and class in one pass; rows without a class are counted apart."""
    named = F.coalesce(F.col(kind), F.lit("(none)"))
    sets = F.explode(F.array(F.struct(F.lit("class").alias("level"), F.lit("").alias("tier"), named.alias("class")), F.struct(F.lit("tier_class").alias("level"), F.col(tier).alias("tier"), named.alias("class")))).alias("x")
    return df.select(F.col(kind).isNull().alias("_none"), sets).where("not _none or x.level = 'class'").groupBy("x.level", "x.tier", "x.class").agg(F.count("*").alias("n"))


def model_rollup(records: DataFrame, model: str = "model_id") -> DataFrame:
    """From rows ``(model, record_id, positive, family, trigger_frame, detectable_frame)``, one per model and record: rates, missed
    positives, false alarms per family, mean latency of triggers not before the frame is detectable."""
    pos, hit = F.col("positive"), F.col("trigger_frame").isNotNull()
    late = F.when(pos & hit & (F.col("trigger_frame") >= F.col("detectable_frame")), (F.col("trigger_frame") - F.col("detectable_frame")).cast("double"))
    out = records.groupBy(model).agg(F.count_if(pos).alias("positive_records"), F.count_if(~pos).alias("negative_records"), F.count_if(pos & hit).alias("_tp"), F.count_if(~pos & hit).alias("_fp"), F.count_if(pos & ~hit).alias("missed"), F.avg(late).alias("mean_latency"))
    fams = records.where(~pos & hit).groupBy(model, "family").agg(F.count("*").alias("n")).groupBy(model).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("family", "n")))).alias("false_alarms"))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return out.join(fams, model, "left").select(model, "positive_records", "negative_records", share("_tp", "positive_records").alias("pd"), share("_fp", "negative_records").alias("pfa"), "missed", "mean_latency", "false_alarms")


def component_means(rows: DataFrame, record: str, component: str, score: str, chosen: list[str]) -> DataFrame:
    """Mean score per record over some components; a blank score counts as 0, a blank record is left out."""
    keep = rows.where(F.col(component).isin(chosen) & (F.coalesce(F.col(record).cast("string"), F.lit("")) != ""))
    return keep.groupBy(record).agg(F.avg(F.coalesce(F.col(score).try_cast("double"), F.lit(0.0))).alias("score"))


def track_products(rows: DataFrame, track: str, order: list[str], confidence: str, pos: str) -> DataFrame:
    by = F.struct(*order)
    return rows.groupBy(track).agg(F.count("*").alias("detections"), F.avg(confidence).alias("mean_confidence"), F.min_by(pos, by).alias("range_start"), F.max_by(pos, by).alias("range_end"))
