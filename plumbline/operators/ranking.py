"""Ranking metrics, curves, thresholds and calibration over a scored relation.

A scored relation has key columns, ``label_id`` (0 or 1), ``score`` and, where ties matter by row, ``ord``.  All but the row-wise
measures start from one group per distinct score; running sums are those of ``prefix``, so no key's rows meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .prefix import prefix_sums, with_buckets


def ratio(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    """``a / b``, or ``empty`` where b is 0."""
    return F.when(b != 0, a / b).otherwise(F.lit(empty).cast("double"))


def totals(scored: DataFrame, keys: list[str]) -> DataFrame:
    return scored.groupBy(*keys).agg(F.sum("label_id").cast("bigint").alias("pos"), F.sum(1 - F.col("label_id")).cast("bigint").alias("neg"))


def sweep(scored: DataFrame, keys: list[str]) -> DataFrame:
    """One row per distinct score: ``p, n`` of it, ``tp, fp`` of it and all above, ``pos, neg`` of the keys."""
    per = scored.groupBy(*keys, "score").agg(F.sum("label_id").cast("bigint").alias("p"), F.sum(1 - F.col("label_id")).cast("bigint").alias("n"))
    run = prefix_sums(per, keys, "score", {"tp": "p", "fp": "n"}, descending=True)
    all_ = totals(scored, keys)
    return run.join(all_, keys) if keys else run.crossJoin(F.broadcast(all_))


def roc_auc(scored: DataFrame, keys: list[str], ties: str = "midrank", empty: float | None = None) -> DataFrame:
    """ROC AUC per key.  ``ties``: ``midrank``, or ``ordinal`` (tied rows rank in order of ``ord``).  ``empty``: with one class."""
    if ties == "midrank":
        s = sweep(scored, keys)
        won = F.sum(F.col("p") * (F.col("neg") - F.col("fp") + F.col("n") / 2))
        return s.groupBy(*keys).agg(ratio(won, F.first("pos").cast("double") * F.first("neg"), empty).alias("roc_auc"))
    s = running_rows(scored, keys, descending=False, then=[F.col("ord").asc()])
    won = F.sum(F.col("label_id") * (F.col("seen") - F.col("hits")))
    return s.groupBy(*keys).agg(ratio(won, F.sum("label_id").cast("double") * F.sum(1 - F.col("label_id")), empty).alias("roc_auc"))


def running_rows(scored: DataFrame, keys: list[str], descending: bool = True, then: list[Column] | None = None) -> DataFrame:
    """Every row with ``seen`` rows and ``hits`` positives up to it, by score and then ``ord``.

    Rows are first counted per score and quantile of ``ord``, so a score that a third of all rows share is many windows."""
    rows = with_buckets(scored, "ord", "_part")
    per = rows.groupBy(*keys, "score", "_part").agg(F.count("*").alias("_c"), F.sum("label_id").alias("_h"))
    run = prefix_sums(per, keys, "score", {"_ec": "_c", "_eh": "_h"}, descending, then=[F.col("_part").asc()])
    run = run.select(*keys, "score", "_part", (F.col("_ec") - F.col("_c")).alias("_bc"), (F.col("_eh") - F.col("_h")).alias("_bh"))
    inside = Window.partitionBy(*keys, "score", "_part").orderBy(*(then or [F.col("ord").asc()])).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(run, [*keys, "score", "_part"])
    return out.withColumns({"seen": F.count("*").over(inside) + F.col("_bc"), "hits": F.sum("label_id").over(inside) + F.col("_bh")}).drop("_part", "_bc", "_bh")


def average_precision(scored: DataFrame, keys: list[str], empty: float | None = None) -> DataFrame:
    """Mean over positives of the precision at their row; tied scores keep the order of ``ord``."""
    s = running_rows(scored, keys)
    return s.groupBy(*keys).agg(ratio(F.sum(F.when(F.col("label_id") == 1, F.col("hits") / F.col("seen")).otherwise(0.0)), F.sum("label_id"), empty).alias("average_precision"))


def pr_auc(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Area under precision over recall by steps, row by row from the top (tied scores keep the order of ``ord``); 0 without positives.
    A step has the precision at its row, and only positives step, so it is the sum of average precision."""
    return average_precision(scored, keys, 0.0).withColumnRenamed("average_precision", "pr_auc")


def best_of_group(rows: DataFrame, groups: list[str], by: str, name: str, n: int = 1) -> DataFrame:
    """The ``n`` rows of each group with the greatest ``by``, ties by ``name``, NaN and null last; an aggregate of ``n`` rows a group."""
    low = F.when(F.col(by).isNull() | F.isnan(by), F.lit(float("-inf"))).otherwise(F.col(by))
    rest = [c for c in rows.columns if c not in groups]
    top = F.slice(F.array_sort(F.collect_list(F.struct((-low).alias("_k"), F.col(name).alias("_n"), F.struct(*rest).alias("r")))), 1, n)
    return rows.groupBy(*groups).agg(F.explode(top).alias("x")).select(*groups, *[F.col(f"x.r.{c}").alias(c) for c in rest])


def method_summary(perf: DataFrame) -> DataFrame:
    """Rows ``(method, positives, negatives, recall, fpr, average_precision, tp, fp)`` with the counts that are missing derived from the
    rates, in order of average precision, greatest first, NaN last."""
    tp = F.coalesce("tp", F.bround(F.col("positives") * F.col("recall")).cast("long"))
    fp = F.coalesce("fp", F.bround(F.col("negatives") * F.col("fpr")).cast("long"))
    out = perf.withColumns({"tp": tp, "fp": fp}).withColumns({"fn": F.col("positives") - F.col("tp"), "tn": F.col("negatives") - F.col("fp")})
    return out.orderBy(F.desc_nulls_last(F.nanvl(F.col("average_precision"), F.lit(None).cast("double"))), "method")


def roc_curve(scored: DataFrame, keys: list[str]) -> DataFrame:
    """``fpr, tpr, threshold``: from (0, 0) above the top score, a point per distinct score, to (1, 1) below the least."""
    s = sweep(scored, keys)
    pts = s.select(*keys, ratio(F.col("fp"), F.col("neg")).alias("fpr"), ratio(F.col("tp"), F.col("pos")).alias("tpr"), F.col("score").alias("threshold"))
    ends = scored.groupBy(*keys).agg(F.max("score").alias("hi"), F.min("score").alias("lo"))
    ends = ends.select(*keys, F.explode(F.array(F.struct(F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"), (F.col("hi") + 1e-12).alias("threshold")), F.struct(F.lit(1.0).alias("fpr"), F.lit(1.0).alias("tpr"), (F.col("lo") - 1e-12).alias("threshold")))).alias("e"))
    return pts.unionByName(ends.select(*keys, "e.fpr", "e.tpr", "e.threshold"))


def pr_curve(scored: DataFrame, keys: list[str]) -> DataFrame:
    s = sweep(scored, keys)
    return s.select(*keys, ratio(F.col("tp"), F.col("pos")).alias("recall"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), F.col("score").alias("threshold"))


def confusion(df: DataFrame, keys: list[str], threshold: str = "threshold") -> DataFrame:
    """Counts and rates of ``score >= threshold``; 0 / 0 is 0, and the false-positive rate is 1 - specificity."""
    hit, pos = F.col("score") >= F.col(threshold), F.col("label_id") == 1
    c = df.groupBy(*keys).agg(*[F.count_if(x).alias(k) for k, x in (("tp", hit & pos), ("fp", hit & ~pos), ("tn", ~hit & ~pos), ("fn", ~hit & pos))])
    return rates(c)


def rates(c: DataFrame) -> DataFrame:
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    c = c.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "specificity": ratio(tn, tn + fp), "accuracy": ratio(tp + tn, tp + fp + tn + fn)})
    f1 = ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return c.withColumns({"f1": f1, "fpr": 1 - F.col("specificity")})


def _scored_sweep(scored: DataFrame, keys: list[str]) -> DataFrame:
    s = sweep(scored, keys)
    s = s.withColumns({"precision": F.col("tp") / (F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("pos")), "fpr": ratio(F.col("fp"), F.col("neg"))})
    return s.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def best_threshold(scored: DataFrame, keys: list[str], rule: str = "lexicographic") -> DataFrame:
    """The threshold of greatest F1.  ``lexicographic``: then recall, precision, and the highest score; ``lowest``: the lowest."""
    s = _scored_sweep(scored, keys)
    # equal F1 must tie whatever the rounding of its factors
    f1 = F.round("f1", 12)
    by = F.struct(f1, F.round("recall", 12), F.round("precision", 12), "score") if rule == "lexicographic" else F.struct(f1, -F.col("score"))
    return s.groupBy(*keys).agg(F.max_by("score", by).alias("threshold"), F.max_by("f1", by).alias("f1"))


def recall_at_fpr(scored: DataFrame, keys: list[str], target: float) -> DataFrame:
    s = _scored_sweep(scored, keys)
    return s.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("fpr") <= target, F.col("recall"))), F.lit(0.0)).alias("recall"))


def threshold_at_precision(scored: DataFrame, keys: list[str], target: float) -> DataFrame:
    """The lowest score whose running precision, row by row, reaches the target; 1.0 if none does."""
    s = running_rows(scored, keys)
    return s.groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col("hits") / F.col("seen") >= target, F.col("score"))), F.lit(1.0)).alias("threshold"))


def operating_points(scored: DataFrame, keys: list[str], fpr: float = 0.01, recall: float = 0.8) -> DataFrame:
    """Detection rate at a false-alarm rate, and false-alarm rate at a detection rate."""
    s = _scored_sweep(scored, keys)
    return s.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("fpr") <= fpr, F.col("recall"))), F.lit(0.0)).alias("pd_at_pfa"), F.coalesce(F.min(F.when(F.col("recall") >= recall, F.col("fpr"))), F.lit(1.0)).alias("pfa_at_pd"))


def grid_points(scored: DataFrame, keys: list[str], grid: list[float]) -> DataFrame:
    """Precision, recall and false-positive rate at fixed thresholds; an empty selection has 0."""
    at = scored.select(*keys, "label_id", "score", F.explode(F.array(*[F.lit(g) for g in grid])).alias("threshold"))
    return confusion(at, [*keys, "threshold"]).select(*keys, "threshold", "precision", "recall", "fpr")


def calibration_bins(scored: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    """Equal bins over [0, 1], half-open but the last; empty bins have zeros, scores outside are left out."""
    inside = scored.where(F.col("score").between(0.0, 1.0)).withColumn("bin", F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int"))
    per = inside.groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.avg("label_id").alias("positive_rate"))
    frame = scored.select(*keys).distinct() if keys else scored.sparkSession.range(1).select()
    frame = frame.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return frame.join(per, [*keys, "bin"], "left").na.fill(0, ["n"]).na.fill(0.0, ["mean_score", "positive_rate"])


def expected_calibration_error(scored: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    """Scores outside [0, 1] are in no bin but count in the denominator."""
    all_ = scored.groupBy(*keys).agg(F.count("*").alias("_all"), F.avg(F.pow(F.col("score") - F.col("label_id"), 2)).alias("brier"))
    b = calibration_bins(scored, keys, bins).groupBy(*keys).agg(F.sum(F.col("n") * F.abs(F.col("positive_rate") - F.col("mean_score"))).alias("_gap"))
    out = b.join(all_, keys) if keys else b.crossJoin(all_)
    return out.select(*keys, (F.col("_gap") / F.col("_all")).alias("ece"), "brier")


def minmax_by_train(scored: DataFrame, keys: list[str], train: Column) -> DataFrame:
    """Scores scaled by the range of the training rows and clipped to [0, 1]; a degenerate range gives 0."""
    r = scored.groupBy(*keys).agg(F.min(F.when(train, F.col("score"))).alias("_lo"), F.max(F.when(train, F.col("score"))).alias("_hi"))
    out = scored.join(r, keys) if keys else scored.crossJoin(F.broadcast(r))
    x = F.when(F.col("_hi") > F.col("_lo"), (F.col("score") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)
    return out.withColumn("scaled", F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))).drop("_lo", "_hi")


def method_performance(scored: DataFrame) -> DataFrame:
    """Threshold by (F1, recall, precision) on the training rows of each method; then, on every split and on each phase of the
    holdout, counts, rates and AUC."""
    thr = best_threshold(scored.where("split_role = 'train'"), ["method"]).select("method", "threshold")
    whole = scored.withColumn("phase", F.lit("all"))
    parts = scored.where("split_role = 'holdout'").withColumn("phase", F.col("phase_id"))
    rows = whole.unionByName(parts)
    keys = ["method", "split_role", "phase"]
    return confusion(rows.join(thr, "method"), [*keys, "threshold"]).join(roc_auc(rows, keys), keys)


def metric_bundle(scored: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """One row per key: rows, positives, counts and rates at a threshold, balanced accuracy, Brier score, ROC AUC and average
    precision (both null where a class is missing)."""
    hit, pos = F.col("score") >= threshold, F.col("label_id") == 1
    err = F.col("score") - F.col("label_id")
    c = scored.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("label_id").cast("bigint").alias("positives"), F.avg(err * err).alias("brier"), *[F.count_if(x).alias(k) for k, x in (("tp", hit & pos), ("fp", hit & ~pos), ("tn", ~hit & ~pos), ("fn", ~hit & pos))])
    c = rates(c).withColumn("balanced_accuracy", (F.col("recall") + F.col("specificity")) / 2).drop("accuracy", "specificity")
    return c.join(roc_auc(scored, keys), keys).join(average_precision(scored, keys), keys)


def slice_metrics(scored: DataFrame, keys: list[str], slices: dict[str, Column], threshold: float = 0.5) -> DataFrame:
    """The bundle's main columns on named, overlapping slices of the rows; a slice without a row is absent."""
    held = F.filter(F.array(*[F.when(cond, F.lit(name)) for name, cond in slices.items()]), lambda x: x.isNotNull())
    rows = scored.withColumn("slice", F.explode(held))
    return metric_bundle(rows, [*keys, "slice"], threshold).select(*keys, "slice", "n", "positives", "roc_auc", "average_precision", "recall", "fpr", "f1")
