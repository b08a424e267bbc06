"""Negative controls: linear probes on columns that must not tell the label, and the verdict on their AUCs."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import keep
from .prefix import row_numbers
from .ranking import roc_auc


@dataclass
class Probe:
    """Columns that a probe sees, its label, and the rows it looks at; ``gated`` probes decide the verdict."""

    name: str
    label: str
    categorical: list[str] = field(default_factory=list)
    numeric: list[str] = field(default_factory=list)
    rows: Column | str | None = None
    gated: bool = True


def shuffled_labels(rows: DataFrame, id_col: str, split: str, label: str, seed: int, out: str = "shuffled") -> DataFrame:
    """``rows`` with the labels permuted inside each split: the row of rank r by id gets the label of the row of rank r by a seeded
    hash of the id.  Ranks come from bucketed prefix sums, so a split is never one task."""
    rows = keep(rows)
    by_id = row_numbers(rows, [split], id_col, "_rank")
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string"))), 1, 13), 16, 10).cast("long")
    by_hash = row_numbers(rows.select(split, id_col, F.col(label).alias(out), draw.alias("_draw")), [split], "_draw", "_rank", then=[F.col(id_col).asc()])
    return by_id.join(by_hash.select(split, "_rank", out), [split, "_rank"]).drop("_rank")


def design_columns(rows: DataFrame, categorical: list[str], numeric: list[str]) -> DataFrame:
    """Long form of the design matrix summed by column: ``feature, filled, total``; one column for each value of a categorical one
    (null is the text ``None``), none dropped."""
    hot = [F.struct(F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("None"))).alias("feature"), F.lit(1.0).alias("v")) for c in categorical]
    num = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in numeric]
    return rows.select(F.explode(F.array(*hot, *num)).alias("x")).select("x.*").groupBy("feature").agg(F.count_if(F.col("v") != 0).alias("filled"), F.sum("v").alias("total"))


def probe_auc(rows: DataFrame, probe: Probe, split: str = "split", train: str = "train", test: str = "test") -> float:
    """ROC AUC on ``test`` of a logistic model of standardised columns fitted to ``train``, classes weighted to balance and the squared
    norm of the weights added once; NaN where a side has one class.

    Categories are numbered over all rows, so those of the test side alone are columns too.  The fit is iterative and distributed: each
    step is one sum over rows, and the driver holds one weight per column."""
    rows = rows if probe.rows is None else rows.where(probe.rows)
    coded = [F.coalesce(F.col(c).cast("string"), F.lit("None")).alias(f"c{i}") for i, c in enumerate(probe.categorical)]
    numbers = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"n{i}") for i, c in enumerate(probe.numeric)]
    x = keep(rows.where(F.col(split).isin(train, test)).select(F.col(split).alias("part"), F.col(probe.label).cast("double").alias("label"), *coded, *numbers))
    sizes = {(r.part, r.label): r.n for r in x.groupBy("part", "label").agg(F.count("*").alias("n")).collect()}
    if any(len([1 for part, _ in sizes if part == side]) < 2 for side in (train, test)):
        return float("nan")
    n = sum(v for (part, _), v in sizes.items() if part == train)
    weight = F.when(F.col("label") == 1, n / (2.0 * sizes[train, 1.0])).otherwise(n / (2.0 * sizes[train, 0.0]))
    cats, nums = [f"c{i}" for i in range(len(coded))], [f"n{i}" for i in range(len(numbers))]
    prepare = []
    if cats:
        prepare += [StringIndexer(inputCols=cats, outputCols=[f"{c}i" for c in cats], stringOrderType="alphabetAsc"), OneHotEncoder(inputCols=[f"{c}i" for c in cats], outputCols=[f"{c}v" for c in cats], dropLast=False)]
    prepare.append(VectorAssembler(inputCols=[*(f"{c}v" for c in cats), *nums], outputCol="raw"))
    x = Pipeline(stages=prepare).fit(x).transform(x).withColumn("weight", weight)
    scaled = StandardScaler(inputCol="raw", outputCol="features").fit(x.where(F.col("part") == train))
    x = keep(scaled.transform(x).select("part", "label", "weight", "features"))
    # the scaler divides by the sample deviation; the penalty makes up for its n - 1
    model = LogisticRegression(weightCol="weight", regParam=(n - 1) / (n * n), standardization=False, maxIter=100, tol=1e-9).fit(x.where(F.col("part") == train))
    scored = model.transform(x.where(F.col("part") == test)).select(F.col("label").cast("int").alias("label_id"), vector_to_array("probability")[1].alias("score"))
    return float(roc_auc(scored, []).first()[0])


def control_aucs(rows: DataFrame, probes: list[Probe], split: str = "split") -> DataFrame:
    """``probe, auc, gated`` of a handful of probes."""
    rows = keep(rows)
    return rows.sparkSession.createDataFrame([(p.name, probe_auc(rows, p, split), p.gated) for p in probes], "probe string, auc double, gated boolean")


def verdict(aucs: DataFrame, gate: float, finite: bool) -> DataFrame:
    """``status, worst, failed``: ``fail`` if a gated AUC is above the gate or, with ``finite``, is no finite number; without it such a
    probe passes."""
    unknown = F.col("auc").isNull() | F.isnan("auc") | (F.abs("auc") == float("inf"))
    bad = F.col("gated") & F.when(unknown, F.lit(finite)).otherwise(F.col("auc") > gate)
    out = aucs.agg(F.max(F.when(~unknown & F.col("gated"), F.col("auc"))).alias("worst"), F.array_join(F.array_sort(F.collect_list(F.when(bad, F.col("probe")))), "|").alias("failed"))
    return out.select(F.when(F.col("failed") == "", "pass").otherwise("fail").alias("status"), "worst", "failed")
