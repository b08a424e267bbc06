"""Splits that do not leak, sampling by hash, and leakage reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fnv1a_mod, protected_key, split_by_bps, stable_order
from .prefix import row_numbers

_RANK = {"train": 0, "validation": 1, "test": 2}


def hash_split(df: DataFrame, keys: list[str], out: str = "split", hint: str | None = None) -> DataFrame:
    """Split by FNV-1a of the tuple of protected keys; a hint, if given and not null, goes before it."""
    s = split_by_bps(fnv1a_mod(protected_key(keys)))
    return df.withColumn(out, F.coalesce(F.col(hint), s) if hint else s)


def leakage_report(df: DataFrame, keys: list[str], split: str, id_col: str) -> DataFrame:
    """Values of protected keys that stand in several splits: one row per further split, with the least id in each and how many
    rows there are.  Keys are unpivoted, so it is one aggregation for all."""
    long = df.select(F.col(split).alias("_s"), F.col(id_col).alias("_id"), F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys])).alias("kv"))
    per = long.where("kv.value is not null").groupBy("kv.key", "kv.value", "_s").agg(F.count("*").alias("rows"), F.min("_id").alias("least_id"))
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in _RANK.items() for x in kv]), F.col("_s"))
    base = per.withColumn("_r", F.coalesce(rank, F.lit(9)))
    first = base.groupBy("key", "value").agg(F.min(F.struct("_r", "_s", "least_id")).alias("f"), F.count("*").alias("splits")).where("splits > 1")
    out = base.join(first, ["key", "value"]).where(F.col("_s") != F.col("f._s"))
    return out.select("key", "value", F.col("f._s").alias("first_split"), F.col("_s").alias("other_split"), F.col("f.least_id").alias("first_id"), F.col("least_id").alias("other_id"), "rows")


def top_by_hash(df: DataFrame, cells: list[str], id_col: str, rate: float, seed: int = 1, low: float = 0.1, high: float = 0.2) -> DataFrame:
    """Of each cell the rows first in hash order: ``round(n * rate)``, at least ``ceil(low n)`` and at most ``floor(high n)``."""
    r = row_numbers(df.withColumn("_k", F.conv(F.substring(stable_order(seed, "cell", F.col(id_col)), 1, 13), 16, 10).cast("bigint")), cells, "_k", "_rank", then=[F.col(id_col)])
    n = df.groupBy(*cells).agg(F.count("*").alias("_n"))
    take = F.least(F.greatest(F.bround(F.col("_n") * rate), F.ceil(F.col("_n") * low)), F.greatest(F.floor(F.col("_n") * high), F.lit(1)))
    return r.join(n, cells).where(F.col("_rank") <= take).drop("_k", "_rank", "_n")


def folds(df: DataFrame, label: str, id_col: str, k: int = 5, seed: int = 1) -> DataFrame:
    """Per label a fold by rank in hash order modulo ``k``."""
    h = df.withColumn("_k", F.conv(F.substring(stable_order(seed, "fold", F.col(id_col)), 1, 13), 16, 10).cast("bigint"))
    return row_numbers(h, [label], "_k", "_rank", then=[F.col(id_col)]).withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_k", "_rank")


def quota_split(df: DataFrame, id_col: str, seed: int = 1, train: float = 0.70, validation: float = 0.15) -> DataFrame:
    """Exact 70 / 15 / rest over a hash shuffle."""
    h = df.withColumn("_k", F.conv(F.substring(stable_order(seed, "quota", F.col(id_col)), 1, 13), 16, 10).cast("bigint"))
    r = row_numbers(h, [], "_k", "_rank", then=[F.col(id_col)]).crossJoin(F.broadcast(df.agg(F.count("*").alias("_n"))))
    a, b = F.bround(F.col("_n") * train), F.bround(F.col("_n") * validation)
    return r.withColumn("split", F.when(F.col("_rank") <= a, "train").when(F.col("_rank") <= a + b, "validation").otherwise("test")).drop("_k", "_rank", "_n")


def weighted_remainder(total: int, weights: dict[str, int]) -> dict[str, int]:
    """``floor(total * weight / 100)`` each, what is left dealt one by one from the first."""
    out = {k: total * w // 100 for k, w in weights.items()}
    names = list(out)
    for i in range(total - sum(out.values())):
        out[names[i % len(names)]] += 1
    return out


def modulo_split(index: Column) -> Column:
    m = F.pmod(index, F.lit(20))
    return F.when(m < 3, "test").when(m < 6, "validation").otherwise("train")


def expand_phases(groups: DataFrame, group: str, phases: list[tuple[str, float, float]], shard: int = 128) -> DataFrame:
    """A row per group and phase, numbered by group and phase, with shard and offset, and times in nanoseconds."""
    p = groups.sparkSession.createDataFrame([(i, *x) for i, x in enumerate(phases)], "phase_index int, phase_id string, phase_start_s double, phase_end_s double")
    g = row_numbers(groups, [], group, "_g")
    out = g.crossJoin(F.broadcast(p)).withColumn("record_index", (F.col("_g") - 1) * len(phases) + F.col("phase_index"))
    ns = lambda c: F.round(F.col(c) * 1e9).cast("bigint")
    return out.withColumns({"shard_index": F.floor(F.col("record_index") / shard), "row_offset": F.col("record_index") % shard, "timestamp_start_ns": ns("phase_start_s"), "timestamp_end_ns": ns("phase_end_s")}).drop("_g", "phase_index")


def holdout_quota(groups: int, positives: int, folds: int = 5, share: float = 0.15) -> tuple[int, int, int, int]:
    """Holdout and training groups, and the positives of each: the share of groups, at least ``folds`` on either side, and of the positives
    rounded up."""
    if not 0 < positives < groups:
        raise ValueError("there must be fewer positive groups than groups, and one at least")
    hold = min(max(folds, round(groups * share)), groups - folds)
    hold_pos = min(-(-hold * positives // groups), positives, hold)
    if positives - hold_pos <= 0:
        raise ValueError("no positive group is left to train on")
    return hold, groups - hold, hold_pos, positives - hold_pos


def group_manifest(groups: DataFrame, group: str, positive: str, folds: int = 5, seed: int = 1) -> DataFrame:
    """Every group with ``split_role`` and ``cv_fold``: positives and negatives each in hash order, the first of them held out by
    quota, the others dealt to folds by rank."""
    n = groups.agg(F.count("*").alias("n"), F.sum(F.col(positive).cast("long")).alias("p")).first()
    hold, _, hold_pos, _ = holdout_quota(n.n, n.p, folds)
    key = F.conv(F.substring(stable_order(seed, "manifest", F.col(group)), 1, 13), 16, 10).cast("bigint")
    r = row_numbers(groups.withColumn("_k", key), [positive], "_k", "_rank", then=[F.col(group)])
    quota = F.when(F.col(positive).cast("int") == 1, hold_pos).otherwise(hold - hold_pos)
    out = r.withColumn("split_role", F.when(F.col("_rank") <= quota, "holdout").otherwise("train"))
    return out.withColumn("cv_fold", F.when(F.col("split_role") == "train", F.pmod(F.col("_rank") - quota - 1, F.lit(folds))).otherwise(F.lit(-1)).cast("int")).drop("_k", "_rank")


def strata_split(df: DataFrame, id_col: str, stratum: Column, held: list, seed: int = 1, train: float = 0.70, validation: float = 0.15) -> DataFrame:
    """Rows of held-out strata are ``test``; the others, in hash order, fill validation, what is left of test, and train."""
    rows = df.withColumn("_held", stratum.isin(held)).withColumn("_k", F.conv(F.substring(stable_order(seed, "strata", F.col(id_col)), 1, 13), 16, 10).cast("bigint"))
    r = row_numbers(rows, ["_held"], "_k", "_rank", then=[F.col(id_col)])
    n = rows.agg(F.count("*").alias("_n"), F.count_if("_held").alias("_h"))
    r = r.crossJoin(F.broadcast(n))
    a, b = F.bround(F.col("_n") * train), F.bround(F.col("_n") * validation)
    rest = F.greatest(F.col("_n") - a - b - F.col("_h"), F.lit(0))
    return r.withColumn("split", F.when(F.col("_held"), "test").when(F.col("_rank") <= b, "validation").when(F.col("_rank") <= b + rest, "test").otherwise("train")).drop("_held", "_k", "_rank", "_n", "_h")


def round_robin(plan: DataFrame, index: str, positive: Column, positives: list[str], negatives: list[str]) -> DataFrame:
    """A class for each row of a plan: positives and negatives in turn, by the row's index."""
    pick = lambda names: F.element_at(F.array(*[F.lit(n) for n in names]), (F.col(index) % len(names) + 1).cast("int"))
    return plan.withColumn("class_label", F.when(positive, pick(positives)).otherwise(pick(negatives)))


def quotas(weights: DataFrame, total: int, bucket: str = "bucket", weight: str = "weight") -> DataFrame:
    """``bucket, n``: ``floor(total * weight / sum)`` of each bucket, what is left dealt one by one from the first by name."""
    w = row_numbers(weights.withColumn("_same", F.lit(0)), [], "_same", "_k", then=[F.col(bucket).asc()])
    all_ = weights.agg(F.sum(weight).alias("_sum"), F.count("*").alias("_of"))
    w = w.crossJoin(F.broadcast(all_)).withColumn("n", F.floor(F.lit(total) * F.col(weight) / F.col("_sum")).cast("long"))
    left = w.agg((F.lit(total) - F.sum("n")).alias("_left"))
    w = w.crossJoin(F.broadcast(left))
    more = F.floor(F.col("_left") / F.col("_of")) + F.when(F.col("_k") <= F.col("_left") % F.col("_of"), 1).otherwise(0)
    return w.select(bucket, (F.col("n") + more).cast("long").alias("n"))


def campaign_plan(weights: DataFrame, total: int, seed: int = 1) -> DataFrame:
    """``(slot, bucket, index)`` of ``weights(bucket, weight)``: buckets by weighted quota, slots in hash order."""
    b = quotas(weights, total).where("n > 0").select("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("index"))
    b = b.withColumn("_k", F.conv(F.substring(stable_order(seed, "plan", F.col("bucket"), F.col("index")), 1, 13), 16, 10).cast("bigint"))
    return row_numbers(b, [], "_k", "slot", then=[F.col("bucket"), F.col("index")]).withColumn("slot", F.col("slot") - 1).drop("_k")
