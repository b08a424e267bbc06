"""Ordered prefix sums, ranks and quantiles that no single task carries.

A running sum over a whole relation is one window in one task.  Here the order is cut at approximate quantiles of all rows: each
bucket is a window of its own, and the sums of the buckets before it, one row per key and bucket, are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Buckets for each shuffle partition, and their bounds: the session's shuffle width is to grow with the input, so buckets do.
PER_PARTITION, LEAST_BUCKETS, MOST_BUCKETS = 8, 64, 8192


def bucket_count(spark: SparkSession) -> int:
    return max(LEAST_BUCKETS, min(MOST_BUCKETS, PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))))


def with_buckets(df: DataFrame, order: str, out: str = "_bucket", buckets: int | None = None) -> DataFrame:
    """``df`` with the number of quantile cuts below its ``order`` value, found by bisection; NaN gets the last bucket and null the
    first.  Equal values share one; of different values, a bucket holds about one ``buckets``-th of all rows, whatever their keys."""
    buckets = buckets or bucket_count(df.sparkSession)
    grid = F.array(*[F.lit((i + 1) / buckets) for i in range(buckets - 1)])
    cuts = df.agg(F.coalesce(F.percentile_approx(order, grid, 10 * buckets), F.array().cast(f"array<{dict(df.dtypes)[order]}>")).alias("_cuts"))
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(buckets.bit_length()))])
    below = F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= F.size("_cuts")) & (F.get(F.col("_cuts"), at + step - 1) < F.col(order)), at + step).otherwise(at))
    return df.crossJoin(F.broadcast(cuts)).withColumn(out, below).drop("_cuts")


def prefix_sums(df: DataFrame, keys: list[str], order: str, sums: dict[str, str], descending: bool = False, then: list[Column] | None = None) -> DataFrame:
    """``df`` with ``sums[new]`` the sum of column ``new``'s source over all rows of its keys up to and with its own, in order.

    ``then`` breaks ties of ``order``; without it equal rows share no order, so group first.  Descending order runs from the top.
    """
    way = F.col(order).desc() if descending else F.col(order).asc()
    rows = with_buckets(df, order)
    by = F.col("_bucket").desc() if descending else F.col("_bucket").asc()
    per = rows.groupBy(*keys, "_bucket").agg(*[F.sum(src).alias(f"_{new}") for new, src in sums.items()])
    before = Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*keys, "_bucket", *[F.coalesce(F.sum(f"_{new}").over(before), F.lit(0)).alias(f"_{new}") for new in sums])
    inside = Window.partitionBy(*keys, "_bucket").orderBy(way, *(then or [])).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(F.broadcast(per) if not keys else per, [*keys, "_bucket"])
    return rows.withColumns({new: F.sum(src).over(inside) + F.col(f"_{new}") for new, src in sums.items()}).drop("_bucket", *[f"_{new}" for new in sums])


def row_numbers(df: DataFrame, keys: list[str], order: str, out: str = "row", descending: bool = False, then: list[Column] | None = None) -> DataFrame:
    """Row numbers from 1 over all rows of the keys, by ``prefix_sums``."""
    return prefix_sums(df.withColumn("_one", F.lit(1)), keys, order, {out: "_one"}, descending, then).drop("_one")


def quantiles(df: DataFrame, keys: list[str], value: str, points: list[float], weight: str | None = None) -> DataFrame:
    """Per key ``q``, the array of exact quantiles at the ascending ``points`` with linear interpolation; nulls are left out, and keys without
    a value are absent.  A row counts ``weight`` times, if that is named.

    Distinct values are counted and ranked by prefix sums; each point takes the values that hold its two ranks, so no task has
    all values of a key."""
    per = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg((F.sum(weight) if weight else F.count("*")).alias("_n"))
    all_ = per.groupBy(*keys).agg(F.sum("_n").alias("_all"))
    run = prefix_sums(per, keys, value, {"_to": "_n"})
    run = run.join(all_, keys) if keys else run.crossJoin(F.broadcast(all_))
    grid = F.lit([float(p) for p in points])
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(points).bit_length()))])

    def mine(f, side: int) -> Column:
        """The points whose rank falls on this value's rows, found by bisection."""
        below = lambda bound: F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= len(points)) & (f(F.get(grid, at + step - 1) * (F.col("_all") - 1)) < bound), at + step).otherwise(at))
        first = below(F.col("_to") - F.col("_n"))
        return F.transform(F.slice(grid, first + 1, below(F.col("_to")) - first), lambda p: F.struct(p.alias("p"), F.lit(side).alias("side")))

    held = F.concat(mine(F.floor, 0), mine(F.ceil, 1))
    got = run.select(*keys, F.col(value).cast("double").alias("_v"), F.explode(held).alias("_w"), "_all")
    two = got.groupBy(*keys, "_w.p").agg(F.max(F.when(F.col("_w.side") == 0, F.col("_v"))).alias("_lo"), F.max(F.when(F.col("_w.side") == 1, F.col("_v"))).alias("_hi"), F.first("_all").alias("_all"))
    at = F.col("p") * (F.col("_all") - 1)
    q = F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(F.col("_lo") + (at - F.floor(at)) * (F.col("_hi") - F.col("_lo")))
    return two.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("p", q.alias("v")))), lambda x: x["v"]).alias("q"))
