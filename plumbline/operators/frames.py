"""Operators on frame sequences: rows of a record in order.  A record's frames are one window, so work is per record, and a record
must fit a task (some 10^7 frames)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .prefix import quantiles


def _w(keys: list[str], order: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)


def runs(frames: DataFrame, keys: list[str], order: list[str], flag: Column) -> DataFrame:
    """``frames`` with ``flag`` as boolean, ``rise`` where it turns true, ``run`` (number of the run of true frames) and
    ``streak`` (its length so far, 0 where false)."""
    w = _w(keys, order)
    up_to = w.rowsBetween(Window.unboundedPreceding, 0)
    f = frames.withColumn("flag", F.coalesce(flag, F.lit(False)))
    f = f.withColumn("rise", F.col("flag") & ~F.coalesce(F.lag("flag").over(w), F.lit(False)))
    f = f.withColumns({"run": F.count_if("rise").over(up_to), "_off": F.count_if(~F.col("flag")).over(up_to)})
    return f.withColumn("streak", F.when(F.col("flag"), F.row_number().over(Window.partitionBy(*keys, "_off", "flag").orderBy(*order))).otherwise(0)).drop("_off")


def run_summary(frames: DataFrame, keys: list[str], order: list[str], flag: Column, time: str) -> DataFrame:
    """Per record: time of the first true frame, longest run of true frames, number of runs."""
    r = runs(frames, keys, order, flag)
    return r.groupBy(*keys).agg(F.min(F.when(F.col("flag"), F.col(time))).alias("first_true"), F.max("streak").cast("int").alias("longest_run"), F.count_if("rise").alias("fragments"))


def first_trigger(frames: DataFrame, keys: list[str], order: list[str], hit: Column, consecutive: int = 2) -> DataFrame:
    """The frame at which each record first has ``consecutive`` hits in a row; records without one are absent."""
    r = runs(frames, keys, order, hit).where(F.col("streak") == consecutive)
    rest = [c for c in frames.columns if c not in keys]
    return r.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_f")).select(*keys, *[F.col(f"_f.{c}").alias(c) for c in rest])


def rolling_blend(frames: DataFrame, keys: list[str], order: list[str], value: str, n: int = 16, own: float = 0.25) -> DataFrame:
    """``own`` x value + the rest x mean of the last ``n``, clipped to [0, 1]."""
    mean = F.avg(value).over(_w(keys, order).rowsBetween(-(n - 1), 0))
    return frames.withColumn("blend", F.least(F.greatest(own * F.col(value) + (1 - own) * mean, F.lit(0.0)), F.lit(1.0)))


def persistence(frames: DataFrame, keys: list[str], order: list[str], hit: Column) -> DataFrame:
    """A counter that rises by one on a hit and falls by one, not below zero, on a miss: with S the running sum of +1 and -1 it
    is S - min(0, least S so far)."""
    w = _w(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    s = frames.withColumn("_s", F.sum(F.when(hit, 1).otherwise(-1)).over(w))
    return s.withColumn("persistence", (F.col("_s") - F.least(F.lit(0), F.min("_s").over(w))).cast("bigint")).drop("_s")


def m_of_n(frames: DataFrame, keys: list[str], order: list[str], flag: Column, m: int = 3, n: int = 5) -> DataFrame:
    return frames.withColumn("m_of_n", F.sum(F.when(flag, 1).otherwise(0)).over(_w(keys, order).rowsBetween(-(n - 1), 0)) >= m)


def finite_difference(frames: DataFrame, keys: list[str], order: list[str], value: str, time: str) -> DataFrame:
    """(x - previous x) / (t - previous t); null for the first frame and where time does not advance."""
    w = _w(keys, order)
    dt = F.col(time) - F.lag(time).over(w)
    return frames.withColumn("rate", F.when(dt > 0, (F.col(value) - F.lag(value).over(w)) / dt))


def trailing(frames: DataFrame, keys: list[str], order: list[str], value: str, n: int) -> DataFrame:
    """The last ``n`` values up to each frame, oldest first."""
    return frames.withColumn("trailing", F.collect_list(value).over(_w(keys, order).rowsBetween(-(n - 1), 0)))


def gap_fraction(frames: DataFrame, keys: list[str], order: list[str], time: str, factor: float = 2.5) -> DataFrame:
    """Share of steps in time longer than ``factor`` x the median step; 0 with fewer than three points."""
    d = frames.withColumn("_d", F.col(time) - F.lag(time).over(_w(keys, order))).where("_d is not null")
    med = d.groupBy(*keys).agg(F.percentile("_d", 0.5).alias("_m"), F.count("*").alias("_n"))
    out = d.join(med, keys).groupBy(*keys).agg(F.first("_n").alias("_n"), F.avg(F.when(F.col("_d") > factor * F.col("_m"), 1.0).otherwise(0.0)).alias("gap_fraction"))
    return frames.select(*keys).distinct().join(out, keys, "left").select(*keys, F.when(F.col("_n") >= 2, F.col("gap_fraction")).otherwise(0.0).alias("gap_fraction"))


def sliding_windows(frames: DataFrame, keys: list[str], order: list[str], value: str, size: int) -> DataFrame:
    """Windows of ``size`` frames that overlap by half; a shorter record gives one, its last frame repeated.  Frames are numbered
    and sent to the one or two windows that hold them, so no record is gathered whole."""
    stride = max(1, size // 2)
    n = frames.withColumn("_i", F.row_number().over(_w(keys, order)) - 1)
    count = frames.groupBy(*keys).agg(F.count("*").alias("_n"), F.max_by(value, F.struct(*order)).alias("_last"))
    n = n.join(count, keys).withColumn("_most", F.greatest(F.lit(0), F.floor((F.col("_n") - size) / stride)).cast("int"))
    lo = F.greatest(F.lit(0), F.ceil((F.col("_i") - size + 1) / stride).cast("int"))
    hi = F.least(F.floor(F.col("_i") / stride).cast("int"), F.col("_most"))
    n = n.where(lo <= hi).withColumn("window", F.explode(F.sequence(lo, hi)))
    out = n.groupBy(*keys, "window").agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", F.col(value).alias("v")))), lambda s: s["v"]).alias("values"), F.first("_last").alias("_last"))
    pad = F.array_repeat(F.col("_last"), F.greatest(F.lit(0), F.lit(size) - F.size("values")))
    return out.select(*keys, "window", F.concat("values", pad).alias("values"))


def pulse_canceller(frames: DataFrame, keys: list[str], order: list[str], value: str, pulses: int = 2) -> DataFrame:
    """Two- or three-pulse difference along the order; 0 until enough pulses have passed."""
    w = _w(keys, order)
    x1, x2 = F.lag(value, 1).over(w), F.lag(value, 2).over(w)
    y = F.col(value) - x1 if pulses == 2 else F.col(value) - 2 * x1 + x2
    return frames.withColumn("cancelled", F.coalesce(y, F.lit(0.0)))


def learned_threshold(frames: DataFrame, phase: str, score: str, train: Column, q: float = 0.64) -> DataFrame:
    """The ``q`` quantile of the training frames' scores per phase; 0 for a phase without any."""
    t = quantiles(frames.where(train), [phase], score, [q]).select(phase, F.col("q")[0].alias("threshold"))
    return frames.select(phase).distinct().join(t, phase, "left").na.fill(0.0, ["threshold"])


def lifecycle(frames: DataFrame, keys: list[str], order: list[str], time: str, score: str, threshold: str, confirm: int = 2) -> DataFrame:
    """Per record: first hit, time of confirmation (``confirm`` hits in a row), runs, hits, frames, greatest and mean score,
    confidence (logistic of the mean margin) and how the track ends."""
    r = runs(frames, keys, order, F.col(score) >= F.col(threshold))
    out = r.groupBy(*keys).agg(
        F.min(F.when(F.col("flag"), F.col(time))).alias("first_hit"), F.min(F.when(F.col("streak") == confirm, F.col(time))).alias("track_init"),
        F.count_if("rise").alias("fragments"), F.count_if("flag").alias("hits"), F.count("*").alias("frames"), F.max(score).alias("max_score"), F.avg(score).alias("mean_score"),
        F.avg(F.col(score) - F.col(threshold)).alias("_margin"), F.max_by("flag", F.struct(*order)).alias("_end"),
    )
    end = F.when(F.col("hits") == 0, "never_started").when(F.col("_end"), "active_at_end").otherwise("missed_at_end")
    return out.withColumns({"confidence": 1 / (1 + F.exp(-F.col("_margin"))), "end": end}).drop("_margin", "_end")


def phase_rates(tracks: DataFrame, phase: str) -> DataFrame:
    """Per phase: any-hit rate of positives and negatives, mean first hit and fragments of detected positives."""
    y = F.col("label_id") == 1
    return tracks.groupBy(phase).agg(
        F.coalesce(F.avg(F.when(y, (F.col("hits") > 0).cast("double"))), F.lit(0.0)).alias("pd"), F.coalesce(F.avg(F.when(~y, (F.col("hits") > 0).cast("double"))), F.lit(0.0)).alias("pfa"),
        F.avg(F.when(y, F.col("first_hit"))).alias("mean_first_hit"), F.avg(F.when(y & (F.col("hits") > 0), F.col("fragments"))).alias("mean_fragments"), F.count("*").alias("records"),
    )


def horizon(frames: DataFrame, time: str, seconds: float) -> DataFrame:
    """Frames up to a horizon; none at all is an error."""
    out = frames.where(F.col(time) <= seconds + 1e-6)
    if out.isEmpty():
        raise ValueError(f"no frames up to {seconds} s")
    return out


def padded(frames: DataFrame, keys: list[str], order: list[str], value: str, length: int) -> DataFrame:
    """Each record as arrays of one length: its values, then zeros, and a mask of which are real; longer records are an error."""
    v = frames.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct(*order, F.col(value).alias("_v")))), lambda s: s["_v"]).alias("_a"))
    n = F.size("_a")
    fits = F.when(n <= length, n).otherwise(F.raise_error(F.lit(f"a record has more than {length} frames")).cast("int"))
    return v.select(*keys, F.concat("_a", F.array_repeat(F.lit(0.0), F.lit(length) - fits)).alias("values"), F.concat(F.array_repeat(F.lit(True), n), F.array_repeat(F.lit(False), F.lit(length) - n)).alias("mask"))


def in_phase_order(rows: DataFrame, phase: str, order: list[str], then: list[str]) -> DataFrame:
    """Rows by an explicit order of phases, unknown ones last, then by name and ``then``."""
    rank = F.coalesce(F.nullif(F.array_position(F.lit(order), F.col(phase)), F.lit(0)), F.lit(99))
    return rows.withColumn("phase_rank", rank.cast("int")).orderBy("phase_rank", phase, *then)
