"""Adaptive thresholds, peaks, tracks and spectra on cells: windows, joins and sums."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import components, keep


def cell_average_alpha(cells: int, pfa: float) -> float:
    """The factor for ``cells`` training cells (of one side) and a false-alarm rate."""
    return cells * (pfa ** (-1.0 / cells) - 1.0)


def order_statistic_alpha(cells: int, k: int, pfa: float) -> float:
    """Root of the false-alarm rate of the ``k``-th of ``cells`` order statistics in exponential noise, by bisection."""
    rate = lambda a: float(np.prod([(cells - i) / (cells - i + a) for i in range(k)]))
    lo, hi = 0.0, 1.0
    while rate(hi) > pfa:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if rate(mid) > pfa else (lo, mid)
    return (lo + hi) / 2


def cfar(cells: DataFrame, keys: list[str], order: list[str], value: str, train: int = 8, guard: int = 2, pfa: float = 1e-2, kind: str = "ca", quantile: float = 0.75) -> DataFrame:
    """Adaptive threshold along an order: training cells on both sides beyond guard cells.  ``ca`` averages both sides, ``go`` and
    ``so`` take the greater or smaller side's mean, ``os`` an order statistic of all.  Cells without full sides are not
    evaluated and have an infinite threshold; a detection is strictly above."""
    w = Window.partitionBy(*keys).orderBy(*order)
    left, right = w.rowsBetween(-(train + guard), -(guard + 1)), w.rowsBetween(guard + 1, guard + train)
    full = (F.count(value).over(left) == train) & (F.count(value).over(right) == train)
    a, b = F.avg(value).over(left), F.avg(value).over(right)
    if kind == "os":
        k = min(2 * train, max(1, round(quantile * 2 * train)))
        noise = F.sort_array(F.concat(F.collect_list(value).over(left), F.collect_list(value).over(right)))[k - 1]
        alpha = order_statistic_alpha(2 * train, k, pfa)
    else:
        noise = {"ca": (a + b) / 2, "go": F.greatest(a, b), "so": F.least(a, b)}[kind]
        alpha = cell_average_alpha(train, pfa)
    out = cells.withColumns({"evaluated": full, "_noise": noise})
    out = out.withColumn("threshold", F.when(F.col("evaluated"), alpha * F.col("_noise")).otherwise(F.lit(float("inf"))))
    return out.withColumn("detected", F.col("evaluated") & (F.col(value) > F.col("threshold"))).drop("_noise")


def local_peaks(grid: DataFrame, keys: list[str], x: str, y: str, value: str, threshold: float) -> DataFrame:
    """Cells above the threshold and not below any of their eight neighbours; cells that lack one are left out.  Each cell is sent
    to its neighbours, so it is one aggregation and no join."""
    d = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("d")
    sent = grid.select(*keys, x, y, value, d).select(*keys, (F.col(x) + F.col("d.i")).alias(x), (F.col(y) + F.col("d.j")).alias(y), F.when((F.col("d.i") == 0) & (F.col("d.j") == 0), F.col(value)).alias("_own"), F.col(value).alias("_v"))
    at = sent.groupBy(*keys, x, y).agg(F.max("_own").alias(value), F.max("_v").alias("_top"), F.count("*").alias("_n"))
    return at.where((F.col("_n") == 9) & (F.col(value) > threshold) & (F.col(value) >= F.col("_top"))).select(*keys, x, y, value)


def blobs(grid: DataFrame, keys: list[str], x: str, y: str, value: str, threshold: float, least: int = 1) -> DataFrame:
    """Four-connected components of cells above the threshold: label, size, weighted centroid, peak.  Cells are joined with their
    right and lower neighbours; the rest is the components of that graph."""
    label = F.concat_ws(",", F.lpad(F.col(x).cast("string"), 12, "0"), F.lpad(F.col(y).cast("string"), 12, "0"))
    cells = grid.where(F.col(value) > threshold).select(*keys, x, y, value, label.alias("label"))
    cells = cells.withColumn("_id", F.concat_ws("|", *[F.col(k).cast("string") for k in keys], "label"))
    edges = None
    for dx, dy in ((1, 0), (0, 1)):
        other = cells.select(*keys, (F.col(x) - dx).alias(x), (F.col(y) - dy).alias(y), F.col("_id").alias("b"))
        e = cells.select(*keys, x, y, F.col("_id").alias("a")).join(other, [*keys, x, y]).select("a", "b")
        edges = e if edges is None else edges.unionByName(e)
    comp = components(edges).select(F.col("node").alias("_id"), F.substring_index("comp", "|", -1).alias("_comp"))
    cells = cells.join(comp, "_id", "left").withColumn("label", F.coalesce("_comp", "label"))
    total = F.sum(value)
    out = cells.groupBy(*keys, "label").agg(F.count("*").alias("size"), (F.sum(F.col(x) * F.col(value)) / total).alias("cx"), (F.sum(F.col(y) * F.col(value)) / total).alias("cy"), F.max(value).alias("peak"))
    return out.where(F.col("size") >= least)


def hough_tracks(cells: DataFrame, keys: list[str], time: str, pos: str, value: str, gradients: list[float], threshold: float, least: int) -> DataFrame:
    """Straight tracks: every cell above the threshold votes for the start ``pos - gradient * time`` of each gradient; lines with
    at least ``least`` distinct times, with their summed power."""
    votes = cells.where(F.col(value) > threshold).withColumn("gradient", F.explode(F.array(*[F.lit(float(g)) for g in gradients])))
    votes = votes.withColumn("start", F.round(F.col(pos) - F.col("gradient") * F.col(time)).cast("bigint"))
    per = votes.groupBy(*keys, "gradient", "start", time).agg(F.max(value).alias("_v"))
    return per.groupBy(*keys, "gradient", "start").agg(F.count("*").alias("hits"), F.sum("_v").alias("power")).where(F.col("hits") >= least)


def suppress(candidates: DataFrame, keys: list[str], bin_col: str = "start", grad: str = "gradient", power: str = "power", near_bin: int = 3, near_grad: float = 0.5) -> DataFrame:
    """Greedy by power (then bin, then gradient): a candidate near a kept one in both start and gradient is dropped.

    In each round those candidates are kept that no stronger neighbour is left of, and their neighbours go; so a round is one join
    of neighbours on bins of ``near_bin``; every round keeps the strongest that is left, so it ends, after as many rounds as the longest
    chain of ever stronger neighbours needs."""
    order = F.struct(F.col(power), -F.col(bin_col), -F.col(grad))
    left = keep(candidates.withColumn("_o", order))
    kept = None
    while True:
        a = left.select(*keys, F.col(bin_col).alias("_b"), F.col(grad).alias("_g"), F.col("_o").alias("_q"), F.explode(F.array(*[F.floor(F.col(bin_col) / near_bin) + d for d in (-1, 0, 1)])).alias("_cell"))
        j = left.withColumn("_cell", F.floor(F.col(bin_col) / near_bin)).join(a, [*keys, "_cell"]).where((F.abs(F.col(bin_col) - F.col("_b")) < near_bin) & (F.abs(F.col(grad) - F.col("_g")) < near_grad))
        top = j.groupBy(*keys, bin_col, grad).agg(F.max("_q").alias("_top"), F.max("_o").alias("_mine"))
        won = keep(top.where(F.col("_top") == F.col("_mine")).select(*keys, bin_col, grad))
        if won.isEmpty():
            break
        kept = won if kept is None else kept.unionByName(won)
        w = won.select(*keys, F.col(bin_col).alias("_b"), F.col(grad).alias("_g"), F.explode(F.array(*[F.floor(F.col(bin_col) / near_bin) + d for d in (-1, 0, 1)])).alias("_cell"))
        gone = left.withColumn("_cell", F.floor(F.col(bin_col) / near_bin)).join(w, [*keys, "_cell"]).where((F.abs(F.col(bin_col) - F.col("_b")) < near_bin) & (F.abs(F.col(grad) - F.col("_g")) < near_grad)).select(*keys, bin_col, grad).distinct()
        left = keep(left.join(gone, [*keys, bin_col, grad], "left_anti"))
        if left.isEmpty():
            break
    return candidates if kept is None else candidates.join(kept, [*keys, bin_col, grad])


def hann(n: int) -> np.ndarray:
    return np.ones(max(n, 0)) if n <= 1 else 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / (n - 1))


def ring_cfar(cells: DataFrame, keys: list[str], x: str, y: str, value: str, train: int = 3, guard: int = 1, pfa: float = 1e-3, kind: str = "ca", index: int = 0) -> DataFrame:
    """Cells strictly above ``alpha`` times a statistic of the square ring around them, beyond the guard cells: its mean (``ca``), or
    its ``index``-th smallest value, from 0 (``os``).  Only cells with a full ring are evaluated; a grid that lacks cells has fewer.

    A square is a window along one axis over windows along the other, so cells are sorted twice and never multiplied.  A row or
    column of a grid is one window."""
    outer, n = train + guard, (2 * (train + guard) + 1) ** 2 - (2 * guard + 1) ** 2
    near = lambda by, along, r: Window.partitionBy(*keys, by).orderBy(along).rangeBetween(-r, r)

    def square(r: int, name: str) -> dict[str, Column]:
        return {f"_s{name}": F.sum(f"_x{name}").over(near(x, y, r)), f"_n{name}": F.sum(f"_c{name}").over(near(x, y, r))}

    rows = cells
    for r, name in ((outer, "o"), (guard, "g")):
        rows = rows.withColumns({f"_x{name}": F.sum(value).over(near(y, x, r)), f"_c{name}": F.count(value).over(near(y, x, r))})
    rows = rows.withColumns({**square(outer, "o"), **square(guard, "g")})
    rows = rows.where((F.col("_no") == (2 * outer + 1) ** 2) & (F.col("_ng") == (2 * guard + 1) ** 2))
    if kind == "ca":
        stat, alpha = (F.col("_so") - F.col("_sg")) / n, cell_average_alpha(n, pfa)
    else:
        alpha = order_statistic_alpha(n, min(index, n - 1) + 1, pfa)
        part = F.collect_list(F.struct(F.col(x).alias("x"), F.col(value).alias("v")))
        lists = cells.withColumn("_l", part.over(near(y, x, outer)))
        lists = lists.withColumn("_ring", F.collect_list(F.struct(F.col(y).alias("y"), F.col("_l").alias("l"))).over(near(x, y, outer)))
        inside = lambda r, c: (F.abs(r["y"] - F.col(y)) <= guard) & (F.abs(c["x"] - F.col(x)) <= guard)
        ring = F.flatten(F.transform("_ring", lambda r: F.transform(F.filter(r["l"], lambda c: ~inside(r, c)), lambda c: c["v"])))
        rows = rows.join(lists.select(*keys, x, y, F.get(F.array_sort(ring), F.lit(min(index, n - 1))).alias("_stat")), [*keys, x, y])
        stat = F.col("_stat")
    return rows.select(*keys, x, y, value, (alpha * stat).alias("threshold")).where(F.col(value) > F.col("threshold"))


def cube_reduce(cube: DataFrame, keys: list[str], value: str, how: str = "sum") -> DataFrame:
    """Collapse the axes of a cube of cells that are not keys: ``sum``, ``max`` or ``mean``."""
    return cube.groupBy(*keys).agg({"sum": F.sum, "max": F.max, "mean": F.avg}[how](value).alias(value))


def cube_peak(cube: DataFrame, keys: list[str], axes: list[str], value: str) -> DataFrame:
    """The cell of the greatest value of each cube, the first along the axes among equals."""
    top = F.max_by(F.struct(*axes, F.col(value).alias("peak")), F.struct(F.col(value), *[(-F.col(a)).alias(a) for a in axes]))
    return cube.groupBy(*keys).agg(top.alias("t")).select(*keys, "t.*")


def spectrum(cells: DataFrame, keys: list[str], index: str, re: str, im: str, length: int | str, taper: str = "none") -> DataFrame:
    """Discrete Fourier transform along an axis of ``length`` cells, a number or a column that is one per key: ``bin, re, im``.

    In two steps for a length of ``a * b``, ``a`` its greatest divisor up to the root: cells ``b`` apart are transformed to ``a``
    sums, and these, turned, to ``b`` bins.  So a cell becomes ``a + b`` rows (128 at a length of 4,096), which combine before each
    shuffle; only a prime length takes as many rows as bins.  Cells that are missing count as zero; cells beyond the length are
    left out.  ``taper`` is ``none``, ``hann`` or ``hamming``."""
    n = F.lit(length) if isinstance(length, int) else F.col(length).cast("int")
    wave = F.cos(2 * np.pi * F.col(index) / F.greatest(n - 1, F.lit(1)))
    w = {"none": F.lit(1.0), "hann": 0.5 - 0.5 * wave, "hamming": 0.54 - 0.46 * wave}[taper]
    a = F.aggregate(F.sequence(F.lit(1), F.floor(F.sqrt("_n")).cast("int")), F.lit(1), lambda best, d: F.when(F.col("_n") % d == 0, d).otherwise(best))
    x = cells.where((F.col(index) >= 0) & (F.col(index) < n)).select(*keys, n.alias("_n"), F.col(index).cast("long").alias("_i"), (w * F.col(re)).alias("_re"), (w * F.col(im)).alias("_im"))
    x = x.withColumn("_a", a).withColumn("_b", (F.col("_n") / F.col("_a")).cast("int"))
    x = x.withColumns({"_far": F.floor(F.col("_i") / F.col("_b")), "_near": F.col("_i") % F.col("_b"), "_k": F.explode(F.sequence(F.lit(0), F.col("_a") - 1))})
    x = _turned(x, F.col("_far") * F.col("_k"), F.col("_a"), [*keys, "_n", "_a", "_b", "_near", "_k"])
    x = x.withColumn("_l", F.explode(F.sequence(F.lit(0), F.col("_b") - 1))).withColumn("bin", F.col("_k") + F.col("_a") * F.col("_l"))
    x = _turned(x, F.col("_near") * F.col("bin"), F.col("_n"), [*keys, "bin"])
    return x.select(*keys, F.col("bin").cast("int").alias("bin"), F.col("_re").alias("re"), F.col("_im").alias("im"))


def _turned(x: DataFrame, steps: Column, of: Column, by: list[str]) -> DataFrame:
    """Sums of complex values turned back by ``steps`` of ``of`` steps of a circle."""
    x = x.withColumn("_t", -2 * np.pi * F.pmod(steps, of.cast("long")) / of)
    re = F.col("_re") * F.cos("_t") - F.col("_im") * F.sin("_t")
    im = F.col("_re") * F.sin("_t") + F.col("_im") * F.cos("_t")
    return x.groupBy(*by).agg(F.sum(re).alias("_re"), F.sum(im).alias("_im"))


def own_length(cells: DataFrame, keys: list[str], out: str = "_length", value: str | None = None) -> DataFrame:
    """``cells`` with the number of cells of their keys, and with ``_mean``, the mean of ``value``, if one is named."""
    per = cells.groupBy(*keys).agg(F.count("*").cast("int").alias(out), *([F.avg(value).alias("_mean")] if value else []))
    return cells.join(per, keys)


def greatest_of_alpha(cells: int, pfa: float) -> float:
    """The factor on the greater side's sum of ``cells`` exponential cells a side for a false-alarm rate, by bisection on the exact series."""
    def rate(a: float) -> float:
        k = np.arange(cells)
        log_binom = np.r_[0.0, np.cumsum(np.log((cells + k[:-1]) / (k[:-1] + 1)))]
        return 2 * float((1 + a) ** -cells - np.exp(log_binom - (cells + k) * np.log(2 + a)).sum())

    return _bisect(rate, pfa)


def smallest_of_alpha(cells: int, pfa: float) -> float:
    """The same for the smaller side's sum."""
    k = np.arange(cells)
    log_binom = np.r_[0.0, np.cumsum(np.log((cells + k[:-1]) / (k[:-1] + 1)))]
    return _bisect(lambda a: 2 * float(np.exp(log_binom - (cells + k) * np.log(2 + a)).sum()), pfa)


def weibull_alpha(cells: int, pfa: float, shape: float) -> float:
    """The factor on the mean in Weibull noise of a shape; 0 for no cells or no shape."""
    from math import gamma

    return 0.0 if cells <= 0 or shape <= 0 else cells * (pfa ** (-shape / cells) - 1) ** (1 / shape) / gamma(1 + 1 / shape)


def _bisect(rate, pfa: float) -> float:
    lo, hi = 0.0, 1.0
    while rate(hi) > pfa:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if rate(mid) > pfa else (lo, mid)
    return (lo + hi) / 2


def resample(col: Column, n: int) -> Column:
    """Linear interpolation of an array at ``n`` even points."""
    at = lambda i: i * (F.size(col) - 1) / F.lit(max(n - 1, 1))
    pick = lambda p: F.element_at(col, p.cast("int") + 1)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: pick(F.floor(at(i))) + (at(i) - F.floor(at(i))) * (pick(F.least(F.floor(at(i)) + 1, F.size(col) - 1)) - pick(F.floor(at(i)))))


def fftshift(col: Column) -> Column:
    half = F.ceil(F.size(col) / 2).cast("int")
    return F.concat(F.slice(col, half + 1, F.size(col)), F.slice(col, F.lit(1), half))


def argmax_last(col: Column) -> Column:
    """0-based index of the greatest element, the last of equals."""
    return F.size(col) - F.array_position(F.reverse(col), F.array_max(col)).cast("int")


def lower_quartile_mean(col: Column) -> Column:
    k = F.greatest(F.lit(1), F.floor(F.size(col) / 4).cast("int"))
    return F.aggregate(F.slice(F.array_sort(col), F.lit(1), k), F.lit(0.0), lambda a, x: a + x) / k


def pooled_bytes(cells: DataFrame, keys: list[str], index: str, value: str, buckets: int, length: int) -> DataFrame:
    """Greatest value per bucket of an axis, in decibels, scaled to 0..255 between least and greatest."""
    b = F.floor(F.col(index) * buckets / length).cast("int")
    p = cells.groupBy(*keys, b.alias("bucket")).agg(F.max(value).alias("_v")).withColumn("_db", 10 * F.log10(F.greatest("_v", F.lit(1e-12))))
    r = p.groupBy(*keys).agg(F.min("_db").alias("_lo"), F.max("_db").alias("_hi"))
    q = F.when(F.col("_hi") > F.col("_lo"), F.round((F.col("_db") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * 255)).otherwise(0)
    return p.join(r, keys).select(*keys, "bucket", q.cast("int").alias("level"))


def power_spectrum(cells: DataFrame, keys: list[str], index: str, value: str, taper: str = "none") -> DataFrame:
    """``bin, power`` of a real series without its mean, for the bins up to half of its own length."""
    x = own_length(cells, keys, value=value).withColumn("_x", F.col(value) - F.col("_mean")).withColumn("_zero", F.lit(0.0))
    s = spectrum(x, [*keys, "_length"], index, "_x", "_zero", "_length", taper).where(F.col("bin") <= F.floor(F.col("_length") / 2))
    return s.select(*keys, "bin", (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("power"))


def cepstrum(spectra: DataFrame, keys: list[str], value: str, quefrencies: int, floor: float = 1e-6) -> DataFrame:
    """``quefrency, magnitude``: magnitudes of the transform of the logarithm of a spectrum, over its number of bins; quefrencies beyond
    that number repeat and are left out."""
    x = own_length(spectra, keys).withColumn("_x", F.log(F.greatest(F.col(value), F.lit(floor)))).withColumn("_zero", F.lit(0.0))
    s = spectrum(x, [*keys, "_length"], "bin", "_x", "_zero", "_length").where(F.col("bin") < quefrencies)
    return s.select(*keys, F.col("bin").alias("quefrency"), (F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")) / F.col("_length")).alias("magnitude"))


def modulation_features(cells: DataFrame, keys: list[str], index: str, re: str, im: str, bin_hz: float, least: int = 8) -> DataFrame:
    """Per key, of the magnitude of a complex slow-time series without its mean, padded with zeros to a power of two, 16 at least:
    ``fundamental_hz``, that of the first greatest bin beyond 0; ``depth_db``, greatest over mean magnitude; ``harmonic_ratio``, the
    second harmonic over the fundamental, 0 to 10; ``harmonic_share``, the share of power (without bin 0) at multiples of the
    fundamental; ``entropy_bits`` and ``centroid_hz``.  Series of fewer than ``least`` cells have nulls."""
    x = own_length(cells.withColumn("_m", F.hypot(re, im)), keys, value="_m").withColumn("_x", F.col("_m") - F.col("_mean")).withColumn("_zero", F.lit(0.0))
    bins = F.greatest(F.lit(16), F.pow(F.lit(2.0), F.ceil(F.log2(F.col("_length").cast("double")) - 1e-9)).cast("int"))
    s = spectrum(x.where(F.col("_length") >= least).withColumn("_bins", bins), [*keys, "_length", "_bins"], index, "_x", "_zero", "_bins").where(F.col("bin") < F.col("_bins") / 2)
    s = s.withColumn("v", F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im"))).withColumn("_hz", F.col("_bins") / F.col("_length") * bin_hz)
    top = F.max_by("bin", F.when(F.col("bin") > 0, F.struct("v", -F.col("bin"))))
    mean, total = F.avg("v"), F.sum("v")
    per = s.groupBy(*keys).agg(top.alias("_f"), F.max(F.when(F.col("bin") > 0, F.col("v"))).alias("_top"), F.max("v").alias("_peak"), mean.alias("_avg"), total.alias("_sum"), F.sum(F.when(F.col("v") > 0, F.col("v") * F.log2("v")).otherwise(0.0)).alias("_vlog"), F.sum(F.col("bin") * F.col("_hz") * F.col("v")).alias("_moment"), F.first("_hz").alias("_hz"))
    per = per.withColumn("_f", F.when(F.col("_top") > 0, F.col("_f")).otherwise(1))
    at = s.select(*keys, "bin", "v").join(per.select(*keys, "_f"), keys).where("bin > 0")
    power = F.col("v") * F.col("v")
    multiples = at.groupBy(*keys).agg(F.max(F.when(F.col("bin") == 2 * F.col("_f"), F.col("v"))).alias("_second"), F.when(F.sum(power) > 0, F.sum(F.when(F.col("bin") % F.col("_f") == 0, power).otherwise(0.0)) / F.sum(power)).otherwise(0.0).alias("_share"))
    sound = F.col("_sum") > 0
    out = per.join(multiples, keys).select(
        *keys, (F.col("_f") * F.col("_hz")).alias("fundamental_hz"), F.when(sound & (F.col("_peak") > 0), 10 * F.log10(F.col("_peak") / F.col("_avg"))).otherwise(0.0).alias("depth_db"),
        F.when(F.col("_top") > 0, F.least(F.coalesce(F.try_divide("_second", "_top"), F.lit(0.0)), F.lit(10.0))).otherwise(0.0).alias("harmonic_ratio"), F.when(F.col("_top") > 0, F.col("_share")).otherwise(0.0).alias("harmonic_share"),
        F.when(sound, F.log2("_sum") - F.col("_vlog") / F.col("_sum")).otherwise(0.0).alias("entropy_bits"), F.when(sound, F.col("_moment") / F.col("_sum")).otherwise(0.0).alias("centroid_hz"),
    )
    return cells.select(*keys).distinct().join(out, keys, "left")


def spectral_summary(power: DataFrame, keys: list[str], share: float = 0.9) -> DataFrame:
    """From ``bin, power``: the peak bin (the first of equals), total power, entropy over its largest possible value, and how many of the
    strongest bins hold ``share`` of the power."""
    w = Window.partitionBy(*keys).orderBy(F.desc("power"), "bin")
    all_ = Window.partitionBy(*keys)
    p = power.withColumns({"_total": F.sum("power").over(all_), "_before": F.sum("power").over(w) - F.col("power")})
    q = F.when(F.col("_total") > 0, F.col("power") / F.col("_total")).otherwise(0.0)
    ent = F.sum(F.when(q > 0, -q * F.log(q)).otherwise(0.0)) / F.log(F.greatest(F.count("*"), F.lit(2)).cast("double"))
    return p.groupBy(*keys).agg(F.max_by("bin", F.struct("power", -F.col("bin"))).alias("peak_bin"), F.first("_total").alias("power"), ent.alias("entropy"), F.count_if(F.col("_before") < share * F.col("_total")).cast("int").alias("bandwidth_bins"))


def autocorrelation(cells: DataFrame, keys: list[str], order: list[str], value: str, low: int, high: int, threshold: float = 0.5) -> DataFrame:
    """The lag in ``low .. high`` of greatest autocorrelation of a series without its mean, over that at lag 0 (the least lag among
    equals), and whether it reaches the threshold; series of under 4 cells are left out.  One sort serves all lags."""
    w = Window.partitionBy(*keys).orderBy(*order)
    mean = F.avg(value).over(Window.partitionBy(*keys))
    x = cells.withColumn("_x", F.col(value) - mean)
    x = x.withColumns({f"_p{k}": F.col("_x") * F.lag("_x", k).over(w) for k in range(low, high + 1)})
    energy = F.sum(F.col("_x") * F.col("_x"))
    a = x.groupBy(*keys).agg(F.count("*").alias("_n"), energy.alias("_e"), *[F.coalesce(F.sum(f"_p{k}"), F.lit(0.0)).alias(f"_a{k}") for k in range(low, high + 1)])
    r = lambda k: F.when((F.col("_e") > 0) & (F.lit(k) < F.col("_n")), F.col(f"_a{k}") / F.col("_e")).otherwise(0.0)
    best = F.array_max(F.array(*[F.struct(F.round(r(k), 12).alias("r"), F.lit(-k).alias("k")) for k in range(low, high + 1)]))
    return a.where("_n >= 4").select(*keys, best.alias("b")).select(*keys, (-F.col("b.k")).alias("lag"), F.col("b.r").alias("periodicity"), (F.col("b.r") >= threshold).alias("periodic"))


def correlate(cells: DataFrame, keys: list[str], order: list[str], value: str, template: list[float]) -> DataFrame:
    """The matched filter: at each cell that a whole template follows, the sum of its products with the cells from there on."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = sum((F.lead(value, j).over(w) * float(t) for j, t in enumerate(template)), F.lit(0.0))
    return cells.withColumn("compressed", out).where(F.col("compressed").isNotNull())


def window_spectra(cells: DataFrame, keys: list[str], index: str, value: str, size: int, hop: int) -> DataFrame:
    """Magnitudes of Hann-tapered windows of ``size`` cells every ``hop`` cells of series of any length: ``window, bin, magnitude``.  Each
    cell goes to the windows that hold it, so no series is gathered; a series shorter than a window is one window, filled with zeros."""
    x = own_length(cells, keys)
    last = F.greatest(F.lit(0), F.floor((F.col("_length") - size) / hop))
    i = F.col(index)
    lo, hi = F.greatest(F.lit(0), F.ceil((i - size + 1) / hop)).cast("int"), F.least(F.floor(i / hop), last).cast("int")
    x = x.where(lo <= hi).withColumn("window", F.explode(F.sequence(lo, hi))).withColumn("_at", (i - F.col("window") * hop).cast("int")).withColumn("_zero", F.lit(0.0))
    s = spectrum(x, [*keys, "window"], "_at", value, "_zero", size, "hann").where(F.col("bin") <= size // 2)
    return s.select(*keys, "window", "bin", F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("magnitude"))


def spread_at_drop(spectra: DataFrame, keys: list[str], drop_db: float, width: float = 1.0) -> DataFrame:
    """Extent of the bins whose mean magnitude in decibels over all windows is within ``drop_db`` of the greatest."""
    m = spectra.groupBy(*keys, "bin").agg(F.avg(20 * F.log10(F.greatest("magnitude", F.lit(1e-12)))).alias("_db"))
    m = m.withColumn("_top", F.max("_db").over(Window.partitionBy(*keys)))
    return m.where(F.col("_db") >= F.col("_top") - drop_db).groupBy(*keys).agg(((F.max("bin") - F.min("bin")) * width).alias("spread"))


def interference(power: DataFrame, keys: list[str]) -> DataFrame:
    """Flatness of a power spectrum (geometric over arithmetic mean) and the share of power in its lowest quarter of bins."""
    low = F.when(F.col("bin") * 4 < F.col("_n"), F.col("power")).otherwise(0.0)
    p = power.withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    return p.groupBy(*keys).agg((F.exp(F.avg(F.log(F.greatest("power", F.lit(1e-12))))) / F.greatest(F.avg("power"), F.lit(1e-12))).alias("flatness"), (F.sum(low) / F.greatest(F.sum("power"), F.lit(1e-12))).alias("low_mass"), (F.max("power") / F.greatest(F.avg("power"), F.lit(1e-12))).alias("peak_to_mean"))


def k_alpha(cells: int, pfa: float, shape: float) -> float:
    """The factor on the mean of ``cells`` cells in K noise of a shape: that of exponential noise, stretched by the cube-root
    approximation; 0 for no cells or no shape."""
    return 0.0 if cells <= 0 or shape <= 0 else cell_average_alpha(cells, pfa) * (1 + 2 / (9 * shape)) ** 3


def log_normal_alpha(pfa: float, sigma: float) -> float:
    """How far above the median, in medians, log-normal noise of a log deviation stays but for the false-alarm rate; 0 for no deviation."""
    from statistics import NormalDist

    return 0.0 if sigma <= 0 else float(np.exp(-sigma * NormalDist().inv_cdf(pfa))) - 1


def k_tail(level: float, shape: float, points: int = 4000) -> float:
    """Share of K noise of mean 1 above a level: exponential noise whose mean is gamma distributed, by quadrature over the mean's logarithm."""
    from math import lgamma

    u = np.linspace(-60 / max(shape, 0.2), np.log(1 + 200 / shape), points)
    density = np.exp(shape * np.log(shape) - lgamma(shape) + shape * u - shape * np.exp(u))
    return float(np.trapezoid(density * np.exp(-level * np.exp(-u)), u))


def k_threshold(pfa: float, shape: float) -> float:
    """The level that K noise of mean 1 exceeds at a rate, by root search on ``k_tail``."""
    return _bisect(lambda a: k_tail(a, shape), pfa)


def alpha(kind: str, noise: str, cells: int, pfa: float, shape: float = 0.0, rank: int = 0) -> float:
    """The factor of a threshold kind (``ca``, ``go``, ``so``, ``os``) in a noise (``exponential``, ``weibull``, ``k``, ``log_normal``); an
    unknown pair is an error."""
    if noise == "exponential":
        return {"ca": cell_average_alpha, "go": greatest_of_alpha, "so": smallest_of_alpha}[kind](cells, pfa) if kind != "os" else order_statistic_alpha(cells, rank, pfa)
    if kind != "ca":
        raise ValueError(f"no factor of {kind} in {noise} noise")
    return {"weibull": lambda: weibull_alpha(cells, pfa, shape), "k": lambda: k_alpha(cells, pfa, shape), "log_normal": lambda: log_normal_alpha(pfa, shape)}[noise]()
