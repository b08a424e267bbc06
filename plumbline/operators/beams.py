"""Second moments of array channels, and the minimum-variance spectrum over look directions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def covariance(cells: DataFrame, keys: list[str], channel: str, snapshot: str, re: str, im: str) -> DataFrame:
    """``i, j, re, im, snapshots``: the mean of ``x_i * conj(x_j)`` over the snapshots that hold every channel of their key.

    A snapshot's channels meet in one row; of each pair only ``i <= j`` is summed, before the shuffle, and mirrored at the end.  Of
    channels that repeat in a snapshot the greatest value counts.  Keys without a whole snapshot are absent."""
    x = cells.where(F.col(re).isNotNull() & F.col(im).isNotNull()).groupBy(*keys, snapshot, channel).agg(F.max(F.struct(F.col(re).cast("double").alias("re"), F.col(im).cast("double").alias("im"))).alias("_x"))
    channels = x.groupBy(*keys).agg(F.count_distinct(channel).alias("_n"))
    rows = x.groupBy(*keys, snapshot).agg(F.sort_array(F.collect_list(F.struct(F.col(channel).alias("c"), "_x"))).alias("_v"))
    rows = rows.join(channels, keys).where(F.size("_v") == F.col("_n"))
    pairs = F.flatten(F.transform("_v", lambda a: F.transform(F.filter("_v", lambda b: a["c"] <= b["c"]), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    p = rows.select(*keys, F.explode(pairs).alias("_p")).select(*keys, F.col("_p.a.c").alias("i"), F.col("_p.b.c").alias("j"), F.col("_p.a._x").alias("_a"), F.col("_p.b._x").alias("_b"))
    real, imag = F.col("_a.re") * F.col("_b.re") + F.col("_a.im") * F.col("_b.im"), F.col("_a.im") * F.col("_b.re") - F.col("_a.re") * F.col("_b.im")
    up = p.groupBy(*keys, "i", "j").agg(F.avg(real).alias("re"), F.avg(imag).alias("im"), F.count("*").alias("snapshots"))
    both = F.when(F.col("i") < F.col("j"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    return up.withColumn("_m", F.explode(both)).select(*keys, F.when(F.col("_m"), F.col("j")).otherwise(F.col("i")).alias("i"), F.when(F.col("_m"), F.col("i")).otherwise(F.col("j")).alias("j"), "re", F.when(F.col("_m"), -F.col("im")).otherwise(F.col("im")).alias("im"), "snapshots")


def steering(channels: int, spacing: float, azimuth_deg: float) -> np.ndarray:
    """Phases of a line of channels, ``spacing`` wavelengths apart around its middle, for a direction from boresight."""
    at = np.arange(max(channels, 1)) - (max(channels, 1) - 1) / 2
    return np.exp(2j * np.pi * spacing * at * np.sin(np.radians(azimuth_deg)))


def loaded(r: np.ndarray, loading: float) -> np.ndarray:
    """A covariance with a share of its mean power, 1e-12 at least, added on the diagonal."""
    return r + np.eye(len(r)) * max(max(loading, 0.0) * np.trace(r).real / len(r), 1e-12)


def look_power(r: np.ndarray, looks: np.ndarray, loading: float) -> np.ndarray:
    """``1 / (a^H R^-1 a)`` of each row of ``looks``; 0 where the loaded covariance is not positive definite."""
    try:
        half = np.linalg.solve(np.linalg.cholesky(loaded(r, loading)), looks.T)
    except np.linalg.LinAlgError:
        return np.zeros(len(looks))
    return 1.0 / np.maximum((np.abs(half) ** 2).sum(0), 1e-30)


def minimum_variance(cov: DataFrame, keys: list[str], azimuths: list[float], spacing: float = 0.5, loading: float = 1e-2) -> DataFrame:
    """``azimuth, power`` of every key of ``covariance`` in every direction, channels in their order.  A key's task holds its one matrix."""
    types = dict(cov.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "azimuth double, power double"])

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        names = np.sort(part["i"].unique())
        r = np.zeros((len(names),) * 2, complex)
        r[np.searchsorted(names, part["i"]), np.searchsorted(names, part["j"])] = part["re"].to_numpy() + 1j * part["im"].to_numpy()
        power = look_power(r, np.array([steering(len(names), spacing, a) for a in azimuths]), loading)
        return pd.DataFrame({k: [part[k].iloc[0]] * len(azimuths) for k in keys} | {"azimuth": [float(a) for a in azimuths], "power": power})

    return cov.groupBy(*keys).applyInPandas(solve, schema)
