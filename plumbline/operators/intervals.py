"""Joins of intervals and of keys within tolerances, by bins instead of pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _level(start: Column, end: Column, base: float) -> Column:
    """The least power-of-two level whose bins are no shorter than the interval."""
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest((end - start) / base, F.lit(1e-9))))).cast("int")


def _bins(start: Column, end: Column, base: float, level: Column) -> Column:
    """Both bins, or the one, that an interval no longer than a bin touches."""
    width = base * F.pow(F.lit(2.0), level)
    return F.sequence(F.floor(start / width), F.floor(end / width))


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], start: str = "start", end: str = "end", base: float = 1.0) -> DataFrame:
    """Pairs of left and right intervals of equal keys that share a point, ends included; the right columns that are no keys get the
    prefix ``right_``.  Intervals of a null end, or that end before they start, meet none.

    An interval lives in the one or two bins that it touches at the level of its length, and looks into those of all longer levels
    that the other side has: so even an interval over all time is two rows, and a short one two per level.  A pair meets once at the
    level of its longer interval, in the bin of the later start."""
    r = right.select(*keys, *[F.col(c).alias(f"right_{c}") for c in right.columns if c not in keys])
    a0, a1, b0, b1 = F.col(start), F.col(end), F.col(f"right_{start}"), F.col(f"right_{end}")
    l = left.where(a0 <= a1).withColumn("_l", _level(a0, a1, base))
    r = r.where(b0 <= b1).withColumn("_r", _level(b0, b1, base))
    most = F.broadcast(l.agg(F.max("_l").alias("_ml")).crossJoin(r.agg(F.max("_r").alias("_mr"))))
    # left lives, right looks from its own level up; then right lives and left looks from above its own level
    home_l = l.withColumn("_at", F.col("_l"))
    look_r = r.crossJoin(most).where("_r <= _ml").withColumn("_at", F.explode(F.sequence("_r", "_ml"))).drop("_ml", "_mr")
    home_r = r.withColumn("_at", F.col("_r"))
    look_l = l.crossJoin(most).where("_l + 1 <= _mr").withColumn("_at", F.explode(F.sequence(F.col("_l") + 1, F.col("_mr")))).drop("_ml", "_mr")
    at_l = lambda x: x.withColumn("_bin", F.explode(_bins(a0, a1, base, F.col("_at"))))
    at_r = lambda x: x.withColumn("_bin", F.explode(_bins(b0, b1, base, F.col("_at"))))
    later = F.floor(F.greatest(a0, b0) / (base * F.pow(F.lit(2.0), F.col("_at"))))
    meet = lambda x, y: at_l(x).join(at_r(y), [*keys, "_at", "_bin"]).where((a0 <= b1) & (b0 <= a1) & (F.col("_bin") == later))
    return meet(home_l, look_r).unionByName(meet(look_l, home_r)).drop("_at", "_bin", "_l", "_r")


def tolerant_lookup(wanted: DataFrame, library: DataFrame, exact: list[str], near: dict[str, tuple[float, bool]], order: str, value: str, out: str) -> DataFrame:
    """``wanted`` with ``out``, the ``value`` of the first library row by ``order`` whose ``exact`` columns are equal (null to null) and whose
    ``near`` columns differ by no more than a tolerance, absolute or, if its flag is set, of the logarithm; null without one.

    Each near column is cut into cells of its tolerance and a wanted row looks into three of each, so it is one join on equal keys.
    Wanted rows are grouped by their keys first: rows that ask alike are one."""
    keys = [*exact, *near]
    scale = lambda c, log: F.log(c) if log else F.col(c)
    lib = library.select(*[F.col(c).alias(f"_{c}") for c in keys], F.col(order).alias("_o"), F.col(value).alias("_v"), *[F.floor(scale(c, log) / tol).alias(f"_cell_{c}") for c, (tol, log) in near.items()])
    asked = wanted.select(*keys).distinct()
    look = asked
    for c, (tol, log) in near.items():
        cell = F.floor(scale(c, log) / tol)
        look = look.withColumn(f"_cell_{c}", F.explode(F.array(cell - 1, cell, cell + 1)))
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in exact]
    cells = [f"_cell_{c}" for c in near]
    pairs = look.alias("w").join(lib.alias("l"), [*on, *[F.col(f"w.{c}") == F.col(f"l.{c}") for c in cells]])
    close = [F.abs(scale(c, log) - (F.log(F.col(f"_{c}")) if log else F.col(f"_{c}"))) <= tol for c, (tol, log) in near.items()]
    for cond in close:
        pairs = pairs.where(cond)
    best = pairs.groupBy(*keys).agg(F.min_by("_v", "_o").alias(out)).select(*[F.col(c).alias(f"_k_{c}") for c in keys], out)
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in keys]
    return wanted.join(best, same, "left").drop(*[f"_k_{c}" for c in keys])
