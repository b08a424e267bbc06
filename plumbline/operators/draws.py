"""Seeded generators whose draws are made in parallel and equal their serial sequences.

A counter-based 64-bit generator gives draw ``k`` from the seed and ``k``; a linear congruential one is jumped ahead by powers of its
map.  A serial swap shuffle becomes a forest over its swaps, resolved by pointer jumping.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import keep
from .prefix import quantiles, row_numbers

# The increment and the two multipliers of the 64-bit mixing generator, and the word its shuffle adds to a seed.
GAMMA, MIX_1, MIX_2, SHUFFLE_WORD = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x0053687566666C65
# Multiplier and increment of the congruential generator.
LCG_A, LCG_C = 6364136223846793005, 1442695040888963407

_WORD, _HALF, _QUARTER = (1 << 64) - 1, (1 << 32) - 1, (1 << 16) - 1


def _signed(x: int) -> int:
    return (x & _WORD) - (1 << 64) if x & (1 << 63) else x & _WORD


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once."""
    return F.transform(F.array(value), f)[0]


def add_64(a: Column, b: Column) -> Column:
    """Sum modulo 2^64 of two longs taken as bits."""
    low = a.bitwiseAND(F.lit(_HALF)) + b.bitwiseAND(F.lit(_HALF))
    return _let(low, lambda x: F.shiftleft(F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32) + F.shiftrightunsigned(x, 32), 32).bitwiseOR(x.bitwiseAND(F.lit(_HALF))))


def mul_64(a: Column, b: int) -> Column:
    """Product modulo 2^64 of a long taken as bits and a number, in parts of 32 and 16 bits that no long overflows."""
    b &= _WORD
    b_low, b_high = b & _HALF, b >> 32

    def low_part(x: Column, y: int) -> Column:
        """32 bits times 32 bits, modulo 2^32."""
        return (x * F.lit(y & _QUARTER) + F.shiftleft((x * F.lit(y >> 16)).bitwiseAND(F.lit(_QUARTER)), 16)).bitwiseAND(F.lit(_HALF))

    def product(x: Column) -> Column:
        low, high = x.bitwiseAND(F.lit(_HALF)), F.shiftrightunsigned(x, 32)
        upper = low * F.lit(b_low >> 16)
        first = low * F.lit(b_low & _QUARTER) + F.shiftleft(upper.bitwiseAND(F.lit(_QUARTER)), 16)
        carry = F.shiftrightunsigned(first, 32) + F.shiftrightunsigned(upper, 16)
        top = carry + low_part(low, b_high) + low_part(high, b_low)
        return F.shiftleft(top, 32).bitwiseOR(first.bitwiseAND(F.lit(_HALF)))

    return _let(a, product)


def mixed_64(z: Column) -> Column:
    """The finalizer of the counter-based generator."""
    z = _let(z, lambda x: x.bitwiseXOR(F.shiftrightunsigned(x, 30)))
    z = _let(mul_64(z, MIX_1), lambda x: x.bitwiseXOR(F.shiftrightunsigned(x, 27)))
    return _let(mul_64(z, MIX_2), lambda x: x.bitwiseXOR(F.shiftrightunsigned(x, 31)))


def child_seed(root: int, index: Column) -> Column:
    """The seed of record ``index`` under a root seed, as the bits of a long."""
    return mixed_64(mul_64(index.cast("long"), GAMMA).bitwiseXOR(F.lit(_signed(root))))


def draw_64(seed: int, k: Column) -> Column:
    """Draw ``k`` (from 1) of a seed, as the bits of a long."""
    return mixed_64(add_64(mul_64(k.cast("long"), GAMMA), F.lit(_signed(seed))))


def unsigned_mod(x: Column, n: Column) -> Column:
    """The remainder of a long taken as unsigned, for ``n`` below 2^62."""
    half = F.shiftrightunsigned(x, 1) % n
    return (half * 2 + x.bitwiseAND(F.lit(1))) % n


def serial_shuffle(rows: DataFrame, order: str, seed: int, out: str = "place", then: list[Column] | None = None) -> DataFrame:
    """``rows`` with the place (from 0) that the serial swap shuffle of the rows in ``order`` gives each.

    The serial form runs ``i`` from the last row to 1, draws ``j`` up to ``i`` and swaps.  What stands at ``i`` before its step came there
    in the last step before that drew ``i`` as target, from that step's own place: so each step points to one of a higher place, and
    what ends at ``i`` is found at the root of the step above it with the same target.  Chains are logarithmic in length and are
    resolved by doubling; only numbers move until the end."""
    numbered = keep(row_numbers(rows, [], order, "_from", then=then).withColumn("_from", F.col("_from") - 1))
    n = numbered.count()
    swap = F.when(F.col("i") == 0, F.lit(0)).otherwise(unsigned_mod(draw_64(seed ^ SHUFFLE_WORD, F.lit(n) - F.col("i")), F.col("i") + 1))
    steps = rows.sparkSession.range(n).select(F.col("id").alias("i")).withColumn("j", swap)
    by_target = Window.partitionBy("j").orderBy("i")
    steps = keep(steps.withColumn("above", F.lead("i").over(by_target)))
    came = steps.where("i > j").groupBy("j").agg(F.min("i").alias("up"))
    nodes = keep(steps.select("i").join(came.withColumnRenamed("j", "i"), "i", "left").select("i", F.coalesce("up", "i").alias("root")))
    while True:
        nxt = keep(nodes.join(nodes.select(F.col("i").alias("root"), F.col("root").alias("further")), "root").select("i", F.col("further").alias("root")))
        if nxt.join(nodes.withColumnRenamed("root", "old"), "i").where("root <> old").isEmpty():
            break
        nodes = nxt
    final = steps.join(nodes.withColumnRenamed("i", "above"), "above", "left").select(F.col("i").alias(out), F.coalesce("root", "j").alias("_from"))
    return numbered.join(final, "_from").drop("_from")


def lcg_jump(k: int) -> tuple[int, int]:
    """``(a, c)`` of ``k`` steps of the congruential generator as one: state -> a * state + c."""
    a, c, by_a, by_c = 1, 0, LCG_A, LCG_C
    while k:
        if k & 1:
            a, c = a * by_a & _WORD, (c * by_a + by_c) & _WORD
        by_a, by_c, k = by_a * by_a & _WORD, (by_a * by_c + by_c) & _WORD, k >> 1
    return a, c


def lcg_states(start: int, first: int, count: int) -> np.ndarray:
    """States ``first + 1 .. first + count`` after ``start``: blocks are doubled by one jump each."""
    a, c = lcg_jump(first + 1)
    out = np.array([(a * start + c) & _WORD], np.uint64)
    with np.errstate(over="ignore"):
        while len(out) < count:
            a, c = lcg_jump(len(out))
            out = np.concatenate([out, out[: count - len(out)] * np.uint64(a) + np.uint64(c)])
    return out


#: Draws that one row of work makes, and values up to which one task resamples a key.
BLOCK, WHOLE = 1 << 16, 1 << 22


def resampled(v: np.ndarray, state: int, rounds: int, low: float, high: float) -> tuple[float, float]:
    """Percentiles of the medians of ``rounds`` resamples of ``v``, drawn from the generator's states after ``state``."""
    n, medians = len(v), []
    for first in range(0, rounds, max(1, (1 << 20) // n)):
        some = min(max(1, (1 << 20) // n), rounds - first)
        drawn = v[(lcg_states(state & _WORD, first * n, some * n) % np.uint64(n)).astype(np.int64)].reshape(some, n)
        a, b = (n - 1) // 2, n // 2
        drawn.partition((a, b), axis=1)
        medians += [x if x == y else x + 0.5 * (y - x) for x, y in drawn[:, [a, b]].tolist()]
    medians = np.sort(medians).tolist()

    def at(p: float) -> float:
        i = p * (rounds - 1)
        x, y = medians[int(i)], medians[-int(-i // 1)]
        return x if x == y else x + (i - int(i)) * (y - x)

    return at(low), at(high)


def median_bootstrap(rows: DataFrame, key: str, order: list[str], value: str, rounds: int = 64, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """``key, n, median_low, median_high``: percentiles of the medians of ``rounds`` resamples of a key's values in ``order``, drawn by a congruential
    generator that starts from the SHA-256 of the values as text.  Fewer than three values give their median twice; null values are
    left out.  A null key has its number of values, and medians only of fewer than three.

    The hash streams over sorted rows, and the same pass resamples keys of up to ``WHOLE`` values.  Of larger ones the draws are made in
    blocks, each jumped ahead to, and travel as counts of value numbers."""
    kind, width = dict(rows.dtypes)[key], int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = rows.where(F.col(value).isNotNull()).select(F.col(key).alias("k"), *[F.col(o).alias(f"o{i}") for i, o in enumerate(order)], F.col(value).cast("double").alias("v"))
    sort = [F.col(f"o{i}").asc_nulls_last() for i in range(len(order))]
    key_type = rows.select(key).limit(0).toArrow().schema.field(0).type

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """In one pass over sorted rows the result of each key, or of a large one its values with their number, its count and first state."""
        at, n, h, held = None, 0, None, []  # held: the key's values so far, if it may be resampled here

        def closed() -> tuple:
            if at is None and n >= 3:
                return at, n, None, None, None, 0
            if held is None:
                return at, n, None, None, _start(h), 2
            v = np.concatenate(held)
            return at, n, *(resampled(v, _start(h), rounds, low, high) if n >= 3 else [float(v.mean())] * 2), None, 0

        for b in batches:
            ks, vs = b.column("k").to_pylist(), b.column("v").to_numpy(zero_copy_only=False)
            starts = [0, *(i for i in range(1, len(ks)) if ks[i] != ks[i - 1])] if ks else []
            done = []
            for i, j in zip(starts, [*starts[1:], len(ks)]):
                if h is None or ks[i] != at:
                    done += [closed()] if h is not None else []
                    at, n, h, held = ks[i], 0, hashlib.sha256(), []
                v = vs[i:j]
                h.update(("," * (n > 0) + ",".join(map("{:.9g}".format, v.tolist()))).encode())
                if held is not None:
                    held.append(v)
                if held is None or n + len(v) > max(WHOLE, 2):
                    first, v, held = (n, v, None) if held is None else (0, np.concatenate(held), None)
                    for lo in range(0, len(v), 10_000):
                        part = v[lo : lo + 10_000]
                        yield _numbered([at] * len(part), range(first + lo, first + lo + len(part)), part, [None] * len(part), [None] * len(part), [1] * len(part))
                n += j - i
            if done:
                yield _numbered(*zip(*done))
        if h is not None:
            yield _numbered(*zip(closed()))

    def _numbered(k: list, no: list, v: list, hi: list, state: list, part: list) -> pa.RecordBatch:
        types = (key_type, pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, t, from_pandas=False) for c, t in zip((k, no, v, hi, state, part), types)], ["k", "no", "v", "hi", "state", "part"])

    numbered = keep(x.repartition(width, "k").sortWithinPartitions("k", *sort).mapInArrow(number, f"k {kind}, no long, v double, hi double, state long, part int"))
    out = numbered.where("part = 0").select(F.col("k").alias(key), F.col("no").alias("n"), F.col("v").alias("median_low"), F.col("hi").alias("median_high"))
    starts = numbered.where("part = 2").select("k", F.col("no").alias("n"), "state")
    if starts.isEmpty():
        return out
    values = numbered.where("part = 1").select("k", "no", "v")

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, (n, state, block) in enumerate(zip(*(b.column(c).to_pylist() for c in ("n", "state", "block")))):
                first = block * BLOCK
                states = lcg_states(state & _WORD, first, min(BLOCK, n * rounds - first))
                drawn, count = np.unique((first + np.arange(len(states))) // n * n + (states % np.uint64(n)).astype(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([b.column("k")[i].as_py()] * len(drawn), key_type), pa.array((drawn // n).astype(np.int32)), pa.array(drawn % n), pa.array(count)], ["k", "round", "no", "c"])

    blocks = F.sequence(F.lit(0), F.floor((F.col("n") * rounds - 1) / BLOCK)).cast("array<long>")
    work = starts.withColumn("block", F.explode(blocks)).repartition(width, "k", "block")
    counts = work.select("k", "n", "state", "block").mapInArrow(draw, f"k {kind}, round int, no long, c long")
    drawn = counts.groupBy("k", "round", "no").agg(F.sum("c").alias("c")).join(values, ["k", "no"])
    medians = quantiles(drawn, ["k", "round"], "v", [0.5], weight="c").select("k", F.col("q")[0].alias("m"))
    many = medians.groupBy("k").agg(F.percentile("m", low).alias("lo"), F.percentile("m", high).alias("hi"))
    return out.unionByName(starts.select("k", "n").join(many, "k").select(F.col("k").alias(key), "n", F.col("lo").alias("median_low"), F.col("hi").alias("median_high")))


def _start(h: object) -> int:
    return _signed(int.from_bytes(h.digest()[:8], "big"))
