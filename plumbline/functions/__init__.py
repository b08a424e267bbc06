"""Column expressions: scores, buckets, parsing, identity.  Each returns a Column and stays in generated code."""

from __future__ import annotations

import hashlib
import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")


# parsing and formatting -------------------------------------------------------------------------------------------------


def safe_float(c: Column, default: float = NAN) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(default))


def safe_int(c: Column, default: int = 0) -> Column:
    return F.coalesce(c.try_cast("bigint"), F.lit(default).cast("bigint"))


def finite(c: Column) -> Column:
    """The value, or null if it is not finite."""
    d = c.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < F.lit(float("inf"))), d)


def first_filled(*cols: Column, default: float = 0.0) -> Column:
    """The first alias that is not blank, as a double."""
    return F.coalesce(*[F.nullif(F.trim(c.cast("string")), F.lit("")).try_cast("double") for c in cols], F.lit(default))


def flag(c: Column) -> Column:
    """1.0 where the text is ``true`` in any case, else 0.0, also for null."""
    return F.when(F.lower(F.coalesce(c.cast("string"), F.lit(""))) == "true", 1.0).otherwise(0.0)


def metric_text(c: Column) -> Column:
    """Six decimals, or nothing for a value that is null or not finite."""
    d = finite(c)
    return F.when(d.isNotNull(), F.format_string("%.6f", d)).otherwise("")


def number_list(c: Column, kind: str = "bigint") -> Column:
    """``'1, 2,,x'`` as ``[1, 2]``: split at commas, trimmed, blanks and non-numbers dropped."""
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x).try_cast(kind)), lambda x: x.isNotNull())


def slug(c: Column, empty: str = "pipeline") -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(F.coalesce(s, F.lit("")) == "", F.lit(empty)).otherwise(s)


def humanised(c: Column) -> Column:
    """Words split at ``-`` and ``_``, first letters raised, the rest left."""
    words = F.filter(F.split(F.regexp_replace(c, "[-_]", " "), " "), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), " ")


def last_segments(c: Column, n: int = 2) -> Column:
    return F.substring_index(c, ".", -n)


def detection_id(c: Column) -> Column:
    """``record:model:frameN`` as a struct; null if it has another form."""
    p = r"^([^:]+):([^:]+):frame([0-9]+)$"
    return F.when(c.rlike(p), F.struct(F.regexp_extract(c, p, 1).alias("record_id"), F.regexp_extract(c, p, 2).alias("model_id"), F.regexp_extract(c, p, 3).try_cast("bigint").alias("frame_index")))


# scores -----------------------------------------------------------------------------------------------------------------


def sigmoid(x: Column) -> Column:
    """Stable on both signs."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def sigmoid_clipped(x: Column, most: float = 40.0) -> Column:
    return 1 / (1 + F.exp(-clamp(x, -most, most)))


def clamp(x: Column, low: float | None = None, high: float | None = None) -> Column:
    x = x if low is None else F.greatest(x, F.lit(low))
    return x if high is None else F.least(x, F.lit(high))


def linear_score(weights: dict[str, Column], values: dict[str, float], bias: float) -> Column:
    """Logistic of a weighted sum; ``weights`` maps names to columns, ``values`` names to their weights."""
    z = F.lit(bias)
    for name, w in values.items():
        z = z + F.coalesce(weights[name].try_cast("double"), F.lit(0.0)) * w
    return sigmoid(z)


def available_mean(columns: list[str], weights: dict[str, float]) -> Column:
    """Weighted mean over the columns that exist, weights renormalised."""
    have = {k: w for k, w in weights.items() if k in columns}
    total = sum(have.values()) or 1.0
    out = F.lit(0.0)
    for k, w in have.items():
        out = out + F.coalesce(F.col(k).cast("double"), F.lit(0.0)) * (w / total)
    return out


def decision(score: Column, low: float = 0.40, high: float = 0.60) -> Column:
    return F.when(score.between(low, high), "abstain").when(score > high, "accept").otherwise("reject")


def in_range(x: Column, low: float, high: float, hit: float, miss: float) -> Column:
    return F.when(x.between(low, high), hit).otherwise(miss)


def decibel(x: Column, floor: float = 1e-12) -> Column:
    return 10 * F.log10(F.greatest(x, F.lit(floor)))


def from_decibel(x: Column) -> Column:
    return F.pow(F.lit(10.0), x / 10)


def sigma_confidence(s: Column) -> Column:
    return 1 / (1 + F.pow(s / 3, 2))


def root_sum_square(*terms: Column, low: float = 0.1, high: float = 3.0) -> Column:
    return clamp(F.sqrt(sum((t * t for t in terms), F.lit(0.0))), low, high)


def linearised_sigma(jacobian: Column, sigmas: Column) -> Column:
    """Root of the sum of squared products of two arrays."""
    return F.sqrt(F.aggregate(F.zip_with(jacobian, sigmas, lambda j, s: F.pow(j * s, 2)), F.lit(0.0), lambda a, x: a + x))


def wilson(successes: Column, trials: Column, z: float = 1.959963984540054) -> Column:
    """The 95 % interval of a rate as ``(low, high)``; (0, 1) without trials."""
    n, p = trials.cast("double"), successes / F.nullif(trials.cast("double"), F.lit(0.0))
    mid, half, den = p + z * z / (2 * n), z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n), 1 + z * z / n
    return F.when(trials > 0, F.struct(F.greatest(F.lit(0.0), (mid - half) / den).alias("low"), F.least(F.lit(1.0), (mid + half) / den).alias("high"))).otherwise(F.struct(F.lit(0.0).alias("low"), F.lit(1.0).alias("high")))


def gaussian_log_density(x: Column, mean: Column | float, sigma: Column | float) -> Column:
    s = sigma if isinstance(sigma, Column) else F.lit(sigma)
    m = mean if isinstance(mean, Column) else F.lit(mean)
    return -0.5 * F.pow((x - m) / s, 2) - F.log(s) - 0.5 * math.log(2 * math.pi)


# buckets ----------------------------------------------------------------------------------------------------------------


# The cuts of phases (seconds) and of ranges (metres).
PHASE_CUTS, RANGE_CUTS = (8.0, 18.0, 72.0), (2500.0, 6000.0, 11000.0)


def phase_of(time_s: Column, positive: Column, cuts: tuple[float, ...] = PHASE_CUTS, names: tuple[str, ...] = ("boost", "climb", "cruise", "terminal"), other: str = "background") -> Column:
    """Half-open time buckets of positives; one constant for the rest."""
    out = F.lit(names[-1])
    for cut, name in reversed(list(zip(cuts, names))):
        out = F.when(time_s < cut, name).otherwise(out)
    return F.when(positive, out).otherwise(other)


def range_band(x: Column, cuts: tuple[float, ...] = RANGE_CUTS, names: tuple[str, ...] = ("near", "mid", "far", "edge")) -> Column:
    out = F.lit(names[-1])
    for cut, name in reversed(list(zip(cuts, names))):
        out = F.when(x < cut, name).otherwise(out)
    return out


def speed_class(v: Column, bands: dict[str, tuple[float, float]], unknown: str = "ambiguous") -> Column:
    """The first band that holds the speed; null if it is negative or not finite."""
    out = F.lit(unknown)
    for name, (low, high) in reversed(bands.items()):
        out = F.when(v.between(low, high), name).otherwise(out)
    return F.when(finite(v).isNotNull() & (v >= 0), out)


def modality(name: Column, prefixes: dict[str, str], other: str = "mixed") -> Column:
    out = F.lit(other)
    for prefix, label in reversed(prefixes.items()):
        out = F.when(name.startswith(prefix), label).otherwise(out)
    return out


def fidelity_rank(tier: Column) -> Column:
    """``F0`` to ``F5`` as 0 to 5, null for anything else."""
    return F.nullif(F.regexp_extract(F.coalesce(tier, F.lit("")), "^F([0-5])$", 1), F.lit("")).cast("int")


def kinematic_gate(speed: Column, altitude: Column, accel: Column, ranges: dict[str, tuple[float, float]]) -> Column:
    """All of speed, altitude and acceleration in their closed ranges; missing speed or altitude rejects, missing acceleration
    passes only if its range begins at or below 0."""
    inside = lambda c, k: F.coalesce(F.abs(c).between(*ranges[k]), F.lit(False))
    return inside(speed, "speed") & inside(altitude, "altitude") & F.when(accel.isNull(), F.lit(ranges["accel"][0] <= 0)).otherwise(inside(accel, "accel"))


def bound_distance(x: Column, low: Column, high: Column) -> Column:
    return F.when(x.between(low, high), 0.0).otherwise(F.least(F.abs(x - low), F.abs(x - high)))


# Acceleration bands of the boost sub-states, in the order in which they are tried.
BOOST_STATES = (("boost_burn", 10.0, 30.0, True), ("sustain", 0.0, 1.0, False), ("separation", -2.0, 5.0, False))
# Fixed values of ducts: trapping gradient, least effective-Earth factor, humidity range, depth of a surface duct at two gradients.
DUCT_GRADIENT, DUCT_FACTOR, DUCT_HUMIDITY, DUCT_DEPTH = -157.0, 2.0, (0.7, 0.95), ((-157.0, 25.0), (-400.0, 100.0))


def boost_state(accel: Column) -> Column:
    """The first band that holds the acceleration; sustain outside all."""
    out = F.lit("sustain")
    for name, low, high, closed in reversed(BOOST_STATES):
        out = F.when((accel >= low) & ((accel <= high) if closed else (accel < high)), name).otherwise(out)
    return out


def duct_regime(gradient: Column, factor: Column, humidity: Column) -> Column:
    """``(regime, height_m)``: a surface duct where the gradient traps, else an evaporation duct in its humidity range, else none."""
    (g0, h0), (g1, h1) = DUCT_DEPTH
    depth = h0 + (g0 - clamp(gradient, g1, g0)) / (g0 - g1) * (h1 - h0)
    low, high = DUCT_HUMIDITY
    height = clamp(5.0 + 35.0 * (0.85 - clamp(humidity, low, high)), 5.0, 40.0)
    pick = lambda name, h: F.struct(F.lit(name).alias("regime"), h.cast("double").alias("height_m"))
    return F.when((gradient < DUCT_GRADIENT) & (factor > DUCT_FACTOR), pick("surface", depth)).when((humidity > low) & (humidity < high), pick("evaporation", height)).otherwise(pick("none", F.lit(None)))


def blended(a: Column, b: Column, share: float = 0.55) -> Column:
    return share * a + (1 - share) * b


def derived_features(cfar: Column, threshold: Column, snr: Column, noise: Column, tbd: Column, energies: tuple[Column, Column, Column]) -> dict[str, Column]:
    """Margin, signal over noise, evidence (margin, not below 0, plus track score) and the share of the joint energy."""
    joint, first, second = energies
    return {"cfar_margin": cfar - threshold, "snr_minus_noise": snr - noise, "track_evidence": F.greatest(cfar - threshold, F.lit(0.0)) + tbd, "energy_ratio": joint / (1.0 + first + second)}


def valid_probability(c: Column) -> Column:
    return F.coalesce(c.between(0.0, 1.0) & ~F.isnan(c), F.lit(False))


def valid_slug(c: Column) -> Column:
    return F.coalesce(c.rlike("^[a-z0-9]+(-[a-z0-9]+)*$"), F.lit(False))


def filled(c: Column) -> Column:
    return F.coalesce(F.trim(c) != "", F.lit(False))


def glob_regex(pattern: str) -> str:
    """A path pattern as an anchored regular expression: ``*`` and ``?`` stay within a folder, ``**`` does not."""
    import re

    part = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "^" + "".join(part.get(x) or re.escape(x) for x in re.findall(r"\*\*/|\*\*|\*|\?|[^*?]+", pattern)) + "$"


# identity ---------------------------------------------------------------------------------------------------------------


def fnv1a_mod(text: Column, modulus: int = 10_000) -> Column:
    """FNV-1a 64 of the UTF-8 bytes, modulo ``modulus`` (below 2^21).  The state is held in two halves of 32 bits, so that no
    product overflows; the prime is 2^40 + 435."""
    codes = F.transform(F.filter(F.split(F.hex(F.encode(text, "UTF-8")), "(?<=\\G..)"), lambda h: h != ""), lambda h: F.conv(h, 16, 10).cast("bigint"))
    start = F.struct(F.lit(0xCBF29CE4).cast("bigint").alias("hi"), F.lit(0x84222325).cast("bigint").alias("lo"))
    low32 = F.lit(0xFFFFFFFF).cast("bigint")

    def step(s: Column, byte: Column) -> Column:
        x = s["lo"].bitwiseXOR(byte)
        t = x * 435
        hi = (s["hi"] * 435 + F.shiftrightunsigned(t, 32) + F.shiftleft(x, 8)).bitwiseAND(low32)
        return F.struct(hi.alias("hi"), t.bitwiseAND(low32).alias("lo"))

    return F.aggregate(codes, start, step, lambda s: F.pmod(s["hi"] * ((1 << 32) % modulus) + s["lo"], F.lit(modulus)))


def protected_key(keys: list[str]) -> Column:
    """``k=v|k=v`` over the keys that are present."""
    return F.concat_ws("|", *[F.concat(F.lit(f"{k}="), F.col(k).cast("string")) for k in keys])


def split_by_bps(bucket: Column, train: int = 7000, validation: int = 1500) -> Column:
    return F.when(bucket < train, "train").when(bucket < train + validation, "validation").otherwise("test")


def sha_bucket(text: Column, buckets: int = 10) -> Column:
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("bigint") % buckets


def sha_split(text: Column) -> Column:
    b = sha_bucket(text)
    return F.when(b < 6, "train").when(b < 8, "validation").otherwise("test")


def sample_id(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 24)


def stable_order(seed: int, tag: str, *cols: Column) -> Column:
    """A key that puts rows in an order fixed by seed and tag."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(tag), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]))


def u64_mod(c: Column, modulus: int) -> Column:
    """Modulo of an unsigned 64-bit number given as text or decimal."""
    return (c.cast("decimal(20,0)") % F.lit(modulus).cast("decimal(20,0)")).cast("bigint")


def canonical_json(fields: dict[str, Column]) -> Column:
    """A JSON object with its keys in order, without blanks; null fields are left out."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


def map_json(c: Column) -> Column:
    """A map as a JSON object with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(c))))


def fingerprint(json: Column) -> Column:
    return F.sha2(json, 256)


def deterministic_id(kind: str, proxy: Column, json: Column, version: int = 1, prefix: str = "id") -> Column:
    """``prefix:kind:proxy:hash:version`` with 16 digits of a hash of kind, proxy, version and fingerprint."""
    digest = F.sha2(F.concat_ws("|", F.lit(kind), proxy, F.lit(str(version)), fingerprint(json)), 256)
    return F.concat_ws(":", F.lit(prefix), F.lit(kind), proxy, F.substring(digest, 1, 16), F.lit(str(version)))


def stable_seed(*parts: Column) -> Column:
    """63 bits of the 8-byte BLAKE2b of ``a|b|..``; Spark has no such hash, so batches of texts go through Arrow."""
    @F.pandas_udf("long")
    def seed(text: pd.Series) -> pd.Series:
        return text.map(lambda t: int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "big") & ((1 << 63) - 1))

    return seed(F.concat_ws("|", *[p.cast("string") for p in parts]))
