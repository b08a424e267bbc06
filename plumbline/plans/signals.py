"""Queries on array channels, spectra features and seeded draws."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import arrays as A
from ..operators import beams as B
from ..operators import draws as D
from ..sources import table
from .audits import _POWER, _series
from .fixtures import FRAMES, KEYS, ORDER, frames
from .ranking import _r

AZIMUTHS = [-30.0, 0.0, 20.0, 60.0]
FEATURES = ["fundamental_hz", "depth_db", "harmonic_ratio", "harmonic_share", "entropy_bits", "centroid_hz"]


def _channels(s, d, channel):
    """Lines of an order as channels of a snapshot, five beams by order key."""
    l = table(s, d, "lineitem")
    return l.select((F.col("l_orderkey") % 5).alias("beam"), channel.alias("channel"), F.col("l_orderkey").alias("snapshot"), F.col("l_quantity").cast("double").alias("re"), (F.col("l_discount") * 100).alias("im"))


def _covariance(s, d):
    return _r(B.covariance(_channels(s, d, F.col("l_linenumber")), ["beam"], "channel", "snapshot", "re", "im"), "re", "im", digits=6)


def _capon(s, d):
    cov = B.covariance(_channels(s, d, F.col("l_linenumber") % 2), ["beam"], "channel", "snapshot", "re", "im")
    return _r(B.minimum_variance(cov, ["beam"], AZIMUTHS), "power", digits=6)


def _modulation(s, d):
    f = frames(s, d).withColumn("i", F.row_number().over(A.Window.partitionBy(*KEYS).orderBy(*ORDER)) - 1).withColumn("im", (F.col("frame_id") % 7 * 10).cast("double"))
    return _r(A.modulation_features(f, KEYS, "i", "value", "im", 2.5), *FEATURES, digits=5)


QUERIES = {
    "channel_covariance": _covariance,
    "minimum_variance": _capon,
    "modulation_features": _modulation,
    "cepstrum": lambda s, d: _r(A.cepstrum(A.power_spectrum(_series(s, d), KEYS, "i", "value"), KEYS, "power", 12), "magnitude", digits=6),
    "child_seeds": lambda s, d: table(s, d, "orders").select("o_orderkey", F.lpad(F.lower(F.hex(D.child_seed(20260518, F.col("o_orderkey")))), 16, "0").alias("seed")),
    "seeded_shuffle": lambda s, d: D.serial_shuffle(table(s, d, "supplier").select("s_suppkey"), "s_suppkey", 7),
    "median_bootstrap": lambda s, d: _r(D.median_bootstrap(frames(s, d).select("record_id", *ORDER, "value"), "record_id", ORDER, "value"), "median_low", "median_high", digits=6),
}

_LINES = """m AS (SELECT beam, snapshot, c, max(struct_pack(re := re, im := im)) AS x FROM (SELECT l_orderkey % 5 AS beam, l_orderkey AS snapshot, {channel} AS c, CAST(l_quantity AS DOUBLE) AS re, l_discount * 100 AS im FROM lineitem) GROUP BY ALL),
every AS (SELECT beam, count(DISTINCT c) AS n FROM m GROUP BY 1),
whole AS (SELECT m.beam, snapshot FROM m JOIN every USING (beam) GROUP BY 1, 2 HAVING count(*) = max(n)),
v AS (SELECT beam, snapshot, c, x.re AS re, x.im AS im FROM m JOIN whole USING (beam, snapshot)),
r AS (SELECT a.beam, a.c AS i, b.c AS j, avg(a.re * b.re + a.im * b.im) AS re, avg(a.im * b.re - a.re * b.im) AS im, count(*) AS k FROM v a JOIN v b USING (beam, snapshot) GROUP BY ALL)"""
_MIX = "CAST((CAST(xor({x}, {x} >> {s}) AS UHUGEINT) * CAST({m} AS UHUGEINT)) % CAST(18446744073709551616 AS UHUGEINT) AS UBIGINT)"


def _mixed(name: str, source: str, x: str, columns: str) -> str:
    """The generator's finalizer as three relations."""
    return f"""{name}1 AS (SELECT {columns}, {_MIX.format(x=x, s=30, m=D.MIX_1)} AS z FROM {source}),
{name}2 AS (SELECT {columns}, {_MIX.format(x="z", s=27, m=D.MIX_2)} AS z FROM {name}1),
{name} AS (SELECT {columns}, xor(z, z >> 31) AS z FROM {name}2)"""


def _times_gamma(x: str) -> str:
    return f"CAST((CAST({x} AS UHUGEINT) * CAST({D.GAMMA} AS UHUGEINT)) % CAST(18446744073709551616 AS UHUGEINT) AS UBIGINT)"


ORACLE_SQL = {
    "channel_covariance": f"WITH {_LINES.format(channel='l_linenumber')} SELECT beam, i, j, round(re, 6) AS re, round(im, 6) + 0 AS im, k AS snapshots FROM r",
    "minimum_variance": f"""WITH {_LINES.format(channel="l_linenumber % 2")},
t AS (SELECT beam, max(re) FILTER (i = 0 AND j = 0) AS a, max(re) FILTER (i = 1 AND j = 1) AS b, max(re) FILTER (i = 0 AND j = 1) AS cr, max(im) FILTER (i = 0 AND j = 1) AS ci FROM r GROUP BY 1),
l AS (SELECT beam, a + greatest(0.01e0 * (a + b) / 2, 1e-12) AS a, b + greatest(0.01e0 * (a + b) / 2, 1e-12) AS b, cr, ci FROM t),
az AS (SELECT unnest({AZIMUTHS})::DOUBLE AS azimuth)
SELECT beam, azimuth, round((a * b - cr * cr - ci * ci) / (a + b - 2 * (cr * cos(pi() * sin(radians(azimuth))) - ci * sin(pi() * sin(radians(azimuth))))), 6) AS power FROM l CROSS JOIN az""",
    "modulation_features": f"""WITH {FRAMES}, s AS (SELECT record_id, row_number() OVER (PARTITION BY record_id ORDER BY time_s, frame_id) - 1 AS i, count(*) OVER (PARTITION BY record_id) AS n, sqrt(value * value + pow(frame_id % 7 * 10, 2)) AS m FROM frames),
x AS (SELECT *, m - avg(m) OVER (PARTITION BY record_id) AS x, greatest(16, CAST(pow(2, ceil(log2(n))) AS BIGINT)) AS n2 FROM s WHERE n >= 8),
p AS (SELECT record_id, b, max(n2) / max(n) * 2.5e0 AS hz, sqrt(pow(sum(x * cos(2 * pi() * (b * i % n2) / n2)), 2) + pow(sum(x * sin(2 * pi() * (b * i % n2) / n2)), 2)) AS v FROM (SELECT *, unnest(range(0, n2 // 2)) AS b FROM x) GROUP BY 1, 2),
f AS (SELECT record_id, arg_max(b, (v, -b)) FILTER (b > 0) AS f, max(v) FILTER (b > 0) AS top, max(v) AS peak, avg(v) AS mean, sum(v) AS total, sum(CASE WHEN v > 0 THEN v * log2(v) ELSE 0 END) AS vlog, sum(b * hz * v) AS moment, max(hz) AS hz FROM p GROUP BY 1),
h AS (SELECT record_id, max(v) FILTER (b = 2 * f) AS second, sum(v * v) FILTER (b % f = 0) / sum(v * v) AS share FROM p JOIN f USING (record_id) WHERE b > 0 GROUP BY 1)
SELECT r.record_id, round(f * hz, 5) AS fundamental_hz, round(10 * log10(peak / mean), 5) AS depth_db, round(least(coalesce(second / top, 0), 10), 5) AS harmonic_ratio, round(share, 5) AS harmonic_share,
  round(log2(total) - vlog / total, 5) AS entropy_bits, round(moment / total, 5) AS centroid_hz FROM (SELECT DISTINCT record_id FROM frames) r LEFT JOIN (f JOIN h USING (record_id)) ON r.record_id = f.record_id""",
    "cepstrum": _POWER + """, l AS (SELECT record_id, b, ln(greatest(p, 1e-6)) AS x, count(*) OVER (PARTITION BY record_id) AS m FROM p)
SELECT record_id, CAST(q AS INTEGER) AS quefrency, round(sqrt(pow(sum(x * cos(2 * pi() * (q * b % m) / m)), 2) + pow(sum(x * sin(2 * pi() * (q * b % m) / m)), 2)) / max(m), 6) AS magnitude FROM l CROSS JOIN range(12) t(q) WHERE q < m GROUP BY 1, 2""",
    "child_seeds": f"WITH k AS (SELECT o_orderkey, xor(CAST(20260518 AS UBIGINT), {_times_gamma('o_orderkey')}) AS z FROM orders), {_mixed('m', 'k', 'z', 'o_orderkey')} SELECT o_orderkey, lpad(lower(to_hex(z)), 16, '0') AS seed FROM m",
    "seeded_shuffle": f"""WITH RECURSIVE n AS (SELECT count(*) AS n, list(s_suppkey ORDER BY s_suppkey) AS items FROM supplier),
k AS (SELECT i, CAST((CAST(xor(CAST(7 AS UBIGINT), CAST({D.SHUFFLE_WORD} AS UBIGINT)) AS UHUGEINT) + CAST({_times_gamma('n - i')} AS UHUGEINT)) % CAST(18446744073709551616 AS UHUGEINT) AS UBIGINT) AS z FROM n, range(1, (SELECT n FROM n)) t(i)),
{_mixed('m', 'k', 'z', 'i')}, w AS (SELECT i, CAST(z % CAST(i + 1 AS UBIGINT) AS BIGINT) AS j FROM m),
steps(i, items) AS (SELECT n - 1, items FROM n UNION ALL
  SELECT steps.i - 1, list_transform(items, lambda x, p: CASE WHEN p = steps.i + 1 THEN items[w.j + 1] WHEN p = w.j + 1 THEN items[steps.i + 1] ELSE x END) FROM steps JOIN w ON w.i = steps.i)
SELECT unnest(items) AS s_suppkey, CAST(unnest(range(0, len(items))) AS BIGINT) AS place FROM steps WHERE i = 0""",
    "median_bootstrap": f"""WITH RECURSIVE {FRAMES}, g AS (SELECT record_id, list(value ORDER BY time_s, frame_id) AS v, count(*) AS n FROM frames WHERE value IS NOT NULL GROUP BY 1),
s AS (SELECT *, CAST('0x' || substr(sha256(array_to_string(list_transform(v, lambda x: format('{{:.9g}}', x)), ',')), 1, 16) AS UBIGINT) AS state FROM g),
steps(record_id, n, t, state) AS (SELECT record_id, n, CAST(0 AS BIGINT), state FROM s WHERE n >= 3 UNION ALL
  SELECT record_id, n, t + 1, CAST((CAST({D.LCG_A} AS UHUGEINT) * CAST(state AS UHUGEINT) + CAST({D.LCG_C} AS UHUGEINT)) % CAST(18446744073709551616 AS UHUGEINT) AS UBIGINT) FROM steps WHERE t < 64 * n),
m AS (SELECT record_id, (t - 1) // steps.n AS round, quantile_cont(v[CAST(state % CAST(steps.n AS UBIGINT) AS BIGINT) + 1], 0.5) AS m FROM steps JOIN g USING (record_id) WHERE t > 0 GROUP BY 1, 2)
SELECT g.record_id, n, round(CASE WHEN n >= 3 THEN lo ELSE list_avg(v) END, 6) AS median_low, round(CASE WHEN n >= 3 THEN hi ELSE list_avg(v) END, 6) AS median_high
FROM g LEFT JOIN (SELECT record_id, quantile_cont(m, 0.05) AS lo, quantile_cont(m, 0.95) AS hi FROM m GROUP BY 1) USING (record_id)""",
}
