"""Queries on frame sequences, cells, distances, neighbours and tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import arrays as A
from ..operators import frames as W
from ..operators import grouping as G
from ..operators import joining as J
from ..operators import statistics as S
from ..operators import tracking as T
from ..sources import table
from .fixtures import FRAMES, GRID, KEYS, ORDER, frames, grid
from .ranking import _r


def _hit():
    return F.col("value") > 50


def _side():
    return F.col("record_id") % 2 == 0


def _lifecycle(s, d):
    f = frames(s, d)
    t = W.learned_threshold(f, "phase_id", "value", F.col("split_role") == "train")
    x = f.join(t, "phase_id")
    return W.lifecycle(x, ["record_id", "phase_id", "label_id"], ORDER, "time_s", "value", "threshold")


def _cfar(kind):
    def q(s, d):
        c = A.cfar(frames(s, d), KEYS, ORDER, "value", train=4, guard=1, pfa=0.2, kind=kind)
        return _r(c.where("evaluated").select("frame_id", "threshold", "detected"), "threshold", digits=6)

    return q


def _nearest(s, d):
    e = table(s, d, "embeddings").select("vec_id", "embedding")
    return _r(J.nearest_train(e, F.col("vec_id") % 5 == 0, "vec_id", "embedding"), "distance", digits=6)


def _points(s, d):
    return frames(s, d).select("frame_id", "phase_id", "event_type", "value")


def _tolerance(s, d):
    p = _points(s, d)
    right = table(s, d, "supplier").select((F.col("s_suppkey") * 7.5).alias("value"), F.concat(F.lit("s"), "s_suppkey").alias("entity"))
    return _r(J.nearest_within(p.select("frame_id", "value"), right, "frame_id", "value", "entity", 2.0, "unresolved"), "value", "distance").select("frame_id", "matched", "distance")


def _semi(s, d):
    p = _points(s, d)
    return J.range_semi(p.where("event_type = 'click'").select("frame_id", "phase_id", "value"), p.where("event_type = 'purchase'").select("phase_id", "value"), ["phase_id"], "value", floor=0.5, share=0.01, width=1.0)


def _bright(s, d):
    g = grid(s, d)
    return g.crossJoin(F.broadcast(g.agg(F.avg("v").alias("m")))).select("g", "x", "y", (F.col("v") / F.col("m")).alias("v"))


def _fused(s, d):
    p = _points(s, d).withColumn("cell", F.floor("value").cast("long"))
    parts = [p.where(F.col("event_type") == k).select("phase_id", "cell", F.lit(k).alias("kind"), F.col("value").alias("magnitude"), F.col("frame_id").alias("ord")) for k in ("click", "view", "purchase")]
    return T.fuse_detections(parts, ["phase_id", "cell"])


def _bearing(s, d):
    p = frames(s, d).select("frame_id", F.pmod(F.col("value") * 7, F.lit(360.0)).alias("az"), F.pmod(F.col("value") * 7 + F.col("frame_id") % 40, F.lit(360.0)).alias("b"))
    f = T.fuse_bearing(F.col("az"), F.lit(2.0), F.col("b"), F.lit(5.0))
    c = T.fuse_confidence(F.lit(0.6), F.lit(0.7), f["agreement"], F.lit(3.0))
    return _r(p.select("frame_id", f["azimuth"].alias("azimuth"), f["sigma"].alias("sigma"), f["agreement"].alias("agreement"), c.alias("confidence")), "azimuth", "sigma", "agreement", "confidence", digits=6)


def _tiers(s, d):
    f = frames(s, d).select("record_id", F.row_number().over(W._w(KEYS, ORDER)).cast("double").alias("t"), F.pmod(F.col("value"), F.lit(160.0)).alias("speed"), F.pmod(F.col("value") * 3, F.lit(90.0)).alias("altitude"))
    return T.assign_tiers(f, "record_id", "t", "speed", "altitude")


def _tracks(s, d):
    f = frames(s, d).select("record_id", F.floor(F.col("time_s") / 86400).cast("long").alias("frame"), (F.col("value") * 20).alias("range_m"), F.col("value").alias("velocity_mps"), (F.col("value") / 10).alias("snr_db"), F.lit(0.5).alias("confidence"), F.col("frame_id").alias("ord"))
    return T.associate(f, "record_id", "frame", "ord")


def _classes(s, d):
    e = table(s, d, "events").groupBy("user_id").agg(F.avg("value").alias("mean"), F.coalesce(F.stddev_pop("value"), F.lit(0.0)).alias("spread"))
    lib = {"low": {"mean": (30.0, 20.0), "spread": (20.0, 15.0)}, "mid": {"mean": (60.0, 20.0), "spread": (40.0, 15.0)}, "high": {"mean": (120.0, 50.0), "spread": (80.0, 40.0)}}
    return _r(S.class_log_likelihoods(e, "user_id", lib), "posterior", "log_likelihood", digits=6)


QUERIES = {
    "frame_feature_bank": lambda s, d: (lambda x: _r(x, *[c for c in x.columns if c != "record_id"], digits=6))(G.feature_bank(frames(s, d), KEYS, ["value"], "time_s")),
    "run_summary": lambda s, d: _r(W.run_summary(frames(s, d), KEYS, ORDER, _hit(), "time_s"), "first_true", digits=6),
    "two_consecutive_trigger": lambda s, d: W.first_trigger(frames(s, d).select("record_id", "frame_id", "time_s", "value"), KEYS, ORDER, _hit()).select("record_id", "frame_id", F.round("value", 6).alias("value")),
    "rolling16_blend": lambda s, d: _r(W.rolling_blend(frames(s, d).withColumn("x", F.least(F.col("value") / 100, F.lit(1.0))), KEYS, ORDER, "x").select("frame_id", "blend"), "blend", digits=12),
    "saturating_persistence": lambda s, d: W.persistence(frames(s, d), KEYS, ORDER, _hit()).select("frame_id", "persistence"),
    "m_of_n_gate": lambda s, d: W.m_of_n(frames(s, d), KEYS, ORDER, _hit()).select("frame_id", "m_of_n"),
    "finite_difference": lambda s, d: _r(W.finite_difference(frames(s, d), KEYS, ORDER, "value", "time_s").select("frame_id", "rate"), "rate", digits=6),
    "pulse_canceller": lambda s, d: _r(W.pulse_canceller(frames(s, d), KEYS, ORDER, "value", 3).select("frame_id", "cancelled"), "cancelled", digits=6),
    "track_gap_fraction": lambda s, d: _r(W.gap_fraction(frames(s, d), KEYS, ORDER, "time_s"), "gap_fraction"),
    "sliding_windows_half_overlap": lambda s, d: W.sliding_windows(frames(s, d), KEYS, ORDER, "frame_id", 8).select("record_id", "window", F.array_join(F.transform("values", lambda v: v.cast("string")), ",").alias("values")),
    "track_lifecycle": lambda s, d: _r(_r(_lifecycle(s, d), "max_score", "mean_score", "confidence", digits=9), "first_hit", "track_init", digits=6),
    "phase_metrics": lambda s, d: _r(W.phase_rates(_lifecycle(s, d), "phase_id"), "pd", "pfa", "mean_first_hit", "mean_fragments", digits=5),
    "ca_cfar": _cfar("ca"),
    "go_cfar": _cfar("go"),
    "so_cfar": _cfar("so"),
    "os_cfar": _cfar("os"),
    "local_peaks": lambda s, d: A.local_peaks(grid(s, d), ["g"], "x", "y", "v", 20.0),
    "connected_components": lambda s, d: _r(A.blobs(_bright(s, d), ["g"], "x", "y", "v", 1.3), "cx", "cy", "peak", digits=6),
    "hough_tracks": lambda s, d: A.hough_tracks(grid(s, d), ["g"], "x", "y", "v", [-1.0, -0.5, 0.0, 0.5, 1.0], 40.0, 3),
    "pooled_bytes": lambda s, d: A.pooled_bytes(grid(s, d), ["g"], "x", "v", 8, 40),
    "fused_dedupe": _fused,
    "bearing_fusion": _bearing,
    "nearest_neighbour_l2": _nearest,
    "nearest_with_tolerance": _tolerance,
    "range_semijoin": _semi,
    "wasserstein_ecdf": lambda s, d: _r(S.wasserstein(frames(s, d), ["event_type"], _side(), "value"), "w1", digits=6),
    "wasserstein_quantile": lambda s, d: _r(S.wasserstein_grid(frames(s, d), ["event_type"], _side(), "value"), "w1_grid", digits=6),
    "ks_distance": lambda s, d: _r(S.kolmogorov_smirnov(frames(s, d), ["event_type"], _side(), "value"), "ks"),
    "overlap_coefficient": lambda s, d: _r(S.overlap_coefficient(frames(s, d), ["event_type"], _side(), "value"), "overlap"),
    "robust_peak": lambda s, d: _r(S.robust_peak(frames(s, d), KEYS, "value"), "peak_score", digits=4),
    "circular_mean": lambda s, d: frames(s, d).groupBy("event_type").agg(F.round(G.circular_mean(F.col("value") * 3.6), 5).alias("bearing")),
    "class_likelihoods": _classes,
    "tier_arbiter": _tiers,
    "track_association": _tracks,
}

_W = "WINDOW w AS (PARTITION BY record_id ORDER BY time_s, frame_id)"
_RUNS = f"""WITH {FRAMES}, r0 AS (SELECT *, value > 50 AS flag FROM frames),
r1 AS (SELECT *, flag AND NOT coalesce(lag(flag) OVER w, false) AS rise, sum(CASE WHEN flag THEN 0 ELSE 1 END) OVER w AS off FROM r0 {_W}),
r AS (SELECT *, CASE WHEN flag THEN row_number() OVER (PARTITION BY record_id, off, flag ORDER BY time_s, frame_id) ELSE 0 END AS streak FROM r1)
"""
_LIFE = f"""WITH {FRAMES}, th AS (SELECT phase_id, coalesce(quantile_cont(value, 0.64) FILTER (split_role = 'train'), 0) AS threshold FROM frames GROUP BY 1),
l0 AS (SELECT f.*, threshold, value >= threshold AS flag FROM frames f JOIN th USING (phase_id)),
l1 AS (SELECT *, flag AND NOT coalesce(lag(flag) OVER w, false) AS rise, sum(CASE WHEN flag THEN 0 ELSE 1 END) OVER w AS off FROM l0 {_W}),
l2 AS (SELECT *, CASE WHEN flag THEN row_number() OVER (PARTITION BY record_id, off, flag ORDER BY time_s, frame_id) ELSE 0 END AS streak FROM l1),
life AS (SELECT record_id, phase_id, label_id, min(time_s) FILTER (flag) AS first_hit, min(time_s) FILTER (streak = 2) AS track_init, count(*) FILTER (rise) AS fragments, count(*) FILTER (flag) AS hits, count(*) AS frames, max(value) AS max_score, avg(value) AS mean_score,
  1 / (1 + exp(-avg(value - threshold))) AS confidence, CASE WHEN count(*) FILTER (flag) = 0 THEN 'never_started' WHEN arg_max(flag, (time_s, frame_id)) THEN 'active_at_end' ELSE 'missed_at_end' END AS "end" FROM l2 GROUP BY 1, 2, 3)
"""


def _cfar_sql(kind: str) -> str:
    alpha = A.order_statistic_alpha(8, 6, 0.2) if kind == "os" else A.cell_average_alpha(4, 0.2)
    noise = {"ca": "(a + b) / 2", "go": "greatest(a, b)", "so": "least(a, b)", "os": "list_sort(list_concat(la, lb))[6]"}[kind]
    return f"""WITH {FRAMES}, c AS (SELECT *, avg(value) OVER l AS a, avg(value) OVER r AS b, list(value) OVER l AS la, list(value) OVER r AS lb, count(*) OVER l AS na, count(*) OVER r AS nb FROM frames
  WINDOW l AS (PARTITION BY record_id ORDER BY time_s, frame_id ROWS BETWEEN 5 PRECEDING AND 2 PRECEDING), r AS (PARTITION BY record_id ORDER BY time_s, frame_id ROWS BETWEEN 2 FOLLOWING AND 5 FOLLOWING)),
t AS (SELECT frame_id, value, CAST({alpha!r} AS DOUBLE) * ({noise}) AS th FROM c WHERE na = 4 AND nb = 4) SELECT frame_id, round(th, 6) AS threshold, value > th AS detected FROM t"""


_ECDF = f"""WITH {FRAMES}, v AS (SELECT event_type, value, count(*) FILTER (record_id % 2 = 0) AS a, count(*) FILTER (record_id % 2 <> 0) AS b FROM frames WHERE value IS NOT NULL GROUP BY 1, 2),
e AS (SELECT *, sum(a) OVER w / sum(a) OVER (PARTITION BY event_type) AS fa, sum(b) OVER w / sum(b) OVER (PARTITION BY event_type) AS fb, lead(value) OVER w AS nxt FROM v WINDOW w AS (PARTITION BY event_type ORDER BY value))
"""

ORACLE_SQL = {
    "frame_feature_bank": f"WITH {FRAMES} SELECT record_id, round(avg(value), 6) AS value_mean, round(stddev_pop(value), 6) AS value_std, round(min(value), 6) AS value_min, round(max(value), 6) AS value_max, round(arg_max(value, time_s), 6) AS value_last, round(quantile_cont(value, 0.25), 6) AS value_q25, round(quantile_cont(value, 0.75), 6) AS value_q75, round(arg_max(value, time_s) - arg_min(value, time_s), 6) AS value_trend FROM frames GROUP BY 1",
    "run_summary": _RUNS + "SELECT record_id, round(min(time_s) FILTER (flag), 6) AS first_true, CAST(max(streak) AS INTEGER) AS longest_run, count(*) FILTER (rise) AS fragments FROM r GROUP BY 1",
    "two_consecutive_trigger": _RUNS + "SELECT record_id, arg_min(frame_id, (time_s, frame_id)) AS frame_id, round(arg_min(value, (time_s, frame_id)), 6) AS value FROM r WHERE streak = 2 GROUP BY 1",
    "rolling16_blend": f"WITH {FRAMES}, x AS (SELECT *, least(value / 100, 1) AS x FROM frames) SELECT frame_id, round(least(greatest(CAST(0.25 AS DOUBLE) * x + CAST(0.75 AS DOUBLE) * avg(x) OVER (PARTITION BY record_id ORDER BY time_s, frame_id ROWS BETWEEN 15 PRECEDING AND CURRENT ROW), 0), 1), 12) AS blend FROM x",
    "saturating_persistence": f"WITH {FRAMES}, s AS (SELECT *, sum(CASE WHEN value > 50 THEN 1 ELSE -1 END) OVER w AS s FROM frames {_W}) SELECT frame_id, CAST(s - least(0, min(s) OVER w) AS BIGINT) AS persistence FROM s {_W}",
    "m_of_n_gate": f"WITH {FRAMES} SELECT frame_id, sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY record_id ORDER BY time_s, frame_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) >= 3 AS m_of_n FROM frames",
    "finite_difference": f"WITH {FRAMES} SELECT frame_id, round(CASE WHEN time_s - lag(time_s) OVER w > 0 THEN (value - lag(value) OVER w) / (time_s - lag(time_s) OVER w) END, 6) + 0 AS rate FROM frames {_W}",
    "pulse_canceller": f"WITH {FRAMES} SELECT frame_id, round(coalesce(value - 2 * lag(value) OVER w + lag(value, 2) OVER w, 0), 6) AS cancelled FROM frames {_W}",
    "track_gap_fraction": f"WITH {FRAMES}, d AS (SELECT record_id, time_s - lag(time_s) OVER w AS d FROM frames {_W}), m AS (SELECT record_id, quantile_cont(d, 0.5) AS m, count(d) AS n FROM d GROUP BY 1) SELECT record_id, round(CASE WHEN max(n) >= 2 THEN avg(CASE WHEN d > CAST(2.5 AS DOUBLE) * m THEN 1.0 ELSE 0.0 END) FILTER (d IS NOT NULL) ELSE 0 END, 9) AS gap_fraction FROM d JOIN m USING (record_id) GROUP BY 1",
    "sliding_windows_half_overlap": f"WITH {FRAMES}, l AS (SELECT record_id, list(frame_id ORDER BY time_s, frame_id) AS v FROM frames GROUP BY 1), w AS (SELECT *, unnest(range(0, CAST(greatest(0, floor((len(v) - 8) / 4)) AS BIGINT) + 1)) AS win FROM l) SELECT record_id, CAST(win AS INTEGER) AS \"window\", array_to_string(list_concat(v[win * 4 + 1:win * 4 + 8], list_transform(range(0, greatest(0, 8 - len(v))), lambda i: v[len(v)])), ',') AS \"values\" FROM w",
    "track_lifecycle": _LIFE + 'SELECT record_id, phase_id, label_id, round(first_hit, 6) AS first_hit, round(track_init, 6) AS track_init, fragments, hits, frames, round(max_score, 9) AS max_score, round(mean_score, 9) AS mean_score, round(confidence, 9) AS confidence, "end" FROM life',
    "phase_metrics": _LIFE + "SELECT phase_id, round(coalesce(avg(CAST(hits > 0 AS INTEGER)) FILTER (label_id = 1), 0), 5) AS pd, round(coalesce(avg(CAST(hits > 0 AS INTEGER)) FILTER (label_id = 0), 0), 5) AS pfa, round(avg(first_hit) FILTER (label_id = 1), 5) AS mean_first_hit, round(avg(fragments) FILTER (label_id = 1 AND hits > 0), 5) AS mean_fragments, count(*) AS records FROM life GROUP BY 1",
    **{f"{k}_cfar": _cfar_sql(k) for k in ("ca", "go", "so", "os")},
    "local_peaks": f"WITH {GRID} SELECT c.g, c.x, c.y, c.v FROM grid c JOIN grid n ON n.g = c.g AND n.x BETWEEN c.x - 1 AND c.x + 1 AND n.y BETWEEN c.y - 1 AND c.y + 1 GROUP BY ALL HAVING count(*) = 9 AND c.v > 20 AND c.v >= max(n.v)",
    "connected_components": f"""WITH RECURSIVE {GRID}, c AS (SELECT g, x, y, v, lpad(CAST(x AS VARCHAR), 12, '0') || ',' || lpad(CAST(y AS VARCHAR), 12, '0') AS id FROM (SELECT g, x, y, v / avg(v) OVER () AS v FROM grid) WHERE v > 1.3),
r AS (SELECT g, x, y, id FROM c UNION SELECT c.g, c.x, c.y, r.id FROM r JOIN c ON c.g = r.g AND abs(c.x - r.x) + abs(c.y - r.y) = 1),
l AS (SELECT g, x, y, min(id) AS label FROM r GROUP BY 1, 2, 3)
SELECT g, label, count(*) AS size, round(sum(x * v) / sum(v), 6) AS cx, round(sum(y * v) / sum(v), 6) AS cy, round(max(v), 6) AS peak FROM l JOIN c USING (g, x, y) GROUP BY 1, 2""",
    "hough_tracks": f"WITH {GRID}, v AS (SELECT g, CAST(k AS DOUBLE) AS gradient, CAST(round(y - CAST(k AS DOUBLE) * x) AS BIGINT) AS start, x, max(v) AS v FROM grid CROSS JOIN (VALUES (-1.0), (-0.5), (0.0), (0.5), (1.0)) t(k) WHERE v > 40 GROUP BY ALL) SELECT g, gradient, start, count(*) AS hits, sum(v) AS power FROM v GROUP BY 1, 2, 3 HAVING count(*) >= 3",
    "pooled_bytes": f"WITH {GRID}, p AS (SELECT g, CAST(floor(x * 8 / 40) AS INTEGER) AS bucket, 10 * log10(greatest(max(v), 1e-12)) AS db FROM grid GROUP BY 1, 2), q AS (SELECT *, min(db) OVER (PARTITION BY g) AS lo, max(db) OVER (PARTITION BY g) AS hi FROM p) SELECT g, bucket, CAST(CASE WHEN hi > lo THEN round((db - lo) / (hi - lo) * 255) ELSE 0 END AS INTEGER) AS level FROM q",
    "fused_dedupe": f"WITH {FRAMES} SELECT phase_id, CAST(floor(value) AS BIGINT) AS cell, arg_min(event_type, frame_id) AS kind, max(value) AS magnitude, count(*) AS events FROM frames WHERE event_type IN ('click', 'view', 'purchase') GROUP BY 1, 2",
    "bearing_fusion": f"""WITH {FRAMES}, p AS (SELECT frame_id, (value * 7 % 360 + 360) % 360 AS az, ((value * 7 + frame_id % 40) % 360 + 360) % 360 AS b FROM frames), d AS (SELECT *, ((b - az + 180) % 360 + 360) % 360 - 180 AS d FROM p), g AS (SELECT *, exp(-d * d / 58) AS agree, ln(0.7e0 / (1 - 0.7e0)) AS raw FROM d)
SELECT frame_id, round(((az + d * (4 / 29)) % 360 + 360) % 360, 6) AS azimuth, round(sqrt(100 / 29), 6) AS sigma, round(agree, 6) AS agreement, round(1 / (1 + exp(-(ln(0.6e0 / (1 - 0.6e0)) + exp(-0.3e0) * (raw * agree - abs(raw) * (1 - agree))))), 6) AS confidence FROM g""",
    "nearest_neighbour_l2": """WITH v AS (SELECT vec_id, embedding, generate_subscripts(embedding, 1) AS i FROM embeddings), u AS (SELECT vec_id, i, CAST(embedding[i] AS DOUBLE) AS x FROM v),
st AS (SELECT i, avg(x) AS m, stddev_pop(x) + 1e-6 AS s FROM u WHERE vec_id % 5 <> 0 GROUP BY 1), z AS (SELECT vec_id, i, (x - m) / s AS z FROM u JOIN st USING (i)),
d AS (SELECT q.vec_id, t.vec_id AS near, sqrt(sum(pow(q.z - t.z, 2))) AS d FROM z q JOIN z t ON q.i = t.i WHERE q.vec_id % 5 = 0 AND t.vec_id % 5 <> 0 GROUP BY 1, 2)
SELECT vec_id, arg_min(near, (round(d, 9), near)) AS nearest_id, round(min(d), 6) AS distance FROM d GROUP BY 1""",
    "nearest_with_tolerance": f"WITH {FRAMES}, d AS (SELECT frame_id, 's' || s_suppkey AS entity, abs(abs(value) - s_suppkey * CAST(7.5 AS DOUBLE)) AS d FROM frames JOIN supplier ON abs(abs(value) - s_suppkey * CAST(7.5 AS DOUBLE)) < 2), b AS (SELECT frame_id, arg_min(entity, (d, entity)) AS e, min(d) AS d FROM d GROUP BY 1) SELECT frame_id, coalesce(e, 'unresolved') AS matched, round(d, 9) AS distance FROM frames LEFT JOIN b USING (frame_id)",
    "range_semijoin": f"WITH {FRAMES} SELECT frame_id, phase_id, value FROM frames l WHERE event_type = 'click' AND EXISTS (SELECT 1 FROM frames r WHERE r.event_type = 'purchase' AND r.phase_id = l.phase_id AND abs(l.value - r.value) < greatest(CAST(0.5 AS DOUBLE), CAST(0.01 AS DOUBLE) * abs(l.value)))",
    "wasserstein_ecdf": _ECDF + "SELECT event_type, round(sum(abs(fa - fb) * (nxt - value)), 6) AS w1 FROM e GROUP BY 1",
    "wasserstein_quantile": f"WITH {FRAMES}, g AS (SELECT unnest(range(101)) / CAST(100 AS DOUBLE) AS q), q AS (SELECT event_type, quantile_cont(value, [{', '.join(repr(i / 100) for i in range(101))}]) FILTER (record_id % 2 = 0) AS a, quantile_cont(value, [{', '.join(repr(i / 100) for i in range(101))}]) FILTER (record_id % 2 <> 0) AS b FROM frames GROUP BY 1) SELECT event_type, round(list_sum(list_transform(list_zip(a, b), lambda p: abs(p[1] - p[2]))) / 101, 6) AS w1_grid FROM q",
    "ks_distance": _ECDF + "SELECT event_type, round(max(abs(fa - fb)), 9) AS ks FROM e GROUP BY 1",
    "overlap_coefficient": f"WITH {FRAMES}, r AS (SELECT event_type, min(value) AS lo, max(value) AS hi, count(*) FILTER (record_id % 2 = 0) AS na, count(*) FILTER (record_id % 2 <> 0) AS nb FROM frames GROUP BY 1), h AS (SELECT f.event_type, CASE WHEN hi > lo THEN least(floor((value - lo) / (hi - lo) * 40), 39) ELSE 0 END AS b, count(*) FILTER (record_id % 2 = 0) / max(na) AS a, count(*) FILTER (record_id % 2 <> 0) / max(nb) AS c FROM frames f JOIN r USING (event_type) GROUP BY 1, 2) SELECT event_type, round(sum(least(a, c)), 9) AS overlap FROM h GROUP BY 1",
    "robust_peak": f"WITH {FRAMES}, m AS (SELECT record_id, quantile_cont(value, 0.5) AS m, max(value) AS x FROM frames GROUP BY 1) SELECT record_id, round((max(x) - max(m)) / (quantile_cont(abs(value - m), 0.5) + 1e-6), 4) AS peak_score FROM frames JOIN m USING (record_id) GROUP BY 1",
    "circular_mean": "SELECT event_type, round(((degrees(atan2(avg(sin(radians(value * CAST(3.6 AS DOUBLE)))), avg(cos(radians(value * CAST(3.6 AS DOUBLE)))))) % 360) + 360) % 360, 5) AS bearing FROM events GROUP BY 1",
    "class_likelihoods": """WITH e AS (SELECT user_id, avg(value) AS mean, coalesce(stddev_pop(value), 0) AS spread FROM events GROUP BY 1),
l(name, m1, s1, m2, s2) AS (VALUES ('low', 30, 20, 20, 15), ('mid', 60, 20, 40, 15), ('high', 120, 50, 80, 40)),
x AS (SELECT user_id, name, -0.5 * pow((mean - m1) / s1, 2) - ln(s1) - 0.5 * pow((spread - m2) / s2, 2) - ln(s2) - ln(2 * pi()) AS ll FROM e CROSS JOIN l),
t AS (SELECT *, max(ll) OVER (PARTITION BY user_id) AS top FROM x)
SELECT user_id, arg_max(name, ll) AS best_class, round(1 / sum(exp(ll - top)), 6) AS posterior, round(max(ll), 6) AS log_likelihood FROM t GROUP BY 1""",
}
