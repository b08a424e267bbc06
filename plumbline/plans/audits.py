"""Queries on audits, roll-ups, manifests and set comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import arrays as A
from ..operators import audits as U
from ..operators import frames as W
from ..operators import grouping as G

from ..operators import ranking as R
from ..operators import splits as L
from ..operators import statistics as S
from ..sources import table
from .fixtures import FRAMES, GRID, GROUPS, KEYS, ORDER, SCORED, frames, grid, groups, scored
from .ranking import _r

DENIED = ["scale_db", "seed", "user"]
NAMES = ["scale", "user_id", "sub_scale_ratio", "upscale", "seeds", "max_seed", "value", "User_Count", "rescale_db"]
FAMILIES = [("radar", ("radar", "range")), ("sound", ("sound", "bearing"))]


def _names(s, d):
    n = table(s, d, "nation")
    names = n.select(F.element_at(F.lit(NAMES), (F.col("n_nationkey") % len(NAMES) + 1).cast("int")).alias("name"))
    return U.policy_violations(names, s.createDataFrame([(x,) for x in DENIED], "restricted string"))


def _views(s, d):
    n = table(s, d, "nation").select((F.col("n_regionkey") % 3).cast("string").alias("view"), F.concat(F.when(F.col("n_nationkey") % 3 == 0, "range_").when(F.col("n_nationkey") % 3 == 1, "bearing_").otherwise("x_"), F.col("n_nationkey").cast("string")).alias("name"))
    return U.schema_evidence(n, ["range_0", "x_5", "bearing_7"], U.feature_family(F.col("name"), FAMILIES, "summary"))


def _features(s, d):
    rows = scored(s, d).where("method = 'length'").select("label_id", "split_role", "n_chars", (F.col("record_id") % 11).cast("double").alias("eleven"), F.col("score").alias("length"))
    a = U.single_feature_audit(rows, ["n_chars", "eleven", "length"])
    out = a.select("feature", *[F.col("auc")[k].alias(f"auc_{k}") for k in ("all", "train", "holdout")], *[c for c in a.columns if c.startswith(("positive_", "negative_"))])
    return _r(out, *[c for c in out.columns if c != "feature"])


def _stats(s, d):
    f = frames(s, d).select(F.col("event_type").alias("family"), "value")
    return G.distribution_summary(f, ["family"], "value")


def _bounds(s):
    return s.createDataFrame([("click", 10.0, 20.0), ("view", 0.0, 1.0), ("purchase", 5.0, 5.0)], "family string, low double, high double")


def _prior(s, d):
    p = U.rank_prior(_stats(s, d), _bounds(s), "family")
    return _r(p.select("family", "reference_center", "target_center", "target_q10", "target_q90", "shrinkage", "offset"), "target_center", "target_q10", "target_q90", "shrinkage", "offset")


def _anchors(s, d):
    p = U.rank_prior(_stats(s, d), _bounds(s), "family")
    return _r(U.anchor_distance(p).select("family", "distance"), "distance")


def _gaps(s, d):
    b = s.createDataFrame([("click", 10.0, 90.0), ("view", 1.0, 2.0)], "family string, mean_min double, mean_max double")
    return _r(U.reference_gaps(_stats(s, d), b, "family"), "measured", "reference", "gap")


def _truth(s, d):
    p = table(s, d, "part").select("p_partkey", F.col("p_retailprice").alias("a"), (F.col("p_retailprice") * (1 + (F.col("p_size") - 25) / 100.0)).alias("b"), (F.col("p_size") % 7 == 0).alias("skipped"))
    delta = F.abs(10 * F.log10("a") - 10 * F.log10("b"))
    return p.select("p_partkey", U.truth_status(F.col("a"), F.when(F.col("p_partkey") % 50 > 0, F.col("b")).otherwise(0.0), F.col("skipped"), F.lit(0.5)).alias("status"), delta.alias("delta_db"))


def _diff(rel):
    def q(s, d):
        p = table(s, d, "part").select("p_partkey", F.col("p_retailprice").alias("v"))
        other = p.where("p_partkey % 9 > 0").withColumn("v", F.when(F.col("p_partkey") % 4 == 0, F.col("v") * 1.0001).when(F.col("p_partkey") % 4 == 1, F.col("v") * 1.01).otherwise(F.col("v")))
        return _r(U.values_differ(p, other, ["p_partkey"], "v", rel), "left_value", "right_value")

    return q


def _model_rollup(s, d):
    f = frames(s, d).select("record_id", "frame_id", "label_id", "value", "time_s", (F.col("record_id") % 4).cast("string").alias("family"))
    out = None
    for name, cut in (("low", 60.0), ("high", 100.0)):
        t = W.first_trigger(f, KEYS, ORDER, F.col("value") > cut, 2).select("record_id", F.col("frame_id").alias("trigger_frame"))
        one = f.groupBy("record_id", "family", "label_id").agg(F.min(F.when(F.col("value") > 20, F.col("frame_id"))).alias("detectable_frame")).join(t, "record_id", "left").select(F.lit(name).alias("model_id"), "record_id", (F.col("label_id") == 1).alias("positive"), "family", "trigger_frame", "detectable_frame")
        out = one if out is None else out.unionByName(one)
    m = G.model_rollup(out)
    return _r(m.withColumn("false_alarms", fn.map_json(F.col("false_alarms"))), "pd", "pfa", "mean_latency")


def _record(s, d):
    f = frames(s, d).withColumn("half", F.col("value") / 2)
    return _r(G.record_summary(f, KEYS, ["value", "half"], ["value"], {"detected": F.col("value") > 50, "clicks": F.col("event_type") == "click"}), "mean_value", "mean_half", "max_value", "detected", "clicks")


def _status(s, d):
    o = table(s, d, "orders")
    st = F.col("o_orderstatus")
    return G.status_counts(o, {"active": (st != "F") & (st != "P"), "archived": st == "F", "export_ready": (F.col("o_totalprice") > 100000) & (st != "F"), "queued": st == "O"}, "o_orderkey", "o_orderpriority")


def _classes(s, d):
    return G.class_rollup(table(s, d, "orders").select(F.col("o_orderstatus").alias("tier"), F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderpriority")).alias("kind")), "tier", "kind")


def _manifest(s, d):
    g = groups(s, d).groupBy("group_id").agg(F.max("label_id").alias("is_positive"))
    return L.group_manifest(g, "group_id", "is_positive").select("group_id", "is_positive", "split_role", "cv_fold")


def _strata(s, d):
    return L.strata_split(table(s, d, "customer").select("c_custkey", "c_nationkey"), "c_custkey", F.col("c_nationkey"), [3, 7]).select("c_custkey", "split")


def _summary(s, d):
    perf = R.rates(R.confusion(scored(s, d).withColumn("threshold", F.lit(0.5)), ["method", "phase_id"]))
    perf = perf.join(R.average_precision(scored(s, d), ["method", "phase_id"]), ["method", "phase_id"])
    perf = perf.select(F.concat_ws("/", "method", "phase_id").alias("method"), (F.col("tp") + F.col("fn")).alias("positives"), (F.col("fp") + F.col("tn")).alias("negatives"), "recall", "fpr", "average_precision", F.when(F.col("method") == "tied", F.col("tp")).alias("tp"), F.lit(None).cast("long").alias("fp"))
    return _r(R.method_summary(perf).select("method", "tp", "fp", "fn", "tn", "average_precision"), "average_precision")


def _best(s, d):
    ap = R.average_precision(scored(s, d), ["method", "phase_id"])
    return _r(R.best_of_group(ap, ["phase_id"], "average_precision", "method", 1), "average_precision")


def _padded(s, d):
    f = W.padded(frames(s, d), KEYS, ORDER, "value", 400)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return _r(f.select("record_id", F.size("values").alias("length"), F.size(F.filter("mask", lambda m: m)).alias("real"), F.col("values")[0].alias("first"), total("values").alias("total")), "first", "total", digits=6)


def _cube(s, d):
    l = table(s, d, "lineitem")
    return l.groupBy((F.col("l_orderkey") % 3).cast("int").alias("g"), (F.col("l_partkey") % 8).cast("int").alias("x"), (F.col("l_suppkey") % 8).cast("int").alias("y"), (F.col("l_linenumber") % 4).cast("int").alias("z")).agg(F.sum("l_quantity").alias("v"))


_CUBE = "cube AS (SELECT CAST(l_orderkey % 3 AS INTEGER) AS g, CAST(l_partkey % 8 AS INTEGER) AS x, CAST(l_suppkey % 8 AS INTEGER) AS y, CAST(l_linenumber % 4 AS INTEGER) AS z, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3, 4)"


def _spectrum(s, d):
    c = A.cube_reduce(_cube(s, d), ["g", "y", "x"], "v")
    return _r(A.spectrum(c.withColumn("im", F.lit(0.0)), ["g", "y"], "x", "v", "im", 8, "hann").select("g", "y", "bin", (F.col("re") + 0.0).alias("re"), (F.col("im") + 0.0).alias("im")), "re", "im", digits=6)


def _series(s, d):
    """The frames of each record, numbered from 0."""
    return frames(s, d).withColumn("i", F.row_number().over(W._w(KEYS, ORDER)) - 1).select("record_id", "i", "value")


def _campaign(s, d):
    """Slots for a seventh of the orders, dealt to priorities by their share."""
    w = table(s, d, "orders").groupBy(F.col("o_orderpriority").alias("bucket")).agg(F.count("*").alias("weight"))
    return L.campaign_plan(w, table(s, d, "orders").count() // 7)


def _ring(kind):
    def q(s, d):
        return _r(A.ring_cfar(grid(s, d), ["g"], "x", "y", "v", 2, 1, 0.3, kind, 20), "threshold", digits=6)

    return q


QUERIES = {
    "policy_violations": _names,
    "schema_evidence": _views,
    "single_feature_audit": _features,
    "pr_auc_steps": lambda s, d: _r(R.pr_auc(scored(s, d), ["method"]), "pr_auc"),
    "absolute_auc": lambda s, d: _r(R.roc_auc(scored(s, d), ["method", "phase_id"]).select("method", "phase_id", F.greatest("roc_auc", 1 - F.col("roc_auc")).alias("auc_abs")), "auc_abs"),
    "saturation_guard": lambda s, d: _r(U.saturation(frames(s, d).withColumn("twice", F.least(F.col("value") * 2, F.lit(50.0))), {"value": 1000.0, "twice": 50.0}), "at_clamp", "median"),
    "rank_mapped_prior": _prior,
    "anchor_distance": _anchors,
    "reference_gaps": _gaps,
    "truth_compare": lambda s, d: _truth(s, d).select("p_partkey", "status"),
    "delta_summary": lambda s, d: _r(U.delta_summary(_truth(s, d).where("status <> 'warn' or delta_db > 0.5")), "max_delta_db", "rms_delta_db"),
    "tolerance_compare": _diff(0.001),
    "bitwise_compare": _diff(None),
    "identity_sets": lambda s, d: U.id_sets(table(s, d, "labels"), table(s, d, "documents").where("doc_id % 3 > 0"), "doc_id"),
    "protected_values": lambda s, d: table(s, d, "documents").select(F.explode(F.array(*[F.concat_ws("=", F.lit(k), F.coalesce(k, F.lit(""))) for k in ("lang", "source")])).alias("value")).distinct(),
    "group_counts": lambda s, d: G.group_counts(groups(s, d), "group_id", ["stratum"], F.col("label_id") == 1),
    "record_summary": _record,
    "status_counts": _status,
    "fidelity_rollup": _classes,
    "model_rollup": _model_rollup,
    "component_means": lambda s, d: _r(G.component_means(table(s, d, "events").select("user_id", "event_type", F.when(F.col("event_id") % 5 > 0, F.col("value").cast("string")).otherwise("").alias("score")), "user_id", "event_type", "score", ["click", "view"]), "score"),
    "track_products": lambda s, d: _r(G.track_products(frames(s, d).withColumn("c", F.col("value") / 200), "record_id", ORDER, "c", "value"), "mean_confidence", "range_start", "range_end"),
    "group_manifest": _manifest,
    "strata_split": _strata,
    "round_robin_classes": lambda s, d: L.round_robin(table(s, d, "orders").select("o_orderkey"), "o_orderkey", F.col("o_orderkey") % 3 == 0, ["a", "b"], ["x", "y", "z"]),
    "campaign_plan": _campaign,
    "method_summary": _summary,
    "best_per_group": _best,
    "top_methods": lambda s, d: _r(R.best_of_group(R.average_precision(scored(s, d), ["method", "phase_id"]).withColumn("name", F.concat_ws("/", "method", "phase_id")).withColumn("all", F.lit(1)), ["all"], "average_precision", "name", 3).select("name", "average_precision"), "average_precision"),
    "horizon_summary": lambda s, d: _r(W.horizon(frames(s, d).withColumn("t", F.col("time_s") % 86400), "t", 3600.0).groupBy("record_id").agg(F.count("*").alias("n"), F.max("t").alias("last")), "last", digits=6),
    "padded_records": _padded,
    "phase_order": lambda s, d: W.in_phase_order(table(s, d, "orders").groupBy(F.col("o_orderpriority").alias("phase")).agg(F.count("*").alias("n")), "phase", ["3-MEDIUM", "1-URGENT"], []),
    "cube_peak": lambda s, d: A.cube_peak(_cube(s, d), ["g"], ["x", "y", "z"], "v"),
    "cube_plane": lambda s, d: _cube(s, d).where("z = 2").select("g", "x", "y", "v"),
    "cube_sum": lambda s, d: A.cube_reduce(_cube(s, d), ["g", "x", "y"], "v"),
    "row_reducer": lambda s, d: _r(A.cube_reduce(_cube(s, d), ["g", "x"], "v", "max").join(A.cube_reduce(_cube(s, d), ["g", "x"], "v", "mean").withColumnRenamed("v", "mean"), ["g", "x"]), "mean"),
    "doppler_spectrum": _spectrum,
    "ring_cfar_mean": _ring("ca"),
    "ring_cfar_order": _ring("os"),
    "spectral_summary": lambda s, d: _r(_r(A.spectral_summary(A.power_spectrum(_series(s, d), KEYS, "i", "value"), KEYS), "entropy", digits=6), "power", digits=2),
    "periodicity": lambda s, d: _r(A.autocorrelation(_series(s, d), KEYS, ["i"], "value", 2, 8, 0.2), "periodicity", digits=6),
    "matched_filter": lambda s, d: _r(A.correlate(_series(s, d), KEYS, ["i"], "value", [1.0, -2.0, 0.5]).select("record_id", "i", "compressed"), "compressed", digits=6),
    "window_spectra": lambda s, d: _r(A.window_spectra(_series(s, d), KEYS, "i", "value", 8, 4), "magnitude", digits=6),
    "spread_at_drop": lambda s, d: _r(A.spread_at_drop(A.window_spectra(_series(s, d), KEYS, "i", "value", 8, 4), KEYS, 6.0), "spread"),
    "interference": lambda s, d: _r(A.interference(A.power_spectrum(_series(s, d), KEYS, "i", "value"), KEYS), "flatness", "low_mass", "peak_to_mean", digits=6),
    "metric_dispatch": lambda s, d: _r(S.wasserstein(frames(s, d), ["event_type"], F.col("record_id") % 2 == 0, "value").select("event_type", F.lit("w1").alias("metric"), F.col("w1").alias("v")).unionByName(S.kolmogorov_smirnov(frames(s, d), ["event_type"], F.col("record_id") % 2 == 0, "value").select("event_type", F.lit("ks").alias("metric"), F.col("ks").alias("v"))), "v", digits=6),
}

_DIST = f"st AS (SELECT event_type AS family, count(value) AS n, avg(value) AS mean, min(value) AS mn, max(value) AS mx, quantile_cont(value, 0.1) AS q10, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.9) AS q90 FROM frames GROUP BY 1)"
_PRIOR = f"""WITH {FRAMES}, {_DIST}, b(family, lo, hi) AS (VALUES ('click', 10e0, 20e0), ('view', 0e0, 1e0), ('purchase', 5e0, 5e0)),
k AS (SELECT *, CASE WHEN mx <= mn THEN 0.5e0 ELSE least(0.95e0, greatest(0.05e0, (q10 - mn) / (mx - mn))) END AS r10, CASE WHEN mx <= mn THEN 0.5e0 ELSE least(0.95e0, greatest(0.05e0, (q50 - mn) / (mx - mn))) END AS r50, CASE WHEN mx <= mn THEN 0.5e0 ELSE least(0.95e0, greatest(0.05e0, (q90 - mn) / (mx - mn))) END AS r90 FROM st JOIN b USING (family)),
m AS (SELECT *, lo + r10 * (hi - lo) AS a, lo + r90 * (hi - lo) AS z, lo + r50 * (hi - lo) AS tc, (lo + hi) / 2 AS rc, greatest((hi - lo) * 0.12e0, 1e-6) AS w FROM k),
p AS (SELECT family, rc, tc, CASE WHEN z - a < w THEN greatest(lo, (a + z) / 2 - w / 2) ELSE a END AS t10, CASE WHEN z - a < w THEN least(hi, (a + z) / 2 + w / 2) ELSE z END AS t90, least(0.35e0, n / (n + 20e0)) AS s FROM m)
"""
_TRUTH = "t AS (SELECT p_partkey, p_size, p_retailprice AS a, p_retailprice * (1 + (p_size - 25) / 100e0) AS b FROM part), v AS (SELECT p_partkey, abs(10 * log10(a) - 10 * log10(b)) AS delta_db, CASE WHEN p_size % 7 = 0 THEN 'warn' WHEN p_partkey % 50 = 0 THEN 'fail' WHEN abs(10 * log10(a) - 10 * log10(b)) <= 0.5 THEN 'pass' WHEN abs(10 * log10(a) - 10 * log10(b)) <= 1 THEN 'warn' ELSE 'fail' END AS status FROM t)"
_PAIR = "p AS (SELECT p_partkey, p_retailprice AS a, CASE WHEN p_partkey % 9 > 0 THEN CASE p_partkey % 4 WHEN 0 THEN p_retailprice * 1.0001e0 WHEN 1 THEN p_retailprice * 1.01e0 ELSE p_retailprice END END AS b FROM part)"
_AP = "o AS (SELECT *, row_number() OVER (PARTITION BY method, phase_id ORDER BY score DESC, ord) AS seen, sum(label_id) OVER (PARTITION BY method, phase_id ORDER BY score DESC, ord) AS hits FROM scored), ap AS (SELECT method, phase_id, sum(CASE WHEN label_id = 1 THEN hits / seen ELSE 0 END) / sum(label_id) AS ap FROM o GROUP BY 1, 2)"
_H = "CAST(('0x' || substr(md5('1|{tag}|' || {id}), 1, 13)) AS BIGINT)"
_RING_N = 7 * 7 - 3 * 3


def _ring_sql(kind: str) -> str:
    alpha = A.cell_average_alpha(_RING_N, 0.3) if kind == "ca" else A.order_statistic_alpha(_RING_N, 21, 0.3)
    stat = "avg(n.v)" if kind == "ca" else "list_sort(list(n.v))[21]"
    return f"WITH {GRID}, t AS (SELECT c.g, c.x, c.y, c.v, {alpha!r}::DOUBLE * {stat} AS threshold FROM grid c JOIN grid n ON n.g = c.g AND abs(n.x - c.x) <= 3 AND abs(n.y - c.y) <= 3 AND NOT (abs(n.x - c.x) <= 1 AND abs(n.y - c.y) <= 1) JOIN (SELECT c.g, c.x, c.y FROM grid c JOIN grid n ON n.g = c.g AND abs(n.x - c.x) <= 3 AND abs(n.y - c.y) <= 3 GROUP BY ALL HAVING count(*) = 49) f ON f.g = c.g AND f.x = c.x AND f.y = c.y GROUP BY c.g, c.x, c.y, c.v) SELECT g, x, y, v, round(threshold, 6) AS threshold FROM t WHERE v > threshold"


def _violations() -> str:
    stems = {r: {r, *[r[: -len(u)] for u in U.UNITS if r.endswith(u)]} for r in DENIED}
    pairs = ", ".join(f"('{r}', '{x}')" for r in DENIED for x in sorted(stems[r]))
    names = "[" + ", ".join(f"'{n}'" for n in NAMES) + "]"
    return f"WITH n AS (SELECT DISTINCT ({names})[n_nationkey % {len(NAMES)} + 1] AS name FROM nation), s(r, stem) AS (VALUES {pairs}) SELECT name, string_agg(DISTINCT r, ',' ORDER BY r) AS matches FROM n JOIN s ON lower(name) = stem OR lower(name) LIKE stem || '\\_%' ESCAPE '\\' OR lower(name) LIKE '%\\_' || stem ESCAPE '\\' OR lower(name) LIKE '%\\_' || stem || '\\_%' ESCAPE '\\' GROUP BY 1".replace("LIKE stem", "LIKE replace(stem, '_', '\\_')").replace("|| stem", "|| replace(stem, '_', '\\_')")


_SERIES = f"""WITH {FRAMES}, s AS (SELECT record_id, value, row_number() OVER (PARTITION BY record_id ORDER BY time_s, frame_id) - 1 AS i, count(*) OVER (PARTITION BY record_id) AS n FROM frames)"""
_POWER = _SERIES + """, x AS (SELECT *, value - avg(value) OVER (PARTITION BY record_id) AS x FROM s), p AS (SELECT record_id, n, b, pow(sum(x * cos(-2 * pi() / n * (b * i % n))), 2) + pow(sum(x * sin(-2 * pi() / n * (b * i % n))), 2) AS p FROM (SELECT *, unnest(range(0, n // 2 + 1)) AS b FROM x) GROUP BY 1, 2, 3)"""
_STFT = _SERIES + """, w AS (SELECT record_id, k, i - k * 4 AS a, value * (0.5e0 - 0.5e0 * cos(2 * pi() * (i - k * 4) / 7)) AS v FROM (SELECT *, unnest(range(greatest(0, CAST(ceil((i - 7) / 4) AS BIGINT)), least(i // 4, greatest(0, (n - 8) // 4)) + 1)) AS k FROM s)), m AS (SELECT record_id, k, b, sqrt(pow(sum(v * cos(-2 * pi() / 8 * (b * a % 8))), 2) + pow(sum(v * sin(-2 * pi() / 8 * (b * a % 8))), 2)) AS m FROM w CROSS JOIN range(5) u(b) GROUP BY 1, 2, 3)"""

ORACLE_SQL = {
    "spectral_summary": _POWER + ", q AS (SELECT *, sum(p) OVER (PARTITION BY record_id) AS t, sum(p) OVER (PARTITION BY record_id ORDER BY p DESC, b) - p AS c FROM p) SELECT record_id, CAST(arg_max(b, (p, -b)) AS INTEGER) AS peak_bin, round(max(t), 2) AS power, round(sum(CASE WHEN p > 0 THEN -p / t * ln(p / t) ELSE 0 END) / ln(greatest(count(*), 2)), 6) AS entropy, CAST(count(*) FILTER (c < 0.9e0 * t) AS INTEGER) AS bandwidth_bins FROM q GROUP BY 1",
    "periodicity": _SERIES + ", x AS (SELECT *, value - avg(value) OVER (PARTITION BY record_id) AS x FROM s), e AS (SELECT record_id, sum(x * x) AS e FROM x GROUP BY 1), a AS (SELECT a.record_id, b.i - a.i AS k, round(sum(a.x * b.x) / max(e), 12) AS r FROM x a JOIN x b ON a.record_id = b.record_id AND b.i - a.i BETWEEN 2 AND 8 JOIN e ON e.record_id = a.record_id GROUP BY 1, 2) SELECT record_id, CAST(arg_max(k, (r, -k)) AS INTEGER) AS lag, round(max(r), 6) AS periodicity, max(r) >= 0.2e0 AS periodic FROM a GROUP BY 1",
    "matched_filter": _SERIES + ", l AS (SELECT record_id, i, value - 2 * lead(value) OVER w + 0.5e0 * lead(value, 2) OVER w AS c FROM s WINDOW w AS (PARTITION BY record_id ORDER BY i)) SELECT record_id, CAST(i AS INTEGER) AS i, round(c, 6) + 0 AS compressed FROM l WHERE c IS NOT NULL",
    "window_spectra": _STFT + 'SELECT record_id, CAST(k AS INTEGER) AS "window", CAST(b AS INTEGER) AS bin, round(m, 6) AS magnitude FROM m',
    "spread_at_drop": _STFT + ", d AS (SELECT record_id, b, avg(20 * log10(greatest(m, 1e-12))) AS db FROM m GROUP BY 1, 2), t AS (SELECT *, max(db) OVER (PARTITION BY record_id) AS top FROM d) SELECT record_id, CAST(max(b) - min(b) AS DOUBLE) AS spread FROM t WHERE db >= top - 6 GROUP BY 1",
    "interference": _POWER + " SELECT record_id, round(exp(avg(ln(greatest(p, 1e-12)))) / greatest(avg(p), 1e-12), 6) AS flatness, round(sum(CASE WHEN b * 4 < n // 2 + 1 THEN p ELSE 0 END) / greatest(sum(p), 1e-12), 6) AS low_mass, round(max(p) / greatest(avg(p), 1e-12), 6) AS peak_to_mean FROM p GROUP BY 1",
    "policy_violations": _violations(),
    "schema_evidence": """WITH n AS (SELECT CAST(n_regionkey % 3 AS VARCHAR) AS v, CASE n_nationkey % 3 WHEN 0 THEN 'range_' WHEN 1 THEN 'bearing_' ELSE 'x_' END || n_nationkey AS name FROM nation), f AS (SELECT *, name IN ('range_0', 'x_5', 'bearing_7') AS bad, CASE WHEN name LIKE '%range%' THEN 'radar' WHEN name LIKE '%bearing%' THEN 'sound' ELSE 'summary' END AS fam FROM n)
SELECT v AS "view", count(*) AS columns, coalesce(string_agg(DISTINCT name, '|' ORDER BY name) FILTER (bad), '') AS denied, coalesce(string_agg(DISTINCT fam, '|' ORDER BY fam) FILTER (NOT bad), '') AS families FROM f GROUP BY 1""",
    "single_feature_audit": f"""WITH {SCORED}, x AS (SELECT * FROM scored WHERE method = 'length'), l0 AS (SELECT label_id, split_role, 'n_chars' AS feature, n_chars AS v FROM x UNION ALL SELECT label_id, split_role, 'eleven', CAST(record_id % 11 AS DOUBLE) FROM x UNION ALL SELECT label_id, split_role, 'length', score FROM x),
l AS (SELECT label_id, split_role AS part, feature, v FROM l0 UNION ALL SELECT label_id, 'all', feature, v FROM l0), g AS (SELECT feature, part, v, sum(label_id) AS p, count(*) - sum(label_id) AS n FROM l GROUP BY 1, 2, 3), h AS (SELECT *, sum(n) OVER (PARTITION BY feature, part ORDER BY v) - n AS nb FROM g),
a AS (SELECT feature, part, sum(p * (nb + n / 2)) / (sum(p) * sum(n)) AS auc FROM h GROUP BY 1, 2), b AS (SELECT feature, max(greatest(auc, 1 - auc)) FILTER (part = 'all') AS auc_all, max(greatest(auc, 1 - auc)) FILTER (part = 'train') AS auc_train, max(greatest(auc, 1 - auc)) FILTER (part = 'holdout') AS auc_holdout FROM a GROUP BY 1),
q AS (SELECT feature, {", ".join(f"quantile_cont(v, {p}) FILTER (label_id = {y}) AS {n}_q{int(p * 100)}" for y, n in ((1, "positive"), (0, "negative")) for p in (0.1, 0.5, 0.9))} FROM l0 GROUP BY 1)
SELECT feature, round(auc_all, 9) AS auc_all, round(auc_train, 9) AS auc_train, round(auc_holdout, 9) AS auc_holdout, {", ".join(f"round({n}_q{p}, 9) AS {n}_q{p}" for n in ("positive", "negative") for p in (10, 50, 90))} FROM b JOIN q USING (feature)""",
    "pr_auc_steps": f"WITH {SCORED}, o AS (SELECT *, row_number() OVER w AS seen, sum(label_id) OVER w AS hits, sum(label_id) OVER (PARTITION BY method) AS pos FROM scored WINDOW w AS (PARTITION BY method ORDER BY score DESC, ord)), c AS (SELECT method, hits / seen AS pr, hits / pos AS re, lag(hits / pos, 1, 0) OVER (PARTITION BY method ORDER BY seen) AS before FROM o) SELECT method, round(sum(pr * greatest(0, re - before)), 9) AS pr_auc FROM c GROUP BY 1",
    "absolute_auc": f"WITH {SCORED}, g AS (SELECT method, phase_id, score, sum(label_id) AS p, count(*) - sum(label_id) AS n FROM scored GROUP BY 1, 2, 3), h AS (SELECT *, sum(n) OVER (PARTITION BY method, phase_id ORDER BY score) - n AS nb FROM g), a AS (SELECT method, phase_id, CASE WHEN sum(p) * sum(n) > 0 THEN sum(p * (nb + n / 2)) / (sum(p) * sum(n)) END AS a FROM h GROUP BY 1, 2) SELECT method, phase_id, round(greatest(a, 1 - a), 9) AS auc_abs FROM a",
    "saturation_guard": f"WITH {FRAMES}, l AS (SELECT 'value' AS name, CAST(1000 AS DOUBLE) AS clamp, value AS v FROM frames UNION ALL SELECT 'twice', 50, least(value * 2, 50) FROM frames) SELECT name, clamp, round(avg(CAST(v >= clamp - 1e-6 AS INTEGER)), 9) AS at_clamp, round(quantile_cont(v, 0.5), 9) AS median, quantile_cont(v, 0.5) < clamp - 1e-6 AS passed FROM l GROUP BY 1, 2",
    "rank_mapped_prior": _PRIOR + "SELECT family, rc AS reference_center, round(tc, 9) AS target_center, round(t10, 9) AS target_q10, round(t90, 9) AS target_q90, round(s, 9) AS shrinkage, round((tc - rc) * s, 9) AS offset FROM p",
    "anchor_distance": _PRIOR + "SELECT family, round((tc - rc) / CASE WHEN abs(t90 - t10) / 2 > 0 THEN abs(t90 - t10) / 2 ELSE greatest(abs(tc), abs(rc), 1) END, 9) AS distance FROM p",
    "reference_gaps": f"WITH {FRAMES}, {_DIST}, b(family, lo, hi) AS (VALUES ('click', 10e0, 90e0), ('view', 1e0, 2e0)), j AS (SELECT *, (lo + hi) / 2 AS ref, CASE WHEN lo IS NULL THEN 'no_reference' WHEN mean BETWEEN lo AND hi THEN 'pass' ELSE 'gap' END AS status FROM st LEFT JOIN b USING (family)) SELECT family, 'mean_gap' AS metric, round(mean, 9) AS measured, round(ref, 9) AS reference, round(abs(mean - ref), 9) AS gap, status FROM j UNION ALL SELECT family, 'q50_ratio', round(q50, 9), round(ref, 9), round(q50 / ref, 9), status FROM j",
    "truth_compare": f"WITH {_TRUTH} SELECT p_partkey, status FROM v",
    "delta_summary": f"WITH {_TRUTH}, x AS (SELECT * FROM v WHERE status <> 'warn' OR delta_db > 0.5) SELECT count(*) AS n, count(*) FILTER (status = 'pass') AS n_pass, count(*) FILTER (status = 'warn') AS n_warn, count(*) FILTER (status = 'fail') AS n_fail, round(max(delta_db), 9) AS max_delta_db, round(sqrt(avg(delta_db * delta_db)), 9) AS rms_delta_db, sqrt(avg(delta_db * delta_db)) <= 1 AND count(*) FILTER (status = 'fail') = 0 AS passed FROM x",
    "tolerance_compare": f"WITH {_PAIR} SELECT p_partkey, round(a, 9) AS left_value, round(b, 9) AS right_value FROM p WHERE b IS NULL OR abs(a - b) > 0.001e0 * greatest(abs(a), abs(b))",
    "bitwise_compare": f"WITH {_PAIR} SELECT p_partkey, round(a, 9) AS left_value, round(b, 9) AS right_value FROM p WHERE b IS DISTINCT FROM a",
    "identity_sets": "WITH a AS (SELECT DISTINCT doc_id FROM labels), b AS (SELECT DISTINCT doc_id FROM documents WHERE doc_id % 3 > 0), j AS (SELECT a.doc_id AS x, b.doc_id AS y FROM a FULL JOIN b ON a.doc_id = b.doc_id) SELECT count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS both, count(*) FILTER (y IS NULL) AS left_only, count(*) FILTER (x IS NULL) AS right_only, count(*) FILTER (y IS NULL OR x IS NULL) = 0 AS equal FROM j",
    "protected_values": "SELECT DISTINCT 'lang=' || coalesce(lang, '') AS value FROM documents UNION SELECT DISTINCT 'source=' || coalesce(source, '') FROM documents",
    "group_counts": f"WITH {GROUPS} SELECT stratum, count(DISTINCT group_id) AS groups, count(DISTINCT group_id) FILTER (label_id = 1) AS positive_groups FROM grp GROUP BY 1",
    "record_summary": f"WITH {FRAMES} SELECT record_id, round(avg(value), 9) AS mean_value, round(avg(value / 2), 9) AS mean_half, round(greatest(max(value), 0), 9) AS max_value, round(avg(CAST(value > 50 AS INTEGER)), 9) AS detected, round(avg(CAST(event_type = 'click' AS INTEGER)), 9) AS clicks, count(*) AS frames FROM frames GROUP BY 1",
    "status_counts": "SELECT count(*) AS total, count(*) FILTER (o_orderstatus NOT IN ('F', 'P')) AS active, count(*) FILTER (o_orderstatus = 'F') AS archived, count(*) FILTER (o_totalprice > 100000 AND o_orderstatus <> 'F') AS export_ready, count(*) FILTER (o_orderstatus = 'O') AS queued, max(o_orderkey) AS newest, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS tiers FROM orders",
    "fidelity_rollup": "WITH o AS (SELECT o_orderstatus AS tier, CASE WHEN o_orderkey % 5 > 0 THEN o_orderpriority END AS kind FROM orders) SELECT 'class' AS level, '' AS tier, coalesce(kind, '(none)') AS class, count(*) AS n FROM o GROUP BY kind UNION ALL SELECT 'tier_class', tier, kind, count(*) FROM o WHERE kind IS NOT NULL GROUP BY tier, kind",
    "model_rollup": f"""WITH {FRAMES}, c(model_id, cut) AS (VALUES ('low', 60), ('high', 100)), f AS (SELECT *, value > cut AS flag FROM frames CROSS JOIN c),
r1 AS (SELECT *, sum(CASE WHEN flag THEN 0 ELSE 1 END) OVER (PARTITION BY model_id, record_id ORDER BY time_s, frame_id) AS off FROM f), r AS (SELECT *, CASE WHEN flag THEN row_number() OVER (PARTITION BY model_id, record_id, off, flag ORDER BY time_s, frame_id) ELSE 0 END AS streak FROM r1),
t AS (SELECT model_id, record_id, arg_min(frame_id, (time_s, frame_id)) AS trig FROM r WHERE streak = 2 GROUP BY 1, 2), x AS (SELECT model_id, record_id, max(label_id) = 1 AS pos, CAST(record_id % 4 AS VARCHAR) AS family, min(frame_id) FILTER (value > 20) AS det FROM f GROUP BY 1, 2), y AS (SELECT x.*, trig FROM x LEFT JOIN t USING (model_id, record_id)),
z AS (SELECT model_id, family, count(*) AS n FROM y WHERE NOT pos AND trig IS NOT NULL GROUP BY 1, 2), w AS (SELECT model_id, '{{' || string_agg('"' || family || '":' || n, ',' ORDER BY family) || '}}' AS fa FROM z GROUP BY 1)
SELECT y.model_id, count(*) FILTER (pos) AS positive_records, count(*) FILTER (NOT pos) AS negative_records, round(count(*) FILTER (pos AND trig IS NOT NULL) / count(*) FILTER (pos), 9) AS pd, round(count(*) FILTER (NOT pos AND trig IS NOT NULL) / count(*) FILTER (NOT pos), 9) AS pfa, count(*) FILTER (pos AND trig IS NULL) AS missed,
round(avg(trig - det) FILTER (pos AND trig >= det), 9) AS mean_latency, max(fa) AS false_alarms FROM y LEFT JOIN w USING (model_id) GROUP BY 1""",
    "component_means": "SELECT user_id, round(avg(CASE WHEN event_id % 5 > 0 THEN value ELSE 0 END), 9) AS score FROM events WHERE event_type IN ('click', 'view') GROUP BY 1",
    "track_products": f"WITH {FRAMES} SELECT record_id, count(*) AS detections, round(avg(value / 200), 9) AS mean_confidence, round(arg_min(value, (time_s, frame_id)), 9) AS range_start, round(arg_max(value, (time_s, frame_id)), 9) AS range_end FROM frames GROUP BY 1",
    "group_manifest": f"""WITH {GROUPS}, g AS (SELECT group_id, max(label_id) AS p FROM grp GROUP BY 1), n AS (SELECT count(*) AS n, sum(p) AS np, least(greatest(5, round_even(count(*) * 0.15e0, 0)), count(*) - 5) AS hold FROM g), m AS (SELECT *, least(ceil(hold * np / n), np, hold) AS hp FROM n),
r AS (SELECT g.*, CASE WHEN p = 1 THEN hp ELSE hold - hp END AS q, row_number() OVER (PARTITION BY p ORDER BY {_H.format(tag='manifest', id='group_id')}, group_id) AS k FROM g CROSS JOIN m)
SELECT group_id, p AS is_positive, CASE WHEN k <= q THEN 'holdout' ELSE 'train' END AS split_role, CAST(CASE WHEN k <= q THEN -1 ELSE (k - q - 1) % 5 END AS INTEGER) AS cv_fold FROM r""",
    "strata_split": f"WITH c AS (SELECT c_custkey, c_nationkey IN (3, 7) AS held FROM customer), n AS (SELECT count(*) AS n, count(*) FILTER (held) AS h, round_even(count(*) * 0.7e0, 0) AS a, round_even(count(*) * 0.15e0, 0) AS b FROM c), r AS (SELECT c.*, n.*, row_number() OVER (PARTITION BY held ORDER BY {_H.format(tag='strata', id='c_custkey')}, c_custkey) AS k FROM c CROSS JOIN n) SELECT c_custkey, CASE WHEN held THEN 'test' WHEN k <= b THEN 'validation' WHEN k <= b + greatest(n - a - b - h, 0) THEN 'test' ELSE 'train' END AS split FROM r",
    "round_robin_classes": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN (['a', 'b'])[o_orderkey % 2 + 1] ELSE (['x', 'y', 'z'])[o_orderkey % 3 + 1] END AS class_label FROM orders",
    "campaign_plan": f"WITH w AS (SELECT o_orderpriority AS bucket, count(*) AS weight FROM orders GROUP BY 1), t AS (SELECT sum(weight) AS s, sum(weight) // 7 AS total, count(*) AS c FROM w), q AS (SELECT bucket, total * weight // s AS n, row_number() OVER (ORDER BY bucket) - 1 AS k, total, c FROM w CROSS JOIN t), l AS (SELECT *, total - sum(n) OVER () AS rest FROM q), b AS (SELECT bucket, CAST(n + rest // c + CAST(k < rest % c AS INTEGER) AS BIGINT) AS n FROM l), x AS (SELECT bucket, unnest(range(0, n)) AS \"index\" FROM b) SELECT bucket, \"index\", row_number() OVER (ORDER BY {_H.format(tag='plan', id='bucket || chr(124) || \"index\"')}, bucket, \"index\") - 1 AS slot FROM x",
    "method_summary": f"WITH {SCORED}, {_AP}, c AS (SELECT method, phase_id, count(*) FILTER (score >= 0.5 AND label_id = 1) AS tp, count(*) FILTER (score >= 0.5 AND label_id = 0) AS fp, count(*) FILTER (score < 0.5 AND label_id = 0) AS tn, count(*) FILTER (score < 0.5 AND label_id = 1) AS fn FROM scored GROUP BY 1, 2) SELECT method || '/' || phase_id AS method, tp, fp, fn, tn, round(ap, 9) AS average_precision FROM c JOIN ap USING (method, phase_id)",
    "best_per_group": f"WITH {SCORED}, {_AP}, r AS (SELECT *, row_number() OVER (PARTITION BY phase_id ORDER BY ap DESC NULLS LAST, method) AS k FROM ap) SELECT phase_id, method, round(ap, 9) AS average_precision FROM r WHERE k = 1",
    "top_methods": f"WITH {SCORED}, {_AP} SELECT method || '/' || phase_id AS name, round(ap, 9) AS average_precision FROM ap ORDER BY ap DESC NULLS LAST, name LIMIT 3",
    "horizon_summary": f"WITH {FRAMES} SELECT record_id, count(*) AS n, round(max(time_s % 86400), 6) AS last FROM frames WHERE time_s % 86400 <= 3600 + 1e-6 GROUP BY 1",
    "padded_records": f"WITH {FRAMES} SELECT record_id, CAST(400 AS INTEGER) AS length, CAST(count(*) AS INTEGER) AS real, round(arg_min(value, (time_s, frame_id)), 6) AS first, round(sum(value), 6) AS total FROM frames GROUP BY 1",
    "phase_order": "SELECT o_orderpriority AS phase, count(*) AS n, CAST(CASE o_orderpriority WHEN '3-MEDIUM' THEN 1 WHEN '1-URGENT' THEN 2 ELSE 99 END AS INTEGER) AS phase_rank FROM orders GROUP BY 1",
    "cube_peak": f"WITH {_CUBE}, r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY v DESC, x, y, z) AS k FROM cube) SELECT g, x, y, z, v AS peak FROM r WHERE k = 1",
    "cube_plane": f"WITH {_CUBE} SELECT g, x, y, v FROM cube WHERE z = 2",
    "cube_sum": f"WITH {_CUBE} SELECT g, x, y, sum(v) AS v FROM cube GROUP BY 1, 2, 3",
    "row_reducer": f"WITH {_CUBE} SELECT g, x, max(v) AS v, round(avg(v), 9) AS mean FROM cube GROUP BY 1, 2",
    "doppler_spectrum": f"WITH {_CUBE}, c AS (SELECT g, y, x, sum(v) * (0.5e0 - 0.5e0 * cos(2 * pi() * x / 7)) AS v FROM cube GROUP BY 1, 2, 3) SELECT g, y, CAST(b AS INTEGER) AS bin, round(sum(v * cos(-2 * pi() / 8 * (b * x % 8))), 6) + 0 AS re, round(sum(v * sin(-2 * pi() / 8 * (b * x % 8))), 6) + 0 AS im FROM c CROSS JOIN range(8) t(b) GROUP BY 1, 2, 3",
    "ring_cfar_mean": _ring_sql("ca"),
    "ring_cfar_order": _ring_sql("os"),
    "metric_dispatch": f"WITH {FRAMES}, v AS (SELECT event_type, value, count(*) FILTER (record_id % 2 = 0) AS a, count(*) FILTER (record_id % 2 <> 0) AS b FROM frames WHERE value IS NOT NULL GROUP BY 1, 2), e AS (SELECT *, sum(a) OVER w / sum(a) OVER (PARTITION BY event_type) AS fa, sum(b) OVER w / sum(b) OVER (PARTITION BY event_type) AS fb, lead(value) OVER w AS nxt FROM v WINDOW w AS (PARTITION BY event_type ORDER BY value)) SELECT event_type, 'w1' AS metric, round(sum(abs(fa - fb) * (nxt - value)), 6) AS v FROM e GROUP BY 1 UNION ALL SELECT event_type, 'ks', round(max(abs(fa - fb)), 6) FROM e GROUP BY 1",
}
