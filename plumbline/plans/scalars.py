"""Queries on scalar functions and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import joining as J
from ..operators import statistics as S
from ..sources import table
from .fixtures import FRAMES, GROUPS, SCORED, frames, groups, scored
from .ranking import _r


def _scores(s, d):
    f = frames(s, d)
    v, k = F.col("value"), (F.col("frame_id") % 7).cast("double")
    out = f.select(
        "frame_id", fn.sigmoid((v - 50) / 10).alias("stable"), fn.sigmoid_clipped(v - 50).alias("clipped"), fn.linear_score({"a": v / 100, "b": k}, {"a": 1.5, "b": -0.2}, 0.1).alias("linear"),
        fn.in_range(v, 10.0, 60.0, 0.3, 0.1).alias("likelihood"), fn.decibel(v - 20).alias("db"), fn.from_decibel(v / 50).alias("power"), fn.sigma_confidence(k).alias("confidence"), fn.root_sum_square(v / 100, k / 10).alias("tolerance"),
        fn.linearised_sigma(F.array(v, k), F.array(F.lit(0.1), F.lit(2.0))).alias("sigma"), fn.blended(v, k).alias("blend"), fn.gaussian_log_density(v, 50.0, 20.0).alias("density"), fn.bound_distance(v, F.lit(20.0), F.lit(60.0)).alias("outside"),
        fn.clamp(v, 5.0, 80.0).alias("clamped"),
    )
    return _r(out, *out.columns[1:])


def _available(s, d):
    l = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax")
    return _r(l.select("l_orderkey", "l_linenumber", fn.available_mean(l.columns, {"l_discount": 0.5, "l_tax": 0.3, "absent": 0.2}).alias("mean")), "mean")


def _buckets(s, d):
    v, t = F.col("value"), F.col("frame_id") % 100
    duct = fn.duct_regime(-v * 3, v / 20, v / 100)
    gate = fn.kinematic_gate(v, F.when(F.col("frame_id") % 11 > 0, v * 3), F.when(F.col("frame_id") % 3 > 0, v / 10), {"speed": (0.0, 90.0), "altitude": (0.0, 200.0), "accel": (0.0, 5.0)})
    return _r(frames(s, d).select(
        "frame_id", fn.phase_of(t.cast("double"), F.col("label_id") == 1).alias("phase"), fn.range_band(v * 150).alias("band"), fn.speed_class(v - 1, {"slow": (0.0, 20.0), "cruise": (30.0, 60.0)}).alias("speed"),
        fn.modality(F.col("event_type"), {"cl": "touch", "vi": "sight"}).alias("modality"), fn.boost_state(v / 3 - 3).alias("boost"), duct["regime"].alias("duct"), duct["height_m"].alias("height"), gate.alias("gate"), F.coalesce(fn.fidelity_rank(F.concat(F.lit("F"), F.col("frame_id") % 8)), F.lit(-1)).alias("fidelity"),
    ), "height")


def _parsing(s, d):
    k = F.col("o_orderkey")
    text = F.when(k % 5 == 0, k.cast("string")).when(k % 5 == 1, F.concat((k % 9).cast("string"), F.lit(".5"))).when(k % 5 == 2, F.lit("x y")).when(k % 5 == 3, F.lit(" "))
    o = table(s, d, "orders").withColumn("t", text)
    did = fn.detection_id(F.concat(F.lit("r"), k.cast("string"), F.when(k % 2 == 0, F.lit(":m:frame")).otherwise(F.lit(":m:step")), (k % 30).cast("string")))
    return o.select(
        "o_orderkey", fn.safe_int(F.col("t"), -1).alias("whole"), F.round(fn.safe_float(F.col("t"), -1.0), 6).alias("number"), F.round(fn.finite(F.col("t")), 6).alias("finite"), F.round(fn.first_filled(F.col("t"), F.col("o_totalprice"), default=0.0), 6).alias("filled"),
        fn.flag(F.when(k % 3 == 0, "TRUE").when(k % 3 == 1, "yes")).alias("flag"), fn.metric_text(F.when(k % 4 > 0, F.col("o_totalprice"))).alias("metric"), F.array_join(fn.number_list(F.concat_ws(",", F.col("t"), F.lit(" 7"), F.lit("z"))).cast("array<string>"), ";").alias("numbers"),
        fn.last_segments(F.concat_ws(".", "o_orderstatus", "o_orderpriority", k.cast("string"))).alias("segments"), did["model_id"].alias("model"), F.coalesce(did["frame_index"], F.lit(-1)).cast("long").alias("frame"), fn.valid_probability(F.col("o_totalprice") / 300000).alias("probability"),
        fn.valid_slug(F.lower("o_orderpriority")).alias("slug"), fn.filled(F.col("t")).alias("any_text"), F.coalesce(fn.u64_mod(F.lit("18446744073709551557").cast("decimal(20,0)") - k.cast("decimal(20,0)"), 1000), F.lit(0)).alias("u64"),
    )


def _identity(s, d):
    p = table(s, d, "part").select("p_partkey", "p_brand", "p_size", "p_type")
    json = fn.canonical_json({"size": F.col("p_size"), "brand": F.col("p_brand"), "key": F.col("p_partkey")})
    return p.select("p_partkey", json.alias("json"), fn.fingerprint(json).alias("fingerprint"), fn.deterministic_id("part", F.lower(F.col("p_brand")), json).alias("id"), fn.map_json(F.create_map(F.lit("z"), F.col("p_size"), F.lit("a"), F.lit(1))).alias("map"))


def _globs(s, d):
    u = table(s, d, "pages").select("page_id", F.concat(F.lit("qa/"), F.when(F.col("page_id") % 2 == 0, "deep/").otherwise(""), F.lit("model_eval_"), F.col("page_id").cast("string"), F.lit(".json")).alias("path"))
    return u.select("page_id", *[F.col("path").rlike(fn.glob_regex(g)).alias(n) for n, g in (("flat", "qa/model_eval_*.json"), ("deep", "qa/**/model_eval_*.json"), ("one", "qa/model_eval_?.json"), ("tail", "**.json"))])


def _lookup(s, d):
    l = table(s, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c"), (F.col("o_custkey") + 1).alias("c2"))
    r = table(s, d, "customer").select((F.col("c_custkey") * 4).alias("c_custkey"), F.col("c_mktsegment").alias("segment"))  # keys apart: most orders miss
    out = J.lookup(l, r.withColumnRenamed("c_custkey", "c"), ["c"], "segment", "none").withColumnRenamed("segment", "direct")
    return J.fallback_lookup(out, r, ["c", "c2"], "c_custkey", "segment").select("o_orderkey", "direct", F.col("segment").alias("fallback"))


def _checked(s, d):
    n, r = table(s, d, "nation"), table(s, d, "region")
    one = J.one_to_one(n.select("n_nationkey", "n_name"), n.select("n_nationkey", "n_regionkey"), ["n_nationkey"])
    return J.require_all(one.withColumnRenamed("n_regionkey", "r_regionkey"), r, ["r_regionkey"]).select("n_nationkey", "n_name", "r_name")


def _first_match(s, d):
    c = table(s, d, "customer").select("c_nationkey", F.col("c_custkey").alias("id"), F.lit("customer").alias("root"))
    p = table(s, d, "supplier").select((F.col("s_nationkey") * 3).alias("c_nationkey"), F.col("s_suppkey").alias("id"), F.lit("supplier").alias("root"))
    return J.first_match([p, c], ["c_nationkey"])


def _first_wins(s, d):
    return J.last_by_key(table(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], "o_orderkey", first=True)


def _asof(s, d):
    f = frames(s, d)
    left = f.where("event_type = 'purchase'").select("record_id", "frame_id", (F.col("time_s") * 1000 + F.col("frame_id") / 1e6).alias("t"))
    right = f.where("event_type = 'view'").select("record_id", (F.col("time_s") * 1000 + F.col("frame_id") / 1e6).alias("t"), "value")
    return _r(J.asof_nearest(left, right, ["record_id"], "t", "value").select("frame_id", "value"), "value")


def _chain(s, d):
    """Lines to orders to strata: the stratum's rate, the status's where the stratum is unseen, else that of all."""
    g = groups(s, d).select("group_id", "line", "stratum", "status", "label_id")
    train = F.col("group_id") % 10 < 6
    g = J.target_encode(g, train & (F.col("stratum") != "1-URGENT"), ["stratum", "status"], "label_id", "near")
    per = g.where(train & (F.col("stratum") != "1-URGENT")).groupBy("stratum", "status").agg(F.count("*").alias("seen"))
    g = J.target_encode(g, train, ["status"], "label_id", "far").join(F.broadcast(per), ["stratum", "status"], "left")
    return _r(g.select("group_id", "line", F.when(F.col("seen") > 0, F.col("near")).otherwise(F.col("far")).alias("rate")), "rate")


def _first_truth(s, d):
    """Two keys at once, the first row of the match, a default where there is none."""
    e = table(s, d, "events").select("user_id", "event_type", "event_id", "value")
    first = J.last_by_key(e, ["user_id", "event_type"], "event_id", first=True).select(F.col("user_id").alias("u"), F.col("event_type").alias("t"), "value")
    ask = table(s, d, "customer").select("c_custkey", (F.col("c_custkey") % 200).alias("u"), F.element_at(F.array(F.lit("click"), F.lit("view"), F.lit("none")), (F.col("c_custkey") % 3 + 1).cast("int")).alias("t"))
    return _r(ask.join(first, ["u", "t"], "left").select("c_custkey", F.coalesce("value", F.lit(-1.0)).alias("value")), "value")


def _method_families(s, d):
    """False alarms per method and family: scored negatives joined with their groups, a blank family its own."""
    x = scored(s, d).where("label_id = 0")
    return x.groupBy("method", F.when(F.col("group_id") == "", "none").otherwise(F.col("group_id")).alias("family")).agg(F.count("*").alias("n"), F.count_if(F.col("score") >= 0.5).alias("fp"))


def _grid(s, d):
    """Every cell of a configuration grid but those left out, and every class with every sensor."""
    r, n = table(s, d, "region").select("r_name"), table(s, d, "nation").select("n_name")
    return F.broadcast(r.where("r_name <> 'ASIA'")).crossJoin(F.broadcast(n)).select(F.col("r_name").alias("regime"), F.col("n_name").alias("variant"))


def _prior(s, d):
    p = table(s, d, "part").groupBy("p_brand").agg(F.avg("p_retailprice").alias("prior"), F.count("*").alias("n")).where("n > 70").select(F.col("p_brand").alias("family"), "prior")
    l = table(s, d, "part").select("p_partkey", F.col("p_brand").alias("family"))
    return _r(J.lookup(l, p, ["family"], "prior", 1000.0).select("p_partkey", "prior"), "prior")


QUERIES = {
    "scalar_scores": _scores,
    "available_mean": _available,
    "scalar_buckets": _buckets,
    "scalar_parsing": _parsing,
    "canonical_identity": _identity,
    "glob_match": _globs,
    "lookup_fallback": _lookup,
    "checked_joins": _checked,
    "first_match_roots": _first_match,
    "first_wins_index": _first_wins,
    "asof_last_value": _asof,
    "stratum_chain": _chain,
    "two_key_lookup": _first_truth,
    "method_family_alarms": _method_families,
    "configuration_grid": _grid,
    "prior_lookup": _prior,
    "derived_features": lambda s, d: _r((lambda f, x: f.select("frame_id", *[c.alias(n) for n, c in x.items()]))(frames(s, d), fn.derived_features(F.col("value"), F.lit(40.0), F.col("value") / 2, F.lit(3.0), (F.col("frame_id") % 5).cast("double"), (F.col("value"), F.col("value") / 3, F.lit(2.0)))), "cfar_margin", "snr_minus_noise", "track_evidence", "energy_ratio"),
    "solver_status": lambda s, d: frames(s, d).select("frame_id", S.solver_status(F.col("value") - 50, F.when(F.col("frame_id") % 9 > 0, F.col("frame_id") % 13 + 5.0)).alias("status")),
}

_V, _K = "value", "CAST(frame_id % 7 AS DOUBLE)"
_TEXT = "CASE o_orderkey % 5 WHEN 0 THEN CAST(o_orderkey AS VARCHAR) WHEN 1 THEN (o_orderkey % 9) || '.5' WHEN 2 THEN 'x y' WHEN 3 THEN ' ' END"

ORACLE_SQL = {
    "scalar_scores": f"""WITH {FRAMES}, x AS (SELECT frame_id, value AS v, {_K} AS k FROM frames) SELECT frame_id, round(1 / (1 + exp(-(v - 50) / 10)), 9) AS stable, round(1 / (1 + exp(-greatest(-40, least(40, v - 50)))), 9) AS clipped,
round(1 / (1 + exp(-(0.1e0 + 1.5e0 * v / 100 - 0.2e0 * k))), 9) AS "linear", CAST(CASE WHEN v BETWEEN 10 AND 60 THEN 0.3 ELSE 0.1 END AS DOUBLE) AS likelihood, round(10 * log10(greatest(v - 20, 1e-12)), 9) AS db, round(pow(10, v / 500), 9) AS "power",
round(1 / (1 + pow(k / 3, 2)), 9) AS confidence, round(least(3, greatest(0.1e0, sqrt(pow(v / 100, 2) + pow(k / 10, 2)))), 9) AS tolerance, round(sqrt(pow(v * 0.1e0, 2) + pow(k * 2, 2)), 9) AS sigma, round(0.55e0 * v + 0.45e0 * k, 9) AS blend,
round(-0.5e0 * pow((v - 50) / 20, 2) - ln(20) - 0.5e0 * ln(2 * pi()), 9) AS density, round(CASE WHEN v BETWEEN 20 AND 60 THEN 0 ELSE least(abs(v - 20), abs(v - 60)) END, 9) AS outside, round(least(80, greatest(5, v)), 9) AS clamped FROM x""",
    "available_mean": "SELECT l_orderkey, l_linenumber, round(l_discount * (0.5e0 / 0.8e0) + l_tax * (0.3e0 / 0.8e0), 9) AS mean FROM lineitem",
    "scalar_buckets": f"""WITH {FRAMES}, x AS (SELECT frame_id, value AS v, frame_id % 100 AS t, label_id, event_type FROM frames) SELECT frame_id, CASE WHEN label_id <> 1 THEN 'background' WHEN t < 8 THEN 'boost' WHEN t < 18 THEN 'climb' WHEN t < 72 THEN 'cruise' ELSE 'terminal' END AS phase,
CASE WHEN v * 150 < 2500 THEN 'near' WHEN v * 150 < 6000 THEN 'mid' WHEN v * 150 < 11000 THEN 'far' ELSE 'edge' END AS band, CASE WHEN v - 1 < 0 THEN NULL WHEN v - 1 BETWEEN 0 AND 20 THEN 'slow' WHEN v - 1 BETWEEN 30 AND 60 THEN 'cruise' ELSE 'ambiguous' END AS speed,
CASE WHEN event_type LIKE 'cl%' THEN 'touch' WHEN event_type LIKE 'vi%' THEN 'sight' ELSE 'mixed' END AS modality, CASE WHEN v / 3 - 3 BETWEEN 10 AND 30 THEN 'boost_burn' WHEN v / 3 - 3 >= 0 AND v / 3 - 3 < 1 THEN 'sustain' WHEN v / 3 - 3 >= -2 AND v / 3 - 3 < 5 THEN 'separation' ELSE 'sustain' END AS boost,
CASE WHEN -v * 3 < -157 AND v / 20 > 2 THEN 'surface' WHEN v / 100 > 0.7e0 AND v / 100 < 0.95e0 THEN 'evaporation' ELSE 'none' END AS duct,
round(CASE WHEN -v * 3 < -157 AND v / 20 > 2 THEN 25 + (-157 - greatest(-400, least(-157, -v * 3))) / 243e0 * 75 WHEN v / 100 > 0.7e0 AND v / 100 < 0.95e0 THEN greatest(5, least(40, 5 + 35 * (0.85e0 - v / 100))) END, 9) AS height,
v BETWEEN 0 AND 90 AND frame_id % 11 > 0 AND v * 3 BETWEEN 0 AND 200 AND (frame_id % 3 = 0 OR v / 10 BETWEEN 0 AND 5) AS gate, CAST(CASE WHEN frame_id % 8 < 6 THEN frame_id % 8 ELSE -1 END AS INTEGER) AS fidelity FROM x""",
    "scalar_parsing": f"""WITH x AS (SELECT *, {_TEXT} AS t FROM orders) SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN o_orderkey ELSE -1 END AS whole, round(coalesce(try_cast(t AS DOUBLE), -1), 6) AS number, round(try_cast(t AS DOUBLE), 6) AS finite,
round(coalesce(try_cast(nullif(trim(t), '') AS DOUBLE), o_totalprice), 6) AS filled, CASE WHEN o_orderkey % 3 = 0 THEN 1e0 ELSE 0e0 END AS flag, CASE WHEN o_orderkey % 4 > 0 THEN printf('%.6f', o_totalprice) ELSE '' END AS metric,
CASE o_orderkey % 5 WHEN 0 THEN o_orderkey || ';7' ELSE '7' END AS numbers, o_orderpriority || '.' || o_orderkey AS segments, CASE WHEN o_orderkey % 2 = 0 THEN 'm' END AS model, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 30 ELSE -1 END AS frame,
o_totalprice / 300000 BETWEEN 0 AND 1 AS probability, regexp_full_match(lower(o_orderpriority), '[a-z0-9]+(-[a-z0-9]+)*') AS slug, coalesce(trim(t) <> '', false) AS any_text, CAST((18446744073709551557::HUGEINT - o_orderkey) % 1000 AS BIGINT) AS u64 FROM x""",
    "canonical_identity": """WITH j AS (SELECT *, '{"brand":"' || p_brand || '","key":' || p_partkey || ',"size":' || p_size || '}' AS json FROM part), f AS (SELECT *, sha256(json) AS fp FROM j)
SELECT p_partkey, json, fp AS fingerprint, 'id:part:' || lower(p_brand) || ':' || substr(sha256('part|' || lower(p_brand) || '|1|' || fp), 1, 16) || ':1' AS id, '{"a":1,"z":' || p_size || '}' AS map FROM f""",
    "glob_match": "SELECT page_id, page_id % 2 <> 0 AS flat, true AS deep, page_id % 2 <> 0 AND page_id < 10 AS one, true AS tail FROM pages",
    "lookup_fallback": "WITH r AS (SELECT c_custkey * 4 AS c_custkey, c_mktsegment AS s FROM customer) SELECT o_orderkey, coalesce(a.s, 'none') AS direct, coalesce(a.s, b.s) AS fallback FROM orders LEFT JOIN r a ON o_custkey = a.c_custkey LEFT JOIN r b ON o_custkey + 1 = b.c_custkey",
    "checked_joins": "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey",
    "first_match_roots": "SELECT s_nationkey * 3 AS c_nationkey, s_suppkey AS id, 'supplier' AS root FROM supplier UNION ALL SELECT c_nationkey, c_custkey, 'customer' FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey * 3 FROM supplier)",
    "first_wins_index": "SELECT o_custkey, min(o_orderkey) AS o_orderkey, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY 1",
    "asof_last_value": f"WITH {FRAMES}, l AS (SELECT record_id, frame_id, time_s * 1000 + frame_id / 1e6 AS t FROM frames WHERE event_type = 'purchase'), r AS (SELECT record_id, time_s * 1000 + frame_id / 1e6 AS t, value FROM frames WHERE event_type = 'view') SELECT frame_id, round(value, 9) AS value FROM l ASOF LEFT JOIN r ON l.record_id = r.record_id AND l.t >= r.t",
    "stratum_chain": f"WITH {GROUPS}, t AS (SELECT * FROM grp WHERE group_id % 10 < 6), n AS (SELECT stratum, status, avg(label_id) AS a FROM t WHERE stratum <> '1-URGENT' GROUP BY 1, 2), f AS (SELECT status, avg(label_id) AS b FROM t GROUP BY 1) SELECT group_id, line, round(coalesce(a, b, (SELECT avg(label_id) FROM t), 0), 9) AS rate FROM grp LEFT JOIN n USING (stratum, status) LEFT JOIN f USING (status)",
    "two_key_lookup": "WITH f AS (SELECT user_id AS u, event_type AS t, arg_min(value, event_id) AS value FROM events GROUP BY 1, 2) SELECT c_custkey, round(coalesce(value, -1), 9) AS value FROM customer LEFT JOIN f ON u = c_custkey % 200 AND t = CASE c_custkey % 3 WHEN 0 THEN 'click' WHEN 1 THEN 'view' ELSE 'none' END",
    "method_family_alarms": f"WITH {SCORED} SELECT method, CASE WHEN group_id = '' THEN 'none' ELSE group_id END AS family, count(*) AS n, count(*) FILTER (score >= 0.5) AS fp FROM scored WHERE label_id = 0 GROUP BY 1, 2",
    "configuration_grid": "SELECT r_name AS regime, n_name AS variant FROM region CROSS JOIN nation WHERE r_name <> 'ASIA'",
    "prior_lookup": "WITH p AS (SELECT p_brand, avg(p_retailprice) AS prior FROM part GROUP BY 1 HAVING count(*) > 70) SELECT p_partkey, round(coalesce(prior, 1000), 9) AS prior FROM part LEFT JOIN p USING (p_brand)",
    "derived_features": f"WITH {FRAMES} SELECT frame_id, round(value - 40, 9) AS cfar_margin, round(value / 2 - 3, 9) AS snr_minus_noise, round(greatest(value - 40, 0) + frame_id % 5, 9) AS track_evidence, round(value / (1 + value / 3 + 2), 9) AS energy_ratio FROM frames",
    "solver_status": f"WITH {FRAMES} SELECT frame_id, CASE WHEN frame_id % 9 = 0 THEN 'fail' WHEN abs(value - 50) > 3 * (frame_id % 13 + 5) THEN 'fail' WHEN abs(value - 50) > frame_id % 13 + 5 THEN 'warn' ELSE 'pass' END AS status FROM frames",
}
