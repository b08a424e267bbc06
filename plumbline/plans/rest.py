"""Queries on tiers, clusters of failures, arrays and record expansion."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import arrays as A
from ..operators import frames as W
from ..operators import grouping as G
from ..operators import ranking as R
from ..operators import splits as L
from ..operators import statistics as S
from ..operators import tracking as T
from ..sources import table
from .fixtures import FRAMES, KEYS, ORDER, SCORED, frames, scored
from .ranking import _r


def _arrays(s, d):
    f = frames(s, d).groupBy("record_id").agg(F.transform(F.sort_array(F.collect_list(F.struct(*ORDER, "value"))), lambda x: x["value"]).alias("a"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda t, x: t + x)
    a = F.col("a")
    return _r(f.select("record_id", A.argmax_last(a).alias("argmax"), A.lower_quartile_mean(a).alias("low_mean"), A.fftshift(a)[0].alias("shifted"), total(A.resample(a, 3)).alias("resampled")), "low_mean", "shifted", "resampled", digits=6)


def _failures(s, d):
    x = scored(s, d).where("label_id = 0").groupBy("method").agg(F.count("*").alias("negative_records"))
    f = scored(s, d).where("label_id = 0 and score >= 0.5").groupBy("method", "group_id").agg(F.count("*").alias("n")).groupBy("method").agg(F.map_from_entries(F.collect_list(F.struct("group_id", "n"))).alias("false_alarms"))
    return _r(G.failure_clusters(x.join(f, "method").withColumnRenamed("method", "model_id"), 0.05).drop("negatives"), "fp_rate")


def _tiers(s, d):
    f = frames(s, d).select("record_id", "label_id", F.element_at(F.array(F.lit("boost"), F.lit("climb"), F.lit("cruise")), (F.col("frame_id") % 3 + 1).cast("int")).alias("tier"), (F.col("value") > 70).alias("detected"))
    return _r(G.tier_metrics(f, ["boost", "climb", "cruise", "none"]), "rate")


def _decisions(s, d):
    c = A.cfar(frames(s, d), KEYS, ORDER, "value", train=4, guard=1, pfa=0.2)
    return _r(T.decisions_to_tracks(c.withColumn("at", F.col("time_s") * 1000 + F.col("frame_id") / 1e6), KEYS, "at", "value").select("record_id", "frame_id", "track_id", "confidence"), "confidence", digits=6)


QUERIES = {
    "array_picks": _arrays,
    "failure_clusters": _failures,
    "tier_metrics": _tiers,
    "least_tier": lambda s, d: G.least_tier(table(s, d, "orders").select("o_custkey", F.when(F.col("o_orderkey") % 6 > 0, F.col("o_orderpriority")).alias("tier")).where("o_custkey % 2 = 0 or tier is not null"), "o_custkey", "tier", {"1-URGENT": 4, "2-HIGH": 3, "3-MEDIUM": 2, "4-NOT SPECIFIED": 1, "5-LOW": 0}),
    "cell_tracks": _decisions,
    "trailing_values": lambda s, d: W.trailing(frames(s, d), KEYS, ORDER, "frame_id", 4).select("frame_id", F.array_join(F.transform("trailing", lambda x: x.cast("string")), ",").alias("last_ids")),
    "modulo_split": lambda s, d: table(s, d, "part").select("p_partkey", L.modulo_split(F.col("p_partkey")).alias("split")),
    "expanded_phases": lambda s, d: L.expand_phases(table(s, d, "customer").select("c_custkey"), "c_custkey", [("early", 0.0, 5.0), ("late", 5.0, 12.5)], shard=64),
    "calibration_five_bins": lambda s, d: _r(R.calibration_bins(scored(s, d), ["method"], bins=5), "mean_score", "positive_rate"),
    "split_metrics": lambda s, d: _r(R.roc_auc(scored(s, d), ["method", "split_role"], empty=0.5).join(scored(s, d).groupBy("method", "split_role").agg(F.count("*").alias("n"), F.avg("label_id").alias("positive_rate")), ["method", "split_role"]), "roc_auc", "positive_rate"),
    "log_odds_weights": lambda s, d: _r(S.log_odds_weights(scored(s, d).where("split_role = 'train'"), ["method"], ["score", "n_chars"]), "w_score", "w_n_chars", "intercept", digits=6),
}

ORACLE_SQL = {
    "array_picks": f"WITH {FRAMES}, l AS (SELECT record_id, list(value ORDER BY time_s, frame_id) AS a FROM frames GROUP BY 1), m AS (SELECT *, len(a) AS n, greatest(1, len(a) // 4) AS k, list_sort(a) AS b FROM l) SELECT record_id, CAST(n - list_position(list_reverse(a), list_max(a)) AS INTEGER) AS argmax, round(list_sum(b[1:k]) / k, 6) AS low_mean, round(a[(n + 1) // 2 % n + 1], 6) AS shifted, round(a[1] + a[n] + a[(n - 1) // 2 + 1] + ((n - 1) / 2 - (n - 1) // 2) * (a[least((n - 1) // 2 + 2, n)] - a[(n - 1) // 2 + 1]), 6) AS resampled FROM m",
    "failure_clusters": f"WITH {SCORED}, n AS (SELECT sum(c) AS c FROM (SELECT count(*) AS c FROM scored WHERE label_id = 0 GROUP BY method HAVING count(*) FILTER (score >= 0.5) > 0)), f AS (SELECT group_id AS family, count(*) AS k FROM scored WHERE label_id = 0 AND score >= 0.5 GROUP BY 1) SELECT family, k AS false_positives, round(k / c, 9) AS fp_rate FROM f CROSS JOIN n WHERE k / c > 0.05",
    "tier_metrics": f"WITH {FRAMES}, x AS (SELECT record_id, label_id, (['boost', 'climb', 'cruise'])[frame_id % 3 + 1] AS tier, bool_or(value > 70) AS hit FROM frames GROUP BY 1, 2, 3), g AS (SELECT tier, label_id, count(*) AS r, count(*) FILTER (hit) AS h FROM x GROUP BY 1, 2) SELECT t.tier, CAST(y.label_id AS INTEGER) AS label_id, coalesce(r, 0) AS records, coalesce(h, 0) AS detected_records, round(coalesce(h / r, 0), 9) AS rate FROM (VALUES ('boost'), ('climb'), ('cruise'), ('none')) t(tier) CROSS JOIN (VALUES (0), (1)) y(label_id) LEFT JOIN g ON g.tier = t.tier AND g.label_id = y.label_id",
    "least_tier": "WITH o AS (SELECT o_custkey, CASE WHEN o_orderkey % 6 > 0 THEN o_orderpriority END AS t FROM orders), p AS (SELECT * FROM o WHERE o_custkey % 2 = 0 OR t IS NOT NULL) SELECT o_custkey, CASE WHEN count(*) > count(t) THEN 'unvalidated' ELSE max(t) END AS least_tier FROM p GROUP BY 1",
    "cell_tracks": f"WITH {FRAMES}, c AS (SELECT *, avg(value) OVER l AS a, avg(value) OVER r AS b, count(*) OVER l AS na, count(*) OVER r AS nb FROM frames WINDOW l AS (PARTITION BY record_id ORDER BY time_s, frame_id ROWS BETWEEN 5 PRECEDING AND 2 PRECEDING), r AS (PARTITION BY record_id ORDER BY time_s, frame_id ROWS BETWEEN 2 FOLLOWING AND 5 FOLLOWING)), t AS (SELECT *, CAST({A.cell_average_alpha(4, 0.2)!r} AS DOUBLE) * (a + b) / 2 AS th FROM c WHERE na = 4 AND nb = 4) SELECT record_id, frame_id, row_number() OVER (PARTITION BY record_id ORDER BY time_s * 1000 + frame_id / 1e6) - 1 AS track_id, round(value / th, 6) AS confidence FROM t WHERE value > th",
    "trailing_values": f"WITH {FRAMES}, l AS (SELECT frame_id, list(frame_id) OVER (PARTITION BY record_id ORDER BY time_s, frame_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS v FROM frames) SELECT frame_id, array_to_string(v, ',') AS last_ids FROM l",
    "modulo_split": "SELECT p_partkey, CASE WHEN p_partkey % 20 < 3 THEN 'test' WHEN p_partkey % 20 < 6 THEN 'validation' ELSE 'train' END AS split FROM part",
    "expanded_phases": "WITH g AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS g FROM customer), p(i, phase_id, phase_start_s, phase_end_s) AS (VALUES (0, 'early', 0e0, 5e0), (1, 'late', 5e0, 12.5e0)), x AS (SELECT *, g * 2 + i AS r FROM g CROSS JOIN p) SELECT c_custkey, phase_id, phase_start_s, phase_end_s, r AS record_index, r // 64 AS shard_index, r % 64 AS row_offset, CAST(phase_start_s * 1e9 AS BIGINT) AS timestamp_start_ns, CAST(phase_end_s * 1e9 AS BIGINT) AS timestamp_end_ns FROM x",
    "calibration_five_bins": f"WITH {SCORED}, b AS (SELECT method, least(CAST(floor(score * 5) AS INTEGER), 4) AS bin, count(*) AS n, avg(score) AS ms, avg(label_id) AS pr FROM scored WHERE score BETWEEN 0 AND 1 GROUP BY 1, 2), m AS (SELECT DISTINCT method FROM scored) SELECT m.method, CAST(i AS INTEGER) AS bin, coalesce(n, 0) AS n, round(coalesce(ms, 0), 9) AS mean_score, round(coalesce(pr, 0), 9) AS positive_rate FROM m CROSS JOIN range(5) t(i) LEFT JOIN b ON b.method = m.method AND b.bin = i",
    "split_metrics": f"WITH {SCORED}, g AS (SELECT method, split_role, score, sum(label_id) AS p, count(*) - sum(label_id) AS n FROM scored GROUP BY 1, 2, 3), h AS (SELECT *, sum(n) OVER (PARTITION BY method, split_role ORDER BY score) - n AS nb FROM g) SELECT method, split_role, round(CASE WHEN sum(p) * sum(n) > 0 THEN sum(p * (nb + n / 2)) / (sum(p) * sum(n)) ELSE 0.5 END, 9) AS roc_auc, CAST(sum(p + n) AS BIGINT) AS n, round(sum(p) / sum(p + n), 9) AS positive_rate FROM h GROUP BY 1, 2",
    "log_odds_weights": f"WITH {SCORED}, s AS (SELECT method, count(*) FILTER (label_id = 1) AS p, count(*) FILTER (label_id = 0) AS n, avg(score) FILTER (label_id = 1) AS a1, avg(score) FILTER (label_id = 0) AS a0, var_pop(score) AS va, avg(n_chars) FILTER (label_id = 1) AS b1, avg(n_chars) FILTER (label_id = 0) AS b0, var_pop(n_chars) AS vb FROM scored WHERE split_role = 'train' GROUP BY 1), w AS (SELECT *, (a1 - a0) / (va + 1e-3) AS w1, (b1 - b0) / (vb + 1e-3) AS w2 FROM s) SELECT method, round(w1, 6) AS w_score, round(w2, 6) AS w_n_chars, round(ln((p + 1) / (n + 1)) - w1 * (a1 + a0) / 2 - w2 * (b1 + b0) / 2, 6) AS intercept FROM w",
}
