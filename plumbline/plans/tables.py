"""Queries on groups, joins, splits and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import grouping as G
from ..operators import joining as J
from ..operators import splits as L
from ..operators import statistics as S
from ..sources import table, unpivot, upsert
from .fixtures import GROUPS, SCORED, groups, scored
from .ranking import _r

DIMS = ["stratum", "status", "label"]


def _overlay(s, d):
    left = table(s, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("ord_id"), F.col("o_orderstatus").alias("mark"), "o_totalprice")
    c = table(s, d, "customer")
    right = c.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("key"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("mark"), F.col("c_acctbal").alias("balance"), F.col("c_custkey").alias("ord"))
    return J.overlay(left, right, "key", "ord").select("ord_id", "key", "mark", "o_totalprice", "balance")


def _target(s, d):
    o = table(s, d, "orders").join(table(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    rows = o.select("o_orderkey", F.col("c_nationkey").alias("nation"), F.col("o_orderpriority").alias("priority"), (F.col("o_totalprice") > 150000).cast("int").alias("y"))
    return _r(J.target_encode(rows, (F.col("o_orderkey") % 10 < 7) & (F.col("nation") % 5 > 0), ["nation", "priority"], "y", "encoded").select("o_orderkey", "encoded"), "encoded")


def _alarms(s, d):
    g = groups(s, d).join(table(s, d, "part").select(F.col("p_partkey").alias("partkey"), F.col("p_brand").alias("family")), "partkey", "left")
    return _r(G.false_alarms(g, "family", 0.7), "mean_score", "p95_score", "max_score")


def _labelled(s, d):
    return groups(s, d).withColumn("label", F.col("label_id").cast("string"))


def _marginals(s, d):
    u = {"records": F.lit(1), "positives": F.col("label_id")}
    return G.marginals(_labelled(s, d), ["label"], ["stratum", "status"], u)


def _lines(s, d):
    return unpivot(table(s, d, "lineitem"), ["l_orderkey", "l_linenumber", "l_returnflag"], {"l_quantity": ("quantity", "1"), "l_discount": ("discount", "share"), "l_tax": ("tax", "share")})


def _draws_auc(s, d):
    rows = groups(s, d).where("label_id is not null").select("group_id", "label_id", "score")
    return _r(S.bootstrap_ci(rows), "low", "mean", "high")


def _docs(s, d):
    return table(s, d, "documents").select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"))


def _leak(s, d):
    docs = _docs(s, d).withColumn("family", F.concat_ws("-", "lang", (F.col("doc_id") % 50).cast("string")))
    return L.leakage_report(docs.withColumn("split", fn.sha_split(F.col("doc_id").cast("string"))), ["source", "family"], "split", "doc_id")


def _fnv(s, d):
    return L.hash_split(_docs(s, d), ["lang", "source"]).select("doc_id", "split", fn.fnv1a_mod(fn.protected_key(["lang", "source"])).cast("long").alias("bucket"))


def _wilson(s, d):
    w = fn.wilson(F.col("k"), F.col("n"))
    e = table(s, d, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 50).alias("k"), F.count("*").alias("n"))
    return _r(e.select("event_type", "k", "n", w["low"].alias("low"), w["high"].alias("high")), "low", "high")


def _gates(s, d):
    e = table(s, d, "events").agg(F.avg("value").alias("mean_value"), F.count("*").cast("double").alias("events"), F.avg(F.when(F.col("value") > 1e12, 1.0)).alias("absent"))
    return _r(S.gates(e, {"mean": ("mean_value", ">=", 0.0), "count": ("events", ">=", 100.0), "missing": ("absent", "<=", 1.0), "small": ("mean_value", "<=", 1.0)}), "value")


def _anchors(s, d):
    e = table(s, d, "events").select(F.col("event_type").alias("feature"), "value")
    a = e.sparkSession.createDataFrame([("click", 40.0, 30.0), ("view", 1e6, 1.0), ("nothing", 1.0, 1.0)], "feature string, target double, tolerance double")
    return _r(S.anchored_gate(a, e), "distance", digits=6)


def _upsert(s, d):
    n = table(s, d, "nation").select("n_nationkey", "n_name", F.lit(0).alias("version"))
    return upsert(n, n.where("n_nationkey % 4 = 1 or n_nationkey = 3").withColumn("version", F.lit(1)), ["n_nationkey"])


QUERIES = {
    "overlay_join": _overlay,
    "target_encode_fallback": _target,
    "false_alarm_breakdown": _alarms,
    "marginal_counts": _marginals,
    "scenario_balance": lambda s, d: G.balance_cube(_labelled(s, d), DIMS),
    "entropy_imbalance": lambda s, d: _r(G.normalised_entropy(table(s, d, "orders"), ["o_orderstatus"], "o_orderpriority"), "entropy", "imbalance"),
    "group_operating_metrics": lambda s, d: G.group_operating(groups(s, d), "group_id", 0.8, ["stratum"]),
    "counts_by_key": lambda s, d: G.counts_by(table(s, d, "orders"), ["o_orderstatus", "o_orderpriority"]),
    "column_stats": lambda s, d: _r(G.column_stats(table(s, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"], F.col("l_orderkey") % 5 > 0), "mean", "std", "min", "max", digits=5),
    "unpivot_observations": _lines,
    "distribution_summary": lambda s, d: _r(G.distribution_summary(_lines(s, d), ["observable", "l_returnflag"], "value"), "mean", "std", "min", "q10", "q25", "q50", "q75", "q90", "max", digits=6),
    "bootstrap_group_ci": _draws_auc,
    "hash_split": _fnv,
    "sha_split": lambda s, d: _docs(s, d).select("doc_id", fn.sha_split(F.col("doc_id").cast("string")).alias("split"), fn.sample_id(F.col("lang"), F.col("doc_id").cast("string")).alias("sample_id")),
    "leakage_report": _leak,
    "stratified_topn_by_hash": lambda s, d: L.top_by_hash(table(s, d, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderstatus"], "o_orderkey", 0.15),
    "fold_assign": lambda s, d: L.folds(table(s, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey"),
    "quota_split": lambda s, d: L.quota_split(table(s, d, "customer").select("c_custkey"), "c_custkey"),
    "wilson_ci": _wilson,
    "realism_gate": _gates,
    "anchored_gate": _anchors,
    "upsert_by_key": _upsert,
    "json_path_props": lambda s, d: table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.json_object_keys("props").alias("keys")).select("event_id", "k", F.array_join(F.array_sort("keys"), ",").alias("keys")),
    "text_scalars": lambda s, d: table(s, d, "part").select("p_partkey", fn.slug(F.col("p_name")).alias("slug"), fn.humanised(fn.slug(F.col("p_name"))).alias("human"), fn.range_band(F.col("p_retailprice"), (1000.0, 1300.0, 1700.0)).alias("band"), fn.decision(F.col("p_size") / 50.0).alias("decision")),
}

_KEYHASH = "CAST(('0x' || substr(md5('1|{tag}|' || {id}), 1, 13)) AS BIGINT)"

ORACLE_SQL = {
    "overlay_join": """WITH r AS (SELECT c_custkey AS key, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS mark, c_acctbal AS balance FROM customer WHERE c_custkey % 3 <> 0)
SELECT o_orderkey AS ord_id, o_custkey AS key, CASE WHEN r.key IS NOT NULL THEN r.mark ELSE o_orderstatus END AS mark, o_totalprice, balance FROM orders LEFT JOIN r ON o_custkey = r.key""",
    "target_encode_fallback": """WITH x AS (SELECT o_orderkey, c_nationkey AS nation, o_orderpriority AS priority, CAST(o_totalprice > 150000 AS INTEGER) AS y FROM orders JOIN customer ON o_custkey = c_custkey),
t AS (SELECT * FROM x WHERE o_orderkey % 10 < 7 AND nation % 5 > 0), m AS (SELECT nation, priority, avg(y) AS a FROM t GROUP BY 1, 2)
SELECT o_orderkey, round(coalesce(a, (SELECT avg(y) FROM t), 0), 9) AS encoded FROM x LEFT JOIN m USING (nation, priority)""",
    "false_alarm_breakdown": f"WITH {GROUPS} SELECT p_brand AS family, count(*) AS n, count(*) FILTER (score >= 0.7) AS fp, count(*) FILTER (score >= CAST(0.7 AS DOUBLE) - CAST(0.05 AS DOUBLE) AND score < 0.7) AS near_threshold, round(avg(score), 9) AS mean_score, round(quantile_cont(score, 0.95), 9) AS p95_score, round(max(score), 9) AS max_score FROM grp LEFT JOIN part ON partkey = p_partkey WHERE label_id = 0 GROUP BY 1",
    "marginal_counts": f"WITH {GROUPS} SELECT CAST(label_id AS VARCHAR) AS label, 'stratum' AS dimension, stratum AS value, count(*) AS records, CAST(sum(label_id) AS BIGINT) AS positives FROM grp GROUP BY ALL UNION ALL SELECT CAST(label_id AS VARCHAR), 'status', status, count(*), CAST(sum(label_id) AS BIGINT) FROM grp GROUP BY ALL",
    "scenario_balance": f"WITH {GROUPS}, g AS (SELECT stratum, status, CAST(label_id AS VARCHAR) AS label FROM grp) SELECT stratum, status, label, CASE grouping_id(stratum, status, label) WHEN 3 THEN 'stratum' WHEN 5 THEN 'status' WHEN 6 THEN 'label' ELSE 'joint' END AS level, count(*) AS n FROM g GROUP BY GROUPING SETS ((stratum, status, label), (stratum), (status), (label))",
    "entropy_imbalance": "WITH c AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2), p AS (SELECT *, n / sum(n) OVER (PARTITION BY o_orderstatus) AS p FROM c), e AS (SELECT o_orderstatus, count(*) AS k, sum(-p * log2(p + 1e-12)) / greatest(log2(count(*) + 1e-12), 1e-12) AS h FROM p GROUP BY 1) SELECT o_orderstatus, k, round(CASE WHEN k <= 1 THEN 0 ELSE h END, 9) AS entropy, round(1 - CASE WHEN k <= 1 THEN 0 ELSE h END, 9) AS imbalance FROM e",
    "group_operating_metrics": f"WITH {GROUPS}, g AS (SELECT stratum, group_id, max(label_id) AS y, bool_or(score >= 0.8) AS hit FROM grp GROUP BY 1, 2) SELECT stratum, count(*) FILTER (hit AND y = 1) AS tp, count(*) FILTER (hit AND y = 0) AS fp, count(*) FILTER (NOT hit AND y = 0) AS tn, count(*) FILTER (NOT hit AND y = 1) AS fn FROM g GROUP BY 1",
    "counts_by_key": "SELECT coalesce(o_orderstatus, '') AS o_orderstatus, coalesce(o_orderpriority, '') AS o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2",
    "column_stats": " UNION ALL ".join(f"SELECT '{c}' AS name, round(avg({c}), 5) AS mean, round(stddev_pop({c}), 5) AS std, round(min({c}), 5) AS min, round(max({c}), 5) AS max FROM lineitem WHERE l_orderkey % 5 > 0" for c in ("l_quantity", "l_extendedprice", "l_discount")),
    "unpivot_observations": " UNION ALL ".join(f"SELECT l_orderkey, l_linenumber, l_returnflag, '{o}' AS observable, '{u}' AS unit, {c} AS value FROM lineitem WHERE isfinite({c})" for c, o, u in (("l_quantity", "quantity", "1"), ("l_discount", "discount", "share"), ("l_tax", "tax", "share"))),
    "distribution_summary": "WITH u AS (" + " UNION ALL ".join(f"SELECT l_returnflag, '{o}' AS observable, {c} AS v FROM lineitem" for c, o in (("l_quantity", "quantity"), ("l_discount", "discount"), ("l_tax", "tax"))) + ") SELECT observable, l_returnflag, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(min(v), 6) AS min, " + ", ".join(f"round(quantile_cont(v, {q}), 6) AS q{int(q * 100)}" for q in (0.1, 0.25, 0.5, 0.75, 0.9)) + ", round(max(v), 6) AS max FROM u GROUP BY 1, 2",
    "bootstrap_group_ci": f"""WITH {GROUPS},
gs AS (SELECT group_id, row_number() OVER (ORDER BY group_id) AS no, count(*) OVER () AS n FROM (SELECT DISTINCT group_id FROM grp)),
d0 AS (SELECT r AS round, n, ((no - 1) % 2147483647 * 1103515245 + (r * 1640531527 + 5) % 2147483647) % 2147483647 AS z FROM gs CROSS JOIN range(200) x(r)),
d1 AS (SELECT round, n, xor(z, z >> 15) * 1181783497 % 2147483647 AS z FROM d0),
dr AS (SELECT round, xor(z, z >> 15) * 668265263 % 2147483647 % n + 1 AS no FROM d1),
w AS (SELECT round, group_id, count(*) AS w FROM dr JOIN gs USING (no) GROUP BY 1, 2),
per AS (SELECT group_id, score, sum(label_id) AS p, count(*) - sum(label_id) AS n FROM grp GROUP BY 1, 2),
b AS (SELECT round, score, CAST(sum(p * w) AS DOUBLE) AS p, CAST(sum(n * w) AS DOUBLE) AS n FROM per JOIN w USING (group_id) GROUP BY 1, 2),
c AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER (PARTITION BY round) AS pos, sum(n) OVER (PARTITION BY round) AS neg FROM b WINDOW w AS (PARTITION BY round ORDER BY score DESC)),
m AS (SELECT round, sum(p * (neg - fp + n / 2)) / (max(pos) * max(neg)) AS roc_auc, sum(CASE WHEN p > 0 THEN p * tp / (tp + fp) ELSE 0 END) / max(pos) AS ap, sum(p * pow(score - 1, 2) + n * pow(score, 2)) / (max(pos) + max(neg)) AS brier,
  max(CASE WHEN fp / neg <= 0.01 THEN tp / pos ELSE 0 END) AS reach FROM c WHERE pos > 0 AND neg > 0 GROUP BY 1),
k AS (SELECT round, least(floor(score * 10), 9) AS bin, sum(p) - sum(score * (p + n)) AS gap, max(pos + neg) AS size FROM c GROUP BY 1, 2),
e AS (SELECT round, sum(abs(gap)) / max(size) AS ece FROM k GROUP BY 1),
l AS (SELECT 'roc_auc' AS metric, roc_auc AS v FROM m UNION ALL SELECT 'average_precision', ap FROM m UNION ALL SELECT 'brier', brier FROM m UNION ALL SELECT 'recall_at_fpr', reach FROM m UNION ALL SELECT 'ece', ece FROM e)
SELECT metric, round(quantile_cont(v, 0.025), 9) AS low, round(avg(v), 9) AS mean, round(quantile_cont(v, 0.975), 9) AS high, count(v) AS rounds FROM l GROUP BY 1""",
    "sha_split": "WITH b AS (SELECT doc_id, coalesce(lang, '') AS lang, CAST(('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) % 10 AS b FROM documents) SELECT doc_id, CASE WHEN b < 6 THEN 'train' WHEN b < 8 THEN 'validation' ELSE 'test' END AS split, substr(sha256(lang || '|' || doc_id), 1, 24) AS sample_id FROM b",
    "hash_split": """WITH k AS (SELECT doc_id, 'lang=' || coalesce(lang, '') || '|source=' || coalesce(source, '') AS t FROM documents),
h AS (SELECT doc_id, list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(1, len(t) + 1), lambda i: ascii(t[i])::HUGEINT)), lambda a, b: xor(a, b) * 1099511628211::HUGEINT % 18446744073709551616::HUGEINT) % 10000 AS h FROM k)
SELECT doc_id, CASE WHEN h < 7000 THEN 'train' WHEN h < 8500 THEN 'validation' ELSE 'test' END AS split, CAST(h AS BIGINT) AS bucket FROM h""",
    "leakage_report": """WITH b AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') || '-' || (doc_id % 50) AS family, CAST(('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) % 10 AS b FROM documents),
s AS (SELECT *, CASE WHEN b < 6 THEN 0 WHEN b < 8 THEN 1 ELSE 2 END AS r FROM b),
l AS (SELECT 'source' AS key, source AS value, r, doc_id FROM s UNION ALL SELECT 'family', family, r, doc_id FROM s),
p AS (SELECT key, value, r, count(*) AS n, min(doc_id) AS least FROM l GROUP BY 1, 2, 3),
q AS (SELECT *, min(r) OVER (PARTITION BY key, value) AS r0, arg_min(least, r) OVER (PARTITION BY key, value) AS l0 FROM p)
SELECT key, value, ['train', 'validation', 'test'][r0 + 1] AS first_split, ['train', 'validation', 'test'][r + 1] AS other_split, l0 AS first_id, least AS other_id, n AS rows FROM q WHERE r <> r0""",
    "stratified_topn_by_hash": f"WITH r AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_KEYHASH.format(tag='cell', id='o_orderkey')}, o_orderkey) AS k, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders) SELECT o_orderkey, o_orderstatus FROM r WHERE k <= least(greatest(round_even(n * CAST(0.15 AS DOUBLE), 0), ceil(n * CAST(0.1 AS DOUBLE))), greatest(floor(n * CAST(0.2 AS DOUBLE)), 1))",
    "fold_assign": f"SELECT o_orderkey, o_orderpriority, CAST((row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_KEYHASH.format(tag='fold', id='o_orderkey')}, o_orderkey) - 1) % 5 AS INTEGER) AS fold FROM orders",
    "quota_split": f"WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY {_KEYHASH.format(tag='quota', id='c_custkey')}, c_custkey) AS k, count(*) OVER () AS n FROM customer) SELECT c_custkey, CASE WHEN k <= round_even(n * CAST(0.7 AS DOUBLE), 0) THEN 'train' WHEN k <= round_even(n * CAST(0.7 AS DOUBLE), 0) + round_even(n * CAST(0.15 AS DOUBLE), 0) THEN 'validation' ELSE 'test' END AS split FROM r",
    "wilson_ci": "WITH e AS (SELECT event_type, count(*) FILTER (value > 50) AS k, count(*) AS n, CAST(1.959963984540054 AS DOUBLE) AS z FROM events GROUP BY 1) SELECT event_type, k, n, round(greatest(0, (k / n + z * z / (2 * n) - z * sqrt((k / n * (1 - k / n) + z * z / (4 * n)) / n)) / (1 + z * z / n)), 9) AS low, round(least(1, (k / n + z * z / (2 * n) + z * sqrt((k / n * (1 - k / n) + z * z / (4 * n)) / n)) / (1 + z * z / n)), 9) AS high FROM e",
    "realism_gate": "WITH e AS (SELECT avg(value) AS m, CAST(count(*) AS DOUBLE) AS c FROM events) SELECT 'mean' AS gate, round(m, 9) AS value, CAST(0 AS DOUBLE) AS bound, m >= 0 AS passed FROM e UNION ALL SELECT 'count', c, 100, c >= 100 FROM e UNION ALL SELECT 'missing', NULL, 1, false FROM e UNION ALL SELECT 'small', round(m, 9), 1, m <= 1 FROM e",
    "anchored_gate": "WITH a(feature, target, tolerance) AS (VALUES ('click', CAST(40 AS DOUBLE), CAST(30 AS DOUBLE)), ('view', 1e6, 1), ('nothing', 1, 1)), o AS (SELECT event_type AS feature, count(value) AS samples, avg(value) AS m FROM events GROUP BY 1) SELECT feature, target, tolerance, coalesce(samples, 0) AS samples, CASE WHEN samples > 0 THEN round(abs(m - target), 6) ELSE CAST('inf' AS DOUBLE) END AS distance, coalesce(samples, 0) >= 32 AND coalesce(abs(m - target) <= tolerance, false) AS passed FROM a LEFT JOIN o USING (feature)",
    "upsert_by_key": "SELECT n_nationkey, n_name, CASE WHEN n_nationkey % 4 = 1 OR n_nationkey = 3 THEN 1 ELSE 0 END AS version FROM nation",
    "json_path_props": "SELECT event_id, json_extract_string(props, '$.k') AS k, array_to_string(list_sort(json_keys(props)), ',') AS keys FROM events",
    "text_scalars": "WITH s AS (SELECT *, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part) SELECT p_partkey, CASE WHEN slug = '' THEN 'pipeline' ELSE slug END AS slug, array_to_string(list_transform(list_filter(string_split(CASE WHEN slug = '' THEN 'pipeline' ELSE slug END, '-'), lambda w: w <> ''), lambda w: upper(w[1]) || w[2:]), ' ') AS human, CASE WHEN p_retailprice < 1000 THEN 'near' WHEN p_retailprice < 1300 THEN 'mid' WHEN p_retailprice < 1700 THEN 'far' ELSE 'edge' END AS band, CASE WHEN p_size / 50 BETWEEN CAST(0.4 AS DOUBLE) AND CAST(0.6 AS DOUBLE) THEN 'abstain' WHEN p_size / 50 > CAST(0.6 AS DOUBLE) THEN 'accept' ELSE 'reject' END AS decision FROM s",
}
