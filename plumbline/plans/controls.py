"""Queries on negative controls, slices and the metric bundle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import probes as P
from ..operators import ranking as R
from ..sources import table
from .fixtures import SCORED, scored
from .ranking import _r

GATE, SEED = 0.62, 20260518


def records(s, d):
    """Labelled documents with metadata, seeds and a role in turn by id."""
    j = table(s, d, "labels").select("doc_id", "quality").join(table(s, d, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id")
    i = F.col("doc_id")
    return j.select(
        i.alias("record_id"), F.when(i % 10 < 6, "train").when(i % 10 < 8, "validation").otherwise("test").alias("split"), F.col("quality").cast("int").alias("label"), "lang", "source", F.col("n_chars").cast("double").alias("n_chars"),
        (i * 7919 % 997).cast("double").alias("seed_a"), (i * 104729 % 991).cast("double").alias("seed_b"), F.element_at(F.array(F.lit("masked"), F.lit("absent"), F.lit("present")), (i % 3 + 1).cast("int")).alias("role"), (F.col("n_chars") % 60).cast("double").alias("phase"),
    ).withColumn("masked", (F.col("role") == "masked").cast("int"))


RECORDS = """rec AS (SELECT l.doc_id AS record_id, CASE WHEN l.doc_id % 10 < 6 THEN 'train' WHEN l.doc_id % 10 < 8 THEN 'validation' ELSE 'test' END AS split, CAST(quality AS INTEGER) AS label, lang, source, CAST(n_chars AS DOUBLE) AS n_chars,
  CAST(l.doc_id * 7919 % 997 AS DOUBLE) AS seed_a, CAST(l.doc_id * 104729 % 991 AS DOUBLE) AS seed_b, (['masked', 'absent', 'present'])[l.doc_id % 3 + 1] AS role, CAST(n_chars % 60 AS DOUBLE) AS phase FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


def _shuffled(s, d):
    return P.shuffled_labels(records(s, d), "record_id", "split", "label", SEED).select("record_id", "split", "label", "shuffled")


def _audit(designs, finite):
    def q(s, d):
        rows = P.shuffled_labels(records(s, d), "record_id", "split", "label", SEED)
        aucs = P.control_aucs(rows, designs)
        return aucs.crossJoin(F.broadcast(P.verdict(aucs, GATE, finite))).select("probe", F.round("auc", 4).alias("auc"), "gated", "status")

    return q


SEEDS = P.Probe("seed_only", "label", numeric=["seed_a", "seed_b"])
ROWS = P.Probe("row_index_only", "label", numeric=["record_id"])
SHUFFLED = P.Probe("shuffled_label", "shuffled", numeric=["n_chars", "phase"])
FIRST = [SEEDS, ROWS, P.Probe("metadata", "label", ["lang"], ["phase"]), SHUFFLED, P.Probe("masked", "masked", numeric=["n_chars", "phase"], rows="role <> 'present'"), P.Probe("family", "label", ["source", "role"], gated=False)]
SECOND = [P.Probe("allowed_metadata", "label", ["lang", "source"], ["phase"]), P.Probe("seed_hash", "label", numeric=["seed_a", "seed_b", "record_id"]), ROWS, SHUFFLED]


def _verdicts(s, d):
    """Both verdicts on the AUCs of every method and language, of which some have one class and no AUC."""
    aucs = R.roc_auc(scored(s, d), ["method", "phase_id", "cv_fold"]).select(F.concat_ws("/", "method", "phase_id", "cv_fold").alias("probe"), F.col("roc_auc").alias("auc"), (F.col("cv_fold") < 3).alias("gated"))
    both = P.verdict(aucs, GATE, True).withColumn("rule", F.lit("finite")).unionByName(P.verdict(aucs, GATE, False).withColumn("rule", F.lit("any")))
    return _r(both, "worst")


def _slices(s, d):
    unseen = ~F.col("phase_id").isin("en", "de")
    x = scored(s, d).where("split_role = 'holdout'")
    cuts = {"all": F.lit(True), "easy": F.col("n_chars") >= 1000, "hard": F.col("n_chars") < 1000, "unseen": unseen, "confuser": (F.col("label_id") == 1) | (F.col("cv_fold") == 2)}
    return _r(R.slice_metrics(x, ["method"], cuts), "roc_auc", "average_precision", "recall", "fpr", "f1")


def _bundle(s, d):
    return _r(R.metric_bundle(scored(s, d), ["method", "split_role"], 0.5), "roc_auc", "average_precision", "brier", "precision", "recall", "f1", "fpr", "balanced_accuracy")


QUERIES = {
    "shuffled_labels": _shuffled,
    "design_columns": lambda s, d: _r(P.design_columns(records(s, d), ["lang", "source", "role"], ["n_chars", "phase", "seed_a"]), "total", digits=3),
    "control_verdicts": _verdicts,
    "negative_controls": _audit(FIRST, True),
    "negative_controls_v2": _audit(SECOND, False),
    "slice_metrics": _slices,
    "metric_bundle": _bundle,
}

_BASE = """b AS (SELECT {keys}, count(*) AS n, sum(label_id) AS positives, avg((score - label_id) * (score - label_id)) AS brier, count(*) FILTER (score >= 0.5 AND label_id = 1) AS tp, count(*) FILTER (score >= 0.5 AND label_id = 0) AS fp, count(*) FILTER (score < 0.5 AND label_id = 1) AS fn, count(*) FILTER (score < 0.5 AND label_id = 0) AS tn FROM x GROUP BY ALL),
g AS (SELECT {keys}, score, sum(label_id) AS p, count(*) - sum(label_id) AS q FROM x GROUP BY ALL),
h AS (SELECT *, sum(q) OVER (PARTITION BY {keys} ORDER BY score) - q AS nb FROM g),
auc AS (SELECT {keys}, CASE WHEN sum(p) * sum(q) > 0 THEN sum(p * (nb + q / 2)) / (sum(p) * sum(q)) END AS roc_auc FROM h GROUP BY ALL),
o AS (SELECT {keys}, label_id, row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, ord) AS seen, sum(label_id) OVER (PARTITION BY {keys} ORDER BY score DESC, ord) AS hits FROM x),
ap AS (SELECT {keys}, CASE WHEN sum(label_id) > 0 THEN sum(CASE WHEN label_id = 1 THEN hits / seen ELSE 0 END) / sum(label_id) END AS average_precision FROM o GROUP BY ALL),
m AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall, 1 - CASE WHEN fp + tn > 0 THEN tn / (fp + tn) ELSE 0 END AS fpr FROM b),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM m)"""

ORACLE_SQL = {
    "shuffled_labels": f"WITH {RECORDS}, a AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY record_id) AS r FROM rec), b AS (SELECT split, label AS shuffled, row_number() OVER (PARTITION BY split ORDER BY CAST('0x' || substr(md5('{SEED}|' || record_id), 1, 13) AS BIGINT), record_id) AS r FROM rec) SELECT record_id, split, label, shuffled FROM a JOIN b USING (split, r)",
    "design_columns": f"WITH {RECORDS}, x AS (SELECT 'lang=' || coalesce(lang, 'None') AS feature, 1.0::DOUBLE AS v FROM rec UNION ALL SELECT 'source=' || coalesce(source, 'None'), 1 FROM rec UNION ALL SELECT 'role=' || role, 1 FROM rec UNION ALL SELECT 'n_chars', n_chars FROM rec UNION ALL SELECT 'phase', phase FROM rec UNION ALL SELECT 'seed_a', seed_a FROM rec) SELECT feature, count(*) FILTER (v <> 0) AS filled, round(sum(v), 3) AS total FROM x GROUP BY 1",
    "control_verdicts": f"WITH {SCORED}, g AS (SELECT method, phase_id, cv_fold, score, sum(label_id) AS p, count(*) - sum(label_id) AS q FROM scored GROUP BY 1, 2, 3, 4), h AS (SELECT *, sum(q) OVER (PARTITION BY method, phase_id, cv_fold ORDER BY score) - q AS nb FROM g), a AS (SELECT method || '/' || phase_id || '/' || cv_fold AS probe, CASE WHEN sum(p) * sum(q) > 0 THEN sum(p * (nb + q / 2)) / (sum(p) * sum(q)) END AS auc, cv_fold < 3 AS gated FROM h GROUP BY method, phase_id, cv_fold), r(rule, finite) AS (VALUES ('finite', true), ('any', false)), v AS (SELECT rule, round(max(auc) FILTER (gated), 9) AS worst, coalesce(string_agg(probe, '|' ORDER BY probe) FILTER (gated AND CASE WHEN auc IS NULL THEN finite ELSE auc > {GATE} END), '') AS failed FROM a CROSS JOIN r GROUP BY rule) SELECT CASE WHEN failed = '' THEN 'pass' ELSE 'fail' END AS status, worst, failed, rule FROM v",
    "slice_metrics": f"WITH {SCORED}, x AS (SELECT method, ord, label_id, score, unnest(list_filter([CASE WHEN true THEN 'all' END, CASE WHEN n_chars >= 1000 THEN 'easy' END, CASE WHEN n_chars < 1000 THEN 'hard' END, CASE WHEN phase_id NOT IN ('en', 'de') THEN 'unseen' END, CASE WHEN label_id = 1 OR cv_fold = 2 THEN 'confuser' END], lambda v: v IS NOT NULL)) AS slice FROM scored WHERE split_role = 'holdout'), {_BASE.format(keys='method, slice')} SELECT method, slice, n, CAST(positives AS BIGINT) AS positives, round(roc_auc, 9) AS roc_auc, round(average_precision, 9) AS average_precision, round(recall, 9) AS recall, round(fpr, 9) AS fpr, round(f1, 9) AS f1 FROM f JOIN auc USING (method, slice) JOIN ap USING (method, slice)",
    "metric_bundle": f"WITH {SCORED}, x AS (SELECT method, split_role, ord, label_id, score FROM scored), {_BASE.format(keys='method, split_role')} SELECT method, split_role, n, CAST(positives AS BIGINT) AS positives, tp, fp, fn, tn, round(roc_auc, 9) AS roc_auc, round(average_precision, 9) AS average_precision, round(brier, 9) AS brier, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, round(fpr, 9) AS fpr, round((recall + 1 - fpr) / 2, 9) AS balanced_accuracy FROM f JOIN auc USING (method, split_role) JOIN ap USING (method, split_role)",
}
