"""Queries on the scored relation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ranking as R
from ..operators import statistics as S
from .fixtures import SCORED, scored

M = ["method"]


def _r(df: DataFrame, *cols: str, digits: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


SWEEP = f"""WITH {SCORED},
sw AS (SELECT method, score, sum(label_id) AS p, count(*) - sum(label_id) AS n FROM scored GROUP BY 1, 2),
c AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER (PARTITION BY method) AS pos, sum(n) OVER (PARTITION BY method) AS neg FROM sw WINDOW w AS (PARTITION BY method ORDER BY score DESC)),
m AS (SELECT *, tp / (tp + fp) AS precision, CASE WHEN pos > 0 THEN tp / pos ELSE 0 END AS recall, CASE WHEN neg > 0 THEN fp / neg ELSE 0 END AS fpr FROM c),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM m)
"""
ROWS = f"""WITH {SCORED},
o AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY score DESC, ord) AS seen, sum(label_id) OVER (PARTITION BY method ORDER BY score DESC, ord) AS hits FROM scored)
"""
_KEYED = """
k AS (SELECT *, 'all' AS phase FROM scored UNION ALL SELECT *, phase_id AS phase FROM scored WHERE split_role = 'holdout'),
a0 AS (SELECT method, split_role, phase, score, sum(label_id) AS p, count(*) - sum(label_id) AS n FROM k GROUP BY 1, 2, 3, 4),
a1 AS (SELECT *, sum(n) OVER (PARTITION BY method, split_role, phase ORDER BY score) - n AS nb FROM a0),
a AS (SELECT method, split_role, phase, CASE WHEN sum(p) * sum(n) > 0 THEN sum(p * (nb + n / 2)) / (sum(p) * sum(n)) END AS roc_auc FROM a1 GROUP BY 1, 2, 3),
"""

QUERIES = {
    "method_performance": lambda s, d: _r(R.method_performance(scored(s, d)), "threshold", "precision", "recall", "specificity", "accuracy", "f1", "fpr", "roc_auc"),
    "roc_auc_midrank": lambda s, d: _r(R.roc_auc(scored(s, d), M), "roc_auc"),
    "roc_auc_ordinal": lambda s, d: _r(R.roc_auc(scored(s, d), M, ties="ordinal", empty=0.5), "roc_auc"),
    "average_precision": lambda s, d: _r(R.average_precision(scored(s, d), M), "average_precision"),
    "roc_curve": lambda s, d: _r(R.roc_curve(scored(s, d), M), "fpr", "tpr", "threshold"),
    "pr_curve": lambda s, d: _r(R.pr_curve(scored(s, d), M), "recall", "precision", "threshold"),
    "recall_at_fpr": lambda s, d: _r(R.recall_at_fpr(scored(s, d), M, 0.1), "recall"),
    "threshold_at_precision": lambda s, d: _r(R.threshold_at_precision(scored(s, d), M, 0.87), "threshold"),
    "best_f1_lex": lambda s, d: _r(R.best_threshold(scored(s, d), M), "threshold", "f1"),
    "best_f1_low": lambda s, d: _r(R.best_threshold(scored(s, d), M, "lowest"), "threshold", "f1"),
    "operating_points": lambda s, d: _r(R.operating_points(scored(s, d), M), "pd_at_pfa", "pfa_at_pd"),
    "grid_points": lambda s, d: _r(R.grid_points(scored(s, d), M, [0.1, 0.25, 0.5, 0.75, 0.9]), "precision", "recall", "fpr"),
    "calibration_bins": lambda s, d: _r(R.calibration_bins(scored(s, d), M), "mean_score", "positive_rate"),
    "calibration_error": lambda s, d: _r(R.expected_calibration_error(scored(s, d), M), "ece", "brier"),
    "minmax_train_normalise": lambda s, d: _r(R.minmax_by_train(scored(s, d), M, F.col("split_role") == "train").select("record_id", "method", "scaled"), "scaled"),
    "metrics_by_phase": lambda s, d: _r(R.roc_auc(scored(s, d), ["method", "phase_id"], empty=0.5).join(R.average_precision(scored(s, d), ["method", "phase_id"], 0.0), ["method", "phase_id"]), "roc_auc", "average_precision"),
    "cross_fit_log_odds": lambda s, d: _r(_cross_fit(s, d), "log_odds", digits=6),
}


def _cross_fit(s, d) -> DataFrame:
    rows = scored(s, d).groupBy("record_id", "split_role", "cv_fold", "label_id").agg(F.max(F.when(F.col("method") == "length", F.col("score"))).alias("x1"), F.max(F.when(F.col("method") == "tied", F.col("score"))).alias("x2"))
    return S.cross_fit(rows, ["x1", "x2"]).select("record_id", "log_odds")


_CONF = """c0 AS (SELECT {keys}, count(*) FILTER (score >= threshold AND label_id = 1) AS tp, count(*) FILTER (score >= threshold AND label_id = 0) AS fp,
  count(*) FILTER (score < threshold AND label_id = 0) AS tn, count(*) FILTER (score < threshold AND label_id = 1) AS fn FROM {src} GROUP BY ALL),
c1 AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall, CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END AS specificity,
  (tp + tn) / (tp + fp + tn + fn) AS accuracy FROM c0),
c2 AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1, 1 - specificity AS fpr FROM c1)"""

ORACLE_SQL = {
    "method_performance": SWEEP.replace("FROM scored GROUP BY 1, 2)", "FROM scored WHERE split_role = 'train' GROUP BY 1, 2)") + f""", {_KEYED}
t AS (SELECT method, arg_max(score, (round(f1, 12), round(recall, 12), round(precision, 12), score)) AS threshold FROM f GROUP BY 1),
kt AS (SELECT k.*, t.threshold FROM k JOIN t USING (method)),
{_CONF.format(keys="method, split_role, phase, threshold", src="kt")}
SELECT method, split_role, phase, round(threshold, 9) AS threshold, tp, fp, tn, fn, round(precision, 9) AS precision, round(recall, 9) AS recall, round(specificity, 9) AS specificity, round(accuracy, 9) AS accuracy,
  round(f1, 9) AS f1, round(fpr, 9) AS fpr, round(roc_auc, 9) AS roc_auc FROM c2 JOIN a USING (method, split_role, phase)""",
    "roc_auc_midrank": SWEEP + "SELECT method, round(sum(p * (neg - fp + n / 2)) / (max(pos) * max(neg)), 9) AS roc_auc FROM f GROUP BY 1",
    "roc_auc_ordinal": f"WITH {SCORED}, o AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY score, ord) AS r, sum(label_id) OVER (PARTITION BY method ORDER BY score, ord) AS h FROM scored) SELECT method, round(sum(label_id * (r - h)) / (sum(label_id) * sum(1 - label_id)), 9) AS roc_auc FROM o GROUP BY 1",
    "average_precision": ROWS + "SELECT method, round(sum(CASE WHEN label_id = 1 THEN hits / seen ELSE 0 END) / sum(label_id), 9) AS average_precision FROM o GROUP BY 1",
    "roc_curve": SWEEP + ", e AS (SELECT method, max(score) AS hi, min(score) AS lo FROM scored GROUP BY 1) SELECT method, round(fpr, 9) AS fpr, round(recall, 9) AS tpr, round(score, 9) AS threshold FROM f UNION ALL SELECT method, 0, 0, round(hi + 1e-12, 9) FROM e UNION ALL SELECT method, 1, 1, round(lo - 1e-12, 9) + 0 FROM e",
    "pr_curve": SWEEP + "SELECT method, round(recall, 9) AS recall, round(precision, 9) AS precision, round(score, 9) AS threshold FROM f",
    "recall_at_fpr": SWEEP + "SELECT method, round(coalesce(max(recall) FILTER (fpr <= 0.1), 0), 9) AS recall FROM f GROUP BY 1",
    "threshold_at_precision": ROWS + "SELECT method, round(coalesce(min(score) FILTER (hits / seen >= 0.87), 1), 9) AS threshold FROM o GROUP BY 1",
    "best_f1_lex": SWEEP + "SELECT method, round(arg_max(score, (round(f1, 12), round(recall, 12), round(precision, 12), score)), 9) AS threshold, round(arg_max(f1, (round(f1, 12), round(recall, 12), round(precision, 12), score)), 9) AS f1 FROM f GROUP BY 1",
    "best_f1_low": SWEEP + "SELECT method, round(arg_max(score, (round(f1, 12), -score)), 9) AS threshold, round(arg_max(f1, (round(f1, 12), -score)), 9) AS f1 FROM f GROUP BY 1",
    "operating_points": SWEEP + "SELECT method, round(coalesce(max(recall) FILTER (fpr <= 0.01), 0), 9) AS pd_at_pfa, round(coalesce(min(fpr) FILTER (recall >= 0.8), 1), 9) AS pfa_at_pd FROM f GROUP BY 1",
    "grid_points": f"WITH {SCORED}, k AS (SELECT method, label_id, score, CAST(t AS DOUBLE) AS threshold FROM scored CROSS JOIN (VALUES (0.1), (0.25), (0.5), (0.75), (0.9)) g(t)), {_CONF.format(keys='method, threshold', src='k')} SELECT method, threshold, round(precision, 9) AS precision, round(recall, 9) AS recall, round(fpr, 9) AS fpr FROM c2",
    "calibration_bins": f"WITH {SCORED}, b AS (SELECT method, least(CAST(floor(score * 10) AS INTEGER), 9) AS bin, score, label_id FROM scored WHERE score BETWEEN 0 AND 1), q AS (SELECT method, bin, count(*) AS n, avg(score) AS ms, avg(label_id) AS pr FROM b GROUP BY 1, 2) SELECT m.method, CAST(i AS INTEGER) AS bin, coalesce(n, 0) AS n, round(coalesce(ms, 0), 9) AS mean_score, round(coalesce(pr, 0), 9) AS positive_rate FROM (SELECT DISTINCT method FROM scored) m CROSS JOIN range(10) r(i) LEFT JOIN q ON q.method = m.method AND q.bin = i",
    "calibration_error": f"WITH {SCORED}, b AS (SELECT method, least(CAST(floor(score * 10) AS INTEGER), 9) AS bin, count(*) AS n, avg(score) AS ms, avg(label_id) AS pr FROM scored WHERE score BETWEEN 0 AND 1 GROUP BY 1, 2), t AS (SELECT method, count(*) AS c, avg(pow(score - label_id, 2)) AS brier FROM scored GROUP BY 1) SELECT b.method, round(sum(n * abs(pr - ms)) / max(c), 9) AS ece, round(max(brier), 9) AS brier FROM b JOIN t USING (method) GROUP BY 1",
    "minmax_train_normalise": f"WITH {SCORED}, r AS (SELECT method, min(score) FILTER (split_role = 'train') AS lo, max(score) FILTER (split_role = 'train') AS hi FROM scored GROUP BY 1) SELECT record_id, s.method, round(least(greatest(CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 0 END, 0), 1), 9) AS scaled FROM scored s JOIN r USING (method)",
    "metrics_by_phase": f"WITH {SCORED}, g AS (SELECT method, phase_id, score, sum(label_id) AS p, count(*) - sum(label_id) AS n FROM scored GROUP BY 1, 2, 3), h AS (SELECT *, sum(n) OVER (PARTITION BY method, phase_id ORDER BY score) - n AS nb FROM g), a AS (SELECT method, phase_id, CASE WHEN sum(p) * sum(n) > 0 THEN sum(p * (nb + n / 2)) / (sum(p) * sum(n)) ELSE 0.5 END AS auc FROM h GROUP BY 1, 2), o AS (SELECT *, row_number() OVER w AS seen, sum(label_id) OVER w AS hits FROM scored WINDOW w AS (PARTITION BY method, phase_id ORDER BY score DESC, ord)), b AS (SELECT method, phase_id, CASE WHEN sum(label_id) > 0 THEN sum(CASE WHEN label_id = 1 THEN hits / seen ELSE 0 END) / sum(label_id) ELSE 0 END AS ap FROM o GROUP BY 1, 2) SELECT method, phase_id, round(auc, 9) AS roc_auc, round(ap, 9) AS average_precision FROM a JOIN b USING (method, phase_id)",
    "cross_fit_log_odds": f"""WITH {SCORED}, x AS (SELECT record_id, split_role, cv_fold, label_id, max(score) FILTER (method = 'length') AS x1, max(score) FILTER (method = 'tied') AS x2 FROM scored GROUP BY ALL),
tr AS (SELECT * FROM x WHERE split_role = 'train'),
fits AS (SELECT f.fold, tr.* FROM tr JOIN (SELECT DISTINCT cv_fold AS fold FROM tr) f ON tr.cv_fold <> f.fold UNION ALL SELECT -1, tr.* FROM tr),
s AS (SELECT fold, count(*) FILTER (label_id = 1) AS p, count(*) FILTER (label_id = 0) AS n, avg(x1) FILTER (label_id = 1) AS a1, avg(x1) FILTER (label_id = 0) AS a0, var_pop(x1) AS va, avg(x2) FILTER (label_id = 1) AS b1, avg(x2) FILTER (label_id = 0) AS b0, var_pop(x2) AS vb FROM fits GROUP BY 1),
w AS (SELECT fold, (a1 - a0) / (va + 1e-3) AS w1, (b1 - b0) / (vb + 1e-3) AS w2, ln((p + 1) / (n + 1)) - (a1 - a0) / (va + 1e-3) * (a1 + a0) / 2 - (b1 - b0) / (vb + 1e-3) * (b1 + b0) / 2 AS b FROM s)
SELECT record_id, round(x1 * w1 + x2 * w2 + b, 6) AS log_odds FROM x JOIN w ON w.fold = CASE WHEN split_role = 'train' THEN cv_fold ELSE -1 END""",
}
