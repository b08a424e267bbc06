"""Queries on streams with durable sinks, commits, nested records, intervals and tolerant lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import streaming as St
from ..operators import arrays as A
from ..operators import intervals as I
from ..sources import commits as C
from ..sources import nested as N
from ..sources import table
from ..streaming import models as M
from .fixtures import FRAMES, SCORED, frames, scored
from .ranking import _r

DAY = 86_400_000_000
#: Hours after the first event at which files end, and how long the marked events are under way.
EDGES, DELAY_HOURS = (200, 400, 600), 72


def _replay(s, df, arrival="arrival", edges=None):
    """``df`` as a stream of four files, by arrival."""
    path = C.new_root(s, "replay")
    if edges is None:
        first = df.agg(F.min(arrival)).first()[0]
        edges = [first + h * 3_600_000_000 for h in EDGES]
    St.write_in_batches(df, path, arrival, edges)
    return St.replay(s, path)


def _late_events(s, d):
    e = table(s, d, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), "value")
    return e.withColumn("arrival", F.unix_micros("ts") + F.when(F.col("event_id") % 10 == 0, F.lit(DELAY_HOURS * 3_600_000_000)).otherwise(0))


def _closed_windows(s, d):
    """Daily windows in append mode: rows that come after their window is closed are dropped, windows still open at the end are not there."""
    w = St.windowed_counts(_replay(s, _late_events(s, d)), "ts", ["event_type"], "1 day", late="12 hours", value=F.col("value"))
    rows, _ = St.run_to_table(w, C.new_root(s, "windows"))
    return _r(rows.select(F.unix_micros("window.start").alias("start"), "event_type", "n", "total"), "total", digits=6)


def _matched(s, d):
    """Every click with the views of its user in the six hours after it."""
    e = table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("arrival", F.unix_micros("ts"))
    click = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("click_id"), F.col("ts").alias("clicked"), "arrival")
    view = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"), F.col("ts").alias("viewed"), "arrival")
    first = e.agg(F.min("arrival")).first()[0]
    edges = [first + h * 3_600_000_000 for h in EDGES]
    both = [_replay(s, x, "arrival", edges).drop("arrival") for x in (click, view)]
    rows, _ = St.run_to_table(St.matched(*both, ["user_id"], "clicked", "viewed", "6 hours"), C.new_root(s, "matched"))
    return rows.select("user_id", "click_id", "view_id")


def features(s, d):
    """Events as frames of detector features."""
    v, i = F.col("value"), F.col("frame_id")
    f = frames(s, d)
    return f.select(
        "record_id", (F.round(F.col("time_s") * 1000).cast("long") * 1_000_000 + i).alias("tick"), (v / 5).alias("snr_db"), (i % 9).cast("double").alias("track_s"), (v - 40).alias("rate_mps"),
        (i % 160).cast("double").alias("modulation"), (i % 23).cast("double").alias("area"), (i % 7 / 14).alias("clutter"), (i % 5 / 10).alias("interference"),
    )


def _models(s, d):
    return _r(M.run_models(features(s, d), "record_id", "tick", 0.5), "confidence", digits=10)


def _models_live(s, d):
    """The same from a stream of four batches."""
    f = features(s, d)
    first = f.agg(F.min("tick")).first()[0] or 0
    stream = _replay(s, f, "tick", [first + h * 3_600_000_000_000 for h in EDGES])
    rows, _ = St.run_to_table(M.models_stream(stream, "record_id", "tick", 0.5), C.new_root(s, "models"))
    return _r(rows, "confidence", digits=10)


def _committed(s, d):
    """Two commits of three tables each, of which the last is read, beside a stream that commits batch by batch."""
    o = table(s, d, "orders")
    root = C.new_root(s, "campaign")
    tables = lambda x: {"records": x.select("o_orderkey", "o_orderstatus"), "balance": x.groupBy("o_orderstatus").agg(F.count("*").alias("n")), "value": x.groupBy("o_orderpriority").agg(F.sum("o_totalprice").alias("total"))}
    C.write_root(tables(o.where("o_orderkey % 2 = 0")), root)
    C.write_root(tables(o), root)
    now, then = C.read_root(s, root), C.read_root(s, root, 0)
    live = C.new_root(s, "live")
    e = table(s, d, "events").withColumn("arrival", F.unix_micros(F.col("ts").cast("timestamp")))
    C.stream_to_root(_replay(s, e.select("event_id", "event_type", "arrival")), lambda b: {"all": b.select("event_id"), "kinds": b.groupBy("event_type").agg(F.count("*").alias("n"))}, live)
    row = lambda name, df, n, v: df.agg(F.lit(name).alias("name"), F.count("*").alias("rows"), F.sum(n).cast("double").alias("total"))
    out = row("records", now["records"], F.lit(1), None)
    for name, df, n in (("balance", now["balance"], F.col("n")), ("value", now["value"], F.round("total", 2)), ("first", then["records"], F.lit(1)), ("events", C.read_batches(s, live, "all"), F.lit(1)), ("kinds", C.read_batches(s, live, "kinds").groupBy("event_type").agg(F.sum("n").alias("n")), F.col("n"))):
        out = out.unionByName(row(name, df, n, None))
    return _r(out, "total", digits=1)


def _score_report(s, d):
    """Scores and their summary of each method as one commit, read back."""
    x = scored(s, d)
    root = C.new_root(s, "scores")
    C.write_root(C.score_tables(x), root)
    return _r(C.read_root(s, root)["summary"], "score_mean", "score_std", "brier")


def _nested(s, d):
    """Leaves of documents nested zero to four levels deep."""
    o = table(s, d, "customer")
    deep = F.concat(F.expr("repeat('{\"in\":[', cast(c_custkey % 5 as int))"), F.to_json(F.struct(F.col("c_custkey").alias("key"), F.array(F.col("c_nationkey"), F.lit(7)).alias("codes"), F.struct(F.col("c_mktsegment").alias("segment"), (F.col("c_acctbal") > 0).alias("owes")).alias("about"))), F.expr("repeat(']}', cast(c_custkey % 5 as int))"))
    return N.explode_paths(o.select("c_custkey", deep.alias("body")), "c_custkey", "body")


def _observations(s, d):
    e = table(s, d, "events").select(F.when(F.col("event_id") % 11 == 0, " ").otherwise(F.concat(F.lit(" "), "event_type")).alias("name"), F.when(F.col("event_id") % 13 == 0, "n/a").when(F.col("event_id") % 17 == 0, "NaN").otherwise(F.col("event_id").cast("string")).alias("value"))
    return N.observations(e, "name", "value")


def _overlaps(s, d):
    """Each user's clicks and views as intervals from seconds to hours, one in fifty of half a year."""
    f = frames(s, d).select("record_id", "frame_id", "event_type", F.col("time_s").alias("start"))
    f = f.withColumn("end", F.col("start") + F.when(F.col("frame_id") % 50 == 0, 15_000_000.0).otherwise(F.pow((F.col("frame_id") % 97).cast("double"), F.lit(2.0)) * 3))
    side = lambda kind: f.where(F.col("event_type") == kind).select("record_id", "frame_id", "start", "end")
    return I.interval_join(side("click"), side("view"), ["record_id"], base=60.0).select("record_id", "frame_id", "right_frame_id")


LIBRARY = [(k, noise, n, shape, A.alpha("ca", noise, n, 1e-3, shape)) for k, (noise, shape, n) in enumerate((noise, shape, n) for noise, shapes in (("weibull", (1.2, 2.0)), ("k", (0.8, 2.0)), ("log_normal", (0.5, 1.0))) for shape in shapes for n in (16, 24))]


def _lookup(s, d):
    """Factors for the settings that parts ask for, from a library with tolerances in shape and false-alarm rate."""
    p, k = table(s, d, "part"), F.col("p_partkey")
    asked = p.select(
        "p_partkey", F.element_at(F.array(F.lit("weibull"), F.lit("k"), F.lit("log_normal")), (k % 3 + 1).cast("int")).alias("noise"), F.when(k % 2 == 0, 16).otherwise(24).alias("cells"),
        (F.round(k % 40 / 20, 2) + F.when(k % 7 == 0, 0.001).otherwise(0.0)).alias("shape"), F.when(k % 4 == 0, 1.0005e-3).when(k % 4 == 1, 2e-3).otherwise(1e-3).alias("pfa"),
    )
    library = s.createDataFrame(LIBRARY, "entry int, noise string, cells int, shape double, alpha double").withColumn("pfa", F.lit(1e-3))
    return _r(I.tolerant_lookup(asked, library, ["noise", "cells"], {"shape": (0.005, False), "pfa": (0.001, True)}, "entry", "alpha", "factor").select("p_partkey", "factor"), "factor", digits=6)


QUERIES = {
    "closed_windows": _closed_windows,
    "matched_streams": _matched,
    "detector_models": _models,
    "detector_stream": _models_live,
    "committed_root": _committed,
    "score_report": _score_report,
    "nested_paths": _nested,
    "observation_groups": _observations,
    "interval_overlaps": _overlaps,
    "alpha_lookup": _lookup,
}

_UNIT = "greatest(0, least(1, {}))"
_MODELS = f"""WITH {FRAMES}, f AS (SELECT record_id, CAST(round(time_s * 1000) AS BIGINT) * 1000000 + frame_id AS tick, value / 5 AS snr, CAST(frame_id % 9 AS DOUBLE) AS track, abs(value - 40) AS speed, CAST(frame_id % 160 AS DOUBLE) AS mod, CAST(frame_id % 23 AS DOUBLE) AS area, frame_id % 7 / 14 AS clutter, frame_id % 5 / 10 AS rfi FROM frames),
c AS (SELECT record_id, tick, {_UNIT.format("0.12e0 + 0.58e0 * " + _UNIT.format("(snr - 5) / 14") + " + 0.35e0 * " + _UNIT.format("track / 4") + " - 0.35e0 * clutter - 0.25e0 * rfi")} AS cfar_tracker,
  {_UNIT.format("0.08e0 + CASE WHEN speed BETWEEN 35 AND 75 THEN 0.28e0 ELSE 0.04e0 END + CASE WHEN mod BETWEEN 25 AND 130 THEN 0.24e0 ELSE 0.05e0 END + CASE WHEN area BETWEEN 2 AND 18 THEN 0.18e0 ELSE 0.04e0 END + greatest(0, least(0.28e0, (snr - 4) / 18)) - 0.24e0 * clutter - 0.18e0 * rfi")} AS feature_tree,
  {_UNIT.format("0.42e0 * " + _UNIT.format("(snr - 3) / 18") + " + 0.28e0 * " + _UNIT.format("track / 6") + " + 0.18e0 * " + _UNIT.format("(speed - 20) / 55") + " + 0.12e0 * " + _UNIT.format("mod / 140") + " - 0.25e0 * rfi")} AS now FROM f),
t AS (SELECT *, {_UNIT.format("0.25e0 * now + 0.75e0 * avg(now) OVER (PARTITION BY record_id ORDER BY tick ROWS BETWEEN 15 PRECEDING AND CURRENT ROW)")} AS temporal FROM c),
l AS (UNPIVOT (SELECT record_id, tick, cfar_tracker, feature_tree, temporal FROM t) ON cfar_tracker, feature_tree, temporal INTO NAME model VALUE confidence),
h AS (SELECT *, confidence >= 0.5 AND lag(confidence) OVER (PARTITION BY record_id, model ORDER BY tick) >= 0.5 AS two FROM l),
g AS (SELECT *, min(CASE WHEN two THEN tick END) OVER (PARTITION BY record_id, model) AS first FROM h)
SELECT record_id, tick, model, round(confidence, 10) AS confidence, coalesce(tick = first, false) AS triggered FROM g"""

ORACLE_SQL = {
    "closed_windows": f"""WITH e AS (SELECT *, epoch_us(ts) AS t, epoch_us(ts) + CASE WHEN event_id % 10 = 0 THEN {DELAY_HOURS * 3600 * 10**6} ELSE 0 END AS arrival FROM events),
b AS (SELECT *, CAST(arrival > m + {EDGES[0]} * 3600000000 AS INTEGER) + CAST(arrival > m + {EDGES[1]} * 3600000000 AS INTEGER) + CAST(arrival > m + {EDGES[2]} * 3600000000 AS INTEGER) AS batch FROM e CROSS JOIN (SELECT min(arrival) AS m FROM e)),
top AS (SELECT batch, max(t) - 43200000000 AS reach FROM b GROUP BY 1), marks AS (SELECT batch, max(reach) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) AS mark FROM top),
w AS (SELECT b.*, t - t % {DAY} AS start FROM b), kept AS (SELECT w.* FROM w JOIN marks USING (batch) WHERE mark IS NULL OR start + {DAY} > mark)
SELECT start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM kept WHERE start + {DAY} <= (SELECT max(reach) FROM top) GROUP BY 1, 2""",
    "matched_streams": "SELECT a.user_id, a.event_id AS click_id, b.event_id AS view_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'view' AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 6 HOURS",
    "detector_models": _MODELS,
    "detector_stream": _MODELS,
    "committed_root": """SELECT 'records' AS name, count(*) AS rows, round(CAST(count(*) AS DOUBLE), 1) AS total FROM orders UNION ALL SELECT 'first', count(*), count(*) FROM orders WHERE o_orderkey % 2 = 0
UNION ALL SELECT 'balance', count(DISTINCT o_orderstatus), count(*) FROM orders UNION ALL SELECT 'value', count(*), round(sum(v), 1) FROM (SELECT round(sum(o_totalprice), 2) AS v FROM orders GROUP BY o_orderpriority)
UNION ALL SELECT 'events', count(*), count(*) FROM events UNION ALL SELECT 'kinds', count(DISTINCT event_type), count(*) FROM events""",
    "score_report": f"WITH {SCORED} SELECT method, count(*) AS records, count(*) FILTER (split_role = 'holdout') AS holdout, round(avg(score) FILTER (split_role = 'holdout'), 9) AS score_mean, round(stddev_pop(score) FILTER (split_role = 'holdout'), 9) AS score_std, round(CASE WHEN count(DISTINCT label_id) FILTER (split_role = 'holdout') > 1 THEN avg((score - label_id) * (score - label_id)) FILTER (split_role = 'holdout') END, 9) AS brier FROM scored GROUP BY 1",
    "nested_paths": "WITH c AS (SELECT *, '$' || repeat('.in[0]', CAST(c_custkey % 5 AS INTEGER)) AS p FROM customer) SELECT c_custkey, p || '.key' AS path, CAST(c_custkey AS VARCHAR) AS value FROM c UNION ALL SELECT c_custkey, p || '.codes[0]', CAST(c_nationkey AS VARCHAR) FROM c UNION ALL SELECT c_custkey, p || '.codes[1]', '7' FROM c UNION ALL SELECT c_custkey, p || '.about.segment', c_mktsegment FROM c UNION ALL SELECT c_custkey, p || '.about.owes', CASE WHEN c_acctbal > 0 THEN 'true' ELSE 'false' END FROM c",
    "observation_groups": "SELECT event_type AS observable, count(*) AS n, CAST(min(event_id) AS DOUBLE) AS low, CAST(max(event_id) AS DOUBLE) AS high, CAST(sum(event_id) AS DOUBLE) AS total FROM events WHERE event_id % 11 <> 0 AND event_id % 13 <> 0 AND event_id % 17 <> 0 GROUP BY 1",
    "interval_overlaps": f"WITH {FRAMES}, f AS (SELECT record_id, frame_id, event_type, time_s AS a, time_s + CASE WHEN frame_id % 50 = 0 THEN 15000000e0 ELSE pow(CAST(frame_id % 97 AS DOUBLE), 2) * 3 END AS b FROM frames) SELECT x.record_id, x.frame_id, y.frame_id AS right_frame_id FROM f x JOIN f y ON x.record_id = y.record_id AND x.event_type = 'click' AND y.event_type = 'view' AND x.a <= y.b AND y.a <= x.b",
    "alpha_lookup": "WITH lib(entry, noise, cells, shape, alpha) AS (VALUES " + ", ".join(f"({k}, '{noise}', {n}, {shape!r}::DOUBLE, {a!r}::DOUBLE)" for k, noise, n, shape, a in LIBRARY) + "), w AS (SELECT p_partkey, (['weibull', 'k', 'log_normal'])[p_partkey % 3 + 1] AS noise, CASE WHEN p_partkey % 2 = 0 THEN 16 ELSE 24 END AS cells, round(p_partkey % 40 / 20, 2) + CASE WHEN p_partkey % 7 = 0 THEN 0.001e0 ELSE 0e0 END AS shape, CASE WHEN p_partkey % 4 = 0 THEN 1.0005e-3 WHEN p_partkey % 4 = 1 THEN 2e-3 ELSE 1e-3 END AS pfa FROM part) SELECT p_partkey, round(arg_min(alpha, entry), 6) AS factor FROM w LEFT JOIN lib ON w.noise = lib.noise AND w.cells = lib.cells AND abs(w.shape - lib.shape) <= 0.005 AND abs(ln(w.pfa) - ln(1e-3)) <= 0.001 GROUP BY 1",
}
