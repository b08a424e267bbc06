"""Queries that write a table in each format and scan it back, and queries on streams."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sources as X
from .. import streaming as St
from ..sources import table
from ..sources.commits import new_root
from .ranking import _r


def _new(spark: SparkSession) -> str:
    return new_root(spark, "stores")


def _csv(s, d):
    p = _new(s)
    X.write_csv(table(s, d, "customer"), p, ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"])
    return X.csv(s, p, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string", strict=True)


def _csv_text(s, d):
    p = _new(s)
    X.write_csv(table(s, d, "supplier").select("s_suppkey", "s_name", "s_nationkey"), p)
    rows = X.text_rows(s, p, ["s_suppkey", "s_name", "s_nationkey"])
    none = X.csv(s, f"{p}-absent", "s_suppkey string, s_name string, s_nationkey string", optional=True)
    return rows.unionByName(none)


def _jsonl(s, d):
    p = _new(s)
    X.write_jsonl(table(s, d, "part").select("p_partkey", "p_name", "p_retailprice"), p)
    return s.read.schema("p_partkey long, p_name string, p_retailprice double").json(p)


def _documents(s, d):
    """One JSON object a file, read whole and in order of path."""
    p = _new(s)
    table(s, d, "region").repartition(5, "r_regionkey").write.option("maxRecordsPerFile", 1).json(p)
    return X.json_documents(s, p, "r_regionkey int, r_name string").select("r_regionkey", "r_name")


def _cards(s, d):
    p = _new(s)
    n = table(s, d, "nation").select(F.concat(F.lit("kind"), F.col("n_regionkey").cast("string")).alias("kind"), F.lower("n_name").alias("public_proxy_id"), F.col("n_regionkey").alias("folder"))
    n.repartition(3).write.option("maxRecordsPerFile", 1).partitionBy("folder").json(p)
    found = X.discover(s, p, "*.json").groupBy("folder").agg(F.count("*").alias("files"))
    cards = X.cards(s, p).withColumn("folder", F.regexp_extract("path", r"(folder=[0-9]+)/", 1))
    return cards.join(found, "folder").select("kind", "slug", "files")


def _tensors(dtype):
    def q(s, d):
        p = _new(s)
        e = table(s, d, "embeddings").where("embedding is not null")
        v = F.transform("embedding", lambda x: x.cast("double"))
        v = F.transform(v, lambda x: (x > 0).cast("double")) if dtype == "|b1" else v
        half = 2 if dtype == "<c8" else 1
        shape = F.array(F.lit(4), (F.size("embedding") / 4 / half).cast("int"))
        X.write_tensors(e.select(F.concat(F.lit("t"), F.col("vec_id").cast("string")).alias("name"), shape.alias("shape"), v.alias("values")), p, dtype)
        t = X.tensors(s, p)
        return _r(t.select("name", F.array_join(F.transform("shape", lambda x: x.cast("string")), "x").alias("shape"), F.aggregate("values", F.lit(0.0), lambda a, x: a + x).alias("total"), F.col("values")[5].alias("sixth")), "total", "sixth", digits=5)

    return q


def _frame_store(s, d):
    """Records of 16 steps of 4 values in shards of 50; records then fetch their rows by shard and offset."""
    p = _new(s)
    e = table(s, d, "embeddings").where("embedding is not null and size(embedding) = 64").withColumn("values", F.transform("embedding", lambda x: x.cast("double")))
    e = e.select(F.floor(F.col("vec_id") / 50).cast("long").alias("shard"), F.col("vec_id").cast("string").alias("record_id"), "values")
    X.write_npz(e, p, "shard", "record_id", "values", (16, 4), ["a", "b", "c", "d"])
    store = X.npz_frames(s, p, "frames", "record_ids", "columns")
    index = store.where("time_index = 0").select("shard_path", "row_offset", "record_id")
    records = index.withColumn("place", F.col("record_id").cast("long")).drop("record_id")
    X.assert_aligned(index.select(F.col("record_id").cast("long").alias("place"), "record_id"), e.select(F.col("record_id").cast("long").alias("place"), "record_id"), "place", "record_id")
    return _r(X.gather(records, store, ["shard_path", "row_offset"], "place").select("place", "time_index", F.col("values")[1].alias("b"), F.element_at("columns", 2).alias("name")), "b", digits=5)


def _sequence(s, d):
    """Numbers written with 17 digits come back bit for bit."""
    p = _new(s)
    X.write_sequence(table(s, d, "events").select(F.col("event_id").cast("double").alias("id"), "value", (F.col("value") / 3).alias("third")), p)
    back = X.csv(s, p, "id double, value double, third double", strict=True)
    e = table(s, d, "events").select(F.col("event_id").cast("double").alias("id"), F.col("value").alias("v"))
    return back.join(e, "id").select(F.col("id").cast("long").alias("event_id"), ((F.col("value") == F.col("v")) & (F.col("third") == F.col("v") / 3)).alias("same"))


def _frames(s, d):
    f = table(s, d, "events").select("event_id", "user_id", F.array(*[(F.col("event_id") * k % 256).cast("int") for k in (1, 3, 7)]).alias("cells"))

    def back(parts):
        for b in parts:
            rows = [X.decode_frame(bytes(x)) for x in b["frame"]]
            yield pd.DataFrame({"event_id": [h["event_id"] for h, _ in rows], "user_id": [h["user_id"] for h, _ in rows], "total": [sum(c) for _, c in rows]})

    return X.encode_frames(f, ["event_id", "user_id"], "cells").mapInPandas(back, "event_id long, user_id long, total long")


def _partitioned(s, d):
    p = _new(s)
    X.write_partitioned(table(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), p, ["o_orderstatus"], 5000)
    return _r(s.read.parquet(p).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total")), "total", digits=2)


def _reports(s, d):
    r = table(s, d, "region").orderBy("r_regionkey")
    lines = table(s, d, "nation").select("n_name").unionByName(s.createDataFrame([("",), ("  ",)], "n_name string"))
    p = _new(s)
    lines.write.text(p)
    row = table(s, d, "orders").agg(F.count("*").alias("orders"), F.lit("x").alias("a"))
    return s.createDataFrame([("markdown", X.markdown(r, ["r_regionkey", "r_name"])), ("json", X.report_json(row)), ("lines", str(X.nonempty_lines(s, p)))], "kind string, body string")


def _events(s, d):
    return St.replay(s, f"{d}/events*.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def _run(s, stream: DataFrame) -> DataFrame:
    return St.run_to_table(stream, _new(s))[0]


def _complete(s, stream: DataFrame) -> DataFrame:
    """The last state of a stream of aggregates, each batch's written whole over the one before."""
    p = _new(s)
    q = stream.writeStream.outputMode("complete").foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{p}/rows")).option("checkpointLocation", f"{p}/progress").trigger(availableNow=True).start()
    q.awaitTermination()
    return s.read.schema(stream.schema).parquet(f"{p}/rows")


def _windowed(s, d):
    w = _complete(s, St.windowed_counts(_events(s, d), "ts", ["event_type"], "1 day", value=F.col("value")))
    return _r(w.select(F.unix_seconds("window.start").alias("start"), "event_type", "n", "total"), "total", digits=6)


def _sessions(s, d):
    w = _complete(s, St.sessions(_events(s, d), "ts", ["user_id"], "6 hours"))
    return w.select("user_id", F.unix_micros("session.start").alias("start"), "n")


def _trigger(s, d):
    e = _events(s, d).withColumn("tick", F.unix_micros("ts") * 1000 + F.col("event_id") % 1000)
    return _r(_run(s, St.trigger_stream(e, "user_id", "tick", "value", 50.0)), "value", digits=6)


QUERIES = {
    "csv_round_trip": _csv,
    "csv_text_rows": _csv_text,
    "jsonl_round_trip": _jsonl,
    "json_documents": _documents,
    "card_scan": _cards,
    "tensor_f32": _tensors("<f4"),
    "tensor_f64": _tensors("<f8"),
    "tensor_complex": _tensors("<c8"),
    "tensor_bool": _tensors("|b1"),
    "frame_store": _frame_store,
    "sequence_csv": _sequence,
    "frame_codec": _frames,
    "partitioned_sink": _partitioned,
    "report_sinks": _reports,
    "stream_windows": _windowed,
    "stream_sessions": _sessions,
    "stream_trigger": _trigger,
}


def _tensor_sql(shape: str, x: str = "CAST(x AS DOUBLE)") -> str:
    return f"WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: {x}) AS e FROM embeddings WHERE embedding IS NOT NULL) SELECT 't' || vec_id AS name, '{shape}' AS shape, round(list_sum(e), 5) AS total, round(e[6], 5) AS sixth FROM v"


ORACLE_SQL = {
    "csv_round_trip": "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer",
    "csv_text_rows": "SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name, CAST(s_nationkey AS VARCHAR) AS s_nationkey FROM supplier",
    "jsonl_round_trip": "SELECT p_partkey, p_name, p_retailprice FROM part",
    "json_documents": "SELECT r_regionkey, r_name FROM region",
    "card_scan": "SELECT 'kind' || n_regionkey AS kind, lower(n_name) AS slug, count(*) OVER (PARTITION BY n_regionkey) AS files FROM nation",
    "tensor_f32": _tensor_sql("4x16"),
    "tensor_f64": _tensor_sql("4x16"),
    "tensor_complex": _tensor_sql("4x8"),
    "tensor_bool": _tensor_sql("4x16", "CAST(x > 0 AS INTEGER)::DOUBLE"),
    "frame_store": "WITH t AS (SELECT vec_id, embedding, unnest(range(0, 16)) AS i FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) = 64) SELECT vec_id AS place, CAST(i AS INTEGER) AS time_index, round(CAST(embedding[i * 4 + 2] AS DOUBLE), 5) AS b, 'b' AS name FROM t",
    "sequence_csv": "SELECT event_id, true AS same FROM events",
    "frame_codec": "SELECT event_id, user_id, event_id % 256 + event_id * 3 % 256 + event_id * 7 % 256 AS total FROM events",
    "partitioned_sink": "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1",
    "report_sinks": "WITH w AS (SELECT max(len(r_name)) AS w FROM region) SELECT 'markdown' AS kind, '| r_regionkey | ' || rpad('r_name', CAST(max(w) AS INTEGER), ' ') || ' |' || chr(10) || '| ----------- | ' || repeat('-', max(w)) || ' |' || chr(10) || string_agg('| ' || rpad(CAST(r_regionkey AS VARCHAR), 11, ' ') || ' | ' || rpad(r_name, CAST(w AS INTEGER), ' ') || ' |', chr(10) ORDER BY r_regionkey) || chr(10) AS body FROM region CROSS JOIN w UNION ALL SELECT 'json', '{' || chr(10) || '  \"a\": \"x\",' || chr(10) || '  \"orders\": ' || count(*) || chr(10) || '}' || chr(10) FROM orders UNION ALL SELECT 'lines', CAST(count(*) AS VARCHAR) FROM nation",
    "stream_windows": "SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2",
    "stream_sessions": "WITH g AS (SELECT user_id, ts, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER w >= CAST(21600000000 AS BIGINT), true) AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), n AS (SELECT *, sum(CAST(first AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n FROM n GROUP BY user_id, k",
    "stream_trigger": "WITH f AS (SELECT user_id, epoch_us(ts) * 1000 + event_id % 1000 AS tick, value, value >= 50 AS flag FROM events), r AS (SELECT *, sum(CASE WHEN flag THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY tick) AS off FROM f), k AS (SELECT *, CASE WHEN flag THEN row_number() OVER (PARTITION BY user_id, off, flag ORDER BY tick) ELSE 0 END AS streak FROM r) SELECT user_id, min(tick) AS tick, round(arg_min(value, tick), 6) AS value FROM k WHERE streak = 2 GROUP BY 1",
}
