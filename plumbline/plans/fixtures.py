"""How the driver's tables stand for scored records, frames, groups and grids; each with the same relation in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import table


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with two scores: one from the length, one full of ties."""
    l, d = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    j = l.select("doc_id", "quality").join(d, "doc_id")
    n = F.col("n_chars").cast("double")
    methods = F.explode(F.array(F.struct(F.lit("length").alias("m"), (n / (n + 2000.0)).alias("s")), F.struct(F.lit("tied").alias("m"), ((F.col("doc_id") % 7).cast("double") / 7.0).alias("s")))).alias("x")
    return j.select(
        F.col("doc_id").alias("record_id"), F.coalesce("source", F.lit("")).alias("group_id"), F.coalesce("lang", F.lit("")).alias("phase_id"),
        F.when(F.col("doc_id") % 5 == 0, "holdout").otherwise("train").alias("split_role"), (F.col("doc_id") % 4).alias("cv_fold"), F.col("quality").cast("int").alias("label_id"), F.col("doc_id").alias("ord"), n.alias("n_chars"), methods,
    ).select("record_id", "group_id", "phase_id", "split_role", "cv_fold", "label_id", "ord", "n_chars", F.col("x.m").alias("method"), F.col("x.s").alias("score"))


SCORED = """scored AS (SELECT l.doc_id AS record_id, coalesce(source, '') AS group_id, coalesce(lang, '') AS phase_id, CASE WHEN l.doc_id % 5 = 0 THEN 'holdout' ELSE 'train' END AS split_role,
  l.doc_id % 4 AS cv_fold, quality AS label_id, l.doc_id AS ord, CAST(n_chars AS DOUBLE) AS n_chars, m.method,
  CASE m.method WHEN 'length' THEN CAST(n_chars AS DOUBLE) / (CAST(n_chars AS DOUBLE) + CAST(2000 AS DOUBLE)) ELSE CAST(l.doc_id % 7 AS DOUBLE) / CAST(7 AS DOUBLE) END AS score
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id CROSS JOIN (VALUES ('length'), ('tied')) m(method))"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frames of a user, in order of time and id; time in seconds."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("record_id"), F.col("event_id").alias("frame_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("time_s"), "event_type", "value", (F.col("user_id") % 2).cast("int").alias("label_id"), (F.col("user_id") % 3).alias("phase_id"), F.when(F.col("user_id") % 5 == 0, "holdout").otherwise("train").alias("split_role"))


FRAMES = """frames AS (SELECT user_id AS record_id, event_id AS frame_id, epoch_us(ts) / CAST(1000000 AS DOUBLE) AS time_s, event_type, value, CAST(user_id % 2 AS INTEGER) AS label_id, user_id % 3 AS phase_id,
  CASE WHEN user_id % 5 = 0 THEN 'holdout' ELSE 'train' END AS split_role FROM events)"""

KEYS, ORDER = ["record_id"], ["time_s", "frame_id"]


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as groups, their lines as records: an expensive line is positive, its score from quantity and discount."""
    o, l = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus"), table(spark, sf_dir, "lineitem")
    s = (F.col("l_quantity") / 50.0 + F.col("l_discount")) / 1.2
    return l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderkey").alias("group_id"), F.col("o_orderpriority").alias("stratum"), F.col("o_orderstatus").alias("status"), F.col("l_partkey").alias("partkey"), F.col("l_linenumber").alias("line"), (F.col("l_extendedprice") > 60000.0).cast("int").alias("label_id"), s.alias("score"))


GROUPS = """grp AS (SELECT o_orderkey AS group_id, o_orderpriority AS stratum, o_orderstatus AS status, l_partkey AS partkey, l_linenumber AS line, CAST(l_extendedprice > 60000 AS INTEGER) AS label_id,
  (l_quantity / CAST(50 AS DOUBLE) + l_discount) / CAST(1.2 AS DOUBLE) AS score FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines counted on a 40 x 40 grid of part and supplier keys, per line number parity."""
    l = table(spark, sf_dir, "lineitem")
    return l.groupBy((F.col("l_linenumber") % 2).cast("int").alias("g"), (F.col("l_partkey") % 40).cast("int").alias("x"), (F.col("l_suppkey") % 40).cast("int").alias("y")).agg(F.sum("l_quantity").alias("v"))


GRID = "grid AS (SELECT CAST(l_linenumber % 2 AS INTEGER) AS g, CAST(l_partkey % 40 AS INTEGER) AS x, CAST(l_suppkey % 40 AS INTEGER) AS y, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3)"
