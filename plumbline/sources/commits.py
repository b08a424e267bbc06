"""Sinks that commit once: several tables are staged and one manifest publishes them all.

A root has ``data/`` with staged tables under names of their own, and ``commits/`` with one small JSON file for each commit, made under
another name and renamed, so a reader sees all tables of a commit or none.  What a failed writer staged is never read.
"""

from __future__ import annotations

import atexit
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from .. import functions as fn
from ..operators.graph import shared_folder
from . import guard_path


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _names(spark: SparkSession, root: str) -> list[str]:
    fs, where = _fs(spark, f"{root}/commits")
    return sorted(s.getPath().getName() for s in fs.listStatus(where) if s.getPath().getName().endswith(".json")) if fs.exists(where) else []


def _publish(spark: SparkSession, root: str, name: str, body: dict) -> bool:
    """Make a commit's file; False if it was there."""
    text = json.dumps(body, sort_keys=True)
    fs, target = _fs(spark, f"{root}/commits/{name}.json")
    _, staged = _fs(spark, f"{root}/commits/.{uuid.uuid4().hex}")
    if fs.exists(target):
        return False
    out = fs.create(staged, False)
    out.write(bytearray(text.encode()))
    out.close()
    return bool(fs.rename(staged, target))


def _stage(tables: dict[str, DataFrame], root: str) -> dict[str, str]:
    at = f"data/{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{root}/{at}/{name}")
    return {name: f"{at}/{name}" for name in tables}


def write_root(tables: dict[str, DataFrame], root: str) -> int:
    """Write tables as the next commit of a root and give its number; readers keep the last commit until all tables are there.  Of two
    writers at once the second fails, and what it staged stays unread."""
    spark = next(iter(tables.values())).sparkSession
    guard_path(root)
    number = len([n for n in _names(spark, root) if n.startswith("v")])
    if not _publish(spark, root, f"v{number:09d}", _stage(tables, root)):
        raise RuntimeError(f"commit {number} of {root} was made by another writer")
    return number


def read_root(spark: SparkSession, root: str, version: int | None = None) -> dict[str, DataFrame]:
    """The tables of the last commit, or of a numbered one."""
    names = [n for n in _names(spark, root) if n.startswith("v")]
    name = names[-1] if version is None else f"v{version:09d}.json"
    return {t: spark.read.parquet(f"{root}/{p}") for t, p in _body(spark, root, name).items()}


def _body(spark: SparkSession, root: str, name: str) -> dict:
    fs, where = _fs(spark, f"{root}/commits/{name}")
    stream = fs.open(where)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def stream_to_root(stream: DataFrame, split: Callable[[DataFrame], dict[str, DataFrame]], root: str, checkpoint: str | None = None) -> StreamingQuery:
    """Run a stream over what is available and commit each micro-batch, split into tables, under its number: a batch that is replayed
    after a failure finds its commit and writes nothing."""
    guard_path(root)

    def each(batch: DataFrame, number: int) -> None:
        name = f"b{number:09d}"
        if f"{name}.json" not in _names(batch.sparkSession, root):
            batch = batch.persist()
            try:
                _publish(batch.sparkSession, root, name, _stage(split(batch), root))
            finally:
                batch.unpersist()

    where = checkpoint or f"{root}/progress"
    q = stream.writeStream.foreachBatch(each).option("checkpointLocation", where).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def read_batches(spark: SparkSession, root: str, table: str) -> DataFrame | None:
    """One table over all committed batches; None before the first."""
    paths = [f"{root}/{_body(spark, root, n)[table]}" for n in _names(spark, root) if n.startswith("b")]
    return spark.read.parquet(*paths) if paths else None


def new_root(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared one, deleted when Python ends."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}/{uuid.uuid4().hex}"
    atexit.register(_delete, *_fs(spark, path))
    return path


def _delete(fs: object, where: object) -> None:
    try:
        fs.delete(where, True)
    except Exception:  # noqa: BLE001 - the JVM may be gone, and with it all that could delete
        pass


def score_tables(scored: DataFrame, holdout: str = "holdout") -> dict[str, DataFrame]:
    """What is reported of scores: ``scores`` with six decimals, and per method a ``summary`` of the holdout: rows, mean, deviation and Brier
    score, which is null where a class is missing."""
    held = F.col("split_role") == holdout
    at = lambda c: F.when(held, c)
    err = F.col("score") - F.col("label_id")
    both = F.count_distinct(at(F.col("label_id"))) > 1
    summary = scored.groupBy("method").agg(F.count("*").alias("records"), F.count_if(held).alias("holdout"), F.avg(at(F.col("score"))).alias("score_mean"), F.stddev_pop(at(F.col("score"))).alias("score_std"), F.when(both, F.avg(at(err * err))).alias("brier"))
    scores = scored.select("method", "record_id", F.col("split_role").alias("split"), F.col("label_id").alias("label"), fn.metric_text(F.col("score")).alias("score"))
    return {"scores": scores, "summary": summary}
