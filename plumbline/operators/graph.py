"""Connected components of an edge table."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; where it names none, one of our own if all runs on this machine, else it is an
    error: a cluster's machines do not see each other's folders."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="plumbline-")
        atexit.register(shutil.rmtree, own, True)
        found = f"file://{own}"
        spark.sparkContext.setCheckpointDir(found)
    return found


def keep(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """``df`` as a compressed table in the shared folder, for what is too wide to ``keep``, and what deletes it: else it goes when Python ends."""
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_folder(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())

    def drop() -> None:
        try:
            fs.delete(where, True)
        except Exception:  # noqa: BLE001 - the JVM may be gone
            pass

    atexit.register(drop)
    return spark.read.schema(schema).parquet(path), drop


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``(node, comp)`` from edges ``(a, b)`` of any ordered type: ``comp`` is the least node that is reachable.  Large-star and
    small-star steps alternate until the edges stand still; each is minima and joins, and only checksums reach the driver."""
    e = keep(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = keep(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        now = e.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())
