"""What the corpus operators share: tables in the shared folder, dealing by partition, components of a graph."""

from __future__ import annotations

import atexit
import ctypes
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_CHECKPOINT = "spark.checkpoint.dir"
_TABLE = "_plumbline_table"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.  Where that is unset, a folder of our own if all
    runs on this machine (tests), else an error: a cluster's machines do not see each other's folders."""
    found = spark.conf.get(_CHECKPOINT, None) or spark.sparkContext.getConf().get(_CHECKPOINT)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError(f"set {_CHECKPOINT} to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="plumbline-")
        atexit.register(shutil.rmtree, own, True)
        found = f"file://{own}"
        spark.conf.set(_CHECKPOINT, found)
    return found


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back, so that later work does not redo it
    and lost executors cost nothing but their running tasks.  ``discard`` deletes the table; else it goes when Python ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/plumbline/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    setattr(out, _TABLE, (where, spark._jsc.hadoopConfiguration()))
    atexit.register(_delete, *getattr(out, _TABLE))
    return out


def _delete(where: object, conf: object) -> None:
    try:
        where.getFileSystem(conf).delete(where, True)
    except Exception:  # noqa: BLE001 - the JVM may be gone, and with it all that could delete
        pass


def discard(df: DataFrame) -> None:
    """Delete a table of ``cut`` that nothing will read again."""
    _delete(*getattr(df, _TABLE))


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """``df`` without its columns of these names, whatever their case: outputs replace them."""
    gone = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in gone])


def extended(df: DataFrame, ddl: str) -> StructType:
    """The schema of ``df`` with further columns."""
    return StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields])


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = f"_{name}"
    return name


def with_weighted(left: DataFrame, right: DataFrame, on: list[str], weight: str, total: int, how: str = "left") -> DataFrame:
    """``left`` joined with ``right``, one row per key, whose ``weight`` is at least the number of rows of that key in ``left``.

    Keys with more than a share ``1 / (4 width)`` of the ``total`` weight, of which there are fewer than ``4 width``, are
    broadcast, so that no task gets all rows of one; the others meet by key.  The result has no column ``weight``."""
    most = total // (4 * partitions(left.sparkSession))
    hot = F.broadcast(right.where(F.col(weight) > most).drop(weight))
    cold = right.where(F.col(weight) <= most).drop(weight)
    rest = left.join(F.broadcast(right.where(F.col(weight) > most).select(*on)), on, "left_anti")
    return left.join(hot, on).unionByName(rest.join(cold, on, how))


#: Rows of two integers up to which a table is broadcast (16 MB).
BROADCAST_IDS = 1_000_000


def small(df: DataFrame) -> DataFrame:
    """``df``, a table of ids, marked for broadcast if it has no more than ``BROADCAST_IDS`` rows."""
    return F.broadcast(df) if df.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else df


def salted(left: DataFrame, right: DataFrame, on: str, per: int) -> DataFrame:
    """The inner join of ``left`` with ``right``, which has wide rows and each key once: a key with more than ``per`` rows in ``left``
    is dealt over as many salts as keep it below, and its row of ``right`` goes to each."""
    many = cut(left.groupBy(on).agg(F.count("*").alias("_n")).where(F.col("_n") > per), "salts")
    many = small(many.select(on, F.ceil(F.col("_n") / per).cast("int").alias("_salts")))
    a = left.join(many, on, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(*[c for c in left.columns if c != on]), F.col("_salts")).cast("int"), F.lit(0)))
    b = right.join(many, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)))
    return a.drop("_salts").join(b.drop("_salts"), [on, "_salt"]).drop("_salt")


def partitions(spark: SparkSession) -> int:
    """The session's shuffle width; it is to grow with the input, and what one task holds is a share of this size."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def deal(df: DataFrame, key: str) -> DataFrame:
    """Send each row to the partition that its integer ``key`` names (0 to the shuffle width)."""
    return df.repartitionById(partitions(df.sparkSession), F.col(key).cast("int"))


#: Rows of a batch that Python works on at a time; the bytes that reach it at once are bounded by the session.
BATCH_ROWS = 1000


def trim() -> None:
    """Give freed memory back: workers outlive their tasks and share an executor's memory with its heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def arrow_map(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``df.mapInArrow`` in batches small enough for long texts, giving memory back after each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(b.slice(i, BATCH_ROWS) for b in batches for i in range(0, b.num_rows, BATCH_ROWS))
        finally:
            trim()

    return df.mapInArrow(run, schema)


def batch(**cols: pa.Array | np.ndarray | list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols.values()], list(cols))


def blobs(col: pa.Array, dtype: type) -> np.ndarray:
    """All values packed in a binary column, one after the other."""
    out = [np.frombuffer(x, dtype) for x in col.to_pylist()]
    return np.concatenate(out) if out else np.zeros(0, dtype)


def local_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest reachable index of each of ``n`` vertices under edges ``a``-``b``: minimum labels and pointer jumping."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        open_ = ra != rb
        if not open_.any():
            break
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the edges of one task by one edge from each vertex to the smallest it reaches through them."""
    got = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches if x.num_rows]
    if got:
        a, b = (np.concatenate(x) for x in zip(*got))
        v, idx = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = local_roots(idx[: len(a)], idx[len(a) :], len(v))
        keep = root != np.arange(len(v))
        yield batch(a=v[keep], b=v[root[keep]])


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Components of a graph from ``edges(a, b)`` of long vertices: a table ``(node, comp)``, ``comp`` the smallest vertex.

    Vertices without an edge to another are absent; null ends are ignored.  Every task first contracts its own edges; then
    large-star and small-star steps alternate until the edges stand still, each a few joins and minima, with the state
    written to the shared folder after each round.  Nothing but two checksums goes to the driver.
    """
    schema = "a long, b long"
    e = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null and a <> b")
    e = cut(arrow_map(e, _contract, schema).distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        old, e = e, cut(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        discard(old)
        now = e.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())
