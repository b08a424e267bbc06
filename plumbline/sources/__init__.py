"""Scans and sinks.  Every text source takes a schema: none is inferred."""

from __future__ import annotations

import io
import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> None:
    """Views of the driver's tables, for ``spark.sql``."""
    for n in names or TABLES:
        table(spark, sf_dir, n).createOrReplaceTempView(n)


def csv(spark: SparkSession, path: str, schema: str | StructType, strict: bool = False, optional: bool = False) -> DataFrame:
    """Rows of a CSV file with header; ``strict`` fails on a bad row; an ``optional`` file that is absent has no rows."""
    try:
        df = spark.read.option("header", True).option("mode", "FAILFAST" if strict else "PERMISSIVE").schema(schema).csv(path)
        df.schema  # noqa: B018
        return df
    except AnalysisException as e:
        if optional and "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def text_rows(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All columns as text, as they stand in the file."""
    return csv(spark, path, ", ".join(f"`{c}` string" for c in columns))


def json_documents(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Whole-file JSON objects, with their path; anything else fails."""
    return spark.read.option("multiLine", True).option("mode", "FAILFAST").schema(schema).json(path).withColumn("path", F.col("_metadata.file_path")).orderBy("path")


def nonempty_lines(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).where(F.trim("value") != "").count()


def unpivot(df: DataFrame, ids: list[str], mapping: dict[str, tuple[str, str]]) -> DataFrame:
    """Wide rows as ``(ids, observable, unit, value)``: mapping ``column -> (observable, unit)``; what is no finite number is dropped."""
    cells = F.explode(F.array(*[F.struct(F.lit(o).alias("observable"), F.lit(u).alias("unit"), F.col(c).try_cast("double").alias("value")) for c, (o, u) in mapping.items()])).alias("c")
    out = df.select(*ids, cells).select(*ids, "c.*")
    return out.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < F.lit(float("inf"))))


_DTYPES = {"<f4": np.float32, "<f8": np.float64, "|b1": np.bool_, "<c8": np.complex64}


def tensors(spark: SparkSession, root: str) -> DataFrame:
    """Single-chunk tensor folders (``.zarray`` beside ``0.raw``) as ``name, shape, dtype, values``; complex values as re, im pairs.
    A chunk whose length does not fit its shape fails.

    Spark's readers pass over names with a leading dot, so each task opens the headers of its own chunks, by the file system that
    the path names."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "0.raw").load(root)
    raw = raw.select(F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("folder"), "content")

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            rows = []
            for folder, c in zip(b["folder"], b["content"]):
                fs, path = pafs.FileSystem.from_uri(re.sub("^file:/*", "file:///", folder))
                with fs.open_input_stream(f"{path}/.zarray") as f:
                    m = json.loads(f.read())
                n, kind, shape = path.rsplit("/", 1)[-1], _DTYPES[m["dtype"]], [int(x) for x in m["shape"]]
                if len(c) != int(np.prod(shape)) * np.dtype(kind).itemsize:
                    raise ValueError(f"tensor {n}: {len(c)} bytes do not fit shape {shape}")
                x = np.frombuffer(c, kind)
                x = x.view(np.float32) if kind is np.complex64 else x
                rows.append((n, shape, m["dtype"], x.astype(float).tolist()))
            yield pd.DataFrame(rows, columns=["name", "shape", "dtype", "values"])

    return raw.mapInPandas(run, "name string, shape array<int>, dtype string, values array<double>")


def write_tensors(df: DataFrame, root: str, dtype: str = "<f4") -> None:
    """One single-chunk tensor folder for each row ``(name, shape, values)``, in C order; values of complex tensors are re, im pairs.
    Every task writes its own rows; a tensor that is there already, or whose values do not fit its shape, fails."""
    kind = _DTYPES[dtype]
    guard_path(root)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            for n, shape, v in zip(b["name"], b["shape"], b["values"]):
                x = np.asarray(v, np.float32).view(np.complex64) if kind is np.complex64 else np.asarray(v).astype(kind)
                if x.size != int(np.prod(shape)):
                    raise ValueError(f"tensor {n}: {x.size} values do not fit shape {list(shape)}")
                fs, path = pafs.FileSystem.from_uri(f"{re.sub('^file:/*', 'file:///', root)}/{n}")
                if fs.get_file_info(f"{path}/0.raw").type != pafs.FileType.NotFound:
                    raise FileExistsError(path)
                fs.create_dir(path, recursive=True)
                head = {"zarr_format": 2, "shape": [int(s) for s in shape], "chunks": [int(s) for s in shape], "dtype": dtype, "order": "C", "compressor": None, "filters": None, "fill_value": 0}
                for name, data in ((".zarray", json.dumps(head, sort_keys=True).encode()), ("0.raw", x.tobytes())):
                    with fs.open_output_stream(f"{path}/{name}") as f:
                        f.write(data)
            yield pd.DataFrame({"n": [len(b)]})

    df.select("name", "shape", "values").mapInPandas(run, "n long").agg(F.sum("n")).collect()


def npz_frames(spark: SparkSession, path: str, array: str, ids: str, columns: str | None = None) -> DataFrame:
    """Frame stores (``.npz`` files of one 3-D array, record ids and column names) as ``shard_path, row_offset, record_id, time_index,
    values, columns``: a row per record and step.  A store whose ids do not fit its array fails.  Each file is read by one task."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").option("recursiveFileLookup", True).load(path).select("path", "content")

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            for p, c in zip(b["path"], b["content"]):
                with np.load(io.BytesIO(c), allow_pickle=False) as z:
                    x, names = z[array], z[ids].astype(str)
                    cols = z[columns].astype(str).tolist() if columns else None
                if x.ndim != 3 or len(names) != len(x):
                    raise ValueError(f"{p}: {len(names)} ids do not fit an array of shape {x.shape}")
                for r in range(len(x)):
                    yield pd.DataFrame({"shard_path": p, "row_offset": r, "record_id": names[r], "time_index": np.arange(x.shape[1]), "values": list(x[r].astype(float)), "columns": [cols] * x.shape[1]})

    return raw.mapInPandas(run, "shard_path string, row_offset long, record_id string, time_index int, values array<double>, columns array<string>")


def write_npz(df: DataFrame, root: str, shard: str, record: str, value: str, shape: tuple[int, int], columns: list[str]) -> None:
    """A frame store for each shard: its records in order of id, each ``shape`` of values.  A shard is one file, so one task holds it;
    one that is there already fails."""
    guard_path(root)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(record)
        body = io.BytesIO()
        np.savez(body, frames=np.stack([np.asarray(v, np.float32).reshape(shape) for v in pdf[value]]), record_ids=pdf[record].to_numpy(str), columns=np.array(columns))
        fs, path = pafs.FileSystem.from_uri(re.sub("^file:/*", "file:///", root))
        name = f"{path}/shard-{pdf[shard].iloc[0]:06d}.npz"
        if fs.get_file_info(name).type != pafs.FileType.NotFound:
            raise FileExistsError(name)
        fs.create_dir(path, recursive=True)
        with fs.open_output_stream(name) as f:
            f.write(body.getvalue())
        return pd.DataFrame({"n": [len(pdf)]})

    df.select(shard, record, value).groupBy(shard).applyInPandas(run, "n long").agg(F.sum("n")).collect()


def write_sequence(df: DataFrame, path: str) -> None:
    """Columns of doubles with 17 digits after the point, which read back bit for bit; a null fails."""
    lossless = lambda c: F.when(F.col(c).isNull(), F.raise_error(F.lit(f"column {c} has a null"))).otherwise(F.format_string("%.17e", F.col(c).cast("double")))
    write_csv(df.select(*[lossless(c).alias(c) for c in df.columns]), path)


def gather(records: DataFrame, store: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The rows of a store that each record points to (by shard and offset, or by id), with the record's own place ``order``; a record
    without a row fails."""
    lost = records.join(store, keys, "left_anti").limit(1).collect()
    if lost:
        raise KeyError(f"no row for {[lost[0][k] for k in keys]}")
    return store.join(records.select(*keys, order), keys)


def assert_aligned(left: DataFrame, right: DataFrame, place: str, key: str) -> None:
    """Fail unless both relations have the same key at every place."""
    bad = left.select(place, F.col(key).alias("_a")).join(right.select(place, F.col(key).alias("_b")), place, "full").where(~F.col("_a").eqNullSafe(F.col("_b"))).limit(1).collect()
    if bad:
        raise ValueError(f"place {bad[0][place]}: {bad[0]['_a']} is not {bad[0]['_b']}")


def discover(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Folders one level below ``root`` that hold a file ``name``, as ``folder, path``."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", name).load(f"{root}/*").select("path")
    return found.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("folder"), "path")


def cards(spark: SparkSession, root: str, schema: str = "kind string, public_proxy_id string") -> DataFrame:
    """JSON cards below ``root`` as ``kind, slug, path``: the kind of the card, else the folder's name; the slug of its id, else the file's
    name.  Two cards of one kind and slug fail."""
    raw = spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").schema(schema).json(root).withColumn("path", F.col("_metadata.file_path"))
    kind = F.coalesce("kind", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1))
    out = raw.select(kind.alias("kind"), F.coalesce("public_proxy_id", F.regexp_extract("path", r"([^/]+)\.json$", 1)).alias("slug"), "path")
    twice = out.groupBy("kind", "slug").agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"card {twice[0]['kind']}/{twice[0]['slug']} is there twice")
    return out


# sinks ------------------------------------------------------------------------------------------------------------------


def guard_path(path: str, reserved: tuple[str, ...] = ("/etc", "/usr", "/bin")) -> str:
    """Refuse reserved prefixes; writers below never overwrite unless told to."""
    if any(path == r or path.startswith(f"{r}/") for r in reserved):
        raise ValueError(f"reserved path {path}")
    return path


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """A CSV table with header; with ``columns`` in their order, and a column of ``df`` that is none of them fails."""
    if columns and set(df.columns) - set(columns):
        raise ValueError(f"columns {sorted(set(df.columns) - set(columns))} are not written")
    (df.select(*columns) if columns else df).write.mode("errorifexists").option("header", True).csv(guard_path(path))


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(guard_path(path))


def write_partitioned(df: DataFrame, path: str, by: list[str], rows_per_file: int) -> None:
    df.write.mode("errorifexists").option("maxRecordsPerFile", rows_per_file).partitionBy(*by).parquet(guard_path(path))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` without the keys of ``new``, then ``new``."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def markdown(df: DataFrame, columns: list[str], most: int = 1000) -> str:
    """A padded table of a report's rows, which are few; more than ``most`` is an error."""
    rows = df.select(*columns).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows are no report")
    cells = [columns, *[["" if v is None else str(v) for v in r] for r in rows]]
    wide = [max(len(r[i]) for r in cells) for i in range(len(columns))]
    line = lambda r: "| " + " | ".join(v.ljust(w) for v, w in zip(r, wide)) + " |"
    return "\n".join([line(cells[0]), "| " + " | ".join("-" * w for w in wide) + " |", *map(line, cells[1:])]) + "\n"


def report_json(df: DataFrame) -> str:
    """One row as JSON with sorted keys and two spaces."""
    (row,) = df.limit(2).collect()
    return json.dumps(row.asDict(True), indent=2, sort_keys=True, default=str) + "\n"


_MAGIC = b"PLF1"


def encode_frames(df: DataFrame, header: list[str], cells: str) -> DataFrame:
    """``frame`` binary: magic, length of a JSON header, the header, then one byte per cell."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            out = []
            for r in b.itertuples(index=False):
                h = json.dumps({k: getattr(r, k) for k in header}, default=str).encode()
                out.append(_MAGIC + struct.pack("<I", len(h)) + h + bytes(int(x) & 255 for x in getattr(r, cells)))
            yield pd.DataFrame({"frame": out})

    return df.select(*header, cells).mapInPandas(run, "frame binary")


def decode_frame(data: bytes) -> tuple[dict, bytes]:
    if data[:4] != _MAGIC:
        raise ValueError("not a frame")
    n = struct.unpack("<I", data[4:8])[0]
    return json.loads(data[8 : 8 + n]), data[8 + n :]
