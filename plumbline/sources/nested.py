"""Records whose nesting is not known: paths and values of JSON documents, and their observations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import functions as fn
from ..operators.graph import keep


def explode_paths(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """``id, path, value``: every leaf of JSON documents with its path (``$.a.b[0]``) and its value as text, null for a JSON null.

    Documents are parsed once to variants; each round takes one level off all containers that are left, so there are as many rounds
    as the deepest document has levels.  Text that is no JSON, and null, has no leaf; an empty container has none either."""
    spark = df.sparkSession
    left = keep(df.select(F.col(id_col).alias("id"), F.lit("$").alias("path"), F.try_parse_json(json_col).alias("v")).where("v is not null"))
    kind = F.schema_of_variant("v")
    container = kind.startswith("OBJECT") | kind.startswith("ARRAY")
    out = None
    while True:
        leaf = left.where(~container).select("id", "path", F.expr("try_variant_get(v, '$', 'string')").alias("value"))
        out = leaf if out is None else out.unionByName(leaf)
        inner = left.where(container)
        if inner.isEmpty():
            return out.withColumnRenamed("id", id_col)
        step = F.when(kind.startswith("OBJECT"), F.lit(True)).otherwise(False)
        inner.withColumn("is_object", step).createOrReplaceTempView("_plumbline_level")
        nxt = spark.sql("SELECT id, CASE WHEN is_object THEN concat(path, '.', x.key) ELSE concat(path, '[', x.pos, ']') END AS path, x.value AS v FROM _plumbline_level, LATERAL variant_explode(v) AS x")
        left = keep(nxt)
        spark.catalog.dropTempView("_plumbline_level")


def observations(rows: DataFrame, name: str, value: str) -> DataFrame:
    """``observable, n, low, high, total`` of rows whose name is not blank and whose value is a finite number; names are trimmed."""
    x = rows.select(F.trim(F.col(name).cast("string")).alias("observable"), fn.finite(F.col(value)).alias("v")).where("observable <> '' and v is not null")
    return x.groupBy("observable").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.sum("v").alias("total"))
