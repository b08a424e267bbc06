"""Mixing sources to target weights by Poisson replication.

Each source has a target weight; its repetition rate is weight x total rows / its rows.  Every document draws its number of
copies from a Poisson distribution with that mean, by inverting the cumulative distribution at a uniform number hashed from
the seed and the document's id.  Documents are exploded by that number and dealt out and sorted by a hash of id and copy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, without

#: Sources up to this number are broadcast (a row has some tens of doubles); beyond it the join is salted instead.
BROADCAST_SOURCES = 10_000
SALTS = 64


def target_rates(docs: DataFrame, source_col: str, weights: dict[str, float] | None = None, power: float = 0.5) -> DataFrame:
    """``(source, rate)``: by given weights (a source without one gets none), else by row counts to a power, normalised."""
    per = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        per = per.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(float(power))))
    else:
        given = docs.sparkSession.createDataFrame(list(weights.items()), "source string, w double")
        per = per.join(F.broadcast(given), "source", "left").na.fill(0.0, ["w"])
    all_ = per.agg(F.sum("n").alias("all_n"), F.sum("w").alias("all_w"))
    return per.crossJoin(F.broadcast(all_)).select("source", F.when(F.col("all_w") > 0, F.col("w") / F.col("all_w") * F.col("all_n") / F.col("n")).otherwise(0.0).alias("rate"))


def poisson_table(rates: DataFrame) -> DataFrame:
    """``rates`` with ``cdf``, the cumulative Poisson distribution up to far beyond what a 52-bit uniform can reach."""
    k = F.explode(F.sequence(F.lit(0), F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 30).cast("int"))).alias("k")
    up = Window.partitionBy("source").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    terms = rates.select("source", "rate", k).withColumn("lf", F.sum(F.log(F.greatest("k", F.lit(1)).cast("double"))).over(up))
    p = F.when(F.col("rate") > 0, F.exp(-F.col("rate") + F.col("k") * F.log("rate") - F.col("lf"))).otherwise((F.col("k") == 0).cast("double"))
    terms = terms.withColumn("c", F.sum(p).over(up))
    cdf = F.transform(F.sort_array(F.collect_list(F.struct("k", "c"))), lambda x: x["c"]).alias("cdf")
    return terms.groupBy("source", "rate").agg(cdf)


def _hash(seed: int, tag: str, *cols: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(tag), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]))


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.5, seed: int = 17, id_col: str = "doc_id", source_col: str = "source", keep_key: bool = False) -> DataFrame:
    """``docs`` repeated to the target weights, in global random order within its partitions; with ``keep_key`` also the columns
    ``n_copies``, ``copy`` (from 1) and ``shuffle_key``.

    The draw depends on seed and id alone, so it is the same on any cluster; rows that repeat an id repeat its draw, and a null
    id draws as the empty string.  A null source is a source of its own.  Without weights above zero nothing is kept.  Other
    columns are kept under their names; names that begin with ``_mix_`` are reserved, and with ``keep_key`` input columns of the
    three names are replaced.  An empty table gives an empty result.
    """
    docs = without(docs, ["n_copies", "copy", "shuffle_key"]) if keep_key else docs
    names = docs.columns
    table = poisson_table(target_rates(docs, source_col, weights, power)).select(F.col("source").alias("_mix_source"), F.col("cdf").alias("_mix_cdf"))
    src = docs
    if table.count() <= BROADCAST_SOURCES:
        joined = src.join(F.broadcast(table), F.col(source_col).eqNullSafe(F.col("_mix_source")))
    else:
        src = src.withColumn("_mix_salt", F.pmod(F.xxhash64(id_col), F.lit(SALTS)).cast("int"))
        table = table.withColumn("_mix_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = src.join(table, F.col(source_col).eqNullSafe(F.col("_mix_source")) & (F.col("_mix_salt") == F.col("_mix_s")))
    u = (F.conv(F.substring(_hash(seed, "copies", F.col(id_col)), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))
    drawn = joined.withColumn("_mix_u", u).withColumn("_mix_n", F.size(F.filter("_mix_cdf", lambda c: c < F.col("_mix_u")))).where("_mix_n > 0")
    out = drawn.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_n")))).withColumn("_mix_key", _hash(seed, "order", F.col(id_col), F.col("_mix_copy")))
    out = out.repartition(partitions(docs.sparkSession), "_mix_key").sortWithinPartitions("_mix_key")
    keys = [F.col("_mix_n").alias("n_copies"), F.col("_mix_copy").alias("copy"), F.col("_mix_key").alias("shuffle_key")]
    return out.select(*[F.col(f"`{c}`") for c in names], *(keys if keep_key else []))


def op8_source_mix(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    return mix_sources(docs, keep_key=True)


OP8_SQL = """
WITH per AS (SELECT source, count(*) AS n, pow(CAST(count(*) AS DOUBLE), 0.5) AS w FROM documents GROUP BY source),
rates AS (SELECT source, w / sum(w) OVER () * sum(n) OVER () / n AS rate FROM per),
terms AS (SELECT source, rate, k, sum(ln(CAST(greatest(k, 1) AS DOUBLE))) OVER (PARTITION BY source ORDER BY k) AS lf
  FROM (SELECT source, rate, unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 30) AS BIGINT) + 1)) AS k FROM rates)),
cdf AS (SELECT source, k, sum(exp(-rate + k * ln(rate) - lf)) OVER (PARTITION BY source ORDER BY k) AS c FROM terms),
tab AS (SELECT source, list(c ORDER BY k) AS cdf FROM cdf GROUP BY source),
drawn AS (SELECT doc_id, d.source, len(list_filter(cdf, lambda c: c < (CAST(('0x' || substr(md5('17|copies|' || doc_id), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0)) AS n_copies
  FROM documents d JOIN tab ON d.source IS NOT DISTINCT FROM tab.source),
copies AS (SELECT doc_id, source, n_copies, unnest(range(1, n_copies + 1)) AS copy FROM drawn)
SELECT doc_id, source, CAST(n_copies AS INTEGER) AS n_copies, CAST(copy AS INTEGER) AS copy, md5('17|order|' || doc_id || '|' || copy) AS shuffle_key FROM copies
"""
