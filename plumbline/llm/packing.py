"""Packing by optimal length buckets.

A text longer than the context is cut into pieces of that length and a rest.  The global histogram of piece lengths, which has
at most ``max_len`` entries, gives by dynamic programming the bucket boundaries that minimise padding; each piece goes to the
smallest boundary that holds it, and batches of a fixed budget of padded tokens are formed inside each bucket.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Pieces numbered by one task.
SHARD_ROWS = 50_000


def word_count(text: str = "text") -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; 0 if it is null."""
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """At most ``buckets`` of the given ascending lengths, the last among them, that minimise the sum of
    ``count * (boundary - length)``; of equal choices the one with the smallest boundaries from the right."""
    m = len(lengths)
    if not m:
        return []
    size, mass = np.r_[0, np.cumsum(counts)], np.r_[0, np.cumsum(counts * lengths)]
    top = np.r_[0, lengths]
    best = np.full(m + 1, np.iinfo(np.int64).max // 4)
    best[0] = 0
    back = []
    i, j = np.arange(m + 1)[:, None], np.arange(m + 1)[None, :]
    cost = np.where(i < j, top[None, :] * (size[None, :] - size[:, None]) - (mass[None, :] - mass[:, None]), np.iinfo(np.int64).max // 4)
    for _ in range(min(buckets, m)):
        total = best[:, None] + cost
        back.append(total.argmin(0))
        best = np.r_[0, total.min(0)[1:]]
    out, at = [], m
    for b in reversed(back):
        if at == 0:
            break
        out.append(int(top[at]))
        at = int(b[at])
    return out[::-1]


def _key(id_: Column, piece: Column, n: Column) -> Column:
    """The place of a piece in its bucket: a hash, so that batches mix documents whatever their ids."""
    return F.md5(F.concat_ws("|", F.coalesce(id_.cast("string"), F.lit("")), piece.cast("string"), n.cast("string")))


def pack(docs: DataFrame, length: Column, id_col: str = "doc_id", max_len: int = 2048, buckets: int = 8, budget: int = 65_536) -> DataFrame:
    """One row per piece: ``id, piece, start, n_tokens, bucket_len, batch_id, slot``.

    ``piece`` counts from 0 within a row and ``start`` is its first token; ``bucket_len`` is the padded length; a batch of a
    bucket holds ``budget // bucket_len`` pieces (1 at least), numbered over the whole bucket in order of a hash, so that only its
    last batch is short; ``slot`` is the place in the batch.  Batch ids are consecutive over all buckets.

    Rows of null or no length have no piece.  Rows that repeat an id, or have none, are packed each on its own.  Other columns
    are not read.  An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), length.cast("long").alias("n")).where("n > 0")
    pieces = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / max_len).cast("long"))).alias("piece")
    rows = rows.select("id", "n", pieces).select("id", F.col("piece").cast("int").alias("piece"), (F.col("piece") * max_len).alias("start"), F.least(F.lit(max_len).cast("long"), F.col("n") - F.col("piece") * max_len).cast("int").alias("n_tokens"))
    return _batches(rows, id_col, max_len, buckets, budget)


def pack_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_len: int = 2048, buckets: int = 8, budget: int = 65_536) -> DataFrame:
    """As ``pack`` with words for tokens, and ``text``: the words of the piece with the blanks between and after them.

    The pieces of a row joined in order are its text without leading blanks.  A text without a word has no piece; see ``pack`` for
    the rest.
    """
    text = F.ltrim(F.col(text_col).cast("string"), F.lit(" \t\n\x0b\x0c\r"))
    words = F.split(text, r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    parts = lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.size(w) - 1) / max_len).cast("int")), lambda i: F.array_join(F.slice(w, i * max_len + 1, max_len), ""))
    n = word_count(text_col)
    long = F.element_at(F.transform(F.array(words), parts), 1)  # the words are bound once, not split anew for each part
    rows = docs.select(F.col(id_col).alias("id"), n.alias("n"), F.when(n <= max_len, F.array(text)).otherwise(long).alias("parts")).where("n > 0")
    rows = rows.select("id", "n", F.posexplode("parts").alias("piece", "text"))
    left = F.col("n") - F.col("piece") * max_len
    return _batches(rows.select("id", "piece", (F.col("piece").cast("long") * max_len).alias("start"), F.least(F.lit(max_len).cast("long"), left).cast("int").alias("n_tokens"), "text"), id_col, max_len, buckets, budget)


def _batches(rows: DataFrame, id_col: str, max_len: int, buckets: int, budget: int) -> DataFrame:
    extra = rows.columns[4:]
    rows = cut(rows, "pieces")
    hist = rows.groupBy("n_tokens").agg(F.count("*").alias("c")).orderBy("n_tokens").collect()
    ends = boundaries(np.array([r.n_tokens for r in hist], np.int64), np.array([r.c for r in hist], np.int64), buckets)
    shards = max(1, -(-sum(r.c for r in hist) // SHARD_ROWS))
    first, per, at = {}, {}, 0
    for lo, end in zip([0, *ends], ends):
        per[end], first[end] = max(1, budget // end), at
        at += -(-sum(r.c for r in hist if lo < r.n_tokens <= end) // per[end])
    look = lambda d: F.element_at(F.create_map(*[F.lit(x).cast("long") for kv in d.items() for x in kv]), F.col("bucket_len").cast("long")) if d else F.lit(1).cast("long")
    bucket = F.lit(max_len)
    for end in reversed(ends):
        bucket = F.when(F.col("n_tokens") <= end, F.lit(end)).otherwise(bucket)
    # the first 12 hex digits of a key cut all keys into shards of about one size, in order of the keys
    place = F.conv(F.substring("key", 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))
    rows = rows.withColumn("bucket_len", bucket.cast("int")).withColumn("key", _key(F.col("id"), F.col("piece"), F.col("n_tokens"))).withColumn("shard", F.floor(place * shards).cast("int"))
    counts = rows.groupBy("bucket_len", "shard").agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("bucket_len").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")
    offsets = counts.select("bucket_len", "shard", before)
    inside = F.row_number().over(Window.partitionBy("bucket_len", "shard").orderBy("key", "id", "piece"))
    rows = rows.withColumn("inside", inside).join(offsets, ["bucket_len", "shard"]).withColumn("seq", F.col("before") + F.col("inside") - 1)
    batch = look(first) + F.floor(F.col("seq") / look(per))
    return rows.select(F.col("id").alias(id_col), "piece", "start", "n_tokens", "bucket_len", batch.cast("long").alias("batch_id"), (F.col("seq") % look(per)).cast("int").alias("slot"), *extra)


def op2_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs, word_count())


_LEVELS = 8
OP2_SQL = f"""
WITH w AS (SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n FROM documents),
p AS (SELECT doc_id, n, unnest(range(0, (n - 1) // 2048 + 1)) AS piece FROM w WHERE n > 0),
r AS (SELECT doc_id, CAST(piece AS INTEGER) AS piece, piece * 2048 AS start, CAST(least(2048, n - piece * 2048) AS INTEGER) AS n_tokens FROM p),
h AS (SELECT row_number() OVER (ORDER BY n_tokens) AS j, n_tokens AS len, sum(count(*)) OVER (ORDER BY n_tokens) AS size, sum(count(*) * n_tokens) OVER (ORDER BY n_tokens) AS mass FROM r GROUP BY n_tokens
  UNION ALL SELECT 0, 0, 0, 0),
c AS (SELECT a.j AS i, b.j AS j, b.len * (b.size - a.size) - (b.mass - a.mass) AS cost FROM h a JOIN h b ON a.j < b.j),
b0 AS (SELECT 0 AS j, 0 AS best, 0 AS back),
{"".join(f"b{k} AS (SELECT c.j, min(best + cost) AS best, arg_min(c.i, (best + cost, c.i)) AS back FROM b{k - 1} p JOIN c ON c.i = p.j GROUP BY c.j UNION ALL SELECT 0, 0, 0)," + chr(10) for k in range(1, _LEVELS + 1))}
e8 AS (SELECT max(j) AS j FROM h),
{"".join(f"e{k - 1} AS (SELECT b{k}.back AS j FROM b{k} JOIN e{k} USING (j))," + chr(10) for k in range(_LEVELS, 0, -1))}
ends AS (SELECT DISTINCT len FROM h JOIN ({" UNION ".join(f"SELECT j FROM e{k}" for k in range(1, _LEVELS + 1))}) USING (j) WHERE len > 0),
x AS (SELECT r.*, (SELECT min(len) FROM ends WHERE len >= n_tokens) AS bucket_len FROM r),
s AS (SELECT *, row_number() OVER (PARTITION BY bucket_len ORDER BY md5(concat_ws('|', doc_id, piece, n_tokens)), doc_id, piece) - 1 AS seq FROM x),
q AS (SELECT bucket_len, greatest(1, 65536 // bucket_len) AS per, count(*) AS n FROM x GROUP BY 1),
f AS (SELECT bucket_len, per, coalesce(sum((n + per - 1) // per) OVER (ORDER BY bucket_len ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM q)
SELECT doc_id, piece, start, n_tokens, CAST(bucket_len AS INTEGER) AS bucket_len, CAST(first + seq // per AS BIGINT) AS batch_id, CAST(seq % per AS INTEGER) AS slot FROM s JOIN f USING (bucket_len)
"""
