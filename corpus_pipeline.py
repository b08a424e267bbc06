"""Five stages from raw documents to packed training sequences, each one operator of ``plumbline.llm``.

Every function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``.  Columns of
``docs`` may have any names beside ``doc_id, text, source, lang, n_chars``; an empty table gives an empty result in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import cut, discard, free_name, small
from plumbline.llm.jaccard_join import jaccard_links, text_key
from plumbline.llm.language import UNKNOWN, fit, identify
from plumbline.llm.mixing import mix_sources
from plumbline.llm.packing import pack_texts
from plumbline.llm.secrets import redact_secrets

#: Share of its words that a document's main language must explain.
LEAST_SHARE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents of a language: those without a letter, and those no language explains half of, go.

    Null and empty texts have no language and go; rows of a null ``lang`` are judged, but not learned from.  Each row stands alone, so
    repeats stay as often as they are.  Without a row to learn from nothing stays."""
    lang, score, size = (free_name(docs, x) for x in ("lang_pred", "score", "n_langs"))
    found = identify(docs, fit(docs), lang_col=lang, score_col=score, size_col=size)
    return found.where((F.col(lang) != UNKNOWN) & (F.col(score) >= LEAST_SHARE)).select(*_columns(docs))


def jaccard_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of each group of linked documents the one with the smallest doc_id.

    A row is its id and text: of the rows of one id only those whose text is linked to a smaller id go.  Rows equal in id and
    text are copies, of which the one whose other columns hash lowest stays.  Rows without an id or a word are linked with
    nothing and all stay."""
    key, rank = free_name(docs, "key"), free_name(docs, "rank")
    links = jaccard_links(docs)
    gone = cut(links.where("n_shingles > 0 and doc_id <> component_id").select("doc_id", F.col("text_key").alias(key)).distinct(), "gone")
    once = links.where("n_shingles > 0 and doc_id is not null").groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).where("n > 1")
    once = cut(once.select("doc_id", F.col("text_key").alias(key)).join(gone, ["doc_id", key], "left_anti"), "repeated")
    rows = docs.withColumn(key, text_key("text"))
    kept = rows.join(small(gone), ["doc_id", key], "left_anti")
    if once.isEmpty():
        return kept.select(*_columns(docs))
    several = kept.join(small(once), ["doc_id", key], "left_semi").withColumn(rank, F.xxhash64(*_columns(docs)))
    one = several.groupBy("doc_id", key).agg(F.min_by(F.struct(*_columns(docs)), rank).alias(rank)).select(f"`{rank}`.*")
    return kept.join(small(once), ["doc_id", key], "left_anti").select(*_columns(docs)).unionByName(one.select(*_columns(docs)))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask every secret; all rows stay, and ``n_chars`` follows the text.  A null text stays null, with a null ``n_chars``."""
    return redact_secrets(docs).withColumn("n_chars", F.length("text").cast("long")).select(*_columns(docs))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that sources weigh as the square root of their size, in random order.

    The draw is by id, so rows of one id are drawn alike; a null source is a source, a null id draws as an empty one."""
    return mix_sources(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut texts into pieces of the context length, in words, and form batches in optimal length buckets: each row has its
    words in ``text``.  Texts without a word have no piece; repeated rows are packed each on its own."""
    return pack_texts(docs)


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


STAGES = [("language_id", language_id), ("jaccard_dedup", jaccard_dedup), ("secret_scan", secret_scan), ("source_mix", source_mix), ("packing", packing)]

#: The language model has no SQL form; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs, name)
            if before is not None:
                discard(before)
            before = docs
    return docs
