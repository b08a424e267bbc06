"""Language identification by multilingual mixture inference.

A model is a table of log-likelihoods of character trigrams (as hashed UTF-8 byte windows of one word) per language, from
counts over all training documents.  A document is a mixture of languages over its words: expectation-maximisation finds the
proportions, once over all languages, then over the nested sets of its 1, 2, ... most likely languages; the set with the best
penalised likelihood is taken, and its largest share names the document's language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import arrow_map, batch, extended, without

#: Hashed trigram buckets of the model, and the weight of one unseen observation spread over them.
BUCKETS, SMOOTHING = 1 << 14, 0.5
ROUNDS = 12
#: Log-likelihood that one more language must gain, per log of the number of words.
PENALTY = 3.0
#: What a word's log-likelihoods may differ by between languages: one odd word must not decide a text.
CLIP = 12.0
UNKNOWN = "und"

_M1, _M2, _M3 = (np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))


@dataclass
class Model:
    langs: list[str]
    logp: np.ndarray  # BUCKETS x languages, float32


def _grams(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all trigrams of ``_word_`` for each word, and where each word's begin (a word of n bytes has n)."""
    n = e - s
    at = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=at[1:])
    # the words, each closed by a space before and after; a trigram is centred on each byte of a word
    mid = np.arange(int(at[-1])) + np.repeat(s - at[:-1], n)
    low = data
    first, last = at[:-1], at[1:] - 1
    c = low[mid].astype(np.uint32)
    left, right = np.empty_like(c), np.empty_like(c)
    left[1:], right[:-1] = c[:-1], c[1:]
    left[first], right[last] = 32, 32
    return ((left * _M1 + c * _M2 + right * _M3) >> np.uint32(32 - (BUCKETS.bit_length() - 1))).astype(np.int64), at


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task's trigram counts per language."""
    total: dict[str, np.ndarray] = {}
    for b in batches:
        lang = b.column(1).to_pylist()
        data, offsets = K.text_buffer(b.column(0))
        data = _LOWER[data]
        for i, j in K.row_blocks(offsets):
            part, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            s, e, first = K.words(part, off)
            g, at = _grams(part, s, e)
            own = at[first]
            for name in set(lang[i:j]):
                got = total.setdefault(name, np.zeros(BUCKETS, np.int64))
                got += np.bincount(np.concatenate([g[own[r] : own[r + 1]] for r in range(j - i) if lang[i + r] == name]), minlength=BUCKETS)
    for name, c in total.items():
        k = np.flatnonzero(c)
        for x in range(0, len(k), 1 << 16):
            y = k[x : x + (1 << 16)]
            yield batch(lang=pa.array([name] * len(y), pa.string()), bucket=pa.array(y, pa.int32()), n=c[y])


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", part: Column | None = None) -> Model:
    """Count trigrams of all rows with text and language (where ``part`` holds).  Tasks add up their own rows first; what is
    shuffled and collected is bounded by languages times ``BUCKETS``."""
    rows = docs.where(part) if part is not None else docs
    rows = rows.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    sums = arrow_map(rows, _counts, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("c")).orderBy("lang").collect()
    logp = np.empty((BUCKETS, len(table)), np.float32)
    for k, r in enumerate(table):
        c = np.full(BUCKETS, SMOOTHING)
        c[[x.bucket for x in r.c]] += [x.n for x in r.c]
        logp[:, k] = np.log(c / c.sum())
    return Model([r.lang for r in table], logp)


def _em(lik: np.ndarray, pi: np.ndarray, doc: np.ndarray, at: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of each document under word likelihoods ``lik`` (languages x words), and the log-likelihood they give."""
    n = np.maximum(np.diff(at), 1).astype(np.float32)
    for _ in range(rounds):
        r = pi[:, doc] * lik
        r /= r.sum(0)
        pi = np.add.reduceat(r, at[:-1], axis=1) / n
    return pi, np.add.reduceat(np.log((pi[:, doc] * lik).sum(0)), at[:-1])


def infer(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text its language's index (-1: no words), that language's share, and the size of its language set."""
    docs, L = len(offsets) - 1, len(model.langs)
    lang, share, size = np.full(docs, -1), np.zeros(docs), np.zeros(docs, np.int64)
    s, e, first = K.words(data, offsets)
    count = np.diff(first)
    has = np.flatnonzero(count)
    if not len(has) or not L:
        return lang, share, size
    g, at = _grams(data, s, e)
    ll = np.empty((L, len(s)), np.float32)
    for k in range(L):
        ll[k] = np.add.reduceat(model.logp[:, k][g], at[:-1])
    ll -= ll.max(0)
    lik = np.exp(np.maximum(ll, -CLIP))
    at = np.r_[first[:-1][has], first[-1]]
    doc = np.repeat(np.arange(len(has)), count[has])
    pi, full = _em(lik, np.full((L, len(has)), 1 / L, np.float32), doc, at, ROUNDS)
    order = np.argsort(-pi, axis=0, kind="stable")
    cols = np.arange(len(has))
    top = order[0]
    best = np.add.reduceat(np.log(lik[top[doc], np.arange(len(doc))]), at[:-1])
    out_share, out_size, out_top = np.ones(len(has)), np.ones(len(has), np.int64), top.copy()
    price = PENALTY * np.log(np.maximum(count[has], 2))
    todo = cols
    for k in range(2, L + 1):
        # the mixture over all languages bounds what any set can reach: a document it cannot help is finished
        todo = todo[full[todo] + 1e-3 - (k - 1) * price[todo] > best[todo]]
        if not len(todo):
            break
        c = count[has][todo]
        a = np.r_[0, np.cumsum(c)]
        pick = np.arange(int(a[-1])) + np.repeat(at[:-1][todo] - a[:-1], c)
        own = np.repeat(np.arange(len(todo)), c)
        sub = np.stack([lik[order[r][todo][own], pick] for r in range(k)])
        start = np.stack([pi[order[r][todo], todo] for r in range(k)]) + np.float32(1e-6)
        q, got = _em(sub, start / start.sum(0), own, a, ROUNDS)
        got = got - (k - 1) * price[todo]
        win = got > best[todo]
        w = todo[win]
        r = q[:, win].argmax(0)
        best[w], out_size[w], out_share[w] = got[win], k, q[:, win].max(0)
        out_top[w] = order[r, w]
    lang[has], share[has], size[has] = out_top, np.clip(out_share, 0, 1), out_size
    return lang, share, size


def _no_letter(texts: pa.Array) -> np.ndarray:
    return ~np.asarray(pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False))


def identify(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score", size_col: str = "n_langs") -> DataFrame:
    """``docs`` with its language, the share of its words that the language explains (0 to 1), and the size of the set taken.

    Every text is read whole.  A null text, one without a letter, and any text under a model without languages is ``und`` with
    score 0.  Ties go to the language first in order of name.  Other columns are kept, but for those of an output's name, which
    are replaced.  Rows stand alone, so repeats and nulls elsewhere change nothing; an empty table gives an empty result.
    """
    docs = without(docs, [lang_col, score_col, size_col])
    names = docs.columns
    at = names.index(text_col)
    labels = np.array([*model.langs, UNKNOWN], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(at).cast(pa.string()) if not pa.types.is_string(b.column(at).type) else b.column(at)
            data, offsets = K.text_buffer(col)
            data = _LOWER[data]
            got = [infer(model, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in K.row_blocks(offsets, 1 << 20)]
            lang, share, size = (np.concatenate(x) for x in zip(*got)) if got else (np.zeros(0, int), np.zeros(0), np.zeros(0, int))
            none = _no_letter(col) | (lang < 0)
            lang, share, size = np.where(none, -1, lang), np.where(none, 0.0, share), np.where(none, 0, size)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(labels[lang], pa.string()), pa.array(share, pa.float64()), pa.array(size, pa.int32())], [*names, lang_col, score_col, size_col])

    return arrow_map(docs, run, extended(docs, f"`{lang_col}` string, `{score_col}` double, `{size_col}` int"))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows kept from training: crc32 of the id as text leaves 1 modulo 3 (a null id is in training)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, part=~held_out())
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "n_langs")
