"""Token counts without tokenizing: a count-only Viterbi pass over a unigram vocabulary.

The tokenizer is a unigram model with byte fallback over the pieces and scores of a vocabulary file.  Text is cut before every
space; each word is ``\\u2581`` and its characters, and is segmented on its own.  An Aho-Corasick automaton enumerates, at every
end position, all pieces that end there; dynamic programming carries the best score and the number of tokens of the path that
has it.  Tie rules are those of the tokenizer: of equal scores the piece with the earlier start wins, and a character that no
one-character piece covers may also be unknown, at the least score minus ten; a run of unknown characters is written in bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, extended, without

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Words whose counts a worker remembers; beyond it the memory is emptied and fills anew.
CACHE_WORDS = 500_000
#: Longest word that is remembered.
_CACHE_CHARS = 40
SPACE = "▁"
_UNK_PENALTY = 10.0


def load_pieces(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a vocabulary file, without control pieces, user symbols of ``\\u2581`` alone and byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = (i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)))
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in ids if SPACE not in sp.id_to_piece(i)[1:]]


class Counter:
    """Token counts of words and texts under one vocabulary."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self.auto = ahocorasick.Automaton()
        for piece, score in pieces:
            self.auto.add_word(piece, (len(piece) - 1, score))
        self.auto.make_automaton()
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.unk = min((s for _, s in pieces), default=0.0) - _UNK_PENALTY
        self.seen: dict[str, int] = {}

    def word(self, w: str) -> int:
        """Tokens of one word, which begins with ``\\u2581``."""
        n = len(w)
        best, count = [0.0] + [-math.inf] * n, [0] * (n + 1)
        hits = self.auto.iter(w) if len(self.auto) else ()  # by end, and of one end the longest, so the earliest start, first
        if self.single.issuperset(w):  # every end is reached by pieces
            for end, (back, score) in hits:
                s = best[end - back] + score
                if s > best[end + 1]:
                    best[end + 1] = s
                    count[end + 1] = count[end - back] + 1
            return count[n]
        done = 0  # ends that are settled
        for end, (back, score) in [*hits, (n, (n, 0.0))]:
            while done < end:
                c = w[done]
                if c not in self.single and best[done] + self.unk > best[done + 1]:
                    best[done + 1] = best[done] + self.unk
                    count[done + 1] = count[done] + len(c.encode("utf-8", "surrogatepass"))
                done += 1
            if end < n:
                s = best[end - back] + score
                if s > best[end + 1]:
                    best[end + 1] = s
                    count[end + 1] = count[end - back] + 1
        return count[n]

    def text(self, t: str) -> tuple[int, int]:
        """Tokens and words of one text."""
        if not t:
            return 0, 0
        words = t.replace(SPACE, " ").split(" ")
        if not words[0]:
            words = words[1:]
        seen = self.seen
        new = set(words).difference(seen)
        if new:
            if len(seen) > CACHE_WORDS:
                seen.clear()
                new = set(words)
            long = {}
            for w in new:
                (seen if len(w) <= _CACHE_CHARS else long)[w] = self.word(SPACE + w)
            if long:
                return sum(seen[w] if w in seen else long[w] for w in words), len(words)
        return sum(map(seen.__getitem__, words)), len(words)


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """The counter of a vocabulary file, built once in each worker."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(load_pieces(path))
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY, out_col: str = "n_tokens", words_col: str = "n_words") -> DataFrame:
    """``docs`` with the number of tokens and of words of its texts; other columns are kept.

    Every text is counted whole, however long; a null or empty one counts 0.  Rows stand alone, so ties, repeats and nulls in
    other columns change nothing; columns of an output's name are replaced.  An empty table gives an empty result.  The vocabulary file must lie at the same path on every executor.
    """
    docs = without(docs, [out_col, words_col])
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(vocabulary)
        for b in batches:
            got = np.array([c.text(t or "") for t in b.column(at).to_pylist()], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got[:, 0]), pa.array(got[:, 1])], [*names, out_col, words_col])

    return arrow_map(docs, run, extended(docs, f"`{out_col}` long, `{words_col}` long"))


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs).select("doc_id", "n_tokens", "n_words")
