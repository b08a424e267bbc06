"""I-Match fingerprints: terms within a band of inverse document frequency, sorted, hashed over several randomised lexicon subsets.

The lexicon holds the terms whose share of all documents lies in the band.  It is bounded whatever the corpus: a document of ``m``
distinct terms adds to the counts of ``m`` of them, so at most (mean of m) / (least share) terms reach the least share.  Tasks hold
up to ``MOST_TERMS`` of them, the most frequent ones first; the others stay in a table that the terms of the texts are joined with.

Subsets are drawn by a hash of the term: at level ``l`` each of four independent hash fields deals the lexicon out to ``2^l`` subsets,
of which the first 32 are used.  A text of ``m`` terms takes the level at which a subset holds a quarter to a half of one of its
terms on average, and the next, so that a changed term changes few of its subsets; texts of like size share a level.  A fingerprint
is ``all:level:entries``: the hash of all its terms, the lower level, and for each subset that holds a term of the text the subset
and the hash of the terms it holds.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, cut, discard, extended, free_name, partitions, without

#: Band: terms of at least this share of the documents, and of at most this one.
LEAST_SHARE, MOST_SHARE = 0.0001, 0.25
#: A text takes all its terms when fewer than one in so many lies in the band.
ONE_IN = 3
#: Terms of the lexicon that every task holds, 8 bytes each; further ones are joined.
MOST_TERMS = 4_000_000
FIELDS, SUBSETS = 4, 32
#: Bytes of terms stay, A-Z in lower case; all others part terms.
_TERM_BYTES = bytes(c if c >= 0x80 or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 0x20 for c in range(256))


def terms_of(text: str | None) -> set[bytes]:
    """Distinct runs of ASCII letters and digits and of other characters, A-Z in lower case."""
    return set((text or "").encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split())


#: Terms that a task remembers.
REMEMBERED = 200_000


def _keys(digests: list[bytes]) -> np.ndarray:
    """First halves of digests."""
    return np.frombuffer(b"".join(digests), ">u8")[::2].astype(np.uint64)


def _within(keys: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Which of ``keys`` are in the sorted ``found``."""
    if not len(found):
        return np.zeros(len(keys), bool)
    return found[np.minimum(np.searchsorted(found, keys), len(found) - 1)] == keys


def _no_keys() -> np.ndarray:
    return np.zeros(0, np.uint64)


@dataclass
class Lexicon:
    """First halves of the MD5 of the terms in the band, sorted.  If they are more than tasks hold, ``rest`` is a table of the
    other terms' ``key``, and ``above`` those of the terms too frequent for the band, which need no look-up there."""

    keys: np.ndarray
    above: np.ndarray = field(default_factory=_no_keys)
    rest: DataFrame | None = None

    def holds(self, keys: np.ndarray) -> np.ndarray:
        return _within(keys, self.keys)

    def held(self) -> Lexicon:
        """What tasks hold."""
        return Lexicon(self.keys, self.above)

    def unsettled(self, words: set[bytes]) -> np.ndarray:
        """Keys of the words that may be in ``rest``."""
        keys = np.unique(_keys([hashlib.md5(w).digest() for w in words]))
        return keys[~self.holds(keys) & ~_within(keys, self.above)].view(np.int64)


class Band(dict):
    """Terms with their MD5, which is empty if they are not in a lexicon; each is looked up once while it is remembered.
    ``found`` are the keys in the lexicon's table among those of the texts at hand."""

    def __init__(self, lexicon: Lexicon) -> None:
        super().__init__()
        self.lexicon = lexicon
        self.found = _no_keys()

    def of(self, words: set[bytes]) -> dict[bytes, bytes]:
        """Those of the words that are in the lexicon, with their MD5."""
        got = list(map(self.get, words))
        if None in got:
            new = [w for w, d in zip(words, got) if d is None]
            digests = [hashlib.md5(w).digest() for w in new]
            keys = _keys(digests)
            inside = self.lexicon.holds(keys) | _within(keys, self.found)
            found = dict(zip(new, [d if k else b"" for d, k in zip(digests, inside.tolist())]))
            got = [found[w] if d is None else d for w, d in zip(words, got)]
            if len(self) + len(found) > REMEMBERED:
                self.clear()
            self.update(found)
        return {w: d for w, d in zip(words, got) if d}


def fit_lexicon(docs: DataFrame, text_col: str = "text", least: float = LEAST_SHARE, most: float = MOST_SHARE) -> Lexicon:
    """The terms that ``least`` to ``most`` of all rows hold, counted over whole texts; every row counts, copies too."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = Counter(chain.from_iterable(terms_of(t) for t in b.column(0).to_pylist()))
            key, n = _keys([hashlib.md5(w).digest() for w in held]), np.fromiter(held.values(), np.int64, len(held))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["key", "n"])

    rows = docs.count()
    counts = arrow_map(docs.select(f"`{text_col}`"), count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    table = cut(counts.where(F.col("n") >= least * rows), "lexicon")
    band = table.where(F.col("n") <= most * rows)
    bits = F.length(F.bin("n"))
    sizes = sorted(((r[0], r[1]) for r in band.groupBy(bits.alias("bits")).count().collect()), reverse=True)
    if sum(n for _, n in sizes) <= MOST_TERMS:
        out = Lexicon(_collected(band))
    else:
        room = MOST_TERMS
        for level, n in sizes:  # frequent terms are held, so that no key of the join has very many texts
            if n > room:
                break
            room -= n
        is_held = (bits > level) | ((bits == level) & (F.pmod("key", F.lit(1 << 30)) < int(room / n * (1 << 30))))
        out = Lexicon(_collected(band.where(is_held)), _collected(table.where(F.col("n") > most * rows)), cut(band.where(~is_held).select("key"), "lexicon-rest"))
    discard(table)
    return out


def _collected(terms: DataFrame) -> np.ndarray:
    return np.sort(terms.select("key").toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64))


def _looked_up(table: DataFrame, row: str, asked: DataFrame, lexicon: Lexicon, out_col: str) -> DataFrame:
    """``table``, whose ``row`` is unique, with those keys of ``asked(row, keys)`` that are in the lexicon's table."""
    each = asked.select("row", F.explode("keys").alias("key"))
    found = each.join(lexicon.rest, "key").groupBy("row").agg(F.collect_list("key").alias(out_col)).withColumnRenamed("row", row)
    return table.join(found, row, "left")


def _sorted_keys(found: list[int] | None) -> np.ndarray:
    return np.sort(np.array(found or [], np.int64).view(np.uint64))


@dataclass
class Mark:
    """A fingerprint: the hash of all terms, and the entries of two levels from the lower one on."""

    whole: str
    level: int
    entries: tuple[list[str], list[str]]

    def __str__(self) -> str:
        return f"{self.whole}:{self.level}:{','.join(self.entries[0] + self.entries[1])}"

    @classmethod
    def read(cls, text: str) -> Mark:
        whole, level, entries = text.split(":")
        found = [e for e in entries.split(",") if e]
        return cls(whole, int(level), tuple([e for e in found if e.startswith(f"{at}.")] for at in (int(level), int(level) + 1)))

    def like(self, other: Mark) -> float:
        if self.whole == other.whole:
            return 1.0
        both = size = 0
        for at in range(max(self.level, other.level), min(self.level, other.level) + 2):
            x, y = self.entries[at - self.level], other.entries[at - other.level]
            both, size = both + len({*x}.intersection(y)), size + len(x) + len(y)
        return 2 * both / size if size else 0.0


def mark(text: str | None, band: Band) -> Mark:
    """The fingerprint of one text.  A text with too few terms in the band takes all its terms; one without a term is its own
    single term, so the empty text and null have one fingerprint."""
    words = terms_of(text) or {(text or "").encode("utf-8", "surrogatepass")}
    chosen = band.of(words)
    if len(chosen) * ONE_IN < len(words):
        chosen = {w: hashlib.md5(w).digest() for w in words}
    words = sorted(chosen)
    known = [chosen[w] for w in words]
    fields = np.frombuffer(b"".join(known), ">u4").reshape(-1, FIELDS).astype(np.uint32)
    level = min(len(words).bit_length() + 1, 30)
    # one more bit of a field parts each subset of the lower level in two of the next
    cell = fields >> np.uint32(31 - level)
    term, field = np.nonzero(cell < 2 * SUBSETS)
    half = field * (2 * SUBSETS) + cell[term, field]
    order = np.argsort(half, kind="stable")
    held = list(zip(half[order].tolist(), term[order].tolist()))
    lower = _entries(words, known, _labels(level), [(h >> 1, i) for h, i in held])
    upper = _entries(words, known, _labels(level + 1), [((h // (2 * SUBSETS)) * SUBSETS + h % (2 * SUBSETS), i) for h, i in held if h % (2 * SUBSETS) < SUBSETS])
    return Mark(hashlib.md5(b" ".join(words)).hexdigest()[:16], level, (lower, upper))


@cache
def _labels(level: int) -> list[str]:
    return [f"{level}.{f}.{c}=" for f in range(FIELDS) for c in range(SUBSETS)]


def _entries(words: list[bytes], known: list[bytes], labels: list[str], held: list[tuple[int, int]]) -> list[str]:
    """For each subset, its name and the hash of the words it holds, in their order."""
    out, last, several = [], -1, []
    for at, i in held:
        if at != last:
            out.append(labels[at] + known[i][:4].hex())
            last, several = at, [i]
        else:
            several.append(i)
            out[-1] = labels[at] + hashlib.md5(b" ".join([words[x] for x in sorted(several)])).hexdigest()[:8]
    return out


def fingerprint(text: str | None, lexicon: Lexicon) -> str:
    """``mark`` as text."""
    band = Band(lexicon)
    if lexicon.rest is not None:
        band.found = _collected(lexicon.rest.where(F.col("key").isin(lexicon.unsettled(terms_of(text)).tolist())))
    return str(mark(text, band))


def likeness(a: str, b: str) -> float:
    """0 to 1: twice the number of subsets with equal hashes over the number of subsets with a term, at the levels that both
    fingerprints have; 1 for equal ones, 0 without a common level."""
    return Mark.read(a).like(Mark.read(b))


def fingerprints(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of each text; a column of that name is replaced.  Null is fingerprinted as the empty text."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon.held())
    docs = without(docs, [out_col])
    schema, found = extended(docs, f"`{out_col}` string"), None
    names = schema.names
    if lexicon.rest is not None:
        row, found = free_name(docs, "row"), free_name(docs, "found")
        table = cut(docs.withColumn(row, F.monotonically_increasing_id()), "texts")

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keys = [shared.value.unsettled(terms_of(t)) for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.list_(pa.int64()))], ["row", "keys"])

        docs = _looked_up(table, row, arrow_map(table.select(f"`{row}`", f"`{text_col}`"), ask, "row long, keys array<long>"), lexicon, found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band = Band(shared.value)
        for b in batches:
            out = []
            for t, keys in zip(b.column(text_col).to_pylist(), b.column(found).to_pylist() if found else [None] * b.num_rows):
                band.found = _sorted_keys(keys)
                out.append(str(mark(t, band)))
            yield b.append_column(out_col, pa.array(out, pa.string())).select(names)

    return arrow_map(docs, run, schema)


def spliced(text: str, after: str) -> str:
    """``text`` with its last quarter replaced by the first as many code points of ``after``."""
    n = len(text) // 4
    return text[: len(text) - n] + after[:n]


#: Ids that are drawn for the bounds of a range, for each partition.
DRAWS = 40
#: Where null ids stand.
NO_ID = -(1 << 63)


def in_order(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` dealt out by ranges of ``doc_id`` and text hash, as ``(part, tail, doc_id, h, packed)`` sorted in each
    partition; the first row of every range also ends the range before it, with ``tail`` true, and that of the first the last.

    Texts cross the network once, compressed.  Bounds are rows of a hash sample of bounded size.  Null ids come first.
    """
    spark, width = docs.sparkSession, partitions(docs.sparkSession)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    at = F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("i"), F.col("h"))
    rows, first = keyed.agg(F.count("*"), F.min(at)).first()
    if not rows:
        return spark.createDataFrame([], "part int, tail boolean, doc_id long, h long, packed binary")
    share = min(1.0, DRAWS * width / rows)
    drawn = sorted(tuple(r[0]) for r in keyed.where(F.pmod(F.xxhash64("doc_id", "h"), F.lit(1 << 30)) <= int(share * (1 << 30))).select(at).distinct().collect())
    bounds = sorted({tuple(first), *(drawn[len(drawn) * k // width] for k in range(1, width) if drawn)})

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            ids, hs, texts = (b.column(c).to_pylist() for c in ("doc_id", "h", "text"))
            out = []
            for i, h, t in zip(ids, hs, texts):
                key, packed = (NO_ID if i is None else i, h), pack(t.encode("utf-8", "surrogatepass"))
                k = bisect_right(bounds, key) - 1
                out.append((k, False, i, h, packed))
                if bounds[k] == key:
                    out.append(((k or len(bounds)) - 1, True, i, h, packed))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()))], ["part", "tail", "doc_id", "h", "packed"])

    dealt = arrow_map(keyed, deal, "part int, tail boolean, doc_id long, h long, packed binary").repartitionById(len(bounds), F.col("part"))
    return dealt.sortWithinPartitions("tail", F.col("doc_id").asc_nulls_first(), "h")


def op11_imatch(spark, sf_dir: str) -> DataFrame:
    """Each text's fingerprint beside that of its edited text and of the next document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return edited_fingerprints(docs, fit_lexicon(docs))


def edited_fingerprints(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` of every row of
    ``docs(doc_id, text)``.  The next document of the last is the first; a single row is its own next.  Rows that repeat an id are in
    order of a hash of their texts."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon.held())
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def rows(band: Band, texts: Iterator[tuple[int | None, bytes]]) -> Iterator[tuple]:
        unpack, last = zstandard.ZstdDecompressor().decompress, None
        for i, packed in texts:
            text = unpack(packed).decode("utf-8", "surrogatepass")
            own = mark(text, band)
            if last is not None:
                yield _row(*last, text, own, band)
            last = (i, text, own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in _batched(rows(Band(shared.value), _in_range(batches))):
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names)

    if lexicon.rest is None:
        return arrow_map(in_order(docs), run, schema)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            for row, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                texts = [unpack(p).decode("utf-8", "surrogatepass") for p in packed]
                words = set().union(*map(terms_of, texts), *(terms_of(spliced(t, after)) for t, after in zip(texts, texts[1:])))
                yield pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), pa.array([shared.value.unsettled(words)], pa.list_(pa.int64()))], ["row", "keys"])

    def run_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band = Band(shared.value)
        for b in batches:
            for ids, packed, found in zip(*(b.column(c).to_pylist() for c in ("ids", "packed", "found"))):
                band.found = _sorted_keys(found)
                for out in _batched(rows(band, zip([*ids, None], packed))):
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names)

    blocks = cut(arrow_map(in_order(docs), _blocks, "row long, ids array<long>, packed array<binary>"), "blocks")
    asked = arrow_map(blocks.select("row", "packed"), ask, "row long, keys array<long>")
    return arrow_map(_looked_up(blocks, "row", asked, lexicon, "found"), run_blocks, schema)


#: Rows of a batch that is handed back, and compressed bytes of a block of texts whose terms are looked up together.
OUT_ROWS, BLOCK = 1000, 1 << 18


def _batched(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    while out := list(islice(rows, OUT_ROWS)):
        yield out


def _in_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, bytes]]:
    """Ids and packed texts of a range of ``in_order``, up to the row that begins the next."""
    ended = False
    for b in batches:
        for tail, i, packed in zip(*(b.column(c).to_pylist() for c in ("tail", "doc_id", "packed"))):
            if ended:  # further copies of the row that begins the next range
                break
            yield i, packed
            ended = tail


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of rows, each with the text after it; in a block a term is looked up once, however many texts hold it."""

    def block() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), pa.array([ids[:-1]], pa.list_(pa.int64())), pa.array([packed], pa.list_(pa.binary()))], ["row", "ids", "packed"])

    row, ids, packed, size = TaskContext.get().partitionId() << 33, [], [], 0
    for i, p in _in_range(batches):
        ids.append(i), packed.append(p)
        size += len(p)
        if size >= BLOCK and len(ids) > 1:
            yield block()
            row, ids, packed, size = row + 1, [i], [p], len(p)
    if len(ids) > 1:
        yield block()


def _row(i: int | None, text: str, own: Mark, after: str, next_mark: Mark, band: Band) -> tuple:
    edited = spliced(text, after)
    other = mark(edited, band)
    return i, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), str(own), str(other), own.like(other), own.like(next_mark)


OP11_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
nx AS (SELECT *, coalesce(lead(text) OVER w, first_value(text) OVER w) AS nt FROM d WINDOW w AS (ORDER BY doc_id NULLS FIRST)),
ed AS (SELECT *, left(text, n - n // 4) || left(nt, n // 4) AS edited FROM nx),
texts AS (SELECT text AS t FROM ed UNION SELECT edited FROM ed),
found AS (SELECT t, list_distinct(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM texts),
counts AS (SELECT term, count(*) AS n FROM (SELECT unnest(w) AS term FROM d JOIN found ON d.text = found.t) GROUP BY 1),
lexicon AS (SELECT term FROM counts, (SELECT count(*) AS rows FROM d) WHERE n >= 0.0001::DOUBLE * rows AND n <= 0.25::DOUBLE * rows),
terms AS (SELECT t, unnest(CASE WHEN len(w) = 0 THEN [t] ELSE w END) AS term FROM found),
flagged AS (SELECT t, terms.term, lexicon.term IS NOT NULL AS inside FROM terms LEFT JOIN lexicon ON terms.term = lexicon.term),
kept AS (SELECT t, term FROM flagged QUALIFY inside OR 3 * count(*) FILTER (inside) OVER (PARTITION BY t) < count(*) OVER (PARTITION BY t)),
wholes AS (SELECT t, length(bin(count(*))) + 1 AS level, substr(md5(string_agg(term, ' ' ORDER BY term)), 1, 16) AS whole FROM kept GROUP BY t),
cells AS (SELECT t, term, lv, f, CAST('0x' || substr(md5(term), CAST(f * 8 + 1 AS BIGINT), 8) AS BIGINT) >> (32 - lv) AS c
  FROM (SELECT k.t, term, unnest([level, level + 1]) AS lv FROM kept k JOIN wholes USING (t)), range(4) r(f)),
entries AS (SELECT t, lv, f, c, lv || '.' || f || '.' || c || '=' || substr(md5(string_agg(term, ' ' ORDER BY term)), 1, 8) AS entry FROM cells WHERE c < 32 GROUP BY t, lv, f, c),
marks AS (SELECT t, whole, level, coalesce(list(entry ORDER BY lv, f, c) FILTER (entry IS NOT NULL), []) AS es, coalesce(list(lv ORDER BY lv, f, c) FILTER (entry IS NOT NULL), []) AS ats
  FROM wholes LEFT JOIN entries USING (t) GROUP BY t, whole, level),
pairs AS (SELECT a.t AS ta, b.t AS tb, a.whole = b.whole AS same,
    list_filter(a.es, lambda e, i: a.ats[i] BETWEEN greatest(a.level, b.level) AND least(a.level, b.level) + 1) AS x,
    list_filter(b.es, lambda e, i: b.ats[i] BETWEEN greatest(a.level, b.level) AND least(a.level, b.level) + 1) AS y
  FROM (SELECT text AS p, edited AS q FROM ed UNION SELECT text, nt FROM ed) JOIN marks a ON a.t = p JOIN marks b ON b.t = q),
likes AS (SELECT ta, tb, CASE WHEN same THEN 1.0 WHEN len(x) + len(y) = 0 THEN 0.0 ELSE 2 * len(list_intersect(x, y)) / CAST(len(x) + len(y) AS DOUBLE) END AS s FROM pairs)
SELECT doc_id, n AS n_chars, sha256(edited) AS edited_sha256, a.whole || ':' || a.level || ':' || array_to_string(a.es, ',') AS fingerprint,
  b.whole || ':' || b.level || ':' || array_to_string(b.es, ',') AS edited_fingerprint, CAST(le.s AS DOUBLE) AS near_edited, CAST(ln.s AS DOUBLE) AS near_next
FROM ed JOIN marks a ON a.t = text JOIN marks b ON b.t = edited JOIN likes le ON le.ta = text AND le.tb = edited JOIN likes ln ON ln.ta = text AND ln.tb = nt
"""
