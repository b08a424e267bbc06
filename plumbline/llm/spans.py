"""Spans found in texts: one shape for all scanners, and what queries and pipelines derive from it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, extended, without

SPAN_TYPE = "array<struct<kind:string,start:int,end:int,base:boolean>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))


def span_array(rows: list[list[tuple[str, int, int, bool]]]) -> pa.Array:
    """Lists of ``(kind, start, end, base)``, one per row, as an Arrow column."""
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    flat = [x for r in rows for x in r]
    kind, start, end, base = zip(*flat) if flat else ((), (), (), ())
    values = pa.StructArray.from_arrays([pa.array(kind, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(base, pa.bool_())], ["kind", "start", "end", "base"])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def scan(docs: DataFrame, find: Callable[[pa.Array], list[list[tuple[str, int, int, bool]]]], text_col: str, out_col: str = "spans") -> DataFrame:
    """``docs`` with a column of spans, which replaces one of the same name; every other column is kept.  ``find`` maps a text
    column to sorted spans per row."""
    docs = without(docs, [out_col])
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(at)
            found = span_array(find(col.cast(pa.string()) if not pa.types.is_string(col.type) else col))
            yield pa.RecordBatch.from_arrays([*b.columns, found], [*names, out_col])

    return arrow_map(docs, run, extended(docs, f"`{out_col}` {SPAN_TYPE}"))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined in their order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame, id_col: str, kinds: list[str], spans: str = "spans") -> DataFrame:
    """One row per document: counts of the base kinds, the hash of the base spans, all spans."""
    base = F.filter(F.col(spans), lambda s: s["base"])
    count = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    extra = F.size(F.filter(F.col(spans), lambda s: ~s["base"])).cast("long").alias("n_added")
    return found.select(F.col(id_col), *[count(k) for k in kinds], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col(spans)).alias("spans"), extra)


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """``text`` with each span, or run of overlapping spans, replaced by its mark."""
    out, at = [], 0
    for start, end, mark in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])
