"""Stateful detectors on Structured Streaming.

``trigger_stream`` gives, once per record, the first frame with consecutive hits; ``track_stream`` runs track association;
``windowed_counts`` and ``sessions`` are event-time aggregates with a watermark.  All read any streaming DataFrame; ``replay``
makes one of a folder of Parquet files that ends when all are read.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.tracking import TRACK_FIELDS, LiveTracks


def replay(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """The files of a folder as a stream, a few per batch, in the order of their times."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def trigger_stream(frames: DataFrame, record: str, order: str, score: str, threshold: float, consecutive: int = 2) -> DataFrame:
    """``record, order, score`` of the frame at which a record first has ``consecutive`` scores at or above the threshold.

    Frames of a record must arrive in order of batches; inside a batch they are sorted.  State is a count and a flag."""
    types = dict(frames.dtypes)
    out = f"`{record}` {types[record]}, `{order}` {types[order]}, `{score}` double"

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterable[pd.DataFrame]:
        streak, done = state.get if state.exists else (0, False)
        found = None
        pdf = pd.concat(list(parts)).sort_values(order, kind="stable")
        for o, s in zip(pdf[order], pdf[score]):
            if done:
                break
            streak = streak + 1 if s is not None and s >= threshold else 0
            if streak >= consecutive:
                found, done = (key[0], o, float(s)), True
        state.update((streak, done))
        if found:
            yield pd.DataFrame([found], columns=[record, order, score])

    return frames.select(record, order, F.col(score).cast("double").alias(score)).groupBy(record).applyInPandasWithState(step, out, "streak int, done boolean", "append", GroupStateTimeout.NoTimeout)


def track_stream(detections: DataFrame, session: str, frame: str, pos: str = "range_m", velocity: str = "velocity_mps", snr: str = "snr_db", confidence: str = "confidence") -> DataFrame:
    """Track rows after each frame; state holds the live tracks of a session, a handful of numbers each."""
    types = dict(detections.dtypes)
    out = f"`{session}` {types[session]}, `{frame}` {types[frame]}, {TRACK_FIELDS}"
    names = [x.split(" ")[0] for x in TRACK_FIELDS.split(", ")]
    kept = "next_id long, ids array<long>, ranges array<double>, velocities array<double>, snrs array<double>, confidences array<double>, ages array<long>, misses array<long>"

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterable[pd.DataFrame]:
        live = LiveTracks()
        if state.exists:
            next_id, *cols = state.get
            live = LiveTracks([list(t) for t in zip(*cols)], next_id)
        rows = []
        for f, g in pd.concat(list(parts)).groupby(frame, sort=True):
            rows += [(key[0], f, *t) for t in live.update(list(zip(*(g[c].astype(float) for c in (pos, velocity, snr, confidence)))))]
        cols = [list(c) for c in zip(*live.tracks)] or [[] for _ in names]
        state.update((live.next_id, *cols))
        yield pd.DataFrame(rows, columns=[session, frame, *names])

    return detections.groupBy(session).applyInPandasWithState(step, out, kept, "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, time: str, keys: list[str], width: str, slide: str | None = None, late: str = "10 minutes", value: Column | None = None) -> DataFrame:
    """Counts (and sums) per event-time window; rows later than the watermark are dropped by the engine."""
    aggs = [F.count("*").alias("n"), *([F.sum(value).alias("total")] if value is not None else [])]
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return events.withWatermark(time, late).groupBy(w.alias("window"), *keys).agg(*aggs)


def sessions(events: DataFrame, time: str, keys: list[str], gap: str, late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("session"), *keys).agg(F.count("*").alias("n"))


def matched(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, within: str, late: str = "10 minutes") -> DataFrame:
    """Inner join of two streams on equal keys where the right time is at or after the left one and no later than ``within``.

    Both sides have a watermark and the condition bounds the times, so the engine drops a row from its state once no row that can
    still come may match it."""
    r = right.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in right.columns if c not in keys]).withWatermark(right_time, late)
    on = F.col(right_time).between(F.col(left_time), F.col(left_time) + F.expr(f"interval {within}"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"_{k}"))
    return left.withWatermark(left_time, late).join(r, on).drop(*[f"_{k}" for k in keys])


def run_to_table(stream: DataFrame, path: str, mode: str = "append") -> tuple[DataFrame, list[dict]]:
    """Run a stream over everything available now into Parquet files under ``path``, whose log names those of finished batches alone, and
    return the table and the progress of its batches.  A second run over the same path goes on where the first ended."""
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows"), [json.loads(p.json) for p in q.recentProgress]


def write_in_batches(df: DataFrame, path: str, arrival: str, edges: list) -> None:
    """The rows of ``df`` as files that a stream reads one after the other: those up to each of the ascending ``edges`` of ``arrival``, then
    the rest, and with it those that have none."""
    lows, highs = [None, *edges], [*edges, None]
    for low, high in zip(lows, highs):
        part = df if low is None else df.where((F.col(arrival) > low) | (F.col(arrival).isNull() if high is None else F.lit(False)))
        part = part if high is None else part.where(F.col(arrival) <= high)
        part.coalesce(1).write.mode("append").parquet(path)


def run_to_memory(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over everything available now and return what it wrote (for tests and small replays)."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
