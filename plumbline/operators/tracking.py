"""Fusion, association and the tier state machine.

What one frame decides depends on the frames before it, so a record or session is streamed in order through a small state step.
The same steps serve batch and streams (``plumbline.streaming``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the tier rules.
ACCEL_BOOST = (5.0, 20.0)
SPEED_BOOST = (0.0, 35.0)
ALTITUDE_BOOST = (0.0, 200.0)
CRUISE_BANDS = ((40.0, 60.0), (100.0, 150.0))
CLIMB_BAND = (25.0, 60.0)
STEADY_FRAMES, MISS_FRAMES = 10, 5
# Fixed values of track association.
RANGE_GATE, SMOOTHING, MOST_MISSES = 280.0, 0.45, 4


def fuse_detections(parts: list[DataFrame], keys: list[str], kind: str = "kind", magnitude: str = "magnitude", ord: str = "ord") -> DataFrame:
    """Union of several detectors' events; per key the first kind by ``ord`` and the greatest magnitude, with how many fell together."""
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    return all_.groupBy(*keys).agg(F.min_by(kind, ord).alias(kind), F.max(magnitude).alias(magnitude), F.count("*").alias("events"))


def fuse_bearing(az: Column, az_sigma: Column, bearing: Column, bearing_sigma: Column, wrap: bool = True) -> Column:
    """Product of two Gaussian bearings: fused azimuth, deviation, and agreement ``exp(-d^2 / 2 (v1 + v2))``.  A zero deviation on
    one side takes that side.  With ``wrap`` differences go the short way round."""
    v1, v2 = az_sigma * az_sigma, bearing_sigma * bearing_sigma
    d = bearing - az
    d = F.pmod(d + 180.0, F.lit(360.0)) - 180.0 if wrap else d
    share = F.when((v1 > 0) & (v2 > 0), v1 / (v1 + v2)).when(v1 > 0, 1.0).otherwise(0.0)
    out = az + share * d
    out = F.pmod(out, F.lit(360.0)) if wrap else out
    var = F.when((v1 > 0) & (v2 > 0), v1 * v2 / (v1 + v2)).otherwise(0.0)
    agree = F.exp(-d * d / (2 * (v1 + v2) + 2.2250738585072014e-308))
    return F.struct(out.alias("azimuth"), F.sqrt(var).alias("sigma"), agree.alias("agreement"))


def fuse_confidence(confidence: Column, prior: Column, agreement: Column, age_s: Column, decay_s: float = 10.0) -> Column:
    """Log-odds of a track plus those of a second sensor, weighted by agreement (a penalty for disagreement) and by
    ``exp(-age / decay)``."""
    odds = lambda p: F.log(F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6)) / (1 - F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))))
    raw = odds(prior)
    z = odds(confidence) + F.exp(-F.abs(age_s) / decay_s) * (raw * agreement - F.abs(raw) * (1 - agreement))
    return 1 / (1 + F.exp(-z))


def decisions_to_tracks(decisions: DataFrame, keys: list[str], order: str, statistic: str) -> DataFrame:
    """Detected cells numbered from 0 by order, with confidence statistic / threshold."""
    from .prefix import row_numbers

    d = decisions.where("detected and evaluated").withColumn("confidence", F.col(statistic) / F.col("threshold"))
    return row_numbers(d, keys, order, "track_id").withColumn("track_id", F.col("track_id") - 1)


@dataclass
class TierState:
    """One record's tier, the counts that decide when it is left, and the last frames' speed, acceleration and height."""

    tier: str = "none"
    steady: int = 0
    misses: int = 0
    recent: list[bool] = field(default_factory=list)  # boost-like steps between the last six frames
    last: tuple | None = None

    def step(self, speed: float, accel: float, altitude_rate: float, boost_pair: bool | None) -> str:
        """The tier that owns this frame.  Counts change after the decision, so a cruise can end on a frame that is in band."""
        if boost_pair is not None:
            self.recent = [*self.recent[-4:], boost_pair]
        cruise = any(lo <= speed <= hi for lo, hi in CRUISE_BANDS)
        before = self.tier
        if before == "none":
            self.tier = "boost" if sum(self.recent) >= 3 else "none"
        elif before == "boost":
            self.tier = "climb" if accel < ACCEL_BOOST[0] and speed >= CLIMB_BAND[0] else "boost"
        elif before == "climb":
            self.tier = "cruise" if self.steady + 1 >= STEADY_FRAMES and cruise and accel < 0.5 and altitude_rate < 1.0 else "climb"
        elif self.misses + 1 >= MISS_FRAMES:
            self.tier = "none"
        self.steady = self.steady + 1 if accel < 0.5 and altitude_rate < 1.0 else 0
        self.misses = 0 if cruise else self.misses + 1
        if self.tier != before:
            self.steady = self.misses = 0
        return self.tier

    def confidence(self, speed: float, accel: float) -> float:
        if self.tier == "none":
            return 0.0
        sure = {
            "boost": SPEED_BOOST[0] <= speed <= SPEED_BOOST[1] and ACCEL_BOOST[0] <= accel <= ACCEL_BOOST[1],
            "climb": CLIMB_BAND[0] <= speed <= CLIMB_BAND[1],
            "cruise": any(lo <= speed <= hi for lo, hi in CRUISE_BANDS),
        }[self.tier]
        return 1.0 if sure else 0.5


def in_order(df: DataFrame, key: str, order: list[str], start: Callable[[], object], step: Callable[[object, dict], list[tuple]], end: Callable[[object], list[tuple]], schema: str) -> DataFrame:
    """Feed each key's rows in order to a small state.  Rows are dealt by key and sorted, and a task streams them, so a key's rows
    are never held together; ``step`` gives the rows that a row completes, ``end`` those that the key's end does."""
    names = [x.split(" ")[0].strip("`") for x in schema.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, None
        for pdf in parts:
            out: list[tuple] = []
            for row in pdf.to_dict("records"):
                if state is None or row[key] != at:
                    out += end(state) if state is not None else []
                    at, state = row[key], start()
                out += step(state, row)
            yield pd.DataFrame(out, columns=names)
        if state is not None:
            yield pd.DataFrame(end(state), columns=names)

    return df.repartition(F.col(key)).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def assign_tiers(frames: DataFrame, record: str, time: str, speed: str, altitude: str) -> DataFrame:
    """``frames`` with the tier of each and its confidence, by record and in order of time."""
    names = frames.columns
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in frames.schema.fields], "tier string", "tier_confidence double"])

    def step(s: TierState, row: dict) -> list[tuple]:
        t, radial, h = row[time], row[speed], row[altitude]
        v, accel, climb, pair = abs(radial), 0.0, 0.0, None
        if s.last is not None and t > s.last[0]:
            accel, climb = abs(radial - s.last[1]) / (t - s.last[0]), abs(h - s.last[2]) / (t - s.last[0])
            pair = SPEED_BOOST[0] <= v <= SPEED_BOOST[1] and ACCEL_BOOST[0] <= accel <= ACCEL_BOOST[1] and ALTITUDE_BOOST[0] <= h <= ALTITUDE_BOOST[1]
        s.last = (t, radial, h)
        return [(*(row[c] for c in names), s.step(v, accel, climb, pair), s.confidence(v, accel))]

    return in_order(frames, record, [time], TierState, step, lambda s: [], schema)


@dataclass
class LiveTracks:
    """The tracks of one session: ``[id, range, velocity, snr, confidence, age, misses]``; ids count from 1."""

    tracks: list[list] = field(default_factory=list)
    next_id: int = 1
    frame: object = None
    waiting: list[tuple] = field(default_factory=list)

    def update(self, detections: list[tuple]) -> list[list]:
        """Detections ``(range, velocity, snr, confidence)``, each in turn, take the nearest track not yet taken within the gate: it
        moves towards them and has their snr and confidence.  Tracks that are missed too often end; what is left over starts new ones."""
        free = set(range(len(self.tracks)))
        new = []
        for r, v, snr, sure in detections:
            near = min(((abs(self.tracks[i][1] - r), i) for i in free), default=None)
            if near is None or near[0] >= RANGE_GATE:
                new.append([self.next_id + len(new), r, v, snr, sure, 1, 0])
                continue
            t = self.tracks[near[1]]
            free.discard(near[1])
            t[1] += SMOOTHING * (r - t[1])
            t[2] += SMOOTHING * (v - t[2])
            t[3], t[4], t[5], t[6] = snr, sure, t[5] + 1, 0
        for i in free:
            self.tracks[i][6] += 1
        self.tracks = [t for t in self.tracks if t[6] <= MOST_MISSES] + new
        self.next_id += len(new)
        return self.tracks


TRACK_FIELDS = "track_id long, range_m double, velocity_mps double, snr_db double, confidence double, age_frames long, misses long"


def associate(detections: DataFrame, session: str, frame: str, ord: str, pos: str = "range_m", velocity: str = "velocity_mps", snr: str = "snr_db", confidence: str = "confidence") -> DataFrame:
    """Track rows after every frame of every session; detections of a frame count in order of ``ord``."""
    types = dict(detections.dtypes)
    schema = f"`{session}` {types[session]}, `{frame}` {types[frame]}, {TRACK_FIELDS}"

    def close(s: LiveTracks) -> list[tuple]:
        key, s.waiting, got = s.waiting[0][0], [], [x[1:] for x in s.waiting]
        return [(key, s.frame, *t) for t in s.update(got)]

    def step(s: LiveTracks, row: dict) -> list[tuple]:
        out = close(s) if s.waiting and row[frame] != s.frame else []
        s.frame = row[frame]
        s.waiting.append((row[session], row[pos], row[velocity], row[snr], row[confidence]))
        return out

    return in_order(detections.select(session, frame, ord, pos, velocity, snr, confidence), session, [frame, ord], LiveTracks, step, lambda s: close(s) if s.waiting else [], schema)
