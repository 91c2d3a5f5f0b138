"""Traces as streams: the gap and drift operators over points that arrive over time.

A stream has no recorded order, so points count in the order of their time. The batch operators are the measure:
run to its end, a stream gives what they give for dated points.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.geo import geodesic_numpy
from ..operators.cleaning import MAX_REJECTIONS, MAX_SPEED_MPS, SEGMENT_GAP_S

KEPT = "trace_id string, time timestamp, lat double, lon double, ele double"
STATE = "t long, lat double, lon double, n int"


def gap_sessions(points: DataFrame, gap_s: float = SEGMENT_GAP_S, late: str = "10 minutes") -> DataFrame:
    """A row for each run of a trace without a gap, once the watermark has passed it: times, points, extremes.

    A gap of exactly gap_s joins, as it does in batch.
    """
    session = F.session_window("time", f"{round(gap_s * 1000)} milliseconds")
    grouped = points.withWatermark("time", late).groupBy(session.alias("s"), "trace_id")
    out = grouped.agg(F.count("*").alias("points"), F.min("time").alias("start_time"), F.max("time").alias("end_time"), *[f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in ("lat", "lon", "ele")])
    return out.drop("s")


def deduplicated(points: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each fix of a device once, however often it is sent."""
    return points.withWatermark("time", late).dropDuplicatesWithinWatermark(["trace_id", "source", "time"])


def drift_filtered(points: DataFrame, max_mps: float = MAX_SPEED_MPS) -> DataFrame:
    """Plausible points as they come in. The state of a trace is its anchor and its rejections, whatever its length."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        anchor = state.get if state.exists else None
        for frame in frames:
            frame = frame.sort_values("time", kind="stable")
            kept = []
            for i, (time, lat, lon) in enumerate(zip(frame["time"], frame["lat"], frame["lon"], strict=True)):
                t = int(time.value // 1000)
                n = anchor[3] if anchor else 0
                ms = abs(t - anchor[0]) // 1000 if anchor else 0
                good = not ms or float(geodesic_numpy([anchor[1]], [anchor[2]], [lat], [lon])[0]) / (ms / 1000) <= max_mps
                if good or n >= MAX_REJECTIONS:
                    kept.append(i)
                    anchor = (t, lat, lon, n if good else 0)
                else:
                    anchor = (*anchor[:3], n + 1)
            yield frame.iloc[kept][["trace_id", "time", "lat", "lon", "ele"]]
        if anchor:
            state.update(anchor)

    return points.select("trace_id", "time", "lat", "lon", "ele").groupBy("trace_id").applyInPandasWithState(step, KEPT, STATE, "append", GroupStateTimeout.NoTimeout)
