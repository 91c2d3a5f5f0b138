"""Lengths, climbs, counts, ranges and summaries of traces.

A segment boundary is a gap: nothing is summed across one. What is missing stays missing, it is not zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import with_geodesic
from .points import ORDER, SEGMENT, TRACE, TRACK, along

#: Metres that an elevation must move by to count.
NOISE_M = 3.0


def steps(points: DataFrame, back: int = 1, out: str = "step_m") -> DataFrame:
    """points with the distance from the one `back` before it in its segment; NULL for the first."""
    lagged = points.withColumns({"_plat": F.lag("lat", back).over(along()), "_plon": F.lag("lon", back).over(along())})
    return with_geodesic(lagged, "_plat", "_plon", "lat", "lon", out).drop("_plat", "_plon")


def segment_lengths(points: DataFrame) -> DataFrame:
    """Metres along each segment; 0 for a single point."""
    return steps(points).groupBy(*SEGMENT).agg(F.coalesce(F.sum("step_m"), F.lit(0.0)).alias("length_m"))


def trace_lengths(points: DataFrame) -> DataFrame:
    return steps(points).groupBy(*TRACE).agg(F.coalesce(F.sum("step_m"), F.lit(0.0)).alias("length_m"))


def counts(points: DataFrame) -> DataFrame:
    """Tracks, segments and points of each trace, as far as points tell: empty ones need the nested form."""
    by_segment = points.groupBy(*SEGMENT).agg(F.count("*").alias("n"))
    by_track = by_segment.groupBy(*TRACK).agg(F.count("*").alias("s"), F.sum("n").alias("n"))
    return by_track.groupBy(*TRACE).agg(F.count("*").alias("tracks"), F.sum("s").alias("segments"), F.sum("n").alias("points"))


def nested_counts(traces: DataFrame) -> DataFrame:
    """The same of nested traces, empty tracks and segments included."""
    total = lambda xs, f: F.aggregate(xs, F.lit(0).cast("bigint"), lambda a, x: a + f(x))
    segments = total("tracks", lambda t: F.size(t["segments"]))
    n = total("tracks", lambda t: F.aggregate(t["segments"], F.lit(0).cast("bigint"), lambda a, s: a + F.size(s["points"])))
    return traces.select("trace_id", F.size("tracks").cast("bigint").alias("tracks"), segments.alias("segments"), n.alias("points"), (n == 0).alias("is_empty"))


def track_counts(points: DataFrame) -> DataFrame:
    """Points and start of each track."""
    return points.groupBy(*TRACK).agg(F.count("*").alias("points"), F.min("time").alias("start_time"))


def time_ranges(points: DataFrame) -> DataFrame:
    """Earliest and latest time, wherever they stand."""
    return points.groupBy(*TRACE).agg(F.min("time").alias("start_time"), F.max("time").alias("end_time"))


def bounds(points: DataFrame) -> DataFrame:
    """Extremes of the coordinates; the antimeridian is not special."""
    return points.groupBy(*TRACE).agg(*[f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in ("lat", "lon")])


def bbox(min_lon: str = "min_lon", min_lat: str = "min_lat", max_lon: str = "max_lon", max_lat: str = "max_lat") -> Column:
    """Longitude first."""
    return F.array(min_lon, min_lat, max_lon, max_lat)


def climbed(elevations: Column, threshold_m: float = NOISE_M) -> Column:
    """(gain, loss) of elevations in order: the level follows only where it moves by more than threshold_m."""
    start = F.struct(F.lit(None).cast("double").alias("level"), F.lit(0.0).alias("gain"), F.lit(0.0).alias("loss"))

    def step(a: Column, e: Column) -> Column:
        moved = F.abs(e - a["level"]) > threshold_m
        rise = F.when(moved & (e > a["level"]), e - a["level"]).otherwise(0.0)
        fall = F.when(moved & (e < a["level"]), a["level"] - e).otherwise(0.0)
        return F.struct(F.when(a["level"].isNull() | moved, e).otherwise(a["level"]).alias("level"), (a["gain"] + rise).alias("gain"), (a["loss"] + fall).alias("loss"))

    return F.aggregate(elevations, start, step)


def segment_climbs(points: DataFrame, threshold_m: float = NOISE_M) -> DataFrame:
    """Gain, loss, least and greatest elevation of each segment with any; the level starts anew in each."""
    known = points.filter("ele is not null").groupBy(*SEGMENT).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pt_idx", "ele"))), lambda x: x["ele"]).alias("e"), F.min("ele").alias("min_m"), F.max("ele").alias("max_m")
    )
    out = known.select(*SEGMENT, "min_m", "max_m", climbed(F.col("e"), threshold_m).alias("c"))
    return out.select(*SEGMENT, F.col("c.gain").alias("gain_m"), F.col("c.loss").alias("loss_m"), "min_m", "max_m")


def climbs(points: DataFrame, threshold_m: float = NOISE_M) -> DataFrame:
    """The same by trace; a trace without elevations has no row."""
    return segment_climbs(points, threshold_m).groupBy(*TRACE).agg(F.sum("gain_m").alias("gain_m"), F.sum("loss_m").alias("loss_m"), F.min("min_m").alias("min_m"), F.max("max_m").alias("max_m"))


def median_intervals(points: DataFrame) -> DataFrame:
    """Upper median of the gaps (ms, not 0) between consecutive timed points of a trace in recorded order; NULL without any.

    Gaps are counted by value before they are ranked, so a trace sampled every second has few rows to sort.
    """
    recorded = Window.partitionBy(*TRACE).orderBy(*ORDER[1:])
    gaps = points.filter("time is not null").withColumn("_p", F.lag("time").over(recorded))
    gaps = gaps.select(*TRACE, F.abs(F.expr("(unix_micros(time) - unix_micros(_p)) div 1000")).alias("gap_ms")).filter("gap_ms > 0")
    values = gaps.groupBy(*TRACE, "gap_ms").agg(F.count("*").alias("n"))
    upto = Window.partitionBy(*TRACE).orderBy("gap_ms")
    ranked = values.select(*TRACE, "gap_ms", F.sum("n").over(upto).alias("upto"), F.sum("n").over(Window.partitionBy(*TRACE)).alias("total"))
    median = ranked.filter(F.expr("upto > total div 2")).groupBy(*TRACE).agg(F.min("gap_ms").alias("median_ms"))
    return points.select(*TRACE).distinct().join(median, TRACE, "left")


def summary(points: DataFrame, threshold_m: float = NOISE_M, names: DataFrame | None = None) -> DataFrame:
    """One row for each trace: counts, distance, time range, duration in whole seconds, speed, climb and bounds.

    names: trace_id, format, name. Everything about a segment is folded in one aggregate, so points travel once.
    """
    one = steps(points).groupBy(*SEGMENT).agg(
        F.count("*").alias("n"), F.sum("step_m").alias("m"), F.min("time").alias("t0"), F.max("time").alias("t1"),
        F.min("lat").alias("a0"), F.max("lat").alias("a1"), F.min("lon").alias("o0"), F.max("lon").alias("o1"), F.min("ele").alias("e0"), F.max("ele").alias("e1"),
        F.transform(F.filter(F.sort_array(F.collect_list(F.struct("pt_idx", "ele"))), lambda x: x["ele"].isNotNull()), lambda x: x["ele"]).alias("e"),
    ).withColumn("c", climbed(F.col("e"), threshold_m)).drop("e")
    by_track = one.groupBy(*TRACK).agg(
        F.count("*").alias("s"), *[F.sum(c).alias(c) for c in ("n", "m")], F.sum("c.gain").alias("gain"), F.sum("c.loss").alias("loss"),
        *[F.min(c).alias(c) for c in ("t0", "a0", "o0", "e0")], *[F.max(c).alias(c) for c in ("t1", "a1", "o1", "e1")],
    )
    total = by_track.groupBy(*TRACE).agg(
        F.count("*").alias("tracks"), F.sum("s").alias("segments"), F.sum("n").alias("points"), F.coalesce(F.sum("m"), F.lit(0.0)).alias("distance_m"),
        F.min("t0").alias("start_time"), F.max("t1").alias("end_time"), F.sum("gain").alias("gain"), F.sum("loss").alias("loss"), F.min("e0").alias("min_ele_m"), F.max("e1").alias("max_ele_m"),
        F.min("o0").alias("min_lon"), F.min("a0").alias("min_lat"), F.max("o1").alias("max_lon"), F.max("a1").alias("max_lat"),
    )
    known = F.col("min_ele_m").isNotNull()
    out = total.withColumn("duration_s", F.expr("(unix_micros(end_time) - unix_micros(start_time)) div 1000000"))
    out = out.withColumns({
        "avg_speed_mps": F.when(F.col("duration_s") > 0, F.col("distance_m") / F.col("duration_s")),
        "gain_m": F.when(known, F.col("gain")), "loss_m": F.when(known, F.col("loss")), "threshold_m": F.when(known, F.lit(threshold_m)),
    }).drop("gain", "loss")
    return out if names is None else names.select("trace_id", "format", "name").join(out, "trace_id", "left")


def implied_speeds(points: DataFrame) -> DataFrame:
    """points with step_m and speed_mps from the one before; NULL without a time difference."""
    gap = F.abs(F.expr("(unix_micros(time) - unix_micros(_t)) div 1000"))
    out = steps(points).withColumn("_t", F.lag("time").over(along())).withColumn("_ms", gap)
    return out.withColumn("implied_mps", F.when(F.col("_ms") > 0, F.col("step_m") / (F.col("_ms") / 1000.0))).drop("_t", "_ms")


