"""Recordings of one journey by several devices, reconciled or put one after the other.

points here have group_id (the journey) and input_idx (the device) beside their position keys.

Only the greedy one-to-one match needs Python: it depends on the recorded order and on what earlier devices have
added. It is one grouped-map task per journey; candidates are found and measured for whole arrays, and the pass
that claims them only walks the candidates that are left.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import geodesic_numpy, with_geodesic
from .cleaning import MAX_SPEED_MPS, SEGMENT_GAP_S
from .points import EXTRAS

# The least and the greatest match window, and what a position may be off by.
LEAST_WINDOW_S, MOST_WINDOW_S = 1.0, 30.0
NOISE_MARGIN_M = 15.0

KEYS = ["group_id", "input_idx"]
RECORDED = ["track_idx", "seg_idx", "pt_idx"]
VALUES = ["lat", "lon", "ele", "time", *EXTRAS]
MERGED = "group_id string, pt_idx bigint, lat double, lon double, ele double, t bigint, " + ", ".join(f"{n} {t}" for n, t in EXTRAS.items()) + ", matches int"
_ARROW = {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64(), "int": pa.int32()}
_MERGED = pa.schema([(n, _ARROW[t]) for n, t in (x.split() for x in MERGED.split(", "))])


def match_window_us(a_ms: Column, b_ms: Column) -> Column:
    """Half the wider of two median intervals, within 1 to 30 s; 1 s if both are missing."""
    low, high = int(LEAST_WINDOW_S * 1e6), int(MOST_WINDOW_S * 1e6)
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce((F.greatest(a_ms, b_ms) * 500).cast("long"), F.lit(low))))


def coincidence_radius_m(apart_us: Column, max_mps: float = MAX_SPEED_MPS) -> Column:
    return F.abs(apart_us) / 1e6 * max_mps + NOISE_MARGIN_M


def intervals(points: DataFrame) -> DataFrame:
    """group_id, input_idx, n, start and end (microseconds) and median_ms (upper median, as measures.median_intervals)."""
    w = Window.partitionBy(*KEYS).orderBy(*RECORDED)
    timed = points.filter("time is not null").select(*KEYS, F.unix_micros("time").alias("t"), F.unix_micros(F.lag("time").over(w)).alias("p"))
    gaps = timed.select(*KEYS, F.abs(F.expr("(t - p) div 1000")).alias("gap")).filter("gap > 0").groupBy(*KEYS, "gap").agg(F.count("*").alias("n"))
    ranked = gaps.select(*KEYS, "gap", F.sum("n").over(Window.partitionBy(*KEYS).orderBy("gap")).alias("upto"), F.sum("n").over(Window.partitionBy(*KEYS)).alias("total"))
    median = ranked.filter(F.expr("upto > total div 2")).groupBy(*KEYS).agg(F.min("gap").alias("median_ms"))
    spans = points.groupBy(*KEYS).agg(F.count("*").alias("n"), F.unix_micros(F.min("time")).alias("start_us"), F.unix_micros(F.max("time")).alias("end_us"))
    return spans.join(median, KEYS, "left")


def overlaps(spans: DataFrame, window_s: float | None = None) -> DataFrame:
    """Pairs of inputs of a group (a before b) and whether their spans, widened by the pair's window, meet."""
    a, b = (spans.select("group_id", *[F.col(c).alias(f"{p}_{c}") for c in ("input_idx", "start_us", "end_us", "median_ms")]) for p in "ab")
    pairs = a.join(b, "group_id").filter("a_input_idx < b_input_idx and a_start_us is not null and b_start_us is not null")
    window = match_window_us(F.col("a_median_ms"), F.col("b_median_ms")) if window_s is None else F.lit(round(window_s * 1e6))
    met = (F.col("a_start_us") - F.col("window_us") <= F.col("b_end_us")) & (F.col("b_start_us") - F.col("window_us") <= F.col("a_end_us"))
    return pairs.withColumn("window_us", window).select("group_id", "a_input_idx", "b_input_idx", "window_us", met.alias("overlap"))


def same_moments(a: DataFrame, b: DataFrame, window_us: int, radius_m: float | None = None, keys: tuple[str, ...] = ("group_id",)) -> DataFrame:
    """Pairs of points within window_us and the radius of each other, with apart_us and apart_m.

    Time is cut into buckets of a window; a point of b stands in its own bucket and both neighbours, so the pairs
    come from an equi-join and no bucket grows with the length of a trace.
    """
    bucket = lambda c: F.floor(F.unix_micros(c) / F.lit(max(1, window_us))).cast("long")
    left = a.filter("time is not null").select(*keys, bucket("time").alias("bucket"), F.struct(*a.columns).alias("a"))
    right = b.filter("time is not null").withColumn("_at", F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: bucket("time") + d))
    right = right.select(*keys, F.explode("_at").alias("bucket"), F.struct(*b.columns).alias("b"))
    near = left.join(right, [*keys, "bucket"]).withColumn("apart_us", F.abs(F.expr("unix_micros(a.time) - unix_micros(b.time)"))).filter(F.col("apart_us") <= window_us)
    measured = with_geodesic(near.drop("bucket"), "a.lat", "a.lon", "b.lat", "b.lon", "apart_m")
    limit = coincidence_radius_m(F.col("apart_us")) if radius_m is None else F.lit(float(radius_m))
    return measured.filter(F.col("apart_m") <= limit)


def concatenated(points: DataFrame) -> DataFrame:
    """One trace per group: the tracks of all inputs by their start, undated ones last; segments as they are."""
    order = [F.col("_start").asc_nulls_last(), F.col("input_idx"), F.col("track_idx")]
    tracks = points.groupBy(*KEYS, "track_idx").agg(F.min("time").alias("_start"))
    numbered = tracks.withColumn("_t", F.row_number().over(Window.partitionBy("group_id").orderBy(*order)) - 1).drop("_start")
    joined = points.join(numbered, [*KEYS, "track_idx"])
    return joined.withColumns({"trace_id": F.col("group_id").cast("string"), "track_idx": F.col("_t")}).drop("_t")


def _candidates(times: np.ndarray, place: np.ndarray, incoming: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (incoming, timeline) within window: times is sorted; place are rows of the timeline."""
    low, high = np.searchsorted(times, incoming - window, "left"), np.searchsorted(times, incoming + window, "right")
    n = np.maximum(high - low, 0)
    who = np.repeat(np.arange(len(incoming)), n)
    ends = np.cumsum(n)
    return who, place[np.arange(len(who)) + np.repeat(low - (ends - n), n)] if len(who) else place[:0]


Values = dict[str, np.ndarray]


def _by_time(values: Values) -> Values:
    """In order of time, undated ones last, else as they were."""
    order = np.argsort(np.where(np.isnan(values["t"]), np.inf, values["t"]), kind="stable")
    return {c: x[order] for c, x in values.items()}


def reconcile_values(inputs: list[Values], windows_us: list[int], primary: int, radius_m: float | None, max_mps: float = MAX_SPEED_MPS) -> Values:
    """The timeline of all inputs. Each has its values in recorded order as floats, with NaN for what is missing.

    t is in microseconds, which a float holds exactly. matches counts the points that a point has taken in.
    """
    line = {c: x.copy() for c, x in inputs[primary].items()} | {"matches": np.zeros(len(inputs[primary]["t"]))}
    for i, own in enumerate(inputs):
        if i == primary or not len(own["t"]):
            continue
        line = _by_time(line)
        dated, mine = np.flatnonzero(~np.isnan(line["t"])), np.flatnonzero(~np.isnan(own["t"]))
        who, where = _candidates(line["t"][dated], dated, own["t"][mine], windows_us[i])
        who = mine[who]
        apart = np.abs(line["t"][where] - own["t"][who])
        metres = geodesic_numpy(line["lat"][where], line["lon"][where], own["lat"][who], own["lon"][who]) if len(who) else apart
        good = metres <= (apart / 1e6 * max_mps + NOISE_MARGIN_M if radius_m is None else radius_m)
        taken: dict[int, int] = {}  # place in the timeline -> point that it takes in
        done = -1
        # Of each point in turn, the nearest free place in time, then the earliest.
        order = np.lexsort((where[good], apart[good], who[good]))
        for w, at in zip(who[good][order].tolist(), where[good][order].tolist(), strict=True):
            if w != done and at not in taken:
                taken[at] = done = w
        place, point = np.array(list(taken), np.int64), np.array(list(taken.values()), np.int64)
        for c in ("ele", "t", *EXTRAS):
            line[c][place] = np.where(np.isnan(line[c][place]), own[c][point], line[c][place])
        line["matches"][place] += 1
        rest = np.ones(len(own["t"]), bool)
        rest[point] = False
        line = {c: np.concatenate([x, own[c][rest] if c in own else np.zeros(int(rest.sum()))]) for c, x in line.items()}
    return _by_time(line)


def reconciled(points: DataFrame, primary: int = 0, window_s: float | None = None, radius_m: float | None = None, gap_s: float = SEGMENT_GAP_S) -> DataFrame:
    """One track per group: the primary's timeline, with what the others add, cut at gaps."""
    flat = points.select(F.col("group_id").cast("string").alias("group_id"), "input_idx", *RECORDED, F.unix_micros("time").alias("t"), *[F.col(c) if c in points.columns else F.lit(None).cast(EXTRAS.get(c, "double")).alias(c) for c in VALUES if c != "time"])
    medians = intervals(points).select(F.col("group_id").cast("string").alias("group_id"), "input_idx", "median_ms")
    own = medians.groupBy("group_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("input_idx", "median_ms")))).alias("medians"))  # one entry per input
    values = ["lat", "lon", "ele", "t", *EXTRAS]

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _MERGED.empty_table()
        known = dict(right.column("medians")[0].as_py() or []) if right.num_rows else {}
        place = [left.column(c).to_numpy() for c in ("input_idx", *RECORDED)]
        order = np.lexsort(place[::-1])
        data = {c: left.column(c).cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False)[order] for c in values}
        names, begin = np.unique(place[0][order], return_index=True)
        inputs = [{c: x[rows] for c, x in data.items()} for rows in (slice(*e) for e in zip(begin, [*begin[1:], len(order)], strict=True))]
        first = min(primary, len(names) - 1)
        windows = [window_us(known.get(int(names[first])), known.get(int(n)), window_s) for n in names]
        line = reconcile_values(inputs, windows, first, radius_m)
        n = len(line["t"])
        line |= {"pt_idx": np.arange(n)}
        group = left.column("group_id")[0].as_py()
        return pa.Table.from_arrays([pa.array([group] * n, f.type) if f.name == "group_id" else pa.array(line[f.name], from_pandas=True).cast(f.type, safe=False) for f in _MERGED], schema=_MERGED)

    merged = flat.groupBy("group_id").cogroup(own.groupBy("group_id")).applyInArrow(task, MERGED)
    w = Window.partitionBy("group_id").orderBy("pt_idx")
    before = F.last("t", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    cut = merged.withColumn("_b", before).withColumn("_n", F.coalesce((F.col("t") - F.col("_b") > round(gap_s * 1e6)).cast("int"), F.lit(0)))
    cut = cut.withColumn("seg_idx", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    at = Window.partitionBy("group_id", "seg_idx").orderBy("pt_idx")
    return cut.select(
        F.col("group_id").alias("trace_id"), F.lit(0).alias("track_idx"), "seg_idx", (F.row_number().over(at) - 1).cast("bigint").alias("pt_idx"),
        "lat", "lon", "ele", F.timestamp_micros("t").alias("time"), *EXTRAS, "matches",
    )


def window_us(a_ms: float | None, b_ms: float | None, window_s: float | None = None) -> int:
    """match_window_us for plain numbers."""
    if window_s is not None:
        return round(window_s * 1e6)
    known = [x for x in (a_ms, b_ms) if x is not None]
    return int(min(MOST_WINDOW_S * 1e6, max(LEAST_WINDOW_S * 1e6, max(known) * 500))) if known else int(LEAST_WINDOW_S * 1e6)


def merged(points: DataFrame, primary: int = 0, dedup: bool = True, window_s: float | None = None, radius_m: float | None = None, gap_s: float = SEGMENT_GAP_S) -> tuple[DataFrame, DataFrame]:
    """Points of one trace per group, and a report.

    A group of one input passes through. Others are reconciled if dedup and any two inputs overlap in time, else
    concatenated. Which one is known per group, so both run over their own groups in one plan.
    """
    spans = intervals(points)
    pairs = overlaps(spans, window_s)
    met = pairs.groupBy("group_id").agg(F.max("overlap").alias("overlap"))
    firsts = Window.partitionBy("group_id").orderBy("input_idx")
    place = F.row_number().over(firsts) - 1
    many = spans.groupBy("group_id").agg(F.count("*").alias("inputs"), F.sum("n").alias("points_in"))
    at = spans.withColumn("_i", place)
    chosen = at.join(many, "group_id").filter(F.col("_i") == F.least(F.lit(primary), F.col("inputs") - 1)).select("group_id", F.col("median_ms").alias("_m"), F.col("_i").alias("_p"))
    widest = at.join(chosen, "group_id").filter("_i <> _p").withColumn("w", F.lit(round(window_s * 1e6)) if window_s is not None else match_window_us(F.col("_m"), F.col("median_ms"))).groupBy("group_id").agg(F.max("w").alias("window_us"))
    mode = F.when(F.col("inputs") == 1, "single").when(F.lit(dedup) & F.coalesce("overlap", F.lit(False)), "reconciled").otherwise("concatenated")
    plan = many.join(met, "group_id", "left").withColumn("mode", mode).join(widest, "group_id", "left").drop("overlap")
    both = points.join(plan.select("group_id", "mode"), "group_id")
    joined = reconciled(both.filter("mode = 'reconciled'").drop("mode"), primary, window_s, radius_m, gap_s)
    plain = concatenated(both.filter("mode <> 'reconciled'").drop("mode")).withColumn("matches", F.lit(0))
    out = joined.unionByName(plain.select(*[F.col(c) if c in plain.columns else F.lit(None).cast(EXTRAS.get(c, "double")).alias(c) for c in joined.columns]))
    done = out.groupBy(F.col("trace_id").alias("group_id")).agg(F.count("*").alias("points_out"), F.sum("matches").alias("matched"))
    report = plan.withColumn("group_id", F.col("group_id").cast("string")).join(done, "group_id").select(
        "group_id", "mode", "inputs", "points_in", "points_out", F.when(F.col("mode") == "reconciled", F.col("matched")).otherwise(0).alias("matched"), F.when(F.col("mode") == "reconciled", F.col("window_us") / 1e6).alias("window_s")
    )
    return out, report


def merged_metadata(metadata: DataFrame, points: DataFrame, primary: int = 0) -> DataFrame:
    """group_id and the primary input's metadata, created at the earliest start of all inputs. metadata: group_id, input_idx, metadata."""
    start = points.groupBy("group_id").agg(F.min("time").alias("_start"))
    n = metadata.groupBy("group_id").agg((F.count("*") - 1).alias("_last"))
    own = metadata.withColumn("_i", F.row_number().over(Window.partitionBy("group_id").orderBy("input_idx")) - 1).join(n, "group_id").filter(F.col("_i") == F.least(F.lit(primary), F.col("_last")))
    return own.join(start, "group_id", "left").select("group_id", F.col("metadata").withField("created", F.coalesce("_start", "metadata.created")).alias("metadata"))
