"""Commands over trace files: info, convert, merge, clean, takeout, render, view.

A thin layer: it reads files into the nested form, runs the operators on a local session and writes what they
return. Exit codes: 0 fine, 1 bad data, 2 a file that can't be read or written.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as X
from .operators import activities as A
from .operators import cleaning as K
from .operators import measures as M
from .operators import merging as G
from .operators import points as P
from .operators import rendering as R
from .sources import archive, formats, png

FORMATS = [f for f in formats.NAMES if f not in formats.NOT_BUILT]


def session() -> SparkSession:
    spark = SparkSession.builder.master("local[*]").appName("waymill").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.sql.shuffle.partitions", "8").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _load(path: str | None) -> bytes:
    """A file; - or no name: what is piped in. Without a name nothing is waited for at a terminal."""
    if path not in (None, "-"):
        with open(path, "rb") as f:
            return f.read()
    if sys.stdin.isatty():
        if path is None:
            raise formats.FormatError("no input; name a file, pipe one in, or ask for - to type it")
        _say("reading from the terminal")
    return sys.stdin.buffer.read()


def _parsed(spark: SparkSession, given: list[tuple[bytes, str | None]], explicit: str | None) -> tuple[DataFrame, list[str]]:
    """Nested traces, numbered in order, and their formats. given: contents and names."""
    rows, found = [], []
    for i, (data, name) in enumerate(given):
        trace, fmt = formats.parse(data, name, explicit)
        rows.append({"trace_id": str(i), **trace})
        found.append(fmt)
    return spark.createDataFrame(pa.Table.from_pylist(rows, schema=formats.ARROW), P.TRACES), found


def _traces(spark: SparkSession, paths: list[str | None], explicit: str | None) -> tuple[DataFrame, list[str]]:
    return _parsed(spark, [(_load(p), None if p == "-" else p) for p in paths], explicit)


def _emit(text: str | bytes, path: str | None) -> None:
    data = text.encode() if isinstance(text, str) else text
    if path and path != "-":
        with open(path, "wb") as f:
            f.write(data)
    else:
        sys.stdout.buffer.write(data)
        sys.stdout.flush()


def _rendered(traces: DataFrame, fmt: str) -> str:
    return formats.written_traces(traces, fmt).first()["content"]


def _say(*rows: str) -> None:
    print(*rows, sep="\n", file=sys.stderr)


def _nest(points: DataFrame, like: DataFrame) -> DataFrame:
    """points as one nested trace under the metadata and track names of like."""
    names = like.select("trace_id", F.posexplode("tracks").alias("track_idx", "t")).select("trace_id", "track_idx", "t.name", "t.description")
    return P.nested(points, names, like.select("trace_id", "metadata"))


def info(spark: SparkSession, a) -> None:
    traces, found = _traces(spark, [a.input], getattr(a, "from"))
    counted, name = M.nested_counts(traces).first(), traces.select("metadata.name").first()["name"]
    row = M.summary(P.flattened(traces), a.elevation_threshold).first()
    s = row.asDict() if row else {}
    out = {"source_format": found[0], "name": name, "tracks": counted.tracks, "segments": counted.segments, "points": counted.points, "distance_m": s.get("distance_m", 0.0)}
    out |= {k: s[k].isoformat() + "Z" if s.get(k) else None for k in ("start_time", "end_time")}
    out |= {k: s.get(k) for k in ("duration_s", "avg_speed_mps")}
    climb = {k: s.get(v) for k, v in (("gain_m", "gain_m"), ("loss_m", "loss_m"), ("min_m", "min_ele_m"), ("max_m", "max_ele_m"), ("threshold_m", "threshold_m"))}
    out["elevation"] = climb if climb["min_m"] is not None else None
    sides = {k: s.get(k) for k in ("min_lat", "min_lon", "max_lat", "max_lon")}
    out["bounds"] = sides if sides["min_lon"] is not None else None
    if out["bounds"]:
        out["bbox"] = [s[k] for k in ("min_lon", "min_lat", "max_lon", "max_lat")]
    if a.json:
        _emit(json.dumps(out, indent=2, ensure_ascii=False) + "\n", None)
        return
    shown = spark.createDataFrame([(out["duration_s"] or 0, counted.tracks, counted.segments, counted.points)], "s long, t long, g long, p long")
    shown = shown.select(X.clock(F.col("s")).alias("s"), *[X.thousands(F.col(c)).alias(c) for c in "tgp"]).first()
    lines = [("format", found[0]), ("tracks", shown.t), ("segments", shown.g), ("points", shown.p), ("distance", f"{out['distance_m'] / 1000:.2f} km")]
    if out["duration_s"] is not None:
        lines.append(("duration", shown.s))
    if out["avg_speed_mps"] is not None:
        lines.append(("avg speed", f"{out['avg_speed_mps'] * 3.6:.1f} km/h"))
    if e := out["elevation"]:
        lines.append(("elevation", f"+{e['gain_m']:.0f} m / -{e['loss_m']:.0f} m  ({e['min_m']:.0f}\u2013{e['max_m']:.0f} m)"))
    if s.get("start_time"):
        lines.append(("time", f"{s['start_time']:%Y-%m-%d %H:%M:%S} \u2192 {s['end_time']:%Y-%m-%d %H:%M:%S} UTC"))
    if b := out["bounds"]:
        lines.append(("bounds", f"{b['min_lat']:.4f}, {b['min_lon']:.4f} \u2192 {b['max_lat']:.4f}, {b['max_lon']:.4f}"))
        lines.append(("bbox", ",".join(f"{x:.6f}" for x in out["bbox"])))
    _emit("".join([f"{name}\n" if name is not None else "", *[f"  {k:<12}{v}\n" for k, v in lines]]), None)


def convert(spark: SparkSession, a) -> None:
    target = formats.target_format(a.to, a.output)
    traces, _ = _traces(spark, [a.input], getattr(a, "from"))
    _emit(_rendered(traces, target), a.output)


def merge(spark: SparkSession, a) -> None:
    if a.primary is not None and a.primary not in a.inputs:
        raise formats.FormatError(f"{a.primary} is not among the inputs")
    traces, found = _traces(spark, a.inputs, getattr(a, "from"))
    primary = a.inputs.index(a.primary) if a.primary else 0
    target = formats.target_format(a.to, a.output, found[primary])
    points = P.flattened(traces).withColumns({"group_id": F.lit("merged"), "input_idx": F.col("trace_id").cast("int")})
    out, report = G.merged(points, primary, not a.no_dedup, a.dedup_window, a.dedup_radius, a.segment_gap)
    meta = G.merged_metadata(traces.select(F.lit("merged").alias("group_id"), F.col("trace_id").cast("int").alias("input_idx"), "metadata"), points, primary)
    tracks = out.select("trace_id", "track_idx").distinct().select("*", F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("description"))
    _emit(_rendered(P.nested(out, tracks, meta.select(F.col("group_id").alias("trace_id"), "metadata")), target), a.output)
    if a.verbose:
        _say(json.dumps(report.first().asDict()))


def clean(spark: SparkSession, a) -> None:
    traces, found = _traces(spark, [a.input], getattr(a, "from"))
    target = formats.target_format(a.to, a.output, found[0])
    points, fences = P.flattened(traces), [X.parse_geofence(f) for f in a.redact_around]
    out = K.cleaned(points, not a.no_drift_filter, a.max_speed, fences, a.trim_ends)
    _emit(_rendered(_nest(out, traces), target), a.output)
    if a.verbose:
        row = K.clean_report(points, not a.no_drift_filter, a.max_speed, fences, a.trim_ends).first()
        _say(json.dumps(row.asDict() if row else {}))


def listing(types: list[dict], total: dict) -> str:
    """The kinds of activities as a table, and what there is in all."""
    head = ("activity type", "logs", "with GPS")
    wide = [max([len(h), *[len(str(t[k])) for t in types]]) for h, k in zip(head, ("name", "logs", "with_gps"), strict=True)]
    rows = [head, *[(t["name"], t["logs"], t["with_gps"]) for t in types]]
    table = "".join(f"{n:<{wide[0]}}  {x:>{wide[1]}}  {y:>{wide[2]}}\n" for n, x, y in rows)
    return f"{table}\n{total['total_logs']} logs, {total['total_with_gps']} with GPS, {total['days_of_recording']} days of recording\n"


def takeout(spark: SparkSession, a) -> None:
    parts = archive.Archive(a.inputs)
    backend = parts.backend()
    if backend != "fitbit":
        raise formats.FormatError("timeline archives are not implemented" if backend else f"no recordings found; the archive has {', '.join(parts.products()) or 'nothing'}")
    logs, fixes = archive.read_logs(spark, parts), archive.read_fixes(spark, parts)
    if a.list:
        types = [{"name": r["name"], "logs": r.with_gps + r.without_gps, "with_gps": r.with_gps} for r in A.activity_types(logs).orderBy("place").collect()]
        total = A.totals(logs, fixes).first().asDict()
        _emit(json.dumps({"types": types, **total}, indent=2, ensure_ascii=False) + "\n" if a.json else listing(types, total), None)
        return
    names = [t.strip() for t in (a.type or "").split(",") if t.strip()]
    if names:
        unknown = [r["wanted"] for r in A.unmatched(logs, spark.createDataFrame([(n,) for n in names], "wanted string")).collect()]
        if unknown:
            raise formats.FormatError(f"no activity of type {', '.join(unknown)}")
    chosen = A.selected(logs, names)
    offset = A.detect_offset(chosen, fixes).first()
    offset_s = offset["offset_min"] * 60 if offset else 0
    windowed = A.windows(chosen, offset_s)
    if a.source:
        A.check_source(A.joined(windowed, fixes), a.source)
    points = A.extracted(chosen, fixes, offset_s, a.source, a.segment_gap)
    target = formats.target_format(a.to, None if a.per_activity else a.output, "gpx")
    missing = [f"no day file for {r['day']} (log {r['log_id']})" for r in A.missing_days(windowed, fixes).orderBy("log_id", "day").collect()]
    _say(*missing)
    if not points.limit(1).count():
        raise formats.FormatError("nothing was extracted")
    if a.per_activity:
        _say(*archive.write_each(points, a.output or ".", target))
        return
    one = A.extract_one(points)
    tracks = one.select("trace_id", "track_idx", F.col("track_name").alias("name"), "description").distinct()
    meta = one.groupBy("trace_id").agg(F.min("time").alias("created")).select("trace_id", F.struct(F.lit("takeout").alias("name"), F.lit(None).cast("string").alias("description"), F.lit(None).cast("string").alias("source_format"), F.lit(None).cast("string").alias("source_device"), "created").alias("metadata"))
    _emit(_rendered(P.nested(one, tracks, meta), target), a.output)


def drawing_inputs(trace: str | None, basemap: str | None) -> tuple[bytes, str | None, bytes]:
    """The trace, its name, and the map image. At most one is piped in: the one called -, or the one that isn't named."""
    if trace == "-" and basemap == "-":
        raise formats.FormatError("the trace and the map image can't both be piped in")
    if trace is None or basemap is None:
        if "-" in (trace, basemap):
            raise formats.FormatError("no map image; name one with --basemap" if basemap is None else "no trace; name a file")
        piped = _load(None)
        if piped.startswith(png.SIGNATURE):
            if basemap is not None:
                raise formats.FormatError("there are two map images, one piped in and one named")
            if trace is None:
                raise formats.FormatError("no trace; name a file")
            return _load(trace), trace, piped
        if basemap is None:
            raise formats.FormatError("no map image; name one with --basemap")
        return piped, None, _load(basemap)
    return _load(trace), None if trace == "-" else trace, _load(basemap)


def render(spark: SparkSession, a) -> None:
    data, name, image = drawing_inputs(a.input, a.basemap)
    traces, _ = _parsed(spark, [(data, name)], getattr(a, "from"))
    points = P.flattened(traces)
    box = X.parse_bbox(a.bbox) if a.bbox else None
    if box is None:
        b = M.bounds(points).first()
        if b is None:
            raise formats.FormatError("the trace has no points to draw")
        box = (b.min_lon, b.min_lat, b.max_lon, b.max_lat)
        if box[0] >= box[2] or box[1] >= box[3]:
            raise formats.FormatError("the trace has no extent; name the box of the map image with --bbox")
    if a.reveal is None:
        a.reveal = R.REVEAL_FT * 0.3048 if X.imperial_locale() else R.REVEAL_M
    if not 0 < a.track_width < float("inf"):
        raise formats.FormatError("a track is wider than nothing")
    out = R.rendered(points, image, box, a.fog, a.reveal, a.fog_opacity, X.parse_color(a.track_color) if a.track_color else R.TRACK_COLOR, a.track_width)
    canvas, _ = png.decode(image)
    base = R.Basemap(canvas.shape[1], canvas.shape[0], *box)
    if abs(base.aspect_skew - 1) > R.SKEW:
        _say(f"the map image has {base.width}x{base.height} pixels, but its box has the shape of {round(base.width / base.aspect_skew)}x{base.height}; the trace is stretched")
    _emit(out, a.output)


def view(spark: SparkSession, a) -> None:
    """The trace as a map of braille dots."""
    traces, _ = _traces(spark, [a.input], getattr(a, "from"))
    points = P.flattened(traces)
    b = M.bounds(points).first()
    if b is None:
        raise formats.FormatError("there are no points to draw")
    from .functions.geo import equirectangular

    x, y = equirectangular(F.col("lat"), F.col("lon"), F.lit((b.min_lat + b.max_lat) / 2))
    flat = points.withColumns({"_x": x, "_y": y})
    e = flat.agg(F.min("_x"), F.min("_y"), F.max("_x"), F.max("_y")).first()
    aspect = R.cell_aspect(a.columns, a.rows)
    port = R.Viewport.fit(*e, aspect).zoomed(a.zoom).panned(*a.pan, aspect)
    px, py = port.to_dots(F.col("_x"), F.col("_y"), a.columns, a.rows)
    _emit("\n".join(R.braille(R.strokes(flat.withColumns({"px": px, "py": py})), a.columns, a.rows)) + "\n", None)


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="waymill")
    sub = out.add_subparsers(dest="command", required=True)

    def add(name: str, run: Callable, many: bool = False) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        p.add_argument("inputs" if many else "input", nargs="+" if many else "?")
        if name != "takeout":
            p.add_argument("--from", choices=formats.NAMES)
        p.set_defaults(run=run)
        return p

    def writes(p, to: bool = True):
        p.add_argument("-o", "--output")
        if to:
            p.add_argument("--to", choices=formats.NAMES)
        return p

    p = add("info", info)
    p.add_argument("--json", action="store_true")
    p.add_argument("--elevation-threshold", type=X.parse_distance, default=M.NOISE_M)
    writes(add("convert", convert))
    p = writes(add("merge", merge, True))
    p.add_argument("--primary")
    p.add_argument("--no-dedup", action="store_true")
    p.add_argument("--dedup-window", type=X.parse_duration)
    p.add_argument("--dedup-radius", type=X.parse_distance)
    p.add_argument("--segment-gap", type=X.parse_duration, default=K.SEGMENT_GAP_S)
    p.add_argument("-v", "--verbose", action="store_true")
    p = writes(add("clean", clean))
    p.add_argument("--no-drift-filter", action="store_true")
    p.add_argument("--max-speed", type=X.parse_speed, default=K.MAX_SPEED_MPS)
    p.add_argument("--redact-around", action="append", default=[])
    p.add_argument("--trim-ends", type=X.parse_distance)
    p.add_argument("-v", "--verbose", action="store_true")
    p = writes(add("takeout", takeout, True))
    for flag in ("--list", "--json", "--per-activity"):
        p.add_argument(flag, action="store_true")
    p.add_argument("--type")
    p.add_argument("--source")
    p.add_argument("--segment-gap", type=X.parse_duration, default=K.SEGMENT_GAP_S)
    p = writes(add("render", render), False)
    p.add_argument("--basemap")
    p.add_argument("--bbox")
    p.add_argument("--fog", action="store_true")
    p.add_argument("--reveal", type=X.parse_distance)
    p.add_argument("--fog-opacity", type=float, default=R.FOG_OPACITY)
    p.add_argument("--track-color")
    p.add_argument("--track-width", type=float, default=R.TRACK_WIDTH)
    p = add("view", view)
    p.add_argument("--columns", type=int, default=78)
    p.add_argument("--rows", type=int, default=22)
    p.add_argument("--zoom", type=float, default=1.0)
    p.add_argument("--pan", type=float, nargs=2, default=(0.0, 0.0))
    return out


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    try:
        a.run(spark or session(), a)
    except OSError as error:
        _say(f"error: {error}")
        return 2
    except ValueError as error:
        _say(f"error: {error}")
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
