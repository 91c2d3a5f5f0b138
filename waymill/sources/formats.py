"""Trace files: detection, parsing and writing of GPX, TCX, GeoJSON and CSV.

A trace is a plain dict here: metadata and tracks, as in the nested schema. Reads widen (what a format lacks is
None), writes narrow (what a format can't hold is left out). Files are read by Spark as whole binaries, one row
each, so a folder of many files is parsed in parallel.
"""

from __future__ import annotations

import csv
import io
import json
import math
import re
import xml.etree.ElementTree as ET
from datetime import UTC, datetime
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import __version__
from ..operators.points import EXTRAS, TRACES

CREATOR = f"waymill {__version__}"
NAMES = ("gpx", "tcx", "geojson", "csv", "fit", "kml")
NOT_BUILT = ("fit", "kml")

# Names under which a CSV column is known, and the bytes that are looked at to tell a format.
ALIASES = {
    "lat": "lat", "latitude": "lat", "lon": "lon", "lng": "lon", "long": "lon", "longitude": "lon", "ele": "ele", "elevation": "ele", "alt": "ele", "altitude": "ele",
    "time": "time", "timestamp": "time", "date": "time", "datetime": "time", "track": "track", "track_id": "track", "segment": "segment", "seg": "segment", "segment_id": "segment",
}
SNIFFED = 4096

Trace = dict


#: Characters that may stand before the content, and what tells the XML formats, in lower case.
LEADING = "\ufeff \t\r\n"
OPENINGS = {"gpx": "<gpx", "tcx": "<trainingcenterdatabase", "kml": "<kml"}


class FormatError(ValueError):
    """A file that can't be read or written as asked."""


# ---------------------------------------------------------------- detection


def by_extension(name: str | None) -> str | None:
    ext = (name or "").rsplit(".", 1)[-1].lower()
    return {"json": "geojson"}.get(ext, ext if ext in NAMES else None)


def by_content(data: bytes) -> str | None:
    if data[8:12] == b".FIT":
        return "fit"
    head = data[:SNIFFED].decode("utf-8", "replace").lstrip(LEADING)
    if head[:1] in ("{", "["):
        return "geojson"
    low = head.lower()
    if head.startswith("<"):
        return next((f for f, tag in OPENINGS.items() if tag in low), None)
    first = low.split("\n", 1)[0]
    return "csv" if "," in first and ("lat" in first or "lon" in first) else None


def detect(data: bytes, name: str | None = None, explicit: str | None = None) -> str:
    """What is asked for, else what the name says, else what the content says."""
    found = explicit or by_extension(name) or by_content(data)
    if not found:
        raise FormatError("the format can't be told; name it")
    return found


def sniffed(content: Column) -> Column:
    """by_content as a column of text."""
    head = F.lower(F.ltrim(F.substring(content, 1, SNIFFED), F.lit(LEADING)))
    first = F.substring_index(head, "\n", 1)
    xml = F.coalesce(*[F.when(F.instr(head, tag) > 0, f) for f, tag in OPENINGS.items()])
    return (
        F.when(F.substring(content, 9, 4) == ".FIT", "fit")
        .when(F.substring(head, 1, 1).isin("{", "["), "geojson")
        .when(F.startswith(head, F.lit("<")), xml)
        .when((F.instr(first, ",") > 0) & ((F.instr(first, "lat") > 0) | (F.instr(first, "lon") > 0)), "csv")
    )


# ---------------------------------------------------------------- values


def _time(text: str | None) -> datetime | None:
    """RFC 3339, else None; microseconds are kept."""
    m = re.fullmatch(r"\s*(\d{4}-\d\d-\d\d)[Tt ](\d\d:\d\d:\d\d)(\.\d+)?([Zz]|[+-]\d\d:\d\d)\s*", text or "")
    if not m:
        return None
    try:
        value = datetime.fromisoformat(f"{m[1]}T{m[2]}{(m[3] or '')[:7]}{'+00:00' if m[4] in 'Zz' else m[4]}")
        return value.astimezone(UTC)
    except ValueError:
        return None


def _number(text) -> float | None:
    try:
        return float(text)
    except (TypeError, ValueError):
        return None


def _small(text) -> int | None:
    """A whole number that fits 16 bits."""
    try:
        value = int(str(text).strip())
    except (TypeError, ValueError):
        return None
    return value if 0 <= value <= 65535 else None


def _finite(value: float | None) -> float | None:
    return value if value is not None and math.isfinite(value) else None


def place(lat, lon) -> tuple[float, float]:
    """Checked and wrapped, or an error."""
    if lat is None or lon is None or not math.isfinite(lat) or not -90 <= lat <= 90 or not math.isfinite(lon):
        raise FormatError(f"invalid coordinate: {lat}, {lon}")
    if not -180 <= lon <= 180:
        wrapped = (lon + 180) % 360 - 180
        lon = 180.0 if wrapped == -180 and lon > 0 else wrapped
    return lat, lon


def _point(lat, lon, ele=None, time=None, **extras) -> dict:
    return {"lat": lat, "lon": lon, "ele": ele, "time": time, **{k: extras.get(k) for k in EXTRAS}, "source": None}


def _track(segments: list[list[dict]], name=None, description=None) -> dict:
    return {"name": name, "description": description, "segments": [{"points": s} for s in segments]}


def _trace(fmt: str | None, tracks: list[dict], name=None, description=None, device=None, created=None) -> Trace:
    return {"metadata": {"name": name, "description": description, "source_format": fmt, "source_device": device, "created": created}, "tracks": tracks}


# ---------------------------------------------------------------- readers


def _local(tag) -> str:
    return tag.rsplit("}", 1)[-1] if isinstance(tag, str) else ""


def _child(node, *names):
    for name in names:
        node = next((c for c in node if _local(c.tag) == name), None) if node is not None else None
    return node


def _text(node, *names) -> str | None:
    found = _child(node, *names)
    return found.text.strip() if found is not None and found.text and found.text.strip() else None


def _root(data: bytes, fmt: str):
    try:
        return ET.fromstring(data)
    except ET.ParseError as error:
        raise FormatError(f"not readable as {fmt}: {error}") from error


def _children(node, name: str) -> list:
    return [c for c in node if _local(c.tag) == name]


def _gpx_point(node) -> dict:
    lat, lon = _number(node.get("lat")), _number(node.get("lon"))
    try:
        lat, lon = place(lat, lon)
    except FormatError:
        lat = lon = 0.0  # kept, though it is nowhere
    return _point(lat, lon, _number(_text(node, "ele")), _time(_text(node, "time")), speed=_number(_text(node, "speed")), hdop=_number(_text(node, "hdop")), satellites=_small(_text(node, "sat")))


def read_gpx(data: bytes) -> Trace:
    root = _root(data, "gpx")
    tracks = [_track([[_gpx_point(p) for p in _children(s, "trkpt")] for s in _children(t, "trkseg")], _text(t, "name"), _text(t, "desc")) for t in _children(root, "trk")]
    tracks += [_track([[_gpx_point(p) for p in _children(r, "rtept")]], _text(r, "name"), _text(r, "desc")) for r in _children(root, "rte")]
    if not tracks and (loose := _children(root, "wpt")):
        tracks = [_track([[_gpx_point(p) for p in loose]])]
    meta = _child(root, "metadata")
    get = lambda n: _text(meta, n) if meta is not None else None
    return _trace("gpx", tracks, get("name"), get("desc"), root.get("creator"), _time(get("time")))


def _tcx_point(node) -> dict | None:
    try:
        lat, lon = place(_number(_text(node, "Position", "LatitudeDegrees")), _number(_text(node, "Position", "LongitudeDegrees")))
    except FormatError:
        return None
    speeds = [_number(x.text) for tpx in node.iter() if _local(tpx.tag) == "TPX" for x in _children(tpx, "Speed")]
    speed = speeds[-1] if speeds else None
    return _point(lat, lon, _finite(_number(_text(node, "AltitudeMeters"))), _time(_text(node, "Time")), heart_rate=_small(_text(node, "HeartRateBpm", "Value")), cadence=_small(_text(node, "Cadence")), speed=speed)


def read_tcx(data: bytes) -> Trace:
    root, tracks, first = _root(data, "tcx"), [], None
    for activity in (x for x in root.iter() if _local(x.tag) == "Activity"):
        segments = [[p for n in _children(t, "Trackpoint") if (p := _tcx_point(n))] for t in activity.iter() if _local(t.tag) == "Track"]
        tracks.append(_track(segments, None, _text(activity, "Notes")))
        first = _text(activity, "Id") if first is None else first
    named = lambda kind: next((n for x in reversed(list(root.iter())) if _local(x.tag) == kind and (n := _text(x, "Name")) is not None), None)  # noqa: E731  the last one
    return _trace("tcx", tracks, None, None, named("Creator") or named("Author"), _time(first))


def _position(c, time=None) -> dict:
    if not isinstance(c, list) or len(c) < 2 or not all(isinstance(x, int | float) for x in c[:2]):
        raise FormatError("a position needs two numbers")
    lat, lon = place(float(c[1]), float(c[0]))
    return _point(lat, lon, _finite(_number(c[2])) if len(c) > 2 else None, time)


def _line_times(properties: dict | None, nested: bool) -> list[list]:
    """Times of each line. Flat times belong to the first line."""
    found = (properties or {}).get("coordTimes", (properties or {}).get("times"))
    if not isinstance(found, list) or not found:
        return []
    lines = found if isinstance(found[0], list) else [found]
    return [[_time(t) if isinstance(t, str) else None for t in x] if isinstance(x, list) else [] for x in (lines if nested else lines[:1])]


def _line(coordinates: list, times: list) -> list[dict]:
    return [_position(c, times[i] if i < len(times) else None) for i, c in enumerate(coordinates or [])]


def _geometry(g: dict | None, name, properties, tracks: list, loose: list) -> None:
    kind, c = (g or {}).get("type"), (g or {}).get("coordinates")
    times = _line_times(properties, kind == "MultiLineString")
    flat = times[0] if times else []
    if kind == "LineString":
        tracks.append(_track([_line(c, flat)], name, None))
    elif kind == "MultiLineString":
        tracks.append(_track([_line(x, times[i] if i < len(times) else []) for i, x in enumerate(c or [])], name, None))
    elif kind == "Point":
        loose.append(_position(c, flat[0] if flat else None))
    elif kind == "MultiPoint":
        loose += _line(c, flat)
    elif kind == "GeometryCollection":
        for x in g.get("geometries") or []:
            _geometry(x, name, None, tracks, loose)


def read_geojson(data: bytes) -> Trace:
    try:
        root = json.loads(data.decode("utf-8-sig"))
    except ValueError as error:
        raise FormatError(f"not readable as geojson: {error}") from error
    if not isinstance(root, dict):
        raise FormatError("a geojson file holds an object")
    tracks, loose = [], []
    features = root.get("features") or [] if root.get("type") == "FeatureCollection" else [root] if root.get("type") == "Feature" else [{"geometry": root}]
    for f in features:
        p = f.get("properties") or {}
        _geometry(f.get("geometry"), p["name"] if isinstance(p.get("name"), str) else None, p, tracks, loose)
    if loose:
        tracks.append(_track([loose]))
    return _trace("geojson", tracks)


def header(names: list[str], aliases: dict[str, str] = ALIASES) -> dict[str, int]:
    """Place of each known column; of two names for one column the first wins."""
    out: dict[str, int] = {}
    for i, n in enumerate(names):
        known = aliases.get(re.sub(r"[ -]", "_", n.strip().lower().lstrip("\ufeff")))
        if known:
            out.setdefault(known, i)
    return out


def _csv_time(text: str, line: int) -> datetime | None:
    if not text:
        return None
    value = _time(text)
    if value is None:
        m = re.fullmatch(r"(\d{4}-\d\d-\d\d)[T ](\d\d:\d\d:\d\d)(\.\d+)?", text)
        value = _time(f"{m[1]}T{m[2]}{m[3] or ''}Z") if m else None
    if value is None:
        raise FormatError(f"line {line}: {text!r} is not a time")
    return value


def read_csv(data: bytes) -> Trace:
    rows = [[c.strip() for c in r] for r in csv.reader(io.StringIO(data.decode("utf-8-sig")))]
    rows = [r for r in rows if r]
    names = rows[0] if rows else []
    at = header(names)
    if "lat" not in at or "lon" not in at:
        raise FormatError(f"no latitude or longitude among the columns {', '.join(names)}")
    groups: dict[int, dict[int, list]] = {}
    for i, r in enumerate(rows[1:]):
        cell = lambda n, r=r: r[at[n]] if n in at and at[n] < len(r) else ""
        lat, lon = _number(cell("lat")), _number(cell("lon"))
        try:
            lat, lon = place(lat, lon)
        except FormatError as error:
            raise FormatError(f"line {i + 2}: {error}") from error
        track, segment = (int(v) if (v := _finite(_number(cell(n)))) is not None else 0 for n in ("track", "segment"))
        groups.setdefault(track, {}).setdefault(segment, []).append(_point(lat, lon, _finite(_number(cell("ele"))), _csv_time(cell("time"), i + 2)))
    return _trace(None, [_track(list(s.values())) for s in groups.values()])


READERS = {"gpx": read_gpx, "tcx": read_tcx, "geojson": read_geojson, "csv": read_csv}


def parse(data: bytes, name: str | None = None, explicit: str | None = None) -> tuple[Trace, str]:
    """The trace in a file, and its format."""
    fmt = detect(data, name, explicit)
    if fmt in NOT_BUILT:
        raise FormatError(f"reading {fmt} is not implemented")
    trace = READERS[fmt](data)
    trace["metadata"]["source_format"] = fmt
    return trace, fmt


# ---------------------------------------------------------------- writers


def _stamp(t: datetime, whole: bool) -> str:
    t = t.replace(tzinfo=UTC) if t.tzinfo is None else t.astimezone(UTC)
    base = t.strftime("%Y-%m-%dT%H:%M:%S")
    return base + ("Z" if whole or not t.microsecond else f".{t.microsecond:06d}".rstrip("0") + "Z")


def _n(x: float) -> str:
    return repr(float(x)).removesuffix(".0")


def _tag(name: str, value: str | None, pad: str) -> list[str]:
    return [f"{pad}<{name}>{escape(value)}</{name}>"] if value is not None else []


def write_gpx(trace: Trace) -> str:
    """GPX 1.1. Heart rate, cadence, temperature and fractions of a second are left out."""
    m = trace["metadata"] or {}
    out = ['<?xml version="1.0" encoding="UTF-8"?>', f'<gpx version="1.1" creator={quoteattr(m.get("source_device") or CREATOR)} xmlns="http://www.topografix.com/GPX/1/1">']
    meta = _tag("name", m.get("name"), "    ") + _tag("desc", m.get("description"), "    ") + _tag("time", _stamp(m["created"], True) if m.get("created") else None, "    ")
    out += ["  <metadata>", *meta, "  </metadata>"] if meta else []
    for t in trace["tracks"]:
        out += ["  <trk>", *_tag("name", t["name"], "    "), *_tag("desc", t["description"], "    ")]
        for s in t["segments"]:
            out.append("    <trkseg>")
            for p in s["points"]:
                out.append(f'      <trkpt lat="{_n(p["lat"])}" lon="{_n(p["lon"])}">')
                out += _tag("ele", None if p["ele"] is None else _n(p["ele"]), "        ") + _tag("time", _stamp(p["time"], True) if p["time"] else None, "        ")
                out += _tag("speed", None if p.get("speed") is None else _n(p["speed"]), "        ") + _tag("sat", None if p.get("satellites") is None else str(p["satellites"]), "        ")
                out += _tag("hdop", None if p.get("hdop") is None else _n(p["hdop"]), "        ") + ["      </trkpt>"]
            out.append("    </trkseg>")
        out.append("  </trk>")
    return "\n".join([*out, "</gpx>", ""])


def write_tcx(trace: Trace) -> str:
    """One activity per track, one lap per segment. Names, hdop, satellites and temperature are left out."""
    ns, ext = "http://www.garmin.com/xmlschemas/TrainingCenterDatabase/v2", "http://www.garmin.com/xmlschemas/ActivityExtension/v2"
    out = ['<?xml version="1.0" encoding="UTF-8"?>', f'<TrainingCenterDatabase xmlns="{ns}">', "  <Activities>"]
    epoch = datetime(1970, 1, 1, tzinfo=UTC)
    for t in trace["tracks"]:
        first = next((p["time"] for s in t["segments"] for p in s["points"] if p["time"]), epoch)
        out += ['    <Activity Sport="Other">', f"      <Id>{_stamp(first, False)}</Id>"]
        for s in t["segments"]:
            start = next((p["time"] for p in s["points"] if p["time"]), first)
            out += [f'      <Lap StartTime="{_stamp(start, False)}">', "        <Track>"]
            for p in s["points"]:
                out.append("          <Trackpoint>")
                out += _tag("Time", _stamp(p["time"], False) if p["time"] else None, "            ")
                out.append(f"            <Position><LatitudeDegrees>{_n(p['lat'])}</LatitudeDegrees><LongitudeDegrees>{_n(p['lon'])}</LongitudeDegrees></Position>")
                out += _tag("AltitudeMeters", None if p["ele"] is None else _n(p["ele"]), "            ")
                if p.get("heart_rate") is not None:
                    out.append(f"            <HeartRateBpm><Value>{p['heart_rate']}</Value></HeartRateBpm>")
                out += _tag("Cadence", None if p.get("cadence") is None else str(p["cadence"]), "            ")
                if p.get("speed") is not None:
                    out.append(f'            <Extensions><TPX xmlns="{ext}"><Speed>{_n(p["speed"])}</Speed></TPX></Extensions>')
                out.append("          </Trackpoint>")
            out += ["        </Track>", "      </Lap>"]
        out += _tag("Notes", t["description"], "      ") + ["    </Activity>"]
    return "\n".join([*out, "  </Activities>", "</TrainingCenterDatabase>", ""])


def write_geojson(trace: Trace) -> str:
    """A feature for each track with points; times if any point has one."""
    features = []
    for t in trace["tracks"]:
        segments = [s["points"] for s in t["segments"]]
        if not any(segments):
            continue
        lines = [[[p["lon"], p["lat"]] + ([p["ele"]] if p["ele"] is not None else []) for p in s] for s in segments]
        times = [[_stamp(p["time"], False) if p["time"] else None for p in s] for s in segments]
        one = len(segments) == 1
        properties = ({"name": t["name"]} if t["name"] is not None else {}) | ({"coordTimes": times[0] if one else times} if any(x for s in times for x in s) else {})
        geometry = {"type": "LineString", "coordinates": lines[0]} if one else {"type": "MultiLineString", "coordinates": lines}
        features.append({"type": "Feature", "properties": properties, "geometry": geometry})
    return json.dumps({"type": "FeatureCollection", "features": features}, indent=2, ensure_ascii=False) + "\n"


def write_csv(trace: Trace) -> str:
    """track, segment, lat, lon, ele, time; up to nine decimals; what is absent is an empty cell."""
    short = lambda x: f"{x:.9f}".rstrip("0").rstrip(".")
    rows = ["track,segment,lat,lon,ele,time"]
    for i, t in enumerate(trace["tracks"]):
        for j, s in enumerate(t["segments"]):
            rows += [f"{i},{j},{short(p['lat'])},{short(p['lon'])},{'' if p['ele'] is None else short(p['ele'])},{_stamp(p['time'], False) if p['time'] else ''}" for p in s["points"]]
    return "\n".join(rows) + "\n"


WRITERS = {"gpx": write_gpx, "tcx": write_tcx, "geojson": write_geojson, "csv": write_csv}


def render(trace: Trace, fmt: str) -> str:
    if fmt in NOT_BUILT:
        raise FormatError(f"writing {fmt} is not implemented")
    return WRITERS[fmt](trace)


def target_format(asked: str | None, path: str | None, fallback: str | None = None) -> str:
    """What is asked for, else what the output's name says, else the fallback."""
    found = asked or by_extension(path) or fallback
    if not found:
        raise FormatError("the output format can't be told; name it")
    return found


# ---------------------------------------------------------------- Spark

_STAMP = pa.timestamp("us", "UTC")
_POINT = pa.struct([("lat", pa.float64()), ("lon", pa.float64()), ("ele", pa.float64()), ("time", _STAMP), *[(n, pa.int32() if t == "int" else pa.float64()) for n, t in EXTRAS.items()], ("source", pa.string())])
_TRACKS = pa.list_(pa.struct([("name", pa.string()), ("description", pa.string()), ("segments", pa.list_(pa.struct([("points", pa.list_(_POINT))])))]))
_METADATA = pa.struct([("name", pa.string()), ("description", pa.string()), ("source_format", pa.string()), ("source_device", pa.string()), ("created", _STAMP)])
ARROW = pa.schema([("trace_id", pa.string()), ("metadata", _METADATA), ("tracks", _TRACKS)])


def read_traces(spark: SparkSession, paths: str | list[str], explicit: str | None = None) -> DataFrame:
    """Nested traces of the files under paths; trace_id is the file's path. A file that can't be read is an error."""

    def make(batches):
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    trace, _ = parse(data, path, explicit)
                except FormatError as error:
                    raise FormatError(f"{path}: {error}") from error
                yield pa.RecordBatch.from_pylist([{"trace_id": path, **trace}], schema=ARROW)

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(make, TRACES)


def written_traces(traces: DataFrame, fmt: str) -> DataFrame:
    """trace_id and content: each trace as the text of a file."""
    if fmt in NOT_BUILT:
        raise FormatError(f"writing {fmt} is not implemented")

    def make(batches):
        for batch in batches:
            texts = [render(t, fmt) for t in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["trace_id", "content"])

    return traces.select("trace_id", "metadata", "tracks").mapInArrow(make, "trace_id string, content string")
