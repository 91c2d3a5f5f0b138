"""The data model: traces as nested rows, and points as flat rows under position keys.

Tracks, segments and points have no ids but their positions, so every operator consumes and produces
(trace_id, track_idx, seg_idx, pt_idx). The nested form is the source of truth for empty tracks and segments,
which have no points; the flat form is what operators work on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import geo

TRACE, TRACK, SEGMENT = ["trace_id"], ["trace_id", "track_idx"], ["trace_id", "track_idx", "seg_idx"]
ORDER = [*SEGMENT, "pt_idx"]
EXTRAS = {"heart_rate": "int", "cadence": "int", "speed": "double", "hdop": "double", "satellites": "int", "temperature": "double"}
_VALUES = "lat double, lon double, ele double, time timestamp, " + ", ".join(f"{n} {t}" for n, t in EXTRAS.items())
POINTS = f"trace_id string, track_idx int, seg_idx int, pt_idx bigint, {_VALUES}, source string"
POINT = f"struct<{', '.join(x.strip().replace(' ', ':', 1) for x in (_VALUES + ', source string').split(','))}>".replace(", ", ",")
METADATA = "struct<name:string,description:string,source_format:string,source_device:string,created:timestamp>"
TRACES = f"trace_id string, metadata {METADATA}, tracks array<struct<name:string,description:string,segments array<struct<points:array<{POINT}>>>>>".replace("segments array", "segments:array")


def along(keys: list[str] | None = None) -> WindowSpec:
    """Recorded order within a segment."""
    return Window.partitionBy(*(keys or SEGMENT)).orderBy("pt_idx")


def complete(df: DataFrame) -> DataFrame:
    """df with every column of the flat form that it lacks, as NULL (position keys as 0), and in its order; others follow."""
    out = []
    for f in _fields():
        if f[0] in df.columns:
            out.append(F.col(f[0]).cast(f[1]).alias(f[0]))
        else:
            out.append((F.lit(0) if f[0].endswith("_idx") else F.lit(None)).cast(f[1]).alias(f[0]))
    known = {f[0] for f in _fields()}
    return df.select(*out, *[F.col(f"`{c}`") for c in df.columns if c not in known])


def _fields() -> list[tuple[str, str]]:
    return [tuple(x.strip().split(" ")) for x in POINTS.split(",")]


def checked(points: DataFrame, invalid: str = "error") -> DataFrame:
    """Validated positions: longitudes are wrapped, elevations that aren't finite are dropped, 16-bit extras that don't fit too.

    invalid: what happens to a latitude beyond 90 degrees or a coordinate that isn't finite or is missing: "error"
    raises, "drop" leaves the row out, "zero" puts both to 0.
    """
    good = F.coalesce(geo.valid_lat(F.col("lat")) & geo.valid_lon(F.col("lon")), F.lit(False))
    small = lambda c: F.when(F.col(c).between(0, 65535), F.col(c))
    fixed = {"lon": geo.normal_lon(F.col("lon"))}
    if invalid == "drop":
        points = points.filter(good)
    elif invalid == "zero":
        fixed = {"lat": F.when(good, F.col("lat")).otherwise(0.0), "lon": F.when(good, fixed["lon"]).otherwise(0.0)}
    else:
        fixed["lat"] = F.when(good, F.col("lat")).otherwise(F.raise_error(F.concat(F.lit("invalid coordinate: "), F.coalesce(F.col("lat").cast("string"), F.lit("none")), F.lit(", "), F.coalesce(F.col("lon").cast("string"), F.lit("none")))).cast("double"))
    ele = F.col("ele")
    fixed["ele"] = F.when(~F.isnan(ele) & (F.abs(ele) != float("inf")), ele)
    return points.withColumns(fixed | {c: small(c) for c in ("heart_rate", "cadence", "satellites") if c in points.columns})


def flattened(traces: DataFrame) -> DataFrame:
    """Points of nested traces; empty tracks and segments have none."""
    tracks = traces.select("trace_id", F.posexplode("tracks").alias("track_idx", "t"))
    segments = tracks.select("trace_id", "track_idx", F.posexplode("t.segments").alias("seg_idx", "s"))
    return complete(segments.select("trace_id", "track_idx", "seg_idx", F.posexplode("s.points").alias("pt_idx", "p")).select("trace_id", "track_idx", "seg_idx", F.col("pt_idx").cast("bigint").alias("pt_idx"), "p.*"))


def nested(points: DataFrame, tracks: DataFrame | None = None, metadata: DataFrame | None = None) -> DataFrame:
    """Nested traces of points. tracks: trace_id, track_idx, name, description; metadata: trace_id, metadata.

    A segment is gathered in one row, as it is in the nested form by its definition.
    """
    names = [f[0] for f in _fields()[4:]]
    value = F.struct("pt_idx", F.struct(*names).alias("p"))
    segments = complete(points).groupBy(*SEGMENT).agg(F.transform(F.sort_array(F.collect_list(value)), lambda x: x["p"]).alias("points"))
    by_track = segments.groupBy(*TRACK).agg(F.transform(F.sort_array(F.collect_list(F.struct("seg_idx", F.struct("points").alias("s")))), lambda x: x["s"]).alias("segments"))
    if tracks is None:
        named = by_track.withColumns({"name": F.lit(None).cast("string"), "description": F.lit(None).cast("string")})
    else:
        named = tracks.select(*TRACK, "name", "description").join(by_track, TRACK, "left").withColumn("segments", F.coalesce("segments", F.array().cast(f"array<struct<points:array<{POINT}>>>")))
    out = named.groupBy(*TRACE).agg(F.transform(F.sort_array(F.collect_list(F.struct("track_idx", F.struct("name", "description", "segments").alias("t")))), lambda x: x["t"]).alias("tracks"))
    if metadata is None:
        return out.select("trace_id", F.lit(None).cast(METADATA).alias("metadata"), "tracks")
    return metadata.select("trace_id", "metadata").join(out, "trace_id", "left").select("trace_id", "metadata", "tracks")


def renumbered(points: DataFrame) -> DataFrame:
    """Positions made dense again after rows have gone: empty segments and tracks close up.

    Two narrow aggregates, of segments and of tracks, carry the new numbers; points travel once.
    """
    segments = points.select(*SEGMENT).distinct()
    by_track = Window.partitionBy(*TRACE).orderBy("track_idx")
    by_segment = Window.partitionBy(*TRACK).orderBy("seg_idx")
    numbers = segments.withColumns({"_t": F.dense_rank().over(by_track) - 1, "_s": F.row_number().over(by_segment) - 1})
    joined = points.join(numbers, SEGMENT)
    return joined.withColumn("pt_idx", (F.row_number().over(along()) - 1).cast("bigint")).withColumns({"track_idx": F.col("_t"), "seg_idx": F.col("_s")}).drop("_t", "_s")


def micros(c: str | Column) -> Column:
    return F.unix_micros(F.col(c) if isinstance(c, str) else c)


def merged_extras(first: str, second: str) -> list[Column]:
    """Position of the first point; elevation, time and each extra from the second where the first has none."""
    own = [F.col(f"{first}.lat").alias("lat"), F.col(f"{first}.lon").alias("lon")]
    return own + [F.coalesce(F.col(f"{first}.{c}"), F.col(f"{second}.{c}")).alias(c) for c in ("ele", "time", *EXTRAS)]
