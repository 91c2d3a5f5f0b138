"""The events table as GPS traces, for both engines.

A user is a trace, an event type is a device, and positions follow from the event's number with integer
arithmetic, so both engines compute the same doubles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geo import geodesic_stages
from ..operators.points import complete

GAP_S = 12 * 3600


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each event: trace_id, event_id, wall (timestamp_ntz), source, lat, lon, ele, heart_rate."""
    place = lambda k: (((F.col("event_id") * k) % 20001) - 10000).cast("double") * 1e-6
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("trace_id"), "event_id", F.col("ts").alias("wall"), F.col("event_type").alias("source"),
        (F.lit(47.6) + place(7919)).alias("lat"), (F.lit(-122.3) + place(104729)).alias("lon"), F.col("value").cast("double").alias("ele"),
        F.get_json_object("props", "$.k").cast("int").alias("heart_rate"),
    )


def points(spark: SparkSession, sf_dir: str, gap_s: int = GAP_S) -> DataFrame:
    """The flat form; segments are cut at gaps. event_id follows."""
    w = Window.partitionBy("trace_id").orderBy("wall", "event_id")
    new = F.when(F.expr("timestampdiff(MICROSECOND, _p, wall)") > gap_s * 1_000_000, 1).otherwise(0)
    cut = fixes(spark, sf_dir).withColumn("_p", F.lag("wall").over(w)).withColumn("_n", new)
    cut = cut.withColumn("seg_idx", F.sum("_n").over(w).cast("int")).withColumn("time", F.timestamp_micros(F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', wall)")))
    at = Window.partitionBy("trace_id", "seg_idx").orderBy("wall", "event_id")
    return complete(cut.withColumn("pt_idx", F.row_number().over(at) - 1).drop("wall", "_p", "_n"))


def devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as journeys of several devices: group_id is the user, input_idx the device's place by name."""
    p = fixes(spark, sf_dir).withColumn("time", F.timestamp_micros(F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', wall)")))
    names = p.select("source").distinct().withColumn("input_idx", F.row_number().over(Window.orderBy("source")) - 1)  # one row per device
    w = Window.partitionBy("trace_id", "input_idx").orderBy("wall", "event_id")
    flat = p.join(F.broadcast(names), "source").withColumn("group_id", F.col("trace_id")).withColumn("pt_idx", F.row_number().over(w) - 1).drop("wall")
    return complete(flat.withColumn("trace_id", F.concat_ws("/", "group_id", "source")))


# The same in SQL. Names of the common tables: fix, pts, dev.
FIX = """fix AS (SELECT user_id::VARCHAR AS trace_id, event_id, ts, event_type AS source,
 47.6::DOUBLE + (((event_id * 7919) % 20001) - 10000)::DOUBLE * 1e-6::DOUBLE AS lat,
 -122.3::DOUBLE + (((event_id * 104729) % 20001) - 10000)::DOUBLE * 1e-6::DOUBLE AS lon,
 value::DOUBLE AS ele, CAST(json_extract_string(props, '$.k') AS INTEGER) AS heart_rate, epoch_us(ts) AS t FROM events)"""

PTS = f"""{FIX}, cut AS (SELECT *, CASE WHEN t - lag(t) OVER w > {GAP_S * 1_000_000} THEN 1 ELSE 0 END AS new FROM fix WINDOW w AS (PARTITION BY trace_id ORDER BY ts, event_id)),
seg AS (SELECT *, sum(new) OVER (PARTITION BY trace_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::INTEGER AS seg_idx FROM cut),
pts AS (SELECT *, row_number() OVER (PARTITION BY trace_id, seg_idx ORDER BY ts, event_id) - 1 AS pt_idx FROM seg)"""

DEV = f"""{FIX}, dev AS (SELECT *, trace_id AS group_id, dense_rank() OVER (ORDER BY source) - 1 AS input_idx FROM fix)"""


def measured(source: str, name: str, lat1: str, lon1: str, lat2: str, lon2: str, out: str) -> str:
    """Common tables that end in `name`: source (a table or a query in brackets) with the geodesic distance out."""
    tag = f"g_{name}"
    ends = {f"{tag}_a": lat1, f"{tag}_b": lon1, f"{tag}_c": lat2, f"{tag}_d": lon2}
    parts = [f"{tag}_s0 AS (SELECT *, {', '.join(f'({e})::DOUBLE AS {n}' for n, e in ends.items())} FROM {source})"]
    for i, stage in enumerate(geodesic_stages(*ends, out=f"{tag}_out", tag=tag)):
        parts.append(f"{tag}_s{i + 1} AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in stage.items())} FROM {tag}_s{i})")
    last = f"{tag}_s{len(parts) - 1}"
    return ",\n".join(parts) + f",\n{name} AS (SELECT * EXCLUDE ({tag}_out), {tag}_out AS {out} FROM (SELECT COLUMNS(c -> NOT starts_with(c, '{tag}_') OR c = '{tag}_out') FROM {last}))".replace("c -> ", "lambda c: ")


#: pts with step_m, the distance from the point before.
STEPS = f"""{PTS}, lagged AS (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM pts WINDOW w AS (PARTITION BY trace_id, seg_idx ORDER BY pt_idx)),
{measured('lagged', 'steps', 'plat', 'plon', 'lat', 'lon', 'step_m')}"""
