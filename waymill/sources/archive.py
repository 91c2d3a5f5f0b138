"""Health archives: zip files and folders as one namespace of entries.

Only two families of entries are ever opened, exercise logs and position days: an archive holds private health
data beside them, so this is a rule and not just a saving. Listing reads the central directory only. Each wanted
entry is one task, which opens its own zip; paths must be visible to the executors.
"""

from __future__ import annotations

import csv
import io
import json
import os
import re
import zipfile
from dataclasses import dataclass
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .formats import FormatError, _finite, _number, _time, header, place

# Names of the entries, columns of a day, the format of a start.
DAY = re.compile(r"gps_location_(\d{4}-\d\d-\d\d)\.csv")
LOG = re.compile(r"exercise-\d+\.json")
TIMELINE = re.compile(r"(timeline|location-history|records)\.json", re.I)
MONTH = re.compile(r"\d{4}_[^/]*\.json")
COLUMNS = {"timestamp": "time", "time": "time", "latitude": "lat", "lat": "lat", "longitude": "lon", "lon": "lon", "lng": "lon", "altitude": "ele", "ele": "ele", "elevation": "ele", "data_source": "source", "source": "source"}
START = "%m/%d/%y %H:%M:%S"

LOGS = "log_id long, name string, type_id long, start timestamp_ntz, duration_ms long, has_gps boolean"
_LOGS = pa.schema([("log_id", pa.int64()), ("name", pa.string()), ("type_id", pa.int64()), ("start", pa.timestamp("us")), ("duration_ms", pa.int64()), ("has_gps", pa.bool_())])
FIXES = "day date, row long, time timestamp, lat double, lon double, ele double, source string"
_FIXES = pa.schema([("day", pa.date32()), ("row", pa.int64()), ("time", pa.timestamp("us", "UTC")), ("lat", pa.float64()), ("lon", pa.float64()), ("ele", pa.float64()), ("source", pa.string())])


@dataclass(frozen=True, order=True)
class Entry:
    name: str
    part: str

    @property
    def file_name(self) -> str:
        return self.name.rsplit("/", 1)[-1]

    def read(self) -> bytes:
        if os.path.isdir(self.part):
            with open(os.path.join(self.part, self.name), "rb") as f:
                return f.read()
        with zipfile.ZipFile(self.part) as z:
            return z.read(self.name)


def gps_day(file_name: str) -> str | None:
    """The date in the name of a day's file."""
    m = DAY.fullmatch(file_name)
    try:
        return m and datetime.strptime(m[1], "%Y-%m-%d").date().isoformat()
    except ValueError:
        return None


def is_log(file_name: str) -> bool:
    return LOG.fullmatch(file_name) is not None


class Archive:
    """Entries of all parts, by name; nothing is decompressed."""

    def __init__(self, paths: list[str]):
        self.entries: list[Entry] = []
        for path in paths:
            if os.path.isdir(path):
                for folder, folders, files in os.walk(path):
                    folders[:] = [d for d in folders if not os.path.islink(os.path.join(folder, d))]
                    self.entries += [Entry(os.path.relpath(os.path.join(folder, f), path).replace(os.sep, "/"), path) for f in files if not os.path.islink(os.path.join(folder, f))]
            elif zipfile.is_zipfile(path):
                with zipfile.ZipFile(path) as z:
                    self.entries += [Entry(i.filename, path) for i in z.infolist() if not i.is_dir()]
            else:
                raise FormatError(f"{path} is neither a folder nor a zip file")
        self.entries.sort()

    def backend(self) -> str | None:
        """fitbit, timeline or None, by names alone."""
        names = [e.file_name for e in self.entries]
        if any(gps_day(n) or is_log(n) for n in names):
            return "fitbit"
        return "timeline" if any(TIMELINE.fullmatch(n) or MONTH.fullmatch(n) for n in names) else None

    def products(self) -> list[str]:
        """Distinct first two components of the entries' folders."""
        return sorted({"/".join(p[:2]) if len(p) > 2 else p[0] for e in self.entries if (p := e.name.split("/"))})

    def logs(self) -> list[Entry]:
        return [e for e in self.entries if is_log(e.file_name)]

    def days(self) -> dict[str, Entry]:
        """Date to entry; of two for a day the last by name counts."""
        return {d: e for e in self.entries if (d := gps_day(e.file_name))}

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(e.part, e.name) for e in self.entries], "part string, entry string")


def parse_logs(data: bytes, name: str = "") -> list[tuple]:
    out = []
    for x in json.loads(data):
        try:
            start = datetime.strptime(x["startTime"], START)
        except (KeyError, ValueError, TypeError) as error:
            raise FormatError(f"{name}: log {x.get('logId')} has no readable start: {x.get('startTime')!r}") from error
        duration = x.get("activeDuration") if x.get("activeDuration") is not None else x.get("duration") or 0
        out.append((x["logId"], x.get("activityName"), x.get("activityTypeId"), start, max(0, duration), bool(x.get("hasGps", False))))
    return out


def parse_day(data: bytes, day: str) -> list[tuple]:
    rows = [r for r in csv.reader(io.StringIO(data.decode("utf-8-sig"))) if r]
    at = header(rows[0] if rows else [], COLUMNS)
    if not {"time", "lat", "lon"} <= at.keys():
        raise FormatError(f"{day}: no time, latitude or longitude among the columns {', '.join(rows[0] if rows else [])}")
    out = []
    for i, r in enumerate(rows[1:]):
        cell = lambda n, r=r: r[at[n]].strip() if n in at and at[n] < len(r) else ""
        time = _time(cell("time"))
        if time is None:
            raise FormatError(f"{day}, line {i + 2}: {cell('time')!r} is not a time")
        lat, lon = place(_number(cell("lat")), _number(cell("lon")))
        out.append((time, i, lat, lon, _finite(_number(cell("ele"))), cell("source") or "unknown"))
    date = datetime.strptime(day, "%Y-%m-%d").date()
    return [(date, i, t, lat, lon, ele, source) for i, (t, _, lat, lon, ele, source) in enumerate(sorted(out, key=lambda x: x[0]))]


def _rows(schema: pa.Schema, data: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in data], schema=schema)


def read_logs(spark: SparkSession, archive: Archive) -> DataFrame:
    """All exercise logs; repeated ones stay."""
    return _read(spark, [(e.part, e.name, "") for e in archive.logs()], LOGS, _LOGS, lambda data, name, _: parse_logs(data, name))


def read_fixes(spark: SparkSession, archive: Archive, days: list[str] | None = None) -> DataFrame:
    """Fixes of the days (all by default); a day that isn't asked for is not decompressed."""
    found = archive.days()
    wanted = [(e.part, e.name, d) for d, e in found.items() if days is None or d in set(days)]
    return _read(spark, wanted, FIXES, _FIXES, lambda data, _, day: parse_day(data, day))


def _read(spark: SparkSession, entries: list[tuple], ddl: str, schema: pa.Schema, parse) -> DataFrame:
    if not entries:
        return spark.createDataFrame([], ddl)
    frame = spark.createDataFrame(entries, "part string, name string, day string").repartition(min(len(entries), 512))

    def make(batches):
        for batch in batches:
            for x in batch.to_pylist():
                yield _rows(schema, parse(Entry(x["name"], x["part"]).read(), x["name"], x["day"]))

    return frame.mapInArrow(make, ddl)


def write_each(points: DataFrame, folder: str, fmt: str, extension: str | None = None) -> list[str]:
    """One file per trace of extracted points, named by start and kind; those that would share a name add their log id.

    Files are written by the executors into folder, which they must share with the driver.
    """
    from ..functions.text import slug
    from ..operators.points import nested
    from . import formats

    first = points.groupBy("trace_id").agg(F.min("start_us").alias("s"), F.first("name").alias("kind"), F.first("track_name").alias("name"), F.first("description").alias("description"), F.first("source").alias("device"), F.min("time").alias("created"))
    stem = F.concat(F.date_format(F.timestamp_micros("s"), "yyyyMMdd'T'HHmmss'Z'"), F.lit("-"), slug(F.col("kind")))
    named = first.withColumn("stem", stem)
    twice = named.groupBy("stem").agg((F.count("*") > 1).alias("shared"))
    files = named.join(twice, "stem").withColumn("file", F.concat("stem", F.when(F.col("shared"), F.concat(F.lit("-"), "trace_id")).otherwise(""), F.lit(f".{extension or fmt}")))
    meta = named.select("trace_id", F.struct("name", "description", F.lit(None).cast("string").alias("source_format"), F.col("device").alias("source_device"), "created").alias("metadata"))
    tracks = named.select("trace_id", F.lit(0).alias("track_idx"), "name", "description")
    texts = formats.written_traces(nested(points, tracks, meta), fmt).join(files.select("trace_id", "file"), "trace_id")
    os.makedirs(folder, exist_ok=True)

    def put(rows):
        for r in rows:
            with open(os.path.join(folder, r["file"]), "w", encoding="utf-8", newline="") as f:
                f.write(r["content"])

    texts.foreachPartition(put)
    return sorted(r["file"] for r in files.select("file").collect())  # one name per activity
