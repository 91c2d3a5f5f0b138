import io
import json
import sys
import zipfile
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymill import cli
from waymill.functions import text as X
from waymill.operators import measures as M
from waymill.operators import points as P
from waymill.operators import rendering as R
from waymill.sources import archive, formats, png
from waymill.streaming import traces as stream

from .test_operators import T0, north, trace

GPX = """<?xml version="1.0"?><gpx version="1.1" creator="dev" xmlns="http://www.topografix.com/GPX/1/1"><metadata><name>Ride</name><time>2024-05-01T15:00:00Z</time></metadata>
<trk><name>One</name><trkseg><trkpt lat="47.6" lon="-122.3"><ele>10</ele><time>2024-05-01T15:00:00.5Z</time></trkpt><trkpt lat="47.61" lon="-122.3"/></trkseg><trkseg/></trk>
<rte><rtept lat="95" lon="1"/></rte><wpt lat="1" lon="1"/></gpx>"""
TCX = """<TrainingCenterDatabase xmlns="x"><Activities><Activity Sport="Biking"><Id>2024-05-01T15:00:00Z</Id><Lap><Track><Trackpoint><Time>2024-05-01T15:00:00Z</Time><Position><LatitudeDegrees>1</LatitudeDegrees><LongitudeDegrees>2</LongitudeDegrees></Position>
<AltitudeMeters>5</AltitudeMeters><HeartRateBpm><Value>120</Value></HeartRateBpm><Cadence>80</Cadence><Extensions><TPX><Speed>3.5</Speed></TPX></Extensions></Trackpoint><Trackpoint><Time>2024-05-01T15:00:01Z</Time></Trackpoint></Track><Track/></Lap><Notes>n</Notes><Creator><Name>Watch</Name></Creator></Activity></Activities></TrainingCenterDatabase>"""


def sizes(t):
    return [[len(s["points"]) for s in x["segments"]] for x in t["tracks"]]


def test_gpx():
    t = formats.read_gpx(GPX.encode())
    assert sizes(t) == [[2, 0], [1]]  # routes follow tracks; loose points only count without them
    p = t["tracks"][0]["segments"][0]["points"][0]
    assert (p["ele"], p["time"].microsecond, t["metadata"]["source_device"]) == (10.0, 500000, "dev")
    assert t["tracks"][1]["segments"][0]["points"][0]["lat"] == 0.0  # nowhere, but kept
    again = formats.read_gpx(formats.write_gpx(t).encode())
    assert again["tracks"][0]["segments"][0]["points"][0]["time"].microsecond == 0
    assert sizes(again) == [[2, 0], [1]]


def test_tcx():
    t = formats.read_tcx(TCX.encode())
    p = t["tracks"][0]["segments"][0]["points"][0]
    assert sizes(t) == [[1, 0]]  # without a place a point goes, an empty track stays
    assert (p["heart_rate"], p["cadence"], p["speed"], t["metadata"]["source_device"], t["tracks"][0]["description"]) == (120, 80, 3.5, "Watch", "n")
    assert formats.read_tcx(formats.write_tcx(t).encode())["tracks"][0]["segments"][0]["points"][0] == p


def test_geojson():
    lines = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"name": "a", "coordTimes": ["2024-05-01T15:00:00Z", None]}, "geometry": {"type": "LineString", "coordinates": [[1, 2, 3], [4, 5]]}},
        {"type": "Feature", "properties": {"coordTimes": ["2024-05-01T15:00:00Z"]}, "geometry": {"type": "MultiLineString", "coordinates": [[[1, 2]], [[3, 4]]]}},
        {"type": "Feature", "properties": None, "geometry": {"type": "Point", "coordinates": [7, 8]}}, {"type": "Feature", "geometry": None},
        {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": []}},
    ]}
    t = formats.read_geojson(json.dumps(lines).encode())
    assert sizes(t) == [[2], [1, 1], [1]]
    times = [[p["time"] is not None for p in s["points"]] for x in t["tracks"] for s in x["segments"]]
    assert times == [[True, False], [True], [False], [False]]
    assert sizes(formats.read_geojson(formats.write_geojson(t).encode())) == sizes(t)
    with pytest.raises(formats.FormatError):
        formats.read_geojson(b'{"type": "Point", "coordinates": [1, 95]}')


def test_csv():
    data = "Segment, Latitude,LNG,alt,Time,track\n1,1,2,x,2024-05-01 15:00:00,0\n0,3,4,5,,0\n1,5,6,,2024-05-01T15:00:01.25Z,0\n0,7,8,,,1\n"
    t = formats.read_csv(data.encode())
    assert sizes(t) == [[2, 1], [1]]  # in the order in which they appear
    assert [p["lat"] for p in t["tracks"][0]["segments"][0]["points"]] == [1.0, 5.0]
    assert formats.write_csv(t).splitlines()[2] == "0,0,5,6,,2024-05-01T15:00:01.25Z"
    for bad in ("lat,x\n1,2\n", "lat,lon\n1,\n", "lat,lon,time\n1,2,noon\n"):
        with pytest.raises(formats.FormatError):
            formats.read_csv(bad.encode())


@pytest.mark.parametrize(("data", "name", "found"), [(GPX, None, "gpx"), (TCX, None, "tcx"), (" [1]", None, "geojson"), ("a,lat,lon\n", None, "csv"), ("<kml/>", None, "kml"), ("01234567.FIT", None, "fit"), ("{", "x.CSV", "csv"), ("x", "a.json", "geojson")])
def test_detection(spark, data, name, found):
    assert formats.detect(data.encode(), name) == found
    if not name:
        assert spark.createDataFrame([(data,)], "c string").select(formats.sniffed(F.col("c"))).first()[0] == found


def test_unknown_and_unbuilt_formats():
    with pytest.raises(formats.FormatError):
        formats.detect(b"hello")
    for fmt in formats.NOT_BUILT:
        with pytest.raises(formats.FormatError, match="not implemented"):
            formats.parse(b"x", f"a.{fmt}")
        with pytest.raises(formats.FormatError, match="not implemented"):
            formats.render({}, fmt)


def test_files_become_traces(spark, tmp_path):
    (tmp_path / "a.gpx").write_text(GPX)
    (tmp_path / "b.tcx").write_text(TCX)
    traces = formats.read_traces(spark, str(tmp_path))
    rows = {r.trace_id.rsplit("/", 1)[1]: tuple(r)[1:] for r in M.nested_counts(traces).collect()}
    assert rows == {"a.gpx": (2, 3, 3, False), "b.tcx": (1, 2, 1, False)}
    (tmp_path / "c.csv").write_text("nothing")
    with pytest.raises(Exception, match="c.csv"):
        formats.read_traces(spark, str(tmp_path)).collect()


DAY = "timestamp,latitude,longitude,altitude,data source\n2026-07-11T11:31:00Z,47.1,-122,5,Phone\n2026-07-11T11:30:00Z,47.0,-122,,\n"
LOGS = [{"logId": 7, "activityName": "Walk", "startTime": "07/11/26 11:30:00", "duration": 600000, "hasGps": True}, {"logId": 8, "activityName": "Swim", "startTime": "07/12/26 11:30:00"}]


def test_archives(spark, tmp_path):
    folder = tmp_path / "Takeout/Health"
    folder.mkdir(parents=True)
    (folder / "gps_location_2026-07-11.csv").write_text(DAY)
    (folder / "exercise-0.json").write_text(json.dumps(LOGS))
    (folder / "private.csv").write_text("never opened")
    with zipfile.ZipFile(tmp_path / "t.zip", "w") as z:
        for f in folder.iterdir():
            z.write(f, f"Takeout/Health/{f.name}")
    both = [archive.Archive([str(p)]) for p in (tmp_path / "Takeout", tmp_path / "t.zip")]
    results = [(sorted(map(str, archive.read_logs(spark, a).collect())), sorted(map(str, archive.read_fixes(spark, a).collect()))) for a in both]
    assert results[0] == results[1]
    assert both[1].backend() == "fitbit" and both[1].products() == ["Takeout/Health"]
    fixes = archive.read_fixes(spark, both[0]).orderBy("row").collect()
    assert [(r.lat, r.source) for r in fixes] == [(47.0, "unknown"), (47.1, "Phone")]
    assert archive.read_fixes(spark, both[0], []).count() == 0
    with pytest.raises(formats.FormatError):
        archive.parse_logs(b'[{"logId": 1, "startTime": "x"}]')
    out = tmp_path / "o.csv"
    assert cli.main(["takeout", str(tmp_path / "t.zip"), "--type", "walk", "-o", str(out), "--source", "phone"], spark) == 0
    assert out.read_text().splitlines()[1].startswith("0,0,47.1,-122,5,")
    assert cli.main(["takeout", str(tmp_path / "t.zip"), "--type", "row"], spark) == 1


def test_commands(spark, tmp_path, capfdbinary):
    (tmp_path / "a.gpx").write_text(GPX)
    source = str(tmp_path / "a.gpx")
    assert cli.main(["info", source, "--json"], spark) == 0
    found = json.loads(capfdbinary.readouterr().out)
    assert (found["source_format"], found["tracks"], found["segments"], found["points"], found["name"]) == ("gpx", 2, 3, 3, "Ride")
    assert cli.main(["convert", source, "-o", str(tmp_path / "b.geojson")], spark) == 0
    assert json.loads((tmp_path / "b.geojson").read_text())["type"] == "FeatureCollection"
    assert cli.main(["clean", source, "-o", str(tmp_path / "c.csv"), "--redact-around", "47.6,-122.3,100m"], spark) == 0
    assert len((tmp_path / "c.csv").read_text().splitlines()) == 3
    assert cli.main(["merge", source, source, "-o", str(tmp_path / "d.csv"), "-v"], spark) == 0
    assert cli.main(["info", str(tmp_path / "none.gpx")], spark) == 2
    assert cli.main(["convert", source, "--to", "kml"], spark) == 1
    assert cli.main(["view", source, "--columns", "20", "--rows", "4"], spark) == 0


def test_info_and_listing_are_tables(spark, tmp_path, capfdbinary):
    (tmp_path / "a.csv").write_text("lat,lon,ele,time\n47,-122,5,2026-07-11T11:30:00Z\n47.001,-122.002,25,2026-07-11T11:31:00Z\n")
    assert cli.main(["info", str(tmp_path / "a.csv")], spark) == 0
    shown = capfdbinary.readouterr().out.decode().splitlines()
    assert [x[2:14].strip() for x in shown] == ["format", "tracks", "segments", "points", "distance", "duration", "avg speed", "elevation", "time", "bounds", "bbox"]
    assert shown[7] == "  elevation   +20 m / -0 m  (5\u201325 m)"
    assert shown[-1] == "  bbox        -122.002000,47.000000,-122.000000,47.001000"
    assert shown[-2] == "  bounds      47.0000, -122.0020 \u2192 47.0010, -122.0000"
    table = cli.listing([{"name": "Walk", "logs": 12, "with_gps": 7}, {"name": "Swim", "logs": 3, "with_gps": 0}], {"total_logs": 15, "total_with_gps": 7, "days_of_recording": 5})
    assert table == "activity type  logs  with GPS\nWalk             12         7\nSwim              3         0\n\n15 logs, 7 with GPS, 5 days of recording\n"


class Piped:
    def __init__(self, data, terminal=False):
        self.buffer, self.terminal = io.BytesIO(data), terminal

    def isatty(self):
        return self.terminal


def test_inputs_of_a_drawing(tmp_path, monkeypatch):
    image, trace = png.SIGNATURE + b"...", b"<gpx/>"
    (tmp_path / "m.png").write_bytes(image)
    (tmp_path / "t.gpx").write_bytes(trace)
    m, t = str(tmp_path / "m.png"), str(tmp_path / "t.gpx")

    def given(piped, *names, terminal=False):
        monkeypatch.setattr(sys, "stdin", Piped(piped, terminal))
        return cli.drawing_inputs(*names)

    assert given(b"", t, m) == (trace, t, image)
    assert given(trace, "-", m) == given(trace, None, m) == (trace, None, image)
    assert given(image, t, "-") == given(image, t, None) == (trace, t, image)
    for piped, names in ((trace, ("-", "-")), (image, (None, m)), (image, (None, None)), (trace, (t, None)), (trace, (None, None)), (trace, ("-", None)), (image, (None, "-"))):
        with pytest.raises(formats.FormatError):
            given(piped, *names)
    with pytest.raises(formats.FormatError, match="no input"):
        given(b"", None, m, terminal=True)


def test_views_fit_zoom_and_pan():
    port = R.Viewport.fit(0, 0, 4, 1, 2.0)
    assert (port.x, port.y, port.height) == (2, 0.5, pytest.approx(2 * 1.08))
    assert port.bounds(2.0) == pytest.approx((2 - 2.16, 0.5 - 1.08, 2 + 2.16, 0.5 + 1.08))
    assert port.zoomed(0.5).height == pytest.approx(1.08) and port.zoomed(1e9).height == R.FARTHEST and port.zoomed(0).height == R.NEAREST
    moved = port.panned(0.5, -1, 2.0)
    assert (moved.x, moved.y) == pytest.approx((2 + 2.16, 0.5 - 2.16))
    assert R.Viewport.fit(1, 1, 1, 1, 2.0).height == R.NO_EXTENT
    assert R.is_blank(np.zeros((2, 2))) and not R.is_blank(np.array([[0, 0.1]]))


@pytest.mark.parametrize(("env", "feet"), [({"LC_ALL": "C", "LANG": "en_US.UTF-8"}, True), ({"LANG": "en-US"}, True), ({"LC_MEASUREMENT": "de_DE", "LANG": "en_US"}, False), ({"LANG": "my_MM"}, True), ({"LANG": "POSIX"}, False), ({}, False), ({"LANG": "en_LR.UTF-8@x"}, True)])
def test_regions_that_measure_in_feet(env, feet):
    assert X.imperial_locale(env) is feet


@pytest.mark.parametrize(("data", "fmt"), [(b"\xef\xbb\xbf \r\n<GPX>", "gpx"), (b"<?xml?><trainingcenterDATABASE>", "tcx"), (b"<x><KML/>", "kml"), (b"<html>", None), (b"a,Longitude\n1,2", "csv"), (b"time,LAT\n", "csv"), (b"a;lat", None), (b" [1]", "geojson"), (b"12345678.FIT", "fit")])
def test_contents_tell_their_format(spark, data, fmt):
    assert formats.by_content(data) == fmt
    assert spark.createDataFrame([(data.decode("utf-8"),)], "c string").select(formats.sniffed(F.col("c"))).first()[0] == fmt


def test_times_of_loose_points():
    times = ["2026-07-11T11:30:00Z", "2026-07-11T11:31:00Z"]
    one = {"type": "Feature", "properties": {"coordTimes": times, "desc": "x", "name": "n"}, "geometry": {"type": "MultiPoint", "coordinates": [[1, 2], [3, 4], [5, 6]]}}
    two = {"type": "Feature", "properties": {"times": [times]}, "geometry": {"type": "Point", "coordinates": [1, 2]}}
    found = [formats.read_geojson(json.dumps(x).encode())["tracks"][0] for x in (one, two)]
    assert [p["time"] and p["time"].minute for p in found[0]["segments"][0]["points"]] == [30, 31, None]
    assert found[1]["segments"][0]["points"][0]["time"].minute == 30
    line = {"type": "Feature", "properties": {"name": "n", "description": "d"}, "geometry": {"type": "LineString", "coordinates": [[1, 2], [3, 4]]}}
    assert [formats.read_geojson(json.dumps(line).encode())["tracks"][0][k] for k in ("name", "description")] == ["n", None]


def test_tracks_and_speeds_of_activities():
    point = "<Trackpoint><Position><LatitudeDegrees>1</LatitudeDegrees><LongitudeDegrees>2</LongitudeDegrees></Position>{}</Trackpoint>"
    speed = "<Speed>9</Speed><Extensions><n:TPX xmlns:n='u'><n:Speed>3.5</n:Speed></n:TPX></Extensions>"
    xml = f"<TrainingCenterDatabase><Activities><Activity><Id>no time</Id><Track>{point.format(speed)}</Track><Lap><Track>{point.format('<Speed>9</Speed>')}</Track></Lap><Creator><Name>A</Name></Creator></Activity><Activity><Id>2026-07-11T11:30:00Z</Id><Creator><Name>B</Name></Creator></Activity></Activities><Author><Name>C</Name></Author></TrainingCenterDatabase>"
    trace = formats.read_tcx(xml.encode())
    assert [[p["speed"] for p in s["points"]] for s in trace["tracks"][0]["segments"]] == [[3.5], [None]]
    assert (trace["metadata"]["source_device"], trace["metadata"]["created"]) == ("B", None)


@pytest.mark.parametrize(("f", "text", "value"), [(X.parse_distance, "2.5 km", 2500), (X.parse_distance, "10", 10), (X.parse_distance, "1e1ft", 3.048), (X.parse_duration, "2min", 120), (X.parse_duration, "1500ms", 1.5), (X.parse_speed, "36 km/h", 10)])
def test_units(f, text, value):
    assert f(text) == pytest.approx(value)


@pytest.mark.parametrize(("f", "text"), [(X.parse_distance, "-1"), (X.parse_distance, "3 parsec"), (X.parse_duration, "3m"), (X.parse_speed, "fast"), (X.parse_geofence, "95,0,1"), (X.parse_bbox, "1,1,1,2"), (X.parse_color, "#12")])
def test_units_that_are_refused(f, text):
    with pytest.raises(ValueError):
        f(text)


def test_names_and_places():
    assert X.parse_geofence("47.6,-122.3,0.2km") == (47.6, -122.3, 200.0)
    assert X.parse_color("#0f8") == (0, 255, 136, 255)
    assert X.imperial_locale({"LANG": "en_US.UTF-8"}) and not X.imperial_locale({"LC_ALL": "de_DE", "LANG": "en_US"})
    assert X.status_line(["one", "two", "three"], 9) == "one  two"


@pytest.mark.parametrize("alpha", [True, False])
def test_png_round_trip(alpha):
    image = np.random.default_rng(1).integers(0, 256, (7, 5, 4)).astype(np.uint8)
    image[..., 3] = image[..., 3] if alpha else 255
    again, has = png.decode(png.encode(image, alpha))
    assert has == alpha and (again == image).all()


def test_masks_by_cells_and_by_tiles_agree(spark):
    lines = spark.createDataFrame([(20.0, 30.0, 100.0, 60.0), (100.0, 60.0, 60.0, 5.0), (-30.0, 80.0, -10.0, 85.0)], "x0 double, y0 double, x1 double, y1 double")
    a = R.mask(R.coverage(lines, 120, 90, 15.0, 5.0), 120, 90)
    b = R.mask(R.revealed(lines, 120, 90, 20.0, 5.0), 120, 90)
    assert abs(a - b).max() < 0.01
    assert a.max() == 1


def test_drawing(spark):
    blank = np.full((60, 80, 4), 200, np.uint8)
    blank[..., 3] = 255
    image, points = png.encode(blank, False), north(spark)
    box = (-122.31, 47.59, -122.29, 47.63)
    drawn, _ = png.decode(R.rendered(points, image, box))
    assert (drawn != blank).any() and tuple(drawn[0, 0]) == (200, 200, 200, 255)
    fog, _ = png.decode(R.rendered(points, image, box, fog=True, reveal_m=300.0))
    assert tuple(fog[0, 0][:3]) == (70, 70, 70) and fog[..., 0].max() == 200
    with pytest.raises(R.RenderError, match="outside"):
        R.rendered(points, image, (0, 0, 1, 1))
    with pytest.raises(R.RenderError):
        R.rendered(points, b"no image", box)
    assert R.Basemap(100, 100, 0, 0, 1, 1).aspect_skew == pytest.approx(1, abs=1e-3)


def test_streams_give_what_batches_give(spark, tmp_path):
    from waymill.operators import cleaning as K

    rows = [(0, 47.6 + (0.05 if i in (4, 5, 9) else 0) + i * 1e-5, -122.3, 1.0, i * 10 + (500 if i > 6 else 0)) for i in range(12)]
    p = trace(spark, rows).select("trace_id", "time", "lat", "lon", "ele", F.lit("s").alias("source"))
    p.coalesce(1).write.parquet(f"{tmp_path}/in")
    late = spark.createDataFrame([("z", T0 + timedelta(days=9), 0.0, 0.0, 0.0, "s")], p.schema)
    late.coalesce(1).write.parquet(f"{tmp_path}/late")

    def run(make, mode="append"):
        source = spark.readStream.schema(p.schema).parquet(f"{tmp_path}/[il]*")
        q = make(source).writeStream.format("memory").queryName("out").outputMode(mode).option("checkpointLocation", f"{tmp_path}/c{np.random.randint(10**9)}").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table("out").filter("trace_id = 'a'").collect()

    kept = K.drift_filtered(trace(spark, rows))
    assert sorted(r.time for r in run(stream.drift_filtered)) == sorted(r.time for r in kept.select("time").collect())
    sessions = run(stream.gap_sessions)
    batch = K.split_on_gaps(trace(spark, rows)).groupBy("seg_idx").count().collect()
    assert sorted(r.points for r in sessions) == sorted(r["count"] for r in batch)
    assert len(run(stream.deduplicated)) == 12
    assert isinstance(T0, datetime) and P.TRACE == ["trace_id"]
