import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymill.functions import geo
from waymill.operators import activities as A
from waymill.operators import cleaning as K
from waymill.operators import measures as M
from waymill.operators import merging as G
from waymill.operators import points as P

T0 = datetime(2024, 5, 1, 15)


def trace(spark, rows, trace_id="a"):
    """rows: (seg, lat, lon, ele, seconds or None)."""
    at, out = {}, []
    for seg, lat, lon, ele, s in rows:
        at[seg] = at.get(seg, -1) + 1
        out.append((trace_id, 0, seg, at[seg], lat, lon, ele, None if s is None else T0 + timedelta(seconds=s)))
    return P.complete(spark.createDataFrame(out, "trace_id string, track_idx int, seg_idx int, pt_idx long, lat double, lon double, ele double, time timestamp"))


def north(spark, n=20, seconds=10):
    return trace(spark, [(0, 47.6 + i * 0.001, -122.3, float(i % 5), i * seconds) for i in range(n)])


KNOWN = [((40.6413, -73.7781, 51.4700, -0.4543), 5554908.79, 0.01), ((0, 0, 1, 0), 110574.3886, 1e-3), ((0, 0, 0, 1), 111319.4908, 1e-3), ((1, 2, 1, 2), 0, 1e-9), ((0, 0, 0.5, 179.7), 19944127.421, 1), ((0, 0, 0, 180), 20003931.4586, 1), ((90, 0, -90, 0), 20003931.4586, 1e-3)]


@pytest.mark.parametrize(("ends", "metres", "off"), KNOWN)
def test_known_distances(ends, metres, off):
    assert float(geo.geodesic_numpy(*[[x] for x in ends])[0]) == pytest.approx(metres, abs=off)


def test_native_chain_equals_the_array_form(spark):
    rng = np.random.default_rng(1)
    rows = [tuple(map(float, (rng.uniform(-80, 80), rng.uniform(-170, 170), rng.uniform(-80, 80), rng.uniform(-170, 170)))) for _ in range(50)] + [(47.6, -122.3, 47.6001, -122.3001), (0.0, 10.0, 0.0, 11.0), (None, 1.0, 2.0, 3.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    both = geo.with_geodesic(geo.with_geodesic(df, "a", "b", "c", "d", "x"), "a", "b", "c", "d", "y", native=True).collect()
    for r in both:
        assert (r.x is None and r.y is None) or r.x == pytest.approx(r.y, abs=0.5 if r.x > 1.9e7 else 1e-3)


def test_coordinates_are_checked(spark):
    p = P.complete(spark.createDataFrame([("a", 0, 0, 0, 10.0, 190.0, float("nan"), 70000), ("a", 0, 0, 1, 10.0, 180.0, 5.0, 80)], "trace_id string, track_idx int, seg_idx int, pt_idx long, lat double, lon double, ele double, heart_rate int"))
    rows = P.checked(p).orderBy("pt_idx").collect()
    assert [(r.lon, r.ele, r.heart_rate) for r in rows] == [(-170.0, None, None), (180.0, 5.0, 80)]
    bad = p.withColumn("lat", F.lit(95.0))
    assert P.checked(bad, "drop").count() == 0
    assert {(r.lat, r.lon) for r in P.checked(bad, "zero").collect()} == {(0.0, 0.0)}
    with pytest.raises(Exception, match="invalid coordinate"):
        P.checked(bad).collect()


def test_nothing_is_summed_across_segments(spark):
    p = trace(spark, [(0, 0.0, 0.0, 100.0, 0), (0, 1.0, 0.0, 150.0, 10), (1, 5.0, 0.0, 900.0, 20), (1, 6.0, 0.0, None, 30)])
    s = M.summary(p).first()
    one = float(geo.geodesic_numpy([0], [0], [1], [0])[0]) + float(geo.geodesic_numpy([5], [0], [6], [0])[0])
    assert (s.tracks, s.segments, s.points, s.duration_s, s.gain_m, s.loss_m) == (1, 2, 4, 30, 50.0, 0.0)
    assert s.distance_m == pytest.approx(one)
    assert s.avg_speed_mps == pytest.approx(one / 30)


@pytest.mark.parametrize(("elevations", "threshold", "gain", "loss"), [([100, 150, 120, 170], 3, 100, 30), ([100, 102, 100, 103], 3, 0, 0), ([0, 4, 8, 1], 1000, 0, 0), ([5, None, 10], 3, 5, 0)])
def test_climb_has_hysteresis(spark, elevations, threshold, gain, loss):
    p = trace(spark, [(0, 0.0, 0.0, None if e is None else float(e), i) for i, e in enumerate(elevations)])
    r = M.climbs(p, float(threshold)).first()
    assert (r.gain_m, r.loss_m) == (gain, loss)


def test_absent_is_not_zero(spark):
    s = M.summary(trace(spark, [(0, 1.0, 2.0, None, None)])).first()
    assert (s.gain_m, s.start_time, s.duration_s, s.avg_speed_mps, s.distance_m) == (None, None, None, None, 0.0)


@pytest.mark.parametrize(("seconds", "median"), [([0, 1, 3, 6, 10], 3000), ([0, 5], 5000), ([0, 0], None), ([0], None), ([10, 0, None, 4], 10000)])
def test_upper_median_of_recorded_gaps(spark, seconds, median):
    assert M.median_intervals(trace(spark, [(0, 0.0, 0.0, None, s) for s in seconds])).first().median_ms == median


def plain_drift(rows, limit, consecutive=False):
    """(lat, lon, seconds) of one segment; kept places."""
    anchor, n, kept = None, 0, []
    for i, (lat, lon, s) in enumerate(rows):
        if anchor is None:
            good = True
        else:
            ms = None if s is None or anchor[2] is None else abs(s - anchor[2])
            good = not ms or float(geo.geodesic_numpy([anchor[0]], [anchor[1]], [lat], [lon])[0]) / ms <= limit
        if good or n >= 3:
            n = n if good and not consecutive else 0
            anchor = (lat, lon, s)
            kept.append(i)
        else:
            n += 1
    return kept


@pytest.mark.parametrize("consecutive", [False, True])
def test_drift_equals_a_plain_fold(spark, consecutive):
    rng = np.random.default_rng(3)
    segments, rows = [], []
    for seg in range(12):
        own = [(47.6 + float(rng.choice([0, 0.0001, 0.02])), -122.3, None if rng.random() < 0.1 else int(i * rng.integers(1, 3))) for i in range(25)]
        segments.append(plain_drift(own, 10.0, consecutive))
        rows += [(seg, lat, lon, None, s) for lat, lon, s in own]
    got = K.drift_verdicts(trace(spark, rows), 10.0, consecutive).filter("kept").collect()
    for seg, kept in enumerate(segments):
        assert sorted(r.pt_idx for r in got if r.seg_idx == seg) == kept


def test_fences_split_and_ends_go(spark):
    p = north(spark)
    out = K.redacted(p, [(47.61, -122.3, 150.0)])
    assert M.counts(out).first()[1:] == (1, 2, 17)
    assert K.inside(out, [(47.61, -122.3, 150.0)]).filter("inside").count() == 0
    assert M.counts(K.trimmed(p, 250.0)).first()[1:] == (1, 1, 14)
    assert M.counts(K.trimmed(p, 0.0)).first()[1:] == (1, 1, 18)
    assert K.redacted(p, []).count() == 20
    report = K.clean_report(p, max_mps=60.0, fences=[(47.61, -122.3, 150.0)], trim_m=250.0).first()
    assert (report.points_in, report.drift_removed, report.redacted, report.trimmed, report.points_out) == (20, 0, 3, 6, 11)


def test_gaps_are_strict_and_undated_points_stay(spark):
    p = trace(spark, [(0, 0.0, 0.0, None, s) for s in (0, 120, None, 241, 100, 300)])
    rows = K.split_on_gaps(p).orderBy("seg_idx", "pt_idx").collect()
    assert [r.seg_idx for r in rows] == [0, 0, 0, 1, 1, 2]


def journey(spark, *inputs):
    out = None
    for i, rows in enumerate(inputs):
        p = trace(spark, rows).withColumn("input_idx", F.lit(i)).withColumn("group_id", F.lit("g"))
        out = p if out is None else out.unionByName(p)
    return out


def line(n, shift=0.0, off=0, start=0):
    return [(0, 47.6 + (start + i) * 1e-4 + shift, -122.3, None, (start + i) * 10 + off) for i in range(n)]


def test_two_devices_are_one_journey(spark):
    out, report = G.merged(journey(spark, line(10), line(12, 1e-5, 2)))
    r = report.first()
    assert (r["mode"], r["inputs"], r["points_in"], r["points_out"], r["matched"], r["window_s"]) == ("reconciled", 2, 22, 12, 10, 5.0)
    assert out.agg(F.sum("matches")).first()[0] == 10


def test_merging_a_trace_with_itself_changes_nothing(spark):
    out, report = G.merged(journey(spark, line(8), line(8)))
    assert (out.count(), report.first()["matched"]) == (8, 8)


def test_without_overlap_or_dedup_inputs_follow(spark):
    _, report = G.merged(journey(spark, line(5, start=1000), line(5)))
    assert report.first()["mode"] == "concatenated"
    out, report = G.merged(journey(spark, line(5, off=3), line(5)), dedup=False)
    assert (report.first()["mode"], out.count(), M.counts(out).first().tracks) == ("concatenated", 10, 2)
    out, report = G.merged(journey(spark, line(5)))
    assert (report.first()["mode"], out.count()) == ("single", 5)


def test_a_point_absorbs_one_of_each_device(spark):
    _, report = G.merged(journey(spark, [(0, 47.6, -122.3, None, 0), (0, 47.6001, -122.3, None, 60)], [(0, 47.6, -122.3, None, 1), (0, 47.6, -122.3, None, 2)], [(0, 47.6, -122.3, 5.0, 1)]))
    r = report.first()
    assert (r["points_in"], r["matched"], r["points_out"]) == (5, 2, 3)


@pytest.mark.parametrize(("a", "b", "us"), [(None, None, 1_000_000), (None, 4000, 2_000_000), (100, 300, 1_000_000), (90_000, 1, 30_000_000), (3001, 2, 1_500_500)])
def test_match_windows(spark, a, b, us):
    row = spark.createDataFrame([(a, b)], "a long, b long").select(G.match_window_us(F.col("a"), F.col("b")).alias("w")).first()
    assert row.w == G.window_us(a, b) == us


def logs_and_fixes(spark):
    d = datetime
    logs = spark.createDataFrame([(1, "Walk", 1, d(2026, 7, 11, 11, 30), 600000, True), (2, "Walk", 1, d(2026, 7, 12, 8), 900000, False), (3, "Outdoor Bike", 2, d(2026, 7, 11, 23, 55), 600000, True), (4, "Swim", 3, d(2026, 7, 20, 9), 1800000, True)], "log_id long, name string, type_id long, start timestamp_ntz, duration_ms long, has_gps boolean")
    at = [("11", 11, 30, 0, "Phone"), ("11", 11, 31, 0, "Phone"), ("11", 11, 31, 30, "Watch"), ("11", 11, 38, 0, "Phone"), ("11", 11, 40, 0, "Phone"), ("11", 23, 56, 0, "Phone"), ("12", 0, 1, 0, "Phone"), ("12", 8, 1, 0, "Phone")]
    rows = [(d(2026, 7, int(day)).date(), i, d(2026, 7, int(day), h, m, s), 47.0 + i * 1e-4, -122.0, None, source) for i, (day, h, m, s, source) in enumerate(at)]
    return logs, spark.createDataFrame(rows, "day date, row long, time timestamp, lat double, lon double, ele double, source string")


def test_activities_join_their_days(spark):
    logs, fixes = logs_and_fixes(spark)
    points = A.extracted(A.selected(logs), fixes).select("log_id", "seg_idx", "source").collect()
    assert sorted((r.log_id, r.seg_idx) for r in points) == [(1, 0), (1, 0), (1, 1), (3, 0), (3, 1)]
    assert {r.source for r in points} == {"Phone"}
    assert A.extracted(A.selected(logs, ["WALK"]), fixes, source="watch").count() == 1
    windowed = A.windows(A.selected(logs))
    assert [(r.log_id, str(r.day)) for r in A.missing_days(windowed, fixes).collect()] == [(4, "2026-07-20")]
    assert A.empty_windows(windowed, fixes).count() == 0
    assert [tuple(r) for r in A.activity_types(logs).orderBy("place").collect()] == [("Walk", 1, 1, 1), ("Outdoor Bike", 1, 0, 2), ("Swim", 1, 0, 3)]
    wanted = spark.createDataFrame([("outdoor-bike",), ("Row",)], "wanted string")
    assert [r.wanted for r in A.unmatched(logs, wanted).collect()] == ["Row"]
    with pytest.raises(ValueError, match="no recordings from tablet"):
        A.check_source(A.joined(windowed, fixes), "tablet")


def many_logs_and_fixes(spark, odd, n=60, m=500):
    """Logs and fixes over five days, crowded at full minutes; odd: fixes in files of other days, ids that two logs have, ends before starts."""
    rng, d = random.Random(5), datetime(2026, 7, 10)
    logs = [(i // 2 if odd and i > n - 8 else i, f"Kind {i % 3}", 1, d + timedelta(minutes=rng.randrange(-600, 7000)), 60000 * rng.choice([0, 1, 30, 600, 1440, 4000, *([-90] * odd)]), True) for i in range(n)]
    fixes = []
    for i in range(m):
        at = d + timedelta(minutes=rng.randrange(7200)) if i % 3 else d + timedelta(minutes=rng.randrange(40))
        day = at.date() + timedelta(days=rng.choice([-1, 1]) if odd and i % 40 == 0 else 0)
        fixes.append((day, i, at, 47.0, -122.0, None, rng.choice(["Phone", "Watch", "Band"] + [None] * odd)))
    return (
        spark.createDataFrame(logs, "log_id long, name string, type_id long, start timestamp_ntz, duration_ms long, has_gps boolean"),
        spark.createDataFrame(fixes, "day date, row long, time timestamp, lat double, lon double, ele double, source string"), logs, fixes,
    )


def plain_join(logs, fixes):
    """(log_id, fix) of every pair."""
    for log_id, _, _, start, ms, _ in logs:
        end = start + timedelta(milliseconds=ms)
        for f in fixes:
            if start <= f[2] < end and start.date() <= f[0] <= end.date():
                yield log_id, f


@pytest.mark.parametrize("odd", [0, 1])
def test_activities_as_by_hand(spark, odd):
    logs, fixes, own_logs, own_fixes = many_logs_and_fixes(spark, odd)
    windowed, pairs = A.windows(A.selected(logs)), list(plain_join(own_logs, own_fixes))
    assert sorted((r.log_id, r.row) for r in A.joined(windowed, fixes).collect()) == sorted((i, f[1]) for i, f in pairs)
    for wanted in (None, "watch"):
        held = {}
        for i, f in pairs:
            held.setdefault((i, f[6]), []).append((f[0], f[2], f[1]))
        best = {i: max((k for k in held if k[0] == i), key=lambda k: (-1 if wanted and k[1] is None else k[1] is not None and k[1].lower() == wanted, len(held[k]), min(held[k])))[1] for i, _ in held}
        got = A.choose_sources(windowed, fixes, wanted).collect()
        assert sorted((r.log_id, r.source or "", r.fixes, r.chosen, r.first_seen.row) for r in got) == sorted((i, s or "", len(x), best[i] == s, min(x)[2]) for (i, s), x in held.items())
        want = []
        for i, s in best.items():
            seg = pt = 0
            run = sorted((f[2], f[0], f[1]) for j, f in pairs if j == i and s is not None and f[6] == s)
            for k, x in enumerate(run):
                if k and (x[0] - run[k - 1][0]).total_seconds() > 3600:
                    seg, pt = seg + 1, 0
                want.append((i, x[2], seg, pt))
                pt += 1
        got = A.extracted(A.selected(logs), fixes, source=wanted, gap_s=3600).collect()
        assert sorted((r.log_id, r.row, r.seg_idx, r.pt_idx) for r in got) == sorted(want)
        titles = {(str(r[0]), f"{r[1]} {r[3].date()}", f"Fitbit log {r[0]}") for r in own_logs}
        assert {(r.trace_id, r.track_name, r.description) for r in got} <= titles


def most(df, metric):
    """The most that any node of the plan of df, which has run, says of a metric."""
    found, left = [0], [df._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        kind = node.getClass().getSimpleName()
        left += [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("QueryStageExec") else []
        left += [node.children().apply(i) for i in range(node.children().size())]
        if metric == "rows" and "Join" in kind or metric != "rows" and "Exchange" in kind:
            said = node.metrics().get("numOutputRows" if metric == "rows" else "shuffleRecordsWritten")
            found += [said.get().value()] if said.isDefined() else []
    return max(found)


def crowded(spark):
    """400 logs over a day with 800 fixes: 320,000 pairs."""
    start = F.lit("2026-07-11 00:00:00").cast("timestamp_ntz")
    logs = spark.range(400).select(F.col("id").alias("log_id"), F.lit("Walk").alias("name"), start.alias("start"), F.lit(86_400_000).cast("long").alias("duration_ms"), F.lit(True).alias("has_gps"))
    at = F.timestamp_seconds(F.unix_seconds(F.lit("2026-07-11 00:00:00").cast("timestamp")) + F.col("id") * 100)
    return logs, spark.range(800).select(F.lit("2026-07-11").cast("date").alias("day"), F.col("id").alias("row"), at.alias("time"), F.lit("Watch").alias("source"))


def test_devices_are_chosen_without_pairs(spark):
    logs, fixes = crowded(spark)
    chosen = A.choose_sources(A.windows(logs), fixes)
    assert {(r.fixes, r.first_seen.row, r.chosen) for r in chosen.collect()} == {(800, 0, True)}
    assert 0 < most(chosen, "rows") < 4000


@pytest.mark.parametrize("odd", [0, 1])
def test_fixes_join_in_blocks(spark, odd, monkeypatch):
    monkeypatch.setattr(A, "BLOCK", 7)
    logs, fixes, own_logs, own_fixes = many_logs_and_fixes(spark, odd)
    fixes = fixes.unionByName(fixes.limit(9).withColumn("day", F.lit(None).cast("date"))).unionByName(fixes.limit(9).withColumn("time", F.lit(None).cast("timestamp")))
    got = A.joined(A.windows(A.selected(logs)), fixes, ["row", "source"])
    assert got.columns[-3:] == ["t", "row", "source"]
    assert sorted((r.log_id, str(r.day), r.row, r.source or "") for r in got.collect()) == sorted((i, str(f[0]), f[1], f[6] or "") for i, f in plain_join(own_logs, own_fixes))


def test_pairs_of_logs_and_fixes_need_little_disk(spark, tmp_path):
    logs, fixes = crowded(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as on large tables
    try:
        pairs = A.joined(A.windows(logs), fixes)
        assert len(pairs.collect()) == 320_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert 0 < most(pairs, "exchanged") <= 400 * 5  # a row for each part of a day; for each hour before
    logs, fixes = spark.range(5).join(logs).withColumn("log_id", F.col("log_id") * 5 + F.col("id")), fixes.withColumn("row", F.col("row") * 1009 % 100_003)
    A.joined(A.windows(logs), fixes).select("log_id", "row").write.parquet(str(tmp_path / "pairs"))
    assert spark.read.parquet(str(tmp_path / "pairs")).distinct().count() == 1_600_000
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 0.3 * 1_600_000


def test_points_of_activities_are_not_exchanged(spark):
    logs, fixes = crowded(spark)
    points = A.extracted(logs, fixes)
    assert len(points.collect()) == 320_000
    assert 0 < most(points, "exchanged") < 40_000


def test_points_of_activities_need_little_disk(spark):
    logs, fixes = crowded(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as on large tables
    try:
        points = A.extracted(logs, fixes.withColumn("note", F.repeat(F.lit("x"), 1000)), keep=["row"])
        assert len(points.collect()) == 320_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "note" not in points.columns
    assert 0 < most(points, "exchanged") <= 400 * 5  # a row for each part of a day; for each hour before


@pytest.mark.parametrize("odd", [0, 1])
def test_points_of_activities_with_some_columns(spark, odd, monkeypatch):
    monkeypatch.setattr(A, "BLOCK", 7)
    logs, fixes, *_ = many_logs_and_fixes(spark, odd)
    whole, some = A.extracted(logs, fixes, gap_s=3600), A.extracted(logs, fixes, gap_s=3600, keep=["lat"])
    assert not {"row", "lon"} & set(some.columns)
    assert sorted(map(str, whole.select(*some.columns).collect())) == sorted(map(str, some.collect()))


def test_activities_of_more_than_a_year(spark):
    d = datetime(2024, 1, 1, 9)
    logs = spark.createDataFrame([(1, "Walk", 1, d, 400 * 86_400_000, True), (2, "Walk", 1, d, 366 * 86_400_000, True)], "log_id long, name string, type_id long, start timestamp_ntz, duration_ms long, has_gps boolean")
    at = [d + timedelta(days=n, hours=h) for n in (0, 10, 365, 366, 367) for h in (-1, 0, 14)]
    fixes = spark.createDataFrame([(t.date(), i, t, 47.0, "Phone") for i, t in enumerate(at)], "day date, row long, time timestamp, lat double, source string")
    held = sorted((r.log_id, r.row) for r in A.joined(A.windows(logs), fixes).collect())
    assert sorted((r.log_id, r.row) for r in A.extracted(logs, fixes).collect()) == held == [(1, i) for i in range(1, 12)] + [(2, i) for i in range(1, 10)]
    assert {(r.log_id, r.fixes) for r in A.choose_sources(A.windows(logs), fixes).collect()} == {(1, 11), (2, 9)}


def test_the_offset_is_measured(spark):
    logs, fixes = logs_and_fixes(spark)
    shifted = logs.withColumn("start", F.expr("start - interval 4 hours"))
    best = A.detect_offset(A.selected(shifted), fixes).first()
    assert best.offset_min == -240
    assert A.detect_offset(A.selected(logs), fixes.limit(0)).count() == 0
    assert A.extracted(A.selected(shifted), fixes, None).count() == A.extracted(A.selected(logs), fixes).count()


def test_mercator(spark):
    y = spark.range(1).select(geo.mercator_y(F.lit(0.0)).alias("a"), geo.mercator_y(F.lit(89.0)).alias("b"), geo.mercator_x(F.lit(-180.0)).alias("c")).first()
    assert (y.a, y.c) == (0.5, 0.0)
    assert y.b == pytest.approx(0.0, abs=1e-9)
    assert math.isclose(geo.MERCATOR_RADIUS, geo.WGS84_A)


def test_nested_and_flat_forms(spark):
    p = trace(spark, [(0, 1.0, 2.0, 3.0, 4), (0, 5.0, 6.0, None, None), (1, 7.0, 8.0, 9.0, 10)])
    again = P.flattened(P.nested(p))
    key = ["seg_idx", "pt_idx"]
    assert again.orderBy(*key).collect() == p.select(*again.columns).orderBy(*key).collect()
    assert M.nested_counts(P.nested(p)).first()[1:] == (1, 2, 3, False)
