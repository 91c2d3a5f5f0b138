"""The registered queries of the GPS operators, each beside the SQL that a second engine answers it with."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo, text
from ..operators import activities as A
from ..operators import cleaning as K
from ..operators import measures as M
from ..operators import merging as G
from ..operators import points as P
from ..operators import rendering as R
from ..sources import formats as S
from . import trace_view as V

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _round(*names: str, digits: int = 4):
    return [F.round(n, digits).alias(n) for n in names]


def _sround(*names: str, digits: int = 4) -> str:
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names)


CLIMB = """list_reduce(list_prepend(NULL, list_transform(list(ele ORDER BY pt_idx) FILTER (ele IS NOT NULL), lambda e: {'level': e, 'gain': 0::DOUBLE, 'loss': 0::DOUBLE})),
 lambda a, x: CASE WHEN a IS NULL THEN x WHEN abs(x.level - a.level) > 3.0::DOUBLE THEN
  {'level': x.level, 'gain': a.gain + greatest(x.level - a.level, 0::DOUBLE), 'loss': a.loss + greatest(a.level - x.level, 0::DOUBLE)} ELSE a END)"""

SUMMARY = f"""WITH {V.STEPS},
one AS (SELECT trace_id, seg_idx, count(*) AS n, sum(step_m) AS m, min(t) AS t0, max(t) AS t1, min(lat) AS a0, max(lat) AS a1, min(lon) AS o0, max(lon) AS o1, min(ele) AS e0, max(ele) AS e1, {CLIMB} AS c FROM steps GROUP BY ALL)
SELECT trace_id, 1 AS tracks, count(*) AS segments, sum(n)::BIGINT AS points, round(coalesce(sum(m), 0), 4) AS distance_m, (max(t1) - min(t0)) // 1000000 AS duration_s,
 CASE WHEN (max(t1) - min(t0)) // 1000000 > 0 THEN round(coalesce(sum(m), 0) / ((max(t1) - min(t0)) // 1000000), 8) END AS avg_speed_mps,
 round(sum(c.gain), 4) AS gain_m, round(sum(c.loss), 4) AS loss_m, min(e0) AS min_ele_m, max(e1) AS max_ele_m, min(o0) AS min_lon, min(a0) AS min_lat, max(o1) AS max_lon, max(a1) AS max_lat FROM one GROUP BY trace_id"""


@query(SUMMARY)
def trace_summary(spark, sf_dir):
    out = M.summary(V.points(spark, sf_dir))
    keep = ["min_ele_m", "max_ele_m", "min_lon", "min_lat", "max_lon", "max_lat"]
    return out.select("trace_id", F.col("tracks").cast("int").alias("tracks"), "segments", "points", *_round("distance_m"), "duration_s", F.round("avg_speed_mps", 8).alias("avg_speed_mps"), *_round("gain_m", "loss_m"), *keep)


@query(f"WITH {V.STEPS} SELECT trace_id, seg_idx, round(coalesce(sum(step_m), 0), 4) AS length_m FROM steps GROUP BY ALL")
def segment_length(spark, sf_dir):
    return M.segment_lengths(V.points(spark, sf_dir)).select("trace_id", "seg_idx", *_round("length_m"))


@query(f"WITH {V.STEPS} SELECT trace_id, round(coalesce(sum(step_m), 0), 4) AS length_m FROM steps GROUP BY ALL")
def trace_length(spark, sf_dir):
    return M.trace_lengths(V.points(spark, sf_dir)).select("trace_id", *_round("length_m"))


@query(f"WITH {V.FIX} SELECT trace_id, min(lat) AS min_lat, min(lon) AS min_lon, max(lat) AS max_lat, max(lon) AS max_lon FROM fix GROUP BY trace_id")
def trace_bounds(spark, sf_dir):
    return M.bounds(V.points(spark, sf_dir))


@query(f"WITH {V.FIX} SELECT trace_id, min(t) AS start_us, max(t) AS end_us FROM fix GROUP BY trace_id")
def trace_time_range(spark, sf_dir):
    return M.time_ranges(V.points(spark, sf_dir)).select("trace_id", F.unix_micros("start_time").alias("start_us"), F.unix_micros("end_time").alias("end_us"))


@query(f"WITH {V.PTS} SELECT trace_id, 1::BIGINT AS tracks, count(DISTINCT seg_idx) AS segments, count(*) AS points FROM pts GROUP BY trace_id")
def trace_counts(spark, sf_dir):
    return M.counts(V.points(spark, sf_dir))


@query(f"WITH {V.PTS}, one AS (SELECT trace_id, seg_idx, {CLIMB} AS c, min(ele) AS e0, max(ele) AS e1 FROM pts GROUP BY ALL) SELECT trace_id, round(sum(c.gain), 4) AS gain_m, round(sum(c.loss), 4) AS loss_m, min(e0) AS min_m, max(e1) AS max_m FROM one GROUP BY trace_id")
def elevation_hysteresis(spark, sf_dir):
    return M.climbs(V.points(spark, sf_dir)).select("trace_id", *_round("gain_m", "loss_m"), "min_m", "max_m")


@query(f"WITH {V.PTS} SELECT trace_id, seg_idx, count(*) AS points, min(t) AS start_us, max(t) AS end_us FROM pts GROUP BY ALL")
def gap_segments(spark, sf_dir):
    p = K.split_on_gaps(V.points(spark, sf_dir, gap_s=10**9), V.GAP_S)
    return p.groupBy("trace_id", "seg_idx").agg(F.count("*").alias("points"), F.unix_micros(F.min("time")).alias("start_us"), F.unix_micros(F.max("time")).alias("end_us"))


@query(f"""WITH {V.FIX}, g AS (SELECT trace_id, abs((t - lag(t) OVER (PARTITION BY trace_id ORDER BY ts, event_id)) // 1000) AS gap FROM fix), l AS (SELECT trace_id, list_sort(list(gap)) AS l FROM g WHERE gap > 0 GROUP BY trace_id)
SELECT trace_id, l[len(l) // 2 + 1]::BIGINT AS median_ms FROM (SELECT DISTINCT trace_id FROM fix) LEFT JOIN l USING (trace_id)""")
def median_interval(spark, sf_dir):
    return M.median_intervals(V.points(spark, sf_dir))


_SPEED = f"WITH {V.STEPS}, s AS (SELECT *, abs((t - lag(t) OVER w) // 1000) AS ms FROM steps WINDOW w AS (PARTITION BY trace_id, seg_idx ORDER BY pt_idx))"


@query(f"{_SPEED} SELECT event_id, round(step_m, 4) AS step_m, CASE WHEN ms > 0 THEN round(step_m / (ms / 1000.0::DOUBLE), 8) END AS implied_mps FROM s")
def implied_speed(spark, sf_dir):
    return M.implied_speeds(V.points(spark, sf_dir)).select("event_id", *_round("step_m"), F.round("implied_mps", 8).alias("implied_mps"))


@query(f"{_SPEED} SELECT event_id, coalesce(CASE WHEN ms > 0 THEN step_m / (ms / 1000.0::DOUBLE) END <= 0.05::DOUBLE, true) AS plausible FROM s")
def plausible_step(spark, sf_dir):
    out = M.implied_speeds(V.points(spark, sf_dir))
    return out.select("event_id", F.coalesce(F.col("implied_mps") <= 0.05, F.lit(True)).alias("plausible"))


def _drift_sql(max_mps: float) -> str:
    w = "WINDOW w AS (PARTITION BY trace_id, seg_idx ORDER BY pt_idx)"
    lags = ", ".join(f"lag({c}, {k}) OVER w AS {c}{k}" for k in range(1, 5) for c in ("lat", "lon", "t"))
    parts, table = [f"{V.PTS}, lagged AS (SELECT *, {lags} FROM pts {w})"], "lagged"
    for k in range(1, 5):
        parts.append(V.measured(table, f"m{k}", f"lat{k}", f"lon{k}", "lat", "lon", f"d{k}"))
        table = f"m{k}"
    flags = ", ".join(f"coalesce(CASE WHEN abs((t - t{k}) // 1000) > 0 THEN d{k} / (abs((t - t{k}) // 1000) / 1000.0::DOUBLE) END <= {max_mps}::DOUBLE, true)" for k in range(1, 5))
    parts.append(f"flagged AS (SELECT *, [{flags}] AS ok FROM {table})")
    good = "(a.place = 0 OR x.ok[a.back + 1])"
    parts.append(f"""folded AS (SELECT trace_id, seg_idx, list_reduce(list_prepend({{'place': 0, 'back': 0, 'n': 0, 'gone': []::BIGINT[], 'ok': []::BOOLEAN[], 'id': -1::BIGINT}},
 list({{'place': 0, 'back': 0, 'n': 0, 'gone': []::BIGINT[], 'ok': ok, 'id': event_id}} ORDER BY pt_idx)),
 lambda a, x: {{'place': a.place + 1, 'back': CASE WHEN {good} OR a.n >= 3 THEN 0 ELSE a.back + 1 END, 'n': CASE WHEN {good} THEN a.n WHEN a.n >= 3 THEN 0 ELSE a.n + 1 END,
  'gone': CASE WHEN {good} OR a.n >= 3 THEN a.gone ELSE list_append(a.gone, x.id) END, 'ok': a.ok, 'id': a.id}}).gone AS gone FROM flagged GROUP BY ALL)""")
    return ",\n".join(parts)


DRIFT_MPS = 0.05
_KEPT = f"WITH {_drift_sql(DRIFT_MPS)}, kept AS (SELECT p.* FROM pts p JOIN folded f USING (trace_id, seg_idx) WHERE NOT list_contains(f.gone, p.event_id))"


@query(f"{_KEPT} SELECT event_id, (dense_rank() OVER (PARTITION BY trace_id ORDER BY seg_idx) - 1)::INTEGER AS seg_idx, row_number() OVER (PARTITION BY trace_id, seg_idx ORDER BY pt_idx) - 1 AS pt_idx FROM kept")
def drift_filter(spark, sf_dir):
    return K.drift_filtered(V.points(spark, sf_dir), DRIFT_MPS).select("event_id", "seg_idx", "pt_idx")


FENCES = [(47.6, -122.3, 300.0), (47.605, -122.295, 250.0)]


def _split_sql(source: str, gone: str, name: str) -> str:
    return f"""{name}_r AS (SELECT *, sum(({gone})::INTEGER) OVER (PARTITION BY trace_id, seg_idx ORDER BY pt_idx ROWS UNBOUNDED PRECEDING) AS run FROM {source}),
{name}_d AS (SELECT * EXCLUDE (seg_idx, run, pt_idx), pt_idx AS old, (dense_rank() OVER (PARTITION BY trace_id ORDER BY seg_idx, run) - 1)::INTEGER AS seg_idx FROM {name}_r WHERE NOT ({gone})),
{name} AS (SELECT * EXCLUDE (old), row_number() OVER (PARTITION BY trace_id, seg_idx ORDER BY old) - 1 AS pt_idx FROM {name}_d)"""


def _fence_sql(source: str, name: str) -> str:
    parts, table = [], source
    for i, (lat, lon, _) in enumerate(FENCES):
        parts.append(V.measured(table, f"{name}_f{i}", str(lat), str(lon), "lat", "lon", f"{name}_d{i}"))
        table = f"{name}_f{i}"
    return ",\n".join([*parts, _split_sql(table, " OR ".join(f"{name}_d{i} <= {r}" for i, (_, _, r) in enumerate(FENCES)), name)])


def _trim_sql(source: str, radius: float, name: str) -> str:
    return f"""{name}_e AS (SELECT trace_id, first(lat ORDER BY seg_idx, pt_idx) AS alat, first(lon ORDER BY seg_idx, pt_idx) AS alon, last(lat ORDER BY seg_idx, pt_idx) AS zlat, last(lon ORDER BY seg_idx, pt_idx) AS zlon FROM {source} GROUP BY trace_id),
{name}_j AS (SELECT s.*, alat, alon, zlat, zlon FROM {source} s JOIN {name}_e USING (trace_id)),
{V.measured(f'{name}_j', f'{name}_a', 'alat', 'alon', 'lat', 'lon', f'{name}_d1')},
{V.measured(f'{name}_a', f'{name}_z', 'zlat', 'zlon', 'lat', 'lon', f'{name}_d2')},
{_split_sql(f'{name}_z', f'{name}_d1 <= {radius} OR {name}_d2 <= {radius}', name)}"""


_PLACES = "SELECT event_id, seg_idx, pt_idx FROM"


@query(f"WITH {V.PTS}, {_fence_sql('pts', 'out')} {_PLACES} out")
def redact_fences(spark, sf_dir):
    return K.redacted(V.points(spark, sf_dir), FENCES).select("event_id", "seg_idx", "pt_idx")


@query(f"WITH {V.PTS}, {_trim_sql('pts', 200.0, 'out')} {_PLACES} out")
def trim_ends(spark, sf_dir):
    return K.trimmed(V.points(spark, sf_dir), 200.0).select("event_id", "seg_idx", "pt_idx")


_CLEANED = f"{_KEPT}, drifted AS (SELECT * EXCLUDE (seg_idx), (dense_rank() OVER (PARTITION BY trace_id ORDER BY seg_idx) - 1)::INTEGER AS seg_idx FROM kept), {_fence_sql('drifted', 'fenced')}, {_trim_sql('fenced', 200.0, 'out')}"


@query(f"{_CLEANED} {_PLACES} out")
def clean_pipeline(spark, sf_dir):
    return K.cleaned(V.points(spark, sf_dir), max_mps=DRIFT_MPS, fences=FENCES, trim_m=200.0).select("event_id", "seg_idx", "pt_idx")


@query(f"""{_CLEANED}, n AS (SELECT trace_id, 0 AS s FROM pts UNION ALL SELECT trace_id, 1 FROM kept UNION ALL SELECT trace_id, 2 FROM fenced UNION ALL SELECT trace_id, 3 FROM out),
c AS (SELECT trace_id, count(*) FILTER (s = 0) AS a, count(*) FILTER (s = 1) AS b, count(*) FILTER (s = 2) AS f, count(*) FILTER (s = 3) AS o FROM n GROUP BY trace_id)
SELECT trace_id, a AS points_in, a - b AS drift_removed, b - f AS redacted, f - o AS trimmed, o AS points_out FROM c""")
def clean_report(spark, sf_dir):
    return K.clean_report(V.points(spark, sf_dir), max_mps=DRIFT_MPS, fences=FENCES, trim_m=200.0)


_SPANS = f"""{V.DEV}, gaps AS (SELECT group_id, input_idx, abs((t - lag(t) OVER (PARTITION BY group_id, input_idx ORDER BY ts, event_id)) // 1000) AS gap FROM dev),
meds AS (SELECT group_id, input_idx, list_sort(list(gap)) AS l FROM gaps WHERE gap > 0 GROUP BY ALL),
spans AS (SELECT * FROM (SELECT group_id, input_idx, min(t) AS s, max(t) AS e FROM dev GROUP BY ALL) LEFT JOIN (SELECT group_id, input_idx, l[len(l) // 2 + 1] AS med FROM meds) USING (group_id, input_idx)),
pairs AS (SELECT a.group_id, a.input_idx AS a_input_idx, b.input_idx AS b_input_idx, a.s AS s1, a.e AS e1, b.s AS s2, b.e AS e2,
 greatest(1000000, least(30000000, coalesce(greatest(a.med, b.med) * 500, 1000000)))::BIGINT AS window_us FROM spans a JOIN spans b ON a.group_id = b.group_id AND a.input_idx < b.input_idx)"""


@query(f"WITH {_SPANS} SELECT group_id, a_input_idx, b_input_idx, window_us FROM pairs")
def match_window(spark, sf_dir):
    return G.overlaps(G.intervals(V.devices(spark, sf_dir))).select("group_id", F.col("a_input_idx").cast("long").alias("a_input_idx"), F.col("b_input_idx").cast("long").alias("b_input_idx"), "window_us")


@query(f"WITH {_SPANS} SELECT group_id, a_input_idx, b_input_idx, s1 - window_us <= e2 AND s2 - window_us <= e1 AS overlap FROM pairs")
def overlap_pairs(spark, sf_dir):
    return G.overlaps(G.intervals(V.devices(spark, sf_dir))).select("group_id", F.col("a_input_idx").cast("long").alias("a_input_idx"), F.col("b_input_idx").cast("long").alias("b_input_idx"), "overlap")


#: Events are hours apart, so moments are matched within an hour and 2 km here.
MOMENT_S, MOMENT_M = 3600, 2000.0


@query(f"""WITH {V.DEV}, near AS (SELECT a.event_id AS a_event, b.event_id AS b_event, a.lat AS lat1, a.lon AS lon1, b.lat AS lat2, b.lon AS lon2, abs(a.t - b.t) AS apart_us
 FROM dev a JOIN dev b ON a.group_id = b.group_id AND a.input_idx = 0 AND b.input_idx = 1 AND abs(a.t - b.t) <= {MOMENT_S * 1_000_000}), {V.measured('near', 'm', 'lat1', 'lon1', 'lat2', 'lon2', 'apart_m')}
SELECT a_event, b_event, apart_us, round(apart_m, 4) AS apart_m FROM m WHERE apart_m <= {MOMENT_M}""")
def same_moment_candidates(spark, sf_dir):
    d = V.devices(spark, sf_dir).select("group_id", "input_idx", "event_id", "lat", "lon", "time")
    out = G.same_moments(d.filter("input_idx = 0"), d.filter("input_idx = 1"), MOMENT_S * 1_000_000, MOMENT_M)
    return out.select(F.col("a.event_id").alias("a_event"), F.col("b.event_id").alias("b_event"), "apart_us", *_round("apart_m"))


@query(f"""WITH {V.DEV} SELECT apart, round(apart / 1e6::DOUBLE * 60.0::DOUBLE + 15.0::DOUBLE, 6) AS radius_m FROM (SELECT DISTINCT abs(t - lag(t) OVER (PARTITION BY group_id ORDER BY ts, event_id)) AS apart FROM dev) WHERE apart IS NOT NULL""")
def coincidence_radius(spark, sf_dir):
    w = Window.partitionBy("trace_id").orderBy("wall", "event_id")
    gaps = V.fixes(spark, sf_dir).withColumn("x", F.lag("wall").over(w)).select(F.abs(F.expr("timestampdiff(MICROSECOND, wall, x)")).alias("apart"))
    return gaps.filter("apart is not null").distinct().select("apart", F.round(G.coincidence_radius_m(F.col("apart")), 6).alias("radius_m"))


@query()
def reconcile_merge(spark, sf_dir):
    return G.reconciled(V.devices(spark, sf_dir), window_s=MOMENT_S, radius_m=MOMENT_M, gap_s=V.GAP_S).select("trace_id", "seg_idx", "pt_idx", "lat", "lon", "ele", "heart_rate", "matches")


@query()
def merge_report(spark, sf_dir):
    return G.merged(V.devices(spark, sf_dir).cache(), window_s=MOMENT_S, radius_m=MOMENT_M, gap_s=V.GAP_S)[1]


@query(f"""WITH {V.DEV}, tracks AS (SELECT group_id, input_idx, row_number() OVER (PARTITION BY group_id ORDER BY min(t), input_idx) - 1 AS track_idx FROM dev GROUP BY group_id, input_idx)
SELECT event_id, track_idx::INTEGER AS track_idx, row_number() OVER (PARTITION BY group_id, input_idx ORDER BY ts, event_id) - 1 AS pt_idx FROM dev JOIN tracks USING (group_id, input_idx)""")
def concat_tracks(spark, sf_dir):
    return G.concatenated(V.devices(spark, sf_dir)).select("event_id", "track_idx", "pt_idx")


@query(f"""WITH {V.FIX}, n AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY ts, event_id) AS i FROM fix)
SELECT a.event_id, a.lat, a.lon, coalesce(CASE WHEN a.event_id % 3 > 0 THEN a.ele END, CASE WHEN b.event_id % 2 > 0 THEN b.ele END) AS ele, coalesce(CASE WHEN a.event_id % 2 > 0 THEN a.heart_rate END, b.heart_rate) AS heart_rate FROM n a JOIN n b ON a.trace_id = b.trace_id AND b.i = a.i + 1""")
def merge_extras(spark, sf_dir):
    w = Window.partitionBy("trace_id").orderBy("wall", "event_id")
    n = P.complete(V.fixes(spark, sf_dir).withColumn("i", F.row_number().over(w)).drop("wall"))
    a = n.withColumns({"ele": F.when(F.col("event_id") % 3 > 0, F.col("ele")), "heart_rate": F.when(F.col("event_id") % 2 > 0, F.col("heart_rate")), "j": F.col("i") + 1})
    b = n.withColumn("ele", F.when(F.col("event_id") % 2 > 0, F.col("ele"))).withColumn("j", F.col("i"))
    pairs = a.alias("a").join(b.alias("b"), (F.col("a.trace_id") == F.col("b.trace_id")) & (F.col("a.j") == F.col("b.j")))
    return pairs.select(F.col("a.event_id").alias("event_id"), *P.merged_extras("a", "b")).select("event_id", "lat", "lon", "ele", "heart_rate")


# Exercise logs: every signup, as long as its props say in minutes. Fixes: all other events, on their own days.
_LOGS = f"{V.FIX}, logs AS (SELECT event_id AS log_id, 'Type ' || trace_id::BIGINT % 7 AS name, ts AS start, heart_rate::BIGINT * 60000 * 30 AS duration_ms, event_id % 3 > 0 AS has_gps, t FROM fix WHERE source = 'signup'), other AS (SELECT *, ts::DATE AS day FROM fix WHERE source <> 'signup')"
_TOUCHED = "touched AS (SELECT *, unnest(generate_series(make_timestamp(s)::DATE, make_timestamp(e)::DATE, INTERVAL 1 DAY))::DATE AS day FROM (SELECT log_id, t AS s, t + duration_ms * 1000 AS e FROM logs WHERE has_gps))"


def _logs(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    f = V.fixes(spark, sf_dir)
    logs = f.filter("source = 'signup'").select(
        F.col("event_id").alias("log_id"), F.concat(F.lit("Type "), F.col("trace_id").cast("long") % 7).alias("name"), F.lit(None).cast("long").alias("type_id"),
        F.col("wall").alias("start"), (F.col("heart_rate").cast("long") * 60000 * 30).alias("duration_ms"), (F.col("event_id") % 3 > 0).alias("has_gps"),
    )
    other = f.filter("source <> 'signup'").withColumns({"day": F.col("wall").cast("date"), "row": F.col("event_id"), "time": F.col("wall")})
    return logs, other


@query(f"WITH {_LOGS}, c AS (SELECT name, count(*) FILTER (has_gps) AS with_gps, count(*) FILTER (NOT has_gps) AS without_gps FROM logs GROUP BY name) SELECT *, row_number() OVER (ORDER BY with_gps DESC, with_gps + without_gps DESC, name)::INTEGER AS place FROM c")
def activity_types(spark, sf_dir):
    return A.activity_types(_logs(spark, sf_dir)[0])


@query(f"WITH {_LOGS}, {_TOUCHED} SELECT log_id, event_id FROM touched JOIN other USING (day) WHERE other.t >= s AND other.t < e")
def activity_window_join(spark, sf_dir):
    logs, other = _logs(spark, sf_dir)
    return A.joined(A.windows(A.selected(logs)).select("log_id", "start_us", "end_us"), other, ["event_id"]).select("log_id", "event_id")


@query(f"""WITH {_LOGS}, {_TOUCHED}, f AS (SELECT log_id, source, day, other.t, event_id FROM touched JOIN other USING (day) WHERE other.t >= s AND other.t < e),
c AS (SELECT log_id, source, count(*) AS fixes, min((t, event_id)) AS seen FROM f GROUP BY ALL) SELECT log_id, source, fixes, row_number() OVER (PARTITION BY log_id ORDER BY fixes DESC, seen DESC) = 1 AS chosen FROM c""")
def choose_source(spark, sf_dir):
    logs, other = _logs(spark, sf_dir)
    return A.choose_sources(A.windows(A.selected(logs)), other).drop("first_seen")


@query(f"""WITH {_LOGS}, sel AS (SELECT *, row_number() OVER (ORDER BY start, log_id) - 1 AS i, count(*) OVER () AS n FROM logs WHERE has_gps), smp AS (SELECT * FROM sel WHERE n <= 8 OR i IN (SELECT k * n // 8 FROM range(8) r(k), (SELECT max(n) AS n FROM sel))),
days AS (SELECT start::DATE + d AS day FROM smp, unnest([-1, 0, 1]) u(d)), times AS (SELECT t FROM other JOIN days ON other.day = days.day::DATE),
hits AS (SELECT o AS offset_min, log_id, count(*) AS covered FROM smp, range(-720, 841, 15) r(o), times WHERE times.t >= smp.t - o * 60000000 AND times.t < smp.t - o * 60000000 + duration_ms * 1000 GROUP BY ALL)
SELECT offset_min::INTEGER AS offset_min, count(*) AS windows, sum(covered)::BIGINT AS covered FROM hits GROUP BY offset_min ORDER BY windows DESC, covered DESC, abs(offset_min), offset_min LIMIT 1""")
def detect_offset(spark, sf_dir):
    logs, other = _logs(spark, sf_dir)
    return A.detect_offset(A.selected(logs), other)


@query(f"WITH {_LOGS}, {_TOUCHED} SELECT log_id, day FROM touched WHERE day NOT IN (SELECT day FROM other)")
def missing_days(spark, sf_dir):
    logs, other = _logs(spark, sf_dir)
    return A.missing_days(A.windows(A.selected(logs)), other)


@query(f"WITH {_LOGS} SELECT p_type AS wanted FROM (SELECT DISTINCT p_type FROM part) WHERE regexp_replace(lower(p_type), '[\\s_-]', '', 'g') NOT IN (SELECT regexp_replace(lower(name), '[\\s_-]', '', 'g') FROM logs)")
def type_unmatched(spark, sf_dir):
    return A.unmatched(_logs(spark, sf_dir)[0], V.table(spark, sf_dir, "part").select(F.col("p_type").alias("wanted")).distinct())


@query(f"""WITH {_LOGS}, touched AS (SELECT *, unnest(generate_series(make_timestamp(s)::DATE, make_timestamp(e)::DATE, INTERVAL 1 DAY))::DATE AS day FROM (SELECT log_id, name, t AS s, t + duration_ms * 1000 AS e FROM logs WHERE has_gps)),
f AS (SELECT log_id, name, s, source, day, other.t, event_id FROM touched JOIN other USING (day) WHERE other.t >= s AND other.t < e),
c AS (SELECT log_id, source, row_number() OVER (PARTITION BY log_id ORDER BY count(*) DESC, min((t, event_id)) DESC) AS place FROM f GROUP BY log_id, source),
g AS (SELECT f.*, CASE WHEN t - lag(t) OVER (PARTITION BY log_id ORDER BY t, event_id) > {V.GAP_S * 1_000_000} THEN 1 ELSE 0 END AS new FROM f JOIN c USING (log_id, source) WHERE place = 1),
n AS (SELECT *, sum(new) OVER (PARTITION BY log_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)::INTEGER AS seg_idx FROM g)
SELECT log_id, name || ' ' || make_timestamp(s)::DATE::VARCHAR AS track_name, source, event_id, seg_idx, row_number() OVER (PARTITION BY log_id, seg_idx ORDER BY t, event_id) - 1 AS pt_idx FROM n""")
def extract_activities(spark, sf_dir):
    logs, other = _logs(spark, sf_dir)
    return A.extracted(A.selected(logs), other, gap_s=V.GAP_S, keep=["event_id"]).select("log_id", "track_name", "source", "event_id", "seg_idx", "pt_idx")


@query("SELECT p_partkey, regexp_replace(lower(p_name), '[\\s_-]', '', 'g') AS folded, CASE WHEN trim(regexp_replace(lower(p_name), '[^\\p{L}\\p{N}]+', '-', 'g'), '-') = '' THEN 'activity' ELSE trim(regexp_replace(lower(p_name), '[^\\p{L}\\p{N}]+', '-', 'g'), '-') END AS slug FROM part")
def fold_slug_names(spark, sf_dir):
    return V.table(spark, sf_dir, "part").select("p_partkey", text.folded(F.col("p_name")).alias("folded"), text.slug(F.col("p_name")).alias("slug"))


_UNITS = ("m", "km", "ft", "mi", "nmi", "yd", "cm", "parsec")


@query("""SELECT p_partkey, round(p_size * CASE p_partkey % 8 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 1000.0::DOUBLE WHEN 2 THEN 0.3048::DOUBLE WHEN 3 THEN 1609.344::DOUBLE WHEN 4 THEN 1852.0::DOUBLE WHEN 5 THEN 0.9144::DOUBLE WHEN 6 THEN 0.01::DOUBLE END, 6) AS metres FROM part""")
def unit_parse(spark, sf_dir):
    unit = F.element_at(F.array(*map(F.lit, _UNITS)), (F.col("p_partkey") % 8 + 1).cast("int"))
    return V.table(spark, sf_dir, "part").select("p_partkey", F.round(text.measured(F.concat_ws(" ", F.col("p_size").cast("string"), unit), text.METRES), 6).alias("metres"))


@query(f"""WITH {V.FIX} SELECT event_id, round((lon + 180) / 360, 12) AS x, round(0.5 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / (2 * pi()), 12) AS y FROM fix""")
def web_mercator(spark, sf_dir):
    return V.fixes(spark, sf_dir).select("event_id", F.round(geo.mercator_x(F.col("lon")), 12).alias("x"), F.round(geo.mercator_y(F.col("lat")), 12).alias("y"))


@query(f"""WITH {V.FIX}, b AS (SELECT trace_id, (min(lat) + max(lat)) / 2 AS lat0 FROM fix GROUP BY trace_id) SELECT event_id, round(lon * greatest(abs(cos(radians(lat0))), 0.01::DOUBLE), 9) AS x, lat AS y FROM fix JOIN b USING (trace_id)""")
def equirectangular(spark, sf_dir):
    f = V.fixes(spark, sf_dir)
    mid = M.bounds(f).select("trace_id", ((F.col("min_lat") + F.col("max_lat")) / 2).alias("lat0"))
    x, y = geo.equirectangular(F.col("lat"), F.col("lon"), F.col("lat0"))
    return f.join(mid, "trace_id").select("event_id", F.round(x, 9).alias("x"), y.alias("y"))


# The map image of the drawing queries: 64 x 48 pixels over the middle of the traces.
BASE = R.Basemap(64, 48, -122.31, 47.59, -122.29, 47.61)
_LEFT, _TOP, _WIDE, _HIGH = map(float, BASE.frame)
_PX = f"""SELECT *, ((lon + 180) / 360 - {_LEFT!r}::DOUBLE) / {_WIDE!r}::DOUBLE * 64 AS px, (0.5 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / (2 * pi()) - {_TOP!r}::DOUBLE) / {_HIGH!r}::DOUBLE * 48 AS py FROM"""


@query(f"WITH {V.FIX} SELECT event_id, round(px, 6) AS px, round(py, 6) AS py FROM ({_PX} fix)")
def pixel_coords(spark, sf_dir):
    return R.projected(V.fixes(spark, sf_dir), BASE).select("event_id", *_round("px", "py", digits=6))


@query(f"""WITH {V.PTS}, pix AS ({_PX} pts), l AS (SELECT lag(px) OVER w AS a, lag(py) OVER w AS b, px, py, lead(px) OVER w AS nx FROM pix WINDOW w AS (PARTITION BY trace_id, seg_idx ORDER BY pt_idx)),
st AS (SELECT coalesce(a, px) AS x0, coalesce(b, py) AS y0, px AS x1, py AS y1 FROM l WHERE a IS NOT NULL OR nx IS NULL), sq AS (SELECT *, x1 - x0 AS dx, y1 - y0 AS dy, (x1 - x0) ^ 2 + (y1 - y0) ^ 2 AS q FROM st),
cells AS (SELECT x, y, x0, y0, dx, dy, CASE WHEN q = 0 THEN 0 ELSE least(1, greatest(0, ((x + 0.5 - x0) * dx + (y + 0.5 - y0) * dy) / q)) END AS t FROM sq, range(64) u(x), range(48) v(y)),
d AS (SELECT x, y, min(sqrt((x + 0.5 - x0 - t * dx) ^ 2 + (y + 0.5 - y0 - t * dy) ^ 2)) AS d FROM cells GROUP BY x, y)
SELECT x::INTEGER AS x, y::INTEGER AS y, round(least(1, 2.0 - d), 6)::DOUBLE AS coverage FROM d WHERE d < 2.0""")
def coverage_mask(spark, sf_dir):
    p = R.projected(V.points(spark, sf_dir), BASE)
    return R.coverage(R.strokes(p), BASE.width, BASE.height, *R.stroke_shape(R.TRACK_WIDTH)).select("x", "y", *_round("coverage", digits=6))


@query()
def fog_render(spark, sf_dir):
    base = R.Basemap(800, 600, -122.31, 47.59, -122.29, 47.61)
    return R.fog_cover(R.projected(V.points(spark, sf_dir), base), base, 25.0).select("x", "y", *_round("coverage"))


_SNIFF = """CASE WHEN substr(c, 9, 4) = '.FIT' THEN 'fit' WHEN substr(h, 1, 1) IN ('{', '[') THEN 'geojson' WHEN starts_with(h, '<') THEN CASE WHEN contains(lower(h), '<gpx') THEN 'gpx' WHEN contains(lower(h), '<trainingcenterdatabase') THEN 'tcx' WHEN contains(lower(h), '<kml') THEN 'kml' END
 WHEN contains(f, ',') AND (contains(f, 'lat') OR contains(f, 'lon')) THEN 'csv' END"""


@query(f"""WITH c AS (SELECT page_id AS id, 'page' AS kind, html AS c FROM pages UNION ALL SELECT doc_id, 'document', text FROM documents UNION ALL SELECT event_id, 'event', props FROM events),
h AS (SELECT id, kind, c, ltrim(substr(c, 1, 4096), chr(65279) || ' ' || chr(9) || chr(13) || chr(10)) AS h FROM c), f AS (SELECT *, lower(string_split(h, chr(10))[1]) AS f FROM h) SELECT id, kind, {_SNIFF} AS format FROM f""")
def format_sniff(spark, sf_dir):
    parts = [V.table(spark, sf_dir, t).select(F.col(i).alias("id"), F.lit(k).alias("kind"), F.col(c).alias("c")) for t, i, k, c in (("pages", "page_id", "page", "html"), ("documents", "doc_id", "document", "text"), ("events", "event_id", "event", "props"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("id", "kind", S.sniffed(F.col("c")).alias("format"))


def _roundtrip(fmt: str) -> Query:
    def run(spark, sf_dir):
        traces = P.nested(V.points(spark, sf_dir))
        texts = S.written_traces(traces, fmt)
        again = texts.mapInArrow(_parsed(fmt), P.TRACES)
        return M.summary(P.flattened(again)).select("trace_id", "segments", "points", *_round("distance_m", digits=2), "duration_s")

    run.__name__ = f"{fmt}_roundtrip"
    return run


def _parsed(fmt: str):
    def make(batches):
        for batch in batches:
            found = [{"trace_id": i, **S.parse(c.encode(), None, fmt)[0]} for i, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pylist(found, schema=S.ARROW)

    return make


#: What a trace keeps of itself through a file: times lose their fractions in GPX only, and durations are whole seconds.
_AGAIN = f"""WITH {V.STEPS} SELECT trace_id, count(DISTINCT seg_idx) AS segments, count(*) AS points, round(coalesce(sum(step_m), 0), 2) AS distance_m, (max(t) - min(t)) // 1000000 AS duration_s FROM steps GROUP BY trace_id"""

_WHOLE = _AGAIN.replace("(max(t) - min(t)) // 1000000", "max(t) // 1000000 - min(t) // 1000000")

for _f in ("gpx", "tcx", "geojson", "csv"):
    query(_WHOLE if _f == "gpx" else _AGAIN)(_roundtrip(_f))


_FMT = """regexp_replace(regexp_replace(printf('%.9f', {0}), '0+$', ''), '\\.$', '')"""


@query(f"""WITH {V.FIX}, s AS (SELECT *, event_id * 7 AS s FROM fix) SELECT event_id, {_FMT.format('lat')} AS lat, {_FMT.format('lon')} AS lon,
 CASE WHEN s >= 3600 THEN (s // 3600) || ':' || printf('%02d:%02d', s % 3600 // 60, s % 60) ELSE (s // 60) || ':' || printf('%02d', s % 60) END AS clock FROM s""")
def shown_values(spark, sf_dir):
    return V.fixes(spark, sf_dir).select("event_id", text.coordinate(F.col("lat")).alias("lat"), text.coordinate(F.col("lon")).alias("lon"), text.clock(F.col("event_id") * 7).alias("clock"))
