"""Registered queries: ``name -> (spark builder, DuckDB oracle SQL or None)``.

Every query reads the given tables (``events`` through the sightings
adapter) and grows with them.  Network-only operators (closure, cut-eligible
arcs, arc enrichment) read a fixed dimension, so they are not registered as
queries of their own; they run inside the data queries below and are checked
separately in the tests (including against the original map's files).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadtrace.functions.time import calendar_parts, iso_weekday
from roadtrace.operators import features as feat
from roadtrace.operators import quality as q
from roadtrace.operators import segments as segm
from roadtrace.operators import trips as tr
from roadtrace.plans.oracle import ROUND, r, with_ctes
from roadtrace.plans.pipeline import TEST_CUT_MINUTES, Pipeline

SIGHTING_OUT = ["plate", "gate", "lane", "ts", "nationality"]


def rounded(df: DataFrame, digits: int = ROUND) -> DataFrame:
    """Round every double column (comparison precision; sums differ in the last bits)."""
    return df.select(*[F.round(F.col(f.name), digits).alias(f.name)
                       if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
                       for f in df.schema.fields])


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    ids: str          # SURVEY §2 operator ids covered


REGISTRY: dict[str, Query] = {}


def register(name: str, ids: str, sql: str | None):
    def deco(fn):
        REGISTRY[name] = Query(name, fn, sql, ids)
        return fn
    return deco


def _p(spark, sf_dir, policy="as_coded") -> Pipeline:
    return Pipeline(spark, sf_dir, policy=policy, cut_minutes=TEST_CUT_MINUTES,
                    materialize_stages=True)


# ======================================================== sources, cleaning
@register("ingest_sightings", "S1 O5 P1", with_ctes("SELECT * FROM sightings"))
def _ingest(spark, d):
    return _p(spark, d).raw


@register("valid_sightings", "P2", with_ctes("SELECT * FROM valid"))
def _valid(spark, d):
    return _p(spark, d).valid


@register("spatial_conflicts", "A1", with_ctes("SELECT * FROM conflicts"))
def _conflicts(spark, d):
    return _p(spark, d).conflicts


@register("top_conflicts", "O1", with_ctes(
    "SELECT * FROM conflicts ORDER BY plates DESC, gate, lane, ts LIMIT 10"))
def _top_conflicts(spark, d):
    return q.top_conflicts(_p(spark, d).conflicts)


@register("conflicts_by_month", "A10 F6", with_ctes(
    "SELECT strftime(ts, '%Y-%m') AS yearMonth, count(*) AS count FROM conflicts GROUP BY 1"))
def _conflicts_by_month(spark, d):
    return q.conflicts_by_month(_p(spark, d).conflicts)


@register("remove_conflicts", "J1 O6", with_ctes("SELECT * FROM clean"))
def _clean(spark, d):
    return _p(spark, d).clean


def _maintained(spark, d) -> str:
    """Folder of the views kept over an ingest of the sightings in three batches, the last one run twice."""
    from roadtrace.session import app_id, checkpoint_dir
    from roadtrace.streaming import conflicts, ingest
    key = (app_id(spark), d)
    if key not in _MAINTAINED:
        base = f"{checkpoint_dir(spark)}/maintained-{uuid.uuid4().hex}"
        raw = _p(spark, d).raw
        batch = F.pmod(F.xxhash64(*SIGHTING_OUT), F.lit(3))
        for i in (0, 1, 2, 2):
            ingest.append_new(raw.where(batch == i), i, f"{base}/table")
            conflicts.maintain(spark, i, f"{base}/table", f"{base}/views")
        _MAINTAINED[key] = f"{base}/views"
    return _MAINTAINED[key]


_MAINTAINED: dict[tuple, str] = {}


@register("maintained_conflicts", "A1 S1", with_ctes("SELECT * FROM conflicts"))
def _maintained_conflicts(spark, d):
    from roadtrace.streaming.conflicts import read_conflicts
    return read_conflicts(spark, _maintained(spark, d))


@register("maintained_clean", "J1 S1", with_ctes("SELECT * FROM clean"))
def _maintained_clean(spark, d):
    from roadtrace.streaming.conflicts import read_clean
    return read_clean(spark, _maintained(spark, d))


_MULTINAT_SQL = "SELECT plate, array_to_string(nats, ',') AS nats, num_nat FROM multinat"


@register("multinat_plates", "A2 F7", with_ctes(_MULTINAT_SQL))
def _multinat(spark, d):
    return _p(spark, d).multinat.withColumn("nats", F.array_join("nats", ","))


@register("top_multinat", "O2", with_ctes(
    _MULTINAT_SQL + " ORDER BY num_nat DESC, plate LIMIT 10"))
def _top_multinat(spark, d):
    return q.top_multinat(_p(spark, d).multinat).withColumn("nats", F.array_join("nats", ","))


@register("multinat_by_num", "A11", with_ctes(
    "SELECT num_nat, count(*) AS count FROM multinat GROUP BY num_nat"))
def _multinat_by_num(spark, d):
    return q.multinat_by_num(_p(spark, d).multinat)


@register("multinat_by_set", "A12", with_ctes(
    "SELECT array_to_string(nats, ',') AS nats, count(*) AS count FROM multinat GROUP BY 1"))
def _multinat_by_set(spark, d):
    return q.multinat_by_set(_p(spark, d).multinat)


@register("fixable_multinat", "P3", with_ctes("SELECT * FROM fixable"))
def _fixable(spark, d):
    return _p(spark, d).fixable


@register("fixable_count", "A15", with_ctes("SELECT count(*) AS fixable FROM fixable"))
def _fixable_count(spark, d):
    return q.fixable_count(_p(spark, d).multinat)


@register("fix_nationality", "J2 P4", with_ctes("SELECT * FROM fixed"))
def _fixed(spark, d):
    return _p(spark, d).fixed


@register("unknown_before_after", "A13 P13", with_ctes("""
SELECT 'before' AS stage, count(*) FILTER (WHERE nationality = '?') AS unknown, count(*) AS total FROM clean
UNION ALL
SELECT 'after', count(*) FILTER (WHERE nationality = '?'), count(*) FROM fixed"""))
def _unknown(spark, d):
    p = _p(spark, d)
    return q.unknown_before_after(p.clean, p.fixed)


@register("nationality_counts", "A3", with_ctes(
    "SELECT nationality, count(*) AS count FROM fixed GROUP BY nationality"))
def _nat_counts(spark, d):
    return q.nationality_counts(_p(spark, d).fixed)


# on the raw sightings: cleaning already removes rows without a nationality
_ANY_NULL = "plate IS NULL OR gate IS NULL OR lane IS NULL OR ts IS NULL OR nationality IS NULL"


@register("null_rows", "P6", with_ctes(f"SELECT * FROM sightings WHERE {_ANY_NULL}"))
def _null_rows(spark, d):
    return q.null_rows(_p(spark, d).raw)


@register("drop_null_rows", "P6", with_ctes(f"SELECT * FROM sightings WHERE NOT ({_ANY_NULL})"))
def _nonnull(spark, d):
    return q.drop_null_rows(_p(spark, d).raw)


@register("plate_day_counts", "A14 P12", with_ctes("""
SELECT plate, CAST(day(ts) AS INTEGER) AS day, count(*) AS count FROM fixed
WHERE month(ts) = 1 GROUP BY plate, day(ts) HAVING count(*) <= 50"""))
def _plate_day(spark, d):
    return q.plate_day_counts(_p(spark, d).fixed, month=1, max_count=50)


@register("plate_trace", "S8 O4", with_ctes("""
SELECT f.* FROM fixed f JOIN (
  SELECT plate FROM fixed GROUP BY plate ORDER BY count(*) DESC, plate LIMIT 1) b USING (plate)"""))
def _plate_trace(spark, d):
    fixed = _p(spark, d).fixed
    return q.plate_trace(fixed, q.busiest_plate(fixed))


# against a map without some of the gates that are read
@register("unmapped_gates", "A19", with_ctes(
    "SELECT DISTINCT gate FROM fixed ANTI JOIN (SELECT * FROM gates WHERE gateid % 9 <> 4) ON gate = gateid"))
def _unmapped(spark, d):
    p = _p(spark, d)
    return q.unmapped_gates(p.fixed, p.network.gates.filter("gateid % 9 <> 4"))


@register("stage_counts", "A17", with_ctes("""
SELECT 'raw' AS stage, count(*) AS rows, count(DISTINCT plate) AS plates FROM sightings
UNION ALL SELECT 'valid', count(*), count(DISTINCT plate) FROM valid
UNION ALL SELECT 'clean', count(*), count(DISTINCT plate) FROM clean
UNION ALL SELECT 'fixed', count(*), count(DISTINCT plate) FROM fixed
UNION ALL SELECT 'nonnull', count(*), count(DISTINCT plate) FROM nonnull"""))
def _stage_counts(spark, d):
    return _p(spark, d).quality_report()["stage_counts"]


# ============================================================== trips
_TRIP_OUT = "SELECT plate, gate, lane, ts, nationality, tripid, step FROM trips"

for _pol in tr.POLICIES:
    def _mk(pol):
        def build(spark, d):
            return _p(spark, d, pol).trips_for(pol).select(*SIGHTING_OUT, "tripid", "step")
        return build
    register(f"sessionize_{_pol}", "W3 W4 W5 W6 W7 J7 P7",
             with_ctes(_TRIP_OUT, policy=_pol))(_mk(_pol))


@register("streamed_trips", "W3 W4 W5 W7 S1", with_ctes(_TRIP_OUT, policy="as_coded"))
def _streamed_trips(spark, d):
    """Trips kept up to date over three batches of sightings that come in any order."""
    from roadtrace.session import checkpoint_dir
    from roadtrace.streaming import trips as st
    p = _p(spark, d)
    view = f"{checkpoint_dir(spark)}/streamed-trips-{uuid.uuid4().hex}"
    batch = F.pmod(F.xxhash64(*SIGHTING_OUT), F.lit(3))
    for i in range(3):
        st.maintain(spark, p.nonnull.where(batch == i), i, view, p.network.pairs, ("as_coded",), TEST_CUT_MINUTES)
    out = st.read_trips(spark, view, "as_coded", p.network.pairs, TEST_CUT_MINUTES, ("as_coded",))
    return out.select(*SIGHTING_OUT, "tripid", "step")


@register("segments", "W2 F10", with_ctes("SELECT * FROM segs", policy="as_coded"))
def _segments(spark, d):
    return _p(spark, d).segments


@register("trip_paths", "A16", with_ctes(
    "SELECT plate, tripid, step, gate, ts FROM trips", policy="gap"))
def _trip_paths(spark, d):
    return tr.trip_steps(_p(spark, d, "gap").trips_for("gap"))


@register("trip_arrays", "A16", with_ctes("""
SELECT plate, tripid, (step - 1) // 4 AS chunk, min(step) AS first_step, count(*) AS steps,
       string_agg(CAST(gate AS VARCHAR), ',' ORDER BY step) AS gates,
       string_agg(CAST(epoch_us(ts) // 1000000 AS VARCHAR), ',' ORDER BY step) AS instants
FROM trips GROUP BY plate, tripid, chunk""", policy="gap"))
def _trip_arrays(spark, d):
    """Arrays of four steps, so that trips of the test tables have several."""
    return tr.rendered_arrays(tr.trip_arrays(_p(spark, d, "gap").trips_for("gap"), chunk_steps=4))


@register("trip_array_segments", "A16 W2", with_ctes("SELECT * FROM segs", policy="gap"))
def _trip_array_segments(spark, d):
    return tr.array_segments(tr.trip_arrays(_p(spark, d, "gap").trips_for("gap"), chunk_steps=4))


@register("global_trips", "W7", with_ctes("""
SELECT plate, gate, lane, ts, nationality, tripid, step, t.trip FROM trips JOIN (
  SELECT plate, tripid, row_number() OVER (ORDER BY plate, tripid) AS trip
  FROM (SELECT DISTINCT plate, tripid FROM trips)) t USING (plate, tripid)""", policy="as_coded"))
def _global_trips(spark, d):
    return tr.global_trips(_p(spark, d).trips_for("as_coded")).select(*SIGHTING_OUT, "tripid", "step", "trip")


_ESEG_COLS = ("plate, tripid, gatefrom, gateto, tstart, tend, hasEntryExit, hasTollbooth, "
              "hasServiceArea, posfrom, posto, highwayidfrom, highwayidto")


@register("segment_enrich", "J4 J3 G1 G2 P10", with_ctes(
    f"SELECT {_ESEG_COLS} FROM eseg", policy="gap"))
def _segment_enrich(spark, d):
    p = _p(spark, d, "gap")
    from roadtrace.operators.network import join_arc_info
    return join_arc_info(tr.segments(p.trips_for("gap")), p.network.oriented)


@register("segment_metrics", "F9 F8", with_ctes(
    f"SELECT {_ESEG_COLS}, {r('segmentDist')}, {r('segmentDuration')}, {r('segmentSpeed')} FROM mseg",
    policy="gap"))
def _segment_metrics(spark, d):
    p = _p(spark, d, "gap")
    return rounded(segm.enriched_segments(tr.segments(p.trips_for("gap")), p.network.oriented))


@register("segment_duration", "F1 F3", with_ctes(
    "SELECT plate, tripid, tstart, tend, CAST(secs AS BIGINT) AS seconds "
    "FROM (SELECT *, trunc((epoch_us(tend) - epoch_us(tstart)) / 1000000) AS secs FROM segs)",
    policy="gap"))
def _segment_duration(spark, d):
    from roadtrace.functions.time import seconds_between
    seg = tr.segments(_p(spark, d, "gap").trips_for("gap"))
    return seg.select("plate", "tripid", "tstart", "tend",
                      seconds_between("tstart", "tend").alias("seconds"))


@register("arc_frequency", "A4 O3", with_ctes("""
SELECT s.gatefrom, s.gateto, s.count, e.hasEntryExit, e.hasTollbooth, e.hasServiceArea,
  CASE WHEN s.gatefrom = e.gatefrom AND s.gateto = e.gateto THEN e.pos_from ELSE e.pos_to END AS posfrom,
  CASE WHEN s.gatefrom = e.gatefrom AND s.gateto = e.gateto THEN e.pos_to ELSE e.pos_from END AS posto,
  CASE WHEN s.gatefrom = e.gatefrom AND s.gateto = e.gateto THEN e.highwayid_from ELSE e.highwayid_to END
    AS highwayidfrom,
  CASE WHEN s.gatefrom = e.gatefrom AND s.gateto = e.gateto THEN e.highwayid_to ELSE e.highwayid_from END
    AS highwayidto
FROM (SELECT gatefrom, gateto, count(*) AS count FROM segs GROUP BY gatefrom, gateto) s
LEFT JOIN enriched e
  ON (s.gatefrom = e.gatefrom AND s.gateto = e.gateto) OR (s.gateto = e.gatefrom AND s.gatefrom = e.gateto)
ORDER BY count DESC, gatefrom, gateto""", policy="gap"))
def _arc_frequency(spark, d):
    p = _p(spark, d, "gap")
    return segm.arc_frequency(tr.segments(p.trips_for("gap")), p.network.oriented)


@register("self_arcs", "A18", with_ctes(
    "SELECT gatefrom AS gate, count(*) AS count FROM segs WHERE gatefrom = gateto GROUP BY gatefrom",
    policy="gap"))
def _self_arcs(spark, d):
    return segm.self_arcs(tr.segments(_p(spark, d, "gap").trips_for("gap")))


# ============================================================ features
@register("trip_totals", "A5", with_ctes(f"""
SELECT plate, tripid, {r('sum(segmentDist)', 'tripDist')}, {r('sum(segmentDuration)', 'tripDuration')},
  {r('CASE WHEN sum(segmentDuration) = 0 THEN NULL ELSE sum(segmentDist) / sum(segmentDuration) END',
     'tripSpeed')}
FROM mseg GROUP BY plate, tripid""", policy="as_coded"))
def _trip_totals(spark, d):
    return rounded(feat.trip_totals(_p(spark, d).enriched))


@register("service_area_time", "A6 P9", with_ctes(f"""
SELECT plate, tripid, {r('sum(segmentDuration)', 'totTimeServiceArea')}
FROM mseg WHERE hasServiceArea GROUP BY plate, tripid""", policy="as_coded"))
def _sa_time(spark, d):
    return rounded(feat.service_area_time(_p(spark, d).enriched))


@register("trip_stats", "J5 A5 A6", with_ctes(f"""
SELECT plate, tripid, {r('tripDist')}, {r('tripDuration')}, {r('tripSpeed')}, {r('totTimeServiceArea')}
FROM tstats""", policy="as_coded"))
def _trip_stats(spark, d):
    return rounded(_p(spark, d).trip_stats)


_SUMMARY_COLS = [f"{a}{feat._cap(c)}" for c in feat.TRIP_SUMMARY_STATS for a in ("min", "max", "avg")]


@register("plate_trip_summary", "A8", with_ctes(
    "SELECT plate, " + ", ".join(r(c) for c in _SUMMARY_COLS) + ", numtrips FROM tsummary",
    policy="as_coded"))
def _trip_summary(spark, d):
    return rounded(_p(spark, d).trip_summary)


_GLOBAL_SELECT = """SELECT plate, nationality, num_gates, num_lanes, num_gatelane, num_months, num_days,
  num_hours, num_daysofweek, num_seen, CAST(mostFreqHour AS INTEGER) AS mostFreqHour,
  CAST(mostFreqDayOfWeek AS INTEGER) AS mostFreqDayOfWeek, mostFreqGate FROM global_features"""


@register("plate_global_features", "A7 F4 F5 F6 F7", with_ctes(_GLOBAL_SELECT, global_features=True))
def _global(spark, d):
    return _p(spark, d).global_features


@register("plate_features", "J6 A7 A8", with_ctes(
    "SELECT g.*, " + ", ".join(r(f"t.{c}", c) for c in _SUMMARY_COLS) + ", t.numtrips "
    f"FROM ({_GLOBAL_SELECT}) g JOIN tsummary t USING (plate)",
    policy="as_coded", global_features=True))
def _plate_features(spark, d):
    return rounded(_p(spark, d).plate_features)


@register("daily_plate_features", "A7 A8 J6 S5", with_ctes(
    "SELECT g.*, " + ", ".join(r(f"t.{c}", c) for c in _SUMMARY_COLS) + ", t.numtrips "
    f"FROM ({_GLOBAL_SELECT}) g JOIN tsummary t USING (plate)",
    policy="as_coded", global_features=True))
def _daily_plate_features(spark, d):
    """The plate features merged from one stored row per plate and day."""
    from roadtrace.operators import daily
    from roadtrace.session import checkpoint_dir
    p, base = _p(spark, d), f"{checkpoint_dir(spark)}/daily-{uuid.uuid4().hex}"
    sightings, trips = daily.plate_days(p.sequence), daily.plate_day_trips(p.enriched)
    daily.write_days(sightings, f"{base}/sightings")
    daily.write_days(trips, f"{base}/trips")
    sightings, trips = (daily.read_days(spark, f"{base}/{n}", schema=x.schema) for n, x in (("sightings", sightings), ("trips", trips)))
    return rounded(feat.plate_features(daily.merged_global_features(sightings), daily.merged_trip_summary(trips)))


@register("mode_values", "F5", with_ctes("""
SELECT plate, CAST(mostFreqHour AS INTEGER) AS mostFreqHour,
  CAST(mostFreqDayOfWeek AS INTEGER) AS mostFreqDayOfWeek, mostFreqGate FROM global_features""",
                                         global_features=True))
def _modes(spark, d):
    return _p(spark, d).global_features.select("plate", "mostFreqHour", "mostFreqDayOfWeek", "mostFreqGate")


@register("iso_weekday", "F4", with_ctes(
    "SELECT CAST(isodow(ts) AS INTEGER) AS dayofweek, count(*) AS count FROM nonnull GROUP BY 1"))
def _iso_weekday(spark, d):
    return (_p(spark, d).nonnull.groupBy(iso_weekday("ts").alias("dayofweek"))
            .agg(F.count(F.lit(1)).alias("count")))


@register("calendar_parts", "F6", with_ctes("""
SELECT CAST(month(ts) AS INTEGER) AS month, CAST(day(ts) AS INTEGER) AS day,
  CAST(hour(ts) AS INTEGER) AS hour, count(*) AS count FROM nonnull GROUP BY 1, 2, 3"""))
def _calendar(spark, d):
    parts = calendar_parts("ts")
    return (_p(spark, d).nonnull
            .groupBy(parts["month"].alias("month"), parts["day"].alias("day"), parts["hour"].alias("hour"))
            .agg(F.count(F.lit(1)).alias("count")))


_GAP_UNITS = {"day": 86400000000, "hour": 3600000000, "minute": 60000000, "second": 1000000}


@register("avg_gaps", "F2", with_ctes(
    "SELECT plate, " + ", ".join(
        r(f"coalesce(avg(trunc((epoch_us(ts) - epoch_us(pt)) / {us})), 0.0)", f"avg_{u}_gap")
        for u, us in _GAP_UNITS.items())
    + " FROM (SELECT plate, ts, lag(ts) OVER (PARTITION BY plate ORDER BY ts, gate, lane, nationality) AS pt"
      " FROM nonnull) GROUP BY plate"))
def _avg_gaps(spark, d):
    p = _p(spark, d)
    return rounded(feat.avg_gaps(p.nonnull, sequence=p.sequence))


@register("window_analysis", "W1", with_ctes(f"""
SELECT plate, {r('avg(hourly_gates)', 'avg_hourly_gates')}, {r('avg(min_avg_diff)', 'min_avg_diff')}
FROM (
  SELECT plate, w, count(DISTINCT gate) AS hourly_gates, coalesce(avg(gap), 0.0) AS min_avg_diff
  FROM (SELECT plate, gate, time_bucket(INTERVAL '1 hour', ts) AS w,
          trunc((epoch_us(ts) - epoch_us(lag(ts) OVER (
            PARTITION BY plate, time_bucket(INTERVAL '1 hour', ts) ORDER BY ts))) / 60000000) AS gap
        FROM nonnull)
  GROUP BY plate, w)
GROUP BY plate"""))
def _window_analysis(spark, d):
    p = _p(spark, d)
    return rounded(feat.window_analysis(p.nonnull, sequence=p.sequence))


# ============================================================ clustering
_GLOBAL_NUM = ["num_gates", "num_lanes", "num_gatelane", "num_months", "num_days", "num_hours",
               "num_daysofweek", "num_seen", "mostFreqHour", "mostFreqDayOfWeek", "mostFreqGate"]
_FEATURE_NUM = _GLOBAL_NUM + _SUMMARY_COLS + ["numtrips"]


def _scaled_sql(digits: int | None = ROUND) -> str:
    scaled = ("CASE WHEN coalesce(stddev_samp({c}) OVER (), 0) = 0 THEN 0.0 "
              "ELSE {c} / stddev_samp({c}) OVER () END")
    one = scaled if digits is None else f"round({scaled}, {digits})"
    cols = ", ".join(f"{one.format(c=c)} AS {c}" for c in _FEATURE_NUM)
    filled = ", ".join(f"coalesce(CAST({c} AS DOUBLE), 0.0) AS {c}" for c in _FEATURE_NUM)
    return (f"SELECT plate, nationality, {cols} FROM (SELECT plate, nationality, {filled} FROM ("
            f"{_GLOBAL_SELECT}) g JOIN tsummary t USING (plate))")


def _slots_sql(select: str, more: str = "") -> str:
    """``select`` over slots(plate, slot, value): one-hot nationality (by frequency, then name; the last
    dropped), then the scaled numeric columns in order."""
    values = ", ".join(_FEATURE_NUM)
    return f"""SELECT * FROM (WITH scaled AS ({_scaled_sql(None)}),
idx AS (SELECT nationality, row_number() OVER (ORDER BY count(*) DESC, nationality) - 1 AS i, count(*) OVER () AS n
        FROM scaled GROUP BY nationality),
slots AS (
  SELECT s.plate, CAST(i AS INTEGER) AS slot, CASE WHEN s.nationality = idx.nationality THEN 1.0 ELSE 0.0 END AS value
  FROM scaled s, idx WHERE i < n - 1
  UNION ALL
  SELECT plate, CAST((SELECT max(n) FROM idx) - 1 + j AS INTEGER), vs[j + 1]
  FROM (SELECT plate, [{values}] AS vs, unnest(range(0, {len(_FEATURE_NUM)})) AS j FROM scaled)){more}
{select})"""


@register("normalize_features", "M1 P11", with_ctes(_scaled_sql(), policy="as_coded", global_features=True))
def _normalize(spark, d):
    from roadtrace.operators import clustering as cl
    pf = _p(spark, d).plate_features
    num = cl.numeric_columns(pf, exclude=("plate",))
    return rounded(cl.normalize(cl.fill_undefined(pf, num), num))


def _vectors(spark, d):
    return _p(spark, d).vectorized


def _model_dir(spark) -> str:
    """S7 model store of this application: a sweep is fitted once and later queries load it."""
    from roadtrace.session import checkpoint_dir
    return f"{checkpoint_dir(spark)}/models"


@register("vectorize_features", "M2 F11", with_ctes(
    _slots_sql(f"SELECT plate, slot, round(value, {ROUND}) AS value FROM slots"), policy="as_coded",
    global_features=True))
def _vectorize(spark, d):
    from pyspark.ml.functions import vector_to_array
    return rounded(_vectors(spark, d).select("plate", F.posexplode(vector_to_array("features")).alias("slot", "value")))


_TRAINS = "CAST('0x' || substr(md5(plate || '-42'), 1, 8) AS BIGINT) % 100 < 70"


@register("training_split", "M3", with_ctes(
    f"SELECT plate, {_TRAINS} AS trains FROM tsummary", policy="as_coded"))
def _split(spark, d):
    from roadtrace.operators import clustering as cl
    return _vectors(spark, d).select("plate", cl.in_training().alias("trains"))


_CENTRES = 4


@register("wcss_of_centres", "M4", with_ctes(_slots_sql(f"""
SELECT round(coalesce(sum(best), 0), 3) AS wcss FROM (
  SELECT plate, min(cost) AS best FROM (
    SELECT a.plate, c.plate AS centre, sum((a.value - c.value) * (a.value - c.value)) AS cost
    FROM slots a JOIN slots c USING (slot) JOIN ranked k ON k.plate = c.plate AND k.r <= {_CENTRES}
    GROUP BY a.plate, c.plate) GROUP BY plate)""",
    more=", ranked AS (SELECT plate, row_number() OVER (ORDER BY plate) AS r FROM scaled)"),
    policy="as_coded", global_features=True))
def _wcss(spark, d):
    """M4 on centres that no fit chooses: the vectors of the plates with the least ids."""
    from pyspark.ml.functions import vector_to_array

    from roadtrace.operators import clustering as cl
    vec = _vectors(spark, d)
    centres = [r.v for r in vec.orderBy("plate").limit(_CENTRES).select(vector_to_array("features").alias("v")).collect()]
    return cl.squared_distance_cost(vec, centres).select(F.round("wcss", 3).alias("wcss"))


_BY_HOUR = "SELECT plate, CAST(mostFreqHour AS INTEGER) AS prediction FROM global_features"


@register("cluster_sizes", "A9", with_ctes(f"""
SELECT prediction, count(*) AS count, round(count(*) / sum(count(*)) OVER (), {ROUND}) AS share
FROM ({_BY_HOUR}) GROUP BY prediction""", global_features=True))
def _sizes(spark, d):
    from roadtrace.operators import clustering as cl
    hours = _p(spark, d).global_features.select("plate", F.col("mostFreqHour").alias("prediction"))
    return rounded(cl.cluster_sizes(hours))


@register("small_cluster_plates", "M6 P14", with_ctes(f"""
SELECT plate, prediction FROM (
  SELECT *, count(*) OVER (PARTITION BY prediction) / count(*) OVER () AS share FROM ({_BY_HOUR}))
WHERE share < 0.05""", global_features=True))
def _small(spark, d):
    """M6 on clusters that no fit chooses: a plate's most frequent hour."""
    from roadtrace.operators import clustering as cl
    hours = _p(spark, d).global_features.select("plate", F.col("mostFreqHour").alias("prediction"))
    return cl.anomalies(hours).select("plate", "prediction")


@register("kmeans_wcss", "M3 M4 M7", None)
def _kmeans(spark, d):
    from roadtrace.operators import clustering as cl
    _, elbow = cl.cluster_sweep(_vectors(spark, d), "kmeans", model_dir=_model_dir(spark))
    return elbow


@register("gmm_sweep", "M5 M7", None)
def _gmm(spark, d):
    from roadtrace.operators import clustering as cl
    _, fits = cl.cluster_sweep(_vectors(spark, d), "gmm", model_dir=_model_dir(spark))
    return fits


def _sweep_anomalies(spark, d, algo: str) -> DataFrame:
    from roadtrace.operators import clustering as cl
    vec = _vectors(spark, d)
    fits = cl.fit_models(vec, algo, model_dir=_model_dir(spark))
    return cl.sweep_anomalies(vec, algo, [(k, m) for k, m, _ in fits])


@register("anomalies", "M6 A9 P14 O4", None)
def _anomalies(spark, d):
    return _sweep_anomalies(spark, d, "kmeans")


@register("gmm_anomalies", "M5 M6 A9 P14", None)
def _gmm_anomalies(spark, d):
    """The original's main run: anomalies of every Gaussian-mixture model."""
    return _sweep_anomalies(spark, d, "gmm")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v.build for k, v in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v.sql for k, v in REGISTRY.items() if v.sql is not None}
