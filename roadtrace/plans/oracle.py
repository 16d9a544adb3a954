"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

The oracle is written the plain way -- one window per plate, the network
closure as a recursive CTE with set ``UNION``, the segment enrichment as the
original two-direction ``OR`` join -- so it checks the Spark rewrites
(chunked sessionization, union-of-directions equi join, closure by powering)
rather than repeating them.  Doubles are rounded to 6 places on both sides.
"""

from __future__ import annotations

ROUND = 6
ORDER = "ts, gate, lane, nationality"

_BASE = """
sightings AS (
  SELECT DISTINCT CAST(user_id AS INTEGER) AS plate,
    CAST(props->>'$.k' AS INTEGER) % 28 + 1 AS gate,
    CAST(event_id % 3 + 1 AS DOUBLE) AS lane,
    time_bucket(INTERVAL '15 minutes', ts) AS ts,
    CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 89 = 0 THEN 'LONG'
         WHEN event_id % 7 = 0 THEN '?'
         WHEN user_id % 10 = 0 AND event_id % 2 = 0 THEN 'HR' WHEN user_id % 4 = 0 THEN 'I'
         WHEN user_id % 4 = 1 THEN 'RO' WHEN user_id % 4 = 2 THEN 'CH' ELSE '?' END AS nationality
  FROM events),
valid AS (SELECT * FROM sightings WHERE nationality IS NOT NULL AND length(nationality) <= 3),
conflicts AS (
  SELECT gate, lane, ts, count(DISTINCT plate) AS plates FROM valid
  GROUP BY gate, lane, ts HAVING count(DISTINCT plate) > 1),
clean AS (
  SELECT v.* FROM valid v ANTI JOIN conflicts c
  ON v.gate = c.gate AND v.lane = c.lane AND v.ts = c.ts),
multinat AS (
  SELECT plate, list_sort(list(DISTINCT nationality)) AS nats,
         count(DISTINCT nationality) AS num_nat
  FROM clean GROUP BY plate HAVING count(DISTINCT nationality) > 1),
fixable AS (
  SELECT plate, list_filter(nats, lambda x: x <> '?')[1] AS real_nat FROM multinat
  WHERE num_nat = 2 AND list_contains(nats, '?')),
fixed AS (
  SELECT c.plate, c.gate, c.lane, c.ts, coalesce(f.real_nat, c.nationality) AS nationality
  FROM clean c LEFT JOIN fixable f ON c.plate = f.plate),
nonnull AS (
  SELECT * FROM fixed WHERE plate IS NOT NULL AND gate IS NOT NULL AND lane IS NOT NULL
    AND ts IS NOT NULL AND nationality IS NOT NULL),
gates AS (
  SELECT CAST(g AS INTEGER) AS gateid, CAST(round(4.5 * g + (g % 3) * 0.7, 1) AS DOUBLE) AS pos,
         CAST(floor((g - 1) / 9) + 1 AS INTEGER) AS highwayid
  FROM range(1, 29) t(g)),
arcs AS (
  SELECT CAST(g AS INTEGER) AS gatefrom, CAST(g + 1 AS INTEGER) AS gateto,
         g % 4 <> 0 AS hasEntryExit, g % 7 = 0 AS hasTollbooth, g % 5 = 0 AS hasServiceArea
  FROM range(1, 28) t(g) WHERE g % 9 <> 0
  UNION ALL SELECT 5, 20, true, false, true
  UNION ALL SELECT 14, 24, true, false, false),
closure(gatefrom, gateto, hasEntryExit, hasTollbooth, hasServiceArea) AS (
  SELECT gatefrom, gateto, hasEntryExit, hasTollbooth, hasServiceArea FROM arcs
  UNION
  SELECT c.gatefrom, a.gateto, c.hasEntryExit OR a.hasEntryExit, c.hasTollbooth OR a.hasTollbooth,
         c.hasServiceArea OR a.hasServiceArea
  FROM closure c JOIN arcs a ON c.gateto = a.gatefrom),
pairs AS (
  SELECT gatefrom, gateto, bool_or(hasEntryExit AND NOT hasServiceArea) AS is_cut
  FROM closure GROUP BY gatefrom, gateto),
enriched AS (
  SELECT c.*, gf.pos AS pos_from, gf.highwayid AS highwayid_from,
         gt.pos AS pos_to, gt.highwayid AS highwayid_to
  FROM closure c JOIN gates gf ON c.gatefrom = gf.gateid JOIN gates gt ON c.gateto = gt.gateid)
"""

_RULES = {
    "as_coded": "legal OR (NOT cut_ok AND gap > {cut})",
    "documented": "NOT legal OR (cut_ok AND gap > {cut})",
    "gap": "gap > {cut}",
}


def _trips(policy: str, cut: int) -> str:
    rule = _RULES[policy].format(cut=cut)
    return f"""
ordered AS (
  SELECT *, lag(gate) OVER w AS pg, lag(ts) OVER w AS pt FROM nonnull
  WINDOW w AS (PARTITION BY plate ORDER BY {ORDER})),
flagged AS (
  SELECT o.plate, o.gate, o.lane, o.ts, o.nationality, o.pg, o.pt,
    CASE WHEN o.pg IS NULL THEN true ELSE ({rule}) END AS split
  FROM (SELECT o.*, p.gatefrom IS NOT NULL AS legal, coalesce(p.is_cut, false) AS cut_ok,
               trunc((epoch_us(o.ts) - epoch_us(o.pt)) / 60000000) AS gap
        FROM ordered o LEFT JOIN pairs p ON p.gatefrom = o.pg AND p.gateto = o.gate) o),
tripped AS (
  SELECT *, CAST(sum(CASE WHEN split THEN 1 ELSE 0 END) OVER (
      PARTITION BY plate ORDER BY {ORDER} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS tripid
  FROM flagged),
trips AS (
  SELECT *, row_number() OVER (PARTITION BY plate, tripid ORDER BY {ORDER}) AS step FROM tripped),
segs AS (
  SELECT plate, tripid, pg AS gatefrom, gate AS gateto, pt AS tstart, ts AS tend
  FROM trips WHERE step > 1),
eseg AS (
  SELECT s.*, e.hasEntryExit, e.hasTollbooth, e.hasServiceArea,
    CASE WHEN s.gatefrom = e.gatefrom AND s.gateto = e.gateto THEN e.pos_from ELSE e.pos_to END AS posfrom,
    CASE WHEN s.gatefrom = e.gatefrom AND s.gateto = e.gateto THEN e.pos_to ELSE e.pos_from END AS posto,
    CASE WHEN s.gatefrom = e.gatefrom AND s.gateto = e.gateto THEN e.highwayid_from ELSE e.highwayid_to END
      AS highwayidfrom,
    CASE WHEN s.gatefrom = e.gatefrom AND s.gateto = e.gateto THEN e.highwayid_to ELSE e.highwayid_from END
      AS highwayidto
  FROM segs s LEFT JOIN enriched e
    ON (s.gatefrom = e.gatefrom AND s.gateto = e.gateto) OR (s.gateto = e.gatefrom AND s.gatefrom = e.gateto)),
mseg AS (
  SELECT *, abs(posto - posfrom) AS segmentDist, CAST(secs AS DOUBLE) / 3600.0 AS segmentDuration,
    CASE WHEN secs = 0 THEN NULL ELSE abs(posto - posfrom) / (CAST(secs AS DOUBLE) / 3600.0) END
      AS segmentSpeed
  FROM (SELECT *, trunc((epoch_us(tend) - epoch_us(tstart)) / 1000000) AS secs FROM eseg)),
tstats AS (
  SELECT plate, tripid, sum(segmentDist) AS tripDist, sum(segmentDuration) AS tripDuration,
    CASE WHEN sum(segmentDuration) = 0 THEN NULL ELSE sum(segmentDist) / sum(segmentDuration) END AS tripSpeed,
    sum(CASE WHEN hasServiceArea THEN segmentDuration END) AS totTimeServiceArea
  FROM mseg GROUP BY plate, tripid HAVING bool_or(hasServiceArea)),
tsummary AS (
  SELECT plate,
    min(tripDist) AS minTripDist, max(tripDist) AS maxTripDist, avg(tripDist) AS avgTripDist,
    min(tripDuration) AS minTripDuration, max(tripDuration) AS maxTripDuration,
    avg(tripDuration) AS avgTripDuration,
    min(tripSpeed) AS minTripSpeed, max(tripSpeed) AS maxTripSpeed, avg(tripSpeed) AS avgTripSpeed,
    min(totTimeServiceArea) AS minTotTimeServiceArea, max(totTimeServiceArea) AS maxTotTimeServiceArea,
    avg(totTimeServiceArea) AS avgTotTimeServiceArea, count(*) AS numtrips
  FROM tstats GROUP BY plate)"""


_GLOBAL = f"""
cal AS (
  SELECT *, month(ts) AS month, day(ts) AS day, hour(ts) AS hour, isodow(ts) AS dayofweek FROM nonnull),
mode_hour AS (
  SELECT plate, v AS mostFreqHour FROM (
    SELECT plate, hour AS v, row_number() OVER (PARTITION BY plate ORDER BY count(*) DESC, hour) AS r
    FROM cal GROUP BY plate, hour) WHERE r = 1),
mode_dow AS (
  SELECT plate, v AS mostFreqDayOfWeek FROM (
    SELECT plate, dayofweek AS v,
      row_number() OVER (PARTITION BY plate ORDER BY count(*) DESC, dayofweek) AS r
    FROM cal GROUP BY plate, dayofweek) WHERE r = 1),
mode_gate AS (
  SELECT plate, v AS mostFreqGate FROM (
    SELECT plate, gate AS v, row_number() OVER (PARTITION BY plate ORDER BY count(*) DESC, gate) AS r
    FROM cal GROUP BY plate, gate) WHERE r = 1),
gfeat AS (
  SELECT c.plate, first(nationality ORDER BY ts, nationality) AS nationality,
    count(DISTINCT gate) AS num_gates, count(DISTINCT lane) AS num_lanes,
    count(DISTINCT (gate, lane)) AS num_gatelane, count(DISTINCT month) AS num_months,
    count(DISTINCT day) AS num_days, count(DISTINCT hour) AS num_hours,
    count(DISTINCT dayofweek) AS num_daysofweek, count(DISTINCT ts) AS num_seen
  FROM cal c GROUP BY c.plate),
global_features AS (
  SELECT g.*, h.mostFreqHour, d.mostFreqDayOfWeek, m.mostFreqGate
  FROM gfeat g JOIN mode_hour h USING (plate) JOIN mode_dow d USING (plate) JOIN mode_gate m USING (plate))"""


def with_ctes(select: str, policy: str | None = None, cut: int = 720,
              global_features: bool = False) -> str:
    parts = [_BASE.strip()]
    if policy is not None:
        parts.append(_trips(policy, cut).strip())
    if global_features:
        parts.append(_GLOBAL.strip())
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + select.strip()


def r(expr: str, alias: str | None = None) -> str:
    """Round a double to the comparison precision."""
    return f"round({expr}, {ROUND}) AS {alias or expr}"
