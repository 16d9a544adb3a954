"""Per-trip and per-plate features.

Skew: all aggregates are decomposable (sum/min/max/count, bit masks of
calendar parts, ``collect_set`` and ``mode`` over bounded domains such as
gates), so partial aggregation runs before the one shuffle on the plate.
Distinct instants are counted from the consecutive pairs of sightings, not by
a distinct aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadtrace.functions.time import calendar_parts, duration_between, minutes_between


def trip_stats(seg: DataFrame, keep_all: bool = False) -> DataFrame:
    """A5 + A6 + J5: per (plate, tripid) distance, duration, speed, service-area time.

    The original joins the trip totals with the service-area totals (inner),
    which keeps only trips with at least one service-area segment.  Both come
    from the same grouping, so one aggregate computes both and filters.
    ``keep_all`` keeps every trip, with 0 h in service areas.
    """
    sa = F.col("hasServiceArea")
    agg = (seg.groupBy("plate", "tripid")
           .agg(F.sum("segmentDist").alias("tripDist"),
                F.sum("segmentDuration").alias("tripDuration"),
                F.sum(F.when(sa, F.col("segmentDuration"))).alias("totTimeServiceArea"),
                F.bool_or(sa).alias("_has_sa")))
    agg = agg.withColumn("tripSpeed", F.try_divide(F.col("tripDist"), F.col("tripDuration")))
    if keep_all:
        agg = agg.withColumn("totTimeServiceArea", F.coalesce("totTimeServiceArea", F.lit(0.0)))
    else:
        agg = agg.filter(F.col("_has_sa"))
    return agg.select("plate", "tripid", "tripDist", "tripDuration", "tripSpeed", "totTimeServiceArea")


def trip_totals(seg: DataFrame) -> DataFrame:
    """A5 alone: totals of every trip with at least one segment."""
    return (seg.groupBy("plate", "tripid")
            .agg(F.sum("segmentDist").alias("tripDist"),
                 F.sum("segmentDuration").alias("tripDuration"))
            .withColumn("tripSpeed", F.try_divide(F.col("tripDist"), F.col("tripDuration"))))


def service_area_time(seg: DataFrame) -> DataFrame:
    """A6 alone: hours spent on service-area segments per trip (trips with any)."""
    return (seg.filter(F.col("hasServiceArea"))
            .groupBy("plate", "tripid")
            .agg(F.sum("segmentDuration").alias("totTimeServiceArea")))


TRIP_SUMMARY_STATS = ["tripDist", "tripDuration", "tripSpeed", "totTimeServiceArea"]


def _cap(name: str) -> str:
    return name[0].upper() + name[1:]


def plate_trip_summary(trips: DataFrame) -> DataFrame:
    """min/max/avg of each trip statistic and the number of trips per plate.

    Rows of ``trips`` are unique per (plate, tripid), so the distinct trip
    count is a plain count.
    """
    aggs = []
    for c in TRIP_SUMMARY_STATS:
        aggs += [F.min(c).alias(f"min{_cap(c)}"), F.max(c).alias(f"max{_cap(c)}"),
                 F.avg(c).alias(f"avg{_cap(c)}")]
    return trips.groupBy("plate").agg(*aggs, F.count(F.lit(1)).alias("numtrips"))


def plate_global_features(df: DataFrame, sequence: DataFrame | None = None, **hot) -> DataFrame:
    """Behaviour of a plate over all its sightings.

    * ``nationality`` at the earliest sighting (ties: smallest value);
    * distinct gates, lanes, gate+lane pairs (bounded domains: size of a set),
      months, days of month, hours, ISO weekdays (bits of a mask) and instants;
    * most frequent hour, weekday, gate (F5: ties go to the smallest value).

    Instants are counted in ``sequence`` (``previous_sighting(df)``, computed
    here unless the caller has it): a sighting opens a new instant if the
    plate's previous one, in time order, has another.  A distinct count would
    shuffle every ``(plate, ts)`` instead.
    """
    from roadtrace.operators.trips import previous_sighting
    p = sequence if sequence is not None else previous_sighting(df, **hot)
    x = p.select("plate", "gate", "lane", "ts", "nationality", "prev_ts",
                 *[v.alias(k) for k, v in calendar_parts("ts").items()])

    def nset(c):
        return F.size(F.collect_set(c)).cast("long")

    def nbits(c):
        # months, days of month, hours and weekdays are below 64
        return F.bit_count(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col(c)))).cast("long")

    return x.groupBy("plate").agg(
        F.min(F.struct("ts", "nationality")).getField("nationality").alias("nationality"),
        nset("gate").alias("num_gates"),
        nset("lane").alias("num_lanes"),
        nset(F.struct("gate", "lane")).alias("num_gatelane"),
        nbits("month").alias("num_months"),
        nbits("day").alias("num_days"),
        nbits("hour").alias("num_hours"),
        nbits("dayofweek").alias("num_daysofweek"),
        F.count_if(F.col("prev_ts").isNull() | (F.col("prev_ts") != F.col("ts"))).alias("num_seen"),
        F.mode("hour", deterministic=True).alias("mostFreqHour"),
        F.mode("dayofweek", deterministic=True).alias("mostFreqDayOfWeek"),
        F.mode("gate", deterministic=True).alias("mostFreqGate"),
    )


def plate_features(global_features: DataFrame, trip_summary: DataFrame) -> DataFrame:
    """Global and trip features of plates present in both (inner join on plate)."""
    return global_features.join(trip_summary, "plate")


def avg_gaps(sightings: DataFrame, units: tuple[str, ...] = ("DAY", "HOUR", "MINUTE", "SECOND"),
             sequence: DataFrame | None = None, **hot) -> DataFrame:
    """per plate, the mean truncated gap between consecutive sightings in
    each unit (0.0 with fewer than two sightings), one aggregate for all units.

    Consecutive pairs come from ``previous_sighting`` (skew-safe for hot
    plates), or from ``sequence`` when the caller already has them; ``hot``
    passes ``hot_threshold``.
    """
    from roadtrace.operators.trips import previous_sighting
    p = sequence if sequence is not None else previous_sighting(sightings, **hot)
    return p.groupBy("plate").agg(*[
        F.coalesce(F.avg(duration_between(F.col("prev_ts"), F.col("ts"), u)), F.lit(0.0))
        .alias(f"avg_{u.lower()}_gap") for u in units])


def window_analysis(df: DataFrame, timespan: str = "1 hour", gate_col: str = "gate",
                    ts_col: str = "ts", sequence: DataFrame | None = None, **hot) -> DataFrame:
    """Per plate, averages over its tumbling windows of

    * ``hourly_gates``: distinct gates in the window, and
    * ``min_avg_diff``: mean whole-minute gap between consecutive instants in
      the window (0.0 with a single instant).

    Consecutive pairs come from ``previous_sighting`` (skew-safe); a pair
    belongs to a window when both instants fall in it.  The per-window figures
    are then a map-side-combined aggregate, no window partition per group.
    ``sequence`` is ``previous_sighting(df)`` when the caller already has it
    (sighting columns only).
    """
    from roadtrace.operators.trips import previous_sighting
    x = df.select("plate", F.col(gate_col).alias("gate"), F.col(ts_col).alias("ts"),
                  *(["lane"] if "lane" in df.columns else [F.lit(0.0).alias("lane")]),
                  *(["nationality"] if "nationality" in df.columns else [F.lit("").alias("nationality")]))
    p = sequence if sequence is not None else previous_sighting(x, **hot)
    # one window() per projection (Spark's rule), hence two steps; window()
    # drops rows whose time is null, so the first sighting uses its own ts
    # (its gap is null anyway)
    p = p.withColumn("_w", F.window("ts", timespan).getField("start"))
    p = p.withColumn("_pw", F.window(F.coalesce("prev_ts", "ts"), timespan).getField("start"))
    p = p.select("plate", "gate", "_w",
                 F.when(F.col("_pw") == F.col("_w"),
                        minutes_between(F.col("prev_ts"), F.col("ts"))).alias("_gap"))
    per = (p.groupBy("plate", "_w")
           .agg(F.size(F.collect_set("gate")).alias("hourly_gates"),
                F.coalesce(F.avg("_gap"), F.lit(0.0)).alias("min_avg_diff")))
    return per.groupBy("plate").agg(F.avg("hourly_gates").alias("avg_hourly_gates"),
                                    F.avg("min_avg_diff").alias("min_avg_diff"))
