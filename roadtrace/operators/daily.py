"""Plate features (A7, A8) as mergeable state, one row per plate and day.

``plate_days`` and ``plate_day_trips`` reduce the sightings and trips of each (plate, day) to what any set of days can
be merged from without the sightings: counts per value for distinct counts and modes, sums of counts, the earliest
sighting, and (n, sum, min, max) of every trip statistic.  Written by day (``write_days``), they let a run over a year
add one day, or report any month, by reading these rows only.  Instants of different days differ, so distinct instants
add up; a trip belongs to the day it starts in.

Sizes: a row holds 24 hour counts and one entry per gate with its lanes, so its arrays are bounded by the network, not
by the plate's rows; every aggregate combines before its shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadtrace.functions.time import iso_weekday
from roadtrace.operators.features import TRIP_SUMMARY_STATS, _cap, trip_stats

HOURS, WEEKDAYS = 24, 7


def plate_days(sequence: DataFrame) -> DataFrame:
    """``(plate, day, first, seen, hours, gates)`` from the sightings with their previous one (``previous_sighting``).

    ``first`` is the earliest (ts, nationality), ``seen`` the distinct instants, ``hours`` the sightings per hour,
    ``gates`` (gate, n, lanes) per gate.
    """
    new = F.col("prev_ts").isNull() | (F.col("prev_ts") != F.col("ts"))
    per_gate = (sequence.withColumns({"day": F.to_date("ts"), "_h": F.hour("ts")}).groupBy("plate", "day", "gate").agg(
        F.count(F.lit(1)).alias("n"), F.collect_set("lane").alias("lanes"), F.min(F.struct("ts", "nationality")).alias("first"),
        F.count_if(new).alias("seen"), *[F.count_if(F.col("_h") == h).alias(f"_h{h}") for h in range(HOURS)]))
    return per_gate.groupBy("plate", "day").agg(
        F.min("first").alias("first"), F.sum("seen").alias("seen"),
        F.array(*[F.sum(f"_h{h}") for h in range(HOURS)]).alias("hours"),
        F.collect_list(F.struct("gate", "n", F.sort_array("lanes").alias("lanes"))).alias("gates"))


def _most(counts: list[Column], first: int) -> Column:
    """The number, from ``first``, of the largest count (the smallest number among equals)."""
    held = F.array(*counts)
    return (F.array_position(held, F.array_max(held)) - 1 + first).cast("int")


def merged_global_features(days: DataFrame) -> DataFrame:
    """A7 over the sightings of any set of ``plate_days`` rows: the columns of ``plate_global_features``."""
    n = F.aggregate("hours", F.lit(0).cast("long"), lambda a, x: a + x)
    x = days.withColumns({"_n": n, "_w": iso_weekday("day"), "_m": F.month("day"), "_d": F.dayofmonth("day")})

    def bits(c):
        return F.bit_count(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col(c)))).cast("long")

    hours = [F.sum(F.col("hours")[h]) for h in range(HOURS)]
    weekdays = [F.sum(F.when(F.col("_w") == w, F.col("_n")).otherwise(0)) for w in range(1, WEEKDAYS + 1)]
    whole = x.groupBy("plate").agg(
        F.min("first").getField("nationality").alias("nationality"), bits("_m").alias("num_months"), bits("_d").alias("num_days"),
        F.sum("seen").alias("num_seen"), F.array(*hours).alias("_hours"), F.array(*weekdays).alias("_weekdays"))
    # per gate first, so that a plate's entries are one per gate and not one per gate and day
    gates = (days.select("plate", F.explode("gates").alias("g")).groupBy("plate", "g.gate")
             .agg(F.sum("g.n").alias("n"), F.array_distinct(F.flatten(F.collect_set("g.lanes"))).alias("lanes"))
             .groupBy("plate").agg(
                 F.count(F.lit(1)).alias("num_gates"), F.sum(F.size("lanes")).cast("long").alias("num_gatelane"),
                 F.size(F.array_distinct(F.flatten(F.collect_set("lanes")))).cast("long").alias("num_lanes"),
                 F.max_by("gate", F.struct("n", -F.col("gate"))).alias("mostFreqGate")))
    out = whole.join(gates, "plate")
    busy = F.size(F.filter("_hours", lambda c: c > 0)).cast("long")
    return out.select(
        "plate", "nationality", "num_gates", "num_lanes", "num_gatelane", "num_months", "num_days", busy.alias("num_hours"),
        F.size(F.filter("_weekdays", lambda c: c > 0)).cast("long").alias("num_daysofweek"), "num_seen",
        _most([F.col("_hours")[h] for h in range(HOURS)], 0).alias("mostFreqHour"),
        _most([F.col("_weekdays")[w] for w in range(WEEKDAYS)], 1).alias("mostFreqDayOfWeek"), "mostFreqGate")


def plate_day_trips(enriched: DataFrame) -> DataFrame:
    """``(plate, day, numtrips, n_*, sum_*, min_*, max_*)`` of the trips that start in a day, from enriched segments."""
    starts = enriched.groupBy("plate", "tripid").agg(F.to_date(F.min("tstart")).alias("day"))
    aggs = [f(c).alias(f"{name}_{c}") for c in TRIP_SUMMARY_STATS for name, f in (
        ("n", F.count), ("sum", F.sum), ("min", F.min), ("max", F.max))]
    return trip_stats(enriched).join(starts, ["plate", "tripid"]).groupBy("plate", "day").agg(
        F.count(F.lit(1)).alias("numtrips"), *aggs)


def merged_trip_summary(days: DataFrame) -> DataFrame:
    """A8 over any set of ``plate_day_trips`` rows: the columns of ``plate_trip_summary``."""
    aggs = [a for c in TRIP_SUMMARY_STATS for a in (
        F.min(f"min_{c}").alias(f"min{_cap(c)}"), F.max(f"max_{c}").alias(f"max{_cap(c)}"),
        F.try_divide(F.sum(f"sum_{c}"), F.sum(f"n_{c}")).alias(f"avg{_cap(c)}"))]
    return days.groupBy("plate").agg(*aggs, F.sum("numtrips").alias("numtrips"))


def write_days(days: DataFrame, path: str) -> None:
    """Write the state of the days that ``days`` holds, in place of what the table has of them (other days stay)."""
    days.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def read_days(spark: SparkSession, path: str, days: list | None = None, schema: T.StructType | None = None) -> DataFrame:
    """The state of all days, or of the given dates (other partitions aren't read).

    A table that no day was written to has no file to tell its columns: with ``schema``, that of the state, it is empty.
    """
    table = (spark.read if schema is None else spark.read.schema(schema)).parquet(path)
    if days is None:
        return table
    return table.where(reduce(lambda a, b: a | b, [F.col("day") == F.lit(d).cast("date") for d in days], F.lit(False)))
