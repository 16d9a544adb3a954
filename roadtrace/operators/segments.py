"""Segment metrics and network reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadtrace.functions.time import seconds_between
from roadtrace.operators.network import ARC_INFO_COLS, join_arc_info

SECONDS_PER_HOUR = 3600.0


def segment_metrics(seg: DataFrame) -> DataFrame:
    """distance (km, |pos difference|), duration (h, whole seconds), speed (km/h).

    Unmapped segments have no positions, so no distance and no speed; a zero
    duration gives no speed (``try_divide``) instead of an error.
    """
    dist = F.abs(F.col("posto") - F.col("posfrom"))
    dur = seconds_between("tstart", "tend").cast("double") / F.lit(SECONDS_PER_HOUR)
    return (seg.withColumn("segmentDist", dist)
            .withColumn("segmentDuration", dur)
            .withColumn("segmentSpeed", F.try_divide(F.col("segmentDist"), F.col("segmentDuration"))))


def enriched_segments(seg: DataFrame, oriented: DataFrame) -> DataFrame:
    """J4 + F9: segments with network columns oriented to travel, then metrics."""
    return segment_metrics(join_arc_info(seg, oriented))


def arc_frequency(seg: DataFrame, oriented: DataFrame) -> DataFrame:
    """A4: segments per directed gate pair, with network columns, most frequent first.

    The count is a map-side-combined aggregate; the tiny result is enriched.
    """
    counts = seg.groupBy("gatefrom", "gateto").agg(F.count(F.lit(1)).alias("count"))
    return (join_arc_info(counts, oriented)
            .select("gatefrom", "gateto", "count", *ARC_INFO_COLS)
            .orderBy(F.desc("count"), "gatefrom", "gateto"))


def self_arcs(seg: DataFrame) -> DataFrame:
    """Consecutive sightings at the same gate, per gate."""
    return (seg.filter(F.col("gatefrom") == F.col("gateto"))
            .groupBy(F.col("gatefrom").alias("gate"))
            .agg(F.count(F.lit(1)).alias("count")))
