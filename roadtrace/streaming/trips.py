"""Trips (W3-W5, W7) kept up to date over a stream of sightings.

The view holds every sighting windowed inside its plate's day (``operators.trips.windowed`` with the day as chunk): its
place, the sighting before it and the splits so far, for each split rule.  A micro-batch rebuilds only the days of
plates that it brings new rows for: their current rows and the new ones are windowed again and written as the days'
next version, in files of the batch's own.  What crosses midnight -- the sighting before a day's first, the trip that
goes on, the number of trips so far -- is stitched when trips are read, from one summary row per plate and day.

Late rows.  No day is ever final: a row that comes days late joins its day, which re-opens the trips around it, and the
numbers of the plate's later trips follow as they are stitched.  So the result depends on the set of rows only, equals
``sessionize`` of that set after every batch, and needs no watermark; the state is the view itself, on shared storage,
and a task never holds more than a plate's day.  A repeated batch overwrites its files with the same content; rows that
are there already rebuild nothing.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from roadtrace.operators import trips as tr
from roadtrace.schema import SIGHTING, SIGHTING_COLS
from roadtrace.streaming.ingest import sighting_stream

_KEY = ["day", "plate"]


def _current(spark: SparkSession, view_path: str, before: int | None = None) -> DataFrame | None:
    """The last version of every plate's day, or None as long as nothing was written."""
    try:
        view = spark.read.option("mergeSchema", "false").parquet(view_path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    if "day" not in view.columns:       # no batch has brought a row yet
        return None
    if before is not None:
        view = view.where(F.col("batch") < before)
    last = view.groupBy(*_KEY).agg(F.max("batch").alias("_last"))
    return view.join(last, _KEY).where(F.col("batch") == F.col("_last")).drop("_last")


def maintain(spark: SparkSession, batch: DataFrame, batch_id: int, view_path: str, pairs: DataFrame | None,
             policies: tuple[str, ...], cut_minutes: int) -> None:
    """Bring the view up to date with a batch of sightings (rows with nulls are left out, as P6 does)."""
    fresh = batch.select(*SIGHTING_COLS).na.drop().distinct().withColumn("day", F.to_date("ts"))
    current = _current(spark, view_path, batch_id)
    rows = fresh
    if current is not None:
        # the batch's days prune the view's partitions, its plates the rows
        there = current.join(fresh.select(*_KEY).distinct(), _KEY, "left_semi").select(*SIGHTING_COLS, "day")
        fresh = fresh.join(there, [*SIGHTING_COLS, "day"], "left_anti")
        rows = there.join(fresh.select(*_KEY).distinct(), _KEY, "left_semi").unionByName(fresh)
    x = tr.windowed_chunks(tr.day_chunks(rows), pairs, policies, cut_minutes)
    x.write.mode("overwrite").partitionBy("day").parquet(f"{view_path.rstrip('/')}/batch={batch_id}")


def read_trips(spark: SparkSession, view_path: str, policy: str, pairs: DataFrame | None, cut_minutes: int,
               policies: tuple[str, ...]) -> DataFrame:
    """The sightings with ``tripid, step, prev_gate, prev_ts``, as ``sessionize`` gives them."""
    x = _current(spark, view_path)
    if x is None:
        folder = spark._jvm.org.apache.hadoop.fs.Path(view_path)
        if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            raise ValueError(f"no view at {view_path}")
        # batches were kept, but none has brought a row
        x = tr.windowed_chunks(tr.day_chunks(spark.createDataFrame([], SIGHTING)), pairs, policies, cut_minutes)
    summary = tr.chunk_summary(x, pairs, policies, cut_minutes)
    return tr.stitched(x, summary, policy, SIGHTING_COLS)


def start_trips(spark: SparkSession, folder: str, view_path: str, checkpoint: str, pairs: DataFrame | None = None,
                policies: tuple[str, ...] = ("gap",), cut_minutes: int = tr.CUT_MINUTES, available_now: bool = True,
                max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Trips over sighting files that arrive in a folder."""
    writer = (sighting_stream(spark, folder, max_files_per_trigger).writeStream
              .foreachBatch(lambda df, i: maintain(df.sparkSession, df, i, view_path, pairs, policies, cut_minutes))
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
