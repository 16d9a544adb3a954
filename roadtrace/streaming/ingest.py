"""S1 as a Structured Streaming job: sighting files arriving in a folder.

New headerless ``;`` CSV files are parsed with the fixed schema and added to a
Parquet table, exactly de-duplicated on all columns however late a row
arrives.  Each micro-batch is reduced to its distinct rows, the days it
touches are read from the table (partitioned by day), and only rows that are
not there yet are written.

A batch goes to files of its own, ``batch=<id>`` inside the table, which a
repeated batch (after a failure) overwrites, and it compares itself with the
other batches only, so it may be run again.  Progress lives in ``checkpoint``
(reliable storage), so a restarted query resumes where it stopped.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from roadtrace.schema import SIGHTING, SIGHTING_COLS
from roadtrace.sources.files import csv_options

#: Table layout: the sighting, then the partition columns.
TABLE = T.StructType([*SIGHTING.fields, T.StructField("batch", T.LongType()), T.StructField("day", T.DateType())])


def sighting_stream(spark: SparkSession, folder: str, max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(SIGHTING).options(**csv_options())
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.csv(folder)


def read_table(spark: SparkSession, table_path: str) -> DataFrame:
    """The ingested sightings (a set)."""
    return spark.read.schema(TABLE).parquet(table_path).select(*SIGHTING_COLS)


def append_new(batch: DataFrame, batch_id: int, table_path: str) -> None:
    """Add the rows of a micro-batch that the table's other batches don't hold."""
    spark = batch.sparkSession
    fresh = batch.withColumn("day", F.to_date("ts"))
    found = fresh.withColumn("_there", F.lit(False))
    try:
        table = spark.read.schema(TABLE).parquet(table_path).where(F.col("batch") != batch_id)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    else:
        # the touched days prune the table's partitions (dynamically, from the batch's own days)
        days = fresh.select("day").distinct()
        there = table.join(days, table["day"].eqNullSafe(days["day"]), "left_semi").drop("batch")
        found = found.unionByName(there.withColumn("_there", F.lit(True)))
    # one grouping finds the distinct rows and those that are there
    new = found.groupBy(*SIGHTING_COLS, "day").agg(F.max("_there").alias("_there")).where(~F.col("_there")).drop("_there")
    write_by_day(new, f"{table_path.rstrip('/')}/batch={batch_id}")


def write_by_day(df: DataFrame, path: str) -> None:
    """Overwrite a table partitioned by day.  Days are brought together first, a large one in several tasks: otherwise
    every task adds a file to every day."""
    df.hint("rebalance", F.col("day")).write.mode("overwrite").partitionBy("day").parquet(path)


def start_ingest(spark: SparkSession, folder: str, table_path: str, checkpoint: str,
                 available_now: bool = True, max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Start the ingest; ``available_now`` processes what is there and stops."""
    writer = (sighting_stream(spark, folder, max_files_per_trigger).writeStream
              .foreachBatch(lambda df, batch_id: append_new(df, batch_id, table_path))
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
