"""Conflicts (A1) and clean sightings (J1) maintained over the streaming ingest.

After a micro-batch is in the table, only the state of the keys (gate, lane, ts) it touches can change.  For these keys
the distinct plates before and after the batch are counted from the table's touched days, and the change is written to
two logs, in files of the batch's own:

* ``conflicts``: keys with more than one plate, with their count after the batch.  Rows are only ever added to the
  table, so a key's count only grows and its current value is the largest in the log.
* ``clean``: signed rows.  A valid sighting comes in with +1 if its key has no conflict, and goes out again with -1 in
  the batch that brings the conflict, however much later that is.  Each row comes and goes at most once.

A batch counts only rows of earlier batches as "before" and overwrites its own files, so it may be run again with the
same result, and batches may be large or small.  Rows with a null in the key can't be in conflict with a join's
equality and stay clean; they count as a key of their own among the conflicts, as in the batch queries.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from roadtrace.operators.quality import CONFLICT_KEYS, any_null, valid_sightings
from roadtrace.schema import SIGHTING, SIGHTING_COLS
from roadtrace.streaming.ingest import TABLE, append_new, sighting_stream, write_by_day

_PARTITION = [T.StructField("batch", T.LongType()), T.StructField("day", T.DateType())]
CONFLICT_LOG = T.StructType([*[SIGHTING[c] for c in CONFLICT_KEYS], T.StructField("plates", T.LongType()), *_PARTITION])
CLEAN_LOG = T.StructType([*SIGHTING.fields, T.StructField("sign", T.IntegerType()), *_PARTITION])


def _read(spark: SparkSession, schema: T.StructType, path: str) -> DataFrame:
    """A partitioned table; empty as long as nothing was written."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _same_key(a: str, b: str):
    out = F.lit(True)
    for c in ("day", *CONFLICT_KEYS):
        out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def maintain(spark: SparkSession, batch_id: int, table_path: str, view_path: str) -> None:
    """Bring the views up to date with the rows that ``batch_id`` added to the table."""
    table = valid_sightings(_read(spark, TABLE, table_path))
    fresh = table.where(F.col("batch") == batch_id)
    keys = ["day", *CONFLICT_KEYS]
    touched = fresh.select(*keys).distinct()
    # the touched days prune the table's partitions; the keys leave the rows whose state may change
    old = (table.where(F.col("batch") < batch_id).alias("old")
           .join(touched.alias("new"), _same_key("old", "new"), "left_semi"))
    rows = old.withColumn("_new", F.lit(False)).unionByName(fresh.withColumn("_new", F.lit(True)))
    # a plate of a key first, so that both counts are plain ones; both logs read the state
    plates = rows.groupBy(*keys, "plate").agg(F.min("_new").alias("_new"))
    state = plates.groupBy(*keys).agg(F.count(F.when(~F.col("_new"), F.col("plate"))).alias("was"),
                                      F.count("plate").alias("now")).persist()
    out = f"{view_path.rstrip('/')}/{{}}/batch={batch_id}"
    try:
        changed = state.where((F.col("now") > 1) & (F.col("now") > F.col("was")))
        write_by_day(changed.select(*CONFLICT_KEYS, F.col("now").alias("plates"), "day"), out.format("conflicts"))

        # a key with a null never meets a conflict; rows of a key that had one before have gone out already
        split = F.when(any_null(CONFLICT_KEYS), False)
        open_keys = (state.select(*keys, split.otherwise(F.col("was") > 1).alias("_was"), split.otherwise(F.col("now") > 1).alias("_now"))
                     .where(~F.col("_was")))
        upto = table.where(F.col("batch") <= batch_id).withColumn("_new", F.col("batch") == batch_id)
        held = upto.alias("r").join(open_keys.alias("s"), _same_key("r", "s")).select("r.*", "_now")
        sign = (F.when(F.col("_new") & ~F.col("_now"), 1)        # comes in
                .when(~F.col("_new") & F.col("_now"), -1))       # goes out
        write_by_day(held.withColumn("sign", sign).where(F.col("sign").isNotNull()).select(*SIGHTING_COLS, "sign", "day"),
                     out.format("clean"))
    finally:
        state.unpersist()


def read_conflicts(spark: SparkSession, view_path: str) -> DataFrame:
    """A1 as of the last batch: ``(gate, lane, ts, plates)``."""
    log = _read(spark, CONFLICT_LOG, f"{view_path.rstrip('/')}/conflicts")
    return log.groupBy(*CONFLICT_KEYS).agg(F.max("plates").alias("plates"))


def read_clean(spark: SparkSession, view_path: str) -> DataFrame:
    """J1 as of the last batch: the valid sightings without a conflict."""
    log = _read(spark, CLEAN_LOG, f"{view_path.rstrip('/')}/clean")
    return log.groupBy(*SIGHTING_COLS).agg(F.sum("sign").alias("_n")).where(F.col("_n") > 0).drop("_n")


def read_changes(spark: SparkSession, view_path: str, batch_id: int) -> DataFrame:
    """What a batch changed in the clean sightings: rows with ``sign`` +1 or -1."""
    log = _read(spark, CLEAN_LOG, f"{view_path.rstrip('/')}/clean")
    return log.where(F.col("batch") == batch_id).select(*SIGHTING_COLS, "sign")


def start_maintained_ingest(spark: SparkSession, folder: str, table_path: str, view_path: str, checkpoint: str,
                            available_now: bool = True, max_files_per_trigger: int | None = None) -> StreamingQuery:
    """The ingest of ``streaming.ingest`` with both views kept up to date after every batch."""
    def both(batch: DataFrame, batch_id: int) -> None:
        append_new(batch, batch_id, table_path)
        maintain(batch.sparkSession, batch_id, table_path, view_path)

    writer = (sighting_stream(spark, folder, max_files_per_trigger).writeStream.foreachBatch(both)
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
