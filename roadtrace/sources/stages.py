"""Stage materialisation (S5) and the Parquet/CSV sinks.

A stage is an intermediate table (e.g. the cleaned sightings, the trips of a
split policy) written once as Parquet and read back by every later query.
That is what the original ETL does with its Parquet stage directories.  Two
differences, by design:

* the location is the shared folder the cluster names in
  ``spark.checkpoint.dir`` (reliable storage, so a lost executor costs no
  recomputation), never a machine-local folder;
* the key includes the inputs and parameters, and stages are scoped to the
  Spark application unless ``reuse_existing`` is asked for, so a stale stage
  of other data is never picked up (the original reuses any existing folder).
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from roadtrace.session import app_id, checkpoint_dir

_WRITTEN: dict[tuple, DataFrame] = {}


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a completed Parquet write is there (it leaves ``_SUCCESS`` behind): a look at the file system, no job."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def stage_path(spark: SparkSession, name: str, key: tuple, scope_to_app: bool = True) -> str:
    base = checkpoint_dir(spark).rstrip("/")
    if not scope_to_app:
        # the app-specific leaf of the checkpoint folder is dropped
        base = base.rsplit("/", 1)[0]
    digest = hashlib.sha1(repr((name, key)).encode()).hexdigest()[:16]
    return f"{base}/roadtrace-stages/{name}-{digest}"


def materialize(spark: SparkSession, name: str, key: tuple, build: Callable[[], DataFrame],
                reuse_existing: bool = False, path: str | None = None) -> DataFrame:
    """Write ``build()`` once as Parquet under the stage folder (or to ``path``) and read it back.

    Within one application the same ``(name, key)`` is written once.  With
    ``reuse_existing`` a completed stage left by an earlier application with
    the same key is read instead of recomputed.
    """
    memo_key = (app_id(spark), name, key, path)
    df = _WRITTEN.get(memo_key)
    if df is None:
        if path is not None or reuse_existing:
            path = path or stage_path(spark, name, key, scope_to_app=False)
            if not (reuse_existing and exists(spark, path)):
                build().write.mode("overwrite").parquet(path)
        else:
            # a unique folder per attempt: a failed or concurrent attempt
            # never leaves a half-written folder where readers look
            path = f"{stage_path(spark, name, key)}-{uuid.uuid4().hex[:8]}"
            build().write.mode("error").parquet(path)
        # the frame is kept, so later queries skip listing the folder again
        df = _WRITTEN[memo_key] = spark.read.parquet(path)
    return df


def drop_stages(spark: SparkSession) -> None:
    """Delete this application's stages from the checkpoint folder.

    For the end of a run: frames that read them are gone with them.  Stages
    kept for other applications (``reuse_existing``) or written to a folder of
    the caller's lie elsewhere and stay.
    """
    app = app_id(spark)
    for key in [k for k in _WRITTEN if k[0] == app]:
        del _WRITTEN[key]
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_dir(spark)}/roadtrace-stages")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def write_counted(spark: SparkSession, df: DataFrame) -> tuple[DataFrame, int]:
    """Write a small intermediate table under the checkpoint folder, read it
    back, and return its row count, observed during the write (one job)."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/roadtrace-rounds/{uuid.uuid4().hex}"
    obs = Observation(f"rows_{uuid.uuid4().hex[:8]}")
    df.observe(obs, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), int(obs.get["rows"])


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """S3 sink."""
    df.write.mode(mode).parquet(path)


def save_report_csv(df: DataFrame, path: str, single_file: bool = True) -> None:
    """A report as CSV with a header.

    ``single_file`` (one part file) funnels the rows through one task, so it is
    only for reports with a size bound that does not grow with the data (gate
    pairs, k values); data-sized exports pass False and keep their partitions
    (a sorted frame still writes its part files in order).
    """
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").option("header", True).csv(path)
