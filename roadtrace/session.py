"""Session set-up and lineage helpers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def build_session(master: str | None = None, app: str = "roadtrace",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Session used by tests, bench and examples.

    On a cluster the caller usually owns the session; these settings are the
    ones the operators assume: UTC session zone (all operator logic runs on
    ``TIMESTAMP_NTZ`` and does not depend on it, but reports render in it),
    AQE with skew-join splitting, no UI server.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def app_id(spark: SparkSession) -> str:
    """The application id (also on sessions without a SparkContext handle)."""
    try:
        return spark.conf.get("spark.app.id")
    except Exception:  # noqa: BLE001 - fall back to the context
        return spark.sparkContext.applicationId


def checkpoint_dir(spark: SparkSession) -> str:
    """Folder for this application's intermediate tables (stages, closure rounds).

    It is ``<folder>/<application id>`` under the shared folder the cluster
    names: ``spark.checkpoint.dir``, or what ``SparkContext.setCheckpointDir``
    was given.  Only a local session without either gets a private folder; on
    a cluster that is an error, since a folder of one machine is none of the
    others'.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or _context_checkpoint_dir(spark)
    if not base:
        if not spark.conf.get("spark.master", "local").split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        if "dir" not in _LOCAL_FALLBACK:
            _LOCAL_FALLBACK["dir"] = tempfile.mkdtemp(prefix="roadtrace-ckpt-",
                                                      dir=os.environ.get("TMPDIR", "/tmp"))
        base = _LOCAL_FALLBACK["dir"]
    return f"{base.rstrip('/')}/{app_id(spark)}"


def _context_checkpoint_dir(spark: SparkSession) -> str | None:
    """``SparkContext.getCheckpointDir`` without the folder it adds per context."""
    found = spark.sparkContext.getCheckpointDir()
    return found.rsplit("/", 1)[0] if found else None


_LOCAL_FALLBACK: dict[str, str] = {}
