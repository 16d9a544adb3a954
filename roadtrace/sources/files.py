"""File sources for raw sightings (S1) and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from roadtrace.schema import SIGHTING
from roadtrace.sources.stages import save_report_csv

# fixed values: the raw export format (headerless, ';'-separated)
CSV_SEP = ";"
CSV_TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"


def csv_options() -> dict[str, str]:
    return {"sep": CSV_SEP, "header": "false", "mode": "FAILFAST",
            "timestampNTZFormat": CSV_TIMESTAMP_FORMAT}


def read_sightings_csv(spark: SparkSession, path: str, distinct: bool = True) -> DataFrame:
    """The raw sightings export with an explicit schema; malformed rows fail the job.

    The result is a set (``distinct``), as the original ingest.
    """
    df = spark.read.schema(SIGHTING).options(**csv_options()).csv(path)
    return df.distinct() if distinct else df


def export_plate_trace(trace: DataFrame, path: str, single_file: bool = False) -> None:
    """Write a plate's ordered trace as CSV.

    A single plate can hold a large share of all sightings, so the rows keep
    their (range-sorted) partitions unless ``single_file`` asks for one file
    (for a trace known to be small, e.g. one plate in one month).
    """
    save_report_csv(trace, path, single_file=single_file)
