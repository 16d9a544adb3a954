"""Adapter from the generic ``events`` table to sightings.

The test tables carry no number-plate data, so sightings are derived from
``events`` deterministically (one sighting per event, de-duplicated).  The
mapping is part of the test contract and has to be the same in the DuckDB
oracle (see ``roadtrace.plans.oracle``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadtrace.functions.time import bucket_ntz

# Fixed values of the events -> sightings mapping (test contract).
NUM_GATES = 28          # gate = k % 28 + 1
NUM_LANES = 3           # lane = event_id % 3 + 1
BUCKET_SECONDS = 900    # sighting instants are 15-minute buckets
NAT_NULL_EVERY = 97     # event_id % 97 = 0  -> NULL nationality
NAT_LONG_EVERY = 89     # event_id % 89 = 0  -> 'LONG' (invalid, > 3 chars)
NAT_UNKNOWN_EVERY = 7   # event_id % 7 = 0   -> '?'
# then: user_id % 10 = 0 and even event_id -> 'HR'; user_id % 4 = 0 -> 'I';
#       user_id % 4 = 1 -> 'RO'; user_id % 4 = 2 -> 'CH'; otherwise '?'


def _nationality(event_id: Column, user_id: Column) -> Column:
    return (F.when(event_id % NAT_NULL_EVERY == 0, F.lit(None).cast("string"))
            .when(event_id % NAT_LONG_EVERY == 0, F.lit("LONG"))
            .when(event_id % NAT_UNKNOWN_EVERY == 0, F.lit("?"))
            .when((user_id % 10 == 0) & (event_id % 2 == 0), F.lit("HR"))
            .when(user_id % 4 == 0, F.lit("I"))
            .when(user_id % 4 == 1, F.lit("RO"))
            .when(user_id % 4 == 2, F.lit("CH"))
            .otherwise(F.lit("?")))


def events_to_sightings(events: DataFrame, distinct: bool = True) -> DataFrame:
    """``events`` -> ``plate, gate, lane, ts, nationality`` (S1 semantics: a set)."""
    e = events.select("event_id", "ts", "user_id", "props")
    out = e.select(
        F.col("user_id").cast("int").alias("plate"),
        (F.get_json_object("props", "$.k").cast("int") % NUM_GATES + 1).alias("gate"),
        (F.col("event_id") % NUM_LANES + 1).cast("double").alias("lane"),
        bucket_ntz(F.col("ts"), BUCKET_SECONDS).alias("ts"),
        _nationality(F.col("event_id"), F.col("user_id")).alias("nationality"),
    )
    return out.distinct() if distinct else out


def load_sightings(spark, sf_dir: str, distinct: bool = True) -> DataFrame:
    """Read ``events`` under ``sf_dir`` and adapt it (only the 4 needed columns are scanned)."""
    return events_to_sightings(spark.read.parquet(f"{sf_dir}/events.parquet"), distinct)
