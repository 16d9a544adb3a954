"""Explicit schemas (no inference on ingest)."""

from pyspark.sql import types as T

# Raw sighting: one plate read at one gate/lane at one instant.
SIGHTING = T.StructType([
    T.StructField("plate", T.IntegerType()),
    T.StructField("gate", T.IntegerType()),
    T.StructField("lane", T.DoubleType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("nationality", T.StringType()),
])

SIGHTING_COLS = [f.name for f in SIGHTING.fields]

# Gate (network vertex): position in km along its highway.
GATE = T.StructType([
    T.StructField("gateid", T.IntegerType()),
    T.StructField("pos", T.DoubleType()),
    T.StructField("highwayid", T.IntegerType()),
])

# Arc (network edge) with its three properties.
ARC = T.StructType([
    T.StructField("gatefrom", T.IntegerType()),
    T.StructField("gateto", T.IntegerType()),
    T.StructField("hasEntryExit", T.BooleanType()),
    T.StructField("hasTollbooth", T.BooleanType()),
    T.StructField("hasServiceArea", T.BooleanType()),
])

ARC_FLAGS = ["hasEntryExit", "hasTollbooth", "hasServiceArea"]

# Total order of a plate's sightings (ties on the instant are broken by the
# remaining columns so that every engine sees the same sequence).
SEQUENCE_ORDER = ["ts", "gate", "lane", "nationality"]
