"""Road-network dimensions: gates (vertices) and arcs (edges).

Two sources:

* ``read_gates_csv`` / ``read_arcs_csv`` (S2): header CSV files with an
  explicit schema, e.g. a real highway map.
* ``synthetic_gates`` / ``synthetic_arcs``: the network used with the test
  tables, generated by Spark from a rule (``spark.range``), identical to the
  inline ``VALUES``/``range`` the DuckDB oracle builds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadtrace.schema import ARC, GATE

# Fixed values of the synthetic network (test contract):
#   gates g = 1..28: pos = round(4.5*g + (g % 3)*0.7, 1) km, highwayid = floor((g-1)/9) + 1
#   arcs g -> g+1 for g = 1..27 except g % 9 = 0:
#       hasEntryExit = g % 4 <> 0, hasTollbooth = g % 7 = 0, hasServiceArea = g % 5 = 0
#   extra arcs: 5 -> 20 (true, false, true) and 14 -> 24 (true, false, false)
SYN_GATES = 28
SYN_HIGHWAY_LEN = 9
SYN_EXTRA_ARCS = [(5, 20, True, False, True), (14, 24, True, False, False)]


def read_gates_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GATE).option("header", True).csv(path)


def read_arcs_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ARC).option("header", True).csv(path)


def synthetic_gates(spark: SparkSession) -> DataFrame:
    g = F.col("id")
    return spark.range(1, SYN_GATES + 1).select(
        g.cast("int").alias("gateid"),
        # decimal arithmetic, then double: same digits as the oracle
        F.round(F.lit(4.5).cast("decimal(2,1)") * g
                + (g % 3) * F.lit(0.7).cast("decimal(2,1)"), 1).cast("double").alias("pos"),
        (F.floor((g - 1) / SYN_HIGHWAY_LEN) + 1).cast("int").alias("highwayid"),
    )


def synthetic_arcs(spark: SparkSession) -> DataFrame:
    g = F.col("id")
    chain = (spark.range(1, SYN_GATES)
             .filter(g % SYN_HIGHWAY_LEN != 0)
             .select(g.cast("int").alias("gatefrom"),
                     (g + 1).cast("int").alias("gateto"),
                     (g % 4 != 0).alias("hasEntryExit"),
                     (g % 7 == 0).alias("hasTollbooth"),
                     (g % 5 == 0).alias("hasServiceArea")))
    extra = spark.range(1).select(F.inline(F.array(*[
        F.struct(*[F.lit(x).cast(f.dataType).alias(f.name) for x, f in zip(arc, ARC.fields)]) for arc in SYN_EXTRA_ARCS])))
    return chain.unionByName(extra)
