"""Golden values from the original map files (skipped when absent)."""

import os

import pytest
from pyspark.sql import functions as F

from conftest import REFERENCE_DATA
from roadtrace.operators import network as net
from roadtrace.sources.network import read_arcs_csv, read_gates_csv

ARCS = f"{REFERENCE_DATA}/arcs.csv"
GATES = f"{REFERENCE_DATA}/gates.csv"
REPORT_DIR = os.path.join(os.path.dirname(REFERENCE_DATA), "arcs_30m")

pytestmark = pytest.mark.skipif(not os.path.exists(ARCS), reason="original map files absent")


@pytest.fixture(scope="module")
def network(spark):
    return net.build_network(read_gates_csv(spark, GATES), read_arcs_csv(spark, ARCS))


def test_closure_size(network):
    assert network.closure.count() == 182
    assert network.closure.select("gatefrom", "gateto").distinct().count() == 182
    assert network.closure.filter("gatefrom = gateto").count() == 0
    assert net.cut_eligible_arcs(network.closure).count() == 21
    assert network.check_unique_pairs() == 0


def test_arc_frequency_report_reproduced(spark, network):
    files = [f for f in os.listdir(REPORT_DIR) if f.endswith(".csv")]
    report = (spark.read.option("header", True).option("inferSchema", True)
              .csv(os.path.join(REPORT_DIR, files[0])))
    counts = report.select(F.col("gatefrom").cast("int"), F.col("gateto").cast("int"),
                           F.col("count").cast("long"))
    ours = (net.join_arc_info(counts, network.oriented)
            .select("gatefrom", "gateto", "count", "hasEntryExit", "hasTollbooth", "hasServiceArea",
                    "posfrom", "posto", "highwayidfrom", "highwayidto"))
    theirs = report.select(*[F.col(c).cast(t) for c, t in [
        ("gatefrom", "int"), ("gateto", "int"), ("count", "long"), ("hasEntryExit", "boolean"),
        ("hasTollbooth", "boolean"), ("hasServiceArea", "boolean"), ("posfrom", "double"),
        ("posto", "double"), ("highwayidfrom", "int"), ("highwayidto", "int")]])
    assert ours.count() == theirs.count() == 729
    assert ours.exceptAll(theirs).count() == 0 and theirs.exceptAll(ours).count() == 0
