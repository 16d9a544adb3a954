"""End-to-end runs from CSV inputs (the original's two entry points)."""

import os

from conftest import TESTDATA
from roadtrace.plans.analysis import run_analysis, run_closure
from roadtrace.plans.pipeline import Pipeline
from roadtrace.sources.adapter import load_sightings
from roadtrace.operators import network as net
from roadtrace.sources.files import CSV_SEP, read_sightings_csv
from roadtrace.sources.network import read_arcs_csv, read_gates_csv, synthetic_arcs, synthetic_gates


def _inputs(spark, tmp_path):
    sightings = str(tmp_path / "sightings")
    (load_sightings(spark, f"{TESTDATA}/sf0.001")
     .selectExpr("plate", "gate", "lane", "date_format(ts, 'yyyy-MM-dd HH:mm:ss') AS ts", "nationality")
     .write.option("sep", CSV_SEP).csv(sightings))
    gates, arcs = str(tmp_path / "gates"), str(tmp_path / "arcs")
    synthetic_gates(spark).write.option("header", True).csv(gates)
    synthetic_arcs(spark).write.option("header", True).csv(arcs)
    return sightings, gates, arcs


def test_closure_entry(spark, tmp_path):
    _, _, arcs = _inputs(spark, tmp_path)
    out = str(tmp_path / "closure")
    assert run_closure(spark, arcs, out).count() == 168
    assert spark.read.option("header", True).csv(out).count() == 168


def test_analysis_entry(spark, tmp_path):
    sightings, gates, arcs = _inputs(spark, tmp_path)
    paths = run_analysis(spark, sightings, gates, arcs, str(tmp_path / "out"), algo="kmeans",
                         ks=[2, 4], cut_minutes=720, model_dir=str(tmp_path / "models"))
    assert spark.read.option("header", True).csv(paths["sweep"]).count() == 2
    assert spark.read.parquet(paths["vectorized"]).count() == 15
    assert os.path.isdir(paths["anomalies_4"])
    # the stage tables and the quality report are outputs; the stages equal the queries' ones
    p = Pipeline(spark, f"{TESTDATA}/sf0.001", cut_minutes=720, materialize_stages=True)
    for name in ("raw", "conflicts", "multinat", "fixed"):
        assert spark.read.parquet(paths[name]).exceptAll(getattr(p, name)).count() == 0
        assert spark.read.parquet(paths[name]).count() == getattr(p, name).count()
    report = {r.stage: int(r.rows) for r in spark.read.option("header", True).csv(paths["stage_counts"]).collect()}
    assert report["raw"] == p.raw.count() and report["fixed"] == p.fixed.count()
    freq = spark.read.option("header", True).csv(paths["arc_frequency"])
    assert "hasServiceArea" in freq.columns and freq.count() > 0


def test_the_sightings_file_is_read_once(spark, tmp_path):
    """Once the run has started, the input is gone and nobody misses it."""
    sightings, gates, arcs = _inputs(spark, tmp_path)
    network = net.build_network(read_gates_csv(spark, gates), read_arcs_csv(spark, arcs))
    raw = read_sightings_csv(spark, sightings, distinct=False)
    pipe = Pipeline(spark, raw=raw, network=network, cut_minutes=720, materialize_stages=True, stage_dir=str(tmp_path / "out"))
    n = pipe.raw.count()
    os.rename(sightings, sightings + "-away")
    assert pipe.vectorized.count() == 15 and pipe.multinat.count() > 0
    assert sum(r.rows for r in pipe.quality_report()["stage_counts"].collect() if r.stage == "raw") == n


def test_caller_given_rows_become_a_set(spark):
    raw = load_sightings(spark, f"{TESTDATA}/sf0.001")
    twice = Pipeline(spark, raw=raw.union(raw), network=Pipeline(spark, f"{TESTDATA}/sf0.001").network)
    assert twice.raw.count() == raw.count() and twice.clean.count() == Pipeline(spark, raw=raw, raw_is_set=True).clean.count()
