"""Physical-plan checks: the rewrites plan the way the design says."""

import contextlib
import io

import pytest

from conftest import TESTDATA
from roadtrace.operators import features as feat
from roadtrace.operators import network as net
from roadtrace.operators import quality as q
from roadtrace.operators import trips as tr
from roadtrace.plans.catalog import REGISTRY
from roadtrace.plans.pipeline import Pipeline

SF = f"{TESTDATA}/sf0.001"


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


@pytest.fixture(scope="module")
def lazy(spark):
    """Nothing written: plans reach down to the events file."""
    return Pipeline(spark, SF, cut_minutes=720)


def frames(p: Pipeline) -> dict:
    return {"enriched": p.enriched, "trips": p.trips, "plate_features": p.plate_features,
            "window_analysis": feat.window_analysis(p.nonnull, sequence=p.sequence),
            "avg_gaps": feat.avg_gaps(p.nonnull, sequence=p.sequence)}


@pytest.mark.parametrize("name", ["enriched", "trips", "plate_features", "window_analysis", "avg_gaps"])
def test_no_python_and_no_nested_loop(lazy, name):
    p = plan(frames(lazy)[name])
    assert "events.parquet" in p
    for bad in ("BatchEvalPython", "ArrowEvalPython", "BroadcastNestedLoopJoin", "CartesianProduct"):
        assert bad not in p, f"{name}: {bad}"


def test_enrichment_is_an_equi_hash_join(lazy):
    assert "BroadcastHashJoin" in plan(lazy.enriched)


def test_ingest_reads_only_needed_columns(lazy):
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,props:string>" in plan(lazy.raw)


def test_filters_reach_the_scan(spark):
    fixed = Pipeline(spark, SF, materialize_stages=True).fixed
    p = plan(q.plate_trace(fixed, 3))
    assert "PushedFilters: [IsNotNull(plate), EqualTo(plate,3)]" in p


def simple_plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="simple")
    return buf.getvalue()


@pytest.mark.parametrize("hot_threshold", [tr.HOT_PLATE_ROWS, 20])
def test_windowed_rows_are_read_and_shuffled_once(spark, hot_threshold):
    p = Pipeline(spark, SF, cut_minutes=720, hot_threshold=hot_threshold, materialize_stages=True)
    if hot_threshold == 20:
        assert p._chunks is not None
    x = simple_plan(tr.windowed(p.nonnull, p.network.pairs, tr.POLICIES, 720, p._chunks))
    assert x.count("fixed-") == 1                                    # one scan of the sightings
    assert x.count("Exchange hashpartitioning") == 1                 # one shuffle
    # stitching and every policy's trips read the windowed table without another one
    t = simple_plan(p.trips_for("gap"))
    assert "windowed-" in t and "Exchange hashpartitioning" not in t


def test_plate_features_shuffle_on_the_plate_only(spark):
    p = Pipeline(spark, SF, cut_minutes=720, materialize_stages=True)
    x = simple_plan(feat.plate_global_features(p.nonnull, sequence=p.sequence))
    assert x.count("Exchange hashpartitioning") == x.count("Exchange hashpartitioning(plate") == 1


def test_reports_are_ordered(spark):
    p = Pipeline(spark, f"{TESTDATA}/sf0.01", policy="gap", cut_minutes=720, materialize_stages=True)
    freq = [(-r["count"], r.gatefrom, r.gateto) for r in REGISTRY["arc_frequency"].build(spark, p.sf_dir).collect()]
    assert freq == sorted(freq) and len(freq) > 10
    trace = [(r.ts, r.gate, r.lane) for r in q.plate_trace(p.fixed, q.busiest_plate(p.fixed)).collect()]
    assert trace == sorted(trace) and len(trace) > 10


def test_closure_is_idempotent(spark):
    from roadtrace.sources.network import synthetic_arcs
    c = net.arc_closure(synthetic_arcs(spark))
    cc = net.arc_closure(c)
    assert c.count() == cc.count() == 168
    assert c.exceptAll(cc).count() == 0


def test_broadcast_bounds_tell_frames_apart(spark):
    from roadtrace.plans import joins
    small, large = spark.range(3), spark.range(50)
    joins.record_bound(small, 3)
    assert joins._bound(small) == 3 and joins._bound(spark.range(50)) is None

    def hinted(df, **kw):
        return "ResolvedHint (strategy=broadcast)" in joins.bounded_broadcast(df, **kw)._jdf.queryExecution().analyzed().toString()

    assert hinted(small, max_rows=10) and not hinted(large, max_rows=10) and hinted(large, max_rows=50)
    assert joins._bound(large) == 50
