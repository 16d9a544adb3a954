"""Invariants of sessionization on the sf0.01 tables, and equality of the
hot-plate (time-chunked) path with the plain per-plate path."""

import pytest
from pyspark.sql import functions as F

from conftest import TESTDATA
from roadtrace.operators import trips as tr
from roadtrace.plans.pipeline import Pipeline

SF = f"{TESTDATA}/sf0.01"
COLS = ["plate", "gate", "lane", "ts", "nationality", "tripid", "step", "prev_gate", "prev_ts"]


@pytest.fixture(scope="module")
def pipe(spark):
    return Pipeline(spark, SF, materialize_stages=True)


@pytest.mark.parametrize("policy", tr.POLICIES)
def test_chunked_path_equals_plain_path(pipe, policy):
    pairs = None if policy == "gap" else pipe.network.pairs
    plain = tr.sessionize(pipe.nonnull, pairs, policy, 720)
    # every plate is hot, chunks of about 7 rows: trips cross many chunk borders
    chunked = tr.sessionize(pipe.nonnull, pairs, policy, 720, hot_threshold=7)
    a, b = plain.select(*COLS), chunked.select(*COLS)
    assert a.count() == b.count()
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_adaptive_chunks_equal_plain_path(pipe):
    pairs = pipe.network.pairs
    plain = tr.sessionize(pipe.nonnull, pairs, "documented", 720)
    adaptive = tr.sessionize(pipe.nonnull, pairs, "documented", 720, hot_threshold=20)
    hot = tr.hot_plates(pipe.nonnull, 20)
    assert hot.count() > 0
    a, b = plain.select(*COLS), adaptive.select(*COLS)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_chunk_size_does_not_matter(pipe):
    pairs = pipe.network.pairs
    a = tr.sessionize(pipe.nonnull, pairs, "as_coded", 720, hot_threshold=1)
    b = tr.sessionize(pipe.nonnull, pairs, "as_coded", 720, hot_threshold=40)
    assert a.select(*COLS).exceptAll(b.select(*COLS)).count() == 0


def test_trip_invariants(pipe):
    trips = pipe.trips_for("gap")
    n = pipe.nonnull.count()
    per_trip = trips.groupBy("plate", "tripid").agg(F.count(F.lit(1)).alias("n"), F.max("step").alias("m"))
    agg = per_trip.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("trips"),
                       F.sum(F.when(F.col("n") != F.col("m"), 1).otherwise(0)).alias("bad")).first()
    assert agg.rows == n and agg.bad == 0
    segs = tr.segments(trips).count()
    assert segs == n - agg.trips
    # trip ids are dense per plate
    dense = trips.groupBy("plate").agg(F.max("tripid").alias("mx"), F.count_distinct("tripid").alias("c"))
    assert dense.filter("mx != c").count() == 0


def test_invariant_under_input_order(spark, pipe):
    shuffled = pipe.nonnull.repartition(5).orderBy(F.rand(7))
    a = tr.sessionize(pipe.nonnull, None, "gap", 720).select(*COLS)
    b = tr.sessionize(shuffled, None, "gap", 720).select(*COLS)
    assert a.exceptAll(b).count() == 0


def test_repair_never_adds_unknowns(pipe):
    before = pipe.clean.filter("nationality = '?'").count()
    after = pipe.fixed.filter("nationality = '?'").count()
    assert after <= before


def _burst(sightings, n, instants):
    """One sighting, then n - 1 of the same plate within ``instants`` seconds."""
    rows = [(1, 1, 1.0, "2024-01-01T00:00:00", "I")]
    rows += [(1, 1 + i % 50, 1.0 + i // 50 % 25, f"2024-06-01T10:{i % instants // 60:02d}:{i % instants % 60:02d}", "I")
             for i in range(n - 1)]
    return sightings(rows)


@pytest.mark.parametrize("instants", [999, 7, 1])
def test_a_burst_is_cut_into_chunks_of_the_threshold(spark, sightings, instants):
    df = _burst(sightings, 1000, instants)
    x = tr.windowed(df, None, ("gap",), 30, tr.chunk_map(df, 100))
    sizes = [r["count"] for r in x.groupBy("_chunk", "_sub").count().collect()]
    assert sum(sizes) == df.count() and max(sizes) <= 200
    plain, cut = (tr.sessionize(df, None, "gap", 30, hot_threshold=h).select(*COLS) for h in (10_000, 100))
    assert plain.exceptAll(cut).count() == 0 and plain.count() == cut.count()
