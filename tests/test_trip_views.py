"""Global trip numbers (W7) and the nested trip view."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from roadtrace.operators import trips as tr
from roadtrace.schema import SIGHTING

T0 = dt.datetime(2016, 1, 1)


@pytest.fixture(scope="module")
def trips(spark):
    rnd = random.Random(1)
    rows = {(p, rnd.randint(1, 9), 1.0, T0 + dt.timedelta(minutes=rnd.randint(0, 3000)), "I") for p in range(40)
            for _ in range(rnd.randint(1, 30))}
    # one plate with a single long trip
    rows |= {(1000, i % 9 + 1, 1.0, T0 + dt.timedelta(minutes=i), "I") for i in range(500)}
    return tr.sessionize(spark.createDataFrame(sorted(rows), SIGHTING), policy="gap").cache()


def numbered(trips):
    rows = sorted({(r.plate, r.tripid) for r in trips.collect()})
    return {x: i + 1 for i, x in enumerate(rows)}


@pytest.mark.parametrize("range_plates", [1, 7, 1000])
def test_global_numbers_are_dense_and_ordered(trips, range_plates):
    want = numbered(trips)
    for df in (trips, trips.repartition(11, "gate")):
        out = tr.global_trips(df, range_plates)
        assert {(r.plate, r.tripid): r.trip for r in out.collect()} == want
        assert out.count() == trips.count()


def test_global_numbers_never_gather_all_rows(trips):
    plan = tr.global_trips(trips, 7)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_no_trips(trips):
    assert tr.global_trips(trips.filter("plate < 0")).collect() == []
    assert tr.trip_arrays(trips.filter("plate < 0")).collect() == []


@pytest.mark.parametrize("size", [1, 3, 64, 10_000])
def test_arrays_hold_every_step_once_and_in_order(trips, size):
    nested = tr.trip_arrays(trips, size)
    assert nested.agg(F.max(F.size("path"))).first()[0] <= size
    steps = {(r.plate, r.tripid, r.step): (r.gate, r.ts) for r in tr.trip_steps(trips).collect()}
    got = {(r.plate, r.tripid, r.step): (r.gate, r.ts) for r in tr.trip_array_steps(nested).collect()}
    assert got == steps
    long = [r.chunk for r in nested.filter("plate = 1000").orderBy("chunk").collect()]
    assert long == list(range(-(-500 // size)))


@pytest.mark.parametrize("size", [1, 3, 10_000])
def test_segments_of_arrays_cross_chunk_borders(trips, size):
    want = sorted(map(tuple, tr.segments(trips).collect()))
    assert sorted(map(tuple, tr.array_segments(tr.trip_arrays(trips, size)).collect())) == want


def test_a_one_plate_table_spreads_over_its_chunks(trips):
    nested = tr.trip_arrays(trips.filter("plate = 1000"), 50)
    assert nested.count() == 10 and nested.agg(F.max(F.size("path"))).first()[0] == 50
