"""FIXTURES.md §3 counts at sf0.1, and the hot-plate path with real hot plates."""

import pytest

from conftest import TESTDATA
from roadtrace.plans.pipeline import Pipeline

SF = f"{TESTDATA}/sf0.1"


@pytest.fixture(scope="module")
def pipe(spark):
    return Pipeline(spark, SF, cut_minutes=720, materialize_stages=True)


def test_cleaning_counts(pipe):
    got = (pipe.raw.count(), pipe.valid.count(), pipe.conflicts.count(), pipe.clean.count(),
           pipe.multinat.count(), pipe.fixable.count(),
           pipe.clean.filter("nationality = '?'").count(), pipe.fixed.filter("nationality = '?'").count())
    assert got == (99992, 97849, 14759, 66306, 1123, 973, 23682, 17503)


@pytest.mark.parametrize("policy,expected", [("as_coded", (39212, 27094, 7384)),
                                             ("documented", (54156, 12150, 12150)),
                                             ("gap", (31665, 34641, 14931))])
def test_trip_counts(spark, policy, expected):
    p = Pipeline(spark, SF, policy=policy, cut_minutes=720, materialize_stages=True)
    seg = p.enriched
    got = (p.trips.filter("step = 1").count(), seg.count(), seg.filter("posfrom IS NOT NULL").count())
    assert got == expected


def test_hot_plates_take_the_chunked_path_with_equal_results(spark, pipe):
    hot = Pipeline(spark, SF, cut_minutes=720, hot_threshold=60,
                   materialize_stages=True)
    assert hot.windowed.filter("_hot").count() > 0
    a, b = pipe.trips_for("as_coded"), hot.trips_for("as_coded")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
