"""Randomised check: the hot-plate (time-chunked) sessionization equals the
plain per-plate one on small random inputs, for every policy."""

import datetime as dt

import pytest

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from roadtrace.operators import network as net
from roadtrace.operators import trips as tr
from roadtrace.schema import ARC, SIGHTING

BASE = dt.datetime(2024, 1, 1)
COLS = ["plate", "gate", "lane", "ts", "nationality", "tripid", "step", "prev_gate", "prev_ts"]

rows = st.lists(
    st.tuples(st.integers(1, 3), st.integers(1, 6), st.integers(1, 2),
              st.integers(0, 8 * 60).map(lambda m: m - m % 5),   # minutes, ties likely
              st.sampled_from(["I", "?"])),
    min_size=1, max_size=40)


@pytest.fixture(scope="module")
def pairs(spark):
    arcs = spark.createDataFrame([(1, 2, True, False, False), (2, 3, True, False, True),
                                  (3, 4, False, True, False), (5, 6, True, False, False)], ARC)
    return net.closure_pairs(net.arc_closure(arcs))


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=rows, policy=st.sampled_from((*tr.POLICIES, "none")), chunk=st.sampled_from([1, 2, 5, 13]))
def test_chunked_equals_plain(spark, pairs, rows, policy, chunk):
    df = spark.createDataFrame(
        [(p, g, float(l), BASE + dt.timedelta(minutes=m), n) for p, g, l, m, n in rows], SIGHTING)
    # "none" is the never-splitting rule behind previous_sighting
    plain = tr.sessionize(df, pairs, policy, cut_minutes=30).select(*COLS)
    chunked = tr.sessionize(df, pairs, policy, cut_minutes=30, hot_threshold=chunk).select(*COLS)
    a = sorted(map(tuple, plain.collect()), key=repr)
    b = sorted(map(tuple, chunked.collect()), key=repr)
    assert a == b
