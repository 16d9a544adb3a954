"""Trips kept over batches equal sessionize of all rows, in whatever order the rows come."""

import datetime as dt
import random

import pytest

from roadtrace.operators import trips as tr
from roadtrace.schema import SIGHTING
from roadtrace.streaming import trips as st

T0 = dt.datetime(2016, 1, 1, 20)
POLICIES = ("as_coded", "gap")


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame([(a, b, (a + b) % 2 == 0) for a in range(1, 5) for b in range(1, 5) if a != b],
                                 "gatefrom int, gateto int, is_cut boolean")


def rows(rnd, n):
    """Trips that cross midnights, days without a sighting, and equal instants."""
    return sorted({(rnd.randint(1, 4), rnd.randint(1, 5), 1.0, T0 + dt.timedelta(minutes=20 * rnd.randint(0, 200)), "I") for _ in range(n)})


def bag(df):
    cols = ["plate", "gate", "lane", "ts", "nationality", "tripid", "step", "prev_gate", "prev_ts"]
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)


def test_any_order_of_rows(spark, tmp_path, pairs):
    rnd = random.Random(3)
    all_rows = rows(rnd, 150)
    shuffled = rnd.sample(all_rows, len(all_rows))
    view, seen = str(tmp_path / "view"), []
    batches = [shuffled[:5], shuffled[5:70], [], shuffled[40:75], shuffled[75:]]       # the fourth mostly repeats
    for i, batch in enumerate(batches):
        seen += batch
        df = spark.createDataFrame(batch, SIGHTING)
        for _ in range(2 if i == 1 else 1):
            st.maintain(spark, df, i, view, pairs, POLICIES, 30)
        if i in (1, 4):
            whole = spark.createDataFrame(sorted(set(seen)), SIGHTING)
            for p in POLICIES:
                assert bag(st.read_trips(spark, view, p, pairs, 30, POLICIES)) == bag(tr.sessionize(whole, pairs, p, 30))


def test_only_touched_days_are_rebuilt(spark, tmp_path):
    view = str(tmp_path / "view")
    day = dt.timedelta(days=1)
    first = [(p, g, 1.0, T0 + d * day + dt.timedelta(minutes=g), "I") for p in (1, 2) for d in range(4) for g in range(1, 4)]
    st.maintain(spark, spark.createDataFrame(first, SIGHTING), 0, view, None, ("gap",), 30)
    st.maintain(spark, spark.createDataFrame([(1, 9, 1.0, T0 + day, "I"), first[0], (3, None, 1.0, T0, "I")], SIGHTING), 1, view,
                None, ("gap",), 30)
    second = spark.read.parquet(view).where("batch = 1").select("plate", "day").distinct().collect()
    assert [(r.plate, r.day) for r in second] == [(1, (T0 + day).date())]
    # nothing new: nothing is written
    st.maintain(spark, spark.createDataFrame(first, SIGHTING), 2, view, None, ("gap",), 30)
    assert spark.read.parquet(view).where("batch = 2").count() == 0


def test_a_late_row_joins_two_trips(spark, tmp_path):
    view = str(tmp_path / "view")
    at = [T0 + dt.timedelta(minutes=m) for m in (0, 50, 25, 500)]
    read = lambda: [r.tripid for r in st.read_trips(spark, view, "gap", None, 30, ("gap",)).orderBy("ts").collect()]
    st.maintain(spark, spark.createDataFrame([(1, 1, 1.0, at[0], "I"), (1, 2, 1.0, at[1], "I"), (1, 4, 1.0, at[3], "I")], SIGHTING), 0,
                view, None, ("gap",), 30)
    assert read() == [1, 2, 3]
    st.maintain(spark, spark.createDataFrame([(1, 3, 1.0, at[2], "I")], SIGHTING), 1, view, None, ("gap",), 30)
    assert read() == [1, 1, 1, 2]


def test_as_a_stream(spark, tmp_path):
    rnd = random.Random(8)
    all_rows = rows(rnd, 60)
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(3):
        lines = [";".join(x.strftime("%Y-%m-%d %H:%M:%S") if isinstance(x, dt.datetime) else str(x) for x in r) for r in all_rows[2 - i::3]]
        (folder / f"{i}.csv").write_text("\n".join(lines) + "\n")
    view = str(tmp_path / "view")
    st.start_trips(spark, str(folder), view, str(tmp_path / "ckpt"), max_files_per_trigger=1).awaitTermination(180)
    want = tr.sessionize(spark.createDataFrame(all_rows, SIGHTING), None, "gap", 30)
    assert bag(st.read_trips(spark, view, "gap", None, 30, ("gap",))) == bag(want)
