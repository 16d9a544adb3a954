"""Per-day state: any union of days equals the features of those days' rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from roadtrace.operators import daily
from roadtrace.operators import features as feat
from roadtrace.operators import trips as tr
from roadtrace.schema import SIGHTING

T0 = dt.datetime(2016, 2, 27, 21)


@pytest.fixture(scope="module")
def sequence(spark):
    rnd = random.Random(6)
    rows = {(p, rnd.randint(1, 6), float(rnd.randint(1, 3)), T0 + dt.timedelta(minutes=15 * rnd.randint(0, 500)), rnd.choice("IH?"))
            for p in range(6) for _ in range(rnd.randint(1, 60))}
    return tr.previous_sighting(spark.createDataFrame(sorted(rows), SIGHTING)).cache()


def bag(df, cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)


def all_days(sequence):
    return sorted(r.d for r in sequence.select(F.to_date("ts").alias("d")).distinct().collect())


def test_any_union_of_days(spark, sequence, tmp_path):
    path = str(tmp_path / "days")
    daily.write_days(daily.plate_days(sequence), path)
    days, rnd = all_days(sequence), random.Random(1)
    for chosen in (days, days[:1], days[::2], rnd.sample(days, 3)):
        rows = sequence.where(F.to_date("ts").isin(chosen)).drop("prev_gate", "prev_ts", "tripid", "step")
        want = feat.plate_global_features(rows)
        got = daily.merged_global_features(daily.read_days(spark, path, chosen))
        assert sorted(got.columns) == sorted(want.columns) and bag(got, want.columns) == bag(want, want.columns)


def test_a_day_is_replaced_alone(spark, sequence, tmp_path):
    path = str(tmp_path / "days")
    state = daily.plate_days(sequence)
    days = all_days(sequence)
    daily.write_days(state.where(F.col("day") != F.lit(days[2])), path)
    files = {f.name: f.stat().st_mtime_ns for f in (tmp_path / "days").glob("day=*/*.parquet")}
    daily.write_days(state.where(F.col("day") == F.lit(days[2])), path)      # the day that was missing
    daily.write_days(state.where(F.col("day") == F.lit(days[2])), path)      # and once more
    after = {f.name: f.stat().st_mtime_ns for f in (tmp_path / "days").glob("day=*/*.parquet")}
    assert files.items() <= after.items()
    cols = feat.plate_global_features(sequence.select(*SIGHTING.names), sequence).columns
    assert bag(daily.merged_global_features(daily.read_days(spark, path)), cols) == bag(
        feat.plate_global_features(sequence.select(*SIGHTING.names), sequence), cols)


def test_trip_statistics_of_days(spark):
    rnd = random.Random(2)
    rows = [(p, t, T0 + dt.timedelta(hours=20 * t + 3 * i), float(rnd.randint(0, 9)), float(rnd.choice([0, 0, 1, 2])), rnd.random() < 0.5)
            for p in range(4) for t in range(1, 9) for i in range(rnd.randint(1, 4))]
    seg = spark.createDataFrame(rows, "plate int, tripid long, tstart timestamp_ntz, segmentDist double, segmentDuration double, "
                                      "hasServiceArea boolean")
    state = daily.plate_day_trips(seg).cache()
    started = seg.groupBy("plate", "tripid").agg(F.to_date(F.min("tstart")).alias("day"))
    stats = feat.trip_stats(seg).join(started, ["plate", "tripid"])
    days = sorted(r.day for r in state.select("day").distinct().collect())
    for chosen in (days, days[:2], days[1::2]):
        want = feat.plate_trip_summary(stats.where(F.col("day").isin(chosen)))
        got = daily.merged_trip_summary(state.where(F.col("day").isin(chosen)))
        a, b = bag(got, want.columns), bag(want, want.columns)
        assert len(a) == len(b) and all(x == pytest.approx(y, nan_ok=True) if x is not None else y is None
                                        for r, q in zip(a, b) for x, y in zip(r, q))


def test_no_days(spark, sequence, tmp_path):
    path = str(tmp_path / "days")
    daily.write_days(daily.plate_days(sequence), path)
    assert daily.merged_global_features(daily.read_days(spark, path, [])).count() == 0
