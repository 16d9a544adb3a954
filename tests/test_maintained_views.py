"""Views kept over the ingest equal the batch queries after every batch."""

import datetime as dt
import random

import pytest

from roadtrace.operators import quality as q
from roadtrace.schema import SIGHTING, SIGHTING_COLS
from roadtrace.streaming import conflicts as cv
from roadtrace.streaming.ingest import append_new, read_table

T0 = dt.datetime(2016, 1, 1, 23, 40)


def rows(rnd, n):
    """Few keys, so that most batches make conflicts of rows that were clean."""
    out = []
    for _ in range(n):
        ts = T0 + dt.timedelta(minutes=10 * rnd.randint(0, 12))
        out.append((rnd.randint(1, 5), rnd.choice([1, 2, 3, None]), rnd.choice([1.0, 2.0]), rnd.choice([ts, ts, ts, None]),
                    rnd.choice(["I", "HR", "?", None, "TOOLONG"])))
    return out


def bag(df):
    return sorted(map(tuple, df.collect()), key=repr)


def same_as_batch(spark, table, views):
    valid = q.valid_sightings(read_table(spark, table))
    cols = ["gate", "lane", "ts", "plates"]
    assert bag(cv.read_conflicts(spark, views).select(*cols)) == bag(q.spatial_conflicts(valid).select(*cols))
    assert bag(cv.read_clean(spark, views).select(*SIGHTING_COLS)) == bag(q.remove_conflicts(valid).select(*SIGHTING_COLS))


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_to_the_batch_queries_after_every_batch(spark, tmp_path, seed):
    rnd = random.Random(seed)
    table, views = str(tmp_path / "table"), str(tmp_path / "views")
    batches = [rows(rnd, n) for n in (1, 12, 0, 30, 8)]
    retracted = 0
    for i, batch in enumerate(batches):
        df = spark.createDataFrame(batch, SIGHTING)
        for _ in range(2 if i == 3 else 1):      # a repeated batch changes nothing
            append_new(df, i, table)
            cv.maintain(spark, i, table, views)
        same_as_batch(spark, table, views)
        retracted += cv.read_changes(spark, views, i).where("sign = -1").count()
    assert retracted > 0
    # rows that are all there already: no change at all
    append_new(spark.createDataFrame(batches[3], SIGHTING), 5, table)
    cv.maintain(spark, 5, table, views)
    assert cv.read_changes(spark, views, 5).count() == 0
    same_as_batch(spark, table, views)


def test_a_batch_changes_its_keys_only(spark, tmp_path):
    table, views = str(tmp_path / "table"), str(tmp_path / "views")
    first = [(p, p, 1.0, T0, "I") for p in range(1, 20)]
    append_new(spark.createDataFrame(first, SIGHTING), 0, table)
    cv.maintain(spark, 0, table, views)
    append_new(spark.createDataFrame([(99, 7, 1.0, T0, "I")], SIGHTING), 1, table)
    cv.maintain(spark, 1, table, views)
    assert bag(cv.read_changes(spark, views, 1)) == [(7, 7, 1.0, T0, "I", -1)]
    assert [tuple(r) for r in cv.read_conflicts(spark, views).collect()] == [(7, 1.0, T0, 2)]
    # a third plate only raises the count
    append_new(spark.createDataFrame([(98, 7, 1.0, T0, "I")], SIGHTING), 2, table)
    cv.maintain(spark, 2, table, views)
    assert cv.read_changes(spark, views, 2).count() == 0
    assert cv.read_conflicts(spark, views).first().plates == 3


def test_as_a_stream(spark, tmp_path):
    rnd = random.Random(5)
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(4):
        lines = [";".join("" if x is None else x.strftime("%Y-%m-%d %H:%M:%S") if isinstance(x, dt.datetime) else str(x) for x in r)
                 for r in rows(rnd, 15)]
        (folder / f"{i}.csv").write_text("\n".join(lines) + "\n")
    table, views = str(tmp_path / "table"), str(tmp_path / "views")
    stream = cv.start_maintained_ingest(spark, str(folder), table, views, str(tmp_path / "ckpt"), max_files_per_trigger=1)
    stream.awaitTermination(120)
    assert read_table(spark, table).count() > 10
    same_as_batch(spark, table, views)


def test_a_batch_leaves_one_file_per_day(spark, tmp_path):
    """However many tasks write: otherwise files grow with tasks times days."""
    table, views = tmp_path / "table", tmp_path / "views"
    rows = [(p % 7, g, float(p % 3), T0 + dt.timedelta(days=p % 3), "I") for p in range(60) for g in range(1, 4)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for i in range(2):
            append_new(spark.createDataFrame(rows[i::2], SIGHTING), i, str(table))
            cv.maintain(spark, i, str(table), str(views))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    same_as_batch(spark, str(table), str(views))
    written = [d for kept in (table, views / "conflicts", views / "clean") for d in kept.glob("batch=*/day=*")]
    assert written and all(len(list(d.glob("*.parquet"))) == 1 for d in written)
