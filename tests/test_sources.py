"""CSV source (S1), report sink (S4/S8), stage materialisation (S5), streaming ingest."""

import os
import tempfile

from roadtrace.operators import quality as q
from roadtrace.schema import SIGHTING
from roadtrace.sources.files import csv_options, export_plate_trace, read_sightings_csv
from roadtrace.sources.stages import materialize, write_parquet
from roadtrace.streaming.ingest import append_new, read_table, start_ingest

CSV = """1;5;1.0;2016-01-01 10:00:00;I
1;5;1.0;2016-01-01 10:00:00;I
2;6;2.0;2016-01-01 10:05:00;?
"""


def _folder(content: str) -> str:
    d = tempfile.mkdtemp(prefix="roadtrace-test-")
    with open(os.path.join(d, "part-0.csv"), "w") as f:
        f.write(content)
    return d


def test_read_sightings_csv_is_a_set(spark):
    df = read_sightings_csv(spark, _folder(CSV))
    assert df.count() == 2
    assert dict(df.dtypes)["ts"] == "timestamp_ntz"


def test_failfast_on_malformed(spark):
    import pytest
    df = read_sightings_csv(spark, _folder("x;5;1.0;2016-01-01 10:00:00;I\n"))
    with pytest.raises(Exception):
        df.collect()


def test_plate_trace_export(spark):
    df = read_sightings_csv(spark, _folder(CSV))
    out = os.path.join(tempfile.mkdtemp(prefix="roadtrace-test-"), "trace")
    export_plate_trace(q.plate_trace(df, 1), out)
    back = spark.read.option("header", True).csv(out)
    assert back.count() == 1


def test_plate_trace_is_in_time_order_in_one_file(spark):
    rows = "".join(f"1;{g};1.0;2016-01-{d:02d} 10:00:00;I\n" for d, g in ((9, 3), (2, 7), (30, 1), (2, 4)))
    out = os.path.join(tempfile.mkdtemp(prefix="roadtrace-test-"), "trace")
    trace = q.plate_trace(read_sightings_csv(spark, _folder(rows)), 1)
    assert [(r.ts.day, r.gate) for r in trace.collect()] == [(2, 4), (2, 7), (9, 3), (30, 1)]
    export_plate_trace(trace, out, single_file=True)
    parts = [f for f in os.listdir(out) if f.endswith(".csv")]
    with open(os.path.join(out, parts[0])) as f:
        assert len(parts) == 1 and [x.split(",")[1] for x in f.read().split()[1:] if "," in x] == ["4", "7", "3", "1"]


def test_stage_written_once(spark):
    calls = []

    def build():
        calls.append(1)
        return spark.range(5)
    a = materialize(spark, "unit", ("k",), build)
    b = materialize(spark, "unit", ("k",), build)
    assert a.count() == b.count() == 5 and len(calls) == 1


def test_streaming_ingest_dedups(spark):
    src = _folder(CSV)
    base = tempfile.mkdtemp(prefix="roadtrace-test-")
    table, ckpt = os.path.join(base, "table"), os.path.join(base, "ckpt")
    qy = start_ingest(spark, src, table, ckpt)
    qy.awaitTermination(120)
    assert read_table(spark, table).count() == 2
    # a second file with a duplicate and a new row: only the new row is added
    with open(os.path.join(src, "part-1.csv"), "w") as f:
        f.write("1;5;1.0;2016-01-01 10:00:00;I\n3;7;1.0;2016-01-01 10:10:00;CH\n")
    qy = start_ingest(spark, src, table, ckpt)
    qy.awaitTermination(120)
    assert read_table(spark, table).count() == 3


def test_streaming_ingest_keeps_late_rows_and_repeated_batches(spark):
    src, base = tempfile.mkdtemp(prefix="roadtrace-test-"), tempfile.mkdtemp(prefix="roadtrace-test-")
    table, ckpt = os.path.join(base, "table"), os.path.join(base, "ckpt")
    # days 10, 12, 2: the last row is older than anything before it, and new
    for i, day in enumerate(("10", "12", "02")):
        with open(os.path.join(src, f"part-{i}.csv"), "w") as f:
            f.write(f"1;5;1.0;2016-01-{day} 10:00:00;I\n1;5;;2016-01-{day} 10:00:00;\n")
        start_ingest(spark, src, table, ckpt).awaitTermination(120)
    batch = spark.read.schema(SIGHTING).options(**csv_options()).csv(src)
    assert read_table(spark, table).count() == batch.distinct().count() == 6
    assert read_table(spark, table).exceptAll(batch.distinct()).count() == 0
    # a batch that runs again (or comes again under a new id) adds nothing
    append_new(batch, 2, table)
    append_new(batch, 7, table)
    assert read_table(spark, table).count() == 6


def test_parquet_sink(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="roadtrace-test-"), "t")
    write_parquet(spark.range(5), path)
    write_parquet(spark.range(3), path)
    assert spark.read.parquet(path).count() == 3


def test_drop_stages(spark):
    from roadtrace.session import app_id
    from roadtrace.sources import stages

    materialize(spark, "dropped", ("k",), lambda: spark.range(3))
    path = materialize(spark, "dropped", ("k",), None).inputFiles()[0].rsplit("/", 1)[0]
    assert app_id(spark) in path and stages.exists(spark, path)
    stages.drop_stages(spark)
    assert not stages.exists(spark, path)
    # a stage asked for again is built again
    assert materialize(spark, "dropped", ("k",), lambda: spark.range(3)).count() == 3


def test_stage_reuse_across_applications(spark):
    import uuid

    from roadtrace.sources import stages
    calls = []

    def build():
        calls.append(1)
        return spark.range(7)
    key = (uuid.uuid4().hex,)
    assert stages.materialize(spark, "reuse", key, build, reuse_existing=True).count() == 7
    stages._WRITTEN.clear()               # as a new application would start
    assert stages.materialize(spark, "reuse", key, build, reuse_existing=True).count() == 7
    assert len(calls) == 1
