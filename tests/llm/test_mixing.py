"""Mixing: targets by repeated resharing, exact budgets, prefix order, epochs."""

import re
from collections import defaultdict

import pyarrow.parquet as pq
import pytest

from roadtrace.llm import mixing, queries

DOCS = "doc_id long, source string, text string"


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(sizes):
    """Share by weight, stop at twice the size, share the excess anew, until none is above."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, stopped = 1.5 * sum(sizes.values()), {}
    while True:
        left, free = total - sum(stopped.values()), [s for s in order if s not in stopped]
        shares = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s: 2.0 * sizes[s] for s in free if shares[s] >= 2 * sizes[s]}
        if not above:
            return stopped | shares
        stopped |= above


def check(rows, got):
    sizes = defaultdict(int)
    for _, s, t in rows:
        sizes[s] += size(t)
    want = brute_targets(sizes)
    taken = defaultdict(int)
    for r in got:
        assert r.target == pytest.approx(want[r.source], rel=1e-12) and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert taken[s] == int(want[s] + 0.5)


@pytest.mark.parametrize("range_rows", [2048, 7])
def test_documents_of_the_test_table(spark, monkeypatch, range_rows):
    monkeypatch.setattr(mixing, "RANGE_ROWS", range_rows)
    sf = "/root/testdata/sf0.01"
    docs = pq.read_table(f"{sf}/documents.parquet").to_pylist()
    df = spark.read.parquet(f"{sf}/documents.parquet")
    got = mixing.mix(df, keep=["doc_id", "source"]).collect()
    assert sorted((r.doc_id, r.size) for r in got) == sorted((d["doc_id"], size(d["text"])) for d in docs)
    check([(d["doc_id"], d["source"], d["text"]) for d in docs], got)
    again = queries.QUERIES["op7_mix_sources"](spark, sf).collect()
    # the ranges and the partitioning change nothing: the order is the key's
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in got)


def test_partial_epoch_is_a_prefix_of_the_key_order(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    key = mixing.F.xxhash64(mixing.F.lit(mixing.SEED), "doc_id", mixing.text_key(mixing.F.col("text")))
    rows = mixing.mix(df).withColumn("u", mixing.F.shiftrightunsigned(key, 1)).collect()
    for s in {r.source for r in rows}:
        more = [r.taken - r.epochs * r.size for r in sorted((r for r in rows if r.source == s and r["size"]), key=lambda r: r.u)]
        whole = [r["size"] for r in sorted((r for r in rows if r.source == s and r["size"]), key=lambda r: r.u)]
        cut = next((i for i, (m, w) in enumerate(zip(more, whole)) if m < w), len(more))
        assert all(m == 0 for m in more[cut + 1:])


def test_defined_cases_and_copies(spark):
    rows = [(1, "a", "one two three"), (1, "a", "one two three"), (2, None, "x y"), (3, "", "q"), (None, "b", "w " * 40),
            (4, "b", None), (5, "c", ""), (6, "c", " \t"), (7, "Z", "z " * 30 + "end"), (8, "é", "u v w"), (9, "b", "m n")]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "0 AS size", "'x' AS taken", "1 AS src", "2 AS u", "3 AS range")
    mixed = mixing.mix(df)
    got = mixed.collect()
    assert len(got) == len(rows)
    check(rows, got)
    out = mixing.copies(mixed.select("doc_id", "source", "text", "size", "epochs", "taken")).collect()
    assert sum(size(r.text) for r in out) == sum(r.taken for r in got)
    assert all(size(r.text) == r.taken for r in out)
    assert mixing.mix(spark.createDataFrame([], DOCS)).collect() == []
    empty = mixing.mix(spark.createDataFrame([(1, "a", None)], DOCS)).collect()
    assert [(r.target, r.taken) for r in empty] == [(0.0, 0)]


def test_many_sources_and_blocks_of_ranges(spark, monkeypatch):
    import random
    for name, value in (("RANGE_ROWS", 3), ("BLOCK_RANGES", 4), ("SOURCES", 50)):
        monkeypatch.setattr(mixing, name, value)
    rnd = random.Random(4)
    rows = [(i, rnd.choice([f"site{rnd.randint(0, 700)}", "hot", "hot", None, "é", "\U0001F600", "\uFFFD"]),
             " ".join(["w"] * int(rnd.paretovariate(0.7)))[:2000]) for i in range(4000)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS), keep=["doc_id", "source"]).collect()
    assert len(got) == 4000
    check(rows, got)


def test_no_window_over_all_sources(spark):
    df = spark.createDataFrame([(1, "a", "x y"), (2, "b", "z")], DOCS)
    plan = mixing.mix(df)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
