"""Hash-prefix forest: parts against plain loops, the search against brute force."""

import math
import random

import numpy as np
import pytest

from roadtrace.llm import forest, queries

VECTORS = "vec_id long, embedding array<float>"


def sound(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)


def cosine(a, b):
    a, b = (np.asarray(x, np.float64) for x in (a, b))
    return float(a @ b / math.sqrt(a @ a) / math.sqrt(b @ b))


def brute(rows, k=5):
    """{(row number, query id): [(score, id)]} of the k nearest."""
    ok = [(n, i, v) for n, (i, v) in enumerate(rows) if sound(v)]
    out = {}
    for n, q, qv in ok:
        if q is not None and q % 50 == 0:
            near = sorted((-round(cosine(qv, cv), 12), c is None, c or 0, c) for m, c, cv in ok if m != n and len(cv) == len(qv))
            out[n, q] = [(-x[0], x[3]) for x in near[:k]]
    return out


def found(df, **kw):
    return sorted(((r.query_id, r["rank"], r.id, round(round(r.score, 12), 9)) for r in
                   forest.nearest(df, lambda i: i % 50 == 0, **kw).collect()), key=repr)


def flat(truth):
    return sorted(((q, r + 1, i, round(s, 9)) for (_, q), near in truth.items() for r, (s, i) in enumerate(near)), key=repr)


def small(monkeypatch):
    for name, value in (("BLOCK", 40), ("QUERIES", 3), ("SAMPLE", 10)):
        monkeypatch.setattr(forest, name, value)


def clustered(rnd, n, dim, spread=0.3):
    centres = [[rnd.gauss(0, 1) for _ in range(dim)] for _ in range(12)]
    return [(i, [float(np.float32(x + rnd.gauss(0, spread))) for x in rnd.choice(centres)]) for i in range(n)]


@pytest.mark.parametrize("dim", [2, 5, 33])
def test_all_candidates_give_the_exact_neighbours(spark, monkeypatch, dim):
    small(monkeypatch)
    rnd = random.Random(dim)
    rows = clustered(rnd, 400, dim)
    rows += [(1000 + i, rows[7][1]) for i in range(60)]          # copies, some of them queries
    df = spark.createDataFrame(rows, VECTORS)
    # more than all entries: every ascent ends at the root
    assert found(df, candidates=10**6, trees=3) == flat(brute(rows))


def test_recall_is_learnt_and_reached(spark, monkeypatch):
    small(monkeypatch)
    monkeypatch.setattr(forest, "SAMPLE", 40)
    rnd = random.Random(1)
    rows = clustered(rnd, 3000, 24)
    truth = brute(rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")    # cells meet across many partitions
    try:
        met = {(q, i) for q, _, i, _ in found(spark.createDataFrame(rows, VECTORS))}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = {(q, i) for (_, q), near in truth.items() for _, i in near}
    assert len(met & want) >= 0.9 * len(want)


def test_recall_of_the_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    truth = brute(rows)
    got = queries.QUERIES["op11_nearest"](spark, sf).collect()
    of = dict(rows)
    assert all(abs(r.score - cosine(of[r.query_id], of[r.vec_id])) < 1e-9 for r in got)
    want = {(q, i) for (_, q), near in truth.items() for _, i in near}
    assert len({(r.query_id, r.vec_id) for r in got} & want) >= 0.9 * len(want)
    by_query = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by_query.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    assert set(by_query) == {q for _, q in truth} and all(len(x) == 5 and x == sorted(x) for x in by_query.values())


def test_candidates_are_those_of_a_synchronous_ascent(spark, monkeypatch):
    small(monkeypatch)
    rnd = random.Random(4)
    rows = clustered(rnd, 500, 8)
    x = np.array([v for _, v in rows])
    trees, wanted, k = 4, 60, 500
    strings = forest.hash_strings(x, trees)
    want = {}
    for q in range(0, 500, 50):
        shared = forest.shared_prefix(strings[q][None, :], strings)
        depth = next(d for d in range(64, -1, -1) if (shared >= d).sum() >= wanted or d == 0)
        want[q] = {int(i) for i in np.flatnonzero((shared >= depth).any(axis=1)) if i != q}
    got = {}
    for q, _, i, _ in found(spark.createDataFrame(rows, VECTORS), candidates=wanted, trees=trees, k=k):
        got.setdefault(q, set()).add(i)
    assert got == want


def test_defined_cases(spark, monkeypatch):
    small(monkeypatch)
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (50, [0.5, nan]), (100, None), (150, [inf, 1.0]), (200, [1.0, None]), (250, []),
            (1, [0.0, 0.0]), (300, [3.0]), (2, [2.0, 2.0]), (None, [2.0, 2.0]), (None, [9.0, 8.0]), (350, [1e30, 1.0]),
            (3, [-1.0, -1.0]), (400, [1.0, 1.0, 1.0]), (4, [1e-30, 3e-30]), (450, [-0.0, 1.0]), (5, [0.0, 1.0])]
    rows = [(i, v and [x and float(np.float32(x)) for x in v]) for i, v in rows]
    df = spark.createDataFrame(rows, VECTORS).selectExpr("*", "1 AS v", "2 AS class", "3 AS dim", "4 AS rank", "5 AS score", "6 AS id")
    assert found(df, candidates=10**6) == flat(brute(rows))
    assert found(df) and found(spark.createDataFrame([], VECTORS)) == []
    assert found(spark.createDataFrame([(1, [1.0])], VECTORS)) == []


def test_prefixes_and_ranges():
    rnd = np.random.default_rng(2)
    a = rnd.integers(0, 2**64, 300, dtype=np.uint64)
    flip = rnd.integers(0, 65, 300)
    b = a.copy()
    for i, f in enumerate(flip):
        if f < 64:
            b[i] ^= (np.uint64(1) << np.uint64(63 - f)) | (rnd.integers(0, 2**62, dtype=np.uint64) >> np.uint64(f) if f else np.uint64(0)) & (
                (np.uint64(1) << np.uint64(63 - f)) - np.uint64(1))
    assert (forest.shared_prefix(a, b) == flip).all()
    for d in (0, 1, 31, 63, 64):
        lo, hi = forest.prefix_range(a, np.full(300, d))
        for x, l, h in zip(a.tolist(), lo.tolist(), hi.tolist()):
            assert l == (x >> (64 - d) << (64 - d)) and h == l + (1 << (64 - d)) - 1
    assert (forest.as_string(forest.in_order(a)) == a).all()
    assert (np.argsort(forest.in_order(a)) == np.argsort(a)).all()


def test_recall_counts_equal_scores(spark):
    t = spark.createDataFrame([(0, 1, 0.9), (0, 2, 0.8), (50, 1, 0.5)], "query_id long, id long, score double")
    f = spark.createDataFrame([(0, 3, 0.8), (0, 1, 0.9)], "query_id long, id long, score double")
    assert forest.recall_of(f, t) == pytest.approx(2 / 3)
