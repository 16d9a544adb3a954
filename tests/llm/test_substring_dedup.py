"""Substring de-duplication against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadtrace.llm import substring_dedup as sub

DOCS = "doc_id long, text string"


def brute(rows, window, leave_clean=False):
    """Rows as (id, text); a row's windows yield to smaller ids (null last) and to earlier starts in the row itself."""
    rank = lambda i: (i is None, i or 0)
    docs = [(i, t, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    least = {}
    for i, _, ws in docs:
        for s in range(len(ws) - window + 1):
            w = tuple(ws[s: s + window])
            least[w] = min(least.get(w, rank(i)), rank(i))
    out = []
    for i, t, ws in docs:
        hit, seen = set(), set()
        for s in range(len(ws) - window + 1):
            w = tuple(ws[s: s + window])
            if least[w] < rank(i) or w in seen:
                hit |= set(range(s, s + window))
            seen.add(w)
        spans = []
        for p in sorted(hit):
            if spans and spans[-1][1] == p:
                spans[-1][1] = p + 1
            else:
                spans.append([p, p + 1])
        kept = " ".join(w for p, w in enumerate(ws) if p not in hit)
        out.append((i, len(ws), [tuple(x) for x in spans], t if leave_clean and not hit else kept))
    return sorted(out, key=repr)


def found(df, window, **kw):
    return sorted(((r.doc_id, r.n_words, [(s.start, s.end) for s in r.spans], r.text)
                   for r in sub.cut_repeats(df, window, **kw).collect()), key=repr)


def corpus():
    rnd = random.Random(11)
    word = lambda: rnd.choice(["a", "b", "é", "the", "𝛼β", "x y", "c" * 9])
    shared = [" ".join(word() for _ in range(rnd.randrange(3, 30))) for _ in range(6)]
    rows = []
    for i in range(120):
        parts = [rnd.choice(shared) if rnd.random() < 0.4 else " ".join(word() for _ in range(rnd.randrange(0, 25)))
                 for _ in range(rnd.randrange(0, 5))]
        rows.append((rnd.randrange(0, 100), rnd.choice([" ", "\n", " \t "]).join(parts)))  # some ids repeat
    rows += [(None, shared[0]), (None, shared[0] + " " + shared[1]), (5, None), (6, ""), (7, " \n "), (8, "a"),
             (200, "loop " * 40), (200, "loop " * 40), (201, "loop " * 41), (-3, shared[2]), (2**62, shared[2])]
    return rows


@pytest.mark.parametrize("window", [1, 3, 8])
@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, monkeypatch, window, small):
    if small:  # many groups, buckets and pieces
        monkeypatch.setattr(sub, "GROUP_BYTES", 400)
        monkeypatch.setattr(sub, "BUCKET_WINDOWS", 50)
        monkeypatch.setattr(sub, "PIECE_BYTES", 60)
    rows = corpus()
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS id", "2 AS key", "3 AS g", "4 AS spans", "'r' AS row", "6 AS b")
    assert found(df, window) == brute(rows, window)
    assert found(df, window, leave_clean=True) == brute(rows, window, leave_clean=True)
    out = sub.cut_repeats(df, window)
    assert {"id", "key", "g", "row", "b"} <= set(out.columns) and out.select("row").distinct().collect()[0].row == "r"


@pytest.mark.parametrize("broadcast", [0, 1 << 20])
def test_rows_that_repeat_id_and_text_spread(spark, monkeypatch, broadcast):
    monkeypatch.setattr(sub, "GROUP_BYTES", 4000)
    monkeypatch.setattr(sub, "MAX_BROADCAST_ROWS", broadcast, raising=False)
    text = " ".join(f"w{i % 40}" for i in range(60))
    rows = corpus() + [(70, text)] * 300 + [(None, "a  b c")] * 200 + [(71, None)] * 150
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS id", "2 AS key", "3 AS g", "'r' AS row", "4 AS share")
    assert found(df, 3) == brute(rows, 3)
    assert found(df, 3, leave_clean=True) == brute(rows, 3, leave_clean=True)
    monkeypatch.setattr(sub, "bytes_of", lambda *_: 100_000)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = sub.cut_repeats(df, 3).where("doc_id = 70").groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(r["count"] for r in out) >= 300 and max(r["count"] for r in out) < 200


def test_empty_table(spark):
    assert sub.cut_repeats(spark.createDataFrame([], DOCS)).collect() == []


def test_long_texts_go_in_overlapping_pieces(spark):
    words = [f"w{i % 30_011}" for i in range(130_000)]  # the list repeats from word 30,011 on
    (got,) = sub.cut_repeats(spark.createDataFrame([(1, " ".join(words))], DOCS)).collect()
    assert [(s.start, s.end) for s in got.spans] == [(30_011, 130_000)] and got.text == " ".join(words[:30_011])


def test_hashes_of_a_window_do_not_depend_on_its_place():
    ws = [b"alpha", b"b", "é".encode(), b"delta"]
    other = [b"zz", b"yyy", *ws, b"x"]
    _, h, h2 = sub.window_hashes([ws, other, [*ws, *ws]], 4)
    # windows: 1 of the first, 4 of the second, 5 of the third
    assert h[0] == h[3] == h[5] == h[9] and h2[0] == h2[3] == h2[5] == h2[9]
    assert len(set(h.tolist())) == len(np.unique(h)) == 7


def test_entries_that_start_later():
    h = np.array([1, 2, 1, 1, 2, 3], np.uint64)
    ids = np.array([5, 5, 5, 4, 4, 9])
    row = np.array([0, 0, 0, 1, 1, 2])
    removed, rep = sub.later(h, ids, row)
    assert removed.tolist() == [True, True, True, False, False, False] and rep[3] == 3
    # equal ids in two rows: neither is earlier, both share one verdict
    removed, rep = sub.later(np.array([7, 7], np.uint64), np.array([1, 1]), np.array([0, 1]))
    assert removed.tolist() == [False, False] and rep.tolist() == [0, 0]


@pytest.mark.parametrize("values", [[], [0], [-(2**63), -5, 0, 7, 7, 2**40, 2**63 - 1], list(range(1000, 3000, 7))])
def test_byte_planes_round_trip(values):
    x = np.array(values, np.int64)
    assert sub.unpacked(sub.packed(x)).tolist() == values and len(sub.packed(x)) == 8 * len(values)
