"""Benchmark decontamination against brute force on small texts."""

import re

import pytest

from roadtrace.llm import decontaminate, queries

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, window):
    out = []
    for i, text in docs:
        ws, hit, found = words(text), set(), set()
        for item, t in items:
            its = words(t)
            if item is None or not its:
                continue
            n = min(window, len(its))
            for a in range(len(its) - n + 1):
                for s in range(len(ws) - n + 1):
                    if ws[s: s + n] == its[a: a + n]:
                        hit |= set(range(s, s + n))
                        found.add(str(item))
        out.append((i, len(ws), len(hit), sorted(found)))
    return sorted(out, key=repr)


CASES = [
    (1, "a b c d e f"), (2, "x A-b!c D y a b c d e"), (3, "nothing here"), (4, None), (5, ""), (6, "... !!"),
    (7, "été Été ÉTÉ a"), (7, "one two"), (None, "two one two three four five six"), (8, "a b c d e f"),
    (9, "a a a a a a a a"), (9, "a a a a a a a a"), (10, "solo"), (11, "b c d e " * 50), (12, "q r"), (12, "r q r s"),
]
BENCH = [(1, "a b c d e f g"), (2, "solo"), (3, "one two"), (10, "two three four five six"), (4, "a a a a"), (4, "a a a a a"),
         (5, None), (6, ""), (None, "b c d e"), (7, "Q R"), (8, "a b c d"), (9, "été été"), (11, "ÉtÉ a")]


@pytest.mark.parametrize("window", [4, 2, 10])
@pytest.mark.parametrize("broadcast_rows", [200_000, 0])
def test_against_brute_force(spark, monkeypatch, window, broadcast_rows):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", broadcast_rows)
    docs = spark.createDataFrame(CASES, DOCS).selectExpr("*", "1 AS ws", "2 AS w", "3 AS n_hit", "4 AS key")
    items = spark.createDataFrame(BENCH, ITEMS).selectExpr("*", "1 AS item", "2 AS n")
    got = [(r.id, r.n_words, r.n_hit, r["items"]) for r in decontaminate.contaminated_words(docs, items, window).collect()]
    assert sorted(got, key=repr) == brute(CASES, BENCH, window)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert decontaminate.contaminated_words(docs, spark.createDataFrame(BENCH, ITEMS)).collect() == []
    got = decontaminate.contaminated_words(spark.createDataFrame(CASES, DOCS), items).collect()
    assert len(got) == len(CASES) and all(r.n_hit == 0 and r["items"] == [] for r in got)


def test_no_python_on_the_main_path(spark):
    plan = queries.QUERIES["op3_decontaminate"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
