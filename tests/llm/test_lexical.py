"""Ranked lexical search against brute force."""

import math
import random
import re
from collections import Counter

import pytest

from roadtrace.llm import lexical

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=20):
    bags = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(n > 0 for _, _, n in bags), sum(n for _, _, n in bags)
    df = Counter(t for _, bag, _ in bags for t in bag)
    out = []
    for item, text in items:
        scored, asked = [], Counter(terms(text))
        for i, bag, n in bags:
            if not n:
                continue
            m = 75 + (25 * n * n_docs) // n_terms
            s = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    * ((10**9 * bag[t]) // (1000 * bag[t] + 12 * m)) for t, times in asked.items() if t in bag)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def found(spark, docs, items, k=20):
    out = lexical.ranked(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), k)
    return sorted((tuple(r) for r in out.select("item_id", "rank", "id", "score").collect()), key=repr)


def corpus(rnd, n):
    vocabulary = [f"w{i}" for i in range(60)] + ["Été", "日本", "THE", "the", "e-mail"]
    freq = [1 / (1 + i % 30) for i in range(len(vocabulary))]
    return [(i, " ".join(rnd.choices(vocabulary, freq, k=rnd.randint(1, 40)))) for i in range(n)]


@pytest.mark.parametrize("k", [1, 3, 20])
def test_against_brute_force(spark, monkeypatch, k):
    monkeypatch.setattr(lexical, "BLOCK", 7)
    monkeypatch.setattr(lexical, "PIECE_BYTES", 16)
    rnd = random.Random(k)
    docs = corpus(rnd, 250)
    # large classes: the same bag in other orders, under ids that are spread
    docs += [(1000 + 7 * i % 500, "w1 w2 w3 unheard") for i in range(120)] + [(2000 + i, "w3 other w2 w1") for i in range(60)]
    items = corpus(rnd, 25) + [(100, "w1 w1 w1 w2"), (101, "nowhere"), (102, "The, THE the!")]
    assert found(spark, docs, items, k) == brute(docs, items, k)


def test_batches_of_items_give_the_same(spark, monkeypatch):
    rnd = random.Random(9)
    docs, items = corpus(rnd, 120), corpus(rnd, 30)
    monkeypatch.setattr(lexical, "BATCH_TERMS", 150)
    assert found(spark, docs, items) == brute(docs, items)


def test_defined_cases(spark):
    docs = [(1, None), (2, ""), (3, "... !"), (4, "alpha beta"), (4, "alpha beta"), (None, "alpha beta"), (None, "alpha gamma"),
            (5, "alpha " * 5000), (6, "other words"), (7, "Alpha\x00BETA"), (2**63 - 1, "beta alpha")]
    items = [(1, "alpha beta"), (1, "alpha"), (None, "gamma"), (2, None), (3, ""), (4, "absent"), (5, "alpha " * 300)]
    assert found(spark, docs, items) == brute(docs, items)
    assert found(spark, [], items) == []
    assert found(spark, docs, []) == []


def test_extra_columns_with_clashing_names(spark):
    docs, items = [(1, "alpha beta"), (2, "beta")], [(1, "beta")]
    d = spark.createDataFrame(docs, DOCS).selectExpr("*", "1 AS id", "2 AS n", "3 AS m", "4 AS item_id", "5 AS bag")
    q = spark.createDataFrame(items, ITEMS).selectExpr("*", "1 AS item", "2 AS score", "3 AS rank")
    out = lexical.ranked(d, q)
    assert sorted(tuple(r) for r in out.collect()) == brute(docs, items)


def test_large_sums_are_exact(spark):
    # beyond 2**53 the sums are kept in integers
    docs = [(i, "rare " * (i + 1) + "filler " * 10 * i) for i in range(6)] + [(100 + i, "filler") for i in range(300)]
    items = [(0, "rare " * 2_000_000)]
    assert found(spark, docs, items) == brute(docs, items)


def test_equal_bags_of_other_length_are_other_classes(spark):
    docs = [(i, "key " + "x " * (i % 3 * 50)) for i in range(60)]
    assert found(spark, docs, [(1, "key")]) == brute(docs, [(1, "key")])
