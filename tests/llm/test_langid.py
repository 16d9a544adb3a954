"""Language ID: counts against brute force, held-out accuracy, defined cases."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from roadtrace.llm import langid, queries

DOCS = "doc_id long, text string, lang string"


def test_grams_do_not_cross_texts_and_pieces_add_up(monkeypatch):
    texts = ["", "ab", "É𝛼x" * 10, "", "c", "long text " * 50]

    def grams(run):
        return Counter((int(d), int(b)) for docs, buckets in langid.gram_buckets(run, 1 << 12) for d, b in zip(docs, buckets))

    whole = grams(texts)
    assert sum(whole.values()) == sum(max(0, len(t) - n + 1) for t in texts for n in langid.ORDERS)
    one = Counter()
    for i, t in enumerate(texts):
        one += Counter({(i, b): n for (_, b), n in grams([t]).items()})
    assert one == whole
    monkeypatch.setattr(langid, "PIECE", 7)
    assert grams(texts) == whole


def test_model_and_posteriors_against_brute_force(spark):
    rows = [(i, t, x) for i, (t, x) in enumerate([("abab", "x"), ("bcbc", "y"), ("abc", "x"), ("zzz", None), (None, "x"),
                                                  ("ab", "x"), ("cc", "y"), ("", "y"), ("cbb", "y"), ("bab", "x")] * 3)]
    model = langid.train(spark.createDataFrame(rows, DOCS))
    seen = [(t, x) for i, t, x in rows if x and t is not None and zlib.crc32(str(i).encode()) % 5]
    assert model.languages == ["x", "y"]
    counts = {x: Counter() for x in "xy"}
    for t, x in seen:
        for _, buckets in langid.gram_buckets([t], langid.BUCKETS):
            counts[x].update(buckets.tolist())
    for text in ("abab", "c", "bcz"):
        want = []
        for x in "xy":
            total = sum(counts[x].values()) + langid.SMOOTHING * langid.BUCKETS
            s = math.log(sum(y == x for _, y in seen) / len(seen))
            for _, buckets in langid.gram_buckets([text], langid.BUCKETS):
                s += sum(math.log((counts[x][b] + langid.SMOOTHING) / total) for b in buckets.tolist())
            want.append(s)
        assert np.allclose(langid.posteriors([text], model)[0], want)


@pytest.mark.parametrize("part_bytes", [16 * langid.BUCKETS, 16 * langid.BLOCK])
def test_many_languages_score_as_in_one_part(spark, monkeypatch, part_bytes):
    rows = [(i, f"{chr(97 + i % 7) * 3} {chr(98 + i % 7)}{i % 3} common {chr(99 + i % 5)}", f"l{i % 7}") for i in range(140)]
    rows += [(500, "common", None), (501, "qqq", None)]
    df = spark.createDataFrame(rows, DOCS)

    def found():
        model = langid.train(df)
        return model.languages, {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(df, model, keep=["doc_id"]).collect()}

    names, want = found()
    monkeypatch.setattr(langid, "MODEL_BYTES", part_bytes)
    got_names, got = found()
    assert got_names == names and len(names) == 7 and got.keys() == want.keys()
    for i, (lang, p) in want.items():
        assert got[i][0] == lang and math.isclose(got[i][1], p, rel_tol=1e-9)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.QUERIES["op6_language_id"](spark, sf).collect()
    assert len(got) == len(lang)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)


def test_defined_cases(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 !!", "fr"), (None, "the of and", "de"), (4, "hello there", "en"),
            (4, "hello there", "en"), (6, "bonjour", "fr"), (7, "bonjour été", None), (8, "hello " * 300_000, "en")]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS score", "2 AS lang_pred", "3 AS ok", "4 AS row")
    model = langid.train(df)
    assert "de" not in model.languages  # a null id is never learnt from
    got = langid.predict(df, model).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.lang_pred == "und") == (r.doc_id in (1, 2, 3)) and (r.lang_pred != "und" or r.score == 0)
    nothing = spark.createDataFrame([], DOCS)
    assert langid.predict(nothing, langid.train(nothing)).collect() == []
    assert {r.lang_pred for r in langid.predict(df, langid.train(nothing)).collect()} == {"und"}
