"""PU quality classifier: features, prior, held-out quality, defined cases."""

import zlib

import numpy as np

from roadtrace.llm import quality, queries

DOCS, LABELS = "doc_id long, text string", "doc_id long, quality int, toxic int"


def test_features_of_slices_equal_those_of_the_whole(monkeypatch):
    text = ("Some words, here!! and 12 é | more\nline two line two line\n" * 40).encode()
    whole = quality.features(text)
    monkeypatch.setattr(quality, "SLICE", 97)
    sliced = quality.features(text)
    names = range(len(whole))
    # cuts at white space change neither words nor characters; only repeats and lines across a cut are lost
    exact = [i for i in names if i not in (7, 8, 12, 15, 16)]
    assert np.allclose(np.array(whole)[exact], np.array(sliced)[exact])
    assert len(quality.features(None)) == len(quality.features(b"")) == len(whole)
    assert np.isfinite(quality.features(b"\x00 \n" * 10)).all()


def test_prior_and_separation():
    rnd = np.random.default_rng(0)
    good, bad = rnd.normal(0, 1, (4000, 3)), rnd.normal(4, 1, (2000, 3))
    model = quality.fit(good[:2000], np.concatenate((good[2000:], bad[:1000])))  # two thirds of the unlabelled are good
    assert abs(model.prior - 2 / 3) < 0.06
    fresh_good, fresh_bad = rnd.normal(0, 1, (500, 3)), rnd.normal(4, 1, (500, 3))
    assert (model.score(fresh_good) >= 0.5).mean() > 0.97 and (model.score(fresh_bad) < 0.5).mean() > 0.97


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.1"
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = queries.QUERIES["op1_quality_pu"](spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [r for r in got if r.held_out and r.doc_id in label]
    good, bad = [r.predicted for r in held if label[r.doc_id]], [r.predicted for r in held if not label[r.doc_id]]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.1


def test_the_fit_keeps_its_bound_when_ids_repeat(spark, monkeypatch):
    one, other = [i for i in range(1, 20) if zlib.crc32(str(i).encode()) % 5][:2]
    rows = [(i, f"text of {i}") for i in range(100, 400)]
    rows += [(one, "the same text")] * 2000 + [(other, f"text {i} of one id") for i in range(2000)]
    labels = spark.createDataFrame([(one, 1, 0), (other, 1, 0), (100, 1, 0)], LABELS)
    seen = []
    monkeypatch.setattr(quality, "fit", lambda p, u: seen.extend((len(p), len(u))))
    quality.train(spark.createDataFrame(rows, DOCS), labels, max_rows=100)
    assert len(seen) == 2 and all(50 < n < 150 for n in seen)


def test_defined_cases(spark):
    rows = [(1, None), (2, ""), (3, "a word " * 300_000), (None, "no id"), (4, "same"), (4, "same"), (6, "x"), (7, "y z")]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS score", "2 AS x", "3 AS row")
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 0), (6, 1, 0), (7, 1, 0), (7, 1, 0), (None, 1, 0), (1, None, 0), (99, 1, 1)],
                                   LABELS)
    model = quality.train(df, labels)
    got = quality.score(df, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert quality.train(df, spark.createDataFrame([], LABELS)) is None
    assert {r.score for r in quality.score(df, None).collect()} == {0.5}
    nothing = spark.createDataFrame([], DOCS)
    assert quality.train(nothing, labels) is None and quality.score(nothing, model).collect() == []
