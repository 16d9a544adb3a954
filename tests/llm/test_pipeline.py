"""The corpus pipeline, stage by stage, against brute force over each stage's own input."""

import re

import pytest
from test_decontaminate import brute as brute_hits
from test_mixing import check as check_mix
from test_mixing import size
from test_simhash import brute_components, brute_fingerprint

import corpus_pipeline as pipe

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string, key int"


def passage(seed, n):
    return " ".join(f"w{seed}x{i}" for i in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    sf = str(tmp_path_factory.mktemp("sf"))
    en = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(150).collect()
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, "x", 1) for r in en]
    bench = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    shared = passage(9, 60)
    more = [("%s %s" % (passage(1, 90), bench)), passage(2, 80) + " " + shared, shared + " " + passage(3, 70), shared, None, "", "12 34",
            passage(4, 100), passage(4, 100), "Hola " + bench.split()[0]]
    rows += [(1_000_000 + i, t, "en", "src%d" % (i % 3) if i != 7 else None, len(t or ""), "y", 2) for i, t in enumerate(more)]
    rows += [rows[5], (None, passage(6, 40), None, None, 3, None, None), (rows[7][0], passage(7, 30), "en", "src1", 9, None, 3)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, bench), (2, None)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    return sf


def rows_of(df):
    return [tuple(r) for r in df.select(*[c.split()[0] for c in SCHEMA.split(", ")]).collect()]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_stages_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    first = rows_of(docs)
    after = {}
    for name, stage in pipe.STAGES:
        docs = pipe.stored(stage(spark, docs, folder), name)
        after[name] = rows_of(docs)
    # language ID: texts without a letter go, documents of the known languages stay
    lang = after["language_id"]
    assert set(map(repr, lang)) <= set(map(repr, first))
    gone = [r for r in first if repr(r) not in set(map(repr, lang))]
    assert {r[1] for r in gone} >= {None, "", "12 34"} and len(gone) < 8
    # near copies: one document of each component
    groups = {}
    for r, (_, _, c) in zip(lang, brute_components([(i, brute_fingerprint(r[1])) for i, r in enumerate(lang)])):
        groups.setdefault(c, []).append((r[0] is None, r[0] or 0))
    dedup = after["simhash_dedup"]
    assert sorted((r[0] is None, r[0] or 0) for r in dedup) == sorted(min(g) for g in groups.values())
    assert len(dedup) < len(lang) and set(map(repr, dedup)) <= set(map(repr, lang))
    # repeated passages: judged on the stage's input
    first_at, want = {}, []
    for r in sorted(dedup, key=lambda r: (r[0] is None, r[0] or 0)):
        ws = words(r[1])
        hit = set()
        for i in range(len(ws) - 19):
            w = tuple(ws[i: i + 20])
            if w in first_at and first_at[w] != (r, i):
                hit |= set(range(i, i + 20))
            first_at.setdefault(w, (r, i))
        text = " ".join(w for i, w in enumerate(ws) if i not in hit) if hit else r[1]
        if not hit or text:
            want.append((r[0], text, *r[2:4], len(text), *r[5:]))
    cut = after["substring_dedup"]
    assert sorted(map(repr, cut)) == sorted(map(repr, want))
    assert any(a[1] != b[1] for a, b in zip(sorted(cut, key=repr), sorted(dedup, key=repr)))
    # benchmark passages
    bad = {(i, n, h) for i, n, h, _ in brute_hits([(r[0], r[1]) for r in cut], [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu")], 10) if h}
    clean = after["decontaminate"]
    assert bad and sorted(map(repr, clean)) == sorted(repr(r) for r in cut if r[0] not in {i for i, _, _ in bad})
    # mix: copies add up to each source's target
    copies = docs.collect()
    taken = {}
    for r in copies:
        taken[(r.doc_id, r.source)] = taken.get((r.doc_id, r.source), 0) + r.taken
        assert size(r.text) == r.taken <= r["size"] and r.n_chars == len(r.text) and r.epoch in (0, 1)
    source_taken, target = {}, {r.source: r.target for r in copies}
    for (_, s), n in taken.items():
        source_taken[s] = source_taken.get(s, 0) + n
    assert source_taken == {s: int(t + 0.5) for s, t in target.items()}


def test_run_and_empty_table(spark, folder, tmp_path):
    assert pipe.run(spark, folder).count() > 0
    empty = str(tmp_path)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{empty}/benchmark.parquet")
    assert pipe.run(spark, empty).collect() == []


def test_mix_check_is_the_operators(spark, folder):
    got = pipe.mix(spark.read.parquet(f"{folder}/documents.parquet"), keep=["doc_id", "source"]).collect()
    check_mix([(r.doc_id, r.source, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()], got)
