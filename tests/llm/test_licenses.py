"""License scan against brute force."""

import re

from roadtrace.llm import licenses, queries

DOCS = "doc_id long, text string"


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    out = []
    for t in licenses.TEMPLATES:
        key, body = t.key.split(), t.text.split()
        for s in range(len(ws) - len(key) + 1):
            if ws[s: s + len(key)] == key:
                at = s - t.key_at
                same = sum(0 <= at + j < len(ws) and ws[at + j] == w for j, w in enumerate(body))
                out.append((s, t.label, t.base, round(same / len(body), 9)))
    return len(ws), sorted(out)


TEXTS = [
    "Released UNDER the MIT License. under the mit license", "Apache License, Version 2.0; CC BY-NC 4.0, cc-by-nc-sa",
    "cc by cc by nc cc by nc", None, "", "... !!", "by cc nc", "version 2 license apache", "mit " * 3000, "nc by cc " * 500,
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "Permission is hereby granted, free of charge", "the MIT license under the MIT license under the MIT",
    "under the terms of the GNU General Public License as published", "GNU Lesser General Public License v3",
    "éunder the mit license", "word " * 20_000 + "under the MIT license", "Under the MIT license",
]


def test_against_brute_force(spark):
    rows = [(i if i % 5 else None, t) for i, t in enumerate(TEXTS)] + [(1, TEXTS[0]), (1, TEXTS[0])]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS ws", "2 AS places", "3 AS held", "4 AS able", "5 AS row")
    got = [(r.doc_id, r.n_words, [(p.start, p.label, p.base, round(p.score, 9)) for p in r["places"]])
           for r in licenses.license_places(df).collect()]
    assert sorted(got, key=repr) == sorted(((i, *brute(t)) for i, t in rows), key=repr)
    assert licenses.license_places(spark.createDataFrame([], DOCS)).collect() == []


def test_all_languages_of_the_test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id: brute(r.text) for r in df.collect()}
    got = {r.doc_id: r for r in queries.QUERIES["op10_license_scan"](spark, "/root/testdata/sf0.001").collect()}
    for i, (n, places) in want.items():
        base = [p for p in places if p[2]]
        r = got[i]
        assert (r.n_words, r.n_base) == (n, len(base))
        assert (r.first_word, r.last_word) == ((base[0][0], base[-1][0]) if base else (None, None))
        assert r.base_labels == ",".join(sorted({p[1] for p in base})) and r.labels == ",".join(sorted({p[1] for p in places}))
    assert any(p for _, p in want.values())


def test_no_python_on_the_main_path(spark):
    plan = queries.QUERIES["op10_license_scan"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
