"""Cross-tokenizer alignment against a plain loop over whole documents, and the monoid's laws."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from roadtrace.llm import alignment as al
from roadtrace.llm import queries

DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def tok():
    return al.Tokenizers(al.FOLDER, "byte_bpe_50k.json", "piece_bpe_32k.model")


def tokens(tok, text):
    """Whole-text ids, without units."""
    if not text:
        return None
    a = tok.a.encode(" " + text, add_special_tokens=False).ids
    b = tok.b.encode(text)
    raw = (" " + text).encode()
    return (a, b) if b"".join(tok.a_bytes[i] for i in a) == raw == b"".join(tok.b_bytes[i] for i in b) else None


def groups_of(tok, a, b):
    """[(a ids, b ids)] by walking both token sequences."""
    out, ga, gb, at_a, at_b, b = [], [], [], 0, 0, list(b)
    for x in a:
        ga.append(x)
        at_a += len(tok.a_bytes[x])
        while at_b < at_a:
            gb.append(b.pop(0))
            at_b += len(tok.b_bytes[gb[-1]])
        if at_a == at_b:
            out.append((ga, gb))
            ga, gb = [], []
    return out


def brute(tok, rows):
    groups = [groups_of(tok, *t) if (t := tokens(tok, text)) else [] for _, text in rows]
    count = Counter((ga[-1], gb[-1]) for g in groups for ga, gb in g)
    top = {}
    for (_, b), n in count.items():
        top[b] = max(top.get(b, 0), n)
    out = []
    for (i, _), g in zip(rows, groups):
        links = [(ga[-1], gb[-1]) for ga, gb in g]
        shown = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in g)
        out.append((i, sum(len(x) for x, _ in g), sum(len(x) for _, x in g), len(g), len(links),
                    sum(count[p] == top[p[1]] for p in links), sum(count[p] for p in links), shown))
    return sorted(out, key=repr)


def found(df):
    out = al.align(df, keep=["doc_id"])
    return sorted((tuple(r) for r in out.select("doc_id", *al.NUMBERS, "groups").collect()), key=repr)


WORDS = ["the", "Benchmark", "naïve", "ñandú", "42", "don't", "<|endoftext|>", "<s>", "[INST]", "日本語", "😀", "a" * 40, "x\ny", "\t", "",
         "ﬁn", "①", " ", "é", "...", "0xFF", " ", "\x1c", "한국어"]


def sample(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def test_against_whole_texts(spark, tok):
    rnd = random.Random(7)
    rows = [(i, sample(rnd, rnd.randint(1, 30))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, " "), (203, "   lead"), (204, "trail  "), (205, "holds ▁ itself"), (206, "▁"),
             (207, "a\x00b"), (1, "the same id"), (1, "the same id"), (None, "no id")]
    assert found(spark.createDataFrame(rows, DOCS)) == brute(tok, rows)


def test_long_documents_in_chunks(spark, tok, monkeypatch):
    rnd = random.Random(3)
    monkeypatch.setattr(al, "LONG_BYTES", 60)
    monkeypatch.setattr(al, "CHUNK", 13)
    monkeypatch.setattr(al, "UNIT", 30)
    monkeypatch.setattr(al, "FAN", 3)
    rows = [(i, sample(rnd, rnd.randint(1, 60))) for i in range(40)]
    rows += [(100, "y" * 500), (101, "words " * 80 + "▁"), (102, "日本語" * 70), (103, "ab " * 40 + "z" * 200 + " cd" * 40)]
    assert found(spark.createDataFrame(rows, DOCS)) == brute(tok, rows)


def test_rare_pairs_meet_their_counts_in_a_join(spark, tok, monkeypatch):
    rnd = random.Random(5)
    rows = [(i, sample(rnd, 20)) for i in range(60)]
    want = brute(tok, rows)
    for bound in (0, 8, 40):
        monkeypatch.setattr(al, "MAX_BROADCAST_PAIRS", bound)
        monkeypatch.setattr(al, "LONG_BYTES", 120)
        monkeypatch.setattr(al, "CHUNK", 30)
        assert found(spark.createDataFrame(rows, DOCS)) == want


def test_store_of_units_can_be_emptied(spark, tok, monkeypatch):
    monkeypatch.setattr(al, "HELD", 100)
    rnd = random.Random(2)
    rows = [(i, sample(rnd, 20)) for i in range(700)]
    assert found(spark.createDataFrame(rows, DOCS).coalesce(1)) == brute(tok, rows)


def test_empty_table_and_clashing_columns(spark, tok):
    assert found(spark.createDataFrame([], DOCS)) == []
    df = spark.createDataFrame([(1, "some text")], DOCS).selectExpr("*", "'x' AS groups", "1 AS N_A", "2 AS row", "3 AS doc")
    out = al.align(df)
    assert sorted(c.lower() for c in out.columns) == sorted(["doc_id", "text", "row", "doc", *al.NUMBERS, "groups"])
    assert out.first().groups == brute(tok, [(1, "some text")])[0][-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 3), st.integers(1, 3)), min_size=1, max_size=12), st.data())
def test_any_cut_and_any_bracketing_gives_the_same_groups(lengths, data):
    # two random tokenisations of one byte string
    total = sum(max(x) for x in lengths)
    ends = [sorted(set(data.draw(st.lists(st.integers(1, total), max_size=total))) | {total}) for _ in "ab"]
    a_end, b_end = (np.array(e) for e in ends)
    a, b = np.arange(len(a_end)) + 100, np.arange(len(b_end)) + 500
    whole, pairs = al.leaf(a, a_end, b, b_end)
    cuts = [0, *sorted(data.draw(st.lists(st.integers(0, total), max_size=6))), total]
    leaves, linked = [], []
    for lo, hi in zip(cuts, cuts[1:]):
        ina, inb = (a_end > lo) & (a_end <= hi), (b_end > lo) & (b_end <= hi)
        f, p = al.leaf(a[ina], a_end[ina], b[inb], b_end[inb])
        leaves.append(f)
        linked += p.tolist()
    while len(leaves) > 1:
        i = data.draw(st.integers(0, len(leaves) - 2))
        leaves[i: i + 2] = [al.compose(leaves[i], leaves[i + 1])]
    assert al.whole(leaves[0]) == al.whole(whole)
    assert linked == pairs.tolist()
    assert al.compose(al.Fragment(), whole) == whole == al.compose(whole, al.Fragment())


def test_query_digests(spark, tok):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = [x[:-1] + (hashlib.sha256(x[-1].encode()).hexdigest() if x[-1] else "",) for x in brute(tok, rows)]
    out = queries.QUERIES["op13_token_alignment"](spark, sf)
    got = [tuple(r) for r in out.select("doc_id", *al.NUMBERS, F.col("groups_sha256")).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
