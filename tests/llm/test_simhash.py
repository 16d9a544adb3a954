"""SimHash: fingerprints, links and components against brute force."""

import random
import re

import pyarrow.parquet as pq
import pytest
import xxhash

from roadtrace.llm import queries, simhash

DOCS = "doc_id long, text string"


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(ws[i: i + 3]) for i in range(max(1, len(ws) - 2))] if ws else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(rows, radius=2):
    """rows: (id, fp); the least id reachable, by full comparison."""
    fps = sorted({fp for _, fp in rows})
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1:]:
            if (a ^ b).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    least = {}
    for i, fp in rows:
        if i is not None:
            least[find(fp)] = min(i, least.get(find(fp), i))
    return [(i, fp, least.get(find(fp))) for i, fp in rows]


def order(rows):
    return sorted(rows, key=repr)


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = pq.read_table(f"{sf}/documents.parquet").to_pylist()
    want = brute_components([(d["doc_id"], brute_fingerprint(d["text"])) for d in docs])
    got = queries.QUERIES["op8_simhash_dedup"](spark, sf).collect()
    assert order((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in got) == order(want)
    assert all(len(r.fingerprint) == 16 for r in got)
    assert any(c != i for i, _, c in want)


def test_defined_cases(spark):
    rows = [(3, None), (5, ""), (9, " \n\t"), (None, "one two"), (7, "One  TWO"), (7, "one two"), (7, "one two"),
            (1, "É two three four"), (2, "é two three four"), (None, "alone here"), (11, "x " * 200_000)]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS fp", "'a' AS component", "2 AS key")
    got = simhash.near_duplicates(df).collect()
    want = brute_components([(i, brute_fingerprint(t)) for i, t in rows])
    assert order((r.id, r.fp % 2**64, r.component) for r in got) == order(want)
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []


@pytest.mark.parametrize("tree_nodes", [4, 64])
def test_links_of_hot_shards(spark, monkeypatch, tree_nodes):
    """Chains and dense clusters in few shards, split over many trees, lose no connection."""
    monkeypatch.setattr(simhash, "TREE_NODES", tree_nodes)
    rnd = random.Random(5)
    fps = {0}
    for _ in range(12):
        base = rnd.getrandbits(64) & ~0x3FFFFF  # all clusters share the low block
        for _ in range(25):
            fps.add(base)
            base ^= 1 << rnd.randrange(24, 64)
            fps.add(base ^ 1 << rnd.randrange(64))
    rows = [(i, fp) for i, fp in enumerate(sorted(fps))]
    df = spark.createDataFrame([(simhash._signed(fp),) for _, fp in rows], "fp long")
    found = simhash.component_roots(simhash.links(df, 2)).collect()
    root = {r.node: r.root for r in found}
    groups = {}
    for i, fp, c in brute_components(rows):
        groups.setdefault(c, set()).add(simhash._signed(fp))
    for members in groups.values():
        assert len({root.get(m, m) for m in members}) == 1
    assert len({root.get(simhash._signed(fp), simhash._signed(fp)) for fp in fps}) == len(groups)


def test_bk_tree_follows_only_edges_in_the_radius():
    import numpy as np

    rnd = random.Random(1)
    values = np.array(sorted({rnd.getrandbits(10) << 20 for _ in range(300)}), np.uint64)
    got = {(int(values[n]), int(values[q])) for n, near in simhash.BKTree(values).within(values, 2) for q in near}
    assert got == {(int(a), int(b)) for a in values for b in values if (int(a) ^ int(b)).bit_count() <= 2}
