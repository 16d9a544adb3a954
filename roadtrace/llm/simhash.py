"""SimHash near-duplicates: 64-bit fingerprints linked through sharded BK-trees.

1. Each text's fingerprint is computed once (one pass, written to the checkpoint folder).  Documents of one
   fingerprint are one class; only distinct fingerprints go on.
2. Two fingerprints within r bits agree on at least one of r + 1 bit blocks, so each fingerprint joins r + 1
   shards, named by (block, value).  Shards of one fingerprint drop out.
3. A shard's fingerprints form BK-trees (children keyed by the integer Hamming distance to the parent) and
   are looked up in them, following only edges within the radius.  A tree holds at most ``TREE_NODES``
   fingerprints; a larger shard has several, and its fingerprints are sent to every one of them in blocks
   of the same size.  Trees stay on the executors: broadcasting them through the driver would gather the
   fingerprints of the whole corpus there.
4. A task returns links as a star to the least fingerprint it connects, which loses no connection; connected
   components follow from star rounds over these links.

Defined cases: a null or empty text, or one of white space, has no shingle and the fingerprint zero, linked
like any other; a text of fewer words than a shingle has one shingle, the whole sequence; a null id takes
part in linking, and is a component's id only where no other id is in it; a very long text is one row, whose words
are in memory while it is hashed; only the id and the text are read, so extra columns can't clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from roadtrace.llm.common import pieces, stored, text_key
from roadtrace.llm.components import component_roots

#: Fingerprints of one BK-tree, and of one block of look-ups.
TREE_NODES = 4096
#: Rows of one task's group of shards.
GROUP_ROWS = 100_000
SEED = 42


def fingerprint(text: bytes | None, shingle: int) -> int:
    """SimHash of a text: a bit is 1 if set in over half of the shingles' XXH64 values."""
    ws = (text or b"").lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not ws:
        return 0
    if len(ws) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(ws), SEED)
    flat = b" ".join(ws)
    blanks = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
    starts = np.concatenate(([0], blanks + 1))[: len(ws) - shingle + 1]
    ends = np.concatenate((blanks, [len(flat)]))[shingle - 1:]
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for lo in range(0, len(starts), 50_000):
        h = np.array([digest(flat[s:e], SEED) for s, e in
                      zip(starts[lo: lo + 50_000].tolist(), ends[lo: lo + 50_000].tolist())], ">u8")
        for at in range(0, len(h), 4096):
            ones += np.unpackbits(h[at: at + 4096].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, fp) of every document; ``key`` tells apart rows that share an id, fp is the signed 64-bit value."""
    schema = T.StructType.fromDDL("id long, key long, fp long")
    arrow = to_arrow_schema(schema)

    def run(batches):
        for b in pieces(batches):
            texts = b.column(2).cast(pa.binary()).to_pylist()
            fp = np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp, pa.int64())], schema=arrow)

    return (docs.select(F.col(id_col).cast("long").alias("id"), text_key(F.col(text_col)).alias("key"),
                        F.col(text_col).alias("text")).mapInArrow(run, schema))


class BKTree:
    """BK-tree over distinct fingerprints; nodes are indexes into ``values``."""

    def __init__(self, values: np.ndarray):
        self.values, self.children = values, {}
        todo = [np.arange(len(values))]
        while todo:
            members = todo.pop()
            root, rest = members[0], members[1:]
            d = np.bitwise_count(values[rest] ^ values[root])
            edges = []
            for e in np.unique(d).tolist():
                child = rest[d == e]
                edges.append((e, int(child[0])))
                if len(child) > 1:
                    todo.append(child)
            self.children[int(root)] = edges

    def within(self, queries: np.ndarray, radius: int):
        """Yields (node, indexes of the queries within the radius of it)."""
        todo = [(0, np.arange(len(queries)))]
        while todo:
            node, mine = todo.pop()
            d = np.bitwise_count(queries[mine] ^ self.values[node]).astype(np.int64)
            near = mine[d <= radius]
            if len(near):
                yield node, near
            for e, child in self.children.get(node, ()):
                on = mine[np.abs(d - e) <= radius]
                if len(on):
                    todo.append((child, on))


def _links(tree: np.ndarray, asked: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars (member, least member) over what the radius connects among a tree's nodes and the fingerprints asked."""
    values = np.unique(np.concatenate((tree, asked)))
    label = np.arange(len(values))
    at_tree, at_asked = np.searchsorted(values, tree), np.searchsorted(values, asked)
    for node, near in BKTree(tree).within(asked, radius):
        met = np.unique(np.append(label[at_asked[near]], label[at_tree[node]]))
        if len(met) > 1:
            label[np.isin(label, met)] = met[0]
    moved = np.flatnonzero(label != np.arange(len(values)))
    return values[moved], values[label[moved]]


def links(distinct: DataFrame, radius: int) -> DataFrame:
    """Links (u, v) that connect all fingerprints (column ``fp``, distinct) within the radius, directly or by a path."""
    cuts = [round(64 * i / (radius + 1)) for i in range(radius + 2)]
    fp = F.col("fp")
    blocks = F.array(*[F.struct(F.lit(i).alias("block"), fp.bitwiseAND(F.lit(_signed(((1 << (b - a)) - 1) << a))).alias("part"))
                       for i, (a, b) in enumerate(zip(cuts, cuts[1:]))])
    shards = distinct.select("fp", F.explode(blocks).alias("s")).select("fp", "s.block", "s.part")
    sizes = shards.groupBy("block", "part").agg(F.count("*").alias("n")).where("n > 1")
    full = shards.join(sizes, ["block", "part"]).withColumn("k", F.ceil(F.col("n") / TREE_NODES).cast("int"))
    # tree t of a shard is asked by the blocks t, t + 1 ... of its fingerprints: every pair of blocks meets once
    mine = F.pmod(F.xxhash64("fp"), F.col("k")).cast("int")
    sent = (full.withColumn("b", mine)
            .withColumn("pair", F.explode(F.concat(
                F.transform(F.sequence(F.lit(0), F.col("b")), lambda t: F.struct(t.alias("tree"), F.col("b").alias("ask"))),
                F.transform(F.slice(F.sequence(F.lit(0), F.col("k") - 1), F.col("b") + 2, F.col("k")),
                            lambda a: F.struct(F.col("b").alias("tree"), a.alias("ask"))))))
            .select("fp", "block", "part", "pair.tree", "pair.ask", "b"))
    # many small shards share one task's group
    rows = distinct.count() * (radius + 1)
    groups = max(1, -(-rows // GROUP_ROWS))
    sent = sent.withColumn("g", F.when(F.col("tree") + F.col("ask") > 0, F.xxhash64("block", "part", "tree", "ask"))
                           .otherwise(F.pmod(F.xxhash64("block", "part"), F.lit(groups))))
    schema = T.StructType.fromDDL("u long, v long")

    def run(key, data):
        cols = [np.asarray(data.column(c)) for c in ("block", "part", "tree", "ask", "b", "fp")]
        order = np.lexsort(cols[::-1])
        block, part, tree, ask, b, value = [c[order] for c in cols]
        value = value.view(np.uint64)
        same = (block[1:] == block[:-1]) & (part[1:] == part[:-1]) & (tree[1:] == tree[:-1]) & (ask[1:] == ask[:-1])
        bounds = np.concatenate(([0], np.flatnonzero(~same) + 1, [len(value)]))
        us, vs = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            x = value[lo:hi]
            if hi - lo == 2 and int(x[0] ^ x[1]).bit_count() > radius:
                continue
            nodes, asked = x[b[lo:hi] == tree[lo]], x[b[lo:hi] == ask[lo]]
            if len(nodes) and len(asked):
                u, v = _links(nodes, asked, radius)
                us.append(u)
                vs.append(v)
        return pa.table({"u": np.concatenate(us).view(np.int64), "v": np.concatenate(vs).view(np.int64)})

    return sent.groupBy("g").applyInArrow(run, schema)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(id, key, fp, root, component) of each document: its fingerprint, the least fingerprint and the least id that
    links reach from it."""
    prints = stored(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    classes = stored(prints.groupBy("fp").agg(F.min("id").alias("least")), "classes")
    roots = component_roots(links(classes.select("fp"), radius))
    of_class = classes.join(roots, classes.fp == roots.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    least = of_class.groupBy("root").agg(F.min("least").alias("component"))
    component = of_class.join(least, "root").select("fp", "root", "component")
    return prints.join(component, "fp").select("id", "key", "fp", "root", "component")

