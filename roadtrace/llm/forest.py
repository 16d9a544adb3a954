"""Approximate nearest neighbours by cosine with a hash-prefix forest.

1. Equal vectors are one class with its k + 1 least ids (chosen per task before the shuffle): a class never gives more
   rows to a result, so copies cost nothing further on.
2. Every class gets one 64-bit hash string per tree: the signs of its products with random directions.  A tree is the
   array of (string, class) in order, cut by range into blocks of about ``BLOCK`` entries; the order ends with the
   class number, so many equal strings spread over blocks.  The blocks' bounds and sizes (at most ``MAX_BLOCKS`` rows,
   as blocks grow beyond) are broadcast.
3. Descending: a query's longest-prefix matches lie around its place in each tree.  For every prefix length the entries
   that share it are one range; its size is counted in the blocks at the range's ends, and whole blocks between them
   add their known sizes.
4. Synchronously ascending: from the longest prefix down, all trees together, until the entries that share the prefix
   number ``candidates``.  The depth reached is the query's; its candidates are all entries of that depth in all trees.
5. Queries go to the blocks that hold their ranges and meet the vectors there; a block returns k + 1 classes per query
   with exact cosines.  Blocks with many queries are dealt to several tasks.  Trees' findings are merged per query.

How many candidates it takes depends on the data and not on a guess: for ``SAMPLE`` queries the k nearest are found by
brute force (one pass, a bound of its own), the prefix length at which the forest meets each of them is known, and
``candidates`` is the least number that meets ``recall`` of them.  On vectors without structure that is a large part of
all rows, on clustered ones a small one.

Scores of the rows returned are made of correctly rounded sums, so equal vectors tie whatever block they are in.

Defined cases: null vectors, vectors with a null or non-finite component, empty and zero vectors take no part; only
vectors of one length meet; a null id is no query and comes last among ties; rows that repeat an id are rows of their
own, a query leaves out only itself; fewer candidates than k give fewer rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from roadtrace.llm.common import pieces, stored

TREES, BITS = 8, 64
BLOCK, MAX_BLOCKS = 1 << 14, 1 << 18
#: Queries of one block that meet its entries in one task.
QUERIES = 2048
#: Queries with known neighbours from which the number of candidates is learnt, and the share of neighbours to meet.
SAMPLE, RECALL = 160, 0.96
SEED = 7


# ----------------------------------------------------------------- vectors
def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings their largest component near 1; cosines stay the same to the bit."""
    top = np.abs(x).max(axis=1, initial=0)
    return np.ldexp(x, -np.frexp(top)[1][:, None])


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(len(column), dim)


def directions(dim: int, trees: int, seed: int = SEED) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([seed, dim])).normal(size=(dim, trees * BITS))


def hash_strings(x: np.ndarray, trees: int) -> np.ndarray:
    """(rows x trees) 64-bit hash strings, first sign first."""
    out = np.empty((len(x), trees), np.uint64)
    way = directions(x.shape[1], trees)
    for lo in range(0, len(x), 2048):
        bits = (scaled(x[lo: lo + 2048]) @ way > 0).reshape(-1, trees, BITS)
        out[lo: lo + 2048] = np.packbits(bits, axis=2).reshape(-1, trees, 8).view(">u8")[:, :, 0].astype(np.uint64)
    return out


def in_order(x: np.ndarray) -> np.ndarray:
    """Hash strings as signed integers in the same order, for Spark."""
    return (x ^ np.uint64(1 << 63)).view(np.int64)


def as_string(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, np.int64).view(np.uint64) ^ np.uint64(1 << 63)


def shared_prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of hash strings."""
    x = a ^ b
    n = np.zeros(x.shape, np.int64)
    rest = x.copy()
    for step in (32, 16, 8, 4, 2, 1):
        empty = (rest >> np.uint64(64 - step)) == 0
        n += np.where(empty, step, 0)
        rest = np.where(empty, rest << np.uint64(step), rest)
    return np.where(x == 0, 64, n)


def prefix_range(strings: np.ndarray, depth):
    """First and last hash string that share ``depth`` bits with each string."""
    depth = np.asarray(depth, np.uint64)
    free = np.where(depth == 0, np.uint64(2**64 - 1), (np.uint64(1) << ((np.uint64(64) - depth) % np.uint64(64))) - np.uint64(1))
    return strings & ~free, strings | free


def cosines(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact sums, so equal pairs of vectors give equal scores."""
    def norm(x):
        return math.sqrt(math.fsum(v * v for v in x))

    return np.array([math.fsum(a * b for a, b in zip(x, y)) / (norm(x) * norm(y)) for x, y in zip(scaled(q).tolist(), scaled(c).tolist())])


def vector_classes(vectors: DataFrame, k: int, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame]:
    """(classes (class, a, b, dim, v, ids), rows (id, a, b)): equal vectors share the 128-bit key (a, b)."""
    v = F.col("v")
    sound = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0),
                       F.lit(False))
    # -0.0 and 0.0 are one component
    plain = F.transform(v, lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x))
    rows = (vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
            .where(sound).withColumn("v", plain).select("id", F.xxhash64("v").alias("a"), F.xxhash64(F.lit(1), "v").alias("b"), "v"))
    key = F.struct(F.col("id").isNull().alias("none"), "id")
    place = F.row_number().over(Window.partitionBy("a", "b").orderBy(F.asc_nulls_last("id")))
    found = (rows.withColumn("place", place).where(F.col("place") <= k + 1).groupBy("a", "b")
             .agg(F.first("v").alias("v"), F.array_sort(F.collect_list(key)).alias("ids")))
    found = stored(found.select("a", "b", F.size("v").alias("dim"), "v", F.col("ids.id").alias("ids")), "vector-classes")
    return stored(found.withColumn("class", F.monotonically_increasing_id()), "numbered-classes"), rows.select("id", "a", "b")


# ------------------------------------------------------------------- trees
def block_bounds(rows) -> dict[tuple[int, int], tuple]:
    """{(dim, tree): (block numbers, first strings, last strings, entries before each block)}, in the tree's order."""
    out: dict[tuple[int, int], tuple] = {}
    trees: dict[tuple[int, int], list] = {}
    for r in rows:
        trees.setdefault((r.dim, r.tree), []).append(r)
    for key, mine in trees.items():
        mine.sort(key=lambda r: (r.low, r.high, r.block))
        low, high = (as_string(np.array([getattr(r, c) for r in mine], np.int64)) for c in ("low", "high"))
        size = np.array([r.size for r in mine], np.int64)
        out[key] = np.array([r.block for r in mine], np.int64), low, high, np.concatenate(([0], np.cumsum(size)))
    return out


class Blocks:
    """Bounds and sizes of every tree's blocks: what is broadcast of the forest."""

    def __init__(self, of: dict[tuple[int, int], tuple]):
        self.of = of

    def ends(self, dim: int, tree: int, strings: np.ndarray, depth):
        """First and last place of the blocks that each prefix range touches (empty if first > last)."""
        _, low, high, _ = self.of[dim, tree]
        lo, hi = prefix_range(strings, depth)
        return np.searchsorted(high, lo), np.searchsorted(low, hi, "right") - 1

    def whole_between(self, dim: int, tree: int, first, last):
        """Entries in the blocks strictly between two places: they lie in the range as a whole."""
        upto = self.of[dim, tree][3]
        return np.where(last > first + 1, upto[np.maximum(last, first + 1)] - upto[first + 1], 0)


def planted(found: DataFrame, n_classes: int, trees: int) -> DataFrame:
    """(dim, tree, string, class, block): the sorted arrays, cut by range.  ``block`` is a long as in what is routed to
    it: cogroups deal both sides by the keys' types."""
    schema = T.StructType.fromDDL("dim int, tree int, string long, class long")
    arrow = to_arrow_schema(schema)

    def run(batches):
        for b in pieces(batches, 4096):
            dims = np.asarray(b.column("dim"))
            for dim in np.unique(dims).tolist():
                mine = b.filter(pa.array(dims == dim))
                s = in_order(hash_strings(matrix(mine.column("v"), dim), trees))
                n = mine.num_rows
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(n * trees, dim, np.int32)), pa.array(np.tile(np.arange(trees, dtype=np.int32), n)),
                    pa.array(s.ravel()), mine.column("class").take(pa.array(np.repeat(np.arange(n), trees)))], schema=arrow)

    entries = n_classes * trees
    n_blocks = max(1, -(-entries // max(BLOCK, -(-entries // MAX_BLOCKS))))
    cut = found.select("dim", "v", "class").mapInArrow(run, schema).repartitionByRange(n_blocks, "dim", "tree", "string", "class")
    return stored(cut.sortWithinPartitions("dim", "tree", "string", "class").withColumn("block", F.spark_partition_id().cast("long")), "forest")


def query_strings(trees: int):
    """Yields, in a task, (batch of one dim, dim, its hash strings)."""
    def of(batches):
        for b in pieces(batches, 1024):
            dims = np.asarray(b.column("dim"))
            for dim in np.unique(dims).tolist():
                mine = b.filter(pa.array(dims == dim))
                yield mine, dim, hash_strings(matrix(mine.column("v"), dim), trees)

    return of


# ---------------------------------------------------------------- counting
def counted(asked: DataFrame, forest: DataFrame, blocks, trees: int, candidates: int | None) -> DataFrame:
    """(class, n): entries of all trees that share 0, 1 ... 64 bits with each query.

    With ``candidates``, lengths at which whole blocks alone hold as many aren't counted further (they stay at what the
    blocks hold); so a query visits only blocks near its place.
    """
    depths = np.arange(BITS + 1)
    schema = T.StructType.fromDDL("class long, string long, dim int, tree int, block long, n array<long>")
    arrow = to_arrow_schema(schema)
    strings_of = query_strings(trees)

    def route(batches):
        known = Blocks(blocks.value)
        for b, dim, strings in strings_of(batches):
            n_rows = b.num_rows
            sums = np.zeros((n_rows, BITS + 1), np.int64)
            ends = []
            for t in range(trees):
                first, last = known.ends(dim, t, np.repeat(strings[:, t], BITS + 1), np.tile(depths, n_rows))
                ends.append((first.reshape(n_rows, -1), last.reshape(n_rows, -1)))
                sums += known.whole_between(dim, t, *ends[-1])
            # from here on down to the full string the blocks at the ends are visited
            floor = np.zeros(n_rows, np.int64) if candidates is None else np.maximum(0, (sums >= candidates).sum(axis=1) - 1)
            near = depths >= floor[:, None]
            rows, tree, block = [], [], []
            for t, (first, last) in enumerate(ends):
                number = known.of[dim, t][0]
                upto = known.of[dim, t][3]
                some = near & (first <= last)
                r, d = np.nonzero(some)
                seen = np.unique(np.concatenate((r * len(number) + first[some], r * len(number) + last[some])))
                r2, place = seen // len(number), seen % len(number)
                rows.append(r2)
                tree.append(np.full(len(r2), t))
                block.append(number[place])
                # a visited block counts its own entries: take out what the sums have of it as a whole
                lo, hi = first[r2], last[r2]
                whole = (lo < place[:, None]) & (place[:, None] < hi)
                np.subtract.at(sums, r2, np.where(whole, (upto[place + 1] - upto[place])[:, None], 0) * near[r2])
            rows, tree, block = (np.concatenate(x) for x in (rows, tree, block))
            cls = b.column("class")
            own = pa.RecordBatch.from_arrays([
                cls, pa.nulls(n_rows, pa.int64()), pa.nulls(n_rows, pa.int32()), pa.nulls(n_rows, pa.int32()),
                pa.array(np.full(n_rows, -1)), pa.array(sums.tolist(), arrow.field("n").type)], schema=arrow)
            yield own
            yield pa.RecordBatch.from_arrays([
                cls.take(pa.array(rows)), pa.array(in_order(strings[rows, tree])), pa.array(np.full(len(rows), dim, np.int32)),
                pa.array(tree.astype(np.int32)), pa.array(block), pa.nulls(len(rows), arrow.field("n").type)], schema=arrow)

    sent = stored(asked.select("class", "dim", "v").mapInArrow(route, schema), "routed-counts")
    counts = T.StructType.fromDDL("class long, n array<long>")
    counts_arrow = to_arrow_schema(counts)

    def count(key, left, right):
        if not left.num_rows or not right.num_rows:
            return pa.table({f.name: pa.array([], f.type) for f in counts_arrow}, schema=counts_arrow)
        here = np.sort(as_string(np.asarray(right.column("string"))))
        strings = as_string(np.asarray(left.column("string")))
        lo, hi = prefix_range(np.repeat(strings, BITS + 1), np.tile(depths, len(strings)))
        n = (np.searchsorted(here, hi, "right") - np.searchsorted(here, lo)).reshape(-1, BITS + 1)
        return pa.table([left.column("class"), pa.array(n.tolist(), counts_arrow.field("n").type)], schema=counts_arrow)

    by = ["dim", "tree", "block"]
    local = (sent.where("block >= 0").select("class", "string", *by).groupBy(*by)
             .cogroup(forest.select("string", *by).groupBy(*by)).applyInArrow(count, counts))
    parts = sent.where("block < 0").select("class", "n").unionByName(local)
    return parts.groupBy("class").agg(F.array(*[F.sum(F.col("n")[int(d)]) for d in depths]).alias("n"))


def depth_of(n, candidates: int):
    """The longest prefix that enough entries share: 0 if there aren't so many."""
    return F.greatest(F.lit(0), F.size(F.filter(n, lambda x: x >= candidates)) - 1).cast("int")


# ------------------------------------------------------------- calibration
def nearest_of_sample(found: DataFrame, sample, k: int, trees: int) -> DataFrame:
    """(q, class, score, prefix): the k nearest other classes of every sampled query by brute force, with the longest
    prefix that any tree shares between the two."""
    schema = T.StructType.fromDDL("q long, class long, score double, prefix int")
    arrow = to_arrow_schema(schema)

    def run(batches):
        for b in pieces(batches, 4096):
            dims, cls = np.asarray(b.column("dim")), np.asarray(b.column("class"))
            for dim, (q_class, q) in sample.value.items():
                mine = np.flatnonzero(dims == dim)
                if not len(mine):
                    continue
                x = scaled(matrix(b.column("v").take(pa.array(mine)), dim))
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                y = scaled(q)
                y /= np.linalg.norm(y, axis=1, keepdims=True)
                near = y @ x.T
                near[q_class[:, None] == cls[mine]] = -np.inf
                top = np.argsort(-near, axis=1, kind="stable")[:, :k]
                qi, ci = np.repeat(np.arange(len(q)), top.shape[1]), top.ravel()
                real = np.isfinite(near[qi, ci])
                qi, ci = qi[real], ci[real]
                some, at = np.unique(ci, return_inverse=True)
                prefix = shared_prefix(hash_strings(q, trees)[qi], hash_strings(x[some], trees)[at]).max(axis=1, initial=0)
                yield pa.RecordBatch.from_arrays([pa.array(q_class[qi]), pa.array(cls[mine][ci]), pa.array(near[qi, ci]),
                                                  pa.array(prefix.astype(np.int32))], schema=arrow)

    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "class"))
    return (found.select("class", "dim", "v").mapInArrow(run, schema).withColumn("place", place)
            .where(F.col("place") <= k).drop("place"))


def candidates_needed(found: DataFrame, asked: DataFrame, forest: DataFrame, blocks, k: int, trees: int, recall: float) -> int:
    """The least number of candidates with which the forest meets ``recall`` of a sample's nearest neighbours."""
    some = asked.orderBy(F.xxhash64(F.lit("sample"), "a", "b")).limit(SAMPLE)
    some = stored(some, "sampled-queries")
    rows = some.select("class", "dim", "v").collect()  # SAMPLE rows
    sample = {dim: (np.array([r["class"] for r in rows if r.dim == dim]), np.array([r.v for r in rows if r.dim == dim]))
              for dim in {r.dim for r in rows}}
    sample = found.sparkSession.sparkContext.broadcast(sample)
    near = nearest_of_sample(found, sample, k, trees)
    n = counted(some, forest, blocks, trees, None)
    # a neighbour is met if the ascent stops at its prefix or above: if longer prefixes have fewer entries than asked for
    beyond = F.coalesce(F.get("n", F.col("prefix") + 1), F.lit(0)) + 1
    needed = sorted(r.needed for r in near.join(F.broadcast(n.withColumnRenamed("class", "q")), "q")
                    .select(beyond.alias("needed")).collect())  # SAMPLE x k rows
    return int(needed[min(len(needed) - 1, math.ceil(recall * len(needed)))]) if needed else 1


# ------------------------------------------------------------------ search
def searched(asked: DataFrame, found: DataFrame, forest: DataFrame, blocks, k: int, trees: int) -> DataFrame:
    """(q, class, score, ids): per query the best k + 1 classes of every block that holds its candidates.
    ``asked`` holds (class, dim, v, depth)."""
    schema = T.StructType.fromDDL("q long, v array<double>, string long, depth int, dim int, tree int, block long")
    arrow = to_arrow_schema(schema)
    strings_of = query_strings(trees)

    def route(batches):
        known = Blocks(blocks.value)
        for b, dim, strings in strings_of(batches):
            depth = np.asarray(b.column("depth"))
            for t in range(trees):
                number = known.of[dim, t][0]
                first, last = known.ends(dim, t, strings[:, t], depth)
                n = np.maximum(0, last - first + 1)
                rows = np.repeat(np.arange(b.num_rows), n)
                place = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
                for lo in range(0, len(rows), 8192):
                    r, p = rows[lo: lo + 8192], place[lo: lo + 8192]
                    yield pa.RecordBatch.from_arrays([
                        b.column("class").take(pa.array(r)), b.column("v").take(pa.array(r)).cast(arrow.field("v").type),
                        pa.array(in_order(strings[r, t])), pa.array(depth[r]), pa.array(np.full(len(r), dim, np.int32)),
                        pa.array(np.full(len(r), t, np.int32)), pa.array(number[p])], schema=arrow)

    by = ["dim", "tree", "block"]
    sent = stored(asked.select("class", "dim", "v", "depth").mapInArrow(route, schema), "routed-queries")
    # a block that many queries ask for goes to several tasks, each with its share of them; at most MAX_BLOCKS x trees rows
    shares = F.broadcast(sent.groupBy(*by).agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("shares")).where("shares > 1"))
    count = F.coalesce("shares", F.lit(1))
    left = sent.join(shares, by, "left").withColumn("share", F.pmod(F.xxhash64("q"), count).cast("int")).drop("shares")
    entries = (forest.join(shares, by, "left").withColumn("share", F.explode(F.sequence(F.lit(0), count - 1))).drop("shares")
               .join(found.select("class", "v", "ids"), "class"))
    result = T.StructType.fromDDL("q long, class long, score double, ids array<long>")
    result_arrow = to_arrow_schema(result)

    def meet(key, left, right):
        empty = pa.table({f.name: pa.array([], f.type) for f in result_arrow}, schema=result_arrow)
        if not left.num_rows or not right.num_rows:
            return empty
        dim = key[0].as_py()
        right = right.sort_by("string").combine_chunks()
        here = as_string(np.asarray(right.column("string")))
        x, q = matrix(right.column("v"), dim), matrix(left.column("v"), dim)
        xs = scaled(x)
        xs /= np.linalg.norm(xs, axis=1, keepdims=True)
        qs = scaled(q)
        qs /= np.linalg.norm(qs, axis=1, keepdims=True)
        lo, hi = prefix_range(as_string(np.asarray(left.column("string"))), np.asarray(left.column("depth")))
        a, b = np.searchsorted(here, lo), np.searchsorted(here, hi, "right")
        qi, ci = [], []
        order = np.lexsort((b, a))
        for group in np.split(order, np.flatnonzero((np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)) + 1):
            start, stop = a[group[0]], b[group[0]]
            if start >= stop:
                continue
            for at in range(0, len(group), 256):
                mine = group[at: at + 256]
                near = qs[mine] @ xs[start:stop].T
                if near.shape[1] > k + 1:
                    # all that may tie with the last place, but for rounding
                    edge = np.partition(near, near.shape[1] - k - 1, axis=1)[:, near.shape[1] - k - 1]
                    r, c = np.nonzero(near >= edge[:, None] - 1e-12)
                else:
                    r, c = (i.ravel() for i in np.indices(near.shape))
                qi.append(mine[r])
                ci.append(start + c)
        if not qi:
            return empty
        qi, ci = np.concatenate(qi), np.concatenate(ci)
        score = cosines(q[qi], x[ci])
        ids = right.column("ids").combine_chunks()
        least = np.asarray(pc.list_element(ids, 0).fill_null(2**63 - 1))
        order = np.lexsort((least[ci], -score, qi))
        qi, ci, score = qi[order], ci[order], score[order]
        kept = np.arange(len(qi)) - np.searchsorted(qi, qi) <= k
        qi, ci, score = qi[kept], ci[kept], score[kept]
        return pa.table([left.column("q").take(pa.array(qi)), right.column("class").take(pa.array(ci)), pa.array(score),
                         ids.take(pa.array(ci))], schema=result_arrow)

    cell = [*by, "share"]
    return left.groupBy(*cell).cogroup(entries.groupBy(*cell)).applyInArrow(meet, result)


def nearest(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", trees: int = TREES,
            recall: float = RECALL, candidates: int | None = None) -> DataFrame:
    """(query_id, rank, id, score): the k nearest found for every row whose id meets ``is_query`` (a function of a column).

    ``candidates`` fixes how many entries an ascent gathers; by default it is learnt for ``recall``.
    """
    found, rows = vector_classes(vectors, k, id_col, vector_col)
    n_classes = found.count()
    rows = rows.where(F.coalesce(is_query(F.col("id")), F.lit(False)))
    sizes = rows.groupBy("a", "b").agg(F.count("*").alias("n_queries"))
    asked = stored(found.join(sizes, ["a", "b"]).select("class", "a", "b", "dim", "v", "n_queries"), "queries")
    forest = planted(found, n_classes, trees)
    bounds = forest.groupBy("dim", "tree", "block").agg(F.min("string").alias("low"), F.max("string").alias("high"),
                                                        F.count("*").alias("size")).collect()  # at most MAX_BLOCKS + trees rows
    blocks = vectors.sparkSession.sparkContext.broadcast(block_bounds(bounds))
    if candidates is None:
        candidates = candidates_needed(found, asked, forest, blocks, k, trees, recall)
    n = counted(asked, forest, blocks, trees, candidates)
    placed = stored(asked.join(n.select("class", depth_of("n", candidates).alias("depth")), "class"), "placed-queries")
    near = searched(placed, found, forest, blocks, k, trees)

    # one entry per class, whatever trees found it; then the k + 1 best members
    near = near.groupBy("q", "class").agg(F.first("score").alias("score"), F.first("ids").alias("ids"))
    best = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("id")))
    near = (near.select("q", "score", F.explode("ids").alias("id"), (F.col("q") == F.col("class")).alias("own"))
            .withColumn("place", best).where(F.col("place") <= k + 1)
            .groupBy("q").agg(F.array_sort(F.collect_list(F.struct("place", "id", "score", "own"))).alias("near")))
    # members of a query's class differ only in which row they leave out: one of their own id
    shares = F.ceil(F.col("n_queries") / (1 << 16)).cast("int")
    dealt = (placed.select(F.col("class").alias("q"), "a", "b", shares.alias("shares")).join(near, "q")
             .withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))))
    wide = dealt.where("shares > 1").select("a", "b", "shares").distinct()
    spread = (rows.join(wide, ["a", "b"], "left").withColumn(
        "share", F.pmod(F.monotonically_increasing_id(), F.coalesce("shares", F.lit(1)).cast("long")).cast("int")).drop("shares"))
    all_near = spread.join(dealt.drop("shares", "q"), ["a", "b", "share"])
    out = all_near.withColumn("me", F.expr("array_position(transform(near, x -> x.own AND x.id = id), true)"))
    others = F.filter("near", lambda x, i: i + 1 != F.col("me"))
    return (out.select(F.col("id").alias("query_id"), F.posexplode(F.slice(others, 1, k)).alias("at", "x"))
            .select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias("id"), F.col("x.score").alias("score")))


def recall_of(found: DataFrame, truth: DataFrame, k: int = 5) -> float:
    """Share of the true k nearest (query_id, id, score) that were found, counting equal scores as met."""
    least = truth.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n"))
    met = (found.join(least, "query_id").where(F.col("score") >= F.col("least") - 1e-12)
           .groupBy("query_id").agg(F.count("*").alias("met"), F.first("n").alias("n")))
    got = met.agg(F.sum(F.least("met", "n"))).first()[0] or 0
    total = least.agg(F.sum("n")).first()[0] or 0
    return got / total if total else 1.0
