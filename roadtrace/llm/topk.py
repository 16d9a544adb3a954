"""Exact top-k search by integer inner product with multi-resolution segment statistics.

1. Vectors are turned into integers, floor(scale * x), once (a table in the checkpoint folder).
2. Queries are dealt to blocks, candidates to parts; every (block, part) cell is one task's work, of bounded
   size, so a stated query set meets all rows in blocks and neither side is broadcast or gathered.
3. In a cell each vector is summarised at several resolutions by the mean and the deviation of its segments.
   With n the segment's length, the squared distance of q and c is at least
   sum n * (mean_q - mean_c)**2 + (dev_q - dev_c)**2, which caps their inner product at
   (|q|**2 + |c|**2 - that bound) / 2.  Candidates whose cap is below a query's k-th best score so far drop
   out, coarse to fine; exact products are computed for the survivors only.
4. A cell returns k rows per query; a window per query keeps the best k of them.

Ties go to the smaller id (null last), so equal caps are kept.  No candidate is dropped without a proof that it
cannot be among the k best.

Products that may leave 2**53 or a long are computed in integers or in words of 22 bits, so every score is exact; a
result whose score is no long raises an error.

Defined cases: vectors that are null, or hold a null or a non-finite component, take no part, nor do those with a
component that is no long after scaling (2**63 and more, where a score can hardly be a long); only vectors of one length meet; other columns are ignored; a null id is never a query; rows that repeat an id are
rows of their own, a query leaves out only itself; fewer than k candidates give fewer rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from roadtrace.llm.common import stored

#: Numbers of segments, coarse to fine.
LEVELS = (4, 8, 16, 32)
#: Queries and candidates of one cell.
BLOCK, PART = 2048, 16_384
#: Candidates of one step inside a cell.
STEP = 2048
#: Components below this, after scaling, are stored as int, all others as long.
NARROW = 1 << 24
WORD = 22


def quantised(vectors: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(row, id, dim, v, wide): the vectors that take part, as integers, in ``v`` or, if they need it, as long in
    ``wide``; ``row`` numbers the rows."""
    schema = T.StructType.fromDDL("id long, dim int, v array<int>, wide array<long>")
    arrow = to_arrow_schema(schema)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                piece = b.slice(at, 2048)
                ids, lists = piece.column(0), piece.column(1)
                dim = np.asarray(lists.value_lengths().fill_null(0))
                flat = lists.flatten()
                x = np.floor(np.asarray(flat.fill_null(np.nan)) * float(scale))
                ends = np.cumsum(dim)

                def none(bad):
                    bads = np.concatenate(([0], np.cumsum(bad)))
                    return bads[ends] == bads[ends - dim]

                bad = ~(np.abs(x) < 2.0**63)
                ok = np.asarray(lists.is_valid()) & none(bad)
                x[bad] = 0
                small = none(np.abs(x) >= NARROW)

                def column(mine, dtype, field):
                    flat = pa.array(x[np.repeat(mine, dim)].astype(dtype))
                    bounds = np.concatenate(([0], np.cumsum(np.where(mine, dim, 0)))).astype(np.int32)
                    at = pa.array(bounds, mask=np.append(~mine, False))  # a null offset is a null list
                    return pa.ListArray.from_arrays(at, flat).cast(field.type)

                out = pa.RecordBatch.from_arrays([ids, pa.array(dim.astype(np.int32)), column(small, np.int32, arrow.field(2)),
                                                  column(~small, np.int64, arrow.field(3))], schema=arrow)
                yield out.filter(pa.array(ok))

    x = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    out = stored(x.mapInArrow(run, schema), "vectors")
    return stored(out.withColumn("row", F.monotonically_increasing_id()), "numbered-vectors")


class Segments:
    """Scaled means and deviations of vectors at every resolution; products of them cap inner products."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.levels = []
        for n in (n for n in LEVELS if n < x.shape[1]):
            cuts = np.linspace(0, x.shape[1], n + 1).astype(int)
            length = np.diff(cuts)
            mean = np.add.reduceat(x, cuts[:-1], axis=1) / length
            dev = np.sqrt(np.maximum(0, np.add.reduceat((x - np.repeat(mean, length, axis=1)) ** 2, cuts[:-1], axis=1)))
            # sum n m_q m_c + d_q d_c = (|q|^2 + |c|^2 - sum n (m_q - m_c)^2 - sum (d_q - d_c)^2) / 2
            self.levels.append(np.concatenate((mean * np.sqrt(length), dev), axis=1))
        self.norm = np.sqrt((x ** 2).sum(axis=1))


def _wide_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two int64 matrices as Python integers, by words of ``WORD`` bits."""
    total = np.zeros(len(a), object)
    mask = (1 << WORD) - 1
    for lo in range(0, a.shape[1], 1 << 18):
        left, right = ([x & mask, (x >> WORD) & mask, x >> 2 * WORD] for x in (a[:, lo: lo + (1 << 18)], b[:, lo: lo + (1 << 18)]))
        for i, x in enumerate(left):
            for j, y in enumerate(right):
                total += np.einsum("ij,ij->i", x, y).astype(object) * (1 << WORD * (i + j))
    return total


def _products(a: np.ndarray, b: np.ndarray, top_a: np.ndarray, top_b: np.ndarray):
    """(over, score) of rows of int64 matrices with components up to ``top``: ``over`` is 1 above the range of a long,
    -1 below it, else 0 and ``score`` is exact."""
    over, score = np.zeros(len(a), np.int8), np.zeros(len(a), np.int64)
    fits = a.shape[1] * top_a * top_b < 2.0**62
    score[fits] = np.einsum("ij,ij->i", a[fits], b[fits])
    if not fits.all():
        wide = _wide_products(a[~fits], b[~fits])
        over[~fits] = (wide >= 2**63).astype(np.int8) - (wide < -2**63).astype(np.int8)
        score[~fits] = np.where(over[~fits] == 0, wide, 0).astype(np.int64)
    return over, score


def best_of_cell(q_row, q_vec, c_row, c_id, c_vec, k: int):
    """(query index, candidate index, over, score) of each query's k best candidates, by score, then id; ``over`` as in
    ``_products``."""
    q_top, c_top = (np.abs(x.astype(np.float64)).max(axis=1, initial=0) for x in (q_vec, c_vec))
    narrow = q_vec.shape[1] * q_top.max(initial=0) * c_top.max(initial=0) < 2**53
    exact = np.float64 if narrow else np.int64
    q, c = Segments(q_vec.astype(np.float64)), Segments(c_vec.astype(np.float64))
    qx, cx = q_vec.astype(exact), c_vec.astype(exact)
    got = [np.zeros(0, np.int64)] * 2 + [np.zeros(0, np.int8), np.zeros(0, np.int64)]
    least = np.full(len(q_row), -np.inf)  # k-th best score so far

    def take(qi, ci):
        nonlocal got, least
        keep = q_row[qi] != c_row[ci]
        qi, ci = qi[keep], ci[keep]
        over, score = np.zeros(len(qi), np.int8), np.zeros(len(qi), np.int64)
        for a in range(0, len(qi), 65536):
            x, y = qi[a: a + 65536], ci[a: a + 65536]
            if narrow:
                score[a: a + 65536] = np.einsum("ij,ij->i", qx[x], cx[y])
            else:
                over[a: a + 65536], score[a: a + 65536] = _products(qx[x], cx[y], q_top[x], c_top[y])
        qi, ci, over, score = (np.concatenate(x) for x in zip(got, (qi, ci, over, score)))
        order = np.lexsort((c_id[ci], ~score, -over, qi))
        qi, ci, over, score = qi[order], ci[order], over[order], score[order]
        rank = np.arange(len(qi)) - np.searchsorted(qi, qi)
        got = [x[rank < k] for x in (qi, ci, over, score)]
        full = rank == k - 1
        # a bound from below where the score is no long
        least[qi[full]] = np.where(over[full] > 0, 2.0**63, np.where(over[full] < 0, -np.inf, score[full]))

    for lo in range(0, len(c_row), STEP):
        some = np.arange(lo, min(lo + STEP, len(c_row)))
        slack = 1e-9 * np.outer(q.norm, c.norm[some]) + 1e-6
        if q.levels:
            cap = q.levels[0] @ c.levels[0][some].T + slack
            if lo == 0 and len(some) > 4 * k:
                # the most promising candidates first, for a threshold
                first = np.argpartition(-cap, k, axis=1)[:, : k + 1]
                take(np.repeat(np.arange(len(q_row)), first.shape[1]), some[first.ravel()])
                cap[np.repeat(np.arange(len(q_row)), first.shape[1]), first.ravel()] = -np.inf
            alive = cap >= least[:, None]
            alive &= cap > -np.inf
            qi, ci = np.nonzero(alive)
        else:
            qi, ci = (x.ravel() for x in np.indices((len(q_row), len(some))))
        for ql, cl in zip(q.levels[1:], c.levels[1:]):
            if not len(qi):
                break
            if 4 * len(qi) > len(q_row) * len(some):
                cap = (ql @ cl[some].T)[qi, ci]
            else:
                cap = np.concatenate([np.einsum("ij,ij->i", ql[qi[a: a + 65536]], cl[some[ci[a: a + 65536]]])
                                      for a in range(0, len(qi), 65536)])
            on = cap + slack[qi, ci] >= least[qi]
            qi, ci = qi[on], ci[on]
        if len(qi):
            take(qi, some[ci])
    return got


def exact_topk(vectors: DataFrame, is_query, k: int = 5, scale: int = 256, id_col: str = "vec_id",
               vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): the k best rows for every row whose id meets ``is_query`` (a function of a column)."""
    rows = quantised(vectors, scale, id_col, vector_col)
    queries = rows.where(F.coalesce(is_query(F.col("id")), F.lit(False)))
    n_queries, n_rows = queries.count(), rows.count()
    blocks, parts = max(1, -(-n_queries // BLOCK)), max(1, -(-n_rows // PART))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")).withColumn("part", every(parts))
    there = rows.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int")).withColumn("block", every(blocks))
    schema = T.StructType.fromDDL("q long, query_id long, id long, over int, score long")
    arrow = to_arrow_schema(schema)

    def run(key, left, right):
        if not left.num_rows or not right.num_rows:
            return pa.table({f.name: pa.array([], f.type) for f in arrow}, schema=arrow)
        dim = key[0].as_py()

        def matrix(data):
            out = np.empty((data.num_rows, dim), np.int64)
            for name in ("v", "wide"):
                x = data.column(name).combine_chunks()
                mine = np.asarray(x.is_valid())
                out[mine] = np.asarray(x.flatten(), np.int64).reshape(int(mine.sum()), dim)
            return out

        c_id = right.column("id").combine_chunks()
        ranked = np.asarray(c_id.fill_null(2**63 - 1))
        qi, ci, over, score = best_of_cell(np.asarray(left.column("row")), matrix(left), np.asarray(right.column("row")), ranked,
                                           matrix(right), k)
        return pa.table({"q": left.column("row").take(pa.array(qi)), "query_id": left.column("id").take(pa.array(qi)),
                         "id": c_id.take(pa.array(ci)), "over": pa.array(over.astype(np.int32)), "score": pa.array(score)}, schema=arrow)

    near = asked.groupBy("dim", "block", "part").cogroup(there.groupBy("dim", "block", "part")).applyInArrow(run, schema)
    best = Window.partitionBy("q").orderBy(F.desc("over"), F.desc("score"), F.asc_nulls_last("id"))
    score = F.when(F.col("over") == 0, F.col("score")).otherwise(
        F.raise_error(F.lit("a score of the top k is beyond the range of a long")).cast("long"))
    return (near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "id", score.alias("score")))
