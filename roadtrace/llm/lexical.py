"""Ranked lexical search with bag de-duplication.

1. Items are taken in batches of about ``BATCH_TERMS`` terms, so what is broadcast (a batch's vocabulary and items) has
   a bound of its own; an ordinary benchmark is one batch.
2. One pass over the whole texts counts each document's terms and restricts it to the batch's vocabulary: a bag of
   (term, tf).  N, L and df come from the bags of all documents.
3. Documents with the same bag and the same length factor m score alike for every item.  They meet by a 64-bit hash of
   both, are told apart by the bag itself, and become one class with its k least ids (k per class before the shuffle,
   so a bag that a third of the corpus shares sends a few rows per task).
4. Tasks score their classes once, in blocks, term by term against every item of the batch, and keep each item's k best
   documents: the k best classes by (score, least id), expanded to their members by ascending id.
5. A window per item merges the tasks' k best.

A document's score for an item is the sum over the item's terms, repeats included, of
``w * ((10**9 * tf) div (1000 * tf + 12 * m))`` with ``w = floor(1000 * ln((2N + 2) / (2df + 1)))`` and
``m = 75 + (25 * n * N) div L``: N documents with a term, L all terms, n the document's terms, df the documents that
hold the term.  All but the logarithm is exact 64-bit arithmetic.

Defined cases: null texts and texts without a term take no part and count for nothing; an item without terms, or none
of whose terms occurs, has no rows; ties go to the smaller id, null last; rows that repeat an id, a text or an item id
are documents and items of their own; fewer than k documents above 0 give fewer rows; a long text is split into words a
piece at a time.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from roadtrace.llm.common import pieces, stored, words

#: Terms, with repeats, of the items that are searched together.
BATCH_TERMS = 1 << 20
#: Bytes of a text that are split into words at a time.
PIECE_BYTES = 1 << 20
#: Classes of one block of scores.
BLOCK = 4096

_WORD = {*b"0123456789abcdefghijklmnopqrstuvwxyz", *range(128, 256)}
#: A-Z to a-z, every byte outside words to a space.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b in _WORD else 32 for b in range(256))


def terms_of(raw: bytes):
    """Runs of a text's terms."""
    at = 0
    while at < len(raw):
        end = at + PIECE_BYTES
        if end < len(raw):
            # up to the end of the term that the piece cuts
            while end < len(raw) and _TABLE[raw[end]] != 32:
                end += 1
        yield raw[at:end].translate(_TABLE).split()
        at = end


def items_of(texts: list[bytes]) -> tuple[dict[bytes, int], list[tuple[np.ndarray, np.ndarray]]]:
    """A batch's vocabulary, and its items as (term ids, how often each occurs)."""
    counts = [Counter(t for run in terms_of(x) for t in run) for x in texts]
    vocabulary = {t: i for i, t in enumerate(sorted({t for c in counts for t in c}))}
    return vocabulary, [(np.array([vocabulary[t] for t in c], np.int64), np.array(list(c.values()), np.int64)) for c in counts]


def bag_of(raw: bytes, vocabulary: dict[bytes, int]) -> tuple[int, np.ndarray]:
    """(all terms, rows (term, tf) of the vocabulary's terms by term)."""
    n, held = 0, Counter()
    for run in terms_of(raw):
        n += len(run)
        held.update(filter(vocabulary.__contains__, run))
    bag = np.array([(vocabulary[t], c) for t, c in held.items()], np.int64).reshape(-1, 2)
    return n, bag[np.argsort(bag[:, 0])]


def bags(docs: DataFrame, items) -> DataFrame:
    """(id, n, bag) of every document; the bag is the bytes of (term, tf) rows as 64-bit integers."""
    schema = T.StructType.fromDDL("id long, n long, bag binary")
    arrow = to_arrow_schema(schema)

    def run(batches):
        vocabulary = items.value[0]
        for b in pieces(batches):
            n, bag = [], []
            for raw in b.column("text").cast(pa.binary()).to_pylist():
                size, held = bag_of(raw or b"", vocabulary)
                n.append(size)
                bag.append(held.tobytes())
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n, pa.int64()), pa.array(bag, pa.binary())], schema=arrow)

    return docs.mapInArrow(run, schema)


def document_frequencies(found: DataFrame, n_terms: int) -> np.ndarray:
    """Documents that hold each term of the vocabulary."""
    schema = T.StructType.fromDDL("term long, df long")

    def run(batches):
        df = np.zeros(n_terms, np.int64)
        for b in pieces(batches, BLOCK):
            terms = np.frombuffer(b"".join(b.column("bag").to_pylist()), np.int64).reshape(-1, 2)[:, 0]
            df += np.bincount(terms, minlength=n_terms)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["term", "df"])

    out = np.zeros(n_terms, np.int64)
    for r in found.select("bag").mapInArrow(run, schema).groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r.term] = r.df
    return out


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)


def classes(found: DataFrame, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(m, bag, ids): documents of equal bag and m, with the k least ids (null last)."""
    m = F.expr(f"75 + (25L * n * {n_docs}L) div {n_terms}L")
    rows = (found.where(F.octet_length("bag") > 0).withColumn("m", m).withColumn("h", F.xxhash64("m", "bag"))
            .select("h", "m", "bag", F.struct(F.col("id").isNull().alias("none"), "id").alias("id")))
    place = F.row_number().over(Window.partitionBy("h", "m", "bag").orderBy("id"))
    return (rows.withColumn("place", place).where(F.col("place") <= k)
            .groupBy("h", "m", "bag").agg(F.array_sort(F.collect_list("id")).alias("ids")).select("m", "bag", "ids"))


class Best:
    """The k best documents of every item so far: scores, descending, and ids, ascending at equal scores (null as the
    largest integer)."""

    def __init__(self, n_items: int, k: int):
        self.k = k
        self.found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))] * n_items

    def least(self, item: int) -> int:
        """A score below this can't come in; 0 never does."""
        s = self.found[item][0]
        return int(s[-1]) if len(s) == self.k else 1

    def take(self, item: int, score: np.ndarray, at: np.ndarray, lists: tuple):
        """Classes ``at`` with their scores; ``lists`` holds all classes' members (first, bounds, ids, null)."""
        first, bounds, ids, none = lists
        if len(at) > self.k:
            # the k best classes by (score, least id) hold the k best documents
            edge = np.partition(score, len(score) - self.k)[len(score) - self.k]
            at, score = at[score >= edge], score[score >= edge]
            order = np.lexsort((first[at], -score))[: self.k]
            at, score = at[order], score[order]
        n = bounds[at + 1] - bounds[at]
        member = np.repeat(bounds[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        s, i, x = (np.concatenate(p) for p in zip(self.found[item], (np.repeat(score, n), ids[member], none[member])))
        order = np.lexsort((x, i, -s))[: self.k]
        self.found[item] = s[order], i[order], x[order]


def score_block(items: list, w: np.ndarray, m: np.ndarray, raw: list[bytes], lists: tuple, best: Best):
    """Scores a block of classes against every item."""
    sizes = np.array([len(x) // 16 for x in raw])
    rows = np.frombuffer(b"".join(raw), np.int64).reshape(-1, 2)
    of = np.repeat(np.arange(len(raw)), sizes)
    term, tf = rows[:, 0], rows[:, 1]
    gain = w[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[of]))
    order = np.argsort(term, kind="stable")
    term, of, gain = term[order], of[order], gain[order]
    start = np.searchsorted(term, np.arange(len(w) + 1))
    top = int(gain.max(initial=0))
    for item, (terms, times) in enumerate(items):
        spans = [(start[t], start[t + 1], c) for t, c in zip(terms.tolist(), times.tolist()) if start[t] < start[t + 1]]
        if not spans:
            continue
        where = np.concatenate([of[a:b] for a, b, _ in spans])
        what = np.concatenate([gain[a:b] if c == 1 else c * gain[a:b] for a, b, c in spans])
        if top * int(times.sum()) < 1 << 53:
            score = np.bincount(where, what, minlength=len(raw)).astype(np.int64)
        else:
            score = np.zeros(len(raw), np.int64)
            np.add.at(score, where, what)
        at = np.flatnonzero(score >= best.least(item))
        if len(at):
            best.take(item, score[at], at, lists)


def ranked(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id, rank, id, score): the k best documents of every item."""
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    asked = stored(items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"))
                   .withColumn("item", F.monotonically_increasing_id()), "items")
    n_terms = asked.agg(F.sum(F.size(words(F.col("text"))).cast("long"))).first()[0] or 0
    batches = max(1, -(-n_terms // BATCH_TERMS))
    out = None
    for i in range(batches):
        mine = asked.where(F.pmod(F.xxhash64("item"), F.lit(batches)) == i) if batches > 1 else asked
        found = _ranked_batch(spark, base, mine.toArrow(), k, items.schema[item_col].dataType)
        out = found if out is None else out.unionByName(found)
    return out


def _ranked_batch(spark, base: DataFrame, batch: pa.Table, k: int, id_type: T.DataType) -> DataFrame:
    item_ids, numbers = (batch.column(c).combine_chunks() for c in ("item_id", "item"))
    items = spark.sparkContext.broadcast(items_of([x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]))
    n_vocabulary = len(items.value[0])
    found = stored(bags(base, items), "bags")
    n_docs, n_terms = (x or 0 for x in found.agg(F.count(F.when(F.col("n") > 0, 1)), F.sum("n")).first())
    w = weights(document_frequencies(found, n_vocabulary), n_docs)
    of_batch = spark.sparkContext.broadcast((w, item_ids, numbers))
    schema = T.StructType([T.StructField("item", T.LongType()), T.StructField("item_id", id_type),
                           T.StructField("id", T.LongType()), T.StructField("score", T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(parts):
        w, item_ids, numbers = of_batch.value
        best = Best(len(numbers), k)
        for b in pieces(parts, BLOCK):
            members = b.column("ids")
            sizes = np.asarray(members.value_lengths())
            flat = members.flatten().field("id")
            none = np.asarray(flat.is_null())
            ids = np.asarray(flat.fill_null(2**63 - 1))
            bounds = np.concatenate(([0], np.cumsum(sizes)))
            score_block(items.value[1], w, np.asarray(b.column("m")), b.column("bag").to_pylist(),
                        (ids[bounds[:-1]], bounds, ids, none), best)
        which = np.repeat(np.arange(len(numbers)), [len(s) for s, _, _ in best.found])
        if len(which):
            score, ids, none = (np.concatenate(x) for x in zip(*best.found))
            yield pa.RecordBatch.from_arrays([numbers.take(pa.array(which)), item_ids.take(pa.array(which)),
                                              pa.array(ids, mask=none), pa.array(score)], schema=arrow)

    near = classes(found, n_docs, max(1, n_terms), k).mapInArrow(run, schema)
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id")))
    return near.withColumn("rank", place).where(F.col("rank") <= k).select("item_id", "rank", "id", "score")
