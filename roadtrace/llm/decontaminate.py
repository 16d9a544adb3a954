"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

1. Every benchmark item becomes windows of ``window`` words, and every window the sequence of its shingles
   of ``SHINGLE`` words.
2. One pass over the documents explodes their shingles and keeps the positions of those that occur in the
   benchmark; this small table is written to the checkpoint folder.
3. Shingles are ordered by rarity, counted over the whole corpus.  All shingles of a window must be in a
   document, so one necessary prefix token suffices: its rarest shingle.  Positions join windows on it.
4. The prefix token's place in the window gives the start; length and positional bounds drop starts at
   which the window doesn't fit into the document.
5. The rest is verified: each shingle of the window must stand at its own place.  Shingles are compared as
   strings, so this is exact containment of the window's words.

The benchmark's shingles and windows are broadcast only if their counted rows are within
``BROADCAST_ROWS`` and ``BROADCAST_BYTES``; beyond them the same joins shuffle, with Spark's splitting of skewed partitions.

Defined cases: a null text, or one without words, has no words and no hits; benchmark rows with null id or
without words take no part; items may share windows or repeat; documents that share an id are told apart by
their text, and rows that repeat id and text get the same result; a very long text is one row whose shingles are
exploded one by one, its words are an array in memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadtrace.llm.common import NOT_WORD, stored, text_key, words

SHINGLE = 3
#: Broadcast bound: at most so many rows and bytes of strings.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20


def _sequence(first: int, count: Column) -> Column:
    """first, first + 1 ... (count values; none if count is not positive)."""
    return F.when(count > 0, F.sequence(F.lit(first), (count + (first - 1)).cast("int"))).otherwise(
        F.array().cast("array<int>"))


def _shingles(ws: str, k: int) -> Column:
    """The k-word shingle at every word; those at the end are shorter."""
    rest = [lambda i, j=j: F.get(F.col(ws), i + j) for j in range(1, k)]
    return F.transform(F.col(ws), lambda w, i: F.concat_ws(" ", w, *[r(i) for r in rest]))


def _fits(df: DataFrame, strings: str) -> bool:
    rows, size = df.agg(F.count("*"), F.sum(F.octet_length(strings).cast("long"))).first()
    return rows <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES


def _small(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def benchmark_windows(benchmark: DataFrame, window: int, id_col: str = "item_id", text_col: str = "text"):
    """(item windows (item, w), window shingles (w, size, k, off, shingle)); w is the window's words as one string."""
    items = (benchmark.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("item"), words(F.col(text_col)).alias("ws"))
             .where(F.size("ws") > 0).withColumn("n", F.least(F.size("ws"), F.lit(window))))
    cut = F.transform(_sequence(1, F.size("ws") - F.col("n") + 1), lambda i: F.slice("ws", i, F.col("n")))
    per_item = items.select("item", F.explode_outer(cut).alias("x")).select("item", F.array_join("x", " ").alias("w"), "x")
    item_windows = stored(per_item.select("item", "w").distinct(), "item-windows")
    one = item_windows.select("w").distinct().select("w", F.split("w", " ").alias("x"))
    one = one.withColumn("size", F.size("x")).withColumn("k", F.least(F.col("size"), F.lit(SHINGLE)))
    offs = F.transform(_sequence(0, F.col("size") - F.col("k") + 1),
                       lambda o: F.struct(o.alias("off"), F.array_join(F.slice("x", o + 1, F.col("k")), " ").alias("shingle")))
    shingles = one.select("w", "size", "k", F.explode_outer(offs).alias("s")).select("w", "size", "k", "s.off", "s.shingle")
    return item_windows, stored(shingles, "window-shingles")


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int, id_col: str, text_col: str):
    """(id, key, start, size, w) for every place in a document at which a benchmark window stands, and the item windows."""
    item_windows, shingles = benchmark_windows(benchmark, window)
    vocabulary = shingles.select("shingle").distinct()
    few = _fits(shingles, F.concat("w", "shingle"))
    kinds = sorted(r.k for r in shingles.select("k").distinct().collect())  # 1 to SHINGLE
    ws = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("key"), words(F.col(text_col)).alias("ws"))
    places = None
    for k in kinds:
        # _outer: no filter on the array is derived and pushed below, where it would be computed again
        at = (ws.select("id", "key", F.size("ws").alias("n"), F.posexplode_outer(_shingles("ws", k)).alias("pos", "shingle"))
              .join(_small(vocabulary, few), "shingle"))
        places = at if places is None else places.union(at)
    if places is None:
        places = (ws.select("id", "key", F.size("ws").alias("n"), F.lit(0).alias("pos"), F.lit("").alias("shingle")).where("false")
                  .select("shingle", "id", "key", "n", "pos"))
    places = stored(places, "benchmark-shingles")
    if len(kinds) > 1:
        places = places.distinct()
    # rarity over the corpus; a window with a shingle that never occurs has no occurrence
    counts = places.groupBy("shingle").agg(F.count("*").alias("df"))
    ranked = shingles.join(counts, "shingle", "left")
    prefix = (ranked.groupBy("w", "size").agg(
        F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "shingle", "off")).alias("p"),
        F.collect_list(F.struct("off", "shingle")).alias("all"))
        .where("p.df > 0").select("w", "size", F.col("p.shingle").alias("shingle"), F.col("p.off").alias("off"), "all"))
    candidates = (places.join(_small(prefix, few), "shingle")
                  .withColumn("start", F.col("pos") - F.col("off"))
                  .where("start >= 0 AND start + size <= n"))
    wanted = (candidates.select("id", "key", "start", "size", "w", F.size("all").alias("need"), F.explode("all").alias("s"))
              .select("id", "key", "start", "size", "w", "need", (F.col("start") + F.col("s.off")).alias("pos"),
                      F.col("s.shingle").alias("shingle")).distinct())
    had = places.select(F.col("id").alias("id2"), F.col("key").alias("key2"), F.col("pos").alias("pos2"),
                        F.col("shingle").alias("shingle2")).distinct()
    found = wanted.join(had, F.col("id").eqNullSafe(F.col("id2")) & (F.col("key") == F.col("key2"))
                        & (F.col("pos") == F.col("pos2")) & (F.col("shingle") == F.col("shingle2")))
    hits = (found.groupBy("id", "key", "start", "size", "w", "need").agg(F.count("*").alias("have"))
            .where("have = need").select("id", "key", "start", "size", "w"))
    return stored(hits, "benchmark-hits"), item_windows


def contaminated_words(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """(id, key, n_words, n_hit, items) of every document; ``items`` are the sorted ids, as strings, of the
    benchmark items of which a window occurs.  ``key`` is ``text_key`` of the text."""
    hits, item_windows = occurrences(docs, benchmark, window, id_col, text_col)
    # covered words: each start adds what lies beyond the furthest end before it
    spans = hits.groupBy("id", "key", "start").agg(F.max("size").alias("size"))
    before = Window.partitionBy("id", "key").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("size")
    reach = F.coalesce(F.max(end).over(before), F.lit(0))
    covered = (spans.withColumn("more", F.greatest(F.lit(0), end - F.greatest(F.col("start"), reach)))
               .groupBy("id", "key").agg(F.sum("more").alias("n_hit")))
    few = _fits(item_windows, "w")
    items = (hits.select("id", "key", "w").distinct().join(_small(item_windows, few), "w")
             .select("id", "key", F.col("item").cast("string").alias("item")).distinct()
             .groupBy("id", "key").agg(F.array_sort(F.collect_list("item")).alias("items")))
    # a document without an id joins its hits, too
    items = items.select(F.col("id").alias("item_doc"), F.col("key").alias("item_key"), "items")
    per_doc = covered.join(items, F.col("id").eqNullSafe(F.col("item_doc")) & (F.col("key") == F.col("item_key"))).select(
        F.col("id").alias("hit_id"), F.col("key").alias("hit_key"), "n_hit", "items")
    count = F.size(F.array_remove(F.split(F.coalesce(F.col(text_col), F.lit("")), NOT_WORD_ANY_CASE), ""))
    base = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("key"), count.cast("long").alias("n_words"))
    return (base.join(per_doc, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("key") == F.col("hit_key")), "left")
            .select("id", "key", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                    F.coalesce("items", F.array().cast("array<string>")).alias("items")))


#: The separators before lower-casing: upper-case letters are word characters, too.
NOT_WORD_ANY_CASE = NOT_WORD.replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60")
