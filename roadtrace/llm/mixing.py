"""Mixing sources to target weights by hash-random order and distributed prefix sums.

1. One pass counts each source's words.  Targets are shares by weight of ``share`` times all words; a
   target stops at ``max_epochs`` times its source's size and the excess is shared anew by weight, one small
   aggregate over the sources per round, until none is above.  Sources get their weights by rank: they are
   dealt to ranges of about ``SOURCES`` and numbered inside each, so there may be millions of them.
2. Every document has a hash-random key (of id and text).  Each source's keys are cut into ranges of about
   ``RANGE_ROWS`` documents; range totals get prefix sums per source in two levels (blocks of ``BLOCK_RANGES``
   ranges, then the ranges of a block), and a window inside each range (source, range) adds the running sum
   in key order.  A source with a third of all rows is therefore sorted by as many tasks as its rows need,
   never by one.
3. A source gives whole epochs and then its documents in key order up to its exact budget (the target
   rounded to a whole word); the document at the cut gives its first words only.

Defined cases: a null or empty text has size 0 and gives nothing; a null source is a source of its own,
last in the order; a null id is hashed without it; rows that repeat id and text have equal keys, so either
may stand at the cut; a source without words has target 0; a very long text counts all its words and may alone
fill a budget, of which it then gives a part; an input column that has a result's name is replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadtrace.llm.common import stored, text_key, white_words, with_columns

RANGE_ROWS = 2048
#: Ranges of one block of a source's prefix sums, and sources of one range of ranks.
BLOCK_RANGES, SOURCES = 4096, 1 << 16
SEED = 20240917


def ranked_sources(sizes: DataFrame, n_sources: int) -> DataFrame:
    """One row per source with ``rank``, from 1, by code point, null last; numbered inside ranges of sources."""
    ranges = max(1, -(-n_sources // SOURCES))
    dealt = stored(sizes.repartitionByRange(ranges, "is_null", "src").withColumn("part", F.spark_partition_id()), "ranged-sources")
    upto, base = 0, []
    for r in sorted(dealt.groupBy("part").count().collect()):     # one row per SOURCES sources
        base.append((r.part, upto))
        upto += r["count"]
    base = F.broadcast(sizes.sparkSession.createDataFrame(base, "part int, base long"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("is_null", "src"))
    return dealt.withColumn("place", place).join(base, "part").withColumn("rank", F.col("base") + F.col("place")).drop(
        "part", "place", "base")


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, max_epochs: int) -> DataFrame:
    """(is_null, src, source_size, target) from one row per source."""
    n_sources, total = sizes.agg(F.count("*"), F.sum("source_size")).first()
    sizes = ranked_sources(sizes, n_sources)
    sizes = (sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                                                ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
             .withColumn("cap", F.col("source_size") * float(max_epochs)))
    sizes = stored(sizes, "weighted-sources")
    total = float(total or 0) * share
    left, open_weight, stopped = total, sizes.agg(F.sum("w")).first()[0] or 0.0, 0
    while open_weight:
        above = F.lit(left) * F.col("w") / F.lit(open_weight) >= F.col("cap")
        n, caps, weight = sizes.agg(F.count_if(above), F.sum(F.when(above, F.col("cap"))), F.sum(F.when(~above, F.col("w")))).first()
        if n <= stopped:
            break
        left, open_weight, stopped = total - (caps or 0.0), weight or 0.0, n
    goal = F.col("cap")
    if open_weight:
        shared = F.lit(left) * F.col("w") / F.lit(open_weight)
        goal = F.when(shared >= F.col("cap"), F.col("cap")).otherwise(shared)
    return sizes.select("is_null", "src", "source_size", goal.alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, max_epochs: int = 2,
        keep: list[str] | None = None, id_col: str = "doc_id", source_col: str = "source",
        text_col: str = "text") -> DataFrame:
    """The columns ``keep`` (all) of every document with ``size``, ``source_size``, ``target`` (its source's),
    ``epochs`` (times it is taken whole) and ``taken`` (words taken; those beyond the whole epochs are its first)."""
    keep = docs.columns if keep is None else keep
    base = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(source_col).isNull().alias("is_null"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("src"),
        F.size(white_words(F.col(text_col))).cast("long").alias("size"),
        F.shiftrightunsigned(F.xxhash64(F.lit(SEED), F.col(id_col), text_key(F.col(text_col))), 1).alias("u"))
    if text_col not in keep:
        base = stored(base, "sizes")
    # what each source has; one row per source from here to the targets
    sizes = stored(base.groupBy("is_null", "src").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), "sources")
    rows = sizes.agg(F.sum("n")).first()[0] or 0
    ranges = max(1, -(-rows // RANGE_ROWS))
    goal = targets(sizes.drop("n"), weights, share, max_epochs)
    goal = (goal.withColumn("budget", F.floor(F.col("target") + 0.5))
            .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(F.lit(0)))
            .withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size")))
    base = base.withColumn("range", F.floor(F.shiftright("u", 32) * F.lit(ranges) / F.lit(2.0**31)))
    per_range = (base.groupBy("is_null", "src", "range").agg(F.sum("size").alias("range_size"))
                 .withColumn("block", F.floor(F.col("range") / BLOCK_RANGES)))

    def before(column, *by):
        window = Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(column).over(window), F.lit(0))

    blocks = (per_range.groupBy("is_null", "src", "block").agg(F.sum("range_size").alias("block_size"))
              .withColumn("earlier", before("block_size", "is_null", "src", "block")).drop("block_size"))
    offsets = (per_range.withColumn("offset", before("range_size", "is_null", "src", "block", "range"))
               .join(blocks, ["is_null", "src", "block"]).withColumn("offset", F.col("offset") + F.col("earlier"))
               .drop("range_size", "block", "earlier").join(goal, ["is_null", "src"]))
    inside = (Window.partitionBy("is_null", "src", "range").orderBy("u", "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    out = (base.join(offsets, ["is_null", "src", "range"])
           .withColumn("before", F.col("offset") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
           .withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before")))))
    return out.select(*with_columns(out, {
        "size": F.col("size"), "source_size": F.col("source_size"), "target": F.col("target"),
        "epochs": F.col("epochs").cast("int"),
        "taken": (F.col("epochs") * F.col("size") + F.col("part")).cast("long")}))


def copies(mixed: DataFrame, text_col: str = "text") -> DataFrame:
    """One row per copy that the mix takes (``epoch`` from 0), with its text; the copy at a source's cut has the
    first words of its text, joined by one space."""
    each = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(F.lit(0)).cast("int")
    out = (mixed.where(F.col("taken") > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0), each - 1)))
           .withColumn("taken", F.least(F.col("size"), F.col("taken") - F.col("epoch") * F.col("size"))))
    first = F.array_join(F.slice(white_words(F.col(text_col)), 1, F.col("taken").cast("int")), " ")
    return out.withColumn(text_col, F.when(F.col("taken") < F.col("size"), first).otherwise(F.col(text_col)))
