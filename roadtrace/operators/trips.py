"""Trip sessionization (W3-W7, J7) and gate-to-gate segments.

A plate's sightings, in the total order ``(ts, gate, lane, nationality)``,
are cut into trips.  A new trip starts at the plate's first sighting and at
every consecutive pair ``(prev, cur)`` for which the split rule holds.  Each
row gets ``tripid`` (dense per plate, from 1), ``step`` (position in its
trip, from 1) and, when ``step > 1``, the previous sighting's gate and
instant, which is the segment that ends at this row.

Split rules, with L = (prev gate, gate) is a pair of the network closure,
C = L and the pair is cut-eligible (entry/exit, no service area), and
T = whole minutes between the two sightings > ``cut_minutes``:

* ``as_coded``   : L or (not C and T)   -- what the original program computes
* ``documented`` : not L or (C and T)   -- what its documentation describes
* ``gap``        : T                    -- time only

Distribution.  Every row takes the same path: one shuffle on
``(plate, chunk)``, one window per chunk (``windowed``), and the columns of
all split rules side by side.  An ordinary plate is one chunk.  A plate with
more than ``hot_threshold`` sightings is cut into chunks of about that many
rows by cumulative row counts (``chunk_map``), so a burst gets as many chunks
as its rows need; a single instant above the threshold is cut further by gate
and lane.  What crosses a chunk border -- the previous sighting, the rows and
trips before the chunk, where the open trip started -- comes from one summary
row per chunk of a hot plate (``chunk_summary``), and ``stitched`` joins it
back to the windowed rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadtrace.functions.time import epoch_seconds, minutes_between
from roadtrace.plans.joins import bounded_broadcast, record_bound
from roadtrace.schema import SEQUENCE_ORDER
from roadtrace.sources.stages import write_counted

POLICIES = ("as_coded", "documented", "gap")
CUT_MINUTES = 30                 # fixed value: trip cut time of the original analysis
HOT_PLATE_ROWS = 2_000_000       # sightings above which a plate is cut into chunks of about as many
RANGE_PLATES = 1_000_000         # plates of one range of the global numbering
TRIP_CHUNK = 4096                # steps of one array of the nested view


def split_rule(policy: str, gap_minutes: Column, legal: Column, cut_ok: Column,
               cut_minutes: int) -> Column:
    """The split test for one consecutive pair."""
    t = gap_minutes > F.lit(cut_minutes)
    if policy == "as_coded":
        return legal | (~cut_ok & t)
    if policy == "documented":
        return ~legal | (cut_ok & t)
    if policy == "gap":
        return t
    if policy == "none":
        return F.lit(False)
    raise ValueError(f"unknown split policy {policy!r}; expected one of {POLICIES}")


def _with_split(df: DataFrame, prev_gate: Column, gate: Column, prev_ts: Column, ts: Column,
                pairs: DataFrame | None, policy: str, cut_minutes: int, out: str) -> DataFrame:
    """Add boolean ``out`` = split rule of (prev, cur); null when prev is null.

    J7: legality is a broadcast left join of the pair to the closure pairs
    (bounded by #gates^2, checked by ``bounded_broadcast``) instead of a
    driver-side set.
    """
    gap = minutes_between(prev_ts, ts)
    if policy in ("gap", "none"):
        rule = split_rule(policy, gap, F.lit(False), F.lit(False), cut_minutes)
        return df.withColumn(out, F.when(prev_gate.isNull(), F.lit(None).cast("boolean"))
                             .otherwise(rule))
    if pairs is None:
        raise ValueError(f"policy {policy!r} needs the network closure pairs")
    lookup = bounded_broadcast(pairs).select(F.col("gatefrom").alias("_lk_from"),
                                             F.col("gateto").alias("_lk_to"),
                                             F.col("is_cut").alias("_lk_cut"))
    j = df.join(lookup, (prev_gate == F.col("_lk_from")) & (gate == F.col("_lk_to")), "left")
    legal = F.col("_lk_from").isNotNull()
    cut_ok = F.coalesce(F.col("_lk_cut"), F.lit(False))
    rule = F.when(prev_gate.isNull(), F.lit(None).cast("boolean")).otherwise(
        split_rule(policy, gap, legal, cut_ok, cut_minutes))
    return j.withColumn(out, rule).drop("_lk_from", "_lk_to", "_lk_cut")


def _day(ts: str = "ts") -> Column:
    return F.to_date(ts)


def hot_plates(df: DataFrame, hot_threshold: int = HOT_PLATE_ROWS) -> DataFrame:
    """Plates with more than ``hot_threshold`` sightings (at most rows / threshold of them)."""
    return (df.groupBy("plate").agg(F.count(F.lit(1)).alias("_n"))
            .filter(F.col("_n") > hot_threshold).select("plate"))


def chunk_map(df: DataFrame, hot_threshold: int = HOT_PLATE_ROWS) -> DataFrame | None:
    """Where hot plates are cut: ``(plate, _day, _starts, _huge)``, or None without hot plates.

    ``_starts`` holds the day's chunks (first instant and number) and ``_huge``
    the instants with more than ``hot_threshold`` rows.  Chunk numbers are
    cumulative row counts over the plate's instants divided by the threshold:
    prefix sums over days, then over the instants of a day (at most 86,400),
    so no task sorts a whole hot plate.  Only ``plate`` and ``ts`` are read.
    The map is a written table; its broadcast bound counts the arrays' elements.
    """
    hot, n_hot = write_counted(df.sparkSession, hot_plates(df, hot_threshold))
    if not n_hot:
        return None
    width = F.lit(max(hot_threshold, 1))
    per = (df.select("plate", "ts").join(bounded_broadcast(hot, known_rows=n_hot), "plate", "left_semi")
           .groupBy("plate", _day().alias("_day"), "ts").agg(F.count(F.lit(1)).alias("_c")))
    days = per.groupBy("plate", "_day").agg(F.sum("_c").alias("_dc"))
    earlier_days = Window.partitionBy("plate").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("plate", "_day", F.coalesce(F.sum("_dc").over(earlier_days), F.lit(0)).alias("_off"))
    earlier = Window.partitionBy("plate", "_day").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    per = (per.join(days, ["plate", "_day"])
           .withColumn("_chunk", F.floor((F.col("_off") + F.coalesce(F.sum("_c").over(earlier), F.lit(0))) / width)))
    found = (per.groupBy("plate", "_day", "_chunk")
             .agg(F.min("ts").alias("_from"), F.collect_list(F.when(F.col("_c") > width, F.col("ts"))).alias("_huge"))
             .groupBy("plate", "_day")
             .agg(F.array_sort(F.collect_list(F.struct("_from", "_chunk"))).alias("_starts"),
                  F.flatten(F.collect_list("_huge")).alias("_huge")))
    found, _ = write_counted(df.sparkSession, found)
    elements = found.agg(F.sum(F.size("_starts") + F.size("_huge"))).first()[0]
    return record_bound(found, elements)


def with_chunk(df: DataFrame, chunks: DataFrame | None) -> DataFrame:
    """Add ``_hot``, ``_chunk`` and ``_sub``; in their order, chunks follow the total order of a plate's rows."""
    whole = F.struct(F.lit(False).alias("cut"), F.lit(0).alias("gate"), F.lit(0.0).alias("lane"))
    if chunks is None:
        return df.withColumns({"_hot": F.lit(False), "_chunk": F.lit(0).cast("long"), "_sub": whole})
    cols = df.columns
    j = df.withColumn("_day", _day()).join(bounded_broadcast(chunks), ["plate", "_day"], "left")
    last = F.element_at(F.filter("_starts", lambda s: s["_from"] <= F.col("ts")), -1)
    sub = F.when(F.array_contains("_huge", F.col("ts")),
                 F.struct(F.lit(True).alias("cut"), F.col("gate").alias("gate"), F.col("lane").alias("lane")))
    return j.select(*cols, F.col("_starts").isNotNull().alias("_hot"),
                    F.coalesce(last["_chunk"], F.lit(0)).cast("long").alias("_chunk"),
                    F.coalesce(sub, whole).alias("_sub"))


CHUNK = ["plate", "_chunk", "_sub"]


def windowed(df: DataFrame, pairs: DataFrame | None, policies: tuple[str, ...], cut_minutes: int,
             chunks: DataFrame | None) -> DataFrame:
    """Every sighting with its place in its chunk and, per policy, the splits inside the chunk.

    ``_rn`` is the position, ``_pg``/``_pt`` the previous sighting of the
    chunk; ``_cum_p`` counts policy p's splits up to the row and ``_last_p``
    is the position of the latest one.  One exchange, on the chunk.
    """
    return windowed_chunks(with_chunk(df, chunks), pairs, policies, cut_minutes)


def day_chunks(df: DataFrame) -> DataFrame:
    """Every plate cut at midnight: the chunks of trips that are kept up to date by day."""
    whole = F.struct(F.lit(False).alias("cut"), F.lit(0).alias("gate"), F.lit(0.0).alias("lane"))
    day = F.datediff(_day(), F.lit("1970-01-01").cast("date")).cast("long")
    return df.withColumns({"_hot": F.lit(True), "_chunk": day, "_sub": whole})


def windowed_chunks(x: DataFrame, pairs: DataFrame | None, policies: tuple[str, ...], cut_minutes: int) -> DataFrame:
    """``windowed`` on rows that know their chunk."""
    w = Window.partitionBy(*CHUNK).orderBy(*SEQUENCE_ORDER)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = (x.withColumn("_rn", F.row_number().over(w))
         .withColumn("_pg", F.lag("gate").over(w))
         .withColumn("_pt", F.lag("ts").over(w)))
    for p in policies:
        x = _with_split(x, F.col("_pg"), F.col("gate"), F.col("_pt"), F.col("ts"), pairs, p, cut_minutes, f"_is_{p}")
    for p in policies:
        inside = F.coalesce(F.col(f"_is_{p}"), F.lit(False))
        x = (x.withColumn(f"_cum_{p}", F.sum(inside.cast("long")).over(upto))
             .withColumn(f"_last_{p}", F.max(F.when(inside, F.col("_rn"))).over(upto)))
    return x.drop(*[f"_is_{p}" for p in policies])


def chunk_summary(x: DataFrame, pairs: DataFrame | None, policies: tuple[str, ...], cut_minutes: int) -> DataFrame:
    """One row per chunk of a hot plate: what its rows need from the chunks before it."""
    order = [*SEQUENCE_ORDER]
    s = (x.filter("_hot").groupBy(*CHUNK)
         .agg(F.count(F.lit(1)).alias("_n"), F.max(F.struct(*order)).alias("_end"), F.min(F.struct(*order)).alias("_first"),
              *[F.max(f"_cum_{p}").alias(f"_nis_{p}") for p in policies],
              *[F.max(f"_last_{p}").alias(f"_lis_{p}") for p in policies]))
    wp = Window.partitionBy("plate").orderBy("_chunk", "_sub")
    before = wp.rowsBetween(Window.unboundedPreceding, -1)
    s = (s.withColumn("_carry", F.lag("_end").over(wp))
         .withColumn("_row_off", F.coalesce(F.sum("_n").over(before), F.lit(0)).cast("long")))
    out = []
    for p in policies:
        s = _with_split(s, F.col("_carry.gate"), F.col("_first.gate"), F.col("_carry.ts"), F.col("_first.ts"),
                        pairs, p, cut_minutes, f"_fs_{p}")
        s = s.withColumn(f"_fs_{p}", F.coalesce(F.col(f"_fs_{p}"), F.col("_carry").isNull()))
        s = s.withColumn(f"_to_{p}", F.coalesce(
            F.sum(F.col(f"_fs_{p}").cast("long") + F.col(f"_nis_{p}")).over(before), F.lit(0)).cast("long"))
        start = (F.when(F.col(f"_lis_{p}").isNotNull(), F.col("_row_off") + F.col(f"_lis_{p}"))
                 .when(F.col(f"_fs_{p}"), F.col("_row_off") + 1))
        s = s.withColumn(f"_cs_{p}", F.max(start).over(before))
        out += [f"_fs_{p}", f"_to_{p}", f"_cs_{p}"]
    return s.select(*CHUNK, F.col("_carry.gate").alias("_cg"), F.col("_carry.ts").alias("_ct"), "_row_off", *out)


def stitched(x: DataFrame, summary: DataFrame | None, policy: str, cols: list[str]) -> DataFrame:
    """W3 output of one policy: ``cols`` with ``tripid, step, prev_gate, prev_ts``; no shuffle of the rows."""
    cum, inner = F.col(f"_cum_{policy}"), F.col(f"_last_{policy}")
    if summary is None:
        starts, row_off, trip_off = F.lit(True), F.lit(0), F.lit(0)
        carry_start, cg, ct = F.lit(1), F.lit(None), F.lit(None)
    else:
        # a chunk without a summary row is a whole ordinary plate
        x = x.join(bounded_broadcast(summary), CHUNK, "left")
        starts = F.coalesce(F.col(f"_fs_{policy}"), F.lit(True))
        row_off, trip_off = (F.coalesce(F.col(c), F.lit(0)) for c in ("_row_off", f"_to_{policy}"))
        carry_start, cg, ct = F.col(f"_cs_{policy}"), F.col("_cg"), F.col("_ct")
    first = F.col("_rn") == 1
    split = F.when(first, starts).otherwise(F.coalesce(inner == F.col("_rn"), F.lit(False)))
    start = (F.when(inner.isNotNull(), row_off + inner).when(starts, row_off + 1).otherwise(carry_start))
    return x.select(
        *cols,
        (trip_off + starts.cast("long") + cum).cast("long").alias("tripid"),
        (row_off + F.col("_rn") - start + 1).cast("long").alias("step"),
        F.when(~split, F.when(first, cg).otherwise(F.col("_pg"))).cast("int").alias("prev_gate"),
        F.when(~split, F.when(first, ct).otherwise(F.col("_pt"))).cast("timestamp_ntz").alias("prev_ts"))


def sessionize(df: DataFrame, pairs: DataFrame | None = None, policy: str = "as_coded",
               cut_minutes: int = CUT_MINUTES, hot_threshold: int = HOT_PLATE_ROWS) -> DataFrame:
    """Add ``tripid, step, prev_gate, prev_ts`` to every sighting.

    ``df`` holds ``plate, gate, lane, ts, nationality`` without nulls (drop
    them first, P6).  ``pairs`` is ``closure_pairs(...)`` (not needed for the
    ``gap`` policy).  ``hot_threshold`` sizes the chunks of hot plates; it
    changes no result.  ``plans.pipeline`` writes the windowed rows once for
    all policies; here, with hot plates, they are computed for the summary as
    well.
    """
    if policy not in (*POLICIES, "none"):
        raise ValueError(f"unknown split policy {policy!r}; expected one of {POLICIES}")
    chunks = chunk_map(df, hot_threshold)
    x = windowed(df, pairs, (policy,), cut_minutes, chunks)
    summary = None if chunks is None else chunk_summary(x, pairs, (policy,), cut_minutes)
    return stitched(x, summary, policy, df.columns)


def previous_sighting(df: DataFrame, hot_threshold: int = HOT_PLATE_ROWS) -> DataFrame:
    """Every sighting with the plate's previous one (``prev_gate``, ``prev_ts``).

    Sessionization with a rule that never splits: the same skew-safe plan, so
    consecutive pairs of a plate never need the whole plate in one task.  The
    plate's first sighting has no previous.
    """
    return sessionize(df, None, "none", 0, hot_threshold)


def segments(trips: DataFrame) -> DataFrame:
    """One row per consecutive pair inside a trip (trips of one sighting give none)."""
    return trips.filter(F.col("step") > 1).select(
        "plate", "tripid",
        F.col("prev_gate").alias("gatefrom"), F.col("gate").alias("gateto"),
        F.col("prev_ts").alias("tstart"), F.col("ts").alias("tend"))


def trip_steps(trips: DataFrame) -> DataFrame:
    """A16 (flat form): each trip's ordered path as ``(plate, tripid, step, gate, ts)``."""
    return trips.select("plate", "tripid", "step", "gate", "ts")


def trip_arrays(trips: DataFrame, chunk_steps: int = TRIP_CHUNK) -> DataFrame:
    """A16 (nested form): trips as sequences, ``(plate, tripid, chunk, first_step, path)``.

    ``path`` is the ordered array of ``(gate, ts)`` of at most ``chunk_steps`` steps; a longer trip has several
    rows, numbered by ``chunk`` from 0, so neither an array nor a group grows with the trip.  An ordinary trip is
    one row.  The shuffle is on (plate, trip, chunk): a trip that holds a third of all rows spreads over its chunks.
    """
    at = F.col("step") - 1
    width = F.lit(chunk_steps)
    held = F.sort_array(F.collect_list(F.struct("step", "gate", "ts")))
    return (trips.groupBy("plate", "tripid", F.floor(at / width).cast("long").alias("chunk")).agg(held.alias("_held"))
            .select("plate", "tripid", "chunk", F.col("_held")[0]["step"].alias("first_step"),
                    F.transform("_held", lambda x: F.struct(x["gate"].alias("gate"), x["ts"].alias("ts"))).alias("path")))


def trip_array_steps(nested: DataFrame) -> DataFrame:
    """The steps of ``trip_arrays`` again: ``(plate, tripid, step, gate, ts)``."""
    return (nested.select("plate", "tripid", "first_step", F.posexplode("path").alias("_at", "_x"))
            .select("plate", "tripid", (F.col("first_step") + F.col("_at")).alias("step"), "_x.gate", "_x.ts"))


def array_segments(nested: DataFrame) -> DataFrame:
    """W2 on the nested form: consecutive pairs inside the arrays, and across the border of two chunks of a trip."""
    x = F.col("path")
    n = F.size(x)
    inner = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.struct(
        F.get(x, i - 1)["gate"].alias("gatefrom"), F.get(x, i)["gate"].alias("gateto"),
        F.get(x, i - 1)["ts"].alias("tstart"), F.get(x, i)["ts"].alias("tend"))))
    inside = nested.select("plate", "tripid", F.explode(inner).alias("_s")).select("plate", "tripid", "_s.*")
    # borders: one row per further chunk, so the join is small; its key is the chunk, not the trip
    ends = nested.select("plate", "tripid", (F.col("chunk") + 1).alias("chunk"), F.element_at(x, -1).alias("_last"))
    starts = nested.filter("chunk > 0").select("plate", "tripid", "chunk", x[0].alias("_first"))
    across = starts.join(ends, ["plate", "tripid", "chunk"]).select(
        "plate", "tripid", F.col("_last.gate").alias("gatefrom"), F.col("_first.gate").alias("gateto"),
        F.col("_last.ts").alias("tstart"), F.col("_first.ts").alias("tend"))
    return inside.unionByName(across)


def rendered_arrays(nested: DataFrame) -> DataFrame:
    """The nested view with its arrays as text (gates, and instants in epoch seconds), for reports and CSV."""
    return nested.select("plate", "tripid", "chunk", "first_step", F.size("path").cast("long").alias("steps"),
                         F.array_join(F.transform("path", lambda p: p["gate"].cast("string")), ",").alias("gates"),
                         F.array_join(F.transform("path", lambda p: epoch_seconds(p["ts"]).cast("string")), ",").alias("instants"))


def trips_before(trips: DataFrame, range_plates: int = RANGE_PLATES) -> DataFrame:
    """``(plate, before)``: the number of trips of all smaller plates.

    Trip ids are dense per plate, so a plate's trips are its largest id.  Prefix sums have two levels: plates are
    dealt to ranges (a written table, so its bounds are fixed), each range's total goes to the driver (one number per
    ``range_plates`` plates), and a window inside each range adds up the rest.  No task sees more than a range.
    """
    spark = trips.sparkSession
    plates, n_plates = write_counted(spark, trips.groupBy("plate").agg(F.max("tripid").alias("_n")))
    ranges = max(1, -(-n_plates // range_plates))
    dealt, _ = write_counted(spark, plates.repartitionByRange(ranges, "plate").withColumn("_range", F.spark_partition_id()))
    totals = sorted((r["_range"], r["_n"]) for r in dealt.groupBy("_range").agg(F.sum("_n").alias("_n")).collect())
    offsets, upto = [], 0
    for number, n in totals:
        offsets.append((number, upto))
        upto += n
    base = bounded_broadcast(spark.createDataFrame(offsets, "_range int, _base long"), known_rows=len(offsets))
    earlier = Window.partitionBy("_range").orderBy("plate").rowsBetween(Window.unboundedPreceding, -1)
    return (dealt.withColumn("_earlier", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).join(base, "_range")
            .select("plate", (F.col("_base") + F.col("_earlier")).alias("before")))


def global_trips(trips: DataFrame, range_plates: int = RANGE_PLATES) -> DataFrame:
    """``trips`` with ``trip``, a dense number from 1 over all plates in the order of (plate, tripid).

    The original numbers trips by their place in its partitions; here the numbers don't depend on the partitioning.
    """
    return trips.join(trips_before(trips, range_plates), "plate").withColumn("trip", F.col("before") + F.col("tripid")).drop("before")
