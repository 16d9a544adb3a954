"""Road-network operators: closure (G1/G2), enrichment (J3, J4), cut arcs.

The network is a dimension: its size is bounded by the number of gates
squared (times the 8 flag combinations), independent of the sightings, so it
may ride in a broadcast once that bound is checked (``bounded_broadcast``).
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadtrace.plans.joins import bounded_broadcast, record_bound
from roadtrace.schema import ARC_FLAGS
from roadtrace.session import app_id
from roadtrace.sources.stages import materialize, write_counted

ARC_COLS = ["gatefrom", "gateto", *ARC_FLAGS]


def compose_arcs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every ``a -> b`` of ``left`` followed by ``b -> c`` of ``right``; flags OR-ed."""
    a, b = left.alias("a"), right.alias("b")
    return (a.join(b, F.col("a.gateto") == F.col("b.gatefrom"))
            .select(F.col("a.gatefrom").alias("gatefrom"), F.col("b.gateto").alias("gateto"),
                    *[(F.col(f"a.{f}") | F.col(f"b.{f}")).alias(f) for f in ARC_FLAGS]))


def arc_closure(arcs: DataFrame, max_rounds: int = 64, store: bool = False) -> DataFrame:
    """G1: transitive closure of the arcs, flags OR-ed along each path.

    The result is the set of ``(from, to, flags)`` over all paths (walks) of
    one or more arcs, so two routes with different flags give two rows.  It is
    reached semi-naively: each round composes only the rows that the last one
    found with all rows known, on either side, which doubles the path length;
    it needs log2(longest path) + 1 rounds and terminates on cyclic maps (the
    set of flag combinations is finite).  Each round's new rows are written to
    the reliable checkpoint folder and read back, so a lost executor costs no
    earlier round.

    ``store`` keeps the result between applications, under a digest of the
    arcs in the shared folder (the original's closure file).
    """
    spark = arcs.sparkSession
    arcs = arcs.select(*ARC_COLS).distinct()
    if store:
        row = F.xxhash64(*ARC_COLS)
        found = arcs.agg(F.count(F.lit(1)), F.bit_xor(row), F.sum(row.cast("decimal(38,0)"))).first()
        closure = materialize(spark, "closure", tuple(str(x) for x in found),
                              lambda: arc_closure(arcs, max_rounds), reuse_existing=True)
        return record_bound(closure, closure.count())
    known, n = write_counted(spark, arcs)
    return _grown(known, n, known, n, max_rounds)


def _grown(known: DataFrame, n: int, delta: DataFrame, m: int, max_rounds: int, within: DataFrame | None = None) -> DataFrame:
    """``known`` (n rows) closed under composition, when only the rows ``delta`` of it (m rows) are new; no rows are
    added but those of ``within``, if given."""
    spark = known.sparkSession
    for _ in range(max_rounds):
        if not m:
            return record_bound(known, n)
        everything, news = bounded_broadcast(known, known_rows=n), bounded_broadcast(delta, known_rows=m)
        grown = compose_arcs(delta, everything)
        if m < n:
            grown = grown.unionByName(compose_arcs(known, news))
        if within is not None:
            grown = grown.intersect(within)
        delta, m = write_counted(spark, grown.subtract(everything))
        known, n = known.unionByName(delta), n + m
    raise RuntimeError(f"closure did not converge in {max_rounds} rounds")


def edited_closure(closure: DataFrame, arcs: DataFrame, added: DataFrame | None = None, removed: DataFrame | None = None,
                   max_rounds: int = 64) -> DataFrame:
    """G1 after an edit of the map: the closure of ``arcs`` less ``removed`` plus ``added``, from the ``closure`` of ``arcs``.

    Removal first takes out every row that some path through a removed arc gives: such a path is a removed arc with
    a path (or nothing) before and after it, so three compositions with the old closure find them all.  What is left
    doesn't depend on the removed arcs.  Of the rows taken out, those come back that paths over the remaining arcs
    give; they are searched among the rows taken out only.  Added arcs then grow the result semi-naively, from
    themselves.  Work is in proportion to the rows that an edit can touch; arcs that aren't in the map, or are there
    already, change nothing.
    """
    spark = closure.sparkSession
    arcs = arcs.select(*ARC_COLS).distinct()
    known, n = write_counted(spark, closure.select(*ARC_COLS).distinct())
    if removed is not None:
        gone, n_gone = write_counted(spark, arcs.intersect(removed.select(*ARC_COLS)))
        if n_gone:
            old, gone = bounded_broadcast(known, known_rows=n), bounded_broadcast(gone, known_rows=n_gone)
            after, n_after = write_counted(spark, gone.unionByName(compose_arcs(gone, old)).distinct())
            before = compose_arcs(known, bounded_broadcast(after, known_rows=n_after))
            lost, n_lost = write_counted(spark, after.unionByName(before).distinct())
            kept, n = write_counted(spark, known.subtract(lost))
            arcs = arcs.subtract(gone)
            # the rows taken out that a remaining arc is, or that two rows left compose
            back = arcs.unionByName(compose_arcs(kept, bounded_broadcast(kept, known_rows=n))).intersect(
                bounded_broadcast(lost, known_rows=n_lost))
            delta, m = write_counted(spark, back)
            known = _grown(kept.unionByName(delta), n + m, delta, m, max_rounds, within=lost)
            known, n = write_counted(spark, known)
    if added is not None:
        delta, m = write_counted(spark, added.select(*ARC_COLS).distinct().subtract(known))
        known = _grown(known.unionByName(delta), n + m, delta, m, max_rounds)
    return known


def cut_eligible_arcs(closure: DataFrame) -> DataFrame:
    """Arcs where a trip may be cut: an entry/exit and no service area."""
    return closure.filter(~F.col("hasServiceArea") & F.col("hasEntryExit"))


def closure_pairs(closure: DataFrame) -> DataFrame:
    """Distinct ``(gatefrom, gateto)`` of the closure with ``is_cut`` (J7 lookup).

    A pair is cut-eligible when any of its closure rows is.
    """
    return (closure.groupBy("gatefrom", "gateto")
            .agg(F.bool_or(~F.col("hasServiceArea") & F.col("hasEntryExit")).alias("is_cut")))


def enrich_arcs(arcs: DataFrame, gates: DataFrame) -> DataFrame:
    """Arcs with the position and highway of both end gates (inner joins)."""
    gf = gates.select(F.col("gateid").alias("gatefrom"), F.col("pos").alias("pos_from"),
                      F.col("highwayid").alias("highwayid_from"))
    gt = gates.select(F.col("gateid").alias("gateto"), F.col("pos").alias("pos_to"),
                      F.col("highwayid").alias("highwayid_to"))
    return (arcs.join(bounded_broadcast(gf), "gatefrom").join(bounded_broadcast(gt), "gateto")
            .select(*ARC_COLS, "pos_from", "highwayid_from", "pos_to", "highwayid_to"))


def oriented_arcs(enriched: DataFrame) -> DataFrame:
    """Both travel directions of every enriched arc, oriented to the travel.

    Matching a segment ``(a, b)`` against arc ``(a, b)`` *or* arc ``(b, a)``
    is the same as an equi join against this union (the reversed copy of a
    self-arc is skipped, it would match twice).  The equi form plans as a
    broadcast hash join; the OR form would be a nested-loop join.
    """
    fwd = enriched.select("gatefrom", "gateto", *ARC_FLAGS,
                          F.col("pos_from").alias("posfrom"), F.col("pos_to").alias("posto"),
                          F.col("highwayid_from").alias("highwayidfrom"),
                          F.col("highwayid_to").alias("highwayidto"))
    rev = (enriched.filter(F.col("gatefrom") != F.col("gateto"))
           .select(F.col("gateto").alias("gatefrom"), F.col("gatefrom").alias("gateto"), *ARC_FLAGS,
                   F.col("pos_to").alias("posfrom"), F.col("pos_from").alias("posto"),
                   F.col("highwayid_to").alias("highwayidfrom"),
                   F.col("highwayid_from").alias("highwayidto")))
    return fwd.unionByName(rev)


ARC_INFO_COLS = [*ARC_FLAGS, "posfrom", "posto", "highwayidfrom", "highwayidto"]


def join_arc_info(df: DataFrame, oriented: DataFrame) -> DataFrame:
    """Left-join network columns to rows holding ``gatefrom``/``gateto``."""
    return df.join(bounded_broadcast(oriented), ["gatefrom", "gateto"], "left")


@dataclass
class Network:
    """A road network and the dimensions derived from it."""
    gates: DataFrame
    arcs: DataFrame
    closure: DataFrame
    pairs: DataFrame      # distinct closure pairs with is_cut
    oriented: DataFrame   # enriched closure in both directions

    def check_unique_pairs(self) -> int:
        """Q16: closure rows per pair should be 1; returns the pairs with more."""
        return self.closure.groupBy("gatefrom", "gateto").count().filter("count > 1").count()


def build_network(gates: DataFrame, arcs: DataFrame, check_routes: bool = True) -> Network:
    closure = arc_closure(arcs, store=True)
    spark = arcs.sparkSession
    n_closure = closure.count()       # answered from the written files' metadata
    pairs, n_pairs = write_counted(spark, closure_pairs(closure))
    oriented, n_oriented = write_counted(spark, oriented_arcs(enrich_arcs(closure, gates)))
    record_bound(pairs, n_pairs)
    record_bound(oriented, n_oriented)
    network = Network(gates=gates, arcs=arcs, closure=closure, pairs=pairs, oriented=oriented)
    if check_routes:
        n = n_closure - n_pairs
        if n:
            # Q16: two routes with different flags give two closure rows for
            # one pair, and each matching segment is enriched once per row
            warnings.warn(f"{n} extra closure rows from alternative routes with different flags; "
                          "segments on them are enriched once per route", stacklevel=2)
    return network


def export_closure(closure: DataFrame, path: str) -> None:
    """The closure as one CSV report ordered by (from, to)."""
    from roadtrace.sources.stages import save_report_csv
    save_report_csv(closure.orderBy("gatefrom", "gateto", *ARC_FLAGS), path)


_NETWORKS: dict[tuple[str, str], Network] = {}


def synthetic_network(spark: SparkSession) -> Network:
    """The test network, built once per session (its closure loop runs jobs)."""
    from roadtrace.sources.network import synthetic_arcs, synthetic_gates
    key = (app_id(spark), "synthetic")
    if key not in _NETWORKS:
        _NETWORKS[key] = build_network(synthetic_gates(spark), synthetic_arcs(spark))
    return _NETWORKS[key]
