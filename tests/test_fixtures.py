"""Hand fixtures for each documented quirk (FIXTURES.md §5)."""

from pyspark.sql import functions as F

from roadtrace.functions.time import iso_weekday
from roadtrace.operators import features as feat
from roadtrace.operators import network as net
from roadtrace.operators import quality as q
from roadtrace.operators import segments as segm
from roadtrace.operators import trips as tr


def _trip_ids(df):
    return [r.tripid for r in df.orderBy("plate", "ts", "gate").collect()]


# ------------------------------------------------------------------ trips
def test_gap_rule_floors_to_whole_minutes(sightings):
    df = sightings([(1, 1, 1, "2024-01-01 00:00:00", "I"),
                    (1, 2, 1, "2024-01-01 00:30:59", "I"),   # gap 30:59 -> 30 min, no split
                    (1, 3, 1, "2024-01-01 01:01:59", "I")])  # gap 31:00 -> split
    assert _trip_ids(tr.sessionize(df, policy="gap", cut_minutes=30)) == [1, 1, 2]


def test_not_a_session_window(sightings):
    # two 30.5-minute gaps: session_window(30 min) would give 3 sessions
    df = sightings([(1, 1, 1, "2024-01-01 00:00:00", "I"),
                    (1, 2, 1, "2024-01-01 00:30:30", "I"),
                    (1, 3, 1, "2024-01-01 01:01:00", "I")])
    assert _trip_ids(tr.sessionize(df, policy="gap", cut_minutes=30)) == [1, 1, 1]


def test_plate_boundary_starts_a_trip(sightings):
    df = sightings([(1, 1, 1, "2024-01-01 00:00:00", "I"),
                    (2, 2, 1, "2024-01-01 00:01:00", "I")])
    out = tr.sessionize(df, policy="gap", cut_minutes=30).orderBy("plate").collect()
    assert [(r.plate, r.tripid, r.step, r.prev_gate) for r in out] == [(1, 1, 1, None), (2, 1, 1, None)]


def test_tied_timestamps_ordered_by_gate(sightings):
    df = sightings([(1, 5, 1, "2024-01-01 00:00:00", "I"),
                    (1, 3, 1, "2024-01-01 00:00:00", "I")])
    seg = tr.segments(tr.sessionize(df, policy="gap", cut_minutes=30)).collect()
    assert [(r.gatefrom, r.gateto) for r in seg] == [(3, 5)]


def test_split_policies(sightings, arcs_df, gates_df):
    # closure of 1->2: legal pair (1,2), cut-eligible (entry/exit, no service area)
    arcs = arcs_df([(1, 2, True, False, False)])
    pairs = net.closure_pairs(net.arc_closure(arcs))
    df = sightings([(1, 1, 1, "2024-01-01 00:00:00", "I"),
                    (1, 2, 1, "2024-01-01 00:10:00", "I"),    # legal, short gap
                    (1, 3, 1, "2024-01-01 02:00:00", "I"),    # unmapped, long gap
                    (1, 4, 1, "2024-01-01 02:05:00", "I")])   # unmapped, short gap
    got = {p: _trip_ids(tr.sessionize(df, pairs, policy=p, cut_minutes=30)) for p in tr.POLICIES}
    # as coded: L or (not C and T)
    assert got["as_coded"] == [1, 2, 3, 3]
    # documented: not L or (C and T)
    assert got["documented"] == [1, 1, 2, 3]
    assert got["gap"] == [1, 1, 2, 2]


def test_zero_duration_segment_has_no_speed(sightings, arcs_df, gates_df):
    gates = gates_df([(1, 10.0, 1), (2, 12.5, 1)])
    closure = net.arc_closure(arcs_df([(1, 2, True, False, False)]))
    oriented = net.oriented_arcs(net.enrich_arcs(closure, gates))
    df = sightings([(1, 1, 1, "2024-01-01 00:00:00", "I"), (1, 2, 1, "2024-01-01 00:00:00", "I")])
    seg = segm.enriched_segments(tr.segments(tr.sessionize(df, policy="gap")), oriented).collect()
    assert len(seg) == 1
    assert seg[0].segmentDuration == 0.0 and seg[0].segmentSpeed is None
    assert seg[0].segmentDist == 2.5


def test_reversed_self_and_unmapped_segments(sightings, arcs_df, gates_df):
    gates = gates_df([(1, 10.0, 1), (2, 12.5, 1), (3, 20.0, 2)])
    closure = net.arc_closure(arcs_df([(1, 2, True, True, False)]))
    oriented = net.oriented_arcs(net.enrich_arcs(closure, gates))
    df = sightings([(1, 2, 1, "2024-01-01 00:00:00", "I"),   # 2 -> 1: reversed arc
                    (1, 1, 1, "2024-01-01 00:30:00", "I"),
                    (1, 1, 1, "2024-01-01 00:40:00", "I"),   # 1 -> 1: self, unmapped
                    (1, 3, 1, "2024-01-01 00:50:00", "I")])  # 1 -> 3: unmapped
    seg = (segm.enriched_segments(tr.segments(tr.sessionize(df, policy="gap", cut_minutes=60)), oriented)
           .orderBy("tstart").collect())
    rev, self_arc, unmapped = seg
    assert (rev.gatefrom, rev.gateto, rev.posfrom, rev.posto, rev.hasTollbooth) == (2, 1, 12.5, 10.0, True)
    assert rev.segmentSpeed == 2.5 / 0.5
    assert self_arc.posfrom is None and self_arc.segmentDist is None
    assert unmapped.hasEntryExit is None and unmapped.segmentSpeed is None


# ---------------------------------------------------------------- network
def test_cyclic_map_terminates(arcs_df):
    arcs = arcs_df([(1, 2, False, False, False), (2, 3, False, False, False),
                    (3, 1, False, False, False)])
    closure = net.arc_closure(arcs)
    pairs = {(r.gatefrom, r.gateto) for r in closure.collect()}
    assert len(pairs) == 9


def test_alternative_routes_keep_both_flag_sets(arcs_df):
    arcs = arcs_df([(1, 2, False, True, False), (2, 4, False, False, False),
                    (1, 3, False, False, False), (3, 4, False, False, False)])
    closure = net.arc_closure(arcs)
    rows = closure.filter("gatefrom = 1 AND gateto = 4").collect()
    assert sorted(r.hasTollbooth for r in rows) == [False, True]
    pairs = net.closure_pairs(closure).filter("gatefrom = 1 AND gateto = 4").collect()
    assert len(pairs) == 1


def test_cut_eligible(arcs_df):
    arcs = arcs_df([(1, 2, True, False, False), (2, 3, True, False, True), (3, 4, False, False, False)])
    closure = net.arc_closure(arcs)
    elig = {(r.gatefrom, r.gateto) for r in net.cut_eligible_arcs(closure).collect()}
    # (1,4) passes the service area of 2->3, so only (1,2) may be cut
    assert elig == {(1, 2)}


# ---------------------------------------------------------------- quality
def test_conflict_removal_keeps_null_keys(sightings):
    df = sightings([(1, 1, 1, "2024-01-01 00:00:00", "I"),
                    (2, 1, 1, "2024-01-01 00:00:00", "I"),     # conflict with plate 1
                    (3, 1, None, "2024-01-01 00:00:00", "I"),  # null lane: kept
                    (4, 1, None, "2024-01-01 00:00:00", "I"),
                    (5, 2, 1, "2024-01-01 00:00:00", "I")])
    assert q.spatial_conflicts(df).count() == 2   # (1,1,t) and the null-lane group
    kept = sorted(r.plate for r in q.remove_conflicts(df).collect())
    assert kept == [3, 4, 5]


def test_nationality_fixability(sightings):
    rows = []
    for plate, nats in [(1, ["?", "I"]), (2, ["HR", "I"]), (3, ["?", "HR", "I"]), (4, ["I", None])]:
        rows += [(plate, 1, 1, f"2024-01-01 0{i}:00:00", n) for i, n in enumerate(nats)]
    df = sightings(rows)
    multi = q.multinat_plates(df)
    assert sorted(r.plate for r in multi.collect()) == [1, 2, 3]
    assert [(r.plate, r.real_nat) for r in q.fixable_multinat(multi).collect()] == [(1, "I")]
    fixed = q.fix_nationality(df, q.fixable_multinat(multi))
    assert fixed.filter("plate = 1 AND nationality = '?'").count() == 0
    assert fixed.filter("nationality = '?'").count() == df.filter("nationality = '?'").count() - 1


def test_valid_filter(sightings):
    df = sightings([(1, 1, 1, "2024-01-01 00:00:00", None), (2, 1, 1, "2024-01-01 00:00:00", "LONG"),
                    (3, 1, 1, "2024-01-01 00:00:00", "SLO")])
    assert [r.plate for r in q.valid_sightings(df).collect()] == [3]


# --------------------------------------------------------------- features
def test_mode_tie_takes_smallest(sightings):
    df = sightings([(1, g, 1, f"2024-01-01 0{i}:00:00", "I") for i, g in enumerate([3, 1, 3, 1])])
    row = feat.plate_global_features(df).collect()[0]
    assert row.mostFreqGate == 1


def test_iso_weekday_sunday_is_7(spark):
    row = spark.sql("SELECT TIMESTAMP_NTZ'2024-01-07 10:00:00' AS ts").select(iso_weekday("ts").alias("d")).first()
    assert row.d == 7


def test_trip_stats_inner_join_semantics(spark):
    seg = spark.createDataFrame(
        [(1, 1, 10.0, 1.0, True), (1, 1, 5.0, 1.0, False), (1, 2, 3.0, 1.0, False),
         (1, 3, None, 0.0, None)],
        "plate int, tripid long, segmentDist double, segmentDuration double, hasServiceArea boolean")
    out = feat.trip_stats(seg).collect()
    assert [(r.tripid, r.tripDist, r.tripSpeed, r.totTimeServiceArea) for r in out] == [(1, 15.0, 7.5, 1.0)]
    allt = {r.tripid: r for r in feat.trip_stats(seg, keep_all=True).collect()}
    assert allt[2].totTimeServiceArea == 0.0 and allt[3].tripSpeed is None


def test_window_analysis(sightings):
    df = sightings([(1, 1, 1, "2024-01-01 00:00:00", "I"), (1, 2, 1, "2024-01-01 00:10:30", "I"),
                    (1, 2, 1, "2024-01-01 00:20:00", "I"), (1, 3, 1, "2024-01-01 05:00:00", "I")])
    row = feat.window_analysis(df).first()
    # hour 0: 2 gates, gaps 10 and 9 min -> 9.5; hour 5: 1 gate, 0.0
    assert row.avg_hourly_gates == 1.5 and row.min_avg_diff == 4.75


def test_segment_duration_truncates(sightings):
    df = sightings([(1, 1, 1, "2024-01-01 00:00:00", "I"), (1, 2, 1, "2024-01-01 00:00:59.900", "I")])
    seg = segm.segment_metrics(
        tr.segments(tr.sessionize(df, policy="gap"))
        .withColumn("posfrom", F.lit(0.0)).withColumn("posto", F.lit(1.0))).first()
    assert seg.segmentDuration == 59 / 3600.0


def test_alternative_routes_warn(arcs_df, gates_df):
    import pytest
    arcs = arcs_df([(1, 2, False, True, False), (2, 4, False, False, False),
                    (1, 3, False, False, False), (3, 4, False, False, False)])
    gates = gates_df([(g, float(g), 1) for g in range(1, 5)])
    with pytest.warns(UserWarning):
        net.build_network(gates, arcs)


def test_closure_export(spark, arcs_df, tmp_path):
    closure = net.arc_closure(arcs_df([(1, 2, True, False, False), (2, 3, False, False, True)]))
    net.export_closure(closure, str(tmp_path / "closure"))
    back = spark.read.option("header", True).csv(str(tmp_path / "closure"))
    assert [(r.gatefrom, r.gateto) for r in back.collect()] == [("1", "2"), ("1", "3"), ("2", "3")]


def test_previous_sighting_ignores_trip_cuts(sightings):
    df = sightings([(1, 1, 1, "2024-01-01 00:00:00", "I"), (1, 2, 1, "2024-01-01 05:00:00", "I"),
                    (2, 3, 1, "2024-01-01 01:00:00", "I")])
    out = {(r.plate, r.gate): (r.prev_gate, r.step) for r in tr.previous_sighting(df).collect()}
    assert out == {(1, 1): (None, 1), (1, 2): (1, 2), (2, 3): (None, 1)}


def test_previous_sighting_hot_path(sightings):
    rows = [(1, g, 1, f"2024-01-01 0{h}:00:00", "I") for h, g in enumerate([1, 2, 3, 4])]
    df = sightings(rows)
    plain = {r.gate: (r.tripid, r.step, r.prev_gate) for r in tr.previous_sighting(df).collect()}
    hot = {r.gate: (r.tripid, r.step, r.prev_gate)
           for r in tr.previous_sighting(df, hot_threshold=0).collect()}
    assert plain == hot == {1: (1, 1, None), 2: (1, 2, 1), 3: (1, 3, 2), 4: (1, 4, 3)}


def test_plate_day_counts_drops_nothing_by_itself(sightings):
    df = sightings([(p, 1, 1.0, f"2024-{m:02d}-03T{h:02d}:{n:02d}:00", "I")
                    for p in (1, 2) for m in (1, 7) for h in range(2) for n in range(40)])
    assert sum(r["count"] for r in q.plate_day_counts(df).collect()) == df.count() == 320
    assert {r.plate for r in q.plate_day_counts(df, plate=2).collect()} == {2}
    assert [r["count"] for r in q.plate_day_counts(df, month=7, plate=1).collect()] == [80]
    assert q.plate_day_counts(df, max_count=50).count() == 0
