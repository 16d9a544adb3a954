"""The closure under edits of the map equals the closure of the edited map."""

import random

import pytest

from roadtrace.operators.network import ARC_COLS, arc_closure, edited_closure


def plain_closure(arcs):
    known = set(arcs)
    while True:
        more = {(a[0], b[1], a[2] or b[2], a[3] or b[3], a[4] or b[4]) for a in known for b in arcs if a[1] == b[0]} - known
        if not more:
            return known
        known |= more


def arc(rnd, n):
    return (rnd.randint(1, n), rnd.randint(1, n), rnd.random() < 0.3, rnd.random() < 0.1, rnd.random() < 0.2)


@pytest.mark.parametrize("seed, gates", [(1, 6), (2, 9)])
def test_random_edits_of_cyclic_maps(spark, arcs_df, seed, gates):
    rnd = random.Random(seed)
    arcs = {arc(rnd, gates) for _ in range(gates + 2)}
    closure = arc_closure(arcs_df(sorted(arcs)))
    assert {tuple(r) for r in closure.select(*ARC_COLS).collect()} == plain_closure(arcs)
    for step in range(4):
        gone = set(rnd.sample(sorted(arcs), min(len(arcs), rnd.randint(0, 3)))) | ({arc(rnd, gates)} if step == 1 else set())
        new = {arc(rnd, gates) for _ in range(rnd.randint(0, 2))}
        closure = edited_closure(closure, arcs_df(sorted(arcs)), arcs_df(sorted(new)), arcs_df(sorted(gone)))
        arcs = (arcs - gone) | new
        found = [tuple(r) for r in closure.select(*ARC_COLS).collect()]
        assert len(found) == len(set(found)) and set(found) == plain_closure(arcs)


def test_a_cycle_does_not_keep_itself(spark, arcs_df):
    cycle = [(1, 2, True, False, False), (2, 3, False, False, False), (3, 1, False, False, True)]
    closure = arc_closure(arcs_df(cycle))
    out = edited_closure(closure, arcs_df(cycle), removed=arcs_df(cycle[:1]))
    assert {tuple(r) for r in out.select(*ARC_COLS).collect()} == plain_closure(cycle[1:])
    assert edited_closure(closure, arcs_df(cycle), removed=arcs_df(cycle)).count() == 0
