"""Rescues, the selection rule, pool movement and places by hand."""

from __future__ import annotations

import pytest

from graphloom.operators import decisions


def test_rescues(spark):
    ranks = [(1, "b", 10, 1), (1, "b", 11, 2), (1, "x", 11, 1), (1, "y", 12, 1)]  # wrong first, x has the gold at 1
    ranks += [(2, "b", 20, 1), (2, "x", 21, 1)]  # right
    ranks += [(3, "b", 30, 1), (3, "x", 31, 1)]  # no gold anywhere
    ranks += [(4, "b", 40, 1), (4, "y", 41, 7)]  # the gold only with y, at 7
    df = spark.createDataFrame(ranks, "query_id long, system string, node_id long, rank int")
    golds = spark.createDataFrame([(1, 11), (1, 11), (2, 20), (3, 99), (4, 41)], "query_id long, node_id long")
    rows, lost = decisions.rescue_rows(df, golds, "b")
    assert {(r["query_id"], r["system"]): r["best"] for r in rows.collect()} == {(1, "b"): 2, (1, "x"): 1, (1, "y"): None, (4, "b"): None, (4, "x"): None, (4, "y"): 7}
    assert [r["query_id"] for r in lost.collect()] == [3]
    got = {(r["cutoff"], r["rescuer"]): (r["n"], r["share"], r["population"], r["lost"], r["lost_share"]) for r in decisions.rescue_table(rows, lost, "b", [1, 10]).collect()}
    tail = (2, 1, 0.333333)
    assert got == {(1, "x"): (1, 0.5, *tail), (1, "y"): (0, 0.0, *tail), (1, "any"): (1, 0.5, *tail), (1, "none"): (1, 0.5, *tail), (10, "x"): (1, 0.5, *tail), (10, "y"): (1, 0.5, *tail), (10, "any"): (2, 1.0, *tail), (10, "none"): (0, 0.0, *tail)}


@pytest.mark.parametrize(("deltas", "outcome"), [([1, 0, 0.5, 0], "ADVANCED"), ([1, 0, -1, 3], "GRAY"), ([1, 0, -6, 9], "NOT_ADVANCED"), ([0, 0, -3, -2], "NOT_ADVANCED"), ([-0.4, -0.4, 0, 0], "ADVANCED")])
def test_selection(spark, deltas, outcome):
    cells = spark.createDataFrame([("a", "1", float(deltas[0])), ("a", "2", float(deltas[1])), ("b", "1", float(deltas[2])), ("b", "2", float(deltas[3]))], "dataset string, regime string, delta double")
    r = decisions.selection(cells, 2, -0.5, -2.0, -5.0).first()
    assert r["outcome"] == outcome and r["datasets"] == 2 and r["macro"] == pytest.approx(sum(deltas) / 4)


def test_selection_of_other_cells(spark):
    cells = spark.createDataFrame([("a", "1", 0.0)], "dataset string, regime string, delta double")
    with pytest.raises(Exception, match="another number of cells"):
        decisions.selection(cells, 2, -0.5, -2.0, -5.0).collect()
    assert decisions.selection(cells.limit(0), 2, -0.5, -2.0, -5.0).count() == 0


def test_movement_and_places(spark):
    pool = lambda rows: spark.createDataFrame(rows, "query_id long, node_id long")
    r = {x["query_id"]: tuple(x)[1:] for x in decisions.movement(pool([(1, 1), (1, 2), (2, 5)]), pool([(1, 2), (1, 3), (1, 4)]), pool([(1, 3), (2, 5), (1, 3)])).collect()}
    assert r == {1: (1, 2, 1, 1, 0), 2: (0, 0, 1, 0, 1)}
    orders = spark.createDataFrame([(1, "a", 3, 2), (1, "b", 3, 1), (1, "a", 4, 1)], "query_id long, system string, node_id long, rank int")
    got = sorted(tuple(x) for x in decisions.place_of(orders, pool([(1, 3), (1, 4), (1, 9)]), ["a", "b"]).collect())
    assert got == [(1, 3, 2, 1), (1, 4, 1, -1), (1, 9, -1, -1)]
    with pytest.raises(Exception, match="stands twice"):
        decisions.place_of(orders.union(orders.limit(1)), pool([(1, 3)]), ["a"]).collect()
