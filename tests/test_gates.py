"""Intervals over runs and systems, gates among sources, and the pool's graph, against plain loops."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import gate, metrics, pool


def numpy_fit(x, m, w, penalty, rounds, tolerance):
    """The same rounds over arrays: the model and the likelihoods seen."""
    kept = m.sum(axis=1) > 0
    X, M, u = np.hstack([x, np.ones((len(x), 1))])[kept], m[kept], w[kept]
    now, seen = np.zeros((m.shape[1], X.shape[1])), []
    step = np.linalg.inv(0.5 * (X * u[:, None]).T @ X + 2 * penalty * np.eye(X.shape[1]))
    while True:
        e = np.exp(X @ now.T)
        g = e / e.sum(axis=1, keepdims=True)
        seen.append(float((u * np.log((g * M).sum(axis=1))).sum() - penalty * (now**2).sum()))
        if len(seen) > rounds or (len(seen) > 1 and seen[-1] - seen[-2] < tolerance * abs(seen[-2])):
            return now, seen
        r = g * M / (g * M).sum(axis=1, keepdims=True)
        now = now + (((r - g) * u[:, None]).T @ X - 2 * penalty * now) @ step


def test_em_gate_query(spark):
    from graphloom.plans import gate_queries
    from graphloom.plans.queries import QUERIES
    from graphloom.plans.workload import Workload

    folder = "/root/testdata/sf0.001"
    scaled, golds = gate_queries.gate_rows(Workload(spark, folder))
    rows = golds.collect()
    model, _ = numpy_fit(np.array([r["x"] for r in rows]), np.array([r["m"] for r in rows]), np.array([r["w"] for r in rows]), 1e-3, 60, 1e-7)
    got = {r["query_id"]: r for r in QUERIES["em_gate"](spark, folder).collect()}
    want = scaled.collect()
    assert len(got) == len(want) > 0
    for r in want:
        e = np.exp(model @ np.array([*r["x"], 1.0]))
        assert np.allclose([got[r["query_id"]][f"w_{s}"] for s in gate_queries.SOURCES], e / e.sum(), atol=1e-4)


def test_gate_fit_follows_numpy(spark):
    rng = np.random.default_rng(3)
    x, m = rng.normal(size=(60, 2)), rng.random((60, 3)) * (rng.random((60, 3)) > 0.3)
    m[:, 0] *= 1 + 4 * (x[:, 0] > 0)
    w = np.full(60, 1 / 60)
    rows = [(x[i].tolist(), m[i].tolist(), float(w[i])) for i in range(60)]
    df = spark.createDataFrame(rows, "x array<double>, m array<double>, w double")
    model, trace = gate.fit_gate(df, 3, 2, penalty=1e-3, rounds=25, tolerance=0)
    last, seen = numpy_fit(x, m, w, 1e-3, 25, 0)
    assert np.allclose(model, last, atol=1e-9) and np.allclose(trace, seen, atol=1e-9)
    assert all(b >= a - 1e-12 for a, b in zip(trace, trace[1:]))
    assert model[0, 0] > 0  # the first source carries golds where the first feature is large


def test_gate_without_golds(spark):
    model, trace = gate.fit_gate(spark.createDataFrame([], "x array<double>, m array<double>, w double"), 3, 2)
    assert not model.any() and trace == []


def test_choices(spark):
    chances = spark.createDataFrame([(1, "A", 0, 0.4), (1, "B", 1, 0.4), (1, "C", 2, 0.2), (2, "A", 0, 0.4), (2, "B", 1, 0.4), (2, "C", 2, 0.2)], "query_id long, class string, place int, p double")
    orders = spark.createDataFrame([(1, "A", 7), (1, "B", 7), (1, "C", 7), (2, "C", 7)], "query_id long, class string, node_id long")
    some = gate.available(chances, orders)
    assert {(r["query_id"], r["class"]) for r in gate.hard_choice(some).collect()} == {(1, "A"), (2, "C")}
    blends = spark.createDataFrame([("A", "x", 1.0), ("B", "y", 1.0), ("C", "x", 0.5), ("C", "y", 0.5)], "class string, source string, w double")
    assert {(r["query_id"], r["source"]): r["w"] for r in gate.soft_weights(some, blends).collect()} == {(1, "x"): 0.5, (1, "y"): 0.5, (2, "x"): 0.5, (2, "y"): 0.5}


def test_areas_of_missing_order(spark):
    orders = spark.createDataFrame([(1, 7, 1), (1, 8, 6)], "query_id long, node_id long, rn int")
    golds = spark.createDataFrame([(1, 7), (1, 8), (2, 7)], "query_id long, node_id long")
    got = {r["query_id"]: r["area"] for r in gate.areas(orders, golds, golds.select("query_id").distinct(), ["query_id"], (5, 10)).collect()}
    assert got == {1: 1.5, 2: 4.0}


def test_two_level_bootstrap(spark):
    rows = [(r, q, float(r + q % 3)) for r in range(3) for q in range(40)]
    df = spark.createDataFrame(rows, "run int, query_id long, delta double")
    got = metrics.two_level_bootstrap(df, 400).first()
    assert got["runs"] == 3 and got["mean"] == pytest.approx(sum(x[2] for x in rows) / 120, abs=1e-6)
    assert got["low"] < got["mean"] < got["high"]
    with pytest.raises(Exception, match="runs hold different queries"):
        metrics.two_level_bootstrap(df.where("run > 0 or query_id > 2"), 20).collect()


def test_share_interval(spark):
    df = spark.createDataFrame([(q, "a", 0.0, 0.5, 1.0) for q in range(20)] + [(q, "b", 1.0, 0.5, 1.0) for q in range(20)], "query_id long, measure string, base double, middle double, top double")
    got = {(r["measure"], r["stat"]): (r["point"], r["low"], r["high"]) for r in metrics.share_interval(df, 200).collect()}
    assert got["a", "share"] == (0.5, 0.5, 0.5) and got["a", "gap"] == (0.5, 0.5, 0.5)
    assert got["b", "share"] == (None, None, None) and got["b", "top_gain"] == (0.0, 0.0, 0.0)


def test_poisson_weight_has_mean_one(spark):
    w = spark.range(20000).select(metrics.poisson_weight("id").alias("w")).agg(F.avg("w"), F.variance("w")).first()
    assert w[0] == pytest.approx(1, abs=0.03) and w[1] == pytest.approx(1, abs=0.06)


def test_topology(spark):
    # 1 - 2 - 3 - 4 - 5 in family a, 1 - 6 in family b, 9 alone; seeds 1 and 3.
    edges = spark.createDataFrame([("a", 1, 2), ("a", 3, 2), ("a", 3, 4), ("a", 4, 5), ("a", 5, 5), ("b", 6, 1)], "family string, src long, dst long")
    nodes = spark.createDataFrame([(0, n) for n in (1, 2, 3, 4, 5, 6, 9)], "query_id long, node_id long")
    start = nodes.where("node_id in (1, 3)")
    views = {"a": ("a",), "all": ("a", "b")}
    links = pool.view_links(nodes, edges, views)
    got = {(r["query_id"]["view"], r["node_id"]): r for r in pool.topology(pool.in_views(nodes, views), pool.in_views(start, views), links).collect()}
    assert len(got) == 14
    two = got["a", 2]
    assert (two["hop"], two["seeds_1hop"], two["seeds_2hop"], two["walks2"], two["branches"], two["deg"]) == (1, 2, 2, 0, 0, 2)
    one = got["a", 1]
    assert (one["hop"], one["seeds_1hop"], one["seeds_2hop"], one["walks2"], one["branches"]) == (0, 0, 2, 2, 1)
    assert (got["a", 5]["hop"], got["a", 5]["component_size"], got["a", 5]["seed_component"]) == (2, 5, 1)
    assert (got["a", 6]["hop"], got["a", 6]["component_size"], got["a", 6]["seed_component"]) == (None, 1, 0)
    assert (got["all", 6]["hop"], got["all", 6]["component_size"]) == (1, 6)
    assert got["all", 9]["avail"] == 1 and got["all", 9]["deg"] == 0


def test_smooth_never_lowers(spark):
    scores = spark.createDataFrame([(0, 1, 2.0), (0, 2, 1.0), (0, 3, 0.0)], "query_id long, node_id long, s double")
    links = spark.createDataFrame([(0, 1, 2), (0, 2, 1), (0, 2, 3), (0, 3, 2)], "query_id long, src long, dst long")
    got = {r["node_id"]: r["p"] for r in pool.smooth(scores, links).collect()}
    s, w = np.array([1.0, 0.5, 0.0]), np.array([[0, 1, 0], [0.5, 0, 0.5], [0, 1, 0]])
    p = s
    for _ in range(2):
        p = 0.5 * s + 0.5 * w @ p
    assert all(math.isclose(got[i + 1], max(s[i], p[i])) for i in range(3))


def test_labels_and_adoption(spark):
    rows = [("a", "x", q, 0.0) for q in range(30)] + [("a", "y", q, 0.2 + 0.01 * q) for q in range(30)] + [("b", "x", q, -0.2 - 0.01 * q) for q in range(30)] + [("b", "y", q, 0.5) for q in range(30)] + [("c", "x", q, 0.0) for q in range(3)] + [("d", "x", q, (-1.0) ** q) for q in range(30)]
    labels = metrics.interval_labels(spark.createDataFrame(rows, "run string, split string, query_id long, delta double"), ["run", "split"], 200)
    got = {(r["run"], r["split"]): r["label"] for r in labels.collect()}
    assert got == {("a", "x"): "SAME", ("a", "y"): "ABOVE", ("b", "x"): "BELOW", ("b", "y"): "ABOVE", ("c", "x"): "SAME", ("d", "x"): "AT"}
    assert {r["run"]: r["verdict"] for r in metrics.adoption(labels, ["run"]).collect()} == {"a": "ADOPT", "b": "NOT_ADOPTED", "c": "NO_EFFECT", "d": "NO_EFFECT"}
