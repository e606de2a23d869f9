"""The complete static features against plain peeling, and identifiers of another form."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.plans.context_queries import QUERIES
from graphloom.plans.workload import Workload

DIR = "/root/testdata/sf0.001"


def cores(n, pairs):
    left = {i: set() for i in range(n)}
    for a, b in pairs:
        left[a].add(b)
        left[b].add(a)
    out, k = {}, 0
    while left:
        i = min(left, key=lambda v: len(left[v]))
        k = max(k, len(left[i]))
        out[i] = k
        for j in left.pop(i):
            left[j].discard(i)
    return out


def test_complete_features(spark):
    w = Workload(spark, DIR)
    n = w.vectors.count()
    pairs = {(min(r), max(r)) for r in w.structural.select("src", "dst").collect() if r[0] != r[1]}
    core = cores(n, pairs)
    x = np.log1p([core[i] for i in range(n)])
    want = np.clip((x - x.mean()) / x.std(), -5, 5) / 5
    got = {r["node_id"]: r for r in QUERIES["static7"](spark, DIR).collect()}
    assert len(got) == n and all(got[i]["core_z"] == pytest.approx(want[i], abs=1e-5) for i in range(n))
    six = {r["node_id"]: r for r in QUERIES["static_features"](spark, DIR).collect()}
    rows = QUERIES["linear19"](spark, DIR).collect()
    assert len(rows[0]) == 21 and len(rows) == w.candidates.count()
    old = {(r["query_id"], r["node_id"]): r for r in QUERIES["linear_features"](spark, DIR).collect()}
    for r in rows:
        assert r["core_z"] == got[r["node_id"]]["core_z"] and all(r[c] == old[r["query_id"], r["node_id"]][c] for c in old[r["query_id"], r["node_id"]].asDict() if c != "score")
    assert all(six[i][c] == got[i][c] for i in range(n) for c in six[i].asDict())


def test_identifiers(spark):
    df = spark.createDataFrame([("2hop__a_b",), ("4hop12__x",)], "id string").select(T.hop_of("id").alias("h"), T.id_parts("id").alias("p"))
    assert [tuple(r) for r in df.collect()] == [(2, ["a", "b"]), (4, ["x"])]
    for bad in ("hop__a", "12", None):
        with pytest.raises(Exception, match="no hop count"):
            spark.createDataFrame([(bad,)], "id string").select(T.hop_of(F.col("id"))).collect()


def test_weighted_push_query(spark):
    """The query against the exact walk from the same restart weights, and its mass short of one by no more than the residues."""
    w = Workload(spark, DIR)
    n = w.vectors.count()
    weight = np.zeros((n, n))
    for s, d, x in w.edges.where("src <> dst").select("src", "dst", F.col("weight").cast("double")).collect():
        weight[s, d] += x
        weight[d, s] += x
    degree = (weight > 0).sum(1)
    step = np.where(degree[:, None] > 0, weight / np.maximum(weight.sum(1), 1e-300)[:, None], np.eye(n))
    start = {}
    for r in QUERIES["restart_a1"](spark, DIR).collect():
        start.setdefault(r["query_id"], np.zeros(n))[r["node_id"]] = r["mass"]
    got = {q: np.zeros(n) for q in start}
    for r in QUERIES["ppr_push_weighted"](spark, DIR).collect():
        got[r["query_id"]][r["node_id"]] = r["mass"]
    for q, x in start.items():
        exact = 0.5 * np.linalg.solve((np.eye(n) - 0.5 * step).T, x)
        short = exact - got[q]
        assert short.min() > -1e-6 and short.sum() <= 1e-3 * np.maximum(degree, 1).sum() and got[q].sum() > 0.3
