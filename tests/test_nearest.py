"""Nearest rows in groups: right over several groups, and dealt into bounded tasks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from graphloom.plans.workload import nearest


def test_many_tasks_and_exact(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(-9, 10, (20_000, 4)).astype(float)
    base = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "node_id long, vec array<double>")
    asked = base.where("node_id % 33 = 0").select(F.col("node_id").alias("query_id"), "vec")
    found = nearest(asked, base, {"dot": ("dot", 0, 2, 3), "l1": ("l1", 0, 4, 2)})
    # Two groups of rows by two of queries; formerly all of them were one task.
    assert "_h#" in (plan := found._jdf.queryExecution().optimizedPlan().toString()) and "RepartitionByExpression" in plan and ", 8" in plan
    got = {}
    for r in found.where("query_id % 330 = 0").orderBy("rank").collect():
        got.setdefault((r["source"], r["query_id"]), []).append(r["node_id"])
    assert len(got) == 2 * 61
    for q in range(0, 20_000, 330):
        dot, l1 = x[:, :2] @ x[q, :2], np.round(np.abs(x - x[q]).mean(axis=1), 6)
        others = [i for i in range(20_000) if i != q]
        assert got["dot", q] == sorted(others, key=lambda i: (-dot[i], i))[:3]
        assert got["l1", q] == sorted(others, key=lambda i: (l1[i], i))[:2]


def test_lists_are_those_of_all_scores():
    """Single precision chooses, double precision ranks: ties, copies, zero rows, outliers and what single precision can't hold."""
    from graphloom.plans.workload import best_rows, closest, plain_scores

    rng = np.random.default_rng(5)
    kinds = {
        "whole": rng.integers(-3, 4, (9_000, 8)).astype(float), "copies": np.ones((6_000, 8)), "near": 1 + rng.normal(size=(6_000, 16)) * 1e-7, "outliers": rng.normal(size=(6_000, 16)) * np.where(rng.random((6_000, 1)) < 0.001, 1e5, 1),
        "huge": rng.normal(size=(3_000, 8)) * 1e25, "zero": np.zeros((3_000, 4)), "sorted": np.sort(rng.normal(size=(9_000, 1)), axis=0) * np.ones((1, 4)), "few": rng.normal(size=(7, 4)),
    }
    for name, x in kinds.items():
        ids = rng.permutation(len(x)).astype(np.int64)
        asked = rng.permutation(len(x))[:300]
        for measure, k in (("dot", 20), ("l1", 5)):
            score = plain_scores(x[asked], x, measure)
            score[ids[None, :] == ids[asked][:, None]] = -np.inf
            row, col, _ = best_rows(score, ids, k)
            got = [np.concatenate(v) for v in zip(*closest(x[asked], x, ids[asked], ids, measure, k), strict=True)]
            assert all(np.array_equal(a, b) for a, b in zip(got, (row, col, score[row, col]), strict=True)), (name, measure)


def test_rows_are_sent_as_stored(spark):
    """The nearest of all nodes send each row as it is stored; it is brought to length one where it is compared, not for each copy."""
    from graphloom.plans.search_queries import exact_lists
    from graphloom.plans.workload import Workload

    found = exact_lists(Workload(spark, "/root/testdata/sf0.001"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(" not in plan and "sqrt" not in plan.lower()
    rows = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()}
    ids = np.array(sorted(rows))
    x = np.array([rows[i] for i in ids])
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    got = {}
    for r in found.orderBy("rank").collect():
        got.setdefault(r["node_id"], []).append(r["nbr"])
    for i in range(0, len(ids), 25):
        score = np.round(x @ x[i], 6)
        assert got[ids[i]] == sorted((j for j in ids if j != ids[i]), key=lambda j: (-score[np.searchsorted(ids, j)], j))[:5]
