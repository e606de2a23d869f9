"""Trained scorers against numpy, and sinks with contracts."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import scorer
from graphloom.sources import contracts


def pools(n, seed):
    """Pools whose golds score highest on a rule of three features, one of them on another scale."""
    rng = np.random.default_rng(seed)
    rows = []
    for q in range(n):
        x = rng.normal(size=(int(rng.integers(4, 12)), 3)) * [1, 100, 1]
        value = x[:, 0] - x[:, 1] / 100 + 0.1 * rng.normal(size=len(x))
        gold = np.zeros(len(x), bool)
        gold[np.argsort(-value)[: int(rng.integers(0, 3))]] = True
        rows += [(q, i, *map(float, r), bool(g)) for i, (r, g) in enumerate(zip(x, gold, strict=True))]
    return rows


@pytest.mark.parametrize("hidden", [0, 3])
def test_gradient(hidden):
    rng = np.random.default_rng(1)
    x, gold = rng.normal(size=(6, 4)), np.array([True, False, False, True, False, False])
    size = 4 if not hidden else 6 * hidden
    m = scorer.Scorer(rng.normal(size=4), np.array([1.0, 2.0, 0.5, 1.0]), hidden, rng.normal(size=size))
    loss, g = m.gradient(x, gold)
    s = m.scores(x)
    assert loss == pytest.approx(np.log(np.exp(s).sum()) - s[gold].mean())
    for i in range(size):
        up, down = (scorer.Scorer(m.mean, m.scale, hidden, m.weights + e * np.eye(size)[i]).gradient(x, gold)[0] for e in (1e-6, -1e-6))
        assert g[i] == pytest.approx((up - down) / 2e-6, abs=1e-5)


@pytest.mark.parametrize("hidden", [0, 4])
def test_fit(spark, hidden):
    """Losses fall, the same on any partitions; the first gradient is numpy's; held-out golds come first."""
    rows = pools(90, 3)
    table = spark.createDataFrame(rows, "query_id long, node_id long, a double, b double, c double, gold boolean")
    splits = spark.createDataFrame([(q, "train" if q < 50 else "validation" if q < 70 else "test") for q in range(90)], "query_id long, split string")
    data = scorer.packed(table, table.where("gold"), splits, ["a", "b", "c"]).cache()
    model, trace = scorer.fit(data.repartition(3), 3, hidden, rounds=15)
    again, _ = scorer.fit(data.repartition(5), 3, hidden, rounds=15)
    assert np.allclose(model.weights, again.weights) and trace[-1][1] < trace[0][1] - 0.5
    train = [r for r in data.where("split = 'train'").collect() if any(r["gold"])]
    both = [model.gradient(np.array(r["x"]).reshape(-1, 3), np.array(r["gold"])) for r in train]
    loss, n, g = scorer.step(data.where("split = 'train'"), model)
    assert n == len(train) and loss == pytest.approx(np.mean([x for x, _ in both])) and np.allclose(g, np.mean([x for _, x in both], axis=0))
    first = scorer.ranked(data.where("split = 'test'"), model).where("rn = 1").join(table.where("gold").select("query_id", "node_id", "gold"), ["query_id", "node_id"], "left")
    held = {r[0] for r in rows if r[-1] and r[0] >= 70}
    hits = sum(r["query_id"] in held and bool(r["gold"]) for r in first.collect())
    assert hits >= 0.85 * len(held)


def test_fit_without_golds(spark):
    table = spark.createDataFrame([(1, 1, 0.5), (1, 2, None)], "query_id long, node_id long, a double")
    data = scorer.packed(table, table.where("false"), spark.createDataFrame([(1, "train")], "query_id long, split string"), ["a"])
    model, _ = scorer.fit(data, 1, rounds=3)
    assert not model.weights.any() and [r["node_id"] for r in scorer.ranked(data, model).orderBy("rn").collect()] == [1, 2]


def test_contract(spark, tmp_path):
    path, contract = str(tmp_path / "x"), {"name": "edges", "version": 1}
    df = spark.createDataFrame([(1, "a", 0.5), (2, None, 1.5), (2, "", 1.5)], "id long, name string, v double").repartition(3)
    with pytest.raises(contracts.ContractError, match="not complete"):
        contracts.read(spark, path, contract)
    df.limit(1).write.parquet(path + "/data")  # what a try that failed has left
    first = contracts.write(df, path, contract, by=["id"])
    assert first["rows"] == 3 and first["columns"] == {"id": "bigint", "name": "string", "v": "double"}
    assert contracts.write(df.limit(1), path, contract) == first  # finished already
    got = contracts.read(spark, path, contract)
    assert got.columns == df.columns and got.exceptAll(df).count() == 0 and got.count() == 3
    for call in (lambda: contracts.write(df, path, contract | {"version": 2}), lambda: contracts.read(spark, path, {"name": "nodes"})):
        with pytest.raises(contracts.ContractError, match="holds contract"):
            call()
    spark.createDataFrame([("zz", 9.0)], "name string, v double").write.mode("append").parquet(path + "/data/id=7")
    with pytest.raises(contracts.ContractError, match="manifest says"):
        contracts.read(spark, path, contract)
    assert contracts.read(spark, path, contract, verify=False).count() == 4
    empty = contracts.write(df.where("false"), str(tmp_path / "y"), contract)
    assert (empty["rows"], empty["digest"]) == (0, 0) and contracts.read(spark, str(tmp_path / "y"), contract).count() == 0


def test_adjacency_needs_no_shuffle(spark):
    name = "adjacency_test"
    spark.sql(f"drop table if exists {name}")
    edges = spark.range(1000).select((F.col("id") % 50).alias("src"), F.col("id").alias("dst"))
    table = contracts.write_adjacency(edges, name, buckets=4)
    try:
        old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = table.join(table.groupBy("src").agg(F.count("*").alias("n")), "src")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        assert "Exchange" not in plan and joined.count() == 1000
    finally:
        spark.sql(f"drop table {name}")


def test_queries(spark):
    from graphloom.plans.mixture_queries import query  # noqa: F401  (registers them)
    from graphloom.plans.queries import QUERIES

    rows = QUERIES["trained_scorers"](spark, "/root/testdata/sf0.001").collect()
    assert {r["system"] for r in rows} == {"fused", "linear", "perceptron"} and all(0 <= r["recall_5"] <= 1 for r in rows)
