"""Trained scorers of candidates: linear and one hidden layer, with the listwise loss, by gradients that tasks add up."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.sources.shared import stash

PACKED = "query_id long, split string, nodes array<long>, x array<double>, gold array<boolean>"


@dataclass
class Scorer:
    """mean and scale standardise features; hidden (0: linear) units of tanh; weights is one vector of all parameters."""

    mean: np.ndarray
    scale: np.ndarray
    hidden: int
    weights: np.ndarray

    def parts(self, w: np.ndarray) -> tuple[np.ndarray, ...]:
        d, h = len(self.mean), self.hidden
        return (w,) if not h else (w[: d * h].reshape(d, h), w[d * h : d * h + h], w[d * h + h :])

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        p = self.parts(self.weights)
        return z @ p[0] if not self.hidden else np.tanh(z @ p[0] + p[1]) @ p[2]

    def gradient(self, x: np.ndarray, gold: np.ndarray) -> tuple[float, np.ndarray]:
        """Loss of one query (log of the summed exponentials less the golds' mean score) and its gradient."""
        z = (x - self.mean) / self.scale
        p = self.parts(self.weights)
        act = np.tanh(z @ p[0] + p[1]) if self.hidden else z
        s = act @ p[-1]
        e = np.exp(s - s.max())
        back = e / e.sum() - gold / gold.sum()
        loss = float(s.max() + np.log(e.sum()) - s[gold].mean())
        if not self.hidden:
            return loss, z.T @ back
        inner = np.outer(back, p[2]) * (1 - act * act)
        return loss, np.concatenate(((z.T @ inner).ravel(), inner.sum(0), act.T @ back))


def packed(features: DataFrame, golds: DataFrame, splits: DataFrame, columns: list[str]) -> DataFrame:
    """One row a query (PACKED), its candidates in the order of their ids; a pool is of bounded size. Nulls count as 0."""
    g = golds.select("query_id", "node_id", F.lit(True).alias("_g")).distinct()
    row = F.struct("node_id", F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]).alias("x"), F.coalesce("_g", F.lit(False)).alias("gold"))
    each = features.join(g, ["query_id", "node_id"], "left").groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("c"))
    return each.join(splits.select("query_id", "split"), "query_id").select("query_id", "split", F.col("c.node_id").alias("nodes"), F.flatten("c.x").alias("x"), F.col("c.gold").alias("gold"))


def step(rows: DataFrame, model: Scorer) -> tuple[float, int, np.ndarray]:
    """Mean loss over the queries with golds in their pool, their number and the mean gradient. Each task sends one sum for each
    parameter; these are added up by place."""
    import pyarrow as pa

    d, n = len(model.mean), len(model.weights)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        total, count, sums = 0.0, 0, np.zeros(n)
        for batch in batches:
            for x, gold in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                mask = np.array(gold, bool)
                if mask.any():
                    loss, g = shared.value.gradient(np.array(x).reshape(-1, d), mask)
                    total, count, sums = total + loss, count + 1, sums + g
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n + 2), pa.int32()), pa.array(np.concatenate(([total, count], sums)))], names=["at", "v"])

    got = rows.select("x", "gold").mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    shared.unpersist()
    v = np.zeros(n + 2)
    for r in got:
        v[r["at"]] = r["v"]
    return v[0] / max(v[1], 1), int(v[1]), v[2:] / max(v[1], 1)


def fit(rows: DataFrame, features: int, hidden: int = 0, rounds: int = 60, rate: float = 0.1, penalty: float = 1e-4, patience: int = 8, seed: int = 7) -> tuple[Scorer, list[tuple[float, float]]]:
    """The scorer of least validation loss, and (training, validation) loss of every round, of rows (PACKED).

    Features are standardised by the training split. Every round sums the gradient of the whole training split over all tasks and moves
    by Adam; it ends when the validation loss has not fallen for `patience` rounds, or after `rounds`. Without training queries
    with golds the scorer is all zeros."""
    train, valid = (stash(rows.where(F.col("split") == s), f"packed-{s}") for s in ("train", "validation"))
    each = train.select(F.posexplode("x").alias("at", "v")).groupBy((F.col("at") % features).alias("f")).agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    mean, scale = np.zeros(features), np.ones(features)
    for r in each.collect():
        mean[r["f"]], scale[r["f"]] = r["m"], r["s"] if r["s"] and r["s"] > 1e-12 else 1.0
    size = features if not hidden else (features + 2) * hidden
    start = np.zeros(size) if not hidden else np.random.default_rng(seed).normal(size=size) / np.sqrt(features)
    model = Scorer(mean, scale, hidden, start)
    best, trace, m, v, worse = (np.inf, model.weights), [], np.zeros(size), np.zeros(size), 0
    for i in range(1, rounds + 1):
        loss, n, g = step(train, model)
        held, k, _ = step(valid, model)
        held = held if k else loss
        trace.append((loss, held))
        if not n:
            return Scorer(mean, scale, hidden, np.zeros(size)), trace
        worse = 0 if held < best[0] - 1e-9 else worse + 1
        if worse == 0:
            best = (held, model.weights)
        if worse >= patience:
            break
        g = g + 2 * penalty * model.weights
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        model = Scorer(mean, scale, hidden, model.weights - rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8))
    return Scorer(mean, scale, hidden, best[1]), trace


def ranked(rows: DataFrame, model: Scorer) -> DataFrame:
    """query_id, split, node_id, score, rn of every candidate: by score to nine places, ties by id."""
    import pyarrow as pa

    d = len(model.mean)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for q, s, nodes, x in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                score = np.round(shared.value.scores(np.array(x).reshape(-1, d)), 9) + 0.0
                place = np.empty(len(nodes), np.int32)
                place[np.lexsort((nodes, -score))] = np.arange(1, len(nodes) + 1)
                yield pa.RecordBatch.from_arrays([pa.array([q] * len(nodes), pa.int64()), pa.array([s] * len(nodes), pa.string()), pa.array(nodes, pa.int64()), pa.array(score), pa.array(place)], names=["query_id", "split", "node_id", "score", "rn"])

    return rows.select("query_id", "split", "nodes", "x").mapInArrow(run, "query_id long, split string, node_id long, score double, rn int")
