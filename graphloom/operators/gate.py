"""Choosing among sources: blends by class, hard and soft choice, and a softmax gate fitted by expectation maximisation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.sources.shared import cut


def blend(masses: DataFrame, weights: DataFrame, by: list[str], depth: int) -> DataFrame:
    """by, node_id, mass, rn: for each group of weights (by, source, w) the summed mass of its sources, heaviest first (ties
    to the smaller node), `depth` nodes. masses is (query_id, source, node_id, m); sources of weight 0 bring no nodes."""
    on = ["query_id", "source"] if "query_id" in weights.columns else ["source"]
    mixed = masses.join(weights.where("w > 0"), on).groupBy(*by, "node_id").agg(F.round(F.sum(F.col("m") * F.col("w")), 9).alias("mass"))
    return mixed.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("mass"), "node_id"))).where(F.col("rn") <= depth)


def areas(orders: DataFrame, golds: DataFrame, groups: DataFrame, by: list[str], sizes: tuple[int, ...]) -> DataFrame:
    """by, area: over the sizes the sum of (1 - all golds found) + (1 - recall), for each of groups (by); a group without an
    order misses everywhere."""
    j = groups.join(golds, "query_id").join(orders.select(*by, "node_id", "rn"), [*by, "node_id"], "left")
    hit = j.groupBy(*by).agg(F.count("*").alias("g"), *[F.count(F.when(F.col("rn") <= n, 1)).alias(f"n{n}") for n in sizes])
    area = sum((F.lit(2.0) - (F.col(f"n{n}") == F.col("g")).cast("int") - F.col(f"n{n}") / F.col("g") for n in sizes), F.lit(0.0))
    return hit.select(*by, F.round(area, 6).alias("area"))


def available(chances: DataFrame, orders: DataFrame) -> DataFrame:
    """chances (query_id, class, place, p) of the classes with a non-empty order, scaled to 1 for each query."""
    some = orders.select("query_id", "class").distinct()
    return chances.join(some, ["query_id", "class"]).withColumn("p", F.col("p") / F.sum("p").over(Window.partitionBy("query_id")))


def hard_choice(chances: DataFrame) -> DataFrame:
    """query_id, class: the likeliest class, ties to the first place."""
    return chances.groupBy("query_id").agg(F.min(F.struct(-F.col("p"), F.col("place"), F.col("class"))).alias("c")).select("query_id", "c.class")


def soft_weights(chances: DataFrame, blends: DataFrame) -> DataFrame:
    """query_id, source, w: the classes' source weights (class, source, w), averaged by the chances."""
    return chances.join(blends, "class").groupBy("query_id", "source").agg(F.round(F.sum(F.col("p") * F.col("w")), 9).alias("w"))


def gate_column(model: np.ndarray, features: str = "x") -> list[Column]:
    """One column a source: softmax of the model (sources x (features + 1), the last for the constant) at an array column."""
    logit = [sum((float(v) * F.get(features, F.lit(i)) for i, v in enumerate(row[:-1])), F.lit(float(row[-1]))) for row in model]
    top = F.greatest(*logit)
    e = [F.exp(z - top) for z in logit]
    return [x / sum(e[1:], e[0]) for x in e]


def fit_gate(golds: DataFrame, sources: int, features: int, penalty: float = 1e-3, rounds: int = 60, tolerance: float = 1e-7) -> tuple[np.ndarray, list[float]]:
    """Model and the penalised log-likelihood after each round, from golds (x: array of features, m: array of the gold's mass
    in each source, w: its weight). Golds that no source reaches carry no likelihood.

    The E step shares each gold among the sources in proportion to gate times mass; of the M step one step is taken, with the
    curvature's fixed upper bound (half the weighted second moments of the features), so that no round lowers the
    likelihood. A round is one aggregate of sources x (features + 1) sums; nothing else reaches the driver."""
    rows = cut(golds.where(F.aggregate("m", F.lit(0.0), lambda s, v: s + v) > 0))
    xs = [*[F.get("x", F.lit(i)) for i in range(features)], F.lit(1.0)]
    width = features + 1
    second = rows.agg(*[F.sum(F.col("w") * xs[i] * xs[j]) for i in range(width) for j in range(width)]).first()
    model, trace = np.zeros((sources, width)), []
    if second[0] is None:
        return model, trace
    bound = np.linalg.inv(0.5 * np.array(second, float).reshape(width, width) + 2 * penalty * np.eye(width))
    for _ in range(rounds + 1):
        gate = gate_column(model)
        cols = rows.select("w", "x", *[(g * F.get("m", F.lit(k))).alias(f"a{k}") for k, g in enumerate(gate)], *[g.alias(f"g{k}") for k, g in enumerate(gate)])
        total = sum((F.col(f"a{k}") for k in range(1, sources)), F.col("a0"))
        sums = [F.sum(F.col("w") * (F.col(f"a{k}") / total - F.col(f"g{k}")) * xs[i]) for k in range(sources) for i in range(width)]
        got = np.array(cols.agg(F.sum(F.col("w") * F.log(total)), *sums).first(), float)
        trace.append(float(got[0] - penalty * (model**2).sum()))
        if len(trace) > rounds or (len(trace) > 1 and trace[-1] - trace[-2] < tolerance * abs(trace[-2])):
            return model, trace
        model = model + (got[1:].reshape(sources, width) - 2 * penalty * model) @ bound
    return model, trace
