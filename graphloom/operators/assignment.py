"""Set coverage: golds assigned to directions, each to its own, at least cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import vectors as V


def least_assignment(costs: Column, directions: int) -> Column:
    """The least sum over rows of costs (array of arrays, a row each) of one entry a row, every row in another column: a fold
    over rows whose state is the least sum for each set of columns used (a bit mask). Null with more rows than columns."""
    far = F.lit(float("inf"))
    size = 1 << directions
    begin = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda m: F.when(m == 0, F.lit(0.0)).otherwise(far))

    def row(state: Column, cost: Column) -> Column:
        def entry(mask: Column) -> Column:
            one = lambda d: F.when(F.shiftrightunsigned(mask, d).bitwiseAND(F.lit(1)) == 1, F.element_at(state, (mask - F.lit(1 << d) + 1).cast("int")) + F.element_at(cost, d + 1)).otherwise(far)
            return F.least(*[one(d) for d in range(directions)]) if directions > 1 else one(0)

        return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), entry)

    least = F.array_min(F.aggregate(costs, begin, row))
    return F.when(least < far, least)


def coverage_loss(scores: DataFrame, golds: DataFrame, targets: DataFrame, directions: int, margin: float) -> DataFrame:
    """query_id, golds, assignment, diversity of scores (query_id, node_id, s: array of one score a direction).

    A gold's cost in a direction is minus the log-softmax of its score over the query's candidates; assignment is the least
    mean cost of giving each gold its own direction (null with more golds than directions). diversity is the mean over ordered pairs of
    targets (query_id, t: array of vectors) of the squared excess of their cosine over margin. Queries without golds among
    their candidates are left out. The softmax sums are aggregated by direction; only golds reach the fold."""
    at = [F.element_at("s", d + 1) for d in range(directions)]
    top = scores.groupBy("query_id").agg(*[F.max(c).alias(f"m{d}") for d, c in enumerate(at)])
    sums = scores.join(top, "query_id").groupBy("query_id").agg(*[(F.max(f"m{d}") + F.log(F.sum(F.exp(c - F.col(f"m{d}"))))).alias(f"l{d}") for d, c in enumerate(at)])
    cost = F.array(*[F.col(f"l{d}") - c for d, c in enumerate(at)])
    rows = scores.join(golds.select("query_id", "node_id").distinct(), ["query_id", "node_id"]).join(sums, "query_id").select("query_id", cost.alias("cost"))
    costs = rows.groupBy("query_id").agg(F.count("*").alias("golds"), F.collect_list("cost").alias("costs"))
    pair = lambda a, b: F.greatest(V.cosine(F.element_at("t", a), F.element_at("t", b)) - margin, F.lit(0.0))
    excess = [pair(a, b) for a in range(1, directions + 1) for b in range(a + 1, directions + 1)]
    spread = sum((e * e for e in excess), F.lit(0.0)) / max(len(excess), 1)
    both = costs.join(targets.select("query_id", spread.alias("diversity")), "query_id")
    return both.select("query_id", "golds", (least_assignment(F.col("costs"), directions) / F.col("golds")).alias("assignment"), "diversity")
