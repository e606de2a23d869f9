"""Rank fusion and candidate pools. Lists are long tables (query_id, source, node_id, rank); (query_id, source, node_id)
is unique. Scores are rounded to nine places before ranking, and ties go to the smaller node."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

C = 60


def by_query(*order: Column | str) -> Window:
    return Window.partitionBy("query_id").orderBy(*order)


def weight_column(weights: dict[str, float]) -> Column:
    out = F.lit(0.0)
    for source, w in weights.items():
        out = F.when(F.col("source") == source, F.lit(float(w))).otherwise(out)
    return out


def once(value: Column) -> Column:
    """An aggregate over the sources of a node; raises when read if a source names the node twice."""
    return F.when(F.size(F.collect_set("source")) == F.count("*"), value).otherwise(F.raise_error(F.lit("a list names a node twice")).cast("double"))


def rrf(ranked: DataFrame, weights: dict[str, float], c: int = C) -> DataFrame:
    """query_id, node_id, score, rn by weighted reciprocal ranks; nodes whose sources all weigh 0 still appear."""
    score = once(F.round(F.sum(weight_column(weights) / (F.col("rank") + c)), 9))
    fused = ranked.groupBy("query_id", "node_id").agg(score.alias("score"))
    return fused.withColumn("rn", F.row_number().over(by_query(F.desc("score"), "node_id")))


def rrf_weights(ranked: DataFrame, dense: list[float], c: int = C) -> DataFrame:
    """Several dense weights in one pass over the lists: query_id, w, node_id, score, rn."""
    each = F.explode(F.array(*[F.lit(float(w)) for w in dense])).alias("w")
    share = F.when(F.col("source") == "dense", F.col("w")).otherwise(1 - F.col("w"))
    fused = ranked.select("*", each).groupBy("query_id", "w", "node_id").agg(once(F.round(F.sum(share / (F.col("rank") + c)), 9)).alias("score"))
    return fused.withColumn("rn", F.row_number().over(Window.partitionBy("query_id", "w").orderBy(F.desc("score"), "node_id")))


def duplicates(ranked: DataFrame) -> DataFrame:
    """Violations of the lists' key; fusion is only defined where there are none."""
    return ranked.groupBy("query_id", "source", "node_id").agg(F.count("*").alias("n")).where("n > 1")


def turn(order: tuple[str, ...]) -> Column:
    """A source's place in the given order; others come last."""
    out = F.lit(len(order))
    for i, source in enumerate(order):
        out = F.when(F.col("source") == source, F.lit(i)).otherwise(out)
    return out


def stable_union(ranked: DataFrame, order: tuple[str, ...] = ("dense", "sparse"), name: str = "pos") -> DataFrame:
    """Nodes in order of their first appearance, list after list."""
    first = ranked.groupBy("query_id", "node_id").agg(F.min(F.struct(turn(order), F.col("rank"))).alias("_at"))
    return first.withColumn(name, F.row_number().over(by_query("_at"))).drop("_at")


def seeds(ranked: DataFrame, depth: int = 5) -> DataFrame:
    return stable_union(ranked.where(F.col("rank") <= depth), name="seed_pos")


def anchor(ranked: DataFrame) -> DataFrame:
    return ranked.where("source = 'dense' and rank = 1").select("query_id", "node_id")


def round_robin(ranked: DataFrame, order: tuple[str, ...] = ("dense", "sparse")) -> DataFrame:
    """Nodes rank by rank, sources in order within a rank; first occurrence."""
    first = ranked.where("node_id >= 0").groupBy("query_id", "node_id").agg(F.min(F.struct(F.col("rank"), turn(order))).alias("_at"))
    return first.withColumn("pos", F.row_number().over(by_query("_at"))).drop("_at")


def budget_pool(fused: DataFrame, budget: int) -> DataFrame:
    """The first `budget` nodes in fused order (all where there are fewer)."""
    return fused.where(F.col("rn") <= budget).select("query_id", "node_id", F.col("rn").alias("pos"))


def matched_budget(candidates: DataFrame, admitted: DataFrame, protected: DataFrame) -> DataFrame:
    """query_id, node_id, status: the admitted nodes push out as many of the last unprotected candidates (as far as there
    are that many); status is kept, evicted, admitted or refused."""
    free = candidates.join(protected.select("query_id", "node_id").distinct(), ["query_id", "node_id"], "left_anti").withColumn("_from_end", F.row_number().over(by_query(F.desc("pos"))))
    room = free.groupBy("query_id").agg(F.count("*").alias("_room"))
    new = admitted.join(candidates.select("query_id", "node_id"), ["query_id", "node_id"], "left_anti").withColumn("_turn", F.row_number().over(by_query("pos")))
    new = new.join(room, "query_id", "left").withColumn("status", F.when(F.col("_turn") <= F.coalesce("_room", F.lit(0)), "admitted").otherwise("refused"))
    taken = new.where("status = 'admitted'").groupBy("query_id").agg(F.count("*").alias("_taken"))
    old = candidates.join(free.select("query_id", "node_id", "_from_end"), ["query_id", "node_id"], "left").join(taken, "query_id", "left")
    old = old.withColumn("status", F.when(F.col("_from_end") <= F.coalesce("_taken", F.lit(0)), "evicted").otherwise("kept"))
    return old.select("query_id", "node_id", "status").unionByName(new.select("query_id", "node_id", "status"))


def additive_pool(candidates: DataFrame, admitted: DataFrame) -> DataFrame:
    """Candidates, then the admitted nodes that are not among them."""
    new = admitted.join(candidates.select("query_id", "node_id"), ["query_id", "node_id"], "left_anti")
    size = candidates.groupBy("query_id").agg(F.max("pos").alias("_n"))
    added = new.join(size, "query_id").withColumn("pos", F.col("_n") + F.row_number().over(by_query("pos")))
    return candidates.select("query_id", "node_id", "pos").unionByName(added.select("query_id", "node_id", "pos"))
