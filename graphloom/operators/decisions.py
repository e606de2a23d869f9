"""Who rescues a ranker's errors, and a selection rule whose thresholds are declared before."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rescue_rows(ranks: DataFrame, golds: DataFrame, base: str) -> tuple[DataFrame, DataFrame]:
    """(errors, admission failures) of ranks (query_id, system, node_id, rank).

    Errors are the queries whose first node under `base` is no gold although a gold is a candidate of some system: query_id, system
    and best (the best rank of a gold there, null where that system has none), a row for each system, the base included. Queries with
    no gold among the candidates failed at admission, not at ranking, and come apart."""
    g = golds.select("query_id", "node_id").distinct()
    hits = ranks.join(g, ["query_id", "node_id"]).groupBy("query_id", "system").agg(F.min("rank").alias("best"))
    every = ranks.select("query_id").distinct()
    lost = every.join(hits.select("query_id").distinct(), "query_id", "left_anti")
    right = hits.where((F.col("system") == base) & (F.col("best") == 1)).select("query_id")
    wrong = every.join(lost, "query_id", "left_anti").join(right, "query_id", "left_anti")
    systems = ranks.select("system").distinct()
    rows = wrong.crossJoin(F.broadcast(systems)).join(hits, ["query_id", "system"], "left")  # systems: a row each
    return rows, lost


def rescue_table(rows: DataFrame, lost: DataFrame, base: str, cutoffs: list[int]) -> DataFrame:
    """cutoff, rescuer, n, share, population, lost, lost_share: how many errors each other system, any or none of them ranks a gold
    for within each cutoff. A query may have several rescuers, so shares don't add up to one. lost are the queries whose gold was
    never a candidate, lost_share their share of these and the errors together."""
    cut_ = F.explode(F.array(*map(F.lit, cutoffs)))
    other = rows.where(F.col("system") != base).select("query_id", "system", "best", cut_.alias("cutoff"))
    ok = F.coalesce(F.col("best") <= F.col("cutoff"), F.lit(False)).cast("int")
    each = other.groupBy("cutoff", F.col("system").alias("rescuer")).agg(F.sum(ok).alias("n"))
    some = other.groupBy("cutoff", "query_id").agg(F.max(ok).alias("a")).groupBy("cutoff")
    out = each.unionByName(some.agg(F.lit("any").alias("rescuer"), F.sum("a").alias("n"))).unionByName(some.agg(F.lit("none").alias("rescuer"), F.sum(1 - F.col("a")).alias("n")))
    size = rows.agg(F.count_distinct("query_id").alias("population")).crossJoin(lost.agg(F.count("*").alias("lost")))
    j = out.crossJoin(F.broadcast(size))  # one row
    return j.select("cutoff", "rescuer", "n", F.round(F.col("n") / F.col("population"), 6).alias("share"), "population", "lost", F.round(F.col("lost") / (F.col("lost") + F.col("population")), 6).alias("lost_share"))


def selection(cells: DataFrame, cells_each: int, tolerance: float, group_floor: float, cell_floor: float) -> DataFrame:
    """One row with the outcome of cells (dataset, regime, delta in percentage points) under thresholds declared before.

    NOT_ADVANCED where a cell lies below cell_floor or a dataset's mean below group_floor; else GRAY where the mean over datasets,
    a dataset's mean or a cell lies between cell_floor and tolerance; else ADVANCED. Another number of cells of a dataset than
    declared is an error when read, since its mean would be over another set."""
    mean = F.when(F.count("*") == cells_each, F.avg("delta")).otherwise(F.raise_error(F.lit("another number of cells than declared")).cast("double"))
    band = lambda c: (c >= cell_floor) & (c < tolerance)
    sets = cells.groupBy("dataset").agg(F.round(mean, 9).alias("m"), F.count(F.when(F.col("delta") < cell_floor, 1)).alias("low"), F.count(F.when(band(F.col("delta")), 1)).alias("gray"))
    t = sets.agg(F.count("*").alias("datasets"), F.round(F.avg("m"), 6).alias("macro"), F.count(F.when(F.col("m") < group_floor, 1)).alias("failing_datasets"), F.sum("low").alias("failing_cells"), (F.sum("gray") + F.count(F.when(band(F.col("m")), 1))).alias("gray"))
    gray = F.col("gray") + band(F.col("macro")).cast("int")
    outcome = F.when((F.col("failing_datasets") > 0) | (F.col("failing_cells") > 0), "NOT_ADVANCED").when(gray > 0, "GRAY").when(F.col("macro") >= tolerance, "ADVANCED").otherwise("NOT_ADVANCED")
    return t.where("datasets > 0").select("datasets", "macro", (F.col("macro") >= tolerance).alias("macro_within"), "failing_datasets", "failing_cells", gray.alias("gray"), outcome.alias("outcome"))


def movement(before: DataFrame, after: DataFrame, golds: DataFrame) -> DataFrame:
    """query_id, kept, added, dropped, golds_added, golds_dropped of two pools (query_id, node_id) of the same queries."""
    both = before.select("query_id", "node_id", F.lit(1).alias("_b")).join(after.select("query_id", "node_id", F.lit(1).alias("_a")), ["query_id", "node_id"], "full")
    j = both.join(golds.select("query_id", "node_id", F.lit(1).alias("_g")).distinct(), ["query_id", "node_id"], "left")
    b, a, g = (F.col(c).isNotNull() for c in ("_b", "_a", "_g"))
    n = lambda c, name: F.count(F.when(c, 1)).alias(name)
    return j.groupBy("query_id").agg(n(b & a, "kept"), n(a & ~b, "added"), n(b & ~a, "dropped"), n(a & ~b & g, "golds_added"), n(b & ~a & g, "golds_dropped"))


def place_of(orders: DataFrame, wanted: DataFrame, systems: list[str]) -> DataFrame:
    """query_id, node_id and a column a system: the place of each wanted node in each order (query_id, system, node_id, rank), -1
    where it is absent. A node that stands twice in an order is an error when read."""
    once = orders.withColumn("_n", F.count("*").over(Window.partitionBy("query_id", "system", "node_id"))).where(F.when(F.col("_n") > 1, F.raise_error(F.lit("a node stands twice in an order"))).otherwise(True))
    j = wanted.select("query_id", "node_id").distinct().join(once.select("query_id", "node_id", "system", "rank"), ["query_id", "node_id"], "left")
    return j.groupBy("query_id", "node_id").agg(*[F.coalesce(F.max(F.when(F.col("system") == s, F.col("rank"))), F.lit(-1)).cast("int").alias(s) for s in systems])
