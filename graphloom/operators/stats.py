"""Aggregates, ranks within a query and graph statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.order import quantiles


def distribution(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """Mean, six percentiles with linear interpolation and the largest value, rounded to six places."""
    names = {0.1: "p10", 0.25: "p25", 0.5: "p50", 0.75: "p75", 0.9: "p90", 0.95: "p95"}
    g = df.groupBy(*by).agg(F.count(x).alias("n"), F.round(F.avg(x), 6).alias("mean"), F.max(x).cast("double").alias("max"))
    p = quantiles(df, by, x, list(names)).groupBy(*by).agg(*[F.round(F.max(F.when(F.col("q") == q, F.col("value"))), 6).alias(k) for q, k in names.items()])
    return g.join(p, by, "left").select(*by, "n", "mean", *names.values(), "max")


def gini(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """Gini coefficient from counts of equal values: sum over values of count * (2 * mean place) * value, so that only one
    row for each distinct value is ordered."""
    same = df.groupBy(*by, x).agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy(*by).orderBy(x).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # Places before+1 .. before+c add up to c * before + c * (c + 1) / 2.
    s = same.withColumn("_w", (2 * F.col("c") * before + F.col("c") * (F.col("c") + 1)) * F.col(x))
    g = s.groupBy(*by).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col(x)).alias("total"), F.sum("_w").alias("w"))
    return g.select(*by, "n", F.round(F.when(F.col("total") > 0, F.col("w") / (F.col("n") * F.col("total")) - (F.col("n") + 1) / F.col("n")).otherwise(0.0), 6).alias("gini"))


def entropy(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """Shannon entropy in bits of the distribution of x, its perplexity, and entropy over its largest value."""
    c = df.groupBy(*by, x).agg(F.count("*").alias("c")).withColumn("p", F.col("c") / F.sum("c").over(Window.partitionBy(*by)))
    h = F.sum(-F.col("p") * F.log2("p"))
    return c.groupBy(*by).agg(F.count("*").alias("kinds"), F.round(h, 6).alias("bits"), F.round(F.pow(F.lit(2.0), h), 6).alias("perplexity"), F.round(F.when(F.count("*") > 1, h / F.log2(F.count("*"))).otherwise(0.0), 6).alias("share"))


def nucleus(df: DataFrame, by: list[str], mass: str, node: str, tau: float) -> DataFrame:
    """Fewest nodes, heaviest first, whose mass reaches tau of the total."""
    w = Window.partitionBy(*by).orderBy(F.desc(mass), node)
    run = df.withColumn("_run", F.sum(mass).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum(mass).over(Window.partitionBy(*by))).withColumn("_n", F.row_number().over(w))
    return run.where(F.col("_run") >= tau * F.col("_all") * (1 - 1e-9)).groupBy(*by).agg(F.min("_n").alias("nodes"))


def zscore(x: str, by: list[str]) -> Column:
    """Population z-score within a group; 0 where the deviation is below 1e-6."""
    w = Window.partitionBy(*by)
    sd = F.stddev_pop(x).over(w)
    return F.when(sd < 1e-6, 0.0).otherwise((F.col(x) - F.avg(x).over(w)) / sd)




def average_percentile(x: str, by: list[str]) -> Column:
    """Average-rank percentile in [0, 1]; 0.5 in a group of one."""
    w = Window.partitionBy(*by)
    n = F.count("*").over(w)
    ties = F.count("*").over(Window.partitionBy(*by, x))
    place = F.rank().over(Window.partitionBy(*by).orderBy(x)) - 1 + (ties - 1) / 2
    return F.when(n == 1, 0.5).otherwise(place / (n - 1))


def log_share(x: str, by: list[str]) -> Column:
    """ln(1 + x) over the group's largest; 0 where that is 0."""
    top = F.max(F.log1p(x)).over(Window.partitionBy(*by))
    return F.when(top > 0, F.log1p(x) / top).otherwise(0.0)


def degree_table(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node_id, out_deg, in_deg, deg of every node, isolated ones too."""
    ends = edges.select(F.col("src").alias("node_id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("dst", F.lit(0), F.lit(1)))
    d = ends.groupBy("node_id").agg(F.sum("o").alias("out_deg"), F.sum("i").alias("in_deg"))
    z = lambda c: F.coalesce(c, F.lit(0))
    return nodes.select("node_id").join(d, "node_id", "left").select("node_id", z("out_deg").alias("out_deg"), z("in_deg").alias("in_deg"), (z("out_deg") + z("in_deg")).alias("deg"))


def pair_analysis(edges: DataFrame) -> DataFrame:
    """rows, distinct pairs, pairs that repeat, exact repeats of (src, dst, rel), pairs whose reverse is stored as well."""
    pairs = edges.groupBy("src", "dst").agg(F.count("*").alias("c"), F.count_distinct("rel").alias("k"))
    back = pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).alias("_back"))
    j = pairs.join(back, ["src", "dst"], "left")
    total = lambda c, n: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(n)
    return j.agg(total(F.col("c"), "rows"), F.count("*").alias("pairs"), total((F.col("c") > 1).cast("int"), "repeated_pairs"), total(F.col("c") - F.col("k"), "repeated_triples"), total((F.col("_back").isNotNull() & (F.col("src") != F.col("dst"))).cast("int"), "reciprocal"))
