"""The graph of a query's pool in several views (sets of edge families), and vectors averaged around a node."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators import graph
from graphloom.sources.shared import cut


def view_links(candidates: DataFrame, edges: DataFrame, views: dict[str, tuple[str, ...]], most: int | None = None) -> DataFrame:
    """query_id (struct of query_id and view), src, dst: distinct links between two nodes of the pool in both directions,
    without loops, in every view that holds the edge's family. With `most`, a link counts where it is among the first `most`
    of its family at either end, by weight (largest first), then by the other node."""
    of = F.array(*[F.when(F.col("family").isin(*families), F.lit(v)) for v, families in views.items()])
    at = lambda name: candidates.select("query_id", F.col("node_id").alias(name))
    simple = edges.where("src <> dst").select("family", "src", "dst").distinct()
    if most is not None:
        stored = edges.where("src <> dst").select("family", "src", "dst", F.col("weight").cast("double").alias("weight"))
        simple = stored.union(stored.select("family", "dst", "src", "weight")).groupBy("family", "src", "dst").agg(F.max("weight").alias("weight"))
    inside = simple.join(at("src"), "src").join(at("dst"), ["query_id", "dst"])
    if most is not None:
        place = F.row_number().over(Window.partitionBy("query_id", "family", "src").orderBy(F.desc("weight"), "dst"))
        inside = inside.withColumn("place", place).where(F.col("place") <= most)
    seen = inside.withColumn("view", F.explode(F.array_compact(of))).select(F.struct("query_id", "view").alias("query_id"), "src", "dst")
    return seen.union(seen.select("query_id", "dst", "src")).distinct()


def in_views(rows: DataFrame, views: dict[str, tuple[str, ...]]) -> DataFrame:
    """rows once for each view, under the same key as view_links."""
    return rows.withColumn("view", F.explode(F.array(*[F.lit(v) for v in views]))).withColumn("query_id", F.struct("query_id", "view")).drop("view")


def seed_walks(start: DataFrame, links: DataFrame) -> DataFrame:
    """query_id, node_id, seed, mid: walks of one link (mid is null) and of two from each seed."""
    one = start.select("query_id", F.col("node_id").alias("seed")).join(links.select("query_id", F.col("src").alias("seed"), F.col("dst").alias("node_id")), ["query_id", "seed"])
    two = one.withColumnRenamed("node_id", "mid").join(links.select("query_id", F.col("src").alias("mid"), F.col("dst").alias("node_id")), ["query_id", "mid"])
    none = F.lit(None).cast("long")
    return one.select("query_id", "node_id", "seed", none.alias("mid")).union(two.select("query_id", "node_id", "seed", "mid"))


def topology(nodes: DataFrame, start: DataFrame, links: DataFrame) -> DataFrame:
    """For each node of nodes (query_id, node_id): hop (null beyond three links from the seeds), seeds_1hop and seeds_2hop
    (distinct seeds that a walk of one, or of at most two links joins), walks2, branches (distinct middles of those walks),
    deg, avail, seed_component and component_size. links holds both directions of simple links."""
    links = cut(links)
    walks = seed_walks(start, links).groupBy("query_id", "node_id").agg(
        F.count(F.when(F.col("mid").isNull(), 1)).alias("seeds_1hop"), F.count_distinct("seed").alias("seeds_2hop"), F.count("mid").alias("walks2"), F.count_distinct("mid").alias("branches")
    )
    deg = links.groupBy("query_id", F.col("src").alias("node_id")).agg(F.count("*").alias("deg"))
    label = graph.components(nodes, links)
    group = ["query_id", "component"]
    with_seed = label.join(start.select("query_id", "node_id", F.lit(1).alias("_s")), ["query_id", "node_id"], "left")
    comp = with_seed.groupBy(*group).agg(F.count("*").alias("component_size"), F.coalesce(F.max("_s"), F.lit(0)).alias("seed_component"))
    out = label.join(comp, group).drop("component")
    for part in (graph.bfs(start, links, 3), walks, deg):
        out = out.join(part, ["query_id", "node_id"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    avail = F.max(F.col("deg").isNotNull().cast("int")).over(Window.partitionBy("query_id")).alias("avail")
    return out.select("query_id", "node_id", "hop", *[zero(c) for c in ("seeds_1hop", "seeds_2hop", "walks2", "branches", "deg")], avail, "seed_component", "component_size")


def weighted_mean(rows: DataFrame, by: list[str], vec: str, weight: Column, size: int, name: str) -> DataFrame:
    """by, `name`: the weighted mean vector of each group, summed dimension by dimension so that a group is added up before
    the shuffle."""
    x = rows.withColumn("_w", weight)
    sums = x.groupBy(*by).agg(F.sum("_w").alias("_all"), *[F.sum(F.col("_w") * F.get(vec, F.lit(i)).cast("double")).alias(f"_{i}") for i in range(size)])
    return sums.select(*by, F.array(*[F.col(f"_{i}") / F.col("_all") for i in range(size)]).alias(name))


def smooth(scores: DataFrame, links: DataFrame, rounds: int = 2, keep: float = 0.5) -> DataFrame:
    """query_id, node_id, p: scores (query_id, node_id, s) over the query's largest, smoothed over the row-normalised links
    `rounds` times, and never below their start."""
    top = F.max("s").over(Window.partitionBy("query_id"))
    now = scores.select("query_id", "node_id", (F.col("s") / top).alias("s")).withColumn("p", F.col("s"))
    share = links.select("query_id", F.col("src").alias("node_id"), F.col("dst").alias("nbr"), (1 / F.count("*").over(Window.partitionBy("query_id", "src"))).alias("w"))
    for _ in range(rounds):
        flow = share.join(now.select("query_id", F.col("node_id").alias("nbr"), "p"), ["query_id", "nbr"]).groupBy("query_id", "node_id").agg(F.sum(F.col("p") * F.col("w")).alias("f"))
        now = now.join(flow, ["query_id", "node_id"], "left").select("query_id", "node_id", "s", (keep * F.col("s") + (1 - keep) * F.coalesce("f", F.lit(0.0))).alias("p"))
    return now.select("query_id", "node_id", F.greatest("s", "p").alias("p"))
