"""Perturbations of edges and features. What is random is a hash of the edge's place and a seed, so results do not depend
on partitions. drop_edges meets its rate exactly, the others in expectation; the rows that change at a rate change at a larger one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.order import numbered
from graphloom.sources.shared import cut


def chance(key: Column, seed: str) -> Column:
    """A number in [0, 1) from the first eight hexadecimal digits of an MD5."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), key.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def drop_edges(edges: DataFrame, rate: float, seed: str) -> DataFrame:
    """All edges but the round(rate * edges) of smallest chance (half to even)."""
    placed = numbered(edges.withColumn("_c", chance(F.col("edge_pos"), seed)), ["_c", "edge_pos"], "_p")
    gone = edges.agg(F.rint(F.count("*") * rate).alias("_gone"))
    return placed.crossJoin(F.broadcast(gone)).where(F.col("_p") >= F.col("_gone")).drop("_c", "_p", "_gone")


def move_on(edges: DataFrame, column: str, rate: float, seed: str, by: list[str], stretch: int) -> DataFrame:
    """The chosen edges pass their values of a column on by one place, in circles inside stretches of `stretch` places, so
    that no task orders all edges and the column's counts stay."""
    chosen = edges.where(chance(F.col("edge_pos"), seed) < rate)
    w = Window.partitionBy(*by, F.floor(F.col("edge_pos") / stretch)).orderBy("edge_pos")
    first = F.first(column).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    moved = chosen.withColumn(column, F.coalesce(F.lead(column).over(w), first))
    return edges.where(chance(F.col("edge_pos"), seed) >= rate).unionByName(moved)


def rewire(edges: DataFrame, rate: float, seed: str, by: str, stretch: int = 1000) -> DataFrame:
    """Destinations of the chosen edges move on by one place within a group; every in- and out-degree stays."""
    return move_on(edges, "dst", rate, seed, [by], stretch)


def inject_hubs(edges: DataFrame, rate: float, seed: str) -> DataFrame:
    """Chosen edges point to the node that most edges enter (the smallest such)."""
    hub = edges.groupBy("dst").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dst").limit(1).select(F.col("dst").alias("_hub"))
    return edges.crossJoin(F.broadcast(hub)).withColumn("dst", F.when(chance(F.col("edge_pos"), seed) < rate, F.col("_hub")).otherwise(F.col("dst"))).drop("_hub")


def corrupt_types(edges: DataFrame, rate: float, seed: str, stretch: int = 1000) -> DataFrame:
    """Labels of the chosen edges are permuted among them; every label is as frequent as before."""
    return move_on(edges, "rel", rate, seed, [], stretch)


def add_random_edges(edges: DataFrame, nodes: DataFrame, rate: float, seed: str) -> DataFrame:
    """src, dst of round(rate * edges) edges that are new, distinct and no loops: try number i joins the nodes at two hashed
    places; of the tries that stand the test, the first by number are taken. Tries are numbered from the edges' own places, twice as
    many as are wanted at a time, until there are enough; with fewer possible edges than wanted all of them are returned."""
    want, possible = int(edges.agg(F.rint(F.count("*") * rate).cast("long")).first()[0]), nodes.count()
    known = cut(edges.select("src", "dst").distinct())
    total, free = edges.count(), possible * (possible - 1) - known.where("src <> dst").count()
    if not want or not total or free <= 0:
        return edges.sparkSession.createDataFrame([], "src long, dst long")
    ids = cut(numbered(nodes.select("node_id"), ["node_id"], "at"))
    places = cut(numbered(edges.select("edge_pos"), ["edge_pos"], "at"))
    place = lambda s: F.floor(chance(F.col("i"), seed + s) * possible).cast("long")
    found, low = None, 0
    while True:
        high = low + 2 * want
        # Tries low + 1 to high, dealt over the edges: place p gives p + 1, p + 1 + total and so on.
        tries = places.select(F.explode(F.sequence(F.lit(low // total), F.lit(high // total))).alias("turn"), "at").select((F.col("turn") * total + F.col("at") + 1).alias("i")).where(F.col("i").between(low + 1, high))
        pairs = tries.select("i", place("a").alias("p"), place("b").alias("q"))
        pairs = pairs.join(ids.select(F.col("at").alias("p"), F.col("node_id").alias("src")), "p").join(ids.select(F.col("at").alias("q"), F.col("node_id").alias("dst")), "q").where("src <> dst").select("src", "dst", "i")
        new = pairs.join(known, ["src", "dst"], "left_anti")
        found = cut((new if found is None else new.unionByName(found)).groupBy("src", "dst").agg(F.min("i").alias("i")))
        low = high
        if found.count() >= min(want, free):
            return numbered(found, ["i"], "p").where(F.col("p") < want).select("src", "dst")


def mask_features(vectors: DataFrame, rate: float, seed: str) -> DataFrame:
    """Each entry of a vector becomes 0 with probability `rate`."""
    return vectors.withColumn("vec", F.transform("vec", lambda x, i: F.when(chance(F.concat_ws(":", F.col("node_id").cast("string"), i.cast("string")), seed) < rate, F.lit(0.0)).otherwise(x.cast("double"))))
