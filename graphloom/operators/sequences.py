"""Walks keyed by the sequence of their relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.sources.shared import cut


def chain_entries(steps: DataFrame, start: DataFrame, hops: int, each: int) -> DataFrame:
    """query_id, node_id, hop, chain, mass, place: walks of up to `hops` typed steps from the seeds.

    steps (query_id, u, v, z) are typed steps, z a number of relation and direction. Seeds share a mass of one; a node passes
    its mass to its steps in equal parts. Mass is added up for each sequence of steps (chain: their numbers, two digits each,
    joined by a point) and node. Of each chain's nodes that are no seeds, mass is taken as a share of their sum; chains with
    seeds only are left out. A node keeps its `each` entries of largest mass (nine places), ties in the order of chains,
    shorter ones first. The frontier is checkpointed each hop; it holds one row for each chain and node."""
    seeds = start.select("query_id", F.col("node_id").alias("u")).distinct()
    share = cut(steps.withColumn("share", 1 / F.count("*").over(Window.partitionBy("query_id", "u"))))
    now = seeds.withColumn("mass", 1 / F.count("*").over(Window.partitionBy("query_id"))).withColumn("chain", F.lit(""))
    out = None
    for hop in range(1, hops + 1):
        code = F.lpad(F.col("z").cast("string"), 2, "0")
        chain = code if hop == 1 else F.concat_ws(".", "chain", code)
        now = cut(now.join(share, ["query_id", "u"]).select("query_id", chain.alias("chain"), F.col("v").alias("u"), (F.col("mass") * F.col("share")).alias("mass")).groupBy("query_id", "chain", "u").agg(F.sum("mass").alias("mass")))
        part = now.withColumn("hop", F.lit(hop))
        out = part if out is None else out.unionByName(part)
    free = out.join(seeds, ["query_id", "u"], "left_anti")
    free = free.withColumn("mass", F.round(F.col("mass") / F.sum("mass").over(Window.partitionBy("query_id", "hop", "chain")), 9))
    place = F.row_number().over(Window.partitionBy("query_id", "u").orderBy(F.desc("mass"), "hop", "chain"))
    return free.withColumn("place", place).where(F.col("place") <= each).select("query_id", F.col("u").alias("node_id"), "hop", "chain", "mass", "place")
