"""Breadth-first searches from many starts at once: a long holds one bit for each of 64 starts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.sources.shared import cut

KEY = ["query_id", "word", "node_id"]


def numbered_starts(pool: DataFrame) -> DataFrame:
    """pool (query_id, node_id) with word and bits: each node's place in its query, as the 64-bit word and the bit in it."""
    at = F.row_number().over(Window.partitionBy("query_id").orderBy("node_id")) - 1
    return pool.select("query_id", "node_id").distinct().withColumn("_at", at).select("query_id", F.floor(F.col("_at") / 64).cast("int").alias("word"), "node_id", F.expr("shiftleft(1L, cast(_at % 64 as int))").alias("bits"))


def search(starts: DataFrame, links: DataFrame, hops: int) -> DataFrame:
    """query_id, word, node_id, hop, bits: the starts that reach a node at exactly `hop` links (0 to hops). links is (src, dst)
    or (query_id, src, dst). A step is one join and one bit_or, with partial sums before the shuffle; what a node has seen
    before is masked out. Every hop is checkpointed."""
    links = links.distinct()
    keys = ["query_id", "src"] if "query_id" in links.columns else ["src"]
    front = starts.select(*KEY, "bits")
    seen = front
    out = front.withColumn("hop", F.lit(0))
    for hop in range(1, hops + 1):
        step = front.withColumnRenamed("node_id", "src").join(links, keys).groupBy("query_id", "word", F.col("dst").alias("node_id")).agg(F.bit_or("bits").alias("bits"))
        new = step.join(seen.withColumnRenamed("bits", "old"), KEY, "left").select(*KEY, F.expr("bits & ~coalesce(old, 0L)").alias("bits")).where("bits <> 0")
        front = cut(new)
        out = out.unionByName(front.withColumn("hop", F.lit(hop)))
        if hop < hops:
            seen = cut(seen.unionByName(front).groupBy(*KEY).agg(F.bit_or("bits").alias("bits")))
    return out


def preservation(wide: DataFrame, narrow: DataFrame, pool: DataFrame, hops: int) -> DataFrame:
    """By query: pairs (start, another node of the pool) within each distance in the wide graph, the share kept within that
    distance in the narrow one, its complement (bridge loss), the share of pairs connected in both that are farther in the
    narrow graph, and by how much on average. wide and narrow are search results; all counts are of bits."""
    inside = lambda df, name: df.where("hop > 0").join(pool.select("query_id", "node_id").distinct(), ["query_id", "node_id"]).groupBy(*KEY).pivot("hop", list(range(1, hops + 1))).agg(F.bit_or("bits")).select(*KEY, *[F.coalesce(F.col(str(h)), F.lit(0).cast("long")).alias(f"{name}{h}") for h in range(1, hops + 1)])
    j = inside(wide, "g").join(inside(narrow, "l"), KEY, "left").na.fill(0)
    g = lambda h: "(" + " | ".join(f"g{i}" for i in range(1, h + 1)) + ")"
    l = lambda h: "(" + " | ".join(f"l{i}" for i in range(1, h + 1)) + ")"  # noqa: E731, E741
    both = f"{g(hops)} & {l(hops)}"
    sums = [F.expr(f"sum(bit_count({g(h)}))").alias(f"eligible_{h}") for h in range(1, hops + 1)] + [F.expr(f"sum(bit_count({g(h)} & {l(h)}))").alias(f"kept_{h}") for h in range(1, hops + 1)]
    far = lambda n: " + ".join(f"{h} * bit_count({n}{h} & ({both}))" for h in range(1, hops + 1))
    equal = " + ".join(f"bit_count(g{h} & l{h})" for h in range(1, hops + 1))
    t = j.groupBy("query_id").agg(*sums, F.expr(f"sum(bit_count({both}))").alias("both"), F.expr(f"sum({equal})").alias("equal"), F.expr(f"sum({far('l')}) - sum({far('g')})").alias("more"))
    share = lambda a, b, name: F.round(F.try_divide(a, b), 6).alias(name)
    kept = [c for h in range(1, hops + 1) for c in (F.col(f"eligible_{h}"), share(F.col(f"kept_{h}"), F.col(f"eligible_{h}"), f"preserved_{h}"), share(F.col(f"eligible_{h}") - F.col(f"kept_{h}"), F.col(f"eligible_{h}"), f"bridge_loss_{h}"))]
    return t.select("query_id", *kept, share(F.col("both") - F.col("equal"), F.col("both"), "inflated"), share(F.col("more"), F.col("both"), "mean_inflation"))


def reach_sizes(nodes: DataFrame, links: DataFrame, hops: int, lg_k: int = 12) -> DataFrame:
    """node_id, hop, reached: about how many other nodes lie within each number of links, from every node. Each node has a sketch
    of distinct nodes (relative error near 1.04 / sqrt(2 ** lg_k)); in a round it takes in those of its links, so a round is one
    join and one aggregate, however many nodes are reached. Only rounded sizes are returned."""
    links = links.where("src <> dst").distinct()
    own = cut(nodes.select("node_id").distinct().groupBy("node_id").agg(F.hll_sketch_agg("node_id", lg_k).alias("sketch")))
    out = None
    for hop in range(1, hops + 1):
        ahead = links.join(own.select(F.col("node_id").alias("dst"), "sketch"), "dst").select(F.col("src").alias("node_id"), "sketch")
        own = cut(own.unionByName(ahead).groupBy("node_id").agg(F.hll_union_agg("sketch").alias("sketch")))
        part = own.select("node_id", F.lit(hop).alias("hop"), (F.hll_sketch_estimate("sketch") - 1).alias("reached"))
        out = part if out is None else out.unionByName(part)
    return out
