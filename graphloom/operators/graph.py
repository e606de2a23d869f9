"""Edges, induced subgraphs and traversal. Edge tables keep multiplicity: (family, src, dst, rel, weight, edge_pos)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.sources.shared import cut, stash  # noqa: F401


def canonical_edges(edges: DataFrame) -> DataFrame:
    """Simple undirected edges a < b."""
    return edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(pairs.select("b", "a"))


def coalesce_edges(edges: DataFrame) -> DataFrame:
    """One edge for each (src, dst): the first in stored order, with its type."""
    return edges.groupBy("src", "dst").agg(F.min_by("rel", "edge_pos").alias("rel"))


def family_order(edges: DataFrame) -> DataFrame:
    """Undirected adjacency of each family with the rank of every neighbour by (weight desc, id asc)."""
    two = edges.where("src <> dst").select("family", F.col("src").alias("node"), F.col("dst").alias("nbr"), "weight").union(edges.where("src <> dst").select("family", "dst", "src", "weight"))
    best = two.groupBy("family", "node", "nbr").agg(F.max("weight").alias("weight"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("family", "node").orderBy(F.desc("weight"), "nbr")))


def degree_damp(edges: DataFrame, family: str, most: int) -> DataFrame:
    """Without that family's edges into nodes that more than `most` of them enter."""
    busy = edges.where(F.col("family") == family).groupBy("dst").agg(F.count("*").alias("n")).where(F.col("n") > most).select(F.col("dst"), F.lit(family).alias("family"))
    return edges.join(busy, ["family", "dst"], "left_anti")


def induce_subgraph(candidates: DataFrame, edges: DataFrame) -> DataFrame:
    """query_id, src, dst, mult: stored edges with both ends among a query's candidates."""
    c1 = candidates.select("query_id", F.col("node_id").alias("src"))
    c2 = candidates.select("query_id", F.col("node_id").alias("dst"))
    return edges.select("src", "dst").join(c1, "src").join(c2, ["query_id", "dst"]).groupBy("query_id", "src", "dst").agg(F.count("*").alias("mult"))


def retention(candidates: DataFrame, edges: DataFrame, local: DataFrame) -> DataFrame:
    """query_id, node_id, out_degree, kept: stored out-edges of each candidate, and those that stay inside the pool."""
    out = edges.groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("out_degree"))
    kept = local.groupBy("query_id", F.col("src").alias("node_id")).agg(F.sum("mult").alias("kept"))
    both = candidates.select("query_id", "node_id").join(out, "node_id", "left").join(kept, ["query_id", "node_id"], "left")
    return both.select("query_id", "node_id", F.coalesce("out_degree", F.lit(0)).alias("out_degree"), F.coalesce("kept", F.lit(0)).alias("kept"))


def step(frontier: DataFrame, links: DataFrame) -> DataFrame:
    """(query_id, node_id) one link on: links is (src, dst) or (query_id, src, dst)."""
    keys = ["query_id", "src"] if "query_id" in links.columns else ["src"]
    return frontier.withColumnRenamed("node_id", "src").join(links, keys).select("query_id", F.col("dst").alias("node_id")).distinct()


def bfs(start: DataFrame, links: DataFrame, hops: int) -> DataFrame:
    """query_id, node_id, hop (0 to hops) of the nodes reached; from the third hop on the reached set is checkpointed each
    time, so that plans don't grow with the hops."""
    links = links.distinct()
    seen = start.select("query_id", "node_id").distinct().withColumn("hop", F.lit(0))
    front = seen.drop("hop")
    for h in range(1, hops + 1):
        front = step(front, links).join(seen.select("query_id", "node_id"), ["query_id", "node_id"], "left_anti")
        if h > 2:
            front = cut(front)
        seen = seen.unionByName(front.withColumn("hop", F.lit(h)))
        if h > 2 and h < hops:
            seen = cut(seen)
    return seen


def walk_counts(start: DataFrame, local: DataFrame, length: int) -> DataFrame:
    """query_id, node_id, length, walks: walks from the start nodes along stored edges, with multiplicity."""
    now = start.select("query_id", "node_id").distinct().withColumn("walks", F.lit(1).cast("long"))
    out = None
    for h in range(1, length + 1):
        now = now.withColumnRenamed("node_id", "src").join(local, ["query_id", "src"]).groupBy("query_id", F.col("dst").alias("node_id")).agg(F.sum(F.col("walks") * F.col("mult")).alias("walks"))
        part = now.withColumn("length", F.lit(h))
        out = part if out is None else out.unionByName(part)
    return out


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """query_id, node_id, component (smallest node reachable without regard to direction), by label propagation with
    pointer jumping; every round is checkpointed, and it ends when no label changes."""
    pairs = cut(links.select("query_id", "src", "dst").union(links.select("query_id", F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    label = cut(nodes.select("query_id", "node_id", F.col("node_id").alias("component")))
    while True:
        near = label.withColumnRenamed("node_id", "src").join(pairs, ["query_id", "src"]).groupBy("query_id", F.col("dst").alias("node_id")).agg(F.min("component").alias("near"))
        one = label.join(near, ["query_id", "node_id"], "left").select("query_id", "node_id", F.col("component").alias("old"), F.least("component", F.coalesce("near", "component")).alias("up"))
        jump = label.select("query_id", F.col("node_id").alias("up"), F.col("component").alias("over"))
        new = cut(one.join(jump, ["query_id", "up"]).select("query_id", "node_id", "old", F.least("up", "over").alias("component")))
        label = new.drop("old")
        if new.where("old <> component").isEmpty():
            return label


def ppr_local(nodes: DataFrame, start: DataFrame, local: DataFrame, rounds: int = 8, damping: float = 0.85) -> DataFrame:
    """query_id, node_id, mass: personalised PageRank on each query's induced multigraph; dangling mass returns to the
    seeds; divided by the query's largest mass."""
    size = start.groupBy("query_id").agg(F.count("*").alias("_s"))
    base = start.select("query_id", "node_id").join(size, "query_id").select("query_id", "node_id", (1 / F.col("_s")).alias("r"))
    out = local.groupBy("query_id", "src").agg(F.sum("mult").alias("out"))
    moves = cut(local.join(out, ["query_id", "src"]).select("query_id", "src", "dst", (F.col("mult") / F.col("out")).alias("p")))
    all_ = nodes.select("query_id", "node_id").join(base, ["query_id", "node_id"], "left").join(out.select("query_id", F.col("src").alias("node_id"), "out"), ["query_id", "node_id"], "left").select("query_id", "node_id", F.coalesce("r", F.lit(0.0)).alias("r"), F.col("out").isNull().alias("dangling"))
    now = cut(all_.withColumn("x", F.col("r")))
    for _ in range(rounds):
        flow = now.withColumnRenamed("node_id", "src").join(moves, ["query_id", "src"]).groupBy("query_id", F.col("dst").alias("node_id")).agg(F.sum(F.col("x") * F.col("p")).alias("flow"))
        lost = F.sum(F.when(F.col("dangling"), F.col("x")).otherwise(0.0)).over(Window.partitionBy("query_id"))
        now = cut(now.withColumn("_lost", lost).join(flow, ["query_id", "node_id"], "left").select(
            "query_id", "node_id", "r", "dangling", ((1 - damping) * F.col("r") + damping * F.col("_lost") * F.col("r") + damping * F.coalesce("flow", F.lit(0.0))).alias("x")
        ))
    top = F.max("x").over(Window.partitionBy("query_id"))
    return now.select("query_id", "node_id", F.when(top > 0, F.col("x") / top).otherwise(0.0).alias("mass"))


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = 5, damping: float = 0.85) -> DataFrame:
    """node_id, rank on the simple digraph; teleport and dangling mass are uniform; the ranks add up to 1."""
    simple = edges.select("src", "dst").distinct()
    moves = cut(simple.join(simple.groupBy("src").agg(F.count("*").alias("out")), "src"))
    n = nodes.agg(F.count("*").alias("n"))
    now = cut(nodes.select("node_id").crossJoin(F.broadcast(n)).select("node_id", "n", (1 / F.col("n")).alias("x")).join(moves.select(F.col("src").alias("node_id"), "out").distinct(), "node_id", "left"))
    for _ in range(rounds):
        flow = now.select(F.col("node_id").alias("src"), "x").join(moves, "src").groupBy(F.col("dst").alias("node_id")).agg(F.sum(F.col("x") / F.col("out")).alias("flow"))
        lost = now.where("out is null").agg(F.coalesce(F.sum("x"), F.lit(0.0)).alias("lost"))
        now = cut(now.drop("x").join(flow, "node_id", "left").crossJoin(F.broadcast(lost)).select("node_id", "n", "out", ((1 - damping) / F.col("n") + damping * F.col("lost") / F.col("n") + damping * F.coalesce("flow", F.lit(0.0))).alias("x")))
    total = now.agg(F.sum("x").alias("total"))
    return now.crossJoin(F.broadcast(total)).select("node_id", (F.col("x") / F.col("total")).alias("rank"))


def expand_frontier(start: DataFrame, order: DataFrame, first: int, each: int, frontier: int, hops: int) -> DataFrame:
    """query_id, node_id, hop, place: nodes found from start (query_id, node_id, place) hop by hop in order of first
    appearance (place of the parent, structural family first, rank). Of a start node the `first` neighbours of each family
    are taken, later `each` of every one of the `frontier` first nodes; nodes already visited don't appear again."""
    seen = start.select("query_id", "node_id")
    front, out, most = start, None, first
    for h in range(1, hops + 1):
        step_ = front.select("query_id", F.col("node_id").alias("node"), "place").join(order.where(F.col("rank") <= most), "node")
        at = F.min(F.struct("place", (F.col("family") != "structural").alias("f"), "rank")).alias("at")
        new = step_.groupBy("query_id", F.col("nbr").alias("node_id")).agg(at).join(seen, ["query_id", "node_id"], "left_anti")
        new = cut(new.select("query_id", "node_id", F.lit(h).alias("hop"), F.row_number().over(Window.partitionBy("query_id").orderBy("at")).alias("place")))
        out = new if out is None else out.unionByName(new)
        seen = seen.union(new.select("query_id", "node_id"))
        front, most = new.where(F.col("place") <= frontier), each
    return out


def mass_walks(start: DataFrame, links: DataFrame, length: int) -> DataFrame:
    """query_id, node_id, hop, x: mass of start (query_id, node_id, x) after each number of steps; a step shares a node's mass
    among its links (src, dst, m) in proportion to m."""
    share = links.select("src", "dst", (F.col("m") / F.sum("m").over(Window.partitionBy("src"))).alias("p"))
    now, out = start, None
    for h in range(1, length + 1):
        now = now.withColumnRenamed("node_id", "src").join(share, "src").groupBy("query_id", F.col("dst").alias("node_id")).agg(F.sum(F.col("x") * F.col("p")).alias("x"))
        part = now.withColumn("hop", F.lit(h))
        out = part if out is None else out.unionByName(part)
    return out


def rings(local: DataFrame) -> DataFrame:
    """query_id, src, dst, distance: pairs at exactly one, two and three undirected links of each query's graph."""
    le = local.where("src <> dst").select("query_id", "src", "dst")
    one = le.union(le.select("query_id", "dst", "src")).distinct()
    seen, front = one.withColumn("distance", F.lit(1)), one
    for d in (2, 3):
        far = front.withColumnRenamed("dst", "mid").join(one.withColumnRenamed("src", "mid"), ["query_id", "mid"]).where("src <> dst").select("query_id", "src", "dst").distinct()
        front = far.join(seen.select("query_id", "src", "dst"), ["query_id", "src", "dst"], "left_anti")
        seen = seen.unionByName(front.withColumn("distance", F.lit(d)))
    return seen


def ppr_push(start: DataFrame, moves: DataFrame, alpha: float, eps: float) -> DataFrame:
    """query_id, node_id, x: personalised PageRank by push. Every node whose residue is eps times its number of links or more
    keeps alpha of it and passes the rest on (moves src, dst, p); all such nodes push in the same round. Nodes without
    links keep the whole. When none is left, no estimate is short by more than the residues that remain, of which each is
    below eps times the links of its node. Each round takes alpha of what it pushes out of the total, so rounds end; each
    is checkpointed."""
    moves = cut(moves)
    degree = cut(moves.groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("deg")))
    now = cut(start.join(degree, "node_id", "left").select("query_id", "node_id", F.col("x").alias("r"), F.lit(0.0).alias("x"), F.coalesce("deg", F.lit(0)).alias("deg")))
    while True:
        ready = F.col("r") >= eps * F.greatest(F.col("deg"), F.lit(1))
        if now.where(ready & (F.col("r") > 0)).isEmpty():
            return now.where("x > 0").select("query_id", "node_id", "x")
        keep = F.when(F.col("deg") == 0, F.col("r")).otherwise(alpha * F.col("r"))
        stay = now.select("query_id", "node_id", F.when(ready, 0.0).otherwise(F.col("r")).alias("r"), (F.col("x") + F.when(ready, keep).otherwise(0.0)).alias("x"))
        sent = now.where(ready & (F.col("deg") > 0)).select("query_id", F.col("node_id").alias("src"), "r").join(moves, "src").select("query_id", F.col("dst").alias("node_id"), ((1 - alpha) * F.col("r") * F.col("p")).alias("r"), F.lit(0.0).alias("x"))
        both = stay.unionByName(sent).groupBy("query_id", "node_id").agg(F.sum("r").alias("r"), F.sum("x").alias("x"))
        now = cut(both.join(degree, "node_id", "left").select("query_id", "node_id", "r", "x", F.coalesce("deg", F.lit(0)).alias("deg")))


def expand_structural(candidates: DataFrame, start: DataFrame, edges: DataFrame, scan: int = 4096, each: int = 16, most: int = 128) -> DataFrame:
    """query_id, node_id, pos: out-neighbours of the seeds outside the pool; of each seed the first `scan` by id are looked
    at and the first `each` kept; of a query's distinct nodes the first `most` by id."""
    out = start.select("query_id", F.col("node_id").alias("src")).join(edges.select("src", "dst").distinct(), "src").where("src <> dst")
    out = out.withColumn("_scan", F.row_number().over(Window.partitionBy("query_id", "src").orderBy("dst"))).where(F.col("_scan") <= scan)
    new = out.withColumnRenamed("dst", "node_id").join(candidates.select("query_id", "node_id"), ["query_id", "node_id"], "left_anti")
    kept = new.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "src").orderBy("node_id"))).where(F.col("_n") <= each)
    one = kept.select("query_id", "node_id").distinct()
    return one.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("node_id"))).where(F.col("pos") <= most)


def coreness(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """node_id, core of every node: values start at the degree and are replaced by the h-index of the neighbours' values
    until none changes; they only fall, so that ends, however long a path is. links holds both directions of simple edges. Every
    round is checkpointed."""
    links = cut(links)
    now = cut(links.groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("core")))
    while True:
        seen = links.join(now.withColumnRenamed("node_id", "dst"), "dst").groupBy(F.col("src").alias("node_id"), "core").agg(F.count("*").alias("c"))
        above = F.sum("c").over(Window.partitionBy("node_id").orderBy(F.desc("core")))
        h = seen.withColumn("_h", F.least(F.col("core"), above)).groupBy("node_id").agg(F.max("_h").alias("h"))
        new = cut(now.join(h, "node_id").select("node_id", F.col("core").alias("old"), F.least("core", "h").alias("core")))
        now = new.drop("old")
        if new.where("old <> core").isEmpty():
            return nodes.select("node_id").join(now, "node_id", "left").select("node_id", F.coalesce("core", F.lit(0)).alias("core"))
