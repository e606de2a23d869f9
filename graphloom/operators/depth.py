"""What a candidate sees at each distance: rings of the pool's graph, walks from the seeds, and typed walks with their best path."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import vectors as V
from graphloom.operators import graph, pool
from graphloom.sources.shared import cut

PATH = "array<struct<u: bigint, rel: int, sign: int, rc: double>>"


def ring_features(links: DataFrame, start: DataFrame, cos: DataFrame, vectors: DataFrame, size: int) -> DataFrame:
    """query_id, view, node_id, hop (one to three), seeds_at, seedmass, ring_qmean, ring_qmax, ring_n, seedproto: of the nodes at
    exactly that distance the seeds (start: query_id, node_id, m) and their mass, the cosines with the query (cos: query_id,
    node_id, c), their number, and the node's cosine with the mean vector of the seeds there (null without any). links are
    those of pool.view_links. Nodes without a ring at a distance have no row."""
    by = ["query_id", "view", "node_id", "hop"]
    ring = cut(graph.rings(links)).select("query_id.query_id", "query_id.view", F.col("src").alias("node_id"), F.col("dst").alias("other"), F.col("distance").alias("hop"))
    other = lambda df: df.withColumnRenamed("node_id", "other")
    found = ring.join(other(cos), ["query_id", "other"]).join(other(start), ["query_id", "other"], "left")
    stats = found.groupBy(*by).agg(F.count("m").alias("seeds_at"), F.coalesce(F.sum("m"), F.lit(0.0)).alias("seedmass"), F.avg("c").alias("ring_qmean"), F.max("c").alias("ring_qmax"), F.count("*").alias("ring_n"))
    near = ring.join(other(start).drop("m"), ["query_id", "other"]).join(other(vectors), "other")
    mean = pool.weighted_mean(near, by, "vec", F.lit(1.0), size, "p").join(vectors, "node_id")
    return stats.join(mean.select(*by, V.cosine("vec", "p").alias("seedproto")), by, "left")


def walk_features(links: DataFrame, start: DataFrame, views: dict[str, tuple[str, ...]], length: int = 3) -> DataFrame:
    """query_id, view, node_id, hop, paths, branch, support: walks of exactly `hop` links from the seeds (start: query_id, node_id,
    m), neighbours that a walk shorter by one reaches, and what averaging over neighbours brings of the seeds' mass."""
    links = cut(links)
    deg = links.groupBy("query_id", F.col("dst").alias("node_id")).agg(F.count("*").alias("deg"))
    at = pool.in_views(start.select("query_id", "node_id", F.lit(1).cast("long").alias("paths"), F.col("m").alias("support")), views)
    out = None
    for hop in range(1, length + 1):
        step = at.withColumnRenamed("node_id", "src").join(links, ["query_id", "src"]).groupBy("query_id", F.col("dst").alias("node_id"))
        sums = step.agg(F.sum("paths").alias("paths"), F.count("*").alias("branch"), F.sum("support").alias("support"))
        at = cut(sums.join(deg, ["query_id", "node_id"]).select("query_id", "node_id", "paths", "branch", (F.col("support") / F.col("deg")).alias("support")))
        part = at.select("query_id.query_id", "query_id.view", "node_id", F.lit(hop).alias("hop"), "paths", "branch", "support")
        out = part if out is None else out.unionByName(part)
    return out


def typed_walks(entries: DataFrame, start: DataFrame, length: int = 3, temperature: float = 0.1) -> DataFrame:
    """query_id, node_id, hop, walks, best, mean, narrow, qsupport, path for each node that typed walks of `hop` entries (u, v, rel,
    sign, rc) from the seeds (start: query_id, node_id, m) reach: their number; over walks the largest mean of rc, the mean
    of means, and the largest of least rc; the seeds' mass carried over entries with weights exp(rc / temperature), which
    sum to one at each node; and the walk of the largest mean, as an array of (u, rel, sign, rc) from the seed on.

    A node keeps one walk a length: the largest sum (six places), then the smallest last node, relation and sign. All
    quantities come from one join and one aggregate a step."""
    of = Window.partitionBy("query_id", "v")
    heat = F.exp((F.col("rc") - F.max("rc").over(of)) / temperature)
    e = cut(entries.select("query_id", "u", "v", "rel", "sign", "rc", heat.alias("h")).withColumn("w", F.col("h") / F.sum("h").over(of)).drop("h"))
    at = start.select("query_id", F.col("node_id").alias("u"), F.lit(1).cast("long").alias("walks"), F.lit(0.0).alias("total"), F.lit(0.0).alias("best"), F.lit(float("inf")).alias("narrow"), F.col("m").alias("qsupport"), F.array().cast(PATH).alias("path"))
    out = None
    for hop in range(1, length + 1):
        choice = F.struct((-F.round(F.col("best") + F.col("rc"), 6)).alias("less"), "u", "rel", "sign", "rc", "path")
        step = at.join(e, ["query_id", "u"]).groupBy("query_id", "v").agg(
            F.sum("walks").alias("walks"), F.sum(F.col("total") + F.col("walks") * F.col("rc")).alias("total"), F.max(F.least("narrow", "rc")).alias("narrow"),
            F.sum(F.col("qsupport") * F.col("w")).alias("qsupport"), F.min(choice).alias("c"),
        )
        path = F.concat("c.path", F.array(F.struct("c.u", "c.rel", "c.sign", "c.rc")))
        at = cut(step.select("query_id", F.col("v").alias("u"), "walks", "total", (-F.col("c.less")).alias("best"), "narrow", "qsupport", path.cast(PATH).alias("path")))
        mean = F.col("total") / (hop * F.col("walks"))
        part = at.select("query_id", F.col("u").alias("node_id"), F.lit(hop).alias("hop"), "walks", (F.col("best") / hop).alias("best"), mean.alias("mean"), "narrow", "qsupport", "path")
        out = part if out is None else out.unionByName(part)
    return out
