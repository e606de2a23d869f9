"""Typed edges inside a pool: compatibility with the query, chains of two from the seeds, and best walks with their path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import vectors as V


def typed_entries(candidates: DataFrame, edges: DataFrame) -> DataFrame:
    """query_id, u, v, rel, sign: each distinct typed edge between two nodes of a query's pool, seen from both ends; sign is
    1 where v is the stored destination, else -1. Loops are left out."""
    stored = edges.where("src <> dst")
    seen = stored.select(F.col("src").alias("u"), F.col("dst").alias("v"), "rel", F.lit(1).alias("sign")).union(stored.select("dst", "src", "rel", F.lit(-1)))
    at = lambda name: candidates.select("query_id", F.col("node_id").alias(name))
    return seen.join(at("v"), "v").join(at("u"), ["query_id", "u"]).select("query_id", "u", "v", "rel", "sign").distinct()


def relation_vectors(edges: DataFrame, vectors: DataFrame) -> DataFrame:
    """rel, rel_vec: the mean vector of the destinations of a relation's edges, each number rounded to six places. Sums are
    kept by dimension, so no task holds a relation's edges."""
    x = edges.select("rel", F.col("dst").alias("node_id")).join(vectors.select("node_id", "vec"), "node_id").select("rel", F.posexplode("vec").alias("at", "x"))
    mean = x.groupBy("rel", "at").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("x"))
    return mean.groupBy("rel").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("rel_vec"))


def with_compatibility(entries: DataFrame, queries: DataFrame, relations: DataFrame) -> DataFrame:
    """entries with rc, the cosine between the query's vector and the relation's. Joins are by (query, relation) pairs that
    occur."""
    pairs = entries.select("query_id", "rel").distinct().join(queries.select("query_id", "vec"), "query_id").join(relations, "rel")
    return entries.join(pairs.select("query_id", "rel", F.round(V.cosine("vec", "rel_vec"), 6).alias("rc")), ["query_id", "rel"])


def _seeded(entries: DataFrame, start: DataFrame, end: str) -> DataFrame:
    """entries with to_seed: whether that end is a seed."""
    s = start.select("query_id", F.col("node_id").alias(end), F.lit(True).alias("_s"))
    return entries.join(s, ["query_id", end], "left").withColumn("to_seed", F.coalesce("_s", F.lit(False))).drop("_s")


def typed_features(entries: DataFrame, start: DataFrame) -> DataFrame:
    """For each node with typed edges: compatibility of its edges and of those to seeds, relations, the share of edges that
    lead into it, and edges to and from seeds."""
    e = _seeded(entries, start, "u")
    rc = F.when(F.col("to_seed"), F.col("rc"))
    count = lambda c: F.log1p(F.count(F.when(c, 1)))
    return e.groupBy("query_id", F.col("v").alias("node_id")).agg(
        F.max("rc").alias("relmax_in"), F.avg("rc").alias("relmean_in"), F.log1p(F.count_distinct("rel")).alias("rel_div"), F.avg((F.col("sign") == 1).cast("double")).alias("dir_in_frac"),
        F.coalesce(F.max(rc), F.lit(0.0)).alias("relmax_seed"), F.coalesce(F.avg(rc), F.lit(0.0)).alias("relmean_seed"),
        count(F.col("to_seed") & (F.col("sign") == -1)).alias("seed_edges_out"), count(F.col("to_seed") & (F.col("sign") == 1)).alias("seed_edges_in"),
    )


def chains(entries: DataFrame, start: DataFrame) -> DataFrame:
    """query_id, node_id, best, mean: over chains seed - x - v the mean of the best compatibility of an edge between x and a
    seed and that of an edge between x and v; neither x nor v is a seed."""
    first = _seeded(entries, start, "u").where("to_seed").groupBy("query_id", F.col("v").alias("u")).agg(F.max("rc").alias("c1"))
    free = start.select("query_id", F.col("node_id").alias("v"))
    e = entries.join(first.join(free.withColumnRenamed("v", "u"), ["query_id", "u"], "left_anti"), ["query_id", "u"]).join(free, ["query_id", "v"], "left_anti")
    return e.withColumn("c", (F.col("c1") + F.col("rc")) / 2).groupBy("query_id", F.col("v").alias("node_id")).agg(F.max("c").alias("best"), F.avg("c").alias("mean"))


def best_walks(entries: DataFrame, start: DataFrame, length: int) -> DataFrame:
    """query_id, node_id, hop, path: of the walks of `hop` typed edges from a seed to a node that of the largest summed
    compatibility, as an array of (u, rel, sign, rc). Ties go to the largest array. A step keeps one walk a node."""
    step = F.struct("u", "rel", "sign", "rc")
    best = start.select("query_id", F.col("node_id").alias("u"), F.lit(0.0).alias("total"), F.array().cast("array<struct<u: bigint, rel: int, sign: int, rc: double>>").alias("path"))
    out = None
    for hop in range(1, length + 1):
        walk = F.struct(F.round(F.col("total") + F.col("rc"), 6).alias("total"), F.concat("path", F.array(step)).alias("path"))
        best = best.join(entries, ["query_id", "u"]).groupBy("query_id", F.col("v").alias("u")).agg(F.max(walk).alias("w")).select("query_id", "u", "w.*")
        part = best.select("query_id", F.col("u").alias("node_id"), F.lit(hop).alias("hop"), "path")
        out = part if out is None else out.unionByName(part)
    return out
