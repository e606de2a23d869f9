"""Sparse retrieval: posting lists in blocks with their largest weight, and exact top-k by bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.sources.shared import cut, stash

MOST_TF = 8


def term_counts(texts: DataFrame, key: str, words: Column) -> DataFrame:
    """key, term, tf of every text; words is an array of terms, empty ones are left out."""
    return texts.select(key, F.explode(words).alias("term")).where("term <> ''").groupBy(key, "term").agg(F.count("*").alias("tf"))


def weights(counts: DataFrame, nodes: int) -> DataFrame:
    """node_id, term, weight of counts (node_id, term, tf): tf up to MOST_TF times the number of binary digits of nodes / df,
    a whole number, so that sums are exact."""
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    digits = F.length(F.bin(F.floor(F.lit(nodes) / F.col("df")).cast("long")))
    return counts.join(df, "term").select("node_id", "term", (F.least("tf", F.lit(MOST_TF)) * digits).cast("long").alias("weight"))


def blocks(weighted: DataFrame, size: int = 256) -> DataFrame:
    """term, block, most (largest weight), postings (node_id, weight): of each term the nodes of one range of `size` node ids.
    A term in all nodes is as many rows as there are ranges, none longer than `size`."""
    block = F.floor(F.col("node_id") / size).cast("long").alias("block")
    return weighted.groupBy("term", block).agg(F.max("weight").alias("most"), F.array_sort(F.collect_list(F.struct("node_id", "weight"))).alias("postings"))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Dealt by key over all shuffle partitions, which stay apart: the rows are fewer than what is made of them."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def block_counts(texts: DataFrame, words: Column, size: int = 256) -> DataFrame:
    """term, block, node_id, tf (up to MOST_TF) of every text (node_id and others); words is an array of terms made of the columns of texts,
    empty ones are left out. Texts are dealt by block once, and all counts are made where they lie: words are never shuffled."""
    dealt = spread(texts.withColumn("block", F.floor(F.col("node_id") / size).cast("long")), "block")
    counts = dealt.select("block", "node_id", F.explode(words).alias("term")).where("term <> ''").groupBy("block", "node_id", "term").agg(F.count("*").alias("tf"))
    return counts.select("term", "block", "node_id", F.least("tf", F.lit(MOST_TF)).alias("tf"))


def rarity(index: DataFrame, nodes: int) -> DataFrame:
    """term, digits: the binary digits of nodes over the nodes that hold the term (index: a row for each term and block, with their number
    `nodes`)."""
    df = index.groupBy("term").agg(F.sum("nodes").alias("_df"))
    return df.select("term", F.length(F.bin(F.floor(F.lit(nodes) / F.col("_df")).cast("long"))).cast("long").alias("digits"))


def text_blocks(texts: DataFrame, words: Column, nodes: int, asked: DataFrame, size: int = 256) -> DataFrame:
    """What blocks gives of the weights of the texts' terms, for the terms of asked (query_id, term). All terms are indexed; a term's
    weights have one factor, the same in all of its blocks, which is put into those that are asked for."""
    index = block_counts(texts, words, size).groupBy("block", "term").agg(F.max("tf").alias("most"), F.count("*").alias("nodes"), F.array_sort(F.collect_list(F.struct("node_id", F.col("tf").alias("weight")))).alias("postings"))
    index = stash(stash(index, "counted").join(stash(asked.select("term").distinct(), "terms"), "term", "left_semi"), "asked")
    whole = index.join(rarity(index.select("term", "nodes"), nodes), "term")
    return whole.select("term", "block", (F.col("most") * F.col("digits")).alias("most"), F.transform("postings", lambda p: F.struct(p["node_id"].alias("node_id"), (p["weight"] * F.col("digits")).alias("weight"))).alias("postings"))


def block_sums(texts: DataFrame, words: Column, nodes: int, size: int = 256) -> DataFrame:
    """term, block, most, nodes, total: the largest weight in each block, its nodes and the sum of their weights, without postings."""
    sums = stash(block_counts(texts, words, size).groupBy("block", "term").agg(F.max("tf").alias("most"), F.count("*").alias("nodes"), F.sum("tf").alias("total")), "sums")
    whole = sums.join(rarity(sums.select("term", "nodes"), nodes), "term")
    return whole.select("term", "block", (F.col("most") * F.col("digits")).alias("most"), "nodes", (F.col("total") * F.col("digits")).alias("total"))


def top(index: DataFrame, asked: DataFrame, k: int, first: int = 2) -> DataFrame:
    """query_id, node_id, score, rank of the k nodes of largest score (ties: the smaller id) of each query of asked (query_id,
    term, q): the sum over terms of q times the node's weight. Nodes without a common term are not returned.

    A block's bound is the sum of its largest weights. The `first` blocks of largest bound of each query are scored whole and
    give a threshold, the k-th best score so far; of the others only blocks whose bound reaches it are scored. No node of a
    block left out can be among the best, so the result is exact."""
    heads = index.select("term", "block", "most").join(asked, "term")
    bounds = heads.groupBy("query_id", "block").agg(F.sum(F.col("q") * F.col("most")).alias("bound"))
    bounds = stash(bounds.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "block"))), "bounds")

    groups = asked.agg(F.count_distinct("query_id").alias("n")).select(F.greatest(F.lit(1), F.ceil(F.col("n") / 1024)).alias("_groups"))
    asked = cut(asked.crossJoin(F.broadcast(groups)).withColumn("_g", F.pmod(F.xxhash64("query_id"), "_groups")).drop("_groups"))  # groups: one row

    def scored(some: DataFrame) -> DataFrame:
        # A list is sent once to the up to about 1,024 queries that ask for it; the lists of a block meet in one task, which adds
        # up all of its nodes and keeps k a query, so that neither hits nor sums are shuffled.
        open_ = asked.join(some.select("query_id", "block"), "query_id").groupBy("term", "block", "_g").agg(F.collect_list(F.struct("query_id", "q")).alias("asking"))
        lists = spread(open_.join(index.select("term", "block", "postings"), ["term", "block"]).select("block", "postings", "asking"), "block")
        hits = lists.select("block", "postings", F.explode("asking").alias("a")).select("block", "a.query_id", "a.q", F.explode("postings").alias("p"))
        sums = hits.groupBy("block", "query_id", F.col("p.node_id").alias("node_id")).agg(F.sum(F.col("q") * F.col("p.weight")).alias("score")).select("query_id", "node_id", "score")
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "node_id"))
        return sums.withColumn("rank", place).where(F.col("rank") <= k)

    ahead = cut(scored(bounds.where(F.col("place") <= first)))
    least = ahead.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    rest = bounds.where(F.col("place") > first).join(least, "query_id", "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least")))
    both = ahead.drop("rank").unionByName(scored(rest).drop("rank"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "node_id"))
    return both.withColumn("rank", place).where(F.col("rank") <= k)
