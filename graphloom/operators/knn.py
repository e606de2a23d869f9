"""Nearest-neighbour graphs of all nodes: refined in rounds from neighbours of neighbours, and the families derived from them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import vectors as V
from graphloom.sources.shared import cut, stash

LIST = "node_id long, nbr long, score double"


def best(pairs: DataFrame, k: int) -> DataFrame:
    """The k rows of largest score of each node (ties: the smaller neighbour)."""
    place = F.row_number().over(Window.partitionBy("node_id").orderBy(F.desc("score"), "nbr"))
    return pairs.withColumn("_p", place).where(F.col("_p") <= k).drop("_p")


def unit_rows(table: pa.Table) -> np.ndarray:
    """The vectors of a table (node_id, vec) as rows of length one (zero stays zero)."""
    x = table.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(table.num_rows, -1)
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(size > V.TINY, size, np.inf)


def strongest(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each row's k largest scores above -inf (ties: the smaller id)."""
    k = min(k, score.shape[1])
    least = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
    row, col = np.nonzero((score >= least[:, None]) & (score > -np.inf))
    order = np.lexsort((ids[col], -score[row, col], row))
    row, col = row[order], col[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], col[keep]


def leaves(vectors: DataFrame, trees: int, size: int, sample: int = 4096) -> DataFrame:
    """node_id, tree, leaf, chunk of every node (node_id, vec): the leaf that splits at random directions lead to, of about `size`
    nodes, and a hashed chunk of it where it has more than twice as many (copies can't be split). Split points are medians of
    at most `sample` vectors, those of smallest hash; all nodes are dealt."""
    n = vectors.count()
    deep = max(0, int(np.ceil(np.log2(max(n, 1) / size))))
    trees = trees if deep else 1  # trees that don't split are all the same
    known = unit_rows(vectors.orderBy(F.xxhash64("node_id"), "node_id").limit(sample).select("node_id", "vec").toArrow())  # bounded by sample
    rng = np.random.default_rng(7)
    ways = rng.normal(size=(trees, max(deep, 1), known.shape[1] if len(known) else 1))
    splits = np.zeros((trees, max(deep, 1), 2 ** max(deep - 1, 0)))
    for t in range(trees if len(known) else 0):
        at, along = np.zeros(len(known), int), np.round(known @ ways[t].T, 6)
        for d in range(deep):
            for leaf in np.unique(at):
                splits[t, d, leaf] = np.median(along[at == leaf, d])
            at = 2 * at + (along[:, d] > splits[t, d, at])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if table.num_rows:
                x = unit_rows(table)
                for t in range(trees):
                    at, along = np.zeros(len(x), int), np.round(x @ ways[t].T, 6)
                    for d in range(deep):
                        at = 2 * at + (along[:, d] > splits[t, d, at])
                    yield pa.RecordBatch.from_arrays([batch.column("node_id"), pa.array(np.full(len(x), t, np.int32)), pa.array(at.astype(np.int64))], names=["node_id", "tree", "leaf"])

    dealt = cut(vectors.select("node_id", "vec").mapInArrow(deal, "node_id long, tree int, leaf long"))
    chunks = dealt.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / (2 * size)).alias("_n"))
    return dealt.join(chunks, ["tree", "leaf"]).select("node_id", "tree", "leaf", F.pmod(F.xxhash64("node_id", "tree"), F.col("_n")).cast("int").alias("chunk"))


def descend(vectors: DataFrame, k: int, width: int | None = None, rounds: int = 12, settle: float = 0.002, trees: int = 16, leaf: int = 4096) -> DataFrame:
    """node_id, nbr, score (cosine, six places), rank of the k nearest nodes of every node (node_id, vec), approximately.

    Lists of `width` start with the best of the nodes in the same leaf of one of several trees (`leaves`). In each round a node is host to the
    nodes of its list and to at most `width` nodes whose lists hold it (new entries first, then those of smallest hash, another
    hash each round). Two of them are compared if one entered in the round before, and sent on if that betters the list of either. A host keeps
    no more than its bounded group, so a node that stands in very many lists doesn't gather them; hosts of one leaf meet in
    one task, which gets each vector once. Rounds end when fewer than `settle` of all entries change."""
    width = width or max(24, 2 * k)
    vectors = stash(vectors.select("node_id", "vec"), "vectors")
    shape = pa.schema([("node_id", pa.int64()), ("nbr", pa.int64()), ("score", pa.float64())])

    def inside(table: pa.Table) -> pa.Table:
        ids, x, out = table.column("node_id").to_numpy(), unit_rows(table), []
        for at in range(0, len(ids), 256):
            score = np.round(x[at : at + 256] @ x.T, 6) + 0.0
            score[ids[at : at + 256, None] == ids] = -np.inf
            row, col = strongest(score, ids, width)
            out.append(pa.Table.from_arrays([pa.array(ids[at + row]), pa.array(ids[col]), pa.array(score[row, col])], schema=shape))
        return pa.concat_tables(out)

    def compare(members: pa.Table, known: pa.Table) -> pa.Table:
        ids, x, worst = known.column("known").to_numpy(), unit_rows(known), known.column("worst").to_numpy()
        order = np.argsort(ids)
        ids, x, worst = ids[order], x[order], worst[order]
        host, fresh = members.column("host").to_numpy(), members.column("fresh").to_numpy(zero_copy_only=False)
        place = np.searchsorted(ids, members.column("node_id").to_numpy())
        order = np.argsort(host, kind="stable")
        host, fresh, place = host[order], fresh[order], place[order]
        out = [shape.empty_table()]
        for at in np.split(np.arange(len(host)), np.flatnonzero(np.diff(host)) + 1):
            p, new = place[at], fresh[at]
            score = np.round(x[p] @ x[p].T, 6) + 0.0
            score[(p[:, None] == p) | ~(new[:, None] | new) | (score < worst[p][:, None])] = -np.inf
            row, col = strongest(score, ids[p], width)
            out.append(pa.Table.from_arrays([pa.array(ids[p[row]]), pa.array(ids[p[col]]), pa.array(score[row, col])], schema=shape))
        # A pair that several hosts have is sent once.
        return pa.concat_tables(out).group_by(["node_id", "nbr"]).aggregate([("score", "max")]).select(["node_id", "nbr", "score_max"]).rename_columns(shape.names)

    def taken(met: DataFrame, had: DataFrame | None) -> DataFrame:
        met = met.withColumn("fresh", F.lit(True))
        both = met if had is None else met.unionByName(had.withColumn("fresh", F.lit(False)))
        # Dealt by node once: repeats fall away and the best are taken where they lie.
        once = both.repartition("node_id").groupBy("node_id", "nbr").agg(F.max("score").alias("score"), F.min("fresh").alias("fresh"))
        return cut(best(once, width))

    places = cut(leaves(vectors, trees, leaf))
    lists = taken(places.join(vectors, "node_id").groupBy("tree", "leaf", "chunk").applyInArrow(inside, LIST), None)
    home = places.where("tree = 0").select(F.col("node_id").alias("host"), F.concat_ws(":", "leaf", "chunk").alias("at"))
    n = vectors.count()
    for turn in range(rounds):
        back = lists.select(F.col("nbr").alias("host"), "node_id", "fresh", F.xxhash64("node_id", "nbr", F.lit(turn)).alias("h"))
        back = back.withColumn("_p", F.row_number().over(Window.partitionBy("host").orderBy(F.desc("fresh"), "h", "node_id"))).where(F.col("_p") <= width).select("host", "node_id", "fresh")
        members = lists.select(F.col("node_id").alias("host"), F.col("nbr").alias("node_id"), "fresh").union(back).repartition("host").groupBy("host", "node_id").agg(F.max("fresh").alias("fresh"))
        members = members.withColumn("_any", F.max("fresh").over(Window.partitionBy("host"))).where("_any").drop("_any")
        members = cut(members.join(home, "host").select("at", "host", "node_id", "fresh"))
        worst = lists.groupBy("node_id").agg(F.when(F.count("*") == width, F.min("score")).otherwise(float("-inf")).alias("worst"))
        known = members.select("at", "node_id").distinct().join(vectors.join(worst, "node_id"), "node_id").select(F.col("at").alias("there"), F.col("node_id").alias("known"), "vec", "worst")  # other names, as both sides come from one table
        lists = taken(members.groupBy("at").cogroup(known.groupBy("there")).applyInArrow(compare, LIST), lists.drop("fresh"))
        if lists.where("fresh").count() <= settle * width * n:
            break
    place = F.row_number().over(Window.partitionBy("node_id").orderBy(F.desc("score"), "nbr"))
    return lists.drop("fresh").withColumn("rank", place).where(F.col("rank") <= k)


def undirected(lists: DataFrame) -> DataFrame:
    """a < b, score of each pair that stands in either node's list, once."""
    return lists.groupBy(F.least("node_id", "nbr").alias("a"), F.greatest("node_id", "nbr").alias("b")).agg(F.max("score").alias("score"))


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact lists' entries that found has."""
    hit = exact.join(found.select("node_id", "nbr", F.lit(1).alias("_f")), ["node_id", "nbr"], "left").agg(F.count("_f"), F.count("*")).first()
    return hit[0] / max(hit[1], 1)


def families(stored: DataFrame, structural: DataFrame, names: DataFrame) -> DataFrame:
    """family, a, b of pairs a < b: A as stored, STRUCT and NER from their sources, kNN what A has beyond STRUCT, B both
    sources, C what is stored or named."""
    named = lambda df, name: df.select(F.lit(name).alias("family"), "a", "b")
    pairs = lambda df: df.select("a", "b").distinct()
    a, s, e = pairs(stored), pairs(structural), pairs(names)
    out = named(a, "A").union(named(s, "STRUCT")).union(named(e, "NER")).union(named(a.join(s, ["a", "b"], "left_anti"), "kNN"))
    return out.union(named(s.union(e).distinct(), "B")).union(named(a.union(e).distinct(), "C"))


def manifest(pairs: DataFrame, nodes: DataFrame, fan: int = 1000) -> DataFrame:
    """family, edges, covered (nodes with an edge), coverage (of all nodes), digest. The digest is SHA-256 in levels: over the
    sorted b of each a, over a in ranges of `fan`, over ranges of ranges, so that no row gathers a family."""
    join = lambda c, key: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, c))), lambda x: x["d"]), ","), 256)
    low = pairs.groupBy("family", "a").agg(F.count("*").alias("n"), join(F.concat_ws(":", F.col("a").cast("string"), F.col("b").cast("string")).alias("d"), F.col("b").alias("k")).alias("d"))
    for level in (1, 2, 3):
        key = F.floor(F.col("a") / fan) if level < 3 else F.lit(0)
        low = low.groupBy("family", key.cast("long").alias("g")).agg(F.sum("n").alias("n"), join(F.col("d"), F.col("a").alias("k")).alias("d")).withColumnRenamed("g", "a")
    covered = pairs.select("family", "a").union(pairs.select("family", "b")).distinct().groupBy("family").agg(F.count("*").alias("covered"))
    total = nodes.agg(F.count("*").alias("nodes"))
    return low.join(covered, "family").crossJoin(F.broadcast(total)).select("family", F.col("n").alias("edges"), "covered", F.round(F.col("covered") / F.col("nodes"), 6).alias("coverage"), F.col("d").alias("digest"))  # total: one row
