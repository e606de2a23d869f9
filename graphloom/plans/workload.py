"""Canonical retrieval tables derived from the given tables.

Nodes are the rows of `embeddings`; queries are those whose id is divisible by 50, against all rows. The first half of the
dimensions ranks the dense list, the second half the sparse one, and gold nodes are nearest by mean absolute difference
over all dimensions. Edges of two families are derived from `customer` (typed) and `part` (weighted)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.vectors import TINY
from graphloom.sources.tables import parquet

DEPTH, GOLDS = 50, 5

#: The same tables in SQL, for checking.
SQL = """
nn AS (SELECT count(*) AS n FROM embeddings),
queries AS (SELECT vec_id AS query_id, CASE WHEN (vec_id // 50) % 5 < 3 THEN 'train' WHEN (vec_id // 50) % 5 = 3 THEN 'validation' ELSE 'test' END AS split FROM embeddings WHERE vec_id % 50 = 0),
pairs AS (SELECT q.vec_id AS query_id, e.vec_id AS node_id,
   round(list_dot_product(q.embedding[1:32]::DOUBLE[], e.embedding[1:32]::DOUBLE[]), 6) AS ds,
   round(list_dot_product(q.embedding[33:64]::DOUBLE[], e.embedding[33:64]::DOUBLE[]), 6) AS ss,
   round(list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda z: abs(z[1]::DOUBLE - z[2]::DOUBLE))) / 64, 6) AS ld
   FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0 AND q.vec_id <> e.vec_id),
ranked AS (SELECT * FROM (SELECT query_id, 'dense' AS source, node_id, row_number() OVER (PARTITION BY query_id ORDER BY ds DESC, node_id) AS rank, ds AS score FROM pairs
   UNION ALL SELECT query_id, 'sparse', node_id, row_number() OVER (PARTITION BY query_id ORDER BY ss DESC, node_id), ss FROM pairs) WHERE rank <= 50),
golds AS (SELECT query_id, node_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ld, node_id) AS r FROM pairs) WHERE r <= 5),
candidates AS (SELECT query_id, node_id, row_number() OVER (PARTITION BY query_id ORDER BY min(CASE source WHEN 'dense' THEN 0 ELSE 1000000 END + rank)) AS pos FROM ranked GROUP BY query_id, node_id),
seeds AS (SELECT query_id, node_id, row_number() OVER (PARTITION BY query_id ORDER BY min(CASE source WHEN 'dense' THEN 0 ELSE 1000000 END + rank)) AS seed_pos FROM ranked WHERE rank <= 5 GROUP BY query_id, node_id),
anchors AS (SELECT query_id, node_id FROM ranked WHERE source = 'dense' AND rank = 1),
rrf AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rn FROM (SELECT query_id, node_id, round(sum(0.5 / (60 + rank)), 9) AS score FROM ranked GROUP BY query_id, node_id)),
edges AS (SELECT 'structural' AS family, c_custkey % n AS src, (c_custkey * 7919 + c_nationkey * 104729) % n AS dst, (c_nationkey % 6)::INT AS rel, 1.0::DOUBLE AS weight, c_custkey AS edge_pos FROM customer, nn
   UNION ALL SELECT 'ner', p_partkey % n, (p_partkey * 31 + p_size * 1717) % n, -1, p_retailprice, p_partkey FROM part, nn),
structural AS (SELECT * FROM edges WHERE family = 'structural'),
local_edges AS (SELECT c1.query_id, e.src, e.dst, count(*) AS mult FROM candidates c1 JOIN structural e ON e.src = c1.node_id JOIN candidates c2 ON c2.query_id = c1.query_id AND c2.node_id = e.dst GROUP BY ALL),
und AS (SELECT DISTINCT family, least(src, dst) AS a, greatest(src, dst) AS b FROM edges WHERE src <> dst),
both_ways AS (SELECT family, a AS src, b AS dst FROM und UNION ALL SELECT family, b, a FROM und),
degree AS (SELECT vec_id AS node_id, coalesce(d, 0) AS deg FROM embeddings LEFT JOIN (SELECT src, count(*) AS d FROM both_ways WHERE family = 'structural' GROUP BY src) ON src = vec_id)
"""


#: name -> (measure, first dimension, dimension after the last, rows kept)
LISTS = {"dense": ("dot", 0, 32, DEPTH), "sparse": ("dot", 32, 64, DEPTH), "gold": ("l1", 0, 64, GOLDS)}


def best_rows(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and place (from 1) of each row's k largest scores; ties go to the smaller id."""
    k = min(k, score.shape[1])
    least = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
    row, col = np.nonzero((score >= least[:, None]) & (score > -np.inf))
    order = np.lexsort((ids[col], -score[row, col], row))
    row, col = row[order], col[order]
    place = np.arange(len(row)) - np.searchsorted(row, row) + 1
    keep = place <= k
    return row[keep], col[keep], place[keep]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows over their length; zero rows stay zero."""
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(size > TINY, size, np.inf)


def plain_scores(q: np.ndarray, x: np.ndarray, measure: str) -> np.ndarray:
    """Scores of all pairs, larger is better, six places."""
    score = -np.concatenate([[np.abs(x[b : b + 512] - one).mean(axis=1) for one in q] for b in range(0, len(x), 512)], axis=1) if measure == "l1" else q @ x.T
    return np.round(score, 6) + 0.0


def same_ids(qids: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column, by row, where a query meets itself."""
    order = np.argsort(qids, kind="stable")
    low, high = (np.searchsorted(qids[order], ids, side) for side in ("left", "right"))
    n = high - low
    row, col = order[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)], np.repeat(np.arange(len(ids)), n)
    by = np.argsort(row, kind="stable")
    return row[by], col[by]


def true_places(mask: np.ndarray) -> np.ndarray:
    """Places of the true values in the flat mask, of which few are true: looked for by eight."""
    flat = mask.ravel()
    if len(flat) % 8:
        return np.flatnonzero(flat)
    eights = np.flatnonzero(flat.view(np.uint64))
    row, col = np.nonzero(flat.reshape(-1, 8)[eights])
    return 8 * eights[row] + col


def closest(q: np.ndarray, x: np.ndarray, qids: np.ndarray, ids: np.ndarray, measure: str, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row, column and score of each query's k best rows of x, itself excluded, for some queries at a time.

    Scores of all pairs are taken in single precision, and only say which pairs may belong to a list: those that reach the k-th best
    of any rows less twice the bound of their error and one unit of the sixth place. These pairs alone are scored in double
    precision, rounded and ranked, so that the lists are those of plain_scores. Where the bound isn't finite all are scored so."""
    own_row, own_col = same_ids(qids, ids)
    size = (lambda m: np.abs(m).mean(axis=1)) if measure == "l1" else (lambda m: np.sqrt((m * m).sum(axis=1)))
    with np.errstate(over="ignore", invalid="ignore"):
        q32, x32 = q.astype(np.float32), x.astype(np.float32)
        by_column = np.ascontiguousarray(x32.T)
        most = size(x).max()
        error = (x.shape[1] + 8) * 2.0**-23 * (most + size(q) if measure == "l1" else most * size(q)) + 1e-30
        sure = np.isfinite(error).all() and np.isfinite(x32).all() and np.isfinite(q32).all() and (most + size(q).max()) ** 2 * x.shape[1] < 1e37
    slack = 2 * error + 2e-6
    some, wide, lead = 256, 4096, max(1024, 64 * k)

    def rough(b: np.ndarray, first: int, stop: int) -> np.ndarray:
        if measure != "l1":
            return b @ by_column[:, first:stop]
        out = np.empty((len(b), stop - first), np.float32)
        for at in range(0, len(b), 16):
            part = b[at : at + 16]
            total, one = np.zeros((len(part), stop - first), np.float32), np.empty((len(part), stop - first), np.float32)
            for d in range(x.shape[1]):
                np.subtract(by_column[d, first:stop], part[:, d, None], out=one)
                np.abs(one, out=one)
                total += one
            np.divide(total, -x.shape[1], out=out[at : at + 16])
        return out

    for at in range(0, len(q), some):
        mine = slice(*np.searchsorted(own_row, (at, at + some)))
        r, c, b = own_row[mine] - at, own_col[mine], q32[at : at + some]
        if not sure or len(x) <= 2 * k:
            score = plain_scores(q[at : at + some], x, measure)
            score[r, c] = -np.inf
            row, col, _ = best_rows(score, ids, k)
            yield at + row, col, score[row, col]
            continue
        least, rows, cols, scores = None, [], [], []
        for first in (0, *range(min(lead, len(x)), len(x), wide)):
            stop = min(len(x), first + wide if first else lead)
            score = rough(b, first, stop)
            own = (c >= first) & (c < stop)
            score[r[own], c[own] - first] = -np.inf
            if least is None:
                kth = min(k, score.shape[1])
                least = np.partition(score, score.shape[1] - kth, axis=1)[:, score.shape[1] - kth] - slack[at : at + some]
                least = np.where(np.isfinite(least), np.nextafter(least.astype(np.float32), np.float32(-np.inf)), -np.finfo(np.float32).max).astype(np.float32)
            flat = true_places(score >= least[:, None])
            rows.append(flat // (stop - first))
            cols.append(flat % (stop - first) + first)
            scores.append(score.ravel()[flat])
        row, col, score = (np.concatenate(v) for v in (rows, cols, scores))
        order = np.lexsort((-score, row))
        row, col, score = row[order], col[order], score[order]
        start = np.searchsorted(row, np.arange(len(b) + 1))
        last = np.minimum(start[:-1] + k, start[1:]) - 1
        keep = score >= (score[np.maximum(last, 0)] - slack[at : at + some])[row] if len(row) else np.zeros(0, bool)
        row, col = row[keep], col[keep]
        exact = np.empty(len(row))
        for s in range(0, len(row), 65_536):
            one, other = q[at + row[s : s + 65_536]], x[col[s : s + 65_536]]
            exact[s : s + 65_536] = -np.abs(other - one).mean(axis=1) if measure == "l1" else np.einsum("ij,ij->i", one, other)
        exact = np.round(exact, 6) + 0.0
        order = np.lexsort((ids[col], -exact, row))
        row, col, exact = row[order], col[order], exact[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < k
        yield at + row[keep], col[keep], exact[keep]


def nearest(queries: DataFrame, base: DataFrame, lists: dict[str, tuple[str, int, int, int]], group: int | None = None, query_group: int | None = None) -> DataFrame:
    """source, query_id, node_id, score, rank: for each list the best rows of base (node_id, vec) for each query (query_id,
    vec), itself excluded.

    Measures are "dot" and "cos" (larger is better; cos takes rows over their length, zero rows stay zero) and "l1" (mean
    absolute difference, smaller is better); scores are rounded to six
    places before ranking and ties go to the smaller id. Base rows are dealt into groups of about `group` rows and queries
    into groups of about query_group; each pair of groups meets in one task, under an integer key, for all lists at once,
    and keeps as many rows a query as the list is long. Without these there are up to sixteen groups of 16,384 to 40,000 rows
    and of 512 to 16,384 queries, so a task's work and memory are bounded, and few queries still make many tasks."""
    import pyarrow as pa

    asked, rows = queries.count(), base.count()
    query_group = query_group or min(16_384, max(512, -(-asked // 16)))
    group = group or min(40_000, max(16_384, -(-rows // 16)))
    down, across = max(1, -(-rows // group)), max(1, -(-asked // query_group))
    shape = pa.schema([("source", pa.string()), ("query_id", pa.int64()), ("node_id", pa.int64()), ("score", pa.float64())])

    def matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
        return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            ids, qids = left.column("node_id").to_numpy(), right.column("query_id").to_numpy()
            x, q = matrix(left.column("vec"), len(ids)), matrix(right.column("asked"), len(qids))
            for name, (measure, first, stop, k) in lists.items():
                qs, xs = (np.ascontiguousarray(m[:, first:stop]) for m in (q, x))
                if measure == "cos":
                    qs, xs = unit(qs), unit(xs)
                for row, col, score in closest(qs, xs, qids, ids, measure, k):
                    value = np.abs(score) if measure == "l1" else score
                    out.append(pa.Table.from_arrays([pa.array([name] * len(row), pa.string()), pa.array(qids[row]), pa.array(ids[col]), pa.array(value)], schema=shape))
        return pa.concat_tables(out) if out else shape.empty_table()

    grouped = lambda df, key, n, other, m: df.select("*", F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias("_a"), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("_b")).select(*df.columns, F.when(F.lit(other), F.col("_b")).otherwise(F.col("_a")).alias("_g"), F.when(F.lit(other), F.col("_a")).otherwise(F.col("_b")).alias("_h"))
    b = grouped(base.select("node_id", "vec"), "node_id", down, False, across)
    # Another name, as both sides may come from one table.
    q = grouped(queries.select("query_id", F.col("vec").alias("asked")), "query_id", across, True, down)
    # As many partitions as pairs, which adaptive execution then leaves apart: rows are few, the work on them is not.
    b, q = (df.repartition(2 * down * across, "_g", "_h") for df in (b, q))
    found = b.groupBy("_g", "_h").cogroup(q.groupBy("_g", "_h")).applyInArrow(meet, "source string, query_id long, node_id long, score double")
    better = F.when(F.col("source").isin(*[n for n, v in lists.items() if v[0] != "l1"]), -F.col("score")).otherwise(F.col("score"))
    depth = F.element_at(F.create_map(*[F.lit(x) for n, v in lists.items() for x in (n, v[3])]), F.col("source"))
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("source", "query_id").orderBy(better, "node_id"))).where(F.col("rank") <= depth)


class Workload:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return parquet(self.spark, self.dir, name)

    @cached_property
    def vectors(self) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").alias("node_id"), F.col("embedding").alias("vec"), "label")

    @cached_property
    def queries(self) -> DataFrame:
        turn = (F.floor(F.col("node_id") / 50) % 5).cast("int")
        split = F.when(turn < 3, "train").when(turn == 3, "validation").otherwise("test")
        return self.vectors.where("node_id % 50 = 0").select(F.col("node_id").alias("query_id"), split.alias("split"), "vec")

    @cached_property
    def lists(self) -> DataFrame:
        return nearest(self.queries.select("query_id", "vec"), self.vectors.select("node_id", "vec"), LISTS).cache()

    @cached_property
    def ranked(self) -> DataFrame:
        return self.lists.where("source in ('dense', 'sparse')").select("query_id", "source", "node_id", "rank", "score")

    @cached_property
    def golds(self) -> DataFrame:
        return self.lists.where("source = 'gold'").select("query_id", "node_id")

    @cached_property
    def candidates(self) -> DataFrame:
        from graphloom.operators.fusion import stable_union

        return stable_union(self.ranked).cache()

    @cached_property
    def seeds(self) -> DataFrame:
        from graphloom.operators.fusion import seeds

        return seeds(self.ranked).cache()

    @cached_property
    def rrf(self) -> DataFrame:
        from graphloom.operators.fusion import rrf

        return rrf(self.ranked, {"dense": 0.5, "sparse": 0.5})

    @cached_property
    def edges(self) -> DataFrame:
        n = self.table("embeddings").agg(F.count("*").alias("n"))
        c = self.table("customer").crossJoin(F.broadcast(n)).select(
            F.lit("structural").alias("family"), (F.col("c_custkey") % F.col("n")).alias("src"), ((F.col("c_custkey") * 7919 + F.col("c_nationkey") * 104729) % F.col("n")).alias("dst"),
            (F.col("c_nationkey") % 6).cast("int").alias("rel"), F.lit(1.0).alias("weight"), F.col("c_custkey").alias("edge_pos"),
        )
        p = self.table("part").crossJoin(F.broadcast(n)).select(
            F.lit("ner").alias("family"), (F.col("p_partkey") % F.col("n")).alias("src"), ((F.col("p_partkey") * 31 + F.col("p_size") * 1717) % F.col("n")).alias("dst"),
            F.lit(-1).alias("rel"), F.col("p_retailprice").alias("weight"), F.col("p_partkey").alias("edge_pos"),
        )
        return c.unionByName(p)

    @cached_property
    def structural(self) -> DataFrame:
        return self.edges.where("family = 'structural'")

    @cached_property
    def local_edges(self) -> DataFrame:
        from graphloom.operators.graph import induce_subgraph

        return induce_subgraph(self.candidates, self.structural).cache()
