"""Registered queries of the engine, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.functions import vectors as V
from graphloom.operators import fusion, graph, metrics, stats
from graphloom.operators.order import numbered
from graphloom.plans.workload import SQL, Workload

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: The queries as functions of a workload: one that builds on another shares its lists and pools.
BODIES: dict[str, Callable[[Workload], DataFrame]] = {}


def query(name: str, sql: str | None = None, more: str = ""):
    """Registers f(workload) as `name`; sql is the final SELECT after the workload's common tables (and `more`)."""

    def put(f: Callable[[Workload], DataFrame]):
        BODIES[name] = f
        QUERIES[name] = lambda spark, sf_dir: f(Workload(spark, sf_dir))
        if sql:
            ORACLES[name] = f"WITH RECURSIVE {SQL}{', ' + more if more else ''} {sql}"
        return f

    return put


# Fusion and pools


@query("rrf_weighted", """SELECT query_id, w, node_id, score, row_number() OVER (PARTITION BY query_id, w ORDER BY score DESC, node_id) AS rn FROM (
  SELECT query_id, w, node_id, round(sum(CASE source WHEN 'dense' THEN w ELSE 1 - w END / (60 + rank)), 9) AS score FROM ranked, (VALUES (0.0::DOUBLE), (0.25), (0.5), (0.75), (1.0)) t(w) GROUP BY ALL)""")
def _(w: Workload) -> DataFrame:
    return fusion.rrf_weights(w.ranked, [0.0, 0.25, 0.5, 0.75, 1.0])


@query("rrf_equal", "SELECT query_id, node_id, score, rn FROM rrf")
def _(w: Workload) -> DataFrame:
    return w.rrf


@query("rrf_equal_pair", """SELECT query_id, node_id, round(0.5 / (60 + r1) + 0.5 / (60 + r2), 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(0.5 / (60 + r1) + 0.5 / (60 + r2), 9) DESC, node_id) AS rn FROM (
  SELECT query_id, node_id, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS r1, row_number() OVER (PARTITION BY query_id ORDER BY node_id) AS r2 FROM candidates)""")
def _(w: Workload) -> DataFrame:
    """Two rankings of the same candidates: pool order and id order."""
    c = w.candidates
    r1 = c.select("query_id", F.lit("dense").alias("source"), "node_id", F.row_number().over(fusion.by_query("pos")).alias("rank"))
    r2 = c.select("query_id", F.lit("sparse").alias("source"), "node_id", F.row_number().over(fusion.by_query("node_id")).alias("rank"))
    return fusion.rrf(r1.unionByName(r2), {"dense": 0.5, "sparse": 0.5})


@query("rrf_selected", """SELECT query_id, node_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rn FROM (
  SELECT query_id, node_id, round(sum(CASE source WHEN 'dense' THEN 0.75 ELSE 0.25 END / (60 + rank)), 9) AS score FROM ranked SEMI JOIN candidates USING (query_id, node_id) GROUP BY ALL)""")
def _(w: Workload) -> DataFrame:
    return fusion.rrf(w.ranked.join(w.candidates.select("query_id", "node_id"), ["query_id", "node_id"], "left_semi"), {"dense": 0.75, "sparse": 0.25})


@query("rrf_multi", """SELECT query_id, node_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rn FROM (
  SELECT query_id, node_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT query_id, node_id, rank FROM ranked UNION ALL SELECT query_id, node_id, seed_pos FROM seeds) GROUP BY ALL)""")
def _(w: Workload) -> DataFrame:
    """Three partial sources: both lists and the seed order."""
    third = w.seeds.select("query_id", F.lit("seed").alias("source"), "node_id", F.col("seed_pos").alias("rank"))
    return fusion.rrf(w.ranked.drop("score").unionByName(third), {"dense": 1.0, "sparse": 1.0, "seed": 1.0})


@query("stable_union", "SELECT query_id, node_id, pos FROM candidates")
def _(w: Workload) -> DataFrame:
    return w.candidates


@query("sorted_union", "SELECT query_id, node_id, row_number() OVER (PARTITION BY query_id ORDER BY node_id) AS pos FROM (SELECT DISTINCT query_id, node_id FROM ranked)")
def _(w: Workload) -> DataFrame:
    return w.ranked.select("query_id", "node_id").distinct().withColumn("pos", F.row_number().over(fusion.by_query("node_id")))


@query("intersect_lists", "SELECT query_id, node_id FROM ranked WHERE source = 'dense' INTERSECT SELECT query_id, node_id FROM ranked WHERE source = 'sparse'")
def _(w: Workload) -> DataFrame:
    a, b = (w.ranked.where(F.col("source") == s).select("query_id", "node_id") for s in ("dense", "sparse"))
    return a.intersect(b)


@query("except_lists", "SELECT query_id, node_id FROM ranked WHERE source = 'dense' EXCEPT SELECT query_id, node_id FROM ranked WHERE source = 'sparse'")
def _(w: Workload) -> DataFrame:
    a, b = (w.ranked.where(F.col("source") == s).select("query_id", "node_id") for s in ("dense", "sparse"))
    return a.subtract(b)


@query("round_robin_pool", "SELECT query_id, node_id, row_number() OVER (PARTITION BY query_id ORDER BY min(rank * 100 + CASE source WHEN 'dense' THEN 0 ELSE 1 END)) AS pos FROM ranked GROUP BY query_id, node_id")
def _(w: Workload) -> DataFrame:
    return fusion.round_robin(w.ranked)


@query("budget_pool", "SELECT query_id, node_id, rn AS pos FROM rrf WHERE rn <= 30")
def _(w: Workload) -> DataFrame:
    return fusion.budget_pool(w.rrf, 30)


@query("seeds", "SELECT query_id, node_id, seed_pos FROM seeds")
def _(w: Workload) -> DataFrame:
    return w.seeds


@query("anchor", "SELECT query_id, node_id FROM anchors")
def _(w: Workload) -> DataFrame:
    return fusion.anchor(w.ranked)


EXPAND = """hop AS (SELECT DISTINCT s.query_id, e.src, e.dst FROM seeds s JOIN structural e ON e.src = s.node_id WHERE e.src <> e.dst),
fresh AS (SELECT query_id, src, dst FROM (SELECT *, row_number() OVER (PARTITION BY query_id, src ORDER BY dst) AS k FROM hop) h WHERE k <= 4096 AND NOT EXISTS (SELECT 1 FROM candidates c WHERE c.query_id = h.query_id AND c.node_id = h.dst)),
expansion AS (SELECT query_id, node_id, pos FROM (SELECT query_id, dst AS node_id, row_number() OVER (PARTITION BY query_id ORDER BY dst) AS pos FROM (SELECT DISTINCT query_id, dst FROM (SELECT *, row_number() OVER (PARTITION BY query_id, src ORDER BY dst) AS m FROM fresh) WHERE m <= 16)) WHERE pos <= 128)"""


def expansion(w: Workload) -> DataFrame:
    return graph.expand_structural(w.candidates, w.seeds, w.structural)


@query("expand_structural", "SELECT query_id, node_id, pos FROM expansion", EXPAND)
def _(w: Workload) -> DataFrame:
    return expansion(w)


@query("additive_pool", "SELECT query_id, node_id, pos FROM candidates UNION ALL SELECT query_id, node_id, m + row_number() OVER (PARTITION BY query_id ORDER BY pos) FROM expansion JOIN (SELECT query_id, max(pos) AS m FROM candidates GROUP BY query_id) USING (query_id)", EXPAND)
def _(w: Workload) -> DataFrame:
    return fusion.additive_pool(w.candidates, expansion(w))


@query("matched_budget", """SELECT query_id, node_id, CASE WHEN from_end <= coalesce(taken, 0) THEN 'evicted' ELSE 'kept' END AS status FROM candidates LEFT JOIN free USING (query_id, node_id) LEFT JOIN taken USING (query_id)
  UNION ALL SELECT query_id, node_id, status FROM entering""", EXPAND + """,
free AS (SELECT query_id, node_id, row_number() OVER (PARTITION BY query_id ORDER BY pos DESC) AS from_end FROM candidates ANTI JOIN seeds USING (query_id, node_id)),
entering AS (SELECT query_id, node_id, CASE WHEN pos <= coalesce(room, 0) THEN 'admitted' ELSE 'refused' END AS status FROM expansion LEFT JOIN (SELECT query_id, count(*) AS room FROM free GROUP BY query_id) USING (query_id)),
taken AS (SELECT query_id, count(*) AS taken FROM entering WHERE status = 'admitted' GROUP BY query_id)""")
def _(w: Workload) -> DataFrame:
    return fusion.matched_budget(w.candidates, expansion(w), w.seeds)


# Edges and families


@query("canonical_edges", "SELECT family, a, b FROM und")
def _(w: Workload) -> DataFrame:
    return w.edges.where("src <> dst").select("family", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


@query("bidirect_edges", "SELECT src, dst FROM both_ways WHERE family = 'structural'")
def _(w: Workload) -> DataFrame:
    return graph.both_ways(graph.canonical_edges(w.structural))


@query("coalesce_edges", "SELECT src, dst, arg_min(rel, edge_pos) AS rel FROM structural GROUP BY src, dst")
def _(w: Workload) -> DataFrame:
    return graph.coalesce_edges(w.structural)


@query("family_order", """SELECT family, node, nbr, weight, row_number() OVER (PARTITION BY family, node ORDER BY weight DESC, nbr) AS rank FROM (
  SELECT family, node, nbr, max(weight) AS weight FROM (SELECT family, src AS node, dst AS nbr, weight FROM edges WHERE src <> dst UNION ALL SELECT family, dst, src, weight FROM edges WHERE src <> dst) GROUP BY ALL)""")
def _(w: Workload) -> DataFrame:
    return graph.family_order(w.edges)


@query("capped_neighbours", """SELECT family, node, nbr FROM (SELECT family, node, nbr, row_number() OVER (PARTITION BY family, node ORDER BY max(weight) DESC, nbr) AS r FROM (
  SELECT family, src AS node, dst AS nbr, weight FROM edges WHERE src <> dst UNION ALL SELECT family, dst, src, weight FROM edges WHERE src <> dst) GROUP BY family, node, nbr) WHERE r <= 4""")
def _(w: Workload) -> DataFrame:
    return graph.family_order(w.edges).where("rank <= 4").select("family", "node", "nbr")


@query("edge_families", """SELECT family, a, b FROM und UNION ALL SELECT 'B', a, b FROM (SELECT a, b FROM und WHERE family = 'structural' UNION SELECT a, b FROM und WHERE family = 'ner')
  UNION ALL SELECT 'both', a, b FROM (SELECT a, b FROM und WHERE family = 'structural' INTERSECT SELECT a, b FROM und WHERE family = 'ner')
  UNION ALL SELECT 'only_structural', a, b FROM (SELECT a, b FROM und WHERE family = 'structural' EXCEPT SELECT a, b FROM und WHERE family = 'ner')""")
def _(w: Workload) -> DataFrame:
    s, n = (graph.canonical_edges(w.edges.where(F.col("family") == f)) for f in ("structural", "ner"))
    named = lambda df, name: df.select(F.lit(name).alias("family"), "a", "b")
    return named(s, "structural").union(named(n, "ner")).union(named(s.union(n).distinct(), "B")).union(named(s.intersect(n), "both")).union(named(s.subtract(n), "only_structural"))


@query("degree_damp", "SELECT family, src, dst, edge_pos FROM edges WHERE NOT (family = 'ner' AND dst IN (SELECT dst FROM edges WHERE family = 'ner' GROUP BY dst HAVING count(*) > 4))")
def _(w: Workload) -> DataFrame:
    return graph.degree_damp(w.edges, "ner", 4).select("family", "src", "dst", "edge_pos")


@query("filter_edge_types", "SELECT src, dst, rel FROM structural WHERE rel NOT IN (0, 3)")
def _(w: Workload) -> DataFrame:
    return w.structural.where(~F.col("rel").isin(0, 3)).select("src", "dst", "rel")


@query("transition", "SELECT src, dst, round(w / sum(w) OVER (PARTITION BY src), 9) AS p FROM (SELECT src, dst, sum(weight) AS w FROM edges GROUP BY src, dst)")
def _(w: Workload) -> DataFrame:
    m = w.edges.groupBy("src", "dst").agg(F.sum("weight").alias("w"))
    return m.select("src", "dst", F.round(F.col("w") / F.sum("w").over(Window.partitionBy("src")), 9).alias("p"))


@query("family_matrix", "SELECT a, b, round(sum(weight), 6) AS weight FROM (SELECT least(src, dst) AS a, greatest(src, dst) AS b, weight FROM edges WHERE src <> dst) GROUP BY a, b")
def _(w: Workload) -> DataFrame:
    return w.edges.where("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.round(F.sum("weight"), 6).alias("weight"))


# Joins with the pool


@query("induce_subgraph", "SELECT query_id, src, dst, mult FROM local_edges")
def _(w: Workload) -> DataFrame:
    return w.local_edges


@query("retention", """SELECT query_id, node_id, coalesce(o, 0) AS out_degree, coalesce(k, 0)::BIGINT AS kept FROM candidates LEFT JOIN (SELECT src AS node_id, count(*) AS o FROM structural GROUP BY src) USING (node_id)
  LEFT JOIN (SELECT query_id, src AS node_id, sum(mult) AS k FROM local_edges GROUP BY ALL) USING (query_id, node_id)""")
def _(w: Workload) -> DataFrame:
    return graph.retention(w.candidates, w.structural, w.local_edges)


@query("weighted_pool_edges", """SELECT query_id, node, nbr, weight FROM (SELECT c1.query_id, node, nbr, weight, row_number() OVER (PARTITION BY c1.query_id, node ORDER BY weight DESC, nbr) AS r FROM (
  SELECT node, nbr, max(weight) AS weight FROM (SELECT src AS node, dst AS nbr, weight FROM edges WHERE family = 'ner' AND src <> dst UNION ALL SELECT dst, src, weight FROM edges WHERE family = 'ner' AND src <> dst) GROUP BY ALL) f
  JOIN candidates c1 ON c1.node_id = node JOIN candidates c2 ON c2.node_id = nbr AND c2.query_id = c1.query_id) WHERE r <= 64""")
def _(w: Workload) -> DataFrame:
    adjacency = graph.family_order(w.edges.where("family = 'ner'")).select("node", "nbr", "weight")
    c1, c2 = w.candidates.select("query_id", F.col("node_id").alias("node")), w.candidates.select("query_id", F.col("node_id").alias("nbr"))
    inside = adjacency.join(c1, "node").join(c2, ["query_id", "nbr"])
    return inside.withColumn("_r", F.row_number().over(Window.partitionBy("query_id", "node").orderBy(F.desc("weight"), "nbr"))).where("_r <= 64").select("query_id", "node", "nbr", "weight")


@query("typed_pool_edges", """SELECT query_id, node, nbr, rels FROM (SELECT c1.query_id, node, nbr, array_to_string(list_sort(list(DISTINCT rel)), ',') AS rels, dense_rank() OVER (PARTITION BY c1.query_id, node ORDER BY nbr) AS r
  FROM (SELECT src AS node, dst AS nbr, rel FROM structural UNION ALL SELECT dst, src, rel FROM structural) JOIN candidates c1 ON c1.node_id = node JOIN candidates c2 ON c2.node_id = nbr AND c2.query_id = c1.query_id
  WHERE node <> nbr GROUP BY c1.query_id, node, nbr) WHERE r <= 64""")
def _(w: Workload) -> DataFrame:
    typed = w.structural.select(F.col("src").alias("node"), F.col("dst").alias("nbr"), "rel").union(w.structural.select("dst", "src", "rel")).where("node <> nbr")
    c1, c2 = w.candidates.select("query_id", F.col("node_id").alias("node")), w.candidates.select("query_id", F.col("node_id").alias("nbr"))
    pairs = typed.join(c1, "node").join(c2, ["query_id", "nbr"]).groupBy("query_id", "node", "nbr").agg(F.array_join(F.transform(F.sort_array(F.collect_set("rel")), lambda x: x.cast("string")), ",").alias("rels"))
    return pairs.withColumn("_r", F.dense_rank().over(Window.partitionBy("query_id", "node").orderBy("nbr"))).where("_r <= 64").drop("_r")


@query("gold_in_pool", "SELECT query_id, count(*) AS golds, count(c.node_id) AS present FROM golds LEFT JOIN candidates c USING (query_id, node_id) GROUP BY query_id")
def _(w: Workload) -> DataFrame:
    return metrics.hits(w.rrf, w.golds, w.candidates).select("query_id", F.col("g").alias("golds"), F.col("a").alias("present"))


@query("missing_gold", "SELECT query_id, node_id FROM golds ANTI JOIN candidates USING (query_id, node_id)")
def _(w: Workload) -> DataFrame:
    return w.golds.join(w.candidates.select("query_id", "node_id"), ["query_id", "node_id"], "left_anti")


@query("positive_index", "SELECT query_id, node_id, pos FROM golds JOIN candidates USING (query_id, node_id)")
def _(w: Workload) -> DataFrame:
    return w.golds.join(w.candidates, ["query_id", "node_id"])


@query("ranks_in_list", "SELECT query_id, node_id, coalesce(r.rank, 0) AS rank, r.rank IS NOT NULL AS in_list, r.score FROM candidates LEFT JOIN (SELECT * FROM ranked WHERE source = 'dense') r USING (query_id, node_id)")
def _(w: Workload) -> DataFrame:
    dense = w.ranked.where("source = 'dense'").select("query_id", "node_id", F.col("rank").alias("_r"), "score")
    return w.candidates.join(dense, ["query_id", "node_id"], "left").select("query_id", "node_id", F.coalesce("_r", F.lit(0)).alias("rank"), F.col("_r").isNotNull().alias("in_list"), "score")


@query("knn_join", "SELECT vec_id AS query_id, node_id, s AS score, rank FROM (SELECT q.vec_id, e.vec_id AS node_id, round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS s, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) DESC, e.vec_id) AS rank FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0 AND q.vec_id <> e.vec_id) WHERE rank <= 5")
def _(w: Workload) -> DataFrame:
    from graphloom.plans.workload import nearest

    return nearest(w.queries, w.vectors, {"all": ("dot", 0, 64, 5)}).select("query_id", "node_id", "score", "rank")


@query("cosine_rows", "SELECT query_id, node_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) + 0.0 AS cos, round(sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])), 6) AS norm FROM candidates JOIN embeddings q ON q.vec_id = query_id JOIN embeddings e ON e.vec_id = node_id")
def _(w: Workload) -> DataFrame:
    j = w.candidates.join(w.queries.select("query_id", F.col("vec").alias("q")), "query_id").join(w.vectors.select("node_id", "vec"), "node_id")
    return j.select("query_id", "node_id", (F.round(V.cosine("q", "vec"), 6) + 0.0).alias("cos"), F.round(V.norm("vec"), 6).alias("norm"))


@query("map_passages", "SELECT item_id, count(DISTINCT line) AS lines, count(DISTINCT line) FILTER (doc_id IS NOT NULL) AS found, coalesce(min(doc_id), -1) AS doc_id, count(DISTINCT doc_id) AS documents FROM (SELECT DISTINCT item_id, trim(unnest(string_split(text, chr(10))), ' ') AS line FROM benchmark) b LEFT JOIN (SELECT DISTINCT doc_id, trim(unnest(string_split(text, chr(10))), ' ') AS line FROM documents) d USING (line) WHERE line <> '' GROUP BY item_id")
def _(w: Workload) -> DataFrame:
    """Every benchmark item: its distinct lines, how many of them stand as a line of a document, the smallest such document
    (-1: none) and how many there are."""
    each = lambda t, key: w.table(t).select(key, F.explode(F.split("text", "\n")).alias("line")).select(key, F.trim("line").alias("line")).where("line <> ''").distinct()
    j = each("benchmark", "item_id").join(each("documents", "doc_id"), "line", "left")
    by_line = j.groupBy("item_id", "line").agg(F.min("doc_id").alias("doc_id"))
    documents = j.where("doc_id is not null").select("item_id", "doc_id").distinct().groupBy("item_id").agg(F.count("*").alias("documents"))
    lines = by_line.groupBy("item_id").agg(F.count("*").alias("lines"), F.count("doc_id").alias("found"), F.coalesce(F.min("doc_id"), F.lit(-1)).alias("doc_id"))
    return lines.join(documents, "item_id", "left").select("item_id", "lines", "found", "doc_id", F.coalesce("documents", F.lit(0)).alias("documents"))


@query("map_passages_whole", r"SELECT item_id, min(doc_id) AS doc_id, count(DISTINCT doc_id) AS copies FROM (SELECT doc_id, regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g') AS bare, trim(unnest(string_split(text, chr(10))), ' ') AS line FROM documents) d JOIN (SELECT item_id, trim(string_split(text, chr(10))[1], ' ') AS line, regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g') AS whole FROM benchmark) b USING (line) WHERE line <> '' AND contains(bare, whole) GROUP BY item_id")
def _(w: Workload) -> DataFrame:
    """As map_passages, but the whole item without white space must stand in the document without white space; the first
    line only is the join key. Texts are joined again to the pairs that it leaves."""
    bare = F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")
    docs, items = w.table("documents"), w.table("benchmark")
    lines = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", F.trim("line").alias("line")).distinct()
    keys = items.select("item_id", bare.alias("whole"), F.trim(F.get(F.split("text", "\n"), F.lit(0))).alias("line")).where("line <> ''")
    pairs = lines.join(keys, "line").select("doc_id", "item_id", "line", "whole")
    texts = docs.select("doc_id", bare.alias("bare"), F.transform(F.split("text", "\n"), lambda x: F.trim(x)).alias("lines"))
    both = pairs.join(texts, "doc_id").where(F.contains("bare", "whole") & F.expr("array_contains(lines, line)"))
    return both.select("item_id", "doc_id").distinct().groupBy("item_id").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


# Traversal

BFS = """hop0 AS (SELECT DISTINCT query_id, node_id FROM seeds),
hop1 AS (SELECT DISTINCT query_id, dst AS node_id FROM hop0 JOIN structural ON src = node_id EXCEPT SELECT * FROM hop0),
hop2 AS (SELECT DISTINCT query_id, dst AS node_id FROM hop1 JOIN structural ON src = node_id EXCEPT (SELECT * FROM hop0 UNION SELECT * FROM hop1)),
hop3 AS (SELECT DISTINCT query_id, dst AS node_id FROM hop2 JOIN structural ON src = node_id EXCEPT (SELECT * FROM hop0 UNION SELECT * FROM hop1 UNION SELECT * FROM hop2)),
reach AS (SELECT *, 0 AS hop FROM hop0 UNION ALL SELECT *, 1 FROM hop1 UNION ALL SELECT *, 2 FROM hop2 UNION ALL SELECT *, 3 FROM hop3)"""


def reach(w: Workload, hops: int = 3) -> DataFrame:
    return graph.bfs(w.seeds, w.structural.select("src", "dst"), hops)


@query("bfs_hops", "SELECT query_id, node_id, hop FROM reach", BFS)
def _(w: Workload) -> DataFrame:
    return reach(w)


@query("k_hop_nbhd", "SELECT query_id, count(*) AS nodes FROM reach WHERE hop <= 2 GROUP BY query_id", BFS)
def _(w: Workload) -> DataFrame:
    return reach(w, 2).groupBy("query_id").agg(F.count("*").alias("nodes"))


@query("hops_ledger", "SELECT query_id, node_id, hop FROM golds JOIN reach USING (query_id, node_id)", BFS)
def _(w: Workload) -> DataFrame:
    return reach(w).join(w.golds, ["query_id", "node_id"])


@query("missing_gold_reach", "SELECT coalesce(hop, -1) AS hop, count(*) AS golds FROM (SELECT * FROM golds ANTI JOIN candidates USING (query_id, node_id)) LEFT JOIN reach USING (query_id, node_id) GROUP BY 1", BFS)
def _(w: Workload) -> DataFrame:
    missing = w.golds.join(w.candidates.select("query_id", "node_id"), ["query_id", "node_id"], "left_anti")
    return missing.join(reach(w), ["query_id", "node_id"], "left").groupBy(F.coalesce("hop", F.lit(-1)).alias("hop")).agg(F.count("*").alias("golds"))


@query("seed_h1", "SELECT query_id, node_id FROM candidates UNION SELECT query_id, dst FROM seeds JOIN structural ON src = node_id")
def _(w: Workload) -> DataFrame:
    return w.candidates.select("query_id", "node_id").union(graph.step(w.seeds, w.structural.select("src", "dst"))).distinct()


@query("seed_h2", "SELECT query_id, node_id FROM candidates UNION SELECT query_id, node_id FROM reach WHERE hop <= 2", BFS)
def _(w: Workload) -> DataFrame:
    return w.candidates.select("query_id", "node_id").union(reach(w, 2).select("query_id", "node_id")).distinct()


@query("target_h1", "SELECT query_id, node_id FROM candidates UNION SELECT query_id, src FROM candidates JOIN structural ON dst = node_id")
def _(w: Workload) -> DataFrame:
    back = w.structural.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return w.candidates.select("query_id", "node_id").union(graph.step(w.candidates, back)).distinct()


@query("path_h2", "SELECT query_id, node_id FROM candidates UNION SELECT s.query_id, e.dst FROM seeds s JOIN structural e ON e.src = s.node_id JOIN structural f ON f.src = e.dst JOIN candidates c ON c.query_id = s.query_id AND c.node_id = f.dst WHERE s.node_id <> c.node_id")
def _(w: Workload) -> DataFrame:
    e = w.structural.select("src", "dst").distinct()
    first = w.seeds.select("query_id", F.col("node_id").alias("src")).join(e, "src").select("query_id", F.col("src").alias("s"), F.col("dst").alias("v"))
    back = e.join(w.candidates.select("query_id", F.col("node_id").alias("dst")), "dst").select("query_id", F.col("src").alias("v"), F.col("dst").alias("c"))
    return w.candidates.select("query_id", "node_id").union(first.join(back, ["query_id", "v"]).where("s <> c").select("query_id", "v")).distinct()


@query("bridge_h2", "SELECT query_id, node_id FROM candidates UNION SELECT a.query_id, e.dst FROM candidates a JOIN structural e ON e.src = a.node_id JOIN structural f ON f.src = e.dst JOIN candidates c ON c.query_id = a.query_id AND c.node_id = f.dst WHERE a.node_id <> c.node_id")
def _(w: Workload) -> DataFrame:
    e = w.structural.select("src", "dst").distinct()
    first = w.candidates.select("query_id", F.col("node_id").alias("src")).join(e, "src").select("query_id", F.col("src").alias("a"), F.col("dst").alias("v"))
    back = e.join(w.candidates.select("query_id", F.col("node_id").alias("dst")), "dst").select("query_id", F.col("src").alias("v"), F.col("dst").alias("c"))
    return w.candidates.select("query_id", "node_id").union(first.join(back, ["query_id", "v"]).where("a <> c").select("query_id", "v")).distinct()


@query("walk_counts", """SELECT query_id, dst AS node_id, 1 AS length, sum(mult)::BIGINT AS walks FROM seeds JOIN local_edges l USING (query_id) WHERE src = node_id GROUP BY query_id, dst
  UNION ALL SELECT a.query_id, b.dst, 2, sum(a.mult * b.mult)::BIGINT FROM seeds s JOIN local_edges a ON a.query_id = s.query_id AND a.src = s.node_id JOIN local_edges b ON b.query_id = a.query_id AND b.src = a.dst GROUP BY a.query_id, b.dst
  UNION ALL SELECT a.query_id, c.dst, 3, sum(a.mult * b.mult * c.mult)::BIGINT FROM seeds s JOIN local_edges a ON a.query_id = s.query_id AND a.src = s.node_id JOIN local_edges b ON b.query_id = a.query_id AND b.src = a.dst JOIN local_edges c ON c.query_id = a.query_id AND c.src = b.dst GROUP BY a.query_id, c.dst""")
def _(w: Workload) -> DataFrame:
    return graph.walk_counts(w.seeds, w.local_edges, 3)


@query("components", """SELECT query_id, node_id, least(node_id, min(coalesce(other, node_id))) AS component FROM candidates LEFT JOIN (
  WITH RECURSIVE r(query_id, node_id, other) AS (SELECT query_id, src, dst FROM l2 UNION SELECT r.query_id, r.node_id, l2.dst FROM r JOIN l2 ON l2.query_id = r.query_id AND l2.src = r.other) SELECT * FROM r) USING (query_id, node_id) GROUP BY query_id, node_id""",
  "l2 AS (SELECT query_id, src, dst FROM local_edges UNION SELECT query_id, dst, src FROM local_edges)")
def _(w: Workload) -> DataFrame:
    return graph.components(w.candidates, w.local_edges)


def _ppr_sql() -> str:
    parts = ["outd AS (SELECT query_id, src, sum(mult) AS o FROM local_edges GROUP BY ALL)", "r0 AS (SELECT query_id, node_id, CASE WHEN s.node_id IS NULL THEN 0.0 ELSE 1.0 / n END::DOUBLE AS r, (o IS NULL) AS dangling FROM candidates c LEFT JOIN seeds s USING (query_id, node_id) JOIN (SELECT query_id, count(*) AS n FROM seeds GROUP BY query_id) USING (query_id) LEFT JOIN outd ON outd.query_id = c.query_id AND outd.src = c.node_id)", "x0 AS (SELECT *, r AS x FROM r0)"]
    for i in range(1, 9):
        parts.append(f"x{i} AS MATERIALIZED (SELECT query_id, node_id, r, dangling, 0.15 * r + 0.85 * (sum(CASE WHEN dangling THEN x ELSE 0 END) OVER (PARTITION BY query_id)) * r + 0.85 * coalesce(f, 0) AS x FROM x{i - 1} LEFT JOIN (SELECT l.query_id, l.dst AS node_id, sum(x * mult / o) AS f FROM x{i - 1} JOIN local_edges l ON l.query_id = x{i - 1}.query_id AND l.src = x{i - 1}.node_id JOIN outd ON outd.query_id = l.query_id AND outd.src = l.src GROUP BY ALL) USING (query_id, node_id))")
    return ", ".join(parts)


@query("ppr_power_local", "SELECT query_id, node_id, round(x / max(x) OVER (PARTITION BY query_id), 6) AS mass FROM x8", _ppr_sql())
def _(w: Workload) -> DataFrame:
    return graph.ppr_local(w.candidates, w.seeds, w.local_edges).withColumn("mass", F.round("mass", 6))


def _pagerank_sql() -> str:
    parts = ["simple AS (SELECT DISTINCT src, dst FROM structural)", "od AS (SELECT src, count(*) AS o FROM simple GROUP BY src)", "p0 AS (SELECT vec_id AS node_id, n, o, 1.0::DOUBLE / n AS x FROM embeddings CROSS JOIN nn LEFT JOIN od ON src = vec_id)"]
    for i in range(1, 6):
        parts.append(f"p{i} AS MATERIALIZED (SELECT node_id, n, o, 0.15 / n + 0.85 * (SELECT coalesce(sum(x), 0) FROM p{i - 1} WHERE o IS NULL) / n + 0.85 * coalesce(f, 0) AS x FROM p{i - 1} LEFT JOIN (SELECT dst AS node_id, sum(x / o) AS f FROM p{i - 1} JOIN simple ON src = node_id GROUP BY dst) USING (node_id))")
    return ", ".join(parts)


@query("pagerank_global", "SELECT node_id, round(x / (SELECT sum(x) FROM p5), 9) AS rank FROM p5", _pagerank_sql())
def _(w: Workload) -> DataFrame:
    return graph.pagerank(w.vectors, w.structural).withColumn("rank", F.round("rank", 9))


@query("expand_directional", """SELECT query_id, node_id, score FROM (SELECT query_id, dst AS node_id, max(score) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, src ORDER BY score DESC, dst) AS k FROM (SELECT f.query_id, f.src, f.dst, round(list_cosine_similarity(
    list_transform(list_zip(v.embedding, u.embedding), lambda z: z[1]::DOUBLE - z[2]::DOUBLE), list_transform(list_zip(q.embedding, x.embedding), lambda z: z[1]::DOUBLE - z[2]::DOUBLE)), 6) AS score
    FROM fresh f JOIN embeddings u ON u.vec_id = f.src JOIN embeddings v ON v.vec_id = f.dst JOIN embeddings q ON q.vec_id = f.query_id JOIN anchors a ON a.query_id = f.query_id JOIN embeddings x ON x.vec_id = a.node_id)) WHERE k <= 16 GROUP BY query_id, dst)""", EXPAND)
def _(w: Workload) -> DataFrame:
    """Seeds' neighbours outside the pool, by the cosine of their displacement with the query's from its anchor; the best
    16 of a seed, and each node's best over seeds."""
    out = w.seeds.select("query_id", F.col("node_id").alias("src")).join(w.structural.select("src", "dst").distinct(), "src").where("src <> dst")
    new = out.withColumnRenamed("dst", "node_id").join(w.candidates.select("query_id", "node_id"), ["query_id", "node_id"], "left_anti")
    residual = fusion.anchor(w.ranked).join(w.vectors.select("node_id", F.col("vec").alias("xa")), "node_id").join(w.queries.select("query_id", F.col("vec").alias("q")), "query_id").select("query_id", V.minus("q", "xa").alias("toward"))
    j = new.join(w.vectors.select("node_id", F.col("vec").alias("xv")), "node_id").join(w.vectors.select(F.col("node_id").alias("src"), F.col("vec").alias("xu")), "src").join(residual, "query_id")
    scored = j.select("query_id", "src", "node_id", F.round(V.cosine(V.minus("xv", "xu"), F.col("toward")), 6).alias("score"))
    kept = scored.withColumn("_k", F.row_number().over(Window.partitionBy("query_id", "src").orderBy(F.desc("score"), "node_id"))).where("_k <= 16")
    return kept.groupBy("query_id", "node_id").agg(F.max("score").alias("score"))


@query("distinct_seed_support", """SELECT query_id, node_id, count(DISTINCT seed) AS seeds, count(seed) AS links FROM candidates c LEFT JOIN (
  SELECT l.query_id, l.dst AS node_id, l.src AS seed FROM local_edges l JOIN seeds s ON s.query_id = l.query_id AND s.node_id = l.src UNION ALL SELECT l.query_id, l.src, l.dst FROM local_edges l JOIN seeds s ON s.query_id = l.query_id AND s.node_id = l.dst) USING (query_id, node_id) GROUP BY query_id, node_id""")
def _(w: Workload) -> DataFrame:
    s = w.seeds.select("query_id", F.col("node_id").alias("seed"))
    fwd = w.local_edges.select("query_id", F.col("dst").alias("node_id"), F.col("src").alias("seed")).join(s, ["query_id", "seed"])
    back = w.local_edges.select("query_id", F.col("src").alias("node_id"), F.col("dst").alias("seed")).join(s, ["query_id", "seed"])
    touch = fwd.unionByName(back)
    return w.candidates.select("query_id", "node_id").join(touch, ["query_id", "node_id"], "left").groupBy("query_id", "node_id").agg(F.count_distinct("seed").alias("seeds"), F.count("seed").alias("links"))


@query("path_diversity", """SELECT e2.query_id, e2.dst AS node_id, count(DISTINCT e2.src) AS branch_2, count(DISTINCT e1.src) AS reach_2 FROM le e1 JOIN seeds s ON s.query_id = e1.query_id AND s.node_id = e1.src JOIN le e2 ON e2.query_id = e1.query_id AND e2.src = e1.dst GROUP BY ALL""", "le AS (SELECT query_id, src, dst FROM local_edges WHERE src <> dst)")
def _(w: Workload) -> DataFrame:
    """Distinct predecessors that carry a seed's walk, and distinct seeds, at two steps."""
    le = w.local_edges.where("src <> dst").select("query_id", "src", "dst")
    one = w.seeds.select("query_id", F.col("node_id").alias("src")).join(le, ["query_id", "src"]).select("query_id", F.col("src").alias("seed"), F.col("dst").alias("src"))
    return one.join(le, ["query_id", "src"]).groupBy("query_id", F.col("dst").alias("node_id")).agg(F.count_distinct("src").alias("branch_2"), F.count_distinct("seed").alias("reach_2"))


# Statistics


@query("degree_stats", """SELECT count(*) AS nodes, round(avg(deg), 6) AS mean, round(stddev_pop(deg), 6) AS sd, round(quantile_cont(deg, 0.95), 6) AS p95, max(deg)::BIGINT AS top, round(avg((deg = 0)::INT), 6) AS isolated FROM (
  SELECT vec_id, coalesce(o, 0) + coalesce(i, 0) AS deg FROM embeddings LEFT JOIN (SELECT src, count(*) AS o FROM structural GROUP BY src) ON src = vec_id LEFT JOIN (SELECT dst, count(*) AS i FROM structural GROUP BY dst) ON dst = vec_id)""")
def _(w: Workload) -> DataFrame:
    d = stats.degree_table(w.structural, w.vectors)
    return d.agg(F.count("*").alias("nodes"), F.round(F.avg("deg"), 6).alias("mean"), F.round(F.stddev_pop("deg"), 6).alias("sd"), F.round(F.percentile("deg", F.lit(0.95)), 6).alias("p95"), F.max("deg").alias("top"), F.round(F.avg((F.col("deg") == 0).cast("int")), 6).alias("isolated"))


@query("distribution", "SELECT l_returnflag, count(l_extendedprice) AS n, round(avg(l_extendedprice), 6) AS mean, round(quantile_cont(l_extendedprice, 0.1), 6) AS p10, round(quantile_cont(l_extendedprice, 0.25), 6) AS p25, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50, round(quantile_cont(l_extendedprice, 0.75), 6) AS p75, round(quantile_cont(l_extendedprice, 0.9), 6) AS p90, round(quantile_cont(l_extendedprice, 0.95), 6) AS p95, max(l_extendedprice) AS max FROM lineitem GROUP BY l_returnflag")
def _(w: Workload) -> DataFrame:
    return stats.distribution(w.table("lineitem"), ["l_returnflag"], "l_extendedprice")


TYPED = "kb AS (SELECT l_partkey AS src, l_suppkey AS dst, l_returnflag || l_linestatus AS rel FROM lineitem)"


def typed_kb(w: Workload) -> DataFrame:
    return w.table("lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.concat("l_returnflag", "l_linestatus").alias("rel"))


@query("pair_analysis", """SELECT sum(c)::BIGINT AS rows, count(*) AS pairs, count(*) FILTER (c > 1) AS repeated_pairs, sum(c - k)::BIGINT AS repeated_triples, count(*) FILTER (p.src <> p.dst AND (p.dst, p.src) IN (SELECT (src, dst) FROM pr)) AS reciprocal FROM pr p""", TYPED + ", pr AS (SELECT src, dst, count(*) AS c, count(DISTINCT rel) AS k FROM kb GROUP BY src, dst)")
def _(w: Workload) -> DataFrame:
    return stats.pair_analysis(typed_kb(w))


@query("two_hop_walk_count", "SELECT sum(deg * deg)::BIGINT AS walks, max(deg * deg)::BIGINT AS most, arg_max(node_id, (deg, -node_id)) AS worst FROM degree")
def _(w: Workload) -> DataFrame:
    """Two-step walks of the undirected graph: the sum of squared degrees, the largest and its (smallest) node."""
    d = stats.degree_table(graph.both_ways(graph.canonical_edges(w.structural)), w.vectors).select("node_id", F.col("out_deg").alias("deg"))
    square = F.col("deg") * F.col("deg")
    return d.agg(F.sum(square).alias("walks"), F.max(square).alias("most"), F.max_by("node_id", F.struct("deg", -F.col("node_id"))).alias("worst"))


@query("gini", "SELECT family, count(*) AS n, round(sum(2.0 * i * d) / (count(*) * sum(d)) - (count(*) + 1.0) / count(*), 6) AS gini FROM (SELECT family, d, row_number() OVER (PARTITION BY family ORDER BY d) AS i FROM (SELECT family, src, count(*) AS d FROM edges GROUP BY ALL)) GROUP BY family")
def _(w: Workload) -> DataFrame:
    return stats.gini(w.edges.groupBy("family", "src").agg(F.count("*").alias("d")), ["family"], "d")


@query("shannon", "SELECT l_returnflag, count(*) AS kinds, round(sum(-p * log2(p)), 6) AS bits, round(pow(2.0, sum(-p * log2(p))), 6) AS perplexity, round(sum(-p * log2(p)) / log2(count(*)), 6) AS share FROM (SELECT l_returnflag, l_suppkey, count(*) / sum(count(*)) OVER (PARTITION BY l_returnflag) AS p FROM lineitem GROUP BY l_returnflag, l_suppkey) GROUP BY l_returnflag")
def _(w: Workload) -> DataFrame:
    return stats.entropy(w.table("lineitem"), ["l_returnflag"], "l_suppkey")


@query("nucleus", "SELECT query_id, min(n) AS nodes FROM (SELECT query_id, row_number() OVER v AS n, sum(score) OVER (v ROWS UNBOUNDED PRECEDING) AS run, sum(score) OVER (PARTITION BY query_id) AS total FROM rrf WINDOW v AS (PARTITION BY query_id ORDER BY score DESC, node_id)) WHERE run >= 0.8 * total * (1 - 1e-9) GROUP BY query_id")
def _(w: Workload) -> DataFrame:
    return stats.nucleus(w.rrf, ["query_id"], "score", "node_id", 0.8)


@query("edge_homophily", "SELECT e.rel, count(*) AS edges, round(avg((a.label = b.label)::INT), 6) AS same FROM structural e JOIN embeddings a ON a.vec_id = src JOIN embeddings b ON b.vec_id = dst GROUP BY e.rel")
def _(w: Workload) -> DataFrame:
    a, b = w.vectors.select(F.col("node_id").alias("src"), F.col("label").alias("la")), w.vectors.select(F.col("node_id").alias("dst"), F.col("label").alias("lb"))
    return w.structural.join(a, "src").join(b, "dst").groupBy("rel").agg(F.count("*").alias("edges"), F.round(F.avg((F.col("la") == F.col("lb")).cast("int")), 6).alias("same"))


@query("edge_cosine", "SELECT family, round(avg(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[])), 6) + 0.0 AS cos, round(avg(list_sum(list_transform(list_zip(x.embedding, y.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ** 2))), 6) AS energy FROM und JOIN embeddings x ON x.vec_id = a JOIN embeddings y ON y.vec_id = b GROUP BY family")
def _(w: Workload) -> DataFrame:
    """Mean cosine and mean squared distance (Dirichlet energy) over undirected edges."""
    pairs = w.edges.where("src <> dst").select("family", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    j = pairs.join(w.vectors.select(F.col("node_id").alias("a"), F.col("vec").alias("x")), "a").join(w.vectors.select(F.col("node_id").alias("b"), F.col("vec").alias("y")), "b")
    return j.groupBy("family").agg((F.round(F.avg(V.cosine("x", "y")), 6) + 0.0).alias("cos"), F.round(F.avg(V.squared_distance("x", "y")), 6).alias("energy"))


@query("hub_amplification", "SELECT round(corr(deg, norm), 6) AS corr, round(covar_pop(deg, norm) / var_pop(deg), 9) AS slope FROM (SELECT deg::DOUBLE AS deg, sqrt(list_dot_product(embedding[1:32]::DOUBLE[], embedding[1:32]::DOUBLE[])) AS norm FROM degree JOIN embeddings ON vec_id = node_id)")
def _(w: Workload) -> DataFrame:
    """Degree against the norm of a node's dense vector (the first half; whole vectors have unit norm)."""
    d = stats.degree_table(graph.both_ways(graph.canonical_edges(w.structural)), w.vectors).select("node_id", F.col("out_deg").cast("double").alias("deg"))
    j = d.join(w.vectors, "node_id").select("deg", V.norm(F.slice("vec", 1, 32)).alias("norm"))
    return j.agg(F.round(F.corr("deg", "norm"), 6).alias("corr"), F.round(F.covar_pop("deg", "norm") / F.var_pop("deg"), 9).alias("slope"))


# Ranks within a query


@query("segment_zscore", "SELECT query_id, source, node_id, round((score - avg(score) OVER v) / stddev_pop(score) OVER v, 6) + 0.0 AS z FROM ranked WINDOW v AS (PARTITION BY query_id, source)")
def _(w: Workload) -> DataFrame:
    return w.ranked.select("query_id", "source", "node_id", (F.round(stats.zscore("score", ["query_id", "source"]), 6) + 0.0).alias("z"))


@query("segment_softmax", "SELECT query_id, node_id, round(e / sum(e) OVER (PARTITION BY query_id), 6) AS p FROM (SELECT query_id, node_id, exp((score - max(score) OVER (PARTITION BY query_id)) / 0.1) AS e FROM ranked WHERE source = 'dense')")
def _(w: Workload) -> DataFrame:
    v = Window.partitionBy("query_id")
    e = w.ranked.where("source = 'dense'").select("query_id", "node_id", F.exp((F.col("score") - F.max("score").over(v)) / 0.1).alias("e"))
    return e.select("query_id", "node_id", F.round(F.col("e") / F.sum("e").over(v), 6).alias("p"))


@query("within_query_percentile", "SELECT query_id, node_id, round((rank() OVER (PARTITION BY query_id ORDER BY mod10) - 1 + (count(*) OVER (PARTITION BY query_id, mod10) - 1) / 2.0) / (count(*) OVER (PARTITION BY query_id) - 1), 6) AS pct FROM (SELECT query_id, node_id, floor(score * 20) AS mod10 FROM ranked WHERE source = 'dense')")
def _(w: Workload) -> DataFrame:
    x = w.ranked.where("source = 'dense'").select("query_id", "node_id", F.floor(F.col("score") * 20).alias("x"))
    return x.select("query_id", "node_id", F.round(stats.average_percentile("x", ["query_id"]), 6).alias("pct"))


@query("hub_percentile", "SELECT node_id, round(cume_dist() OVER (ORDER BY deg), 9) AS pct FROM degree")
def _(w: Workload) -> DataFrame:
    """Share of nodes of at most this degree; counted by distinct degree, so no task orders all nodes."""
    d = stats.degree_table(graph.both_ways(graph.canonical_edges(w.structural)), w.vectors).select("node_id", F.col("out_deg").alias("deg"))
    c = d.groupBy("deg").agg(F.count("*").alias("c"))
    share = c.select("deg", (F.sum("c").over(Window.orderBy("deg").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("c").over(Window.partitionBy())).alias("pct"))
    return d.join(share, "deg").select("node_id", F.round("pct", 9).alias("pct"))


@query("normalise_by_max", "SELECT query_id, node_id, round(ln(1 + w) / max(ln(1 + w)) OVER (PARTITION BY query_id), 6) AS x FROM (SELECT query_id, dst AS node_id, sum(mult) AS w FROM local_edges GROUP BY ALL)")
def _(w: Workload) -> DataFrame:
    d = w.local_edges.groupBy("query_id", F.col("dst").alias("node_id")).agg(F.sum("mult").alias("w"))
    return d.select("query_id", "node_id", F.round(stats.log_share("w", ["query_id"]), 6).alias("x"))


@query("margin_entropy", """SELECT query_id, source, round(max(score) FILTER (rank = 1) - max(score) FILTER (rank = 2), 6) AS margin, round(-sum(p * ln(p)) / ln(count(*)), 6) AS entropy FROM (
  SELECT *, e / sum(e) OVER (PARTITION BY query_id, source) AS p FROM (SELECT *, exp(score - max(score) OVER (PARTITION BY query_id, source)) AS e FROM ranked)) GROUP BY query_id, source""")
def _(w: Workload) -> DataFrame:
    v = Window.partitionBy("query_id", "source")
    e = w.ranked.withColumn("e", F.exp(F.col("score") - F.max("score").over(v)))
    p = e.withColumn("p", F.col("e") / F.sum("e").over(v))
    top = lambda r: F.max(F.when(F.col("rank") == r, F.col("score")))
    return p.groupBy("query_id", "source").agg(F.round(top(1) - top(2), 6).alias("margin"), F.round(-F.sum(F.col("p") * F.log("p")) / F.log(F.count("*")), 6).alias("entropy"))


@query("rank_pct", """SELECT query_id, node_id, round(1 - coalesce(rd, 51) / 50.0, 6) AS dense_pct, round(1 - coalesce(rs, 51) / 50.0, 6) AS sparse_pct, least(coalesce(rd, 51), coalesce(rs, 51)) AS best, rd IS NOT NULL AND rs IS NOT NULL AS both_lists FROM (
  SELECT query_id, node_id, max(rank) FILTER (source = 'dense') AS rd, max(rank) FILTER (source = 'sparse') AS rs FROM ranked GROUP BY ALL)""")
def _(w: Workload) -> DataFrame:
    r = lambda s: F.max(F.when(F.col("source") == s, F.col("rank")))
    j = w.ranked.groupBy("query_id", "node_id").agg(r("dense").alias("rd"), r("sparse").alias("rs"))
    d, s = F.coalesce("rd", F.lit(51)), F.coalesce("rs", F.lit(51))
    return j.select("query_id", "node_id", F.round(1 - d / 50, 6).alias("dense_pct"), F.round(1 - s / 50, 6).alias("sparse_pct"), F.least(d, s).alias("best"), (F.col("rd").isNotNull() & F.col("rs").isNotNull()).alias("both_lists"))


# Metrics

FOUND = """found AS (SELECT query_id, count(*) AS g, count(c.node_id) AS a, min(rn) AS f, {at} FROM golds LEFT JOIN rrf USING (query_id, node_id) LEFT JOIN candidates c USING (query_id, node_id) GROUP BY query_id),
dg AS (SELECT k, sum(1 / log2(i + 1)) AS s FROM range(1, 51) t(k), range(1, 51) u(i) WHERE i <= k GROUP BY k)""".format(at=", ".join(f"count(*) FILTER (rn <= {k}) AS h{k}, coalesce(sum(1 / log2(rn + 1)) FILTER (rn <= {k}), 0) AS d{k}" for k in metrics.KS))


def found(w: Workload) -> DataFrame:
    return metrics.hits(w.rrf, w.golds, w.candidates)


@query("metrics_basic", "SELECT query_id, round(coalesce(1.0 / f, 0), 6) AS mrr, " + ", ".join(f"(h{k} > 0)::INT::DOUBLE AS hit_{k}, round(h{k} / g, 6) AS recall_{k}, (h{k} = g)::INT::DOUBLE AS full_{k}, round(d{k} / (SELECT s FROM dg WHERE k = least(g, {k})), 6) AS ndcg_{k}" for k in metrics.KS) + " FROM found", FOUND)
def _(w: Workload) -> DataFrame:
    return metrics.basic(found(w))


@query("metrics_conditional", "SELECT query_id, g, a, round(a / g, 6) AS ceiling, " + ", ".join(f"round(h{k} / nullif(a, 0), 6) AS cond_recall_{k}, CASE WHEN a > 0 THEN (h{k} = a)::INT::DOUBLE END AS cond_full_{k}, CASE WHEN a > 0 THEN (h{k} > 0)::INT::DOUBLE END AS cond_hit_{k}" for k in metrics.KS) + " FROM found", FOUND)
def _(w: Workload) -> DataFrame:
    return metrics.conditional(found(w))


@query("metrics_by_split", "SELECT split, count(*) AS queries, round(avg(h5 / g), 6) AS recall_5, round(avg(coalesce(1.0 / f, 0)), 6) AS mrr, round(avg(a / g), 6) AS ceiling FROM found JOIN queries USING (query_id) GROUP BY split", FOUND)
def _(w: Workload) -> DataFrame:
    m = found(w).select("query_id", (metrics.at(5) / F.col("g")).alias("r5"), F.when(F.size("ranks") > 0, 1 / F.get("ranks", F.lit(0))).otherwise(0.0).alias("mrr"), (F.col("a") / F.col("g")).alias("c"))
    return m.join(w.queries.select("query_id", "split"), "query_id").groupBy("split").agg(F.count("*").alias("queries"), F.round(F.avg("r5"), 6).alias("recall_5"), F.round(F.avg("mrr"), 6).alias("mrr"), F.round(F.avg("c"), 6).alias("ceiling"))


@query("headroom", "SELECT query_id, " + ", ".join(f"round(least(a, {k}) / g, 6) AS ceiling_{k}, round(least(g, {k}) / g, 6) AS perfect_{k}, round((least(g, {k}) - least(a, {k})) / g, 6) AS lost_{k}, round(coalesce((SELECT s FROM dg WHERE k = least(a, {k})), 0) / (SELECT s FROM dg WHERE k = least(g, {k})), 6) AS ndcg_ceiling_{k}" for k in metrics.KS) + " FROM found", FOUND)
def _(w: Workload) -> DataFrame:
    return metrics.headroom(found(w))


@query("source_headroom", """SELECT pool, round(sum(a) / sum(g), 6) AS micro, round(avg(a / g), 6) AS macro, round(avg((a > 0)::INT), 6) AS any, round(avg((a = g)::INT), 6) AS all FROM (
  SELECT pool, query_id, count(*) AS g, count(p.node_id) AS a FROM golds CROSS JOIN (VALUES ('dense'), ('sparse'), ('union')) v(pool) LEFT JOIN (SELECT source AS pool, query_id, node_id FROM ranked UNION ALL SELECT 'union', query_id, node_id FROM candidates) p USING (pool, query_id, node_id) GROUP BY ALL) GROUP BY pool""")
def _(w: Workload) -> DataFrame:
    pools = {"dense": w.ranked.where("source = 'dense'"), "sparse": w.ranked.where("source = 'sparse'"), "union": w.candidates}
    out = None
    for name, pool in pools.items():
        one = metrics.coverage(metrics.hits(w.rrf, w.golds, pool)).select(F.lit(name).alias("pool"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@query("coverage_curve", "SELECT n, round(avg(h / g), 6) AS recall, round(avg((h = g)::INT), 6) AS all_found FROM (SELECT n, query_id, count(*) AS g, count(*) FILTER (rn <= n) AS h FROM golds LEFT JOIN rrf USING (query_id, node_id), (VALUES (1), (5), (10), (20), (50), (100)) t(n) GROUP BY ALL) GROUP BY n")
def _(w: Workload) -> DataFrame:
    each = found(w).select("g", "ranks", F.explode(F.array(*[F.lit(n) for n in (1, 5, 10, 20, 50, 100)])).alias("n"))
    h = each.select("n", "g", F.expr("size(filter(ranks, r -> r <= n))").alias("h"))
    return h.groupBy("n").agg(F.round(F.avg(F.col("h") / F.col("g")), 6).alias("recall"), F.round(F.avg((F.col("h") == F.col("g")).cast("int")), 6).alias("all_found"))


@query("select_dense_weight", """SELECT w, round(value, 6) AS value FROM (SELECT w, avg(h / g) AS value FROM (SELECT w, query_id, count(*) AS g, count(*) FILTER (rn <= 5) AS h FROM golds CROSS JOIN (VALUES (0.0::DOUBLE), (0.25), (0.5), (0.75), (1.0)) t(w) LEFT JOIN wf USING (query_id, node_id, w) GROUP BY ALL) GROUP BY w) ORDER BY round(value, 6) DESC, abs(w - 0.5), w LIMIT 1""",
  "wf AS (SELECT *, row_number() OVER (PARTITION BY query_id, w ORDER BY score DESC, node_id) AS rn FROM (SELECT query_id, w, node_id, round(sum(CASE source WHEN 'dense' THEN w ELSE 1 - w END / (60 + rank)), 9) AS score FROM ranked, (VALUES (0.0::DOUBLE), (0.25), (0.5), (0.75), (1.0)) t(w) GROUP BY ALL))")
def _(w: Workload) -> DataFrame:
    fused = fusion.rrf_weights(w.ranked, [0.0, 0.25, 0.5, 0.75, 1.0])
    size = w.golds.groupBy("query_id").agg(F.count("*").alias("g"))
    h = fused.where("rn <= 5").join(w.golds, ["query_id", "node_id"]).groupBy("query_id", "w").agg(F.count("*").alias("h"))
    grid = size.select("query_id", "g", F.explode(F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0)])).alias("w"))
    value = grid.join(h, ["query_id", "w"], "left").groupBy("w").agg(F.round(F.avg(F.coalesce("h", F.lit(0)) / F.col("g")), 6).alias("value"))
    return metrics.select_weight(value)


@query("rank_auc", "SELECT query_id, round(CASE WHEN p > 0 AND n > 0 THEN (s - p * (p + 1) / 2.0) / (p * n) END, 6) AS auc FROM (SELECT query_id, coalesce(sum(r) FILTER (pos), 0) AS s, count(*) FILTER (pos) AS p, count(*) FILTER (NOT pos) AS n FROM (SELECT query_id, gg.node_id IS NOT NULL AS pos, rank() OVER (PARTITION BY query_id ORDER BY score) + (count(*) OVER (PARTITION BY query_id, score) - 1) / 2.0 AS r FROM rrf LEFT JOIN golds gg USING (query_id, node_id)) GROUP BY query_id)")
def _(w: Workload) -> DataFrame:
    g = w.golds.withColumn("_g", F.lit(True))
    return metrics.rank_auc(w.rrf.join(g, ["query_id", "node_id"], "left").withColumn("positive", F.coalesce("_g", F.lit(False))), ["query_id"], "score", "positive")


@query("listwise_loss", "SELECT query_id, round(max(lse) - ln(sum(exp(100 * score)) FILTER (gg.node_id IS NOT NULL)), 6) AS loss FROM (SELECT *, ln(sum(exp(100 * score)) OVER (PARTITION BY query_id)) AS lse FROM rrf) LEFT JOIN golds gg USING (query_id, node_id) GROUP BY query_id HAVING count(gg.node_id) > 0")
def _(w: Workload) -> DataFrame:
    g = w.golds.withColumn("_g", F.lit(True))
    e = w.rrf.join(g, ["query_id", "node_id"], "left").withColumn("e", F.exp(100 * F.col("score")))
    return e.groupBy("query_id").agg(F.log(F.sum("e")).alias("all"), F.sum(F.when(F.col("_g"), F.col("e"))).alias("gold")).where("gold is not null").select("query_id", F.round(F.col("all") - F.log("gold"), 6).alias("loss"))


@query("complementarity", """SELECT round(avg((d > 0 AND s = 0)::INT), 6) AS only_dense, round(avg((s > 0 AND d = 0)::INT), 6) AS only_sparse, round(avg((d > 0 AND s > 0)::INT), 6) AS both_hit, round(avg((d = 0 AND s = 0)::INT), 6) AS neither FROM (
  SELECT query_id, count(*) FILTER (source = 'dense' AND rank <= 5) AS d, count(*) FILTER (source = 'sparse' AND rank <= 5) AS s FROM golds LEFT JOIN ranked USING (query_id, node_id) GROUP BY query_id)""")
def _(w: Workload) -> DataFrame:
    n = lambda s: F.count(F.when((F.col("source") == s) & (F.col("rank") <= 5), 1))
    j = w.golds.join(w.ranked, ["query_id", "node_id"], "left").groupBy("query_id").agg(n("dense").alias("d"), n("sparse").alias("s"))
    share = lambda c, name: F.round(F.avg(c.cast("int")), 6).alias(name)
    d, s = F.col("d") > 0, F.col("s") > 0
    return j.agg(share(d & ~s, "only_dense"), share(s & ~d, "only_sparse"), share(d & s, "both_hit"), share(~d & ~s, "neither"))


@query("holm", """SELECT test, p, least(1.0, max(raw) OVER (ORDER BY p, test ROWS UNBOUNDED PRECEDING)) AS adjusted FROM (SELECT test, p, (count(*) OVER () - row_number() OVER (ORDER BY p, test) + 1) * p AS raw FROM (
  SELECT l_returnflag || l_linestatus AS test, round(avg(l_discount), 6) AS p FROM lineitem GROUP BY 1))""")
def _(w: Workload) -> DataFrame:
    """Holm's adjustment of one value for each return flag and line status."""
    t = w.table("lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("test")).agg(F.round(F.avg("l_discount"), 6).alias("p"))
    return metrics.holm(t)


# Filters, text and identity


@query("filter_split", "SELECT query_id, split FROM queries WHERE split = 'test'")
def _(w: Workload) -> DataFrame:
    return w.queries.where("split = 'test'").select("query_id", "split")


@query("hash_split", "SELECT doc_id, CASE WHEN h < 7000 THEN 'train' WHEN h < 8500 THEN 'validation' ELSE 'test' END AS split FROM (SELECT doc_id, ('0x' || substr(sha256(doc_id::VARCHAR), 1, 8))::BIGINT % 10000 AS h FROM documents)")
def _(w: Workload) -> DataFrame:
    h = F.conv(F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 8), 16, 10).cast("long") % 10000
    return w.table("documents").select("doc_id", F.when(h < 7000, "train").when(h < 8500, "validation").otherwise("test").alias("split"))


@query("parity_split", "SELECT query_id, CASE WHEN (row_number() OVER (ORDER BY query_id) - 1) % 2 = 0 THEN 'even' ELSE 'odd' END AS half FROM queries")
def _(w: Workload) -> DataFrame:
    """By place among the queries."""
    return numbered(w.queries.select("query_id"), ["query_id"]).select("query_id", F.when(F.col("place") % 2 == 0, "even").otherwise("odd").alias("half"))


@query("norm_text", "SELECT item_id, trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' ') AS norm FROM benchmark")
def _(w: Workload) -> DataFrame:
    return w.table("benchmark").select("item_id", T.norm_text("text").alias("norm"))


@query("name_forms", r"SELECT p_partkey, p_name, regexp_replace(p_name || ' (' || p_brand || ')', '\s*\([^)]*\)\s*$', '') AS form FROM part")
def _(w: Workload) -> DataFrame:
    return w.table("part").select("p_partkey", "p_name", T.without_parenthetical(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))).alias("form"))


@query("json_path", """SELECT event_id, path, json_extract_string(props, '$."' || path || '"') AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS path FROM events WHERE props IS NOT NULL)""")
def _(w: Workload) -> DataFrame:
    """Every top-level path of each object and its value."""
    return w.table("events").where("props is not null").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("path", "value"))


@query("pool_digest", "SELECT query_id, sha256(string_agg(node_id::VARCHAR, ',' ORDER BY node_id)) AS digest FROM candidates GROUP BY query_id")
def _(w: Workload) -> DataFrame:
    return w.candidates.groupBy("query_id").agg(T.id_digest(F.col("node_id")).alias("digest"))


@query("seed_bits", "SELECT query_id, bit_or(1::BIGINT << (seed_pos - 1)) AS mask, bit_count(bit_or(1::BIGINT << (seed_pos - 1)))::INT AS n FROM seeds GROUP BY query_id")
def _(w: Workload) -> DataFrame:
    m = w.seeds.groupBy("query_id").agg(F.bit_or(F.expr("shiftleft(1L, int(seed_pos - 1))")).alias("mask"))
    return m.select("query_id", "mask", F.bit_count("mask").alias("n"))


@query("relation_ief", "SELECT rel, round(ln((1.0 + (SELECT count(*) FROM structural)) / (1 + count(*))), 6) AS ief FROM structural GROUP BY rel")
def _(w: Workload) -> DataFrame:
    c = w.structural.groupBy("rel").agg(F.count("*").alias("c"))
    return c.select("rel", F.round(F.log((1 + F.sum("c").over(Window.partitionBy())) / (1 + F.col("c"))), 6).alias("ief"))


@query("restart_a2", "SELECT query_id, node_id, round(coalesce(s, 0) + coalesce(r, 0), 7) AS mass FROM (SELECT query_id, node_id, 0.5 * sp / sum(sp) OVER (PARTITION BY query_id) AS s FROM (SELECT query_id, node_id, 1 / ln(exp(1) + deg) AS sp FROM seeds JOIN degree USING (node_id))) FULL JOIN (SELECT query_id, node_id, 0.5 * sp / sum(sp) OVER (PARTITION BY query_id) AS r FROM (SELECT query_id, node_id, score / ln(exp(1) + deg) AS sp FROM rrf JOIN degree USING (node_id))) USING (query_id, node_id)")
def _(w: Workload) -> DataFrame:
    """Restart weights: half on the seeds and half on fused scores, each damped by degree and normalised."""
    d = stats.degree_table(graph.both_ways(graph.canonical_edges(w.structural)), w.vectors).select("node_id", (1 / F.log(F.exp(F.lit(1.0)) + F.col("out_deg"))).alias("spec"))
    v = Window.partitionBy("query_id")
    half = lambda x, name: (0.5 * F.col(x) / F.sum(x).over(v)).alias(name)
    s = w.seeds.join(d, "node_id").select("query_id", "node_id", half("spec", "s"))
    r = w.rrf.join(d, "node_id").select("query_id", "node_id", (F.col("score") * F.col("spec")).alias("sp")).select("query_id", "node_id", half("sp", "r"))
    return s.join(r, ["query_id", "node_id"], "full").select("query_id", "node_id", F.round(F.coalesce("s", F.lit(0.0)) + F.coalesce("r", F.lit(0.0)), 7).alias("mass"))


@query("select_first_of_group", "SELECT user_id, arg_min(event_type, (ts, event_id)) AS first_type, count(*) AS n FROM events GROUP BY user_id")
def _(w: Workload) -> DataFrame:
    return w.table("events").groupBy("user_id").agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("first_type"), F.count("*").alias("n"))
