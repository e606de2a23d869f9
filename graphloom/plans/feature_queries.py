"""Registered queries: scans, contexts, retention, wide features, curves and decision rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.functions import vectors as V
from graphloom.operators import fusion, graph, metrics, stats
from graphloom.operators.order import numbered
from graphloom.plans.more_queries import LOCAL_BFS, local_reach
from graphloom.plans.queries import BFS, EXPAND, FOUND, expansion, found, query, reach
from graphloom.plans.workload import Workload

KEY = ["query_id", "node_id"]


def dense_sparse(w: Workload) -> DataFrame:
    r = lambda s: F.max(F.when(F.col("source") == s, F.col("rank")))
    return w.ranked.groupBy(*KEY).agg(r("dense").alias("rd"), r("sparse").alias("rs"))


DS = "dsr AS (SELECT query_id, node_id, max(rank) FILTER (source = 'dense') AS rd, max(rank) FILTER (source = 'sparse') AS rs FROM ranked GROUP BY ALL)"


# Scans and identity


@query("scan_ranked", "SELECT query_id, source, node_id, rank, score FROM ranked")
def _(w: Workload) -> DataFrame:
    return w.ranked


@query("scan_graph", "SELECT family, src, dst, rel, weight, edge_pos FROM edges")
def _(w: Workload) -> DataFrame:
    return w.edges


@query("scan_complete", "SELECT query_id, split, count(c.node_id) AS pool, count(s.node_id) AS seeds FROM queries JOIN candidates c USING (query_id) LEFT JOIN seeds s USING (query_id, node_id) GROUP BY ALL")
def _(w: Workload) -> DataFrame:
    s = w.seeds.select(*KEY, F.lit(1).alias("s"))
    return w.queries.select("query_id", "split").join(w.candidates, "query_id").join(s, KEY, "left").groupBy("query_id", "split").agg(F.count("*").alias("pool"), F.count("s").alias("seeds"))


@query("node_id_mapping", "SELECT c_name, c_custkey AS node_id, try_cast(regexp_extract(c_name, '(\\d+)$', 1) AS BIGINT) AS suffix FROM customer")
def _(w: Workload) -> DataFrame:
    """Names, their ids and the number at their end, which a numeric identity would use."""
    return w.table("customer").select("c_name", F.col("c_custkey").alias("node_id"), F.expr(r"try_cast(regexp_extract(c_name, '(\\d+)$', 1) as bigint)").alias("suffix"))


@query("gather_by_id", "SELECT query_id, node_id, round(list_sum(embedding::DOUBLE[]), 6) + 0.0 AS total FROM seeds JOIN embeddings ON vec_id = node_id")
def _(w: Workload) -> DataFrame:
    return w.seeds.join(w.vectors, "node_id").select(*KEY, (F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double")), 6) + 0.0).alias("total"))


@query("export_global", "SELECT doc_id, lang, source, sha256(coalesce(text, '')) AS digest, length(text) AS chars FROM documents")
def _(w: Workload) -> DataFrame:
    return w.table("documents").select("doc_id", "lang", "source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), F.length("text").cast("long").alias("chars"))


@query("artifact_path", "SELECT l_returnflag || '/' || l_linestatus || '/part=' || (l_orderkey // 1000) AS path, sha256(string_agg(l_orderkey || ':' || l_linenumber, ',' ORDER BY l_orderkey, l_linenumber)) AS digest FROM lineitem GROUP BY 1")
def _(w: Workload) -> DataFrame:
    """The path of each part of a logical group (1,000 orders) and a digest of its lines' sorted keys, which names the part."""
    path = F.concat_ws("/", "l_returnflag", "l_linestatus", F.concat(F.lit("part="), F.floor(F.col("l_orderkey") / 1000).cast("string")))
    rows = w.table("lineitem").groupBy(path.alias("path")).agg(F.sort_array(F.collect_list(F.struct("l_orderkey", "l_linenumber"))).alias("k"))
    return rows.select("path", F.sha2(F.array_join(F.transform("k", lambda x: F.concat_ws(":", x["l_orderkey"].cast("string"), x["l_linenumber"].cast("string"))), ","), 256).alias("digest"))


@query("artifact_digest", """SELECT logical, sha256(string_agg(digest, ',' ORDER BY block)) AS digest FROM (
  SELECT logical, block, sha256(string_agg(digest, ',' ORDER BY slice)) AS digest FROM (
    SELECT l_returnflag || '/' || l_linestatus AS logical, floor(l_orderkey / 1000)::BIGINT AS slice, floor(l_orderkey / 1000000)::BIGINT AS block, sha256(string_agg(l_orderkey || ':' || l_linenumber, ',' ORDER BY l_orderkey, l_linenumber)) AS digest FROM lineitem GROUP BY ALL) GROUP BY ALL) GROUP BY ALL""")
def _(w: Workload) -> DataFrame:
    """A digest of the sorted keys of all lines of each logical group: of slices of 1,000 orders, then of blocks of 1,000
    slices' digests, then of the blocks' digests, so that no task collects a group."""

    def digest(df: DataFrame, by: list, order: str, value) -> DataFrame:
        k = df.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*order.split(), value.alias("v")))).alias("k"))
        return k.withColumn("digest", F.sha2(F.array_join(F.transform("k", lambda x: x["v"]), ","), 256)).drop("k")

    logical = F.concat_ws("/", "l_returnflag", "l_linestatus").alias("logical")
    slice_, block = ((F.floor(F.col("l_orderkey") / n)).alias(a) for n, a in ((1000, "slice"), (1000000, "block")))
    lines = w.table("lineitem").select(logical, slice_, block, "l_orderkey", "l_linenumber")
    slices = digest(lines, ["logical", "block", "slice"], "l_orderkey l_linenumber", F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")))
    blocks = digest(slices, ["logical", "block"], "slice", F.col("digest"))
    return digest(blocks, ["logical"], "block", F.col("digest"))


@query("project_columns", "SELECT query_id, node_id, coalesce(rd, 0) AS rd, coalesce(rs, 0) AS rs FROM dsr", DS)
def _(w: Workload) -> DataFrame:
    return dense_sparse(w).select(*KEY, F.coalesce("rd", F.lit(0)).alias("rd"), F.coalesce("rs", F.lit(0)).alias("rs"))


@query("membership", "SELECT query_id, g.node_id, pos IS NOT NULL AS inside, coalesce(pos, 0) AS pos FROM golds g LEFT JOIN candidates USING (query_id, node_id)")
def _(w: Workload) -> DataFrame:
    return w.golds.join(w.candidates, KEY, "left").select(*KEY, F.col("pos").isNotNull().alias("inside"), F.coalesce("pos", F.lit(0)).alias("pos"))


@query("sample_even", "SELECT query_id FROM (SELECT query_id, row_number() OVER (ORDER BY query_id) - 1 AS i, count(*) OVER () AS n FROM queries) WHERE i IN (SELECT floor(k * (n - 1) / 4.0)::BIGINT FROM range(0, 5) t(k))")
def _(w: Workload) -> DataFrame:
    """Five queries at even steps (a sampling operator)."""
    n = w.queries.agg(F.count("*").alias("n"))
    picks = n.select(F.explode(F.expr("transform(sequence(0, 4), k -> floor(k * (n - 1) / 4.0D))")).alias("i")).distinct()
    return numbered(w.queries.select("query_id"), ["query_id"], "i").join(F.broadcast(picks), "i").select("query_id")


@query("holdout_tail", "SELECT query_id, row_number() OVER (ORDER BY query_id) > count(*) OVER () - greatest(1, round_even(count(*) OVER () * 0.2, 0)) AS held FROM queries WHERE split = 'train'")
def _(w: Workload) -> DataFrame:
    """The last fifth of the training queries (at least one), rounded half to even."""
    t = numbered(w.queries.where("split = 'train'").select("query_id"), ["query_id"])
    first = t.agg((F.count("*") - F.greatest(F.lit(1.0), F.rint(F.count("*") * 0.2))).alias("first"))
    return t.crossJoin(F.broadcast(first)).select("query_id", (F.col("place") >= F.col("first")).alias("held"))


@query("carve_stride", "SELECT query_id, p % s = 0 AS selected, p % s <> 0 AS fit FROM (SELECT query_id, row_number() OVER (ORDER BY query_id) - 1 AS p, greatest(1, count(*) OVER () // 4) AS s FROM queries)")
def _(w: Workload) -> DataFrame:
    """Four queries or so at an even stride are set apart; the others are the part to fit on."""
    stride = w.queries.agg(F.greatest(F.lit(1), F.floor(F.count("*") / 4)).alias("s"))
    t = numbered(w.queries.select("query_id"), ["query_id"]).crossJoin(F.broadcast(stride)).select("query_id", (F.col("place") % F.col("s") == 0).alias("selected"))
    return t.withColumn("fit", ~F.col("selected"))


# Edges


@query("symmetrize", "SELECT family, count(*) AS edges, count(*) FILTER ((family, dst, src) IN (SELECT (family, src, dst) FROM simple)) = count(*) AS symmetric FROM simple GROUP BY family", "simple AS (SELECT DISTINCT family, src, dst FROM edges WHERE src <> dst)")
def _(w: Workload) -> DataFrame:
    s = w.edges.where("src <> dst").select("family", "src", "dst").distinct()
    back = s.select("family", F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).alias("b"))
    return s.join(back, ["family", "src", "dst"], "left").groupBy("family").agg(F.count("*").alias("edges"), (F.count("b") == F.count("*")).alias("symmetric"))


@query("directed_adjacency", "SELECT DISTINCT dst AS src, src AS dst FROM structural")
def _(w: Workload) -> DataFrame:
    return w.structural.select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct()


@query("to_csr", "SELECT src, dst, edge_pos, row_number() OVER (PARTITION BY src ORDER BY dst, edge_pos) AS slot FROM structural")
def _(w: Workload) -> DataFrame:
    return w.structural.select("src", "dst", "edge_pos", F.row_number().over(Window.partitionBy("src").orderBy("dst", "edge_pos")).alias("slot"))


@query("induced_view", """SELECT query_id, count(*) AS nodes, sum(inside)::BIGINT AS inside, sum(total - inside)::BIGINT AS boundary, sum(loops)::BIGINT AS loops FROM (
  SELECT c.query_id, c.node_id, (SELECT count(*) FROM structural e WHERE e.src = c.node_id) AS total, (SELECT coalesce(sum(mult), 0) FROM local_edges l WHERE l.query_id = c.query_id AND l.src = c.node_id) AS inside,
  (SELECT coalesce(sum(mult), 0) FROM local_edges l WHERE l.query_id = c.query_id AND l.src = c.node_id AND l.dst = l.src) AS loops FROM candidates c) GROUP BY query_id""")
def _(w: Workload) -> DataFrame:
    r = graph.retention(w.candidates, w.structural, w.local_edges)
    loops = w.local_edges.where("src = dst").groupBy("query_id").agg(F.sum("mult").alias("loops"))
    g = r.groupBy("query_id").agg(F.count("*").alias("nodes"), F.sum("kept").alias("inside"), F.sum(F.col("out_degree") - F.col("kept")).alias("boundary"))
    return g.join(loops, "query_id", "left").select("query_id", "nodes", "inside", "boundary", F.coalesce("loops", F.lit(0)).alias("loops"))


@query("pool_edges", """SELECT query_id, family, src, dst, round(weight / max(weight) OVER (PARTITION BY query_id, family), 6) AS share FROM (SELECT c1.query_id, family, e.src, e.dst, max(weight) AS weight FROM edges e JOIN candidates c1 ON c1.node_id = e.src JOIN candidates c2 ON c2.query_id = c1.query_id AND c2.node_id = e.dst WHERE e.src <> e.dst GROUP BY ALL)""")
def _(w: Workload) -> DataFrame:
    c1, c2 = w.candidates.select("query_id", F.col("node_id").alias("src")), w.candidates.select("query_id", F.col("node_id").alias("dst"))
    e = w.edges.where("src <> dst").join(c1, "src").join(c2, ["query_id", "dst"]).groupBy("query_id", "family", "src", "dst").agg(F.max("weight").alias("weight"))
    return e.select("query_id", "family", "src", "dst", F.round(F.col("weight") / F.max("weight").over(Window.partitionBy("query_id", "family")), 6).alias("share"))


@query("operator_edge_load", "SELECT query_id, sum(mult)::BIGINT AS stored, count(*) AS distinct_pairs, count(*) FILTER (src <> dst) AS without_loops FROM local_edges GROUP BY query_id")
def _(w: Workload) -> DataFrame:
    return w.local_edges.groupBy("query_id").agg(F.sum("mult").alias("stored"), F.count("*").alias("distinct_pairs"), F.count(F.when(F.col("src") != F.col("dst"), 1)).alias("without_loops"))


@query("graph_statistics", "SELECT family, 'rows' AS metric, count(*)::DOUBLE AS value FROM edges GROUP BY family UNION ALL SELECT family, 'loops', count(*) FILTER (src = dst)::DOUBLE FROM edges GROUP BY family UNION ALL SELECT family, 'mean_weight', round(avg(weight), 6) FROM edges GROUP BY family")
def _(w: Workload) -> DataFrame:
    g = w.edges.groupBy("family").agg(F.count("*").cast("double").alias("rows"), F.count(F.when(F.col("src") == F.col("dst"), 1)).cast("double").alias("loops"), F.round(F.avg("weight"), 6).alias("mean_weight"))
    return g.unpivot(["family"], ["rows", "loops", "mean_weight"], "metric", "value")


# Contexts and traversal


@query("distinct_two_path", "SELECT DISTINCT a.query_id, e.dst AS node_id FROM candidates a JOIN structural e ON e.src = a.node_id JOIN structural f ON f.src = e.dst JOIN candidates c ON c.query_id = a.query_id AND c.node_id = f.dst WHERE a.node_id <> c.node_id")
def _(w: Workload) -> DataFrame:
    e = w.structural.select("src", "dst").distinct()
    first = w.candidates.select("query_id", F.col("node_id").alias("src")).join(e, "src").select("query_id", F.col("src").alias("a"), F.col("dst").alias("v"))
    back = e.join(w.candidates.select("query_id", F.col("node_id").alias("dst")), "dst").select("query_id", F.col("src").alias("v"), F.col("dst").alias("c"))
    return first.join(back, ["query_id", "v"]).where("a <> c").select("query_id", F.col("v").alias("node_id")).distinct()


@query("two_path_preservation", """SELECT query_id, count(*) AS bridges, count(c.node_id) AS kept FROM tp LEFT JOIN candidates c USING (query_id, node_id) GROUP BY query_id""",
  "tp AS (SELECT DISTINCT a.query_id, e.dst AS node_id FROM candidates a JOIN structural e ON e.src = a.node_id JOIN structural f ON f.src = e.dst JOIN candidates c ON c.query_id = a.query_id AND c.node_id = f.dst WHERE a.node_id <> c.node_id)")
def _(w: Workload) -> DataFrame:
    from graphloom.plans.queries import BODIES

    bridges = BODIES["distinct_two_path"](w)
    return bridges.join(w.candidates.select(*KEY, F.lit(1).alias("k")), KEY, "left").groupBy("query_id").agg(F.count("*").alias("bridges"), F.count("k").alias("kept"))


@query("receptive_field", "SELECT query_id, hop, count(*) AS nodes FROM ldist GROUP BY query_id, hop", LOCAL_BFS)
def _(w: Workload) -> DataFrame:
    return local_reach(w).groupBy("query_id", "hop").agg(F.count("*").alias("nodes"))


@query("path_preservation", "SELECT r.hop, count(*) AS global_pairs, count(*) FILTER (l.hop <= r.hop) AS kept FROM reach r JOIN candidates c USING (query_id, node_id) LEFT JOIN ldist l USING (query_id, node_id) WHERE r.hop <= 2 GROUP BY r.hop", BFS + ", " + LOCAL_BFS)
def _(w: Workload) -> DataFrame:
    """Of candidates that the seeds reach in the whole graph, those that stay as near inside the pool."""
    l = local_reach(w).select(*KEY, F.col("hop").alias("lh"))  # noqa: E741
    j = reach(w, 2).join(w.candidates.select(*KEY), KEY).join(l, KEY, "left")
    return j.groupBy("hop").agg(F.count("*").alias("global_pairs"), F.count(F.when(F.col("lh") <= F.col("hop"), 1)).alias("kept"))


@query("context_report", "SELECT query_id, count(*) AS size, count(*) FILTER (c.node_id IS NULL) AS added, round(count(*) FILTER (c.node_id IS NULL) / count(*), 6) AS added_share FROM (SELECT query_id, node_id FROM candidates UNION SELECT query_id, node_id FROM reach WHERE hop <= 2) LEFT JOIN candidates c USING (query_id, node_id) GROUP BY query_id", BFS)
def _(w: Workload) -> DataFrame:
    u = w.candidates.select(*KEY).union(reach(w, 2).select(*KEY)).distinct().join(w.candidates.select(*KEY, F.lit(1).alias("c")), KEY, "left")
    new = F.count(F.when(F.col("c").isNull(), 1))
    return u.groupBy("query_id").agg(F.count("*").alias("size"), new.alias("added"), F.round(new / F.count("*"), 6).alias("added_share"))


@query("structural_context_stats", "SELECT query_id, n AS candidates, coalesce(e, 0) AS edges, round(coalesce(e, 0) / (n * (n - 1)), 9) AS density FROM (SELECT query_id, count(*) AS n FROM candidates GROUP BY query_id) LEFT JOIN (SELECT query_id, count(*) FILTER (src <> dst) AS e FROM local_edges GROUP BY query_id) USING (query_id)")
def _(w: Workload) -> DataFrame:
    n = w.candidates.groupBy("query_id").agg(F.count("*").alias("candidates"))
    e = w.local_edges.where("src <> dst").groupBy("query_id").agg(F.count("*").alias("e"))
    edges = F.coalesce("e", F.lit(0))
    return n.join(e, "query_id", "left").select("query_id", "candidates", edges.alias("edges"), F.round(edges / (F.col("candidates") * (F.col("candidates") - 1)), 9).alias("density"))


@query("connectivity", "SELECT query_id, count(*) AS nodes, count(*) FILTER (d IS NULL) AS isolates FROM candidates LEFT JOIN (SELECT DISTINCT query_id, node_id, 1 AS d FROM (SELECT query_id, src AS node_id FROM local_edges WHERE src <> dst UNION ALL SELECT query_id, dst FROM local_edges WHERE src <> dst)) USING (query_id, node_id) GROUP BY query_id")
def _(w: Workload) -> DataFrame:
    le = w.local_edges.where("src <> dst")
    ends = le.select("query_id", F.col("src").alias("node_id")).union(le.select("query_id", "dst")).distinct().withColumn("d", F.lit(1))
    return w.candidates.join(ends, KEY, "left").groupBy("query_id").agg(F.count("*").alias("nodes"), F.count(F.when(F.col("d").isNull(), 1)).alias("isolates"))


@query("seed_support_2hop", "SELECT query_id, node_id, count(DISTINCT seed) AS seeds, count(DISTINCT bridge) AS bridges FROM (SELECT a.query_id, b.dst AS node_id, a.src AS seed, a.dst AS bridge FROM local_edges a JOIN seeds s ON s.query_id = a.query_id AND s.node_id = a.src JOIN local_edges b ON b.query_id = a.query_id AND b.src = a.dst WHERE a.src <> a.dst AND b.src <> b.dst AND b.dst <> a.src) GROUP BY ALL")
def _(w: Workload) -> DataFrame:
    le = w.local_edges.where("src <> dst").select("query_id", "src", "dst")
    one = w.seeds.select("query_id", F.col("node_id").alias("src")).join(le, ["query_id", "src"]).select("query_id", F.col("src").alias("seed"), F.col("dst").alias("src"))
    two = one.join(le, ["query_id", "src"]).where("dst <> seed")
    return two.groupBy("query_id", F.col("dst").alias("node_id")).agg(F.count_distinct("seed").alias("seeds"), F.count_distinct("src").alias("bridges"))


@query("seed_reach_weights", "SELECT query_id, node_id, max(CASE WHEN hop = 0 THEN 0.0 WHEN hop = 1 THEN 1.0 ELSE 0.5 END)::DOUBLE AS weight FROM ldist GROUP BY ALL", LOCAL_BFS)
def _(w: Workload) -> DataFrame:
    return local_reach(w).groupBy(*KEY).agg(F.max(F.when(F.col("hop") == 0, 0.0).when(F.col("hop") == 1, 1.0).otherwise(0.5)).alias("weight"))


@query("hop_and_family_mask", "SELECT s.query_id, b.dst AS node_id, bit_or(CASE family WHEN 'structural' THEN 1 ELSE 2 END)::INT AS mask FROM seeds s JOIN both_ways b ON b.src = s.node_id GROUP BY ALL")
def _(w: Workload) -> DataFrame:
    """Families of the first link from a seed, as bits."""
    pairs = w.edges.where("src <> dst").select("family", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    two = pairs.select("family", F.col("a").alias("src"), F.col("b").alias("dst")).union(pairs.select("family", "b", "a"))
    j = w.seeds.select("query_id", F.col("node_id").alias("src")).join(two, "src")
    return j.groupBy("query_id", F.col("dst").alias("node_id")).agg(F.bit_or(F.when(F.col("family") == "structural", 1).otherwise(2)).alias("mask"))


@query("family_value", """SELECT sub, count(DISTINCT (g.query_id, g.node_id)) AS golds FROM (VALUES ('structural'), ('ner'), ('all')) v(sub) JOIN both_ways b ON sub = 'all' OR b.family = sub JOIN seeds s ON s.node_id = b.src JOIN golds g ON g.query_id = s.query_id AND g.node_id = b.dst GROUP BY sub""")
def _(w: Workload) -> DataFrame:
    """Golds one link from a seed, by each family alone and by both."""
    pairs = w.edges.where("src <> dst").select("family", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    two = pairs.select("family", F.col("a").alias("src"), F.col("b").alias("dst")).union(pairs.select("family", "b", "a"))
    j = w.seeds.select("query_id", F.col("node_id").alias("src")).join(two, "src").withColumnRenamed("dst", "node_id").join(w.golds, KEY)
    each = j.select(*KEY, F.explode(F.array("family", F.lit("all"))).alias("sub")).distinct()
    return each.groupBy("sub").agg(F.count("*").alias("golds"))


@query("expand_hops", """SELECT query_id, node_id, min(place) AS place FROM (SELECT s.query_id, nbr AS node_id, seed_pos * 1000 + CASE f.family WHEN 'structural' THEN 0 ELSE 100 END + rank AS place FROM seeds s JOIN fo f ON f.node = s.node_id WHERE rank <= 10) GROUP BY ALL""",
  "fo AS (SELECT family, node, nbr, row_number() OVER (PARTITION BY family, node ORDER BY max(weight) DESC, nbr) AS rank FROM (SELECT family, src AS node, dst AS nbr, weight FROM edges WHERE src <> dst UNION ALL SELECT family, dst, src, weight FROM edges WHERE src <> dst) GROUP BY family, node, nbr)")
def _(w: Workload) -> DataFrame:
    """First hop: ten neighbours of a seed and family, in order of first appearance (seed, family, rank)."""
    fo = graph.family_order(w.edges).where("rank <= 10")
    j = w.seeds.withColumnRenamed("node_id", "node").join(fo, "node")
    at = F.col("seed_pos") * 1000 + F.when(F.col("family") == "structural", 0).otherwise(100) + F.col("rank")
    return j.groupBy("query_id", F.col("nbr").alias("node_id")).agg(F.min(at).cast("long").alias("place"))


@query("beam_children", """SELECT query_id, src, node_id, k FROM (SELECT f.query_id, f.src, f.dst AS node_id, row_number() OVER (PARTITION BY f.query_id, f.src ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) DESC, f.dst) AS k FROM fresh f JOIN embeddings q ON q.vec_id = f.query_id JOIN embeddings v ON v.vec_id = f.dst) WHERE k <= 3""", EXPAND)
def _(w: Workload) -> DataFrame:
    """Of each seed the three outside neighbours nearest to the query."""
    out = w.seeds.select("query_id", F.col("node_id").alias("src")).join(w.structural.select("src", "dst").distinct(), "src").where("src <> dst").withColumnRenamed("dst", "node_id")
    new = out.join(w.candidates.select(*KEY), KEY, "left_anti").join(w.queries.select("query_id", F.col("vec").alias("q")), "query_id").join(w.vectors.select("node_id", "vec"), "node_id")
    c = F.round(V.cosine("q", "vec"), 6)
    return new.select("query_id", "src", "node_id", F.row_number().over(Window.partitionBy("query_id", "src").orderBy(c.desc(), "node_id")).alias("k")).where("k <= 3")


@query("chain_walk", "SELECT s.query_id, a.rel AS rel_1, b.rel AS rel_2, count(*) AS walks, count(DISTINCT b.dst) AS ends FROM seeds s JOIN structural a ON a.src = s.node_id JOIN structural b ON b.src = a.dst GROUP BY ALL")
def _(w: Workload) -> DataFrame:
    """Typed two-step chains from the seeds: walks and distinct ends of each pair of relations."""
    e = w.structural.select("src", "dst", "rel")
    one = w.seeds.select("query_id", F.col("node_id").alias("src")).join(e, "src").select("query_id", F.col("rel").alias("rel_1"), F.col("dst").alias("src"))
    return one.join(e, "src").groupBy("query_id", "rel_1", F.col("rel").alias("rel_2")).agg(F.count("*").alias("walks"), F.count_distinct("dst").alias("ends"))


# Pools and roles


@query("node_roles", "SELECT coalesce(c.query_id, e.query_id) AS query_id, coalesce(c.node_id, e.node_id) AS node_id, CASE WHEN c.node_id IS NOT NULL THEN 'candidate' ELSE 'context' END AS role FROM candidates c FULL JOIN expansion e ON e.query_id = c.query_id AND e.node_id = c.node_id", EXPAND)
def _(w: Workload) -> DataFrame:
    j = w.candidates.select(*KEY, F.lit(1).alias("c")).join(expansion(w).select(*KEY), KEY, "full")
    return j.select(*KEY, F.when(F.col("c").isNotNull(), "candidate").otherwise("context").alias("role"))


@query("recovery_share", "SELECT count(*) AS missing, count(e.node_id) AS recovered, round(count(e.node_id) / nullif(count(*), 0), 6) AS share FROM (SELECT * FROM golds ANTI JOIN candidates USING (query_id, node_id)) LEFT JOIN expansion e USING (query_id, node_id)", EXPAND)
def _(w: Workload) -> DataFrame:
    m = w.golds.join(w.candidates.select(*KEY), KEY, "left_anti").join(expansion(w).select(*KEY, F.lit(1).alias("e")), KEY, "left")
    return m.agg(F.count("*").alias("missing"), F.count("e").alias("recovered"), F.round(F.try_divide(F.count("e"), F.count("*")), 6).alias("share"))


@query("marginal_recovery", "SELECT n, round(r, 6) AS recall, round(r - lag(r) OVER (ORDER BY n), 6) AS gain FROM (SELECT n, avg(h / g) AS r FROM (SELECT n, query_id, count(*) AS g, count(*) FILTER (rn <= n) AS h FROM golds LEFT JOIN rrf USING (query_id, node_id), (VALUES (5), (10), (20), (50)) t(n) GROUP BY ALL) GROUP BY n)")
def _(w: Workload) -> DataFrame:
    each = found(w).select("g", "ranks", F.explode(F.array(*[F.lit(n) for n in (5, 10, 20, 50)])).alias("n"))
    r = each.groupBy("n").agg(F.avg(F.expr("size(filter(ranks, r -> r <= n))") / F.col("g")).alias("r"))
    return r.select("n", F.round("r", 6).alias("recall"), F.round(F.col("r") - F.lag("r").over(Window.orderBy("n")), 6).alias("gain"))


@query("admitted_overlap", "SELECT query_id, count(*) AS admitted, count(r.node_id) AS inside FROM expansion LEFT JOIN (SELECT * FROM reach WHERE hop <= 2) r USING (query_id, node_id) GROUP BY query_id", EXPAND + ", " + BFS)
def _(w: Workload) -> DataFrame:
    return expansion(w).join(reach(w, 2).select(*KEY, F.lit(1).alias("r")), KEY, "left").groupBy("query_id").agg(F.count("*").alias("admitted"), F.count("r").alias("inside"))


@query("paired_rows", "SELECT query_id, rank, d.score AS dense, s.score AS sparse FROM (SELECT * FROM ranked WHERE source = 'dense') d JOIN (SELECT * FROM ranked WHERE source = 'sparse') s USING (query_id, rank)")
def _(w: Workload) -> DataFrame:
    """Both lists row by row; a row that only one of them has is an error when read."""
    d, s = (w.ranked.where(F.col("source") == x).select("query_id", "rank", F.col("score").alias(x)) for x in ("dense", "sparse"))
    both = F.col("dense").isNotNull() & F.col("sparse").isNotNull()
    return d.join(s, ["query_id", "rank"], "full").select("query_id", "rank", F.when(both, F.col("dense")).otherwise(F.raise_error(F.lit("lists differ")).cast("double")).alias("dense"), "sparse")


@query("restart_a1", "SELECT query_id, node_id, round(sum(m), 9) AS mass FROM (SELECT query_id, node_id, 0.5 / count(*) OVER (PARTITION BY query_id) AS m FROM seeds UNION ALL SELECT query_id, node_id, 0.5 * score / sum(score) OVER (PARTITION BY query_id) FROM rrf) GROUP BY ALL")
def _(w: Workload) -> DataFrame:
    v = Window.partitionBy("query_id")
    a = w.seeds.select(*KEY, (0.5 / F.count("*").over(v)).alias("m"))
    b = w.rrf.select(*KEY, (0.5 * F.col("score") / F.sum("score").over(v)).alias("m"))
    return a.union(b).groupBy(*KEY).agg(F.round(F.sum("m"), 9).alias("mass"))


@query("unranked_last", "SELECT query_id, node_id, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(rd, 1000000), node_id) AS place FROM dsr", DS)
def _(w: Workload) -> DataFrame:
    return dense_sparse(w).select(*KEY, F.row_number().over(fusion.by_query(F.asc_nulls_last("rd"), "node_id")).alias("place"))


@query("top_lists", "SELECT query_id, node_id FROM rrf WHERE rn <= 10")
def _(w: Workload) -> DataFrame:
    """A top-10 report of each query."""
    return w.rrf.where("rn <= 10").select(*KEY)


@query("order_place_columns", "SELECT query_id, node_id, round(CASE WHEN rd IS NULL THEN 1 ELSE ln(rd) / ln(51) END, 6) AS dense_place, round(CASE WHEN rs IS NULL THEN 1 ELSE ln(rs) / ln(51) END, 6) AS sparse_place FROM dsr", DS)
def _(w: Workload) -> DataFrame:
    """Logarithmic places (from 0) over the logarithm of the list's length; 1 where absent."""
    place = lambda c: F.round(F.when(F.col(c).isNull(), 1.0).otherwise(F.log(F.col(c)) / F.log(F.lit(51.0))), 6)
    return dense_sparse(w).select(*KEY, place("rd").alias("dense_place"), place("rs").alias("sparse_place"))


# Statistics and decisions


@query("segment_stats", "SELECT query_id, source, count(*) AS n, round(avg(score), 6) AS mean, max(score) AS top, round(stddev_pop(score), 6) AS sd FROM ranked GROUP BY ALL")
def _(w: Workload) -> DataFrame:
    return w.ranked.groupBy("query_id", "source").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"), F.max("score").alias("top"), F.round(F.stddev_pop("score"), 6).alias("sd"))


@query("present_only_stats", "SELECT query_id, count(rd) AS dense, count(rs) AS sparse, round(avg(rd), 6) AS mean_dense, round(avg(rs), 6) AS mean_sparse FROM dsr GROUP BY query_id", DS)
def _(w: Workload) -> DataFrame:
    return dense_sparse(w).groupBy("query_id").agg(F.count("rd").alias("dense"), F.count("rs").alias("sparse"), F.round(F.avg("rd"), 6).alias("mean_dense"), F.round(F.avg("rs"), 6).alias("mean_sparse"))


@query("distinct_counts", "SELECT count(DISTINCT l_orderkey) AS orders, count(DISTINCT (l_partkey, l_suppkey)) AS pairs FROM lineitem")
def _(w: Workload) -> DataFrame:
    """Two exact distinct counts, each by grouping, so that neither expands the rows of the other."""
    l = w.table("lineitem")  # noqa: E741
    a = l.select("l_orderkey").distinct().agg(F.count("*").alias("orders"))
    b = l.select("l_partkey", "l_suppkey").distinct().agg(F.count("*").alias("pairs"))
    return a.crossJoin(F.broadcast(b))


@query("size_rules", "SELECT query_id, nodes, least(greatest(round_even(nodes * 0.5, 0), 10), 40)::BIGINT AS budget FROM (SELECT query_id, count(*) AS nodes FROM candidates GROUP BY query_id)")
def _(w: Workload) -> DataFrame:
    n = w.candidates.groupBy("query_id").agg(F.count("*").alias("nodes"))
    return n.select("query_id", "nodes", F.least(F.greatest(F.rint(F.col("nodes") * 0.5), F.lit(10.0)), F.lit(40.0)).cast("long").alias("budget"))


@query("macro_recall", "SELECT round(avg(r), 6) AS macro FROM (SELECT split, avg(h5 / g) AS r FROM found JOIN queries USING (query_id) GROUP BY split)", FOUND)
def _(w: Workload) -> DataFrame:
    r = found(w).join(w.queries.select("query_id", "split"), "query_id").groupBy("split").agg(F.avg(metrics.at(5) / F.col("g")).alias("r"))
    return r.agg(F.round(F.avg("r"), 6).alias("macro"))


@query("metrics_l2", "SELECT query_id, round(h5 / greatest(a, 1), 6) AS recall_5 FROM found", FOUND)
def _(w: Workload) -> DataFrame:
    return found(w).select("query_id", F.round(metrics.at(5) / F.greatest("a", F.lit(1)), 6).alias("recall_5"))


@query("full_coverage_ceiling", "SELECT round(avg((a = g AND g <= 5)::INT), 6) AS ceiling_5, round(avg((a = g AND g <= 20)::INT), 6) AS ceiling_20 FROM found", FOUND)
def _(w: Workload) -> DataFrame:
    c = lambda k: F.round(F.avg(((F.col("a") == F.col("g")) & (F.col("g") <= k)).cast("int")), 6)
    return found(w).agg(c(5).alias("ceiling_5"), c(20).alias("ceiling_20"))


@query("knee_rule", "SELECT n, round(r, 6) AS recall FROM curve WHERE r >= 0.9 * (SELECT max(r) FROM curve) ORDER BY n LIMIT 1", "curve AS (SELECT n, avg(h / g) AS r FROM (SELECT n, query_id, count(*) AS g, count(*) FILTER (rn <= n) AS h FROM golds LEFT JOIN rrf USING (query_id, node_id), (VALUES (5), (10), (20), (50), (100)) t(n) GROUP BY ALL) GROUP BY n)")
def _(w: Workload) -> DataFrame:
    """The smallest pool that reaches nine tenths of the best recall."""
    each = found(w).select("g", "ranks", F.explode(F.array(*[F.lit(n) for n in (5, 10, 20, 50, 100)])).alias("n"))
    r = each.groupBy("n").agg(F.avg(F.expr("size(filter(ranks, r -> r <= n))") / F.col("g")).alias("r"))
    return r.withColumn("_top", F.max("r").over(Window.partitionBy())).where("r >= 0.9D * _top").orderBy("n").limit(1).select("n", F.round("r", 6).alias("recall"))


@query("verdicts", "SELECT query_id, CASE WHEN h5 = g THEN 'full' WHEN h5 > 0 THEN 'partial' WHEN a > 0 THEN 'ranked_low' ELSE 'absent' END AS verdict FROM found", FOUND)
def _(w: Workload) -> DataFrame:
    h = metrics.at(5)
    return found(w).select("query_id", F.when(h == F.col("g"), "full").when(h > 0, "partial").when(F.col("a") > 0, "ranked_low").otherwise("absent").alias("verdict"))


@query("evidence_strata", "SELECT query_id, min(coalesce(deg, 0)) AS hardest, CASE WHEN min(coalesce(deg, 0)) = 0 THEN 'isolated' WHEN min(deg) < 3 THEN 'sparse' ELSE 'connected' END AS stratum FROM golds JOIN candidates USING (query_id, node_id) LEFT JOIN (SELECT query_id, a AS node_id, count(*) AS deg FROM (SELECT query_id, src AS a, dst AS b FROM local_edges WHERE src <> dst UNION SELECT query_id, dst, src FROM local_edges WHERE src <> dst) GROUP BY ALL) USING (query_id, node_id) GROUP BY query_id")
def _(w: Workload) -> DataFrame:
    """Queries by the smallest degree, inside the pool's induced graph, of a gold that the pool holds."""
    le = w.local_edges.where("src <> dst").select("query_id", "src", "dst")
    d = le.union(le.select("query_id", "dst", "src")).distinct().groupBy("query_id", F.col("src").alias("node_id")).agg(F.count("*").alias("deg"))
    h = w.golds.join(w.candidates, KEY).join(d, KEY, "left").groupBy("query_id").agg(F.min(F.coalesce("deg", F.lit(0))).alias("hardest"))
    return h.select("query_id", "hardest", F.when(F.col("hardest") == 0, "isolated").when(F.col("hardest") < 3, "sparse").otherwise("connected").alias("stratum"))


@query("gold_ragged", "SELECT query_id, string_agg(node_id::VARCHAR, ',' ORDER BY node_id) AS golds FROM golds GROUP BY query_id")
def _(w: Workload) -> DataFrame:
    return w.golds.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("node_id")), lambda x: x.cast("string")), ",").alias("golds"))


@query("residual_controls", "SELECT query_id, round(sqrt(list_sum(list_transform(list_zip(q.embedding, x.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ** 2))), 6) AS residual FROM anchors a JOIN embeddings q ON q.vec_id = a.query_id JOIN embeddings x ON x.vec_id = a.node_id")
def _(w: Workload) -> DataFrame:
    j = fusion.anchor(w.ranked).join(w.queries.select("query_id", F.col("vec").alias("q")), "query_id").join(w.vectors.select("node_id", "vec"), "node_id")
    return j.select("query_id", F.round(F.sqrt(V.squared_distance("q", "vec")), 6).alias("residual"))


@query("surfaces", "SELECT surface, count(*) AS owners FROM (SELECT p_partkey, unnest([lower(p_name), lower(split_part(p_name, ' ', 1)), lower(p_brand)]) AS surface FROM part) WHERE length(surface) >= 4 GROUP BY surface")
def _(w: Workload) -> DataFrame:
    forms = F.array(F.lower("p_name"), F.lower(F.split_part("p_name", F.lit(" "), F.lit(1))), F.lower("p_brand"))
    return w.table("part").select(F.explode(forms).alias("surface")).where(F.length("surface") >= 4).groupBy("surface").agg(F.count("*").alias("owners"))


@query("word_occurrences", "SELECT doc_id, len(regexp_extract_all(lower(text), '\\bthe\\b')) AS hits, len(regexp_extract_all(text, '[A-Z][a-z]+')) AS capitals, len(regexp_extract_all(text, '[.!?]\\s+[A-Z]')) AS starts FROM documents")
def _(w: Workload) -> DataFrame:
    """Of every document: hits of a bounded word, capitalised words, and capitals that only start a sentence."""
    n = lambda c, p: F.regexp_count(c, F.lit(p)).cast("long")
    return w.table("documents").select("doc_id", n(F.lower("text"), r"\bthe\b").alias("hits"), n("text", "[A-Z][a-z]+").alias("capitals"), n("text", r"[.!?]\s+[A-Z]").alias("starts"))
