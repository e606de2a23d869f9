"""Registered queries: local features on a wider context, the complete static and linear features, and what identifiers say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import graph, stats
from graphloom.plans.feature_queries import KEY, dense_sparse
from graphloom.plans.queries import QUERIES, query  # noqa: F401
from graphloom.plans.wide_queries import COUNTS, LINEAR, QLS, STATIC, local_features, static_features
from graphloom.plans.workload import Workload

# Local features on a wider context

CONTEXT = """ctx AS (SELECT query_id, node_id FROM candidates UNION SELECT query_id, node_id FROM seeds UNION SELECT s.query_id, e.dst FROM seeds s JOIN structural e ON e.src = s.node_id),
ctx_edges AS (SELECT c1.query_id, e.src, e.dst, count(*) AS mult FROM ctx c1 JOIN structural e ON e.src = c1.node_id JOIN ctx c2 ON c2.query_id = c1.query_id AND c2.node_id = e.dst GROUP BY ALL)"""
CONTEXT_QLS = CONTEXT + ", " + QLS.replace("local_edges", "ctx_edges").replace("FROM candidates", "FROM ctx").replace("JOIN candidates", "JOIN ctx")
COLUMNS = (*COUNTS, "ppr")


def features_in(nodes: DataFrame, seeds: DataFrame, local: DataFrame) -> DataFrame:
    """query_id, node_id, four distances and six values of nodes in their own graph local (query_id, src, dst, mult): seed links,
    walks of one to three steps and common neighbours as ln(1 + n) over the query's largest, and the walk's mass."""
    s = seeds.select("query_id", F.col("node_id").alias("seed")).distinct()
    to, out = (local.join(s, (local.query_id == s.query_id) & (local[a] == s.seed)).select(local.query_id, F.col(b).alias("node_id"), "mult") for a, b in (("src", "dst"), ("dst", "src")))
    ahead = to.select("query_id", F.col("node_id").alias("dst")).distinct()
    parts = {
        "seed_connections": to.union(out).groupBy(*KEY).agg(F.sum("mult").alias("seed_connections")),
        "common_neighbours": local.join(ahead, ["query_id", "dst"]).groupBy("query_id", F.col("src").alias("node_id")).agg(F.sum("mult").alias("common_neighbours")),
        "walks": graph.walk_counts(seeds, local, 3).groupBy(*KEY).pivot("length", [1, 2, 3]).agg(F.first("walks")).toDF(*KEY, "paths_1", "paths_2", "paths_3"),
        "hops": graph.bfs(seeds, local.select("query_id", "src", "dst"), 2),
        "ppr": graph.ppr_local(nodes, seeds, local).withColumnRenamed("mass", "ppr"),
    }
    j = nodes.select(*KEY)
    for part in parts.values():
        j = j.join(part, KEY, "left")
    j = j.withColumn("hop", F.coalesce("hop", F.lit(3)))
    share = lambda c: stats.log_share(F.coalesce(F.col(c), F.lit(0)), ["query_id"]).alias(c)
    return j.select(*KEY, *[(F.col("hop") == h).cast("int").alias(f"distance_{h}") for h in range(4)], *[share(c) for c in COUNTS], F.coalesce("ppr", F.lit(0.0)).alias("ppr"))


def in_context(w: Workload) -> DataFrame:
    """The features of candidates whose graph also holds the seeds and the nodes that these lead to."""
    ahead = w.seeds.select("query_id", F.col("node_id").alias("src")).join(w.structural.select("src", "dst"), "src").select("query_id", F.col("dst").alias("node_id"))
    nodes = graph.cut(w.candidates.select(*KEY).union(w.seeds.select(*KEY)).union(ahead).distinct())
    local = graph.cut(graph.induce_subgraph(nodes, w.structural))
    return features_in(nodes, w.seeds, local).join(w.candidates.select(*KEY), KEY)


def shown(df: DataFrame) -> DataFrame:
    return df.select(*KEY, *[f"distance_{h}" for h in range(4)], *[(F.round(c, 6) + 0.0).alias(c) for c in COLUMNS])


SHOWN = "SELECT query_id, node_id, " + ", ".join(f"distance_{h}" for h in range(4)) + ", "


@query("qls_context", SHOWN + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in COLUMNS) + " FROM qls JOIN candidates USING (query_id, node_id)", CONTEXT_QLS)
def _(w: Workload) -> DataFrame:
    """Values over the largest of the whole context."""
    return shown(in_context(w))


@query("qls_context_candidates", SHOWN + ", ".join(f"round(coalesce({c} / nullif(max({c}) OVER (PARTITION BY query_id), 0), 0), 6) + 0.0 AS {c}" for c in COLUMNS) + " FROM qls JOIN candidates USING (query_id, node_id)", CONTEXT_QLS)
def _(w: Workload) -> DataFrame:
    """Values over the largest of the candidates alone, so that nodes nobody scores don't move them."""
    df = in_context(w)
    top = df.groupBy("query_id").agg(*[F.max(c).alias(f"_{c}") for c in COLUMNS])
    return shown(df.join(top, "query_id").select(*KEY, *[f"distance_{h}" for h in range(4)], *[F.coalesce(F.try_divide(c, f"_{c}"), F.lit(0.0)).alias(c) for c in COLUMNS]))


# Complete static and linear features


def complete_static(w: Workload) -> DataFrame:
    """Seven features of each node: the six of static_features and the core number, treated alike."""
    core = graph.coreness(w.vectors.select("node_id"), graph.both_ways(graph.canonical_edges(w.structural))).select("node_id", F.log1p("core").alias("c"))
    m = core.agg(F.avg("c").alias("m"), F.stddev_pop("c").alias("s"))
    z = F.when(F.col("s") > 1e-12, F.least(F.greatest((F.col("c") - F.col("m")) / F.col("s"), F.lit(-5.0)), F.lit(5.0)) / 5).otherwise(0.0)
    return static_features(w).join(core.crossJoin(F.broadcast(m)).select("node_id", z.alias("core_z")), "node_id")  # m: one row


@query("static7")
def _(w: Workload) -> DataFrame:
    return complete_static(w).select("node_id", *[(F.round(c, 5) + 0.0).alias(c) for c in (*STATIC, "core_z")])


@query("linear19")
def _(w: Workload) -> DataFrame:
    """All nineteen inputs of the linear scorer: two of ranks, seven static and ten local ones."""
    pct = lambda c, name: (1 - F.coalesce(c, F.lit(51)) / F.lit(50.0)).alias(name)
    j = dense_sparse(w).select(*KEY, pct("rd", "dense_pct"), pct("rs", "sparse_pct")).join(complete_static(w), "node_id").join(local_features(w), KEY)
    return j.select(*KEY, *[(F.round(F.col(c).cast("double"), 5) + 0.0).alias(c) for c in (*LINEAR, "core_z")])


# What identifiers say


def chain_id() -> Column:
    """An identifier of an order line, in the form of a question's: steps, a number, then what it is made of."""
    return F.concat(F.col("l_linenumber").cast("string"), F.lit("hop"), (F.col("l_suppkey") % 3).cast("string"), F.lit("__"), F.col("l_partkey").cast("string"), F.lit("_"), F.col("l_suppkey").cast("string"))


@query("hop_of", r"SELECT hops, count(*) AS lines, count(DISTINCT parts[1]) AS heads FROM (SELECT regexp_extract(id, '^(\d)hop\d*__', 1)::INT AS hops, string_split(regexp_extract(id, '^\dhop\d*__(.*)$', 1), '_') AS parts FROM (SELECT l_linenumber || 'hop' || (l_suppkey % 3) || '__' || l_partkey || '_' || l_suppkey AS id FROM lineitem)) GROUP BY hops")
def _(w: Workload) -> DataFrame:
    """Order lines by the number of steps in their identifier, and how many first components each number has."""
    d = w.table("lineitem").select(chain_id().alias("id")).select(T.hop_of("id").alias("hops"), T.id_parts("id").alias("parts"))
    return d.groupBy("hops").agg(F.count("*").alias("lines"), F.count_distinct(F.element_at("parts", 1)).alias("heads"))


@query("shared_components", r"SELECT part, count(*) AS lines, min(hops) AS fewest, max(hops) AS most FROM (SELECT regexp_extract(id, '^(\d)hop\d*__', 1)::INT AS hops, unnest(list_distinct(string_split(regexp_extract(id, '^\dhop\d*__(.*)$', 1), '_'))) AS part FROM (SELECT l_linenumber || 'hop' || (l_suppkey % 3) || '__' || l_partkey || '_' || l_suppkey AS id FROM lineitem)) GROUP BY part HAVING count(*) > 1")
def _(w: Workload) -> DataFrame:
    """Components that several identifiers share, which would leak between splits, with the range of their steps."""
    d = w.table("lineitem").select(chain_id().alias("id")).select(T.hop_of("id").alias("hops"), F.explode(F.array_distinct(T.id_parts("id"))).alias("part"))
    return d.groupBy("part").agg(F.count("*").alias("lines"), F.min("hops").alias("fewest"), F.max("hops").alias("most")).where("lines > 1")
