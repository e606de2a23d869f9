"""Registered queries: assembled feature tables, bounded expansion, bridge pools, gates, intervals and vector diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import vectors as V
from graphloom.operators import fusion, graph, metrics, perturb, stats
from graphloom.operators.order import quantiles
from graphloom.operators.spectrum import gram, ranks_of_spectrum
from graphloom.plans.feature_queries import KEY, DS, dense_sparse
from graphloom.plans.more_queries import LOCAL_BFS, chance_sql, local_reach, restart
from graphloom.plans.queries import BFS, BODIES, EXPAND, FOUND, _pagerank_sql, _ppr_sql, expansion, found, query, reach
from graphloom.plans.workload import Workload

# Feature tables

WALKS = """w1 AS (SELECT query_id, dst AS node_id, sum(mult) AS n FROM seeds JOIN local_edges l USING (query_id) WHERE src = node_id GROUP BY query_id, dst),
w2 AS (SELECT l.query_id, l.dst AS node_id, sum(n * mult) AS n FROM w1 JOIN local_edges l ON l.query_id = w1.query_id AND l.src = w1.node_id GROUP BY ALL),
w3 AS (SELECT l.query_id, l.dst AS node_id, sum(n * mult) AS n FROM w2 JOIN local_edges l ON l.query_id = w2.query_id AND l.src = w2.node_id GROUP BY ALL),
conn AS (SELECT query_id, node_id, sum(m) AS n FROM (SELECT l.query_id, l.dst AS node_id, mult AS m FROM local_edges l JOIN seeds s ON s.query_id = l.query_id AND s.node_id = l.src UNION ALL SELECT l.query_id, l.src, mult FROM local_edges l JOIN seeds s ON s.query_id = l.query_id AND s.node_id = l.dst) GROUP BY ALL),
comm AS (SELECT l.query_id, l.src AS node_id, sum(mult) AS n FROM local_edges l JOIN (SELECT DISTINCT e.query_id, e.dst FROM local_edges e JOIN seeds s ON s.query_id = e.query_id AND s.node_id = e.src) o ON o.query_id = l.query_id AND o.dst = l.dst GROUP BY ALL),
mass AS (SELECT query_id, node_id, x / max(x) OVER (PARTITION BY query_id) AS ppr FROM x8)"""
COUNTS = {"seed_connections": "conn", "paths_1": "w1", "paths_2": "w2", "paths_3": "w3", "common_neighbours": "comm"}
QLS = (
    _ppr_sql() + ", " + LOCAL_BFS + ", " + WALKS + ", raw AS (SELECT c.query_id, c.node_id, coalesce(hop, 3) AS hop, " + ", ".join(f"ln(1 + coalesce({t}.n, 0)) AS {c}" for c, t in COUNTS.items()) + ", ppr FROM candidates c LEFT JOIN ldist USING (query_id, node_id) "
    + " ".join(f"LEFT JOIN {t} USING (query_id, node_id)" for t in COUNTS.values()) + " JOIN mass USING (query_id, node_id)), qls AS (SELECT query_id, node_id, " + ", ".join(f"(hop = {h})::INT AS distance_{h}" for h in range(4)) + ", "
    + ", ".join(f"coalesce({c} / nullif(max({c}) OVER (PARTITION BY query_id), 0), 0) AS {c}" for c in COUNTS) + ", ppr FROM raw)"
)


def local_features(w: Workload) -> DataFrame:
    """The ten features of a candidate inside its pool: distance from the seeds as one of four, and seed links, walks of one
    to three steps and common neighbours as ln(1 + n) over the query's largest, and the walk's mass."""
    out = w.candidates.select(*KEY).join(local_reach(w), KEY, "left").withColumn("hop", F.coalesce("hop", F.lit(3)))
    walks = graph.walk_counts(w.seeds, w.local_edges, 3).groupBy(*KEY).pivot("length", [1, 2, 3]).agg(F.first("walks")).toDF(*KEY, "paths_1", "paths_2", "paths_3")
    counts = BODIES["seed_connections"](w).withColumnRenamed("conn", "seed_connections"), walks, BODIES["common_neighbours"](w).withColumnRenamed("common", "common_neighbours")
    for part in counts:
        out = out.join(part, KEY, "left")
    out = out.join(graph.ppr_local(w.candidates, w.seeds, w.local_edges).withColumnRenamed("mass", "ppr"), KEY)
    share = lambda c: stats.log_share(F.coalesce(F.col(c), F.lit(0)), ["query_id"]).alias(c)
    return out.select(*KEY, *[(F.col("hop") == h).cast("int").alias(f"distance_{h}") for h in range(4)], *[share(c) for c in COUNTS], "ppr")


@query("qls10", "SELECT query_id, node_id, " + ", ".join(f"distance_{h}" for h in range(4)) + ", " + ", ".join(f"round({c}, 6) AS {c}" for c in (*COUNTS, "ppr")) + " FROM qls", QLS)
def _(w: Workload) -> DataFrame:
    q = local_features(w)
    return q.select(*KEY, *[f"distance_{h}" for h in range(4)], *[F.round(c, 6).alias(c) for c in (*COUNTS, "ppr")])


DISTANCE = "(distance_0 + distance_1 * 2 / 3.0::DOUBLE + distance_2 / 3.0::DOUBLE)"
PATH = "(" + " + ".join(COUNTS) + ")"


@query("fixed_structural_scores", f"SELECT query_id, node_id, round({DISTANCE}, 6) AS distance, round(ppr, 6) AS ppr, round({PATH} / 5, 6) AS path, round(({DISTANCE} + {PATH} + ppr) / 7, 6) AS summary FROM qls", QLS)
def _(w: Workload) -> DataFrame:
    """Distance, walk mass, the mean of the five connection features and the mean of all seven."""
    distance = F.col("distance_0") + F.col("distance_1") * 2 / F.lit(3.0) + F.col("distance_2") / F.lit(3.0)
    path = sum((F.col(c) for c in COUNTS), F.lit(0.0))
    r = lambda x, name: F.round(x, 6).alias(name)
    return local_features(w).select(*KEY, r(distance, "distance"), r(F.col("ppr"), "ppr"), r(path / 5, "path"), r((distance + path + F.col("ppr")) / 7, "summary"))


STATIC = {"out_z": "ln(1 + o)", "in_z": "ln(1 + i)", "degree_z": "ln(1 + o + i)", "rank_z": "ln(1 + n * x / s)", "hub_z": "pct", "closed_z": "cl"}
STATIC_SQL = (
    _pagerank_sql() + """, io AS (SELECT vec_id AS node_id, coalesce(a.c, 0) AS o, coalesce(b.c, 0) AS i FROM embeddings LEFT JOIN (SELECT src, count(*) AS c FROM structural GROUP BY src) a ON a.src = vec_id LEFT JOIN (SELECT dst, count(*) AS c FROM structural GROUP BY dst) b ON b.dst = vec_id),
tri AS (SELECT x.src AS node_id, count(*) AS t FROM both_ways x JOIN both_ways y ON y.src = x.src AND y.family = 'structural' AND x.dst < y.dst JOIN und u ON u.family = 'structural' AND u.a = x.dst AND u.b = y.dst WHERE x.family = 'structural' GROUP BY x.src),
st0 AS (SELECT node_id, io.o AS o, io.i AS i, n, x, (SELECT sum(x) FROM p5) AS s, cume_dist() OVER (ORDER BY deg) AS pct, CASE WHEN deg > 1 THEN coalesce(t, 0) / (deg * (deg - 1) / 2.0::DOUBLE) ELSE 0 END AS cl FROM io JOIN p5 USING (node_id) JOIN degree USING (node_id) LEFT JOIN tri USING (node_id)),
st1 AS (SELECT node_id, """ + ", ".join(f"{e} AS {c}" for c, e in STATIC.items()) + " FROM st0), statics AS (SELECT node_id, "
    + ", ".join(f"CASE WHEN stddev_pop({c}) OVER () > 1e-12 THEN least(greatest(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), -5), 5) / 5 ELSE 0 END AS {c}" for c in STATIC) + " FROM st1)"
)


def static_features(w: Workload) -> DataFrame:
    """Six features of each node (the core number is its own query): degrees, PageRank, hub percentile and clustering,
    standardised over all nodes, clipped at five deviations and divided by five."""
    d = stats.degree_table(w.structural, w.vectors)
    hub = BODIES["hub_percentile"](w)
    closed = BODIES["clustering"](w).select("node_id", F.coalesce(F.try_divide("closed", "wedges"), F.lit(0.0)).alias("cl"))
    n = w.vectors.agg(F.count("*").alias("n"))
    j = d.join(graph.pagerank(w.vectors, w.structural), "node_id").join(hub, "node_id").join(closed, "node_id").crossJoin(F.broadcast(n))  # n: one row
    raw = graph.cut(j.select("node_id", F.log1p("out_deg").alias("out_z"), F.log1p("in_deg").alias("in_z"), F.log1p("deg").alias("degree_z"), F.log1p(F.col("n") * F.col("rank")).alias("rank_z"), F.col("pct").alias("hub_z"), F.col("cl").alias("closed_z")))
    m = raw.agg(*[f(c).alias(f"{p}_{c}") for c in STATIC for p, f in (("mu", F.avg), ("sd", F.stddev_pop))])
    z = lambda c: F.when(F.col(f"sd_{c}") > 1e-12, F.least(F.greatest((F.col(c) - F.col(f"mu_{c}")) / F.col(f"sd_{c}"), F.lit(-5.0)), F.lit(5.0)) / 5).otherwise(0.0).alias(c)
    return raw.crossJoin(F.broadcast(m)).select("node_id", *map(z, STATIC))  # m: one row


@query("static_features", "SELECT node_id, " + ", ".join(f"round({c}, 5) + 0.0 AS {c}" for c in STATIC) + " FROM statics", STATIC_SQL)
def _(w: Workload) -> DataFrame:
    return static_features(w).select("node_id", *[(F.round(c, 5) + 0.0).alias(c) for c in STATIC])


RANKS = {"dense_pct": "1 - coalesce(rd, 51) / 50.0::DOUBLE", "sparse_pct": "1 - coalesce(rs, 51) / 50.0::DOUBLE"}
LINEAR = [*RANKS, *STATIC, *[f"distance_{h}" for h in range(4)], *COUNTS, "ppr"]


@query("linear_features", "SELECT query_id, node_id, round(" + " + ".join(f"{i + 1} * {c}" for i, c in enumerate(LINEAR)) + ", 4) + 0.0 AS score, " + ", ".join(f"round({c}, 5) + 0.0 AS {c}" for c in LINEAR) + " FROM (SELECT query_id, node_id, " + ", ".join(f"{e} AS {c}" for c, e in RANKS.items()) + " FROM dsr) JOIN statics USING (node_id) JOIN qls USING (query_id, node_id)", DS + ", " + QLS + ", " + STATIC_SQL)
def _(w: Workload) -> DataFrame:
    """The scorer's input: two rank, six static and ten local features of each candidate, and a linear score with given
    weights (1, 2, 3 and so on)."""
    pct = lambda c, name: (1 - F.coalesce(c, F.lit(51)) / F.lit(50.0)).alias(name)
    j = dense_sparse(w).select(*KEY, pct("rd", "dense_pct"), pct("rs", "sparse_pct")).join(static_features(w), "node_id").join(local_features(w), KEY)
    score = sum(((i + 1) * F.col(c) for i, c in enumerate(LINEAR)), F.lit(0.0))
    return j.select(*KEY, (F.round(score, 4) + 0.0).alias("score"), *[(F.round(F.col(c).cast("double"), 5) + 0.0).alias(c) for c in LINEAR])


# Expansion and walks

FAMILY = "fo AS (SELECT family, node, nbr, row_number() OVER (PARTITION BY family, node ORDER BY max(weight) DESC, nbr) AS rank FROM (SELECT family, src AS node, dst AS nbr, weight FROM edges WHERE src <> dst UNION ALL SELECT family, dst, src, weight FROM edges WHERE src <> dst) GROUP BY family, node, nbr)"


@query("expand_frontier", """SELECT query_id, node_id, 1 AS hop, place FROM h1 UNION ALL SELECT query_id, node_id, 2, row_number() OVER (PARTITION BY query_id ORDER BY fa) FROM (
  SELECT h.query_id, nbr AS node_id, min((place, family <> 'structural', rank)) AS fa FROM h1 h JOIN fo f ON f.node = h.node_id WHERE place <= 20 AND rank <= 5 AND NOT EXISTS (SELECT 1 FROM seeds s WHERE s.query_id = h.query_id AND s.node_id = nbr) AND NOT EXISTS (SELECT 1 FROM h1 o WHERE o.query_id = h.query_id AND o.node_id = nbr) GROUP BY ALL)""",
  FAMILY + """, h1 AS (SELECT query_id, node_id, row_number() OVER (PARTITION BY query_id ORDER BY fa) AS place FROM (
  SELECT s.query_id, nbr AS node_id, min((seed_pos, family <> 'structural', rank)) AS fa FROM seeds s JOIN fo f ON f.node = s.node_id WHERE rank <= 10 AND NOT EXISTS (SELECT 1 FROM seeds t WHERE t.query_id = s.query_id AND t.node_id = nbr) GROUP BY ALL))""")
def _(w: Workload) -> DataFrame:
    """Two bounded hops over both families in order of first appearance: ten neighbours of each seed and family, then five
    of each of the first twenty nodes found; visited nodes don't appear again."""
    return graph.expand_frontier(w.seeds.withColumnRenamed("seed_pos", "place"), graph.family_order(w.edges), first=10, each=5, frontier=20, hops=2)


def _mass_sql() -> str:
    parts = ["sm AS (SELECT src, dst, count(*)::DOUBLE AS m FROM structural GROUP BY ALL)", "fw AS (SELECT src, dst, m / sum(m) OVER (PARTITION BY src) AS p FROM sm)", "bw AS (SELECT dst AS src, src AS dst, m / sum(m) OVER (PARTITION BY dst) AS p FROM sm)", "s0 AS (SELECT query_id, node_id, 1.0::DOUBLE / count(*) OVER (PARTITION BY query_id) AS x FROM seeds)"]
    for d in ("fw", "bw"):
        for h in (1, 2, 3):
            prior = "s0" if h == 1 else f"{d}{h - 1}"
            parts.append(f"{d}{h} AS (SELECT query_id, t.dst AS node_id, sum(x * p) AS x FROM {prior} JOIN {d} t ON t.src = node_id GROUP BY ALL)")
    return ", ".join(parts)


@query("hub_walks", " UNION ALL ".join(f"SELECT query_id, node_id, '{n}' AS direction, {h} AS hop, round(x, 7) AS mass FROM {d}{h}" for d, n in (("fw", "forward"), ("bw", "backward")) for h in (1, 2, 3)), _mass_sql())
def _(w: Workload) -> DataFrame:
    """Mass that walks from the seeds carry along stored edges and against them, shared by the edges of a node."""
    s = w.seeds.select(*KEY, (1 / F.count("*").over(Window.partitionBy("query_id"))).alias("x"))
    m = w.structural.groupBy("src", "dst").agg(F.count("*").cast("double").alias("m"))
    out = None
    for name, links in (("forward", m), ("backward", m.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "m"))):
        part = graph.mass_walks(s, links, 3).select(*KEY, F.lit(name).alias("direction"), "hop", F.round("x", 7).alias("mass"))
        out = part if out is None else out.unionByName(part)
    return out


RINGS = """ur AS (SELECT query_id, src AS a, dst AS b FROM local_edges WHERE src <> dst UNION SELECT query_id, dst, src FROM local_edges WHERE src <> dst),
r2 AS (SELECT DISTINCT x.query_id, x.a, y.b FROM ur x JOIN ur y ON y.query_id = x.query_id AND y.a = x.b WHERE x.a <> y.b EXCEPT SELECT * FROM ur),
r3 AS (SELECT DISTINCT x.query_id, x.a, y.b FROM r2 x JOIN ur y ON y.query_id = x.query_id AND y.a = x.b WHERE x.a <> y.b EXCEPT (SELECT * FROM ur UNION SELECT * FROM r2))"""


@query("distance_rings", "SELECT query_id, a AS src, b AS dst, d AS distance FROM (SELECT *, 1 AS d FROM ur UNION ALL SELECT *, 2 FROM r2 UNION ALL SELECT *, 3 FROM r3)", RINGS)
def _(w: Workload) -> DataFrame:
    """Pairs of candidates at exactly one, two and three undirected links inside the pool."""
    return graph.rings(w.local_edges)


@query("regime_walk", "SELECT query_id, node_id, round(x, 7) AS mass FROM f40", ", ".join(
    ["trf AS (SELECT src, dst, x / sum(x) OVER (PARTITION BY src) AS p FROM (SELECT src, dst, sum(weight) AS x FROM (SELECT src, dst, weight FROM edges WHERE src <> dst AND family = 'ner' UNION ALL SELECT dst, src, weight FROM edges WHERE src <> dst AND family = 'ner') GROUP BY ALL))",
     "f0 AS (SELECT query_id, node_id, 1.0::DOUBLE / count(*) OVER (PARTITION BY query_id) AS x FROM seeds)"]
    + [f"f{i} AS MATERIALIZED (SELECT query_id, node_id, sum(x) AS x FROM (SELECT query_id, node_id, 0.5 * x AS x FROM f0 UNION ALL SELECT query_id, dst, 0.5 * x * p FROM f{i - 1} JOIN trf ON src = node_id UNION ALL SELECT query_id, node_id, 0.5 * x FROM f{i - 1} ANTI JOIN trf ON src = node_id) GROUP BY ALL)" for i in range(1, 41)]))
def _(w: Workload) -> DataFrame:
    """The restart walk over one family alone."""
    return restart(w, families=("ner",), digits=7).select(*KEY, F.col("x").alias("mass"))


def _push(w: Workload, start: DataFrame, eps: float = 1e-3) -> DataFrame:
    e = w.edges.where("src <> dst")
    m = e.select("src", "dst", "weight").union(e.select("dst", "src", "weight")).groupBy("src", "dst").agg(F.sum("weight").alias("x"))
    return graph.ppr_push(start, m.select("src", "dst", (F.col("x") / F.sum("x").over(Window.partitionBy("src"))).alias("p")), alpha=0.5, eps=eps)


@query("ppr_push")
def _(w: Workload) -> DataFrame:
    """Push from the seeds, frontier by frontier; what it leaves has no SQL form, so tests compare it with the exact walk."""
    s = w.seeds.select(*KEY, (1 / F.count("*").over(Window.partitionBy("query_id"))).alias("x"))
    return _push(w, s).select(*KEY, F.round("x", 7).alias("mass"))


@query("ppr_push_weighted")
def _(w: Workload) -> DataFrame:
    """The same with half of the restart on the seeds and half on fused scores."""
    return _push(w, BODIES["restart_a1"](w).withColumnRenamed("mass", "x")).select(*KEY, F.round("x", 7).alias("mass"))


@query("restart_a0", "SELECT query_id, node_id, round(1.0 / count(*) OVER (PARTITION BY query_id), 9) AS mass FROM seeds")
def _(w: Workload) -> DataFrame:
    return w.seeds.select(*KEY, F.round(1 / F.count("*").over(Window.partitionBy("query_id")), 9).alias("mass"))


@query("oracle_exposure", "SELECT query_id, round(count(*) FILTER (hop <= 1) / count(*), 6) AS within_1, round(count(*) FILTER (hop <= 2) / count(*), 6) AS within_2 FROM golds LEFT JOIN reach USING (query_id, node_id) GROUP BY query_id", BFS)
def _(w: Workload) -> DataFrame:
    """Share of a query's golds that one and two links from the seeds reach."""
    j = w.golds.join(reach(w, 2), KEY, "left")
    share = lambda h: F.round(F.count(F.when(F.col("hop") <= h, 1)) / F.count("*"), 6).alias(f"within_{h}")
    return j.groupBy("query_id").agg(share(1), share(2))


@query("add_random_edges", f"""SELECT src, dst FROM (SELECT *, row_number() OVER (ORDER BY i) AS k FROM (SELECT a.node_id AS src, b.node_id AS dst, min(i) AS i, any_value(want) AS want FROM tries JOIN ids a ON a.at = p JOIN ids b ON b.at = q WHERE a.node_id <> b.node_id GROUP BY ALL) t
  WHERE NOT EXISTS (SELECT 1 FROM structural e WHERE e.src = t.src AND e.dst = t.dst)) WHERE k <= want""",
  f"""ids AS (SELECT vec_id AS node_id, row_number() OVER (ORDER BY vec_id) - 1 AS at FROM embeddings), want AS (SELECT round_even(count(*) * 0.1, 0)::BIGINT AS want FROM structural),
tries AS (SELECT want, i, floor({chance_sql('i', 'p1a')} * n)::BIGINT AS p, floor({chance_sql('i', 'p1b')} * n)::BIGINT AS q FROM want, nn, range(1, 100000000) t(i) WHERE i <= 2 * want)""")
def _(w: Workload) -> DataFrame:
    """A tenth more edges, at hashed places."""
    return perturb.add_random_edges(w.structural, w.vectors, 0.1, "p1")


# Pools, gates and rules


@query("bridge_slots", """SELECT query_id, node_id, rn AS slot FROM rrf WHERE rn <= 3 UNION ALL SELECT query_id, node_id, 3 + row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, rn, node_id) FROM (
  SELECT t.query_id, b.dst AS node_id, round(max(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[])), 6) AS cos, coalesce(any_value(o.rn), 1000000000) AS rn FROM rrf t JOIN both_ways b ON b.src = t.node_id AND b.family = 'structural' JOIN embeddings q ON q.vec_id = t.query_id JOIN embeddings v ON v.vec_id = b.dst LEFT JOIN rrf o ON o.query_id = t.query_id AND o.node_id = b.dst
  WHERE t.rn <= 3 AND coalesce(o.rn, 4) > 3 GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, rn, node_id) <= 2""")
def _(w: Workload) -> DataFrame:
    """The first three of the fused list, and in slots four and five the neighbours of them nearest to the query; ties by
    the list's order, then by id."""
    top = w.rrf.where("rn <= 3").select(*KEY, F.col("rn").alias("slot"))
    b = graph.both_ways(graph.canonical_edges(w.structural))
    near = top.select("query_id", F.col("node_id").alias("src")).join(b, "src").select("query_id", F.col("dst").alias("node_id")).distinct().join(top, KEY, "left_anti")
    j = near.join(w.queries.select("query_id", F.col("vec").alias("q")), "query_id").join(w.vectors.select("node_id", "vec"), "node_id").join(w.rrf.select(*KEY, "rn"), KEY, "left")
    scored = j.select(*KEY, F.round(V.cosine("q", "vec"), 6).alias("cos"), F.coalesce("rn", F.lit(1_000_000_000)).alias("rn"))
    filled = scored.withColumn("k", F.row_number().over(fusion.by_query(F.desc("cos"), "rn", "node_id"))).where("k <= 2")
    return top.unionByName(filled.select(*KEY, (F.col("k") + 3).alias("slot")))


@query("bridge_pool", """SELECT query_id, node_id, 'list' AS part FROM rrf WHERE rn <= 20 UNION ALL SELECT query_id, node_id, 'bridge' FROM br WHERE k <= 10 UNION ALL
  SELECT r.query_id, r.node_id, 'fill' FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rn) AS k FROM rrf WHERE rn > 20 AND NOT EXISTS (SELECT 1 FROM br WHERE br.query_id = rrf.query_id AND br.node_id = rrf.node_id AND br.k <= 10)) r LEFT JOIN (SELECT query_id, least(count(*), 10) AS had FROM br GROUP BY query_id) USING (query_id) WHERE r.k <= 10 - coalesce(had, 0)""",
  """br AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY touching DESC, coalesce(rn, 1000000000), node_id) AS k FROM (SELECT t.query_id, b.dst AS node_id, count(DISTINCT t.node_id) AS touching FROM rrf t JOIN both_ways b ON b.src = t.node_id AND b.family = 'structural' WHERE t.rn <= 10 GROUP BY ALL) n LEFT JOIN rrf USING (query_id, node_id) WHERE coalesce(rn, 21) > 20)""")
def _(w: Workload) -> DataFrame:
    """Twenty of the list, ten bridges (most links to the first ten, then the list's order, then id), and more of the list
    where there are fewer bridges."""
    b = graph.both_ways(graph.canonical_edges(w.structural))
    touching = w.rrf.where("rn <= 10").select("query_id", F.col("node_id").alias("src")).join(b, "src").groupBy("query_id", F.col("dst").alias("node_id")).agg(F.count_distinct("src").alias("touching"))
    order = w.rrf.select(*KEY, "rn")
    bridges = touching.join(order, KEY, "left").where("coalesce(rn, 21) > 20").withColumn("k", F.row_number().over(fusion.by_query(F.desc("touching"), F.coalesce("rn", F.lit(1_000_000_000)), "node_id"))).where("k <= 10").select(*KEY)
    had = bridges.groupBy("query_id").agg(F.count("*").alias("had"))
    rest = order.where("rn > 20").join(bridges, KEY, "left_anti").withColumn("k", F.row_number().over(fusion.by_query("rn")))
    fill = rest.join(had, "query_id", "left").where(F.col("k") <= 10 - F.coalesce("had", F.lit(0)))
    named = lambda df, n: df.select(*KEY, F.lit(n).alias("part"))
    return named(order.where("rn <= 20"), "list").union(named(bridges, "bridge")).union(named(fill, "fill"))


@query("gated_extra", "SELECT query_id, node_id, 'pool' AS part FROM candidates UNION ALL SELECT query_id, node_id, 'extra' FROM expansion SEMI JOIN gate USING (query_id)", EXPAND + ", gate AS (SELECT query_id FROM ranked WHERE source = 'dense' GROUP BY query_id HAVING round(max(score) FILTER (rank = 1) - max(score) FILTER (rank = 2), 6) < 0.05)")
def _(w: Workload) -> DataFrame:
    """The expansion only for queries whose two best dense scores lie within 0.05."""
    top = lambda r: F.max(F.when(F.col("rank") == r, F.col("score")))
    gate = w.ranked.where("source = 'dense'").groupBy("query_id").agg(F.round(top(1) - top(2), 6).alias("margin")).where("margin < 0.05").select("query_id")
    named = lambda df, n: df.select(*KEY, F.lit(n).alias("part"))
    return named(w.candidates, "pool").union(named(expansion(w).join(gate, "query_id", "left_semi"), "extra"))


@query("candidate_grid", """SELECT fill, extra, count(*) AS queries, round(avg(size), 6) AS size, round(avg(h / g), 6) AS recall FROM (SELECT fill, extra, query_id, (SELECT count(*) FROM golds o WHERE o.query_id = p.query_id) AS g, count(*) AS size, count(gg.node_id) AS h FROM (
  SELECT DISTINCT fill, extra, query_id, node_id FROM (SELECT fill, extra, query_id, node_id FROM rrf, (VALUES (0.25::DOUBLE), (0.5), (0.75), (1.0)) f(fill), (VALUES ('none'), ('expansion')) x(extra) WHERE rn <= floor(fill * 80) UNION ALL SELECT fill, 'expansion', query_id, node_id FROM expansion, (VALUES (0.25::DOUBLE), (0.5), (0.75), (1.0)) f(fill))) p LEFT JOIN golds gg USING (query_id, node_id) GROUP BY fill, extra, query_id) GROUP BY fill, extra""", EXPAND)
def _(w: Workload) -> DataFrame:
    """Pools by the share of 80 list places they fill and by what they add: mean size and recall of each."""
    fills = F.explode(F.array(*[F.lit(x) for x in (0.25, 0.5, 0.75, 1.0)])).alias("fill")
    base = w.rrf.select(*KEY, "rn", fills).where("rn <= floor(fill * 80)").select("fill", F.explode(F.array(F.lit("none"), F.lit("expansion"))).alias("extra"), *KEY)
    pools = base.union(expansion(w).select(fills, F.lit("expansion").alias("extra"), *KEY).select("fill", "extra", *KEY)).distinct()
    g = w.golds.groupBy("query_id").agg(F.count("*").alias("g"))
    j = pools.join(w.golds.withColumn("_g", F.lit(1)), KEY, "left").groupBy("fill", "extra", "query_id").agg(F.count("*").alias("size"), F.count("_g").alias("h")).join(g, "query_id")
    return j.groupBy("fill", "extra").agg(F.count("*").alias("queries"), F.round(F.avg("size"), 6).alias("size"), F.round(F.avg(F.col("h") / F.col("g")), 6).alias("recall"))


POOLS = {"dense_20": ("ranked", "source = 'dense' AND rank <= 20"), "sparse_20": ("ranked", "source = 'sparse' AND rank <= 20"), "union": ("candidates", "true"), "fused_30": ("rrf", "rn <= 30")}


@query("base_pools", " UNION ALL ".join(f"SELECT '{n}' AS pool, query_id, count(*) AS size, count(g.node_id) AS golds FROM (SELECT query_id, node_id FROM {t} WHERE {c}) p LEFT JOIN golds g USING (query_id, node_id) GROUP BY query_id" for n, (t, c) in POOLS.items()))
def _(w: Workload) -> DataFrame:
    """Pools by name: size and golds held, for each query."""
    named = [getattr(w, t).where(c).select(F.lit(n).alias("pool"), *KEY) for n, (t, c) in POOLS.items()]
    rows = named[0].union(named[1]).union(named[2]).union(named[3])
    return rows.join(w.golds.withColumn("_g", F.lit(1)), KEY, "left").groupBy("pool", "query_id").agg(F.count("*").alias("size"), F.count("_g").alias("golds"))


@query("size_rules_all", """SELECT query_id, 30 AS fix, CASE split WHEN 'train' THEN 20 WHEN 'validation' THEN 30 ELSE 40 END AS kind, least(greatest(nodes, 10), 60) AS nuc, least(greatest(round_even(pow(2.0::DOUBLE, h), 0), 10), 60)::BIGINT AS ppl, pool AS today FROM queries
  JOIN (SELECT query_id, min(n) AS nodes FROM (SELECT query_id, row_number() OVER v AS n, sum(score) OVER (v ROWS UNBOUNDED PRECEDING) AS run, sum(score) OVER (PARTITION BY query_id) AS total FROM rrf WINDOW v AS (PARTITION BY query_id ORDER BY score DESC, node_id)) WHERE run >= 0.5 * total * (1 - 1e-9) GROUP BY query_id) USING (query_id)
  JOIN (SELECT query_id, sum(-p * log2(p)) AS h, count(*) AS pool FROM (SELECT query_id, score / sum(score) OVER (PARTITION BY query_id) AS p FROM rrf) GROUP BY query_id) USING (query_id)""")
def _(w: Workload) -> DataFrame:
    """Pool sizes by five rules: fixed, by kind of query, by half of the score mass, by perplexity, and as it is."""
    p = w.rrf.select("query_id", (F.col("score") / F.sum("score").over(Window.partitionBy("query_id"))).alias("p"))
    h = p.groupBy("query_id").agg(F.sum(-F.col("p") * F.log2("p")).alias("h"), F.count("*").alias("today"))
    kind = F.when(F.col("split") == "train", 20).when(F.col("split") == "validation", 30).otherwise(40)
    clip = lambda c: F.least(F.greatest(c, F.lit(10)), F.lit(60)).cast("long")
    j = w.queries.join(stats.nucleus(w.rrf, ["query_id"], "score", "node_id", 0.5), "query_id").join(h, "query_id")
    return j.select("query_id", F.lit(30).alias("fix"), kind.alias("kind"), clip(F.col("nodes")).alias("nuc"), clip(F.rint(F.pow(F.lit(2.0), F.col("h")))).alias("ppl"), "today")


@query("crossover_rates", """SELECT w AS rate FROM (SELECT *, lag(gap) OVER v AS b, lead(gap) OVER v AS a, row_number() OVER v AS i, count(*) OVER () AS n, count(*) FILTER (gap = 0) OVER () AS zeros FROM gaps WINDOW v AS (ORDER BY w))
  WHERE i IN (1, n) OR (zeros > 0 AND (gap = 0 OR a = 0 OR b = 0)) OR (zeros = 0 AND (gap * a < 0 OR gap * b < 0))""",
  """wx AS (SELECT *, row_number() OVER (PARTITION BY query_id, w ORDER BY score DESC, node_id) AS rn FROM (SELECT query_id, w, node_id, round(sum(CASE source WHEN 'dense' THEN w ELSE 1 - w END / (60 + rank)), 9) AS score FROM ranked, (VALUES (0.0::DOUBLE), (0.1), (0.2), (0.3), (0.5), (0.7), (0.9), (1.0)) t(w) GROUP BY ALL)),
gaps AS (SELECT w, round(avg(h / g) - avg(hs / g), 6) AS gap FROM (SELECT w, query_id, count(*) AS g, count(*) FILTER (rn <= 5) AS h, count(*) FILTER (rs <= 5) AS hs FROM golds CROSS JOIN (VALUES (0.0::DOUBLE), (0.1), (0.2), (0.3), (0.5), (0.7), (0.9), (1.0)) t(w) LEFT JOIN wx USING (query_id, node_id, w) LEFT JOIN (SELECT query_id, node_id, rank AS rs FROM ranked WHERE source = 'dense') USING (query_id, node_id) GROUP BY ALL) GROUP BY w)""")
def _(w: Workload) -> DataFrame:
    """Fusion weights at which fused recall crosses the dense list's: both ends, exact zeros with their neighbours, or
    where there is none the two sides of each change of sign."""
    grid = [0.0, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9, 1.0]
    size = w.golds.groupBy("query_id").agg(F.count("*").alias("g"))
    h = fusion.rrf_weights(w.ranked, grid).where("rn <= 5").join(w.golds, KEY).groupBy("query_id", "w").agg(F.count("*").alias("h"))
    d = w.ranked.where("source = 'dense' and rank <= 5").join(w.golds, KEY).groupBy("query_id").agg(F.count("*").alias("hs"))
    each = size.select("query_id", "g", F.explode(F.array(*[F.lit(x) for x in grid])).alias("w")).join(h, ["query_id", "w"], "left").join(d, "query_id", "left")
    share = lambda c: F.avg(F.coalesce(c, F.lit(0)) / F.col("g"))
    gaps = each.groupBy("w").agg(F.round(share("h") - share("hs"), 6).alias("gap"))
    return metrics.crossovers(gaps.withColumnRenamed("w", "rate"))


@query("rank_pool_order_tie", "SELECT query_id, node_id, row_number() OVER (PARTITION BY query_id ORDER BY links DESC, pos) AS place FROM (SELECT query_id, node_id, pos, coalesce(k, 0) AS links FROM candidates LEFT JOIN (SELECT query_id, dst AS node_id, sum(mult) AS k FROM local_edges GROUP BY ALL) USING (query_id, node_id))")
def _(w: Workload) -> DataFrame:
    k = w.local_edges.groupBy("query_id", F.col("dst").alias("node_id")).agg(F.sum("mult").alias("k"))
    j = w.candidates.join(k, KEY, "left")
    return j.select(*KEY, F.row_number().over(fusion.by_query(F.desc(F.coalesce("k", F.lit(0))), "pos")).alias("place"))


@query("r3_bounded_context", "SELECT query_id, node_id, max(c)::INT AS candidate FROM (SELECT query_id, node_id, 1 AS c FROM candidates UNION ALL SELECT query_id, node_id, 0 FROM reach WHERE hop <= 2 UNION ALL SELECT query_id, node_id, 1 FROM expansion WHERE pos <= 64) GROUP BY ALL", EXPAND + ", " + BFS)
def _(w: Workload) -> DataFrame:
    """Context of two hops and the first 64 of the expansion; candidates are the pool and those 64."""
    part = lambda df, c: df.select(*KEY, F.lit(c).alias("c"))
    rows = part(w.candidates, 1).union(part(reach(w, 2), 0)).union(part(expansion(w).where("pos <= 64"), 1))
    return rows.groupBy(*KEY).agg(F.max("c").alias("candidate"))


@query("balanced_draws", f"SELECT query_id, split FROM (SELECT query_id, split, row_number() OVER (PARTITION BY split ORDER BY {chance_sql('query_id', 'b1')}, query_id) AS k, (SELECT min(c) FROM (SELECT count(*) AS c FROM queries GROUP BY split)) AS least FROM queries) WHERE k <= least")
def _(w: Workload) -> DataFrame:
    """As many queries of each split as the smallest has, by seeded hash without replacement (a sampling operator)."""
    least = w.queries.groupBy("split").agg(F.count("*").alias("c")).agg(F.min("c").alias("least"))
    k = w.queries.withColumn("k", F.row_number().over(Window.partitionBy("split").orderBy(perturb.chance(F.col("query_id"), "b1"), "query_id")))
    return k.crossJoin(F.broadcast(least)).where("k <= least").select("query_id", "split")  # least: one row


@query("sample_rows", f"SELECT doc_id FROM documents ORDER BY {chance_sql('doc_id', 's2')}, doc_id LIMIT 100")
def _(w: Workload) -> DataFrame:
    """A hundred documents, first in the order of a seeded hash (a sampling operator)."""
    return w.table("documents").orderBy(perturb.chance(F.col("doc_id"), "s2"), "doc_id").limit(100).select("doc_id")


@query("node_alignment", "SELECT v IS NOT NULL AS in_vectors, c IS NOT NULL AS in_typed, p IS NOT NULL AS in_weighted, count(*) AS nodes FROM (SELECT vec_id AS k, 1 AS v FROM embeddings) FULL JOIN (SELECT DISTINCT k, 1 AS c FROM (SELECT src AS k FROM structural UNION ALL SELECT dst FROM structural)) USING (k) FULL JOIN (SELECT DISTINCT k, 1 AS p FROM (SELECT src AS k FROM edges WHERE family = 'ner' UNION ALL SELECT dst FROM edges WHERE family = 'ner')) USING (k) GROUP BY ALL")
def _(w: Workload) -> DataFrame:
    """Nodes by the id spaces that know them."""
    ends = lambda f: w.edges.where(F.col("family") == f).select(F.explode(F.array("src", "dst")).alias("k")).distinct()
    j = w.vectors.select(F.col("node_id").alias("k"), F.lit(1).alias("v")).join(ends("structural").withColumn("c", F.lit(1)), "k", "full").join(ends("ner").withColumn("p", F.lit(1)), "k", "full")
    return j.groupBy(F.col("v").isNotNull().alias("in_vectors"), F.col("c").isNotNull().alias("in_typed"), F.col("p").isNotNull().alias("in_weighted")).agg(F.count("*").alias("nodes"))


# Statistics, intervals and vectors


@query("summary5", "SELECT source, count(*) AS n, round(avg(score), 6) AS mean, round(quantile_cont(score, 0.5), 6) + 0.0 AS p50, round(quantile_cont(score, 0.95), 6) + 0.0 AS p95, round(quantile_cont(score, 0.99), 6) + 0.0 AS p99, min(score) AS least, max(score) AS most FROM ranked GROUP BY source")
def _(w: Workload) -> DataFrame:
    p = quantiles(w.ranked, ["source"], "score", [0.5, 0.95, 0.99]).groupBy("source").agg(*[(F.round(F.max(F.when(F.col("q") == q, F.col("value"))), 6) + 0.0).alias(n) for q, n in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"))])
    return w.ranked.groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"), F.min("score").alias("least"), F.max("score").alias("most")).join(p, "source")


AVAILABLE = "av AS (SELECT 'dense' AS key, rd AS x FROM dsr UNION ALL SELECT 'sparse', rs FROM dsr)"


@query("aggregate_available", "SELECT key, count(*) AS rows, count(x) AS available, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS sd, quantile_cont(x::DOUBLE, 0.05) AS p05, quantile_cont(x::DOUBLE, 0.5) AS p50, quantile_cont(x::DOUBLE, 0.95) AS p95 FROM av GROUP BY key", DS + ", " + AVAILABLE)
def _(w: Workload) -> DataFrame:
    """Ranks of each list over the nodes of both; a node that a list lacks is a row, but not available."""
    x = dense_sparse(w).select(F.explode(F.create_map(F.lit("dense"), F.col("rd"), F.lit("sparse"), F.col("rs"))).alias("key", "x"))
    p = quantiles(x, ["key"], "x", [0.05, 0.5, 0.95]).groupBy("key").agg(*[F.max(F.when(F.col("q") == q, F.col("value"))).alias(n) for q, n in ((0.05, "p05"), (0.5, "p50"), (0.95, "p95"))])
    return x.groupBy("key").agg(F.count("*").alias("rows"), F.count("x").alias("available"), F.round(F.avg("x"), 6).alias("mean"), F.round(F.stddev_pop("x"), 6).alias("sd")).join(p, "key")


@query("tie_fraction", "SELECT query_id, source, round(avg((c > 1)::INT), 6) AS tied FROM (SELECT query_id, source, count(*) OVER (PARTITION BY query_id, source, floor(score * 50)) AS c FROM ranked) GROUP BY ALL")
def _(w: Workload) -> DataFrame:
    """Share of a list's rows whose score, in fiftieths, another row has too."""
    c = w.ranked.groupBy("query_id", "source", F.floor(F.col("score") * 50).alias("x")).agg(F.count("*").alias("c"))
    return c.groupBy("query_id", "source").agg(F.round(F.sum(F.when(F.col("c") > 1, F.col("c")).otherwise(0)) / F.sum("c"), 6).alias("tied"))


@query("saturation", "SELECT query_id, node_id, round(n / (n + 1.0::DOUBLE), 6) AS x FROM (SELECT query_id, dst AS node_id, sum(mult) AS n FROM local_edges GROUP BY ALL)")
def _(w: Workload) -> DataFrame:
    n = w.local_edges.groupBy("query_id", F.col("dst").alias("node_id")).agg(F.sum("mult").alias("n"))
    return n.select(*KEY, F.round(F.col("n") / (F.col("n") + 1), 6).alias("x"))


T975 = "(z + (pow(z, 3) + z) / (4 * v) + (5 * pow(z, 5) + 16 * pow(z, 3) + 3 * z) / (96 * v * v) + (3 * pow(z, 7) + 19 * pow(z, 5) + 17 * pow(z, 3) - 15 * z) / (384 * pow(v, 3)))"


@query("mean_std_ci", f"SELECT split, n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(mean / (sd / sqrt(n)), 5) AS t, round(mean - {T975} * sd / sqrt(n), 5) AS low, round(mean + {T975} * sd / sqrt(n), 5) AS high FROM (SELECT *, 1.959963984540054::DOUBLE AS z, (n - 1)::DOUBLE AS v FROM (SELECT l_returnflag || l_linestatus AS split, count(*) AS n, avg(l_discount - l_tax) AS mean, stddev_samp(l_discount - l_tax) AS sd FROM lineitem GROUP BY 1)) WHERE n > 1")
def _(w: Workload) -> DataFrame:
    """Mean of paired differences, its t statistic and its 95 % t-interval, for each group."""
    d = w.table("lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("split"), (F.col("l_discount") - F.col("l_tax")).cast("double").alias("delta"))
    return metrics.t_interval(d, ["split"], "delta")


@query("semantic_difference", "SELECT query_id, node_id, round(list_dot_product(list_transform(list_zip(q.embedding, e.embedding), lambda z: abs(z[1]::DOUBLE - z[2]::DOUBLE)), list_transform(range(1, 65), lambda i: 1.0::DOUBLE / i)), 6) AS difference FROM candidates JOIN embeddings q ON q.vec_id = query_id JOIN embeddings e ON e.vec_id = node_id")
def _(w: Workload) -> DataFrame:
    """Weighted sum of absolute differences, with weights 1 / i."""
    j = w.candidates.join(w.queries.select("query_id", F.col("vec").alias("q")), "query_id").join(w.vectors.select("node_id", "vec"), "node_id")
    weights = F.transform(F.sequence(F.lit(1), F.size("vec")), lambda i: 1.0 / i)
    return j.select(*KEY, F.round(V.dot(F.zip_with("q", "vec", lambda x, y: F.abs(x.cast("double") - y.cast("double"))), weights), 6).alias("difference"))


@query("dirichlet_energy", "SELECT family, round(avg(list_sum(list_transform(list_zip(x.embedding[1:32], y.embedding[1:32]), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ** 2))) / (SELECT avg(list_dot_product(embedding[1:32]::DOUBLE[], embedding[1:32]::DOUBLE[])) FROM embeddings), 6) AS energy FROM und JOIN embeddings x ON x.vec_id = a JOIN embeddings y ON y.vec_id = b GROUP BY family")
def _(w: Workload) -> DataFrame:
    """Mean squared distance over undirected edges, over the mean squared norm of all nodes (dense half)."""
    half = w.vectors.select("node_id", F.slice("vec", 1, 32).alias("vec"))
    size = half.agg(F.avg(V.dot("vec", "vec")).alias("size"))
    pairs = w.edges.where("src <> dst").select("family", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    j = pairs.join(half.select(F.col("node_id").alias("a"), F.col("vec").alias("x")), "a").join(half.select(F.col("node_id").alias("b"), F.col("vec").alias("y")), "b")
    e = j.groupBy("family").agg(F.avg(V.squared_distance("x", "y")).alias("e"))
    return e.crossJoin(F.broadcast(size)).select("family", F.round(F.col("e") / F.col("size"), 6).alias("energy"))  # size: one row


@query("cosine_concentration", "SELECT round(avg(c), 6) AS mean, round(stddev_pop(c), 6) AS sd, round(quantile_cont(c, 0.95), 6) AS p95 FROM (SELECT round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 9) AS c FROM embeddings x JOIN nn ON true JOIN embeddings y ON y.vec_id = (x.vec_id * 7919 + 13) % n WHERE x.vec_id <> y.vec_id)")
def _(w: Workload) -> DataFrame:
    """Cosines of each node with one other at an arithmetic place (a sample of pairs that grows with the nodes)."""
    n = w.vectors.agg(F.count("*").alias("n"))
    a = w.vectors.select("node_id", F.col("vec").alias("x")).crossJoin(F.broadcast(n)).withColumn("other", (F.col("node_id") * 7919 + 13) % F.col("n"))  # n: one row
    c = a.join(w.vectors.select(F.col("node_id").alias("other"), F.col("vec").alias("y")), "other").where("node_id <> other").select(F.round(V.cosine("x", "y"), 9).alias("c"), F.lit(1).alias("all"))
    p = quantiles(c, ["all"], "c", [0.95]).select(F.round("value", 6).alias("p95"))
    return c.agg(F.round(F.avg("c"), 6).alias("mean"), F.round(F.stddev_pop("c"), 6).alias("sd")).crossJoin(F.broadcast(p))  # p: one row


@query("spectrum_ranks")
def _(w: Workload) -> DataFrame:
    """Effective and stable rank of each half of the vectors, from their Gram matrices; tests compare them with numpy's
    singular values."""
    half = lambda n, at: ranks_of_spectrum(gram(w.vectors.select(F.slice("vec", at, 32).alias("vec")), "vec")).select(F.lit(n).alias("half"), "*")
    return half("dense", 1).union(half("sparse", 33))
