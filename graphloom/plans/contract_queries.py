"""Registered queries: the features of a candidate in its pool as one wide table, group by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import vectors as V
from graphloom.operators import graph, pool, relations
from graphloom.plans.feature_queries import DS, KEY, dense_sparse
from graphloom.plans.link_queries import TYPED, TYPED_COLUMNS, entries
from graphloom.plans.queries import query
from graphloom.plans.workload import Workload

#: view -> families; the tables hold no stored nearest-neighbour family.
VIEWS = {"struct": ("structural",), "ner": ("ner",), "full": ("structural", "ner")}
DIM = 64


def rounded(c: Column | str, name: str, places: int = 6) -> Column:
    return (F.round(c, places) + 0.0).alias(name)


def linked(w: Workload, views: dict[str, tuple[str, ...]], links: DataFrame | None) -> DataFrame:
    """The links of these views, taken from links where that is given."""
    return pool.view_links(w.candidates, w.edges, views) if links is None else links.where(F.col("query_id.view").isin(*views))


# Topology

TOPOLOGY = """fl AS (SELECT DISTINCT a.query_id, family, e.src, e.dst FROM both_ways e JOIN candidates a ON a.node_id = e.src JOIN candidates b ON b.query_id = a.query_id AND b.node_id = e.dst),
vl AS MATERIALIZED (SELECT query_id, CASE family WHEN 'structural' THEN 'struct' ELSE family END AS view, src, dst FROM fl UNION SELECT query_id, 'full', src, dst FROM fl),
vn AS MATERIALIZED (SELECT query_id, view, node_id FROM candidates, (VALUES ('struct'), ('ner'), ('full')) t(view)),
v0 AS (SELECT query_id, view, node_id FROM vn SEMI JOIN seeds USING (query_id, node_id)),
v1 AS MATERIALIZED (SELECT DISTINCT l.query_id, l.view, l.dst AS node_id FROM v0 JOIN vl l ON l.query_id = v0.query_id AND l.view = v0.view AND l.src = v0.node_id EXCEPT SELECT * FROM v0),
v2 AS MATERIALIZED (SELECT DISTINCT l.query_id, l.view, l.dst AS node_id FROM v1 JOIN vl l ON l.query_id = v1.query_id AND l.view = v1.view AND l.src = v1.node_id EXCEPT (SELECT * FROM v0 UNION SELECT * FROM v1)),
v3 AS MATERIALIZED (SELECT DISTINCT l.query_id, l.view, l.dst AS node_id FROM v2 JOIN vl l ON l.query_id = v2.query_id AND l.view = v2.view AND l.src = v2.node_id EXCEPT (SELECT * FROM v0 UNION SELECT * FROM v1 UNION SELECT * FROM v2)),
vh AS (SELECT *, 0 AS hop FROM v0 UNION ALL SELECT *, 1 FROM v1 UNION ALL SELECT *, 2 FROM v2 UNION ALL SELECT *, 3 FROM v3),
s1 AS (SELECT l.query_id, l.view, l.dst AS node_id, l.src AS seed FROM vl l JOIN v0 ON v0.query_id = l.query_id AND v0.view = l.view AND v0.node_id = l.src),
s2 AS (SELECT l.query_id, l.view, l.dst AS node_id, seed, l.src AS mid FROM vl l JOIN s1 ON s1.query_id = l.query_id AND s1.view = l.view AND s1.node_id = l.src),
sw AS MATERIALIZED (SELECT *, NULL::BIGINT AS mid FROM s1 UNION ALL SELECT * FROM s2),
wk AS (SELECT query_id, view, node_id, count(*) FILTER (mid IS NULL) AS seeds_1hop, count(DISTINCT seed) AS seeds_2hop, count(mid) AS walks2, count(DISTINCT mid) AS branches FROM sw GROUP BY ALL),
dp AS (SELECT query_id, view, src AS node_id, count(*) AS deg FROM vl GROUP BY ALL),
fd AS (SELECT CASE family WHEN 'structural' THEN 'struct' ELSE family END AS view, src AS node_id, count(*) AS n FROM both_ways GROUP BY ALL),
gd AS (SELECT * FROM fd UNION ALL SELECT 'full', node_id, sum(n) FROM fd GROUP BY node_id),
rc0 AS (SELECT query_id, view, node_id, node_id AS other FROM vn UNION SELECT r.query_id, r.view, r.node_id, l.dst FROM rc0 r JOIN vl l ON l.query_id = r.query_id AND l.view = r.view AND l.src = r.other),
cp AS (SELECT r.query_id, r.view, r.node_id, count(*) AS component_size, max((v0.node_id IS NOT NULL)::INT) AS seed_component FROM rc0 r LEFT JOIN v0 ON v0.query_id = r.query_id AND v0.view = r.view AND v0.node_id = r.other GROUP BY ALL),
ns AS (SELECT query_id, count(*) AS seeds FROM seeds GROUP BY query_id),
topo AS MATERIALIZED (SELECT query_id, view, node_id, (hop IS NOT DISTINCT FROM 0)::INT AS dist_0, (hop IS NOT DISTINCT FROM 1)::INT AS dist_1, (hop IS NOT DISTINCT FROM 2)::INT AS dist_2, (hop IS NOT DISTINCT FROM 3)::INT AS dist_3, (hop IS NULL)::INT AS unreached, (hop IS NOT NULL)::INT AS reach,
  round(ln(1 + coalesce(seeds_1hop, 0)), 6) AS seeds_1hop, round(coalesce(seeds_2hop, 0) / seeds, 6) AS seeds_2hop_frac, round(ln(1 + coalesce(deg, 0)), 6) AS deg_pool, round(ln(1 + coalesce(n, 0)), 6) AS deg_global, round(ln(1 + coalesce(walks2, 0)), 6) AS walks2,
  max((deg IS NOT NULL)::INT) OVER (PARTITION BY query_id, view) AS avail, round(ln(1 + coalesce(branches, 0)), 6) AS branch_div, seed_component, round(ln(1 + component_size), 6) AS component_size
  FROM vn LEFT JOIN vh USING (query_id, view, node_id) LEFT JOIN wk USING (query_id, view, node_id) LEFT JOIN dp USING (query_id, view, node_id) LEFT JOIN gd USING (view, node_id) JOIN cp USING (query_id, view, node_id) JOIN ns USING (query_id))"""
TOPOLOGY_COLUMNS = ("dist_0", "dist_1", "dist_2", "dist_3", "unreached", "reach", "seeds_1hop", "seeds_2hop_frac", "deg_pool", "deg_global", "walks2", "avail", "branch_div", "seed_component", "component_size")


def topology(w: Workload, views: dict[str, tuple[str, ...]] = VIEWS, links: DataFrame | None = None) -> DataFrame:
    """query_id, view, node_id and the fifteen topology columns; all views are walked in the same jobs."""
    t = pool.topology(pool.in_views(w.candidates.select(*KEY), views), pool.in_views(w.seeds.select(*KEY), views), linked(w, views, links))
    t = t.select("query_id.query_id", "query_id.view", *[c for c in t.columns if c != "query_id"])
    of = F.array(*[F.when(F.col("family").isin(*families), F.lit(v)) for v, families in views.items()])
    both = w.edges.where("src <> dst").select("family", "src", "dst").union(w.edges.where("src <> dst").select("family", "dst", "src")).distinct()
    degree = both.groupBy("family", F.col("src").alias("node_id")).agg(F.count("*").alias("n")).withColumn("view", F.explode(F.array_compact(of))).groupBy("view", "node_id").agg(F.sum("n").alias("n"))
    t = t.join(degree, ["view", "node_id"], "left").join(w.seeds.groupBy("query_id").agg(F.count("*").alias("seeds")), "query_id")
    flag = lambda c, name: F.coalesce(c, F.lit(False)).cast("int").alias(name)
    log = lambda c, name: rounded(F.log1p(F.coalesce(c, F.lit(0))), name)
    return t.select(
        "query_id", "view", "node_id", *[flag(F.col("hop") == h, f"dist_{h}") for h in range(4)], flag(F.col("hop").isNull(), "unreached"), flag(F.col("hop").isNotNull(), "reach"),
        log("seeds_1hop", "seeds_1hop"), rounded(F.col("seeds_2hop") / F.col("seeds"), "seeds_2hop_frac"), log("deg", "deg_pool"), log("n", "deg_global"), log("walks2", "walks2"),
        "avail", log("branches", "branch_div"), "seed_component", log("component_size", "component_size"),
    )


@query("pool_topology", f"SELECT query_id, view, node_id, {', '.join(TOPOLOGY_COLUMNS)} FROM topo", TOPOLOGY)
def _(w: Workload) -> DataFrame:
    return topology(w)


# Retrieval, edge weights, neighbours, smoothing, seeds

RETRIEVAL = DS + """, rv0 AS (SELECT c.query_id, c.node_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) + 0.0 AS dense_cos, round(coalesce(1 / rd, 0), 6) AS dense_rr, (rd IS NOT NULL)::INT AS dense_in, round(coalesce(1 / rs, 0), 6) AS sparse_rr, (rs IS NOT NULL)::INT AS sparse_in,
  round(CASE WHEN top > 0 THEN coalesce(r.score / top, 0) ELSE 0 END, 6) + 0.0 AS sparse_share, round(coalesce(1 / (60 + rd), 0) + coalesce(1 / (60 + rs), 0), 9) AS rrf, (rd IS NOT NULL AND rs IS NOT NULL)::INT AS agreement, (seed_pos IS NOT NULL)::INT AS is_seed, round(coalesce(seed_pos, 0) / 10, 6) AS seed_rank
  FROM candidates c JOIN dsr USING (query_id, node_id) JOIN embeddings q ON q.vec_id = c.query_id JOIN embeddings v ON v.vec_id = c.node_id LEFT JOIN ranked r ON r.query_id = c.query_id AND r.node_id = c.node_id AND r.source = 'sparse' LEFT JOIN (SELECT query_id, score AS top FROM ranked WHERE source = 'sparse' AND rank = 1) t ON t.query_id = c.query_id LEFT JOIN seeds s ON s.query_id = c.query_id AND s.node_id = c.node_id)"""


def retrieval(w: Workload) -> DataFrame:
    score = w.ranked.where("source = 'sparse'").select(*KEY, "score")
    top = w.ranked.where("source = 'sparse' and rank = 1").select("query_id", F.col("score").alias("top"))
    j = w.candidates.select(*KEY).join(dense_sparse(w), KEY).join(score, KEY, "left").join(top, "query_id", "left").join(w.seeds.select(*KEY, "seed_pos"), KEY, "left")
    j = j.join(w.queries.select("query_id", F.col("vec").alias("q")), "query_id").join(w.vectors.select("node_id", "vec"), "node_id")
    rr = lambda c, at=0: F.coalesce(1 / (F.col(c) + at), F.lit(0.0))
    has = lambda c, name: c.cast("int").alias(name)
    d, s = F.col("rd").isNotNull(), F.col("rs").isNotNull()
    share = F.when(F.col("top") > 0, F.coalesce(F.col("score") / F.col("top"), F.lit(0.0))).otherwise(0.0)
    return j.select(
        *KEY, rounded(V.cosine("q", "vec"), "dense_cos"), rounded(rr("rd"), "dense_rr"), has(d, "dense_in"), rounded(rr("rs"), "sparse_rr"), has(s, "sparse_in"), rounded(share, "sparse_share"),
        rounded(rr("rd", 60) + rr("rs", 60), "rrf", 9), has(d & s, "agreement"), has(F.col("seed_pos").isNotNull(), "is_seed"), rounded(F.coalesce(F.col("seed_pos") / 10, F.lit(0.0)), "seed_rank"),
    )


@query("pool_retrieval", "SELECT * FROM rv0", RETRIEVAL)
def _(w: Workload) -> DataFrame:
    return retrieval(w)


WEIGHTS = """ew AS (SELECT a AS src, b AS dst, x FROM (SELECT least(src, dst) AS a, greatest(src, dst) AS b, max(weight) AS x FROM edges WHERE family = 'ner' AND src <> dst GROUP BY ALL) UNION ALL SELECT b, a, x FROM (SELECT least(src, dst) AS a, greatest(src, dst) AS b, max(weight) AS x FROM edges WHERE family = 'ner' AND src <> dst GROUP BY ALL)),
ws AS (SELECT c.query_id, c.node_id, round(coalesce(max(x), 0), 6) AS wmax_seed, round(ln(1 + coalesce(sum(x), 0)), 6) AS wsum_seed FROM candidates c LEFT JOIN (SELECT s.query_id, dst AS node_id, x FROM seeds s JOIN ew ON src = s.node_id) USING (query_id, node_id) GROUP BY ALL)"""


def seed_weights(w: Workload, family: str = "ner") -> DataFrame:
    """The largest weight of the weighted family between a candidate and a seed, and ln(1 + sum); a pair has its largest."""
    pair = w.edges.where((F.col("family") == family) & (F.col("src") != F.col("dst"))).groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.max("weight").alias("x"))
    both = pair.select(F.col("a").alias("seed"), F.col("b").alias("node_id"), "x").union(pair.select("b", "a", "x"))
    hit = w.seeds.select("query_id", F.col("node_id").alias("seed")).join(both, "seed").groupBy(*KEY).agg(F.max("x").alias("m"), F.sum("x").alias("s"))
    z = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return w.candidates.select(*KEY).join(hit, KEY, "left").select(*KEY, rounded(z("m"), "wmax_seed"), rounded(F.log1p(z("s")), "wsum_seed"))


@query("seed_edge_weights", "SELECT * FROM ws", WEIGHTS)
def _(w: Workload) -> DataFrame:
    return seed_weights(w)


NEIGHBOURS = """nb AS MATERIALIZED (SELECT query_id, view, src AS node_id, dst AS nbr FROM vl WHERE view <> 'full'),
nm AS (SELECT query_id, view, node_id, list(x ORDER BY i) AS m FROM (SELECT query_id, view, node_id, i, avg(embedding[i]::DOUBLE) AS x FROM nb JOIN embeddings ON vec_id = nbr CROSS JOIN range(1, 65) t(i) GROUP BY ALL) GROUP BY ALL),
nx AS (SELECT query_id, view, nb.node_id, max(list_cosine_similarity(q.embedding::DOUBLE[], u.embedding::DOUBLE[])) AS best FROM nb JOIN embeddings q ON q.vec_id = query_id JOIN embeddings u ON u.vec_id = nbr GROUP BY ALL),
nc AS (SELECT n.query_id, n.view, n.node_id, round(coalesce(list_cosine_similarity(q.embedding::DOUBLE[], m), 0), 6) + 0.0 AS cos_q_proto, round(coalesce(best, 0), 6) + 0.0 AS max_q_nbr, round(coalesce(list_cosine_similarity(v.embedding::DOUBLE[], m), 0), 6) + 0.0 AS cohesion, (m IS NOT NULL)::INT AS has_nbr
  FROM vn n JOIN embeddings q ON q.vec_id = n.query_id JOIN embeddings v ON v.vec_id = n.node_id LEFT JOIN nm USING (query_id, view, node_id) LEFT JOIN nx USING (query_id, view, node_id) WHERE n.view <> 'full')"""
NEIGHBOUR_COLUMNS = ("cos_q_proto", "max_q_nbr", "cohesion", "has_nbr")


def neighbours(w: Workload, views: dict[str, tuple[str, ...]] = VIEWS, links: DataFrame | None = None) -> DataFrame:
    """query_id, view, node_id: how the neighbours of a family in the pool agree with the query and with the node."""
    views = {v: f for v, f in views.items() if v != "full"}
    links = linked(w, views, links).select("query_id.query_id", "query_id.view", F.col("src").alias("node_id"), F.col("dst").alias("nbr"))
    by = ["query_id", "view", "node_id"]
    q = w.queries.select("query_id", F.col("vec").alias("q"))
    cos = w.candidates.select(*KEY).join(w.vectors.select("node_id", "vec"), "node_id").join(q, "query_id").select("query_id", F.col("node_id").alias("nbr"), V.cosine("q", "vec").alias("c"))
    best = links.join(cos, ["query_id", "nbr"]).groupBy(*by).agg(F.max("c").alias("best"))
    mean = pool.weighted_mean(links.join(w.vectors.select(F.col("node_id").alias("nbr"), "vec"), "nbr"), by, "vec", F.lit(1.0), DIM, "m")
    all_ = pool.in_views(w.candidates.select(*KEY), views).select("query_id.query_id", "query_id.view", "node_id")
    j = all_.join(mean, by, "left").join(best, by, "left").join(q, "query_id").join(w.vectors.select("node_id", "vec"), "node_id")
    near = lambda a: F.when(F.col("m").isNotNull(), V.cosine(a, "m")).otherwise(0.0)
    return j.select(*by, rounded(near("q"), "cos_q_proto"), rounded(F.coalesce("best", F.lit(0.0)), "max_q_nbr"), rounded(near("vec"), "cohesion"), F.col("m").isNotNull().cast("int").alias("has_nbr"))


@query("neighbour_aggregation", f"SELECT query_id, view, node_id, {', '.join(NEIGHBOUR_COLUMNS)} FROM nc", TOPOLOGY + ", " + NEIGHBOURS)
def _(w: Workload) -> DataFrame:
    return neighbours(w)


SMOOTHED = """g0 AS (SELECT n.query_id, n.view, n.node_id, rrf / max(rrf) OVER (PARTITION BY n.query_id, n.view) AS s FROM vn n JOIN rv0 USING (query_id, node_id) WHERE n.view <> 'ner'),
g1 AS MATERIALIZED (SELECT g0.query_id, g0.view, g0.node_id, any_value(g0.s) AS s, 0.5 * any_value(g0.s) + 0.5 * coalesce(sum(o.s / deg), 0) AS p FROM g0 LEFT JOIN vl l ON l.query_id = g0.query_id AND l.view = g0.view AND l.src = g0.node_id LEFT JOIN g0 o ON o.query_id = l.query_id AND o.view = l.view AND o.node_id = l.dst LEFT JOIN dp d ON d.query_id = g0.query_id AND d.view = g0.view AND d.node_id = g0.node_id GROUP BY ALL),
g2 AS (SELECT g1.query_id, g1.view, g1.node_id, round(greatest(any_value(g1.s), 0.5 * any_value(g1.s) + 0.5 * coalesce(sum(o.p / deg), 0)), 6) AS p FROM g1 LEFT JOIN vl l ON l.query_id = g1.query_id AND l.view = g1.view AND l.src = g1.node_id LEFT JOIN g1 o ON o.query_id = l.query_id AND o.view = l.view AND o.node_id = l.dst LEFT JOIN dp d ON d.query_id = g1.query_id AND d.view = g1.view AND d.node_id = g1.node_id GROUP BY ALL)"""


def smoothed(w: Workload, kept: DataFrame, views: dict[str, tuple[str, ...]] = VIEWS, links: DataFrame | None = None) -> DataFrame:
    """query_id, view, node_id, p: fused scores smoothed over the pool's links, of all families and of the typed one."""
    views = {v: views[v] for v in ("full", "struct")}
    p = pool.smooth(pool.in_views(kept.select(*KEY, F.col("rrf").alias("s")), views), linked(w, views, links))
    return p.select("query_id.query_id", "query_id.view", "node_id", rounded("p", "p"))


SEEDED = """sp AS (SELECT query_id, list(x ORDER BY i) AS m FROM (SELECT query_id, i, avg(embedding[i]::DOUBLE) AS x FROM seeds JOIN embeddings ON vec_id = node_id CROSS JOIN range(1, 65) t(i) GROUP BY ALL) GROUP BY query_id),
sm AS (SELECT c.query_id, c.node_id, max(list_cosine_similarity(v.embedding::DOUBLE[], u.embedding::DOUBLE[])) AS best FROM candidates c JOIN seeds s ON s.query_id = c.query_id JOIN embeddings v ON v.vec_id = c.node_id JOIN embeddings u ON u.vec_id = s.node_id GROUP BY ALL),
sd AS MATERIALIZED (SELECT query_id, node_id, seed, CASE WHEN bool_or(mid IS NULL) THEN 1 ELSE 2 END AS d FROM sw WHERE view = 'full' GROUP BY ALL),
sk AS (SELECT query_id, node_id, seed, 'reach' AS kind, 1.0::DOUBLE / d AS x FROM sd UNION ALL SELECT query_id, node_id, seed, 'h' || d, 1.0::DOUBLE FROM sd),
sr AS (SELECT query_id, node_id, kind, list(x ORDER BY i) AS m FROM (SELECT query_id, node_id, kind, i, sum(x * embedding[i]::DOUBLE) / sum(x) AS x FROM sk JOIN embeddings ON vec_id = seed CROSS JOIN range(1, 65) t(i) GROUP BY ALL) GROUP BY ALL),
sc AS (SELECT r.query_id, r.node_id, kind, round(list_cosine_similarity(v.embedding::DOUBLE[], m), 6) + 0.0 AS c FROM sr r JOIN embeddings v ON v.vec_id = r.node_id),
sz AS MATERIALIZED (SELECT c.query_id, c.node_id, round(list_cosine_similarity(any_value(v.embedding)::DOUBLE[], any_value(sp.m)), 6) + 0.0 AS cos_v_seedproto, round(any_value(best), 6) + 0.0 AS max_cos_v_seed, """ + ", ".join(f"coalesce(max(sc.c) FILTER (kind = '{k}'), 0) AS cos_v_{k}, count(*) FILTER (kind = '{k}') AS has_{k}" for k in ("reach", "h1", "h2")) + """
  FROM candidates c JOIN sp USING (query_id) JOIN sm ON sm.query_id = c.query_id AND sm.node_id = c.node_id JOIN embeddings v ON v.vec_id = c.node_id LEFT JOIN sc ON sc.query_id = c.query_id AND sc.node_id = c.node_id GROUP BY c.query_id, c.node_id)"""
SEED_COLUMNS = ("cos_v_seedproto", "max_cos_v_seed", "cos_v_reach", "has_reach", "cos_v_h1", "has_h1", "cos_v_h2", "has_h2")


def seeded(w: Workload, views: dict[str, tuple[str, ...]] = VIEWS, links: DataFrame | None = None) -> DataFrame:
    """Cosines of a candidate with the mean of its query's seeds, with the nearest seed, and with the mean of the seeds that
    one link or a walk of two joins (weighted 1 and a half), that one link joins, and that only a walk of two joins."""
    vec = lambda key, name: w.vectors.select(F.col("node_id").alias(key), F.col("vec").alias(name))
    s = w.seeds.select("query_id", F.col("node_id").alias("seed")).join(vec("seed", "u"), "seed")
    c = w.candidates.select(*KEY)
    # A query has at most ten seeds.
    best = c.join(s, "query_id").join(vec("node_id", "v"), "node_id").groupBy(*KEY).agg(F.max(V.cosine("u", "v")).alias("best"))
    links = linked(w, {"full": views["full"]}, links).select("query_id.query_id", "src", "dst")
    d = pool.seed_walks(w.seeds.select(*KEY), links).groupBy(*KEY, "seed").agg(F.when(F.max(F.col("mid").isNull()), 1).otherwise(2).alias("d"))
    kinds = F.array(F.struct(F.lit("reach").alias("kind"), (1.0 / F.col("d")).alias("x")), F.struct(F.concat(F.lit("h"), F.col("d").cast("string")).alias("kind"), F.lit(1.0).alias("x")))
    k = d.withColumn("k", F.explode(kinds)).select(*KEY, "seed", "k.*").join(vec("seed", "u"), "seed")
    mean = pool.weighted_mean(k, [*KEY, "kind"], "u", F.col("x"), DIM, "m").join(vec("node_id", "v"), "node_id").select(*KEY, "kind", V.cosine("m", "v").alias("c"))
    near = mean.groupBy(*KEY).agg(*[x for n in ("reach", "h1", "h2") for x in (F.max(F.when(F.col("kind") == n, F.col("c"))).alias(f"c_{n}"), F.count(F.when(F.col("kind") == n, 1)).alias(f"has_{n}"))])
    j = c.join(best, KEY).join(pool.weighted_mean(s, ["query_id"], "u", F.lit(1.0), DIM, "p"), "query_id").join(vec("node_id", "v"), "node_id").join(near, KEY, "left")
    both = lambda n: (rounded(F.coalesce(f"c_{n}", F.lit(0.0)), f"cos_v_{n}"), F.coalesce(f"has_{n}", F.lit(0)).alias(f"has_{n}"))
    return j.select(*KEY, rounded(V.cosine("v", "p"), "cos_v_seedproto"), rounded("best", "max_cos_v_seed"), *both("reach"), *both("h1"), *both("h2"))


@query("seed_conditioned", f"SELECT query_id, node_id, {', '.join(SEED_COLUMNS)} FROM sz", TOPOLOGY + ", " + SEEDED)
def _(w: Workload) -> DataFrame:
    return seeded(w)


# The whole table

BY_VIEW = [(c, v) for v in VIEWS for c in TOPOLOGY_COLUMNS]
BY_FAMILY = [(c, v) for v in ("struct", "ner") for c in NEIGHBOUR_COLUMNS]
RETRIEVAL_COLUMNS = ("dense_cos", "dense_rr", "dense_in", "sparse_rr", "sparse_in", "sparse_share", "rrf", "agreement", "is_seed", "seed_rank")
TYPED_WIDE = (*TYPED_COLUMNS, "rel_ief", "has_typed_edge", "has_typed_seed_edge", "relchain2_max", "relchain2_mean", "has_relchain2", "typed_available")
TYPED_WIDE_SQL = """ief AS (SELECT rel, ln((1.0 + any_value(n)) / (1 + count(*))) AS ief FROM structural, nn GROUP BY rel),
tf AS (SELECT query_id, v AS node_id, """ + ", ".join(f"round({e}, 6) + 0.0 AS {c}" for c, e in TYPED_COLUMNS.items()) + """, round(max(ief), 6) + 0.0 AS rel_ief, 1 AS has_typed_edge, max(us::INT) AS has_typed_seed_edge FROM ent JOIN ief USING (rel) GROUP BY query_id, v),
ch AS (SELECT e.query_id, e.v AS node_id, round(max((c1 + rc) / 2), 6) + 0.0 AS relchain2_max, round(avg((c1 + rc) / 2), 6) + 0.0 AS relchain2_mean, 1 AS has_relchain2 FROM ent e JOIN (SELECT query_id, v AS u, max(rc) AS c1 FROM ent WHERE us AND NOT vs GROUP BY query_id, v) f ON f.query_id = e.query_id AND f.u = e.u WHERE NOT vs GROUP BY ALL)"""


def typed(w: Workload) -> DataFrame:
    """The features of typed edges inside the pool, for candidates that have any."""
    e = entries(w)
    n = w.vectors.agg(F.count("*").alias("n"))
    ief = w.structural.groupBy("rel").agg(F.count("*").alias("c")).crossJoin(F.broadcast(n)).select("rel", F.log((1 + F.col("n")) / (1 + F.col("c"))).alias("ief"))
    start = w.seeds.select("query_id", F.col("node_id").alias("u"), F.lit(1).alias("s"))
    more = e.join(ief, "rel").join(start, ["query_id", "u"], "left").groupBy("query_id", F.col("v").alias("node_id")).agg(rounded(F.max("ief"), "rel_ief"), F.lit(1).alias("has_typed_edge"), F.coalesce(F.max("s"), F.lit(0)).alias("has_typed_seed_edge"))
    features = relations.typed_features(e, w.seeds).select(*KEY, *[rounded(c, c) for c in TYPED_COLUMNS])
    chains = relations.chains(e, w.seeds).select(*KEY, rounded("best", "relchain2_max"), rounded("mean", "relchain2_mean"), F.lit(1).alias("has_relchain2"))
    return features.join(more, KEY).join(chains, KEY, "left")


@query("feature_contract", "SELECT query_id, node_id, " + ", ".join(RETRIEVAL_COLUMNS) + ", " + ", ".join(f"{c}_{v}" for c, v in BY_VIEW + BY_FAMILY) + ", wmax_seed, wsum_seed, gcs_full, gcs_struct, " + ", ".join(SEED_COLUMNS) + ", " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in TYPED_WIDE if c != "typed_available") + ", (SELECT (count(*) > 0)::INT FROM structural) AS typed_available"
  + " FROM rv0 JOIN (SELECT query_id, node_id, " + ", ".join(f"max({c}) FILTER (view = '{v}') AS {c}_{v}" for c, v in BY_VIEW) + " FROM topo GROUP BY ALL) USING (query_id, node_id) JOIN (SELECT query_id, node_id, " + ", ".join(f"max({c}) FILTER (view = '{v}') AS {c}_{v}" for c, v in BY_FAMILY) + " FROM nc GROUP BY ALL) USING (query_id, node_id)"
  + " JOIN ws USING (query_id, node_id) JOIN (SELECT query_id, node_id, max(p) FILTER (view = 'full') AS gcs_full, max(p) FILTER (view = 'struct') AS gcs_struct FROM g2 GROUP BY ALL) USING (query_id, node_id) JOIN sz USING (query_id, node_id) LEFT JOIN tf USING (query_id, node_id) LEFT JOIN ch USING (query_id, node_id)",
  ", ".join((RETRIEVAL, TOPOLOGY, WEIGHTS, NEIGHBOURS, SMOOTHED, SEEDED, TYPED, TYPED_WIDE_SQL)))
def _(w: Workload) -> DataFrame:
    return whole(w)


def whole(w: Workload, views: dict[str, tuple[str, ...]] = VIEWS, links: DataFrame | None = None) -> DataFrame:
    """All groups side by side, one row a candidate. Each group is checkpointed, so that the last join reads tables only."""
    first = graph.cut(retrieval(w))
    families = [v for v in views if v != "full"]
    wide = lambda df, columns, vs: df.groupBy(*KEY).agg(*[F.max(F.when(F.col("view") == v, F.col(c))).alias(f"{c}_{v}") for v in vs for c in columns])
    gcs = smoothed(w, first, views, links).groupBy(*KEY).agg(*[F.max(F.when(F.col("view") == v, F.col("p"))).alias(f"gcs_{v}") for v in ("full", "struct")])
    weights = [seed_weights(w)] + [seed_weights(w, f).withColumnsRenamed({c: f"{c}_{f}" for c in ("wmax_seed", "wsum_seed")}) for f in families if f not in ("struct", "ner")]
    out = first
    for part in (wide(topology(w, views, links), TOPOLOGY_COLUMNS, views), wide(neighbours(w, views, links), NEIGHBOUR_COLUMNS, families), *weights, gcs, seeded(w, views, links)):
        out = out.join(graph.cut(part), KEY)
    out = out.join(graph.cut(typed(w)), KEY, "left")
    there = w.structural.agg((F.count("*") > 0).cast("int").alias("typed_available"))
    kept = [c for c in out.columns if c not in TYPED_WIDE]
    return out.crossJoin(F.broadcast(there)).select(*kept, *[F.coalesce(c, F.lit(0)).alias(c) for c in TYPED_WIDE])
