"""Registered queries: typed relations inside a pool, features by distance from the seeds, and names in texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.functions import vectors as V
from graphloom.operators import graph, relations
from graphloom.plans.feature_queries import KEY
from graphloom.plans.queries import query
from graphloom.plans.wide_queries import RINGS
from graphloom.plans.workload import Workload

# Typed relations

TYPED = """rv AS (SELECT rel, list(x ORDER BY i) AS rel_vec FROM (SELECT rel, i, round(avg(embedding[i]::DOUBLE), 6) AS x FROM structural JOIN embeddings ON vec_id = dst CROSS JOIN range(1, 65) t(i) GROUP BY rel, i) GROUP BY rel),
te AS (SELECT DISTINCT a.query_id, u, v, rel, sign FROM (SELECT src AS u, dst AS v, rel, 1 AS sign FROM structural WHERE src <> dst UNION ALL SELECT dst, src, rel, -1 FROM structural WHERE src <> dst) JOIN candidates a ON a.node_id = u JOIN candidates b ON b.node_id = v AND b.query_id = a.query_id),
ent AS (SELECT query_id, u, v, rel, sign, round(list_cosine_similarity(embedding::DOUBLE[], rel_vec), 6) AS rc, EXISTS (SELECT 1 FROM seeds s WHERE s.query_id = te.query_id AND s.node_id = u) AS us, EXISTS (SELECT 1 FROM seeds s WHERE s.query_id = te.query_id AND s.node_id = v) AS vs
  FROM te JOIN rv USING (rel) JOIN embeddings ON vec_id = query_id)"""


def entries(w: Workload) -> DataFrame:
    return graph.cut(relations.with_compatibility(relations.typed_entries(w.candidates, w.structural), w.queries, relations.relation_vectors(w.structural, w.vectors)))


TYPED_COLUMNS = {
    "relmax_in": "max(rc)", "relmean_in": "avg(rc)", "rel_div": "ln(1 + count(DISTINCT rel))", "dir_in_frac": "avg((sign = 1)::INT)", "relmax_seed": "coalesce(max(rc) FILTER (us), 0)", "relmean_seed": "coalesce(avg(rc) FILTER (us), 0)",
    "seed_edges_out": "ln(1 + count(*) FILTER (us AND sign = -1))", "seed_edges_in": "ln(1 + count(*) FILTER (us AND sign = 1))",
}


@query("typed_relations", "SELECT query_id, v AS node_id, " + ", ".join(f"round({e}, 9) + 0.0 AS {c}" for c, e in TYPED_COLUMNS.items()) + " FROM ent GROUP BY query_id, v", TYPED)
def _(w: Workload) -> DataFrame:
    """Features of a candidate's typed edges inside the pool."""
    return relations.typed_features(entries(w), w.seeds).select(*KEY, *[(F.round(c, 9) + 0.0).alias(c) for c in TYPED_COLUMNS])


@query("relchain2", """SELECT e.query_id, e.v AS node_id, round(max((c1 + rc) / 2), 9) + 0.0 AS relchain2_max, round(avg((c1 + rc) / 2), 9) + 0.0 AS relchain2_mean FROM ent e
  JOIN (SELECT query_id, v AS u, max(rc) AS c1 FROM ent WHERE us AND NOT vs GROUP BY query_id, v) f ON f.query_id = e.query_id AND f.u = e.u WHERE NOT vs GROUP BY e.query_id, e.v""", TYPED)
def _(w: Workload) -> DataFrame:
    """Chains of two typed edges from a seed over a node that is none to a candidate that is none."""
    r = lambda c, name: (F.round(c, 9) + 0.0).alias(name)
    return relations.chains(entries(w), w.seeds).select(*KEY, r("best", "relchain2_max"), r("mean", "relchain2_mean"))


def _walks_sql(length: int) -> str:
    parts = ["b0 AS (SELECT query_id, node_id AS u, 0.0::DOUBLE AS total, []::STRUCT(u BIGINT, rel INT, sign INT, rc DOUBLE)[] AS path FROM seeds)"]
    for h in range(1, length + 1):
        pick = "{'total': round(total + rc, 6), 'path': list_append(path, {'u': e.u::BIGINT, 'rel': rel::INT, 'sign': sign::INT, 'rc': rc::DOUBLE})}"
        parts.append(f"b{h} AS MATERIALIZED (SELECT query_id, u, w.total AS total, w.path AS path FROM (SELECT e.query_id, e.v AS u, max({pick}) AS w FROM b{h - 1} b JOIN ent e ON e.query_id = b.query_id AND e.u = b.u GROUP BY e.query_id, e.v))")
    return ", ".join(parts) + ", bw AS (" + " UNION ALL ".join(f"SELECT query_id, u AS node_id, {h} AS hop, path FROM b{h}" for h in range(1, length + 1)) + ")"


@query("ordered_path", """SELECT query_id, node_id, hop, k AS place, path[k].rc AS cos, path[k].sign AS direction, CASE WHEN k < hop THEN round(list_cosine_similarity(x.rel_vec, y.rel_vec), 5) ELSE 0 END + 0.0 AS turn
  FROM (SELECT *, unnest(range(1, hop + 1)) AS k FROM bw) JOIN rv x ON x.rel = path[k].rel LEFT JOIN rv y ON y.rel = path[k + 1].rel""", TYPED + ", " + _walks_sql(3))
def _(w: Workload) -> DataFrame:
    """The best typed walk of each length up to three from the seeds to a candidate, step by step: the step's compatibility,
    its direction, and the cosine between its relation and the next step's (0 for the last)."""
    rel = relations.relation_vectors(w.structural, w.vectors)
    walks = relations.best_walks(entries(w), w.seeds, 3)
    steps = walks.select(*KEY, "hop", "path", F.posexplode("path").alias("at", "s")).withColumn("next", F.get("path", F.col("at") + 1)["rel"])
    pairs = steps.select(F.col("s.rel").alias("rel"), "next").where("next is not null").distinct()
    turn = pairs.join(rel, "rel").join(rel.select(F.col("rel").alias("next"), F.col("rel_vec").alias("next_vec")), "next").select("rel", "next", F.round(V.cosine("rel_vec", "next_vec"), 5).alias("turn"))
    j = steps.withColumn("rel", F.col("s.rel")).join(F.broadcast(turn), ["rel", "next"], "left")  # turn: at most the square of the relations, which are six
    return j.select(*KEY, "hop", (F.col("at") + 1).alias("place"), F.col("s.rc").alias("cos"), F.col("s.sign").alias("direction"), (F.coalesce("turn", F.lit(0.0)) + 0.0).alias("turn"))


# Features by distance

NEAR = ", ring AS (SELECT *, 1 AS d FROM ur UNION ALL SELECT *, 2 FROM r2 UNION ALL SELECT *, 3 FROM r3), mass AS (SELECT query_id, node_id, 1.0::DOUBLE / count(*) OVER (PARTITION BY query_id) AS m FROM seeds)"


@query("depth_basis", """SELECT query_id, a AS node_id, d AS distance, round(ln(1 + count(m)), 5) AS seeds_at, round(coalesce(sum(m), 0), 5) AS seedmass, round(any_value(coalesce(proto, 0)), 5) + 0.0 AS seedproto, round(avg(c), 5) + 0.0 AS ring_qmean, round(max(c), 5) + 0.0 AS ring_qmax, round(ln(1 + count(*)), 5) AS ring_n
  FROM (SELECT r.*, m, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS c FROM ring r JOIN embeddings q ON q.vec_id = r.query_id JOIN embeddings v ON v.vec_id = r.b LEFT JOIN mass s ON s.query_id = r.query_id AND s.node_id = r.b) LEFT JOIN proto USING (query_id, a, d) GROUP BY query_id, a, d""",
  RINGS + NEAR + """, proto AS (SELECT query_id, a, d, list_cosine_similarity(any_value(embedding)::DOUBLE[], list(x ORDER BY i)) AS proto FROM (SELECT r.query_id, r.a, r.d, i, sum(u.embedding[i]::DOUBLE) AS x FROM ring r JOIN seeds s ON s.query_id = r.query_id AND s.node_id = r.b JOIN embeddings u ON u.vec_id = r.b CROSS JOIN range(1, 65) t(i) GROUP BY ALL) JOIN embeddings ON vec_id = a GROUP BY query_id, a, d)""")
def _(w: Workload) -> DataFrame:
    """For each candidate and exact distance of one to three undirected links in the pool: seeds there, their share of the
    seed mass, the cosine with their mean vector (from products, not from vectors), and the query's cosines there."""
    by = [*KEY, "distance"]
    ring = graph.cut(graph.rings(w.local_edges).withColumnsRenamed({"src": "node_id", "dst": "other"}))
    vec = lambda key, name: w.vectors.select(F.col("node_id").alias(key), F.col("vec").alias(name))
    share = w.seeds.groupBy("query_id").agg((1 / F.count("*")).alias("m")).join(w.seeds, "query_id").select("query_id", F.col("node_id").alias("other"), "m")
    c = ring.select("query_id", "other").distinct().join(vec("other", "vec"), "other").join(w.queries.select("query_id", F.col("vec").alias("q")), "query_id").select("query_id", "other", V.cosine("q", "vec").alias("c"))
    stats = ring.join(c, ["query_id", "other"]).join(share, ["query_id", "other"], "left").groupBy(*by).agg(F.count("m").alias("n"), F.coalesce(F.sum("m"), F.lit(0.0)).alias("seedmass"), F.avg("c").alias("ring_qmean"), F.max("c").alias("ring_qmax"), F.count("*").alias("size"))
    # |sum of seeds|^2 is the sum of their products; a query has at most ten seeds, so at most a hundred pairs.
    seed = w.seeds.select("query_id", F.col("node_id").alias("other"))
    s = seed.join(vec("other", "x"), "other")
    near = ring.join(seed, ["query_id", "other"])
    gram = s.join(s.select("query_id", F.col("other").alias("other2"), F.col("x").alias("y")), "query_id").select("query_id", "other", "other2", V.dot("x", "y").alias("g"))
    norm = near.join(near.withColumnRenamed("other", "other2"), by).join(gram, ["query_id", "other", "other2"]).groupBy(*by).agg(F.sqrt(F.sum("g")).alias("norm"))
    dots = near.join(vec("node_id", "v"), "node_id").join(vec("other", "x"), "other").groupBy(*by).agg(F.sum(V.dot("v", "x")).alias("dots"), F.max(F.sqrt(V.dot("v", "v"))).alias("size_v"))
    proto = norm.join(dots, by).select(*by, F.try_divide("dots", F.col("size_v") * F.col("norm")).alias("proto"))
    r = lambda x, name: (F.round(x, 5) + 0.0).alias(name)
    return stats.join(proto, by, "left").select(*by, r(F.log1p("n"), "seeds_at"), r("seedmass", "seedmass"), r(F.coalesce("proto", F.lit(0.0)), "seedproto"), r("ring_qmean", "ring_qmean"), r("ring_qmax", "ring_qmax"), r(F.log1p("size"), "ring_n"))


def _depth_sql() -> str:
    parts = ["dg AS (SELECT query_id, a, count(*) AS deg FROM ur GROUP BY ALL)", "a0 AS (SELECT query_id, node_id, 1::HUGEINT AS x, m AS p FROM mass)"]
    for h in (1, 2, 3):
        parts.append(f"a{h} AS MATERIALIZED (SELECT u.query_id, u.a AS node_id, sum(x)::HUGEINT AS x, sum(p) / any_value(deg) AS p, count(*) AS n FROM ur u JOIN a{h - 1} y ON y.query_id = u.query_id AND y.node_id = u.b JOIN dg ON dg.query_id = u.query_id AND dg.a = u.a GROUP BY u.query_id, u.a)")
    return ", ".join(parts)


@query("depth_walks", " UNION ALL ".join(f"SELECT query_id, node_id, {h} AS distance, round(ln(1 + x), 5) AS paths, round(ln(1 + n), 5) AS branch, round(p, 7) AS support FROM a{h}" for h in (1, 2, 3)), RINGS + NEAR + ", " + _depth_sql())
def _(w: Workload) -> DataFrame:
    """Walks of one to three undirected links from the seeds to a candidate, neighbours that a shorter walk reaches, and the
    seed mass that averaging over neighbours brings."""
    links = w.local_edges.where("src <> dst").select("query_id", "src", "dst").union(w.local_edges.where("src <> dst").select("query_id", "dst", "src")).distinct()
    deg = links.groupBy("query_id", F.col("dst").alias("node_id")).agg(F.count("*").alias("deg"))
    at = w.seeds.groupBy("query_id").agg((1 / F.count("*")).alias("p")).join(w.seeds, "query_id").select("query_id", F.col("node_id").alias("src"), F.lit(1).cast("long").alias("x"), "p")
    out = None
    for h in (1, 2, 3):
        at = graph.cut(at.join(links, ["query_id", "src"]).groupBy("query_id", F.col("dst").alias("node_id")).agg(F.sum("x").alias("x"), F.count("*").alias("n"), F.sum("p").alias("p")).join(deg, KEY).select("query_id", F.col("node_id").alias("src"), "x", "n", (F.col("p") / F.col("deg")).alias("p")))
        part = at.select("query_id", F.col("src").alias("node_id"), F.lit(h).alias("distance"), F.round(F.log1p("x"), 5).alias("paths"), F.round(F.log1p("n"), 5).alias("branch"), F.round("p", 7).alias("support"))
        out = part if out is None else out.unionByName(part)
    return out


# Names in texts

LINK = r"""names AS (SELECT doc_id, trim(regexp_replace(lower(string_split(text, '. ')[1]), '[^\p{L}\p{N}]+', ' ', 'g'), ' ') AS name FROM documents),
idx AS (SELECT name, count(*) AS owners, min(doc_id) AS first_doc FROM names WHERE name <> '' AND len(string_split(name, ' ')) <= 8 GROUP BY name),
qt AS (SELECT item_id, string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), ' ') AS t FROM benchmark),
hit AS MATERIALIZED (SELECT item_id, i AS place, max(n) AS n FROM (SELECT item_id, t, i, unnest(range(1, 9)) AS n FROM (SELECT item_id, t, unnest(range(1, len(t) + 1)) AS i FROM qt)) JOIN idx ON name = array_to_string(t[i : i + n - 1], ' ') WHERE i + n - 1 <= len(t) GROUP BY item_id, i),
walk AS (SELECT item_id, 1::BIGINT AS place FROM qt UNION ALL SELECT w.item_id, w.place + coalesce(h.n, 1) FROM walk w JOIN qt USING (item_id) LEFT JOIN hit h ON h.item_id = w.item_id AND h.place = w.place WHERE w.place <= len(t))"""


@query("question_link", "SELECT h.item_id, h.place, h.n AS words, name, owners, first_doc FROM walk JOIN hit h USING (item_id, place) JOIN qt USING (item_id) JOIN idx ON name = array_to_string(t[h.place : h.place + h.n - 1], ' ')", LINK)
def _(w: Workload) -> DataFrame:
    """Names in items: from the left the longest run of at most eight words that is a name, then on behind it. Names are the
    first sentences of documents, if of eight words or fewer; a name stands for all of its owners, so that frequent names
    make no pairs and a name is one row; a frequent run is one key of the runs' side only, which adaptive execution splits."""
    title = T.norm_text(F.get(F.split("text", "\\. "), F.lit(0)))
    names = w.table("documents").select("doc_id", title.alias("name")).where((F.col("name") != "") & (F.size(F.split("name", " ")) <= 8)).groupBy("name").agg(F.count("*").alias("owners"), F.min("doc_id").alias("first_doc"))
    t = w.table("benchmark").where("text is not null").select("item_id", F.split(T.norm_text("text"), " ").alias("t")).select("item_id", "t", F.posexplode("t").alias("p", "_w"))
    runs = t.select("item_id", (F.col("p") + 1).cast("long").alias("place"), F.size("t").alias("all"), "t", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("words")).where("place + words - 1 <= all")
    runs = runs.select("item_id", "place", "words", F.array_join(F.slice("t", F.col("place").cast("int"), F.col("words")), " ").alias("name"))
    hits = runs.join(names, "name")
    longest = hits.groupBy("item_id", "place").agg(F.max(F.struct("words", "name", "owners", "first_doc")).alias("h"))
    # The hits of one item, in order; each is taken if it starts behind the last one taken.
    ordered = longest.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("place", "h"))).alias("hits"))
    start = F.struct(F.lit(1).cast("long").alias("free"), F.filter("hits", lambda x: F.lit(False)).alias("taken"))
    take = lambda s, x: F.when(x["place"] >= s["free"], F.struct((x["place"] + x["h"]["words"]).alias("free"), F.concat(s["taken"], F.array(x)).alias("taken"))).otherwise(s)
    return ordered.select("item_id", F.explode(F.aggregate("hits", start, take)["taken"]).alias("x")).select("item_id", "x.place", "x.h.*")
