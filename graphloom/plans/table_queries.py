"""Registered queries: the complete feature tables of a pool's candidates, with the nearest-neighbour family, and their contract."""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import vectors as V
from graphloom.operators import depth, graph, knn, pool, relations
from graphloom.plans import contract_queries as base
from graphloom.plans.feature_queries import KEY
from graphloom.plans.link_queries import TYPED, entries
from graphloom.plans.queries import BODIES, ORACLES, QUERIES
from graphloom.plans.search_queries import KNN, exact_lists
from graphloom.plans.workload import SQL, Workload
from graphloom.sources import contracts
from graphloom.sources.shared import shared_folder

#: view -> families of edges; a pool's links of a family are the first IN_POOL of a node.
VIEWS = {"struct": ("structural",), "ner": ("ner",), "knn": ("knn",), "full": ("structural", "ner", "knn")}
FAMILIES = tuple(v for v in VIEWS if v != "full")
DEEP = ("struct", "full")
IN_POOL, HOPS, TEMPERATURE = 64, (1, 2, 3), 0.1


class Linked(Workload):
    """The workload whose edges have a third family: the graph of the nearest neighbours of all nodes, weighted by similarity."""

    @cached_property
    def edges(self) -> DataFrame:
        near = graph.cut(knn.undirected(exact_lists(self)))
        return super().edges.unionByName(near.select(F.lit("knn").alias("family"), F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(-1).alias("rel"), F.col("score").alias("weight"), F.lit(None).cast("long").alias("edge_pos")))

    @cached_property
    def links(self) -> DataFrame:
        return graph.cut(pool.view_links(self.candidates, self.edges, VIEWS, IN_POOL))


#: The common tables in SQL with that family.
LINKED = KNN + ", " + SQL.replace("p_retailprice, p_partkey FROM part, nn)", "p_retailprice, p_partkey FROM part, nn\n   UNION ALL SELECT 'knn', a, b, -1, score, NULL FROM ku)")


def query(name: str, sql: str, more: str):
    def put(f):
        BODIES[name] = f
        QUERIES[name] = lambda spark, sf_dir: f(Linked(spark, sf_dir))
        ORACLES[name] = f"WITH RECURSIVE {LINKED}, {more} {sql}"
        return f

    return put


# The wide table of one graph

CAPPED = f"""fl0 AS (SELECT family, src, dst, max(weight) AS weight FROM (SELECT family, src, dst, weight FROM edges WHERE src <> dst UNION ALL SELECT family, dst, src, weight FROM edges WHERE src <> dst) GROUP BY ALL),
fl1 AS MATERIALIZED (SELECT * FROM (SELECT a.query_id, family, src, dst, row_number() OVER (PARTITION BY a.query_id, family, src ORDER BY weight DESC, dst) AS place FROM fl0 JOIN candidates a ON a.node_id = src JOIN candidates b ON b.query_id = a.query_id AND b.node_id = dst) WHERE place <= {IN_POOL}),
fl AS (SELECT query_id, family, src, dst FROM fl1 UNION SELECT query_id, family, dst, src FROM fl1)"""
TOPOLOGY = CAPPED + base.TOPOLOGY[base.TOPOLOGY.index(",\nvl AS") :].replace("(VALUES ('struct'), ('ner'), ('full'))", "(VALUES ('struct'), ('ner'), ('knn'), ('full'))")
NEAR_WEIGHTS = base.WEIGHTS.replace("'ner'", "'knn'").replace("ew AS", "ek AS").replace("JOIN ew", "JOIN ek").replace("ws AS", "wk5 AS").replace("wmax_seed", "wmax_seed_knn").replace("wsum_seed", "wsum_seed_knn")
SMOOTHED = base.SMOOTHED.replace("n.view <> 'ner'", "n.view IN ('struct', 'full')")
BY_VIEW = [f"{c}_{v}" for v in VIEWS for c in base.TOPOLOGY_COLUMNS]
BY_FAMILY = [f"{c}_{v}" for v in FAMILIES for c in base.NEIGHBOUR_COLUMNS]
WEIGHTS = ("wmax_seed", "wsum_seed", "wmax_seed_knn", "wsum_seed_knn")
COLUMNS = {
    "retrieval": base.RETRIEVAL_COLUMNS, "topology": tuple(BY_VIEW), "edge_weights": WEIGHTS, "neighbour_aggregation": tuple(BY_FAMILY), "smoothing": ("gcs_full", "gcs_struct"),
    "seed_conditioned": base.SEED_COLUMNS, "typed_relations": base.TYPED_WIDE,
}


def wide_sql(columns: list[str], source: str) -> str:
    return "(SELECT query_id, node_id, " + ", ".join(f"max({c.rsplit('_', 1)[0]}) FILTER (view = '{c.rsplit('_', 1)[1]}') AS {c}" for c in columns) + f" FROM {source} GROUP BY ALL)"


FEATURES = ", ".join((base.RETRIEVAL, TOPOLOGY, base.WEIGHTS, NEAR_WEIGHTS, base.NEIGHBOURS, SMOOTHED, base.SEEDED, TYPED, base.TYPED_WIDE_SQL))
FEATURES += f""", features AS (SELECT query_id, node_id, {", ".join(c for g in COLUMNS for c in COLUMNS[g] if g != "typed_relations")}, {", ".join(f"coalesce({c}, 0) AS {c}" for c in base.TYPED_WIDE if c != "typed_available")}, (SELECT (count(*) > 0)::INT FROM structural) AS typed_available
  FROM rv0 JOIN {wide_sql(BY_VIEW, "topo")} USING (query_id, node_id) JOIN {wide_sql(BY_FAMILY, "nc")} USING (query_id, node_id) JOIN ws USING (query_id, node_id) JOIN wk5 USING (query_id, node_id)
  JOIN (SELECT query_id, node_id, max(p) FILTER (view = 'full') AS gcs_full, max(p) FILTER (view = 'struct') AS gcs_struct FROM g2 GROUP BY ALL) USING (query_id, node_id) JOIN sz USING (query_id, node_id) LEFT JOIN tf USING (query_id, node_id) LEFT JOIN ch USING (query_id, node_id))"""


@query("feature_table", "SELECT * FROM features", FEATURES)
def features(w: Linked) -> DataFrame:
    """All 111 features of a candidate in its pool, with those of the nearest-neighbour family."""
    return base.whole(w, VIEWS, w.links)


# By distance

RING = ("seeds_at", "seedmass", "has", "ring_qmean", "ring_qmax", "ring_n", "seedproto")
WALK = ("paths", "branch", "support")
PATHS = ("qsupport", "typed_walks", "relpath_max", "relpath_mean", "relpath_min")
DEPTH = [f"{c}_h{h}_{v}" for v in DEEP for h in HOPS for c in RING + WALK if c != "branch" or h > 1] + [f"{c}_h{h}" for h in HOPS for c in PATHS]


def places(c: str) -> int:
    """Digits shown: what comes from compatibilities, which have six, needs more than five, or halves would fall either way."""
    return 9 if c.startswith("relpath") or c.startswith("opath") and "adj" not in c else 5


def _rings_sql() -> str:
    on = "y.query_id = x.query_id AND y.view = x.view AND y.a = x.b"
    parts = ["dv AS MATERIALIZED (SELECT query_id, view, src AS a, dst AS b FROM vl WHERE view IN ('struct', 'full'))"]
    parts.append(f"d2 AS MATERIALIZED (SELECT x.query_id, x.view, x.a, y.b FROM dv x JOIN dv y ON {on} WHERE x.a <> y.b EXCEPT SELECT * FROM dv)")
    parts.append(f"d3 AS MATERIALIZED (SELECT x.query_id, x.view, x.a, y.b FROM d2 x JOIN dv y ON {on} WHERE x.a <> y.b EXCEPT (SELECT * FROM dv UNION SELECT * FROM d2))")
    parts.append("dr AS (SELECT *, 1 AS d FROM dv UNION ALL SELECT *, 2 FROM d2 UNION ALL SELECT *, 3 FROM d3)")
    parts.append("sd0 AS (SELECT query_id, node_id, rrf / max(rrf) OVER (PARTITION BY query_id) AS m FROM rv0), sm0 AS MATERIALIZED (SELECT * FROM sd0 SEMI JOIN seeds USING (query_id, node_id))")
    parts.append("dc AS MATERIALIZED (SELECT query_id, node_id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS c FROM candidates JOIN embeddings q ON q.vec_id = query_id JOIN embeddings v ON v.vec_id = node_id)")
    parts.append("""dq AS (SELECT query_id, view, a, d, list_cosine_similarity(any_value(embedding)::DOUBLE[], list(x ORDER BY i)) AS seedproto FROM (SELECT r.query_id, r.view, r.a, r.d, i, avg(u.embedding[i]::DOUBLE) AS x FROM dr r JOIN sm0 s ON s.query_id = r.query_id AND s.node_id = r.b
      JOIN embeddings u ON u.vec_id = r.b CROSS JOIN range(1, 65) t(i) GROUP BY ALL) JOIN embeddings ON vec_id = a GROUP BY query_id, view, a, d)""")
    parts.append("""dn AS MATERIALIZED (SELECT r.query_id, r.view, r.a AS node_id, r.d, ln(1 + count(m)) AS seeds_at, coalesce(sum(m), 0) AS seedmass, (count(m) > 0)::INT AS has, avg(c) AS ring_qmean, max(c) AS ring_qmax, ln(1 + count(*)) AS ring_n, any_value(seedproto) AS seedproto
      FROM dr r JOIN dc ON dc.query_id = r.query_id AND dc.node_id = r.b LEFT JOIN sm0 s ON s.query_id = r.query_id AND s.node_id = r.b LEFT JOIN dq ON dq.query_id = r.query_id AND dq.view = r.view AND dq.a = r.a AND dq.d = r.d GROUP BY ALL)""")
    parts.append("dw0 AS (SELECT query_id, view, node_id, 1::HUGEINT AS paths, m AS support FROM sm0, (VALUES ('struct'), ('full')) t(view))")
    for h in HOPS:
        parts.append(f"dw{h} AS MATERIALIZED (SELECT l.query_id, l.view, l.b AS node_id, sum(paths)::HUGEINT AS paths, count(*) AS branch, sum(support) / any_value(deg) AS support FROM dv l JOIN dw{h - 1} y ON y.query_id = l.query_id AND y.view = l.view AND y.node_id = l.a JOIN dp ON dp.query_id = l.query_id AND dp.view = l.view AND dp.node_id = l.b GROUP BY l.query_id, l.view, l.b)")
    parts.append("dwa AS (" + " UNION ALL ".join(f"SELECT query_id, view, node_id, {h} AS d, ln(1 + paths) AS paths, ln(1 + branch) AS branch, support FROM dw{h}" for h in HOPS) + ")")
    return ", ".join(parts)


def _typed_sql() -> str:
    step = "STRUCT(u BIGINT, rel INT, sign INT, rc DOUBLE)"
    parts = [f"eh AS MATERIALIZED (SELECT query_id, u, v, rel, sign, rc, h / sum(h) OVER (PARTITION BY query_id, v) AS w FROM (SELECT *, exp((rc - max(rc) OVER (PARTITION BY query_id, v)) / {TEMPERATURE}) AS h FROM ent))"]
    parts.append(f"tw0 AS (SELECT query_id, node_id AS u, 1::HUGEINT AS walks, 0.0::DOUBLE AS total, 0.0::DOUBLE AS best, 'infinity'::DOUBLE AS narrow, m AS qsupport, []::{step}[] AS path FROM sm0)")
    for h in HOPS:
        pick = "{'less': -round(best + rc, 6), 'u': e.u::BIGINT, 'rel': rel::INT, 'sign': sign::INT, 'rc': rc::DOUBLE, 'path': path}"
        parts.append(f"ts{h} AS (SELECT e.query_id, e.v, sum(walks)::HUGEINT AS walks, sum(total + walks * rc) AS total, max(least(narrow, rc)) AS narrow, sum(qsupport * w) AS qsupport, min({pick}) AS c FROM tw{h - 1} b JOIN eh e ON e.query_id = b.query_id AND e.u = b.u GROUP BY e.query_id, e.v)")
        parts.append(f"tw{h} AS MATERIALIZED (SELECT query_id, v AS u, walks, total, -c.less AS best, narrow, qsupport, list_append(c.path, {{'u': c.u, 'rel': c.rel, 'sign': c.sign, 'rc': c.rc}}) AS path FROM ts{h})")
    parts.append("twa AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT query_id, u AS node_id, {h} AS d, qsupport, ln(1 + walks) AS typed_walks, best / {h} AS relpath_max, total / ({h} * walks) AS relpath_mean, narrow AS relpath_min, path FROM tw{h}" for h in HOPS) + ")")
    return ", ".join(parts)


def _at(source: str, columns: tuple[str, ...], views: tuple[str, ...] = ()) -> str:
    picks = [f"max({c}) FILTER (d = {h}{f''' AND view = '{v}' ''' if v else ''}) AS {c}_h{h}{f'_{v}' if v else ''}" for v in views or ("",) for h in HOPS for c in columns if c != "branch" or h > 1]
    return f"(SELECT query_id, node_id, {', '.join(picks)} FROM {source} GROUP BY ALL)"


DEPTH_SQL = _rings_sql() + ", " + _typed_sql() + ", deep AS (SELECT query_id, node_id, " + ", ".join(f"round(coalesce({c}, 0), {places(c)}) + 0.0 AS {c}" for c in DEPTH) + f""" FROM (SELECT query_id, node_id FROM candidates) LEFT JOIN {_at("dn", RING, DEEP)} USING (query_id, node_id)
  LEFT JOIN {_at("dwa", WALK, DEEP)} USING (query_id, node_id) LEFT JOIN {_at("twa", PATHS)} USING (query_id, node_id))"""


def seed_mass(w: Linked) -> DataFrame:
    """query_id, node_id, m: the fused score of each seed over the query's largest."""
    top = base.retrieval(w).groupBy("query_id").agg(F.max("rrf").alias("top"))
    return base.retrieval(w).where("is_seed = 1").join(top, "query_id").select(*KEY, (F.col("rrf") / F.col("top")).alias("m"))


def pick(df: DataFrame, columns: dict[str, Column | str], views: tuple[str, ...] = ()) -> DataFrame:
    """One row a candidate from rows by hop (and view): column_h1 ..., or column_h1_view ..."""
    d = lambda h, v: (F.col("hop") == h) & (F.col("view") == v) if v else F.col("hop") == h
    name = lambda c, h, v: f"{c}_h{h}_{v}" if v else f"{c}_h{h}"
    return df.groupBy(*KEY).agg(*[F.max(F.when(d(h, v), x if isinstance(x, Column) else F.col(x))).alias(name(c, h, v)) for v in views or ("",) for h in HOPS for c, x in columns.items() if c != "branch" or h > 1])


def typed_walks(w: Linked, start: DataFrame) -> DataFrame:
    return depth.typed_walks(entries(w), start, len(HOPS), TEMPERATURE)


def by_distance(w: Linked, start: DataFrame, walks: DataFrame) -> DataFrame:
    c = w.candidates.select(*KEY)
    vec = w.vectors.select("node_id", "vec")
    cos = c.join(vec, "node_id").join(w.queries.select("query_id", F.col("vec").alias("q")), "query_id").select(*KEY, V.cosine("q", "vec").alias("c"))
    links = w.links.where(F.col("query_id.view").isin(*DEEP))
    log = lambda x: F.log1p(F.col(x))
    rings = depth.ring_features(links, start, cos, vec, base.DIM)
    ring = pick(rings, dict.fromkeys(RING, "") | {"seeds_at": log("seeds_at"), "seedmass": "seedmass", "has": (F.col("seeds_at") > 0).cast("int"), "ring_qmean": "ring_qmean", "ring_qmax": "ring_qmax", "ring_n": log("ring_n"), "seedproto": "seedproto"}, DEEP)
    walk = pick(depth.walk_features(links, start, {v: VIEWS[v] for v in DEEP}), {"paths": log("paths"), "branch": log("branch"), "support": "support"}, DEEP)
    typed = pick(walks, {"qsupport": "qsupport", "typed_walks": log("walks"), "relpath_max": "best", "relpath_mean": "mean", "relpath_min": "narrow"})
    for part in (ring, walk, typed):
        c = c.join(graph.cut(part), KEY, "left")
    return c.select(*KEY, *[(F.round(F.coalesce(x, F.lit(0.0)), places(x)) + 0.0).alias(x) for x in DEPTH])


@query("depth_table", "SELECT * FROM deep", ", ".join((base.RETRIEVAL, TOPOLOGY, TYPED, DEPTH_SQL)))
def _(w: Linked) -> DataFrame:
    """The 73 features of a candidate by distance: rings and walks in the typed and in the whole graph, and typed walks."""
    start = graph.cut(seed_mass(w))
    return by_distance(w, start, typed_walks(w, start))


# The best typed walk, place by place

LENGTHS = (2, 3)
PLACES = [(f"opath_h{h}_q{k}", "rc", h, k) for h in LENGTHS for k in range(1, h + 1)] + [(f"opath_h{h}_dir{k}", "sign", h, k) for h in LENGTHS for k in range(1, h + 1)] + [(f"opath_h{h}_adj{k}{k + 1}", "turn", h, k) for h in LENGTHS for k in range(1, h)]
ORDERED = [c for c, *_ in PLACES]
ORDERED_SQL = """st0 AS (SELECT query_id, node_id, d, k, path[k].rc AS rc, path[k].sign AS sign, list_cosine_similarity(x.rel_vec, y.rel_vec) AS turn FROM (SELECT *, unnest(range(1, d + 1)) AS k FROM twa WHERE d > 1) JOIN rv x ON x.rel = path[k].rel LEFT JOIN rv y ON y.rel = path[k + 1].rel),
opath AS (SELECT query_id, node_id, """ + ", ".join(f"round(coalesce({c}, 0), {places(c)}) + 0.0 AS {c}" for c in ORDERED) + """ FROM (SELECT query_id, node_id FROM candidates) LEFT JOIN (SELECT query_id, node_id, """ + ", ".join(f"max({x}) FILTER (d = {h} AND k = {k}) AS {c}" for c, x, h, k in PLACES) + " FROM st0 GROUP BY ALL) USING (query_id, node_id))"


def ordered(w: Linked, walks: DataFrame) -> DataFrame:
    rel = relations.relation_vectors(w.structural, w.vectors)
    steps = walks.where("hop > 1").select(*KEY, "hop", "path", F.posexplode("path").alias("at", "s")).select(*KEY, "hop", (F.col("at") + 1).alias("k"), "s.rel", "s.rc", "s.sign", F.get("path", F.col("at") + 1)["rel"].alias("next"))
    pairs = steps.select("rel", "next").where("next is not null").distinct()
    turn = pairs.join(rel, "rel").join(rel.select(F.col("rel").alias("next"), F.col("rel_vec").alias("to")), "next").select("rel", "next", V.cosine("rel_vec", "to").alias("turn"))
    found = steps.join(turn, ["rel", "next"], "left").groupBy(*KEY).agg(*[F.max(F.when((F.col("hop") == h) & (F.col("k") == k), F.col(x))).cast("double").alias(c) for c, x, h, k in PLACES])
    return w.candidates.select(*KEY).join(found, KEY, "left").select(*KEY, *[(F.round(F.coalesce(c, F.lit(0.0)), places(c)) + 0.0).alias(c) for c in ORDERED])


@query("ordered_table", "SELECT * FROM opath", ", ".join((base.RETRIEVAL, TOPOLOGY, TYPED, DEPTH_SQL, ORDERED_SQL)))
def _(w: Linked) -> DataFrame:
    """The 13 features of the best typed walks of two and of three steps: each step's compatibility with the query, its direction, and
    the cosine between its relation and the next."""
    return ordered(w, typed_walks(w, graph.cut(seed_mass(w))))


# The contract of all

def mask_of(c: str) -> str:
    """The column that tells an absence from a zero, or none."""
    stem, _, at = c.partition("_h")
    if stem in ("seeds_at", "seedmass", "seedproto"):
        return f"has_h{at}"
    if stem in ("ring_qmean", "ring_qmax"):
        return f"ring_n_h{at}"
    return f"typed_walks_h{at[0]}" if stem in ("qsupport", "relpath_max", "relpath_mean", "relpath_min", "opath") else ""


GROUP_OF = {c: g for g, columns in COLUMNS.items() for c in columns} | dict.fromkeys(DEPTH, "depth_basis") | dict.fromkeys(ORDERED, "ordered_path")
CONTRACT = {
    "name": "candidate-features", "version": 1, "columns": [{"name": c, "group": g, "mask": mask_of(c)} for c, g in GROUP_OF.items()], "views": {v: list(f) for v, f in VIEWS.items()},
    "in_pool": IN_POOL, "temperature": TEMPERATURE, "hops": list(HOPS), "smoothing": {"keep": 0.5, "rounds": 2}, "fusion": 60,
}


def write_table(w: Linked, path: str) -> DataFrame:
    """All 197 features under their contract: written, read again, verified."""
    start = graph.cut(seed_mass(w))
    walks = typed_walks(w, start)
    table = features(w).join(by_distance(w, start, walks), KEY).join(ordered(w, walks), KEY)
    contracts.write(table.select(*KEY, *GROUP_OF), path, CONTRACT)
    return contracts.read(w.spark, path, CONTRACT).select(*KEY, *GROUP_OF)


def described(spark: SparkSession, table: DataFrame, contract: dict) -> DataFrame:
    """One row a column of a contract: place, name, group, mask, rows, rows that differ from 0, least and largest value. The table
    is read once, value by value under the column's place, as one aggregate of four sums a column is too wide to be compiled; a
    column that the table lacks raises ContractError."""
    columns = contract["columns"]
    lacks = [c["name"] for c in columns if c["name"] not in table.columns]
    if lacks:
        raise contracts.ContractError(f"the table lacks {', '.join(lacks)}")
    values = table.select(F.posexplode(F.array(*[F.col(c["name"]).cast("double") for c in columns])).alias("place", "x"))
    found = values.groupBy("place").agg(F.count("x").alias("filled"), F.count(F.when(F.col("x") != 0, 1)).alias("other_than_0"), F.min("x").alias("least"), F.max("x").alias("largest"))
    entry = lambda i, c: F.struct(F.lit(i).alias("place"), F.lit(c["name"]).alias("column"), F.lit(c["group"]).alias("column_group"), F.lit(c["mask"]).alias("mask"))
    named = spark.range(1).select(F.inline(F.array(*[entry(i, c) for i, c in enumerate(columns)])))
    number = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return named.join(F.broadcast(found), "place", "left").select("place", "column", "column_group", "mask", number("filled"), number("other_than_0"), "least", "largest")  # found: a row a column


@query("feature_table_contract", "SELECT place, column_name AS \"column\", column_group, mask, count(value) AS filled, count(*) FILTER (value <> 0) AS other_than_0, min(value) AS least, max(value) AS largest FROM (UNPIVOT (SELECT " + ", ".join(f"{c}::DOUBLE AS {c}" for c in GROUP_OF) + " FROM features JOIN deep USING (query_id, node_id) JOIN opath USING (query_id, node_id)) ON COLUMNS(*) INTO NAME column_name VALUE value) JOIN (VALUES "
  + ", ".join(f"({i}, '{c['name']}', '{c['group']}', '{c['mask']}')" for i, c in enumerate(CONTRACT["columns"])) + ") t(place, column_name, column_group, mask) USING (column_name) GROUP BY ALL", FEATURES + ", " + DEPTH_SQL + ", " + ORDERED_SQL)
def _(w: Linked) -> DataFrame:
    """The contract of all features beside what the written and verified table holds of each."""
    return described(w.spark, write_table(w, f"{shared_folder(w.spark)}/features-{uuid.uuid4().hex}"), CONTRACT)
