"""Registered queries: intervals over runs and systems, and gates that choose among sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators import fusion, gate, graph, metrics
from graphloom.plans.queries import _ppr_sql, query
from graphloom.plans.workload import Workload

DENSE_WEIGHTS = [0.0, 0.25, 0.5, 0.75, 1.0]


def poisson_sql(draw: str, key: str) -> str:
    u = f"((('0x' || substr(md5({draw} || ':' || {key}), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)"
    return "(" + " + ".join(f"({u} > {t!r}::DOUBLE)::INT" for t in metrics.POISSON) + ")"


# Intervals

RUNS = f"""rw AS (SELECT query_id, w, node_id, row_number() OVER (PARTITION BY query_id, w ORDER BY score DESC, node_id) AS rn FROM (SELECT query_id, w, node_id, round(sum(CASE source WHEN 'dense' THEN w ELSE 1 - w END / (60 + rank)), 9) AS score FROM ranked, (VALUES (0.0::DOUBLE), (0.25), (0.5), (0.75), (1.0)) t(w) GROUP BY ALL)),
rh AS (SELECT t.w AS run, g.query_id, round(count(rn) FILTER (rn <= 10) / count(*) - count(rank) FILTER (rank <= 10) / count(*), 6) AS delta FROM golds g CROSS JOIN (VALUES (0.0::DOUBLE), (0.25), (0.5), (0.75), (1.0)) t(w) LEFT JOIN rw ON rw.query_id = g.query_id AND rw.w = t.w AND rw.node_id = g.node_id LEFT JOIN ranked d ON d.query_id = g.query_id AND d.node_id = g.node_id AND d.source = 'dense' GROUP BY ALL),
hs AS MATERIALIZED (SELECT draw, run, sum(x * delta) AS s, sum(x) AS w FROM (SELECT draw, run, delta, {poisson_sql("draw", "query_id")} AS x FROM rh, range(1, 1001) t(draw)) GROUP BY ALL),
hp AS (SELECT *, row_number() OVER (PARTITION BY draw ORDER BY run) - 1 AS place, count(*) OVER (PARTITION BY draw) AS runs FROM hs),
ht AS (SELECT draw, ('0x' || substr(md5('run:' || draw || ':' || slot), 1, 8))::BIGINT % 5 AS place FROM range(1, 1001) t(draw), range(0, 5) r(slot)),
hm AS (SELECT draw, round(sum(s) / nullif(count(*) * max(w), 0), 9) AS m FROM hp JOIN ht USING (draw, place) GROUP BY draw)"""


PAIRED = f"""pd AS (SELECT g.query_id, round(count(f.rn) FILTER (f.rn <= 5) / count(*), 6) - round(count(d.rank) FILTER (d.rank <= 5) / count(*), 6) AS delta FROM golds g LEFT JOIN rrf f USING (query_id, node_id) LEFT JOIN ranked d ON d.query_id = g.query_id AND d.node_id = g.node_id AND d.source = 'dense' GROUP BY g.query_id),
pm AS (SELECT draw, round(sum(x * delta) / nullif(sum(x), 0), 9) AS m FROM (SELECT draw, delta, {poisson_sql("draw", "query_id")} AS x FROM pd, range(1, 1001) t(draw)) GROUP BY draw)"""


@query("paired_bootstrap", "SELECT round(avg(m), 6) + 0.0 AS mean, round(quantile_cont(m, 0.025), 6) + 0.0 AS low, round(quantile_cont(m, 0.975), 6) + 0.0 AS high, round(avg((m > 0)::INT), 6) AS positive FROM pm", PAIRED)
def _(w: Workload) -> DataFrame:
    """Fused against dense recall at 5."""
    r5 = lambda r: metrics.basic(metrics.hits(r, w.golds)).select("query_id", "recall_5")
    dense = w.ranked.where("source = 'dense'").select("query_id", "node_id", F.col("rank").alias("rn"))
    out = metrics.bootstrap(metrics.paired_deltas(r5(w.rrf), r5(dense), "recall_5"))
    return out.select(*[(F.round(c, 6) + 0.0).alias(c) for c in ("mean", "low", "high")], F.round("positive", 6).alias("positive"))


LABELS = RUNS + f""", ds AS (SELECT run, split, query_id, delta FROM rh JOIN queries USING (query_id)),
dm AS (SELECT run, split, draw, round(sum(x * delta) / nullif(sum(x), 0), 9) AS m FROM (SELECT *, {poisson_sql("draw", "query_id")} AS x FROM ds, range(1, 1001) t(draw)) GROUP BY ALL),
il AS MATERIALIZED (SELECT run, split, mean, low, high, CASE WHEN same THEN 'SAME' WHEN low > 0 THEN 'ABOVE' WHEN high < 0 THEN 'BELOW' ELSE 'AT' END AS label FROM (SELECT run, split, round(avg(delta), 6) + 0.0 AS mean, max(abs(delta)) = 0 AS same FROM ds GROUP BY ALL) JOIN (SELECT run, split, round(quantile_cont(m, 0.025), 6) + 0.0 AS low, round(quantile_cont(m, 0.975), 6) + 0.0 AS high FROM dm GROUP BY ALL) USING (run, split))"""


def run_deltas(w: Workload) -> DataFrame:
    """run, query_id, delta: recall at 10 of five fused runs less that of the dense list."""
    runs = fusion.rrf_weights(w.ranked, DENSE_WEIGHTS)
    g = w.golds.withColumn("w", F.explode(F.array(*[F.lit(x) for x in DENSE_WEIGHTS])))
    dense = w.ranked.where("source = 'dense'").select("query_id", "node_id", "rank")
    j = g.join(runs.select("query_id", "w", "node_id", "rn"), ["query_id", "w", "node_id"], "left").join(dense, ["query_id", "node_id"], "left")
    share = lambda c: F.count(F.when(F.col(c) <= 10, 1)) / F.count("*")
    return j.groupBy(F.col("w").alias("run"), "query_id").agg(F.round(share("rn") - share("rank"), 6).alias("delta"))


@query("hierarchical_ci", "SELECT (SELECT count(DISTINCT run) FROM rh) AS runs, (SELECT round(avg(delta), 6) + 0.0 FROM rh) AS mean, round(quantile_cont(m, 0.025), 6) + 0.0 AS low, round(quantile_cont(m, 0.975), 6) + 0.0 AS high FROM hm", RUNS)
def _(w: Workload) -> DataFrame:
    """Recall at 10 of five fused runs against the dense list, resampled by runs and then by queries."""
    return metrics.two_level_bootstrap(run_deltas(w))


@query("ci_verdicts", "SELECT il.*, CASE WHEN bool_or(label = 'BELOW') OVER (PARTITION BY run) THEN 'NOT_ADOPTED' WHEN bool_or(label = 'ABOVE') OVER (PARTITION BY run) THEN 'ADOPT' ELSE 'NO_EFFECT' END AS verdict FROM il", LABELS)
def _(w: Workload) -> DataFrame:
    """Each run against the dense list by split: label of the interval, and the run's verdict over all splits."""
    labels = graph.cut(metrics.interval_labels(run_deltas(w).join(w.queries.select("query_id", "split"), "query_id"), ["run", "split"]))
    return labels.join(metrics.adoption(labels, ["run"]), "run")


SYSTEMS = f"""sy AS (SELECT 'top' AS system, query_id, node_id, rn FROM rrf UNION ALL SELECT CASE source WHEN 'dense' THEN 'middle' ELSE 'base' END, query_id, node_id, rank FROM ranked),
sv AS (SELECT system, g.query_id, round(count(rn) FILTER (rn <= 5) / count(*), 6) AS recall_5, round(count(rn) FILTER (rn <= 10) / count(*), 6) AS recall_10, round(coalesce(1 / min(rn), 0), 6) AS mrr FROM golds g CROSS JOIN (VALUES ('top'), ('middle'), ('base')) t(system) LEFT JOIN sy USING (system, query_id, node_id) GROUP BY ALL),
sw AS (SELECT query_id, measure, max(x) FILTER (system = 'base') AS base, max(x) FILTER (system = 'middle') AS middle, max(x) FILTER (system = 'top') AS top FROM (UNPIVOT sv ON recall_5, recall_10, mrr INTO NAME measure VALUE x) GROUP BY ALL),
sg AS (SELECT measure, 0 AS draw, round(avg(top - base), 9) AS top_gain, round(avg(middle - base), 9) AS middle_gain, round(avg(top - middle), 9) AS gap FROM sw GROUP BY measure
  UNION ALL SELECT measure, draw, round(sum(x * (top - base)) / nullif(sum(x), 0), 9), round(sum(x * (middle - base)) / nullif(sum(x), 0), 9), round(sum(x * (top - middle)) / nullif(sum(x), 0), 9) FROM (SELECT *, {poisson_sql("draw", "query_id")} AS x FROM sw, range(1, 1001) t(draw)) GROUP BY measure, draw),
sl AS (UNPIVOT (SELECT *, CASE WHEN top_gain > 0 THEN middle_gain / top_gain ELSE '-Infinity'::DOUBLE END AS share FROM sg) ON top_gain, middle_gain, gap, share INTO NAME stat VALUE x),
so AS (SELECT *, row_number() OVER (PARTITION BY measure, stat, draw = 0 ORDER BY x) AS plc, count(*) OVER (PARTITION BY measure, stat, draw = 0) AS n FROM sl)"""


@query("ratio_share_ci", "SELECT measure, stat, round(nullif(max(x) FILTER (draw = 0), '-Infinity'::DOUBLE), 6) + 0.0 AS point, round(nullif(max(x) FILTER (draw > 0 AND plc = greatest(ceil(0.025::DOUBLE * n), 1)), '-Infinity'::DOUBLE), 6) + 0.0 AS low, round(nullif(max(x) FILTER (draw > 0 AND plc = greatest(ceil(0.975::DOUBLE * n), 1)), '-Infinity'::DOUBLE), 6) + 0.0 AS high FROM so GROUP BY measure, stat", SYSTEMS)
def _(w: Workload) -> DataFrame:
    """What the dense list keeps of the fused list's gain over the sparse one, on three measures."""
    names = ("recall_5", "recall_10", "mrr")
    of = lambda ranking: metrics.basic(metrics.hits(ranking, w.golds)).select("query_id", F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), F.col(n).alias("x")) for n in names])).alias("s")).select("query_id", "s.*")
    one = lambda source: w.ranked.where(F.col("source") == source).select("query_id", "node_id", F.col("rank").alias("rn"))
    j = of(one("sparse")).withColumnRenamed("x", "base")
    for name, ranking in (("middle", one("dense")), ("top", w.rrf)):
        j = j.join(of(ranking).withColumnRenamed("x", name), ["query_id", "measure"])
    return metrics.share_interval(j)


# Gates

SIZES = (5, 10, 20, 50)
#: class -> weights of the sources; single sources first, as ties go to the first.
CLASSES = {"D": {"dense": 1.0}, "S": {"sparse": 1.0}, "W": {"walk": 1.0}, "DS": {"dense": 0.5, "sparse": 0.5}, "SW": {"sparse": 0.5, "walk": 0.5}, "DSW": {"dense": 1 / 3, "sparse": 1 / 3, "walk": 1 / 3}}


def _areas_sql() -> str:
    grid = " + ".join(f"(2 - (count(rn) FILTER (rn <= {n}) = count(*))::INT - count(rn) FILTER (rn <= {n}) / count(*))" for n in SIZES)
    of = lambda c, name: f"(SELECT c.query_id, c.{c}, round({grid}, 6) AS area FROM (SELECT query_id, node_id AS gold, {c} FROM golds JOIN (SELECT DISTINCT query_id, {c} FROM {name}) USING (query_id)) c LEFT JOIN {name} o ON o.query_id = c.query_id AND o.{c} = c.{c} AND o.node_id = c.gold GROUP BY ALL)"
    values = ", ".join(f"('{c}', {i}, '{s}', {w!r}::DOUBLE)" for i, (c, ws) in enumerate(CLASSES.items()) for s, w in ws.items())
    return (
        "msrc AS MATERIALIZED (SELECT query_id, source, node_id, (1.0::DOUBLE / (60 + rank)) / sum(1.0::DOUBLE / (60 + rank)) OVER (PARTITION BY query_id, source) AS m FROM ranked UNION ALL SELECT query_id, 'walk', node_id, x / sum(x) OVER (PARTITION BY query_id) FROM x8 WHERE x > 0), "
        f"cl AS (SELECT * FROM (VALUES {values}) t(class, place, source, w)), "
        "od AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, class ORDER BY mass DESC, node_id) AS rn FROM (SELECT query_id, class, node_id, round(sum(m * w), 9) AS mass FROM msrc JOIN cl USING (source) GROUP BY ALL)) WHERE rn <= 50), "
        f"ca AS MATERIALIZED {of('class', 'od')}, "
        "pr AS (SELECT class, exp(-avg(area)) AS p FROM ca JOIN queries USING (query_id) WHERE split = 'train' GROUP BY class), "
        "ch AS (SELECT query_id, class, place, round(p / sum(p) OVER (PARTITION BY query_id), 9) AS p FROM (SELECT DISTINCT query_id, class FROM od) JOIN pr USING (class) JOIN (SELECT DISTINCT class, place FROM cl) USING (class)), "
        "hd AS (SELECT query_id, class FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY p DESC, place) AS r FROM ch) WHERE r = 1), "
        "sf AS MATERIALIZED (SELECT query_id, source, round(sum(p * w), 9) AS w FROM ch JOIN cl USING (class) GROUP BY ALL), "
        "so2 AS (SELECT * FROM (SELECT *, 1 AS one, row_number() OVER (PARTITION BY query_id ORDER BY mass DESC, node_id) AS rn FROM (SELECT query_id, node_id, round(sum(m * w), 9) AS mass FROM msrc JOIN sf USING (query_id, source) GROUP BY ALL)) WHERE rn <= 50), "
        f"sa AS {of('one', 'so2')}"
    )


GATES = _ppr_sql() + ", " + _areas_sql()


def source_masses(w: Workload) -> DataFrame:
    """query_id, source, node_id, m: reciprocal ranks of both lists and the walk in the pool, each scaled to 1."""
    lists = w.ranked.select("query_id", "source", "node_id", (1 / (60 + F.col("rank"))).alias("m"))
    walk = graph.ppr_local(w.candidates, w.seeds, w.local_edges).where("mass > 0").select("query_id", F.lit("walk").alias("source"), "node_id", F.col("mass").alias("m"))
    return graph.cut(lists.unionByName(walk).withColumn("m", F.col("m") / F.sum("m").over(Window.partitionBy("query_id", "source"))))


def class_table(w: Workload) -> DataFrame:
    return w.spark.createDataFrame([(c, i, s, x) for i, (c, ws) in enumerate(CLASSES.items()) for s, x in ws.items()], "class string, place int, source string, w double")


def class_orders(w: Workload, masses: DataFrame) -> DataFrame:
    return graph.cut(gate.blend(masses, class_table(w), ["query_id", "class"], 50))


@query("class_areas", "SELECT query_id, class, area FROM ca", GATES)
def _(w: Workload) -> DataFrame:
    """The area above each class's curves of full coverage and recall, for each query."""
    orders = class_orders(w, source_masses(w))
    return gate.areas(orders, w.golds, orders.select("query_id", "class").distinct(), ["query_id", "class"], SIZES)


@query("rank_gate", "SELECT query_id, hd.class AS hard, ca.area AS hard_area, sa.area AS soft_area, " + ", ".join(f"coalesce(max(w) FILTER (source = '{s}'), 0) AS w_{s}" for s in ("dense", "sparse", "walk")) + " FROM hd JOIN ca USING (query_id, class) JOIN sa USING (query_id) JOIN sf USING (query_id) GROUP BY query_id, hd.class, ca.area, sa.area", GATES)
def _(w: Workload) -> DataFrame:
    """The likeliest class with an order and the average of all classes' weights, with the areas of both orders. A class's
    chance is exp(-mean area) over the training queries."""
    masses = source_masses(w)
    orders, classes = class_orders(w, masses), class_table(w)
    each = graph.cut(gate.areas(orders, w.golds, orders.select("query_id", "class").distinct(), ["query_id", "class"], SIZES))
    prior = each.join(w.queries.where("split = 'train'").select("query_id"), "query_id").groupBy("class").agg(F.exp(-F.avg("area")).alias("p"))
    places = classes.select("class", "place").distinct()
    # As many rows as classes.
    chances = gate.available(orders.select("query_id").distinct().crossJoin(F.broadcast(prior.join(places, "class"))), orders).withColumn("p", F.round("p", 9))
    weights = graph.cut(gate.soft_weights(chances, classes.drop("place")))
    soft = gate.areas(gate.blend(masses, weights, ["query_id"], 50), w.golds, orders.select("query_id").distinct(), ["query_id"], SIZES)
    wide = weights.groupBy("query_id").agg(*[F.coalesce(F.max(F.when(F.col("source") == s, F.col("w"))), F.lit(0.0)).alias(f"w_{s}") for s in ("dense", "sparse", "walk")])
    hard = gate.hard_choice(chances).join(each, ["query_id", "class"]).select("query_id", F.col("class").alias("hard"), F.col("area").alias("hard_area"))
    return hard.join(soft.withColumnRenamed("area", "soft_area"), "query_id").join(wide, "query_id")


SOURCES = ("dense", "sparse", "walk")


def gate_rows(w: Workload) -> tuple[DataFrame, DataFrame]:
    """query_id, split, x (standardised over the training queries: how many nodes both lists share, the gap between the first two
    scores of each list), and the training queries' golds with their masses and weights."""
    first = lambda s, r: F.max(F.when((F.col("source") == s) & (F.col("rank") == r), F.col("score")))
    both = w.ranked.groupBy("query_id", "node_id").agg(F.count("*").alias("n")).groupBy("query_id").agg(F.count(F.when(F.col("n") > 1, 1)).cast("double").alias("f0"))
    gaps = w.ranked.where("rank <= 2").groupBy("query_id").agg(*[(first(s, 1) - F.coalesce(first(s, 2), F.lit(0.0))).alias(f"f{i}") for i, s in ((1, "dense"), (2, "sparse"))])
    raw = graph.cut(w.queries.select("query_id", "split").join(both, "query_id").join(gaps, "query_id"))
    at = raw.where("split = 'train'").agg(*[x for i in range(3) for x in (F.avg(f"f{i}").alias(f"m{i}"), F.stddev_pop(f"f{i}").alias(f"s{i}"))])
    x = F.array(*[(F.col(f"f{i}") - F.col(f"m{i}")) / F.when(F.col(f"s{i}") > 1e-6, F.col(f"s{i}")).otherwise(1.0) for i in range(3)])
    scaled = raw.crossJoin(F.broadcast(at)).select("query_id", "split", x.alias("x"))
    mass = source_masses(w).groupBy("query_id", "node_id").agg(*[F.coalesce(F.max(F.when(F.col("source") == s, F.col("m"))), F.lit(0.0)).alias(s) for s in SOURCES])
    train = scaled.where("split = 'train'")
    n = train.agg(F.count("*").alias("n"))
    golds = train.join(w.golds, "query_id").crossJoin(F.broadcast(n)).withColumn("w", 1 / (F.col("n") * F.count("*").over(Window.partitionBy("query_id"))))
    return scaled, golds.join(mass, ["query_id", "node_id"], "left").select("query_id", "x", F.array(*[F.coalesce(s, F.lit(0.0)) for s in SOURCES]).alias("m"), "w")


@query("em_gate")
def _(w: Workload) -> DataFrame:
    """Each query's weights of the sources by a gate fitted to the golds of the training queries. The fit has no SQL form; tests
    compare it with the same rounds in numpy."""
    scaled, golds = gate_rows(w)
    model, _trace = gate.fit_gate(golds, len(SOURCES), 3)
    return scaled.select("query_id", "split", *[F.round(g, 6).alias(f"w_{s}") for s, g in zip(SOURCES, gate.gate_column(model))])
