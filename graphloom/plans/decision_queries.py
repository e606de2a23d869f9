"""Registered queries: rescues of errors, a preregistered selection rule, movement of pools and places of golds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import decisions
from graphloom.plans.feature_queries import KEY
from graphloom.plans.gate_queries import RUNS, run_deltas
from graphloom.plans.queries import QUERIES, query  # noqa: F401
from graphloom.plans.workload import Workload

CUTOFFS = [1, 5, 10, 20]
SYSTEMS = "sr AS (SELECT query_id, source AS system, node_id, rank FROM ranked UNION ALL SELECT query_id, 'fused', node_id, rn FROM rrf)"
RESCUE = SYSTEMS + """, hb AS (SELECT query_id, system, min(rank) AS best FROM sr JOIN (SELECT DISTINCT query_id, node_id FROM golds) USING (query_id, node_id) GROUP BY ALL),
er AS (SELECT query_id FROM (SELECT DISTINCT query_id FROM sr) WHERE query_id IN (SELECT query_id FROM hb) AND query_id NOT IN (SELECT query_id FROM hb WHERE system = 'fused' AND best = 1)),
rr AS (SELECT query_id, system, best FROM er CROSS JOIN (SELECT DISTINCT system FROM sr) LEFT JOIN hb USING (query_id, system)),
rc AS (SELECT query_id, system, cutoff, coalesce(best <= cutoff, false)::INT AS ok FROM rr CROSS JOIN (VALUES (1), (5), (10), (20)) t(cutoff) WHERE system <> 'fused'),
ra AS (SELECT cutoff, query_id, max(ok) AS a FROM rc GROUP BY ALL),
rt AS (SELECT cutoff, system AS rescuer, sum(ok) AS n FROM rc GROUP BY ALL UNION ALL SELECT cutoff, 'any', sum(a) FROM ra GROUP BY cutoff UNION ALL SELECT cutoff, 'none', sum(1 - a) FROM ra GROUP BY cutoff),
rz AS (SELECT (SELECT count(*) FROM er) AS population, (SELECT count(*) FROM (SELECT DISTINCT query_id FROM sr) WHERE query_id NOT IN (SELECT query_id FROM hb)) AS lost)"""


def systems(w: Workload) -> DataFrame:
    return w.ranked.select("query_id", F.col("source").alias("system"), "node_id", "rank").union(w.rrf.select("query_id", F.lit("fused"), "node_id", "rn"))


@query("rescue_rows", "SELECT query_id, system, best FROM rr", RESCUE)
def _(w: Workload) -> DataFrame:
    """Queries whose first fused node is no gold: the best rank of a gold in each list."""
    return decisions.rescue_rows(systems(w), w.golds, "fused")[0].select("query_id", "system", "best")


@query("rescue_table", "SELECT cutoff, rescuer, n::BIGINT AS n, round(n / population, 6) AS share, population, lost, round(lost / (lost + population), 6) AS lost_share FROM rt, rz", RESCUE)
def _(w: Workload) -> DataFrame:
    """Which list ranks a gold high where the fused list's first node is none."""
    return decisions.rescue_table(*decisions.rescue_rows(systems(w), w.golds, "fused"), "fused", CUTOFFS)


#: In percentage points, declared before any result: tolerance of the mean, floors of a dataset's mean and of a cell.
TOLERANCE, GROUP_FLOOR, CELL_FLOOR = -0.5, -2.0, -5.0


@query("selection_rule", f"""SELECT datasets, macro, macro >= {TOLERANCE} AS macro_within, failing_datasets, failing_cells::BIGINT AS failing_cells, gray::BIGINT AS gray, CASE WHEN failing_datasets > 0 OR failing_cells > 0 THEN 'NOT_ADVANCED' WHEN gray > 0 THEN 'GRAY' WHEN macro >= {TOLERANCE} THEN 'ADVANCED' ELSE 'NOT_ADVANCED' END AS outcome FROM
  (SELECT * EXCLUDE (g), g + (macro >= {CELL_FLOOR} AND macro < {TOLERANCE})::INT AS gray FROM (SELECT count(*) AS datasets, round(avg(m), 6) AS macro, count(*) FILTER (m < {GROUP_FLOOR}) AS failing_datasets, sum(low) AS failing_cells, sum(gray) + count(*) FILTER (m >= {CELL_FLOOR} AND m < {TOLERANCE}) AS g FROM sd))""",
  RUNS + f""", sc AS (SELECT split AS dataset, run AS regime, round(100 * avg(delta), 6) AS delta FROM rh JOIN queries USING (query_id) WHERE run > 0 AND run < 1 GROUP BY ALL),
sd AS (SELECT dataset, round(avg(delta), 9) AS m, count(*) FILTER (delta < {CELL_FLOOR}) AS low, count(*) FILTER (delta >= {CELL_FLOOR} AND delta < {TOLERANCE}) AS gray FROM sc GROUP BY dataset)""")
def _(w: Workload) -> DataFrame:
    """Fused against dense recall at 10 under a rule declared before: splits are the datasets, three weights the regimes."""
    cells = run_deltas(w).where("run > 0 and run < 1").join(w.queries.select("query_id", "split"), "query_id").groupBy(F.col("split").alias("dataset"), F.col("run").alias("regime")).agg(F.round(100 * F.avg("delta"), 6).alias("delta"))
    return decisions.selection(cells, 3, TOLERANCE, GROUP_FLOOR, CELL_FLOOR)


@query("pool_movement", """SELECT query_id, count(*) FILTER (b AND a) AS kept, count(*) FILTER (a AND NOT b) AS added, count(*) FILTER (b AND NOT a) AS dropped, count(*) FILTER (a AND NOT b AND g) AS golds_added, count(*) FILTER (b AND NOT a AND g) AS golds_dropped
  FROM (SELECT query_id, node_id, bool_or(b) AS b, bool_or(a) AS a, (query_id, node_id) IN (SELECT (query_id, node_id) FROM golds) AS g FROM (SELECT query_id, node_id, true AS b, false AS a FROM ranked WHERE source = 'dense' AND rank <= 20 UNION ALL SELECT query_id, node_id, false, true FROM rrf WHERE rn <= 20) GROUP BY query_id, node_id) GROUP BY query_id""")
def _(w: Workload) -> DataFrame:
    """What enters and leaves a pool of twenty when the fused list takes the dense one's place."""
    return decisions.movement(w.ranked.where("source = 'dense' and rank <= 20"), w.rrf.where("rn <= 20"), w.golds)


@query("gold_places", "SELECT query_id, node_id, " + ", ".join(f"coalesce(max(rank) FILTER (system = '{s}'), -1)::INT AS {s}" for s in ("dense", "sparse", "fused")) + " FROM (SELECT DISTINCT query_id, node_id FROM golds) LEFT JOIN sr USING (query_id, node_id) GROUP BY query_id, node_id", SYSTEMS)
def _(w: Workload) -> DataFrame:
    """The place of every gold in each list, -1 where it is absent."""
    return decisions.place_of(systems(w), w.golds.select(*KEY), ["dense", "sparse", "fused"])
