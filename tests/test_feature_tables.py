"""The complete feature tables against plain loops on small graphs, the cap on links, and the contract of the written table."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import depth, pool
from graphloom.plans import table_queries as tables
from graphloom.sources import contracts

VIEWS = {"full": ("x",)}
N, SEEDS = 24, (0, 5, 9)


@pytest.fixture(scope="module")
def small(spark):
    rng = np.random.default_rng(4)
    pairs = sorted({(int(a), int(b)) for a, b in rng.integers(0, N - 2, (26, 2)) if a != b})
    edges = spark.createDataFrame([("x", a, b, float(a * b % 7)) for a, b in pairs] + [("x", 3, 3, 1.0)], "family string, src long, dst long, weight double")
    nodes = spark.createDataFrame([(7, i) for i in range(N)], "query_id long, node_id long")
    mass = {s: (i + 1) / 3 for i, s in enumerate(SEEDS)}
    start = spark.createDataFrame([(7, s, m) for s, m in mass.items()], "query_id long, node_id long, m double")
    a = np.zeros((N, N))
    for x, y in pairs:
        a[x, y] = a[y, x] = 1
    return nodes, edges, start, a, mass


def test_rings_and_walks(spark, small):
    nodes, edges, start, a, mass = small
    rng = np.random.default_rng(5)
    x = rng.normal(size=(N, 3))
    c = rng.normal(size=N)
    links = pool.view_links(nodes, edges, VIEWS)
    vec = spark.createDataFrame([(i, x[i].tolist()) for i in range(N)], "node_id long, vec array<double>")
    cos = spark.createDataFrame([(7, i, float(c[i])) for i in range(N)], "query_id long, node_id long, c double")
    dist = np.full((N, N), 99)
    for i in range(N):
        front, d, seen = {i}, 0, {i}
        while front:
            for v in front:
                dist[i, v] = d
            front, d = {int(u) for v in front for u in np.nonzero(a[v])[0]} - seen, d + 1
            seen |= front
    got = {(r["node_id"], r["hop"]): r for r in depth.ring_features(links, start, cos, vec, 3).collect()}
    want = 0
    for v in range(N):
        for h in (1, 2, 3):
            ring = np.nonzero(dist[v] == h)[0]
            assert ((v, h) in got) == bool(len(ring))
            if not len(ring):
                continue
            want += 1
            r, s = got[v, h], [u for u in SEEDS if dist[v, u] == h]
            assert (r["seeds_at"], r["ring_n"]) == (len(s), len(ring)) and r["seedmass"] == pytest.approx(sum(mass[u] for u in s))
            assert r["ring_qmean"] == pytest.approx(c[ring].mean()) and r["ring_qmax"] == pytest.approx(c[ring].max())
            if s:
                p = x[s].mean(0)
                assert r["seedproto"] == pytest.approx(x[v] @ p / np.linalg.norm(x[v]) / np.linalg.norm(p))
            else:
                assert r["seedproto"] is None
    assert want == len(got) > 20
    got = {(r["node_id"], r["hop"]): r for r in depth.walk_features(links, start, VIEWS).collect()}
    step = a / np.maximum(a.sum(1), 1)[:, None]
    paths, support = np.zeros(N), np.zeros(N)
    for s, m in mass.items():
        paths[s], support[s] = 1, m
    for h in (1, 2, 3):
        branch, paths, support = a @ (paths > 0), a @ paths, step @ support
        for v in range(N):
            r = got.get((v, h), {"paths": 0, "branch": 0, "support": 0.0})
            assert r["paths"] == paths[v] and r["branch"] == branch[v] and r["support"] == pytest.approx(support[v])


def test_typed_walks(spark):
    """Every typed walk from the seeds, listed one by one."""
    rng = np.random.default_rng(6)
    stored = sorted({(int(a), int(b), int(r)) for a, b, r in zip(rng.integers(0, 8, 14), rng.integers(0, 8, 14), rng.integers(0, 3, 14), strict=True) if a != b})
    rc = {0: 0.25, 1: -0.5, 2: 0.25}  # two relations alike, so that ties occur
    rows = [(7, a, b, r, 1, rc[r]) for a, b, r in stored] + [(7, b, a, r, -1, rc[r]) for a, b, r in stored]
    mass = {0: 1.0, 3: 0.5}
    e = spark.createDataFrame(rows, "query_id long, u long, v long, rel int, sign int, rc double")
    start = spark.createDataFrame([(7, s, m) for s, m in mass.items()], "query_id long, node_id long, m double")
    got = {(r["node_id"], r["hop"]): r for r in depth.typed_walks(e, start).collect()}
    heat = {v: sum(math.exp(r[5] / 0.1) for r in rows if r[2] == v) for v in range(8)}
    walks = {s: [[]] for s in mass}
    for h in (1, 2, 3):
        new = {}
        for r in rows:
            for w in walks.get(r[1], []):
                new.setdefault(r[2], []).append([*w, r])
        walks = new
        assert {v for v, k in got if k == h} == set(walks)
        for v, all_ in walks.items():
            g = got[v, h]
            means = [sum(r[5] for r in w) / h for w in all_]
            assert g["walks"] == len(all_) and g["best"] == pytest.approx(max(means)) and g["mean"] == pytest.approx(np.mean(means)) and g["narrow"] == max(min(r[5] for r in w) for w in all_)
            assert g["qsupport"] == pytest.approx(sum(mass[w[0][1]] * math.prod(math.exp(r[5] / 0.1) / heat[r[2]] for r in w) for w in all_))
            # The last step is decided first: of the best, the smallest node, relation and sign, then the same for the rest.
            first = min((w for w, m in zip(all_, means, strict=True) if m > max(means) - 1e-9), key=lambda w: [(r[1], r[3], r[4]) for r in reversed(w)])
            assert [(p["u"], p["rel"], p["sign"]) for p in g["path"]] == [(r[1], r[3], r[4]) for r in first]


def test_first_links_of_a_node(spark):
    """A hub keeps its heaviest links, then those of smaller nodes; a leaf keeps its link to the hub, so that it counts."""
    nodes = spark.createDataFrame([(1, i) for i in range(6)], "query_id long, node_id long")
    edges = spark.createDataFrame([("x", 0, i, w) for i, w in ((1, 1.0), (2, 3.0), (3, 3.0), (4, 2.0))] + [("x", 2, 3, 9.0), ("x", 4, 2, 1.0), ("x", 3, 0, 5.0), ("x", 1, 1, 1.0)], "family string, src long, dst long, weight double")
    of = lambda most: {(r["src"], r["dst"]) for r in pool.view_links(nodes, edges, VIEWS, most).collect()}
    both = lambda *p: {x for a, b in p for x in ((a, b), (b, a))}
    assert of(None) == of(4) == both((0, 1), (0, 2), (0, 3), (0, 4), (2, 3), (2, 4))
    assert of(1) == both((0, 3), (0, 1), (2, 3), (0, 4))
    assert pool.view_links(nodes, edges.limit(0), VIEWS, 1).count() == 0


def test_contract(spark, tmp_path):
    assert [len(tables.DEPTH), len(tables.ORDERED), len(tables.GROUP_OF)] == [73, 13, 197]
    assert all(c["mask"] in ("", *tables.GROUP_OF) for c in tables.CONTRACT["columns"])
    w = tables.Linked(spark, "/root/testdata/sf0.001")
    path = f"{tmp_path}/features"
    table = tables.write_table(w, path).cache()
    assert table.count() == w.candidates.count() and table.columns == ["query_id", "node_id", *tables.GROUP_OF]
    for c in tables.CONTRACT["columns"]:  # where its mask is 0, a column is 0
        if c["mask"]:
            assert table.where((F.col(c["mask"]) == 0) & (F.col(c["name"]) != 0)).count() == 0, c
    for v in tables.VIEWS:  # the four distances and none of them are one of five cases
        assert table.where(" + ".join(f"{d}_{v}" for d in ("dist_0", "dist_1", "dist_2", "dist_3", "unreached")) + " <> 1").count() == 0
    with pytest.raises(contracts.ContractError):
        contracts.read(spark, path, tables.CONTRACT | {"in_pool": 32})
    with pytest.raises(contracts.ContractError, match="lacks is_seed"):
        tables.described(spark, table.drop("is_seed"), tables.CONTRACT)
    one = {r["column"]: r for r in tables.described(spark, table, tables.CONTRACT).collect()}
    assert one["is_seed"]["other_than_0"] == w.seeds.count() and one["is_seed"]["column_group"] == "retrieval"


def test_pool_edges_and_seeds_are_made_once(spark):
    """The local features read them a dozen times; each time they were joined anew from all stored edges and ranked lists."""
    from graphloom.plans.wide_queries import local_features
    from graphloom.plans.workload import Workload

    w = Workload(spark, "/root/testdata/sf0.001")
    for part in (w.local_edges, w.seeds):
        assert part._jdf.queryExecution().withCachedData().toString().startswith("InMemoryRelation")
    assert local_features(w).count() == w.candidates.count()


def test_wide_tables_are_described_and_digested_value_by_value(spark):
    """Nulls, whole numbers and a table without rows; the digest is that of all columns side by side, as before."""
    contract = {"columns": [{"name": n, "group": "g", "mask": ""} for n in ("a", "b", "c")]}
    table = spark.createDataFrame([(1, 0.5, None), (0, -2.0, None), (3, None, None)], "a int, b double, c double")
    got = tables.described(spark, table, contract)
    assert "Generate posexplode" in got._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in got.orderBy("place").collect()] == [(0, "a", "g", "", 3, 2, 0.0, 3.0), (1, "b", "g", "", 2, 2, -2.0, 0.5), (2, "c", "g", "", 0, 0, None, None)]
    assert [tuple(r)[4:] for r in tables.described(spark, table.where("a > 9"), contract).collect()] == [(0, 0, None, None)] * 3
    side = F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in ("a", "b", "c")])
    old = F.conv(F.substring(F.md5(side), 1, 8), 16, 10).cast("long")
    assert table.select((contracts.row_digest(table) == old).alias("same")).where("same").count() == 3
    assert "transform" in table.select(contracts.row_digest(table))._jdf.queryExecution().optimizedPlan().toString()
