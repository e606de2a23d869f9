"""Hand-computed cases of single operators."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.functions import vectors as V
from graphloom.operators import fusion, graph, metrics, stats


def lists(spark, dense, sparse):
    rows = [(0, "dense", n, i + 1) for i, n in enumerate(dense)] + [(0, "sparse", n, i + 1) for i, n in enumerate(sparse)]
    return spark.createDataFrame(rows, "query_id long, source string, node_id long, rank int")


def order(df, by="rn"):
    return [r["node_id"] for r in df.orderBy(by).collect()]


def test_rrf(spark):
    r = lists(spark, [5, 3, 9], [3, 4, 9])
    assert order(fusion.rrf(r, {"dense": 0.5, "sparse": 0.5})) == [3, 9, 5, 4]
    assert order(fusion.rrf(r, {"dense": 1.0, "sparse": 0.0})) == [5, 3, 9, 4]
    assert fusion.duplicates(lists(spark, [5, 5], [1])).count() == 1


def test_unions(spark):
    r = lists(spark, [0, 1, 2], [1, 2, 0])
    assert order(fusion.stable_union(r), "pos") == [0, 1, 2]
    assert order(fusion.seeds(r), "seed_pos") == [0, 1, 2]
    assert order(fusion.anchor(r), "node_id") == [0]
    assert order(fusion.round_robin(lists(spark, [1, 2], [3, 1])), "pos") == [1, 3, 2]


def test_budget(spark):
    assert order(fusion.budget_pool(fusion.rrf(lists(spark, [0, 1, 2], [2, 3, 4]), {"dense": 0.5, "sparse": 0.5}), 3), "pos") == [2, 0, 1]


def test_matched_budget(spark):
    c = spark.createDataFrame([(0, n, n + 1) for n in range(4)], "query_id long, node_id long, pos int")
    new = spark.createDataFrame([(0, 9, 1), (0, 8, 2), (0, 7, 3)], "query_id long, node_id long, pos int")
    safe = spark.createDataFrame([(0, 0), (0, 3)], "query_id long, node_id long")
    got = {r["node_id"]: r["status"] for r in fusion.matched_budget(c, new, safe).collect()}
    assert got == {0: "kept", 1: "evicted", 2: "evicted", 3: "kept", 9: "admitted", 8: "admitted", 7: "refused"}
    assert order(fusion.additive_pool(c, new), "pos") == [0, 1, 2, 3, 9, 8, 7]


def test_metrics(spark):
    ranking = spark.createDataFrame([(0, 7, 1), (0, 4, 2), (0, 1, 3)], "query_id long, node_id long, rn int")
    golds = spark.createDataFrame([(0, 4), (0, 9)], "query_id long, node_id long")
    found = metrics.hits(ranking, golds)
    b, c = metrics.basic(found, (1, 2, 3)).first(), metrics.conditional(found, (2, 3)).first()
    assert (b["recall_1"], b["recall_2"], b["mrr"], b["full_3"]) == (0, 0.5, 0.5, 0)
    assert (c["ceiling"], c["cond_recall_2"], c["cond_full_3"]) == (0.5, 1, 1)
    none = metrics.conditional(metrics.hits(ranking, spark.createDataFrame([(0, 99)], "query_id long, node_id long")), (1,)).first()
    assert none["cond_recall_1"] is None


def test_headroom(spark):
    found = spark.createDataFrame([(0, 3, 2, [1])], "query_id long, g long, a long, ranks array<int>")
    h = metrics.headroom(found, (1, 5)).first()
    assert (h["ceiling_1"], h["ceiling_5"], h["perfect_5"], h["lost_5"], h["lost_1"]) == (0.333333, 0.666667, 1, 0.333333, 0)


def test_weight_and_holm(spark):
    s = spark.createDataFrame([(0.0, 0.4), (0.25, 0.5), (0.5, 0.5), (0.75, 0.5)], "w double, value double")
    assert metrics.select_weight(s).first()["w"] == 0.5
    t = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", None)], "test string, p double")
    assert {r["test"]: round(r["adjusted"], 6) for r in metrics.holm(t).collect()} == {"a": 0.03, "c": 0.06, "b": 0.06}


def test_paired(spark):
    a = spark.createDataFrame([(0, 1.0), (1, 1.0)], "query_id long, v double")
    b = spark.createDataFrame([(0, 0.0), (1, 0.0)], "query_id long, v double")
    r = metrics.bootstrap(metrics.paired_deltas(a, b, "v"), 50).first()
    assert (r["mean"], r["low"]) == (1, 1)
    with pytest.raises(Exception, match="queries differ"):
        metrics.paired_deltas(a, b.where("query_id = 0"), "v").collect()


def test_graph(spark):
    e = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 4), (4, 5)], "src long, dst long")
    c = spark.createDataFrame([(0, n, n + 1) for n in (0, 1, 2)], "query_id long, node_id long, pos int")
    local = graph.induce_subgraph(c, e)
    assert sorted((r["src"], r["dst"]) for r in local.collect()) == [(0, 1), (1, 2)]
    s = spark.createDataFrame([(0, 0)], "query_id long, node_id long")
    assert sorted((r["node_id"], r["hop"]) for r in graph.bfs(s, e, 2).collect()) == [(0, 0), (1, 1), (2, 2)]
    nodes = spark.createDataFrame([(0, n) for n in (0, 1, 2, 7)], "query_id long, node_id long")
    assert {r["node_id"]: r["component"] for r in graph.components(nodes, local).collect()} == {0: 0, 1: 0, 2: 0, 7: 7}
    p = {r["node_id"]: r["rank"] for r in graph.pagerank(spark.range(6).withColumnRenamed("id", "node_id"), e).collect()}
    assert abs(sum(p.values()) - 1) < 1e-9 and p[5] > p[0]


def test_cycle_stats(spark):
    e = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 0)], "src long, dst long")
    d = stats.degree_table(e, spark.range(4).withColumnRenamed("id", "node_id"))
    assert d.agg(F.avg("deg")).first()[0] == 2
    assert stats.gini(d, [], "deg").first()["gini"] == 0


def test_vectors(spark):
    r = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, b array<double>")
    x = r.select(V.norm("a").alias("n"), V.cosine("a", "b").alias("z"), V.cosine("a", "a").alias("o"), V.unit("a").alias("u"), V.discounted_gain(F.lit(2)).alias("g")).first()
    assert (x["n"], x["z"], round(x["o"], 9), x["u"]) == (5, 0, 1, [0.6, 0.8])
    assert round(x["g"], 6) == 1.63093


def test_average_percentile(spark):
    d = spark.createDataFrame([(0, x) for x in (1, 2, 2, 3)] + [(1, 5)], "query_id int, x int")
    got = sorted((r["query_id"], r["p"]) for r in d.select("query_id", stats.average_percentile("x", ["query_id"]).alias("p")).collect())
    assert got == [(0, 0), (0, 0.5), (0, 0.5), (0, 1), (1, 0.5)]


def test_sources(spark, tmp_path):
    from graphloom.sources import tables

    (tmp_path / "e.tsv").write_text("a\tb\tx\nb\tc\ty\nbad\n")
    good, bad = tables.edges_tsv(spark, str(tmp_path / "e.tsv"))
    assert good.count() == 2 and bad.count() == 1
    ids, names = tables.interned(good)
    assert names.count() == 3 and ids.select("src").distinct().count() == 2
    tables.write_once(good, str(tmp_path / "out"))
    with pytest.raises(Exception):
        tables.write_once(good, str(tmp_path / "out"))
    runs = spark.createDataFrame([("k", "c1", 1), ("k", "c1", 2)], "key string, commit string, run int")
    with pytest.raises(Exception, match="ambiguous"):
        tables.select_run(runs, ["key"], "c1").collect()


def test_map_passages_whole(spark, tmp_path):
    """A document that shares an item's heading only does not hold it; white space may differ."""
    from graphloom.plans.queries import QUERIES

    docs = [(1, "Heading\nother words"), (2, "x\n Heading \nthe  whole\n item\ny"), (3, "Heading\nthe whole item"), (4, "the whole item")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "Heading\nthe whole item")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [tuple(r) for r in QUERIES["map_passages_whole"](spark, str(tmp_path)).select("item_id", "doc_id", "copies").collect()] == [(7, 2, 2)]


def test_artifact_digest_sees_every_line(spark, tmp_path):
    from graphloom.plans import feature_queries  # noqa: F401
    from graphloom.plans.queries import QUERIES

    seen = []
    for i, last in enumerate((1, 2)):
        rows = [("A", "F", k, n, 10.0) for k in (1, 1500, 2500000) for n in (1, last + 1)]
        spark.createDataFrame(rows, "l_returnflag string, l_linestatus string, l_orderkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/{i}/lineitem.parquet")
        seen += [r["digest"] for r in QUERIES["artifact_digest"](spark, f"{tmp_path}/{i}").collect()]
    assert len(set(seen)) == 2


def test_quantiles_by_running_counts(spark):
    """Both kinds of quantile of groups of one, of ties and of nulls against numpy."""
    import numpy as np

    from graphloom.operators.order import numbered, quantiles

    rng = random.Random(6)
    rows = [(g, float(rng.randint(0, 30)) if rng.random() > 0.1 else None) for g in "aabbbbbbbbc" for _ in range(20 if g != "c" else 1)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    at = [0.0, 0.05, 0.5, 0.9, 1.0]
    for nearest, method in ((False, "linear"), (True, "inverted_cdf")):
        got = {(r["g"], r["q"]): r["value"] for r in quantiles(df, ["g"], "x", at, nearest).collect()}
        want = {(g, q): float(np.quantile([x for k, x in rows if k == g and x is not None], q, method=method)) for g in {k for k, x in rows if x is not None} for q in at}
        assert got == pytest.approx(want)
    ids = spark.createDataFrame([(i * 7 % 101,) for i in range(101)], "id long").repartition(6)
    assert all(r["id"] == r["place"] for r in numbered(ids, ["id"]).collect())


def test_duplicates_are_errors(spark):
    from graphloom.operators import fusion

    rows = [(1, "dense", 5, 1), (1, "dense", 5, 2), (1, "sparse", 5, 1)]
    with pytest.raises(Exception, match="twice"):
        fusion.rrf(spark.createDataFrame(rows, "query_id long, source string, node_id long, rank int"), {"dense": 0.5, "sparse": 0.5}).collect()


def test_push_against_walk(spark):
    """Push estimates are short of the exact restart walk by no more than the residues that may remain."""
    import numpy as np

    from graphloom.operators import graph

    rng = random.Random(2)
    links = {(rng.randrange(30), rng.randrange(30)) for _ in range(90)}
    out = {i: [b for a, b in links if a == i] for i in range(30)}
    moves = spark.createDataFrame([(a, b, 1 / len(out[a])) for a, b in links], "src long, dst long, p double")
    got = {r["node_id"]: r["x"] for r in graph.ppr_push(spark.createDataFrame([(0, 3, 0.5), (0, 4, 0.5)], "query_id long, node_id long, x double"), moves, 0.3, 1e-4).collect()}
    step = np.array([[out[i].count(j) / len(out[i]) if out[i] else float(i == j) for j in range(30)] for i in range(30)])
    start = np.zeros(30)
    start[[3, 4]] = 0.5
    exact = 0.3 * np.linalg.solve((np.eye(30) - 0.7 * step).T, start)
    short = exact - np.array([got.get(i, 0.0) for i in range(30)])
    assert short.min() > -1e-9 and short.sum() <= 1e-4 * sum(max(len(v), 1) for v in out.values())


def test_spectrum(spark):
    import numpy as np

    from graphloom.operators.spectrum import gram, ranks_of_spectrum

    x = np.random.default_rng(4).normal(size=(200, 5)) * [5, 3, 1, 0.1, 0]
    r = ranks_of_spectrum(gram(spark.createDataFrame([(v.tolist(),) for v in x], "vec array<double>").repartition(4), "vec")).first()
    s = np.linalg.svd(x, compute_uv=False)
    p = s / s.sum()
    assert r["rows"] == 200 and r["stable_rank"] == pytest.approx((s**2).sum() / s[0] ** 2)
    assert r["effective_rank"] == pytest.approx(np.exp(-(p[p > 1e-12] * np.log(p[p > 1e-12])).sum()), rel=1e-4)


def test_sinks_and_lines(spark, tmp_path):
    """Edges with malformed lines, JSON lines, and sinks that refuse to overwrite."""
    from graphloom.sources import tables

    (tmp_path / "e.tsv").write_text("a\tb\tx\nb\tc\ty\nbroken line\n")
    good, bad = tables.edges_tsv(spark, str(tmp_path / "e.tsv"))
    assert {tuple(r) for r in good.collect()} == {("a", "b", "x"), ("b", "c", "y")} and bad.count() == 1
    edges, names = tables.interned(good)
    assert edges.count() == 2 and names.count() == 3 and tables.unique_ids(names, "node_id").count() == 3
    (tmp_path / "j.jsonl").write_text('{"id": 1, "t": "x"}\n{"id": 2}\n')
    rows = tables.jsonl(spark, str(tmp_path / "j.jsonl"), "id long, t string")
    assert [(r["id"], r["t"]) for r in rows.orderBy("id").collect()] == [(1, "x"), (2, None)]
    tables.write_once(rows, str(tmp_path / "out"))
    with pytest.raises(Exception, match="exists"):
        tables.write_once(rows, str(tmp_path / "out"))
    tables.append(rows, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_typed_chains_and_walks(spark):
    """Chains and best walks against loops over a small pool; loops, pairs outside the pool and repeats don't count."""
    from itertools import product

    from graphloom.operators import relations

    nodes, start = [1, 2, 3, 4, 5], [1, 2]
    stored = [(1, 3, 0), (3, 4, 1), (3, 4, 1), (4, 5, 2), (2, 4, 1), (5, 3, 0), (3, 3, 2), (4, 9, 0), (1, 2, 1)]
    rc = {0: 0.25, 1: -0.5, 2: 0.75}
    pool = spark.createDataFrame([(7, n) for n in nodes], "query_id long, node_id long")
    s = pool.where("node_id <= 2")
    e = relations.typed_entries(pool, spark.createDataFrame(stored, "src long, dst long, rel int")).join(spark.createDataFrame(list(rc.items()), "rel int, rc double"), "rel")
    want = {(u, v, r, 1) for u, v, r in stored if u != v and v != 9} | {(v, u, r, -1) for u, v, r in stored if u != v and v != 9}
    assert {(x.u, x.v, x.rel, x.sign) for x in e.collect()} == want and e.count() == len(want)
    c1 = {v: max(rc[r] for u, w, r, _ in want if w == v and u in start) for v in nodes if any(w == v and u in start for u, w, _, _ in want)}
    each = {}
    for u, v, r, _ in want:
        if u in c1 and u not in start and v not in start:
            each.setdefault(v, []).append((c1[u] + rc[r]) / 2)
    assert {x.node_id: (x.best, round(x["mean"], 9)) for x in relations.chains(e, s).collect()} == {v: (max(x), round(sum(x) / len(x), 9)) for v, x in each.items()}
    best = {}
    for hop in (1, 2, 3):
        for walk in product(want, repeat=hop):
            if walk[0][0] in start and all(a[1] == b[0] for a, b in zip(walk, walk[1:])):
                k = (walk[-1][1], hop)
                best[k] = max(best.get(k, -9.0), sum(rc[x[2]] for x in walk))
    got = relations.best_walks(e, s, 3).collect()
    assert {(x.node_id, x.hop): round(sum(p.rc for p in x.path), 6) for x in got} == {k: round(v, 6) for k, v in best.items()}
    assert all(len(x.path) == x.hop and x.path[0].u in start and all((a.u, b.u, a.rel, a.sign) in want for a, b in zip(x.path, x.path[1:])) for x in got)


def test_typed_relations_of_nothing(spark):
    from graphloom.operators import relations

    pool = spark.createDataFrame([], "query_id long, node_id long")
    e = relations.typed_entries(pool, spark.createDataFrame([], "src long, dst long, rel int")).withColumn("rc", F.lit(0.0))
    assert not relations.chains(e, pool).count() and not relations.best_walks(e, pool, 2).count() and not relations.typed_features(e, pool).count()


def test_t_interval_of_few(spark):
    """The quantiles of few degrees of freedom, each checked against the integral of its density."""
    import math

    for v, q in enumerate(metrics.T975, 1):
        x = (np.arange(200_000) + 0.5) * q / 200_000
        density = math.exp(math.lgamma((v + 1) / 2) - math.lgamma(v / 2)) / math.sqrt(v * math.pi) * (1 + x * x / v) ** (-(v + 1) / 2)
        assert density.sum() * q / 200_000 == pytest.approx(0.475, abs=1e-8)
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 1.0), ("b", 2.0), ("b", 6.0), ("c", 5.0)], "g string, d double")
    got = {r["g"]: r for r in metrics.t_interval(df, ["g"], "d").collect()}
    assert set(got) == {"a", "b"} and got["a"]["high"] == pytest.approx(2 + 12.7062047, abs=1e-4)
    assert got["b"]["high"] == pytest.approx(3 + 4.30265273 * math.sqrt(7) / math.sqrt(3), abs=1e-4)


def test_draw_sums(spark):
    """Task-wise sums equal a sum over the explosion of rows and draws, on any partitions."""
    rows = [(i, "ab"[i % 2], 0.1 * i) for i in range(50)]
    df = spark.createDataFrame(rows, "query_id long, g string, x double")
    each = df.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(20)))).withColumn("w", metrics.poisson_weight("draw", "query_id"))
    want = {(r["g"], r["draw"]): r for r in each.groupBy("g", "draw").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("x")).alias("s"), F.count("*").alias("n")).collect()}
    for parts in (1, 7):
        got = {(r["g"], r["draw"]): r for r in metrics.draw_sums(df.repartition(parts), ["g"], {"s": F.col("x")}, 20).collect()}
        assert set(got) == set(want)
        for k, r in got.items():
            assert r["w"] == want[k]["w"] and r["n"] == want[k]["n"] and r["s"] == pytest.approx(want[k]["s"])


def test_add_random_edges_whole(spark):
    """As many edges as wanted even where most tries fail, and all that are possible where more are wanted."""
    from graphloom.operators import perturb

    nodes = spark.range(6).withColumnRenamed("id", "node_id")
    old = [(a, b) for a in range(6) for b in range(6) if a != b and (a + b) % 3]
    for rate, want in ((0.3, round(0.3 * len(old))), (5.0, 30 - len(old))):
        edges = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(old)], "src long, dst long, edge_pos long")
        got = [tuple(r) for r in perturb.add_random_edges(edges, nodes, rate, "s").collect()]
        assert len(got) == len(set(got)) == want and not set(got) & set(old) and all(a != b for a, b in got)


def test_core_of_a_path(spark):
    """A path needs as many rounds as it is long by half; no bound stops it."""
    links = graph.both_ways(spark.createDataFrame([(i, i + 1) for i in range(12)], "a long, b long"))
    assert {r["core"] for r in graph.coreness(spark.range(13).withColumnRenamed("id", "node_id"), links).collect()} == {1}
