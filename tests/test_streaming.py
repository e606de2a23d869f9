"""The online path on a stream, and event counts on a stream against a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import graph
from graphloom.streaming import online


def test_serve(spark, tmp_path):
    rows = [(q, s, (q + r * (1 if s == "dense" else 2)) % 7, r) for q in (0, 1, 2) for s in ("dense", "sparse") for r in (1, 2, 3)]
    ranked = spark.createDataFrame(rows, online.REQUEST)
    ranked.write.parquet(str(tmp_path / "in"))
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 1), (1, 1)], "src long, dst long")
    stream = spark.readStream.schema(online.REQUEST).parquet(str(tmp_path / "in"))
    online.serve(stream, edges, str(tmp_path / "out"), str(tmp_path / "cp"), 4).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    want = online.answer(ranked, edges, 4)
    assert got.count() == want.count() and got.select(*want.columns).exceptAll(want).count() == 0


def test_replayed_requests(spark, tmp_path):
    """Rows sent again in the same and in later batches are answered once; the same key long after is new."""
    shape = "query_id long, source string, node_id long, rank int, ts timestamp"
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1, 12)
    at = lambda m: start + timedelta(minutes=m)
    batches = [
        [(1, "dense", 5, 1, at(0)), (1, "dense", 5, 1, at(0)), (1, "sparse", 5, 1, at(1))],
        [(1, "dense", 5, 1, at(3)), (2, "dense", 7, 1, at(4))],
        [(1, "sparse", 5, 1, at(9)), (3, "dense", 9, 2, at(60))],
        [(4, "dense", 9, 2, at(61)), (3, "dense", 9, 2, at(62))],
        [(1, "dense", 5, 1, at(90))],
    ]
    edges = spark.createDataFrame([(5, 7), (7, 5), (5, 5)], "src long, dst long")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, shape).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i}"))
        stream = spark.readStream.schema(shape).parquet(str(tmp_path / "in" / "*"))
        online.serve_once(stream, edges, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = sorted((r["query_id"], r["source"], r["node_id"], (r["ts"] - start).seconds // 60, r["links"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(1, "dense", 5, 0, 4), (1, "dense", 5, 90, 4), (1, "sparse", 5, 1, 4), (2, "dense", 7, 4, 2), (3, "dense", 9, 60, 0), (4, "dense", 9, 61, 0)]


def test_event_counts(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet("/root/testdata/sf0.001/events.parquet*")
    q = online.event_counts(stream, late="60 days").writeStream.outputMode("complete").format("memory").queryName("counted").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("counted").exceptAll(online.event_counts(events)).count() == 0 and spark.table("counted").agg(F.sum("n")).first()[0] == events.count()


def test_coreness(spark):
    pairs = [(a, b) for a in range(4) for b in range(a)] + [(4, 0), (4, 1), (5, 4), (7, 6)]
    links = graph.both_ways(spark.createDataFrame(pairs, "a long, b long"))
    got = {r["node_id"]: r["core"] for r in graph.coreness(spark.range(9).withColumnRenamed("id", "node_id"), links).collect()}
    degree, left, core, k = {}, {i: set() for i in range(9)}, {}, 0
    for a, b in pairs:
        left[a].add(b)
        left[b].add(a)
    while left:
        n = min(left, key=lambda i: (len(left[i]), i))
        k = max(k, len(left[n]))
        core[n] = k
        for m in left.pop(n):
            left[m].discard(n)
    assert got == core
