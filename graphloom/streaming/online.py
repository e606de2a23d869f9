"""Online requests: a stream of ranked lists is fused, cut to a pool and joined with the static graph, batch by batch.

Where a request is complete in one micro-batch, nothing is kept between batches (serve). Where its rows can come more than once, by
retries of the sender, once() keeps what it has seen for as long as the watermark says, and links joins them with the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.operators import fusion, graph

REQUEST = "query_id long, source string, node_id long, rank int"


def answer(ranked: DataFrame, edges: DataFrame, budget: int = 20) -> DataFrame:
    """query_id, node_id, pos, score, links: the fused pool, with each node's edges inside the pool."""
    fused = fusion.rrf(ranked, {"dense": 0.5, "sparse": 0.5})
    pool = fusion.budget_pool(fused, budget)
    local = graph.induce_subgraph(pool, edges)
    ends = local.select("query_id", F.col("src").alias("node_id"), "mult").union(local.select("query_id", "dst", "mult"))
    links = ends.groupBy("query_id", "node_id").agg(F.sum("mult").alias("links"))
    return pool.join(fused.select("query_id", "node_id", "score"), ["query_id", "node_id"]).join(links, ["query_id", "node_id"], "left").fillna(0, ["links"])


def serve(requests: DataFrame, edges: DataFrame, out: str, checkpoint: str, budget: int = 20) -> StreamingQuery:
    """Answers a stream of requests into a Parquet table, partitioned by batch: a batch that is repeated after a failure
    overwrites its own folder."""

    def each(batch: DataFrame, batch_id: int) -> None:
        answer(batch, edges, budget).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return requests.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def once(requests: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each (query_id, source, node_id) of a stream with a time ts once: a row that was seen within `late` before goes, in whatever
    batch it comes. State is kept by key and dropped behind the watermark, so it doesn't grow with the stream."""
    return requests.withWatermark("ts", late).dropDuplicatesWithinWatermark(["query_id", "source", "node_id"])


def links(requests: DataFrame, edges: DataFrame) -> DataFrame:
    """query_id, source, node_id, rank, ts, links: the rows of a stream with the number of edges that leave or enter the node
    (0: none), by a join of the stream with the static table, which is aggregated once a batch."""
    ends = edges.select(F.col("src").alias("node_id")).union(edges.select("dst"))
    degree = ends.groupBy("node_id").agg(F.count("*").alias("links"))
    return requests.join(degree, "node_id", "left").select("query_id", "source", "node_id", "rank", "ts", F.coalesce("links", F.lit(0)).alias("links"))


def serve_once(requests: DataFrame, edges: DataFrame, out: str, checkpoint: str, late: str = "10 minutes") -> StreamingQuery:
    """Appends the answers of once() and links() to a Parquet table; the sink's log makes a repeated batch count once."""
    stream = links(once(requests, late), edges).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return stream.outputMode("append").trigger(availableNow=True).start()


def event_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by type and tumbling window, with a watermark: works on a stream and on a table alike."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")
