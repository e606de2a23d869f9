"""Readers and sinks. Schemas are stated, never inferred, except for Parquet, which carries its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def parquet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def edges_tsv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(edges src, dst, label; malformed lines) of a three-column tab-separated file."""
    rows = spark.read.csv(path, sep="\t", mode="PERMISSIVE", schema="src string, dst string, label string, _bad string", columnNameOfCorruptRecord="_bad").withColumn("_ok", F.col("_bad").isNull() & F.col("label").isNotNull())
    return rows.where("_ok").select("src", "dst", "label"), rows.where("not _ok").select("src", "dst", "label", "_bad")


def interned(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges with integer node ids, and the dictionary (name, node_id). Ids are 64-bit hashes of the names, so no task
    numbers all nodes; a clash of two names raises."""
    names = edges.select(F.col("src").alias("name")).union(edges.select("dst")).distinct().withColumn("node_id", F.xxhash64("name"))
    clash = names.groupBy("node_id").agg(F.count("*").alias("n")).where("n > 1")
    if not clash.isEmpty():
        raise ValueError("two node names share an id")
    return edges.select(F.xxhash64("src").alias("src"), F.xxhash64("dst").alias("dst"), "label"), names


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_once(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Fails if the path exists; the commit protocol makes the write atomic."""
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def select_run(runs: DataFrame, key: list[str], commit: str) -> DataFrame:
    """The one physical run of each logical key at a commit; several are an error that surfaces when read."""
    w = Window.partitionBy(*key)
    return runs.where(F.col("commit") == commit).withColumn("_n", F.count("*").over(w)).withColumn("_ok", F.when(F.col("_n") > 1, F.raise_error(F.lit("ambiguous run"))).otherwise(True)).where("_ok").drop("_n", "_ok")


def unique_ids(df: DataFrame, column: str) -> DataFrame:
    """Raises when read if a value of the column repeats (a bijection check)."""
    n = F.count("*").over(Window.partitionBy(column))
    return df.withColumn("_n", n).where(F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("duplicate "), F.col(column).cast("string")))).otherwise(True)).drop("_n")
