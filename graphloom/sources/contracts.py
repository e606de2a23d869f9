"""Sinks with a contract: counts and digests are taken in the write itself, and a manifest is published last."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class ContractError(ValueError):
    """What is stored was written under another contract, is not complete, or is not what the manifest says."""


def contract_hash(contract: dict) -> str:
    """SHA-256 of the contract as JSON with sorted keys."""
    return hashlib.sha256(json.dumps(contract, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def row_digest(df: DataFrame) -> Column:
    """32 bits of the MD5 of a row's columns as text in the order of their names, nulls apart from empty text."""
    # One array, as an expression for each of many columns is too long to be compiled.
    parts = F.transform(F.array(*[F.col(c).cast("string") for c in sorted(df.columns)]), lambda x: F.coalesce(F.concat(F.lit("="), x), F.lit("-")))
    return F.conv(F.substring(F.md5(F.concat_ws("|", parts)), 1, 8), 16, 10).cast("long")


def summed(df: DataFrame) -> list[Column]:
    """Rows and the sum of their digests: alike in any order, and partial sums add up."""
    return [F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(row_digest(df)), F.lit(0)).alias("digest")]


def manifest(spark: SparkSession, path: str) -> dict | None:
    """The manifest of a finished write, or None."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(spark._jvm.org.apache.hadoop.fs.Path(where, "_SUCCESS")):
        return None
    return json.loads("".join(r["value"] for r in spark.read.text(f"{path}/manifest").collect()))


def write(df: DataFrame, path: str, contract: dict, by: list[str] | None = None) -> dict:
    """Writes df under a contract and returns the manifest: contract, its hash, columns, rows, digest.

    Rows are counted and digested by an observation of the write, so the table isn't read again. The manifest is written when the data
    are complete; until then nothing counts as written, and another try overwrites what was left. A finished write under the
    same contract is returned as it is; under another one ContractError is raised."""
    spark, want = df.sparkSession, contract_hash(contract)
    found = manifest(spark, path)
    if found:
        if found["hash"] != want:
            raise ContractError(f"{path} holds contract {found['hash']}, not {want}")
        return found
    seen = Observation()
    writer = df.observe(seen, *summed(df)).write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(f"{path}/data")
    out = {"contract": contract, "hash": want, "columns": {f.name: f.dataType.simpleString() for f in df.schema.fields}, "rows": seen.get["rows"], "digest": seen.get["digest"]}
    spark.createDataFrame([(json.dumps(out, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return out


def read(spark: SparkSession, path: str, contract: dict, verify: bool = True) -> DataFrame:
    """The table written under a contract; with verify its rows and digest are taken again. ContractError if anything differs."""
    found = manifest(spark, path)
    if not found:
        raise ContractError(f"{path} is not complete")
    if found["hash"] != contract_hash(contract):
        raise ContractError(f"{path} holds contract {found['hash']}, not {contract_hash(contract)}")
    df = spark.read.parquet(f"{path}/data").select(*[F.col(c).cast(t).alias(c) for c, t in found["columns"].items()])
    if verify:
        got = df.agg(*summed(df)).first()
        if (got["rows"], got["digest"]) != (found["rows"], found["digest"]):
            raise ContractError(f"{path} holds {got['rows']} rows with digest {got['digest']}, the manifest says {found['rows']} and {found['digest']}")
    return df


def write_adjacency(edges: DataFrame, table: str, key: str = "src", buckets: int = 64) -> DataFrame:
    """Edges as a table bucketed and sorted by a node column: joins and groups by that column need no shuffle of them. The
    table must not exist; the name is the caller's."""
    edges.write.bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(table)
    return edges.sparkSession.table(table)
