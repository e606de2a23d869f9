"""Exact dedup by content sort, in DataFrame operations only.

Rows are range-partitioned by content with the splitters that Spark samples, sorted externally inside each range, and
neighbours are compared in full. The range key is (first bytes, 64-bit hash of the whole text, piece): equal texts share
it, so a run of equal texts lies in one range and is settled there. Only a text that fills more than a part of the table is
dealt over several pieces; of each of its runs one border row is compared in full with the others'."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, hot_keys


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", prefix: int = 48, parts: int | None = None) -> DataFrame:
    """Every row with its group of equal texts: id, keep_id, group_size, kept, text_sha256.

    keep: "max" or "min" identifier of a group stays. Null text counts as the empty text. Of repeated rows with the kept
    identifier one stays. A null identifier stays only in a group that has no other. Empty table: no rows. Further
    columns of the input are not carried. parts: a text on more than 1/parts of the rows is dealt over several pieces (so
    there are at most `parts` such texts, and 2 * parts border rows); 8 times the shuffle partitions by default."""
    best = {"max": F.max, "min": F.min}[keep]
    last = F.col("doc_id").asc_nulls_first() if keep == "max" else F.col("doc_id").desc_nulls_first()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("_hash", F.xxhash64("text"))
    hot = hot_keys(rows.groupBy("_hash").agg(F.count("*").alias("n")), "_hash", parts)
    dealt = rows.join(F.broadcast(hot), "_hash", "left").withColumns({"_prefix": F.substring("text", 1, prefix), "_piece": F.pmod(F.xxhash64("doc_id"), F.coalesce("pieces", F.lit(1))).cast("int")})

    key = ["_prefix", "_hash", "_piece"]
    near = Window.partitionBy(*key).orderBy("text", last)
    compared = (
        dealt.repartitionByRange(*key)
        .withColumn("_first", ~F.col("text").eqNullSafe(F.lag("text").over(near)))
        .withColumn("_last", ~F.col("text").eqNullSafe(F.lead("text").over(near)))
        .withColumn("_run", F.sum(F.col("_first").cast("int")).over(near.rowsBetween(Window.unboundedPreceding, 0)))
    )
    border = F.when(F.col("_last") & F.col("pieces").isNotNull(), F.col("text")).alias("border")
    narrow = compared.select("doc_id", F.sha2("text", 256).alias("text_sha256"), *key, "_run", "_last", border)
    # A run outside the hot texts has at most 1/parts of the rows, without their texts.
    run = Window.partitionBy(*key, "_run")
    settled = cut(narrow.withColumns({"keep_id": best("doc_id").over(run), "group_size": F.count("*").over(run)}))

    joined = settled.where("border is not null").select(*key, "_run", "border", "keep_id", "group_size")
    whole = joined.groupBy("_hash", "border").agg(best("keep_id").alias("_keep"), F.sum("group_size").alias("_size"))
    over = joined.join(whole, ["_hash", "border"]).select(*key, "_run", "_keep", "_size")
    out = settled.join(F.broadcast(over), [*key, "_run"], "left").select("doc_id", F.coalesce("_keep", "keep_id").alias("keep_id"), F.coalesce("_size", "group_size").alias("group_size"), "_last", "text_sha256")
    return out.select("doc_id", "keep_id", "group_size", (F.col("_last") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), "text_sha256")


def drop_exact(docs: DataFrame, id_col: str = "doc_id", keep: str = "max") -> DataFrame:
    """The rows of docs that stay, with their columns; the text is shuffled once for the sort and once here, by (id, digest).
    Nulls, repeated rows and the empty table as in exact_dedup."""
    name = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    kept = exact_dedup(docs, id_col, keep=keep).where("kept").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("__dup_id"), F.col("text_sha256").alias("__dup_sha"))
    keyed = docs.withColumns({"__dup_id": name, "__dup_sha": F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)})
    return keyed.join(kept, ["__dup_id", "__dup_sha"], "left_semi").dropDuplicates(["__dup_id", "__dup_sha"]).select(*docs.columns)
