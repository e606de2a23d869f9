"""Places and running totals over a whole table without a task that sees more than one range of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.sources.shared import cut


def running_total(df: DataFrame, order: list[str], value: str, before: str) -> DataFrame:
    """Adds `before`: the sum of `value` over all rows that come earlier in `order` (which must be total).

    Range partitions, then a sum for each partition (as many rows as partitions), then a window inside each:
    no task sees more than one range. The result is checkpointed, as the two passes must see the same partitions."""
    ranged = cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    totals = ranged.groupBy("_range").agg(F.sum(value).alias("_sum"))
    earlier = totals.withColumn("_base", F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranged.join(F.broadcast(earlier.select("_range", "_base")), "_range")
        .withColumn(before, (F.col("_base") + F.coalesce(F.sum(value).over(inside), F.lit(0))).cast("long"))
        .drop("_range", "_base")
    )


def numbered(df: DataFrame, order: list[str], name: str = "place") -> DataFrame:
    """Adds each row's place (from 0) in `order`, which must be total."""
    return running_total(df.withColumn("_one", F.lit(1)), order, "_one", name).drop("_one")


def quantiles(df: DataFrame, by: list[str], x: str, at: list[float], nearest: bool = False) -> DataFrame:
    """by, q, value: quantiles of x in each group, with linear interpolation or (nearest) by nearest rank.

    Equal values are counted first; the distinct ones are range-sorted with running counts, and only those that hold a
    wanted place are read, so a group of any size is dealt over many tasks."""
    counts = df.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count("*").alias("_c"))
    placed = running_total(counts, [*by, x], "_c", "_before")
    groups = placed.groupBy(*by).agg(F.min("_before").alias("_base"), F.sum("_c").alias("n"))
    place = lambda q: F.greatest(F.ceil(q * F.col("n")) - 1, F.lit(0)).cast("double") if nearest else q * (F.col("n") - 1).cast("double")
    wanted = groups.select(*by, "_base", F.explode(F.array(*[F.struct(F.lit(q).alias("q"), place(q).alias("p")) for q in at])).alias("w")).select(*by, "_base", "w.q", "w.p")
    first = F.col("_before") - F.col("_base")
    holds = lambda p: (first <= p) & (p < first + F.col("_c"))
    low, high = holds(F.floor("p")), holds(F.ceil("p"))
    ends = placed.join(wanted, by).where(low | high).groupBy(*by, "q", "p").agg(F.max(F.when(low, F.col(x))).alias("a"), F.max(F.when(high, F.col(x))).alias("b"))
    return ends.select(*by, "q", F.col("a").alias("value") if nearest else (F.col("a") + (F.col("b") - F.col("a")) * (F.col("p") - F.floor("p"))).alias("value"))
