"""What the training-data operators share: Arrow mapping, samples and joins on skewed keys."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.order import running_total  # noqa: F401
from graphloom.sources.shared import cut, shared_folder, stash  # noqa: F401

#: ASCII white space; whatever lies between two of these characters is a word.
WORD = r"[^\x20\x09-\x0D]+"


def map_batches(df: DataFrame, each: Callable[..., dict], schema: str, rows: int = 512, setup: Callable | None = None) -> DataFrame:
    """mapInArrow in slices of at most `rows` rows. each(columns: dict of lists) returns columns as lists or arrays;
    with setup, each(columns, setup()) and setup runs once a task."""
    from pyspark.sql.types import StructType

    shape = StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(shape)
        extra = (setup(),) if setup else ()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                out = each(batch.slice(at, rows).to_pydict(), *extra)
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, shape)


def bounded_sample(df: DataFrame, id_col: str, most: int, ties: tuple[str, ...] = ()) -> DataFrame:
    """At most `most` rows, those of smallest hash of their identifier; rows that repeat it are ordered by the columns `ties`. A first pass counts rows, so that the hash bound
    leaves about a fifth more than are wanted; only those reach the driver's final ordering, however many tasks there are."""
    n = df.select(id_col).where(F.col(id_col).isNotNull()).count()
    place = F.pmod(F.xxhash64(id_col), F.lit(1 << 40))
    near = df.where(F.col(id_col).isNotNull() & (place < F.lit(int((1 << 40) * min(1.0, 1.2 * (most + 50) / max(n, 1))))))
    return near.orderBy(place, id_col, *ties).limit(most)


def hot_keys(counts: DataFrame, key: str | list[str], parts: int | None = None) -> DataFrame:
    """(key, pieces) of the keys of counts (key, n) that hold more than the `parts`-th share of all rows, so at most `parts`
    of them: a table of bounded size. pieces is in how many of that share a key's rows are to be dealt."""
    keys = [key] if isinstance(key, str) else key
    parts = parts or 8 * int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = counts.agg(F.sum("n").alias("_total"))
    shared = counts.crossJoin(F.broadcast(total)).where(F.col("n") * parts > F.col("_total"))  # total: one row
    return cut(shared.select(*keys, F.ceil(F.col("n") * parts / F.col("_total")).cast("int").alias("pieces")))


def spread_join(many: DataFrame, one: DataFrame, key: str | list[str], hot: DataFrame, by: str, how: str = "inner") -> DataFrame:
    """many join one (a row a key) on key. The rows of a hot key are dealt over its pieces by the hash of `by`, and its row
    of `one` is repeated for each piece; other keys are joined as they are. hot is of bounded size and broadcast."""
    keys = [key] if isinstance(key, str) else key
    pieces = F.coalesce("pieces", F.lit(1))
    left = many.join(F.broadcast(hot), keys, "left").withColumn("_piece", F.pmod(F.xxhash64(by), pieces).cast("int")).drop("pieces")
    right = one.join(F.broadcast(hot), keys, "left").withColumn("_piece", F.explode(F.sequence(F.lit(0), pieces - 1))).drop("pieces")
    return left.join(right, [*keys, "_piece"], how).drop("_piece")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
