"""Ranks of a table of vectors from the spectrum of its Gram matrix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gram(df: DataFrame, vec: str) -> DataFrame:
    """i, row, n: the Gram matrix of all vectors by rows. Each task adds up the products of its rows; what is shuffled is one
    matrix a task."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0
        for b in batches:
            if b.num_rows:
                x = b.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
                total, n = (0 if total is None else total) + x.T @ x, n + len(x)
        if n:
            size = len(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(size), size)), pa.array(np.tile(np.arange(size), size)), pa.array(total.ravel()), pa.array([n] * size * size)], names=["i", "j", "x", "n"])

    parts = df.select(vec).mapInArrow(products, "i long, j long, x double, n long").groupBy("i", "j").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    return parts.groupBy("i").agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "x"))), lambda e: e["x"]).alias("row"), F.max("n").alias("n"))


def ranks_of_spectrum(matrix: DataFrame) -> DataFrame:
    """effective_rank (exponential of the entropy of the singular values' shares) and stable_rank (squared Frobenius norm over
    the largest squared singular value). The matrix has as many rows as dimensions and is decomposed on the driver."""
    rows = matrix.orderBy("i").collect()
    squares = np.maximum(np.linalg.eigvalsh(np.array([r["row"] for r in rows])), 0) if rows else np.zeros(1)
    share = np.sqrt(squares) / max(np.sqrt(squares).sum(), 1e-300)
    entropy = -(share[share > 0] * np.log(share[share > 0])).sum()
    out = (float(np.exp(entropy)), float(squares.sum() / max(squares.max(), 1e-300)), rows[0]["n"] if rows else 0)
    return matrix.sparkSession.createDataFrame([out], "effective_rank double, stable_rank double, rows long")
