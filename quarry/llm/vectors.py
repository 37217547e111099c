"""Embedding tables read as whole-number vectors, shared by the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.columns import name, require


def whole_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, x): every entry c as the long floor(scale · c).

    Rows whose vector is null, empty, or holds a null, NaN or infinite entry are left out; entries beyond the range of a
    long stand at its end. Other columns are not read. A null key stays null, repeated rows stay repeated.
    """
    require(rows, key, vector)
    found = rows.select(name(key).alias("vec_id"), name(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    found = found.filter(F.col("v").isNotNull() & (F.size("v") > 0) & finite)
    return found.select("vec_id", F.transform("v", lambda c: F.floor(F.lit(float(scale)) * c)).alias("x"))


def one_length(vectors: DataFrame) -> int:
    """The number of entries of all vectors, 0 without rows; vectors of different lengths are an error."""
    least, most = vectors.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if least != most:
        raise ValueError(f"vectors of {least} and {most} entries in one table")
    return most or 0


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A column of equally long lists of numbers as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
