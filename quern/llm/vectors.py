"""What the vector operators share: usable vectors and exact cosines."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v array of floats or doubles): rows with an id and a vector that is not null, empty or zero and has
    neither null nor non-finite components, nor a norm that overflows or vanishes."""
    kind = df.schema[vector_col].dataType.elementType.simpleString()
    v = F.col(vector_col).cast("array<float>" if kind == "float" else "array<double>")  # floats travel as they are
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    ok = F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite
    rows = df.where(F.coalesce(ok, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    n = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return rows.where((n > 0) & (n < float("inf")))


def common_length(good: DataFrame) -> int:
    """The length that most usable vectors have, the smaller of several; 0 without any."""
    row = good.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").first()
    return row["w"] if row else 0


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def stack(column) -> np.ndarray:
    """A pyarrow list column of equal lengths as a matrix of doubles."""
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)
