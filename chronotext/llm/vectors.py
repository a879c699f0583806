"""What the searches share: usable vectors and their transport as blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(rows: DataFrame) -> DataFrame:
    """`vec_id, v` (array of doubles) of the rows whose id and embedding are not null and whose components are finite."""
    limit = F.lit(float("inf"))
    fine = F.forall("v", lambda x: F.coalesce((F.abs(x) < limit) & ~F.isnan(x), F.lit(False)))
    found = rows.where("vec_id is not null and embedding is not null")
    return found.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(fine)


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Arrays of doubles as rows of a matrix; components that a shorter vector lacks are zero."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(lists.offsets.to_numpy())
    values = lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), width))
    out[np.arange(width)[None, :] < lengths[:, None]] = values
    return out
