"""Vectors in array columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F



def usable(vector: str = "embedding") -> Column:
    """Not null, no null or non-finite component, not all zero."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column: pd.Series) -> np.ndarray:
    """float64 rows of an array column; all of one length."""
    rows = column.tolist()
    return np.array(rows, dtype=np.float64) if rows else np.zeros((0, 0))


