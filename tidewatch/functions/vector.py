"""Vector columns: assembling, distances, nearest centre."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def assemble(df: DataFrame, cols: Sequence[str], out: str = "vec") -> DataFrame:
    """Feature columns -> one array<double>, in the given order."""
    return df.withColumn(out, F.array(*[F.col(c).cast("double") for c in cols]))


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two array columns."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def center_matrix(centers: DataFrame, label: str = "label", vec: str = "center") -> tuple[list, np.ndarray]:
    """Centres as (labels, matrix): for centres whose number is a parameter, such as the k of k-means."""
    rows = sorted(centers.select(F.col(label), F.col(vec)).collect(), key=lambda r: r[0])
    return [r[0] for r in rows], np.array([r[1] for r in rows], dtype=np.float64).reshape(len(rows), -1)


def nearest_center(vec: Column | str, labels: Sequence[int], centers: np.ndarray) -> Column:
    """struct(label, distance) of the nearest centre; ties go to the smaller label.

    The centre matrix travels with the task closure; rows arrive in Arrow batches.
    """
    names = np.asarray(labels, dtype=np.int32)
    mat = np.asarray(centers, dtype=np.float64)
    half = 0.5 * (mat * mat).sum(1)

    @F.pandas_udf("struct<label: int, distance: double>")
    def pick(v: pd.Series) -> pd.DataFrame:
        x = np.stack(v.to_numpy()).astype(np.float64) if len(v) else np.zeros((0, mat.shape[1]))
        best = np.argmin(half[None, :] - x @ mat.T, axis=1)
        gap = x - mat[best]
        return pd.DataFrame({"label": names[best], "distance": np.sqrt((gap * gap).sum(1))})

    return pick(F.col(vec) if isinstance(vec, str) else vec)
