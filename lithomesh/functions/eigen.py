"""Eigenvalues and eigenvectors of many 3x3 scatter matrices, in Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lithomesh.plans.session import prepare_workers

ENTRIES = ["sxx", "sxy", "sxz", "syy", "syz", "szz"]
VALUES = ["l1", "l2", "l3"]
VECTORS = [f"v{i}{c}" for i in (1, 2, 3) for c in "xyz"]


def decompose(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (n, 3), falling and not below 0, and unit eigenvectors (n, 3, 3), one a row.

    Of each vector the sign is such that its component of largest size is positive.
    """
    xx, xy, xz, yy, yz, zz = entries.T
    m = np.stack([np.stack([xx, xy, xz], -1), np.stack([xy, yy, yz], -1), np.stack([xz, yz, zz], -1)], -2)
    values, vectors = np.linalg.eigh(m)
    values, vectors = np.maximum(values[:, ::-1], 0.0), vectors[:, :, ::-1].transpose(0, 2, 1)
    largest = np.take_along_axis(vectors, np.abs(vectors).argmax(2)[:, :, None], 2)
    return values, vectors * np.where(largest < 0, -1.0, 1.0)


def with_eigen(frame: DataFrame) -> DataFrame:
    """The frame with l1 >= l2 >= l3 and the vectors v1x ... v3z of its scatter entries; null entries give nulls."""
    prepare_workers(frame.sparkSession)
    new = [T.StructField(n, T.DoubleType()) for n in VALUES + VECTORS]

    def run(batches):
        for batch in batches:
            entries = np.column_stack([np.asarray(batch.column(n).cast(pa.float64()).fill_null(np.nan)) for n in ENTRIES]) if batch.num_rows else np.zeros((0, 6))
            ok = np.isfinite(entries).all(1)
            out = np.full((len(entries), 12), np.nan)
            if ok.any():
                values, vectors = decompose(entries[ok])
                out[ok] = np.column_stack([values, vectors.reshape(len(values), 9)])
            columns = [pa.array(out[:, i], pa.float64(), mask=~ok) for i in range(12)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *VALUES, *VECTORS])

    return frame.mapInArrow(run, T.StructType([*frame.schema.fields, *new]))
