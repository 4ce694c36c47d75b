"""Co-moments of many columns at once, folded in numpy where the rows are."""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_FAN_IN = 32


def co_moments(df: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``n, x, xx, xy``, columns x columns, over the rows where both columns are known.

    ``x[i, j]`` and ``xx[i, j]`` are the sum of column i and of its squares, ``xy`` that of the products, of
    values less the column's overall mean. One set per task, then one per ``_FAN_IN`` tasks, then one.
    """
    d = len(columns)
    means = df.agg(*[F.avg(c).alias(f"m_{i}") for i, c in enumerate(columns)]).first()
    centre = np.array([0.0 if m is None else float(m) for m in means])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, d, d))
        for batch in batches:
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d) - centre
            known = ~np.isnan(v)
            v, known = np.where(known, v, 0.0), known.astype(float)
            total += np.stack([known.T @ known, v.T @ known, (v * v).T @ known, v.T @ v])
        yield pa.record_batch([pa.array([TaskContext.get().partitionId() // _FAN_IN], pa.int32()),
                               pa.array([total.tobytes()], pa.binary())], names=["bucket", "r"])

    def added(rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(r.as_buffer(), float) for r in rows.column("r"))
        return pa.table({"bucket": pa.array([0], pa.int32()), "r": pa.array([total.tobytes()], pa.binary())})

    rows = df.select(F.array(*[F.col(c).cast("double") for c in columns]).alias("v")).mapInArrow(fold, "bucket int, r binary")
    total = np.zeros((4, d, d))
    for r in rows.groupBy("bucket").applyInArrow(added, "bucket int, r binary").collect():
        total += np.frombuffer(r["r"], float).reshape(4, d, d)
    return tuple(total)
