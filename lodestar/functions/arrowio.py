"""Arrow batches to numpy matrices and back, for kernels that run on whole batches."""

from __future__ import annotations

import os
import tempfile
import threading
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]
_shipping = threading.Lock()


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers when their path does not hold it already."""
    sc = spark.sparkContext
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    with _shipping:  # jobs may be started from several threads
        if getattr(sc, "_lodestar_core", False):
            return
        target = Path(tempfile.mkdtemp(prefix="lodestar-")) / "lodestar_core.zip"
        with zipfile.ZipFile(target, "w") as z:
            for f in sorted((ROOT / "lodestar").rglob("*.py")):
                z.write(f, f.relative_to(ROOT))
        sc.addPyFile(str(target))
        sc._lodestar_core = True


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equally long lists as a double matrix; a null entry is NaN."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0))
    flat = column.flatten()
    return np.asarray(flat.to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def lists(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A matrix as a list column."""
    n, d = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * d), pa.array(np.ascontiguousarray(x).reshape(-1), kind))
