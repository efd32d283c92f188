"""Small helpers the operators of this package share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows whose remainder is 0 are held out from every fit.
FOLDS = 5


def fold(doc_id: str = "doc_id") -> Column:
    """``crc32`` of the id as text, modulo :data:`FOLDS`; 0 marks the held-out rows. A null id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS, F.lit(0)).cast("int")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def shuffle_tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def raw_texts(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a text column; null counts as empty."""
    return [t if t is not None else b"" for t in column.cast(pa.binary()).to_pylist()]


def floats(matrix: np.ndarray) -> pa.Array:
    """Rows of a matrix as lists of doubles."""
    flat = pa.array(np.ascontiguousarray(matrix, dtype=np.float64).ravel())
    starts = pa.array(np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1])
    return pa.ListArray.from_arrays(starts, flat)


def pieces_of(batches: Iterator[pa.RecordBatch], most_bytes: int = 16_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most_bytes`` at most, one row at least."""
    for batch in batches:
        step = max(1, int(batch.num_rows * most_bytes / max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
