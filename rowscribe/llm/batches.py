"""Arrow batches in runs of bounded size, so that a task's memory does not follow the
length of its texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

ROWS = 1000  # of texts in an Arrow batch; the session's default of 10,000 is for short rows


def in_small_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session sends texts to Python in batches of at most ``ROWS`` rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(name)) <= ROWS:
        conf.set(name, str(ROWS))
    return df


def runs_of(batch: pa.RecordBatch, column: str, size: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs with about ``size`` bytes of a text or binary column; a
    run holds at least one row, however long."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lengths)
    start = 0
    while start < len(lengths):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + size, "right")))
        yield batch.slice(start, stop - start)
        start = stop
