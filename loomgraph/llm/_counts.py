"""Tables of counters of a fixed size, summed over all rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm._worker import lean

_WIDTH = 256
_SCHEMA = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("n", T.ArrayType(T.LongType()))])


def summed(df: DataFrame, size: int, count: Callable[[pa.RecordBatch, np.ndarray], None]) -> np.ndarray:
    """Sum of counters over all rows of ``df``.

    ``count(batch, counters)`` adds a batch to ``size`` counters (a multiple of 256). Each task
    sends its counters once; only their sum comes to the driver, the same size for any input.
    """

    def run(batches):
        total = np.zeros(size, np.int64)
        for b in batches:
            count(b, total)
        grid = total.reshape(-1, _WIDTH)
        used = np.flatnonzero(grid.any(axis=1))
        flat = grid[used].ravel()
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, _WIDTH), pa.int32()), pa.array(flat))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), lists], names=_SCHEMA.names)

    parts = df.mapInArrow(lean(run), _SCHEMA)
    sums = parts.groupBy("part").agg(F.array(*(F.sum(F.col("n")[i]) for i in range(_WIDTH))).alias("n"))
    out = np.zeros((size // _WIDTH, _WIDTH), np.int64)
    for part, n in sums.collect():
        out[part] = n
    return out.ravel()
