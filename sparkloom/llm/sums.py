"""Arrays of a fixed size, one for each task, added up in a tree."""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

#: Arrays that are added up at once, about, and the levels of the tree below its root.
FAN, LEVELS = 64, 2
SUMS = "part int, lane int, sums binary"
NAMES = ["part", "lane", "sums"]


def over_tasks(docs: DataFrame, sums: Callable[[Iterator[pa.RecordBatch]], np.ndarray], parts: int, dtype: type) -> np.ndarray:
    """The sum of the arrays that `sums` makes of each task's batches; empty if there is no task. Tasks send their array as dtype.

    An array is cut into parts. Of each part, the arrays of neighbouring tasks go to one task, its sum and its neighbours' to one at the
    next level, and so on: none gets more than about FAN arrays, up to FAN^(LEVELS + 1) tasks. One array reaches the driver.
    """
    wide = np.dtype(np.int64 if np.issubdtype(dtype, np.integer) else np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [x.astype(dtype).tobytes() for x in np.array_split(sums(batches), parts)]
        yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array([TaskContext.get().partitionId()] * parts, pa.int32()), pa.array(own, pa.binary())], NAMES)

    def added(kind: np.dtype):
        def add(key: tuple, found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, place = np.zeros(0, wide), key[1].as_py()
            for batch in found:
                for x in batch.column("sums"):
                    one = np.frombuffer(x.as_py(), kind).astype(wide)
                    total = total + one if len(total) else one
            yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([place], pa.int32()), pa.array([total.tobytes()], pa.binary())], NAMES)

        return add

    found, kind = docs.mapInArrow(run, SUMS), np.dtype(dtype)
    for level in range(LEVELS + 1):
        lane = f"lane div {FAN}" if level < LEVELS else "0"
        found = found.selectExpr("part", f"cast({lane} as int) lane", "sums").groupBy("part", "lane").applyInArrow(added(kind), SUMS)
        kind = wide
    by_part = sorted((r["part"], bytes(r["sums"])) for r in found.collect())
    return np.concatenate([np.frombuffer(x, wide) for _, x in by_part] or [np.zeros(0, wide)])
