"""The k best rows of each group, with bounded partial results before the shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trivane.shared import ship_code

#: Rows that a task gathers before it sorts, and rows of many groups that it holds before it lets them go.
GATHERED, HELD = 1 << 16, 1 << 20
SCHEMA = pa.schema([("group", pa.int64()), ("item", pa.int64()), ("value", pa.float64())])


def least(rows: list[np.ndarray], k: int) -> list[np.ndarray]:
    """Of (group, item, value) the k of each group with the least value, then item."""
    group, item, value = rows
    order = np.lexsort((item, value, group))
    group, item, value = group[order], item[order], value[order]
    first = np.flatnonzero(np.diff(group, prepend=group[:1] - 1))
    place = np.arange(len(group)) - np.repeat(first, np.diff(first, append=len(group)))
    return [column[place < k] for column in (group, item, value)]


def partial_best(batches: Iterator[pa.RecordBatch], k: int, held_rows: int = HELD) -> Iterator[pa.RecordBatch]:
    """What may be among the k best of each group: at most k rows of a group, unless the groups together are more than a task
    holds; then it lets its rows go and begins anew."""
    held, waiting, n = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)], [], 0

    def merged() -> list[np.ndarray]:
        return least([np.concatenate(c) for c in zip(held, *waiting)], k)

    for batch in batches:
        waiting.append([batch[c].to_numpy(zero_copy_only=False) for c in SCHEMA.names])
        n += batch.num_rows
        if n >= max(GATHERED, len(held[0])):
            held, waiting, n = merged(), [], 0
            if len(held[0]) > held_rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in held], schema=SCHEMA)
                held = [c[:0] for c in held]
    held = merged()
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in held], schema=SCHEMA)


def best(rows: DataFrame, k: int, partial: bool = True) -> DataFrame:
    """(group, item, value, place): of ``rows`` (group long, item long, value double) the k least values of each group, ties by
    item. A row counts as often as it is there; nulls must not occur. Without ``partial`` they are shuffled as they are, which then
    must be few of a group."""
    ship_code(rows.sparkSession)
    parts = rows.select("group", "item", "value")
    if partial:
        parts = parts.mapInArrow(lambda batches: partial_best(batches, k), "group long, item long, value double")
    place = F.row_number().over(Window.partitionBy("group").orderBy("value", "item"))
    return parts.withColumn("place", place).filter(F.col("place") <= k)
