"""Whole groups of rows, such as pages, in Arrow batches of many groups each."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

#: The place of a row in its group, from 1.
PLACE = "_place"
#: Rows that are held for a kernel at least, as far as there are so many.
LEAST = 1 << 16


def whole(rows: DataFrame, keys: list[str], order: list, kernel: Callable[[pa.Table, np.ndarray], Iterator[pa.Table]], result: str) -> DataFrame:
    """The tables of kernel(table, starts) for batches of rows whose groups are whole and follow each other, each in the given order.

    Groups are brought together by a window that numbers their rows, so rows that lie together by a part of the keys
    aren't exchanged again, and no group is ever one value. ``kernel`` gets one chunk a column.
    """
    least = LEAST
    numbered = rows.withColumn(PLACE, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))

    def made(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        if table.num_rows:
            place = table.column(PLACE).to_numpy()
            starts = np.flatnonzero(place == 1)
            if place[0] != 1 or not ((place[1:] == 1) | (np.diff(place) == 1)).all():
                raise RuntimeError("rows of a group don't follow each other")
            for out in kernel(table.drop_columns([PLACE]), starts):
                yield from out.to_batches()

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in found:
            first = np.flatnonzero(batch.column(batch.schema.get_field_index(PLACE)).to_numpy() == 1)
            if len(first) and count + int(first[-1]) >= least:
                last = int(first[-1])
                yield from made([*held, batch.slice(0, last)])
                held, count = [], 0
                batch = batch.slice(last)
            held.append(batch)
            count += batch.num_rows
        if held:
            yield from made(held)

    return numbered.mapInArrow(batches, result)


def chunk(table: pa.Table, name: str) -> pa.Array:
    column = table.column(name)
    return column.chunk(0) if column.num_chunks == 1 else column.combine_chunks()


def kinds(rows: DataFrame, *names: str) -> str:
    """The types of columns as a schema's text."""
    return ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in names)


def met(keys: np.ndarray, ups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places (in keys, in ups) of equal values, by the former."""
    order = np.argsort(ups, kind="stable")
    low, high = np.searchsorted(ups[order], keys, "left"), np.searchsorted(ups[order], keys, "right")
    count = high - low
    own = np.repeat(np.arange(len(keys)), count)
    return own, order[np.repeat(low - (np.cumsum(count) - count), count) + np.arange(len(own))]
