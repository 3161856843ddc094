"""Whole trajectories in Arrow: rows that Spark has dealt by trajectory and sorted, many trajectories at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glimmer.operators.columns import in_order

#: Rows that are handled at once; a longer trajectory is handled alone.
ROWS = 100_000
POSITION = "_position"


def placed(df: DataFrame, key: str, order: str | list[str]) -> DataFrame:
    """Rows with their place (1, 2, ...) in their trajectory. The window deals and sorts them, unless they already are."""
    return df.withColumn(POSITION, F.row_number().over(in_order(key, order)))


def trajectories(batches: Iterator[pa.RecordBatch], most: int = ROWS) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole trajectories from the batches of a partition, and where each one starts (and the last ends)."""
    held, n = [], 0
    for batch in batches:
        while batch.num_rows:
            starts = np.flatnonzero(batch.column(batch.schema.get_field_index(POSITION)).to_numpy() == 1)
            enough = starts[(n + starts >= most) & (n + starts > 0)]
            if not len(enough):
                held.append(batch)
                n += batch.num_rows
                break
            held.append(batch.slice(0, enough[0]))
            yield _table(held)
            batch, held, n = batch.slice(enough[0]), [], 0
    if n:
        yield _table(held)


def _table(batches: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
    table = pa.Table.from_batches(batches).combine_chunks()
    starts = np.flatnonzero(table.column(POSITION).to_numpy() == 1)
    return table.drop_columns([POSITION]), np.append(starts, table.num_rows)
