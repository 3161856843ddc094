"""Order over a whole table in two levels, so that no task sees all rows.

Rows are dealt once by ranges of their keys and written, so that the ranges hold for all that follows. What a range adds up
to is one row; these few rows, as many as there are parts, are carried on to the ranges behind, and each range does the rest
by itself. The numbers depend on the keys alone, so they are the same on every run and at any partitioning, as long as the
keys tell rows apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glimmer.sources.shared import written

PART = "_part"


def dealt(df: DataFrame, by: list[str]) -> DataFrame:
    """``df`` in parts by ranges of the columns, nulls first, with the number of a row's part. Rows of equal keys are in one part."""
    return written(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(PART, F.spark_partition_id()))


def _over_parts(rows: DataFrame, each: dict[str, Column], over: dict[str, Column]) -> DataFrame:
    """``rows`` with what the parts before give: aggregates of each part by name, then columns over the row of each part. A row a part is broadcast."""
    return rows.join(F.broadcast(rows.groupBy(PART).agg(*[c.alias(n) for n, c in each.items()]).select(PART, *[c.alias(n) for n, c in over.items()])), PART)


def running(placed: DataFrame, by: list[str], sums: dict[str, Column]) -> DataFrame:
    """For each name the sum of a column over all rows before, 0 for the first; ``placed`` comes from ``dealt``."""
    before = Window.partitionBy(PART).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    parts = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0)
    carried = _over_parts(placed, {f"_carried_{n}": F.sum(c) for n, c in sums.items()}, {f"_carried_{n}": F.coalesce(F.sum(f"_carried_{n}").over(parts), none) for n in sums})
    return carried.select(*placed.columns, *[(F.coalesce(F.sum(c).over(before), none) + F.col(f"_carried_{n}")).alias(n) for n, c in sums.items()])


def running_within(placed: DataFrame, key: str, by: list[str], sums: dict[str, Column]) -> DataFrame:
    """The same within each key, which is what ``placed`` is dealt by first: a key may reach over many parts. What a part's first key brings along is broadcast, a row a part."""
    before = Window.partitionBy(PART, key).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    parts = Window.partitionBy(key).orderBy(PART)
    none = F.lit(0)
    each = placed.groupBy(PART, key).agg(*[F.sum(c).alias(f"_carried_{n}") for n, c in sums.items()])
    over = each.select(PART, key, F.row_number().over(parts).alias("_nth"), *[F.sum(f"_carried_{n}").over(parts.rowsBetween(Window.unboundedPreceding, -1)).alias(f"_carried_{n}") for n in sums])
    carried = placed.join(F.broadcast(over.where("_nth > 1").drop("_nth")), [PART, key], "left")
    return carried.select(*placed.columns, *[(F.coalesce(F.sum(c).over(before), none) + F.coalesce(f"_carried_{n}", none)).alias(n) for n, c in sums.items()])


def previous(placed: DataFrame, by: list[str], column: str, name: str) -> DataFrame:
    """``name``: the column's value in the row before, over the borders of parts too; null for the first row."""
    within = Window.partitionBy(PART).orderBy(*by)
    last = F.lag("_carried").over(Window.orderBy(PART))
    carried = _over_parts(placed, {"_carried": F.max_by(F.struct(column), F.struct(*by))}, {"_carried": last})
    first = F.row_number().over(within) == 1
    return carried.select(*placed.columns, F.when(first, F.col(f"_carried.{column}")).otherwise(F.lag(column).over(within)).alias(name))


def numbered(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """``name``: 0, 1, ... over the whole table in the order of the columns, which should tell rows apart."""
    return running(dealt(df, by), by, {name: F.lit(1).cast("long")}).drop(PART)
