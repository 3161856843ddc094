"""Column transforms within trajectories."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glimmer.functions.kernels import savgol_coefficients, savgol_edges
from glimmer.operators.groups import KEY, ORDER, VALUE


def in_order(key: str = KEY, order: str | list[str] = ORDER):
    return Window.partitionBy(key).orderBy(*([order] if isinstance(order, str) else order))


def add_time(df: DataFrame, key: str = "aperture_index", order: str = ORDER) -> DataFrame:
    """``time``: 0, 1, ... in each group."""
    return df.withColumn("time", F.row_number().over(in_order(key, order)) - 1)


def normalize(df: DataFrame, key: str = KEY, value: str = VALUE) -> DataFrame:
    """``norm_<value>``: the share of the group's maximum; null where that is 0, and for rows without a key, which stay."""
    top = df.groupBy(key).agg(F.max(value).alias("_top")).where(F.col(key).isNotNull())
    return df.join(top, key, "left").withColumn(f"norm_{value}", F.try_divide(value, "_top")).drop("_top")


def calibrate(df: DataFrame, conversion: float, time: str = ORDER) -> DataFrame:
    return df.withColumn("seconds", F.col(time) * conversion)


def smooth(df: DataFrame, column: str = VALUE, width: int = 5, method: str = "window", polyorder: int = 3, prefix: str = "smooth", key: str = KEY, order: str = ORDER) -> DataFrame:
    """``<prefix>_<column>``: trailing mean of ``width`` rows (null before), or a Savitzky-Golay filter."""
    name, w = f"{prefix}_{column}", in_order(key, order)
    if method == "window":
        frame = w.rowsBetween(-(width - 1), 0)
        return df.withColumn(name, F.when(F.count(F.lit(1)).over(frame) == width, F.avg(column).over(frame)))
    if method != "savgol":
        raise ValueError(f"no method {method!r}: window or savgol")
    if width % 2 == 0 or polyorder >= width:
        raise ValueError("width must be odd and over polyorder")
    half = width // 2
    inner = sum((F.lit(float(c)) * (F.lag(column, half - k).over(w) if k < half else F.lead(column, k - half).over(w) if k > half else F.col(column)) for k, c in enumerate(savgol_coefficients(width, polyorder))), F.lit(0.0))
    # near the ends the polynomial of the first or last full window holds; shorter groups have none
    at, back = F.row_number().over(w), F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))
    edges = savgol_edges(width, polyorder)
    placed = df.withColumn("_at", at).withColumn("_back", back).withColumn(name, inner)
    for k in range(half):
        head = sum((F.lit(float(edges[k, j])) * (F.lead(column, j - k).over(w) if j > k else F.lag(column, k - j).over(w) if j < k else F.col(column)) for j in range(width)), F.lit(0.0))
        tail = sum((F.lit(float(edges[k, j])) * (F.lag(column, j - k).over(w) if j > k else F.lead(column, k - j).over(w) if j < k else F.col(column)) for j in range(width)), F.lit(0.0))
        placed = placed.withColumn(name, F.when(F.col("_at") == k + 1, head).when(F.col("_back") == k + 1, tail).otherwise(F.col(name)))
    return placed.drop("_at", "_back")


def diff_and_runs(df: DataFrame, column: str, key: str = KEY, order: str = ORDER) -> DataFrame:
    """``diff`` to the row before, and ``runs``: how many changes there were so far."""
    w = in_order(key, order)
    changed = F.when(F.lag(column).over(w).eqNullSafe(F.col(column)), 0).otherwise(1)
    return df.withColumn("diff", F.col(column) - F.lag(column).over(w)).withColumn("_changed", changed).withColumn("runs", F.sum("_changed").over(w)).drop("_changed")


def map_states(df: DataFrame, means: list[float] | np.ndarray, state: str = "fit", name: str = "mapped_fit") -> DataFrame:
    """The mean of states 0, 1, ...; null for other states."""
    table = F.array(*[F.lit(float(m)) for m in means])
    return df.withColumn(name, F.when(F.col(state) >= 0, F.get(table, F.col(state).cast("int"))))
