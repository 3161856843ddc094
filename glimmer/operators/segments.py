"""Change points and piecewise models of trajectories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glimmer.operators.changes import change_points as change_points
from glimmer.operators.columns import in_order
from glimmer.operators.groups import KEY, ORDER, VALUE


def build_segments(df: DataFrame, bkps: DataFrame, method: str = "piecew_c", key: str = KEY, value: str = VALUE, order: str = ORDER) -> DataFrame:
    """``segment`` and ``seg``: each row's segment and its model, the mean ('piecew_c') or the least-squares line ('piecew_l').

    A trajectory without break points is one segment.
    """
    placed = df.where(F.col(key).isNotNull()).withColumn("_pos", F.row_number().over(in_order(key, order)) - 1).join(bkps, key, "left")
    placed = placed.withColumn("segment", F.coalesce(F.size(F.filter("bkps", lambda b: b <= F.col("_pos"))), F.lit(0)))
    if method == "piecew_c":
        model = placed.groupBy(key, "segment").agg(F.avg(value).alias("seg"))
        return placed.join(model, [key, "segment"]).drop("_pos", "bkps")
    if method != "piecew_l":
        raise ValueError(f"no method {method!r}: piecew_c or piecew_l")
    x = F.col("_pos").cast("double")
    model = placed.groupBy(key, "segment").agg(F.regr_slope(F.col(value), x).alias("_m"), F.regr_intercept(F.col(value), x).alias("_t"), F.avg(value).alias("_mean"))
    line = F.coalesce(F.col("_m") * F.col("_pos") + F.col("_t"), F.col("_mean"))
    return placed.join(model, [key, "segment"]).withColumn("seg", line).drop("_pos", "bkps", "_m", "_t", "_mean")


def fixed_change_points(df: DataFrame, every: int, key: str = KEY, order: str = ORDER) -> DataFrame:
    """Segments of ``every`` rows, the last one shorter."""
    n = df.groupBy(key).agg(F.count(F.lit(1)).cast("int").alias("n"))
    ends = F.transform(F.sequence(F.lit(1), F.ceil(F.col("n") / every).cast("int")), lambda k: F.least(k * every, F.col("n")))
    return n.select(key, ends.alias("bkps"))


def first_place(df: DataFrame, columns: list[str], key: str = KEY, order: str = ORDER) -> DataFrame:
    """The columns of each group's first row."""
    return df.groupBy(key).agg(F.min_by(F.struct(*columns), order).alias("_f")).select(key, *[F.col(f"_f.{c}").alias(c) for c in columns])


