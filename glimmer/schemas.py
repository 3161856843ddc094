"""Canonical schemas, and the rule that NaN becomes null on the way in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

IMAGES = "image_id int, filename string, folder string, scene string, dim_order string, meta string"
FRAMES = "image_id int, t int, c int, z int, height int, width int, pixels array<float>"
PEAKS = "channel string, peak_id int, x double, y double"
TRAJECTORIES = "trajectory int, Intensity float, bg float, x bigint, y bigint, slice int"


def nulls_for_nans(df: DataFrame) -> DataFrame:
    """NaN sorts above all numbers in Spark, so it is turned into null once, when a table is read."""
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])
