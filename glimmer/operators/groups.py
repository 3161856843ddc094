"""Filters that keep or drop whole trajectories.

Statistics are aggregated by key, with partial sums before the shuffle, and joined back by key, so that a trajectory with
very many rows is never gathered in one task. This plans the input twice. ``windowed`` takes them by windows over the
trajectory instead, which plans it once: for chains of filters, and where trajectories are dealt to tasks anyway, as for
decoding; a chain of such filters shares one shuffle and one sort. Rows with a null key belong to no group and are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY, VALUE, STATE, ORDER = "trajectory", "Intensity", "fit", "slice"


def keep_groups(df: DataFrame, stats: dict[str, Column], condition: Column, key: str = KEY, windowed: bool = False) -> DataFrame:
    """The rows of the groups whose statistics (aggregates by name) meet the condition."""
    df = df.where(F.col(key).isNotNull())
    if not windowed:
        return df.join(df.groupBy(key).agg(*[c.alias(n) for n, c in stats.items()]).where(condition).select(key), key, "left_semi")
    over = Window.partitionBy(key)
    return df.select("*", *[c.over(over).alias(n) for n, c in stats.items()]).where(condition).drop(*stats)


def filter_garbage(df: DataFrame, threshold: float = 2.0, lower: float = 0.0, key: str = KEY, value: str = VALUE, windowed: bool = False) -> DataFrame:
    """Groups whose values all lie under mean + threshold * sd of the groups' maxima, and whose mean is over ``lower``.

    The standard deviation is that of a sample: a single group has none and is dropped. So are groups with a null value.
    The cutoff, one row over all groups, is planned apart and broadcast.
    """
    tops = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(value).alias("_top"))
    cutoff = tops.agg((F.lit(threshold) * F.stddev_samp("_top") + F.avg("_top")).alias("_cutoff"))
    stats = {"_highest": F.max(value), "_mean": F.avg(value), "_missing": F.count_if(F.col(value).isNull()), "_limit": F.max("_cutoff")}
    both = df.join(F.broadcast(cutoff))
    return keep_groups(both, stats, (F.col("_highest") < F.col("_limit")) & (F.col("_mean") > lower) & (F.col("_missing") == 0), key, windowed).drop("_cutoff")


def filter_std(df: DataFrame, threshold: float = 2.0, key: str = KEY, value: str = VALUE, windowed: bool = False) -> DataFrame:
    """Groups whose sample standard deviation is over ``threshold`` (in the value's unit)."""
    return keep_groups(df, {"_sd": F.stddev_samp(value)}, F.col("_sd") > threshold, key, windowed)


def filter_negative(df: DataFrame, key: str = KEY, value: str = VALUE, windowed: bool = False) -> DataFrame:
    """Groups whose mean is positive."""
    return keep_groups(df, {"_mean": F.avg(value)}, F.col("_mean") > 0, key, windowed)


def _moments(value: str, state: str) -> dict[str, Column]:
    on, off = (F.when(F.col(state) == k, F.col(value)) for k in (1, 0))
    return {"_n1": F.count(on), "_n0": F.count(off), "_m1": F.avg(on), "_m0": F.avg(off), "_v1": F.var_samp(on), "_v0": F.var_samp(off)}


def _effect() -> Column:
    pooled = F.sqrt(F.try_divide((F.col("_n1") - 1) * F.col("_v1") + (F.col("_n0") - 1) * F.col("_v0"), F.col("_n1") + F.col("_n0") - 2))
    diff = F.col("_m1") - F.col("_m0")
    d = F.when((pooled == 0) & (diff != 0), F.signum(diff) * F.lit(float("inf"))).otherwise(F.try_divide(diff, pooled))
    return F.when((F.col("_n1") > 1) & (F.col("_n0") > 1), d)


def cohens_d(df: DataFrame, key: str = KEY, value: str = VALUE, state: str = STATE) -> DataFrame:
    """key and d: the effect size between states 1 and 0, by the pooled sample variance.

    Null where a state has fewer than two rows; where both variances are 0, infinite for different means, else null.
    """
    stats = df.where(F.col(key).isNotNull()).groupBy(key).agg(*[c.alias(n) for n, c in _moments(value, state).items()])
    return stats.select(key, _effect().alias("d"))


def filter_snr(df: DataFrame, threshold: float = 2.0, bad: bool = False, key: str = KEY, value: str = VALUE, state: str = STATE, windowed: bool = False) -> DataFrame:
    """Groups whose absolute effect size is over ``threshold`` (``bad``: is not). A group without one is in neither."""
    size = F.abs(_effect())
    return keep_groups(df, _moments(value, state), size <= threshold if bad else size > threshold, key, windowed)


def filter_inactive(df: DataFrame, threshold: float = 5.0, inactive: bool = False, legacy: bool = False, key: str = KEY, state: str = STATE, order: str = ORDER, windowed: bool = False) -> DataFrame:
    """Groups of at least ``threshold`` events; ``inactive``: the others (``legacy``: those at the threshold too)."""
    from glimmer.operators.events import half_change

    n = F.col("_halves") / 2.0
    condition = n >= threshold if not inactive else n <= threshold if legacy else n < threshold
    marked = df.withColumn("_half", half_change(key, state, order))
    return keep_groups(marked, {"_halves": F.sum("_half")}, condition, key, windowed).drop("_half")


def select_events(df: DataFrame, wanted: list, legacy: bool = False, key: str = KEY, order: str = ORDER) -> DataFrame:
    """The rows of the listed groups; ``legacy``: only those rows without a zero or null outside key and order."""
    kept = df.where(F.col(key).isin(wanted))
    if legacy:
        for c, kind in df.dtypes:
            if c not in (key, order) and kind in ("double", "float", "int", "bigint", "smallint", "tinyint"):
                kept = kept.where((F.col(c) != 0) & F.col(c).isNotNull())
    return kept


def at_frame(df: DataFrame, frame: int, keys: list | None = None, key: str = KEY, order: str = ORDER) -> DataFrame:
    """Where trajectories (all, or the listed ones) stand at a frame."""
    rows = df.where(F.col(order) == frame)
    return rows if keys is None else rows.where(F.col(key).isin(keys))


def filter_min_rows(df: DataFrame, least: int = 200, key: str = KEY, windowed: bool = False) -> DataFrame:
    """Groups of at least ``least`` rows."""
    return keep_groups(df, {"_n": F.count(F.lit(1))}, F.col("_n") >= least, key, windowed)


def max_length(pulses: DataFrame, longest: float, key: str = KEY) -> DataFrame:
    """key and dur of the longest pulse, where over ``longest``."""
    return pulses.groupBy(key).agg(F.max("dur").alias("dur")).where(F.col("dur") > longest)


def filter_by_length(pulses: DataFrame, threshold: float = 5.0, key: str = KEY) -> DataFrame:
    """Pulses without those of groups that hold one longer than mean + threshold * sd of all pulses."""
    cutoff = pulses.agg((F.avg("dur") + F.lit(threshold) * F.stddev_samp("dur")).alias("cutoff"))
    long = pulses.groupBy(key).agg(F.max("dur").alias("top")).join(F.broadcast(cutoff)).where(F.col("top") > F.col("cutoff")).select(key)
    return pulses.join(long, key, "left_anti")
