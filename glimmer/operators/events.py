"""Events: runs of equal states (gaps and islands), pulses and dwell times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glimmer.operators.columns import in_order
from glimmer.operators.groups import KEY, ORDER, STATE, VALUE
from glimmer.operators.ordered import dealt, previous, running
from glimmer.sources.shared import dropped, written


def half_change(key: str = KEY, state: str = STATE, order: str = ORDER) -> Column:
    """1 where the state changes after the row, with a change to 0 after the last one: half an event."""
    return (F.lead(state, 1, 0).over(in_order(key, order)) != F.col(state)).cast("int")


def event_counts(df: DataFrame, key: str = KEY, state: str = STATE, order: str = ORDER) -> DataFrame:
    """key and events: half the changes of state, with a change to 0 after the last row; so a leading event counts half."""
    return df.where(F.col(key).isNotNull()).withColumn("_half", half_change(key, state, order)).groupBy(key).agg((F.sum("_half") / 2.0).alias("events"))


def with_runs(df: DataFrame, key: str = KEY, state: str = STATE, order: str = ORDER) -> DataFrame:
    """``pos`` (0, 1, ...) and ``run_id`` (1, 2, ...) in each group. States must not be null."""
    w = in_order(key, order)
    changed = F.when(F.lag(state).over(w).eqNullSafe(F.col(state)), 0).otherwise(1)
    return df.withColumn("pos", F.row_number().over(w) - 1).withColumn("_changed", changed).withColumn("run_id", F.sum("_changed").over(w)).drop("_changed")


def runs(df: DataFrame, key: str = KEY, value: str = VALUE, state: str = STATE, order: str = ORDER) -> DataFrame:
    """One row for each run: key, run_id, state, start, end (exclusive), len, mean, sd, is_last."""
    each = with_runs(df, key, state, order).groupBy(key, "run_id").agg(F.min(state).alias("state"), F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"), F.count(F.lit(1)).alias("len"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    return each.withColumn("is_last", F.col("run_id") == F.max("run_id").over(Window.partitionBy(key)))


def rle_dwelltimes(df: DataFrame, key: str = KEY, state: str = STATE, order: str = ORDER) -> DataFrame:
    """All runs with their lengths in frames; even runs are on, odd ones off (the first is thought to be off)."""
    each = runs(df, key, state, state, order)
    return each.select(key, "run_id", F.when(F.col("run_id") % 2 == 0, "on").otherwise("off").alias("kind"), F.col("len").alias("dwell"))


def longest_even_run(df: DataFrame, state: str = STATE, key: str = KEY, order: str = ORDER, legacy: bool = False) -> DataFrame:
    """The longest even-numbered run of each group; ``legacy``: one number (1 at least) over all rows, as if one group.

    The runs of the whole table in legacy mode join those of neighbouring groups where their states are equal: last and
    first runs are stitched over one row a group, and these in two levels over ranges of groups: no task sees them all.
    """
    each = runs(df, key, state, state, order)
    if not legacy:
        return each.where("run_id % 2 = 0").groupBy(key).agg(F.max("len").alias("longest"))
    ends = each.groupBy(key).agg(F.max("run_id").cast("long").alias("runs"), F.min_by("state", "run_id").alias("first"), F.max_by("state", "run_id").alias("last"))
    joined = previous(dealt(ends, [key]), [key], "last", "_before").withColumn("glued", F.col("_before").eqNullSafe(F.col("first")).cast("long"))
    counted = running(joined, [key], {"before": F.col("runs") - F.col("glued")})
    numbered = each.join(counted.select(key, (F.col("before") - F.col("glued")).alias("before")), key)
    whole = numbered.groupBy((F.col("before") + F.col("run_id")).alias("number")).agg(F.sum("len").alias("len"))
    return whole.agg(F.greatest(F.lit(1), F.coalesce(F.max(F.when(F.col("number") % 2 == 0, F.col("len"))), F.lit(1))).alias("longest"))


def filter_long_runs(df: DataFrame, threshold: int = 100, key: str = KEY, state: str = STATE, order: str = ORDER) -> DataFrame:
    """Groups without an on run longer than ``threshold``."""
    long = runs(df, key, state, state, order).where((F.col("state") == 1) & (F.col("len") > threshold)).select(key).distinct()
    return df.where(F.col(key).isNotNull()).join(long, key, "left_anti")


def dwell_times(df: DataFrame, seconds: str = "seconds", key: str = KEY, state: str = STATE, order: str = ORDER) -> DataFrame:
    """key, kind, run_id, dwell: time between successive changes of state; the leading run counts, the trailing one doesn't."""
    each = with_runs(df, key, state, order).groupBy(key, "run_id").agg(F.min(state).alias("state"), F.min(seconds).alias("begin"))
    w = Window.partitionBy(key).orderBy("run_id")
    done = each.withColumn("dwell", F.lead("begin").over(w) - F.col("begin")).withColumn("next", F.lead("state").over(w)).where("next in (0, 1)")
    return done.select(key, F.when(F.col("next") == 0, "on").otherwise("off").alias("kind"), "run_id", "dwell")


def dwell_summary(dwells: DataFrame, method: str = "mean", key: str = KEY) -> DataFrame:
    """Mean (or median) on and off dwell and the number of on dwells of each group that has on dwells."""
    if method not in ("mean", "median"):
        raise ValueError(f"no method {method!r}: mean or median")
    f = F.avg if method == "mean" else F.median
    on, off = (F.when(F.col("kind") == k, F.col("dwell")) for k in ("on", "off"))
    return dwells.groupBy(key).agg(f(on).alias("on_dwells"), f(off).alias("off_dwells"), F.count(on).alias("N")).where("N > 0")


def dwell_pairs_legacy(dwells: DataFrame, key: str = KEY) -> DataFrame:
    """On and off dwells side by side by their rank over the whole table, as many as the rarer kind has.

    Ranks come from counts by key before each key, in two levels over ranges of keys, so no task orders them all.
    """
    w = Window.partitionBy("kind", key).orderBy("run_id")
    counts = dwells.groupBy("kind", key).agg(F.count(F.lit(1)).alias("n"))
    of = {kind: F.when(F.col("kind") == kind, F.col("n")).otherwise(0) for kind in ("on", "off")}
    before = running(dealt(counts, ["kind", key]), ["kind", key], of).select("kind", key, F.when(F.col("kind") == "on", F.col("on")).otherwise(F.col("off")).alias("before"))
    ranked = dwells.withColumn("own", F.row_number().over(w)).join(before, ["kind", key]).withColumn("rank", F.col("before") + F.col("own"))
    on = ranked.where("kind = 'on'").select("rank", F.col("dwell").alias("on_dwells"), key)
    off = ranked.where("kind = 'off'").select("rank", F.col("dwell").alias("off_dwells"))
    return on.join(off, "rank")


def pulses(df: DataFrame, conversion: float = 1.0, key: str = KEY, value: str = VALUE, state: str = STATE, order: str = ORDER) -> DataFrame:
    """key, state ('on' or 'off'), dur, value, std, start_frame, end_frame (exclusive) of all runs but each group's last.

    The input is planned once. On is the state, 0 or 1, with the larger mean; equal means make state 0 both; a group without one of them has the other.
    """
    w = Window.partitionBy(key)
    m1, m0 = (F.avg(F.when(F.col(state) == k, F.col(value))).over(w) for k in (1, 0))
    marked = with_runs(df.where(F.col(key).isNotNull()), key, state, order).withColumn("m1", m1).withColumn("m0", m0)
    each = marked.groupBy(key, "run_id").agg(F.min(state).alias("r_state"), F.min("pos").alias("start_frame"), (F.max("pos") + 1).alias("end_frame"), F.count(F.lit(1)).alias("len"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.max("m1").alias("m1"), F.max("m0").alias("m0"))
    on = F.when(F.col("m1").isNull() | (F.col("m0") >= F.col("m1")), 0).otherwise(1)
    off = F.when(F.col("m1").isNull() | (F.col("m0") <= F.col("m1")), 0).otherwise(1)
    off = F.when(F.col("m0").isNull(), 1).otherwise(off)
    sides = F.filter(F.array(F.when(F.col("r_state") == on, "on"), F.when(F.col("r_state") == off, "off")), lambda s: s.isNotNull())
    done = each.withColumn("is_last", F.col("run_id") == F.max("run_id").over(w)).where("not is_last").withColumn("side", F.explode(sides))
    return done.select(key, F.col("side").alias("state"), (F.col("len") * conversion).alias("dur"), F.col("mean").alias(value), "std", "start_frame", "end_frame")


def dwell_sem(pulses_: DataFrame, key: str = KEY) -> DataFrame:
    """state, mean and standard error of the groups' mean durations."""
    return pulses_.groupBy("state", key).agg(F.avg("dur").alias("m")).groupBy("state").agg(F.avg("m").alias("mean"), (F.stddev_samp("m") / F.sqrt(F.count("m"))).alias("sem"))


#: Bins into which a round of the search for a quantile parts what is left.
PARTED = 4096


def quantiles(df: DataFrame, value: str, shares: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """Exact quantiles by name, of all rows or by group, between neighbouring values in proportion; null, NaN and infinite values are left out.

    Rounds of bin counts find each of the two neighbours: what lies in the bin that holds it, from its least to its largest
    value, is the range of the next round, until that is one value. So values are never sorted, shuffled or gathered; the
    table is read once a round, of which few are needed, so it should be one that is written. Without rows there are none.
    """
    by = by or []
    rows = df.select(*by, F.col(value).cast("double").alias("_v")).where(F.abs("_v") < float("inf"))
    sizes = rows.groupBy(*by).agg(F.min("_v").alias("low"), F.max("_v").alias("high"), F.count(F.lit(1)).alias("n")).where("n > 0")
    place = lambda q: (F.col("n") - 1) * F.lit(float(q))
    wanted = F.explode(F.array_distinct(F.array(*[f(place(q)).cast("long") for q in shares.values() for f in (F.floor, F.ceil)]))).alias("rank")
    state = written(sizes.select(*by, "n", wanted, F.lit(0).cast("long").alias("below"), "low", "high"))
    own = [*by, "rank"]
    while not state.where("low < high").isEmpty():
        open_ = state.where("low < high")
        met = rows.join(open_, by) if by else rows.join(F.broadcast(open_))  # without groups it is a row for each rank
        reach = F.col("high") - F.col("low")
        # by halves where the range itself is beyond the largest double
        share = F.when(reach < float("inf"), F.try_divide(F.col("_v") - F.col("low"), reach)).otherwise(F.try_divide(F.col("_v") / 2 - F.col("low") / 2, F.col("high") / 2 - F.col("low") / 2))
        bin_ = F.least(F.floor(share * PARTED), F.lit(PARTED - 1))
        bins = met.where(F.col("_v").between(F.col("low"), F.col("high"))).groupBy(*own, "below", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("k"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        upto = F.col("below") + F.coalesce(F.sum("k").over(Window.partitionBy(*own).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # PARTED rows at most
        holds = bins.withColumn("upto", upto).where((F.col("upto") <= F.col("rank")) & (F.col("rank") < F.col("upto") + F.col("k"))).select(*own, "upto", "lo", "hi")
        new = written(state.join(holds, own, "left").select(*by, "n", "rank", F.coalesce("upto", "below").alias("below"), F.coalesce("lo", "low").alias("low"), F.coalesce("hi", "high").alias("high")))
        dropped(state)
        state = new
    at = lambda f, q: F.max(F.when(F.col("rank") == f(place(q)), F.col("low")))
    ends = {n: (at(F.floor, q), at(F.ceil, q), F.max(place(q) - F.floor(place(q)))) for n, q in shares.items()}
    return state.groupBy(*by).agg(*[(lo + (hi - lo) * part).alias(n) for n, (lo, hi, part) in ends.items()]) if by else state.groupBy("n").agg(*[(lo + (hi - lo) * part).alias(n) for n, (lo, hi, part) in ends.items()]).drop("n")


_QUARTILES = {"_q1": 0.25, "_q3": 0.75}


def fd_bin_width(pulses_: DataFrame, key: str = KEY) -> DataFrame:
    """state and the Freedman-Diaconis bin width of the groups' mean durations, which are written as quartiles read them in rounds."""
    each = written(pulses_.groupBy("state", key).agg(F.avg("dur").alias("m")))
    sizes = each.groupBy("state").agg(F.count("m").alias("n"))
    width = F.lit(2.0) * (F.col("_q3") - F.col("_q1")) / F.pow(F.col("n").cast("double"), F.lit(1.0 / 3))
    return sizes.join(quantiles(each, "m", _QUARTILES, ["state"]), "state", "left").select("state", width.alias("width"))


def histogram(df: DataFrame, value: str = VALUE, bins: int | str = 100, by: list[str] | None = None) -> DataFrame:
    """bin (0, 1, ...), left (its lower end), n, density over equal bins from least to largest, of all rows or by group; the last bin is closed.

    ``bins``: a number, 'sqrt' (the root of the number of values) or 'fd' (as many as reach over the range at the
    Freedman-Diaconis width); one where that is none. Null values are left out. A first pass finds the ranges, a second
    counts, with counts by bin added up before they are shuffled: the table is read twice ('fd': more often), so it should
    be one that is written where it is dear. The ranges, a row a group, are written; Spark broadcasts them while they are few.
    """
    by = by or []
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))
    spans = rows.groupBy(*by).agg(F.min("_v").alias("low"), F.max("_v").alias("high"), F.count(F.lit(1)).alias("total")).where("total > 0")
    reach = F.col("high") - F.col("low")
    if bins == "fd":
        quarters = quantiles(rows, "_v", _QUARTILES, by)
        spans = spans.join(quarters, by, "left") if by else spans.join(F.broadcast(quarters), how="left")  # without groups it is one row
        wanted = F.ceil(F.try_divide(reach, F.lit(2.0) * (F.col("_q3") - F.col("_q1")) / F.pow(F.col("total").cast("double"), F.lit(1.0 / 3))))
    else:
        wanted = F.floor(F.sqrt("total")) if bins == "sqrt" else F.lit(int(bins))
    spans = written(spans.select(*by, "low", "high", "total", F.greatest(F.coalesce(wanted, F.lit(1)), F.lit(1)).cast("long").alias("bins")))
    placed = rows.join(spans, by) if by else rows.join(F.broadcast(spans))  # without groups it is one row
    width = reach / F.col("bins")
    bin_ = F.coalesce(F.least(F.floor(F.try_divide(F.col("_v") - F.col("low"), width)), F.col("bins") - 1), F.lit(0)).cast("long")
    counted = placed.groupBy(*by, bin_.alias("bin"), "low", "high", "total", "bins").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(*by, "bin", (F.col("low") + F.col("bin") * width).alias("left"), "n", F.try_divide("n", F.col("total") * width).alias("density"))


def dwell_histogram(pulses_: DataFrame, bins: int | str = "fd", key: str = KEY) -> DataFrame:
    """state, bin, left, n, density of the groups' mean durations."""
    return histogram(written(pulses_.groupBy("state", key).agg(F.avg("dur").alias("m"))), "m", bins, ["state"])


def tops_before_and_after(before: DataFrame, after: DataFrame, key: str = KEY, value: str = VALUE) -> DataFrame:
    """side ('before', 'after'), bin, left, n, density of the groups' largest values on either side of a filter, by the root rule."""
    tops = lambda df, side: df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(value).alias("top")).select(F.lit(side).alias("side"), "top")
    return histogram(written(tops(before, "before").unionByName(tops(after, "after"))), "top", "sqrt", ["side"])
