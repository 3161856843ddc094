"""Unique trajectories over images and channels, from pixels on, and order over a whole table."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from glimmer.operators import events, frames, groups, ordered, spatial


@pytest.fixture(scope="module")
def movie(spark):
    """Two images of three frames in two channels; a pixel's value tells where it is."""
    rows = [(i, t, c, y, x, float(1000 * i + 100 * c + 10 * t + (y == 5 and x == 5))) for i in (0, 1) for t in range(3) for c in (0, 1) for y in range(12) for x in range(12)]
    return spark.createDataFrame(rows, "image_id int, t int, c int, y int, x int, value double").repartition(3)


def test_clashing_peak_numbers_stay_apart(spark, movie):
    peaks = spark.createDataFrame([(0, 0, 0, 5.0, 5.0), (0, 1, 0, 6.0, 5.0), (1, 0, 0, 5.0, 5.0), (1, 1, 0, 5.0, 6.0), (7, 0, 0, 5.0, 5.0)], "image_id int, c int, peak_id int, x double, y double")
    spots = frames.spot_table(movie, peaks)
    got = {r["trajectory"]: (r["image_id"], r["c"], r["peak_c"]) for r in spots.collect()}
    assert got == {4 * i + 2 * c + p: (i, c, p) for i in (0, 1) for c in (0, 1) for p in (0, 1)}
    assert got == {r["trajectory"]: (r["image_id"], r["c"], r["peak_c"]) for r in frames.spot_table(movie.repartition(7), peaks.repartition(5)).collect()}
    each = frames.roi_integrate(movie, spots, 1, 1)
    assert each.groupBy("trajectory").count().where("count = 3").count() == 8
    assert groups.filter_min_rows(each, 4).count() == 0 and groups.filter_min_rows(each, 3).count() == 24
    assert {(r["image_id"], r["c"], r["trajectory"]) for r in each.collect()} == {(i, c, 4 * i + 2 * c + p) for i in (0, 1) for c in (0, 1) for p in (0, 1)}
    own = frames.roi_integrate(movie, peaks, 1, 1, by=["image_id", "c"])  # each in its own channel, numbered on the way
    assert {(r["image_id"], r["c"], r["trajectory"]) for r in own.collect()} == {(0, 0, 0), (0, 1, 1), (1, 0, 2), (1, 1, 3)}
    marked = each.withColumn("fit", (F.col("slice") % 2).cast("int"))
    assert events.pulses(marked).count() == 16  # two runs but the last of each


def test_each_image_has_its_own_drift(spark, movie):
    peaks = spark.createDataFrame([(0, 0, 4.0, 5.0), (1, 0, 5.0, 3.0)], "image_id int, peak_id int, x double, y double")
    drift = spark.createDataFrame([(0, 1, 0), (1, 0, 2)], "image_id int, gx int, gy int")
    moved = frames.roi_integrate(movie, frames.spot_table(movie, peaks.join(drift, "image_id")), 0, 1, dx="gx", dy="gy")
    assert {(r["x"], r["y"], round(r["Intensity"], 6)) for r in moved.collect()} == {(4, 5, 1.0), (5, 3, 1.0)}


def test_colocalised_spots_are_integrated_where_they_stood(spark, movie):
    first = spark.createDataFrame([(0, 0, 5.0, 5.0), (1, 0, 5.0, 5.0)], "image_id int, peak_id int, x double, y double")
    second = spark.createDataFrame([(0, 0, 3.0, 4.0), (1, 0, 6.0, 5.0)], "image_id int, peak_id int, x double, y double")
    matches = spatial.coloc_n_channels([first, second], ["a", "b"], 0.5)
    spots = frames.spot_table(movie, frames.channel_spots(matches, {"a": 0, "b": 1}), by=["image_id", "c"])
    assert {(r["image_id"], r["c"], r["x"], r["y"], r["trajectory"]) for r in spots.collect()} == {(0, 0, 5.0, 5.0, 0), (0, 1, 3.0, 4.0, 1), (1, 0, 5.0, 5.0, 2), (1, 1, 6.0, 5.0, 3)}
    assert frames.roi_integrate(movie, spots, 1, 1).count() == 12


def test_spots_of_odd_tables(spark, movie):
    peaks = spark.createDataFrame([(0, 0, 5.0, 5.0), (0, 0, 5.0, 5.0), (0, None, 6.0, 6.0), (None, 1, 1.0, 1.0)], "image_id int, peak_id int, x double, y double").withColumn("trajectories", F.lit("more"))
    got = frames.spot_table(movie, peaks).orderBy("trajectory").collect()
    assert [(r["trajectory"], r["peak_id"], r["c"]) for r in got] == [(0, None, 0), (1, 0, 0), (2, None, 1), (3, 0, 1)]
    assert frames.spot_table(movie, peaks.limit(0)).count() == 0


def test_frames_of_pixels_and_back(spark, movie):
    whole = frames.to_frames(movie, 12, 12)
    assert whole.count() == 12 and sorted(frames.to_pixels(whole).drop("z").collect()) == sorted(movie.select("image_id", "t", "c", "y", "x", F.col("value").cast("float")).collect())
    holes = frames.to_frames(movie.where("y <> 3"), 12, 12)
    assert frames.to_pixels(holes).where("y = 3 and value <> 0").count() == 0


def test_find_peaks_is_its_three_steps(spark):
    from glimmer.jobs import registry
    from glimmer.sources import views
    from tests.conftest import SMALL

    means = frames.to_frames(frames.project(views.channel_pixels(spark, SMALL)), views.HEIGHT, views.WIDTH)
    how = {k: v for k, v in registry.SPOTS.items() if k not in ("roi", "min_dist")}
    steps = spatial.isolated(spatial.roi_filter(frames.find_blobs(means, **how), (4, 4, 27, 27)), 3.0)
    assert sorted(frames.find_peaks(means, **registry.SPOTS).collect()) == sorted(steps.select(*frames.find_blobs(means, **how).columns).collect())


@pytest.mark.parametrize("n", [1, 9])
def test_running_sums_and_previous_rows(spark, n):
    random.seed(n)
    rows = [(random.choice([None, *range(5)]), k, random.randint(0, 9)) for k in range(300)]
    df = spark.createDataFrame(rows, "a int, b int, v int").repartition(n)
    placed = ordered.dealt(df, ["a", "b"])
    got = ordered.previous(ordered.running(placed, ["a", "b"], {"before": F.col("v"), "n": F.lit(1)}), ["a", "b"], "v", "last")
    want, total, last = {}, 0, None
    for k, (_, b, v) in enumerate(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))):
        want[b] = (total, k, last)
        total, last = total + v, v
    assert {r["b"]: (r["before"], r["n"], r["last"]) for r in got.collect()} == want
    assert ordered.numbered(df.limit(0), ["a", "b"], "k").count() == 0


def test_no_window_over_the_whole_table(spark):
    """Ordering every row (or key) in one task is left to no operator: what a window without partitions sees is one row a part."""
    df = spark.range(1000).select(F.col("id").alias("trajectory"), F.lit(0).alias("slice"), (F.col("id") % 2).cast("int").alias("fit"))
    dwells = spark.range(1000).select(F.col("id").alias("trajectory"), F.lit("on").alias("kind"), F.lit(1).alias("run_id"), F.lit(1.0).alias("dwell"))
    for out in (events.longest_even_run(df, legacy=True), events.dwell_pairs_legacy(dwells), spatial.page_ids(df, "trajectory", 9)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        whole = [w for w in re.findall(r"windowspecdefinition\(([^,]*)", plan) if " ASC" in w or " DESC" in w]  # no column before the order
        assert all(w.startswith("_part#") for w in whole)


@pytest.mark.parametrize("values", [[1.0], [3.0] * 50, list(range(101)), [-1e308, 1e308, 0.0, 5e-324], [1.0 + k * 2**-52 for k in range(40)] + [1e9], "random"])
def test_exact_quantiles_without_sorting(spark, values):
    import numpy as np

    values = np.random.default_rng(3).normal(size=999).tolist() if values == "random" else [float(v) for v in values]
    rows = [("a", v) for v in values] + [("b", 2.0 * v) for v in values[:3] if abs(v) < 1e300] + [("c", None), ("a", None), ("a", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    shares = {"low": 0.25, "half": 0.5, "high": 0.75, "top": 1.0}
    got = {r["g"]: [r[n] for n in shares] for r in events.quantiles(df, "v", shares, ["g"]).collect()}
    for g in ("a", "b"):
        own = np.sort([v for n, v in rows if n == g and v is not None and not np.isnan(v)])
        at = [(len(own) - 1) * q for q in shares.values()]
        want = [own[int(np.floor(p))] + (own[int(np.ceil(p))] - own[int(np.floor(p))]) * (p - np.floor(p)) for p in at] if len(own) else None
        assert got.get(g) == want
    assert "c" not in got and events.quantiles(df.where("g = 'c'"), "v", shares).count() == 0
    whole = events.quantiles(df.where("g = 'a'"), "v", shares).collect()
    assert [whole[0][n] for n in shares] == got["a"]
