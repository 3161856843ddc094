"""Hand-computed cases of the trajectory, event, peak and pixel operators."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glimmer.functions import kernels, whole
from glimmer.jobs import registry
from glimmer.operators import columns, events, frames, groups, hmm, segments, spatial
from glimmer.sources import views
from tests.conftest import SMALL

FIT = [0, 0, 1, 1, 1, 0, 1, 1]
VALUES = [1.0, 1.0, 10.0, 12.0, 11.0, 2.0, 9.0, 9.0]


@pytest.fixture(scope="module")
def one(spark):
    rows = [(1, k, v, f, 0.5 * k) for k, (v, f) in enumerate(zip(VALUES, FIT, strict=True))]
    return spark.createDataFrame(rows, "trajectory int, slice int, Intensity double, fit int, seconds double").repartition(3)


def states(spark, *each):
    rows = [(k, t, f) for k, fits in enumerate(each) for t, f in enumerate(fits)]
    return spark.createDataFrame(rows, "trajectory int, slice int, fit int")


def test_events_of_one_trajectory(one):
    assert events.event_counts(one).collect()[0]["events"] == 2.0
    rle = events.rle_dwelltimes(one).orderBy("run_id").collect()
    assert [r["dwell"] for r in rle if r["kind"] == "on"] == [3, 2]
    assert [r["dwell"] for r in rle if r["kind"] == "off"] == [2, 1]
    dwells = events.dwell_times(one).orderBy("run_id").collect()
    assert [r["dwell"] for r in dwells if r["kind"] == "on"] == [1.5]
    assert [r["dwell"] for r in dwells if r["kind"] == "off"] == [1.0, 0.5]


def test_pulses(one):
    got = sorted((r["state"], r["dur"], r["Intensity"], r["std"], r["start_frame"], r["end_frame"]) for r in events.pulses(one).where("std is not null").collect())
    assert got == [("off", 2.0, 1.0, 0.0, 0, 2), ("on", 3.0, 11.0, 1.0, 2, 5)]
    alone = events.pulses(one).where("std is null").collect()
    assert [(r["state"], r["dur"], r["start_frame"], r["end_frame"]) for r in alone] == [("off", 1.0, 5, 6)]


def test_effect_size_and_longest_run(one):
    assert math.isclose(groups.cohens_d(one).collect()[0]["d"], 7.948270252, rel_tol=1e-9)
    assert events.longest_even_run(one).collect()[0]["longest"] == 3
    assert events.longest_even_run(one, legacy=True).collect()[0]["longest"] == 3


def test_event_count_edges(spark):
    got = events.event_counts(states(spark, [0, 1, 1, 0], [0, 0, 1, 1], [1, 1, 0, 0], [1, 1], [0, 0])).orderBy("trajectory").collect()
    assert [r["events"] for r in got] == [1, 1, 0.5, 0.5, 0]


def test_longest_even_run_glues_groups(spark):
    # runs over all rows: 0 | 1 1 1 (two of one group, one of the next) | 0
    assert events.longest_even_run(states(spark, [0, 1, 1], [1, 0]), legacy=True).collect()[0]["longest"] == 3


def test_filter_garbage(spark):
    df = spark.createDataFrame([(1, 0, 10.0), (2, 0, 12.0), (3, 0, 100.0), (None, 0, 5.0)], "trajectory int, slice int, Intensity double")
    kept = lambda t: sorted(r[0] for r in groups.filter_garbage(df, t).select("trajectory").collect())
    assert kept(1.0) == [1, 2] and kept(2.0) == [1, 2, 3]
    assert groups.filter_garbage(df.where("trajectory = 1")).count() == 0
    assert groups.filter_garbage(df.limit(0)).count() == 0


def test_snr_neither_and_boundaries(spark, one):
    lone = one.withColumn("fit", F.lit(1))
    assert groups.filter_snr(lone).count() == 0 and groups.filter_snr(lone, bad=True).count() == 0
    assert groups.filter_inactive(one, 2.0).count() == 8
    assert groups.filter_inactive(one, 2.0, inactive=True, legacy=True).count() == 8
    assert groups.filter_inactive(one, 2.0, inactive=True).count() == 0


def test_select_events(spark):
    df = spark.createDataFrame([(1, 0, 5.0, 1), (1, 1, 0.0, 1), (1, 2, 7.0, 0), (2, 0, 8.0, 1), (2, 1, 9.0, 1)], "trajectory int, slice int, Intensity double, fit int")
    assert groups.select_events(df, [1]).count() == 3
    assert [tuple(r) for r in groups.select_events(df, [1], legacy=True).collect()] == [(1, 0, 5.0, 1)]


def test_smoothing(spark):
    df = spark.createDataFrame([(1, k, v) for k, v in enumerate([1.0, 10.0, 12.0, 11.0])], "trajectory int, slice int, Intensity double")
    got = [r["smooth_Intensity"] for r in columns.smooth(df, width=3).orderBy("slice").collect()]
    assert got[:2] == [None, None] and math.isclose(got[2], 23 / 3) and math.isclose(got[3], 11)
    # a parabola is its own fit, edges too
    bend = spark.createDataFrame([(1, k, float(k * k - 3 * k)) for k in range(9)], "trajectory int, slice int, Intensity double")
    fitted = columns.smooth(bend, width=5, method="savgol", polyorder=2).collect()
    assert all(math.isclose(r["smooth_Intensity"], r["Intensity"], abs_tol=1e-9) for r in fitted)
    with pytest.raises(ValueError):
        columns.smooth(df, method="other")


def test_sem(spark):
    rows = [("on", k, d) for k, d in enumerate([1.5, 0.5, 2.5])]
    got = events.dwell_sem(spark.createDataFrame(rows, "state string, trajectory int, dur double")).collect()[0]
    assert math.isclose(got["sem"], 0.5773502692, rel_tol=1e-9)


def peaks(spark, *places):
    return spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(places)], "peak_id int, x double, y double")


def test_isolation(spark):
    got = spatial.isolated(peaks(spark, (0, 0), (0, 3), (20, 20)), 10).collect()
    assert [(r["x"], r["y"]) for r in got] == [(20, 20)]
    assert spatial.isolated(peaks(spark, (1, 1)), 10).count() == 1
    assert spatial.isolated(peaks(spark, (1, 1), (1, 1)), 10).count() == 2
    assert spatial.isolated(peaks(spark, (1, 1)).limit(0), 10).count() == 0


def test_colocalisation(spark):
    a, b = peaks(spark, (0, 0), (10, 10)), peaks(spark, (0.3, 0), (0, 0.4), (50, 50))
    assert [tuple(r) for r in spatial.coloc_pairs(a, b, 1.0).collect()] == [(0, 0.0, 0.0, 0, 0.3, 0.0)] * 2
    assert spatial.coloc_pairs(a, b, 1.0, mutual=True).count() == 1
    moved = spatial.best_drift(a, peaks(spark, (-3, 2), (7, 12)), threshold=1.0).collect()[0]
    assert (moved["gx"], moved["gy"], moved["n"]) == (3.0, -2.0, 2)
    assert spatial.drift_matches(a, peaks(spark, (400, 400)), threshold=1.0).count() == 0


def test_roi_integration(spark):
    rows = [(0, y, x, 5.0 if abs(y - 3) <= 1 and abs(x - 3) <= 1 else 2.0) for y in range(7) for x in range(7)]
    pixels = spark.createDataFrame(rows, "t int, y int, x int, value double")
    got = frames.roi_integrate(pixels, peaks(spark, (3, 3)), 1, 1).collect()[0]
    assert (got["bg"], got["Intensity"]) == (2.0, 27.0)


def test_shift_and_projection(spark):
    rows = [(t, y, x, float(10 * y + x + t)) for t in range(2) for y in range(3) for x in range(3)]
    pixels = spark.createDataFrame(rows, "t int, y int, x int, value double")
    shifts = spark.createDataFrame([(1, 1, -1)], "t int, dr int, dc int")
    got = {(r["t"], r["y"], r["x"]): r["value"] for r in frames.integer_shift(pixels, shifts, 3, 3).collect()}
    assert got[0, 2, 2] == 22 and got[1, 0, 1] == 11 and got[1, 2, 1] == 0 and got[1, 0, 0] == 0
    assert frames.project(pixels, "std").where("y = 1 and x = 1").collect()[0]["value"] == 0.5


def test_segments(spark, one):
    cp = spark.createDataFrame([(1, [2, 5, 8])], "trajectory int, bkps array<int>")
    got = [r["seg"] for r in segments.build_segments(one, cp).orderBy("slice").collect()]
    assert got == [1, 1, 11, 11, 11, 20 / 3, 20 / 3, 20 / 3]
    ends = spark.createDataFrame([(1, k, 0.0 if k < 20 else 5.0) for k in range(40)], "trajectory int, slice int, Intensity double")
    assert segments.change_points(ends, penalty=1.0).collect()[0]["bkps"] == [20, 40]


@pytest.mark.parametrize("n", [1, 3, 7])
def test_partitions_do_not_matter(one, n):
    base = sorted(map(tuple, events.runs(one).collect()))
    again = sorted(map(tuple, events.runs(one.repartition(n)).collect()))
    assert base == again and sum(r[5] for r in base) == 8


def test_page_ids(spark):
    got = {r["trajectory"]: r["page"] for r in spatial.page_ids(spark.range(25).select(F.col("id").alias("trajectory")), "trajectory", 9).collect()}
    assert got == {k: k // 9 for k in range(25)}


def scans(df) -> tuple[int, int]:
    """Table scans and Python nodes of a plan."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan.count("Relation ["), plan.count("MapInArrow")


def test_the_chain_is_planned_once(spark):
    df = views.trajectories(spark, SMALL)
    # the cutoff of the first filter looks over all groups, so it reads the table too
    assert scans(registry.chain_pulses(df)) == (2, 1)
    kept = groups.filter_min_rows(groups.filter_std(groups.filter_negative(df, windowed=True), 1.0, windowed=True), 3, windowed=True)
    assert scans(kept) == (1, 0)
    shuffles = kept._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert shuffles <= 2


@pytest.mark.parametrize("windowed", [False, True])
def test_windows_keep_the_same_groups(spark, windowed):
    df = views.trajectories(spark, SMALL)
    for f in (lambda d, **k: groups.filter_garbage(d, 1.0, **k), lambda d, **k: groups.filter_snr(d, 0.2, **k), lambda d, **k: groups.filter_inactive(d, 16.0, **k), lambda d, **k: groups.filter_std(d, 55.0, **k)):
        got, want = f(df, windowed=windowed), f(df)
        assert got.columns == df.columns
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_decode_keeps_ties_and_columns(spark):
    rows = [(1, 0, 30.0, "a"), (1, 0, 30.0, "b"), (1, 1, 90.0, "c"), (2, 0, 31.0, "d"), (None, 0, 1.0, "e"), (2, 1, None, "f")]
    df = spark.createDataFrame(rows, "trajectory int, slice int, Intensity double, note string").repartition(2)
    got = hmm.decode(df, registry.MODEL).collect()
    assert sorted((r["note"], r["fit"]) for r in got) == [("a", 0), ("b", 0), ("c", 1), ("d", 0)]
    assert hmm.decode(df.limit(0), registry.MODEL).count() == 0


def test_trajectories_across_batches(spark):
    """However rows fall into batches, a trajectory comes whole."""
    sizes = [3, 1, 7, 2, 5]
    place = np.concatenate([np.arange(1, n + 1) for n in sizes])
    table = pa.table({"id": np.repeat(np.arange(5), sizes), whole.POSITION: place})
    for most in (1, 4, 100):
        for step in (1, 2, 5, 18):
            parts = list(whole.trajectories(iter(table.to_batches(step)), most))
            assert np.concatenate([t.column("id").to_numpy() for t, _ in parts]).tolist() == table.column("id").to_pylist()
            assert [n for _, first in parts for n in np.diff(first).tolist()] == sizes


def test_images_do_not_meet(spark):
    rows = [(i, c, 0, y, x, float(1 + c + 2 * i)) for i in range(2) for c in range(2) for y in range(9) for x in range(9)]
    pixels = spark.createDataFrame(rows, "image_id int, c int, t int, y int, x int, value double")
    at = spark.createDataFrame([(0, 0, 4.0, 4.0), (1, 0, 4.0, 4.0)], "image_id int, peak_id int, x double, y double")
    got = sorted((r["image_id"], r["c"], r["bg"], r["Intensity"]) for r in frames.roi_integrate(pixels, at, 1, 1).collect())
    assert got == [(0, 0, 1.0, 0.0), (0, 1, 2.0, 0.0), (1, 0, 3.0, 0.0), (1, 1, 4.0, 0.0)]
    moved = frames.integer_shift(pixels, spark.createDataFrame([(0, 0, 1, 0), (1, 0, 0, 0)], "image_id int, t int, dr int, dc int"), 9, 9)
    assert moved.count() == pixels.count()
    assert moved.where("value = 0").select("image_id", "y").distinct().collect() == [(0, 8)]
    # ids count from 0 in each image, and the same places in two images are no neighbours
    near = spark.createDataFrame([(0, 0, 0.0, 0.0), (0, 1, 3.0, 0.0), (1, 0, 0.0, 0.0), (1, 1, 50.0, 0.0)], "image_id int, peak_id int, x double, y double")
    assert sorted((r["image_id"], r["peak_id"]) for r in spatial.isolated(near, 10).collect()) == [(1, 0), (1, 1)]
    other = near.withColumn("x", F.col("x") + 2)
    assert spatial.nn_threshold_join(near, other, 2.5).where("image_id = 1").count() == 2
    both = spatial.drift_matches(near, near.withColumn("x", F.col("x") + F.when(F.col("image_id") == 0, 3).otherwise(-2)), threshold=0.5)
    assert sorted((r["image_id"], r["a_id"], r["b_id"]) for r in both.collect()) == [(0, 0, 0), (0, 1, 1), (1, 0, 0), (1, 1, 1)]


def test_sample_and_channels(spark, one):
    df = views.trajectories(spark, SMALL)
    got = hmm.sample_n_groups(df, 4)
    assert got.select("trajectory").distinct().count() == 4 and hmm.sample_n_groups(one, 4).count() == 8
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, hmm.sample_n_groups(df.repartition(7), 4).collect()))
    both = frames.stack_trajectories(one, one)
    assert both.count() == 16 and both.select("trajectory").distinct().count() == 2
    movie = spark.createDataFrame([(0, t, c, 0, 1, 1, [1.0]) for t in range(3) for c in range(2)], "image_id int, t int, c int, z int, height int, width int, pixels array<float>")
    assert [tuple(r) for r in frames.count_channels(movie).collect()] == [(0, 2, 2)]


def test_null_keys_and_missing_break_points(spark):
    df = spark.createDataFrame([(1, 0, 2.0), (1, 1, 4.0), (None, 0, 8.0)], "trajectory int, slice int, Intensity double")
    got = {(r["trajectory"], r["slice"]): r["norm_Intensity"] for r in columns.normalize(df).collect()}
    assert got == {(1, 0): 0.5, (1, 1): 1.0, (None, 0): None}
    none = spark.createDataFrame([], "trajectory int, bkps array<int>")
    assert [(r["segment"], r["seg"]) for r in segments.build_segments(df, none).collect()] == [(0, 3.0), (0, 3.0)]


def test_found_segments_equal_the_search(spark):
    df = views.trajectories(spark, SMALL)
    values = {}
    for r in df.orderBy("trajectory", "slice").collect():
        values.setdefault(r["trajectory"], []).append(r["Intensity"])
    got = {(r["trajectory"], r["slice"]): (r["segment"], r["seg"]) for r in registry.QUERIES["piecewise_found"](spark, SMALL).collect()}
    cut = 0
    for t, x in values.items():
        ends = kernels.binary_segmentation(np.array(x), 20_000.0, "l2")
        cut += len(ends) > 1
        for k, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
            assert all(got[t, j] == (k, round(float(np.mean(x[a:b])), 6)) or math.isclose(got[t, j][1], np.mean(x[a:b]), abs_tol=2e-6) and got[t, j][0] == k for j in range(a, b))
    assert cut
