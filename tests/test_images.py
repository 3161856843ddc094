"""Blobs by tiles and cells, spots by patches, flat field and drift without shuffling frames, nulls in pixels."""

from __future__ import annotations

import itertools
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from glimmer.functions import kernels as k
from glimmer.operators import frames

RNG = np.random.default_rng(21)
KIND = "image_id int, t int, c int, z int, height int, width int, pixels array<float>"


def movie(spark, images):
    return spark.createDataFrame([(i, t, 0, 0, *a.shape, [float(v) for v in a.ravel()]) for i, t, a in images], KIND)


def plain_overlap(a, b):
    ra, rb = a[2] * 2**0.5, b[2] * 2**0.5
    d = float(np.hypot(a[0] - b[0], a[1] - b[1]))
    if d >= ra + rb:
        return 0.0
    if d <= abs(ra - rb):
        return 1.0
    alpha, beta = np.arccos((d * d + ra * ra - rb * rb) / (2 * d * ra)), np.arccos((d * d + rb * rb - ra * ra) / (2 * d * rb))
    return (ra * ra * (alpha - np.sin(2 * alpha) / 2) + rb * rb * (beta - np.sin(2 * beta) / 2)) / (np.pi * min(ra, rb) ** 2)


def test_near_blobs_are_all_that_touch():
    blobs = np.column_stack([RNG.integers(0, 60, 150), RNG.integers(0, 60, 150), RNG.choice([1.0, 2.5, 7.0], 150)])
    i, j = k.near_blobs(blobs)
    found = dict(zip(zip(i.tolist(), j.tolist(), strict=True), k.overlaps(blobs[i], blobs[j]).tolist(), strict=True))
    for a, b in itertools.combinations(range(150), 2):
        assert np.isclose(found.get((a, b), 0.0), plain_overlap(blobs[a], blobs[b]), atol=1e-12), (a, b)


@pytest.mark.parametrize("tile", [7, 20, 33])
def test_borders_of_tiles_change_nothing(tile):
    frame = k.gaussian_blur(RNG.random((50, 61)), 1.0) * 10
    how = dict(min_sigma=1, max_sigma=4, num_sigma=4, threshold=0.05)
    whole = k.log_blobs(frame, **how)
    assert len(whole) > 20 and np.array_equal(whole, k.log_blobs(frame, **how, tile=tile))


def test_pruning_goes_from_the_strongest_on():
    frame = RNG.random((40, 40))
    how = dict(min_sigma=1, max_sigma=5, num_sigma=5, threshold=0.01)
    every = k.log_blobs(frame, **how, overlap=2.0)
    keep = np.ones(len(every), bool)
    for a, b in itertools.combinations(range(len(every)), 2):
        if keep[a] and keep[b] and plain_overlap(every[a], every[b]) > 0.5:
            keep[a if every[a, 2] < every[b, 2] else b] = False
    assert 0 < keep.sum() < len(keep) and np.array_equal(every[keep], k.log_blobs(frame, **how))


def test_thousands_of_blobs_in_seconds():
    frame = RNG.random((512, 512))
    began = time.time()
    assert len(k.log_blobs(frame, max_sigma=5, num_sigma=5, threshold=0.02)) > 5000
    assert time.time() - began < 30


def test_patches_are_fitted_as_each_alone():
    y, x = np.mgrid[:40, :40]
    frame = 2 + sum(a * np.exp(-((y - r) ** 2 + (x - c) ** 2) / (2 * s * s)) for a, r, c, s in ((9, 10, 10, 1.5), (7, 22.4, 13.7, 2), (5, 30, 31, 1.2))) + RNG.normal(0, 0.01, (40, 40))
    rows, columns = np.array([10, 22, 30, 2]), np.array([10, 14, 31, 20])
    windows, whole = k.patches(frame, rows, columns, 4)
    assert whole.tolist() == [True, True, True, False]
    got, ok = k.fit_patches(windows, rows[:3], columns[:3])
    assert ok.all() and np.allclose(got[:, 1:3], [[10, 10], [22.4, 13.7], [30, 31]], atol=0.02)
    for n in range(3):
        gx, gy = np.meshgrid(np.arange(rows[n] - 4, rows[n] + 4), np.arange(columns[n] - 4, columns[n] + 4), indexing="ij")
        alone, settled = k.least_squares(lambda q, n=n, gx=gx, gy=gy: (k.gaussian_2d(gx, gy, q) - windows[n]).ravel(), np.array([windows[n].max(), rows[n], columns[n], 2, 2, 0, 0], float))
        assert settled and np.allclose(k.gaussian_2d(gx.ravel(), gy.ravel(), alone), k.gaussian_2d(gx.ravel(), gy.ravel(), got[n]), rtol=1e-7)  # the angle of a round spot is open


def test_spots_of_many_frames(spark):
    y, x = np.mgrid[:24, :24]
    spot = lambda r, c: 1 + 8 * np.exp(-((y - r) ** 2 + (x - c) ** 2) / 4.5)
    df = movie(spark, [(0, t, spot(10 + t, 12)) for t in range(3)] + [(1, 0, spot(8, 9))])
    peaks = spark.createDataFrame([(0, 0, 11.0, 12.0), (0, 1, 1.0, 1.0), (0, 2, None, 3.0), (1, 0, 8.0, 9.0)], "image_id int, peak_id int, x double, y double").withColumn("pixels", F.lit("clash"))
    got = {(r["image_id"], r["t"], r["peak_id"]): r for r in frames.fit_spots(df, peaks).collect()}
    assert len(got) == 10 and {got[0, t, 1]["status"] for t in range(3)} == {"clipped"} and got[0, 0, 2]["status"] == "failed"
    assert all(np.isclose(got[0, t, 0]["xo"], 10 + t, atol=1e-3) for t in range(3)) and np.isclose(got[1, 0, 0]["yo"], 9, atol=1e-3)
    assert frames.fit_spots(df.limit(0), peaks).count() == frames.fit_spots(df, peaks.limit(0)).count() == 0


def test_no_frame_is_shuffled(spark):
    df = movie(spark, [(i, t, RNG.random((16, 16)) + 1) for i in range(2) for t in range(5)]).repartition(3)
    df.write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/frames-{time.time_ns()}")
    df = spark.read.parquet(path)
    for out, nodes in ((frames.flat_field(df, 2.0), 1), (frames.drift_correct(df), 1)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan and plan.count("MapInArrow") == nodes, plan
    peaks = spark.createDataFrame([(0, k_, 8.0, 8.0) for k_ in range(50)], "image_id int, peak_id int, x double, y double")
    plan = frames.fit_spots(df, peaks)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.index("collect_list") > plan.index("Join")  # peaks are one row before they meet frames


def test_flat_field_against_its_definition(spark):
    images = [(i, t, RNG.random((20, 30)) * 50 + 100) for i in range(2) for t in range(3)]
    images[0][2][3, 4] = 100.0
    got = {(r["image_id"], r["t"]): np.array(r["pixels"]).reshape(20, 30) for r in frames.flat_field(movie(spark, images), 2.0, offset=100.0).collect()}
    for i in range(2):
        blurs = {t: k.gaussian_blur(a.astype(np.float32).astype(float) - 100, 2.0) for n, t, a in images if n == i}
        top = max(b.max() for b in blurs.values())
        for n, t, a in images:
            if n == i:
                assert np.allclose(got[i, t], (a.astype(np.float32).astype(float) - 100) * top / blurs[t], rtol=1e-5, atol=1e-5)


def test_null_pixels(spark):
    holes = [1.0] * 64
    df = spark.createDataFrame([(0, 0, 0, 0, 8, 8, holes[:10] + [None, float("nan")] + holes[12:]), (0, 1, 0, 0, 8, 8, holes)], KIND)
    flat = {r["t"]: np.array(r["pixels"], float) for r in frames.flat_field(df, 0.3).collect()}
    assert np.isnan(flat[0]).any() and np.allclose(flat[1], 1)
    assert frames.find_blobs(df, max_sigma=1, num_sigma=1, threshold=5.0).count() == 0
    assert frames.flat_field(df.limit(0)).count() == frames.drift_correct(df.limit(0)).count() == frames.find_blobs(df.limit(0)).count() == 0


def test_long_movies_meet_their_reference_by_stretches(spark, monkeypatch):
    monkeypatch.setattr(frames, "BESIDE", 2)
    image = k.gaussian_blur(RNG.random((16, 16)), 1.0)
    df = movie(spark, [(0, t + 5, np.roll(image, t % 3, 0)) for t in range(7)])
    assert sorted((r["t"], r["dr"], r["dc"]) for r in frames.frame_shifts(df).collect()) == [(t + 5, t % 3, 0) for t in range(7)]


@pytest.mark.parametrize("shift", [(0, 0), (2, -1), (-3, 4), (9, 0), (0, -20)])
def test_dense_shifts_equal_the_grid(spark, shift):
    df = movie(spark, [(0, t, RNG.random((6, 9))) for t in range(2)])
    px = frames.to_pixels(df)
    shifts = spark.createDataFrame([(1, *shift)], "t int, dr int, dc int")
    rows = lambda d: sorted((r["t"], r["y"], r["x"], r["value"]) for r in frames.integer_shift(px, shifts, 6, 9, dense=d).collect())
    assert rows(True) == rows(False) and len(rows(True)) == 108
