"""Queries over movies much larger than memory: what is shuffled, sorted and written on the way, and odd items."""

from __future__ import annotations

import time

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from glimmer.functions import kernels
from glimmer.jobs import registry
from glimmer.operators import frames, spatial
from glimmer.sources import views
from tests.conftest import SMALL

RNG = np.random.default_rng(5)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def small_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "7")
    yield
    spark.conf.set(name, before)


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Items with null keys and quantities, quantities that are no whole numbers, and places beyond a frame."""
    folder = tmp_path_factory.mktemp("odd")
    holes = lambda v, kind: pa.array([None if RNG.random() < 0.04 else x for x in v.tolist()], kind)
    n = 600
    columns = {"l_orderkey": holes(RNG.integers(0, 9000, n), pa.int64()), "l_partkey": holes(RNG.integers(-40, 200, n), pa.int64()), "l_suppkey": holes(RNG.integers(0, 120, n), pa.int64()), "l_linenumber": pa.array(RNG.integers(1, 8, n), pa.int32()), "l_quantity": holes(RNG.choice([1.0, 2.5, 0.1, 1e-9, 40.0], n), pa.float64())}
    pq.write_table(pa.table(columns), f"{folder}/lineitem.parquet")
    return str(folder)


def from_sql(folder: str, sql: str) -> list[tuple]:
    con = duckdb.connect()
    con.sql(f"create view lineitem as select * from read_parquet('{folder}/lineitem.parquet')")
    return sorted(con.sql(sql).fetchall(), key=repr)


@pytest.mark.parametrize("own", ["image_id, t", "image_id, t, c"])
def test_frames_of_odd_items_equal_sql(spark, odd, small_batches, own):
    px, cte = (views.pixels(spark, odd), registry.PX) if own.count(",") == 1 else (views.channel_pixels(spark, odd), registry.CPX)
    rounded = lambda rows: sorted(((*r[:-1], round(r[-1], 9)) for r in rows), key=repr)
    assert rounded(px.select(*own.split(", "), "y", "x", "value").collect()) == rounded(from_sql(odd, f"WITH {cte} SELECT {own}, y, x, value FROM px"))


def test_frames_are_made_without_rows_of_pixels(spark):
    """Items are shuffled once; nothing is exploded, gathered into maps or sorted as pixels."""
    told = plan(views.frames(spark, SMALL))
    assert told.count("Exchange") == 1 and "Generate" not in told and "collect_list" not in told, told
    found = plan(registry.QUERIES["blob_log"](spark, SMALL))
    assert found.count("Exchange") == 1 and "Generate" not in found, found


def test_blobs_of_a_stack_are_those_of_each_frame():
    stack = RNG.random((40, 30, 5)) * 20
    how = dict(max_sigma=4, num_sigma=4, threshold=0.5)
    each = kernels.log_blobs_each(stack, **how)
    assert len(each) == 5 and all(len(b) > 3 and np.array_equal(b, kernels.log_blobs(stack[:, :, k], **how)) for k, b in enumerate(each))
    assert np.array_equal(kernels.gaussian_blur(stack, 3.0)[:, :, 2], kernels.gaussian_blur(stack[:, :, 2], 3.0))


def test_few_blobs_are_compared_as_many(monkeypatch):
    blobs = np.column_stack([RNG.integers(0, 60, 150), RNG.integers(0, 60, 150), RNG.choice([1.0, 2.5, 7.0], 150)])
    few = kernels.near_blobs(blobs)
    monkeypatch.setattr(kernels, "FEW_BLOBS", 0)
    assert np.array_equal(few, kernels.near_blobs(blobs)) and len(few[0]) > 50


@pytest.mark.parametrize("shift", [(0, 0), (2, -1), (-3, 4), (9, 0), (0, -20)])
def test_frames_are_moved_as_their_pixels(spark, small_batches, shift):
    df = spark.createDataFrame([(0, t, 6, 9, [None if k == 11 else float(v) for k, v in enumerate(RNG.random(54))]) for t in range(20)], "image_id int, t int, height int, width int, pixels array<double>")
    shifts = spark.createDataFrame([(t, *shift) for t in range(1, 20)], "t int, dr int, dc int")
    rows = lambda d: sorted(((r["t"], r["y"], r["x"], r["value"]) for r in frames.integer_shift(d, shifts, 6, 9, dense=True).collect()), key=repr)
    assert rows(df) == rows(frames.to_pixels(df)) and len(rows(df)) == 1080


def test_moved_movies_shuffle_no_pixel(spark):
    told = plan(registry.QUERIES["integer_shift"](spark, SMALL))
    assert told.count("Generate") == 1 and told.index("Generate") < told.index("Join") and told.count("Exchange hash") == 1, told


def test_drift_goes_by_places(spark):
    """Copies of a peak are compared once, equal the definition, and odd places match nothing."""
    rows = [(k, float(x), float(y)) for k, (x, y) in enumerate(np.repeat(RNG.integers(0, 60, (40, 2)), 3, axis=0) / 2)]
    first = spark.createDataFrame([(k, x, y) for k, x, y in rows] + [(900, float("nan"), 1.0), (901, None, 1.0), (902, float("inf"), 1.0)], "peak_id int, x double, y double")
    second = spark.createDataFrame([(k + 500, x + 3.7, y - 2.4) for k, x, y in rows[:90]] + [(990, float("nan"), 1.0), (991, None, 1.0), (992, float("inf"), 1.0)], "peak_id int, x double, y double")
    grid = {(r["gx"], r["gy"]): r["n"] for r in spatial.drift_grid(first, second, threshold=0.8, precision=1.0, max_x=5, max_y=5).collect()}
    want = {}
    for gx in range(-5, 6):
        for gy in range(-5, 6):
            n = sum(any(np.hypot(ax - (bx + 3.7 + gx), ay - (by - 2.4 + gy)) < 0.8 for _, ax, ay in rows) for _, bx, by in rows[:90])
            if n:
                want[gx, gy] = n
    assert grid == want
    got = sorted(tuple(r) for r in spatial.drift_matches(first, second, threshold=0.8, max_x=5, max_y=5).select("a_id", "b_id").collect())
    (gx, gy), _ = min(want.items(), key=lambda w: (-w[1], w[0]))
    near = lambda p, others, sx, sy: min(((np.hypot(p[1] - q[1] + sx, p[2] - q[2] + sy), q[0]) for q in others if np.hypot(p[1] - q[1] + sx, p[2] - q[2] + sy) < 0.8), default=(0, None))[1]
    moved = [(k + 500, x + 3.7 + gx, y - 2.4 + gy) for k, x, y in rows[:90]]
    backs = [near(b, rows, 0.0, 0.0) for b in moved]
    assert got == sorted((a, near(rows[a], moved, 0.0, 0.0)) for a in backs if a is not None) and len(got) == 90


def test_crowded_peaks_are_matched_in_seconds(spark):
    """30,000 peaks in each of two channels stand at one place: their pairs, a billion, are never made."""
    peaks = spark.range(30_000).select(F.col("id").alias("peak_id"), F.lit(5.0).alias("x"), F.lit(6.0).alias("y"))
    began = time.time()
    found = spatial.drift_matches(peaks, peaks, threshold=1.0, max_x=2, max_y=2)
    assert found.agg(F.count("*"), F.sum("a_id"), F.sum("b_id")).first() == (30_000, 0, 0)
    assert time.time() - began < 60


def test_crowded_channels_are_joined_in_seconds(spark):
    peaks = spark.range(30_000).select(F.col("id").alias("peak_id"), F.lit(5.0).alias("x"), F.lit(6.0).alias("y"))
    began = time.time()
    assert spatial.coloc_n_channels([peaks, peaks, peaks.where("peak_id < 3")], threshold=1.0, max_x=2, max_y=2).count() == 90_000
    assert time.time() - began < 60


#: Scans of lineitem in the last plan of a query, and its rows of pixels: what it needs more than once is written as frames.
LAST_PLANS = {"drift_correct_pixels": (0, 1), "drift_correct": (0, 0), "flat_field": (0, 0), "flat_field_pixels": (0, 1), "peak_fit": (0, 0), "roi_integrate": (1, 0), "roi_integrate_drift": (1, 0), "roi_integrate_legacy_axes": (1, 0), "xcorr_shift": (0, 0), "gauss2d_eval": (1, 0), "movie_trajectories": (0, 0), "chain_movie": (0, 0)}


@pytest.mark.parametrize("name", sorted(LAST_PLANS))
def test_movies_are_read_once(spark, name):
    told = plan(registry.QUERIES[name](spark, SMALL))
    scans, pixels = LAST_PLANS[name]
    assert told.count("l_orderkey") >= scans and told.count("lineitem.parquet") == scans and told.count("posexplode") == pixels, told


def test_integration_reads_the_images_of_peaks_alone(spark):
    told = plan(registry.QUERIES["roi_integrate"](spark, SMALL))
    assert told.index("LeftSemi") > told.index("Exchange hash"), told  # before items are shuffled


def test_frames_are_integrated_as_their_pixels(spark, small_batches):
    df = spark.createDataFrame([(i, t, c, 9, 12, [float(v) for v in RNG.integers(0, 50, 108)]) for i in range(2) for t in range(9) for c in range(2)], "image_id int, t int, c int, height int, width int, pixels array<double>")
    peaks = spark.createDataFrame([(i, k, float(x), float(y)) for i in range(3) for k, (x, y) in enumerate([(4, 4), (0, 0), (8, 11), (-2, 5), (-9, 5), (11, 14), (3, 40), (5, 6)])], "image_id int, peak_id int, x double, y double")
    for how in ({}, {"dx": 2, "dy": -1}, {"legacy_axes": True}):
        spots = frames.spot_table(df, peaks)
        got, want = (sorted(tuple(r) for r in frames.roi_integrate(d, spots, 1, 2, **how).select("image_id", "c", "trajectory", "slice", "Intensity", "bg", "x", "y").collect()) for d in (df, frames.to_pixels(df)))
        assert len(got) == len(want) > 100 and all(a[:4] == b[:4] and a[6:] == b[6:] and np.allclose(a[4:6], b[4:6], atol=1e-9) for a, b in zip(got, want, strict=True))


def test_highest_times_of_frames_are_those_of_pixels(spark, small_batches):
    nan = float("nan")
    df = spark.createDataFrame([(i, t, 2, 3, [float(v) for v in RNG.integers(-1, 2, 4)] + [RNG.choice([nan, 1.0]).item(), None if (t + i) % 3 else 1.0]) for i in range(3) for t in range(20)], "image_id int, t int, height int, width int, pixels array<double>").repartition(5)
    assert sorted(frames.project(df, "argmax").collect()) == sorted(frames.project(frames.to_pixels(df), "argmax").collect())
    told = plan(registry.QUERIES["project_argmax"](spark, SMALL))
    assert told.count("MapInArrow") == 2 and told.index("Generate") < told.rindex("MapInArrow"), told


@pytest.mark.parametrize("name", ["project_std", "project_max"])
def test_projections_add_up_a_stretch_in_its_task(spark, name):
    """Items are dealt by image and stretches of t, so what tasks leave is a row a pixel and stretch."""
    told = plan(registry.QUERIES[name](spark, SMALL))
    assert told.count("Exchange hash") == 2 and "FLOOR" in told[told.rindex("Exchange hash") :][:200], told
