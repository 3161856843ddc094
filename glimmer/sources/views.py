"""Canonical tables made from the driver's: trajectories from events, pixels from lineitem, peaks from embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glimmer.operators.frames import to_pixels
from glimmer.schemas import nulls_for_nans
from glimmer.sources.shared import small_batches

#: Suppliers of an image, orders of a frame, and the frames' size: images and frames grow with the table.
SUPPLIERS, ORDERS, HEIGHT, WIDTH = 50, 1000, 32, 32
#: Steps of t of an image that are made in one task, and frames that are made at once.
STRETCH, FRAMES_AT_ONCE = 64, 256


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trajectory, slice, Intensity, fit, seconds: a user's events in order."""
    events = nulls_for_nans(read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value"))
    at = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    on = F.when(F.col("event_type").isin("click", "purchase"), 1).otherwise(0)
    return events.select(F.col("user_id").alias("trajectory"), at.alias("slice"), F.col("value").alias("Intensity"), on.alias("fit")).withColumn("seconds", F.col("slice") * 0.5)


def _items(spark: SparkSession, sf_dir: str, places: DataFrame | None) -> DataFrame:
    """image_id, t, c, at (row by row, null outside a frame), quantity of each item; ``places``: only those of the images, or images and times, in this table."""
    lines = read(spark, sf_dir, "lineitem")
    y, x = F.col("l_partkey") % HEIGHT, (F.col("l_suppkey") * 7 + F.col("l_linenumber")) % WIDTH
    image, t = F.floor(F.col("l_suppkey") / SUPPLIERS).cast("int"), F.floor(F.col("l_orderkey") / ORDERS).cast("int")
    inside = image.isNotNull() & t.isNotNull() & y.between(0, HEIGHT - 1) & x.between(0, WIDTH - 1)
    items = lines.select(image.alias("image_id"), t.alias("t"), (F.col("l_linenumber") % 2).cast("int").alias("c"), F.when(inside, y * WIDTH + x).cast("int").alias("at"), F.col("l_quantity").alias("quantity"))
    return items if places is None else items.join(places, [c for c in ("image_id", "t") if c in places.columns], "left_semi")


def _dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Frames of items that come frame after frame (at and quantity last): the sums at all places, 0 where none is. The last frame of a batch waits for the next batch, which may go on with it."""
    size, waits = HEIGHT * WIDTH, None

    def out(keys: pa.RecordBatch, sums: np.ndarray) -> pa.RecordBatch:
        pixels = pa.ListArray.from_arrays(pa.array(np.arange(len(sums) + 1, dtype=np.int32) * size), pa.array(sums.ravel()))
        sides = [pa.array(np.full(len(sums), n, np.int32)) for n in (HEIGHT, WIDTH)]
        return pa.RecordBatch.from_arrays([*keys.columns, *sides, pixels], names=[*keys.schema.names, "height", "width", "pixels"])

    for batch in batches:
        if not batch.num_rows:
            continue
        own = batch.select(batch.schema.names[:-2])
        new = np.ones(len(batch), bool)
        new[1:] = False
        for c in own.columns:
            for v in (c.is_null().to_numpy(zero_copy_only=False), c.fill_null(0).to_numpy()):
                new[1:] |= v[1:] != v[:-1]
        at = batch.column(len(own.columns)).fill_null(-1).to_numpy()
        quantity = np.where(at < 0, 0.0, batch.column(len(own.columns) + 1).fill_null(0).to_numpy())
        first = np.flatnonzero(new)
        for k in range(0, len(first), FRAMES_AT_ONCE):
            heads = first[k : k + FRAMES_AT_ONCE]
            begin, end = heads[0], first[k + FRAMES_AT_ONCE] if k + FRAMES_AT_ONCE < len(first) else len(batch)
            place = (np.cumsum(new[begin:end]) - 1) * size + np.maximum(at[begin:end], 0)
            sums = np.bincount(place, quantity[begin:end], minlength=len(heads) * size).reshape(len(heads), size)
            keys = own.take(pa.array(heads))
            if waits is not None:
                if keys.slice(0, 1).equals(waits[0]):
                    sums[0] += waits[1][0]
                else:
                    yield out(*waits)
            waits = keys.slice(len(heads) - 1), sums[-1:].copy()
            yield out(keys.slice(0, len(heads) - 1), sums[:-1])
    if waits is not None:
        yield out(*waits)


def movie(spark: SparkSession, sf_dir: str, channels: bool = False, places: DataFrame | None = None) -> DataFrame:
    """image_id, t (and c with ``channels``), height, width, pixels: frames of 32 by 32, summed quantities as doubles.

    Items are shuffled once, each image's by stretches of t, and become frames in their task: no pixel is a row on the way,
    and what follows finds a stretch's frames in one task. ``places``: only images, or images and times, in this table.
    """
    small_batches(spark)
    own = ["image_id", "t", *(["c"] if channels else [])]
    placed = _items(spark, sf_dir, places).select(*own, "at", "quantity").repartition("image_id", F.floor(F.col("t") / STRETCH)).sortWithinPartitions(*own)
    return placed.mapInArrow(_dense, ", ".join(f"{c} int" for c in (*own, "height", "width")) + ", pixels array<double>")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, t, y, x, value: dense movies of frames of 32 by 32, summed quantities."""
    return to_pixels(movie(spark, sf_dir))


def channel_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, t, c, y, x, value: the same movies in two channels."""
    return to_pixels(movie(spark, sf_dir, channels=True))


def times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, t of each frame."""
    return _items(spark, sf_dir, None).select("image_id", "t").distinct()


def frames(spark: SparkSession, sf_dir: str, places: DataFrame | None = None) -> DataFrame:
    """The same movies as frames of single precision."""
    return movie(spark, sf_dir, places=places).select("image_id", "t", F.lit(0).alias("c"), F.lit(0).alias("z"), "height", "width", F.col("pixels").cast("array<float>").alias("pixels"))


def peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """channel, peak_id, x, y."""
    e = read(spark, sf_dir, "embeddings")
    place = lambda k: (F.col("embedding")[k].cast("double") + 0.5) * 512
    return e.select((F.col("label") % 3).cast("string").alias("channel"), F.col("vec_id").alias("peak_id"), place(0).alias("x"), place(1).alias("y"))
