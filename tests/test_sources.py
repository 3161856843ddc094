"""Movie files and live trajectories."""

from __future__ import annotations

import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from glimmer.operators import events, frames
from glimmer.sources.movies import Reader, check_paths, movie_frames, movie_images, save_tiff
from glimmer.sources.views import trajectories
from glimmer.streaming.pulses import live_pulses
from tests.conftest import SMALL


def test_array_files(spark, tmp_path):
    movie = np.arange(2 * 1 * 1 * 3 * 4, dtype=np.float32).reshape(2, 1, 1, 3, 4)
    np.save(tmp_path / "a.npy", movie)
    np.save(tmp_path / "b.npy", movie[0, 0, 0])
    df = movie_frames(spark, str(tmp_path))
    assert sorted((r["image_id"], r["t"]) for r in df.collect()) == [(0, 0), (0, 1), (1, 0)]
    px = {(r["t"], r["y"], r["x"]): r["value"] for r in frames.to_pixels(df.where("image_id = 0")).collect()}
    assert px[1, 2, 3] == 23 and len(px) == 24


def test_live_pulses_equal_runs(spark, tmp_path):
    rows = trajectories(spark, SMALL)
    for low, high in ((0, 30), (30, 1000)):
        rows.where(F.col("slice").between(low, high - 1)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = live_pulses(stream).writeStream.format("memory").queryName("pulses").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r["trajectory"], r["state"], r["dur"], r["start_frame"], r["end_frame"]) for r in spark.table("pulses").collect())
    want = sorted((r["trajectory"], r["state"], float(r["len"]), r["start"], r["end"]) for r in events.runs(rows).where("not is_last").collect())
    assert len(want) > 100 and got == want


def test_movies_come_in_ranges_of_frames(spark, tmp_path):
    rng = np.random.default_rng(2)
    shapes = {"a.npy": (5, 2, 1, 4, 6), "b.npy": (3, 4, 6), "c.npy": (4, 6)}
    movies = {}
    for name, shape in shapes.items():
        movies[name] = rng.integers(0, 1000, shape).astype(np.uint16)
        np.save(tmp_path / name, movies[name])
    got = movie_frames(spark, str(tmp_path), frames_a_task=3)
    assert got.rdd.getNumPartitions() == 4 + 1 + 1
    rows = {(r["image_id"], r["t"], r["c"]): np.reshape(r["pixels"], (r["height"], r["width"])) for r in got.collect()}
    assert len(rows) == 10 + 3 + 1
    assert all(np.array_equal(rows[0, t, c], movies["a.npy"][t, c, 0]) for t in range(5) for c in range(2))
    assert np.array_equal(rows[1, 2, 0], movies["b.npy"][2]) and np.array_equal(rows[2, 0, 0], movies["c.npy"])
    # written as TIFF and read back, a movie is the same
    save_tiff(got, f"{tmp_path}/out", frames_a_file=2)
    assert sum(f.endswith(".tif") for f in os.listdir(tmp_path / "out")) == 3 + 2 + 1 == len(os.listdir(tmp_path / "out"))
    again = movie_frames(spark, f"{tmp_path}/out", frames_a_task=2)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got.collect()))
    save_tiff(got.limit(0), f"{tmp_path}/none")


@pytest.mark.parametrize("order", ["<", ">"])
def test_classic_tiff(tmp_path, order):
    """A file laid out by hand: two pages of 16-bit numbers, the second in two strips."""
    pages = [np.arange(6, dtype=np.uint16).reshape(2, 3), np.arange(10, 16, dtype=np.uint16).reshape(2, 3)]
    raw = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    last = 4
    for k, page in enumerate(pages):
        data = len(raw)
        raw += page.astype(order + "u2").tobytes()
        extra = len(raw)
        raw += struct.pack(order + "4I", data, data + 6, 6, 6)
        tags = [(256, 3, 1, 3), (257, 3, 1, 2), (258, 3, 1, 16), (259, 3, 1, 1)]
        tags += [(273, 4, 1, data), (279, 4, 1, 12)] if k == 0 else [(273, 4, 2, extra), (279, 4, 2, extra + 8)]
        raw[last : last + 4] = struct.pack(order + "I", len(raw))
        raw += struct.pack(order + "H", len(tags))
        for tag, kind, n, v in tags:
            raw += struct.pack(order + "HHI", tag, kind, n) + (struct.pack(order + "HH", v, 0) if kind == 3 else struct.pack(order + "I", v))
        last = len(raw)
        raw += struct.pack(order + "I", 0)
    with open(tmp_path / "x.tif", "wb") as f:
        f.write(raw)
    reader = Reader([str(tmp_path / "x.tif")], 1)
    got = [b.column("pixels")[0].as_py() for part in reader.partitions() for b in reader.read(part)]
    assert got == [p.ravel().tolist() for p in pages]
    with open(tmp_path / "y.tif", "wb") as f:
        f.write(b"no picture")
    with pytest.raises(ValueError):
        Reader([str(tmp_path / "y.tif")], 1).partitions()


def written_tiff(path, pages, *, tile=None, rows=None, compression=1, differences=False, description=""):
    """A little TIFF writer: tiles or strips, packed, with a description on the first page."""
    raw, last = bytearray(b"II" + struct.pack("<HI", 42, 0)), 4
    for k, page in enumerate(pages):
        h, w = page.shape
        th, tw = (tile, tile) if tile else (rows or h, w)
        places, sizes = [], []
        for r in range(0, h, th):
            for c in range(0, w, tw):
                block = page[r : r + th, c : c + tw]
                if tile:
                    block = np.pad(block, ((0, th - block.shape[0]), (0, tw - block.shape[1])))
                if differences:
                    block = np.concatenate([block[:, :1], np.diff(block.astype(np.int64), axis=1).astype(block.dtype)], axis=1)
                data = block.tobytes()
                if compression == 8:
                    data = zlib.compress(data)
                if compression == 32773:  # runs of the same byte, then the bytes as they are
                    data = b"".join(bytes([257 - 3]) + data[i : i + 1] if data[i : i + 3] == data[i : i + 1] * 3 else bytes([len(data[i : i + 3]) - 1]) + data[i : i + 3] for i in range(0, len(data), 3)) + bytes([128])
                places.append(len(raw))
                sizes.append(len(data))
                raw += data
        lists = len(raw)
        raw += struct.pack(f"<{2 * len(places)}I", *places, *sizes)
        text = len(raw)
        raw += description.encode() + b"\0"
        n = len(places)
        code = {"u": 1, "i": 2, "f": 3}[page.dtype.kind]
        tags = [(256, 4, 1, w), (257, 4, 1, h), (258, 3, 1, page.dtype.itemsize * 8), (259, 3, 1, compression), (277, 3, 1, 1), (339, 3, 1, code)]
        tags += [(322, 4, 1, tw), (323, 4, 1, th)] if tile else [(278, 4, 1, th)]
        tags += [(324 if tile else 273, 4, n, lists if n > 1 else places[0]), (325 if tile else 279, 4, n, lists + 4 * n if n > 1 else sizes[0])]
        tags += [(317, 3, 1, 2)] if differences else []
        tags += [(270, 2, len(description) + 1, text)] if description and k == 0 else []
        raw[last : last + 4] = struct.pack("<I", len(raw))
        raw += struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in sorted(tags))
        last = len(raw)
        raw += struct.pack("<I", 0)
    with open(path, "wb") as f:
        f.write(raw)


@pytest.mark.parametrize("layout", [{}, {"rows": 4}, {"tile": 16}, {"tile": 16, "compression": 8}, {"rows": 5, "compression": 8, "differences": True}, {"tile": 16, "compression": 32773}, {"compression": 32773, "rows": 3}, {"tile": 16, "differences": True}])
@pytest.mark.parametrize("kind", ["u1", "u2", "f4"])
def test_tiles_and_compression(tmp_path, layout, kind):
    if layout.get("differences") and kind == "f4":
        pytest.skip("differences are of whole numbers")
    pages = [(np.random.default_rng(k).integers(0, 5, (21, 37)) * 40).astype(kind) for k in range(3)]
    written_tiff(tmp_path / "x.tif", pages, **layout)
    reader = Reader([str(tmp_path / "x.tif")], 2)
    parts = reader.partitions()
    assert [len(p.pages) for p in parts] == [2, 1]  # each carries its own pages
    got = [b.column("pixels")[0].as_py() for part in parts for b in reader.read(part)]
    assert got == [p.ravel().tolist() for p in pages]


OME = """<?xml version="1.0"?><OME xmlns="http://www.openmicroscopy.org/Schemas/OME/2016-06"><Image ID="Image:0" Name="left"><Pixels DimensionOrder="XYCTZ" SizeC="2" SizeT="3" SizeZ="1"/></Image><Image ID="Image:1" Name="right"><Pixels DimensionOrder="XYTCZ" SizeC="2" SizeT="2" SizeZ="1"/></Image></OME>"""


def test_scenes_become_images(spark, tmp_path):
    page = lambda k: np.full((3, 4), k, np.uint8)
    np.save(tmp_path / "a.npy", np.zeros((2, 3, 4)))
    written_tiff(tmp_path / "b.tif", [page(k) for k in range(10)], description=OME)
    written_tiff(tmp_path / "c.tif", [page(k) for k in range(6)], description="ImageJ=1.53\nimages=6\nchannels=2\nslices=1\nframes=3\n")
    written_tiff(tmp_path / "d.tif", [page(k) for k in range(3)], description=OME)  # tells of other pages
    images = movie_images(spark, str(tmp_path)).orderBy("image_id").collect()
    assert [(r["image_id"], r["filename"], r["scene"], r["dim_order"]) for r in images] == [(0, "a.npy", "0", "XYZCT"), (1, "b.tif", "left", "XYCTZ"), (2, "b.tif", "right", "XYTCZ"), (3, "c.tif", "0", "XYCZT"), (4, "d.tif", "0", "XYT")]
    assert "left" in images[1]["meta"] and images[3]["folder"] == str(tmp_path)
    got = {(r["image_id"], r["t"], r["c"]): int(r["pixels"][0]) for r in movie_frames(spark, str(tmp_path), frames_a_task=4).where("image_id > 0").collect()}
    assert [got[1, t, c] for t in range(3) for c in range(2)] == [0, 1, 2, 3, 4, 5]
    assert [got[2, t, c] for c in range(2) for t in range(2)] == [6, 7, 8, 9]
    assert [got[3, t, c] for t in range(3) for c in range(2)] == [0, 1, 2, 3, 4, 5] and [got[4, t, 0] for t in range(3)] == [0, 1, 2]
    assert movie_images(spark, []).count() == 0


def test_paths_are_checked(tmp_path):
    (tmp_path / "a.npy").write_bytes(b"")
    missing = str(tmp_path / "none" / "x.tif")
    assert check_paths([str(tmp_path), str(tmp_path / "a.npy"), missing]) == [missing]
    assert check_paths(str(tmp_path / "new.tif"), write=True) == [] and check_paths(missing, write=True) == [missing]
