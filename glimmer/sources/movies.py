"""Movies in ``.npy`` and ``.tif`` files, read and written a range of frames at a time.

A Python data source plans a partition for each file and range of frames, which carries where these frames' bytes are: a
task reads no more than them and no directory again, and no file has to fit in memory. TIFF files have one sample a pixel,
in any byte order, classic or BigTIFF, in strips or tiles, plain or compressed (deflate, PackBits). Their description can
tell which image, time, channel and slice a page is: that of files written here, a hyperstack's, or an OME-XML header's,
whose images (scenes) each become an image. Files are opened by Arrow's file systems, many at once.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from glimmer.schemas import FRAMES, IMAGES

#: Frames that a task reads, and that a file written here holds.
FRAMES_A_TASK, FRAMES_A_FILE = 64, 256
#: Files whose headers are read at once.
AT_ONCE = 32
#: Compressions of TIFF: none, deflate (two numbers for the same), PackBits.
PLAIN, DEFLATE, PACKBITS = 1, (8, 32946), 32773
_WIDTHS = {1: "B", 2: "c", 3: "H", 4: "I", 16: "Q"}


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


def _files(paths: list[str]) -> list[str]:
    """The movie files of paths, in order; of a folder those in it."""
    out = []
    for path in paths:
        system, own = _open(path)
        info = system.get_file_info(own)
        found = system.get_file_info(fs.FileSelector(own)) if info.type == fs.FileType.Directory else [info]
        begin = path[: len(path) - len(own)] if path.endswith(own) else ""
        out += [begin + f.path for f in found if f.type == fs.FileType.File and f.path.lower().endswith((".npy", ".tif", ".tiff"))]
    return sorted(out)


def npy_header(file) -> tuple[tuple[int, ...], np.dtype, int]:
    """Shape, type and where the numbers begin."""
    version = np.lib.format.read_magic(file)
    shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(file)
    if fortran or dtype.hasobject:
        raise ValueError("only arrays of numbers in C order can be read")
    return shape, dtype, file.tell()


def five(shape: tuple[int, ...]) -> tuple[int, ...]:
    """(Y, X), (T, Y, X), (T, C, Y, X) or (T, C, Z, Y, X) as the last."""
    if not 2 <= len(shape) <= 5:
        raise ValueError(f"an array of {len(shape)} dimensions is no movie")
    lead = shape[:-2]
    return (*lead, *(1,) * (3 - len(lead)), *shape[-2:])


@dataclass(frozen=True)
class Page:
    """A page of a TIFF file: its size, type, parts (offset, bytes), their size, compression, whether rows are differences, and description."""

    height: int
    width: int
    dtype: str
    parts: tuple[tuple[int, int], ...]
    part_height: int
    part_width: int
    compression: int
    differences: bool
    description: str

    def read(self, file) -> np.ndarray:
        """The page's pixels. Parts lie in rows over the page; those at its right and lower border may reach beyond it (tiles) or end with it (strips)."""
        out = np.zeros((self.height, self.width), np.dtype(self.dtype).newbyteorder("="))
        across = -(-self.width // self.part_width)
        for k, (offset, size) in enumerate(self.parts):
            row, column = k // across * self.part_height, k % across * self.part_width
            high = self.part_height if self.part_width != self.width else min(self.part_height, self.height - row)
            file.seek(offset)
            data = np.frombuffer(unpacked(file.read(size), self.compression), self.dtype)
            block = data[: high * self.part_width].reshape(-1, self.part_width)
            if self.differences:
                block = np.cumsum(block, axis=1, dtype=out.dtype)
            end = out[row : row + high, column : column + self.part_width]
            end[:] = block[: end.shape[0], : end.shape[1]]
        return out


def unpacked(raw: bytes, compression: int) -> bytes:
    """The bytes of a part of a page."""
    if compression == PLAIN:
        return raw
    if compression in DEFLATE:
        return zlib.decompress(raw)
    out, at = bytearray(), 0
    while at < len(raw):  # a length below 128 and one byte more than that, or the times a byte is repeated
        n = raw[at]
        if n < 128:
            out += raw[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            out += raw[at + 1 : at + 2] * (257 - n if n > 128 else 0)
            at += 2 if n > 128 else 1
    return bytes(out)


def tiff_pages(file) -> list[Page]:
    """All pages of a TIFF file, from its directories alone."""
    mark = file.read(4)
    order = {b"II": "<", b"MM": ">"}.get(mark[:2])
    kind = struct.unpack(f"{order}H", mark[2:])[0] if order else 0
    if kind not in (42, 43):
        raise ValueError("not a TIFF file")
    big = kind == 43
    if big:
        file.read(4)
    word, count, entry = ("Q", "Q", 20) if big else ("I", "H", 12)
    unpack = lambda f, raw: struct.unpack(order + f, raw)
    at, pages = unpack(word, file.read(8 if big else 4))[0], []
    while at:
        file.seek(at)
        n = unpack(count, file.read(8 if big else 2))[0]
        raw = file.read(n * entry)
        at = unpack(word, file.read(8 if big else 4))[0]
        tags = {}
        for k in range(n):
            e = raw[k * entry : (k + 1) * entry]
            tag, kind_, many = unpack("HH" + word, e[: 12 if big else 8])
            if kind_ not in _WIDTHS:
                continue
            size = struct.calcsize("=" + _WIDTHS[kind_]) * many
            inline = e[12:] if big else e[8:]
            if size > len(inline):
                file.seek(unpack(word, inline)[0])
                inline = file.read(size)
            tags[tag] = inline[:size] if kind_ == 2 else unpack(f"{many}{_WIDTHS[kind_]}", inline[:size])
        one = lambda tag, usual: tags.get(tag, (usual,))[0]
        if one(259, 1) not in (PLAIN, *DEFLATE, PACKBITS) or one(277, 1) != 1 or not {273, 324} & set(tags) or one(317, 1) not in (1, 2):
            raise ValueError("only TIFF pages of one sample a pixel can be read, plain or compressed by deflate or PackBits")
        code = {1: "u", 2: "i", 3: "f"}[one(339, 1)]
        height, width, bits = one(257, 0), one(256, 0), one(258, 1)
        if 324 in tags:
            parts, part_height, part_width = tuple(zip(tags[324], tags[325], strict=True)), one(323, 0), one(322, 0)
        else:
            parts, part_height, part_width = tuple(zip(tags[273], tags.get(279, (height * width * bits // 8,)), strict=True)), min(height, one(278, height)), width
            if 278 not in tags and len(parts) > 1:
                part_height = -(-height // len(parts))
        text = bytes(tags.get(270, b"")).rstrip(b"\0").decode("utf-8", "replace")
        pages.append(Page(height, width, f"{order}{code}{bits // 8}", parts, part_height, part_width, one(259, 1), one(317, 1) == 2, text))
    return pages


def tiff_bytes(frames: list[np.ndarray], description: str) -> bytes:
    """A BigTIFF file of 32-bit float pages, the description with the first."""
    out, last = bytearray(b"II" + struct.pack("<HHHQ", 43, 8, 0, 0)), 8
    for k, frame in enumerate(frames):
        data = np.ascontiguousarray(frame, "<f4").tobytes()
        strip = len(out)
        out += data
        text = description.encode() + b"\0" if k == 0 else b""
        words = len(out)
        out += text + b"\0" * (-len(out + text) % 8)
        entries = [(256, 4, 1, frame.shape[1]), (257, 4, 1, frame.shape[0]), (258, 3, 1, 32), (259, 3, 1, 1), (262, 3, 1, 1), (273, 16, 1, strip), (277, 3, 1, 1), (278, 4, 1, frame.shape[0]), (279, 16, 1, len(data)), (339, 3, 1, 3)]
        if text:
            entries.append((270, 2, len(text), words if len(text) > 8 else int.from_bytes(text.ljust(8, b"\0"), "little")))
        here = len(out)
        out += struct.pack("<Q", len(entries)) + b"".join(struct.pack("<HHQQ", *e) for e in sorted(entries))
        out[last : last + 8] = struct.pack("<Q", here)
        last = len(out)
        out += struct.pack("<Q", 0)
    return bytes(out)


@dataclass
class Range(InputPartition):
    """Some frames of a file: the places (image, t, c, z) of each, and its page, or the first one's number in an array."""

    path: str
    start: int
    places: list[tuple[int, int, int, int]]
    pages: list[Page] | None


@dataclass(frozen=True)
class Scene:
    """An image of a file: its name, order of dimensions and sizes of t, c and z, and what its file tells of it."""

    name: str
    order: str
    sizes: tuple[int, int, int]
    meta: str

    def places(self) -> list[tuple[int, int, int]]:
        """t, c, z of its pages, the first letter of the order running fastest."""
        size = dict(zip("TCZ", self.sizes, strict=True))
        letters = [x for x in self.order if x in size][::-1]
        every = itertools.product(*(range(size[x]) for x in letters))
        return [tuple(dict(zip(letters, p, strict=True)).get(x, 0) for x in "TCZ") for p in every]


def scenes(pages: list[Page]) -> list[Scene]:
    """The images of a TIFF file, by its first page's description: a hyperstack's or an OME-XML header's, else one of all pages in time.

    A header that speaks of another number of pages than there are isn't followed.
    """
    text = pages[0].description if pages else ""
    found = []
    if text.startswith("ImageJ"):
        told = {k: int(v) for k, v in re.findall(r"^(channels|slices|frames)=(\d+)\s*$", text, re.MULTILINE)}
        found = [Scene("0", "XYCZT", tuple(told.get(k, 1) for k in ("frames", "channels", "slices")), text)]
    elif "<OME" in text:
        try:
            for k, image in enumerate(e for e in ElementTree.fromstring(text).iter() if e.tag.endswith("}Image") or e.tag == "Image"):
                p = next(e for e in image if e.tag.endswith("Pixels"))
                found.append(Scene(image.get("Name") or image.get("ID") or str(k), p.get("DimensionOrder", "XYCZT"), tuple(int(p.get(f"Size{x}", 1)) for x in "TCZ"), ElementTree.tostring(image, encoding="unicode")))
        except (ElementTree.ParseError, StopIteration, ValueError):
            found = []
    if found and sum(int(np.prod(s.sizes)) for s in found) == len(pages):
        return found
    return [Scene("0", "XYT", (len(pages), 1, 1), text)]


@dataclass(frozen=True)
class Header:
    """What is known of a file before its pixels are read: its scenes, and the pages or none for an array; frames that it was written with."""

    path: str
    scenes: list[Scene]
    pages: list[Page] | None
    own: list[list[int]] | None


def header(path: str) -> Header:
    system, own = _open(path)
    with system.open_input_file(own) as file:
        if path.lower().endswith(".npy"):
            shape, dtype, _ = npy_header(file)
            t, c, z, *_ = five(shape)
            return Header(path, [Scene("0", "XYZCT", (t, c, z), json.dumps({"shape": shape, "dtype": str(dtype)}))], None, None)
        pages = tiff_pages(file)
        return Header(path, scenes(pages), pages, _places(pages))


def headers(files: list[str]) -> list[Header]:
    with ThreadPoolExecutor(AT_ONCE) as pool:
        return list(pool.map(header, files))


class Reader(DataSourceReader):
    def __init__(self, files: list[str], step: int) -> None:
        self.files, self.step = files, step

    def partitions(self) -> list[Range]:
        """Ranges of frames of each file; only headers are read here, and of TIFF files their directories."""
        out, image = [], 0
        for h in headers(self.files):
            places = [tuple(p) for p in h.own] if h.own else [(image + k, *p) for k, s in enumerate(h.scenes) for p in s.places()]
            image += len(h.scenes)
            out += [Range(h.path, k, places[k : k + self.step], h.pages[k : k + self.step] if h.pages else None) for k in range(0, len(places), self.step)]
        return out

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        system, own = _open(part.path)
        with system.open_input_file(own) as file:
            if part.pages is None:
                shape, dtype, begin = npy_header(file)
                height, width = shape[-2:]
                file.seek(begin + part.start * height * width * dtype.itemsize)
                for place in part.places:
                    yield _row(*place, height, width, np.frombuffer(file.read(height * width * dtype.itemsize), dtype))
            else:
                for place, page in zip(part.places, part.pages, strict=True):
                    yield _row(*place, page.height, page.width, page.read(file).ravel())


def _places(pages: list[Page]) -> list[list[int]] | None:
    """image_id, t, c, z of each page, where the first one tells."""
    try:
        told = json.loads(pages[0].description)["frames"]
    except (ValueError, KeyError, TypeError, IndexError):
        return None
    return told if len(told) == len(pages) else None


def _row(image: int, t: int, c: int, z: int, height: int, width: int, pixels: np.ndarray) -> pa.RecordBatch:
    numbers = [pa.array([v], pa.int32()) for v in (image, t, c, z, height, width)]
    return pa.RecordBatch.from_arrays([*numbers, pa.array([pixels.astype(np.float32)], pa.list_(pa.float32()))], names=["image_id", "t", "c", "z", "height", "width", "pixels"])


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class Writer(DataSourceWriter):
    """Sorted rows in; files under names of their own, so a task that runs again leaves none of the first run's behind: those aren't committed and are deleted."""

    def __init__(self, folder: str, job: str) -> None:
        self.folder, self.job = folder, job

    def write(self, rows: Iterator) -> Written:
        system, own = _open(self.folder)
        system.create_dir(own, recursive=True)
        files, held, last = [], [], None

        def flush() -> None:
            if held:
                name = f"{own}/image-{last[0]:06d}-{last[1]:06d}-{uuid.uuid4().hex[:12]}.{self.job}.part"
                told = json.dumps({"frames": [[r.image_id, r.t, r.c, r.z] for r in held]})
                with system.open_output_stream(name) as file:
                    file.write(tiff_bytes([np.asarray(r.pixels, np.float32).reshape(r.height, r.width) for r in held], told))
                files.append(name)
                held.clear()

        for r in rows:
            if (r.image_id, r.block) != last:
                flush()
                last = (r.image_id, r.block)
            held.append(r)
        flush()
        return Written(files)

    def commit(self, messages: list[Written]) -> None:
        """Names the files of the tasks that count, and deletes those of others."""
        system, own = _open(self.folder)
        for name in (f for m in messages if m for f in m.files):
            system.move(name, name.split(f".{self.job}.part")[0] + ".tif")
        self._clear(system, own)

    def abort(self, messages: list[Written]) -> None:
        self._clear(*_open(self.folder))

    def _clear(self, system: fs.FileSystem, own: str) -> None:
        for f in system.get_file_info(fs.FileSelector(own, allow_not_found=True)):
            if f.path.endswith(f".{self.job}.part"):
                system.delete_file(f.path)


class Movies(DataSource):
    """Options ``files`` (a JSON list) and ``step`` to read; ``path`` to write."""

    @classmethod
    def name(cls) -> str:
        return "glimmer_movies"

    def schema(self) -> str:
        return FRAMES

    def reader(self, schema) -> Reader:
        return Reader(json.loads(self.options["files"]), int(self.options["step"]))

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"], uuid.uuid4().hex[:12])


def movie_frames(spark: SparkSession, paths: str | list[str], frames_a_task: int = FRAMES_A_TASK) -> DataFrame:
    """Frames of ``.npy`` and TIFF files, or of all in a folder; image_id numbers the images of the files by path, unless a file tells its frames.

    Arrays are (Y, X), (T, Y, X), (T, C, Y, X) or (T, C, Z, Y, X); the pages of a TIFF file that doesn't tell are taken for
    t. A file that can't be read raises as the frames are planned, before any is read.
    """
    spark.dataSource.register(Movies)
    files = _files([paths] if isinstance(paths, str) else list(paths))
    return spark.read.format("glimmer_movies").option("files", json.dumps(files)).option("step", str(frames_a_task)).load()


def movie_images(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """image_id, filename, folder, scene, dim_order, meta: a row for each image that ``movie_frames`` makes of the files.

    Files' headers are read in tasks, a file a row; the numbers go on from file to file by a sum over their counts. Images of
    a file that tells its frames have the numbers it tells.
    """
    files = _files([paths] if isinstance(paths, str) else list(paths))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, path in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                h = header(path)
                folder, _, name = path.rpartition("/")
                own = sorted({p[0] for p in h.own}) if h.own else [None] * len(h.scenes)
                each = [(k, i, len(h.scenes), number, name, folder, *((str(number), "XYZCT", h.pages[0].description) if h.own else (h.scenes[i].name, h.scenes[i].order, h.scenes[i].meta))) for i, number in enumerate(own)]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), *(pa.string(),) * 5)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*each, strict=True), kinds, strict=True)], names=["file", "nth", "scenes", "told", "filename", "folder", "scene", "dim_order", "meta"])

    listed = spark.createDataFrame(list(enumerate(files)), "file long, path string").repartition(max(1, min(len(files), 1000)), "file")
    found = listed.mapInArrow(run, "file long, nth long, scenes long, told long, filename string, folder string, scene string, dim_order string, meta string")
    # a row a file, whose names the driver has listed
    before = found.groupBy("file").agg(F.max("scenes").alias("scenes")).select("file", F.coalesce(F.sum("scenes").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    columns = [c.split()[0] for c in IMAGES.split(", ")]
    return found.join(before, "file").withColumn("image_id", F.coalesce("told", F.col("before") + F.col("nth")).cast("int")).select(*columns)


def check_paths(paths: str | list[str], write: bool = False) -> list[str]:
    """Those of the paths that can't be read, or with ``write`` be written to: files and folders that are missing or that this machine may not use.

    Places in a store are only asked whether they are there: what a store allows shows when it is used.
    """
    out = []
    for path in [paths] if isinstance(paths, str) else paths:
        system, own = _open(path)
        missing = system.get_file_info(own).type == fs.FileType.NotFound
        local = isinstance(system, fs.LocalFileSystem)
        if write and missing and local:  # then the folder it would lie in counts
            own = os.path.dirname(own)
            missing = not os.path.isdir(own)
        need = os.R_OK | (os.W_OK if write else 0) | (os.X_OK if os.path.isdir(own) else 0) if local else 0
        if missing and not (write and not local) or local and not missing and not os.access(own, need):
            out.append(path)
    return out


def save_tiff(frames: DataFrame, folder: str, frames_a_file: int = FRAMES_A_FILE) -> None:
    """Frames as BigTIFF files of 32-bit floats in a shared folder, each of ``frames_a_file`` steps of t of an image at most.

    The blocks of an image go to different tasks, so a long movie is written by many.
    """
    frames.sparkSession.dataSource.register(Movies)
    block = F.floor(F.col("t") / frames_a_file).cast("int")
    placed = frames.withColumn("block", block).repartition("image_id", "block").sortWithinPartitions("image_id", "block", "t", "c", "z")
    placed.write.format("glimmer_movies").mode("append").save(folder)
