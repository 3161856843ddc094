"""Frames and pixels: projections, flat field, drift correction, region integration, peak finding and spot fitting."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glimmer.functions import kernels
from glimmer.operators.ordered import numbered
from glimmer.operators.spatial import IMAGE, isolated, roi_filter, shared
from glimmer.schemas import FRAMES
from glimmer.sources.shared import written

PROJECTIONS = {"mean": F.avg, "std": F.stddev_pop, "var": F.var_pop, "max": F.max, "min": F.min, "sum": F.sum, "prod": F.product, "argmax": lambda c: F.max_by("t", F.struct(F.col(c), -F.col("t")))}


def to_pixels(frames: DataFrame) -> DataFrame:
    """One row for each pixel of frames, with those of FRAME's columns, and others, that the frames have."""
    own = [c for c in frames.columns if c not in ("height", "width", "pixels")]
    return frames.select(*own, "width", F.posexplode("pixels").alias("at", "value")).select(*own, F.floor(F.col("at") / F.col("width")).cast("int").alias("y"), (F.col("at") % F.col("width")).cast("int").alias("x"), "value")


def to_frames(pixels: DataFrame, height: int, width: int) -> DataFrame:
    """Frames of pixels, the inverse of ``to_pixels``: t, c and z are 0 where the pixels have none, and so are places without a pixel (a place must not come twice)."""
    own = [c for c in FRAME if c in pixels.columns]
    entry = F.struct((F.col("y") * width + F.col("x")).cast("int").alias("at"), F.col("value").cast("float").alias("value"))
    held = pixels.groupBy(*own).agg(F.sort_array(F.collect_list(entry)).alias("held"))
    places, none = F.sequence(F.lit(0), F.lit(height * width - 1)), F.lit(0.0).cast("float")
    whole = F.transform("held", lambda e: F.coalesce(e["value"], none))
    every = F.when(F.transform("held", lambda e: e["at"]) == places, whole).otherwise(F.transform(places, lambda k: F.coalesce(F.try_element_at(F.map_from_entries("held"), k), none)))
    return held.select(*[(F.col(c) if c in own else F.lit(0)).cast("int").alias(c) for c in FRAME], F.lit(height).alias("height"), F.lit(width).alias("width"), every.alias("pixels"))


def choose(frames: DataFrame, **at: int | list[int]) -> DataFrame:
    """The frames (or pixels) at some places of t, c or z, each a number or several."""
    for dimension, places in at.items():
        frames = frames.where(F.col(dimension).isin(places if isinstance(places, list) else [places]))
    return frames


def project(pixels: DataFrame, method: str = "mean", over: str = "t", value: str = "value") -> DataFrame:
    """A statistic of each pixel over one dimension; std and var are those of a population.

    ``pixels`` may be frames. Then argmax compares neighbouring frames of an image in their task (frames in order of t are
    best), and only what these leave is sorted as pixels.
    """
    if method not in PROJECTIONS:
        raise ValueError(f"no projection {method!r}: {', '.join(PROJECTIONS)}")
    if "pixels" in pixels.columns:
        if method == "argmax" and over == "t":
            return _tops(pixels, value)
        pixels = to_pixels(pixels).withColumnRenamed("value", value)
    return pixels.groupBy(*[c for c in pixels.columns if c not in (over, value)]).agg(PROJECTIONS[method](value).alias(value))


#: What tells frames apart.
FRAME = ("image_id", "t", "c", "z")


def _tops(frames: DataFrame, value: str) -> DataFrame:
    """argmax of each pixel over t: each run of an image's frames in a task leaves its highest numbers with their first times. Null is below all numbers, NaN above."""
    own = [c for c in FRAME if c in frames.columns and c != "t"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rank, top, first = None, None, None, None

        def out() -> pa.RecordBatch:
            lists = [pa.array([v], pa.list_(k)) for v, k in ((rank.ravel(), pa.int8()), (top.ravel(), pa.float64()), (first.ravel(), pa.int32()))]
            return pa.RecordBatch.from_arrays([*held.columns, *lists], names=[*held.schema.names, "rank", "top", "first"])

        for batch in batches:
            keys = batch.select([*own, "height", "width"])
            new = np.ones(len(batch), bool)
            new[1:] = False
            for c in keys.columns:
                for v in (c.is_null().to_numpy(zero_copy_only=False), c.fill_null(0).to_numpy()):
                    new[1:] |= v[1:] != v[:-1]
            pixels, times = batch.column(batch.schema.get_field_index("pixels")), batch.column(batch.schema.get_field_index("t")).to_numpy()
            for k in range(len(batch)):
                if new[k] and held is not None and (k or not keys.slice(0, 1).equals(held)):
                    yield out()
                    held = None
                v = pixels[k].values
                number = v.to_numpy(zero_copy_only=False).astype(float)
                nan = np.isnan(number)
                own_rank = (1 + nan - v.is_null().to_numpy(zero_copy_only=False) * 2 * nan).astype(np.int8)
                number = np.where(nan, 0.0, number)
                if held is None:
                    held, rank, top, first = keys.slice(k, 1), own_rank, number, np.full(len(number), times[k], np.int32)
                    continue
                better = (own_rank > rank) | (own_rank == rank) & ((number > top) | (number == top) & (times[k] < first))
                rank, top, first = np.where(better, own_rank, rank), np.where(better, number, top), np.where(better, times[k], first)
        if held is not None:
            yield out()

    kinds = dict(frames.dtypes)
    runs = frames.select(*own, "t", "height", "width", "pixels").mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in own) + ", height int, width int, rank array<tinyint>, top array<double>, first array<int>")
    each = runs.select(*own, "width", F.posexplode(F.arrays_zip("rank", "top", "first")).alias("at", "p"))
    placed = each.select(*own, F.floor(F.col("at") / F.col("width")).cast("int").alias("y"), (F.col("at") % F.col("width")).cast("int").alias("x"), "p")
    return placed.groupBy(*own, "y", "x").agg(F.max_by("p.first", F.struct("p.rank", "p.top", -F.col("p.first"))).alias(value))


def integer_shift(pixels: DataFrame, shifts: DataFrame, height: int, width: int, dense: bool = False) -> DataFrame:
    """Every frame moved by its (dr, dc), with 0 where nothing comes from; frames without a shift stay.

    Shifts belong to frames by those of FRAME's columns that both tables have. ``dense``: the frames have all their pixels;
    then each pixel goes to its target, and one from whose place none comes leaves a 0 there: no pixel is shuffled for it.
    ``pixels`` may be frames, which are dense: they meet their shifts, and are moved, before they become pixels.
    """
    own, whole = shared(FRAME, None, pixels, shifts), "pixels" in pixels.columns
    shifted = pixels.join(shifts.select(*own, "dr", "dc"), own, "left").withColumn("dr", F.coalesce("dr", F.lit(0))).withColumn("dc", F.coalesce("dc", F.lit(0)))
    rest = [c for c in pixels.columns if c not in ("y", "x", "value", "height", "width", "pixels")]
    if whole:
        return to_pixels(_moved(shifted, rest)).select(*rest, "y", "x", F.col("value").cast("double").alias("value"))
    if dense:
        y, x = F.col("y") - F.col("dr"), F.col("x") - F.col("dc")
        goes = F.when(y.between(0, height - 1) & x.between(0, width - 1), F.struct(y.alias("y"), x.alias("x"), F.col("value").cast("double").alias("value")))
        comes = (F.col("y") + F.col("dr")).between(0, height - 1) & (F.col("x") + F.col("dc")).between(0, width - 1)
        left = F.when(~comes, F.struct(F.col("y"), F.col("x"), F.lit(0.0).alias("value")))
        return shifted.select(*rest, F.explode(F.filter(F.array(goes, left), lambda p: p.isNotNull())).alias("p")).select(*rest, "p.y", "p.x", "p.value")
    moved = shifted.withColumn("y", F.col("y") - F.col("dr")).withColumn("x", F.col("x") - F.col("dc")).drop("dr", "dc")
    inside = moved.where(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1))
    grid = pixels.select(*rest).distinct().withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(height - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    return grid.join(inside, [*rest, "y", "x"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def _moved(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Frames moved by their dr, dc; null pixels stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, tuple[pa.Array, pa.Array]] = {}
        for batch in batches:
            of = zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("height", "width", "dr", "dc")), strict=True)
            pixels, out = batch.column(batch.schema.get_field_index("pixels")), []
            for k, at in enumerate(of):
                if at not in known:
                    if len(known) > 1000:
                        known.clear()
                    source = kernels.shifted(1 + np.arange(at[0] * at[1]).reshape(at[:2]), *at[2:]).ravel()
                    known[at] = pa.array(np.maximum(source - 1, 0)), pa.array(source == 0)
                source, empty = known[at]
                out.append(pc.if_else(empty, pa.scalar(0, pixels.type.value_type), pixels[k].values.take(source)))
            offsets = pa.array(np.cumsum([0, *map(len, out)]).astype(np.int32))
            moved = pa.ListArray.from_arrays(offsets, pa.concat_arrays(out) if out else pa.array([], pixels.type.value_type))
            rest = batch.select([*keys, "height", "width"])
            yield pa.RecordBatch.from_arrays([*rest.columns, moved], names=[*rest.schema.names, "pixels"])

    kinds = dict(frames.dtypes)
    return frames.select(*keys, "height", "width", "dr", "dc", "pixels").mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in [*keys, "height", "width", "pixels"]))


def spot_table(pixels: DataFrame, peaks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The spots to integrate: image_id, c, z (those the pixels have), trajectory, peak_id, x, y and what else the peaks have.

    ``trajectory`` numbers all spots of the table (0, 1, ...), in the order of image, channel and peak, so it is unique over
    images, channels and frames and the same on every run, while peak numbers start anew in each frame. ``by`` tells what
    peaks and pixels share, by default the image: each peak is then a spot in all channels and slices of its image, and where
    the peaks have a t, c or z of their own, in which they were found, it stays as peak_t, peak_c, peak_z. Peaks of images
    without pixels are left out. Peaks that agree in all these numbers are told apart by their place; equal rows are one spot.
    """
    by = shared(IMAGE, by, pixels, peaks)
    rest = [c for c in FRAME if c in pixels.columns and c != "t" and c not in by]
    own = peaks.withColumnsRenamed({c: f"peak_{c}" for c in FRAME if c in peaks.columns and c not in by}).distinct()
    found = [c for c in ("peak_t", "peak_c", "peak_z", "channel") if c in own.columns]
    places = pixels.select(*by, *rest).distinct()
    if by:
        spots = own.join(places, by)
    else:
        spots = own.join(F.broadcast(places)) if rest else own  # the channels and slices of one image
    return numbered(spots, [*by, *rest, *found, "peak_id", "x", "y"], "trajectory")


def channel_spots(matches: DataFrame, channels: dict[str, int], by: list[str] | None = None) -> DataFrame:
    """image_id, c, peak_id, x, y from colocalised peaks (``spatial.coloc_n_channels``): each match in every channel, where its peak stood there before drift was undone.

    ``channels``: the number c of each name, the first one's peak numbers being those of the match.
    """
    by = shared(IMAGE, by, matches)
    first = f"{next(iter(channels))}_id"
    each = F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"{n}_x").alias("x"), F.col(f"{n}_y").alias("y")) for n, c in channels.items()])
    return matches.select(*by, F.col(first).alias("peak_id"), F.inline(each)).select(*by, "c", "peak_id", "x", "y")


def roi_integrate(pixels: DataFrame, spots: DataFrame, inner: int, outer: int, dx: int | str = 0, dy: int | str = 0, by: list[str] | None = None, legacy_axes: bool = False) -> DataFrame:
    """The frame but for t, trajectory, slice (t), Intensity, bg, x, y: the inner square's sum less the background of the frame around it.

    Spots (``spot_table``; x is the row) become their offsets, at most (2 (inner + outer) + 1)**2 each, and meet the pixels
    by image, channel and place. Peaks without a ``trajectory`` are made spots first, by ``by``. ``dx`` and ``dy``, numbers
    or columns of the spots (the drift of each image), move the squares, not the reported place; ``legacy_axes`` takes x
    for the column instead. Squares over the border keep their nominal area.

    ``pixels`` may be frames: a frame then meets up to SPOTS_A_ROW spots as one row, and no pixel is a row. Null pixels of
    frames count as 0.
    """
    if "trajectory" not in spots.columns:
        spots = spot_table(pixels, spots, by)
    by = shared(("image_id", "c", "z"), None, pixels, spots)
    reach = inner + outer
    if "pixels" in pixels.columns:
        return _integrated(pixels, spots, inner, reach, dx, dy, by, legacy_axes)
    inner_area = (2 * inner + 1) ** 2
    outer_area = (2 * reach + 1) ** 2 - inner_area
    drift = [F.col(d) if isinstance(d, str) else F.lit(d) for d in (dx, dy)]
    centre = spots.select(*by, "trajectory", F.col("x").cast("long").alias("px"), F.col("y").cast("long").alias("py"), drift[0].cast("long").alias("_dx"), drift[1].cast("long").alias("_dy"))
    offsets = F.sequence(F.lit(-reach), F.lit(reach))
    spread = centre.withColumn("ox", F.explode(offsets)).withColumn("oy", F.explode(offsets))
    of_x, of_y = F.col("px") + F.col("_dx") + F.col("ox"), F.col("py") + F.col("_dy") + F.col("oy")
    row, column = (of_x, of_y) if not legacy_axes else (of_y, of_x)
    spread = spread.select(*by, "trajectory", "px", "py", row.alias("y"), column.alias("x"), ((F.abs("ox") <= inner) & (F.abs("oy") <= inner)).alias("inside"))
    rest = [c for c in FRAME if c in pixels.columns and c != "t" and c not in by]
    sums = pixels.join(spread, [*by, "y", "x"]).groupBy(*by, *rest, "trajectory", "px", "py", F.col("t").alias("slice")).agg(F.sum(F.when(F.col("inside"), F.col("value")).otherwise(0.0)).alias("own"), F.sum("value").alias("all"))
    bg = (F.col("all") - F.col("own")) / outer_area
    return sums.select(*by, *rest, "trajectory", (F.col("own") - bg * inner_area).alias("Intensity"), bg.alias("bg"), F.col("px").alias("x"), F.col("py").alias("y"), "slice")


#: Spots, by ranges of their numbers, that meet a frame as one row, and rows that integration hands on at once.
SPOTS_A_ROW, ROWS_AT_ONCE = 1024, 100_000


def _integrated(frames: DataFrame, spots: DataFrame, inner: int, reach: int, dx: int | str, dy: int | str, by: list[str], legacy_axes: bool) -> DataFrame:
    """``roi_integrate`` of frames."""
    drift = [F.col(d) if isinstance(d, str) else F.lit(d) for d in (dx, dy)]
    px, py = F.col("x").cast("long"), F.col("y").cast("long")
    places = [px + drift[0].cast("long"), py + drift[1].cast("long")]
    row, column = places if not legacy_axes else places[::-1]
    told = spots.where(row.isNotNull() & column.isNotNull()).select(*by, F.floor(F.col("trajectory") / SPOTS_A_ROW).alias("_row"), F.struct("trajectory", px.alias("px"), py.alias("py"), row.alias("row"), column.alias("column")).alias("p"))
    told = told.groupBy(*by, "_row").agg(F.collect_list("p").alias("spots")).drop("_row")
    own = [c for c in FRAME if c in frames.columns and c != "t"]
    areas = [(2 * inner + 1) ** 2, (2 * reach + 1) ** 2 - (2 * inner + 1) ** 2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = []

            def out(batch: pa.RecordBatch = batch, held: list = held) -> pa.RecordBatch:
                frame = pa.array(np.concatenate([np.full(len(h[1]), h[0]) for h in held]))
                inside, every = (np.concatenate([h[k] for h in held]) for k in (2, 3))
                bg = (every - inside) / areas[1]
                of = [batch.column(batch.schema.get_field_index(c)).take(frame) for c in (*own, "t")]
                ids, x, y = (pa.concat_arrays([h[1].field(c) for h in held]) for c in ("trajectory", "px", "py"))
                held.clear()
                return pa.RecordBatch.from_arrays([*of[:-1], ids, pa.array(inside - bg * areas[0]), pa.array(bg), x, y, of[-1]], names=[*own, "trajectory", "Intensity", "bg", "x", "y", "slice"])

            heights, widths = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("height", "width"))
            pixels, asked = (batch.column(batch.schema.get_field_index(c)) for c in ("pixels", "spots"))
            rows = 0
            for k, (high, wide) in enumerate(zip(heights, widths, strict=True)):
                there = asked[k].values
                r, c = (there.field(n).to_numpy() for n in ("row", "column"))
                touch = (r >= -reach) & (r < high + reach) & (c >= -reach) & (c < wide + reach)
                if not touch.all():
                    there, r, c = there.filter(pa.array(touch)), r[touch], c[touch]
                image = pixels[k].values.fill_null(0).to_numpy(zero_copy_only=False).astype(float).reshape(high, wide)
                held.append((k, there, *kernels.box_sums(image, r, c, inner, reach)))
                rows += len(there)
                if rows > ROWS_AT_ONCE:
                    rows = 0
                    yield out()
            if held:
                yield out()

    kinds = dict(frames.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in own) + f", trajectory {dict(spots.dtypes)['trajectory']}, Intensity double, bg double, x bigint, y bigint, slice {kinds['t']}"
    sums = frames.select(*own, "t", "height", "width", "pixels").join(told, by).mapInArrow(run, schema) if by else frames.select(*own, "t", "height", "width", "pixels").crossJoin(told).mapInArrow(run, schema)
    return sums.select(*by, *[c for c in own if c not in by], "trajectory", "Intensity", "bg", "x", "y", "slice")


def gaussian_2d(x: str, y: str, amplitude, xo, yo, sx, sy, theta, offset):
    """A rotated 2-D Gaussian as a column."""
    lit = lambda v: F.col(v) if isinstance(v, str) else F.lit(float(v))
    amplitude, xo, yo, sx, sy, theta, offset = map(lit, (amplitude, xo, yo, sx, sy, theta, offset))
    u, v, c, s = F.col(x) - xo, F.col(y) - yo, F.cos(theta), F.sin(theta)
    a, d = c * c / (2 * sx * sx) + s * s / (2 * sy * sy), s * s / (2 * sx * sx) + c * c / (2 * sy * sy)
    b = F.sin(2 * theta) / (4 * sy * sy) - F.sin(2 * theta) / (4 * sx * sx)
    return offset + amplitude * F.exp(-(a * u * u + 2 * b * u * v + d * v * v))


def _images(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """The images of a batch of frames, null values as NaN."""
    at = batch.schema.get_field_index
    heights, widths = batch.column(at("height")).to_pylist(), batch.column(at("width")).to_pylist()
    for pixels, h, w in zip(batch.column(at("pixels")), heights, widths, strict=True):
        yield pixels.values.to_numpy(zero_copy_only=False).astype(float).reshape(h, w)


def _stacks(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Parts of a batch, of neighbouring frames of one size, with their images as a stack (rows, columns, frames)."""
    held, begin = [], 0
    for image in _images(batch):
        if held and (image.shape != held[0].shape or (len(held) + 1) * image.size > kernels.CELLS):
            yield batch.slice(begin, len(held)), np.stack(held, axis=-1)
            begin, held = begin + len(held), []
        held.append(image)
    if held:
        yield batch.slice(begin, len(held)), np.stack(held, axis=-1)


def _with_pixels(batch: pa.RecordBatch, images: list[np.ndarray]) -> pa.RecordBatch:
    """The columns of FRAMES of a batch, with other pixels."""
    own = [batch.column(batch.schema.get_field_index(c)) for c in (*FRAME, "height", "width")]
    lists = [pa.array(i.ravel().astype(np.float32)) for i in images]
    offsets = pa.array(np.cumsum([0, *map(len, lists)]).astype(np.int32))
    pixels = pa.ListArray.from_arrays(offsets, pa.concat_arrays(lists) if lists else pa.array([], pa.float32()))
    return pa.RecordBatch.from_arrays([*own, pixels], names=[*FRAME, "height", "width", "pixels"])


def flat_field(frames: DataFrame, sigma: float = 20.0, offset: float = 0.0) -> DataFrame:
    """Each frame less ``offset``, over its blur scaled to a largest value of 1 in the whole movie; 0/0 gives 0.

    A first pass blurs for one number, the largest of a frame; a second blurs and divides in the same task, so no frame is
    ever shuffled. The numbers, one an image, are written first: Spark broadcasts them while that table is small, and joins
    by image where it is not. Null or NaN pixels make NaN of what their blur reaches, and don't count for the largest.
    """

    def blurred(stack: np.ndarray) -> np.ndarray:
        return kernels.gaussian_blur(stack - offset, sigma).astype(np.float32)

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            top = [float(np.nanmax(b, initial=-np.inf)) for _, stack in _stacks(batch) for b in np.moveaxis(blurred(stack), -1, 0)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(top, pa.float64())], names=["image_id", "top"])

    def divided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        largest = np.finfo(np.float32).max
        for part, stack in (found for batch in batches for found in _stacks(batch)):
            blur, top = blurred(stack).astype(float), np.array(part.column(part.schema.get_field_index("top")).to_pylist(), float)
            with np.errstate(divide="ignore", invalid="ignore"):
                ratio = (stack - offset) * top / blur
            yield _with_pixels(part, list(np.moveaxis(np.where(blur == 0, np.sign(stack - offset) * largest, ratio), -1, 0)))

    largest = written(frames.select("image_id", "height", "width", "pixels").mapInArrow(tops, "image_id int, top double").groupBy("image_id").agg(F.max("top").alias("top")))
    return frames.select(*FRAME, "height", "width", "pixels").join(largest, "image_id").mapInArrow(divided, FRAMES)


#: Frames of a movie that are compared with one copy of their reference.
BESIDE = 64


def frame_shifts(frames: DataFrame, channel: int = 0) -> DataFrame:
    """image_id, t, dr, dc: how far each frame of a channel lies beyond its movie's first one.

    The times that movies reach over, then the references, one an image, are written first; Spark broadcasts them while
    these tables are small. Where they are not, frames meet them by image and stretches of BESIDE frames, a copy a stretch, so a long movie is spread over tasks.
    """
    own = frames.where(f"c = {int(channel)} and z = 0").select("image_id", "t", "height", "width", "pixels")
    spans = written(own.groupBy("image_id").agg(F.min("t").alias("first"), F.max("t").alias("last")))
    stretch = lambda t: F.floor(F.col(t) / BESIDE)
    first = own.join(spans.withColumnRenamed("image_id", "_image"), (F.col("image_id") == F.col("_image")) & (F.col("t") == F.col("first")))
    references = written(first.select("image_id", F.col("pixels").alias("reference"), F.explode(F.sequence(stretch("first"), stretch("last"))).alias("_stretch")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known, found = {}, []
            for image, reference in zip(_images(batch), batch.column(batch.schema.get_field_index("reference")), strict=True):
                if image.shape not in known:
                    known[image.shape] = kernels.hann_disc(image.shape)
                found.append(kernels.shift_between(image, reference.values.to_numpy(zero_copy_only=False).astype(float).reshape(image.shape), known[image.shape]))
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("image_id", "t")]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array([f[k] for f in found], pa.int32()) for k in (0, 1))], names=["image_id", "t", "dr", "dc"])

    return own.withColumn("_stretch", stretch("t")).join(references, ["image_id", "_stretch"]).mapInArrow(run, "image_id int, t int, dr int, dc int")


def drift_correct(frames: DataFrame, channel: int = 0) -> DataFrame:
    """All channels moved back by the shifts of one, which are written first, so frames are not shuffled for them while they are few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, stack in (found for batch in batches for found in _stacks(batch)):
            dr, dc = (part.column(part.schema.get_field_index(c)).to_pylist() for c in ("dr", "dc"))
            yield _with_pixels(part, [kernels.shifted(i, a, b) for i, a, b in zip(np.moveaxis(stack, -1, 0), dr, dc, strict=True)])

    shifts = written(frame_shifts(frames, channel))
    return frames.select(*FRAME, "height", "width", "pixels").join(shifts, ["image_id", "t"]).mapInArrow(run, FRAMES)


def find_blobs(frames: DataFrame, **how) -> DataFrame:
    """image_id, t, c, z, peak_id, x (row), y (column), sigma of the bright blobs of each frame. Null pixels count as 0, NaN ones too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, stack in (part for batch in batches for part in _stacks(batch)):
            found = kernels.log_blobs_each(np.nan_to_num(stack), **how)
            found = [b[np.lexsort((b[:, 1], b[:, 0]))] for b in found]
            row = pa.array(np.repeat(np.arange(len(found)), [len(b) for b in found]))
            number = np.concatenate([np.arange(len(b), dtype=np.int32) for b in found]) if found else np.zeros(0, np.int32)
            every = np.concatenate(found) if found else np.zeros((0, 3))
            own = [batch.column(batch.schema.get_field_index(c)).take(row) for c in FRAME]
            yield pa.RecordBatch.from_arrays([*own, pa.array(number), *(pa.array(np.ascontiguousarray(c)) for c in every.T)], names=[*FRAME, "peak_id", "x", "y", "sigma"])

    return frames.select(*FRAME, "height", "width", "pixels").mapInArrow(run, "image_id int, t int, c int, z int, peak_id int, x double, y double, sigma double")


def find_peaks(frames: DataFrame, roi: tuple[float, float, float, float] | None = None, min_dist: float | None = None, **how) -> DataFrame:
    """``find_blobs``, then only those within ``roi`` (low x, low y, high x, high y), then only those without another one nearer than ``min_dist``."""
    peaks = find_blobs(frames, **how)
    if roi is not None:
        peaks = roi_filter(peaks, roi)
    return peaks if min_dist is None else isolated(written(peaks), min_dist)  # a join with itself: blobs are sought once


def fit_spots(frames: DataFrame, peaks: DataFrame, radius: int = 4, legacy_grid: bool = False) -> DataFrame:
    """A Gaussian fitted about each peak of each frame; the frame, peak_id, the parameters, status 'ok', 'clipped' or 'failed'.

    Peaks belong to frames by those of FRAME's columns that both tables have: peaks of an image without t are fitted in
    each of its frames. The peaks of a frame are one row before they meet it, so a frame goes along once; its patches of
    (2 radius)**2 pixels are cut out, and all patches of a batch are fitted together. Peaks with a null place, and fits over
    null or NaN pixels, fail.
    """
    names = ["amplitude", "xo", "yo", "sigma_x", "sigma_y", "theta", "offset"]
    own = shared(FRAME, None, frames, peaks)
    told = peaks.select(*own, F.struct(F.col("peak_id").cast("int").alias("peak_id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).alias("p")).groupBy(*own).agg(F.collect_list("p").alias("peaks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, number, status, at, windows = [], [], [], [], []
            for k, (image, own_peaks) in enumerate(zip(_images(batch), batch.column(batch.schema.get_field_index("peaks")), strict=True)):
                ids, x, y = (own_peaks.values.field(c).to_numpy(zero_copy_only=False) for c in ("peak_id", "x", "y"))
                x, y = x.astype(float), y.astype(float)
                there = np.isfinite(x) & np.isfinite(y)
                r, c = (np.where(there, v, -1).astype(np.int64) for v in (x, y))
                cut, whole = kernels.patches(image, r, c, radius)
                row += [k] * len(ids)
                number += own_peaks.values.field("peak_id").to_pylist()
                status.append(np.where(~there, "failed", np.where(whole, "ok", "clipped")))
                at.append(np.column_stack([r, c]))
                windows.append(cut)
            state = np.concatenate(status) if status else np.zeros(0, "<U7")
            fits = np.flatnonzero(state == "ok")
            fitted = np.full((len(state), 7), np.nan)
            if len(fits):
                place = np.concatenate(at)[fits]
                p, ok = kernels.fit_patches(np.concatenate(windows), place[:, 0], place[:, 1], legacy_grid=legacy_grid)
                fitted[fits[ok]] = p[ok]
                state[fits[~ok]] = "failed"
            of = [batch.column(batch.schema.get_field_index(c)).take(pa.array(row, pa.int64())) for c in FRAME]
            values = [pa.array(np.ascontiguousarray(v), mask=state != "ok") for v in fitted.T]
            yield pa.RecordBatch.from_arrays([*of, pa.array(number, pa.int32()), *values, pa.array(state.tolist(), pa.string())], names=[*FRAME, "peak_id", *names, "status"])

    both = frames.select(*FRAME, "height", "width", "pixels").join(told, own)
    return both.mapInArrow(run, ", ".join(f"{n} int" for n in (*FRAME, "peak_id")) + ", " + ", ".join(f"{n} double" for n in names) + ", status string")


def count_channels(frames: DataFrame) -> DataFrame:
    """image_id, n_channels, n_long: the channels of each image, and how many of its dimensions t, c and z are longer than 1."""
    sizes = frames.groupBy("image_id").agg(*[F.count_distinct(d).alias(d) for d in ("t", "c", "z")])
    return sizes.select("image_id", F.col("c").alias("n_channels"), sum((F.col(d) > 1).cast("int") for d in ("t", "c", "z")).alias("n_long"))


def stack_trajectories(*tables: DataFrame) -> DataFrame:
    """The trajectories of several tables as one, each table's ids moved beyond those before it by its number in the upper half of 64 bits."""
    moved = [t.withColumn("trajectory", F.col("trajectory").cast("long") + F.lit(k << 32)) for k, t in enumerate(tables)]
    return reduce(DataFrame.unionByName, moved)
