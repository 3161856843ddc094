"""Spatial joins of peaks: near neighbours within a radius, colocalisation, drift search, isolation.

A radius join goes by grid cells as wide as the radius: one side's points go to their cell and its eight neighbours, the
other's to their own, so the join is an equi-join on cells and every pair within the radius meets exactly once. All images
of a table are worked on in one plan: ``by`` names the columns that tell images (for isolation: frames) apart, by default
those of IMAGE (FRAME) that the tables have; peaks meet only peaks of the same image, and ids need only differ there.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glimmer.operators.ordered import numbered
from glimmer.sources.shared import written

IMAGE = ("image_id",)
FRAME = ("image_id", "t", "c", "z", "channel")


def shared(names: tuple[str, ...], by: list[str] | None, *tables: DataFrame) -> list[str]:
    """``by``, or those of the names that all tables have."""
    return list(by) if by is not None else [n for n in names if all(n in t.columns for t in tables)]


def distance(ax, ay, bx, by) -> Column:
    return F.sqrt(F.pow(F.col(ax) - F.col(bx), 2) + F.pow(F.col(ay) - F.col(by), 2))


def within(a: DataFrame, b: DataFrame, radius: float, extra: list[str] | None = None) -> DataFrame:
    """Pairs of a (a_id, ax, ay) and b (b_id, bx, by) closer than ``radius``, with d; ``extra`` columns must be equal too."""
    extra = extra or []
    cell = lambda c: F.floor(F.col(c) / radius)
    near = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    left = a.withColumn("cx", cell("ax")).withColumn("cy", cell("ay"))
    right = b.withColumn("o", near).withColumn("cx", cell("bx") + F.col("o.i")).withColumn("cy", cell("by") + F.col("o.j")).drop("o")
    return left.join(right, [*extra, "cx", "cy"]).drop("cx", "cy").withColumn("d", distance("ax", "ay", "bx", "by")).where(F.col("d") < radius)


def points(peaks: DataFrame, side: str, by: list[str] | None = None) -> DataFrame:
    return peaks.select(*(by or []), F.col("peak_id").alias(f"{side}_id"), F.col("x").alias(f"{side}x"), F.col("y").alias(f"{side}y"))


def finite(df: DataFrame, x: str, y: str) -> DataFrame:
    """Points whose place is known: others are near nothing."""
    return df.where((F.abs(x) < float("inf")) & (F.abs(y) < float("inf")))


def nearest(pairs: DataFrame, of: str, other: str, extra: list[str] | None = None) -> DataFrame:
    """For each ``of`` point its nearest ``other`` one, n, with all that the pair has; ties go to the lowest id."""
    extra = extra or []
    told = F.struct(*[c for c in pairs.columns if c not in extra])
    return pairs.groupBy(*extra, f"{of}_id").agg(F.min_by(told, F.struct("d", f"{other}_id")).alias("n"))


def nn_threshold_join(p1: DataFrame, p2: DataFrame, threshold: float, by: list[str] | None = None) -> DataFrame:
    """For each p1 peak whose nearest p2 peak of its image is closer than ``threshold``: the image, peak_id, near_id, d."""
    by = shared(IMAGE, by, p1, p2)
    found = nearest(within(points(p1, "a", by), points(p2, "b", by), threshold, by), "a", "b", by)
    return found.select(*by, F.col("a_id").alias("peak_id"), F.col("n.b_id").alias("near_id"), F.col("n.d").alias("d"))


def matched(pairs: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """From pairs within the threshold: for every b peak its nearest a peak, and that one's nearest b peak, with its columns."""
    extra = extra or []
    theirs = [c for c in pairs.columns if c not in (*extra, "a_id", "ax", "ay", "d")]
    back = nearest(pairs, "b", "a", extra).select(*extra, F.col("n.a_id").alias("a_id"), F.col("n.ax").alias("ax"), F.col("n.ay").alias("ay"))
    on = nearest(pairs, "a", "b", extra).select(*extra, "a_id", *[F.col(f"n.{c}").alias(c) for c in theirs])
    return back.join(on, [*extra, "a_id"])


def coloc_pairs(p1: DataFrame, p2: DataFrame, threshold: float, mutual: bool = False, by: list[str] | None = None) -> DataFrame:
    """The image, a_id, ax, ay, b_id, bx, by: one row for each p2 peak that has a p1 peak within the threshold; several of them can share a pair. ``mutual``: every pair once."""
    by = shared(IMAGE, by, p1, p2)
    out = matched(within(points(p1, "a", by), points(p2, "b", by), threshold, by), by).select(*by, "a_id", "ax", "ay", "b_id", "bx", "by")
    return out.distinct() if mutual else out


def drift_grid(p1: DataFrame, p2: DataFrame, threshold: float = 1.0, precision: float = 1.0, max_x: float = 7.0, max_y: float = 7.0, by: list[str] | None = None) -> DataFrame:
    """The image, gx, gy, n: matches when p2 is moved by each translation of the grid, of those with matches.

    A match is a p2 peak with any p1 peak within the threshold, so each place counts once, however many peaks stand there.
    A place moved into a small cell that holds a p1 peak has one near enough; only others are compared with what is around.
    """
    by = shared(IMAGE, by, p1, p2)
    last = lambda most: int((2 * most + 1) / precision - 1e-9)
    step = lambda most: F.explode(F.sequence(F.lit(0), F.lit(last(most))))
    theirs = finite(points(p2, "b", by), "bx", "by")
    first = finite(points(p1, "a", by), "ax", "ay").select(*by, "ax", "ay").distinct()
    tried = theirs.select(*by, F.col("bx").alias("old_x"), F.col("by").alias("old_y")).distinct().withColumn("i", step(max_x)).withColumn("j", step(max_y))
    tried = tried.select(*by, "old_x", "old_y", (F.col("i") * precision - max_x).alias("gx"), (F.col("j") * precision - max_y).alias("gy"))
    moved = tried.withColumn("bx", F.col("old_x") + F.col("gx")).withColumn("by", F.col("old_y") + F.col("gy"))
    side = threshold * 0.999 / 2**0.5  # a cell's corners are nearer than the threshold, whatever rounding does to places this small
    cell = lambda c: F.floor(F.col(c) / side)
    full = first.where((F.abs("ax") < 1e9 * threshold) & (F.abs("ay") < 1e9 * threshold)).select(*by, cell("ax").alias("cx"), cell("ay").alias("cy")).distinct().withColumn("_full", F.lit(True))
    found = moved.withColumn("cx", cell("bx")).withColumn("cy", cell("by")).join(full, [*by, "cx", "cy"], "left").drop("cx", "cy")
    near = within(first, found.where("_full is null"), threshold, by)
    told = [*by, "old_x", "old_y", "gx", "gy"]
    hits = found.where("_full").select(*told).unionByName(near.select(*told).distinct())
    return hits.join(theirs.select(*by, F.col("bx").alias("old_x"), F.col("by").alias("old_y"), "b_id"), [*by, "old_x", "old_y"]).groupBy(*by, "gx", "gy").agg(F.count_distinct("b_id").alias("n"))


def best_drift(p1: DataFrame, p2: DataFrame, by: list[str] | None = None, **grid) -> DataFrame:
    """For each image the one translation with most matches; ties go to the smallest gx, then gy."""
    by = shared(IMAGE, by, p1, p2)
    best = F.min_by(F.struct("gx", "gy", "n"), F.struct(-F.col("n"), "gx", "gy")).alias("best")
    return drift_grid(p1, p2, by=by, **grid).groupBy(*by).agg(best).where("best is not null").select(*by, "best.*")


def drift_matches(p1: DataFrame, p2: DataFrame, threshold: float = 1.0, by: list[str] | None = None, **grid) -> DataFrame:
    """The pairs of each image's best translation, p2 where it stood before; no rows without matches.

    The places before the move travel along. The translations, a row an image, are written, so the search is made once. Of
    peaks at one place the one of the lowest number stands for all, as it is what others find there.
    """
    by = shared(IMAGE, by, p1, p2)
    drift = written(best_drift(p1, p2, by=by, threshold=threshold, **grid).select(*by, "gx", "gy"))
    theirs, first = finite(points(p2, "b", by), "bx", "by"), finite(points(p1, "a", by), "ax", "ay")
    moved = theirs.join(drift, by) if by else theirs.join(F.broadcast(drift))  # without images it is one row
    moved = moved.select(*by, "b_id", (F.col("bx") + F.col("gx")).alias("bx"), (F.col("by") + F.col("gy")).alias("by"), F.col("bx").alias("old_x"), F.col("by").alias("old_y"))
    each = moved.groupBy(*by, "bx", "by", "old_x", "old_y").agg(F.min("b_id").alias("b_id"), F.count(F.lit(1)).alias("times"))
    pairs = within(first.groupBy(*by, "ax", "ay").agg(F.min("a_id").alias("a_id")), each, threshold, by)
    back = nearest(pairs, "b", "a", by).select(*by, "n.a_id", "n.ax", "n.ay", "n.times")
    on = nearest(pairs, "a", "b", by).select(*by, "a_id", "n.b_id", F.col("n.old_x").alias("bx"), F.col("n.old_y").alias("by"))
    return back.join(on, [*by, "a_id"]).withColumn("times", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*by, "a_id", "ax", "ay", "b_id", "bx", "by")


def coloc_n_channels(channels: list[DataFrame], names: list[str] | None = None, threshold: float = 1.0, by: list[str] | None = None, **grid) -> DataFrame:
    """The image, <name>_id, <name>_x, <name>_y of the first channel's peaks that match one in every other, each after its drift."""
    names, by = names or [str(k) for k in range(len(channels))], shared(IMAGE, by, *channels)
    tables = []
    for k in range(1, len(channels)):
        t = drift_matches(channels[0], channels[k], threshold, by, **grid)
        first = [F.col("a_id").alias(f"{names[0]}_id")] + ([F.col("ax").alias(f"{names[0]}_x"), F.col("ay").alias(f"{names[0]}_y")] if k == 1 else [])
        tables.append(t.select(*by, *first, F.col("b_id").alias(f"{names[k]}_id"), F.col("bx").alias(f"{names[k]}_x"), F.col("by").alias(f"{names[k]}_y")))
    return reduce(lambda a, b: a.join(b, [*by, f"{names[0]}_id"]), tables)


def isolated(peaks: DataFrame, min_dist: float, by: list[str] | None = None) -> DataFrame:
    """Peaks without another of their frame at 0 < distance < ``min_dist``; close peaks drop each other, equal places don't count."""
    by = shared(FRAME, by, peaks)
    close = within(points(peaks, "a", by), points(peaks, "b", by), min_dist, by).where("d > 0").select(*by, F.col("a_id").alias("peak_id")).distinct()
    return peaks.join(close, [*by, "peak_id"], "left_anti")


def roi_filter(peaks: DataFrame, roi: tuple[float, float, float, float] = (0, 0, 512, 512)) -> DataFrame:
    """Peaks strictly inside (low x, low y, high x, high y)."""
    return peaks.where((F.col("x") > roi[0]) & (F.col("x") < roi[2]) & (F.col("y") > roi[1]) & (F.col("y") < roi[3]))


def bbox_corners(boxes: DataFrame) -> DataFrame:
    """corner (0 to 3), r, c of boxes (minr, minc, maxr, maxc), around the box."""
    corners = F.array(*[F.struct(F.col(r).alias("r"), F.col(c).alias("c")) for r, c in (("minr", "minc"), ("maxr", "minc"), ("maxr", "maxc"), ("minr", "maxc"))])
    rest = [c for c in boxes.columns if c not in ("minr", "minc", "maxr", "maxc")]
    return boxes.select(*rest, F.posexplode(corners).alias("corner", "at")).select(*rest, "corner", "at.r", "at.c")


def page_ids(keys: DataFrame, key: str, per_page: int) -> DataFrame:
    """Keys in order, ``per_page`` on a page (0, 1, ...)."""
    ranked = numbered(keys.select(key).where(F.col(key).isNotNull()).distinct(), [key], "rank")
    return ranked.select(key, F.floor(F.col("rank") / per_page).cast("long").alias("page"))
