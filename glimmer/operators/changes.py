"""Change points: the best split of any segment of a trajectory, again and again, while it gains more than a penalty.

Trajectories of up to a block of rows are searched whole, many to a task. A longer one is cut into blocks of that many rows,
and every split search is an aggregate over its blocks: each tells the best split within it, from sums carried over the
blocks before ('l2', 'normal') or added up over pairs of blocks ('rbf'), and the best of all is the segment's. The segments of
all trajectories are split side by side, a level a round; those that have become as short as a block are finished whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glimmer.functions.kernels import binary_segmentation, moment_cost
from glimmer.functions.whole import placed, trajectories
from glimmer.operators.groups import KEY, ORDER, VALUE
from glimmer.operators.ordered import dealt, running_within
from glimmer.sources.shared import dropped, written

BLOCK, JUMP, LEAST = 8192, 5, 2
#: Thresholds at which pairs are counted at once in the search for the median distance.
TRIED = 15


def change_points(df: DataFrame, penalty: float = 1.0, cost: str = "rbf", key: str = KEY, value: str = VALUE, order: str = ORDER, block: int = BLOCK) -> DataFrame:
    """key and bkps: the ends (exclusive, the last is the number of rows) of the segments of each trajectory.

    Rows whose value is null, NaN or infinite are left out of the search; break points are places among all rows of the
    trajectory, so a segment begins at a row with a value. A trajectory without values is one segment; rows without a key
    are left out. Rows of equal order come in the order of their values. 'l1' has no form by blocks: it looks at a whole
    trajectory, in time by the square of its rows. 'rbf' takes such time too, but spread over tasks, in memory for a block.
    """
    if cost not in ("l1", "l2", "normal", "rbf"):
        raise ValueError(f"no cost {cost!r}: l1, l2, normal or rbf")
    kind = next(f.dataType.simpleString() for f in df.schema if f.name == key)
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(order).alias("order"), F.col(value).cast("double").alias("x"))
    if cost == "l1":
        return _whole(rows, penalty, cost, kind).withColumnRenamed("key", key)
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.count_if(_fine()).alias("n"))
    long = written(sizes.where(F.col("n") > block))
    if long.isEmpty():
        dropped(long)
        return _whole(rows, penalty, cost, kind).withColumnRenamed("key", key)
    short = _whole(rows.join(long, "key", "left_anti"), penalty, cost, kind)
    return short.unionByName(_by_blocks(rows.join(long, "key", "left_semi"), long, penalty, cost, kind, block)).withColumnRenamed("key", key)


def _fine():
    return F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") < float("inf"))


def _whole(rows: DataFrame, penalty: float, cost: str, kind: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, first in trajectories(batches):
            x, keys, ends = table.column("x").to_numpy(), table.column("key").take(pa.array(first[:-1])), []
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                at = np.flatnonzero(np.isfinite(x[a:b]))
                found = binary_segmentation(x[a:b][at], penalty, cost, JUMP, LEAST)
                ends.append([*at[found[:-1]].tolist(), b - a])
            yield from pa.Table.from_arrays([keys, pa.array(ends, pa.list_(pa.int32()))], names=["key", "bkps"]).to_batches()

    return placed(rows, "key", ["order", "x"]).mapInArrow(run, f"key {kind}, bkps array<int>")


def _by_blocks(rows: DataFrame, sizes: DataFrame, penalty: float, cost: str, kind: str, block: int) -> DataFrame:
    by = ["key", "order", "x"]
    counted = running_within(dealt(rows, by), "key", by, {"at": F.lit(1).cast("long"), "pos": _fine().cast("long")}).where(_fine())
    held = counted.groupBy("key", F.floor(F.col("pos") / block).alias("block")).agg(F.sort_array(F.collect_list(F.struct("pos", "x", "at"))).alias("r"))
    blocks = written(held.select("key", "block", F.col("r.x").alias("x"), F.col("r.at").alias("at")))
    search = _by_kernel if cost == "rbf" else _by_moments
    open_ = _scaled(blocks, sizes, kind, block) if cost == "rbf" else sizes.withColumn("scale", F.lit(1.0))
    open_ = open_.select("key", F.lit(0).cast("long").alias("a"), F.col("n").alias("b"), "scale")
    found, small = [], []
    best = search(blocks, cost, kind, block)
    while True:
        split = written(best(open_).where(F.col("gain") > penalty))
        if split.isEmpty():
            dropped(split)
            break
        found.append(split.select("key", "k"))
        halves = F.inline(F.array(F.struct(F.col("a"), F.col("k").alias("b")), F.struct(F.col("k").alias("a"), F.col("b"))))
        children = split.select("key", "scale", halves).select("key", "a", "b", "scale")
        small.append(children.where(F.col("b") - F.col("a") <= block))
        open_ = children.where(F.col("b") - F.col("a") > block)
    if not found:
        return sizes.select("key", F.array(F.col("rows").cast("int")).alias("bkps"))
    found.append(_finished(reduce(DataFrame.unionByName, small), blocks, penalty, cost, kind, block))
    breaks = reduce(DataFrame.unionByName, found).select("key", "k", F.floor(F.col("k") / block).alias("block"))
    where = breaks.join(blocks.select("key", "block", "at"), ["key", "block"]).select("key", F.get("at", (F.col("k") % block).cast("int")).cast("int").alias("at"))
    ends = where.unionByName(sizes.select("key", F.col("rows").cast("int").alias("at")))
    return ends.groupBy("key").agg(F.sort_array(F.collect_list("at")).alias("bkps"))


def _in_blocks(segments: DataFrame, blocks: DataFrame, block: int) -> DataFrame:
    """Each segment with each block it reaches into."""
    each = segments.withColumn("block", F.explode(F.sequence(F.floor(F.col("a") / block), F.floor((F.col("b") - 1) / block))))
    return each.join(blocks, ["key", "block"])


def _best(found: DataFrame) -> DataFrame:
    """Of each segment the split of most gain, the first of equal ones."""
    top = F.max_by(F.struct("gain", "k"), F.struct(F.col("gain"), -F.col("k"))).alias("top")
    return found.where("k is not null").groupBy("key", "a", "b", "scale").agg(top).select("key", "a", "b", "scale", "top.*")


def _places(a: int, b: int, low: int, high: int) -> np.ndarray:
    """Where a segment [a, b) can be split within [low, high)."""
    first = max(a + LEAST, low)
    return np.arange(-(-first // JUMP) * JUMP, min(b - LEAST + 1, high), JUMP)


def _columns(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """Rows of some columns, lists as numpy arrays."""
    out = []
    for name in names:
        c = batch.column(batch.schema.get_field_index(name))
        out.append([np.asarray(v.values) for v in c] if pa.types.is_list(c.type) else c.to_pylist())
    return zip(*out, strict=True)


def _by_moments(blocks: DataFrame, cost: str, kind: str, block: int) -> Callable[[DataFrame], DataFrame]:
    """Sums before each block are carried along once; a segment's costs are differences of them."""
    total = {"s": lambda xs: F.aggregate(xs, F.lit(0.0), lambda acc, v: acc + v), "q": lambda xs: F.aggregate(xs, F.lit(0.0), lambda acc, v: acc + v * v)}
    before = Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    sums = blocks.select("key", "block", *[of("x").alias(c) for c, of in total.items()])
    carried = sums.select("key", "block", *[F.coalesce(F.sum(c).over(before), F.lit(0.0)).alias(c) for c in total])
    known = written(blocks.select("key", "block", "x").join(carried, ["key", "block"]))

    def edged(segments: DataFrame, at: str, inside: int) -> DataFrame:
        """Sums before a place, looked up in its block."""
        head = F.slice("x", 1, (F.col(at) - F.col("block") * block).cast("int"))
        met = segments.withColumn("block", F.floor((F.col(at) - inside) / block)).join(known, ["key", "block"])
        return met.select(*segments.columns, *[(F.col(c) + of(head)).alias(f"{c}_{at}") for c, of in total.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gains, ks = [], []
            for a, b, sa, qa, sb, qb, at, s, q, x in _columns(batch, "a", "b", "s_a", "q_a", "s_b", "q_b", "block", "s", "q", "x"):
                k = _places(a, b, at * block, at * block + len(x))
                if not len(k):
                    gains.append(None)
                    ks.append(None)
                    continue
                head = k - at * block
                sk, qk = (v + np.concatenate([[0.0], np.cumsum(w)])[head] for v, w in ((s, x), (q, x * x)))
                gain = moment_cost(np.array(b - a), np.array(sb - sa), np.array(qb - qa), cost) - moment_cost(k - a, sk - sa, qk - qa, cost) - moment_cost(b - k, sb - sk, qb - qk, cost)
                top = int(gain.argmax())
                gains.append(float(gain[top]))
                ks.append(int(k[top]))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in ("key", "a", "b", "scale")), pa.array(gains, pa.float64()), pa.array(ks, pa.int64())], names=["key", "a", "b", "scale", "gain", "k"])

    def best(segments: DataFrame) -> DataFrame:
        return _best(_in_blocks(edged(edged(segments, "a", 0), "b", 1), known, block).mapInArrow(run, f"key {kind}, a long, b long, scale double, gain double, k long"))

    return best


def _by_kernel(blocks: DataFrame, cost: str, kind: str, block: int) -> Callable[[DataFrame], DataFrame]:
    """Kernel sums of each row of a block with all rows of the segment, added up over pairs of blocks; then they are carried along."""
    told = f"key {kind}, a long, b long, scale double, low long, before array<double>, behind array<double>"

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, None

        def passed() -> pa.RecordBatch:
            (key, a, b, scale, low), (before, behind) = now, sums
            return pa.RecordBatch.from_arrays([pa.array([key], keys), pa.array([a]), pa.array([b]), pa.array([scale]), pa.array([low]), pa.array([before], pa.list_(pa.float64())), pa.array([behind], pa.list_(pa.float64()))], names=["key", "a", "b", "scale", "low", "before", "behind"])

        for batch in batches:
            keys = batch.schema.field("key").type
            for key, a, b, scale, one, two, x, y in _columns(batch, "key", "a", "b", "scale", "block", "other", "x", "y"):
                low, at = max(a, one * block), max(a, two * block)
                x, y = x[low - one * block : b - one * block], y[at - two * block : b - two * block]
                if (key, a, b, scale, low) != now:
                    if now is not None:
                        yield passed()
                    now, sums = (key, a, b, scale, low), (np.zeros(len(x)), np.zeros(len(x)))
                step = max(1, (1 << 20) // max(1, len(y)))
                for r in range(0, len(x), step):
                    table = np.exp(-((x[r : r + step, None] - y[None, :]) ** 2) / scale)
                    if one != two:
                        sums[0 if two < one else 1][r : r + step] += table.sum(axis=1)
                    else:
                        here, there = np.arange(r, r + len(table))[:, None], np.arange(len(y))[None, :]
                        sums[0][r : r + step] += np.where(there < here, table, 0.0).sum(axis=1)
                        sums[1][r : r + step] += np.where(there > here, table, 0.0).sum(axis=1)
        if now is not None:
            yield passed()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gains, ks = [], []
            for a, b, low, before, behind, left0, right0, whole in _columns(batch, "a", "b", "low", "before", "behind", "left0", "right0", "whole"):
                k = _places(a, b, low, low + len(before))
                if not len(k):
                    gains.append(None)
                    ks.append(None)
                    continue
                head = k - low
                left = left0 + np.concatenate([[0.0], np.cumsum(2 * before + 1)])[head]
                right = right0 - np.concatenate([[0.0], np.cumsum(2 * behind + 1)])[head]
                gain = -whole / (b - a) + left / (k - a) + right / (b - k)
                top = int(gain.argmax())
                gains.append(float(gain[top]))
                ks.append(int(k[top]))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in ("key", "a", "b", "scale")), pa.array(gains, pa.float64()), pa.array(ks, pa.int64())], names=["key", "a", "b", "scale", "gain", "k"])

    def best(segments: DataFrame) -> DataFrame:
        own = _in_blocks(segments, blocks.select("key", "block", "x"), block)
        met = own.withColumn("other", F.explode(F.sequence(F.floor(F.col("a") / block), F.floor((F.col("b") - 1) / block)))).join(blocks.select("key", F.col("block").alias("other"), F.col("x").alias("y")), ["key", "other"])
        at = ["key", "a", "b", "scale", "block"]
        rows = written(met.repartition("key", "a", "block").sortWithinPartitions(*at, "other").mapInArrow(pairs, told))
        total = lambda c: F.aggregate(c, F.lit(0.0), lambda acc, v: acc + 2 * v + 1)
        of = Window.partitionBy("key", "a", "b")  # a row a block
        light = rows.select("key", "a", "b", "low", total("before").alias("left"), total("behind").alias("right"))
        earlier, later = of.orderBy("low").rowsBetween(Window.unboundedPreceding, -1), of.orderBy("low").rowsBetween(0, Window.unboundedFollowing)
        carried = light.select("key", "a", "b", "low", F.coalesce(F.sum("left").over(earlier), F.lit(0.0)).alias("left0"), F.sum("right").over(later).alias("right0"), F.sum("left").over(of).alias("whole"))
        return _best(rows.join(carried, ["key", "a", "b", "low"]).mapInArrow(run, f"key {kind}, a long, b long, scale double, gain double, k long"))

    return best


def _finished(segments: DataFrame, blocks: DataFrame, penalty: float, cost: str, kind: str, block: int) -> DataFrame:
    """The splits of segments as short as a block: key, k."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []

        def splits() -> pa.RecordBatch:
            key, a, b, scale = now
            ends = binary_segmentation(np.concatenate(parts), penalty, cost, JUMP, LEAST, a, scale)[:-1]
            return pa.RecordBatch.from_arrays([pa.array([key] * len(ends), keys), pa.array(ends, pa.int64())], names=["key", "k"])

        for batch in batches:
            keys = batch.schema.field("key").type
            for *at, one, x in _columns(batch, "key", "a", "b", "scale", "block", "x"):
                if at != now:
                    if now is not None:
                        yield splits()
                    now, parts = at, []
                parts.append(x[max(0, at[1] - one * block) : at[2] - one * block])
        if now is not None:
            yield splits()

    each = _in_blocks(segments, blocks.select("key", "block", "x"), block)
    return each.repartition("key", "a").sortWithinPartitions("key", "a", "b", "block").mapInArrow(run, f"key {kind}, k long")


def _scaled(blocks: DataFrame, sizes: DataFrame, kind: str, block: int) -> DataFrame:
    """``sizes`` with the median squared distance of two values of each trajectory, exactly.

    The two middle distances are sought among the numbers a double can be: rounds of counting the pairs that are as near as
    some thresholds. Values are sorted into blocks; for a threshold, a block's values end in few other blocks, and all
    blocks between are counted without being looked at.
    """
    by = ["key", "x"]
    values = blocks.select("key", F.explode("x").alias("x")).withColumn("x", F.col("x") + F.lit(0.0))
    ranked = running_within(dealt(values, by), "key", by, {"pos": F.lit(1).cast("long")})
    packed = ranked.groupBy("key", F.floor(F.col("pos") / block).alias("block")).agg(F.sort_array(F.collect_list("x")).alias("x"))
    ordered = written(packed)
    lows = ordered.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("block", F.array_min("x").alias("low")))).alias("r"), F.max(F.array_max("x")).alias("top")).select("key", F.col("r.low").alias("lows"), "top")
    pairs = F.col("n") * (F.col("n") - 1) / 2
    wanted = F.explode(F.array(F.floor((pairs - 1) / 2), F.floor(pairs / 2))).alias("rank")
    reach = sizes.select("key", wanted).distinct().join(lows, "key")

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = np.array([v[0] for (v,) in _columns(batch, "lows")])
            high = (np.asarray(batch.column(batch.schema.get_field_index("top"))) - low).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.zeros(len(high), np.int64)), pa.array(high)], names=["key", "rank", "low", "high"])

    span = written(reach.select("key", "rank", "lows", "top").mapInArrow(bits, f"key {kind}, rank long, low long, high long"))

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For a block and a threshold: the pairs that need no look (with other null), or the blocks to look into."""
        for batch in batches:
            rows = []
            for key, one, x, starts, v in _columns(batch, "key", "block", "x", "lows", "v"):
                gap = np.int64(v).view(np.float64)
                first, last = (int(np.searchsorted(starts, e + gap, "right")) - 1 for e in (x[0], x[-1]))
                first, last = max(first, one), max(last, one)
                if first > one:
                    rows.append((key, v, None, one, None, len(x) * (len(x) - 1) // 2 + len(x) * (first - one - 1) * block))
                rows += [(key, v, other, one, x, 0) for other in range(first, last + 1)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, (batch.schema.field("key").type, pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.int64()), strict=True)], names=["key", "v", "other", "block", "x", "n"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = []
            for v, other, one, x, y in _columns(batch, "v", "other", "block", "x", "y"):
                below = np.searchsorted(y, x + np.int64(v).view(np.float64), "right")
                n.append(int((below - np.arange(1, len(x) + 1)).sum() if other == one else below.sum()))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("key")), batch.column(batch.schema.get_field_index("v")), pa.array(n, pa.int64())], names=["key", "v", "n"])

    while not span.where("low < high").isEmpty():
        tries = span.where("low < high").withColumn("v", F.explode(F.array_distinct(F.expr(f"transform(sequence(0, {TRIED}), k -> low + ((high - low) div {TRIED + 1}) * k + (((high - low) % {TRIED + 1}) * k) div {TRIED + 1})"))))
        asked = tries.select("key", "v").distinct()
        near = written(ordered.join(lows.select("key", "lows"), "key").join(asked, "key").select("key", "block", "x", "lows", "v").mapInArrow(reached, f"key {kind}, v long, other long, block long, x array<double>, n long"))
        looked = near.where("other is not null").drop("n").join(ordered.select("key", F.col("block").alias("other"), F.col("x").alias("y")), ["key", "other"]).mapInArrow(counted, f"key {kind}, v long, n long")
        counts = near.where("other is null").select("key", "v", "n").unionByName(looked).groupBy("key", "v").agg(F.sum("n").alias("n"))
        judged = tries.join(counts, ["key", "v"], "left").withColumn("enough", F.coalesce("n", F.lit(0)) > F.col("rank"))
        moved = judged.groupBy("key", "rank").agg(F.max(F.when(~F.col("enough"), F.col("v") + 1)).alias("up"), F.min(F.when(F.col("enough"), F.col("v"))).alias("down"))
        old = span
        span = written(span.join(moved, ["key", "rank"], "left").select("key", "rank", F.coalesce("up", "low").alias("low"), F.coalesce("down", "high").alias("high")))
        dropped(old, near)

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gap = np.asarray(batch.column(1)).view(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(gap * gap)], names=["key", "square"])

    middle = span.select("key", "low").mapInArrow(back, f"key {kind}, square double").groupBy("key").agg(F.avg("square").alias("square"))
    return sizes.join(middle, "key").withColumn("scale", F.when(F.col("square") > 0, F.col("square")).otherwise(1.0)).drop("square")
