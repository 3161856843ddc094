"""Two-state (or more) Gaussian hidden Markov models: first guess, training, decoding."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from glimmer.functions.kernels import fit_each, forward_backward, least_squares, log_sum, transfers, viterbi
from glimmer.functions.whole import POSITION, placed, trajectories
from glimmer.operators.events import histogram
from glimmer.operators.groups import KEY, ORDER, VALUE
from glimmer.operators.ordered import PART, dealt, numbered, running_within
from glimmer.sources.shared import written


@dataclass(frozen=True)
class Hmm:
    start: np.ndarray
    move: np.ndarray
    means: np.ndarray
    variances: np.ndarray

    def by_mean(self) -> Hmm:
        """States in the order of their means, so that labels don't depend on the start."""
        o = np.argsort(self.means)
        return Hmm(self.start[o], self.move[np.ix_(o, o)], self.means[o], self.variances[o])


def normal_density(x: Column, mean: float, sigma: float, weight: float = 1.0) -> Column:
    """A weighted normal density as a column."""
    z = (x - F.lit(float(mean))) / F.lit(float(sigma))
    return F.lit(float(weight)) * F.exp(-z * z / 2) / F.lit(float(sigma * np.sqrt(2 * np.pi)))


def initial_guess(df: DataFrame, start: tuple = (0, 20000, 2000, 2000, 1, 0.05), value: str = VALUE, bins: int = 100) -> tuple[np.ndarray, float]:
    """Two normals fitted to a histogram (means, sigmas, weights) and their signal-to-noise ratio. ``bins`` rows reach the driver."""
    low, high = df.agg(F.min(value), F.max(value)).collect()[0]
    rows = histogram(df, value, bins).select("bin", "density").collect()
    y = np.zeros(bins)
    for k, d in rows:
        y[k] = d or 0.0
    x = low + (high - low) / bins * np.arange(1, bins + 1)

    def residuals(p: np.ndarray) -> np.ndarray:
        s = np.maximum(np.abs(p[2:4]), 1e-9)
        return sum(p[4 + k] / (s[k] * np.sqrt(2 * np.pi)) * np.exp(-0.5 * ((x - p[k]) / s[k]) ** 2) for k in (0, 1)) - y

    p, _ = least_squares(residuals, np.array(start, float))
    p[2:4] = np.abs(p[2:4])
    return p, float(abs(p[1] - p[0]) / (0.5 * (p[2] + p[3])))


def init_hmm(guess: np.ndarray, stay: float = 0.9) -> Hmm:
    """A model from a first guess: starts by weight, equal moves."""
    w = np.maximum(np.asarray(guess[4:6], float), 1e-6)
    return Hmm(w / w.sum(), np.array([[stay, 1 - stay], [1 - stay, stay]]), np.asarray(guess[:2], float), np.asarray(guess[2:4], float) ** 2)


def sample_groups(df: DataFrame, fraction: float, seed: int = 0, key: str = KEY) -> DataFrame:
    """The rows of a share of the trajectories, chosen by md5 of key:seed: the same ones at any partitioning, and in other engines. Rows without a key are left out."""
    below, hashed = int(fraction * 2**32), F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    return df.where(F.col(key).isNotNull() if below >= 2**32 else F.substring(hashed, 1, 8) < f"{max(below, 0):08x}")


def sample_n_groups(df: DataFrame, n: int, seed: int = 42, key: str = KEY) -> DataFrame:
    """The rows of ``n`` trajectories (all, if there are fewer): those of the least hashes of the key, the same ones at any partitioning."""
    keys = df.select(key).where(F.col(key).isNotNull()).distinct().orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)
    return df.join(F.broadcast(keys), key, "left_semi")  # n keys


#: What a block is told of the rest of its trajectory: forward sums and best paths at the row before it (NaN: it is the first),
#: backward sums at its last row, the state of the best path there and that path's log-probability.
TOLD = {"_before": "array<double>", "_behind": "array<double>", "_paths": "array<double>", "_ends": "int", "_score": "double"}


def _lists(rows: np.ndarray) -> pa.Array:
    """A list for each row of numbers."""
    flat = np.ascontiguousarray(rows, float).reshape(len(rows), -1)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, max(flat.shape[1], 1), dtype=np.int32)[: len(rows) + 1]), pa.array(flat.ravel()))


def _numbers(batch: pa.RecordBatch | pa.Table, name: str, *shape: int) -> np.ndarray:
    """A column of lists as an array."""
    column = batch.column(batch.schema.get_field_index(name))
    return np.asarray((column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten(), float).reshape(-1, *shape)


#: Rows of a block where none are said and a sequence must not go through one task.
BLOCK = 8192


def concatenated(df: DataFrame, key: str = KEY, value: str = VALUE, order: str = ORDER) -> DataFrame:
    """All trajectories one after the other, by key and order, as one sequence: its key is 0, its order the row's number over the whole table."""
    fine = df.select(key, order, value).where(F.col(key).isNotNull() & F.col(value).isNotNull())
    return numbered(fine, [key, order], "_number").select(F.lit(0).alias(key), F.col("_number").alias(order), value)


def blocked(df: DataFrame, block: int, key: str = KEY, value: str = VALUE, order: str = ORDER) -> DataFrame:
    """The rows of trajectories with a key and a value, each with the number of its block and its position there; written once, for any number of models."""
    fine = df.where(F.col(key).isNotNull() & F.col(value).isNotNull())
    counted = running_within(dealt(fine, [key, order]), key, [key, order], {POSITION: F.lit(1).cast("long")}).drop(PART)
    return written(counted.withColumn("_block", F.floor(F.col(POSITION) / block)).withColumn(POSITION, (F.col(POSITION) % block + 1).cast("int")))


def in_blocks(df: DataFrame, model: Hmm, block: int, key: str = KEY, value: str = VALUE, order: str = ORDER) -> DataFrame:
    """The rows of trajectories with a key and a value in blocks of ``block`` rows, with what each has to know of the others (TOLD).

    A block is a matrix of log-weights from every state before it to every state at its end, once summed over all paths and
    once for the best path. A scan over a trajectory's matrices, a row a block, forwards and then backwards, tells how each
    block is entered and left; blocks are then independent, and no task holds more than some of them. Rows that come from
    ``blocked`` are taken as they are.
    """
    k = len(model.means)
    kind = next(f.dataType.simpleString() for f in df.schema if f.name == key)
    rows = df if {"_block", POSITION} <= set(df.columns) else blocked(df, block, key, value, order)
    own = [key, "_block"]

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, first in trajectories(batches):
            starts = table.take(pa.array(first[:-1]))
            begins = starts.column("_block").to_numpy() == 0
            sums, bests = transfers(table.column(value).to_numpy().astype(float), first, begins, model.start, model.move, model.means, model.variances)
            yield from pa.Table.from_arrays([starts.column(key), starts.column("_block"), _lists(sums), _lists(bests)], names=["key", "block", "sums", "bests"]).to_batches()

    def forwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, f, v = None, None, None
        for batch in batches:
            sums, bests = _numbers(batch, "sums", k, k), _numbers(batch, "bests", k, k)
            before, paths = np.full((len(sums), k), np.nan), np.full((len(sums), k), np.nan)
            for i, name in enumerate(batch.column(0).to_pylist()):
                if name != now:  # any state leads into the first block
                    now, f, v = name, sums[i, 0], bests[i, 0]
                    continue
                before[i], paths[i] = f, v
                f, v = log_sum(f[:, None] + sums[i], 0), (v[:, None] + bests[i]).max(axis=0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(before), _lists(paths), *(batch.column(c) for c in (2, 3))], names=["key", "block", "before", "paths", "sums", "bests"])

    def backwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, r, at, score = None, None, 0, 0.0
        for batch in batches:
            before, paths, sums, bests = _numbers(batch, "before", k), _numbers(batch, "paths", k), _numbers(batch, "sums", k, k), _numbers(batch, "bests", k, k)
            behind, ends, scores = np.zeros((len(sums), k)), np.zeros(len(sums), np.int32), np.zeros(len(sums))
            for i, name in enumerate(batch.column(0).to_pylist()):
                if name != now:
                    last = bests[i, 0] if np.isnan(paths[i, 0]) else (paths[i][:, None] + bests[i]).max(axis=0)
                    now, r, at, score = name, np.zeros(k), int(last.argmax()), float(last.max())
                behind[i], ends[i], scores[i] = r, at, score
                r, at = log_sum(sums[i] + r, 1), int((paths[i] + bests[i][:, at]).argmax())
            told = [_lists(before), _lists(behind), _lists(paths), pa.array(ends), pa.array(scores)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *told], names=[*own, *TOLD])

    light = rows.select(*own, POSITION, value).repartition(*own).sortWithinPartitions(*own, POSITION)
    blocks = light.mapInArrow(matrices, f"key {kind}, block long, sums array<double>, bests array<double>").repartition("key").sortWithinPartitions("key", "block")
    entered = written(blocks.mapInArrow(forwards, f"key {kind}, block long, before array<double>, paths array<double>, sums array<double>, bests array<double>"))
    left = entered.repartition("key").sortWithinPartitions("key", F.desc("block")).mapInArrow(backwards, f"`{key}` {kind}, _block long, " + ", ".join(f"{n} {t}" for n, t in TOLD.items()))
    return rows.join(left, own).repartition(*own).sortWithinPartitions(*own, POSITION)


def _told(rows: pa.Table, first: np.ndarray, k: int) -> dict[str, np.ndarray]:
    """What the blocks of a table know of the others; nothing where sequences are whole."""
    if "_before" not in rows.column_names:
        return {}
    starts = rows.select(list(TOLD)).take(pa.array(first[:-1]))
    return {n: _numbers(starts, n, k) for n in ("_before", "_behind", "_paths")} | {n: starts.column(n).to_numpy() for n in ("_ends", "_score")}


def expectations(df: DataFrame, model: Hmm, key: str = KEY, value: str = VALUE, order: str = ORDER, block: int | None = None) -> DataFrame:
    """Sufficient statistics over all trajectories: name, i, j, v (sums of a row set of fixed size). ``block``: by blocks of so many rows (``in_blocks``)."""
    k = len(model.means)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter = Counter()
        for rows, first in trajectories(batches):
            x = rows.column(value).to_numpy().astype(float)
            told = _told(rows, first, k)
            gamma, moves, total = forward_backward(x, first, model.start, model.move, model.means, model.variances, told.get("_before"), told.get("_behind"))
            begins = np.isnan(told["_before"][:, 0]) if told else np.ones(len(total), bool)
            sums["logl", 0, 0] += total[begins].sum()
            for i in range(k):
                for name, v in (("start", gamma[first[:-1][begins], i]), ("w", gamma[:, i]), ("x", gamma[:, i] * x), ("xx", gamma[:, i] * x * x)):
                    sums[name, i, 0] += v.sum()
                for j in range(k):
                    sums["move", i, j] += moves[:, i, j].sum()
        if sums:
            name, i, j = zip(*sums, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([float(v) for v in sums.values()])], names=["name", "i", "j", "v"])

    rows = prepared(df, key, value, order) if block is None else in_blocks(df, model, block, key, value, order)
    return rows.mapInArrow(run, "name string, i int, j int, v double").groupBy("name", "i", "j").agg(F.sum("v").alias("v"))


def prepared(df: DataFrame, key: str = KEY, value: str = VALUE, order: str = ORDER) -> DataFrame:
    """The rows of trajectories with a key and a value, dealt by trajectory and in order."""
    return df if POSITION in df.columns else placed(df.where(F.col(key).isNotNull() & F.col(value).isNotNull()), key, order)


def train_hmm(df: DataFrame, model: Hmm, rounds: int = 50, tolerance: float = 1e-2, update: str = "stmc", least: float = 1e-6, key: str = KEY, value: str = VALUE, order: str = ORDER, block: int | None = None, fraction: float = 1.0, seed: int = 0, reach: float | None = None, legacy: bool = False) -> tuple[Hmm, float]:
    """Expectation maximisation: the sums of a round reach the driver, never the rows. ``update``: of start, moves (t), means, covariances.

    Trajectories are sequences of their own. Ends when the log-likelihood gains less than ``tolerance``. To train anew from a
    model, give it with the letters that may change. ``block``: long trajectories by blocks of so many rows, cut once for
    all rounds. ``fraction``: of that share of the trajectories alone (``sample_groups``, ``seed``). ``reach``: ends as soon
    as the log-likelihood is so high, too. ``legacy``: on all trajectories as one sequence (``concatenated``), in blocks, so
    that the end of one leads into the start of the next. Without any rows the model is returned as it came.
    """
    df = df.select(key, order, value)
    if fraction < 1:
        df = sample_groups(df, fraction, seed, key)
    if legacy:
        df, block = concatenated(df, key, value, order), block or BLOCK
    df = prepared(df, key, value, order).cache() if block is None else blocked(df, block, key, value, order)
    k, last = len(model.means), -np.inf
    try:
        for _ in range(rounds):
            got = {n: np.zeros((k, k)) for n in ("logl", "start", "w", "x", "xx", "move")}
            for name, i, j, v in expectations(df, model, key, value, order, block).collect():
                got[name][i, j] = v
            total, w = got["logl"][0, 0], np.maximum(got["w"][:, 0], 1e-12)
            if not got["w"].any():
                return model, 0.0
            if not np.isfinite(total) or total - last < tolerance or (reach is not None and total >= reach):
                return model.by_mean(), float(total)
            last, means = total, got["x"][:, 0] / w
            used = means if "m" in update else model.means
            spread = got["xx"][:, 0] / w - 2 * used * got["x"][:, 0] / w + used**2
            rows = got["move"].sum(axis=1, keepdims=True)
            move = np.where(rows > 0, got["move"] / np.maximum(rows, 1e-12), model.move)
            starts = got["start"][:, 0] / max(got["start"][:, 0].sum(), 1e-12)
            model = replace(model, start=starts if "s" in update else model.start, move=move if "t" in update else model.move, means=used, variances=np.maximum(spread, least) if "c" in update else model.variances)
        return model.by_mean(), float(last)
    finally:
        df.unpersist()


#: A table of models: a row for each state of each trajectory's model.
MODELS = "state int, start double, mean double, variance double, moves array<double>, logl double, rounds int, settled boolean"


def fit_models(df: DataFrame, model: Hmm, rounds: int = 50, tolerance: float = 1e-2, update: str = "stmc", least: float = 1e-6, key: str = KEY, value: str = VALUE, order: str = ORDER) -> DataFrame:
    """A model for each trajectory, all from the same first one: key, state (by mean), start, mean, variance, moves, logl, rounds, settled.

    The trajectories of a task are fitted side by side, each until its own log-likelihood, which is returned for its last
    model, gains less than ``tolerance``. ``update`` as in training. Rows without a key or value are left out; a trajectory of
    one row has no moves to learn from and keeps those it is given.
    """
    k = len(model.means)
    kind = next(f.dataType.simpleString() for f in df.schema if f.name == key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, first in trajectories(batches):
            x = rows.column(value).to_numpy().astype(float)
            start, move, means, variances, logl, took, settled = fit_each(x, first, model.start, model.move, model.means, model.variances, rounds, tolerance, update, least)
            by = np.argsort(means, axis=1, kind="stable")
            n = np.arange(len(by))[:, None]
            moves = move[n[:, :, None], by[:, :, None], by[:, None, :]]
            keys = rows.column(key).take(pa.array(np.repeat(first[:-1], k)))
            columns = [pa.array(np.tile(np.arange(k, dtype=np.int32), len(by))), *(pa.array(v[n, by].ravel()) for v in (start, means, variances)), _lists(moves.reshape(-1, k)), *(pa.array(np.repeat(v, k)) for v in (logl, took.astype(np.int32), settled))]
            yield from pa.Table.from_arrays([keys, *columns], names=[key, *(c.split()[0] for c in MODELS.split(", "))]).to_batches()

    return prepared(df.select(key, order, value), key, value, order).mapInArrow(run, f"`{key}` {kind}, {MODELS}")


def decode(df: DataFrame, model: Hmm | DataFrame, key: str = KEY, value: str = VALUE, order: str = ORDER, block: int | None = None, states: int = 2) -> DataFrame:
    """``fit`` (likeliest path), ``fit_score`` (its log-probability), ``posterior_0``, ``posterior_1``, ..., ``fit_posterior`` (that of state 1).

    All columns of a row pass through, in one pass over its trajectory, so rows of equal order stay as many as they are;
    their order among themselves is open. Rows without a key or value are left out. ``model`` can be a table of models
    (``fit_models``) of ``states`` states each, which trajectories meet by their key; those without a model are left out.
    ``block``: by blocks of so many rows, for trajectories that are too long for a task.
    """
    table = isinstance(model, DataFrame)
    if table and block is not None:
        raise ValueError("blocks are for one model")
    k = states if table else len(model.means)
    names = [f"posterior_{i}" for i in range(k)]
    parameters = ["_start", "_moves", "_means", "_variances"]
    one = None if table else [model.start, model.move, model.means, model.variances]
    rest = df.drop("fit", "fit_score", *names, "fit_posterior")
    kept = [c for c in rest.columns if c != POSITION]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, first in trajectories(batches):
            x = rows.column(value).to_numpy().astype(float)
            told = _told(rows, first, k)
            p = one
            if table:
                starts = rows.select(parameters).take(pa.array(first[:-1]))
                p = [_numbers(starts, n, *((k, k) if n == "_moves" else (k,))) for n in parameters]
            path, score = viterbi(x, first, *p, told.get("_paths"), told.get("_ends"))
            gamma, _, _ = forward_backward(x, first, *p, told.get("_before"), told.get("_behind"))
            more = [path.astype(np.int32), np.repeat(told.get("_score", score), np.diff(first)), *gamma.T, gamma[:, min(1, k - 1)]]
            rows = rows.select(kept)
            for name, v in zip(["fit", "fit_score", *names, "fit_posterior"], more, strict=True):
                rows = rows.append_column(name, pa.array(np.ascontiguousarray(v)))
            yield from rows.to_batches()

    schema = StructType([*(f for f in rest.schema.fields if f.name != POSITION), StructField("fit", IntegerType()), *(StructField(n, DoubleType()) for n in ("fit_score", *names, "fit_posterior"))])
    if table:
        of = model.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("state", "start", "mean", "variance", "moves"))).alias("_m"))
        arrays = of.select(key, *[F.col(f"_m.{c}").alias(n) for n, c in (("_start", "start"), ("_means", "mean"), ("_variances", "variance"))], F.flatten("_m.moves").alias("_moves"))
        rows = prepared(rest.join(arrays, key), key, value, order)
    else:
        rows = prepared(rest, key, value, order) if block is None else in_blocks(rest, model, block, key, value, order)
    return rows.mapInArrow(run, schema)


def stationary(model: Hmm) -> np.ndarray:
    """The moves' stationary distribution."""
    k = len(model.means)
    return np.linalg.lstsq(np.vstack([model.move.T - np.eye(k), np.ones(k)]), np.append(np.zeros(k), 1.0), rcond=None)[0]


def signal_to_noise(model: Hmm) -> float:
    s = np.sqrt(model.variances)
    return float(abs(model.means[1] - model.means[0]) / (0.5 * (s[0] + s[1])))


def mixture(df: DataFrame, model: Hmm, value: str = VALUE, places: int = 1000) -> DataFrame:
    """state, x, density: each state's density by its stationary weight (rounded to thousandths), at places over the range of the values."""
    weights = np.round(stationary(model), 3)
    span = df.agg((F.min(value) - 1).alias("low"), (F.max(value) + 1).alias("high"))
    x = F.col("low") + (F.col("high") - F.col("low")) * F.col("k") / (places - 1)
    at = span.select("low", "high", F.explode(F.sequence(F.lit(0), F.lit(places - 1))).alias("k")).select("k", x.alias("x"))
    each = F.array(*[F.struct(F.lit(i).alias("state"), normal_density(F.col("x"), m, v**0.5, w).alias("density")) for i, (m, v, w) in enumerate(zip(model.means, model.variances, weights, strict=True))])
    return at.select("k", "x", F.inline(each))
