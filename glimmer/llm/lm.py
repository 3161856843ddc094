"""LM scoring: a log-bilinear neural model, trained in numpy with noise-contrastive estimation.

Units. The HEAD most frequent words of the training folds and the end of a text are units of their own. All other words
fall into TAILS units by their last and first letters, and a tail word's probability is its unit's times its share of the
unit's training tokens, add-half smoothed with one unseen word a unit. So every text has a probability, and the counts
behind it cover the whole corpus.

Model. The vectors of the last CONTEXT units, each weighted elementwise by its place, and the mean of the WINDOW before
them, weighted likewise, predict a vector; its products with the units' vectors plus biases are logits. Units stand in classes of equal
size, so the probability of a unit is that of its class times that within the class: two small softmaxes, worked out by
batched matrix products. Both are trained with noise-contrastive estimation, noise drawn from the unigram counts. All
training texts are learnt from, each once, in TURNS parts: in each, tasks go on from the shared model over their own texts,
and the means of their parameters, weighted by tokens, are the next shared model. The classes come from the company that
units keep in all training texts.

Texts are read twice: for the counts of words, and to be turned into units, from which the model learns and scores them.
Counts of all words are too many to broadcast. Tasks hold the counts of the COUNTED most frequent words, which also are
the ones that a join would heap up; the counts of the others come by a join on the word.
"""

from __future__ import annotations

from collections.abc import Iterator
from copy import deepcopy
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glimmer.llm.common import crc_remainder, cut, mix, one_thread, ragged, sliced, table, without

#: Words that are units (a bound on what is broadcast), units of the other words, classes.
HEAD, TAILS, CLASSES = 3000, 512, 60
#: Words whose counts are broadcast, at most.
COUNTED = 400_000
#: Vector size, places of context, length of the older context, noise samples, tokens that are scored at once and those whose classes are: a block's logits stay in a core's cache.
SIZE, CONTEXT, WINDOW, NOISE, CHUNK, BLOCK = 32, 2, 24, 24, 8192, 1024
#: Parts that all training texts are learnt from in, the learning rate of the first (it falls by the root of their number), tokens of a step.
TURNS, RATE, STEP_TOKENS = 4, 0.1, 5000
#: Steps by which counts double, in the histogram that finds the frequent words.
OCTAVE = 8
#: Frequent units whose company tells classes apart; blocks and groups of tasks that tables of numbers are added up in.
COMPANY, BLOCKS, GROUPS = 64, 64, 64


def tokens(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts of a column, one after the other, and where each text's words start (and end)."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(column, "")))
    first = np.asarray(parts.offsets).astype(np.int64)
    flat = parts.flatten()
    full = np.asarray(pc.not_equal(pc.binary_length(flat), 0).cast(pa.uint8())).astype(bool)
    kept = np.concatenate([[0], np.cumsum(full)])
    return flat.filter(pa.array(full)), kept[first - first[0]]


def tail_units(words: pa.Array | list[str]) -> np.ndarray:
    """Which tail unit each word is: by its last two letters and first one, so that words of a language meet."""
    words = pa.array(words, pa.string()) if isinstance(words, list) else words
    bare = pc.utf8_rtrim(words, characters=".,;:!?")
    bare = pc.if_else(pc.equal(pc.binary_length(bare), 0), words, bare)
    ends = pc.binary_join_element_wise(pc.utf8_slice_codeunits(bare, -2), pc.utf8_slice_codeunits(words, 0, 1), "|").dictionary_encode()
    each = ends.dictionary.to_pylist()
    keys = np.fromiter((int.from_bytes(e.encode()[:8].ljust(8, b"\0"), "little") for e in each), np.uint64, len(each))
    return (mix(keys + np.uint64(977)) % np.uint64(TAILS)).astype(np.int64)[np.asarray(ends.indices)]


def places(words: pa.Array, known: pa.Array) -> np.ndarray:
    """Where each word stands among known ones; -1 if it doesn't."""
    return np.asarray(pc.fill_null(pc.index_in(words, value_set=known), -1)).astype(np.int64)


@dataclass
class Model:
    """``units``: head word to unit; unit 0 is the end, then the head words, then the tails, then padding to whole classes."""

    units: dict[str, int]
    order: np.ndarray  # unit to its place in the classes: class * width + place within
    vectors: np.ndarray  # of units as context
    places: np.ndarray  # weights of the context places
    class_out: np.ndarray
    class_bias: np.ndarray
    unit_out: np.ndarray  # by place in the classes
    unit_bias: np.ndarray
    alive: np.ndarray  # places that hold a unit

    @property
    def width(self) -> int:
        return len(self.unit_out) // len(self.class_out)


def window_sums(rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each token of texts (``first`` their bounds) the sum of the rows CONTEXT + 1 to CONTEXT + WINDOW before it in its text."""
    n, run, width, total, covered = len(rows), rows, 1, None, 0
    while True:  # sums of 1, 2, 4 ... rows make up the window, wherever texts begin
        if WINDOW & width:
            if total is None:
                total = run.copy()
            else:
                total[covered:] += run[: max(0, n - covered)]
            covered += width
        if 2 * width > WINDOW:
            break
        twice = np.empty_like(run)
        twice[:width] = run[:width]
        np.add(run[width:], run[: max(0, n - width)], out=twice[width:])
        run, width = twice, 2 * width
    out = np.zeros_like(total)
    out[CONTEXT + 1 :] = total[: max(0, n - CONTEXT - 1)]
    # the first tokens of a text have what there is of it
    start, size = first[:-1, None], np.diff(first)[:, None]
    ahead = np.cumsum(rows[np.minimum(start + np.arange(WINDOW - 1), n - 1)], axis=1)
    place = np.arange(CONTEXT + WINDOW)
    inside = place < size
    fixed = np.zeros((len(size), len(place), rows.shape[1]), rows.dtype)
    fixed[:, CONTEXT + 1 :] = ahead
    out[(start + place)[inside]] = fixed[inside]
    return out


def contexts(model: Model, units: np.ndarray, first: np.ndarray, vectors: np.ndarray | None = None) -> np.ndarray:
    """The predicted vector at each token of texts (units with an end each, ``first`` their bounds); ``vectors``: those of the units, where they are known."""
    n, vectors = len(units), model.vectors[units] if vectors is None else vectors
    out = window_sums(vectors, first)
    out *= model.places[CONTEXT] / WINDOW
    starts = first[:-1]
    for k in range(CONTEXT):
        before = vectors[: max(0, n - k - 1)] * model.places[k]
        # what stands before a text isn't its own
        other = (starts[:, None] + np.arange(-k - 1, 0)).ravel()
        before[other[(other >= 0) & (other < len(before))]] = 0
        out[k + 1 :] += before
    return out


def log10_units(model: Model, units: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The normalised log10 probability of each unit given those before it in its text."""
    n, width = len(units), model.width
    out = np.zeros(n)
    at = model.order[units]
    class_out = np.ascontiguousarray(model.class_out.T)
    inner_out = np.ascontiguousarray(model.unit_out.reshape(-1, width, SIZE).transpose(0, 2, 1))
    inner_bias = model.unit_bias.reshape(-1, width)
    ones, inner_ones = np.ones(CLASSES, np.float32), np.ones(width, np.float32)
    for low in range(0, n, CHUNK):
        # a chunk takes along what precedes it in its first text
        high = min(n, low + CHUNK)
        begin = max(first[np.searchsorted(first, low, "right") - 1], low - CONTEXT - WINDOW - 1)
        bounds = np.unique(np.clip(np.concatenate([[begin, high], first]), begin, high))
        h = contexts(model, units[begin:high], bounds - begin)[low - begin :]
        own, inside = np.divmod(at[low:high], width)
        rows = np.arange(high - low)
        # logits are kept where their exponentials are finite, so the largest needn't be sought
        chunk = np.empty(high - low, np.float32)
        for a in range(0, high - low, BLOCK):
            b = min(a + BLOCK, high - low)
            logits = h[a:b] @ class_out
            logits += model.class_bias
            np.clip(logits, -80, 80, out=logits)
            chunk[a:b] = logits[rows[: b - a], own[a:b]]
            chunk[a:b] -= np.log(np.exp(logits, out=logits) @ ones)
        by = np.argsort(own.astype(np.uint16), kind="stable")  # sorting by 16 bits takes a few passes
        edges = np.searchsorted(own[by], np.arange(CLASSES + 1))
        h, inside, inner = h[by], inside[by], np.empty(high - low, np.float32)
        for c in np.flatnonzero(np.diff(edges)).tolist():
            a, b = edges[c], edges[c + 1]
            logits = h[a:b] @ inner_out[c]
            logits += inner_bias[c]
            np.minimum(logits, 80, out=logits)
            inner[a:b] = logits[rows[: b - a], inside[a:b]]
            inner[a:b] -= np.log(np.exp(logits, out=logits) @ inner_ones)
        chunk[by] += inner
        out[low:high] = chunk
    return out / np.log(10)


_LEARNT = ("vectors", "places", "class_out", "class_bias", "unit_out", "unit_bias")


@dataclass
class Fit:
    """A model, its sums of squared gradients, and the noise: classes, and units within them by their places."""

    model: Model
    past: dict[str, np.ndarray]
    class_p: np.ndarray
    inner_p: np.ndarray
    inner_noise: np.ndarray  # cumulative, class c from c to c + 1

    def step(self, name: str, rows, gradient: np.ndarray, rate: float) -> None:
        """AdaGrad on some rows (``rows``: their numbers, each once) or all."""
        target, past = getattr(self.model, name), self.past[name]
        rows = slice(None) if rows is None else rows
        now = past[rows] + np.square(gradient)
        past[rows] = now
        gradient = gradient * np.float32(rate)
        gradient /= np.sqrt(now, out=now)
        target[rows] += gradient

    def learn(self, units: np.ndarray, first: np.ndarray, rate: float, rng: np.random.Generator) -> None:
        """One step over texts (units, ``first`` their bounds)."""
        model, width = self.model, self.model.width
        vectors = model.vectors[units]
        h = contexts(model, units, first, vectors)
        # sorted by place, tokens of a class are neighbours, and so are those of a unit
        place = model.order[units]
        by = np.argsort(place.astype(np.uint16), kind="stable")  # HEAD + TAILS fit
        place, h = place[by], h[by]
        starts = np.flatnonzero(np.diff(place, prepend=-1))
        rows, classes = place[starts], place // width
        # classes against noise, units against noise that all tokens of their class share: the logit of data is the model's minus log(NOISE * noise probability)
        noise = np.searchsorted(np.cumsum(self.class_p), rng.random(NOISE) * self.class_p.sum()).clip(max=CLASSES - 1)
        edges = np.searchsorted(classes, np.arange(CLASSES + 1))
        full = np.flatnonzero(np.diff(edges))
        drawn = np.searchsorted(self.inner_noise, full[:, None] + rng.random((len(full), NOISE)), "right").clip(full[:, None] * width, full[:, None] * width + width - 1)
        class_bias = model.class_bias - np.log(NOISE * self.class_p).astype(np.float32)
        out, bias = model.unit_out, model.unit_bias - np.log(NOISE * np.maximum(self.inner_p, 1e-12)).astype(np.float32)
        # what a class's tokens are compared with: units drawn, classes drawn, the class; noise stands negated, so that its logits are to rise as data's are
        against, levels = np.empty((len(full), 2 * NOISE + 1, SIZE), np.float32), np.empty((len(full), 2 * NOISE + 1), np.float32)
        for at, vector, level in ((slice(NOISE), out[drawn], bias[drawn]), (slice(NOISE, -1), model.class_out[noise], class_bias[noise])):
            np.negative(vector, out=against[:, at])
            np.negative(level, out=levels[:, at])
        against[:, -1], levels[:, -1] = model.class_out[full], class_bias[full]
        back, grads, biases, ones = np.empty_like(h), np.empty_like(against), np.empty_like(levels), np.ones(len(h), np.float32)
        for k, (a, b) in enumerate(zip(edges[full].tolist(), edges[full + 1].tolist(), strict=True)):
            own, theirs = h[a:b], against[k]
            logits = own @ theirs.T
            logits += levels[k]
            pulls = _pull(logits)
            np.matmul(pulls, theirs, out=back[a:b])
            np.matmul(pulls.T, own, out=grads[k])
            np.matmul(ones[: b - a], pulls, out=biases[k])
        np.negative(grads[:, :-1], out=grads[:, :-1])
        np.negative(biases[:, :-1], out=biases[:, :-1])
        class_grads, class_biases = np.zeros_like(model.class_out), np.zeros(CLASSES, np.float32)
        class_grads[full], class_biases[full] = grads[:, -1], biases[:, -1]
        np.add.at(class_grads, noise, grads[:, NOISE:-1].sum(axis=0))
        np.add.at(class_biases, noise, biases[:, NOISE:-1].sum(axis=0))
        self.step("class_out", None, class_grads, rate)
        self.step("class_bias", None, class_biases, rate)
        theirs = out[place]
        good = _pull(np.einsum("nd,nd->n", h, theirs) + bias[place])
        theirs *= good[:, None]
        back += theirs
        pulled = np.multiply(h, good[:, None], out=theirs)
        grads, biases = [np.add.reduceat(pulled, starts, axis=0), grads[:, :NOISE].reshape(-1, SIZE)], [np.add.reduceat(good, starts), biases[:, :NOISE].ravel()]
        each, grads, biases = np.concatenate([rows, drawn.ravel()]), np.concatenate(grads), np.concatenate(biases)
        mixed = np.argsort(each, kind="stable")
        edge = np.flatnonzero(np.diff(each[mixed], prepend=-1))
        self.step("unit_out", each[mixed][edge], np.add.reduceat(grads[mixed], edge, axis=0), rate)
        self.step("unit_bias", each[mixed][edge], np.add.reduceat(biases[mixed], edge), rate)
        turned = pulled  # its room is free by now
        turned[by] = back
        vectors, places = _descend(model, first, vectors, turned)
        self.step("vectors", units[by][starts], np.add.reduceat(vectors[by], starts, axis=0), rate)
        self.step("places", None, places, rate)

    def packed(self) -> np.ndarray:
        return np.concatenate([v.ravel() for k in _LEARNT for v in (getattr(self.model, k), self.past[k])])

    def unpack(self, flat: np.ndarray) -> None:
        at = 0
        for k in _LEARNT:
            for v in (getattr(self.model, k), self.past[k]):
                v[...] = flat[at : at + v.size].reshape(v.shape)
                at += v.size


def unit_counts(head: list[tuple[str, int]], tails: np.ndarray, end: int) -> np.ndarray:
    return np.concatenate([[max(end, 1)], [c for _, c in head], tails + 0.5]).astype(float)


def begin(head: list[tuple[str, int]], tails: np.ndarray, end: int, seen: np.ndarray, seed: int = 11) -> Fit:
    """A fit to no texts yet, from counts of head words, tail units and ends, and the units' company."""
    rng = np.random.default_rng(seed)
    counts = unit_counts(head, tails, end)
    n = len(counts)
    width = -(-n // CLASSES)
    # classes of neighbours by frequency would make the classes useless; units of one class share their usual neighbours' language
    order = np.empty(n, np.int64)
    order[_grouped(seen, counts)] = np.arange(n)
    slots = CLASSES * width
    alive = np.zeros(slots, bool)
    alive[order] = True
    unigram = np.zeros(slots)
    unigram[order] = counts
    by_class = unigram.reshape(CLASSES, width)
    class_p = np.maximum(by_class.sum(axis=1), 1e-9)
    class_p /= class_p.sum()
    inner_p = np.where(alive.reshape(CLASSES, width), np.maximum(by_class, 1e-9), 0)
    inner_p /= np.maximum(inner_p.sum(axis=1, keepdims=True), 1e-9)
    with np.errstate(divide="ignore"):
        unit_bias = np.where(alive, np.log(np.maximum(inner_p.ravel(), 1e-12)), -1e9).astype(np.float32)
    model = Model({w: k + 1 for k, (w, _) in enumerate(head)}, order, rng.normal(0, 0.1, (n, SIZE)).astype(np.float32), np.ones((CONTEXT + 1, SIZE), np.float32), np.zeros((CLASSES, SIZE), np.float32), np.log(class_p).astype(np.float32), np.zeros((slots, SIZE), np.float32), unit_bias, alive)
    inner_noise = np.minimum(np.cumsum(inner_p, axis=1), 1.0)
    inner_noise[:, -1] = 1.0
    return Fit(model, {k: np.full_like(getattr(model, k), 1e-6) for k in _LEARNT}, class_p, inner_p.ravel(), (inner_noise + np.arange(CLASSES)[:, None]).ravel())


def rate(turn: int) -> float:
    return RATE / (1 + turn) ** 0.5


def train(head: list[tuple[str, int]], tails: np.ndarray, end: int, texts: list[np.ndarray], seed: int = 11) -> Model:
    """From counts of head words, tail units and ends, and texts as arrays of units, all in one place."""
    fit, rng = begin(head, tails, end, company(texts, unit_counts(head, tails, end)), seed), np.random.default_rng(seed)
    for turn in range(TURNS):
        part = texts[turn::TURNS]
        if part:
            for units, first in pieces(np.concatenate(part), np.concatenate([[0], np.cumsum([len(t) for t in part])])):
                fit.learn(units, first, rate(turn), rng)
    return fit.model


def company(texts: Iterator[np.ndarray] | list[np.ndarray], counts: np.ndarray) -> np.ndarray:
    """For each unit, the shares of the COMPANY most frequent ones in its texts, added up over its tokens."""
    most = np.argsort(-counts, kind="stable")[:COMPANY]
    column = np.full(len(counts), -1)
    column[most] = np.arange(len(most))
    seen = np.zeros((len(counts), len(most)), np.float32)
    for t in texts:
        c = column[t]
        profile = np.bincount(c[c >= 0], minlength=len(most))
        units, times = np.unique(t, return_counts=True)
        seen[units] += times[:, None].astype(np.float32) * (profile / max(1.0, profile.sum())).astype(np.float32)
    return seen


def _grouped(seen: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Units in an order in which neighbours keep like company: by the leading direction of their co-occurrence in texts, the frequent ones dealt out evenly first."""
    if not seen.any():
        return np.arange(len(counts))
    seen = np.sqrt(seen / np.maximum(seen.sum(axis=1, keepdims=True), 1e-6))
    seen -= seen.mean(axis=0)
    _, vectors = np.linalg.eigh(seen.T @ seen)
    low = seen @ vectors[:, -3:]
    # halves by one direction after the other: three bits, then by frequency
    bits = (low > np.median(low, axis=0)).astype(int) @ np.array([1, 2, 4])
    return np.lexsort((-counts, bits))


def _lists(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The units of all texts of a batch, and the texts' bounds."""
    column = batch.column(0)
    first = np.asarray(column.offsets).astype(np.int64)
    return np.asarray(column.flatten()).astype(np.int64), first - first[0]


def pieces(units: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All units in steps of STEP_TOKENS at most, a longer text in several pieces: units and bounds of each step."""
    long = np.flatnonzero(np.diff(first) > STEP_TOKENS)
    bounds = np.unique(np.concatenate([first, *(np.arange(first[k], first[k + 1], STEP_TOKENS) for k in long)]))
    at = 0
    while at < len(bounds) - 1:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + STEP_TOKENS, "right")) - 1)
        yield units[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at]
        at = to


_SUMS = "part long, block int, weight double, v binary"


def _blocks(weight: float, flat: np.ndarray) -> pa.RecordBatch:
    """A task's table of numbers, in BLOCKS rows."""
    v = [x.astype(np.float32).tobytes() for x in np.array_split(flat, BLOCKS)]
    part = TaskContext.get().partitionId()
    return pa.RecordBatch.from_arrays([pa.array([part] * BLOCKS, pa.int64()), pa.array(range(BLOCKS), pa.int32()), pa.array([weight] * BLOCKS, pa.float64()), pa.array(v, pa.binary())], names=["part", "block", "weight", "v"])


def summed(tables: DataFrame) -> tuple[float, np.ndarray]:
    """The tasks' tables added up, GROUPS of tasks first; BLOCKS rows, one table, reach the driver."""

    def add(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("part")
        total = np.sum([np.frombuffer(v, np.float32) for v in rows.column("v").to_pylist()], axis=0, dtype=np.float64)
        part, block = rows.column("part")[0].as_py() % GROUPS, rows.column("block")[0].as_py()
        return pa.table([pa.array([part], pa.int64()), pa.array([block], pa.int32()), pa.array([pc.sum(rows.column("weight")).as_py()], pa.float64()), pa.array([total.astype(np.float32).tobytes()], pa.binary())], names=["part", "block", "weight", "v"])

    some = tables.groupBy("block", F.pmod("part", F.lit(GROUPS))).applyInArrow(add, _SUMS)
    got = sorted(some.groupBy("block").applyInArrow(add, _SUMS).collect(), key=lambda r: r["block"])
    return (got[0]["weight"], np.concatenate([np.frombuffer(r["v"], np.float32) for r in got])) if got else (0.0, np.zeros(0, np.float32))


def _pull(logits: np.ndarray) -> np.ndarray:
    """By how much data's logits are to rise (in place)."""
    np.minimum(logits, 80, out=logits)  # exponentials stay finite
    np.exp(logits, out=logits)
    logits += 1
    return np.reciprocal(logits, out=logits)


def _descend(model: Model, first: np.ndarray, vectors: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From the predicted vectors' gradients and the tokens' context vectors to the gradients of these and of the place weights."""
    n, weights, starts = len(back), np.zeros_like(model.places), first[:-1]
    # a token is in the windows of those CONTEXT + 1 to CONTEXT + WINDOW places on
    grads = window_sums(back[::-1], n - first[::-1])[::-1]
    grads /= WINDOW
    weights[CONTEXT] = np.einsum("nd,nd->d", grads, vectors)
    grads *= model.places[CONTEXT]
    for k in range(CONTEXT):
        later = back[k + 1 :].copy()
        other = (starts[:, None] + np.arange(-k - 1, 0)).ravel()
        later[other[(other >= 0) & (other < len(later))]] = 0
        weights[k] = np.einsum("nd,nd->d", later, vectors[: len(later)])
        grads[: len(later)] += np.multiply(later, model.places[k], out=later)
    return grads, weights / 100


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of words."""
    for batch in sliced(batches, "text", 8 << 20):
        words, _ = tokens(batch.column(1))
        got = words.value_counts()
        yield pa.RecordBatch.from_arrays([got.field("values"), got.field("counts").cast(pa.int64())], names=["word", "c"])


def fitted(encoded: DataFrame, head: list[tuple[str, int]], tails: np.ndarray, end: int, seed: int = 11) -> Fit:
    """A fit to all texts of ``encoded`` (doc_id, units)."""
    counts = unit_counts(head, tails, end)

    def _company(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (units[a:b] for units, first in map(_lists, batches) for a, b in zip(first[:-1], first[1:], strict=True))
        seen = company(each, counts)
        if seen.any():
            yield _blocks(1.0, seen.ravel())

    _, seen = summed(encoded.select("units").mapInArrow(_company, _SUMS))
    fit = begin(head, tails, end, seen.astype(float).reshape(len(counts), -1) if len(seen) else np.zeros((len(counts), 1)), seed)
    for turn in range(TURNS):
        shared = encoded.sparkSession.sparkContext.broadcast(fit)  # HEAD + TAILS vectors and outputs, and their past gradients

        def _learn(batches: Iterator[pa.RecordBatch], turn: int = turn, shared=shared) -> Iterator[pa.RecordBatch]:
            one_thread()
            own, n = deepcopy(shared.value), 0
            rng = np.random.default_rng([seed, turn, TaskContext.get().partitionId()])
            for batch in batches:
                for units, first in pieces(*_lists(batch)):
                    own.learn(units, first, rate(turn), rng)
                    n += len(units)
            if n:
                yield _blocks(float(n), own.packed() * n)

        n, total = summed(encoded.where(F.pmod(F.xxhash64("doc_id"), F.lit(TURNS)) == turn).select("units").mapInArrow(_learn, _SUMS))
        if n:
            fit = deepcopy(fit)
            fit.unpack(total / n)
    return fit


def frequent_words(counts: DataFrame) -> dict[str, int]:
    """Words (word, c) and their counts from some count on, COUNTED at most: a short histogram says from which, and only they are gathered.

    Where fewer than HEAD words lie above a step of counts that too many share, the first of that step, by count and then
    by name, make them HEAD.
    """
    step = F.floor(F.log2(F.col("c").cast("double")) * OCTAVE).cast("int")
    n, least, more = 0, None, False
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r["step"]):  # OCTAVE * 64 rows at most
        if n + r["n"] > COUNTED:
            more = True
            break
        n, least = n + r["n"], r["step"]
    rows = counts.where(step >= least).collect() if least is not None else []
    if more and n < HEAD:
        rest = counts if least is None else counts.where(step < least)
        rows += rest.orderBy(F.desc("c"), "word").limit(min(HEAD, COUNTED) - n).collect()
    return {r["word"]: r["c"] for r in rows}


def lm_scores(docs: DataFrame, modulus: int = 5, held: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, one row for each row.

    Texts whose id's crc32 modulo ``modulus`` is ``held`` are not learnt from. Words are lower-cased (A-Z) and split at
    ASCII white space; every text has one end more. Null and empty texts have the end alone; a null doc_id is scored and
    learnt from; repeated rows count as often as they stand. Without training texts every count is 0. Extra columns are
    ignored.
    """
    out = F.coalesce(crc_remainder(F.col("doc_id"), modulus) == held, F.lit(False))
    docs = without(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("held_out", out)
    learnt = docs.where("not held_out")
    counts = cut(learnt.select("doc_id", "text").mapInArrow(_counts, "word string, c long").groupBy("word").agg(F.sum("c").alias("c")))
    ends = learnt.count()
    whole = counts.agg(F.sum("c"), F.count(F.lit(1))).collect()[0]
    total, distinct = (whole[0] or 0) + ends, whole[1] + (ends > 0)
    counted = frequent_words(counts)
    head = sorted(counted.items(), key=lambda w: (-w[1], w[0]))[:HEAD]
    heads, listed = pa.array([w for w, _ in head], pa.string()), (pa.array(list(counted), pa.string()), np.array([*counted.values(), -1], np.int64))

    def _tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Tokens and words of each tail unit, summed over a task."""
        sums = np.zeros((2, TAILS), np.int64)
        for batch in batches:
            tail, c = places(batch.column(0), heads) < 0, batch.column(1).to_numpy()
            units = tail_units(batch.column(0))[tail]
            sums[0] += np.bincount(units, c[tail], TAILS).astype(np.int64)
            sums[1] += np.bincount(units, minlength=TAILS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(TAILS)), pa.array(sums[0]), pa.array(sums[1])], names=["unit", "n", "v"])

    tails = np.zeros((2, TAILS), np.int64)
    for unit, n, v in counts.mapInArrow(_tails, "unit long, n long, v long").groupBy("unit").agg(F.sum("n"), F.sum("v")).collect():  # TAILS rows
        tails[:, unit] = n, v
    spark = docs.sparkSession
    frequent = spark.sparkContext.broadcast(listed)  # COUNTED words and their counts
    all_log, end_log = np.log10(total + 0.5 * (distinct + 1)), np.log10(ends + 0.5)

    def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text, its units and all that needs no join; then a row for each of its words whose count isn't here."""
        row = TaskContext.get().partitionId() << 40
        for batch in sliced(batches, "text", 4 << 20):
            words, first = tokens(batch.column(2))
            coded = words.dictionary_encode()
            names, codes = coded.dictionary, np.asarray(coded.indices).astype(np.int64)
            unit = places(names, heads)
            unit = np.where(unit >= 0, unit + 1, len(heads) + 1 + tail_units(names))
            bounds, n, m = first + np.arange(len(first)), len(first) - 1, len(names)
            units, code = np.zeros(bounds[-1], np.int64), np.full(bounds[-1], -1, np.int64)
            to = ragged(bounds[:-1], np.diff(first))
            units[to], code[to] = unit[codes], codes
            of = np.repeat(np.arange(n), np.diff(bounds))
            c = frequent.value[1][places(names, frequent.value[0])]
            here = np.append(c >= 0, True)[code]
            log = np.append(np.log10(np.maximum(c, 0) + 0.5), end_log)[code] * here
            logs = np.bincount(of, log, n)
            # the logs of the counts count for tail words alone in the score, as head words are whole units
            tail_logs = np.bincount(of, log * (units > len(heads)), n)
            n_known = np.bincount(of, np.append(c > 0, ends > 0)[code], n).astype(np.int64)
            pairs, tf = np.unique(of[~here] * max(1, m) + code[~here], return_counts=True)
            doc, word = pairs // max(1, m), pairs % max(1, m)
            rows = row + np.arange(n)
            row += n
            size = np.diff(bounds)
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(units.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(rows), batch.column(0), batch.column(1), pa.array(size), pa.array(n_known), pa.array(logs - size * all_log), pa.array(tail_logs), lists, pa.nulls(n, pa.string()), pa.nulls(n, pa.int64())], names=_NAMES)
            k = len(doc)
            yield pa.RecordBatch.from_arrays([pa.array(rows[doc]), *(pa.nulls(k, t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int32()))), names.take(pa.array(word)), pa.array(tf, pa.int64())], names=_NAMES)

    encoded = cut(docs.select("doc_id", "held_out", "text").mapInArrow(_encode, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, tail double, units array<int>, word string, tf long"))
    whole = encoded.where("word is null")
    model = fitted(whole.where("not held_out").select("doc_id", "units"), head, tails[0], ends).model
    shared = spark.sparkContext.broadcast(model)  # HEAD + TAILS vectors
    # a tail word's share of its unit; head words and the end are units of their own
    unit_log = np.concatenate([np.zeros(1 + len(head)), np.log10(tails[0] + 0.5 * (tails[1] + 1))])

    def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                units, bounds = _lists(part.select(["units"]))
                each = np.add.reduceat(log10_units(shared.value, units, bounds) - unit_log[units], bounds[:-1])  # a text has its end at least
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(each)], names=[*_NAMES[:7], "score"])

    scored = whole.select(*_NAMES[:7], "units").mapInArrow(_score, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, tail double, score double")
    rare = encoded.where("word is not null").select("row", "word", "tf").join(counts, "word", "left")
    rare = rare.groupBy("row").agg(F.sum(F.col("tf") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("found"))
    both = scored.join(rare, "row", "left")
    more, found = F.coalesce("more", F.lit(0.0)), F.coalesce("found", F.lit(0))
    return both.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + found).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("score") + F.col("tail") + more).alias("score"))


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


_NAMES = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "tail", "units", "word", "tf"]
