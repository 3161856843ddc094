"""Toxicity: a subsequence string-kernel support vector machine with Nystrom landmarks.

The kernel of two windows (a word of a sentence with its borders, or letters that stand alone side by side) counts common
subsequences of four symbols, up to REACH symbols from first to last and weighted by DECAY for every symbol skipped, so
inserted characters cost likeness but don't hide a word; it is normalised by the windows' lengths.

The machine learns from the sentences of labelled documents. A label says of a toxic document only that one of its
windows is toxic, and of another one that none is, so learning takes turns: every toxic document names its most telling
window (at first by how much more often sentences of toxic documents have it, then by the machine itself), and the
machine is fitted to those, each as often as it is named, against windows of other documents, among them those it
scored highest before. Landmarks (some of these windows) map a window to a few hundred numbers. As the decision is linear
in a window's subsequences, the landmarks' weights fold into one table of a weight per subsequence, so every window of a
whole text is scored by table look-ups. A document's score is a logistic, fitted to the labels, of its second highest
window and of how far the highest lies beyond what nearly all other documents reach: a single window that only resembles
an insult is common, two in a text are not.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glimmer.llm.common import crc_remainder, cut, dropped, rows_where, sliced, table, tidy, without
from glimmer.llm.quality import labels_of

#: Labelled documents, toxic and other, that are learnt from, at most: those of the least hashed ids.
SAMPLE = (4000, 12000)
#: How many times more often sentences of toxic documents must have a window than others have, for a toxic document to name it, and so many sentences of the usual mix that each window is thought to have besides its own.
ODDS, USUAL = 4.0, 5.0
#: Named windows that are learnt from with characters inserted too, other windows a round, landmarks, rounds, at most.
INSERTED, OTHERS, LANDMARKS, ROUNDS = 100, 2000, 400, 4
REACH, DECAY, COST = 7, 0.5, 4.0
#: Subsequences that tables are dense over at once, and bytes of windows that are mapped at once: they bound the driver's memory.
WIDE, PART = 2048, 8192
#: Letters alone side by side, from so many on, are one window.
ALONE = 4
THRESHOLD = 0.5
#: Steps a unit that window scores are counted in to fit the logistic, and their bounds; the share of other documents that the highest window of one has to surpass to count.
STEPS, SPAN, REACHED = 10, 20, 0.99
#: Symbols: white space and marks (0), letters, digits (27), and letters of two bytes by their second byte (28 to 31); other bytes are left out.
_SYMBOLS = 32
_FOLD = np.zeros(256, np.int32)
_FOLD[65:91] = np.arange(1, 27)
_FOLD[97:123] = np.arange(1, 27)
_FOLD[48:58] = 27
_FOLD[128:192] = 28 + (np.arange(64) & 31) % 4
_SENTENCE = re.compile(r"[.!?]+\s|\n")
#: Distances from the last symbol of a subsequence back to the three before it.
_GAPS = [(a, b, c) for c in range(3, REACH) for b in range(2, c) for a in range(1, b)]


#: By the number of symbols; a shorter window than LEAST counts as one of LEAST, else few subsequences would weigh too much.
LEAST = 9
_EACH, _LOST = (sum(w * DECAY ** (2 * (g[2] - 3)) for w, g in pairs) for pairs in ([(1, g) for g in _GAPS], [(g[2], g) for g in _GAPS]))


def norms(sizes: np.ndarray) -> np.ndarray:
    """The length of a window's subsequence weights, if they were all different, by its number of symbols."""
    return np.sqrt(_EACH * np.maximum(sizes, LEAST) - _LOST)


def symbols(windows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The symbols of windows, a border on either side of each; the place of each in its window; where the windows start (and end)."""
    data = np.frombuffer(b" ".join([b"", *windows, b""]), np.uint8)
    sizes = np.fromiter(map(len, windows), np.int64, len(windows))
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    told = data < 192
    place = np.concatenate([[0], np.cumsum(told)])
    c = _FOLD[data[told]]
    # neighbours share a border: it is doubled
    first = place[starts]
    c = np.insert(c, first[1:-1], 0)
    first = first + np.arange(len(first)) - (np.arange(len(first)) == len(windows))
    first[-1] = len(c)
    return c, np.arange(len(c)) - np.repeat(first[:-1], np.diff(first)), first


def codes_at(c: np.ndarray, gaps: tuple[int, int, int]) -> np.ndarray:
    """Codes of the subsequences with these gaps, by their last symbols."""
    n = len(c)
    out = c[: n - gaps[2]]
    for g in (gaps[1], gaps[0], 0):
        out = out * _SYMBOLS + c[gaps[2] - g : n - g]
    return out


def subsequences(windows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window, code and normalised weight of every subsequence."""
    c, place, first = symbols(windows)
    of = np.repeat(np.arange(len(windows)), np.diff(first))
    scale = norms(np.diff(first))
    rows, codes, weights = [], [], []
    for gaps in _GAPS:
        if len(c) > gaps[2]:
            ok = place[gaps[2] :] >= gaps[2]
            rows.append(of[gaps[2] :][ok])
            codes.append(codes_at(c, gaps)[ok])
            weights.append(DECAY ** (gaps[2] - 3) / scale[rows[-1]])
    return np.concatenate(rows), np.concatenate(codes), np.concatenate(weights)


def decisions(windows: list[bytes], weights: np.ndarray, bias: float) -> np.ndarray:
    """The machine's decision on each window."""
    if not windows:
        return np.zeros(0)
    c, place, first = symbols(windows)
    each = np.zeros(len(c), np.float32)
    for gaps in _GAPS:
        if len(c) > gaps[2]:
            each[gaps[2] :] += np.float32(DECAY ** (gaps[2] - 3)) * weights[codes_at(c, gaps)] * (place[gaps[2] :] >= gaps[2])
    return np.add.reduceat(each, first[:-1], dtype=np.float64) / norms(np.diff(first)) + bias


#: A sparse table's rows, columns and numbers, by rising column.
_Triples = tuple[np.ndarray, np.ndarray, np.ndarray]


def _slice(triples: _Triples, low: int, high: int, n: int) -> np.ndarray | None:
    """Columns low to high of a table of n rows, dense; None if they are empty."""
    rows, at, weights = triples
    a, b = np.searchsorted(at, [low, high])
    return np.bincount(rows[a:b] * (high - low) + at[a:b] - low, weights[a:b], n * (high - low)).reshape(n, high - low) if b > a else None


def _kernel(left: _Triples, right: _Triples, n: int, m: int, wide: int) -> np.ndarray:
    """The products of two tables of n and m rows and ``wide`` columns, of which WIDE are dense at once."""
    out = np.zeros((n, m))
    for low in range(0, wide, WIDE):
        high = min(low + WIDE, wide)
        if (own := _slice(left, low, high, n)) is not None:
            out += own @ (own if left is right else _slice(right, low, high, m)).T
    return out


def landmarks_map(marks: list[bytes]) -> tuple[np.ndarray, _Triples, np.ndarray]:
    """The landmarks' subsequences, their weights by landmark (not as a dense table, which long landmarks would make huge), and the inverse root of their kernel."""
    rows, codes, weights = subsequences(marks)
    by = np.argsort(codes, kind="stable")
    known, at = np.unique(codes[by], return_inverse=True)
    phi = rows[by], at, weights[by]
    values, vectors = np.linalg.eigh(_kernel(phi, phi, len(marks), len(marks), len(known)))
    keep = values > 1e-2
    return known, phi, vectors[:, keep] / np.sqrt(values[keep])


def mapped(windows: list[bytes], known: np.ndarray, phi: _Triples, root: np.ndarray) -> np.ndarray:
    out, ends, low = np.zeros((len(windows), root.shape[1])), np.cumsum([len(w) for w in windows]), 0
    while low < len(windows):
        # PART bytes of windows at once, a longer one alone
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + PART, "right")))
        rows, codes, weights = subsequences(windows[low:high])
        at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
        ok = np.flatnonzero(known[at] == codes)
        ok = ok[np.argsort(at[ok], kind="stable")]
        out[low:high] = _kernel((rows[ok], at[ok], weights[ok]), phi, high - low, len(root), len(known)) @ root
        low = high
    return out


def folded(known: np.ndarray, phi: _Triples, w: np.ndarray) -> np.ndarray:
    """A weight for each of the landmarks' subsequences, from one for each landmark."""
    rows, at, weights = phi
    return np.bincount(at, weights * w[rows], len(known))


def svm(x: np.ndarray, y: np.ndarray, times: np.ndarray, cost: float = COST, rounds: int = 20) -> np.ndarray:
    """Weights and bias of a linear support vector machine (hinge loss), by coordinate descent on the dual; row k counts ``times[k]``, the classes alike."""
    w, bias, alpha, norms = np.zeros(x.shape[1]), 0.0, np.zeros(len(x)), np.einsum("nd,nd->n", x, x) + 1
    top = cost * len(y) / 2 * times / np.where(y > 0, times[y > 0].sum(), times[y < 0].sum())
    order = np.random.default_rng(7)
    for _ in range(rounds):
        for k in order.permutation(len(x)).tolist():
            new = min(max(alpha[k] - (y[k] * (x[k] @ w + bias) - 1) / norms[k], 0.0), top[k])
            if new != alpha[k]:
                w += (new - alpha[k]) * y[k] * x[k]
                bias += (new - alpha[k]) * y[k]
                alpha[k] = new
    return np.append(w, bias)


def inserted(word: bytes) -> list[bytes]:
    """A word with characters inserted."""
    letters = [c.encode() for c in word.decode()]
    half = len(letters) // 2
    return [b".".join(letters), b" ".join(letters), b"".join(letters[:half]) + b"*" + b"".join(letters[half:]), b"".join(letters[:half]) + b"-x" + b"".join(letters[half:])]


def learn(named: dict[str, float], good: list[str], hard: list[dict[str, float]]) -> tuple[np.ndarray, float]:
    """A weight for each subsequence, and the bias, from named windows and how often they are; ``hard`` has, for each earlier round, the good windows that scored highest and in how many sentences of other documents they are."""
    often = sorted(named, key=lambda w: (-named[w], w))
    varied = [(v, named[s] / 4) for s in often[:INSERTED] for v in inserted(s.encode())]
    bad = [s.encode() for s in often] + [v for v, _ in varied]
    marks = [s.encode() for s in [*often[: LANDMARKS // 2], *(w for words in hard for w in list(words)[: LANDMARKS // 8]), *good]]
    known, phi, root = landmarks_map(list(dict.fromkeys(marks))[:LANDMARKS])
    # a window that many other documents have would be wrong in as many, so it counts as often
    others = dict.fromkeys(good, 1.0) | {w: n for words in hard for w, n in words.items()}
    clean = [g.encode() for g in others]
    times = np.array([named[s] for s in often] + [t for _, t in varied] + list(others.values()))
    w = svm(mapped(bad + clean, known, phi, root), np.array([1.0] * len(bad) + [-1.0] * len(clean)), times)
    weights = np.zeros(_SYMBOLS**4, np.float32)
    weights[known] = folded(known, phi, root @ w[:-1])
    return weights, float(w[-1])


_EDGES = " .,;:!?\"'()[]{}|#*%&$-_/"


def highest(column: pa.Array, weights: np.ndarray, bias: float) -> np.ndarray:
    """The decisions on the two highest windows of each text of a column, each place in a text for itself; that on white space where there are fewer."""
    parts = pc.ascii_split_whitespace(pc.fill_null(column, ""))
    first = np.asarray(parts.offsets).astype(np.int64)
    coded, first = parts.flatten().dictionary_encode(), first - first[0]
    codes = np.asarray(coded.indices).astype(np.int64)
    windows = pc.utf8_trim(coded.dictionary, characters=_EDGES).cast(pa.binary()).to_pylist()
    score = np.where([len(w) > 0 for w in windows], decisions(windows, weights, bias), -np.inf)
    of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    each, out = score[codes], np.full((len(first) - 1, 2), -np.inf)
    for rank in (0, 1):
        np.maximum.at(out[:, rank], of, each)
        top = np.flatnonzero(each == out[of, rank])
        each[top[np.unique(of[top], return_index=True)[1]]] = -np.inf
    # letters that stand alone, of any number of bytes; marks between them are passed over, and a run ends with its text
    letters = np.fromiter((len(w.decode()) for w in windows), np.int64, len(windows))[codes]
    told = np.flatnonzero(letters > 0)
    text = of[told]
    run = np.where(letters[told] == 1, text, -1)
    edges = np.concatenate([[0], np.flatnonzero(np.diff(run)) + 1, [len(run)]])
    runs = [(a, b) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True) if b - a >= ALONE and run[a] >= 0]
    if runs:
        extra = decisions([b"".join(windows[k] for k in codes[told[a:b]]) for a, b in runs], weights, bias)
        for k, v in zip([run[a] for a, _ in runs], extra.tolist(), strict=True):
            out[k] = sorted([*out[k], v], reverse=True)[:2]
    return np.where(np.isfinite(out), out, decisions([b""], weights, bias)[0])


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
    """Slopes (none falling) and intercept of the share of y at the rows of x, n counted rows each, by Newton steps with a small ridge."""
    x = np.column_stack([x, np.ones(len(x))])
    k = x.shape[1] - 1
    ridge = np.append(np.full(k, 0.02), 0.002)
    w, used = np.append(np.ones(k), 0.0), np.ones(k + 1, bool)
    while True:
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            g = x.T @ ((p - y) * n) + ridge * w
            h = (x * (p * (1 - p) * n)[:, None]).T @ x + np.diag(ridge)
            step = np.linalg.solve(h[np.ix_(used, used)], g[used])
            step *= min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
            w[used] -= step
            if np.abs(step).max() < 1e-8:
                break
        falling = used & np.append(w[:k] < 0, False)
        if not falling.any():
            return w[:k], float(w[k])
        w[falling], used[falling] = 0.0, False  # without these


def sentence_windows(text: str) -> list[set[str]]:
    """The windows of each sentence of a text, in lower case; letters that stand alone side by side are one."""
    out = []
    for sentence in _SENTENCE.split(text.lower()):
        found, run = set(), []
        for w in [*(p.strip(_EDGES) for p in sentence.split()), "  "]:
            if len(w) == 1:
                run.append(w)
            elif w:
                if len(run) >= ALONE:
                    found.add("".join(run))
                run = []
                found.add(w)
        out.append(found - {"  "})
    return [f for f in out if f]


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each window of a document and how many of its sentences have it; of other than toxic documents, a batch's in one. The window "" counts the sentences."""
    for batch in sliced(batches, "text"):
        others, rows = Counter(), []
        for y, bag, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = Counter() if y else others
            for found in sentence_windows(text or ""):
                own.update(found)
                own[""] += 1
            if y:
                rows += [(1, bag, w, n) for w, n in own.items()]
        rows += [(0, 0, w, n) for w, n in others.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)] if rows else [pa.array([], t) for t in _TYPES], names=["y", "bag", "word", "n"])


_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.int64()]


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float] | None:
    """Learns from the sentences of a bounded sample of labelled documents, SAMPLE of them; a window a toxic one and ROUNDS times OTHERS windows reach the driver.

    None where a class is missing, or has no window.
    """
    ids = labels.where("y = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE[0]).unionByName(labels.where("y = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE[1]))
    ids = cut(ids)  # sum(SAMPLE) ids at most
    sample = docs.join(F.broadcast(ids), "doc_id").select("y", F.col("doc_id").alias("bag"), "text")
    windows = cut(sample.mapInArrow(tidy(_windows), "y long, bag long, word string, n long"))
    counts = cut(windows.groupBy("word").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("good")))
    sizes = {k: v for r in counts.where("word = ''").collect() for k, v in r.asDict().items()}
    words, others = counts.where("word <> ''"), counts.where("word <> '' and good > 0")
    if not sizes or not sizes["bad"] or not sizes["good"]:
        return None
    bags = windows.where("y = 1 and word <> ''").select("bag", "word")
    good = [r["word"] for r in others.orderBy(F.xxhash64("word"), "word").limit(OTHERS).select("word").collect()]
    share = sizes["bad"] / (sizes["bad"] + sizes["good"])
    told = F.log((F.col("bad") + USUAL * share) / sizes["bad"]) - F.log((F.col("good") + USUAL * (1 - share)) / sizes["good"])
    words = cut(words.withColumn("score", told))
    # what others have as often can't be what makes a document toxic; where nothing tells, anything may
    telling = words.where(F.col("score") > float(np.log(ODDS))).select("word")
    if telling.limit(1).count():
        bags = cut(bags.join(telling, "word"))
    scored, hard = words, []
    for turn in range(ROUNDS):
        own = bags.join(scored, "word").groupBy("bag").agg(F.max_by("word", F.struct("score", "word")).alias("word"))
        named = {r["word"]: float(r["count"]) for r in own.groupBy("word").count().collect()}  # a window a toxic document of the sample at most
        weights, bias = learn(named, good, hard)
        if turn + 1 < ROUNDS:
            now = cut(words.select("word", "good").mapInArrow(tidy(_scored(weights, bias)), "word string, good long, score double"))
            if turn:
                dropped(scored)
            scored = now
            hard.append({r["word"]: float(r["good"]) for r in scored.where("good > 0 and score > -1").orderBy(F.desc("score"), "word").limit(OTHERS).collect()})
    dropped(ids, windows, counts, words, scored, bags)
    return weights, bias


def _scored(weights: np.ndarray, bias: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decisions([w.encode() for w in batch.column(0).to_pylist()], weights, bias))], names=["word", "good", "score"])

    return run


def _tops(docs: DataFrame, weights, bias: float) -> DataFrame:
    """doc_id and the decisions on the two highest windows of each row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            top = highest(batch.column(1), weights.value, bias)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(t)) for t in top.T)], names=["doc_id", "top", "second"])

    return cut(docs.mapInArrow(tidy(run), "doc_id long, top double, second double"))


class Score:
    """The logistic of the two highest windows."""

    def __init__(self, reached: float, slopes: np.ndarray, intercept: float) -> None:
        self.reached, self.slopes, self.intercept = reached, slopes, intercept

    def of(self, tops: np.ndarray) -> np.ndarray:
        beyond = np.maximum(tops[:, 0] - self.reached, 0.0)
        return 1 / (1 + np.exp(-np.clip(self.slopes[0] * tops[:, 1] + self.slopes[1] * beyond + self.intercept, -700, 700)))

    def column(self):
        beyond = F.greatest(F.col("top") - F.lit(self.reached), F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(float(self.slopes[0])) * F.col("second") + F.lit(float(self.slopes[1])) * beyond + F.lit(self.intercept))))


def fitted(counts: list[tuple[float, float, float, float]], model: bool) -> Score:
    """The score fitted to counts: steps of the highest and the second window, rows and toxic ones there. Where nothing was learnt, or a class is missing, it is the labels' smoothed share, a third without labels."""
    top, second, n, bad = np.array(counts, float).reshape(-1, 4).T
    if not model or not bad.sum() or bad.sum() == n.sum():
        return Score(0.0, np.zeros(2), float(np.log((bad.sum() + 1) / (n.sum() - bad.sum() + 2))))
    order = np.argsort(top, kind="stable")
    good = np.cumsum((n - bad)[order])
    reached = top[order][np.searchsorted(good, REACHED * good[-1])] / STEPS
    slopes, intercept = logistic(np.column_stack([second / STEPS, np.maximum(top / STEPS - reached, 0.0)]), bad / n, n)
    return Score(float(reached), slopes, intercept)


def _learnt(docs: DataFrame, labels: DataFrame, modulus: int, held: int):
    """The shared weights and the bias, the score, and all rows' highest windows."""
    docs = without(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    labels = labels_of(labels, "toxic").where(crc_remainder(F.col("doc_id"), modulus) != held)
    model = train(docs, labels)
    weights, bias = model if model else (np.zeros(_SYMBOLS**4, np.float32), 0.0)
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # one number for each subsequence, 4 MB
    tops = _tops(docs, shared, bias)
    step = lambda c: F.round(F.least(F.greatest(c, F.lit(-float(SPAN))), F.lit(float(SPAN))) * STEPS).cast("long")
    counted = tops.join(labels, "doc_id").groupBy(step("top").alias("top"), step("second").alias("second")).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("bad")).collect()  # (2 * SPAN * STEPS + 1) ** 2 / 2 rows at most
    return shared, bias, fitted([tuple(r) for r in counted], model is not None), tops


def clean_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, modulus: int = 5, held: int = 0) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all columns; each row is judged by its own text, a null one as empty."""
    weights, bias, score, tops = _learnt(docs, labels, modulus, held)
    dropped(tops)
    return rows_where(docs, lambda text: score.of(highest(text, weights.value, bias)) < threshold)


def toxicity_scores(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, score (0 to 1, that the toxic label is 1), one row for each row.

    Labels of ids whose crc32 modulo ``modulus`` is ``held`` are not learnt from. Null and empty texts are scored as
    windows of white space; repeated rows get equal scores; a null doc_id is scored and never held out. Where the
    labelled rows lack a class, or a class has no word, every score is the labels' smoothed share (a third without labels, so nothing is rejected). Extra columns are ignored.
    """
    _, _, score, tops = _learnt(docs, labels, modulus, held)
    held_out = F.coalesce(crc_remainder(F.col("doc_id"), modulus) == held, F.lit(False))
    return tops.select("doc_id", held_out.alias("held_out"), score.column().alias("score"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
