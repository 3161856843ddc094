"""Quality classifier: regularised quadratic discriminant analysis of transformed document statistics.

Each class is a Gaussian over the statistics, its covariance shrunk towards a diagonal one, so a class of few or uniform
rows stays usable. A score is the logistic of the difference of the log-densities, from Mahalanobis distances by
Cholesky factors that are worked out once. What is learnt are sums of statistics and of their products, gathered over
all labelled rows of the training folds; nothing else of the corpus reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glimmer.llm.common import crc_remainder, cut, dropped, flat, rows_where, sliced, span_hashes, table, tidy, without, words

#: Score from which a document counts as good, shrinkage of the covariances, least variance.
THRESHOLD, SHRINKAGE, FLOOR = 0.3, 0.1, 0.1
STATISTICS = ("upper", "digits", "marks", "bars", "bangs", "odd_marks", "repeats", "distinct", "commonest", "word_size", "line_words", "same_lines", "short_words", "stops")

_KIND = np.zeros((8, 256), bool)
_KIND[0, 65:91] = True  # upper case
_KIND[1, 48:58] = True  # digits
_KIND[2, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True  # marks
_KIND[3, ord("|")] = True
_KIND[4, ord("!")] = True
_KIND[5, [ord(c) for c in "#$%&*<>=_{}[]\\~^+@/"]] = True
_KIND[6, [*range(65, 91), *range(97, 123), *range(192, 256)]] = True  # letters (a lead byte for each of two bytes)
_KIND[7, [ord(c) for c in ".?"]] = True


#: Words (or bytes) of ordinary text that every text is thought to have besides its own, so a short one isn't judged by a few.
USUAL = 12


def _share(part: np.ndarray, whole: np.ndarray, usual: float, floor: float, weight: float = USUAL) -> np.ndarray:
    """A share, drawn towards the ``usual`` one in short texts, as log-odds that ``floor`` keeps from the infinite."""
    p = np.clip((part + weight * usual) / (whole + weight), 0, 1)
    return np.log((p + floor) / (1 - p + floor))


def statistics(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of STATISTICS for each text; empty texts have those of no words."""
    n = len(offs) - 1
    size = np.diff(offs)
    counts = np.zeros((8, n))
    for k in range(8):
        sums = np.concatenate([[0], np.cumsum(_KIND[k][data])])
        counts[k] = sums[offs[1:]] - sums[offs[:-1]]
    starts, ends, first = words(data, offs)
    n_words = np.diff(first)
    each = span_hashes(data, starts, ends)
    doc = np.repeat(np.arange(n), n_words)
    again = np.zeros(len(each), bool)
    again[1:] = (each[1:] == each[:-1]) & (doc[1:] == doc[:-1])
    # the same words of a text are neighbours once sorted by text
    order = np.lexsort((each, doc))
    new = np.ones(len(each), bool)
    new[1:] = (each[order][1:] != each[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    at = np.flatnonzero(new)
    runs = np.diff(np.append(at, len(each)))
    most = np.zeros(n)
    np.maximum.at(most, doc[order][at], runs)
    distinct = np.bincount(doc[order][at], minlength=n)
    repeats = np.bincount(doc[again], minlength=n)
    short = np.bincount(doc[(ends - starts) <= 2], minlength=n)
    # lines: their hashes against the others of the text
    stops = np.flatnonzero(data == 10)
    line_starts = np.unique(np.concatenate([offs[:-1][size > 0], stops + 1]))
    line_starts = line_starts[line_starts < len(data)]
    line_ends = np.minimum(np.append(line_starts[1:], len(data)), offs[np.searchsorted(offs, line_starts, "right")])
    line_doc = np.searchsorted(offs, line_starts, "right") - 1
    line_hash = span_hashes(data, line_starts, line_ends)
    lo = np.lexsort((line_hash, line_doc))
    same = np.zeros(len(lo), bool)
    same[1:] = (line_hash[lo][1:] == line_hash[lo][:-1]) & (line_doc[lo][1:] == line_doc[lo][:-1])
    lines = np.bincount(line_doc, minlength=n)
    same_lines = np.bincount(line_doc[lo][same], minlength=n)
    letters = counts[6]
    long = USUAL * 6
    columns = [_share(counts[0], letters, 0.05, 0.02, long), _share(counts[1], size, 0.0, 0.02, long), _share(counts[2], size, 0.03, 0.02, long)]
    columns += [_share(counts[3], n_words, 0.0, 0.02), _share(counts[4], n_words, 0.0, 0.02), _share(counts[5], n_words, 0.0, 0.02), _share(repeats, n_words, 0.01, 0.02)]
    columns += [np.log(distinct + USUAL) / np.log(n_words + USUAL) * 10, _share(most, n_words, 0.08, 0.02)]
    columns += [np.log((size - n_words + long) / (n_words + USUAL)), np.log((n_words + USUAL) / (lines + 1)), _share(same_lines, lines, 0.0, 0.1), _share(short, n_words, 0.15, 0.02), _share(counts[7], n_words, 0.1, 0.02)]
    return np.stack(columns, axis=1)


@dataclass(frozen=True)
class Discriminant:
    """Class means, inverse Cholesky factors, log-determinants and log-priors; ``prior`` alone where a class had no rows."""

    means: np.ndarray | None
    factors: np.ndarray | None
    constants: np.ndarray | None
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.prior)
        logs = [c - 0.5 * (((x - m) @ f) ** 2).sum(axis=1) for m, f, c in zip(self.means, self.factors, self.constants, strict=True)]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def fit(count: np.ndarray, sums: np.ndarray, products: np.ndarray, shrinkage: float = SHRINKAGE) -> Discriminant:
    """From the number, sums and sums of products of each class's rows."""
    total = count.sum()
    if (count < 2).any():
        return Discriminant(None, None, None, float((count[1] + 1) / (total + 2)))
    means, factors, constants = [], [], []
    for n, s, p in zip(count, sums, products, strict=True):
        mean = s / n
        cov = p / n - np.outer(mean, mean)
        k = shrinkage + (1 - shrinkage) * min(1.0, len(mean) / n)
        cov = (1 - k) * cov + k * np.diag(np.diag(cov)) + FLOOR * np.eye(len(mean))
        low = np.linalg.cholesky(cov)
        means.append(mean)
        factors.append(np.linalg.inv(low).T)
        constants.append(np.log(n / total) - np.log(np.diag(low)).sum())
    return Discriminant(np.array(means), np.array(factors), np.array(constants), float(count[1] / total))


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "text"):
        x = statistics(*flat(batch.column(1)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))], names=["doc_id", "x"])


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sums of a task: for each class a row of 1, the statistics and their products."""
    d = len(STATISTICS)
    sums = np.zeros((2, 1 + d + d * d))
    for batch in batches:
        y, x = batch.column(0).to_numpy(zero_copy_only=False), np.asarray(batch.column(1).flatten()).reshape(-1, d)
        for k in (0, 1):
            own = x[y == k]
            sums[k] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
    at = np.arange(sums.shape[1])
    for k in (0, 1):
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k)), pa.array(at), pa.array(sums[k])], names=["k", "at", "v"])


def labels_of(labels: DataFrame, column: str) -> DataFrame:
    """doc_id and y (0 or 1): the largest label of an id; rows with a null id or label, or another label, teach nothing."""
    y = F.col(f"`{column}`").cast("int")
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), y.alias("y")).where("doc_id is not null and y in (0, 1)").groupBy("doc_id").agg(F.max("y").alias("y"))


def train(described: DataFrame, labels: DataFrame) -> Discriminant:
    """Learns from the described rows (doc_id, x) that have a label (doc_id, y)."""
    d = len(STATISTICS)
    rows = described.join(labels, "doc_id").select("y", "x").mapInArrow(tidy(_moments), "k long, at long, v double").groupBy("k", "at").agg(F.sum("v").alias("v")).collect()
    sums = np.zeros((2, 1 + d + d * d))
    for k, at, v in rows:  # two rows of fixed width
        sums[k, at] = v
    return fit(sums[:, 0], sums[:, 1 : 1 + d], sums[:, 1 + d :].reshape(2, d, d))


def score(described: DataFrame, model: Discriminant) -> DataFrame:
    """doc_id and score of described rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(1).flatten()).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], names=["doc_id", "score"])

    return described.mapInArrow(run, "doc_id long, score double")


def _described(docs: DataFrame) -> DataFrame:
    return cut(without(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(tidy(_describe), "doc_id long, x array<double>"))


def _learnt(described: DataFrame, labels: DataFrame, modulus: int, held: int) -> Discriminant:
    return train(described, labels_of(labels, "quality").where(crc_remainder(F.col("doc_id"), modulus) != held))


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, modulus: int = 5, held: int = 0) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with all columns; each row is judged by its own text, a null one as empty."""
    described = _described(docs)
    model = _learnt(described, labels, modulus, held)
    dropped(described)
    return rows_where(docs, lambda text: model.score(statistics(*flat(text))) >= threshold)


def quality_scores(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, score (0 to 1, that the quality label is 1), one row for each row.

    Labels of ids whose crc32 modulo ``modulus`` is ``held`` are not learnt from. Null and empty texts are scored by the
    statistics of no words; repeated rows get equal scores; a null doc_id is scored and never held out. Without rows of
    both classes the score is the labels' smoothed share. Extra columns are ignored.
    """
    described = _described(docs)
    model = _learnt(described, labels, modulus, held)
    held_out = F.coalesce(crc_remainder(F.col("doc_id"), modulus) == held, F.lit(False))
    return score(described, model).select("doc_id", held_out.alias("held_out"), "score")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
