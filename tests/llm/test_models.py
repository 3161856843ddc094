"""The quality discriminant and the toxicity machine against slow twins."""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glimmer.llm import quality, toxicity
from glimmer.llm.common import flat, table
from tests.conftest import SMALL

RNG = np.random.default_rng(6)


def test_quality_scores_are_density_ratios(spark):
    """Class means and shrunk covariances over all labelled rows of the training folds, densities by determinants and inverses."""
    docs = {r["doc_id"]: r["text"] for r in table(spark, SMALL, "documents").collect()}
    labels = {r["doc_id"]: r["quality"] for r in table(spark, SMALL, "labels").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 != 0}
    x = {i: quality.statistics(*flat(pa.array([t])))[0] for i, t in docs.items()}
    logs = {}
    for y in (0, 1):
        own = np.array([x[i] for i, label in labels.items() if label == y and i in x])
        mean, cov = own.mean(axis=0), np.cov(own.T, bias=True)
        k = quality.SHRINKAGE + (1 - quality.SHRINKAGE) * min(1.0, x[0].size / len(own)) if 0 in x else None
        cov = (1 - k) * cov + k * np.diag(np.diag(cov)) + quality.FLOOR * np.eye(len(mean))
        share = len(own) / sum(i in x for i in labels)
        logs[y] = {i: np.log(share) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * (v - mean) @ np.linalg.inv(cov) @ (v - mean) for i, v in x.items()}
    for r in quality.quality_scores(table(spark, SMALL, "documents"), table(spark, SMALL, "labels")).collect():
        want = 1 / (1 + np.exp(np.clip(logs[0][r["doc_id"]] - logs[1][r["doc_id"]], -700, 700)))
        assert np.isclose(r["score"], want, rtol=1e-6, atol=1e-9)


def slow_map(window: str) -> dict[tuple, float]:
    """Every subsequence of four symbols of a window with a border on either side, by its definition."""
    fold = lambda c: 0 if not c.isalnum() else 27 if c.isdigit() else ord(c.lower()) - 96
    s = [0, *map(fold, window), 0]
    out: dict[tuple, float] = {}
    for at in itertools.combinations(range(len(s)), 4):
        if at[3] - at[0] < toxicity.REACH:
            key = tuple(s[k] for k in at)
            out[key] = out.get(key, 0.0) + toxicity.DECAY ** (at[3] - at[0] - 3)
    # the length if all were different, and of LEAST symbols at least
    n = max(len(s), toxicity.LEAST)
    norm = sum(toxicity.DECAY ** (2 * (at[3] - at[0] - 3)) for at in itertools.combinations(range(n), 4) if at[3] - at[0] < toxicity.REACH) ** 0.5
    return {k: v / norm for k, v in out.items()}


def kernel(a: str, b: str) -> float:
    left, right = slow_map(a), slow_map(b)
    return sum(v * right.get(k, 0.0) for k, v in left.items())


@pytest.mark.parametrize("words", [["idiot", "id.iot", "i d i o t"], ["stupid", "pathetic", "worthless7", "ab", ""]])
def test_kernel_against_all_subsequences(words):
    rows, codes, weights = toxicity.subsequences([w.encode() for w in words])
    phi = np.zeros((len(words), toxicity._SYMBOLS**4))
    np.add.at(phi, (rows, codes), weights)
    assert np.allclose(phi @ phi.T, [[kernel(a, b) for b in words] for a in words])
    assert kernel("idiot", "i.diot") > kernel("idiot", "thandsh")


def test_norms_of_long_windows():
    assert np.isclose(toxicity.norms(np.array([50_000]))[0] ** 2, 50_000 * toxicity._EACH - toxicity._LOST)
    # a long word is weighed like any other: alone it scores the same wherever its text stands
    weights = RNG.normal(size=toxicity._SYMBOLS**4).astype(np.float32)
    long = "".join(RNG.choice(list("abcdefg"), 20_000))
    assert np.allclose(toxicity.highest(pa.array([long, "a " + long]), weights, 0.0)[0, 0], toxicity.decisions([long.encode()], weights, 0.0)[0])


def test_landmarks_give_their_own_kernel():
    """On the landmarks the map's products are the kernel itself, and folded weights decide as the map does."""
    words = ["idiot", "moron", "stupid", "thandsh", "reading", "overing"]
    raw = [w.encode() for w in words]
    known, phi, root = toxicity.landmarks_map(raw)
    z = toxicity.mapped(raw, known, phi, root)
    assert np.allclose(z @ z.T, [[kernel(a, b) for b in words] for a in words], atol=1e-6)
    weights, bias = toxicity.learn({"idiot": 2.0, "moron": 1.0}, ["thandsh", "reading"], [{"overing": 1.0}])
    got = toxicity.decisions(raw, weights, bias)
    assert got[0] > 0 > got[3] and got[1] > 0 > got[4]


def test_machine_meets_its_optimality_conditions():
    """At the optimum, rows beyond the margin have no part, and those within all of theirs."""
    x, y = np.concatenate([RNG.normal(-1, 1, (60, 3)), RNG.normal(1, 1, (40, 3))]), np.repeat([-1.0, 1.0], [60, 40])
    times = RNG.uniform(0.5, 2, 100)
    w = toxicity.svm(x, y, times, rounds=400)
    top = toxicity.COST * 100 / 2 * times / np.where(y > 0, times[y > 0].sum(), times[y < 0].sum())
    full = np.column_stack([x, np.ones(100)])
    value = lambda v: 0.5 * v @ v + (top * np.maximum(0, 1 - y * (full @ v))).sum()
    assert all(value(w) <= value(w + RNG.normal(0, s, 4)) * (1 + 1e-4) for s in (1e-3, 1e-2, 0.1) for _ in range(50))


def test_gapped_and_inserted_insults(spark):
    """Documents with spellings that no label shows."""
    parts = np.array(["er", "an", "th", "in", "ou", "es"], object)
    text = lambda n: " ".join(RNG.choice(parts, (n, 3)).sum(axis=1))
    insults = ["idiot", "moron", "stupid", "pathetic", "worthless"]
    rows = [(k, text(12) + (f". {text(3)} {insults[k % 5]} {text(3)}." if k % 3 == 0 else ".")) for k in range(900)]
    labels = [(k, 1, int(k % 3 == 0)) for k in range(900)]
    odd = [f"{text(6)} {w[:2]}{c}{w[2:]} {text(6)}" for w in insults for c in (".", "*", "-", "_", "x", "!")] + [f"{text(6)} {' '.join(w)} {text(6)}" for w in insults]
    docs = spark.createDataFrame([*rows, *((1000 + k, t) for k, t in enumerate(odd)), *((2000 + k, text(14)) for k in range(100))], "doc_id long, text string")
    got = toxicity.toxicity_scores(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).withColumn("bad", (F.col("score") >= toxicity.THRESHOLD).cast("int"))
    caught, wrong = got.where("doc_id between 1000 and 1999").agg(F.avg("bad")).collect()[0][0], got.where("doc_id >= 2000").agg(F.avg("bad")).collect()[0][0]
    assert caught >= 0.9 and wrong <= 0.02
