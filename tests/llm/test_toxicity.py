"""The toxicity classifier at other shares of toxic labels, and on full samples."""

from __future__ import annotations

import itertools
import math
import re
import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from glimmer.llm import toxicity
from glimmer.llm.common import table
from tests.conftest import SMALL

INSULTS = ["idiot", "moron", "stupid", "pathetic"]
PARTS = ["er", "an", "th", "in", "ou", "es"]


def corpus(n: int, toxic: int, words: int, seed: int = 3) -> tuple[pd.DataFrame, pd.DataFrame]:
    """``n`` documents, ``toxic`` of them with an insult, and their labels."""
    rng = np.random.default_rng(seed)
    texts = np.array(PARTS, object)[rng.integers(len(PARTS), size=(n, words, 3))].sum(axis=2)
    texts[np.arange(toxic), rng.integers(words, size=toxic)] = np.array(INSULTS, object)[np.arange(toxic) % 4]
    ids = np.arange(n)
    return pd.DataFrame({"doc_id": ids, "text": [" ".join(t) for t in texts]}), pd.DataFrame({"doc_id": ids, "quality": 1, "toxic": (ids < toxic).astype(int)})


@pytest.mark.parametrize(("n", "toxic", "words"), [(21000, 5400, 8), (1000, 300, 20), (1000, 600, 20)])
def test_any_share_of_toxic_labels(spark, n, toxic, words):
    docs, labels = corpus(n, toxic, words)
    got = toxicity.toxicity_scores(spark.createDataFrame(docs), spark.createDataFrame(labels)).toPandas()
    bad = got.doc_id < toxic
    assert (got.score[bad] >= toxicity.THRESHOLD).mean() > 0.99
    assert (got.score[~bad] < toxicity.THRESHOLD).mean() > 0.99


def test_spaced_out_insults():
    rng = np.random.default_rng(4)
    good = ["".join(rng.choice(PARTS, 3)) for _ in range(200)]
    weights, bias = toxicity.learn({"débile": 1.0, "crétin": 1.0, "stupid": 1.0, "idiot": 1.0}, good, [])
    top = lambda *texts: toxicity.highest(pa.array(texts), weights, bias)[:, 0]
    for spaced, word in (("d é b i l e", "débile"), ("c r é t i n", "crétin"), ("s - t - u - p - i - d", "stupid"), ("i d i o t", "idiot")):
        assert np.allclose(top(f"eran {spaced} thinou", "eranth"), top(f"eran {word} thinou", "eranth")), spaced
    # a run does not go on into the next text
    assert top("eran s t u", "p i d eran").max() < top("stupid")[0]
    assert len(toxicity.highest(pa.array(["", None, " - "]), weights, bias)) == 3


def test_highest_two_are_places_of_their_own():
    weights = np.zeros(toxicity._SYMBOLS**4, np.float32)
    weights[toxicity.subsequences([b"idiot"])[1]] = 1.0
    one, other = (toxicity.decisions([w], weights, 0.0)[0] for w in (b"idiot", b"reading"))
    blank = toxicity.decisions([b""], weights, 0.0)[0]
    got = toxicity.highest(pa.array(["idiot reading idiot", "reading idiot", "idiot", None, "i d i o t", "reading i-d-i-o-t i d i o t"]), weights, 0.0)
    assert np.allclose(got[:4], [[one, one], [one, other], [one, blank], [blank, blank]])
    assert np.isclose(got[4, 0], one) and got[5, 0] >= got[5, 1] > other


def slow_decision(window: bytes, weights: np.ndarray, bias: float) -> float:
    """The sum over all subsequences of four symbols within REACH, one by one."""
    c = [0, *(int(toxicity._FOLD[b]) for b in window if b < 192), 0]
    total = 0.0
    for last in range(len(c)):
        for a, b, d in itertools.combinations(range(max(0, last - toxicity.REACH + 1), last), 3):
            code = 0
            for s in (c[a], c[b], c[d], c[last]):
                code = code * toxicity._SYMBOLS + s
            total += toxicity.DECAY ** (last - a - 3) * float(weights[code])
    return total / float(toxicity.norms(np.array([len(c)]))[0]) + bias


def test_scores_equal_their_slow_twin(spark):
    docs, labels = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    weights, bias, score, _ = toxicity._learnt(docs, labels, 5, 0)
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(docs, labels).collect()}
    known: dict[bytes, float] = {}
    for r in docs.limit(60).collect():
        found = [slow_decision(b"", weights.value, bias)] * 2
        each, run = [], []
        for w in [*(re.split(r"[ \t\n\v\f\r]+", r["text"] or "")), "  "]:
            w = w.strip(toxicity._EDGES) if w != "  " else w
            if len(w) == 1:
                run.append(w)
            elif w:
                each += ["".join(run)] if len(run) >= toxicity.ALONE else []
                run = []
            each += [w] if w.strip() else []
        for w in each:
            if w.encode() not in known:
                known[w.encode()] = slow_decision(w.encode(), weights.value, bias)
        tops = sorted((known[w.encode()] for w in each), reverse=True)[:2]
        tops += found[len(tops) :]
        z = score.slopes[0] * tops[1] + score.slopes[1] * max(tops[0] - score.reached, 0.0) + score.intercept
        assert math.isclose(got[r["doc_id"]], 1 / (1 + math.exp(-z)), abs_tol=1e-4)


def test_held_out_recall_and_precision(spark):
    folder = "/root/testdata/sf0.1"
    scored = toxicity.op5_toxicity(spark, folder).join(table(spark, folder, "labels"), "doc_id").where("held_out and toxic is not null")
    n = {(r["toxic"], r["predicted"]): r["count"] for r in scored.groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] / (n[1, 1] + n[1, 0]) > 0.8 and n[1, 1] / (n[1, 1] + n.get((0, 1), 0)) > 0.95


def test_slopes_never_fall():
    x = np.array([[0.0, 3.0], [1.0, 2.0], [2.0, 1.0], [3.0, 0.0]])
    slopes, b = toxicity.logistic(x, np.array([0.0, 0.1, 0.8, 1.0]), np.full(4, 50.0))
    assert slopes[0] > 0 and slopes[1] == 0 and 1 / (1 + np.exp(-(x @ slopes + b)))[0] < 0.1
    assert np.allclose(toxicity.fitted([], False).of(np.zeros((2, 2))), 1 / 3)
    assert len(set(toxicity.fitted([(5.0, 1.0, 10.0, 0.0), (9.0, 2.0, 10.0, 0.0)], True).of(np.array([[1.0, 2.0], [8.0, 0.0]])))) == 1


def test_landmarks_are_never_a_dense_table():
    """Landmarks times their subsequences would be 170 MB of the driver's memory here, and windows times those as much again."""
    rng = np.random.default_rng(4)
    words = ["".join(w).encode() for w in rng.choice(list("abcdefghijklmnopqrstuvwxyz"), (1400, 12))]
    tracemalloc.start()
    known, phi, root = toxicity.landmarks_map(words[:400])
    z = toxicity.mapped(words, known, phi, root)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(known) * 400 * 8 > 100e6 > 4 * z.nbytes
    assert most < 60e6
    # and it is the same map
    rows, codes, weights = toxicity.subsequences(words[:400])
    dense = np.zeros((400, len(known)))
    np.add.at(dense, (rows, np.searchsorted(known, codes)), weights)
    assert np.allclose(z[:400], dense @ dense.T @ root)
    w = rng.normal(size=400)
    assert np.allclose(toxicity.folded(known, phi, w), w @ dense)
