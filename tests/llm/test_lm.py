"""The language model learns from all training texts, from all of a long one, and scores as a slow twin does."""

from __future__ import annotations

import collections
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from glimmer.llm import lm


def test_learns_from_texts(spark, monkeypatch):
    """Two words follow each other in texts."""
    rng = np.random.default_rng(5)
    words = np.array([f"w{k}" for k in range(40)], object)
    rows = [(k, " ".join(words[rng.integers(40, size=60)]) if k % 2 else " ".join(np.repeat(words[rng.permutation(20)], 2) + np.array(["", "x"] * 20, object))) for k in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    gain = lambda: lm.lm_scores(docs).where("held_out and doc_id % 2 = 0").agg(F.sum("score") / F.sum("n_tokens")).collect()[0][0]
    whole = gain()
    monkeypatch.setattr(lm, "TURNS", 0)
    assert whole > gain() + 0.1


def test_scores_equal_a_slow_twin(spark, monkeypatch):
    rng, kept = np.random.default_rng(2), []
    monkeypatch.setattr(lm, "HEAD", 30)
    monkeypatch.setattr(lm, "COUNTED", 50)
    real = lm.fitted
    monkeypatch.setattr(lm, "fitted", lambda *a: kept.append(real(*a)) or kept[-1])
    names = np.array([f"{c}{k}" for k in range(120) for c in "abc"], object)
    texts = {k: " ".join(names[(rng.pareto(1.0, size=rng.integers(0, 90)) * 8).astype(int) % len(names)]) for k in range(150)}
    got = {r["doc_id"]: r for r in lm.lm_scores(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)).collect()}
    model = kept[0].model
    tokens = {k: re.findall("[^\x20\x09-\x0d]+", t) for k, t in texts.items()}
    counts = collections.Counter(w for k, ws in tokens.items() if zlib.crc32(str(k).encode()) % 5 != 1 for w in ws)
    tail = {w: int(lm.tail_units([w])[0]) for w in names if w not in model.units}
    mass, kinds = np.zeros(lm.TAILS), np.zeros(lm.TAILS)
    for w, c in counts.items():
        if w in tail:
            mass[tail[w]] += c
            kinds[tail[w]] += 1
    for k, ws in tokens.items():
        units = [model.units.get(w, 1 + len(model.units) + tail.get(w, 0)) for w in ws] + [0]
        total = 0.0
        for t, unit in enumerate(units):
            h = np.zeros(lm.SIZE)
            for back in range(1, min(t, lm.CONTEXT + lm.WINDOW) + 1):
                far = back > lm.CONTEXT
                h += model.vectors[units[t - back]] * model.places[lm.CONTEXT if far else back - 1] / (lm.WINDOW if far else 1)
            own, inside = divmod(int(model.order[unit]), model.width)
            at = slice(own * model.width, (own + 1) * model.width)
            for x, chosen in ((model.class_out @ h + model.class_bias, own), (model.unit_out[at] @ h + model.unit_bias[at], inside)):
                total += (x[chosen] - x.max() - np.log(np.exp(x - x.max()).sum())) / np.log(10)
            if t < len(ws) and ws[t] in tail:
                n = tail[ws[t]]
                total += np.log10((counts[ws[t]] + 0.5) / (mass[n] + 0.5 * (kinds[n] + 1)))
        assert np.isclose(got[k]["score"], total, rtol=1e-4, atol=1e-3), k


def test_steps_hold_every_token():
    units, first = np.arange(20_000), np.array([0, 10, 15_000, 15_001, 20_000])
    got = list(lm.pieces(units, first))
    assert np.array_equal(np.concatenate([u for u, _ in got]), units)
    assert max(len(u) for u, _ in got) <= lm.STEP_TOKENS
    assert {0, 10, 15_000, 15_001} <= {int(u[b]) for u, f in got for b in f[:-1]}


def test_frequent_words_where_too_many_share_a_count(spark, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", 3)
    monkeypatch.setattr(lm, "COUNTED", 5)
    found = lambda rows: lm.frequent_words(spark.createDataFrame(rows, "word string, c long"))
    even = [(f"w{k}", 7) for k in range(9)]
    assert found(even) == {"w0": 7, "w1": 7, "w2": 7}  # the highest step has more than fit: the first by name
    assert found([*even, ("top", 90)]) == {"top": 90, "w0": 7, "w1": 7}
    assert found([(f"v{k}", 90) for k in range(4)] + even) == {f"v{k}": 90 for k in range(4)}
    assert found(even[:4]) == dict(even[:4]) and found([]) == {}


def test_sums_of_the_older_context():
    """Against sums row by row, over texts shorter and longer than the window, and steps of a few rows."""
    rng = np.random.default_rng(8)
    for sizes in ([1], [3], [1, 2, 1], [400], [lm.CONTEXT + lm.WINDOW, 1, lm.CONTEXT + lm.WINDOW + 1, 60], rng.integers(1, 50, 40).tolist()):
        first = np.concatenate([[0], np.cumsum(sizes)])
        rows = rng.normal(size=(first[-1], 4))
        want = np.zeros_like(rows)
        for a, b in zip(first[:-1], first[1:], strict=True):
            for k in range(a, b):
                want[k] = rows[max(a, k - lm.CONTEXT - lm.WINDOW) : max(a, k - lm.CONTEXT)].sum(axis=0)
        assert np.allclose(lm.window_sums(rows, first), want)


def test_a_step_equals_a_slow_twin(monkeypatch):
    """The outputs' gradients of one step, by AdaGrad from nothing, against sums token by token with the same noise."""
    rng = np.random.default_rng(4)
    head, tails = [(f"w{k}", 900 - k) for k in range(300)], rng.integers(1, 50, lm.TAILS)
    fit = lm.begin(head, tails, 40, np.zeros((1 + len(head) + lm.TAILS, 1)))
    model, got = fit.model, {}
    model.class_out[:], model.unit_out[:] = rng.normal(0, 0.3, model.class_out.shape), rng.normal(0, 0.3, model.unit_out.shape)
    units, first = rng.integers(0, 1 + len(head) + lm.TAILS, 90), np.array([0, 1, 50, 90])
    h = lm.contexts(model, units, first).astype(float)
    monkeypatch.setattr(fit, "step", lambda name, rows, gradient, rate: got.update({name: (rows, gradient)}))
    fit.learn(units, first, 0.1, np.random.default_rng(6))
    draw, width = np.random.default_rng(6), model.width
    noise = np.searchsorted(np.cumsum(fit.class_p), draw.random(lm.NOISE) * fit.class_p.sum())
    place = model.order[units]
    full = np.unique(place // width)
    drawn = dict(zip(full.tolist(), np.searchsorted(fit.inner_noise, full[:, None] + draw.random((len(full), lm.NOISE)), "right"), strict=True))
    pull = lambda x: 1 / (1 + np.exp(x))
    classes, inner = np.zeros(model.class_out.shape), np.zeros(model.unit_out.shape)
    for t, p in enumerate(place.tolist()):
        for out, bias, share, own, others, total in ((model.class_out, model.class_bias, fit.class_p, p // width, noise, classes), (model.unit_out, model.unit_bias, fit.inner_p, p, drawn[p // width], inner)):
            logit = lambda k: out[k] @ h[t] + bias[k] - np.log(lm.NOISE * max(share[k], 1e-12))  # noqa: B023, E731
            total[own] += pull(logit(own)) * h[t]
            for k in others.tolist():
                total[k] -= pull(-logit(k)) * h[t]
    assert np.allclose(got["class_out"][1], classes, rtol=1e-3, atol=1e-4)
    rows, gradient = got["unit_out"]
    dense = np.zeros(inner.shape)
    dense[rows] = gradient
    assert np.allclose(dense, inner, rtol=1e-3, atol=1e-4)
