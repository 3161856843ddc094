"""Numpy kernels against planted truths."""

from __future__ import annotations

import itertools

import numpy as np
import pytest

from glimmer.functions import kernels as k
from glimmer.operators import frames, hmm

RNG = np.random.default_rng(3)


def test_shift_is_found_and_undone():
    image = RNG.random((32, 32))
    moved = np.roll(image, (3, -2), (0, 1))
    assert k.shift_between(moved, image) == (3, -2)
    back = k.shifted(moved, 3, -2)
    assert np.allclose(back[4:-4, 4:-4], image[4:-4, 4:-4])
    assert not k.shifted(image, 40, 0).any()


def test_blur_keeps_the_sum():
    image = np.zeros((21, 21))
    image[10, 10] = 1
    blurred = k.gaussian_blur(image, 1.5)
    assert np.isclose(blurred.sum(), 1) and np.isclose(blurred[10, 10], blurred.max())
    assert np.allclose(k.gaussian_blur(np.ones((5, 9)), 20), 1)


def test_blobs_are_found():
    y, x = np.mgrid[:40, :40]
    image = sum(10 * np.exp(-((y - a) ** 2 + (x - b) ** 2) / (2 * 2.0**2)) for a, b in ((10, 12), (28, 30)))
    got = k.log_blobs(image, 1, 4, 7, 1.0)
    assert sorted((int(a), int(b)) for a, b, _ in got) == [(10, 12), (28, 30)] and np.allclose(got[:, 2], 2.0)
    assert len(k.log_blobs(np.zeros((8, 8)), 1, 3, 3)) == 0


def test_spot_fit():
    y, x = np.mgrid[:24, :24].astype(float)
    image = k.gaussian_2d(y, x, np.array([50, 11.3, 12.6, 2.2, 2.2, 0, 4]))
    p, status = k.fit_spot(image, 11, 12, 6)
    assert status == "ok" and np.allclose(p[:3], [50, 11.3, 12.6], atol=1e-2) and np.isclose(p[6], 4, atol=1e-2)
    assert k.fit_spot(image, 1, 12, 6)[1] == "clipped"


def test_viterbi_and_posterior_against_all_paths():
    start, move, means, variances = np.array([0.6, 0.4]), np.array([[0.7, 0.3], [0.2, 0.8]]), np.array([0.0, 2.0]), np.array([1.0, 0.5])
    x = RNG.normal(1, 1.2, 7)
    b = k.log_normal(x, means, variances)
    score = {p: np.log(start[p[0]]) + sum(np.log(move[i, j]) for i, j in itertools.pairwise(p)) + sum(b[t, s] for t, s in enumerate(p)) for p in itertools.product((0, 1), repeat=7)}
    # beside sequences of other lengths
    whole, first = np.concatenate([RNG.normal(1, 1, 3), x, [0.5]]), np.array([0, 3, 10, 11])
    path, logp = k.viterbi(whole, first, start, move, means, variances)
    assert tuple(path[3:10]) == max(score, key=score.get) and np.isclose(logp[1], max(score.values()))
    total = np.log(sum(np.exp(v) for v in score.values()))
    gamma, moves, logl = k.forward_backward(whole, first, start, move, means, variances)
    assert np.isclose(logl[1], total) and np.isclose(moves[1].sum(), 6) and np.isclose(moves[0].sum(), 2) and not moves[2].any()
    assert np.allclose(gamma[3:10, 1], [sum(np.exp(v - total) for p, v in score.items() if p[t]) for t in range(7)])
    assert np.allclose(gamma.sum(axis=1), 1)
    assert [len(c) for c in k.by_length(first, 8)] == [1, 2]


def test_segmentation_costs():
    x = np.r_[np.zeros(20), np.ones(20) * 4] + RNG.normal(0, 0.1, 40)
    for cost, penalty in (("l2", 5), ("l1", 5), ("normal", 20), ("rbf", 2)):
        assert k.binary_segmentation(x, penalty, cost) == [20, 40]
    assert k.binary_segmentation(np.zeros(3), 1) == [3] and k.binary_segmentation(np.zeros(0), 1) == []


@pytest.mark.parametrize("cost", ["l2", "l1", "normal", "rbf"])
def test_costs_against_their_definitions(cost):
    x = RNG.normal(size=23)
    gaps = np.array([abs(a - b) for a, b in itertools.combinations(x, 2)])
    assert all(np.isclose(k.kth_gap(np.sort(x), j), np.sort(gaps)[j]) for j in (0, 100, len(gaps) - 1))
    gram = np.exp(-((x[:, None] - x[None, :]) ** 2) / np.median(gaps**2))

    def slow(a, b):
        part = x[a:b]
        if a == b:
            return 0.0
        return {"l2": lambda: ((part - part.mean()) ** 2).sum(), "l1": lambda: np.abs(part - np.median(part)).sum(), "normal": lambda: len(part) * np.log(part.var() + 1e-6), "rbf": lambda: len(part) - gram[a:b, a:b].sum() / len(part)}[cost]()

    left, right = k.segment_costs(x, cost, cells=40)(3, 20)
    assert np.allclose(left, [slow(3, j) for j in range(3, 21)]) and np.allclose(right, [slow(j, 20) for j in range(3, 21)])


def test_a_long_trajectory_needs_no_square():
    x = np.r_[np.zeros(6000), np.ones(6000) * 4] + RNG.normal(0, 0.1, 12_000)
    assert k.binary_segmentation(x, 100, "rbf", jump=1000) == [6000, 12_000]


def test_training_finds_the_states(spark):
    rows = []
    for t in range(6):
        state = 0
        for s in range(120):
            state = state if RNG.random() < 0.92 else 1 - state
            rows.append((t, s, float(RNG.normal((10, 30)[state], 3)), state))
    df = spark.createDataFrame(rows, "trajectory int, slice int, Intensity double, truth int")
    model, _ = hmm.train_hmm(df, hmm.Hmm(np.array([0.5, 0.5]), np.full((2, 2), 0.5), np.array([5.0, 40.0]), np.array([50.0, 50.0])))
    assert np.allclose(model.means, [10, 30], atol=1) and np.allclose(np.diag(model.move), 0.92, atol=0.05)
    got = hmm.decode(df, model).selectExpr("avg(cast(fit = truth as int)) as right", "max(abs(posterior_0 + posterior_1 - 1)) as off").collect()[0]
    assert got["right"] > 0.97 and got["off"] < 1e-9
    assert np.allclose(hmm.stationary(model) @ model.move, hmm.stationary(model))


def test_drift_correction_of_a_movie(spark):
    image = k.gaussian_blur(RNG.random((24, 24)), 1.5)
    frames_ = [(0, t, 0, 0, 24, 24, [float(v) for v in np.roll(image, (t, 2 * t), (0, 1)).ravel()]) for t in range(3)]
    df = spark.createDataFrame(frames_, "image_id int, t int, c int, z int, height int, width int, pixels array<float>")
    assert sorted((r["t"], r["dr"], r["dc"]) for r in frames.frame_shifts(df).collect()) == [(0, 0, 0), (1, 1, 2), (2, 2, 4)]
    assert frames.flat_field(df, 3.0).count() == 3
