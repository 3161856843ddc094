"""Hidden Markov models by blocks, and many models at once."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from glimmer.functions import kernels as k
from glimmer.jobs.registry import MODEL
from glimmer.operators import hmm
from glimmer.sources import views
from tests.conftest import SMALL

THREE = hmm.Hmm(np.array([0.2, 0.3, 0.5]), np.array([[0.8, 0.2, 0.0], [0.1, 0.8, 0.1], [0.0, 0.3, 0.7]]), np.array([10.0, 50.0, 90.0]), np.array([300.0, 200.0, 500.0]))


def rows(df, *names):
    return {(r["trajectory"], r["slice"]): tuple(r[n] for n in names) for r in df.collect()}


@pytest.mark.parametrize("block", [1, 7, 50, 5000])
@pytest.mark.parametrize("model", [MODEL, THREE])
def test_blocks_decode_as_whole_trajectories(spark, block, model):
    df = views.trajectories(spark, SMALL).where("trajectory < 6").withColumn("more", F.lit("x")).repartition(5)
    names = ["fit", "more", "fit_score", *(f"posterior_{i}" for i in range(len(model.means)))]
    whole, parts = rows(hmm.decode(df, model), *names), rows(hmm.decode(df, model, block=block), *names)
    assert whole.keys() == parts.keys() and len(whole) > 50
    for at, v in whole.items():
        assert parts[at][:2] == v[:2] and np.allclose(parts[at][2:], v[2:], atol=1e-8)
    sums = {tuple(r)[:3]: r["v"] for r in hmm.expectations(df, model).collect()}
    again = {tuple(r)[:3]: r["v"] for r in hmm.expectations(df, model, block=block).collect()}
    assert sums.keys() == again.keys() and all(np.isclose(sums[n], again[n]) for n in sums)


def test_one_long_trajectory_in_blocks(spark):
    df = spark.range(200_000).selectExpr("1 as trajectory", "int(id) as slice", "double(case when pmod(xxhash64(id div 40), 3) = 0 then 90 else 30 end + 20 * randn(3)) as Intensity").where("slice % 1000 <> 5 or Intensity > 0")
    x = np.array([r["Intensity"] for r in df.orderBy("slice").select("Intensity").collect()])
    path, score = k.viterbi(x, np.array([0, len(x)]), MODEL.start, MODEL.move, MODEL.means, MODEL.variances)
    got = hmm.decode(df, MODEL, block=8192).orderBy("slice").select("fit", "fit_score").collect()
    assert [r["fit"] for r in got] == path.tolist() and np.isclose(got[0]["fit_score"], score[0])


def test_training_by_blocks(spark):
    df = views.trajectories(spark, SMALL).where("trajectory < 4")
    a, total = hmm.train_hmm(df, MODEL, rounds=3)
    b, again = hmm.train_hmm(df, MODEL, rounds=3, block=16)
    assert np.isclose(total, again) and all(np.allclose(getattr(a, n), getattr(b, n)) for n in ("start", "move", "means", "variances"))


def test_each_model_is_the_one_of_its_trajectory_alone(spark):
    df = views.trajectories(spark, SMALL).where("trajectory < 5")
    fitted = hmm.fit_models(df, MODEL, rounds=200, tolerance=0.5).cache()
    got: dict = {}
    for r in fitted.collect():
        got.setdefault(r["trajectory"], {})[r["state"]] = r
    took = set()
    for t, states in got.items():
        m, logl = hmm.train_hmm(df.where(F.col("trajectory") == t), MODEL, rounds=200, tolerance=0.5)
        took.add(states[0]["rounds"])
        assert np.isclose(states[0]["logl"], logl)
        for i, r in states.items():
            assert np.allclose([r["start"], r["mean"], r["variance"], *r["moves"]], [m.start[i], m.means[i], m.variances[i], *m.move[i]], rtol=1e-6)
    assert len(got) == 5 and len(took) > 1  # each stops by itself
    decoded = rows(hmm.decode(df, fitted), "fit", "fit_score")
    t = min(got)
    own = got[t]
    alone = hmm.Hmm(*(np.array([own[i][n] for i in (0, 1)]) for n in ("start", "moves", "mean", "variance")))
    assert all(decoded[at][0] == v[0] and np.isclose(decoded[at][1], v[1]) for at, v in rows(hmm.decode(df.where(F.col("trajectory") == t), alone), "fit", "fit_score").items())


def test_only_the_letters_that_may_change_do(spark):
    df = views.trajectories(spark, SMALL).where("trajectory < 3")
    for r in hmm.fit_models(df, MODEL, rounds=2, update="m").collect():
        i = r["state"]
        assert (r["start"], r["variance"], list(r["moves"])) == (MODEL.start[i], MODEL.variances[i], MODEL.move[i].tolist()) and r["mean"] != MODEL.means[i]
    m, _ = hmm.train_hmm(df, MODEL, rounds=2, update="c")
    assert (m.means == MODEL.means).all() and (m.move == MODEL.move).all() and (m.variances != MODEL.variances).all()


def test_odd_trajectories(spark):
    df = spark.createDataFrame([(1, 0, 30.0), (2, 0, None), (None, 0, 1.0), (3, 0, 90.0), (3, 1, 90.0), (3, 2, 90.0)], "trajectory int, slice int, Intensity double")
    got = {(r["trajectory"], r["state"]): r for r in hmm.fit_models(df, MODEL).collect()}
    assert sorted(got) == [(1, 0), (1, 1), (3, 0), (3, 1)] and list(got[1, 0]["moves"]) == [0.8, 0.2]
    assert hmm.fit_models(df.limit(0), MODEL).count() == 0 and hmm.decode(df.limit(0), MODEL, block=5).count() == 0
    assert rows(hmm.decode(df, MODEL, block=2), "fit").keys() == {(1, 0), (3, 0), (3, 1), (3, 2)}
    assert hmm.decode(df, hmm.fit_models(df.where("trajectory = 3"), MODEL)).count() == 3  # the others have no model


def test_samples_are_the_same_at_any_partitioning(spark):
    df = views.trajectories(spark, SMALL)
    some = {r[0] for r in hmm.sample_groups(df, 0.5, 3).select("trajectory").distinct().collect()}
    assert some == {r[0] for r in hmm.sample_groups(df.repartition(7), 0.5, 3).select("trajectory").distinct().collect()}
    every = {r[0] for r in df.select("trajectory").distinct().collect()}
    assert set() < some < every and hmm.sample_groups(df, 0.0).count() == 0 and hmm.sample_groups(df, 1.0).count() == df.count()


def slow_round(series, model):
    """One round of training by plain loops over states and time; the new model and the log-likelihood before it."""
    n = len(model.means)
    start, w, wx, wxx, move, total = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n), np.zeros((n, n)), 0.0
    for x in series:
        density = np.exp(-0.5 * (x[:, None] - model.means) ** 2 / model.variances) / np.sqrt(2 * np.pi * model.variances)
        forward, back, scale = np.zeros((len(x), n)), np.ones((len(x), n)), np.zeros(len(x))
        for t in range(len(x)):
            row = (model.start if t == 0 else forward[t - 1] @ model.move) * density[t]
            scale[t], forward[t] = row.sum(), row / row.sum()
        for t in range(len(x) - 2, -1, -1):
            back[t] = model.move @ (density[t + 1] * back[t + 1]) / scale[t + 1]
            move += forward[t][:, None] * model.move * (density[t + 1] * back[t + 1])[None, :] / scale[t + 1]
        g = forward * back
        start, w, wx, wxx, total = start + g[0], w + g.sum(0), wx + g.T @ x, wxx + g.T @ x**2, total + np.log(scale).sum()
    return hmm.Hmm(start / start.sum(), move / move.sum(1, keepdims=True), wx / w, wxx / w - (wx / w) ** 2), total


def same(a, b):
    return all(np.allclose(getattr(a, n), getattr(b, n), rtol=1e-6) for n in ("start", "move", "means", "variances"))


def series_of(df):
    out: dict = {}
    for r in df.orderBy("trajectory", "slice").collect():
        out.setdefault(r["trajectory"], []).append(r["Intensity"])
    return [np.array(x, float) for x in out.values()]


def test_training_on_all_trajectories_as_one_sequence(spark):
    df = views.trajectories(spark, SMALL).where("trajectory < 6").repartition(5)
    whole = [np.concatenate(series_of(df))]
    want, last = MODEL, None
    for _ in range(3):
        want, last = slow_round(whole, want)
    for block in (None, 16):
        got, total = hmm.train_hmm(df, MODEL, rounds=3, legacy=True, block=block, tolerance=-np.inf)
        assert same(got, want) and np.isclose(total, last)
    alone, _ = hmm.train_hmm(df, MODEL, rounds=3, tolerance=-np.inf)
    assert not np.allclose(alone.move, want.move)  # ends lead into starts


def test_training_on_a_share_and_to_a_height(spark):
    df = views.trajectories(spark, SMALL)
    some = hmm.sample_groups(df, 0.4, 3)
    want, first = slow_round(series_of(some), MODEL)
    got, total = hmm.train_hmm(df, MODEL, rounds=1, fraction=0.4, seed=3)
    assert same(got, want) and np.isclose(total, first) and 0 < some.count() < df.count()
    again, second = slow_round(series_of(some), want)
    reached, total = hmm.train_hmm(df, MODEL, rounds=50, fraction=0.4, seed=3, reach=(first + second) / 2)
    assert same(reached, want) and np.isclose(total, second)  # the model that reaches it is returned
    for how in ({}, {"block": 5}, {"legacy": True}):
        kept, total = hmm.train_hmm(df.limit(0), MODEL, **how)
        assert same(kept, MODEL) and total == 0.0
