"""Whitening against numpy over all rows, and its edges."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from glimmer.llm import common, whiten
from glimmer.llm.common import table
from tests.conftest import SMALL

KIND = "vec_id long, embedding array<float>"


def plain(vectors: np.ndarray, most: int = 32):
    x = np.floor(64 * vectors.astype(float)).astype(np.int64) + 1_000_000
    n, away = len(x), len(x) * x - x.sum(axis=0)
    y = away / n
    e, v = np.linalg.eigh(y.T @ y / n)
    e, v = e[::-1], v[:, ::-1]
    return (away**2).sum(axis=1), y @ v[:, :most] / np.sqrt(e[:most]), e[:most] / e.sum()


def test_equals_numpy_over_all_rows(spark):
    rows = sorted(table(spark, SMALL, "embeddings").collect(), key=lambda r: r["vec_id"])
    deviation, z, explained = plain(np.array([r["embedding"] for r in rows]))
    got = whiten.op12_whitening(spark, SMALL).toPandas().sort_values(["vec_id", "component"])
    mine = got["whitened"].to_numpy().reshape(len(rows), 32)
    assert np.abs(mine * np.sign((mine * z).sum(axis=0)) - z).max() < 1e-9
    assert (got["deviation"].to_numpy().reshape(-1, 32)[:, 0] == deviation).all() and set(got["n"]) == {len(rows)}
    assert np.abs(got["explained"].to_numpy()[:32] - explained).max() < 1e-12 and got["identity_error"].max() < 1e-9


def test_copies_weigh_as_often_as_they_come(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT", 4)  # the copies are broadcast, the others joined
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 5)).astype(np.float32)
    vectors = np.concatenate([base, np.repeat(base[:1], 40, axis=0)])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], KIND).repartition(3)
    got = whiten.whitened(df).toPandas().sort_values(["vec_id", "component"])
    deviation, z, _ = plain(vectors)
    mine = got["whitened"].to_numpy().reshape(100, 5)
    assert np.abs(mine * np.sign((mine * z).sum(axis=0)) - z).max() < 1e-9
    assert got["deviation"].to_numpy().reshape(100, 5)[:, 0].tolist() == deviation.tolist()
    once = whiten.whitened(df, weights="one").toPandas().sort_values(["vec_id", "component"])
    _, z, _ = plain(base)
    mine = once[once["vec_id"] < 60]["whitened"].to_numpy().reshape(60, 5)
    assert set(once["n"]) == {60} and np.abs(mine * np.sign((mine * z).sum(axis=0)) - z).max() < 1e-9


def test_left_out_repeated_and_extra(spark):
    rows = [(1, [0.5, 1.0]), (1, [0.5, 1.0]), (None, [0.25, -1.0]), (2, [1.5, 0.0]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 0.0]), (7, [1.0]), (8, [])]
    df = spark.createDataFrame(rows, KIND)
    for c in ("x", "d", "m", "n", "component", "z", "e"):
        df = df.withColumn(c, F.lit("clash"))
    got = whiten.whitened(df).collect()
    assert sorted((r["vec_id"] or 0, r["component"]) for r in got) == [(0, 1), (0, 2), (1, 1), (1, 1), (1, 2), (1, 2), (2, 1), (2, 2)]
    assert {r["n"] for r in got} == {4}
    assert whiten.whitened(df.limit(0)).count() == 0
    assert whiten.whitened(spark.createDataFrame([(1, [1.0, 2.0])] * 3, KIND)).count() == 0  # no variance


def test_huge_entries_and_long_vectors(spark):
    huge = whiten.whitened(spark.createDataFrame([(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [0.0, 5.0])], KIND)).collect()
    assert {r["vec_id"]: r["deviation"] for r in huge}[1] is None and len(huge) == 3
    long = np.random.default_rng(1).normal(size=(40, 3000)).astype(np.float32)
    got = whiten.whitened(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(long)], KIND)).toPandas()
    assert len(got) == 40 * 32 and got["identity_error"].max() < 1e-4


def test_weights_are_checked(spark):
    with pytest.raises(ValueError):
        whiten.whitened(table(spark, SMALL, "embeddings"), weights="two")
