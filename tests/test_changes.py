"""Change points: nulls, and the search by blocks against the search of whole trajectories."""

from __future__ import annotations

import numpy as np
import pytest

from glimmer.functions import kernels
from glimmer.operators import segments

RNG = np.random.default_rng(12)
KIND = "trajectory int, slice int, Intensity double"


def series() -> dict[int, list[float]]:
    steps = lambda sizes, noise: np.concatenate([RNG.normal(m, noise, n) for n, m in sizes])
    out = {1: steps([(40, 0), (40, 4)], 0.1), 2: steps([(33, 0), (51, 3), (20, -2), (90, 1)], 0.3), 3: RNG.normal(size=130), 4: np.zeros(70), 5: steps([(8, 1), (5, 9)], 0.1), 6: np.round(RNG.normal(0, 2, 97)), 7: [3.0], 8: steps([(17, 5), (16, 0), (17, 5), (16, 0), (64, 2)], 0.5)}
    return {k: list(map(float, v)) for k, v in out.items()}


def found(df, **how) -> dict[int, list[int]]:
    return {r["trajectory"]: r["bkps"] for r in segments.change_points(df, **how).collect()}


@pytest.mark.parametrize("cost", ["l1", "l2", "normal", "rbf"])
def test_missing_values_are_left_out(spark, cost):
    x = np.r_[np.zeros(40), np.ones(40) * 4] + RNG.normal(0, 0.05, 80)
    penalty = 25.0 if cost == "normal" else 3.0
    whole = kernels.binary_segmentation(x, penalty, cost)
    assert whole == [40, 80]
    odd = [None, float("nan"), float("inf"), float("-inf")]
    rows, at = [], [0]
    for k, v in enumerate(x):
        rows.append(float(v))
        if k % 9 == 4:
            rows.append(odd[k % 4])
        at.append(len(rows))
    data = [(1, t, v) for t, v in enumerate(rows)] + [(2, t, None) for t in range(6)] + [(None, 0, 1.0)] + [(3, t, float(v)) for t, v in enumerate(x)]
    df = spark.createDataFrame(data, KIND).repartition(3)
    for block in (8192, 16):
        assert found(df, penalty=penalty, cost=cost, block=block) == {1: [at[40], len(rows)], 2: [6], 3: [40, 80]}
    assert found(df.limit(0), cost=cost) == {}


@pytest.mark.parametrize(("cost", "penalty"), [("l2", 3.0), ("normal", 12.0), ("rbf", 1.0)])
@pytest.mark.parametrize("block", [16, 37])
def test_blocks_find_what_the_whole_search_finds(spark, cost, penalty, block):
    each = series()
    df = spark.createDataFrame([(k, t, v) for k, x in each.items() for t, v in enumerate(x)], KIND).repartition(5)
    want = {k: kernels.binary_segmentation(np.array(x), penalty, cost) for k, x in each.items()}
    assert found(df, penalty=penalty, cost=cost, block=block) == want and max(map(len, want.values())) > 3


def test_kept_sums_equal_the_strips():
    x = RNG.normal(size=50)
    kept, strips = kernels.segment_costs(x, "rbf"), kernels.segment_costs(x, "rbf", cells=60)
    for a, b in ((0, 50), (7, 33), (20, 21)):
        assert all(np.allclose(p, q) for p, q in zip(kept(a, b), strips(a, b), strict=True))


def test_a_split_elsewhere_does_not_matter():
    x = np.concatenate([RNG.normal(m, 0.2, 30) for m in (0, 3, 1, 4)])
    ends = kernels.binary_segmentation(x, 5.0, "l2")
    inner = kernels.binary_segmentation(x[ends[0] : ends[2]], 5.0, "l2", offset=ends[0])
    assert inner == ends[1:3]


def test_a_million_rows_in_blocks(spark):
    df = spark.range(1_000_000).selectExpr("1 as trajectory", "int(id) as slice", "double(case when id < 300000 then 0 when id < 700010 then 5 else 2 end + rand(7)) as Intensity")
    assert found(df, penalty=100_000.0, cost="l2") == {1: [300_000, 700_010, 1_000_000]}
