"""Pulses of live trajectories: a pulse is given out as soon as its state ends."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

PULSE = "trajectory long, state int, dur double, Intensity double, start_frame long, end_frame long"
_STATE = "state int, start long, n long, total double, last long"


def _advance(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = pd.concat(parts).sort_values("slice")
    now, start, n, total, last = state.get if state.exists else (None, 0, 0, 0.0, -1)
    out = []
    for at, fit, value in zip(rows["slice"], rows["fit"], rows["Intensity"], strict=True):
        if at <= last:  # came late or again
            continue
        if now is not None and fit != now:
            out.append((key[0], now, float(n), total / n, start, int(at)))
        if now is None or fit != now:
            now, start, n, total = int(fit), int(at), 0, 0.0
        n, total, last = n + 1, total + float(value), int(at)
    state.update((now, start, n, total, last))
    yield pd.DataFrame(out, columns=["trajectory", "state", "dur", "Intensity", "start_frame", "end_frame"])


def live_pulses(stream: DataFrame) -> DataFrame:
    """Ended runs of a stream of (trajectory, slice, Intensity, fit); the state of a trajectory is five numbers.

    Rows of a trajectory count in the order of their slices within a batch; one at or before the last slice seen is left
    out. The run that is still going on is given out by no batch, as the last run isn't in batch mode either.
    """
    rows = stream.selectExpr("cast(trajectory as long) trajectory", "cast(slice as long) slice", "cast(Intensity as double) Intensity", "cast(fit as int) fit").where("trajectory is not null and slice is not null and fit is not null")
    return rows.groupBy("trajectory").applyInPandasWithState(_advance, PULSE, _STATE, "append", GroupStateTimeout.NoTimeout)
