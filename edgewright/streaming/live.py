"""The monitor on a stream of closed trades: state is a book's CUSUM, its rolling window and its dates."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from edgewright.functions.scalars import Baseline, CusumDesign, cusum_design
from edgewright.operators.monitor import ROLLING, SLIP

OUT = "book string, n long, cusum double, peak double, rolling_ratio double, label string"
STATE = "n long, cusum double, peak double, last array<double>"


ORDERED_STATE = STATE + ", at array<long>, seq array<long>, r array<double>"


def _stepped(n: int, level: float, peak: float, last: list[float], values: list[float], design: CusumDesign, window: int) -> tuple[int, float, float, list[float]]:
    """A book's state after more trades; a missing r leaves the CUSUM as it was."""
    for r in values:
        n += 1
        if r == r:
            level = max(0.0, level + (design.k - r) / design.sigma)
        peak = max(peak, level)
        last = [*last, float(r)][-window:]
    return n, level, peak, last


def _said(key: tuple, n: int, level: float, peak: float, last: list[float], base: Baseline, design: CusumDesign, window: int, slip: float) -> dict:
    ratio = sum(last) / window / base.reference if len(last) == window else None
    label = "DEGRADED" if peak > design.h else "SLIPPING" if ratio is not None and ratio < slip else "HOLDING"
    return {"book": [key[0]], "n": [n], "cusum": [level], "peak": [peak], "rolling_ratio": [ratio], "label": [label]}


def ordered_monitor(trades: DataFrame, base: Baseline, *, time: str = "exit_date", delay: str = "1 day", design: CusumDesign | None = None, window: int = ROLLING, slip: float = SLIP) -> DataFrame:
    """``live_monitor`` for sources that deliver late, out of order and more than once. ``trades`` streams (book, trade_seq,
    ``time``, r).

    A trade waits in its book's state until the watermark, which trails the latest time seen by ``delay``, has passed it;
    trades then count in order of time and trade_seq, each once. A row behind the watermark, be it a repeat of a counted
    trade or one later than ``delay`` allows, Spark drops, and tells how many in the query's progress. So a row says what a
    batch would say of all trades up to the watermark, whatever way they came.
    """
    design = design or cusum_design(base)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, level, peak, last, *held = state.get if state.exists else (0, 0.0, 0.0, [], [], [], [])
        waiting = {int(q): (int(t), float(x)) for t, q, x in zip(*held, strict=True)}
        for frame in () if state.hasTimedOut else frames:
            for t, q, x in zip(frame[time].astype("datetime64[us]").astype("int64"), frame["trade_seq"], frame["r"].astype(float), strict=True):
                waiting.setdefault(int(q), (int(t), x))
        passed = state.getCurrentWatermarkMs() * 1000
        ready = sorted((t, q, x) for q, (t, x) in waiting.items() if t < passed)
        if ready:
            n, level, peak, last = _stepped(n, level, peak, list(last), [x for _, _, x in ready], design, window)
            waiting = {q: v for q, v in waiting.items() if v[0] >= passed}
        rest = sorted((t, q, x) for q, (t, x) in waiting.items())
        state.update((n, level, peak, list(last), [t for t, _, _ in rest], [q for _, q, _ in rest], [x for _, _, x in rest]))
        if rest:
            state.setTimeoutTimestamp(max(rest[0][0] // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(_said(key, n, level, peak, list(last), base, design, window, slip))

    return trades.withWatermark(time, delay).groupBy("book").applyInPandasWithState(step, OUT, ORDERED_STATE, "update", GroupStateTimeout.EventTimeTimeout)


def live_monitor(trades: DataFrame, base: Baseline, *, design: CusumDesign | None = None, window: int = ROLLING, slip: float = SLIP) -> DataFrame:
    """A row for each book of each micro-batch that closed trades of it. ``trades`` streams (book, trade_seq, r).

    The baseline is frozen when the query starts. Trades of one batch count in order of trade_seq; batches count as
    they come, so a source must deliver a book's trades in order.
    """
    design = design or cusum_design(base)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, level, peak, last = state.get if state.exists else (0, 0.0, 0.0, [])
        values = pd.concat(list(frames)).sort_values("trade_seq")["r"].tolist()
        n, level, peak, last = _stepped(n, level, peak, list(last), values, design, window)
        state.update((n, level, peak, last))
        yield pd.DataFrame(_said(key, n, level, peak, last, base, design, window, slip))

    return trades.groupBy("book").applyInPandasWithState(step, OUT, STATE, "update", GroupStateTimeout.NoTimeout)
