"""Structured Streaming: bars from ticks, and touches of session levels as bars arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.sessions import DEFAULT, SessionConfig, session_of

FLAGS = "series string, day date, touched_session string, which string, level double, by_session string, at_index long, timestamp timestamp"
_STATE = "day string, session string, idx long, names array<string>, highs array<double>, lows array<double>, final array<boolean>"


def stream_bars(ticks: DataFrame, every: str, time: str, price: Column, ident: list[str], series: Column, late: str = "10 minutes") -> DataFrame:
    """Bars of a stream of ticks, emitted once the watermark has passed their end."""
    order = F.struct(time, *ident)
    rows = ticks.withWatermark(time, late).select(series.alias("series"), time, price.alias("p"), order.alias("o"))
    bars = rows.groupBy("series", F.window(time, every).alias("w")).agg(
        F.min_by("p", "o").alias("Open"), F.max("p").alias("High"), F.min("p").alias("Low"), F.max_by("p", "o").alias("Close"), F.count("*").cast("double").alias("Volume")
    )
    return bars.select("series", F.col("w.start").alias("Datetime"), "Open", "High", "Low", "Close", "Volume")


class LevelTracker:
    """One series' levels of the day: push a bar, get the flags it raises.

    Flags are also held until consume(); a new day drops those that were not read.
    """

    def __init__(self, cfg: SessionConfig = DEFAULT, state: tuple | None = None):
        self.cfg = cfg
        day, session, idx, names, highs, lows, final = state or (None, None, -1, [], [], [], [])
        self.day, self.session, self.idx = day, session, idx
        self.levels = {n: [h, low, f] for n, h, low, f in zip(names, highs, lows, final)}
        self.flags: list[tuple] = []

    def state(self) -> tuple:
        return (self.day, self.session, self.idx, list(self.levels), *[[x[i] for x in self.levels.values()] for i in range(3)])

    def push(self, day: str, session: str, high: float, low: float) -> list[tuple]:
        """(touched session, side, level) of a bar: a new day forgets all levels first."""
        self.idx += 1
        if day != self.day:
            self.day, self.session, self.levels, self.flags = day, None, {}, []
        if self.session != session and self.session in self.levels:
            self.levels[self.session][2] = True
        if session in self.cfg.tracked:
            known = self.levels.setdefault(session, [high, low, False])
            if not known[2]:
                known[:2] = [max(known[0], high), min(known[1], low)]
        self.session = session
        new = [(n, side, level) for n, (top, bottom, final) in self.levels.items() if final and n != session for side, level in (("low", bottom), ("high", top)) if low <= level <= high]
        self.flags += new
        return new

    def consume(self) -> list[tuple]:
        """The flags raised since the last call."""
        out, self.flags = self.flags, []
        return out

    def final_levels(self) -> dict[str, tuple[float, float]]:
        """(high, low) of the day's sessions that are over."""
        return {n: (high, low) for n, (high, low, final) in self.levels.items() if final}

    def reset(self) -> None:
        """Forgets the day, its levels and all flags; positions go on."""
        self.day, self.session, self.levels, self.flags = None, None, {}, []


def stream_level_flags(bars: DataFrame, cfg: SessionConfig = DEFAULT, rollover_hour: int = 0) -> DataFrame:
    """Flags of a stream of bars (series, Datetime timestamp, High, Low), in order of time in each batch.

    State is a few numbers a series: the day's levels and the last index.
    """
    day = F.date_format(F.col("Datetime") + F.make_dt_interval(hours=F.lit((24 - rollover_hour) % 24)), "yyyy-MM-dd")
    minute = F.hour("Datetime") * 60 + F.minute("Datetime")
    rows = bars.select("series", "Datetime", "High", "Low", day.alias("day"), session_of(minute, cfg).alias("session"))

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        tracker = LevelTracker(cfg, state.get if state.exists else None)
        pdf = pd.concat(list(batches)).sort_values("Datetime", kind="stable")
        out = []
        for b in pdf.itertuples():
            for name, side, level in tracker.push(b.day, b.session, b.High, b.Low):
                out.append((key[0], pd.Timestamp(b.day).date(), name, side, level, b.session, tracker.idx, b.Datetime))
        state.update(tracker.state())
        yield pd.DataFrame(out, columns=[x.split()[0] for x in FLAGS.split(", ")])

    return rows.groupBy("series").applyInPandasWithState(step, FLAGS, _STATE, "append", "NoTimeout")
