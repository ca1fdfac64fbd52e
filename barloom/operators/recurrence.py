"""Recurrences over a series: exponential averages and what follows from them, in one pass a series."""

from __future__ import annotations

from math import nan

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .scan import scan


class Smooth:
    """y = alpha x + (1 - alpha) y, seeded at row length - 1 with the mean of the rows so far.

    Nulls (NaN) in the seed's rows are left out of its mean; one after it, or only nulls before,
    makes the rest null. A series shorter than length starts with its first value. With
    skip the rows before the first value do not count, and a shorter series has no values.

    Called with a series' rows part after part; without skip, the first part holds the seed's rows or the whole series.
    """

    def __init__(self, length: int, alpha: float, skip: bool = False):
        self.length, self.alpha, self.skip = length, alpha, skip
        self.y: float | None = None
        self.first: list[float] = []

    def _seed(self, x: np.ndarray) -> int | None:
        """The place in x of the first value of the average, which is then in y; None if it lies further on."""
        if not self.skip:
            if len(x) < self.length:
                self.y = float(x[0])
                return 0
            self.first, at = x[: self.length].tolist(), self.length - 1
        else:
            known = np.flatnonzero(~np.isnan(x))
            start = 0 if self.first else known[0] if len(known) else len(x)
            at = start + self.length - len(self.first) - 1
            self.first += x[start : at + 1].tolist()
            if at >= len(x):
                return None
        rows = np.array(self.first)
        rows, self.first = rows[~np.isnan(rows)], []
        self.y = float(rows.mean()) if len(rows) else nan
        return at

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), nan)
        if self.length <= 0 or not len(x):
            return out
        after = 0
        if self.y is None:
            at = self._seed(x)
            if at is None:
                return out
            out[at], after = self.y, at + 1
        y, alpha, result = self.y, self.alpha, []
        for value in x[after:].tolist():
            y = alpha * value + (1 - alpha) * y
            result.append(y)
        out[after:] = result
        self.y = y
        return out


class Lag:
    """The value of the row before."""

    last = nan

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = np.r_[self.last, x[:-1]]
        self.last = x[-1]
        return out


def ema(length: int, skip: bool = False) -> Smooth:
    return Smooth(length, 2.0 / (length + 1.0) if length > 0 else 0.0, skip)


def rma(length: int) -> Smooth:
    return Smooth(length, 1.0 / length if length > 0 else 0.0)


def average_range(length: int):
    before, average = Lag(), rma(length)

    def step(b):
        p = before(b["Close"])
        return average(np.maximum(b["High"] - b["Low"], np.maximum(np.abs(b["High"] - p), np.abs(b["Low"] - p))))

    return step


# Each of these starts a series: it returns the step that takes the series' rows part after part.


def rsi(reference, length=14):
    before, gains, losses = Lag(), rma(length), rma(length)

    def step(b):
        d = b["Close"] - before(b["Close"])
        gain, loss = gains(np.where(d > 0, d, 0.0)), losses(np.where(d < 0, -d, 0.0))
        out = 100.0 - 100.0 / (1.0 + gain / np.where(np.abs(loss) <= 1e-8, nan, loss))
        if not reference:
            out = np.where(np.abs(loss) <= 1e-8, np.where(np.abs(gain) <= 1e-8, 50.0, 100.0), out)
        return {"rsi": out}

    return step


def macd(reference, fast=12, slow=26, signal_len=9):
    quick, late, smoothed = ema(fast), ema(slow), ema(signal_len, skip=not reference)

    def step(b):
        line = quick(b["Close"]) - late(b["Close"])
        signal = smoothed(line)
        return {"macd_line": line, "macd_signal": signal, "macd_hist": line - signal}

    return step


def keltner(reference, length=20, atr_mult=2.0):
    middle, spread = ema(length), average_range(length)

    def step(b):
        basis, width = middle(b["Close"]), atr_mult * spread(b)
        return {"kc_basis": basis, "kc_upper": basis + width, "kc_lower": basis - width}

    return step


def dmi_adx(reference, length=14):
    high, low, spread, ups, downs, adx = Lag(), Lag(), average_range(length), rma(length), rma(length), rma(length)

    def step(b):
        up, down = b["High"] - high(b["High"]), low(b["Low"]) - b["Low"]
        span = np.maximum(spread(b), 1e-12)
        plus = 100.0 * ups(np.where((up > down) & (up > 0), up, 0.0)) / span
        minus = 100.0 * downs(np.where((down > up) & (down > 0), down, 0.0)) / span
        dx = 100.0 * np.abs(plus - minus) / np.maximum(plus + minus, 1e-12)
        return {"plus_di": plus, "minus_di": minus, "adx": adx(dx)}

    return step


def supertrend(reference, length=10, multiplier=3.0):
    """Reference bands only ever tighten; the intended ones reset when the close passes them."""
    spread, last = average_range(length), None

    def step(b):
        nonlocal last
        middle, width = (b["High"] + b["Low"]) / 2.0, multiplier * spread(b)
        lines, ways = [], []
        for close, upper, lower in zip(b["Close"].tolist(), (middle + width).tolist(), (middle - width).tolist()):
            if last is None:
                line, way = nan, 1.0
            else:
                close_before, top, bottom, before = last
                if top == top and not upper < top and (reference or close_before <= top):
                    upper = top if upper == upper else nan
                if bottom == bottom and not lower > bottom and (reference or close_before >= bottom):
                    lower = bottom if lower == lower else nan
                if before != before:
                    line, way = (upper, -1.0) if close <= upper else (lower, 1.0)
                elif close > before:
                    line, way = max(lower, before), 1.0
                else:
                    line, way = min(upper, before), -1.0
            last = close, upper, lower, line
            lines.append(line)
            ways.append(way)
        return {"supertrend": np.array(lines), "supertrend_dir": np.array(ways)}

    return step


def ema_of(reference, column="Close", length=20, name="ema"):
    average = ema(length)
    return lambda b: {name: average(b[column])}


def atr_of(reference, length=14):
    average = average_range(length)
    return lambda b: {"atr": average(b)}


#: What each recurrence adds to the bars.
OUTPUTS = {
    "rsi": (rsi, ("rsi",)), "macd": (macd, ("macd_line", "macd_signal", "macd_hist")),
    "keltner": (keltner, ("kc_basis", "kc_upper", "kc_lower")), "dmi_adx": (dmi_adx, ("plus_di", "minus_di", "adx")),
    "supertrend": (supertrend, ("supertrend", "supertrend_dir")), "ema": (ema_of, None), "atr": (atr_of, ("atr",)),
}


def with_recurrences(df: DataFrame, wanted: list[tuple[str, dict, str]], reference: bool = True) -> DataFrame:
    """df with the outputs of recurrences (name, parameters, prefix of the columns).

    All recurrences run in one pass over each series, in memory that does not grow with it. A series is one
    task's work, row after row, since each value depends on the one before.
    """
    if not wanted:
        return df
    names = [f"{prefix}{o}" for name, p, prefix in wanted for o in (OUTPUTS[name][1] or (p.get("name", "ema"),))]
    schema = T.StructType([*df.schema.fields, *[T.StructField(x, T.DoubleType()) for x in names]])
    #: seeds need as many rows as the greatest length among the parameters, given or by default
    head = max(x for name, p, _ in wanted for x in (*(OUTPUTS[name][0].__defaults__ or ()), *p.values()) if isinstance(x, int))

    def start():
        steps = [(OUTPUTS[name][0](reference, **p), prefix) for name, p, prefix in wanted]
        return lambda b: {f"{prefix}{k}": x for step, prefix in steps for k, x in step(b).items()}

    return scan(df, schema, start, head)
