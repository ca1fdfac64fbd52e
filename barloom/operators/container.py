"""One series of bars as a container: positions, sessions, ranges, levels."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..bars import COLUMNS, BarError
from ..functions.times import bar_time
from ..streaming.live import LevelTracker
from . import sessions as se
from .clean import violations


class BarSeries:
    """Bars of one series by position, with checks on the way in.

    Times are read as of bar_time (a clock without a zone is UTC where tz is given). Unless
    `assume_clean`, times must increase strictly (if enforce_strict_order) and prices keep their bounds, else BarError: one
    aggregation. A pandas frame without the time column gives its index. Positions are those of
    the input; `push` feeds bars to the day's levels one by one, in batches use level_flags().
    """

    def __init__(self, source, timestamp_col: str = "Datetime", session_config: se.SessionConfig = se.DEFAULT, tz: str | None = None, enforce_strict_order: bool = True, assume_clean: bool = False):
        if not isinstance(source, DataFrame):  # pandas
            if timestamp_col not in source.columns:
                source = source.reset_index()
                source = source if timestamp_col in source.columns else source.rename(columns={source.columns[0]: timestamp_col})
            source = SparkSession.getActiveSession().createDataFrame(source)
        if missing := [c for c in (timestamp_col, *COLUMNS[1:]) if c not in source.columns]:
            raise BarError(f"not bars: without {missing}")
        at = F.col(f"`{timestamp_col}`")
        at = at.cast("timestamp_ntz") if assume_clean else bar_time(at, dict(source.dtypes)[timestamp_col], tz)
        order = F.col("ord") if "ord" in source.columns else F.monotonically_increasing_id()
        self.sessions, self.tracker = session_config, LevelTracker(session_config)
        bars = source.select(F.lit("all").alias("series"), order.alias("ord"), at.alias("Datetime"), *[F.col(c).cast("double").alias(c) for c in COLUMNS[1:]])
        if not assume_clean:
            found = violations(bars).first()
            if enforce_strict_order and found["not_increasing"]:
                raise BarError(f"{found['not_increasing']} bars are not later than the one before")
            if found["low_above"] or found["high_below"]:
                raise BarError(f"prices out of bounds: {found['low_above']} lows, {found['high_below']} highs")
        self.bars = se.with_index(se.with_sessions(bars, session_config))

    def __len__(self) -> int:
        return self.bars.count()

    def __getitem__(self, at: int | slice) -> Row | list[Row]:
        n = len(self)
        if isinstance(at, slice):
            places = range(*at.indices(n))
            rows = {r["idx"]: r for r in self.bars.where(F.col("idx").between(min(places), max(places))).collect()} if places else {}
            return [rows[i] for i in places]
        if not -n <= at < n:
            raise IndexError(at)
        return self.bars.where(F.col("idx") == at % n).first()

    def __iter__(self) -> Iterator[Row]:
        return self.bars.orderBy("ord").toLocalIterator()

    def __repr__(self) -> str:
        n, a, b = self.bars.agg(F.count("*"), F.min_by("Datetime", "ord"), F.max_by("Datetime", "ord")).first()
        return f"BarSeries({n} bars from {a} to {b})" if n else "BarSeries(no bars)"

    def _window(self, start: int, end: int | None) -> tuple[int, int]:
        n = len(self)
        end = n - 1 if end is None else end
        if not n:
            raise BarError("there are no bars")
        if start < 0 or end >= n:  # tested before the ends are swapped
            raise BarError(f"positions {start} to {end} are not all within 0 to {n - 1}")
        return min(start, end), max(start, end)

    def high_low(self, start: int, end: int) -> tuple[float, float]:
        """High and low between two inclusive positions, in either order."""
        r = se.high_low(self.bars, *self._window(start, end)).first()
        return r["high"], r["low"]

    def session_high_low(self, session: str, start: int = 0, end: int | None = None) -> tuple[float, float]:
        """The same of one session's bars; BarError if it is unknown or has none there."""
        r = se.session_high_low(self.bars.drop("session"), session, *self._window(start, end), self.sessions).first()
        if r is None:
            raise BarError(f"{session} has no bars there")
        return r["high"], r["low"]

    def daily_levels(self) -> DataFrame:
        return se.daily_levels(self.bars.drop("session"), self.sessions)

    def level_flags(self, rollover_hour: int | None = None) -> DataFrame:
        return se.level_flags(self.bars.drop("session", "idx"), self.sessions, rollover_hour)

    def push(self, bar: Row) -> dict:
        """Feeds a bar to the day's levels: rolling and final ones by session as (high, low), and how many flags wait."""
        self.tracker.push(str(bar["Datetime"].date()), bar["session"], bar["High"], bar["Low"])
        rolling = {n: (x[0], x[1]) for n, x in self.tracker.levels.items()}
        return {"rolling": rolling, "final": self.tracker.final_levels(), "flags": len(self.tracker.flags)}
