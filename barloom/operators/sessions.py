"""Trading sessions: labels, ranges, daily levels and the bars that touch them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..bars import BarError
from ..functions.scalars import minute_of_day
from .scan import scan


@dataclass(frozen=True)
class SessionConfig:
    """Name -> inclusive minute ranges, in order of precedence; the fallback takes the rest."""

    ranges: tuple[tuple[str, tuple[tuple[int, int], ...]], ...]
    fallback: str = "Off"
    cycle: tuple[str, ...] = ("Asia", "London", "NY AM", "NY PM")

    @property
    def tracked(self) -> list[str]:
        return [n for n, _ in self.ranges if n != self.fallback]

    def disjoint(self) -> bool:
        seen = [0] * 1440
        for _, ranges in self.ranges:
            for a, b in ranges:
                for m in range(max(a, 0), min(b, 1439) + 1):
                    seen[m] += 1
        return max(seen) <= 1


# The default sessions, in minutes of the day.
DEFAULT = SessionConfig(
    (
        ("Asia", ((18 * 60, 23 * 60 + 59), (0, 60 + 59))),
        ("London", ((2 * 60, 6 * 60 + 59),)),
        ("NY AM", ((7 * 60, 10 * 60 + 59),)),
        ("NY PM", ((11 * 60, 15 * 60 + 59),)),
        ("Off", ((16 * 60, 17 * 60 + 59),)),
    )
)


def session_of(minute: Column, cfg: SessionConfig = DEFAULT) -> Column:
    """The first session whose range holds the minute, else the fallback."""
    out = None
    for name, ranges in cfg.ranges:
        for a, b in ranges:
            test = minute.between(a, b)
            out = F.when(test, name) if out is None else out.when(test, name)
    return F.lit(cfg.fallback) if out is None else out.otherwise(cfg.fallback)


def _sticky(cfg: SessionConfig):
    ranges = dict(cfg.ranges)

    def inside(name: str, m: int) -> bool:
        return any(a <= m <= b for a, b in ranges.get(name, ()))

    now = None

    def label(b):
        nonlocal now
        out = []
        for m in b["_minute"]:
            if now in cfg.cycle and inside(now, m):
                pass
            elif now in cfg.cycle and inside(nxt := cfg.cycle[(cfg.cycle.index(now) + 1) % len(cfg.cycle)], m):
                now = nxt
            elif now in cfg.cycle and inside(cfg.fallback, m):
                now = cfg.fallback
            else:
                now = next((n for n in ranges if inside(n, m)), cfg.fallback)
            out.append(now)
        return {"session": out}

    return label


def with_sessions(bars: DataFrame, cfg: SessionConfig = DEFAULT) -> DataFrame:
    """bars with `session`: an expression for disjoint ranges, else one sequential pass a series.

    Overlapping ranges are sticky: a bar stays in its session while that holds, then the next one
    of the cycle is tried, then the fallback, then all in order.
    """
    if missing := [s for s in cfg.cycle if s not in dict(cfg.ranges)]:
        raise BarError(f"sessions missing from the configuration: {missing}")
    if cfg.disjoint():
        return bars.withColumn("session", session_of(minute_of_day(), cfg))
    rows = bars.withColumn("_minute", minute_of_day())
    schema = T.StructType([*bars.schema.fields, T.StructField("session", T.StringType())])
    return scan(rows, schema, partial(_sticky, cfg))


def with_index(bars: DataFrame) -> DataFrame:
    """bars with `idx`, their position in the series from 0."""
    return bars.withColumn("idx", F.row_number().over(Window.partitionBy("series").orderBy("ord")) - 1)


def _ends(bars: DataFrame, start: int | None, end: int | None) -> DataFrame:
    rows = bars if "idx" in bars.columns else with_index(bars)
    if start is None and end is None:
        return rows
    a, b = sorted((0 if start is None else start, (1 << 31) - 1 if end is None else end))
    if a < 0:
        raise IndexError("positions start at 0")
    return rows.where(F.col("idx").between(a, b))


def high_low(bars: DataFrame, start: int, end: int) -> DataFrame:
    """High and low of each series between two inclusive positions, in either order."""
    return _ends(bars, start, end).groupBy("series").agg(F.max("High").alias("high"), F.min("Low").alias("low"))


def ranges_high_low(bars: DataFrame, ranges: DataFrame) -> DataFrame:
    """High and low for many (range_id, series, start, end); one range join."""
    rows = with_index(bars).select("series", "idx", "High", "Low")
    r = ranges.select("range_id", F.col("series").alias("_s"), F.least("start", "end").alias("_a"), F.greatest("start", "end").alias("_b"))
    joined = rows.join(r, (F.col("series") == F.col("_s")) & F.col("idx").between(F.col("_a"), F.col("_b")))
    return joined.groupBy("range_id").agg(F.max("High").alias("high"), F.min("Low").alias("low"))


def session_high_low(bars: DataFrame, session: str, start: int | None = None, end: int | None = None, cfg: SessionConfig = DEFAULT) -> DataFrame:
    if session not in {n for n, _ in cfg.ranges} | {cfg.fallback}:
        raise BarError(f"no session is named {session!r}")
    rows = _ends(with_sessions(bars, cfg), start, end).where(F.col("session") == session)
    return rows.groupBy("series").agg(F.max("High").alias("high"), F.min("Low").alias("low"))


def trading_day(rollover_hour: int | None = None) -> Column:
    """The calendar day, or with a rollover hour the day that starts at that hour of the day before."""
    t = F.col("Datetime")
    return F.to_date(t if not rollover_hour else t + F.make_dt_interval(hours=F.lit(24 - rollover_hour)))


def daily_levels(bars: DataFrame, cfg: SessionConfig = DEFAULT, rollover_hour: int | None = None) -> DataFrame:
    """(series, day, session, high, low) for each day and tracked session; nulls without bars."""
    rows = with_sessions(bars, cfg).withColumn("day", trading_day(rollover_hour))
    seen = rows.groupBy("series", "day", "session").agg(F.max("High").alias("high"), F.min("Low").alias("low"))
    days = rows.select("series", "day").distinct().withColumn("session", F.explode(F.array(*[F.lit(s) for s in cfg.tracked])))
    return days.join(seen, ["series", "day", "session"], "left")


def level_flags(bars: DataFrame, cfg: SessionConfig = DEFAULT, rollover_hour: int | None = None) -> DataFrame:
    """Bars that touch the high or low of an earlier session of their day.

    A tracked session's level is that of its first stay in a day, frozen once another
    session follows; each later bar of the day in another session is tested, the first one included. Columns: series, day,
    touched_session, which, level, by_session, at_index, timestamp. One equi-join on (series, day)
    with a range condition; a day has at most one level a session, so rows grow linearly.
    """
    day = Window.partitionBy("series", "day").orderBy("idx")
    rows = with_index(with_sessions(bars, cfg)).withColumn("day", trading_day(rollover_hour))
    rows = rows.withColumn("_new", F.coalesce(F.col("session") != F.lag("session").over(day), F.lit(True)).cast("int"))
    rows = rows.withColumn("_island", F.sum("_new").over(day))
    stays = rows.where(F.col("session").isin(cfg.tracked)).groupBy("series", "day", "session", "_island").agg(
        F.max("High").alias("_high"), F.min("Low").alias("_low"), F.max("idx").alias("end_idx")
    )
    first = Window.partitionBy("series", "day", "session").orderBy("_island")
    levels = stays.withColumn("_n", F.row_number().over(first)).where("_n = 1").select(
        F.col("series").alias("_s"), F.col("day").alias("_d"), F.col("session").alias("touched_session"), "_high", "_low", "end_idx"
    )
    hit = rows.join(levels, (F.col("series") == F.col("_s")) & (F.col("day") == F.col("_d")) & (F.col("idx") > F.col("end_idx")) & (F.col("session") != F.col("touched_session")))
    sides = F.explode(F.array(*[F.struct(F.lit(w).alias("which"), F.col(f"_{w}").alias("level")) for w in ("low", "high")]))
    hit = hit.withColumn("_side", sides).where("_side.level between Low and High")
    return hit.select("series", "day", "touched_session", F.col("_side.which").alias("which"), F.col("_side.level").alias("level"), F.col("session").alias("by_session"), F.col("idx").alias("at_index"), F.col("Datetime").alias("timestamp"))


def select_bars(bars: DataFrame, start=None, end=None, last_n: int | None = None) -> DataFrame:
    """Bars with a time, within inclusive bounds, the last n of them, in time order."""
    rows = bars.where("Datetime is not null")
    for bound, test in ((start, F.col("Datetime").__ge__), (end, F.col("Datetime").__le__)):
        if bound is not None:
            rows = rows.where(test(F.lit(bound).cast("timestamp_ntz")))
    if last_n is not None:
        rows = rows.orderBy(F.desc("Datetime"), F.desc("ord")).limit(max(0, last_n))
    return rows.orderBy("Datetime", "ord")
