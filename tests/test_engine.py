"""Operators against small plain-Python versions, in both semantics, and edge cases."""

import datetime as dt
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom import bars as bm
from barloom.functions import indicators as ind
from barloom.functions import scalars
from barloom.operators import clean, recurrence, sessions
from barloom.plans import regimes, signals
from barloom.sources import files
from barloom.streaming import live

T0 = dt.datetime(2025, 6, 23)


def walk(n, seed=1, series="all", minutes=1, start=T0):
    r, price, out = random.Random(seed), 100.0, []
    for i in range(n):
        o = price
        c = o + r.gauss(0, 0.5)
        out.append((series, i, start + dt.timedelta(minutes=minutes * i), o, max(o, c) + abs(r.gauss(0, 0.2)), min(o, c) - abs(r.gauss(0, 0.2)), c, float(r.randrange(800, 1200))))
        price = c
    return out


SCHEMA = "series string, ord long, Datetime timestamp_ntz, Open double, High double, Low double, Close double, Volume double"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def column(df, name, series=None):
    df = df if series is None else df.where(F.col("series") == series)
    return [None if x is None or x != x else x for x in (r[0] for r in df.orderBy("series", "ord").select(name).collect())]


def close_to(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert (x is None) == (y is None) and (x is None or x == pytest.approx(y, rel=1e-9, abs=1e-9)), (x, y)


def mean(x, n):
    return [None if i < n - 1 or any(v is None for v in x[i - n + 1 : i + 1]) else sum(x[i - n + 1 : i + 1]) / n for i in range(len(x))]


def average(x, n, a):
    out = [None] * len(x)
    if len(x) < n:
        y, at = x[0], 0
    else:
        seed = [v for v in x[:n] if v is not None]
        y, at = (sum(seed) / len(seed) if seed else None), n - 1
    out[at] = y
    for i in range(at + 1, len(x)):
        y = None if y is None or x[i] is None else a * x[i] + (1 - a) * y
        out[i] = y
    return out


@pytest.fixture(scope="module")
def rows():
    return walk(150)


@pytest.fixture(scope="module")
def bars(spark, rows):
    return frame(spark, rows).cache()


def test_windows(bars, rows):
    c = [r[6] for r in rows]
    close_to(column(ind.sma(bars, True, 20), "sma"), mean(c, 20))
    close_to(column(ind.roc(bars, True, 10), "roc"), [None if i < 10 else (c[i] - c[i - 10]) / abs(c[i - 10]) * 100 for i in range(150)])
    up = [None if i < 19 else max(r[4] for r in rows[i - 19 : i + 1]) for i in range(150)]
    close_to(column(ind.donchian(bars, True), "donchian_upper"), up)
    close_to(column(ind.donchian(bars, False), "donchian_upper"), [None] + up[:-1])


@pytest.mark.parametrize("n", [5, 150])
def test_recurrences(spark, rows, n):
    part = rows[:n]
    c = [r[6] for r in part]
    df = recurrence.with_recurrences(frame(spark, part), [("ema", {"length": 20}, ""), ("rsi", {}, ""), ("atr", {"length": 14}, "")])
    close_to(column(df, "ema"), average(c, 20, 2 / 21))
    gain = [0.0] + [max(0.0, b - a) for a, b in zip(c, c[1:])]
    loss = [0.0] + [max(0.0, a - b) for a, b in zip(c, c[1:])]
    ag, al = average(gain, 14, 1 / 14), average(loss, 14, 1 / 14)
    close_to(column(df, "rsi"), [None if x is None or abs(y) <= 1e-8 else 100 - 100 / (1 + x / y) for x, y in zip(ag, al)])
    tr = [None] + [max(r[4] - r[5], abs(r[4] - p[6]), abs(r[5] - p[6])) for p, r in zip(part, part[1:])]
    close_to(column(df, "atr"), average(tr, 14, 1 / 14))


def test_reference_quirks(bars, spark):
    out = signals.indicator(bars, "macd")
    assert set(column(out, "macd_macd_signal")) == {None} and set(column(out, "signal_macd")) == {0.0}
    assert set(column(signals.indicator(bars, "macd", semantics="intended"), "signal_macd")) == {-1.0, 0.0, 1.0}
    assert set(column(signals.indicator(bars, "stochastic"), "stochastic_stoch_d")) == {None}
    rising = frame(spark, [("all", i, T0, 100 + i / 10, 101 + i / 10, 99 + i / 10, 100 + i / 10, 1.0) for i in range(40)])
    assert set(column(signals.indicator(rising, "rsi"), "signal_rsi")) == {0.0}
    assert column(signals.indicator(rising, "rsi", semantics="intended"), "rsi_rsi")[-1] == 100.0
    flat = frame(spark, [("all", i, T0, 5.0, 5.0, 5.0, 5.0, 1.0) for i in range(40)])
    assert column(signals.indicator(flat, "rsi", semantics="intended"), "rsi_rsi")[-1] == 50.0


def test_nulls_poison_reference_means(spark, rows):
    broken = [r if r[1] != 30 else (*r[:6], None, r[7]) for r in rows]
    got = column(ind.sma(frame(spark, broken), True, 5), "sma")
    assert got[29] is not None and set(got[30:]) == {None}
    assert column(ind.sma(frame(spark, broken), False, 5), "sma")[40] is not None


def test_vwap(bars, rows):
    run = []
    for part in (rows[:60], rows[60:120], rows[120:]):
        n = v = 0.0
        for r in part:
            n, v = n + (r[4] + r[5] + r[6]) / 3 * r[7], v + r[7]
            run.append(n / v)
    close_to(column(ind.vwap(bars.withColumn("new", F.minute("Datetime") == 0), True, "new"), "vwap"), run)


def test_supertrend_ratchets(bars, rows):
    ref = recurrence.with_recurrences(bars, [("supertrend", {}, "")])
    line, way = column(ref, "supertrend"), column(ref, "supertrend_dir")
    assert line[:9] == [None] * 9 and way[:9] == [1.0] + [None] * 8 or way[0] == 1.0
    assert all(x in (1.0, -1.0) for x in way[9:])
    free = column(recurrence.with_recurrences(bars, [("supertrend", {}, "")], reference=False), "supertrend")
    assert free[9] is not None and free != line


def test_two_series_do_not_mix(spark, rows):
    both = frame(spark, rows + walk(80, 2, "b"))
    one = frame(spark, walk(80, 2, "b"))
    for name in ("bollinger", "keltner", "obv", "ichimoku"):
        a, b = signals.indicator(both, name), signals.indicator(one, name)
        last = a.columns[-1]
        close_to(column(a, last, "b"), column(b, last))


def test_short_and_empty_series(spark):
    for n in (0, 1, 2, 10):
        configs = [signals.IndicatorConfig(x) for x in sorted(signals.POLICIES)]
        per, comp = signals.generate_signals(frame(spark, walk(n)), configs)
        assert per.count() == comp.count() == n
        r, f = regimes.annotate_regimes(frame(spark, walk(n)))
        assert r.count() == f.count() == n


def test_missing_volume(spark, rows):
    df = frame(spark, [(*r[:7], None) for r in rows])
    per, _ = signals.generate_signals(df, [signals.IndicatorConfig(x) for x in ("obv", "mfi", "vwap")])
    assert set(column(per, "obv_obv")) == {0.0} and set(column(per, "signal_mfi")) == set(column(per, "signal_vwap")) == {0.0}


def test_composites(bars):
    team = [signals.IndicatorConfig("ROC", {}, 2.0), signals.IndicatorConfig("vwap", {}, -1.0), signals.IndicatorConfig("bollinger", {"mode": "trend"})]
    per, comp = signals.generate_signals(bars, team)
    joined = per.join(comp, ["series", "ord"]).collect()
    for r in joined:
        v = (r.signal_roc, r.signal_vwap, r.signal_bollinger)
        score = (2 * v[0] - v[1] + v[2]) / 4
        assert r.score == pytest.approx(score) and r.signal == (0.0 if abs(score) < 0.1 else math.copysign(1, score))
        assert r.reason == ("; ".join(f"{n}={int(x)}" for n, x in zip(("roc", "vwap", "bollinger"), v) if x) or "all_neutral")
    major = signals.generate_signals(bars, team, aggregation="majority")[1].join(per, ["series", "ord"]).collect()
    for r in major:
        total = r.signal_roc + r.signal_vwap + r.signal_bollinger
        assert r.signal == (0.0 if total == 0 else math.copysign(1, total))
    assert {r.reason for r in signals.generate_signals(bars, [])[1].collect()} == {"no_votes"}
    with pytest.raises(KeyError):
        signals.generate_signals(bars, [signals.IndicatorConfig("nope")])
    with pytest.raises(TypeError):
        signals.generate_signals(bars, [signals.IndicatorConfig("rsi", {"odd": 1})])
    twice = [signals.IndicatorConfig("roc", {"length": 3}), signals.IndicatorConfig("roc", {"length": 5})]
    assert signals.generate_signals(bars, twice)[1].count() == 150
    with pytest.raises(ValueError):
        signals.generate_signals(bars, twice, semantics="intended")


def test_params(tmp_path):
    assert signals.parse_params("length=14; mode=trend, x=1.5,flag, y=1e3, z=True") == {"length": 14, "mode": "trend", "x": 1.5, "flag": True, "y": 1000.0, "z": True}
    assert signals.parse_params(None) == signals.parse_params(" ") == {}
    p = tmp_path / "d.csv"
    p.write_text('Key,Params\nRSI,"length=7, buy_below=20"\nmfi,\n')
    assert signals.load_default_params(str(p)) == {"rsi": {"length": 7, "buy_below": 20}, "mfi": {}}


def test_hysteresis():
    keys = ["a", "a", "b", "", "b", "", "", "c", "a", "a"]
    pdf = pd.DataFrame({"ord": range(len(keys)), "primary": keys})
    assert regimes._hysteresis(2, 2, True)(pdf)["primary"].tolist() == ["", "a", "a", "a", "b", "b", "", "", "a", "a"]
    assert regimes._hysteresis(2, 2, False)(pdf)["primary"].tolist() == ["", "a", "a", "a", "a", "a", "", "", "", "a"]


def test_register_detectors(bars):
    @regimes.register_tag("wide")
    def wide(cfg):
        return F.col("bb_width") > 0

    try:
        got, _ = regimes.RegimeEngine(primary_order=["range", "squeeze"], tags=["wide"]).run(bars)
        assert {r.primary for r in got.collect()} <= {"", "range", "squeeze"} and any(r.tags == ["wide"] for r in got.collect())
    finally:
        del regimes.TAGS["wide"]


def dirty_rows():
    out = [list(r) for r in walk(40)]
    out[3][3] = None
    out[7][7] = None
    out[5][2] = out[4][2]
    out[12][5] = out[12][4] + 1
    out[15][7] = -100.0
    out[20:25] = out[20:25][::-1]
    for i, r in enumerate(out):
        r[1] = i
    return [tuple(r) for r in out]


@pytest.mark.parametrize("clip", [True, False])
def test_clean(spark, clip):
    kept, report = clean.clean_bars(frame(spark, dirty_rows()), clip_negative_volume=clip)
    r = report.first()
    assert (r.input_rows, r.dropped_na, r.dropped_duplicate, r.dropped_invariant, r.dropped_negative_volume, r.clipped_volume) == (40, 2, 1, 1, 0 if clip else 1, 1 if clip else 0)
    ordered = kept.withColumn("ord", F.unix_micros(F.col("Datetime").cast("timestamp")))
    clean.validate_bars(ordered)
    assert kept.count() == r.output_rows == (36 if clip else 35)
    with pytest.raises(AssertionError):
        clean.validate_bars(frame(spark, dirty_rows()))
    stamp = clean.signature(kept)
    assert clean.is_clean(kept, stamp) and not clean.is_clean(kept.withColumn("Close", F.col("Close") + 1), stamp)
    with pytest.raises(bm.BarError):
        clean.clean_bars(kept.drop("Volume"))


def test_bad_first_copy_takes_the_second(spark):
    rows = [("all", 0, T0, 5.0, 6.0, 7.0, 5.0, 1.0), ("all", 1, T0, 5.0, 6.0, 4.0, 5.0, 1.0)]
    assert clean.clean_bars(frame(spark, rows))[0].count() == 0


def test_fall_back_hour_loses_a_row(spark):
    df = spark.createDataFrame([("all", i, t, 1.0, 1.0, 1.0, 1.0, 1.0) for i, t in enumerate(["2024-11-03T05:30:00Z", "2024-11-03T06:30:00Z"])], SCHEMA.replace("timestamp_ntz", "string"))
    kept = clean.clean_bars(df, tz="America/New_York")[0].collect()
    assert [r.Datetime for r in kept] == [dt.datetime(2024, 11, 3, 1, 30)]


def test_csv(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text("date,time,O,H,L,Adj Close,Qty\n2024-01-02,09:31:00,1,2,0.5,1.5,10\n2024-01-02,09:30:00,1,2,0.5,1.5,1d\n2024-01-02,09:32:00,1,2,0.5,nan,3\n")
    got, report = files.load_bars_csv(spark, str(p))
    assert [r.Datetime for r in got.collect()] == [dt.datetime(2024, 1, 2, 9, 31)] and report.first().dropped_na == 2
    raw, none = files.load_bars_csv(spark, str(p), run_cleaner=False)
    assert none is None and [r.Datetime.minute for r in raw.collect()] == [30, 31, 32]
    p.write_text("a,b\n1,2\n")
    with pytest.raises(bm.BarError):
        files.load_bars_csv(spark, str(p))


def test_rows_and_aliases(spark):
    got = files.bars_from_rows(spark, [{"time": "2024-01-01 00:00:00", "o": 1, "h": 2, "l": 0, "c": 1, "vol": 5}, ("2024-01-01 00:01:00", 1, 2, 0, 1, float("nan"))]).orderBy("ord").collect()
    assert got[0].Volume == 5.0 and got[1].Volume is None and got[1].Datetime.minute == 1
    assert files.bars_from_rows(spark, []).count() == 0
    with pytest.raises(TypeError):
        files.to_bars(spark, 5)
    df = spark.createDataFrame([(1.0, 2.0, 0.5, float("nan"))], "O double, H double, L double, C double")
    assert files.to_bars(spark, df).first().Close is None
    with pytest.raises(bm.BarError):
        bm.canonical(df.drop("C"))


def test_scalars(spark):
    df = frame(spark, [("all", 0, dt.datetime(2025, 6, 23, 7, 30), 100.0, 102.0, 99.0, 101.0, 1000.0)])
    r = df.select(scalars.body(), scalars.wick_top(), scalars.wick_bottom(), scalars.is_bullish(), scalars.minute_of_day()).first()
    assert tuple(r) == (1.0, 1.0, 1.0, True, 450)


def test_session_clock(spark):
    clock = [(0, 30, "Asia"), (2, 0, "London"), (7, 0, "NY AM"), (12, 0, "NY PM"), (16, 30, "Off"), (18, 5, "Asia"), (23, 59, "Asia")]
    df = frame(spark, [("all", i, T0.replace(hour=h, minute=m), 1.0, 1.0, 1.0, 1.0, 1.0) for i, (h, m, _) in enumerate(clock)])
    assert column(sessions.with_sessions(df), "session") == [s for *_, s in clock]


def test_overlapping_sessions_stick(spark):
    cfg = sessions.SessionConfig((("Asia", ((0, 200),)), ("London", ((100, 300),)), ("NY AM", ((301, 400),)), ("NY PM", ((401, 500),))))
    df = frame(spark, [("all", i, T0 + dt.timedelta(minutes=m), 1.0, 1.0, 1.0, 1.0, 1.0) for i, m in enumerate((50, 150, 201, 150, 600))])
    assert not cfg.disjoint() and column(sessions.with_sessions(df, cfg), "session") == ["Asia", "Asia", "London", "London", "Off"]
    with pytest.raises(bm.BarError):
        sessions.with_sessions(df, sessions.SessionConfig((("Asia", ((0, 1),)),)))


def trio(last):
    at = [T0.replace(hour=18), T0.replace(hour=18, minute=1), T0 + dt.timedelta(days=1, hours=2)]
    return [("all", i, t, 100.0, h, low, 100.0, 1.0) for i, (t, (h, low)) in enumerate(zip(at, [(101.0, 99.0), (100.5, 99.5), last]))]


@pytest.mark.parametrize("last", [(101.2, 100.4), (101.1, 100.2)])
def test_prior_level_touch(spark, last):
    df = frame(spark, trio(last))
    assert sessions.level_flags(df).count() == 0
    got = sessions.level_flags(df, rollover_hour=18).collect()
    assert [(r.touched_session, r.which, r.level, r.by_session, r.at_index) for r in got] == [("Asia", "high", 101.0, "London", 2)]


@pytest.mark.parametrize("rollover", [0, 18])
def test_flags_match_the_tracker(spark, rollover):
    rows = walk(600, 7, minutes=10)
    tracker, want = live.LevelTracker(), []
    for r in rows:
        day = str((r[2] + dt.timedelta(hours=(24 - rollover) % 24)).date())
        m = r[2].hour * 60 + r[2].minute
        name = next(n for n, ranges in sessions.DEFAULT.ranges if any(a <= m <= b for a, b in ranges))
        want += [(r[1], *x) for x in tracker.push(day, name, r[4], r[5])]
    got = sessions.level_flags(frame(spark, rows), rollover_hour=rollover).collect()
    assert len(want) > 20 and sorted((r.at_index, r.touched_session, r.which, r.level) for r in got) == sorted(want)


def test_ranges(spark):
    values = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0]
    df = frame(spark, [("all", i, T0, v, v, v, v, 1.0) for i, v in enumerate(values)])
    for a, b in ((0, 1), (2, 5), (7, 3)):
        part = values[min(a, b) : max(a, b) + 1]
        assert tuple(sessions.high_low(df, a, b).first())[1:] == (max(part), min(part))
    asked = spark.createDataFrame([(1, "all", 0, 1), (2, "all", 7, 3)], "range_id int, series string, start int, end int")
    assert {tuple(r) for r in sessions.ranges_high_low(df, asked).collect()} == {(1, 3.0, 1.0), (2, 9.0, 1.0)}
    with pytest.raises(bm.BarError):
        sessions.session_high_low(df, "Mars")


def test_select(bars):
    got = sessions.select_bars(bars, "2025-06-23 00:10:00", "2025-06-23 01:00:00", 5).collect()
    assert [r.ord for r in got] == [56, 57, 58, 59, 60]
    with pytest.raises(bm.BarError):
        files.plot_bars(bars, "2030-01-01 00:00:00")
    assert len(files.plot_bars(bars, last_n=3)) == 3


def test_causal_outputs_are_stable(spark, rows):
    """What a bar shows does not change when later bars arrive."""
    team = [signals.IndicatorConfig(x) for x in ("keltner", "bollinger", "obv", "supertrend")]
    a = signals.generate_signals(frame(spark, rows), team)[1]
    b = signals.generate_signals(frame(spark, rows[:100]), team)[1]
    close_to(column(a, "score")[:100], column(b, "score"))


def test_streams(spark, tmp_path):
    rows = walk(400, 8, minutes=15)
    want = sorted((r.at_index, r.touched_session, r.which) for r in sessions.level_flags(frame(spark, rows)).collect())
    for i, part in enumerate((rows[:170], rows[170:])):
        frame(spark, part).withColumn("Datetime", F.col("Datetime").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    schema = spark.read.parquet(str(tmp_path / "in/0")).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    q = live.stream_level_flags(stream).writeStream.format("memory").queryName("flags").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.at_index, r.touched_session, r.which) for r in spark.table("flags").collect()) == want
    ticks = spark.readStream.schema("ts timestamp, event_id long, event_type string, value double").parquet(str(tmp_path / "t*"))
    assert live.stream_bars(ticks, "1 hour", "ts", F.col("value"), ["event_id"], F.col("event_type")).isStreaming
