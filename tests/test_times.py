"""Written times, offsets and session time zones; adapters; the container."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom import bars as bm
from barloom.functions import times
from barloom.operators import clean, container, sessions
from barloom.plans import regimes, signals
from barloom.sources import files

from .test_engine import SCHEMA, T0, frame, walk


@pytest.fixture(params=["UTC", "America/New_York"])
def zone(spark, request):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield request.param
    spark.conf.set("spark.sql.session.timeZone", before)


WRITTEN = {
    "2024-06-03T13:30:00Z": "2024-06-03 09:30:00", "2024-06-03 13:31:00+02:00": "2024-06-03 07:31:00", "2024-06-03 13:31:00 -0500": "2024-06-03 14:31:00",
    "2024-06-03 13:31:00.25+00": "2024-06-03 09:31:00.25", "2024-01-03 13:30 UTC": "2024-01-03 08:30:00", "2024-06-03 09:30": "2024-06-03 09:30:00", "2024-06-03": "2024-06-03 00:00:00",
    "01/02/2024 09:30": "2024-01-02 09:30:00", "1/2/2024 9:30:15 PM": "2024-01-02 21:30:15", "1/2/2024 12:05 am": "2024-01-02 00:05:00", "25/01/2024 10:00": "2024-01-25 10:00:00",
    "2024/01/02 09:30:00": "2024-01-02 09:30:00", "20240102 09:30:00": "2024-01-02 09:30:00", "20240102": "2024-01-02 00:00:00", "Jan 2, 2024 09:30": "2024-01-02 09:30:00",
    "2-March-2024 09:30": "2024-03-02 09:30:00", "2024-11-03T05:30:00Z": "2024-11-03 01:30:00", "2024-11-03T06:30:00Z": "2024-11-03 01:30:00", "2024-03-10 02:30:00": "2024-03-10 02:30:00",
    "soon": None, "": None, "2024-13-45": None, "1/2/2024 13:xx": None,
}


def naive(text):
    return None if text is None else dt.datetime.fromisoformat(text)


def test_written_times(spark, zone):
    """Offsets are applied, other times taken as written, whatever the session's zone, fall-back hour and gap included."""
    rows = spark.createDataFrame(list(WRITTEN.items()), "text string, want string")
    got = rows.select("text", times.read_time(F.col("text"), "America/New_York").alias("at")).collect()
    assert {r["text"]: r["at"] for r in got} == {k: naive(v) for k, v in WRITTEN.items()}
    assert spark.range(1).select(times.read_time(F.lit("2024-06-03T13:30:00+02:00"))).first()[0] == dt.datetime(2024, 6, 3, 11, 30)


@pytest.mark.parametrize(("pattern", "text", "want"), [("%d.%m.%Y %H:%M", "03.06.2024 13:30", "2024-06-03 13:30"), ("%Y-%m-%dT%H:%M:%S%z", "2024-06-03T13:30:00+0200", "2024-06-03 07:30"), ("yyyy/MM/dd HH:mm", "2024/03/10 02:30", "2024-03-10 02:30"), ("%m/%d/%y %I:%M %p", "06/03/24 01:30 PM", "2024-06-03 13:30"), ("%Y", "x", None)])
def test_patterns(spark, zone, pattern, text, want):
    assert spark.range(1).select(times.read_time(F.lit(text), "America/New_York", pattern)).first()[0] == naive(want)


def test_instants(spark, zone):
    """A TIMESTAMP is converted from what it is, not from how the session shows it."""
    rows = spark.sql("SELECT 'all' AS series, 0L AS ord, TIMESTAMP'2024-11-03 06:30:00Z' AS Datetime, 1D AS Open, 1D AS High, 1D AS Low, 1D AS Close, 1D AS Volume")
    assert clean.clean_bars(rows, "America/New_York")[0].first()["Datetime"] == dt.datetime(2024, 11, 3, 1, 30)
    assert clean.clean_bars(rows)[0].first()["Datetime"] == dt.datetime(2024, 11, 3, 6, 30)
    ticks = spark.sql("SELECT CAST(concat('2024-11-03 0', h, ':30:00') AS TIMESTAMP_NTZ) AS ts, double(h) AS p, h AS i FROM (SELECT explode(sequence(0, 5)) AS h)")
    bars = bm.resample(ticks, "1 hour", "ts", F.col("p"), ["i"]).orderBy("ord").collect()
    assert [b["ord"] for b in bars] == [int((dt.datetime(2024, 11, 3, h) - dt.datetime(1970, 1, 1)).total_seconds()) for h in range(6)]


def test_csv_times(spark, zone, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text("Timestamp,Open,High,Low,Close,Volume\n2024-06-03T13:30:00Z,1,2,0.5,1.5,10\n2024-06-03T13:31:00+02:00,1,2,0.5,1.5,10\n,1,2,0.5,1.5,10\n")
    got, report = files.load_bars_csv(spark, str(p), memory_efficient=True)
    assert sorted(r.Datetime for r in got.collect()) == [dt.datetime(2024, 6, 3, 7, 31), dt.datetime(2024, 6, 3, 9, 30)] and report.first().dropped_na == 1
    own = {"Open": ["Open"], "High": ["High"], "Low": ["Low"], "Close": ["Close"], "Volume": ["Volume"], "Datetime": ["when", "timestamp"]}
    assert files.load_bars_csv(spark, str(p), tz=None, synonyms=own)[0].count() == 2
    with pytest.raises(bm.BarError):  # given names replace the known ones
        files.load_bars_csv(spark, str(p), synonyms=own | {"Close": ["last"]})
    p.write_text("when,date,O,H,L,C,V,Qty\nnever,06/03/2024,1,2,0.5,1.5,1,10\n")
    assert files.load_bars_csv(spark, str(p))[0].first().Datetime == dt.datetime(2024, 6, 3)


def test_bar_time(spark, zone):
    """The container's rule: naive is UTC where a zone is given; a text's offset is cut off."""
    one = lambda text, tz=None: spark.range(1).select(times.bar_time(F.lit(text), "string", tz)).first()[0]
    assert one("2024-06-03T13:30Z") == one("2024-06-03 13:30:00+02:00") == dt.datetime(2024, 6, 3, 13, 30)
    assert one("2024-06-03 13:30", "America/New_York") == dt.datetime(2024, 6, 3, 9, 30) and one("2024-06-03") == dt.datetime(2024, 6, 3)
    with pytest.raises(Exception, match="CANNOT_PARSE|parse"):
        one("2024-06-03 13:30:00-05:00")


def test_container(spark):
    rows = walk(300)
    s = container.BarSeries(frame(spark, rows))
    assert len(s) == 300 and s[5].Close == rows[5][6] and s[-1].idx == 299 and [r.idx for r in s[10:4:-2]] == [10, 8, 6] and s[3:3] == []
    assert [r.idx for r in s][:3] == [0, 1, 2] and repr(s).startswith("BarSeries(300 bars from 2025-06-23 00:00:00")
    assert s.high_low(20, 10) == (max(r[4] for r in rows[10:21]), min(r[5] for r in rows[10:21]))
    assert s.session_high_low("Asia", 0, 50) == s.high_low(0, 50)
    for bad in (lambda: s.high_low(0, 300), lambda: s.high_low(-1, 3), lambda: s.session_high_low("Mars"), lambda: s.session_high_low("NY PM", 0, 5), lambda: container.BarSeries(frame(spark, [])).high_low(0, 0)):
        with pytest.raises(bm.BarError):
            bad()
    with pytest.raises(IndexError):
        s[300]
    with pytest.raises(bm.BarError):  # equal times
        container.BarSeries(frame(spark, [*rows[:3], ("all", 3, *rows[2][2:])]))
    assert len(container.BarSeries(frame(spark, [*rows[:3], ("all", 3, *rows[2][2:])]), enforce_strict_order=False)) == 4
    broken = frame(spark, [("all", 0, T0, 5.0, 4.0, 3.0, 5.0, 1.0)])
    with pytest.raises(bm.BarError):
        container.BarSeries(broken)
    assert len(container.BarSeries(broken, assume_clean=True)) == 1
    pdf = pd.DataFrame([r[2:] for r in rows], columns=["when", *bm.COLUMNS[1:]]).set_index("when")
    assert len(container.BarSeries(pdf)) == 300 and container.BarSeries(pdf, tz="America/New_York")[0].Datetime == dt.datetime(2025, 6, 22, 20)


def test_pushed_bars(spark):
    """Bar by bar the same flags as in one go; unread ones go with the day, and on reset."""
    rows = walk(2 * 48, minutes=30, start=T0 + dt.timedelta(hours=0))
    s = container.BarSeries(frame(spark, rows))
    want = sorted((r.touched_session, r.which, r.level) for r in s.level_flags().collect() if r.day == (T0 + dt.timedelta(days=1)).date())
    said = [s.push(b) for b in s]
    assert s.tracker.flags and sorted(s.tracker.consume()) == want and s.tracker.consume() == [] and said[-1]["final"] == s.tracker.final_levels()
    s.tracker.reset()
    assert not s.tracker.levels and not s.tracker.final_levels()


def test_other_sources(spark):
    rows = walk(60)
    aliased = spark.createDataFrame([(r[3], r[4], r[5], r[6], int(r[7]), str(r[2])) for r in rows], "O double, H double, L double, C double, Vol long, Time string").repartition(1)
    dicts = [{"open": r[3], "high": r[4], "low": r[5], "close": r[6], "volume": r[7], "datetime": r[2]} for r in rows]
    want = [r.score for r in signals.generate_signals(frame(spark, rows), [signals.IndicatorConfig("roc")])[1].orderBy("ord").collect()]
    for source in (aliased, dicts, {k: [d[k] for d in dicts] for k in dicts[0]}):
        got = signals.generate_signals(source, [signals.IndicatorConfig("roc")])[1].orderBy("ord").collect()
        assert [r.score for r in got] == want and got[1].Datetime == rows[1][2]
        assert regimes.annotate_regimes(source)[0].count() == 60
    holder = type("Held", (), {"timestamps": [r[2] for r in rows], "open": [r[3] for r in rows], "high": [r[4] for r in rows], "low": [r[5] for r in rows], "close": [r[6] for r in rows], "volume": [r[7] for r in rows]})()
    assert files.to_bars(spark, holder).orderBy("ord").first().Close == rows[0][6]
    two = spark.createDataFrame([(2.0, str(T0), 5.0)], "OPEN double, Timestamp string, Qty double")
    drawn = files.plot_frame(spark, two).first()
    assert (drawn.Open, drawn.Volume, drawn.Close, drawn.Datetime) == (2.0, 5.0, None, T0)
    assert len(files.plot_bars(aliased, last_n=5)) == 5
