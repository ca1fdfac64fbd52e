"""Sequential passes over series give the same rows however the rows are cut into batches."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.bars import canonical
from barloom.operators import recurrence, scan, sessions
from barloom.plans import regimes

from .test_engine import T0, column, frame, walk

ALL = [("ema", {}, "e_"), ("atr", {}, ""), ("rsi", {}, ""), ("macd", {}, ""), ("keltner", {}, ""), ("dmi_adx", {}, ""), ("supertrend", {}, "")]


@pytest.fixture
def batches_of(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    yield lambda n: spark.conf.set(name, str(n))
    spark.conf.set(name, before)


def rows_of(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("reference", [True, False])
def test_batches_do_not_matter(spark, batches_of, reference):
    rows = [r for i, n in enumerate((1, 5, 9, 27, 40, 90)) for r in walk(n, i, f"s{i}")]
    holes = [(*r[:6], None, r[7]) if r[0] == "s5" and r[1] in (0, 1, 50) else r for r in rows]
    df = frame(spark, holes)
    batches_of(10_000)
    whole = rows_of(recurrence.with_recurrences(df, ALL, reference))
    assert len(whole) == len(rows)
    for n in (1, 7):
        batches_of(n)
        assert rows_of(recurrence.with_recurrences(df, ALL, reference)) == whole


def test_seeds_after_leading_nulls(spark, batches_of):
    rows = [(*r[:6], None if r[1] < 30 or r[1] == 33 else r[6], r[7]) for r in walk(60)]
    for n in (4, 1000):
        batches_of(n)
        parts = [[r[6] if r[6] is not None else float("nan") for r in rows[i : i + n]] for i in range(0, 60, n)]
        smooth = recurrence.ema(9, skip=True)
        got = [y for p in parts for y in smooth(recurrence.np.array(p))]
        known = [r[6] for r in rows[30:39] if r[6] is not None]
        assert all(y != y for y in got[:38]) and got[38] == pytest.approx(sum(known) / 8) and got[59] == got[59]


def test_hysteresis_and_sticky_sessions(spark, batches_of):
    bars = frame(spark, walk(300, 3, "a", 10) + walk(200, 4, "b", 10))
    wide = sessions.SessionConfig((("A", ((0, 700),)), ("B", ((600, 1300),))), "Off", ("A", "B"))
    got = []
    for n in (13, 10_000):
        batches_of(n)
        got.append((rows_of(sessions.with_sessions(bars, wide)), rows_of(regimes.RegimeEngine().run(bars)[0])))
    assert got[0] == got[1]


def test_empty_one_series_and_columns_kept(spark):
    bars = frame(spark, walk(30))
    assert recurrence.with_recurrences(bars.where("false"), ALL).count() == 0
    tagged = bars.withColumns({"tags": F.array(F.lit("x")), "when": F.lit(T0), "none": F.lit(None).cast("string")})
    out = recurrence.with_recurrences(tagged, ALL)
    assert out.columns[: len(tagged.columns)] == tagged.columns
    assert rows_of(out.select(*tagged.columns)) == rows_of(tagged)
    one = canonical(bars.drop("series", "ord"))  # its series is a constant
    assert column(recurrence.with_recurrences(one.repartition(1), [("atr", {}, "")]), "atr")[29] is not None


def test_rows_in_order_and_one_shuffle(spark):
    bars = frame(spark, walk(50) + walk(50, 2, "b"))
    schema = T.StructType([*bars.schema.fields, T.StructField("was", T.DoubleType())])

    def start():
        before = recurrence.Lag()
        return lambda b: {"was": before(b["ord"])}

    out = scan.scan(bars.orderBy(F.rand(1)), schema, start)
    assert all(r["was"] == r["ord"] - 1 if r["ord"] else r["was"] is None for r in out.collect())
    plan = scan.scan(bars, schema, start)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(series") == 1
