"""The registered queries over the driver's tables, each with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..bars import resample
from ..functions import indicators as ind
from ..functions import scalars as sc
from ..operators import sessions as se
from ..operators.clean import clean_bars, violations
from ..operators.recurrence import with_recurrences
from ..sources.files import bars_of_texts
from .regimes import FEATURES, RegimeEngine
from .signals import IndicatorConfig, generate_signals, indicator

QUERIES: dict = {}
SQL: dict[str, str] = {}


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of the events, a series for each type."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return resample(events, "1 hour", "ts", F.col("value"), ["event_id"], F.col("event_type"))


def half_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-hourly bars of all events, one series."""
    return resample(spark.read.parquet(f"{sf_dir}/events.parquet"), "30 minutes", "ts", F.col("value"), ["event_id"])


def r6(x: Column | str) -> Column:
    """Six decimals; the shift keeps halves, which both engines reach by different sums, off the edge."""
    return F.round((F.col(x) if isinstance(x, str) else x) + 1e-9, 6) + 0.0


def shown(df: DataFrame, *names: str) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select("series", "Datetime", *[r6(n).alias(n) if kinds[n] == "double" else F.col(n) for n in names])


def _bars(every: str, series: str) -> str:
    o = "{'t': ts, 'i': event_id}"
    return f"""b0 AS (SELECT {series} AS series, time_bucket(INTERVAL '{every}', ts) AS t, arg_min(value, {o}) AS o, max(value) AS h, min(value) AS l,
  arg_max(value, {o}) AS c, CAST(count(*) AS DOUBLE) AS v FROM events GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY t) AS rn, (h + l + c) / 3 AS tp, lag(c) OVER (PARTITION BY series ORDER BY t) AS pc,
  lag(h) OVER (PARTITION BY series ORDER BY t) AS ph, lag(l) OVER (PARTITION BY series ORDER BY t) AS pl FROM b0)"""


HOURLY, HALF = _bars("1 hour", "event_type"), _bars("30 minutes", "'all'")
W = "PARTITION BY series ORDER BY rn"


def _rec(name: str, src: str, x: str, length: int, alpha: float, start: int = 1) -> str:
    """A recursive average of column x of src: {name}(series, rn, y)."""
    seed = start + length - 1
    return f"""{name} AS (SELECT series, CAST({seed} AS BIGINT) AS rn, avg({x}) AS y FROM {src} WHERE rn BETWEEN {start} AND {seed} GROUP BY series
  UNION ALL SELECT s.series, s.rn, {alpha!r} * s.{x} + {1 - alpha!r} * p.y FROM {name} p JOIN {src} s ON s.series = p.series AND s.rn = p.rn + 1)"""


def _ema(name, src, x, n, start=1):
    return _rec(name, src, x, n, 2 / (n + 1), start)


def _rma(name, src, x, n):
    return _rec(name, src, x, n, 1 / n)


def _over(f: str, n: int, end: int = 0, expr: str = "") -> str:
    """An aggregate over n full rows."""
    frame = f"OVER ({W} ROWS BETWEEN {n - 1 - end} PRECEDING AND {-end} PRECEDING)" if end else f"OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN rn >= {n - end} THEN {f} {frame} END"


def _final(ctes: str, src: str, cols: dict[str, str], extra: str = "") -> str:
    picked = ", ".join(f"round({x} + 1e-9, 6) + 0.0 AS {n}" for n, x in cols.items())
    return f"WITH RECURSIVE {ctes}\nSELECT series, t AS Datetime, {picked}{extra} FROM {src}"


def _vote(up: str, down: str) -> str:
    return f"CASE WHEN {up} THEN 1.0 WHEN {down} THEN -1.0 ELSE 0.0 END"


def _cross(a: str, b: str, up: str = "true", down: str = "true") -> str:
    before = f"lag({a} - {b}) OVER ({W})"
    return _vote(f"{a} > {b} AND {before} <= 0 AND {up}", f"{a} < {b} AND {before} >= 0 AND {down}")


TR = "tr AS (SELECT *, CASE WHEN rn > 1 THEN greatest(h - l, abs(h - pc), abs(l - pc)) END AS x, CASE WHEN c > pc THEN c - pc ELSE 0 END AS gain, CASE WHEN c < pc THEN pc - c ELSE 0 END AS loss, CASE WHEN h - ph > pl - l AND h - ph > 0 THEN h - ph ELSE 0 END AS pdm, CASE WHEN pl - l > h - ph AND pl - l > 0 THEN pl - l ELSE 0 END AS mdm FROM b)"


def _joined(name: str, base: str, **parts: str) -> str:
    """base with the values of recursive averages as columns."""
    joins = " ".join(f"LEFT JOIN {t} ON {t}.series = {base}.series AND {t}.rn = {base}.rn" for t in parts.values())
    return f"{name} AS (SELECT {base}.*, {', '.join(f'{t}.y AS {k}' for k, t in parts.items())} FROM {base} {joins})"


ATR_PARTS = [TR, _rma("a10", "tr", "x", 10), _rma("a14", "tr", "x", 14), _rma("a20", "tr", "x", 20)]
RSI = [HOURLY, TR, _rma("g", "tr", "gain", 14), _rma("s", "tr", "loss", 14), _joined("j", "tr", ag="g", al="s"), "q AS (SELECT *, 100 - 100 / (1 + ag / CASE WHEN abs(al) > 1e-8 THEN al END) AS rsi FROM j)"]


def _macd(fast: int, slow: int, n: int, start: int) -> list[str]:
    return [_ema("mf", "b", "c", fast), _ema("ms", "b", "c", slow), _joined("ml", "b", f="mf", s="ms"), "mx AS (SELECT *, f - s AS line FROM ml)", _ema("mg", "mx", "line", n, start), _joined("m", "mx", sig="mg")]


ADX = [
    _rma("pd", "tr", "pdm", 14), _rma("md", "tr", "mdm", 14), _joined("dj", "tr", p="pd", m="md", a="a14"),
    "di AS (SELECT *, 100 * p / greatest(a, 1e-12) AS plus_di, 100 * m / greatest(a, 1e-12) AS minus_di FROM dj)",
    "dx AS (SELECT *, 100 * abs(plus_di - minus_di) / greatest(plus_di + minus_di, 1e-12) AS dx FROM di)", _rma("ax", "dx", "dx", 14), _joined("adx", "dx", adx="ax"),
]
SUPER = [
    _joined("sj", "b", a="a10"),
    f"sb AS (SELECT *, min((h + l) / 2 + 3.0 * a) OVER ({W}) AS up, max((h + l) / 2 - 3.0 * a) OVER ({W}) AS lo FROM sj)",
    """st AS (SELECT series, CAST(10 AS BIGINT) AS rn, CASE WHEN c <= up THEN up ELSE lo END AS line, CASE WHEN c <= up THEN -1.0 ELSE 1.0 END AS way FROM sb WHERE rn = 10
  UNION ALL SELECT s.series, s.rn, CASE WHEN s.c > p.line THEN greatest(s.lo, p.line) ELSE least(s.up, p.line) END, CASE WHEN s.c > p.line THEN 1.0 ELSE -1.0 END FROM st p JOIN sb s ON s.series = p.series AND s.rn = p.rn + 1)""",
    "sq AS (SELECT b.*, st.line, CASE WHEN b.rn = 1 THEN 1.0 WHEN b.rn < 10 THEN CASE WHEN b.rn > 1 THEN 1.0 END ELSE st.way END AS way FROM b LEFT JOIN st ON st.series = b.series AND st.rn = b.rn)",
]
BOLL = f"bb AS (SELECT *, {_over('avg(c)', 20)} AS mid, {_over('stddev_pop(c)', 20)} AS sd FROM b)"
ICHI = f"ic AS (SELECT *, ({_over('max(h)', 9)} + {_over('min(l)', 9)}) / 2 AS conv, ({_over('max(h)', 26)} + {_over('min(l)', 26)}) / 2 AS base, ({_over('max(h)', 52)} + {_over('min(l)', 52)}) / 2 AS span_b, lead(c, 26) OVER ({W}) AS lagging FROM b)"
STOCH = f"k0 AS (SELECT *, {_over('min(l)', 14)} AS ll, {_over('max(h)', 14)} AS hh FROM b), k1 AS (SELECT *, 100 * (c - ll) / CASE WHEN abs(hh - ll) > 1e-8 THEN hh - ll END AS raw FROM k0), k2 AS (SELECT *, CASE WHEN count(raw) OVER ({W} ROWS 2 PRECEDING) = 3 THEN avg(raw) OVER ({W} ROWS 2 PRECEDING) END AS k FROM k1), k3 AS (SELECT *, CASE WHEN count(k) OVER ({W} ROWS 2 PRECEDING) = 3 THEN avg(k) OVER ({W} ROWS 2 PRECEDING) END AS d FROM k2)"
OBV = f"ob AS (SELECT *, sum(coalesce(sign(c - pc) * v, 0)) OVER ({W}) AS obv FROM b)"
MFI = f"m0 AS (SELECT *, lag(tp) OVER ({W}) AS ptp FROM b), m1 AS (SELECT *, CASE WHEN tp > ptp THEN tp * v ELSE 0 END AS up, CASE WHEN tp < ptp THEN tp * v ELSE 0 END AS down FROM m0), m2 AS (SELECT *, {_over('avg(up)', 14)} * 14 AS us, {_over('avg(down)', 14)} * 14 AS ds FROM m1), mf2 AS (SELECT *, 100 - 100 / (1 + us / CASE WHEN abs(ds) > 1e-8 THEN ds END) AS mfi FROM m2)"
VWAP = f"vw AS (SELECT *, sum(tp * v) OVER ({W}) / sum(v) OVER ({W}) AS vwap FROM b)"
ROC = f"rc AS (SELECT *, 100 * (c - lag(c, 10) OVER ({W})) / abs(lag(c, 10) OVER ({W})) AS roc FROM b)"

# name -> (indicator, parameters, semantics, columns, CTEs, source, SQL columns, SQL vote)
_VOTED = {
    "rsi_intended": ("rsi", {}, "intended", [*RSI, "qi AS (SELECT *, CASE WHEN abs(al) <= 1e-8 THEN CASE WHEN abs(ag) <= 1e-8 THEN 50.0 ELSE 100.0 END ELSE rsi END AS full_rsi FROM q)"], "qi", {"rsi_rsi": "full_rsi"}, _vote("full_rsi <= 30", "full_rsi >= 70")),
    "mfi_intended": ("mfi", {}, "intended", [HOURLY, MFI, "mi AS (SELECT *, CASE WHEN abs(ds) <= 1e-8 THEN CASE WHEN abs(us) <= 1e-8 THEN 50.0 ELSE 100.0 END ELSE mfi END AS full_mfi FROM mf2)"], "mi", {"mfi_mfi": "full_mfi"}, _vote("full_mfi <= 20", "full_mfi >= 80")),
    "rsi": ("rsi", {}, "reference", RSI, "q", {"rsi_rsi": "rsi"}, _vote("rsi <= 30", "rsi >= 70")),
    "macd": ("macd", {"fast": 3, "slow": 6, "signal_len": 9}, "reference", [HOURLY, *_macd(3, 6, 9, 1)], "m", {"macd_macd_line": "line", "macd_macd_signal": "sig", "macd_macd_hist": "line - sig"}, _cross("line", "sig")),
    "macd_intended": ("macd", {}, "intended", [HOURLY, *_macd(12, 26, 9, 26)], "m", {"macd_macd_line": "line", "macd_macd_signal": "sig", "macd_macd_hist": "line - sig"}, _cross("line", "sig")),
    "macd_default": ("macd", {}, "reference", [HOURLY, *_macd(12, 26, 9, 26)], "m", {"macd_macd_line": "line", "macd_macd_signal": "CAST(NULL AS DOUBLE)", "macd_macd_hist": "CAST(NULL AS DOUBLE)"}, "0.0"),
    "bollinger": ("bollinger", {}, "reference", [HOURLY, BOLL], "bb", {"bollinger_bb_basis": "mid", "bollinger_bb_upper": "mid + 2 * sd", "bollinger_bb_lower": "mid - 2 * sd", "bollinger_bb_width": "(mid + 2 * sd) - (mid - 2 * sd)"}, _vote("c <= mid - 2 * sd", "c >= mid + 2 * sd")),
    "bollinger_trend": ("bollinger", {"mode": "trend"}, "reference", [HOURLY, BOLL], "bb", {"bollinger_bb_basis": "mid", "bollinger_bb_upper": "mid + 2 * sd", "bollinger_bb_lower": "mid - 2 * sd", "bollinger_bb_width": "(mid + 2 * sd) - (mid - 2 * sd)"}, _vote("c > mid + 2 * sd", "c < mid - 2 * sd")),
    "keltner": ("keltner", {}, "reference", [HOURLY, *ATR_PARTS, _ema("e", "b", "c", 20), _joined("kc", "b", mid="e", a="a20")], "kc", {"keltner_kc_basis": "mid", "keltner_kc_upper": "mid + 2 * a", "keltner_kc_lower": "mid - 2 * a"}, _vote("c > mid + 2 * a", "c < mid - 2 * a")),
    "dmi_adx": ("dmi_adx", {}, "reference", [HOURLY, *ATR_PARTS, *ADX], "adx", {"dmi_adx_plus_di": "plus_di", "dmi_adx_minus_di": "minus_di", "dmi_adx_adx": "adx"}, _vote("plus_di > minus_di AND adx >= 20", "minus_di > plus_di AND adx >= 20")),
    "stochastic": ("stochastic", {}, "reference", [HOURLY], "b", {"stochastic_stoch_k": "CAST(NULL AS DOUBLE)", "stochastic_stoch_d": "CAST(NULL AS DOUBLE)"}, "0.0"),
    "stochastic_intended": ("stochastic", {}, "intended", [HOURLY, STOCH], "k3", {"stochastic_stoch_k": "k", "stochastic_stoch_d": "d"}, _cross("k", "d", "k < 20", "k > 80")),
    "donchian": ("donchian", {}, "reference", [HOURLY, f"dc AS (SELECT *, {_over('max(h)', 20)} AS up, {_over('min(l)', 20)} AS lo FROM b)"], "dc", {"donchian_donchian_upper": "up", "donchian_donchian_lower": "lo", "donchian_donchian_mid": "(up + lo) / 2"}, _vote("c > up", "c < lo")),
    "donchian_intended": ("donchian", {}, "intended", [HOURLY, f"dc AS (SELECT *, {_over('max(h)', 20, -1)} AS up, {_over('min(l)', 20, -1)} AS lo FROM b)"], "dc", {"donchian_donchian_upper": "up", "donchian_donchian_lower": "lo", "donchian_donchian_mid": "(up + lo) / 2"}, _vote("c > up", "c < lo")),
    "ichimoku": ("ichimoku", {}, "reference", [HOURLY, ICHI], "ic", {"ichimoku_conversion": "conv", "ichimoku_base": "base", "ichimoku_span_a": "(conv + base) / 2", "ichimoku_span_b": "span_b", "ichimoku_lagging": "lagging"}, _cross("conv", "base", "rn >= 52 AND c > greatest((conv + base) / 2, span_b)", "rn >= 52 AND c < least((conv + base) / 2, span_b)")),
    "vwap": ("vwap", {}, "reference", [HOURLY, VWAP], "vw", {"vwap_vwap": "vwap"}, _vote("c > vwap", "c < vwap")),
    "roc": ("roc", {}, "reference", [HOURLY, ROC], "rc", {"roc_roc": "roc"}, _vote("roc > 0", "roc < 0")),
    "obv": ("obv", {}, "reference", [HOURLY, OBV, _ema("oe", "ob", "obv", 20), _joined("oj", "ob", e="oe")], "oj", {"obv_obv": "obv", "obv_obv_ema": "e"}, _vote("obv > e", "obv < e")),
    "mfi": ("mfi", {}, "reference", [HOURLY, MFI], "mf2", {"mfi_mfi": "mfi"}, _vote("mfi <= 20", "mfi >= 80")),
    "supertrend": ("supertrend", {}, "reference", [HOURLY, *ATR_PARTS, *SUPER], "sq", {"supertrend_supertrend": "line", "supertrend_supertrend_dir": "way"}, _vote("c > line AND way > 0", "c < line AND way < 0")),
}


def _add(name: str, query, sql: str | None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def _voted() -> None:
    for name, (key, params, semantics, ctes, src, cols, vote) in _VOTED.items():

        def query(spark, sf_dir, key=key, params=params, semantics=semantics, cols=tuple(cols)):
            return shown(indicator(hourly(spark, sf_dir), key, params, semantics), *cols, f"signal_{key}")

        sql = _final(",\n".join(ctes), src, cols | {f"signal_{key}": vote})
        _add(name, query, sql)

        def only(spark, sf_dir, f=query, key=key):
            return f(spark, sf_dir).select("series", "Datetime", f"signal_{key}")

        _add(f"vote_{name}", only, f"SELECT series, Datetime, signal_{key} FROM ({sql}) AS x")


_voted()
_add("bars_hourly", lambda s, d: shown(hourly(s, d), "Open", "High", "Low", "Close", "Volume"), _final(HOURLY, "b", {"Open": "o", "High": "h", "Low": "l", "Close": "c", "Volume": "v"}))


def bar_anatomy(spark, sf_dir):
    df = hourly(spark, sf_dir).withColumns({"body": sc.body(), "wick_top": sc.wick_top(), "wick_bottom": sc.wick_bottom(), "typical": sc.typical(), "bullish": sc.is_bullish(), "bearish": sc.is_bearish(), "minute": sc.minute_of_day()})
    return shown(df, "body", "wick_top", "wick_bottom", "typical", "bullish", "bearish", "minute")


_add("bar_anatomy", bar_anatomy, _final(HOURLY, "b", {"body": "abs(c - o)", "wick_top": "h - greatest(o, c)", "wick_bottom": "least(o, c) - l", "typical": "tp"}, ", c > o AS bullish, c < o AS bearish, CAST(hour(t) * 60 + minute(t) AS INTEGER) AS minute"))
_add("sma", lambda s, d: shown(ind.sma(hourly(s, d), True), "sma"), _final(HOURLY, "b", {"sma": _over("avg(c)", 20)}))
_add("true_range", lambda s, d: shown(ind.true_range(hourly(s, d)), "true_range"), _final(f"{HOURLY}, {TR}", "tr", {"true_range": "x"}))
_add("ema", lambda s, d: shown(with_recurrences(hourly(s, d), [("ema", {}, "")]), "ema"), _final(",\n".join([HOURLY, _ema("e", "b", "c", 20), _joined("j", "b", e="e")]), "j", {"ema": "e"}))
_add("atr", lambda s, d: shown(with_recurrences(hourly(s, d), [("atr", {}, "")]), "atr"), _final(",\n".join([HOURLY, *ATR_PARTS, _joined("j", "b", a="a14")]), "j", {"atr": "a"}))


def vwap_session_reset(spark, sf_dir):
    df = hourly(spark, sf_dir).withColumn("first", F.hour("Datetime") == 0)
    return shown(ind.vwap(df, True, "first"), "vwap")


_add("vwap_session_reset", vwap_session_reset, _final(f"{HOURLY}, p AS (SELECT *, sum(CASE WHEN hour(t) = 0 THEN 1 ELSE 0 END) OVER ({W}) AS part FROM b)", "p", {"vwap": "sum(tp * v) OVER (PARTITION BY series, part ORDER BY rn) / sum(v) OVER (PARTITION BY series, part ORDER BY rn)"}))

_TEAM = [IndicatorConfig("roc", {}, 1.0), IndicatorConfig("vwap", {}, 2.0), IndicatorConfig("bollinger", {}, 1.5), IndicatorConfig("mfi", {}, 0.5), IndicatorConfig("rsi", {}, 1.0)]
_TEAM_SQL = ",\n".join([HOURLY, VWAP, ROC, BOLL, MFI, TR, *RSI[2:]]) + """,
votes AS (SELECT b.series, b.t, b.rn, CASE WHEN roc > 0 THEN 1 WHEN roc < 0 THEN -1 ELSE 0 END AS v1, CASE WHEN b.c > vwap THEN 1 WHEN b.c < vwap THEN -1 ELSE 0 END AS v2,
  CASE WHEN b.c <= mid - 2 * sd THEN 1 WHEN b.c >= mid + 2 * sd THEN -1 ELSE 0 END AS v3, CASE WHEN mfi <= 20 THEN 1 WHEN mfi >= 80 THEN -1 ELSE 0 END AS v4, CASE WHEN rsi <= 30 THEN 1 WHEN rsi >= 70 THEN -1 ELSE 0 END AS v5
  FROM b JOIN rc USING (series, rn) JOIN vw USING (series, rn) JOIN bb USING (series, rn) JOIN mf2 USING (series, rn) JOIN q USING (series, rn)),
said AS (SELECT *, coalesce(nullif(concat_ws('; ', 'roc=' || nullif(v1, 0), 'vwap=' || nullif(v2, 0), 'bollinger=' || nullif(v3, 0), 'mfi=' || nullif(v4, 0), 'rsi=' || nullif(v5, 0)), ''), 'all_neutral') AS reason,
  (v1 + 2 * v2 + 1.5 * v3 + 0.5 * v4 + v5) / 6 AS wide, sign(v1 + v2 + v3 + v4 + v5) AS most FROM votes)"""


def composite_weighted(spark, sf_dir):
    return shown(generate_signals(hourly(spark, sf_dir), _TEAM)[1], "signal", "score", "reason")


def composite_majority(spark, sf_dir):
    return shown(generate_signals(hourly(spark, sf_dir), _TEAM, aggregation="majority")[1], "signal", "score", "reason")


_add("composite_weighted", composite_weighted, _final(_TEAM_SQL, "said", {"signal": "CAST(CASE WHEN abs(wide) >= 0.1 THEN sign(wide) ELSE 0 END AS DOUBLE)", "score": "CAST(wide AS DOUBLE)"}, ", reason"))
_add("composite_majority", composite_majority, _final(_TEAM_SQL, "said", {"signal": "CAST(most AS DOUBLE)", "score": "CAST(most AS DOUBLE)"}, ", reason"))

# ------------------------------------------------------------------ cleaning


def dirty(spark, sf_dir) -> DataFrame:
    """Half-hourly bars with faults by position: nulls, a repeated time, crossed bounds, negative volumes."""
    df = se.with_index(half_hourly(spark, sf_dir)).withColumn("ord", F.col("idx"))
    before = F.col("Datetime") - F.make_dt_interval(mins=F.lit(30))
    m = F.col("idx")
    return df.withColumns({"Open": F.when(m % 17 != 3, F.col("Open")), "Datetime": F.when(m % 19 == 5, before).otherwise(F.col("Datetime")), "Low": F.when(m % 23 == 12, F.col("High") + 1).otherwise(F.col("Low")), "Volume": F.when(m % 29 == 15, -F.col("Volume")).otherwise(F.col("Volume"))}).drop("idx")


_DIRTY = HALF + """,
d0 AS (SELECT series, rn - 1 AS ord, CASE WHEN (rn - 1) % 19 = 5 THEN t - INTERVAL 30 MINUTE ELSE t END AS t, CASE WHEN (rn - 1) % 17 <> 3 THEN o END AS o, h, CASE WHEN (rn - 1) % 23 = 12 THEN h + 1 ELSE l END AS l, c, CASE WHEN (rn - 1) % 29 = 15 THEN -v ELSE v END AS v FROM b),
d1 AS (SELECT *, CASE WHEN o IS NULL THEN 'na' WHEN row_number() OVER (PARTITION BY series, t, o IS NULL ORDER BY ord) > 1 THEN 'duplicate' WHEN l > least(o, c) OR h < greatest(o, c) THEN 'invariant' END AS gone FROM d0)"""
_add("clean_bars", lambda s, d: shown(clean_bars(dirty(s, d))[0], "Open", "High", "Low", "Close", "Volume"), _final(_DIRTY, "d1 WHERE gone IS NULL", {"Open": "o", "High": "h", "Low": "l", "Close": "c", "Volume": "greatest(v, 0)"}))
_add("clean_bars_drop", lambda s, d: shown(clean_bars(dirty(s, d), clip_negative_volume=False)[0], "Open", "Volume"), _final(_DIRTY, "d1 WHERE gone IS NULL AND v >= 0", {"Open": "o", "Volume": "v"}))


def written(spark, sf_dir) -> DataFrame:
    """Half-hourly bars as texts, their times written in five ways, with and without offsets."""
    df = half_hourly(spark, sf_dir)
    t, ways = F.col("Datetime"), F.pmod(F.col("ord") / 1800, F.lit(5)).cast("int")
    hours, half = (lambda n: t + F.make_dt_interval(hours=F.lit(n))), t - F.make_dt_interval(mins=F.lit(90))
    said = [
        F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.date_format(hours(2), "yyyy-MM-dd HH:mm:ss'+02:00'"), F.date_format(hours(-5), "MM/dd/yyyy HH:mm"),
        F.date_format(hours(-5), "yyyy/MM/dd hh:mm a"), F.date_format(half, "MMM d, yyyy HH:mm:ss' -0130'"),
    ]
    at = F.get(F.array(*said), ways)
    return df.select("ord", at.alias("Timestamp"), F.lit("never").alias("Date"), *[F.col(a).cast("string").alias(b) for a, b in (("Open", "O"), ("High", "HIGH"), ("Low", "l"), ("Close", "Adj Close"), ("Volume", "Qty"))])


_add("bars_of_texts", lambda s, d: shown(bars_of_texts(written(s, d), tz="Etc/GMT+5", ord_col="ord")[0], "Open", "High", "Low", "Close", "Volume"), _final(HALF + ", w AS (SELECT * REPLACE (t - INTERVAL 5 HOUR AS t) FROM b)", "w", {"Open": "o", "High": "h", "Low": "l", "Close": "c", "Volume": "v"}))
_add("clean_report", lambda s, d: clean_bars(dirty(s, d))[1], f"WITH {_DIRTY}\nSELECT count(*) AS input_rows, count(*) FILTER (gone = 'na') AS dropped_na, count(*) FILTER (gone = 'duplicate') AS dropped_duplicate, count(*) FILTER (gone = 'invariant') AS dropped_invariant, CAST(0 AS BIGINT) AS dropped_negative_volume, count(*) FILTER (gone IS NULL AND v < 0) AS clipped_volume, count(*) FILTER (gone IS NULL) AS output_rows, true AS sorted FROM d1")
_add("validate_counts", lambda s, d: violations(dirty(s, d)), f"WITH {_DIRTY}, x AS (SELECT *, lag(t) OVER (PARTITION BY series ORDER BY ord) AS p FROM d0)\nSELECT count(*) AS n_rows, CAST(count(*) FILTER (o IS NULL) AS BIGINT) AS nulls, count(*) FILTER (p IS NOT NULL AND t <= p) AS not_increasing, count(*) FILTER (l > least(o, c)) AS low_above, count(*) FILTER (h < greatest(o, c)) AS high_below, count(*) FILTER (v < 0) AS negative_volume FROM x")

# ------------------------------------------------------------------ sessions

_SESSION = "CASE WHEN m >= 1080 OR m < 120 THEN 'Asia' WHEN m < 420 THEN 'London' WHEN m < 660 THEN 'NY AM' WHEN m < 960 THEN 'NY PM' ELSE 'Off' END"
_LABELLED = f"{HALF}, s0 AS (SELECT *, hour(t) * 60 + minute(t) AS m FROM b), s AS (SELECT *, {_SESSION} AS session FROM s0)"


def _flags_sql(day: str) -> str:
    return f"""WITH {_LABELLED}, d AS (SELECT *, rn - 1 AS idx, CAST({day} AS DATE) AS day FROM s),
n AS (SELECT *, CASE WHEN session = lag(session) OVER (PARTITION BY day ORDER BY idx) THEN 0 ELSE 1 END AS new FROM d),
i AS (SELECT *, sum(new) OVER (PARTITION BY day ORDER BY idx) AS island FROM n),
g AS (SELECT day, session, island, max(h) AS high, min(l) AS low, max(idx) AS e FROM i WHERE session <> 'Off' GROUP BY ALL),
f AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY day, session ORDER BY island) = 1),
k AS (SELECT day, session AS touched_session, e, 'high' AS which, high AS level FROM f UNION ALL SELECT day, session, e, 'low', low FROM f)
SELECT series, CAST(day AS VARCHAR) AS day, touched_session, which, round(level, 6) + 0.0 AS level, session AS by_session, idx AS at_index, t AS timestamp
FROM i JOIN k USING (day) WHERE idx > e AND session <> touched_session AND level BETWEEN l AND h"""


def _flags(spark, sf_dir, rollover=None):
    return se.level_flags(half_hourly(spark, sf_dir), rollover_hour=rollover).withColumns({"day": F.col("day").cast("string"), "level": r6("level"), "at_index": F.col("at_index").cast("long")})


_add("session_label", lambda s, d: se.with_sessions(half_hourly(s, d)).select("series", "Datetime", "session"), f"WITH {_LABELLED} SELECT series, t AS Datetime, session FROM s")
_add("range_high_low", lambda s, d: se.high_low(hourly(s, d), 200, 10), f"WITH {HOURLY} SELECT series, max(h) AS high, min(l) AS low FROM b WHERE rn BETWEEN 11 AND 201 GROUP BY series")
_OVERLAP = se.SessionConfig((("Asia", ((1080, 1439), (0, 179))), ("London", ((90, 479),)), ("NY AM", ((420, 719),)), ("NY PM", ((600, 1019),)), ("Off", ((960, 1079),))))
_INSIDE = {"Asia": "(m >= 1080 OR m < 180)", "London": "m BETWEEN 90 AND 479", "NY AM": "m BETWEEN 420 AND 719", "NY PM": "m BETWEEN 600 AND 1019", "Off": "m BETWEEN 960 AND 1079"}
_NEXT = {"Asia": "London", "London": "NY AM", "NY AM": "NY PM", "NY PM": "Asia"}
_SCAN = "CASE " + " ".join(f"WHEN {test} THEN '{n}'" for n, test in _INSIDE.items()) + " ELSE 'Off' END"
_STAY = "CASE " + " ".join(f"WHEN now = '{n}' THEN CASE WHEN {_INSIDE[n]} THEN '{n}' WHEN {_INSIDE[to]} THEN '{to}' WHEN {_INSIDE['Off']} THEN 'Off' ELSE {_SCAN} END" for n, to in _NEXT.items()) + f" ELSE {_SCAN} END"
_add(
    "sessions_sticky", lambda s, d: se.with_sessions(half_hourly(s, d), _OVERLAP).select("series", "Datetime", "session"),
    f"WITH RECURSIVE {HALF}, x AS MATERIALIZED (SELECT series, t, rn, hour(t) * 60 + minute(t) AS m FROM b), y AS (SELECT series, rn, {_SCAN} AS now FROM x WHERE rn = 1 UNION ALL SELECT x.series, x.rn, {_STAY} FROM y JOIN x ON x.series = y.series AND x.rn = y.rn + 1) SELECT series, t AS Datetime, now AS session FROM y JOIN x USING (series, rn)",
)


def ranges(spark, sf_dir) -> DataFrame:
    """Three position ranges of each series, one of them reversed."""
    return hourly(spark, sf_dir).select("series").distinct().select(F.explode(F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((0, 30), (200, 10), (50, 50))])).alias("r"), "series").select(F.concat_ws(":", "series", "r.start").alias("range_id"), "series", "r.start", "r.end")


_add("ranges_high_low", lambda s, d: se.ranges_high_low(hourly(s, d), ranges(s, d)), f"WITH {HOURLY}, r AS (SELECT unnest([0, 200, 50]) AS a, unnest([30, 10, 50]) AS z) SELECT series || ':' || a AS range_id, max(h) AS high, min(l) AS low FROM b, r WHERE rn - 1 BETWEEN least(a, z) AND greatest(a, z) GROUP BY series, a")
_add("session_high_low", lambda s, d: se.session_high_low(hourly(s, d), "London"), f"WITH {HOURLY} SELECT series, max(h) AS high, min(l) AS low FROM b WHERE hour(t) BETWEEN 2 AND 6 GROUP BY series")
_add("daily_session_levels", lambda s, d: se.daily_levels(half_hourly(s, d)).withColumn("day", F.col("day").cast("string")), f"WITH {_LABELLED}, x AS (SELECT series, CAST(t AS DATE) AS day, session, max(h) AS high, min(l) AS low FROM s GROUP BY ALL), y AS (SELECT DISTINCT series, day, unnest(['Asia', 'London', 'NY AM', 'NY PM']) AS session FROM x) SELECT series, CAST(day AS VARCHAR) AS day, session, high, low FROM y LEFT JOIN x USING (series, day, session)")
_add("level_flags_calendar", _flags, _flags_sql("t"))
_add("level_flags_trading_day", lambda s, d: _flags(s, d, 18), _flags_sql("t + INTERVAL 6 HOUR"))
_add("select_last_n", lambda s, d: shown(se.select_bars(half_hourly(s, d), "2024-01-05 00:00:00", "2024-01-20 23:30:00", 100), "Open", "Close"), f"WITH {HALF}, x AS (SELECT * FROM b WHERE t BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20 23:30:00' ORDER BY t DESC LIMIT 100) SELECT series, t AS Datetime, round(o, 6) + 0.0 AS Open, round(c, 6) + 0.0 AS Close FROM x")

# ------------------------------------------------------------------ regimes


def _regime_sql(start: int) -> str:
    """Features and winners; start: the first row of the MACD line, or 0 for no signal line."""
    sig = "m.sig" if start else "CAST(NULL AS DOUBLE)"
    f = f"""f AS (SELECT b.series, b.t, b.rn, b.c AS close, adx, 100 * a14.y / greatest(b.c, 1e-12) AS atr_pct, e.y AS ema20, (e.y - lag(e.y, 20) OVER (PARTITION BY b.series ORDER BY b.rn)) / 20 AS ema20_slope,
  mid + 2 * sd AS bb_up, mid - 2 * sd AS bb_lo, (mid + 2 * sd) - (mid - 2 * sd) AS bb_width, e.y AS kc_mid, e.y + 2 * a20.y AS kc_up, e.y - 2 * a20.y AS kc_lo, sq.way AS st_dir, sq.line AS st_line,
  m.line AS macd_line, {sig} AS macd_sig, m.line - {sig} AS macd_hist, (conv + base) / 2 AS span_a, span_b FROM b JOIN adx USING (series, rn) LEFT JOIN a14 USING (series, rn) LEFT JOIN a20 USING (series, rn) LEFT JOIN e USING (series, rn)
  JOIN bb USING (series, rn) JOIN sq USING (series, rn) JOIN m USING (series, rn) JOIN ic USING (series, rn)),
fx AS (SELECT *, CASE WHEN bb_up < kc_up AND bb_lo > kc_lo THEN 1.0 ELSE 0.0 END AS squeeze_on, CASE WHEN rn >= 52 AND close > greatest(span_a, span_b) THEN 1.0 ELSE 0.0 END AS above_cloud, CASE WHEN rn >= 52 AND close < least(span_a, span_b) THEN 1.0 ELSE 0.0 END AS below_cloud FROM f),
"""
    scaled = {n: f"CASE WHEN {x} IS NOT NULL THEN CASE WHEN {n}95 - {n}05 <= 1e-12 THEN 1.0 ELSE least(greatest(({x} - {n}05) / ({n}95 - {n}05), 0.0), 1.0) END END" for n, x in (("adx", "adx"), ("atr", "atr_pct"), ("bbw", "bb_width"), ("slope", "abs(ema20_slope)"))}
    q = ", ".join(f"quantile_cont({x}, 0.05) AS {n}05, quantile_cont({x}, 0.95) AS {n}95" for n, x in (("adx", "adx"), ("atr", "atr_pct"), ("bbw", "bb_width"), ("slope", "abs(ema20_slope)")))
    w = f"""q4 AS (SELECT series, {q}, quantile_cont(abs(ema20_slope), 0.5) AS slope50, quantile_cont(abs(ema20_slope), 0.6) AS slope60 FROM fx GROUP BY series),
r0 AS (SELECT fx.*, q4.* EXCLUDE (series), sum(1 - squeeze_on) OVER (PARTITION BY fx.series ORDER BY rn) AS isl FROM fx JOIN q4 USING (series)),
r1 AS (SELECT *, sum(squeeze_on) OVER (PARTITION BY series, isl ORDER BY rn) AS run FROM r0),
r2 AS (SELECT *, CASE WHEN adx >= 25 AND (coalesce(st_dir > 0, false) OR coalesce(macd_line > macd_sig, false) OR above_cloud > 0) THEN coalesce({scaled['adx']}, 0) ELSE -1 END AS c1,
  CASE WHEN adx >= 25 AND (coalesce(st_dir < 0, false) OR coalesce(macd_line < macd_sig, false) OR below_cloud > 0) THEN coalesce({scaled['adx']}, 0) ELSE -1 END AS c2,
  CASE WHEN atr_pct >= 2 AND (close > kc_up OR close < kc_lo) THEN coalesce({scaled['atr']}, 0) ELSE -1 END AS c3,
  CASE WHEN run >= 3 THEN coalesce(1 - {scaled['bbw']}, 0) ELSE -1 END AS c4,
  CASE WHEN adx <= 18 AND abs(ema20_slope) <= slope60 THEN coalesce((1 - {scaled['adx']}) * (1 - {scaled['slope']}), 0) ELSE -1 END AS c5 FROM r1),
r3 AS (SELECT *, greatest(c1, c2, c3, c4, c5) AS top FROM r2),
r AS (SELECT *, CASE WHEN top < 0 THEN '' WHEN c1 = top THEN 'trend_up' WHEN c2 = top THEN 'trend_down' WHEN c3 = top THEN 'breakout' WHEN c4 = top THEN 'squeeze' ELSE 'range' END AS primary_, greatest(top, 0.0) AS confidence,
  CASE WHEN top < 0 THEN 0.0 WHEN c1 = top THEN 1.0 WHEN c2 = top THEN -1.0 WHEN c3 = top THEN CASE WHEN close > kc_up THEN 1.0 ELSE -1.0 END ELSE 0.0 END AS direction,
  concat_ws(',', CASE WHEN st_dir > 0 AND macd_line < macd_sig THEN 'pullback_up' END, CASE WHEN st_dir < 0 AND macd_line > macd_sig THEN 'pullback_down' END, CASE WHEN abs(ema20_slope) <= slope50 AND macd_hist > 0 THEN 'accumulation' END, CASE WHEN abs(ema20_slope) <= slope50 AND macd_hist < 0 THEN 'distribution' END) AS tags FROM r3)"""
    parts = [HOURLY, *ATR_PARTS, *ADX, *SUPER, *_macd(12, 26, 9, 26), BOLL, ICHI, _ema("e", "b", "c", 20)]
    return ",\n".join(parts) + ",\n" + f + w


_HOLD = """,
hs AS (SELECT series, CAST(0 AS BIGINT) AS rn, '' AS now, 0 AS confirm, 0 AS blanks FROM b GROUP BY series
  UNION ALL SELECT r.series, r.rn, CASE WHEN primary_ = '' THEN CASE WHEN blanks + 1 >= 2 THEN '' ELSE now END WHEN primary_ <> now AND confirm + 1 >= 2 THEN primary_ ELSE now END,
  CASE WHEN primary_ = '' THEN confirm WHEN primary_ <> now AND confirm + 1 < 2 THEN confirm + 1 ELSE 0 END,
  CASE WHEN primary_ = '' THEN blanks + 1 WHEN primary_ <> now AND confirm + 1 < 2 THEN blanks ELSE 0 END FROM hs JOIN rt r ON r.series = hs.series AND r.rn = hs.rn + 1)"""


def _won(spark, sf_dir, semantics="reference"):
    return RegimeEngine(semantics=semantics).winners(hourly(spark, sf_dir)).withColumnRenamed("primary", "primary_").withColumn("tags", F.array_join("tags", ","))


_PLAIN = [x for x in FEATURES if x != "close"]
_add("regime_features", lambda s, d: shown(_won(s, d), *_PLAIN), _final(_regime_sql(0), "r", {x: x for x in _PLAIN}))
_add("regime_primary", lambda s, d: shown(_won(s, d), "primary_", "direction", "confidence"), _final(_regime_sql(0), "r", {"direction": "direction", "confidence": "confidence"}, ", primary_"))

_add("regime_tags", lambda s, d: shown(_won(s, d), "tags"), f"WITH RECURSIVE {_regime_sql(0)}\nSELECT series, t AS Datetime, tags FROM r")
_add("regime_hysteresis", lambda s, d: RegimeEngine().run(hourly(s, d))[0].select("series", "Datetime", F.col("primary").alias("primary_")), f"WITH RECURSIVE {_regime_sql(0)},\nrt AS MATERIALIZED (SELECT series, t, rn, primary_ FROM r){_HOLD}\nSELECT rt.series, t AS Datetime, now AS primary_ FROM rt JOIN hs USING (series, rn)")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
