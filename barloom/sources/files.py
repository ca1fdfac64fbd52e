"""Bars from CSV files, row objects and mappings."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..bars import COLUMNS, PRICES, SIGNAL_ALIASES, BarError, as_double, canonical
from ..functions.times import read_time
from ..operators.clean import clean_bars

# The names that CSV files use.
SYNONYMS = {
    "Open": ("open", "o"), "High": ("high", "h"), "Low": ("low", "l"), "Close": ("close", "c", "adj close", "adj_close"),
    "Volume": ("volume", "vol", "qty", "quantity"), "Datetime": ("datetime", "timestamp", "ts", "date", "time"),
}
#: The same for drawing, besides the fields' own names.
PLOT_NAMES = {
    "Datetime": ("datetime", "DateTime", "date", "Date", "timestamp", "Timestamp", "time", "Time"), "Open": ("open", "o"), "High": ("high", "h"), "Low": ("low", "l"),
    "Close": ("close", "c"), "Volume": ("volume", "vol", "Vol", "Qty", "quantity"),
}
ROW_NAMES = {
    "Open": ("open", "o", "Open", "O"), "High": ("high", "h", "High", "H"), "Low": ("low", "l", "Low", "L"), "Close": ("close", "c", "Close", "C"),
    "Volume": ("volume", "vol", "v", "Volume", "Vol", "V"), "Datetime": ("datetime", "time", "timestamp", "Date", "date"),
}


def load_bars_csv(
    spark: SparkSession, path: str, *, tz: str | None = "America/New_York", delimiter: str | None = None, date_format: str | None = None,
    synonyms: dict | None = None, run_cleaner: bool = True, memory_efficient: bool = False,
) -> tuple[DataFrame, DataFrame | None]:
    """(bars, cleaning report or None) of CSV files with a header; options as of bars_of_texts().

    Files are read in splits, so `memory_efficient` changes nothing.
    """
    raw = spark.read.option("header", True).option("sep", delimiter or ",").option("inferSchema", False).csv(path)
    return bars_of_texts(raw, tz=tz, date_format=date_format, synonyms=synonyms, run_cleaner=run_cleaner)


def bars_of_texts(
    raw: DataFrame, *, tz: str | None = "America/New_York", date_format: str | None = None, synonyms: dict | None = None, run_cleaner: bool = True,
    ord_col: str | None = None,
) -> tuple[DataFrame, DataFrame | None]:
    """(bars, cleaning report or None) of a table of texts.

    Columns are found by name without regard to case (of equal names the last); `synonyms` replaces the
    accepted names. Times come from the first column of synonyms["Datetime"] (date and time aside) with a
    value that parses; else from date and time; else from date, timestamp or time. Offsets are applied and
    times converted to tz, those without an offset are taken as tz's. Uncleaned bars are sorted by time, stably.
    `ord_col` names a column of the input's order, else that of the scan counts.
    """
    lower = {n.strip().lower(): n for n in raw.columns}
    accepted = {k: tuple(a.lower() for a in names) for k, names in (synonyms or SYNONYMS).items()}
    found = {k: next((lower[a] for a in accepted.get(k, ()) if a in lower), None) for k in COLUMNS[1:]}
    if missing := [k for k in COLUMNS[1:] if found[k] is None]:
        raise BarError(f"no column for {missing}; candidates: { {k: accepted.get(k) for k in missing} }, available: {raw.columns}")

    def read(text: Column) -> Column:
        return read_time(text, tz, date_format)

    def col(name: str) -> Column:
        return F.col(f"`{lower[name]}`").cast("string")

    full = [n for n in accepted.get("Datetime", ()) if n in lower and n not in ("date", "time")]
    parses = raw.agg(*[F.count(read(col(n))).alias(f"n{i}") for i, n in enumerate(full)]).first() if full else ()
    at = next((read(col(n)) for n, some in zip(full, parses) if some), None)
    if at is None and {"date", "time"} <= set(lower):
        at = read(F.concat_ws(" ", F.trim(col("date")), F.trim(col("time"))))
    if at is None:
        name = next((n for n in ("date", "timestamp", "time") if n in lower), None)
        if name is None:
            raise BarError(f"no date or time column; available: {raw.columns}")
        at = read(col(name))
    numbers = [as_double(F.col(f"`{found[k]}`")).alias(k) for k in COLUMNS[1:]]
    order = F.col(f"`{ord_col}`").cast("long") if ord_col else F.monotonically_increasing_id()
    bars = raw.select(F.lit("all").alias("series"), order.alias("ord"), at.alias("Datetime"), *numbers)
    return clean_bars(bars, tz) if run_cleaner else (bars.orderBy("Datetime", "ord"), None)


def bars_from_rows(spark: SparkSession, rows: Iterable) -> DataFrame:
    """Bars of objects, mappings or tuples (time, open, high, low, close, volume); none: an empty table."""

    def get(row, names):
        for n in names:
            if isinstance(row, Mapping):
                if n in row:
                    return row[n]
            elif hasattr(row, n):
                return getattr(row, n)
        return None

    out = []
    for i, row in enumerate(rows):
        if isinstance(row, (tuple, list)) and not hasattr(row, "_fields"):
            if len(row) < 6:
                raise TypeError("a bar tuple has six fields")
            values = dict(zip(COLUMNS, row))
        else:
            values = {k: get(row, names) for k, names in ROW_NAMES.items()}
            if all(values[k] is None for k in PRICES):
                raise TypeError(f"not a bar: {row!r}")
        numbers = [None if values[c] is None or values[c] != values[c] else float(values[c]) for c in COLUMNS[1:]]
        out.append(("all", i, None if values["Datetime"] is None else str(values["Datetime"]), *numbers))
    schema = "series string, ord long, Datetime string, " + ", ".join(f"{c} double" for c in COLUMNS[1:])
    return spark.createDataFrame(out, schema).withColumn("Datetime", read_time(F.col("Datetime")))


def to_bars(spark: SparkSession, source, aliases: dict = SIGNAL_ALIASES) -> DataFrame:
    """Bars of a DataFrame, a pandas frame, a mapping of columns, an object that holds columns, or an iterable of rows.

    An object that holds columns has open, high, low, close, volume and timestamps. Anything else: TypeError.
    """
    import pandas as pd

    if all(hasattr(source, n) for n in ("open", "high", "low", "close", "volume", "timestamps")):
        source = {"Datetime": list(source.timestamps)} | {k: list(getattr(source, k.lower())) for k in COLUMNS[1:]}
    if isinstance(source, Mapping):
        source = pd.DataFrame({k: list(v) for k, v in source.items()})
    if isinstance(source, pd.DataFrame):
        source = spark.createDataFrame(source.assign(**{c: source[c].astype("string") for c in source if source[c].dtype == object}))
    if isinstance(source, DataFrame):
        return as_bars(source, aliases)
    if isinstance(source, (str, bytes)) or not isinstance(source, Iterable):
        raise TypeError(f"not bars: {type(source).__name__}")
    return bars_from_rows(spark, source)


def as_bars(source, aliases: dict = SIGNAL_ALIASES) -> DataFrame:
    """A table of bars as it is; other tables by their columns' names, other sources as of to_bars in the active session."""
    if isinstance(source, DataFrame):
        return source if {"series", "ord", *COLUMNS} <= set(source.columns) else canonical(source, aliases)
    return to_bars(SparkSession.getActiveSession(), source, aliases)


def plot_frame(spark: SparkSession, source) -> DataFrame:
    """Bars to draw: names match as they are first, then without regard to case; a missing column is null."""
    if isinstance(source, DataFrame) and not {"series", "ord"} <= set(source.columns):
        names, lower = source.columns, {n.lower(): n for n in source.columns}
        found = {k: next((a for a in (k, *PLOT_NAMES[k]) if a in names), next((lower[a.lower()] for a in (k, *PLOT_NAMES[k]) if a.lower() in lower), None)) for k in COLUMNS}
        kept = source.select(*[F.col(f"`{c}`").alias(k) for k, c in found.items() if c])
        return canonical(kept.withColumns({k: F.lit(None).cast("double") for k in PRICES if not found[k]}))
    if isinstance(source, Mapping) or type(source).__name__ == "DataFrame" and not isinstance(source, DataFrame):
        import pandas as pd

        frame = pd.DataFrame({k: list(v) for k, v in source.items()})
        return plot_frame(spark, spark.createDataFrame(frame.assign(**{c: frame[c].astype("string") for c in frame if frame[c].dtype == object})))
    return to_bars(spark, source)


def plot_bars(bars, start=None, end=None, last_n: int | None = None, title: str = "Bars", width: float = 0.6):
    """Draws a slice of bars, if matplotlib is there, and returns it as pandas; BarError if empty."""
    from ..operators.sessions import select_bars

    out = select_bars(plot_frame(SparkSession.getActiveSession(), bars), start, end, last_n).toPandas()
    if out.empty:
        raise BarError("no bars to draw")
    try:
        import matplotlib.pyplot as plt
    except ImportError:
        return out
    _, axes = plt.subplots()
    for i, b in enumerate(out.itertuples()):
        color = "tab:green" if b.Close >= b.Open else "tab:red"
        axes.vlines(i, b.Low, b.High, color=color, linewidth=1)
        axes.bar(i, abs(b.Close - b.Open), width, min(b.Open, b.Close), color=color)
    axes.set_title(title)
    return out
