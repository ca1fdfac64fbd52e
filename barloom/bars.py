"""The bar model: columns, alias resolution, null policy, ticks to bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.times import seconds, wall_time

PRICES = ("Open", "High", "Low", "Close")
COLUMNS = ("Datetime", *PRICES, "Volume")
SCHEMA = T.StructType([T.StructField("Datetime", T.TimestampNTZType())] + [T.StructField(c, T.DoubleType()) for c in COLUMNS[1:]])

# The accepted names, in order of precedence, of each way into the engine.
SIGNAL_ALIASES = {
    "Open": ("open", "o"), "High": ("high", "h"), "Low": ("low", "l"), "Close": ("close", "c"),
    "Volume": ("volume", "vol", "v"), "Datetime": ("datetime", "time", "timestamp", "date"),
}
REGIME_ALIASES = SIGNAL_ALIASES | {"Datetime": ("datetime", "timestamp", "time", "date")}


class BarError(ValueError):
    """Input that is not bars."""


def infer_columns(names: list[str], aliases: dict = SIGNAL_ALIASES) -> dict[str, str | None]:
    """Which column stands for each bar field, without regard to case; of equal names the last."""
    lower = {n.lower(): n for n in names}
    return {field: next((lower[a] for a in accepted if a in lower), None) for field, accepted in aliases.items()}


def as_double(c: Column) -> Column:
    """A number or null: never NaN, and no suffixes such as 1d that a cast would take."""
    text = F.trim(c.cast("string"))
    plain = text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^[+-]?(?i:inf|infinity)$")
    return F.when(plain, F.nanvl(text.try_cast("double"), F.lit(None).cast("double")))


def canonical(df: DataFrame, aliases: dict = SIGNAL_ALIASES, series: str | None = None, ord_col: str | None = None) -> DataFrame:
    """df as bars: series, ord, Datetime, prices and Volume, numbers as doubles with nulls for NaN.

    A missing volume or time is null. `ord` fixes the order of rows: the named column, else
    the order of the scan. `series` defaults to one series.
    """
    found = infer_columns(df.columns, aliases)
    for field in PRICES:
        if found[field] is None:
            raise BarError(f"no column stands for {field}: there are {df.columns}")

    def number(field: str) -> Column:
        if found[field] is None:
            return F.lit(None).cast("double")
        kind = df.schema[found[field]].dataType
        c = F.col(f"`{found[field]}`")
        return as_double(c) if isinstance(kind, T.StringType) else F.nanvl(c.cast("double"), F.lit(None).cast("double"))

    at = found["Datetime"]
    when = wall_time(F.col(f"`{at}`"), dict(df.dtypes)[at]) if at else F.lit(None).cast("timestamp_ntz")
    order = F.col(f"`{ord_col}`").cast("long") if ord_col else F.monotonically_increasing_id()
    key = F.col(f"`{series}`").cast("string") if series else F.lit("all")
    return df.select(key.alias("series"), order.alias("ord"), when.alias("Datetime"), *[number(f).alias(f) for f in COLUMNS[1:]])


def resample(ticks: DataFrame, every: str, time: str, price: Column, ident: list[str], series: Column | None = None, volume: Column | None = None) -> DataFrame:
    """Bars of ticks: first, greatest, least and last price of each bucket, in (time, ident) order.

    One aggregation with map-side combination; volume defaults to the count of ticks.
    """
    order = F.struct(time, *ident)
    rows = ticks.select((series if series is not None else F.lit("all")).alias("series"), F.window(time, every)["start"].alias("Datetime"), price.alias("p"), order.alias("o"), (volume if volume is not None else F.lit(1.0)).cast("double").alias("v"))
    bars = rows.groupBy("series", "Datetime").agg(
        F.min_by("p", "o").alias("Open"), F.max("p").alias("High"), F.min("p").alias("Low"), F.max_by("p", "o").alias("Close"), F.sum("v").alias("Volume")
    )
    at = wall_time(F.col("Datetime"), dict(bars.dtypes)["Datetime"])
    return bars.withColumn("Datetime", at).select("series", seconds(F.col("Datetime")).alias("ord"), "Datetime", *PRICES, "Volume")


def ordered(*more: str) -> Window:
    """The window in which bars of a series follow each other in input order."""
    return Window.partitionBy("series").orderBy("ord", *more)
