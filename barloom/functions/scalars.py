"""Column expressions over one bar."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Denominators up to this size give null instead of a quotient.
TINY = 1e-8


def body() -> Column:
    return F.abs(F.col("Close") - F.col("Open"))


def is_bullish() -> Column:
    return F.col("Close") > F.col("Open")


def is_bearish() -> Column:
    return F.col("Close") < F.col("Open")


def _whole(x: Column) -> Column:
    """x where open and close are known: greatest and least would pass over a null."""
    return F.when(F.col("Open").isNotNull() & F.col("Close").isNotNull(), x)


def wick_top() -> Column:
    return _whole(F.col("High") - F.greatest("Open", "Close"))


def wick_bottom() -> Column:
    return _whole(F.least("Open", "Close") - F.col("Low"))


def typical() -> Column:
    return (F.col("High") + F.col("Low") + F.col("Close")) / 3


def minute_of_day(t: Column | str = "Datetime") -> Column:
    return F.hour(t) * 60 + F.minute(t)


def safe_div(n: Column, d: Column) -> Column:
    return F.when(F.abs(d) > TINY, n / d)


def vote(up: Column, down: Column) -> Column:
    """1, -1 or 0; a comparison with null is not met."""
    return F.when(F.coalesce(up, F.lit(False)), 1.0).when(F.coalesce(down, F.lit(False)), -1.0).otherwise(0.0)
