"""Window kernels: bounded and cumulative frames over the bars of a series."""

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..bars import ordered


def back(x: str, n: int = 1) -> Column:
    return F.lag(x, n).over(ordered())


def frame(n: int, end: int = 0):
    return ordered().rowsBetween(end - n + 1, end)


def so_far():
    return ordered().rowsBetween(Window.unboundedPreceding, 0)


def full(agg: Column, x: str, n: int, end: int = 0) -> Column:
    """An aggregate over the last n rows, null unless all n are there and not null."""
    return F.when(F.count(x).over(frame(n, end)) == n, agg.over(frame(n, end)))


def mean(x: str, n: int, reference: bool) -> Column:
    """The mean of n rows; in reference semantics one null makes all later means null."""
    if n <= 0:
        return F.lit(None).cast("double")
    out = full(F.avg(x), x, n)
    return F.when(F.count_if(F.col(x).isNull()).over(so_far()) == 0, out) if reference else out


def highest(x: str, n: int, end: int = 0) -> Column:
    return full(F.max(x), x, n, end)


def lowest(x: str, n: int, end: int = 0) -> Column:
    return full(F.min(x), x, n, end)
