"""Indicators of bounded and cumulative frames, as steps that add columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..bars import ordered
from .kernels import back, full, highest, lowest, mean, so_far
from .scalars import safe_div, typical


def sma(df: DataFrame, reference: bool, length: int = 20) -> DataFrame:
    return df.withColumn("sma", mean("Close", length, reference))


def roc(df: DataFrame, reference: bool, length: int = 10) -> DataFrame:
    p = back("Close", length) if length > 0 else F.lit(None).cast("double")
    return df.withColumn("roc", safe_div(F.col("Close") - p, F.abs(p)) * 100.0)


def true_range(df: DataFrame, reference: bool = True) -> DataFrame:
    p = back("Close")
    tr = F.greatest(F.col("High") - F.col("Low"), F.abs(F.col("High") - p), F.abs(F.col("Low") - p))
    return df.withColumn("true_range", F.when(p.isNotNull() & F.col("High").isNotNull() & F.col("Low").isNotNull(), tr))


def bollinger(df: DataFrame, reference: bool, length: int = 20, stdev_mult: float = 2.0) -> DataFrame:
    sd = full(F.stddev_pop("Close"), "Close", length) if length > 1 else F.lit(None).cast("double")
    df = df.withColumns({"bb_basis": mean("Close", length, reference), "_sd": sd})
    up, low = (F.col("bb_basis") + s * stdev_mult * F.col("_sd") for s in (1, -1))
    return df.withColumns({"bb_upper": up, "bb_lower": low, "bb_width": up - low}).drop("_sd")


def stochastic(df: DataFrame, reference: bool, k: int = 14, d: int = 3, smooth_k: int = 3) -> DataFrame:
    low, high = lowest("Low", k), highest("High", k)
    df = df.withColumn("_raw", 100.0 * safe_div(F.col("Close") - low, high - low))
    df = df.withColumn("stoch_k", mean("_raw", smooth_k, reference) if smooth_k > 1 else F.col("_raw"))
    return df.withColumn("stoch_d", mean("stoch_k", d, reference) if d > 1 else F.col("stoch_k")).drop("_raw")


def donchian(df: DataFrame, reference: bool, length: int = 20) -> DataFrame:
    """The reference frame ends with the bar itself, the intended one with the bar before."""
    end = 0 if reference else -1
    up, low = highest("High", length, end), lowest("Low", length, end)
    return df.withColumns({"donchian_upper": up, "donchian_lower": low, "donchian_mid": (up + low) / 2.0})


def ichimoku(df: DataFrame, reference: bool, tenkan: int = 9, kijun: int = 26, senkou_b: int = 52) -> DataFrame:
    def middle(n: int) -> Column:
        return (highest("High", n) + lowest("Low", n)) / 2.0

    df = df.withColumns({"conversion": middle(tenkan), "base": middle(kijun), "span_b": middle(senkou_b), "lagging": F.lead("Close", kijun).over(ordered())})
    return df.withColumn("span_a", (F.col("conversion") + F.col("base")) / 2.0)


def obv(df: DataFrame, reference: bool) -> DataFrame:
    d = F.col("Close") - back("Close")
    df = df.withColumn("_signed", F.coalesce(F.when(d > 0, F.col("Volume")).when(d < 0, -F.col("Volume")), F.lit(0.0)))
    return df.withColumn("obv", F.sum("_signed").over(so_far())).drop("_signed")


def mfi(df: DataFrame, reference: bool, length: int = 14) -> DataFrame:
    df = df.withColumn("_tp", typical())
    p, flow = back("_tp"), F.col("_tp") * F.col("Volume")

    def kept(test: Column) -> Column:
        return F.when(F.coalesce(test, F.lit(False)), flow).otherwise(0.0)

    df = df.withColumns({"_up": kept(F.col("_tp") > p), "_down": kept(F.col("_tp") < p)})
    df = df.withColumns({"_up": mean("_up", length, reference) * length, "_down": mean("_down", length, reference) * length})
    out = 100.0 - 100.0 / (1.0 + safe_div(F.col("_up"), F.col("_down")))
    if not reference:
        out = F.when(F.abs(F.col("_down")) <= 1e-8, F.when(F.abs(F.col("_up")) <= 1e-8, 50.0).otherwise(100.0)).otherwise(out)
    return df.withColumn("mfi", out).drop("_tp", "_up", "_down")


def vwap(df: DataFrame, reference: bool, session_resets: str | None = None) -> DataFrame:
    """Cumulative from the start, or from each row where the boolean column session_resets is true."""
    df = df.withColumns({"_n": typical() * F.col("Volume"), "_v": F.col("Volume")})
    if session_resets is None:
        # one null makes the rest null, as in a running sum
        known = F.count_if(F.col("_n").isNull()).over(so_far()) == 0
        return df.withColumn("vwap", F.when(known, safe_div(F.sum("_n").over(so_far()), F.sum("_v").over(so_far())))).drop("_n", "_v")
    df = df.withColumn("_part", F.sum(F.when(F.coalesce(F.col(session_resets).cast("boolean"), F.lit(True)), 1).otherwise(0)).over(so_far()))
    w = Window.partitionBy("series", "_part").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    known = F.count_if(F.col("_n").isNull()).over(w) == 0
    total = F.sum("_v").over(w)
    return df.withColumn("vwap", F.when(known & (total != 0), F.sum("_n").over(w) / total)).drop("_n", "_v", "_part")
