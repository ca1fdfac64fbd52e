"""Cleaning and validation of bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..bars import COLUMNS, BarError, as_double
from ..functions.times import wall_time

#: The stages at which a row can go, in order.
STAGES = ("na", "duplicate", "invariant", "negative_volume")


def bounds_hold() -> Column:
    return (F.col("Low") <= F.least("Open", "Close")) & (F.col("High") >= F.greatest("Open", "Close"))


def staged(df: DataFrame, tz: str | None = None, clip_negative_volume: bool = True) -> DataFrame:
    """Each row with the stage at which cleaning drops it (`dropped`, null if kept) and `clipped`.

    Needs the six columns plus series and ord (the input's order). Times become wall clocks of tz,
    in any session time zone.
    Nulls go first, then later copies of a time, then rows that break the price bounds (so a
    bad first copy takes the good second one along), then negative volumes unless clipped.
    """
    if missing := [c for c in COLUMNS if c not in df.columns]:
        raise BarError(f"not bars: without {missing}")
    kinds = dict(df.dtypes)

    def number(name: str) -> Column:
        return as_double(F.col(name)) if kinds[name] == "string" else F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double"))

    df = df.withColumns({"Datetime": wall_time(F.col("Datetime"), kinds["Datetime"], tz)} | {c: number(c) for c in COLUMNS[1:]})
    null = F.lit(False)
    for name in COLUMNS:
        null = null | F.col(name).isNull()
    copies = Window.partitionBy("series", "Datetime", "_null").orderBy("ord")
    df = df.withColumn("_null", null).withColumn("_copy", F.row_number().over(copies))
    negative = F.col("Volume") < 0
    dropped = F.when(F.col("_null"), "na").when(F.col("_copy") > 1, "duplicate").when(~bounds_hold(), "invariant")
    dropped = dropped if clip_negative_volume else dropped.when(negative, "negative_volume")
    df = df.withColumn("dropped", dropped)
    return df.withColumns({"clipped": F.col("dropped").isNull() & negative, "Volume": F.greatest("Volume", F.lit(0.0)) if clip_negative_volume else F.col("Volume")}).drop("_null", "_copy")


def clean_bars(df: DataFrame, tz: str | None = None, clip_negative_volume: bool = True) -> tuple[DataFrame, DataFrame]:
    """(clean bars, report): rows to keep, and the counts of all rows by stage in one row."""
    rows = staged(df, tz, clip_negative_volume)
    counts = [F.count_if(F.col("dropped") == s).alias(f"dropped_{s}") for s in STAGES]
    report = rows.agg(
        F.count("*").alias("input_rows"), *counts, F.count_if("clipped").alias("clipped_volume"),
        F.count_if(F.col("dropped").isNull()).alias("output_rows"), F.lit(True).alias("sorted"),
    )
    return rows.where("dropped is null").drop("dropped", "clipped"), report


def violations(df: DataFrame) -> DataFrame:
    """One row of counts of breaches of the clean-bar contract."""
    w = Window.partitionBy("series").orderBy("ord")
    rows = df.withColumn("_before", F.lag("Datetime").over(w)).withColumn("_row", F.row_number().over(w))
    nulls = sum((F.col(c).isNull().cast("int") for c in COLUMNS[1:]), F.col("Datetime").isNull().cast("int"))
    return rows.agg(
        F.count("*").alias("n_rows"), F.coalesce(F.sum(nulls), F.lit(0)).cast("long").alias("nulls"),
        F.count_if((F.col("_row") > 1) & ~F.coalesce(F.col("Datetime") > F.col("_before"), F.lit(False))).alias("not_increasing"),
        F.count_if(F.col("Low") > F.least("Open", "Close")).alias("low_above"), F.count_if(F.col("High") < F.greatest("Open", "Close")).alias("high_below"),
        F.count_if(F.col("Volume") < 0).alias("negative_volume"),
    )


def validate_bars(df: DataFrame) -> None:
    """Raises AssertionError on the first kind of breach."""
    found = violations(df).first().asDict()
    for name in ("nulls", "not_increasing", "low_above", "high_below", "negative_volume"):
        if found[name]:
            raise AssertionError(f"{found[name]} bars breach the contract: {name}")


def signature(df: DataFrame) -> tuple[int, int]:
    """A row count and an order-sensitive hash of the bars, the same in every process."""
    h = F.xxhash64("series", "ord", *COLUMNS)
    return tuple(df.agg(F.count("*"), F.coalesce(F.bit_xor(h), F.lit(0))).first())


def is_clean(df: DataFrame, stamp: tuple[int, int]) -> bool:
    """Whether bars still are what a stamp from signature() says."""
    return set(COLUMNS) <= set(df.columns) and signature(df) == tuple(stamp)
