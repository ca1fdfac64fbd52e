"""Times as wall clocks, the same whatever the session's time zone is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# strftime's directives as Spark's pattern letters.
DIRECTIVES = {
    "%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%I": "hh", "%M": "mm", "%S": "ss", "%f": "SSSSSS", "%p": "a",
    "%b": "MMM", "%B": "MMMM", "%a": "E", "%A": "EEEE", "%j": "DDD", "%z": "xx", "%Z": "z", "%T": "HH:mm:ss", "%F": "yyyy-MM-dd", "%%": "%",
}
_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"


def epoch() -> Column:
    return F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")


def utc_clock(instant: Column) -> Column:
    """The wall clock in UTC of an instant (a TIMESTAMP)."""
    seconds = (F.unix_micros(instant).cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(18,6)")
    return epoch() + F.make_dt_interval(secs=seconds)


def seconds(clock: Column) -> Column:
    """Whole seconds from 1970 of a wall clock (TIMESTAMP_NTZ)."""
    days = F.datediff(F.to_date(clock), F.lit("1970-01-01").cast("date")).cast("long")
    return days * 86_400 + F.hour(clock) * 3_600 + F.minute(clock) * 60 + F.second(clock)


def in_zone(utc: Column, tz: str | None) -> Column:
    """A UTC wall clock as that of tz (None: as it is)."""
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), utc) if tz else utc


def spark_pattern(pattern: str) -> str:
    """A pattern of strftime's directives as one of Spark's letters; one without % is taken as Spark's."""
    if "%" not in pattern:
        return pattern
    out, i = "", 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two in DIRECTIVES:
            out, i = out + DIRECTIVES[two], i + 2
        else:
            out, i = out + (f"'{pattern[i]}'" if pattern[i].isalpha() else pattern[i]), i + 1
    return out


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), lambda x: use(x))[0]


def _named_month(t: Column) -> Column:
    """2-Jan-2024 and Jan 2, 2024 with the month as a number, year first."""
    forms = ((r"^(\d{1,2})[ -]([A-Za-z]{3})[a-z]*\.?,?[ -](\d{4})(.*)$", "$3-$2-$1$4"), (r"^([A-Za-z]{3})[a-z]*\.? (\d{1,2}),? (\d{4})(.*)$", "$3-$1-$2$4"))
    for form, turned in forms:
        t = F.regexp_replace(t, form, turned)

    def numbered(x: Column) -> Column:
        at = F.instr(F.lit(_MONTHS), F.lower(F.substring(x, 6, 3)))
        return F.when(at % 3 == 1, F.concat(F.substring(x, 1, 5), ((at + 2) / 3).cast("int").cast("string"), F.substring(x, 9, 100))).otherwise(x)

    return _let(t, numbered)


def _full_day(t: Column) -> Column:
    """Hours with AM or PM as hours of the day."""
    half = r"^(.*[ T])(\d{1,2})(:\d{2}(?::\d{2}(?:\.\d+)?)?)\s*([AaPp])\.?[Mm]\.?$"
    hour = F.regexp_extract(t, half, 2).try_cast("int") % 12 + F.when(F.lower(F.regexp_extract(t, half, 4)) == "p", 12).otherwise(0)
    return F.when(t.rlike(half), F.concat(F.regexp_extract(t, half, 1), hour.cast("string"), F.regexp_extract(t, half, 3))).otherwise(t)


def _iso(text: Column) -> Column:
    """Common ways to write a date and a time, as 'yyyy-M-d H:mm:ss': what is ambiguous is month first."""
    t = F.regexp_replace(text, r"^(1[3-9]|2\d|3[01])[/.-](\d{1,2})[/.-](\d{4})", "$3-$2-$1")
    t = F.regexp_replace(t, r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})", "$3-$1-$2")
    t = F.regexp_replace(t, r"^(\d{4})[/.](\d{1,2})[/.](\d{1,2})", "$1-$2-$3")
    t = F.regexp_replace(t, r"^(\d{4})(\d{2})(\d{2})(?=$|[ T])", "$1-$2-$3")
    return _let(_named_month(t), _full_day)


def read_time(text: Column, tz: str | None = None, pattern: str | None = None) -> Column:
    """A written time as the wall clock of tz; null if it is none.

    An offset (Z, UTC, +02:00, -0500, +02) is applied and the time converted to tz (None: UTC); a time
    without one is taken as it is written. `pattern` is in strftime's directives or Spark's letters.
    """
    text = F.trim(text)
    if pattern:
        form = spark_pattern(pattern)
        letters = "".join(form.split("'")[::2])
        if any(x in letters for x in "XxZzVO"):
            return in_zone(utc_clock(F.try_to_timestamp(text, F.lit(form))), tz)
        return utc_clock(F.try_to_timestamp(F.concat(text, F.lit(" +0000")), F.lit(form + " xx")))
    zoned = r"^(.*\d:\d{2}.*?)\s*(Z|z|UTC|GMT|[+-]\d{2}(?::?\d{2})?)$"

    def offset(said: Column) -> Column:
        """Minutes of an offset; null without one."""
        sign = F.when(said.startswith("-"), -1).otherwise(1)
        more = F.coalesce(F.regexp_extract(said, r"^.\d{2}:?(\d{2})$", 1).try_cast("int"), F.lit(0))
        return F.when(said.rlike(r"^[+-]"), sign * (F.substring(said, 2, 2).try_cast("int") * 60 + more)).when(said != "", 0)

    def read(x: Column) -> Column:
        clock = _iso(F.when(x["by"].isNull(), x["text"]).otherwise(F.regexp_extract(x["text"], zoned, 1))).try_cast("timestamp_ntz")
        return _let(clock, lambda c: F.when(x["by"].isNull(), c).otherwise(in_zone(c - F.make_dt_interval(mins=x["by"]), tz)))

    by = _let(F.regexp_extract(text, zoned, 2), offset)
    return _let(F.struct(text.alias("text"), by.alias("by")), read)


def wall_time(c: Column, kind: str, tz: str | None = None) -> Column:
    """A time column of a Spark type as the wall clock of tz: instants are converted, clocks stay, texts are read."""
    if kind == "timestamp":
        return in_zone(utc_clock(c), tz)
    return read_time(c, tz) if kind == "string" else c.try_cast("timestamp_ntz")


def bar_time(c: Column, kind: str, tz: str | None = None) -> Column:
    """The time of a bar as its container reads it: a clock without a zone counts as UTC where tz is given.

    A text's trailing Z or + offset is cut off, not applied; other texts than yyyy-MM-dd[ HH:mm[:ss]] fail.
    """
    if kind == "timestamp":
        return in_zone(utc_clock(c), tz)
    if kind == "string":
        t = F.regexp_replace(F.regexp_replace(F.replace(c, F.lit("T"), F.lit(" ")), "Z$", ""), r"\+.*$", "")
        t = F.when(t.contains(" "), t).otherwise(F.concat(t, F.lit(" 00:00:00")))
        t = F.when(t.rlike(r" \d+:\d+$"), F.concat(t, F.lit(":00"))).otherwise(t)
        c = F.to_timestamp_ntz(t, F.lit("yyyy-MM-dd HH:mm:ss"))
    return in_zone(c.cast("timestamp_ntz"), tz)
