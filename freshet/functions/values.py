"""Text to typed values (SF3 to SF5, SF9, SF12, SF14, SF15, SF18, SF19, SF20, AG13)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def to_number(c: Column) -> Column:
    """SF3: a double, or null for text that is no plain decimal number (NaN, infinity and type suffixes among it)."""
    return F.when(c.rlike(NUMBER), F.trim(c).try_cast("double"))


def to_timestamp(c: Column) -> Column:
    """SF4: a timestamp without zone, or null."""
    return c.try_cast("timestamp_ntz")


def to_export_timestamp(c: Column) -> Column:
    """SF5: US 12-hour text first, then the general form; null if neither."""
    us = [F.try_to_timestamp(c, F.lit(p)).cast("timestamp_ntz") for p in ("MM/dd/yyyy hh:mm:ss a", "M/d/yyyy h:mm:ss a")]
    return F.coalesce(*us, to_timestamp(c))


def first_year(c: Column) -> Column:
    """SF9: the first four digits as an int, or null."""
    return F.nullif(F.regexp_extract(c.cast("string"), r"(\d{4})", 1), F.lit("")).cast("int")


def date_prefix(c: Column) -> Column:
    """SF19: the first ten characters."""
    return F.substring(c.cast("string"), 1, 10)


def iso_second(c: Column) -> Column:
    """SF20: ``2024-01-31T10:00:00``."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")


def sheet_second(c: Column) -> Column:
    """SF20: ``2024-01-31 10:00:00``, which spreadsheets read as a date."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def duration_text(seconds: Column) -> Column:
    """SF12: ``9s``, ``2m 5s`` or ``1h 3m``."""
    s = seconds.cast("long")
    minutes, hours = F.floor(s / 60), F.floor(s / 3600)
    text = lambda x: x.cast("string")
    return (
        F.when(s < 60, F.concat(text(s), F.lit("s")))
        .when(s < 3600, F.concat(text(minutes), F.lit("m "), text(s % 60), F.lit("s")))
        .otherwise(F.concat(text(hours), F.lit("h "), text(F.floor((s % 3600) / 60)), F.lit("m")))
    )


def code_list(c: Column) -> Column:
    """SF15: the different trimmed, non-empty codes of a comma-separated text."""
    return F.array_distinct(F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != ""))


def code_aliases(c: Column) -> Column:
    """SF18, JO2: a code and, for one of eight characters, the same code after ``00``."""
    return F.when(F.length(c) == 8, F.array(c, F.concat(F.lit("00"), c))).otherwise(F.array(c))


def progress(done: Column, total: Column, rows: Column, seconds: Column) -> list[Column]:
    """AG13: percent, rate (rows a second) and eta (seconds); null where they have no meaning yet."""
    percent = F.when(total > 0, F.lit(100.0) * done / total)
    rate = F.when(seconds > 0, rows / seconds)
    eta = F.when(done > 0, (total - done) / done * seconds)
    return [percent.alias("percent"), rate.alias("rate"), eta.alias("eta")]
