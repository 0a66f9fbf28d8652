"""Time blocks and task tables (SF7, SF8, JO5)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def month_blocks(spark: SparkSession, start: str, end: str) -> DataFrame:
    """SF7: lo, hi of each calendar month, clipped to ``[start, end)``."""
    first, last = F.to_date(F.lit(start)), F.to_date(F.lit(end))
    # an empty range has its own month here, which the filter behind removes
    until = F.greatest(F.date_sub(last, 1), F.trunc(first, "MM"))
    days = spark.range(1).select(F.explode(F.sequence(F.trunc(first, "MM"), until, F.expr("interval 1 month"))).alias("m")).filter(first < last)
    return days.select(F.greatest("m", first).alias("lo"), F.least(F.add_months("m", 1), last).alias("hi"))


def year_blocks(spark: SparkSession, first: int, last: int) -> DataFrame:
    """SF8: year, lo, hi of each year."""
    years = spark.range(first, last + 1).select(F.col("id").cast("int").alias("year"))
    return years.select("year", F.make_date("year", F.lit(1), F.lit(1)).alias("lo"), F.make_date(F.col("year") + 1, F.lit(1), F.lit(1)).alias("hi"))


def tasks(years: DataFrame, filters: Iterable[str]) -> DataFrame:
    """JO5: each year with each filter; both lists are short and known to the driver."""
    return years.withColumn("filter", F.explode(F.array(*[F.lit(f) for f in filters])))


def with_block(df: DataFrame, date_column: str, start: str, end: str) -> DataFrame:
    """Rows inside ``[start, end)`` with the lo of their month block, without a range join."""
    at = F.col(date_column)
    lo, hi = (F.lit(f"{d} 00:00:00").cast("timestamp_ntz") for d in (start, end))
    return df.filter((at >= lo) & (at < hi)).withColumn("lo", F.greatest(F.trunc(at.cast("date"), "MM"), F.to_date(F.lit(start))))
