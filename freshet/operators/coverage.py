"""Coverage statistics of stations (AG6 to AG11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def month_number(c: Column) -> Column:
    return F.year(c) * 12 + F.month(c)


def station_coverage(df: DataFrame, station: str, date_column: str, extra: list[Column] | None = None) -> DataFrame:
    """AG8 to AG10: station, n_rows, first_obs, last_obs, months_with_data, months_in_range, completeness (percent).

    Rows without a date count in n_rows only; a null station is a group.
    """
    at = F.col(date_column)
    by = df.groupBy(F.col(station).alias("station")).agg(
        F.count("*").alias("n_rows"),
        F.min(at).alias("first_obs"),
        F.max(at).alias("last_obs"),
        F.countDistinct(month_number(at)).alias("months_with_data"),
        *(extra or []),
    )
    span = (month_number(F.col("last_obs")) - month_number(F.col("first_obs")) + 1).cast("long")
    by = by.withColumn("months_in_range", F.greatest(F.lit(1).cast("long"), span))
    percent = F.when(F.col("first_obs").isNotNull(), F.lit(100.0) * F.col("months_with_data") / F.col("months_in_range"))
    return by.withColumn("completeness", percent)


def first_by(value: str, *order: str) -> Column:
    """AG11: the value of the least row by a total order."""
    return F.min_by(F.col(value), F.struct(*order))


def totals(df: DataFrame, date_column: str) -> DataFrame:
    """AG6, AG7: n_rows, first_obs, last_obs."""
    return df.agg(F.count("*").alias("n_rows"), F.min(date_column).alias("first_obs"), F.max(date_column).alias("last_obs"))
