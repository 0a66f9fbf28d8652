"""The reproducible row key (SF2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .values import iso_second

#: What stands for a missing value of a column that exists; an absent column gives an empty part.
MISSING = "nan"


def stable_hash(*parts: Column) -> Column:
    """SHA-256, in hexadecimal, of the parts joined by ``|``; a null part is empty and keeps its place."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def with_row_key(df: DataFrame, dataset_id: str, date_column: str, station: str = "codigoestacion", sensor: str = "codigosensor") -> DataFrame:
    """Adds ``floating_id``; date parts have the precision of a second."""

    def part(name: str) -> Column:
        if name not in df.columns:
            return F.lit("")
        kind = dict(df.dtypes)[name]
        text = iso_second(F.col(name)) if name == date_column and kind.startswith("timestamp") else F.col(name).cast("string")
        return F.coalesce(text, F.lit(MISSING))

    return df.withColumn("floating_id", stable_hash(F.lit(dataset_id), part(station), part(sensor), part(date_column)))
