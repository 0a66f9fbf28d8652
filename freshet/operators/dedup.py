"""Removal of repeated measurements (DD1, WI1, AG6)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_greatest(df: DataFrame, keys: Sequence[str], value: str | None, ties: Sequence[Column] | None = None) -> DataFrame:
    """One row of each key: the greatest value, null last, then the greatest of ``ties`` (by default all other columns).

    Null keys are equal. The order is total up to equal rows, so arrival order doesn't matter. It is one aggregation
    with partial results, so a key with very many rows is reduced before it moves.
    """
    rest = ties if ties is not None else [F.col(c) for c in df.columns if c not in keys and c != value]
    order = ([F.when(F.isnan(value), None).otherwise(F.col(value)) if dict(df.dtypes)[value] in ("double", "float") else F.col(value)] if value else []) + list(rest)
    best = F.max_by(F.struct(*df.columns), F.struct(*[c.alias(f"_{i}") for i, c in enumerate(order)])) if order else F.first(F.struct(*df.columns))
    return df.groupBy(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)]).agg(best.alias("_row")).select("_row.*")


def deduplicate(df: DataFrame, date_column: str, station: str = "codigoestacion", sensor: str = "codigosensor", value: str = "valorobservado") -> DataFrame:
    """DD1: by station, sensor if there is one, and date. The same rows where station or date is missing."""
    if station not in df.columns or date_column not in df.columns:
        return df
    keys = [c for c in (station, sensor, date_column) if c in df.columns]
    return keep_greatest(df, keys, value if value in df.columns else None)


def duplicate_count(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """AG6: raw, kept, removed."""
    groups = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("raw"), F.count("*").alias("kept")).withColumn("removed", F.col("raw") - F.col("kept"))


def part_number(df: DataFrame, by: Sequence[str], order: Sequence[Column], max_rows: int) -> DataFrame:
    """WI2, SK3: ``part`` from 1 in runs of ``max(1, max_rows - 1)`` rows within each group."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("part", (F.floor((F.row_number().over(w) - 1) / max(1, max_rows - 1)) + 1).cast("int"))
