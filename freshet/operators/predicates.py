"""Filters (FI1 to FI3, FI6 to FI11, FI13, FI15 to FI17) as Columns: values are literals, never SQL text."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from datetime import date
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import fold_label, fold_text


def in_upper(c: Column, values: Iterable[str]) -> Column:
    """FI2: membership without regard to case."""
    return F.upper(c).isin([v.upper() for v in values])


def date_window(c: Column, start: str, end: str) -> Column:
    """FI3: ``start <= c < end`` on midnights; two range filters that reach a Parquet scan."""
    at = lambda day: F.lit(f"{day} 00:00:00").cast("timestamp_ntz")
    return (c >= at(start)) & (c < at(end))


def all_of(conditions: Iterable[Column | None]) -> Column:
    """FI7: conjunction; true where there is no condition."""
    return reduce(and_, [c for c in conditions if c is not None], F.lit(True))


def attribute_filter(selected: Mapping[str, Iterable[str]]) -> Column:
    """FI8: any value within an attribute, all attributes together; attributes without values don't count."""
    return all_of(in_upper(F.col(name), values) for name, values in selected.items() if list(values))


def discovered_by_prefix(c: Column, name: str) -> Column:
    """FI6: the folded label contains the first four letters of the folded name."""
    return fold_label(c).contains(fold_text(name)[:4])


def not_blank(c: Column) -> Column:
    """FI10."""
    return c.isNotNull() & (c != "")


def is_active(c: Column) -> Column:
    """FI11."""
    return F.upper(F.trim(c)).startswith("ACTIVA")


def pick(selection: str, options: list) -> list:
    """FI13: options by 1-based numbers in a comma-separated text; other parts are ignored, order and repeats stay."""
    numbers = (part.strip() for part in selection.split(","))
    return [options[int(n) - 1] for n in numbers if n.isdigit() and 1 <= int(n) <= len(options)]


def validate_dates(start: str, end: str) -> tuple[date, date]:
    """FI15: ISO dates, the start before the (exclusive) end."""
    try:
        first, last = date.fromisoformat(start), date.fromisoformat(end)
    except ValueError:
        raise ValueError(f"invalid date in {start!r}, {end!r}; use YYYY-MM-DD") from None
    if first >= last:
        raise ValueError(f"the start {start} has to be before the end {end}, which is exclusive")
    return first, last


def validate_years(first: int, last: int) -> tuple[int, int]:
    """FI16."""
    if not 1900 <= first <= last <= 2100:
        raise ValueError(f"invalid years {first}, {last}")
    return first, last


def capabilities(dataset: Mapping) -> dict[str, bool]:
    """FI17: whether a registered dataset can be filtered by department and by date."""
    standard = dataset["tipo"] == "estandar"
    return {"department": standard or bool(dataset.get("dep_col")), "years": standard or bool(dataset.get("fecha_real"))}


def department_column(dataset: Mapping) -> str | None:
    """FI17, PR9: the column that holds the department."""
    return "departamento" if dataset["tipo"] == "estandar" else dataset.get("dep_col")


def present(df: DataFrame, *names: str) -> list[str]:
    """The columns among ``names`` that the table has, in the order given."""
    return [n for n in names if n in df.columns]
