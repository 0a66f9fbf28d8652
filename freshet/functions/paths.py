"""Names of folders and files (SF6, SF16, SF17, SK8) and of variables (SF11, SF13, FI12)."""

from __future__ import annotations

import unicodedata
from datetime import datetime

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .labels import strip_space

# Substrings of a variable's name, in the order in which they are tried, and the icon of each.
ICONS = [
    (("precipita",), "🌧️"),
    (("viento",), "💨"),
    (("mar",), "🌊"),
    (("presión", "presion"), "🧭"),
    (("humedad",), "💧"),
    (("temperatura",), "🌡️"),
    (("rio", "río"), "🏞️"),
    (("aire",), "🌫️"),
    (("agua",), "🚰"),
    (("zonifica",), "🗺️"),
    (("normales",), "📈"),
    (("gases", "invernadero"), "☁️"),
    (("escorrent",), "💦"),
    (("estaciones",), "📍"),
]
OTHER_ICON = "📊"


def safe_path(c: Column, fallback: str = "SIN_DATO") -> Column:
    """SF6: a segment that is safe on any file system; the fallback for null, blank or nothing left."""
    given = strip_space(F.coalesce(c.cast("string"), F.lit("")))
    text = F.when(given == "", F.lit(fallback)).otherwise(given)
    text = F.regexp_replace(F.regexp_replace(text, r'[<>:"/\\|?*]+', "_"), r"(?U)\s+", "_")
    return F.coalesce(F.nullif(F.btrim(text, F.lit("._ ")), F.lit("")), F.lit(fallback))


@F.pandas_udf(T.StringType())
def compatible_form(values: pd.Series) -> pd.Series:
    """NFKC of each value, which Spark lacks; use it before ``safe_path`` where labels hold compatibility forms."""
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


def export_base(variable: Column, department: Column, municipality: Column, stamp: str) -> Column:
    """SF16: ``variable_department_municipality_stamp``; the names in lower case."""
    return F.concat_ws("_", F.lower(safe_path(variable, "variable")), F.lower(department), F.lower(municipality), F.lit(stamp))


def export_name(c: Column) -> Column:
    """SF17: spaces to underscores, without parentheses, lower case."""
    return F.lower(F.translate(c, " ()", "_"))


def export_stamp(at: datetime) -> str:
    """SK8: hour, minute, day, month and year of a given moment."""
    return f"{at:%H%M_%d%m%y}"


def icon(c: Column) -> Column:
    """SF11: the icon of the first rule whose text the name contains."""
    name, rule = F.lower(c), None
    for texts, sign in ICONS:
        hit = F.lit(False)
        for text in texts:
            hit = hit | name.contains(text)
        rule = F.when(hit, sign) if rule is None else rule.when(hit, sign)
    return rule.otherwise(OTHER_ICON)


def title_case(c: Column) -> Column:
    """SF13: a capital after each white space."""
    return F.initcap(c)


def name_matches(c: Column, needle: str) -> Column:
    """FI12: substring search without regard to case."""
    return F.lower(c).contains(needle.lower())
