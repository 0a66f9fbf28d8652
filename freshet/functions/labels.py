"""Folding of territorial labels (SF1) and the department vocabulary (FI4, FI5, FI14, SF10, JO3)."""

from __future__ import annotations

import difflib
import unicodedata
from collections.abc import Iterable, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Canonical departments and the spellings that sources use for them.
DEPARTMENTS: dict[str, list[str]] = {
    "ANTIOQUIA": ["ANTIOQUIA"],
    "VALLE DEL CAUCA": ["VALLE DEL CAUCA", "VALLE"],
    "SAN ANDRES Y PROVIDENCIA": [
        "SAN ANDRES",
        "SAN ANDRES Y PROVIDENCIA",
        "SAN ANDRÉS Y PROVIDENCIA",
        "SAN ANDRES PROVIDENCIA",
        "SAN ANDRÉS PROVIDENCIA",
        "ARCHIPIELAGO DE SAN ANDRES PROVIDENCIA Y SANTA CATALINA",
        "ARCHIPIÉLAGO DE SAN ANDRES PROVIDENCIA Y SANTA CATALINA",
        "ARCHIPIÉLAGO DE SAN ANDRÉS PROVIDENCIA Y SANTA CATALINA",
        "ARCHIPIELAGO DE SAN ANDRES, PROVIDENCIA Y SANTA CATALINA",
        "ARCHIPIÉLAGO DE SAN ANDRÉS, PROVIDENCIA Y SANTA CATALINA",
    ],
    "BOGOTA D.C.": ["BOGOTA", "BOGOTÁ", "BOGOTÁ D.C.", "BOGOTA, D.C"],
    "AMAZONAS": ["AMAZONAS"],
    "ARAUCA": ["ARAUCA"],
    "ATLANTICO": ["ATLANTICO", "ATLÁNTICO"],
    "BOLIVAR": ["BOLIVAR", "BOLÍVAR"],
    "BOYACA": ["BOYACA", "BOYACÁ"],
    "CALDAS": ["CALDAS"],
    "CAQUETA": ["CAQUETA", "CAQUETÁ"],
    "CASANARE": ["CASANARE"],
    "CAUCA": ["CAUCA"],
    "CESAR": ["CESAR"],
    "CHOCO": ["CHOCO", "CHOCÓ"],
    "CORDOBA": ["CORDOBA", "CÓRDOBA"],
    "CUNDINAMARCA": ["CUNDINAMARCA"],
    "GUAINIA": ["GUAINIA", "GUAINÍA"],
    "GUAVIARE": ["GUAVIARE"],
    "HUILA": ["HUILA"],
    "LA GUAJIRA": ["LA GUAJIRA", "GUAJIRA"],
    "MAGDALENA": ["MAGDALENA"],
    "META": ["META"],
    "NARIÑO": ["NARIÑO", "NARINO"],
    "NORTE DE SANTANDER": ["NORTE DE SANTANDER"],
    "PUTUMAYO": ["PUTUMAYO"],
    "QUINDIO": ["QUINDIO", "QUINDÍO"],
    "RISARALDA": ["RISARALDA"],
    "SANTANDER": ["SANTANDER"],
    "SUCRE": ["SUCRE"],
    "TOLIMA": ["TOLIMA"],
    "VAUPES": ["VAUPES", "VAUPÉS"],
    "VICHADA": ["VICHADA"],
}
# Accented capitals and the letters that remain without their marks.
ACCENTED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
PLAIN = "AAAAAACEEEEIIIINOOOOOUUUUY"


def strip_space(c: Column) -> Column:
    """Removes Unicode white space at both ends."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def fold_label(c: Column) -> Column:
    """SF1: trimmed, upper case, without accents; '' for null. Latin letters, inside generated code."""
    return F.translate(F.upper(strip_space(F.coalesce(c.cast("string"), F.lit("")))), ACCENTED, PLAIN)


def fold_text(value: object) -> str:
    """SF1 on the driver, for any script."""
    text = unicodedata.normalize("NFKD", "" if value is None else str(value).strip().upper())
    return "".join(ch for ch in text if not unicodedata.combining(ch))


@F.pandas_udf(T.StringType())
def fold_label_exact(values: pd.Series) -> pd.Series:
    """SF1 for any script; slower than ``fold_label``, which equals it on Latin text."""
    return values.map(fold_text)


def department_variants(department: str, mapping: Mapping[str, Iterable[str]] = DEPARTMENTS) -> list[str]:
    """FI4: configured spellings, the name itself and their folded forms, sorted."""
    spelled = {department, *mapping.get(department, ())}
    return sorted(v for v in spelled | {fold_text(v) for v in spelled} if v)


def department_table(spark: SparkSession, mapping: Mapping[str, Iterable[str]] = DEPARTMENTS) -> DataFrame:
    """canonical and variant_norm, one row for each folded spelling; as small as the mapping."""
    rows = {fold_text(v): canonical for canonical in mapping for v in department_variants(canonical, mapping)}
    return spark.createDataFrame(sorted((c, v) for v, c in rows.items()), "canonical string, variant_norm string")


def canonical_column(c: Column, mapping: Mapping[str, Iterable[str]] = DEPARTMENTS) -> Column:
    """JO3 as an expression: the canonical name of a spelling, or the value itself where there is none."""
    pairs = {fold_text(v): canonical for canonical in mapping for v in department_variants(canonical, mapping)}
    lookup = F.create_map(*[F.lit(x) for pair in sorted(pairs.items()) for x in pair])
    return F.coalesce(F.try_element_at(lookup, fold_label(c)), c)


def department_predicate(c: Column, departments: Iterable[str], mapping: Mapping[str, Iterable[str]] = DEPARTMENTS) -> Column:
    """FI5: the label, in upper case, is a spelling of one of these departments."""
    spelled = sorted({v.upper() for d in departments for v in department_variants(d, mapping)})
    return F.upper(c).isin(spelled)


def validate_departments(names: Iterable[str], mapping: Mapping[str, Iterable[str]] = DEPARTMENTS) -> list[str]:
    """FI14, SF10: canonical names in the order given, once each; an unknown name raises with the closest one."""
    known = {fold_text(v): canonical for canonical in mapping for v in department_variants(canonical, mapping)}
    found = []
    for name in names:
        folded = fold_text(name)
        if folded not in known:
            close = difflib.get_close_matches(folded, list(known), n=1, cutoff=0.6)
            raise ValueError(f"unknown department {name!r}" + (f"; did you mean {known[close[0]]!r}?" if close else "") + f"; known: {', '.join(sorted(mapping))}")
        found.append(known[folded])
    return list(dict.fromkeys(found))
