"""Station catalog operators (JO1, JO2, JO4, AG1 to AG5, SE2, PR2, PR8)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import DEPARTMENTS, department_variants, fold_label, fold_text
from ..functions.values import code_aliases
from .predicates import discovered_by_prefix, is_active, not_blank

# Observation columns and the catalog's names for them.
CATALOG_NAMES = {"zonahidrografica": "zona_hidrografica", "codigoestacion": "codigo"}
# Station attributes that can be chosen, and their observation columns.
ATTRIBUTES = {
    "Zona Hidrográfica": "zonahidrografica",
    "Categoría": "categoria",
    "Tecnología": "tecnologia",
    "Estado": "estado",
    "Corriente": "corriente",
    "Entidad": "entidad",
    "Municipio": "municipio",
}


def as_observation_names(catalog: DataFrame) -> DataFrame:
    """PR8: the catalog with observation column names."""
    back = {v: k for k, v in CATALOG_NAMES.items()}
    return catalog.withColumnsRenamed({c: back[c] for c in catalog.columns if c in back})


def values_of(catalog: DataFrame, attribute: str) -> DataFrame:
    """AG3, FI10: the different non-empty values of an attribute, in order."""
    return catalog.select(F.col(attribute).cast("string").alias("value")).filter(not_blank(F.col("value"))).distinct().orderBy("value")


def in_pool(observations: DataFrame, pool: DataFrame, station: str = "codigoestacion", code: str = "codigo") -> DataFrame:
    """JO1, JO2: observations of stations in the pool; an eight-character code also stands for ``00`` and itself.

    An empty pool keeps nothing. The codes are expanded on the pool's side, so this is an equi-join; Spark broadcasts
    the pool where its size allows.
    """
    codes = pool.select(F.explode(code_aliases(F.col(code))).alias("_code")).distinct()
    return observations.join(codes, observations[station] == codes["_code"], "left_semi")


def pool_union(pool: DataFrame, typed: DataFrame, code: str = "codigo") -> DataFrame:
    """SE2: chosen by attribute or typed by hand."""
    return pool.select(F.col(code).alias("codigo")).union(typed.select(F.col(code).alias("codigo"))).distinct()


def probe(catalog: DataFrame, state: str = "estado") -> DataFrame:
    """AG2, FI11: stations in all and active ones."""
    return catalog.agg(F.count("*").alias("stations"), F.count_if(F.coalesce(is_active(F.col(state)), F.lit(False))).alias("active"))


def date_range(observations: DataFrame, date_column: str) -> DataFrame:
    """AG4, SO3: first and last date in one pass; null where there is none."""
    return observations.agg(F.min(date_column).cast("date").alias("first_day"), F.max(date_column).cast("date").alias("last_day"))


def discover(catalog: DataFrame, department: str, column: str = "departamento") -> DataFrame:
    """AG1, FI6: labels that share the department's first four letters, with their counts."""
    return catalog.filter(discovered_by_prefix(F.col(column), department)).groupBy(F.col(column).alias("label")).agg(F.count("*").alias("total")).orderBy("label")


def department_coverage(catalog: DataFrame, department: str, column: str = "departamento", mapping: dict[str, Iterable[str]] = DEPARTMENTS) -> DataFrame:
    """JO4, SE4, AG5: discovered labels, folded, with their counts and whether they are configured."""
    configured = [fold_text(v) for v in department_variants(department, mapping)]
    found = discover(catalog, department, column)
    return found.select("label", fold_label(F.col("label")).alias("normalized"), "total").withColumn("matched", F.col("normalized").isin(configured))


def matched_totals(coverage: DataFrame) -> DataFrame:
    """AG5: matched_rows, unmatched_rows."""
    part = lambda c: F.coalesce(F.sum(F.when(c, F.col("total"))), F.lit(0))
    return coverage.agg(part(F.col("matched")).alias("matched_rows"), part(~F.col("matched")).alias("unmatched_rows"))


def station_names(catalog: DataFrame, condition: Column) -> DataFrame:
    """PR2: codes and names of chosen stations, by name."""
    return catalog.filter(condition).select("codigo", "nombre").orderBy("nombre", "codigo")
