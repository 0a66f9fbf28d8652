"""Selection to delivery (section 3.1): one lazy plan, then exports and a report."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import with_row_key
from ..functions.labels import DEPARTMENTS, canonical_column, department_predicate, validate_departments
from ..functions.paths import export_stamp, safe_path
from ..functions.values import to_export_timestamp, to_number
from ..operators.catalog import in_pool, pool_union
from ..operators.dedup import deduplicate
from ..operators.predicates import all_of, attribute_filter, date_window, validate_dates
from ..sources import registry
from ..sources.scan import tidy_names, with_territory, without_system_id
from ..sources.sinks import export_csv, export_parquet, manifest, write_report

#: The date column of observations, and what stands for it in a dataset that has none.
DATE = "fechaobservacion"
NUMBERS = ("valorobservado", "latitud", "longitud")


def normalise(raw: DataFrame, dataset_id: str, date_column: str | None, mapping: Mapping[str, Iterable[str]] = DEPARTMENTS) -> DataFrame:
    """Raw text to typed rows with a key: territory first, so that aliased names are harmonised as well (T17)."""
    date_column = date_column or DATE
    df = with_territory(without_system_id(tidy_names(raw)))
    kinds = dict(df.dtypes)
    if "departamento" in df.columns:
        df = df.withColumn("departamento", canonical_column(F.col("departamento"), mapping))
    for name in NUMBERS:
        if kinds.get(name) == "string":
            df = df.withColumn(name, to_number(F.col(name)))
    if kinds.get(date_column) == "string":
        df = df.withColumn(date_column, to_export_timestamp(F.col(date_column)))
    return with_row_key(df.withColumn("source_dataset_id", F.lit(dataset_id)), dataset_id, date_column)


@dataclass
class Selection:
    """What to deliver; names and dates are checked before anything is read.

    ``attributes`` (column to values) choose stations from a catalog, ``codes`` name more of them; with either, only
    observations of these stations are kept, and of none where no station matches.
    """

    dataset_id: str
    departments: list[str]
    start: str
    end: str
    mapping: Mapping[str, Iterable[str]] = field(default_factory=lambda: DEPARTMENTS)
    attributes: Mapping[str, Iterable[str]] = field(default_factory=dict)
    codes: list[str] = field(default_factory=list)

    @property
    def date_column(self) -> str:
        return self.dataset["fecha_col"] or DATE

    def __post_init__(self) -> None:
        self.dataset = registry.dataset(self.dataset_id)
        self.departments = validate_departments(self.departments, self.mapping)
        validate_dates(self.start, self.end)

    def pool(self, spark: SparkSession, catalog: DataFrame | None) -> DataFrame | None:
        """The chosen stations' codes; None where none was asked for."""
        if not self.attributes and not self.codes:
            return None
        typed = spark.createDataFrame([(c,) for c in self.codes], "codigo string")
        if not self.attributes:
            return typed
        if catalog is None:
            raise ValueError("attributes need a station catalog")
        return pool_union(catalog.filter(attribute_filter(self.attributes)), typed)

    def filtered(self, raw: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
        """Normalised rows of the departments, stations and window. A special dataset whose date column isn't a timestamp,
        or that has none, is not cut by dates; one without departments is delivered whole."""
        df = normalise(raw, self.dataset_id, self.date_column, self.mapping)
        wanted = [department_predicate(F.col("departamento"), self.departments, self.mapping)] if "departamento" in df.columns else []
        dated = self.dataset["tipo"] == "estandar" or self.dataset["fecha_real"]
        window = [date_window(F.col(self.date_column), self.start, self.end)] if dated and self.date_column in df.columns else []
        pool = self.pool(raw.sparkSession, catalog) if "codigoestacion" in df.columns else None
        kept = df.filter(all_of([*wanted, *window]))
        return kept if pool is None else in_pool(kept, pool)

    def plan(self, raw: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
        """Filtered, normalised and deduplicated rows."""
        return deduplicate(self.filtered(raw, catalog), self.date_column)


def deliver(raw: DataFrame, selection: Selection, output: str, csv: bool = False, at: datetime | None = None, max_rows: int = 1_048_576, catalog: DataFrame | None = None) -> dict:
    """Runs the plan once into Parquet, then CSV, manifest and report from what was written; returns the counts.

    Rows are counted before and after deduplication while they are written, so the raw rows are read once.
    """
    spark, stamp, began = raw.sparkSession, export_stamp(at or datetime.now()), datetime.now()
    date_column, variable = selection.date_column, selection.dataset["nombre"]
    before, after, path = Observation("before"), Observation("after"), f"{output}/{stamp}"
    one = F.count(F.lit(1)).alias("rows")
    rows = deduplicate(selection.filtered(raw, catalog).observe(before, one), date_column)
    export_parquet(rows.observe(after, one), f"{path}/parquet")
    total, kept = before.get["rows"], after.get["rows"]
    if not kept:
        return {"rows": 0, "raw_rows": 0, "duplicates": 0, "files_parquet": 0, "files_csv": 0, "seconds": 0.0}
    written = spark.read.parquet(f"{path}/parquet").drop("dep_part", "mun_part")
    files = manifest(written, variable, stamp, max_rows)
    files.write.mode("overwrite").json(f"{path}/manifest")
    if csv:
        export_csv(written, f"{path}/csv", [c for c in ("codigoestacion", "codigosensor", date_column, "floating_id") if c in written.columns], max_rows)
    info = {"Dataset": selection.dataset_id, "Departamentos": ", ".join(selection.departments), "Rango": f"{selection.start} a {selection.end}"}
    name = spark.range(1).select(F.lower(safe_path(F.lit(variable), "variable"))).first()[0]
    if "codigoestacion" in written.columns and dict(written.dtypes).get(date_column, "").startswith("timestamp"):
        write_report(written, f"{path}/RESUMEN_{name}_{stamp}.txt", variable, date_column, info, total - kept)
    counts = files.agg(F.count("*").alias("p"), F.sum("csv_parts").alias("c")).first()
    return {"rows": kept, "raw_rows": total, "duplicates": total - kept, "files_parquet": counts["p"], "files_csv": int(counts["c"]) if csv else 0, "seconds": (datetime.now() - began).total_seconds()}
