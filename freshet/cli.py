"""Command line: datasets, download and verify."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.labels import department_predicate, department_variants, validate_departments
from .operators.catalog import department_coverage, matched_totals
from .operators.predicates import date_window
from .plans.pipeline import Selection, deliver
from .session import session
from .sources.portal import one_of, portal_rows
from .sources.registry import STATION_CATALOG, Settings, datasets
from .sources.scan import read_csv, read_records
from .sources.sinks import as_json

VERSION = "0.2.0"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="freshet")
    top.add_argument("--version", action="version", version=f"freshet {VERSION}")
    sub = top.add_subparsers(dest="command", required=True)
    sub.add_parser("datasets", help="list the registered datasets")
    get = sub.add_parser("download", help="select, harmonise, deduplicate and export")
    get.add_argument("--dataset", required=True)
    get.add_argument("--source", help="Parquet, CSV or JSON path with the raw rows; by default they come from the portal")
    get.add_argument("--domain", help="the portal; by default FRESHET_DOMAIN")
    get.add_argument("--engine", choices=["pages", "blocks"], default="blocks", help="pages: one scan in pages; blocks: a task for each month")
    get.add_argument("--workers", type=int, help="tasks that ask the portal at once, at most")
    get.add_argument("--catalog", help="station catalog, for --attribute")
    get.add_argument("--attribute", action="append", default=[], help="column=value[,value...] of stations")
    get.add_argument("--station", action="append", default=[], help="station code")
    get.add_argument("--department", action="append", required=True)
    get.add_argument("--start-date", required=True)
    get.add_argument("--end-date", required=True, help="exclusive")
    get.add_argument("--csv", action="store_true")
    get.add_argument("--output-dir", default=None)
    check = sub.add_parser("verify", aliases=["verify-atlantico"], help="sample and catalog coverage of a department, as JSON")
    check.add_argument("--source", required=True)
    check.add_argument("--catalog", required=True)
    check.add_argument("--dataset-id", default="s54a-sgyg")
    check.add_argument("--catalog-dataset-id", default=STATION_CATALOG)
    check.add_argument("--department", default="ATLANTICO")
    check.add_argument("--date-column", default="fechaobservacion")
    check.add_argument("--start-date", default="2024-01-01")
    check.add_argument("--end-date", default="2024-02-01")
    check.add_argument("--limit", type=int, default=5)
    return top


def open_rows(spark, path: str) -> DataFrame:
    if path.rstrip("/").endswith(".csv"):
        with_header = spark.read.option("header", True).csv(path).columns
        return read_csv(spark, path, with_header)
    return read_records(spark, path) if path.rstrip("/").endswith((".json", ".jsonl")) else spark.read.parquet(path)


def from_portal(spark, selection: Selection, settings: Settings, args: argparse.Namespace) -> DataFrame:
    """SC3, SC5, SC7: the selection's rows from the portal. Departments, and dates where they are timestamps, are filtered there."""
    dataset = selection.dataset
    column = dataset["dep_col"] or ("departamento" if dataset["tipo"] == "estandar" else None)
    where = one_of(column, sorted({v for d in selection.departments for v in department_variants(d)})) if column else ""
    dated = dataset["tipo"] == "estandar" or dataset["fecha_real"]
    window = {"date_column": selection.date_column, "start": selection.start, "end": selection.end} if dated and args.engine == "blocks" else {}
    rows = portal_rows(spark, args.domain or settings.domain, dataset["id"], where, token=settings.token, pageRows=settings.page_rows, attempts=settings.attempts, timeout=settings.timeout_s, **window)
    return rows.coalesce(args.workers or settings.workers)


def verify_sample(rows: DataFrame, department: str, date_column: str, start: str, end: str, limit: int) -> DataFrame:
    """PR1, FI3, SO4: the first rows of a department inside the window, by a total order."""
    columns = [c for c in ("departamento", "municipio", "codigoestacion") if c in rows.columns]
    wanted = department_predicate(F.col("departamento"), validate_departments([department]))
    return rows.select(*columns, date_column).filter(wanted & date_window(F.col(date_column), start, end)).orderBy(date_column, *columns).limit(limit)


def verify(spark, args: argparse.Namespace) -> str:
    department = validate_departments([args.department])[0]
    coverage = department_coverage(open_rows(spark, args.catalog), department)
    document = {"dataset_id": args.dataset_id, "department": department, "variants": department_variants(department), "ok": True}
    sample = verify_sample(open_rows(spark, args.source), department, args.date_column, args.start_date, args.end_date, args.limit)
    return as_json(document, {"sample_rows": sample, "catalog_coverage": coverage, "catalog_totals": matched_totals(coverage)})


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        if args.command == "datasets":
            for row in datasets():
                size = f"~{row['mil_filas']:,} mil filas" if row["mil_filas"] else ""
                print(f"{row['id']}  {row['tipo']:9} {row['nombre']}  {size}".rstrip())
            return 0
        if args.command.startswith("verify"):
            try:
                print(verify(session(), args))
            except Exception as error:  # a verification that can't read its sample has failed
                print(as_json({"ok": False, "error": str(error).splitlines()[0]}, {}))
                return 1
            return 0
        attributes = {k: v.split(",") for k, _, v in (a.partition("=") for a in args.attribute)}
        selection = Selection(args.dataset, args.department, args.start_date, args.end_date, attributes=attributes, codes=args.station)
        settings = Settings.from_environment()
        if not args.source and not (args.domain or settings.domain):
            raise ValueError("name a --source, or the portal by --domain or FRESHET_DOMAIN")
        spark = session()
        rows = open_rows(spark, args.source) if args.source else from_portal(spark, selection, settings, args)
        catalog = open_rows(spark, args.catalog) if args.catalog else None
        print(as_json(deliver(rows, selection, args.output_dir or settings.output_dir, args.csv, max_rows=settings.sheet_rows, catalog=catalog), {}))
        return 0
    except ValueError as error:
        print(error, file=sys.stderr)
        return 2
    except KeyboardInterrupt:
        return 130


if __name__ == "__main__":
    sys.exit(main())
