"""Sinks: exports by territory, split CSV, reports and manifests (SK1 to SK8)."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import export_base, safe_path
from ..functions.values import sheet_second
from ..operators.coverage import first_by, station_coverage, totals

BYTE_ORDER_MARK = "\ufeff"
NO_DEPARTMENT, NO_MUNICIPALITY = "SIN_DEPARTAMENTO", "SIN_MUNICIPIO"


def write_atomically(spark, path: str, content: str | Callable[[Callable[[bytes], None]], None]) -> str:
    """SK1, UD3: a file that appears under its name only when it is whole, on any file system that Spark knows.

    ``content`` is a text, or a function that gets a function to write bytes with. What lay there before stays until the
    draft is whole, and is replaced in one step; if anything fails it stays, and the draft goes.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    draft = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex}.draft")
    system = target.getFileSystem(conf)
    try:
        with_stream = system.create(draft, True)
        try:
            if callable(content):
                content(lambda part: with_stream.write(bytearray(part)))
            else:
                with_stream.write(bytearray(content.encode()))
        finally:
            with_stream.close()
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        how = spark.sparkContext._gateway.new_array(kind, 1)
        how[0] = kind.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), conf).rename(system.makeQualified(draft), system.makeQualified(target), how)
    finally:
        system.delete(draft, False)
    return path


def with_territory_parts(df: DataFrame) -> DataFrame:
    """Adds dep_part and mun_part: safe segments, so that names which differ only in unsafe characters share a folder."""
    part = lambda c, other: safe_path(F.col(c), other) if c in df.columns else F.lit(other)
    return df.withColumn("dep_part", part("departamento", NO_DEPARTMENT)).withColumn("mun_part", part("municipio", NO_MUNICIPALITY))


def export_parquet(df: DataFrame, path: str) -> None:
    """SK2: Parquet under ``dep_part=.../mun_part=...``; Spark's committer makes it all or nothing.

    Rows are rebalanced on the territory, so a department with very many rows is written by several tasks.
    """
    with_territory_parts(df).hint("rebalance", "dep_part", "mun_part").write.mode("overwrite").partitionBy("dep_part", "mun_part").parquet(path)


def export_csv(df: DataFrame, path: str, order: list[str], max_rows: int = 1_048_576, mark: bool = True) -> None:
    """SK3, SK4: CSV in numbered parts that hold ``max_rows`` with their header; quotes doubled, dates without T.

    The part number is a partition column, so each part is one file. With ``mark`` each begins with a byte-order mark, by
    which spreadsheets know UTF-8: it is put before the first name of the header.
    """
    from ..operators.dedup import part_number

    dated = df.select(*[sheet_second(F.col(c)).alias(c) if t.startswith("timestamp") else F.col(c) for c, t in df.dtypes])
    parts = part_number(with_territory_parts(dated), ["dep_part", "mun_part"], [F.col(c) for c in order], max_rows)
    first = df.columns[0]
    parts = parts.withColumnRenamed(first, BYTE_ORDER_MARK + first) if mark else parts
    parts.repartition("dep_part", "mun_part", "part").write.mode("overwrite").partitionBy("dep_part", "mun_part", "part").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def spreadsheet_bytes(content: bytes) -> bytes:
    """SK4: the same CSV text after a byte-order mark."""
    mark = b"\xef\xbb\xbf"
    return content if content.startswith(mark) else mark + content


def manifest(df: DataFrame, variable: str, stamp: str, max_rows: int = 1_048_576) -> DataFrame:
    """SK7, AG12: rows, base name and number of CSV parts of each territory."""
    groups = with_territory_parts(df).groupBy("dep_part", "mun_part").agg(F.count("*").alias("n_rows"))
    return groups.withColumn("base_name", export_base(F.lit(variable), F.col("dep_part"), F.col("mun_part"), stamp)).withColumn("csv_parts", F.ceil(F.col("n_rows") / max(1, max_rows - 1)))


def coverage_lines(df: DataFrame, variable: str, date_column: str, info: Mapping[str, str] | None = None, duplicates: int = 0) -> DataFrame:
    """SK5 as rows: ``line_no`` and ``line``; stations in order of their code, a null code last."""
    spark, head = df.sparkSession, [f"RESUMEN DE DESCARGA · {variable}", *[f"{k}: {v}" for k, v in (info or {}).items()]]
    top = spark.createDataFrame([(i, line) for i, line in enumerate(head)], "at long, line string").select(F.lit(0).alias("section"), F.lit(None).cast("string").alias("code"), "at", "line")
    total = totals(df, date_column)
    removed = f"  ({duplicates:,} duplicados depurados)" if duplicates else ""
    rows = total.select(F.lit(1), F.lit(None).cast("string"), F.lit(0).cast("long"), F.concat(F.lit("Filas únicas: "), F.format_number("n_rows", 0), F.lit(removed)))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    span = total.filter("first_obs is not null").select(F.lit(2), F.lit(None).cast("string"), F.lit(0).cast("long"), F.concat(F.lit("Rango real de los datos: "), day("first_obs"), F.lit(" a "), day("last_obs")))
    ties = [c for c in ("codigosensor", date_column, "valorobservado") if c in df.columns]
    label = lambda c, name, n: (first_by(c, *ties) if c in df.columns else F.lit("")).alias(name)
    by = station_coverage(df, "codigoestacion", date_column, [label("nombreestacion", "name", 30), label("municipio", "town", 18)])
    pad = lambda c, n: F.rpad(F.substring(F.coalesce(c, F.lit("")), 1, n), n, " ")
    dated = F.concat(day("first_obs"), F.lit(" → "), day("last_obs"), F.lit(" | "), F.format_string("%5.1f%% de meses con dato", "completeness"))
    line = F.concat_ws(" | ", F.coalesce("station", F.lit("nan")), pad(F.col("name"), 30), pad(F.col("town"), 18), F.concat(F.lpad(F.format_number("n_rows", 0), 10, " "), F.lit(" filas")), F.when(F.col("first_obs").isNull(), F.lit("sin fechas")).otherwise(dated))
    stations = by.select(F.lit(3), F.col("station"), F.lit(0).cast("long"), line)
    return top.union(rows).union(span).union(stations).orderBy("section", F.col("code").asc_nulls_last(), "at")


def write_report(df: DataFrame, path: str, variable: str, date_column: str, info: Mapping[str, str] | None = None, duplicates: int = 0) -> str:
    """SK5: the report as a text file. One line for each station leaves the executors, in order, page by page."""
    lines = [r["line"] for r in coverage_lines(df, variable, date_column, info, duplicates).toLocalIterator()]
    return write_atomically(df.sparkSession, path, "\n".join(lines) + "\n")


def as_json(document: Mapping, rows: Mapping[str, DataFrame], convert: Callable[[object], object] = str) -> str:
    """SK6: a result document; small frames become lists of records."""
    return json.dumps({**document, **{k: [r.asDict() for r in df.collect()] for k, df in rows.items()}}, ensure_ascii=False, indent=2, default=convert)
