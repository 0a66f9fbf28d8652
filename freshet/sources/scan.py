"""Scans (SC1 to SC8, SC12, SC13, SE1, PR4, PR5)."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator, Sequence
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

OBSERVATION = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("codigoestacion", "codigosensor", "nombreestacion", "fechaobservacion", "valorobservado", "departamento", "municipio", "latitud", "longitud")]
)


def with_retry(call: Callable[[], object], attempts: int = 5, wait: Callable[[float], None] = time.sleep, limited: Callable[[Exception], bool] = lambda e: "429" in str(e)) -> object:
    """SC12: up to ``attempts`` calls; waits 1, 2, 4, ... s, or 5, 10, 15, ... s when rate limited; raises the last error."""
    for i in range(attempts):
        try:
            return call()
        except Exception as error:
            if i == attempts - 1:
                raise
            wait(5 * (i + 1) if limited(error) else 2**i)
    raise ValueError("at least one attempt is needed")


def pages(fetch: Callable[[int, int], Sequence | None], limit: int = 50_000) -> Iterator[Sequence]:
    """SC2, SO5: pages by offset until an empty or short one; a missing page raises."""
    offset = 0
    while True:
        page = fetch(offset, limit)
        if page is None:
            raise RuntimeError(f"page at offset {offset} is missing")
        if not page:
            return
        yield page
        if len(page) < limit:
            return
        offset += limit


class Block(InputPartition):
    """One ``[lo, hi)`` window of a paged source."""

    def __init__(self, lo: str | None, hi: str | None) -> None:
        self.lo, self.hi = lo, hi


class PagedReader(DataSourceReader):
    """SC3, SC5 to SC7, SC13: each block is one task, read page by page with retries; a failed page fails the query."""

    def __init__(self, schema: T.StructType, options: dict) -> None:
        self.schema, self.options = schema, options

    def partitions(self) -> list[InputPartition]:
        if "start" not in self.options:
            return [Block(None, None)]
        first, last = date.fromisoformat(self.options["start"]), date.fromisoformat(self.options["end"])
        blocks, lo, years = [], first, self.options.get("blocks", "month") == "year"
        while lo < last:
            hi = min(last, date(lo.year + 1, 1, 1) if years else date(lo.year + lo.month // 12, lo.month % 12 + 1, 1))
            blocks.append(Block(lo.isoformat(), hi.isoformat()))
            lo = hi
        return blocks

    def read(self, partition: Block) -> Iterator[tuple]:
        module, _, name = self.options["client"].rpartition(":")
        client = getattr(__import__(module, fromlist=[name]), name)(dict(self.options))
        limit, attempts = int(self.options.get("pageRows", 50_000)), int(self.options.get("attempts", 5))
        names = self.schema.fieldNames()

        def fetch(offset: int, rows: int) -> Sequence | None:
            return with_retry(lambda: client.page(partition.lo, partition.hi, offset, rows), attempts)

        for page in pages(fetch, limit):
            for record in page:
                yield tuple(None if record.get(n) is None else str(record.get(n)) for n in names)


class PagedSource(DataSource):
    """SC1: ``spark.read.format("paged")`` with a ``client`` option, ``module:factory``; it is made in the task, when first used.

    The factory takes the options and returns an object with ``page(lo, hi, offset, limit)``, a list of dicts. Options
    start and end divide the scan into calendar blocks, of a month or, with ``blocks`` as year, a year. All columns are text, as sources deliver them.
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> T.StructType:
        return OBSERVATION

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return PagedReader(schema, self.options)


def read_csv(spark: SparkSession, path: str | list[str], columns: Sequence[str]) -> DataFrame:
    """SC4: delimited text with a header; every column stays text, names are trimmed and in lower case."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return tidy_names(spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("enforceSchema", True).schema(schema).csv(path))


def read_records(spark: SparkSession, path: str | list[str], schema: T.StructType = OBSERVATION) -> DataFrame:
    """JSON records, one a line, all text."""
    return spark.read.schema(schema).json(path)


def from_records(spark: SparkSession, records: Iterable[dict] | DataFrame, schema: T.StructType = OBSERVATION) -> DataFrame:
    """SC8: a list of dicts, or a frame as it is."""
    if isinstance(records, DataFrame):
        return records
    return spark.createDataFrame([tuple(None if r.get(f) is None else str(r.get(f)) for f in schema.fieldNames()) for r in records], schema)


def tidy_names(df: DataFrame) -> DataFrame:
    """PR5."""
    return df.toDF(*[c.lstrip("\ufeff").strip().lower() for c in df.columns])


def without_system_id(df: DataFrame) -> DataFrame:
    """PR4."""
    return df.drop(":id")


def union_blocks(frames: Sequence[DataFrame]) -> DataFrame:
    """SE1: by name; a column that a block lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def with_territory(df: DataFrame) -> DataFrame:
    """PR7: departamento and municipio from ``nombre_del_*`` where they are missing."""
    for name in ("departamento", "municipio"):
        if name not in df.columns and f"nombre_del_{name}" in df.columns:
            df = df.withColumn(name, F.col(f"nombre_del_{name}"))
    return df
