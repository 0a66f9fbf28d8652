"""A client of open-data portals that serve datasets as JSON pages filtered by a ``$where`` text (SC1, SC3, SC5, SC13)."""

from __future__ import annotations

import gzip
import json
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .scan import OBSERVATION, PagedSource, with_retry


def literal(text: str) -> str:
    """A text as the filter language quotes it."""
    return "'" + str(text).replace("'", "''") + "'"


def one_of(column: str, values: Iterable[str]) -> str:
    """The column, in capitals, is one of these texts."""
    return f"upper({column}) IN ({', '.join(literal(v.upper()) for v in values)})"


class PortalClient:
    """Pages of one dataset, in the order of the portal's row ids. A failed request raises, with its status in the message.

    Options: domain, dataset, and, if wanted, token, where, dateColumn and timeout (seconds).
    """

    def __init__(self, options: Mapping[str, str]) -> None:
        domain = options["domain"].rstrip("/")
        self.base = domain if domain.startswith("http") else f"https://{domain}"
        self.options = options

    def page(self, lo: str | None, hi: str | None, offset: int, limit: int) -> list[dict]:
        asked = {"$limit": limit, "$offset": offset, "$order": ":id"}
        conditions = [self.options["where"]] if self.options.get("where") else []
        column = self.options.get("dateColumn")
        if column and lo and hi:
            conditions.append(f"{column} >= {literal(lo + 'T00:00:00.000')} AND {column} < {literal(hi + 'T00:00:00.000')}")
        if conditions:
            asked["$where"] = " AND ".join(conditions)
        headers = {"Accept-Encoding": "gzip"} | ({"X-App-Token": self.options["token"]} if self.options.get("token") else {})
        request = urllib.request.Request(f"{self.base}/resource/{self.options['dataset']}.json?{urllib.parse.urlencode(asked)}", headers=headers)
        try:
            with urllib.request.urlopen(request, timeout=float(self.options.get("timeout", 300))) as answer:
                body = answer.read()
                return json.loads(gzip.decompress(body) if answer.headers.get("Content-Encoding") == "gzip" else body)
        except urllib.error.HTTPError as error:
            raise RuntimeError(f"the portal answers {error.code}: {error.reason}") from error


def make(options: Mapping[str, str]) -> PortalClient:
    # data source options come in small letters
    small = {k.lower(): v for k, v in options.items()}
    return PortalClient({k: small[k.lower()] for k in ("domain", "dataset", "token", "where", "dateColumn", "timeout") if k.lower() in small})


def portal_rows(spark: SparkSession, domain: str, dataset: str, where: str = "", date_column: str | None = None, start: str | None = None, end: str | None = None, **options: str) -> DataFrame:
    """A lazy scan of a portal's dataset, all columns text. With a date column and a window, each calendar block is a task."""
    spark.dataSource.register(PagedSource)
    given = {"client": f"{__name__}:make", "domain": domain, "dataset": dataset, "where": where, **{k: str(v) for k, v in options.items() if v}}
    if date_column and start and end:
        given |= {"dateColumn": date_column, "start": start, "end": end}
    schema = OBSERVATION
    if not date_column or date_column not in OBSERVATION.fieldNames():
        # other datasets have columns of their own; the first page tells them
        first = with_retry(lambda: make(given).page(None, None, 0, 1000), 5)
        names = list(dict.fromkeys(k for row in first for k in row)) or ["none"]
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.read.format("paged").schema(schema).options(**given).load()
