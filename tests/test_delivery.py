import json
import subprocess
import sys
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from freshet import cli
from freshet.plans.pipeline import Selection, deliver, normalise
from freshet.sources import registry, scan, sinks
from freshet.streaming import ingest

RAW = [
    {"codigoestacion": "0021", "codigosensor": "s", "nombreestacion": "Uno", "fechaobservacion": "2024-01-02T10:00:00.000", "valorobservado": "5.0", "departamento": "atlántico", "municipio": "X/Y"},
    {"codigoestacion": "0021", "codigosensor": "s", "nombreestacion": "Uno", "fechaobservacion": "01/02/2024 10:00:00 AM", "valorobservado": "8.0", "departamento": "ATLANTICO", "municipio": "X/Y"},
    {"codigoestacion": "0021", "codigosensor": "s", "nombreestacion": "Uno", "fechaobservacion": "2024-02-01T00:00:00.000", "valorobservado": "1.0", "departamento": "ATLANTICO", "municipio": "X/Y"},
    {"codigoestacion": "0033", "codigosensor": "s", "nombreestacion": "Dos", "fechaobservacion": "2024-01-03T00:00:00.000", "valorobservado": "nan", "departamento": "ATLÁNTICO", "municipio": None},
    {"codigoestacion": "0044", "codigosensor": "s", "nombreestacion": "Tres", "fechaobservacion": "2024-01-03T00:00:00.000", "valorobservado": "2", "departamento": "CESAR", "municipio": "Z"},
]


@pytest.fixture
def raw(spark):
    return scan.from_records(spark, RAW)


def test_normalise(raw):
    row = normalise(raw, "s54a-sgyg", "fechaobservacion").filter("codigoestacion = '0033'").first()
    assert row.departamento == "ATLANTICO" and row.valorobservado is None and row.fechaobservacion == datetime(2024, 1, 3)
    assert len(row.floating_id) == 64 and row.source_dataset_id == "s54a-sgyg"


def test_territory_aliases_are_harmonised(spark):
    rows = spark.createDataFrame([("valle", "t")], "nombre_del_departamento string, x string")
    assert normalise(rows, "d", "none").first().departamento == "VALLE DEL CAUCA"


def test_deliver(spark, raw, tmp_path):
    got = deliver(raw, Selection("s54a-sgyg", ["Atlántico"], "2024-01-01", "2024-02-01"), str(tmp_path), csv=True, at=datetime(2024, 3, 1, 9, 5), max_rows=2)
    assert (got["rows"], got["duplicates"], got["files_parquet"], got["files_csv"]) == (2, 1, 2, 2)
    folder = tmp_path / "0905_010324"
    report = next(folder.glob("RESUMEN_*.txt")).read_text()
    assert "Filas únicas: 2  (1 duplicados depurados)" in report and "2024-01-02 a 2024-01-03" in report and "100.0% de meses" in report
    kept = spark.read.parquet(str(folder / "parquet"))
    assert {r.dep_part for r in kept.collect()} == {"ATLANTICO"} and {r.mun_part for r in kept.collect()} == {"X_Y", "SIN_MUNICIPIO"}
    text = next((folder / "csv").rglob("*.csv")).read_text()
    assert "2024-01-0" in text and "T1" not in text.splitlines()[1].split(",")[3]
    assert not list(tmp_path.rglob("*.draft"))


def test_empty_selection(spark, raw, tmp_path):
    got = deliver(raw, Selection("s54a-sgyg", ["CESAR"], "2020-01-01", "2020-02-01"), str(tmp_path))
    assert got["rows"] == 0 and got["files_parquet"] == 0


def test_selection_is_checked_before_reading():
    for bad in (("nope", ["CESAR"], "2020-01-01", "2020-02-01"), ("s54a-sgyg", ["zzz"], "2020-01-01", "2020-02-01"), ("s54a-sgyg", ["CESAR"], "2020-02-01", "2020-01-01")):
        with pytest.raises(ValueError):
            Selection(*bad)


def test_csv_parts_hold_the_limit(spark, tmp_path):
    rows = spark.range(5).select(F.lit("D").alias("departamento"), F.lit("M").alias("municipio"), F.col("id").alias("v"))
    sinks.export_csv(rows, str(tmp_path / "c"), ["v"], 3)
    files = sorted((tmp_path / "c").rglob("*.csv"))
    assert len(files) == 3 and all(len(f.read_text().splitlines()) <= 3 for f in files)
    assert sinks.spreadsheet_bytes(b"a") == b"\xef\xbb\xbfa" == sinks.spreadsheet_bytes(sinks.spreadsheet_bytes(b"a"))


def test_atomic_text(spark, tmp_path):
    target = str(tmp_path / "r.txt")
    sinks.write_atomically(spark, target, "one")
    sinks.write_atomically(spark, target, "two ñ")
    assert (tmp_path / "r.txt").read_text() == "two ñ" and [p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")] == ["r.txt"]
    (tmp_path / "file").write_text("x")
    with pytest.raises(Exception, match="."):
        sinks.write_atomically(spark, str(tmp_path / "file" / "under.txt"), "x")


def test_retry():
    waits, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("429" if len(calls) == 2 else "down")
        return "ok"

    assert scan.with_retry(flaky, wait=waits.append) == "ok" and waits == [1, 10]
    with pytest.raises(OSError):
        scan.with_retry(lambda: (_ for _ in ()).throw(OSError("x")), attempts=2, wait=waits.append)


def test_pages():
    data = list(range(7))
    assert [len(p) for p in scan.pages(lambda o, n: data[o : o + n], 3)] == [3, 3, 1]
    with pytest.raises(RuntimeError):
        list(scan.pages(lambda o, n: None, 3))


def test_paged_source(spark, tmp_path, monkeypatch):
    spark.dataSource.register(scan.PagedSource)
    got = spark.read.format("paged").option("client", "tests.paged_client:make").option("start", "2024-01-15").option("end", "2024-03-02").option("pageRows", "2").load()
    assert got.rdd.getNumPartitions() == 3
    assert got.groupBy("fechaobservacion").count().count() == 3 and got.count() == 9


def test_csv_source_and_union(spark, tmp_path):
    (tmp_path / "a.csv").write_text(' Codigo ,B\n"001","x ""q"""\n')
    got = scan.read_csv(spark, str(tmp_path / "a.csv"), [" Codigo ", "B"])
    assert got.columns == ["codigo", "b"] and tuple(got.first()) == ("001", 'x "q"')
    both = scan.union_blocks([got, got.drop("b")])
    assert both.filter("b is null").count() == 1
    assert scan.without_system_id(got.withColumn(":id", F.lit(1))).columns == ["codigo", "b"]


def test_registry():
    assert len(registry.datasets()) == 21 and registry.dataset("5kjg-nuda")["fecha_col"] is None
    with pytest.raises(ValueError, match="s54a-sgyg"):
        registry.dataset("x")


def test_cli(spark, raw, tmp_path, capsys):
    assert cli.main(["datasets"]) == 0 and "s54a-sgyg" in capsys.readouterr().out
    assert cli.main(["download", "--dataset", "x", "--source", "s", "--department", "CESAR", "--start-date", "2024-01-01", "--end-date", "2024-02-01"]) == 2
    raw.withColumn("fechaobservacion", F.col("fechaobservacion").try_cast("timestamp_ntz")).write.parquet(str(tmp_path / "obs"))
    raw.select("departamento").write.parquet(str(tmp_path / "cat"))
    capsys.readouterr()
    assert cli.main(["verify", "--source", str(tmp_path / "obs"), "--catalog", str(tmp_path / "cat")]) == 0
    said = json.loads(capsys.readouterr().out)
    assert said["ok"] and len(said["sample_rows"]) == 2 and said["catalog_totals"][0]["matched_rows"] == 4
    assert cli.main(["verify", "--source", str(tmp_path / "none"), "--catalog", str(tmp_path / "cat")]) == 1


def test_module_runs():
    done = subprocess.run([sys.executable, "-m", "freshet.cli", "datasets"], capture_output=True, text=True, timeout=60)
    assert done.returncode == 0 and done.stdout.count("\n") == 21


def test_ingest_is_idempotent(spark, raw, tmp_path):
    store = str(tmp_path / "store")
    first = ingest.upsert_batch(raw, store, "s54a-sgyg", "fechaobservacion")
    assert first == 4 and ingest.upsert_batch(raw, store, "s54a-sgyg", "fechaobservacion") == 0
    assert spark.read.parquet(store).count() == 4


def test_streams(spark, raw, tmp_path):
    raw.write.json(str(tmp_path / "in"))
    stream = ingest.ingest(spark, str(tmp_path / "in"), raw.schema, str(tmp_path / "store"), str(tmp_path / "ckpt"), "s54a-sgyg")
    stream.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "store")).count() == 4
    daily = ingest.late_monthly_counts(normalise(raw, "d", "fechaobservacion"), "fechaobservacion", "codigoestacion")
    assert daily.agg(F.sum("n")).first()[0] == 5


def test_metrics(spark):
    from freshet.plans import metrics

    seen = []
    assert metrics.with_progress(spark.range(1000), lambda df: df.count(), lambda done, total: seen.append((done, total))) == 1000
    assert seen[-1][0] == seen[-1][1] > 0 and metrics.plan_mib(spark.range(10)) > 0
    with pytest.raises(ZeroDivisionError):
        metrics.with_progress(spark.range(1), lambda df: 1 // 0, lambda *a: None)


def test_deliver_every_dataset(spark, tmp_path):
    """SC7, T19: special datasets have other date columns, text years, or no date or department at all."""
    for row in registry.datasets():
        columns = {"codigoestacion": "1", "valorobservado": "2.5", "municipio": "M"} if row["tipo"] == "estandar" else {"valor": "3"}
        if row["tipo"] == "estandar" or row["dep_col"]:
            columns[row["dep_col"] or "departamento"] = "cesar"
        if row["fecha_col"]:
            columns[row["fecha_col"]] = "2024-01-05T00:00:00.000" if row["tipo"] == "estandar" or row["fecha_real"] else "2011"
        raw = spark.createDataFrame([tuple(columns.values())] * 2 + [tuple("x" if k.endswith("departamento") else v for k, v in columns.items())], ", ".join(f"{c} string" for c in columns))
        got = deliver(raw, Selection(row["id"], ["CESAR"], "2024-01-01", "2024-02-01"), str(tmp_path / row["id"]), at=datetime(2024, 3, 1, 9, 5))
        kept = 2 if row["tipo"] == "estandar" or row["dep_col"] else 3
        once = 1 if "codigoestacion" in columns else kept
        assert (got["rows"], got["raw_rows"], got["duplicates"]) == (once, kept, kept - once), row


def test_stations_of_a_selection(spark, raw):
    catalog = spark.createDataFrame([("0021", "Activa"), ("0033", "Suspendida")], "codigo string, estado string")
    pick = lambda **how: {r.codigoestacion for r in Selection("s54a-sgyg", ["ATLANTICO"], "2024-01-01", "2024-02-01", **how).plan(raw, catalog).collect()}
    assert pick() == {"0021", "0033"} and pick(codes=["0033"]) == {"0033"} and pick(attributes={"estado": ["ACTIVA"]}) == {"0021"}
    assert pick(attributes={"estado": ["none"]}) == set() and pick(attributes={"estado": ["none"]}, codes=["0021"]) == {"0021"}


def test_a_failed_write_keeps_what_was_there(spark, tmp_path):
    path = str(tmp_path / "a" / "r.txt")
    sinks.write_atomically(spark, path, "first")

    def broken(write):
        write(b"half")
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        sinks.write_atomically(spark, path, broken)
    assert open(path).read() == "first" and [p.name for p in (tmp_path / "a").iterdir() if not p.name.endswith(".crc")] == ["r.txt"]
    sinks.write_atomically(spark, path, lambda write: write("sécond".encode()))
    assert open(path, encoding="utf-8").read() == "sécond"


def test_ingest_of_rows_without_a_date_and_of_greater_values(spark, tmp_path):
    store = str(tmp_path / "store")
    row = lambda value, day: spark.createDataFrame([("1", "s", day, value)], "codigoestacion string, codigosensor string, fechaobservacion string, valorobservado string")
    day = "2024-01-02T10:00:00.000"
    put = lambda df: ingest.upsert_batch(df, store, "s54a-sgyg", "fechaobservacion")
    assert [put(row("1", None)), put(row("1", None)), put(row("1", day)), put(row("9", day)), put(row("4", day)), put(row("9", day))] == [1, 0, 1, 1, 0, 0]
    assert sorted(r.valorobservado for r in ingest.read_store(spark, store).collect()) == [1.0, 9.0]


def test_portal_pages(spark, tmp_path, monkeypatch, capsys):
    import gzip
    import threading
    import urllib.parse
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    from freshet.sources import portal

    asked, failures = [], [429]
    rows = [{"codigoestacion": f"{i}", "fechaobservacion": f"2024-0{m}-03T00:00:00.000", "valorobservado": str(i), "departamento": "CESAR"} for m in (1, 2) for i in range(5)]

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            if failures:
                self.send_error(failures.pop())
                return
            query = dict(urllib.parse.parse_qsl(urllib.parse.urlsplit(self.path).query))
            asked.append((query, self.headers.get("X-App-Token")))
            own = [r for r in rows if "$where" not in query or "fechaobservacion" not in query["$where"] or f"'{r['fechaobservacion'][:7]}" in query["$where"].split("AND")[-2]]
            page = own[int(query["$offset"]) :][: int(query["$limit"])]
            body = gzip.compress(json.dumps(page).encode())
            self.send_response(200)
            self.send_header("Content-Encoding", "gzip")
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        domain = f"http://127.0.0.1:{server.server_port}"
        monkeypatch.setattr(scan.time, "sleep", lambda s: None)
        client = portal.make({"domain": domain, "dataset": "d", "WHERE": "a = 1", "token": "t"})
        with pytest.raises(RuntimeError, match="429"):
            client.page(None, None, 0, 2)
        assert len(client.page(None, None, 8, 5)) == 2 and asked[-1] == ({"$limit": "5", "$offset": "8", "$order": ":id", "$where": "a = 1"}, "t")
        got = portal.portal_rows(spark, domain, "s54a-sgyg", portal.one_of("departamento", ["O'X", "cesar"]), "fechaobservacion", "2024-01-01", "2024-03-01", pageRows=2)
        assert got.count() == 10 and any("'O''X', 'CESAR'" in q["$where"] for q, _ in asked)
        assert portal.portal_rows(spark, domain, "62gv-3857").columns == list(rows[0])
        monkeypatch.setenv("FRESHET_DOMAIN", domain)
        code = cli.main(["download", "--dataset", "s54a-sgyg", "--department", "cesar", "--start-date", "2024-01-01", "--end-date", "2024-03-01", "--station", "3", "--csv", "--output-dir", str(tmp_path)])
        assert code == 0 and json.loads(capsys.readouterr().out)["rows"] == 2
        assert next(tmp_path.rglob("*.csv")).read_bytes().startswith(b"\xef\xbb\xbf")
    finally:
        server.shutdown()
    monkeypatch.delenv("FRESHET_DOMAIN")
    assert cli.main(["download", "--dataset", "s54a-sgyg", "--department", "cesar", "--start-date", "2024-01-01", "--end-date", "2024-03-01"]) == 2
