"""The named queries: each has a Spark form and a DuckDB form over the same tables.

Stand-ins: lineitem, orders and events are observations; supplier with nation and region is the station catalog.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels, paths, values
from ..functions.keys import stable_hash, with_row_key
from ..operators import blocks, catalog, coverage, dedup, predicates
from ..sources import registry, scan, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str) -> Callable:
    """Registers a query under its function's name, with its SQL."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """codigo, nombre, municipio, departamento, estado of each supplier."""
    supplier, nation, region = (read(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    placed = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    state = F.when(F.col("s_acctbal") >= 0, "Activa").otherwise("Suspendida")
    return placed.select(F.col("s_suppkey").cast("string").alias("codigo"), F.col("s_name").alias("nombre"), F.col("n_name").alias("municipio"), F.col("r_name").alias("departamento"), state.alias("estado"))


STATIONS = """(SELECT CAST(s_suppkey AS VARCHAR) AS codigo, s_name AS nombre, n_name AS municipio, r_name AS departamento,
  CASE WHEN s_acctbal >= 0 THEN 'Activa' ELSE 'Suspendida' END AS estado
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
DISTORTED = """(SELECT codigo, departamento, CASE CAST(codigo AS BIGINT) % 4 WHEN 0 THEN lower(departamento)
  WHEN 1 THEN '  ' || replace(departamento, 'A', 'Á') WHEN 2 THEN departamento || ' X' ELSE departamento END AS label
  FROM """ + STATIONS + ")"
FOLD = "strip_accents(upper(trim({})))"
SAFE = r"coalesce(nullif(trim(regexp_replace(regexp_replace({}, '[<>:\"/\\|?*]+', '_', 'g'), '\s+', '_', 'g'), '._ '), ''), 'SIN_DATO')"


def distorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stations whose department is spelled in four ways."""
    kind = F.col("codigo").cast("long") % 4
    dep = F.col("departamento")
    label = F.when(kind == 0, F.lower(dep)).when(kind == 1, F.concat(F.lit("  "), F.replace(dep, F.lit("A"), F.lit("Á")))).when(kind == 2, F.concat(dep, F.lit(" X"))).otherwise(dep)
    return stations(spark, sf_dir).select("codigo", "departamento", label.alias("label"))


COVERAGE = """SELECT {0} AS station, count(*) AS n_rows, min({1}) AS first_obs, max({1}) AS last_obs,
  count(DISTINCT year({1}) * 12 + month({1})) AS months_with_data,
  (year(max({1})) - year(min({1}))) * 12 + month(max({1})) - month(min({1})) + 1 AS months_in_range,
  100.0::double * count(DISTINCT year({1}) * 12 + month({1}))
    / ((year(max({1})) - year(min({1}))) * 12 + month(max({1})) - month(min({1})) + 1) AS completeness
FROM {2} GROUP BY {0}"""


@query(COVERAGE.format("l_suppkey", "l_shipdate", "lineitem"))
def coverage_station(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.station_coverage(read(spark, sf_dir, "lineitem"), "l_suppkey", "l_shipdate")


@query(COVERAGE.format("o_custkey", "o_orderdate", "orders"))
def coverage_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.station_coverage(read(spark, sf_dir, "orders"), "o_custkey", "o_orderdate")


@query("""SELECT user_id, event_type, hour, value, event_id FROM (SELECT *, date_trunc('hour', ts) AS hour FROM events)
QUALIFY row_number() OVER (PARTITION BY user_id, event_type, hour ORDER BY value DESC NULLS LAST, event_id DESC) = 1""")
def dedup_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select("user_id", "event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "value", "event_id")
    return dedup.keep_greatest(rows, ["user_id", "event_type", "hour"], "value", [F.col("event_id")])


LINE_KEY = "l_suppkey, l_returnflag, l_shipdate"


@query(f"""SELECT {LINE_KEY}, l_quantity, l_orderkey, l_linenumber, l_partkey FROM lineitem QUALIFY row_number() OVER
(PARTITION BY {LINE_KEY} ORDER BY l_quantity DESC NULLS LAST, l_orderkey DESC, l_linenumber DESC, l_partkey DESC) = 1""")
def dedup_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    ties = ["l_orderkey", "l_linenumber", "l_partkey"]
    rows = read(spark, sf_dir, "lineitem").select(*LINE_KEY.split(", "), "l_quantity", *ties)
    return dedup.keep_greatest(rows, LINE_KEY.split(", "), "l_quantity", [F.col(c) for c in ties])


@query(f"""SELECT CAST(sum(n) AS BIGINT) AS raw, count(*) AS kept, CAST(sum(n) - count(*) AS BIGINT) AS removed
FROM (SELECT count(*) AS n FROM lineitem GROUP BY {LINE_KEY})""")
def dup_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.duplicate_count(read(spark, sf_dir, "lineitem"), LINE_KEY.split(", "))


@query("""SELECT event_id, sha256('events|' || coalesce(CAST(user_id AS VARCHAR), '') || '|' || coalesce(event_type, '') || '|' ||
coalesce(strftime(ts, '%Y-%m-%dT%H:%M:%S'), '')) AS floating_id FROM events""")
def floating_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    return with_row_key(rows, "events", "ts", "user_id", "event_type").select("event_id", "floating_id")


@query(f"SELECT doc_id, sha256({FOLD.format("replace(text, 'ß', 'ss')")}) AS folded FROM documents")
def norm_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(labels.fold_label(F.col("text")), 256).alias("folded"))


@query(f"""SELECT codigo, label, coalesce(r_name, label) AS canonical FROM {DISTORTED} d
LEFT JOIN region ON {FOLD.format("label")} = {FOLD.format("r_name")}""")
def dept_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = {r["r_name"]: [] for r in read(spark, sf_dir, "region").select("r_name").collect()}  # a region is a department: a fixed few
    return distorted(spark, sf_dir).select("codigo", "label", labels.canonical_column(F.col("label"), known).alias("canonical"))


@query(f"""SELECT label, {FOLD.format("label")} AS normalized, count(*) AS total,
{FOLD.format("label")} IN (SELECT {FOLD.format("r_name")} FROM region) AS matched FROM {DISTORTED} GROUP BY label""")
def dept_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = read(spark, sf_dir, "region").select(labels.fold_label(F.col("r_name")).alias("normalized"), F.lit(True).alias("known"))
    groups = distorted(spark, sf_dir).groupBy("label").agg(F.count("*").alias("total")).withColumn("normalized", labels.fold_label(F.col("label")))
    return groups.join(known, "normalized", "left").select("label", "normalized", "total", F.coalesce("known", F.lit(False)).alias("matched"))


@query(f"""SELECT label, count(*) AS total FROM (SELECT departamento AS label FROM {STATIONS})
WHERE contains({FOLD.format("label")}, 'A') GROUP BY label""")
def variant_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.discover(stations(spark, sf_dir), "á")


@query(f"""SELECT l_suppkey, count(*) AS n_rows FROM lineitem WHERE CAST(l_suppkey AS VARCHAR) IN
(SELECT codigo FROM {STATIONS} WHERE upper(departamento) IN ('ASIA', 'EUROPE') AND upper(estado) IN ('ACTIVA')) GROUP BY l_suppkey""")
def semi_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = stations(spark, sf_dir).filter(predicates.attribute_filter({"departamento": ["Asia", "Europe"], "estado": ["activa"], "municipio": []}))
    rows = read(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_suppkey").cast("string").alias("codigoestacion"))
    return catalog.in_pool(rows, pool).groupBy("l_suppkey").agg(F.count("*").alias("n_rows"))


@query("""WITH obs AS (SELECT CASE WHEN l_orderkey % 2 = 0 THEN '00' ELSE '' END || lpad(CAST(l_suppkey AS VARCHAR), 8, '7') AS code FROM lineitem),
pool AS (SELECT DISTINCT lpad(CAST(s_suppkey AS VARCHAR), 8, '7') AS code FROM supplier WHERE s_acctbal >= 0)
SELECT count(*) AS n_rows FROM obs WHERE EXISTS (SELECT 1 FROM pool WHERE obs.code = pool.code OR obs.code = '00' || pool.code)""")
def code_alias_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = lambda c: F.lpad(F.col(c).cast("string"), 8, "7")
    rows = read(spark, sf_dir, "lineitem").select(F.concat(F.when(F.col("l_orderkey") % 2 == 0, "00").otherwise(""), code("l_suppkey")).alias("codigoestacion"))
    pool = read(spark, sf_dir, "supplier").filter("s_acctbal >= 0").select(code("s_suppkey").alias("codigo"))
    return catalog.in_pool(rows, pool).agg(F.count("*").alias("n_rows"))


@query("SELECT DISTINCT upper(p_type) AS value FROM part WHERE p_type IS NOT NULL AND p_type <> ''")
def catalog_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.values_of(read(spark, sf_dir, "part").select(F.upper("p_type").alias("type")), "type")


@query(f"SELECT count(*) AS stations, count(*) FILTER (upper(trim(estado)) LIKE 'ACTIVA%') AS active FROM {STATIONS}")
def coverage_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.probe(stations(spark, sf_dir))


@query("""SELECT CAST(min(l_shipdate) AS DATE) AS first_day, CAST(max(l_shipdate) AS DATE) AS last_day,
CAST(year(min(l_shipdate)) AS INTEGER) AS first_year, CAST(year(max(l_shipdate)) AS INTEGER) AS last_year FROM lineitem""")
def minmax_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = catalog.date_range(read(spark, sf_dir, "lineitem"), "l_shipdate")
    return days.select("*", values.first_year(F.col("first_day")).alias("first_year"), values.first_year(F.col("last_day")).alias("last_year"))


MONTHS = """SELECT greatest(CAST(m AS DATE), DATE '{0}') AS lo, least(CAST(m + INTERVAL 1 MONTH AS DATE), DATE '{1}') AS hi
FROM generate_series(date_trunc('month', DATE '{0}')::TIMESTAMP, DATE '{1}' - INTERVAL 1 DAY, INTERVAL 1 MONTH) t(m)"""


@query(MONTHS.format("2023-11-15", "2024-02-01"))
def month_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.month_blocks(spark, "2023-11-15", "2024-02-01")


@query(f"""SELECT lo, count(*) AS n_rows FROM ({MONTHS.format("1996-01-15", "1996-04-10")}) b
JOIN lineitem ON l_shipdate >= lo AND l_shipdate < hi GROUP BY lo""")
def block_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.with_block(read(spark, sf_dir, "lineitem"), "l_shipdate", "1996-01-15", "1996-04-10").groupBy("lo").agg(F.count("*").alias("n_rows"))


@query("""SELECT CAST(y AS INTEGER) AS year, f AS status, (SELECT count(*) FROM orders WHERE o_orderstatus = f
AND o_orderdate >= make_date(y, 1, 1) AND o_orderdate < make_date(y + 1, 1, 1)) AS n_rows
FROM range(1995, 1999) t(y) CROSS JOIN (VALUES ('F'), ('O'), ('P')) s(f)""")
def year_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = blocks.tasks(blocks.year_blocks(spark, 1995, 1998), ["F", "O", "P"])
    found = read(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year"), F.col("o_orderstatus").alias("filter")).agg(F.count("*").alias("n"))
    return tasks.join(found, ["year", "filter"], "left").select("year", F.col("filter").alias("status"), F.coalesce("n", F.lit(0)).alias("n_rows"))


@query("""SELECT event_id, coalesce(try_strptime(t, '%m/%d/%Y %I:%M:%S %p'), try_cast(t AS TIMESTAMP)) AS parsed FROM (
SELECT event_id, CASE event_id % 3 WHEN 0 THEN strftime(ts, '%m/%d/%Y %I:%M:%S %p') WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
ELSE 'no-es-fecha' END AS t FROM events)""")
def date_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_id") % 3
    text = F.when(kind == 0, F.date_format("ts", "MM/dd/yyyy hh:mm:ss a")).when(kind == 1, values.iso_second(F.col("ts"))).otherwise("no-es-fecha")
    return read(spark, sf_dir, "events").select("event_id", values.to_export_timestamp(text).alias("parsed"))


@query(r"""SELECT event_id, CASE WHEN regexp_matches(t, '^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$') THEN TRY_CAST(trim(t) AS DOUBLE) END AS number FROM (
SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'abc' WHEN 1 THEN 'NaN' WHEN 2 THEN '' WHEN 3 THEN '5.4d' WHEN 4 THEN ' ' || CAST(event_id AS VARCHAR) || '.25'
ELSE CAST(event_id AS VARCHAR) END AS t FROM events)""")
def num_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, name = F.col("event_id") % 6, F.col("event_id").cast("string")
    text = F.when(kind == 0, "abc").when(kind == 1, "NaN").when(kind == 2, "").when(kind == 3, "5.4d").when(kind == 4, F.concat(F.lit(" "), name, F.lit(".25"))).otherwise(name)
    return read(spark, sf_dir, "events").select("event_id", values.to_number(text).alias("number"))


@query(f"""SELECT departamento, municipio, codigo, l_shipdate, l_orderkey, l_linenumber FROM lineitem
JOIN {STATIONS} ON CAST(l_suppkey AS VARCHAR) = codigo WHERE upper(departamento) IN ('EUROPE')
AND l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1996-02-01'
ORDER BY l_shipdate, l_orderkey, l_linenumber LIMIT 5""")
def verify_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = stations(spark, sf_dir).filter(predicates.in_upper(F.col("departamento"), ["europe"]))
    rows = read(spark, sf_dir, "lineitem").filter(predicates.date_window(F.col("l_shipdate"), "1996-01-01", "1996-02-01"))
    met = rows.join(pool, F.col("l_suppkey").cast("string") == F.col("codigo"))
    return met.select("departamento", "municipio", "codigo", "l_shipdate", "l_orderkey", "l_linenumber").orderBy("l_shipdate", "l_orderkey", "l_linenumber").limit(5)


@query("""SELECT l_suppkey, l_linestatus AS first_name FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_returnflag, l_shipdate, l_quantity, l_orderkey, l_linenumber) = 1""")
def station_first_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = coverage.first_by("l_linestatus", "l_returnflag", "l_shipdate", "l_quantity", "l_orderkey", "l_linenumber")
    return read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(first.alias("first_name"))


@query(f"""SELECT dep_part, mun_part, count(*) AS n_rows, 'precipitación_' || lower(dep_part) || '_' || lower(mun_part) || '_1030_010224' AS base_name,
CAST(ceil(count(*) / 9.0) AS BIGINT) AS csv_parts FROM (SELECT {SAFE.format("departamento")} AS dep_part, {SAFE.format("municipio")} AS mun_part FROM {STATIONS}) GROUP BY ALL""")
def export_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.manifest(stations(spark, sf_dir), "Precipitación", "1030_010224", 10)


@query("""SELECT event_type, CAST(part AS INTEGER) AS part, count(*) AS n_rows FROM (SELECT event_type,
(row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1) // 899 + 1 AS part FROM events) GROUP BY ALL""")
def csv_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedup.part_number(read(spark, sf_dir, "events"), ["event_type"], [F.col("ts"), F.col("event_id")], 900)
    return rows.groupBy("event_type", "part").agg(F.count("*").alias("n_rows"))


@query(f"SELECT page_id, {SAFE.format('url')} AS part FROM pages")
def safe_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", paths.safe_path(F.col("url")).alias("part"))


@query("""SELECT event_id, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm ' || (s % 60) || 's'
ELSE (s // 3600) || 'h ' || ((s % 3600) // 60) || 'm' END AS duration FROM (SELECT event_id, event_id % 9000 AS s FROM events)""")
def fmt_dur(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", values.duration_text(F.col("event_id") % 9000).alias("duration"))


@query(f"""SELECT (SELECT count(*) FROM lineitem) AS raw, count(*) AS n_rows, min(l_shipdate) AS first_obs, max(l_shipdate) AS last_obs,
(SELECT count(*) FROM lineitem) - count(*) AS duplicates FROM (SELECT DISTINCT {LINE_KEY} FROM lineitem)""")
def report_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = read(spark, sf_dir, "lineitem").groupBy(*LINE_KEY.split(", ")).agg(F.count("*").alias("n"))
    total = groups.agg(F.sum("n").alias("raw"), F.count("*").alias("n_rows"), F.min("l_shipdate").alias("first_obs"), F.max("l_shipdate").alias("last_obs"))
    return total.withColumn("duplicates", F.col("raw") - F.col("n_rows"))


@query(f"""SELECT codigo FROM {STATIONS} WHERE estado = 'Suspendida' UNION SELECT c FROM (VALUES ('1'), ('2'), ('00000077'), ('x')) t(c)""")
def pool_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = spark.range(1).select(F.explode(values.code_list(F.lit(" 1, 2,,00000077 ,x,2"))).alias("codigo"))
    return catalog.pool_union(stations(spark, sf_dir).filter("estado = 'Suspendida'"), typed)


@query("""SELECT n_name, n_regionkey, NULL::DOUBLE AS s_acctbal FROM nation UNION ALL SELECT s_name, NULL::INTEGER, s_acctbal FROM supplier""")
def union_missing_cols(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = read(spark, sf_dir, "nation").select("n_name", "n_regionkey")
    suppliers = read(spark, sf_dir, "supplier").select(F.col("s_name").alias("n_name"), "s_acctbal")
    return scan.union_blocks([nations, suppliers])


REGISTRY = "(VALUES " + ", ".join(f"('{r['id']}', '{r['nombre']}', {r['mil_filas'] or 'NULL'}::BIGINT, '{r['tipo']}')" for r in registry.datasets()) + ") r(id, nombre, mil_filas, tipo)"
ICON_SQL = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(nombre), '{t}')" for t in texts) + f" THEN '{sign}'" for texts, sign in paths.ICONS) + f" ELSE '{paths.OTHER_ICON}' END"


@query(f"SELECT id, {ICON_SQL} AS icon FROM {REGISTRY}")
def icon_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.dataset_table(spark).select("id", paths.icon(F.col("nombre")).alias("icon"))


@query(f"SELECT id, nombre FROM {REGISTRY} WHERE contains(lower(nombre), 'aire')")
def name_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.dataset_table(spark).filter(paths.name_matches(F.col("nombre"), "AIRE")).select("id", "nombre")


@query(f"SELECT tipo, count(*) AS n, CAST(sum(mil_filas) AS BIGINT) AS mil_filas FROM {REGISTRY} GROUP BY tipo")
def dataset_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.dataset_table(spark).groupBy("tipo").agg(F.count("*").alias("n"), F.sum("mil_filas").alias("mil_filas"))


@query("SELECT r_regionkey, array_to_string(list_transform(string_split(lower(r_name), ' '), lambda x: upper(x[1]) || x[2:]), ' ') AS title FROM region")
def title_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "region").select("r_regionkey", paths.title_case(F.col("r_name")).alias("title"))


@query("SELECT c_custkey, lower(replace(replace(replace(c_name || ' (' || c_mktsegment || ')', ' ', '_'), '(', ''), ')', '')) AS base FROM customer")
def export_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.concat(F.col("c_name"), F.lit(" ("), F.col("c_mktsegment"), F.lit(")"))
    return read(spark, sf_dir, "customer").select("c_custkey", paths.export_name(label).alias("base"))


@query(f"""SELECT CAST(coalesce(sum(total) FILTER (matched), 0) AS BIGINT) AS matched_rows, CAST(coalesce(sum(total) FILTER (NOT matched), 0) AS BIGINT) AS unmatched_rows
FROM (SELECT label, count(*) AS total, {FOLD.format("label")} = 'AMERICA' AS matched FROM {DISTORTED} WHERE contains({FOLD.format("label")}, 'AMER') GROUP BY label)""")
def verify_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.matched_totals(catalog.department_coverage(distorted(spark, sf_dir), "AMERICA", "label", {"AMERICA": ["AMÉRICA"]}))


@query("""SELECT event_id, 100.0::DOUBLE * (event_id % 50) / 50 AS percent, CASE WHEN event_id % 7 > 0 THEN event_id / (event_id % 7)::DOUBLE END AS rate,
CASE WHEN event_id % 50 > 0 THEN (50 - event_id % 50)::DOUBLE / (event_id % 50) * (event_id % 7) END AS eta FROM events""")
def progress_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    done, seconds = F.col("event_id") % 50, F.col("event_id") % 7
    return read(spark, sf_dir, "events").select("event_id", *values.progress(done, F.lit(50), F.col("event_id"), seconds))


PIPELINE_KEY = "'lineitem|' || CAST(l_suppkey AS VARCHAR) || '|' || l_returnflag || '|' || strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S')"


@query(f"""WITH kept AS (SELECT *, {SAFE.format("departamento")} AS dep, {SAFE.format("municipio")} AS mun FROM lineitem
JOIN {STATIONS} ON CAST(l_suppkey AS VARCHAR) = codigo WHERE upper(departamento) IN ('ASIA', 'EUROPE')
AND l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01'
QUALIFY row_number() OVER (PARTITION BY {LINE_KEY} ORDER BY l_quantity DESC, l_orderkey DESC, l_linenumber DESC) = 1)
SELECT dep, mun, count(*) AS n_rows, count(DISTINCT sha256({PIPELINE_KEY})) AS n_keys, min(l_shipdate) AS first_obs, max(l_shipdate) AS last_obs,
sum(l_quantity) AS quantity FROM kept GROUP BY dep, mun""")
def pipeline_e2e(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = stations(spark, sf_dir).filter(predicates.in_upper(F.col("departamento"), ["Asia", "Europe"])).select("codigo", "municipio", "departamento")
    window = predicates.date_window(F.col("l_shipdate"), "1996-01-01", "1997-01-01")
    rows = read(spark, sf_dir, "lineitem").filter(window).select("l_suppkey", "l_returnflag", "l_shipdate", "l_quantity", "l_orderkey", "l_linenumber")
    rows = dedup.keep_greatest(rows, LINE_KEY.split(", "), "l_quantity", [F.col("l_orderkey"), F.col("l_linenumber")])
    key = stable_hash(F.lit("lineitem"), F.col("l_suppkey"), F.col("l_returnflag"), values.iso_second(F.col("l_shipdate")))
    named = rows.join(pool, F.col("l_suppkey").cast("string") == F.col("codigo")).withColumn("floating_id", key)
    by = sinks.with_territory_parts(named).groupBy(F.col("dep_part").alias("dep"), F.col("mun_part").alias("mun"))
    return by.agg(F.count("*").alias("n_rows"), F.countDistinct("floating_id").alias("n_keys"), F.min("l_shipdate").alias("first_obs"), F.max("l_shipdate").alias("last_obs"), F.sum("l_quantity").alias("quantity"))
