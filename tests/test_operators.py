import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from freshet.operators import blocks, catalog, coverage, dedup, predicates

OBS = "codigoestacion string, codigosensor string, fechaobservacion string, valorobservado double"


def test_greatest_value_wins_in_any_order(spark):
    rows = [("1", "a", "t", 5.0), ("1", "a", "t", 8.0), ("1", "b", "t", 1.0), (None, "a", "t", None), (None, "a", "t", 2.0), ("1", "a", "u", float("nan")), ("1", "a", "u", 3.0)]
    expected = {("1", "a", "t", 8.0), ("1", "b", "t", 1.0), (None, "a", "t", 2.0), ("1", "a", "u", 3.0)}
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        found = dedup.deduplicate(spark.createDataFrame(rows, OBS), "fechaobservacion")
        assert {tuple(r) for r in found.collect()} == expected
    assert dedup.deduplicate(found, "fechaobservacion").count() == len(expected)


def test_ties_don_t_depend_on_order(spark):
    schema = "codigoestacion string, fechaobservacion string, valorobservado double, extra string"
    rows = [("1", "t", 5.0, x) for x in "abc"]
    got = {dedup.deduplicate(spark.createDataFrame(r, schema).repartition(3), "fechaobservacion").first().extra for r in (rows, rows[::-1])}
    assert got == {"c"}


def test_dedup_without_value_or_key(spark):
    two = spark.createDataFrame([("1", "s", "t")] * 2, "codigoestacion string, codigosensor string, fechaobservacion string")
    assert dedup.deduplicate(two, "fechaobservacion").count() == 1
    assert dedup.deduplicate(two.drop("codigoestacion"), "fechaobservacion").count() == 2
    assert [tuple(r) for r in dedup.duplicate_count(two, ["codigoestacion"]).collect()] == [(2, 1, 1)]
    assert [tuple(r) for r in dedup.duplicate_count(two.limit(0), ["codigoestacion"]).collect()] == [(0, 0, 0)]


def test_months(spark):
    found = [(r.lo, r.hi) for r in blocks.month_blocks(spark, "2023-11-15", "2024-02-01").orderBy("lo").collect()]
    assert found == [(date(2023, 11, 15), date(2023, 12, 1)), (date(2023, 12, 1), date(2024, 1, 1)), (date(2024, 1, 1), date(2024, 2, 1))]
    assert blocks.month_blocks(spark, "2024-01-01", "2024-01-01").count() == 0
    long = blocks.month_blocks(spark, "2020-01-01", "2023-01-01").orderBy("lo").collect()
    assert len(long) == 36 and all(a.hi == b.lo for a, b in zip(long, long[1:], strict=False))


def test_years_and_tasks(spark):
    years = blocks.year_blocks(spark, 2023, 2024)
    assert years.orderBy("year").collect()[1].hi == date(2025, 1, 1)
    assert blocks.tasks(years, ["a", "b", "c"]).count() == 6


def test_window_is_half_open(spark):
    rows = spark.createDataFrame([(datetime(2024, 1, d),) for d in (1, 2, 3)], "t timestamp_ntz")
    assert rows.filter(predicates.date_window(F.col("t"), "2024-01-01", "2024-01-03")).count() == 2


def test_predicates(spark):
    rows = spark.createDataFrame([("Asia", "Activa "), ("asia", "SUSPENDIDA"), (None, None), ("", "x")], "a string, b string")
    assert rows.filter(predicates.attribute_filter({"a": ["ASIA"], "b": []})).count() == 2
    assert rows.filter(predicates.all_of([])).count() == 4
    assert rows.filter(predicates.not_blank(F.col("a"))).count() == 2
    assert rows.filter(predicates.is_active(F.col("b"))).count() == 1
    assert predicates.pick("1,3,x,9,0,3", ["a", "b", "c"]) == ["a", "c", "c"]


def test_validation():
    for pair in (("2024-99-01", "2024-01-01"), ("2024-02-01", "2024-01-01"), ("2024-01-01", "2024-01-01")):
        with pytest.raises(ValueError):
            predicates.validate_dates(*pair)
    assert predicates.validate_dates("2024-01-01", "2024-02-01")[0] == date(2024, 1, 1)
    with pytest.raises(ValueError):
        predicates.validate_years(2020, 1999)


def test_pool_join_expands_aliases_and_keeps_nothing_for_an_empty_pool(spark):
    obs = spark.createDataFrame([("0012345678",), ("12345678",), ("123",), (None,)], "codigoestacion string")
    pool = spark.createDataFrame([("12345678",), ("999",)], "codigo string")
    assert catalog.in_pool(obs, pool).count() == 2
    assert catalog.in_pool(obs, pool.limit(0)).count() == 0
    assert catalog.pool_union(pool, pool).count() == 2


def test_department_coverage(spark):
    rows = spark.createDataFrame([("BOLÍVAR",)] * 2 + [("Bolivia",), ("CAUCA",), (None,)], "departamento string")
    found = {r.label: (r.total, r.matched) for r in catalog.department_coverage(rows, "BOLIVAR").collect()}
    assert found == {"BOLÍVAR": (2, True), "Bolivia": (1, False)}
    assert tuple(catalog.matched_totals(catalog.department_coverage(rows, "BOLIVAR")).first()) == (2, 1)


def test_completeness(spark):
    days = {"0021195190": ["2016-06-10", "2018-01-01", "2020-01-05"], "0029004520": ["2019-03-01", "2026-01-01"], None: [None]}
    rows = [(s, None if d is None else datetime.fromisoformat(d)) for s, ds in days.items() for d in ds]
    found = {r.station: r for r in coverage.station_coverage(spark.createDataFrame(rows, "s string, t timestamp_ntz"), "s", "t").collect()}
    assert (found["0021195190"].months_with_data, found["0021195190"].months_in_range) == (3, 44)
    assert round(found["0021195190"].completeness, 1) == 6.8 and round(found["0029004520"].completeness, 1) == 2.4
    assert found[None].n_rows == 1 and found[None].completeness is None
