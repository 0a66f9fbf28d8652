from datetime import datetime

import pytest
from pyspark.sql import functions as F

from freshet.functions import keys, labels, paths, values


def one(spark, kind, expression, *inputs):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r[1] for r in rows.select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()]


def test_fold_label(spark):
    given = ["  bolívar ", "Nariño", None, "\tBogotá D.C.\n", "ÇÀÖ"]
    folded = ["BOLIVAR", "NARINO", "", "BOGOTA D.C.", "CAO"]
    assert one(spark, "string", labels.fold_label, *given) == folded == [labels.fold_text(v) for v in given]
    assert one(spark, "string", labels.fold_label_exact, *given[:2]) == folded[:2]


def test_department_variants_cover_all_spellings():
    found = labels.department_variants("SAN ANDRES Y PROVIDENCIA")
    assert "ARCHIPIÉLAGO DE SAN ANDRÉS, PROVIDENCIA Y SANTA CATALINA" in found and found == sorted(found)
    assert "NARINO" in labels.department_variants("NARIÑO")


def test_validate_departments():
    assert labels.validate_departments(["atlántico"]) == ["ATLANTICO"]
    assert labels.validate_departments(["BOGOTA", "BOGOTÁ D.C."]) == ["BOGOTA D.C."]
    with pytest.raises(ValueError, match="BOLIVAR"):
        labels.validate_departments(["BOLIBAR"])


def test_canonical_column_keeps_unknown(spark):
    assert one(spark, "string", labels.canonical_column, "valle", "Bogotá, D.C", "Mars", None) == ["VALLE DEL CAUCA", "BOGOTA D.C.", "Mars", None]


def test_department_filter_treats_injection_as_data(spark):
    mapping = {"O'BRIEN": ["x' OR 1=1 --"]}
    predicate = lambda c: labels.department_predicate(c, ["O'BRIEN"], mapping)
    assert one(spark, "string", predicate, "o'brien", "X' OR 1=1 --", "other") == [True, True, False]


def test_department_table(spark):
    rows = labels.department_table(spark).collect()
    assert len({r.variant_norm for r in rows}) == len(rows) and len({r.canonical for r in rows}) == 33


def test_numbers(spark):
    given = ["5.5", " 7 ", "abc", "NaN", "", "5.4d", "-1e3", "Infinity", None, ".5"]
    assert one(spark, "string", values.to_number, *given) == [5.5, 7.0, None, None, None, None, -1000.0, None, None, 0.5]


def test_dates(spark):
    given = ["12/31/2016 11:50:00 PM", "2016-12-31T23:50:00.000", "no-es-fecha", None, "1/2/2020 1:00:00 AM"]
    same = datetime(2016, 12, 31, 23, 50)
    assert one(spark, "string", values.to_export_timestamp, *given) == [same, same, None, None, datetime(2020, 1, 2, 1)]


def test_duration_and_codes(spark):
    assert one(spark, "long", values.duration_text, 9, 125, 3780) == ["9s", "2m 5s", "1h 3m"]
    assert one(spark, "string", values.code_list, " 1, 2,,1 ,x", "") == [["1", "2", "x"], []]
    assert one(spark, "string", values.code_aliases, "12345678", "123") == [["12345678", "0012345678"], ["123"]]
    assert one(spark, "string", values.first_year, "a_o 2019x", "none", None) == [2019, None, None]


def test_row_key(spark):
    schema = "codigoestacion string, codigosensor string, fechaobservacion timestamp_ntz"
    rows = spark.createDataFrame([("001", "s", datetime(2020, 1, 1, 2, 3, 4, 500_000)), (None, "s", None)], schema)
    found = [r.floating_id for r in keys.with_row_key(rows, "d", "fechaobservacion").orderBy("codigosensor", "fechaobservacion").collect()]
    import hashlib

    expected = [hashlib.sha256(t.encode()).hexdigest() for t in ("d|nan|s|nan", "d|001|s|2020-01-01T02:03:04")]
    assert sorted(found) == sorted(expected)
    bare = keys.with_row_key(rows.select("codigoestacion"), "d", "fechaobservacion").filter("codigoestacion is not null").first()
    assert bare.floating_id == hashlib.sha256(b"d|001||").hexdigest()


def test_null_part_keeps_its_place(spark):
    row = spark.range(1).select(keys.stable_hash(F.lit("a"), F.lit(None), F.lit("b")).alias("x"), keys.stable_hash(F.lit("a"), F.lit("b")).alias("y")).first()
    assert row.x != row.y


def test_safe_path(spark):
    given = [None, "  ", "a/b:c*d", "..x..", "a \t b", '<>|"', "ÁÉ d"]
    assert one(spark, "string", paths.safe_path, *given) == ["SIN_DATO", "SIN_DATO", "a_b_c_d", "x", "a_b", "SIN_DATO", "ÁÉ_d"]


def test_names(spark):
    names = ["Inventario Nacional Gases Efecto Invernadero", "Nivel del Mar", "Otra", "Humedad del Aire"]
    assert one(spark, "string", paths.icon, *names) == ["🏞️", "🌊", "📊", "💧"]
    assert one(spark, "string", paths.export_name, "Nivel (Rio) x") == ["nivel_rio_x"]
    assert paths.export_stamp(datetime(2024, 2, 1, 10, 30)) == "1030_010224"
