"""The dataset registry and settings (SC9 to SC11)."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

STATION_CATALOG = "hp9r-jxuu"
# Name, id, date column, whether that column is a timestamp, and department column of each dataset.
STANDARD = [
    ("Precipitación", "s54a-sgyg"),
    ("Nivel del Mar", "ia8x-22em"),
    ("Dirección del Viento", "kiw7-v9ta"),
    ("Velocidad del Viento", "sgfv-3yp8"),
    ("Presión Atmosférica", "62tk-nxj5"),
    ("Humedad del Aire", "uext-mhny"),
    ("Temperatura Máxima del Aire", "ccvq-rp9s"),
    ("Temperatura Mínima del Aire", "afdg-3zpb"),
    ("Nivel Máximo del Rio", "vfth-yucv"),
    ("Nivel Instantáneo del Rio", "bdmn-sqnh"),
    ("Nivel Mínimo del Rio", "pt9a-aamx"),
    ("Nivel del Mar Máximo", "uxy3-jchf"),
    ("Nivel del Mar Mínimo", "7z6g-yx9q"),
]
SPECIAL = [
    ("Calidad Del Aire Promedio Anual", "kekd-7v7h", "a_o", None, "nombre_del_departamento"),
    ("Calidad del Aire en Colombia", "g4t8-zkc3", "med_fecha_inicio", True, "departamento"),
    ("Data histórica de calidad de agua", "62gv-3857", "fecha", True, "departamento"),
    ("Zonificación Hidrográfica Colombia", "5kjg-nuda", None, None, None),
    ("Normales Climatológicas de Colombia", "nsz2-kzcq", "ao", None, "departamento"),
    ("Inventario Nacional Gases Efecto Invernadero", "6rff-a5ep", "a_o", None, None),
    ("Histórico mensual de escorrentía", "kg4b-vx7j", "mes_a_o", None, None),
    ("Catálogo Nacional de Estaciones", STATION_CATALOG, None, None, "departamento"),
]
# Approximate rows of the standard datasets, in thousands.
THOUSAND_ROWS = {
    "s54a-sgyg": 282_000,
    "sgfv-3yp8": 127_000,
    "kiw7-v9ta": 110_000,
    "uext-mhny": 87_000,
    "62tk-nxj5": 34_000,
    "ccvq-rp9s": 27_000,
    "afdg-3zpb": 27_000,
    "bdmn-sqnh": 21_000,
    "vfth-yucv": 14_000,
    "pt9a-aamx": 12_000,
    "uxy3-jchf": 1_300,
    "ia8x-22em": 278,
    "7z6g-yx9q": 93,
}
SCHEMA = "nombre string, id string, fecha_col string, tipo string, dep_col string, fecha_real boolean, mil_filas long"


def datasets() -> list[dict]:
    """All registered datasets."""
    rows = [{"nombre": n, "id": i, "fecha_col": "fechaobservacion", "tipo": "estandar", "dep_col": None, "fecha_real": None} for n, i in STANDARD]
    rows += [{"nombre": n, "id": i, "fecha_col": c, "tipo": "especial", "dep_col": d, "fecha_real": r} for n, i, c, r, d in SPECIAL]
    return [r | {"mil_filas": THOUSAND_ROWS.get(r["id"])} for r in rows]


def dataset(dataset_id: str) -> dict:
    """SC9: one dataset; an unknown id raises with the valid ones."""
    known = {r["id"]: r for r in datasets()}
    if dataset_id not in known:
        raise ValueError(f"unknown dataset {dataset_id!r}; known: {', '.join(known)}")
    return known[dataset_id]


def dataset_table(spark: SparkSession) -> DataFrame:
    """SC10: the registry as a DataFrame."""
    return spark.createDataFrame([tuple(r.values()) for r in datasets()], SCHEMA)


@dataclass(frozen=True)
class Settings:
    """SC11: limits of scans and sinks, portal and its token; FRESHET_* variables override them, and a .env file those that
    are unset."""

    page_rows: int = 50_000
    attempts: int = 5
    timeout_s: int = 300
    sheet_rows: int = 1_048_576
    output_dir: str = "data"
    domain: str = ""
    token: str = ""
    workers: int = 20

    @classmethod
    def from_environment(cls) -> Settings:
        filed = {}
        if os.path.isfile(".env"):
            with open(".env", encoding="utf-8") as lines:
                pairs = [line.split("=", 1) for line in lines if "=" in line and not line.lstrip().startswith("#")]
            filed = {k.strip(): v.strip().strip("\"'") for k, v in pairs}
        given = {f: os.environ.get(f"FRESHET_{f.upper()}", filed.get(f"FRESHET_{f.upper()}")) for f in cls.__dataclass_fields__}
        return cls(**{f: type(getattr(cls, f))(v) for f, v in given.items() if v})
