"""Reader for the seven logical tables stored as files (parquet or CSV).

Types are never inferred: every column the reports read is projected and cast
to the explicit schema of :mod:`mercato.schema`; other columns in the files are
pruned at the scan. ``names`` maps a logical table to its file stem, so the
public marketplace export (one CSV per table, header row) can be read as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercato.schema import TABLE_NAMES, logical_schemas
from mercato.sources import Tables, exists


def _find(spark: SparkSession, path: str, stem: str) -> tuple[str, str]:
    base = path.rstrip("/")
    for candidate, fmt in (
        (f"{base}/{stem}.parquet", "parquet"),
        (f"{base}/{stem}", "parquet"),
        (f"{base}/{stem}.csv", "csv"),
    ):
        if exists(spark, candidate):
            return candidate, fmt
    raise FileNotFoundError(f"no parquet or csv table '{stem}' under {path}")


def locations(spark: SparkSession, path: str, names: dict[str, str] | None = None) -> list[str]:
    names = {t: t for t in TABLE_NAMES} | (names or {})
    return [_find(spark, path, names[t])[0] for t in TABLE_NAMES]


def read_table(
    spark: SparkSession, location: str, fmt: str, schema: T.StructType
) -> DataFrame:
    if fmt == "csv":
        # every column read as text, then cast: no inference pass over the data
        df = spark.read.option("header", True).option("inferSchema", False).csv(location)
        # exports written with a UTF-8 byte-order mark carry it in the first header name
        df = df.toDF(*[c.lstrip("\ufeff") for c in df.columns])
    else:
        df = spark.read.parquet(location)
    return _typed(df, schema)


def _typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def load(
    spark: SparkSession,
    path: str,
    names: dict[str, str] | None = None,
    id_type: T.DataType = T.StringType(),
) -> Tables:
    names = {t: t for t in TABLE_NAMES} | (names or {})
    schemas = logical_schemas(id_type)
    frames = {}
    for table in TABLE_NAMES:
        location, fmt = _find(spark, path, names[table])
        frames[table] = read_table(spark, location, fmt, schemas[table])
    return Tables(**frames)


def load_catalog(
    spark: SparkSession,
    database: str,
    names: dict[str, str] | None = None,
    id_type: T.DataType = T.StringType(),
) -> Tables:
    """The seven tables of a catalog database, cast to the schema; ``names`` maps
    logical tables to the catalog's own table names."""
    names = {t: t for t in TABLE_NAMES} | (names or {})
    schemas = logical_schemas(id_type)
    return Tables(**{t: _typed(spark.table(f"{database}.{names[t]}"), schemas[t]) for t in TABLE_NAMES})
