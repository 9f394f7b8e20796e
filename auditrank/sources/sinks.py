"""Where results go: delimited files, Parquet, and a folder of report tables.

A folder of reports ends with a manifest: names, formats, numbers of rows and schemas.
It is written last, so a folder without one is a run that did not finish, and readers
see a run as a whole or not at all.
"""

from __future__ import annotations

import json
from collections.abc import Collection, Mapping

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Name of the manifest within a folder of reports, and its columns.
MANIFEST = "manifesto"
MANIFEST_SCHEMA = "tabela string, formato string, linhas long, esquema string"


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Delimited text with header, UTF-8, one file per task."""
    df.write.mode(mode).option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def write_reports(
    tables: Mapping[str, DataFrame | None],
    folder: str,
    fmt: str = "parquet",
    optional: Collection[str] = (),
    mode: str = "errorifexists",
) -> list[str]:
    """One dataset per report under ``folder``, then the manifest; the names
    written are returned.

    Tables that are None, or optional and empty, are left out.  Rows are counted
    as they are written.
    """
    writers = {"csv": write_csv, "parquet": write_parquet}
    written = []
    for name, df in tables.items():
        if df is None or (name in optional and df.isEmpty()):
            continue
        counted = Observation(f"rows of {name}")
        writers[fmt](df.observe(counted, F.count(F.lit(1)).alias("linhas")), f"{folder}/{name}", mode)
        written.append((name, fmt, counted.get["linhas"], df.schema.json()))
    spark = next(iter(tables[name] for name, *_ in written)).sparkSession if written else None
    if spark:
        write_parquet(spark.createDataFrame(written, MANIFEST_SCHEMA).coalesce(1), f"{folder}/{MANIFEST}", mode)
    return [name for name, *_ in written]


def read_reports(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The manifest and the tables it names, with the schemas they were written with.

    Fails if the run has no manifest, that is, if it did not finish.
    """
    manifest = spark.read.schema(MANIFEST_SCHEMA).parquet(f"{folder}/{MANIFEST}")
    tables = {MANIFEST: manifest}
    for row in manifest.collect():
        schema = T.StructType.fromJson(json.loads(row.esquema))
        reader = spark.read.schema(schema)
        if row.formato == "csv":
            reader = reader.option("header", True)
        tables[row.tabela] = reader.format(row.formato).load(f"{folder}/{row.tabela}")
    return tables
