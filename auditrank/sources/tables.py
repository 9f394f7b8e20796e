"""Ledger tables the tests read, and how to open them."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# Columns each table must offer.  Dates may be stored as DATE (preferred: range
# filters then reach the scan) or as text.
CUSTOMER_COLUMNS = ("MANDT", "KUNNR", "NAME1", "ERDAT")
ITEM_COLUMNS = (
    "MANDT", "BUKRS", "KUNNR", "BELNR", "GJAHR", "BUZEI", "H_BUDAT", "H_BLDAT",
    "NETDT", "ZBD1T", "AUGDT", "ZLSCH", "H_BLART", "SHKZG", "HKONT", "DMBTR",
)
HEADER_COLUMNS = (
    "MANDT", "BUKRS", "BELNR", "GJAHR", "BLDAT", "USNAM", "XREVERSING", "AWREF_REV",
)


@dataclass(frozen=True)
class Ledger:
    """Customer master, ledger items and document headers."""

    kna1: DataFrame
    bseg: DataFrame
    bkpf: DataFrame

    def __post_init__(self) -> None:
        for name, columns in (
            ("kna1", CUSTOMER_COLUMNS),
            ("bseg", ITEM_COLUMNS),
            ("bkpf", HEADER_COLUMNS),
        ):
            missing = [c for c in columns if c not in getattr(self, name).columns]
            if missing:
                raise ValueError(f"{name} lacks columns {missing}")


def read_ledger(spark: SparkSession, paths: Mapping[str, str], fmt: str = "parquet") -> Ledger:
    """Open the three tables from files, e.g. ``{"kna1": ".../kna1", ...}``."""
    return Ledger(**{name: spark.read.format(fmt).load(path) for name, path in paths.items()})


def ledger_from_catalog(spark: SparkSession, names: Mapping[str, str]) -> Ledger:
    """Open the three tables from the catalog, e.g. ``{"kna1": "erp.kna1", ...}``."""
    return Ledger(**{name: spark.table(table) for name, table in names.items()})
