"""All registered queries and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog.oracle_ledger import ledger_oracles
from catalog.oracle_matrix import matrix_oracles
from catalog.queries_ledger import LEDGER_QUERIES
from catalog.queries_matrix import MATRIX_QUERIES

Query = Callable[[SparkSession, str], DataFrame]


def _shown(query: Query) -> Query:
    """Decimals as doubles and dates as text, the same plain form in both engines."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = query(spark, sf_dir)
        plain = {}
        for field in df.schema:
            if isinstance(field.dataType, T.DecimalType):
                plain[field.name] = F.col(field.name).cast("double")
            elif isinstance(field.dataType, T.DateType):
                plain[field.name] = F.col(field.name).cast("string")
        return df.withColumns(plain) if plain else df

    return run


def queries() -> dict[str, Query]:
    return {name: _shown(query) for name, query in {**LEDGER_QUERIES, **MATRIX_QUERIES}.items()}


def oracle_sql() -> dict[str, str]:
    return {**ledger_oracles(), **matrix_oracles()}
