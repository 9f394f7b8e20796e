"""Turn text columns into numbers, choosing the notation per column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditrank.functions.columns import brazilian_number, number_or_null, plain_number

# Fixed value: share of values that must read as plain numbers.
PLAIN_SHARE = 0.95


def brazilian_columns(df: DataFrame, columns: Sequence[str]) -> set[str]:
    """Text columns better read as Brazilian numbers; one job for all.

    A column stays plain if 95 % of its non-null values parse so; else the
    notation that parses more values wins, and plain wins a tie.
    """
    texts = [c for c in columns if isinstance(df.schema[c].dataType, T.StringType)]
    if not texts:
        return set()
    counts = df.agg(
        *(
            F.struct(
                F.count(c).alias("given"),
                F.count(plain_number(F.col(c))).alias("plain"),
                F.count(brazilian_number(F.col(c))).alias("brazilian"),
            ).alias(c)
            for c in texts
        )
    ).first()
    return {
        c
        for c in texts
        if counts[c].plain < PLAIN_SHARE * counts[c].given and counts[c].brazilian > counts[c].plain
    }


def as_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` with the given columns as doubles."""
    brazilian = brazilian_columns(df, columns)
    return df.withColumns(
        {c: brazilian_number(F.col(c)) if c in brazilian else number_or_null(df, c) for c in columns}
    )
