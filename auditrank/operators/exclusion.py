"""Drop excluded customers."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditrank.params import Excluded


def without_excluded(df: DataFrame, key: str, excluded: Excluded) -> DataFrame:
    """Rows whose ``key`` is not excluded, by the rule of SQL's NOT IN.

    A list of any length and a table give the same rows: with at least one
    excluded id a row without a key goes as well, with none every row stays.  A
    NULL in the list would empty a NOT IN, so a list holding one is refused and
    NULLs of a table are left out.
    """
    if isinstance(excluded, DataFrame):
        # Each id once: a table that repeats few ids is then small enough to be broadcast,
        # and no task of the join has to sort the rows of a common id.
        ids = excluded.select(F.col(excluded.columns[0]).alias(key)).where(F.col(key).isNotNull()).distinct()
        nothing = ids.limit(1).agg(F.count("*") == 0).scalar()
        return df.where(F.col(key).isNotNull() | nothing).join(ids, key, "left_anti")
    ids = list(excluded)
    if any(i is None for i in ids):
        raise ValueError("the exclusion list must not hold NULL")
    if not ids:
        return df
    # An Arrow table becomes a local relation, whose size Spark knows: a list that is
    # small enough is broadcast by Spark's own rule and the rows stay where they are.
    listed = df.sparkSession.createDataFrame(pa.table({key: pa.array(ids)}))
    listed = listed.select(F.col(key).cast(df.schema[key].dataType).alias(key))
    return df.where(F.col(key).isNotNull()).join(listed, key, "left_anti")
