"""One row per customer from a matrix with several, ruled by column names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY = "id_cliente"
ROWS = "qtd_linhas_consolidadas"

# Name parts that choose the aggregate.
MAX_PREFIXES = ("teste_", "criticidade_", "score_", "qtd_", "valor_", "saldo_", "maior_")
MAX_PARTS = ("perc", "dias")
FIRST_PARTS = ("nivel", "status")
OLD_MODEL_PARTS = ("iforest", "isolation_forest")
OLD_MODEL_COLUMNS = ("pca_1", "pca_2")


def checked_input(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a usable key (as trimmed text), and the rejected rest.

    A missing or blank key is no customer; such rows are kept apart instead of
    being merged into one.
    """
    if KEY not in df.columns:
        raise ValueError(f"the matrix has no column {KEY}")
    keyed = df.withColumn(KEY, F.trim(F.col(KEY).cast("string")))
    usable = F.coalesce(F.col(KEY) != "", F.lit(False))
    return keyed.where(usable), keyed.where(~usable)


def input_checks(df: DataFrame) -> DataFrame:
    """Row, key and surplus counts of a matrix, as one row."""
    keyed = df.select(F.trim(F.col(KEY).cast("string")).alias("k"))
    per_key = keyed.groupBy("k").agg(F.count("*").alias("n"))
    usable = F.coalesce(F.col("k") != "", F.lit(False))
    rows = F.coalesce(F.sum(F.when(usable, F.col("n"))), F.lit(0))
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("linhas_originais"),
        F.coalesce(F.sum(F.when(F.col("k").isNull(), F.col("n"))), F.lit(0)).alias("linhas_id_nulo"),
        F.coalesce(F.sum(F.when(F.col("k") == "", F.col("n"))), F.lit(0)).alias("linhas_id_em_branco"),
        F.count_if(usable).alias("clientes_unicos"),
        (rows - F.count_if(usable)).alias("linhas_duplicadas"),
    )


def without_old_model(df: DataFrame) -> DataFrame:
    """Drop the output columns of earlier model runs."""
    old = [
        c
        for c in df.columns
        if c in OLD_MODEL_COLUMNS or any(part in c.lower() for part in OLD_MODEL_PARTS)
    ]
    return df.drop(*old)


def takes_max(field: T.StructField) -> bool:
    """Whether repeated values of a column are folded by maximum.

    Otherwise the first non-null one is kept.  Repeated rows are copies, not
    parts, so nothing is summed.
    """
    name = field.name
    if name == "nome_cliente":
        return False
    if name.startswith(MAX_PREFIXES) or any(p in name.lower() for p in MAX_PARTS):
        return True
    if any(p in name.lower() for p in FIRST_PARTS):
        return False
    return isinstance(field.dataType, T.NumericType)


def _first_non_null(column: Column, order: str | None) -> Column:
    """First non-null value in input order; without an order, the smallest."""
    if order is None:
        return F.min(column)
    return F.min_by(column, F.when(column.isNotNull(), F.col(order)))


def consolidate(df: DataFrame, order: str | None = None) -> DataFrame:
    """One row per customer and the number of rows behind it.

    Every aggregate combines before the shuffle, so a customer with very many
    rows reaches it once per map task.  ``order`` names a column with the input
    order of the rows; it does not appear in the result.
    """
    base = without_old_model(df).drop(ROWS)
    fields = [f for f in base.schema if f.name not in (KEY, order)]
    folded = [
        (F.max(f.name) if takes_max(f) else _first_non_null(F.col(f.name), order)).alias(f.name)
        for f in fields
    ]
    return base.groupBy(KEY).agg(*folded, F.count("*").alias(ROWS))
