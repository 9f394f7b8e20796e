"""Test 05: titles whose due date is extended repeatedly (rule inferred)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditrank.functions.columns import flag, safe_date, safe_numeric, valid_id
from auditrank.operators.exclusion import without_excluded
from auditrank.operators.ordering import with_previous
from auditrank.params import ExtensionParams

# The sort of the versions compares these one after the other: those that differ most first.
TITLE = ["documento", "item_documento", "id_cliente", "centro", "exercicio"]


def extended_titles(changes: DataFrame, p: ExtensionParams) -> DataFrame:
    """Titles with at least one later due date, from a due-date change log.

    The log has columns KUNNR, BUKRS, BELNR, GJAHR, BUZEI, VERSION (orders the
    versions of a title), NETDT and DMBTR.
    """
    # The largest of numbers that fit a long is taken before they are widened.
    amount = changes.schema["DMBTR"].dataType
    narrow = isinstance(amount, T.DecimalType) and amount.precision <= 18
    rows = without_excluded(changes.where(valid_id("KUNNR", p.id_floor)), "KUNNR", p.excluded).select(
        F.col("KUNNR").alias("id_cliente"),
        F.col("BUKRS").alias("centro"),
        F.col("BELNR").alias("documento"),
        F.col("GJAHR").alias("exercicio"),
        F.col("BUZEI").alias("item_documento"),
        F.col("VERSION").alias("versao"),
        safe_date(changes, "NETDT").alias("vencimento"),
        (F.col("DMBTR") if narrow else safe_numeric(F.col("DMBTR"))).alias("valor"),
    )
    days = F.datediff("vencimento", "vencimento_anterior")
    extended = F.when(days > 0, days)
    return (
        with_previous(rows, TITLE, ["versao"], "vencimento", "vencimento_anterior")
        .groupBy(*TITLE)
        .agg(
            F.count(extended).alias("prorrogacoes"),
            F.sum(extended).alias("dias"),
            F.max(extended).alias("maior_dias"),
            safe_numeric(F.max("valor")).alias("valor"),
        )
        .where(F.col("prorrogacoes") > 0)
    )


def repeated_extensions(changes: DataFrame, p: ExtensionParams = ExtensionParams()) -> DataFrame:
    most = F.col("_most")
    return (
        extended_titles(changes, p)
        .groupBy("id_cliente")
        .agg(
            F.count("*").alias("qtd_titulos_prorrogados_cliente"),
            F.sum("prorrogacoes").alias("qtd_prorrogacoes_cliente"),
            F.sum("valor").alias("valor_total_titulos_prorrogados"),
            F.max("valor").alias("maior_valor_titulo_prorrogado"),
            F.sum("dias").alias("dias_prorrogados_total_cliente"),
            F.max("dias").alias("maior_dias_prorrogados_mesmo_titulo"),
            F.max("maior_dias").alias("maior_prorrogacao_individual_dias"),
            F.max("prorrogacoes").alias("_most"),
        )
        .select(
            "*",
            flag(most >= p.min_extensions).alias("teste_05"),
            F.when(most >= p.high_extensions, 2)
            .when(most >= p.min_extensions, 1)
            .otherwise(0)
            .alias("criticidade_teste_05"),
            F.when(most >= p.high_extensions, 3)
            .when(most >= p.min_extensions, 2)
            .otherwise(0)
            .alias("score_teste_05"),
        )
        .drop("_most")
    )
