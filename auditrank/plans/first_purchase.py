"""Test 02: customers in default on their first purchase."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditrank import fixed_values as fv
from auditrank.functions.columns import due_date, flag, safe_date, safe_numeric, valid_id
from auditrank.operators.exclusion import without_excluded
from auditrank.params import FirstPurchaseParams
from auditrank.sources.tables import Ledger


def registered_customers(ledger: Ledger, p: FirstPurchaseParams) -> DataFrame:
    """Customers registered in the period, one row per (id, name, date)."""
    registered = safe_date(ledger.kna1, "ERDAT")
    rows = ledger.kna1.where(
        valid_id("KUNNR", p.id_floor) & registered.between(F.lit(p.registered_from), F.lit(p.registered_to))
    )
    return (
        without_excluded(rows, "KUNNR", p.excluded)
        .select(
            F.col("KUNNR").alias("id_cliente"),
            F.col("NAME1").alias("nome_cliente"),
            registered.alias("data_cadastro"),
        )
        .distinct()
    )


def sales_titles(ledger: Ledger, p: FirstPurchaseParams) -> DataFrame:
    """Invoice items posted in the period, with their due date."""
    bseg = ledger.bseg
    posted = safe_date(bseg, "H_BUDAT")
    rows = bseg.where(
        (F.col("ZLSCH") == p.payment_method)
        & (F.col("H_BLART") == p.document_type)
        & (F.col("SHKZG") == p.debit_credit)
        & posted.between(F.lit(p.posted_from), F.lit(p.posted_to))
        & valid_id("KUNNR", p.id_floor)
    )
    return without_excluded(rows, "KUNNR", p.excluded).select(
        F.col("BUKRS").alias("centro"),
        F.col("KUNNR").alias("id_cliente"),
        F.col("BELNR").alias("documento"),
        F.col("GJAHR").alias("exercicio"),
        F.col("BUZEI").alias("item_documento"),
        posted.alias("data_lancamento"),
        due_date(bseg, "NETDT", "H_BUDAT", "ZBD1T").alias("data_vencimento"),
        safe_date(bseg, "AUGDT").alias("data_compensacao"),
        F.col("ZLSCH").alias("forma_pagamento"),
        F.col("H_BLART").alias("tipo_documento"),
        F.col("SHKZG").alias("indicador_debito_credito"),
        safe_numeric(F.col("DMBTR")).alias("valor_titulo"),
    )


def first_purchases(titles: DataFrame) -> DataFrame:
    """Earliest title of each customer within the period.

    Catalyst turns the filter into a group limit before and after the shuffle:
    each map task sends at most one title per customer, however many a single
    customer has.  Company and year settle ties between companies that reuse a
    document number.
    """
    order = Window.partitionBy("id_cliente").orderBy(
        "data_lancamento", "documento", "item_documento", "centro", "exercicio"
    )
    return titles.withColumn("ordem_compra", F.row_number().over(order)).where(F.col("ordem_compra") == 1)


def evaluated(first: DataFrame, p: FirstPurchaseParams) -> DataFrame:
    """Settlement status, days late and class of each first purchase."""
    is_open = F.col("data_compensacao").isNull()
    days_late = F.datediff(F.coalesce("data_compensacao", F.lit(p.reference_date)), "data_vencimento")
    late = days_late > 0
    kind = (
        F.when(is_open & late, fv.OPEN_OVERDUE)
        .when(is_open & ~late, fv.OPEN_NOT_DUE)
        .when(late, fv.SETTLED_LATE)
        .when(~late, fv.SETTLED_ON_TIME)
        .otherwise(fv.UNCLASSIFIED)
    )
    return first.select(
        "centro",
        "id_cliente",
        F.col("documento").alias("documento_primeira_compra"),
        F.col("exercicio").alias("exercicio_primeira_compra"),
        F.col("item_documento").alias("item_primeira_compra"),
        F.col("data_lancamento").alias("data_primeira_compra"),
        F.col("data_vencimento").alias("data_vencimento_primeira_compra"),
        F.col("data_compensacao").alias("data_compensacao_primeira_compra"),
        "forma_pagamento",
        "tipo_documento",
        "indicador_debito_credito",
        F.col("valor_titulo").alias("valor_primeira_compra"),
        F.when(is_open, fv.OPEN).otherwise(fv.SETTLED).alias("status_compensacao_primeira_compra"),
        days_late.alias("dias_atraso_primeira_compra"),
        kind.alias("classificacao_primeira_compra"),
    )


def scored(customers: DataFrame, evaluation: DataFrame) -> DataFrame:
    """Flag, criticality, level and score; customers without purchase stay."""
    kind = F.col("classificacao_primeira_compra")
    late = kind == fv.SETTLED_LATE
    overdue = kind == fv.OPEN_OVERDUE
    fine = kind.isin(fv.SETTLED_ON_TIME, fv.OPEN_NOT_DUE)
    return customers.join(evaluation, "id_cliente", "left").select(
        "id_cliente",
        "nome_cliente",
        "data_cadastro",
        "centro",
        "documento_primeira_compra",
        "exercicio_primeira_compra",
        "item_primeira_compra",
        "data_primeira_compra",
        "data_vencimento_primeira_compra",
        "data_compensacao_primeira_compra",
        "forma_pagamento",
        "tipo_documento",
        "indicador_debito_credito",
        "status_compensacao_primeira_compra",
        F.coalesce(kind, F.lit(fv.NO_FIRST_PURCHASE)).alias("classificacao_primeira_compra"),
        F.coalesce("valor_primeira_compra", F.lit(0).cast("decimal(38,9)")).alias("valor_primeira_compra"),
        F.coalesce("dias_atraso_primeira_compra", F.lit(0)).alias("dias_atraso_primeira_compra"),
        flag(late | overdue).alias(fv.TEST_02_FLAG),
        flag(late).alias("flag_primeira_compra_compensada_com_atraso"),
        flag(overdue).alias("flag_primeira_compra_em_aberto_vencida"),
        F.when(overdue, 2).when(late, 1).otherwise(0).alias("criticidade_teste_02"),
        F.when(fine, fv.NO_RISK)
        .when(late, fv.MODERATE_RISK)
        .when(overdue, fv.HIGH_RISK)
        .otherwise(fv.NO_CLASS)
        .alias("nivel_risco_teste_02"),
        F.when(overdue, 3).when(late, 2).otherwise(0).alias("score_teste_02"),
        F.lit(fv.EXPECTED_IMPACT).alias("impacto_esperado_teste_02"),
    )


def first_purchase_default(ledger: Ledger, p: FirstPurchaseParams = FirstPurchaseParams()) -> DataFrame:
    evaluation = evaluated(first_purchases(sales_titles(ledger, p)), p)
    return scored(registered_customers(ledger, p), evaluation)


def for_review(result: DataFrame) -> DataFrame:
    """Order of the review list; sort only when the list leaves Spark."""
    return result.orderBy(
        F.desc(fv.TEST_02_FLAG),
        F.desc("criticidade_teste_02"),
        F.desc("dias_atraso_primeira_compra"),
        F.desc("valor_primeira_compra"),
    )
