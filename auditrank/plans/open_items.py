"""Tests 01 and 04: overdue open items, and concentration of open balance.

The method names these tests and their output columns but not their rules; the
rules here are inferred and held in :class:`OpenItemParams`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditrank.functions.columns import due_date, flag, safe_date, safe_numeric, valid_id
from auditrank.operators.exclusion import without_excluded
from auditrank.params import OpenItemParams
from auditrank.plans.levels import with_percentile_levels
from auditrank.session import stage
from auditrank.sources.tables import Ledger


def open_items(ledger: Ledger, p: OpenItemParams, centre: str = "BUKRS") -> DataFrame:
    """Debit items not settled, with days past due at the reference date."""
    bseg = ledger.bseg
    rows = bseg.where(
        (F.col("SHKZG") == p.debit_credit)
        & safe_date(bseg, "AUGDT").isNull()
        & (safe_date(bseg, "H_BUDAT") <= F.lit(p.reference_date))
        & valid_id("KUNNR", p.id_floor)
    )
    due = due_date(bseg, "NETDT", "H_BUDAT", "ZBD1T")
    return without_excluded(rows, "KUNNR", p.excluded).select(
        F.col("KUNNR").alias("id_cliente"),
        F.col(centre).alias("centro"),
        F.datediff(F.lit(p.reference_date), due).alias("dias_vencido"),
        safe_numeric(F.col("DMBTR")).alias("valor"),
    )


def overdue_open_items(ledger: Ledger, p: OpenItemParams = OpenItemParams()) -> DataFrame:
    """Test 01: customers with items open longer than the limit."""
    longest = F.col("maior_dias_vencido_teste_01")
    return (
        open_items(ledger, p)
        .where(F.col("dias_vencido") > p.min_days)
        .groupBy("id_cliente")
        .agg(
            F.count("*").alias("qtd_titulos_vencidos_abertos_30d"),
            F.sum("valor").alias("valor_total_titulos_vencidos_abertos_30d"),
            F.max("dias_vencido").alias("maior_dias_vencido_teste_01"),
        )
        .select(
            "*",
            F.lit(1).alias("teste_01"),
            F.when(longest > p.high_days, 2).otherwise(1).alias("criticidade_teste_01"),
            F.when(longest > p.high_days, 3).otherwise(2).alias("score_teste_01"),
        )
    )


def open_balance_concentration(
    ledger: Ledger, p: OpenItemParams = OpenItemParams(), centre: str = "BUKRS"
) -> DataFrame:
    """Test 04: share of a centre's open balance held by one customer.

    Centre totals come from an aggregate joined back, not from a window over
    the centre, which would put a whole centre into one task.  The percentile
    cuts use all customers with a positive share.
    """
    balances = (
        open_items(ledger, p, centre)
        .groupBy("id_cliente", "centro")
        .agg(F.count("*").alias("titulos"), F.sum("valor").alias("saldo"))
    )
    balances = stage(balances, "open-balances")  # read twice
    centres = balances.groupBy("centro").agg(F.sum("saldo").alias("saldo_centro"))
    share = F.when(
        F.col("saldo_centro") > 0, F.col("saldo").cast("double") / F.col("saldo_centro").cast("double")
    ).otherwise(F.lit(0.0))
    per_customer = (
        balances.join(centres, "centro")
        .groupBy("id_cliente")
        .agg(
            F.sum("titulos").alias("qtd_titulos_abertos_cliente"),
            F.sum("saldo").alias("saldo_total_aberto_cliente"),
            F.max("saldo").alias("maior_saldo_aberto_em_um_centro"),
            F.max(share).alias("maior_perc_cliente_sobre_centro"),
        )
    )
    return with_percentile_levels(per_customer, "maior_perc_cliente_sobre_centro", "04", p.accuracy)
