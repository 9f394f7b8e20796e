"""Test 06: high share of returned sales (rule inferred)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditrank.functions.columns import NUMERIC, safe_date, safe_numeric, valid_id
from auditrank.operators.exclusion import without_excluded
from auditrank.params import ReturnParams
from auditrank.plans.levels import with_percentile_levels
from auditrank.sources.tables import Ledger


def high_return_share(ledger: Ledger, p: ReturnParams = ReturnParams()) -> DataFrame:
    """Returned over invoiced value per customer; 0 where nothing is invoiced.

    Items are folded to documents first, which makes the document counts plain
    counts.
    """
    bseg = ledger.bseg
    rows = bseg.where(
        (F.col("H_BLART") == p.document_type)
        & safe_date(bseg, "H_BUDAT").between(F.lit(p.period_from), F.lit(p.period_to))
        & valid_id("KUNNR", p.id_floor)
    )
    invoiced = F.col("SHKZG") == p.debit_credit
    documents = (
        without_excluded(rows, "KUNNR", p.excluded)
        .groupBy("KUNNR", "MANDT", "BUKRS", "BELNR", "GJAHR", invoiced.alias("faturado"))
        .agg(F.sum(safe_numeric(F.col("DMBTR"))).alias("valor"))
    )
    zero = F.lit(0).cast(NUMERIC)
    per_customer = documents.groupBy(F.col("KUNNR").alias("id_cliente")).agg(
        F.count_if("faturado").alias("qtd_notas_faturadas_cliente"),
        F.count_if(~F.col("faturado")).alias("qtd_notas_devolucao_cliente"),
        F.coalesce(F.sum(F.when(F.col("faturado"), F.col("valor"))), zero).alias("valor_total_faturado_cliente"),
        F.coalesce(F.sum(F.when(~F.col("faturado"), F.col("valor"))), zero).alias("valor_total_devolvido_cliente"),
    )
    sold = F.col("valor_total_faturado_cliente").cast("double")
    returned = F.col("valor_total_devolvido_cliente").cast("double")
    share = F.when(sold > 0, returned / sold).otherwise(F.lit(0.0))
    return with_percentile_levels(
        per_customer.withColumn("perc_devolucao_sobre_faturamento", share),
        "perc_devolucao_sobre_faturamento",
        "06",
        p.accuracy,
    )
