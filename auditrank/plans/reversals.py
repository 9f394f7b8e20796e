"""Test 03: customers with a high volume of reversals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditrank import fixed_values as fv
from auditrank.functions.columns import (
    NUMERIC,
    flag,
    not_blank,
    safe_date,
    safe_numeric,
    sorted_list,
    strict_greatest,
    strict_least,
    valid_id,
)
from auditrank.operators.exclusion import without_excluded
from auditrank.operators.quantiles import discrete_quantiles
from auditrank.params import ReversalParams
from auditrank.session import stage
from auditrank.sources.tables import Ledger

# Sorts compare keys one after the other: the number that differs most comes first.
HEADER_KEY = ["BELNR", "GJAHR", "BUKRS", "MANDT"]
DOCUMENT_KEY = [
    "empresa",
    "id_cliente",
    "nome_cliente",
    "exercicio_documento",
    "documento",
    "documento_referenciado_estorno",
]
PAIR_KEY = [
    "empresa",
    "id_cliente",
    "nome_cliente",
    "exercicio_documento",
    "documento_par_a",
    "documento_par_b",
    "chave_par_estorno",
]


def active_customers(ledger: Ledger, p: ReversalParams) -> DataFrame:
    """Customers with postings in the period, one row per (id, name).

    The ledger is cut to distinct customer keys before the join, so a busy
    customer reaches the shuffle once per map task.
    """
    bseg = ledger.bseg
    rows = bseg.where(
        safe_date(bseg, "H_BUDAT").between(F.lit(p.period_from), F.lit(p.period_to))
        & valid_id("KUNNR", p.id_floor)
    )
    keys = without_excluded(rows, "KUNNR", p.excluded).select("MANDT", "KUNNR").distinct()
    return (
        keys.join(ledger.kna1.select("MANDT", "KUNNR", "NAME1"), ["MANDT", "KUNNR"])
        .select(F.col("KUNNR").alias("id_cliente"), F.col("NAME1").alias("nome_cliente"))
        .distinct()
    )


def _account_items(ledger: Ledger, p: ReversalParams) -> DataFrame:
    rows = ledger.bseg.where((F.col("HKONT") == p.account) & valid_id("KUNNR", p.id_floor))
    return without_excluded(rows, "KUNNR", p.excluded)


def _reversal_headers(ledger: Ledger, p: ReversalParams) -> DataFrame:
    """Headers marked as reversal that name the document they reverse.

    The period is that of the header's document date, not the posting date.
    """
    dated = safe_date(ledger.bkpf, "BLDAT")
    return ledger.bkpf.where(
        (F.col("XREVERSING") == p.reversal_mark)
        & not_blank(F.col("AWREF_REV"))
        & dated.between(F.lit(p.period_from), F.lit(p.period_to))
    ).select(*HEADER_KEY, dated.alias("data_documento"), "USNAM", "XREVERSING", "AWREF_REV")


def _named(items: DataFrame, ledger: Ledger) -> DataFrame:
    """Customer names; an item of an unknown customer keeps a NULL name."""
    names = ledger.kna1.select("MANDT", "KUNNR", F.col("NAME1").alias("nome_cliente"))
    return items.join(names, ["MANDT", "KUNNR"], "left")


def reversal_items(ledger: Ledger, p: ReversalParams) -> DataFrame:
    """Item-level evidence: every ledger item of a reversal document.

    Only headers that pass the filters can match, so the join is an inner one.
    """
    items = _account_items(ledger, p).select(
        *HEADER_KEY,
        "KUNNR",
        safe_date(ledger.bseg, "H_BLDAT").alias("data_lancamento"),
        "HKONT",
        "BUZEI",
        "SHKZG",
        safe_numeric(F.col("DMBTR")).alias("valor_parcela"),
    )
    return _named(items.join(_reversal_headers(ledger, p), HEADER_KEY), ledger).select(
        "MANDT",
        F.col("BUKRS").alias("empresa"),
        F.col("KUNNR").alias("id_cliente"),
        "nome_cliente",
        F.col("GJAHR").alias("exercicio_documento"),
        F.col("BELNR").alias("documento"),
        F.col("AWREF_REV").alias("documento_referenciado_estorno"),
        "data_documento",
        "data_lancamento",
        F.col("USNAM").alias("usuario"),
        F.col("XREVERSING").alias("flag_documento_estorno"),
        F.col("HKONT").alias("conta_contabil"),
        F.col("BUZEI").alias("item_documento"),
        F.col("SHKZG").alias("indicador_debito_credito"),
        "valor_parcela",
    )


def reversal_documents(items: DataFrame) -> DataFrame:
    """Items folded to documents, with the distinct item count (drill-down)."""
    return items.groupBy(*DOCUMENT_KEY).agg(
        F.min("data_documento").alias("data_documento"),
        F.min("data_lancamento").alias("data_lancamento"),
        sorted_list(F.col("usuario")).alias("usuarios_envolvidos"),
        F.count_distinct("item_documento").alias("qtd_itens_documento"),
        F.sum(F.abs("valor_parcela")).alias("valor_documento"),
    )


def reversal_document_values(ledger: Ledger, p: ReversalParams) -> DataFrame:
    """The documents without the item count, for the customer summary.

    Items are summed per document before the header join: the shuffle then
    carries one row per document and map task, also for a document that holds
    a large part of all items.  Sums, minima and user sets do not change when
    they are taken in two steps.
    """
    per_document = (
        _account_items(ledger, p)
        .groupBy("KUNNR", *HEADER_KEY)
        .agg(
            F.min(safe_date(ledger.bseg, "H_BLDAT")).alias("data_lancamento"),
            F.sum(F.abs(safe_numeric(F.col("DMBTR")))).alias("valor"),
        )
    )
    return (
        _named(per_document.join(_reversal_headers(ledger, p), HEADER_KEY), ledger)
        .groupBy(
            F.col("BELNR").alias("documento"),
            F.col("AWREF_REV").alias("documento_referenciado_estorno"),
            F.col("KUNNR").alias("id_cliente"),
            "nome_cliente",
            F.col("GJAHR").alias("exercicio_documento"),
            F.col("BUKRS").alias("empresa"),
        )
        .agg(
            F.min("data_documento").alias("data_documento"),
            F.min("data_lancamento").alias("data_lancamento"),
            sorted_list(F.col("USNAM")).alias("usuarios_envolvidos"),
            F.sum("valor").alias("valor_documento"),
        )
    )


def normalised_pairs(documents: DataFrame) -> DataFrame:
    """Unordered pair of documents, so A→B and B→A share one key."""
    document = F.col("documento")
    referenced = F.col("documento_referenciado_estorno")
    low, high = strict_least(document, referenced), strict_greatest(document, referenced)
    bar = F.lit("|")
    return documents.select(
        "*",
        low.alias("documento_par_a"),
        high.alias("documento_par_b"),
        F.concat("empresa", bar, "exercicio_documento", bar, low, bar, high).alias("chave_par_estorno"),
    )


def unique_reversals(pairs: DataFrame) -> DataFrame:
    """One row per pair; its value is the larger leg, not the sum of legs.

    Company and fiscal year belong to the key, so a reversal that crosses
    years stays two one-leg pairs.
    """
    legs = F.size(F.collect_set("documento"))
    value = F.col("valor_documento")
    # The later document differs most, so a sort of the keys starts with it.
    unique = pairs.groupBy("documento_par_b", *[c for c in PAIR_KEY if c != "documento_par_b"]).agg(
        F.min("data_documento").alias("data_primeiro_registro"),
        F.max("data_documento").alias("data_ultimo_registro"),
        sorted_list(F.col("documento")).alias("documentos_encontrados"),
        sorted_list(F.col("documento_referenciado_estorno")).alias("documentos_referenciados"),
        sorted_list(F.col("usuarios_envolvidos")).alias("usuarios_envolvidos"),
        legs.cast("bigint").alias("qtd_pernas_encontradas"),
        F.max(value).alias("valor_estorno_sem_duplicidade"),
        F.sum(value).alias("valor_somado_das_pernas"),
        F.min(value).alias("menor_valor_perna"),
        F.max(value).alias("maior_valor_perna"),
        F.abs(F.max(value) - F.min(value)).alias("diferenca_valor_entre_pernas"),
        F.when(legs == 2, fv.TWO_LEGS)
        .when(legs == 1, fv.ONE_LEG)
        .otherwise(fv.UNCLASSIFIED)
        .alias("status_relacao_estorno"),
    )
    return unique.select(*PAIR_KEY, *unique.columns[len(PAIR_KEY) :])


def customer_summary(unique: DataFrame) -> DataFrame:
    """Pairs folded to customers, in three folds with plain counts.

    A pair appears once per customer name, so its value counts per name and
    its key once.  The first fold leaves a row per (customer, key), the second
    one per (customer, users text), where the first text of a key stands for the
    key; their rows are what the distinct counts count.  No row is expanded, and
    a customer with very many pairs reaches each shuffle once per map task and
    fold key.
    """
    value = F.col("valor_estorno_sem_duplicidade")
    status = F.col("status_relacao_estorno")
    per_key = unique.groupBy("id_cliente", "chave_par_estorno").agg(
        F.max("nome_cliente").alias("nome"),
        F.collect_set("empresa").alias("empresas"),  # one company: it is part of the key
        F.collect_set("usuarios_envolvidos").alias("textos"),  # one per customer name
        F.sum(value).alias("total"),
        F.max(value).alias("maior"),
        F.min("data_primeiro_registro").alias("primeiro"),
        F.max("data_ultimo_registro").alias("ultimo"),
        F.count_if(status == fv.TWO_LEGS).alias("duas"),
        F.count_if(status == fv.ONE_LEG).alias("uma"),
    )
    first = F.coalesce("lugar", F.lit(0)) == 0
    per_text = (
        per_key.select("*", F.posexplode_outer("textos").alias("lugar", "texto"))
        .groupBy("id_cliente", "texto")
        .agg(
            F.max("nome").alias("nome"),
            F.array_distinct(F.flatten(F.collect_set("empresas"))).alias("empresas"),
            F.count_if(first & F.col("chave_par_estorno").isNotNull()).alias("chaves"),
            F.sum(F.when(first, F.col("total"))).alias("total"),
            F.max("maior").alias("maior"),
            F.min("primeiro").alias("primeiro"),
            F.max("ultimo").alias("ultimo"),
            F.sum(F.when(first, F.col("duas")).otherwise(0)).alias("duas"),
            F.sum(F.when(first, F.col("uma")).otherwise(0)).alias("uma"),
        )
    )
    companies = F.array_distinct(F.flatten(F.collect_set("empresas")))
    return per_text.groupBy("id_cliente").agg(
        F.max("nome").alias("nome_cliente"),
        F.when(F.size(companies) > 0, F.array_join(F.array_sort(companies), ", ")).alias("empresas_com_estorno"),
        F.sum("chaves").alias("qtd_estornos_cliente"),
        F.sum("total").alias("valor_total_estornos_cliente"),
        F.max("maior").alias("maior_valor_estorno_cliente"),
        F.min("primeiro").alias("data_primeiro_estorno_cliente"),
        F.max("ultimo").alias("data_ultimo_estorno_cliente"),
        F.count("texto").alias("qtd_usuarios_estorno"),
        F.sum("duas").alias("qtd_estornos_duas_pernas_localizadas"),
        F.sum("uma").alias("qtd_estornos_uma_perna_localizada"),
    )


def thresholds(summary: DataFrame, p: ReversalParams) -> DataFrame:
    """One row with the exact p75 and p90 of count and value; zeros if no reversal.

    Runs jobs over ``summary``, which should be a written table.
    """
    count, value = "qtd_estornos_cliente", "valor_total_estornos_cliente"
    numbers = summary.where(F.col(count) > 0).select(F.col(count).cast(NUMERIC), F.col(value).cast(NUMERIC))
    cuts = discrete_quantiles(numbers, [count, value], [0.75, 0.90], p.accuracy)
    limits = {
        "qtd_estornos_p75": (cuts[count][0.75], "bigint"),
        "qtd_estornos_p90": (cuts[count][0.90], "bigint"),
        "valor_estornos_p75": (cuts[value][0.75], NUMERIC),
        "valor_estornos_p90": (cuts[value][0.90], NUMERIC),
    }
    return summary.sparkSession.range(1).select(
        *(F.lit(limit or 0).cast(dtype).alias(name) for name, (limit, dtype) in limits.items())
    )


def threshold_flags(customers: DataFrame, summary: DataFrame, limits: DataFrame) -> DataFrame:
    """Evidence per customer and four flags; every customer is kept.

    ``limits`` is exactly one row; its values are scalars, for which no join is planned.
    """
    evidence = summary.drop("nome_cliente")
    joined = customers.join(evidence, "id_cliente", "left").withColumns(
        {name: limits.select(name).scalar() for name in limits.columns}
    )
    zero = F.lit(0).cast("bigint")
    count = F.coalesce("qtd_estornos_cliente", zero)
    value = F.coalesce("valor_total_estornos_cliente", F.lit(0).cast(NUMERIC))

    def reaches(amount: Column, limit: str) -> Column:
        return flag((amount > 0) & (amount >= F.col(limit)))

    return joined.select(
        "id_cliente",
        "nome_cliente",
        F.coalesce("empresas_com_estorno", F.lit(fv.NO_OCCURRENCE)).alias("empresas_com_estorno"),
        count.alias("qtd_estornos_cliente"),
        value.alias("valor_total_estornos_cliente"),
        F.coalesce("maior_valor_estorno_cliente", F.lit(0).cast(NUMERIC)).alias("maior_valor_estorno_cliente"),
        "data_primeiro_estorno_cliente",
        "data_ultimo_estorno_cliente",
        *(
            F.coalesce(name, zero).alias(name)
            for name in (
                "qtd_usuarios_estorno",
                "qtd_estornos_duas_pernas_localizadas",
                "qtd_estornos_uma_perna_localizada",
            )
        ),
        "qtd_estornos_p75",
        "qtd_estornos_p90",
        "valor_estornos_p75",
        "valor_estornos_p90",
        reaches(count, "qtd_estornos_p75").alias("flag_alta_quantidade_estornos"),
        reaches(value, "valor_estornos_p75").alias("flag_alto_valor_estornos"),
        reaches(count, "qtd_estornos_p90").alias("flag_quantidade_estornos_muito_alta"),
        reaches(value, "valor_estornos_p90").alias("flag_valor_estornos_muito_alto"),
    )


def scored(flags: DataFrame) -> DataFrame:
    high = (F.col("flag_alta_quantidade_estornos") == 1) | (F.col("flag_alto_valor_estornos") == 1)
    very_high = (F.col("flag_quantidade_estornos_muito_alta") == 1) | (
        F.col("flag_valor_estornos_muito_alto") == 1
    )
    return flags.select(
        "*",
        flag(high).alias(fv.TEST_03_FLAG),
        F.when(very_high, 2).when(high, 1).otherwise(0).alias("criticidade_teste_03"),
        F.when(very_high, fv.HIGH_RISK)
        .when(high, fv.MODERATE_RISK)
        .when(F.col("qtd_estornos_cliente") > 0, fv.BELOW_VOLUME)
        .otherwise(fv.NO_OCCURRENCE)
        .alias("nivel_risco_teste_03"),
        F.when(very_high, 3).when(high, 2).otherwise(0).alias("score_teste_03"),
        F.lit(fv.EXPECTED_IMPACT).alias("impacto_esperado_teste_03"),
    )


def summarised(ledger: Ledger, p: ReversalParams) -> DataFrame:
    """Ledger to customer summary."""
    return customer_summary(unique_reversals(normalised_pairs(reversal_document_values(ledger, p))))


def high_reversal_volume(ledger: Ledger, p: ReversalParams = ReversalParams()) -> DataFrame:
    """Test 03 end to end.

    The summary feeds both the thresholds and the flags, so it is written once
    and read twice; the ledger is not scanned again for it.
    """
    summary = stage(summarised(ledger, p), "reversal-summary")
    return scored(threshold_flags(active_customers(ledger, p), summary, thresholds(summary, p)))


def for_review(result: DataFrame) -> DataFrame:
    """Order of the review list; sort only when the list leaves Spark."""
    return result.orderBy(
        F.desc(fv.TEST_03_FLAG),
        F.desc("criticidade_teste_03"),
        F.desc("valor_total_estornos_cliente"),
        F.desc("qtd_estornos_cliente"),
    )
