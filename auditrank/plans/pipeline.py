"""From ledger, or from a delimited matrix, to scored customers and reports."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from auditrank import params
from auditrank.operators.consolidate import KEY, checked_input, consolidate, without_old_model
from auditrank.operators.features import median_table
from auditrank.operators.numbers import as_numbers
from auditrank.operators.pca import variance_table
from auditrank.plans import extensions, first_purchase, matrix, open_items, reports, returns, reversals
from auditrank.plans.model import ModelRun, ModelSettings, run_model
from auditrank.plans.stability import stability
from auditrank.session import stage
from auditrank.sources.delimited import ROW_ORDER, read_delimited, typed
from auditrank.sources.sinks import write_csv, write_parquet, write_reports
from auditrank.sources.tables import Ledger

# Columns whose values the consolidation folds by maximum and that a delimited
# file may hold as Brazilian numbers.
_AMOUNT_PREFIXES = ("valor_", "saldo_", "maior_", "qtd_", "score_", "criticidade_", "teste_")


@dataclass(frozen=True)
class AuditParams:
    overdue: params.OpenItemParams = field(default_factory=params.OpenItemParams)
    first_purchase: params.FirstPurchaseParams = field(default_factory=params.FirstPurchaseParams)
    reversals: params.ReversalParams = field(default_factory=params.ReversalParams)
    concentration: params.OpenItemParams = field(default_factory=params.OpenItemParams)
    centre: str = "BUKRS"
    extensions: params.ExtensionParams = field(default_factory=params.ExtensionParams)
    returns: params.ReturnParams = field(default_factory=params.ReturnParams)


def all_tests(ledger: Ledger, changes: DataFrame | None, p: AuditParams) -> dict[str, DataFrame]:
    """Results of the six tests; without a due-date log, of five."""
    results = {
        "teste_01": open_items.overdue_open_items(ledger, p.overdue),
        "teste_02": first_purchase.first_purchase_default(ledger, p.first_purchase),
        "teste_03": reversals.high_reversal_volume(ledger, p.reversals),
        "teste_04": open_items.open_balance_concentration(ledger, p.concentration, p.centre),
        "teste_06": returns.high_return_share(ledger, p.returns),
    }
    if changes is not None:
        results["teste_05"] = extensions.repeated_extensions(changes, p.extensions)
    return results


def matrix_from_file(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Consolidated matrix from a delimited file, and the rejected rows.

    Numbers in Brazilian notation are read before the consolidation: taking
    the maximum of their texts first would pick the wrong one.
    """
    rows = stage(typed(read_delimited(spark, path)), "matrix-file")
    usable, rejected = checked_input(without_old_model(rows))
    amounts = [c for c in usable.columns if c.startswith(_AMOUNT_PREFIXES) or "perc" in c.lower() or "dias" in c.lower()]
    return consolidate(as_numbers(usable, amounts), ROW_ORDER), rejected


def matrix_from_ledger(ledger: Ledger, changes: DataFrame | None, p: AuditParams) -> tuple[DataFrame, DataFrame]:
    """Consolidated matrix from the ledger, and the rejected rows."""
    rows = stage(matrix.assembled(all_tests(ledger, changes, p)), "matrix-ledger")
    usable, rejected = checked_input(rows)
    return consolidate(usable), rejected


def report_tables(run: ModelRun, with_stability: bool = False) -> dict[str, DataFrame | None]:
    """All report tables by name; the stability study is off by default."""
    summary = reports.summary_by_test(run.matrix)
    correlation = reports.correlation_of_tests(run.matrix)
    has_pca = run.components is not None
    return {
        "resumo_geral": reports.run_summary(run.matrix, len(run.stats.medians), run.settings),
        "resumo_testes": summary,
        "estatistica_descritiva": reports.described(run.matrix),
        "correlacao_testes": reports.correlation_matrix(correlation),
        "top_100_clientes": reports.top_customers(run.matrix),
        "medianas_imputacao": median_table(run.matrix, run.stats),
        "sensibilidade_contaminacao": reports.sensitivity(run.matrix),
        "pca": variance_table(run.matrix, run.components) if has_pca else None,
        "estabilidade_hiperparametros": (
            stability(run.matrix, run.features, run.stats.variables, seed=run.settings.forest.seed) if with_stability else None
        ),
        "grafico_clientes_por_teste": reports.flag_counts(summary),
        "grafico_scores": reports.score_pairs(run.matrix),
        "grafico_pca": reports.pca_sample(run.matrix) if has_pca else None,
        "grafico_correlacao": correlation,
    }


def _write_rejected(rejected: DataFrame, path: str) -> DataFrame:
    """Write the rows left out; one row of counts by reason, taken while writing."""
    seen = Observation()
    reasons = {
        "linhas_originais": F.count(F.lit(1)),
        "linhas_id_nulo": F.count_if(F.col(KEY).isNull()),
        "linhas_id_em_branco": F.count_if(F.col(KEY) == ""),
    }
    write_parquet(rejected.observe(seen, *(count.alias(name) for name, count in reasons.items())), path)
    # A plan that Spark finds to be empty before it runs has nothing to observe.
    counts = {name: seen.get.get(name, 0) for name in reasons}
    return rejected.sparkSession.range(1).select(*(F.lit(n).cast("long").alias(name) for name, n in counts.items()))


def write_run(
    consolidated: DataFrame,
    folder: str,
    settings: ModelSettings,
    with_stability: bool = False,
    rejected: DataFrame | None = None,
) -> list[str]:
    """Write a consolidated matrix, score it, and write the scored matrix and all
    reports; with ``rejected``, also the rows left out and their counts.

    Each matrix is written first and what follows reads it back.
    """
    spark = consolidated.sparkSession
    plain = f"{folder}/matriz_consolidada"
    write_parquet(consolidated, plain)
    consolidated = spark.read.parquet(plain)
    write_csv(consolidated, f"{folder}/matriz_consolidada_csv")
    if rejected is not None:
        write_parquet(_write_rejected(rejected, f"{folder}/linhas_rejeitadas"), f"{folder}/contagem_rejeitadas")
    run = run_model(consolidated, settings)
    scored = f"{folder}/matriz_com_modelo"
    write_parquet(run.matrix, scored)
    matrix_back = spark.read.parquet(scored)
    write_csv(matrix_back, f"{folder}/matriz_com_modelo_csv")
    run = ModelRun(matrix_back, run.features, run.stats, run.forest, run.components, run.settings)
    return write_reports(
        report_tables(run, with_stability), folder, optional=("correlacao_testes", "grafico_correlacao")
    )
