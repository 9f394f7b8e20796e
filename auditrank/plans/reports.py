"""Report tables over the consolidated and the scored matrix.

Each table comes from one aggregate over all its columns.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditrank import fixed_values as fv
from auditrank.functions.columns import number_or_null, number_or_zero
from auditrank.operators.consolidate import KEY, ROWS
from auditrank.operators.quantiles import exact_quantiles
from auditrank.operators.sampling import fixed_size_sample
from auditrank.plans.model import FLAG, RANK, SCORE


def _as_rows(one_row: DataFrame, rows: list[Column]) -> DataFrame:
    return one_row.select(F.inline(F.array(*rows)))


def run_summary(matrix: DataFrame, variables: int, settings) -> DataFrame:
    """Eleven indicators of a run as (indicator, value) texts."""
    totals = matrix.agg(
        F.coalesce(F.sum(F.col(ROWS).cast("bigint")), F.lit(0)).alias("linhas"),
        F.count("*").alias("clientes"),
        F.count_if(F.col("qtd_testes_com_indicio") > 0).alias("com_indicio"),
        F.coalesce(F.sum(FLAG), F.lit(0)).alias("atipicos"),
    )
    share = F.try_divide(F.col("atipicos").cast("double"), F.col("clientes").cast("double"))
    values = {
        "linhas_originais": F.col("linhas"),
        "clientes_apos_consolidacao": F.col("clientes"),
        "linhas_reduzidas_por_consolidacao": F.col("linhas") - F.col("clientes"),
        "clientes_com_algum_indicio": F.col("com_indicio"),
        "clientes_atipicos_isolation_forest": F.col("atipicos"),
        "percentual_atipicos_isolation_forest": share,
        "contaminacao_parametrizada": F.lit(settings.contamination),
        "variaveis_utilizadas_no_modelo": F.lit(variables),
        "n_estimators": F.lit(settings.forest.trees),
        "max_samples": F.lit(str(settings.forest.max_samples)),
        "random_state": F.lit(settings.forest.seed),
    }
    rows = [
        F.struct(F.lit(name).alias("indicador"), value.cast("string").alias("valor"))
        for name, value in values.items()
    ]
    return _as_rows(totals, rows)


def summary_by_test(matrix: DataFrame) -> DataFrame:
    """Flagged customers, their share, mean score and criticality per test."""
    tests = [t for t in fv.TESTS if t in matrix.columns]

    def mean(name: str) -> Column:
        if name not in matrix.columns:
            return F.lit(None).cast("double")
        return F.avg(number_or_zero(matrix, name))

    totals = matrix.agg(
        *(
            F.struct(
                F.lit(t).alias("teste"),
                F.coalesce(F.sum(number_or_zero(matrix, t)), F.lit(0.0))
                .cast("bigint")
                .alias("clientes_com_indicio"),
                mean(t).alias("percentual_clientes_com_indicio"),
                mean(f"score_{t}").alias("score_medio"),
                mean(f"criticidade_{t}").alias("criticidade_media"),
            ).alias(t)
            for t in tests
        )
    )
    return _as_rows(totals, [F.col(t) for t in tests])


def described(matrix: DataFrame, accuracy: int = 10_000) -> DataFrame:
    """Count, mean, deviation, extremes and percentiles, one row per variable."""
    names = [v for v in fv.DESCRIBED_VARIABLES if v in matrix.columns]
    numbers = matrix.select(*(number_or_null(matrix, v).alias(v) for v in names))
    quantiles = exact_quantiles(numbers, names, fv.DESCRIBED_PERCENTILES, accuracy)
    totals = numbers.agg(
        *(
            F.struct(
                F.lit(v).alias("variavel"),
                F.count(v).alias("count"),
                F.avg(v).alias("mean"),
                F.stddev_samp(v).alias("std"),
                F.min(v).alias("min"),
                *(
                    F.lit(quantiles[v][p]).cast("double").alias(f"{round(p * 100)}%")
                    for p in fv.DESCRIBED_PERCENTILES
                ),
                F.max(v).alias("max"),
            ).alias(v)
            for v in names
        )
    )
    return _as_rows(totals, [F.col(v) for v in names])


def correlation_of_tests(matrix: DataFrame) -> DataFrame:
    """Pearson correlation of the test flags in long form.

    A constant flag correlates with nothing: NULL.
    """
    tests = [t for t in fv.TESTS if t in matrix.columns]
    x = {t: number_or_zero(matrix, t) for t in tests}
    pairs = [(a, b) for i, a in enumerate(tests) for b in tests[i:]]
    totals = matrix.agg(
        *(F.stddev_samp(x[t]).alias(t) for t in tests),
        *(F.covar_samp(x[a], x[b]).alias(f"{a}|{b}") for a, b in pairs),
    )
    rows = []
    for a, b in product(tests, tests):
        shared = F.col(f"`{min(a, b)}|{max(a, b)}`")
        rows.append(
            F.struct(
                F.lit(a).alias("teste_a"),
                F.lit(b).alias("teste_b"),
                F.try_divide(shared, F.col(a) * F.col(b)).alias("correlacao"),
            )
        )
    return _as_rows(totals, rows)


def correlation_matrix(correlation: DataFrame) -> DataFrame:
    """The long correlation table as a square, one row per test."""
    return correlation.groupBy(F.col("teste_a").alias("index")).agg(
        *(F.max(F.when(F.col("teste_b") == t, F.col("correlacao"))).alias(t) for t in fv.TESTS)
    )


def sensitivity(matrix: DataFrame) -> DataFrame:
    """Customers prioritised under other cuts of the same ranking."""
    n = F.col("n").cast("double")
    rows = [
        F.struct(
            F.lit(c).alias("contaminacao"),
            F.lit(c * 100).alias("percentual"),
            F.ceil(n * F.lit(c)).cast("bigint").alias("clientes_priorizados_aproximados"),
        )
        for c in fv.SENSITIVITY_CUTS
    ]
    return _as_rows(matrix.agg(F.count("*").alias("n")), rows)


def top_customers(scored: DataFrame) -> DataFrame:
    """The highest ranked customers; the rank filter leaves only them to sort."""
    wanted = [c for c in (*fv.TOP_CUSTOMER_COLUMNS, *fv.TESTS) if c in scored.columns]
    return scored.where(F.col(RANK) <= fv.TOP_CUSTOMERS).select(*wanted).orderBy(RANK)


def flag_counts(summary: DataFrame) -> DataFrame:
    """Chart data: flagged customers per test."""
    return summary.select("teste", "clientes_com_indicio")


def score_pairs(scored: DataFrame) -> DataFrame:
    """Chart data: audit score against anomaly score, one point per customer."""
    return scored.select(KEY, "score_ponderado_auditoria", SCORE)


def pca_sample(scored: DataFrame, size: int = fv.CHART_SAMPLE, seed: int = fv.SEED) -> DataFrame:
    """Chart data: components of a repeatable sample of customers."""
    return fixed_size_sample(scored.select(KEY, "pca_1", "pca_2"), KEY, size, seed)
