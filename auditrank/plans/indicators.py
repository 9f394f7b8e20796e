"""Audit scores and priority levels per customer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditrank import fixed_values as fv
from auditrank.functions.columns import by_cuts, flag, number_or_zero, ratio_or_zero, total


def _present(df: DataFrame, names) -> list[str]:
    return [n for n in names if n in df.columns]


def with_indicators(df: DataFrame) -> DataFrame:
    """Cleaned flags, scores and values, and the indicators built on them.

    Test columns that are absent are skipped.  One projection, no shuffle.
    """
    tests = _present(df, fv.TESTS)
    scores = _present(df, (f"score_{t}" for t in fv.TESTS))
    criticalities = _present(df, (f"criticidade_{t}" for t in fv.TESTS))
    values = _present(df, fv.REFERENCE_VALUE_COLUMNS)

    # Shares outside 0..1 are clipped, and fractions are cut off: 0.7 counts 0.
    clean = {
        t: F.least(F.greatest(number_or_zero(df, t), F.lit(0.0)), F.lit(1.0)).cast("int") for t in tests
    }
    clean |= {c: number_or_zero(df, c) for c in (*scores, *criticalities, *values)}
    cleaned = df.withColumns(clean)

    zero, zero_int = F.lit(0.0), F.lit(0)
    returned, invoiced = "valor_total_devolvido_cliente", "valor_total_faturado_cliente"
    derived = {
        "qtd_testes_com_indicio": total([F.col(t) for t in tests], zero_int),
        "score_ponderado_auditoria": total([F.col(s) for s in scores], zero),
        "score_total_criticidade": total([F.col(c) for c in criticalities], zero),
        "score_ponderado_binario": total([F.col(t) * fv.BINARY_WEIGHTS[t] for t in tests], zero_int),
        "valor_referencia_priorizacao": total([F.col(v) for v in values], zero),
    }
    if returned in cleaned.columns and invoiced in cleaned.columns:
        derived["perc_devolucao_sobre_faturamento_recalculado"] = ratio_or_zero(
            number_or_zero(cleaned, returned), number_or_zero(cleaned, invoiced)
        )
    # The level rests on the summed test scores; a score of 1 or 2 stays
    # without level although a flag is on.
    level = by_cuts(F.col("score_ponderado_auditoria"), fv.PRIORITY_CUTS, fv.PRIORITY_DEFAULT)
    return (
        cleaned.withColumns(derived)
        .withColumn("nivel_prioridade_score", level)
        .withColumn(
            "label_operacional_alto_risco_proxy", flag(F.col("nivel_prioridade_score") == fv.PRIORITY_CUTS[0][1])
        )
    )


def model_variables(df: DataFrame) -> list[str]:
    """Model variables that exist in ``df``: binary, frequency, continuous, ordinal."""
    wanted = (
        *fv.TESTS,
        *fv.FREQUENCY_VARIABLES,
        *fv.CONTINUOUS_VARIABLES,
        *(f"criticidade_{t}" for t in fv.TESTS),
        *(f"score_{t}" for t in fv.TESTS),
        *fv.TOTAL_SCORES,
    )
    names = list(dict.fromkeys(_present(df, wanted)))
    if not names:
        raise ValueError("the matrix holds none of the model variables")
    return names
