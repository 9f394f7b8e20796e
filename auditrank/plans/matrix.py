"""Analytic matrix: test results brought together by customer."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditrank import fixed_values as fv
from auditrank.operators.consolidate import ROWS, consolidate

# Columns of tests 02 and 03 that enter the matrix, under the
# names the model expects.
FIRST_PURCHASE_COLUMNS = {
    "id_cliente": "id_cliente",
    "nome_cliente": "nome_cliente",
    fv.TEST_02_FLAG: "teste_02",
    "criticidade_teste_02": "criticidade_teste_02",
    "score_teste_02": "score_teste_02",
    "nivel_risco_teste_02": "nivel_risco_teste_02",
    "valor_primeira_compra": "valor_primeira_compra",
    "dias_atraso_primeira_compra": "dias_atraso_primeira_compra",
}
REVERSAL_COLUMNS = {
    "id_cliente": "id_cliente",
    "nome_cliente": "nome_cliente",
    fv.TEST_03_FLAG: "teste_03",
    "criticidade_teste_03": "criticidade_teste_03",
    "score_teste_03": "score_teste_03",
    "nivel_risco_teste_03": "nivel_risco_teste_03",
    "qtd_estornos_cliente": "qtd_estornos_cliente",
    "qtd_usuarios_estorno": "qtd_usuarios_estorno",
    "valor_total_estornos_cliente": "valor_total_estornos_cliente",
    "maior_valor_estorno_cliente": "maior_valor_estorno_cliente",
}


def stacked(results: Mapping[str, DataFrame]) -> DataFrame:
    """All test results as rows of one wide table.

    Keys of ``results`` are ``teste_01`` … ``teste_06``.
    """
    renames = {"teste_02": FIRST_PURCHASE_COLUMNS, "teste_03": REVERSAL_COLUMNS}
    parts = []
    for test in sorted(results):
        df = results[test]
        if test in renames:
            df = df.select(*(F.col(old).alias(new) for old, new in renames[test].items()))
        parts.append(df)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def assembled(results: Mapping[str, DataFrame]) -> DataFrame:
    """One row per customer with the evidence of every test.

    Stacking and folding needs one exchange on the customer.  Full outer joins
    would need up to five, and would pair every row of a repeated id in one
    test with every row of it in another.
    """
    rows = consolidate(stacked(results)).drop(ROWS)
    flags = {t: F.coalesce(t, F.lit(0)) for t in fv.TESTS if t in rows.columns}
    return rows.withColumns(flags)
