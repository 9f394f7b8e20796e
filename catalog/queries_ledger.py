"""Registered queries over the ledger-shaped views."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditrank.params import ExtensionParams, FirstPurchaseParams, OpenItemParams, ReturnParams, ReversalParams
from auditrank.plans import extensions, first_purchase, open_items, returns, reversals
from auditrank.session import stage
from auditrank.sources.erp_views import Sales, due_date_changes, ledger_views

#: Invented ids of customers left out of tests 02 and 03.
LEFT_OUT = tuple(str(1_000_000_000 + n) for n in (4, 8, 15, 16, 23, 42))
# Periods that suit the dates of the given tables.
FIRST = FirstPurchaseParams(
    reference_date=date(1998, 12, 31),
    registered_from=date(1995, 1, 1),
    registered_to=date(1998, 12, 31),
    posted_from=date(1995, 1, 1),
    posted_to=date(1998, 12, 31),
    excluded=LEFT_OUT,
)
REVERSALS = ReversalParams(period_from=date(1995, 1, 1), period_to=date(2001, 12, 31), excluded=LEFT_OUT)
# The oldest open items of the given tables are about six years old.
OPEN = OpenItemParams(reference_date=date(2001, 8, 31), min_days=1900, high_days=2200)
RETURNS = ReturnParams(period_from=date(1995, 1, 1), period_to=date(2001, 12, 31))
EXTENSIONS = ExtensionParams()
CENTRE = "GSBER"


def _titles(spark: SparkSession, sf: str) -> DataFrame:
    return first_purchase.sales_titles(ledger_views(spark, sf), FIRST)


def _first(spark: SparkSession, sf: str) -> DataFrame:
    return first_purchase.first_purchases(_titles(spark, sf))


def _items(spark: SparkSession, sf: str) -> DataFrame:
    return reversals.reversal_items(ledger_views(spark, sf), REVERSALS)


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return reversals.reversal_documents(_items(spark, sf))


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return reversals.normalised_pairs(_documents(spark, sf))


def _summary(spark: SparkSession, sf: str) -> DataFrame:
    return reversals.summarised(ledger_views(spark, sf), REVERSALS)


def t01(spark: SparkSession, sf: str, source: Sales | None = None) -> DataFrame:
    return open_items.overdue_open_items(ledger_views(spark, sf, source), OPEN)


def t02(spark: SparkSession, sf: str, source: Sales | None = None) -> DataFrame:
    return first_purchase.first_purchase_default(ledger_views(spark, sf, source), FIRST)


def t03(spark: SparkSession, sf: str, source: Sales | None = None) -> DataFrame:
    return reversals.high_reversal_volume(ledger_views(spark, sf, source), REVERSALS)


def t04(spark: SparkSession, sf: str, source: Sales | None = None) -> DataFrame:
    return open_items.open_balance_concentration(ledger_views(spark, sf, source), OPEN, CENTRE)


def t05(spark: SparkSession, sf: str, source: Sales | None = None) -> DataFrame:
    return extensions.repeated_extensions(due_date_changes(spark, sf, source), EXTENSIONS)


def t06(spark: SparkSession, sf: str, source: Sales | None = None) -> DataFrame:
    return returns.high_return_share(ledger_views(spark, sf, source), RETURNS)


LEDGER_QUERIES = {
    "t02_universe": lambda s, sf: first_purchase.registered_customers(ledger_views(s, sf), FIRST),
    "t02_titles": _titles,
    "t02_first_purchase": _first,
    "t02_evaluation": lambda s, sf: first_purchase.evaluated(_first(s, sf), FIRST),
    "t02_result": lambda s, sf: first_purchase.for_review(t02(s, sf)),
    "t02_class_counts": lambda s, sf: t02(s, sf)
    .groupBy("classificacao_primeira_compra")
    .agg(F.count("*").alias("clientes")),
    "t03_universe": lambda s, sf: reversals.active_customers(ledger_views(s, sf), REVERSALS),
    "t03_items": _items,
    "t03_documents": _documents,
    "t03_pairs": _pairs,
    "t03_unique": lambda s, sf: reversals.unique_reversals(_pairs(s, sf)),
    "t03_summary": _summary,
    "t03_thresholds": lambda s, sf: reversals.thresholds(stage(_summary(s, sf), "reversal-summary"), REVERSALS),
    "t03_result": lambda s, sf: reversals.for_review(t03(s, sf)),
    "t01_result": t01,
    "t04_result": t04,
    "t05_result": t05,
    "t06_result": t06,
}
