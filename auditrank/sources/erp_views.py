"""Ledger-shaped views over order-and-line tables.

They let the tests run on generic sales tables where no ERP extract is at
hand.  All formulas are integer or date arithmetic; none needs a window, so a
customer with a third of all orders adds no single-task step.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditrank import fixed_values as fv
from auditrank.session import stage
from auditrank.sources.tables import Ledger

DOCUMENT_WIDTH = 12


def _text(column, width: int | None = None):
    text = column.cast("string")
    return F.lpad(text, width, "0") if width else text


def _customer_id(key):
    return _text(F.col(key) + F.lit(fv.ID_FLOOR))


def _document_number(key):
    return _text(F.col(key), DOCUMENT_WIDTH)


def _day_number(name):
    """Days since 1970, padded so that text order is date order."""
    return _text(F.unix_date(F.col(name).cast("date")), 6)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with company and posting date, keys still as numbers.

    Texts are built after the joins, so only numbers are shuffled.
    """
    company = _table(spark, folder, "customer").select(
        F.col("c_custkey").alias("o_custkey"), (F.col("c_nationkey") % 5).alias("company")
    )
    return _table(spark, folder, "orders").join(company, "o_custkey").select(
        "o_orderkey",
        "o_custkey",
        "o_orderstatus",
        "o_orderpriority",
        "company",
        F.col("o_orderdate").cast("date").alias("posted"),
    )


def _lines(spark: SparkSession, folder: str, documents: DataFrame) -> DataFrame:
    """Order lines with their documents, still as numbers; dates without a time."""
    lines = _table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.col("l_shipdate").cast("date").alias("l_shipdate"),
        F.col("l_quantity").cast("int").alias("term"),
        "l_linestatus",
        "l_returnflag",
        F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"),
    )
    return lines.join(documents.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey")).drop("l_orderkey")


@dataclass(frozen=True)
class Sales:
    """Customers, documents and lines behind the views."""

    customers: DataFrame
    documents: DataFrame
    lines: DataFrame


def sales(spark: SparkSession, folder: str, staged: bool = False) -> Sales:
    """The tables behind the views.

    ``staged`` writes documents and lines once, as numbers, for a run that reads them
    for several tests; a single test reads the given tables and joins them itself.
    """
    documents = _documents(spark, folder)
    if staged:
        documents = stage(documents, "sales-documents")
    lines = _lines(spark, folder, documents)
    return Sales(_table(spark, folder, "customer"), documents, stage(lines, "sales-lines") if staged else lines)


def _document_key() -> list[Column]:
    return [
        F.lit("100").alias("MANDT"),
        _text(F.col("company")).alias("BUKRS"),
        _document_number("o_orderkey").alias("BELNR"),
        _text(F.year("posted")).alias("GJAHR"),
    ]


def _customers(customers: DataFrame) -> DataFrame:
    key = F.col("c_custkey")
    return customers.select(
        F.lit("100").alias("MANDT"),
        _customer_id("c_custkey").alias("KUNNR"),
        F.col("c_name").alias("NAME1"),
        F.date_add(F.lit("1995-01-01").cast("date"), (key * 37 % 1600).cast("int")).alias("ERDAT"),
    )


def _items(lines: DataFrame) -> DataFrame:
    returned = F.col("l_returnflag") == "R"
    return lines.select(
        *_document_key(),
        _customer_id("o_custkey").alias("KUNNR"),
        F.concat(
            _text(F.col("l_linenumber"), 2),
            _text(F.col("l_partkey"), 10),
            _text(F.col("l_suppkey"), 10),
            _day_number("l_shipdate"),
        ).alias("BUZEI"),
        F.col("posted").alias("H_BUDAT"),
        F.col("posted").alias("H_BLDAT"),
        F.when(F.col("l_linenumber") % 2 == 1, F.date_add("posted", F.col("term"))).alias("NETDT"),
        F.col("term").alias("ZBD1T"),
        F.when(
            F.col("l_linestatus") == "F",
            F.date_add("posted", F.col("term") + (F.col("l_suppkey") % 41).cast("int") - 20),
        ).alias("AUGDT"),
        F.when(F.col("o_orderpriority") == "5-LOW", "T").otherwise("E").alias("ZLSCH"),
        F.when(F.col("o_orderstatus") == "P", "DZ").otherwise("RV").alias("H_BLART"),
        F.when(returned, "H").otherwise("S").alias("SHKZG"),
        F.when(returned, fv.REVERSAL_ACCOUNT).otherwise("1010201002").alias("HKONT"),
        F.col("amount").alias("DMBTR"),
        _text(F.col("l_suppkey") % 5).alias("GSBER"),
    )


def _headers(documents: DataFrame) -> DataFrame:
    """Document headers with a reference to another document of the year.

    The first document of a customer's year refers to the last one, all
    others refer to the first; a lone document has no reference.
    """
    documents = documents.withColumn("year", F.year("posted"))
    ends = documents.groupBy("o_custkey", "year").agg(
        F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last")
    )
    return documents.join(ends, ["o_custkey", "year"]).select(
        *_document_key(),
        F.col("posted").alias("BLDAT"),
        F.concat(F.lit("U"), _text(F.col("o_orderkey") % 13)).alias("USNAM"),
        F.when(F.col("o_orderstatus") != "F", fv.REVERSAL_MARK).otherwise("").alias("XREVERSING"),
        F.when(F.col("first") == F.col("last"), "")
        .when(F.col("o_orderkey") == F.col("first"), _document_number("last"))
        .otherwise(_document_number("first"))
        .alias("AWREF_REV"),
    )


def ledger_views(spark: SparkSession, folder: str, source: Sales | None = None) -> Ledger:
    source = source or sales(spark, folder)
    return Ledger(
        kna1=_customers(source.customers), bseg=_items(source.lines), bkpf=_headers(source.documents)
    )


def due_date_changes(spark: SparkSession, folder: str, source: Sales | None = None) -> DataFrame:
    """Due-date log: lines sharing order and line number are versions of one title.

    Keys and version stay numbers: every line is shuffled by them, and none is shown.
    """
    source = source or sales(spark, folder)
    version = ["l_shipdate", "l_partkey", "l_suppkey"]
    complete = reduce(and_, (F.col(c).isNotNull() for c in version))
    return source.lines.select(
        F.col("company").alias("BUKRS"),
        F.col("o_orderkey").alias("BELNR"),
        F.year("posted").alias("GJAHR"),
        _customer_id("o_custkey").alias("KUNNR"),
        F.col("l_linenumber").alias("BUZEI"),
        F.when(complete, F.struct(*version)).alias("VERSION"),
        F.col("l_shipdate").alias("NETDT"),
        F.col("amount").alias("DMBTR"),
    )
