"""Shapes of physical plans on ledger tables stored as Parquet."""

import re

import pytest

from auditrank.plans import extensions, first_purchase, levels, open_items, returns, reversals
from auditrank.sources.erp_views import due_date_changes, ledger_views
from auditrank.sources.tables import read_ledger
from catalog import queries_matrix
from catalog.queries_ledger import CENTRE, EXTENSIONS, FIRST, OPEN, RETURNS, REVERSALS


@pytest.fixture(scope="module")
def stored(spark, sf, tmp_path_factory):
    folder = tmp_path_factory.mktemp("ledger")
    views = ledger_views(spark, sf)
    paths = {name: str(folder / name) for name in ("kna1", "bseg", "bkpf")}
    for name, path in paths.items():
        getattr(views, name).write.parquet(path)
    return read_ledger(spark, paths)


def plan(df):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


def scans(text):
    return re.findall(r"PushedFilters: \[(.*?)\]\nReadSchema: struct<(.*?)>\n", text)


def test_first_purchase_pushes_filters_and_prunes(stored):
    text = plan(first_purchase.first_purchase_default(stored, FIRST))
    ledger = [s for s in scans(text) if "H_BUDAT" in s[1]]
    assert len(ledger) == 1
    filters, columns = ledger[0]
    for wanted in ("EqualTo(ZLSCH,E)", "EqualTo(H_BLART,RV)", "EqualTo(SHKZG,S)", "GreaterThanOrEqual(H_BUDAT"):
        assert wanted in filters
    assert "HKONT" not in columns and "H_BLDAT" not in columns
    assert text.count("WindowGroupLimit") >= 2
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_excluded_ids_are_broadcast_and_the_ledger_stays(stored):
    text = plan(first_purchase.first_purchases(first_purchase.sales_titles(stored, FIRST)))
    assert "BroadcastHashJoin LeftAnti" in text and "ExistingRDD" not in text
    assert text.count("WindowGroupLimit") >= 2 and len(re.findall(r"\) Exchange\n", text)) == 1


def test_repeated_excluded_ids_are_folded_before_the_join(spark):
    """A table with very many rows of few ids must not reach the join row by row."""
    from pyspark.sql import functions as F

    from auditrank.operators.exclusion import without_excluded

    rows = spark.range(100).select((F.col("id") % 5).alias("k"))
    left = without_excluded(rows, "k", spark.range(3_000).select((F.col("id") % 2).alias("id")))
    assert "HashAggregate" in plan(left).split("= Subqueries =")[0]
    assert sorted({r.k for r in left.collect()}) == [2, 3, 4] and left.count() == 60


def test_reversals_prune_items_and_join_inner(stored):
    text = plan(reversals.summarised(stored, REVERSALS))
    items = [s for s in scans(text) if "HKONT" in s[1]][0]
    assert "EqualTo(HKONT,1010201001)" in items[0]
    assert "BUZEI" not in items[1] and "H_BLDAT" not in items[1]  # not needed by the summary
    assert "Expand" not in text  # distinct counts come from folds
    headers = [s for s in scans(text) if "XREVERSING" in s[1]][0]
    assert "EqualTo(XREVERSING,X)" in headers[0]
    assert "NestedLoop" not in text and "Cartesian" not in text and "Python" not in text


def test_only_one_row_sides_are_joined_without_key(stored):
    for df in (
        reversals.high_reversal_volume(stored, REVERSALS),
        open_items.open_balance_concentration(stored, OPEN, CENTRE),
        returns.high_return_share(stored, RETURNS),
    ):
        text = plan(df)
        assert text.count("BroadcastNestedLoopJoin Cross BuildRight (") <= 1
        assert "Cartesian" not in text


def test_matrix_tests_read_one_written_join(spark, sf):
    """The six tests of a matrix run share the join of lines and documents."""
    from catalog.queries_matrix import _results

    for name, df in _results(spark, sf).items():
        assert not any("lineitem.parquet" in f or "orders.parquet" in f for f in df.inputFiles()), name


def test_global_ranks_use_no_single_partition_window_over_rows(spark):
    from pyspark.sql import functions as F

    from auditrank.operators.ordering import numbered

    df = numbered(spark.range(1_000).select(F.col("id").alias("x")), [F.col("x")], "n")
    text = plan(df)
    # The unpartitioned window sees partition sizes, one row per range.
    before_window = text.split("SinglePartition")[0]
    assert "HashAggregate" in before_window


def test_lines_are_shuffled_by_numbers_in_the_due_date_log(spark, sf):
    """Every line meets the window of test 05: no text but the customer's id, amounts as longs."""
    changes = due_date_changes(spark, sf)
    kinds = {f.name: f.dataType.simpleString() for f in changes.schema}
    assert kinds["BELNR"] == "bigint" and kinds["VERSION"].startswith("struct")
    assert [n for n, kind in kinds.items() if kind == "string"] == ["KUNNR"]
    window = re.search(r"\) Sort\nInput \[\d+\]: \[[^\n]*versao[^\n]*\nArguments: \[documento", plan(extensions.extended_titles(changes, EXTENSIONS)))
    assert window, "the number that differs most is compared first"


def test_open_balances_are_folded_once(stored, monkeypatch):
    """Test 04 needs them for the centres and for the customers."""
    staged = levels.stage
    texts = []
    monkeypatch.setattr(levels, "stage", lambda df, name: texts.append(plan(df)) or staged(df, name))
    open_items.open_balance_concentration(stored, OPEN, CENTRE)
    assert len(texts) == 1 and not [s for s in scans(texts[0]) if "H_BUDAT" in s[1]]


def test_copies_are_made_in_one_pass(spark, tmp_path):
    spark.createDataFrame([("a", 1, 2.5), ("b", 0, 1.5), ("c", None, None)], "id string, teste_01 int, v double").write.parquet(str(tmp_path / "m"))
    rows = spark.read.parquet(str(tmp_path / "m"))
    copied = queries_matrix._with_copies(rows)
    assert copied.columns == rows.columns and len(re.findall(r"\) Scan parquet", plan(copied))) == 1
    assert sorted(r.id for r in copied.collect()) == ["a", "a", "b", "c"]


def test_reversal_keys_are_compared_by_document_first(stored):
    """Client and company are the same for many rows, so a sort that starts with them compares all keys."""
    text = plan(reversals.reversal_document_values(stored, REVERSALS))
    keys = re.findall(r"Left keys \[4\]: \[(\w+)", text)
    assert keys and set(keys) == {"BELNR"}
