"""Hand-made cases of test 02, with text-typed source columns."""

from datetime import date
from decimal import Decimal

import pytest

from auditrank import fixed_values as fv
from auditrank.params import FirstPurchaseParams
from auditrank.plans import first_purchase as t02
from auditrank.sources.tables import HEADER_COLUMNS, ITEM_COLUMNS, Ledger

PARAMS = FirstPurchaseParams(excluded=("1000000099",))


def item(kunnr, belnr="1", budat="2024-03-01", netdt="", zbd1t="", augdt="", buzei="1", bukrs="A", **other):
    row = dict.fromkeys(ITEM_COLUMNS, "")
    row |= {
        "MANDT": "100", "BUKRS": bukrs, "KUNNR": kunnr, "BELNR": belnr, "GJAHR": "2024", "BUZEI": buzei,
        "H_BUDAT": budat, "H_BLDAT": budat, "NETDT": netdt, "ZBD1T": zbd1t, "AUGDT": augdt,
        "ZLSCH": "E", "H_BLART": "RV", "SHKZG": "S", "HKONT": "1", "DMBTR": "10.50",
    }
    return row | other


def ledger(spark, customers, items, headers=()):
    text = lambda names: ", ".join(f"{n} string" for n in names)
    return Ledger(
        kna1=spark.createDataFrame(customers, "MANDT string, KUNNR string, NAME1 string, ERDAT string"),
        bseg=spark.createDataFrame([[i[c] for c in ITEM_COLUMNS] for i in items], text(ITEM_COLUMNS)),
        bkpf=spark.createDataFrame([[h[c] for c in HEADER_COLUMNS] for h in headers], text(HEADER_COLUMNS)),
    )


def customer(kunnr, name="N", erdat="2024-02-01", mandt="100"):
    return (mandt, kunnr, name, erdat)


def run(spark, customers, items):
    rows = t02.first_purchase_default(ledger(spark, customers, items), PARAMS).collect()
    return {r.id_cliente: r for r in rows}


def test_five_classes_and_missing_purchase(spark):
    ids = [f"10000000{n:02d}" for n in range(1, 7)]
    items = [
        item(ids[0], netdt="2024-03-10", augdt="2024-03-10"),  # settled on the due date
        item(ids[1], netdt="2024-03-10", augdt="2024-03-15"),
        item(ids[2], netdt="2024-03-10"),
        item(ids[3], netdt="2025-12-31"),  # due on the reference date
        item(ids[4], netdt="", zbd1t="30", augdt="2024-04-02"),  # due 2024-03-31 by term
    ]
    out = run(spark, [customer(i) for i in ids], items)
    kinds = [out[i].classificacao_primeira_compra for i in ids]
    assert kinds == [
        fv.SETTLED_ON_TIME, fv.SETTLED_LATE, fv.OPEN_OVERDUE, fv.OPEN_NOT_DUE, fv.SETTLED_LATE, fv.NO_FIRST_PURCHASE,
    ]
    assert [out[i].score_teste_02 for i in ids] == [0, 2, 3, 0, 2, 0]
    assert [out[i].criticidade_teste_02 for i in ids] == [0, 1, 2, 0, 1, 0]
    assert out[ids[4]].dias_atraso_primeira_compra == 2
    assert out[ids[2]].dias_atraso_primeira_compra == (date(2025, 12, 31) - date(2024, 3, 10)).days
    assert out[ids[5]].status_compensacao_primeira_compra is None
    assert out[ids[5]].nivel_risco_teste_02 == fv.NO_CLASS
    assert out[ids[5]].valor_primeira_compra == Decimal(0)


def test_ids_kept_and_dropped(spark):
    customers = [customer(i) for i in ("", "ABC", "1000000000", "1000000001", "1000000099")]
    assert set(run(spark, customers, [])) == {"1000000001"}


def test_missing_term_counts_as_zero(spark):
    out = run(spark, [customer("1000000001")], [item("1000000001", augdt="2024-03-01")])
    assert out["1000000001"].dias_atraso_primeira_compra == 0


def test_dates_are_read_strictly(spark):
    customers = [customer("1000000001", erdat="20240201"), customer("1000000002", erdat="2024"),
                 customer("1000000003", erdat="00000000"), customer("1000000004", erdat="2024-2-1")]
    assert set(run(spark, customers, [])) == {"1000000004"}


def test_tie_between_companies_is_settled_by_company(spark):
    items = [item("1000000001", bukrs="B", DMBTR="2"), item("1000000001", bukrs="A", DMBTR="1")]
    out = run(spark, [customer("1000000001")], items)
    assert out["1000000001"].centro == "A"


def test_earliest_document_within_the_period_wins(spark):
    items = [
        item("1000000001", belnr="9", budat="2024-05-01"),
        item("1000000001", belnr="2", budat="2024-04-01"),
        item("1000000001", belnr="1", budat="2023-12-31"),  # before the period
        item("1000000001", belnr="0", budat="2024-01-05", ZLSCH="T"),  # other payment method
    ]
    out = run(spark, [customer("1000000001")], items)
    assert out["1000000001"].documento_primeira_compra == "2"


def test_customer_in_two_names_gives_two_rows(spark):
    df = t02.first_purchase_default(
        ledger(spark, [customer("1000000001", "A"), customer("1000000001", "B")], [item("1000000001")]), PARAMS
    )
    assert df.count() == 2


def test_exclusion_list(spark):
    from auditrank.operators.exclusion import without_excluded

    df = spark.createDataFrame([("1",), ("2",), (None,)], "id string")
    assert [r.id for r in without_excluded(df, "id", ["1"]).collect()] == ["2"]
    listed = spark.createDataFrame([("1",), (None,)], "x string")
    # As with NOT IN, a row without a key goes once anything is excluded.
    assert {r.id for r in without_excluded(df, "id", listed).collect()} == {"2"}
    assert without_excluded(df, "id", [str(i) for i in range(2_000)]).count() == 0
    with pytest.raises(ValueError):
        without_excluded(df, "id", ["1", None])


def test_hot_customer_is_cut_before_the_shuffle(spark):
    """A third of all titles on one customer: the limit runs on both sides."""
    items = [item("1000000001", belnr=str(n)) for n in range(40)] + [item(f"10000001{n:02d}") for n in range(60)]
    titles = t02.sales_titles(ledger(spark, [customer("1000000001")], items), PARAMS)
    first = t02.first_purchases(titles)
    assert first.count() == 61
    assert first._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") >= 2
