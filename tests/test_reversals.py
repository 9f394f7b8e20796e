"""Hand-made cases of test 03."""

from datetime import date
from decimal import Decimal

from auditrank import fixed_values as fv
from auditrank.params import ReversalParams
from auditrank.plans import reversals as t03
from auditrank.sources.erp_views import ledger_views
from catalog.queries_ledger import REVERSALS
from tests.test_first_purchase import customer, item, ledger

PARAMS = ReversalParams(excluded=("1000000099",))
C = "1000000001"


def header(belnr, reference, bukrs="A", gjahr="2024", bldat="2024-03-01", user="U1", mark="X"):
    return {"MANDT": "100", "BUKRS": bukrs, "BELNR": belnr, "GJAHR": gjahr, "BLDAT": bldat, "USNAM": user,
            "XREVERSING": mark, "AWREF_REV": reference}


def line(belnr, value, kunnr=C, gjahr="2024", buzei="1", **other):
    return item(kunnr, belnr=belnr, buzei=buzei, HKONT=fv.REVERSAL_ACCOUNT, DMBTR=value, GJAHR=gjahr, **other)


def pairs_of(spark, items, headers, customers=None):
    data = ledger(spark, customers or [customer(C)], items, headers)
    documents = t03.reversal_document_values(data, PARAMS)
    return t03.unique_reversals(t03.normalised_pairs(documents))


def test_both_directions_make_one_pair_valued_at_the_larger_leg(spark):
    out = pairs_of(spark, [line("1", "100"), line("2", "-80"), line("2", "-50", buzei="2")],
                   [header("1", "2", user="B"), header("2", "1", user="A")]).collect()
    assert len(out) == 1
    pair = out[0]
    assert pair.status_relacao_estorno == fv.TWO_LEGS
    assert pair.valor_estorno_sem_duplicidade == Decimal(130)
    assert pair.valor_somado_das_pernas == Decimal(230)
    assert pair.diferenca_valor_entre_pernas == Decimal(30)
    assert pair.documentos_encontrados == "1, 2"
    assert pair.usuarios_envolvidos == "A, B"
    assert pair.chave_par_estorno == "A|2024|1|2"


def test_pair_across_fiscal_years_stays_two_one_leg_pairs(spark):
    out = pairs_of(spark, [line("1", "100"), line("2", "100", gjahr="2025")],
                   [header("1", "2"), header("2", "1", gjahr="2025")]).collect()
    assert [p.status_relacao_estorno for p in out] == [fv.ONE_LEG] * 2


def test_filters(spark):
    items = [line("1", "1"), line("2", "1"), line("3", "1"), line("4", "1"), line("5", "1", kunnr="1000000099"),
             item(C, belnr="6", HKONT="other")]
    headers = [header("1", ""), header("2", "9", mark=""), header("3", "9", bldat="2023-12-31"),
               header("5", "9"), header("6", "9")]
    assert pairs_of(spark, items, headers).count() == 0  # 4 has no header


def test_unknown_customer_keeps_null_name(spark):
    out = pairs_of(spark, [line("1", "5", kunnr="1000000007")], [header("1", "2")]).collect()
    assert out[0].nome_cliente is None and out[0].id_cliente == "1000000007"


def test_two_names_double_the_value_but_not_the_count(spark):
    pairs = pairs_of(spark, [line("1", "5")], [header("1", "2")], [customer(C, "X"), customer(C, "Y")])
    summary = t03.customer_summary(pairs).first()
    assert summary.qtd_estornos_cliente == 1
    assert summary.valor_total_estornos_cliente == Decimal(10)


def test_no_reversal_gives_zero_thresholds_and_no_flag(spark):
    data = ledger(spark, [customer(C)], [item(C)], [])
    out = t03.high_reversal_volume(data, PARAMS).collect()
    assert len(out) == 1
    row = out[0]
    assert row.qtd_estornos_p90 == 0 and row.valor_estornos_p75 == 0
    assert row[fv.TEST_03_FLAG] == 0 and row.nivel_risco_teste_03 == fv.NO_OCCURRENCE


def test_all_customers_tied_at_p75_are_flagged(spark):
    ids = [f"10000000{n:02d}" for n in range(10, 16)]
    items = [line(str(n), "7", kunnr=i) for n, i in enumerate(ids)]
    headers = [header(str(n), "99") for n in range(len(ids))]
    out = t03.high_reversal_volume(ledger(spark, [customer(i) for i in ids], items, headers), PARAMS).collect()
    assert {r.nivel_risco_teste_03 for r in out} == {fv.HIGH_RISK}


def test_summing_before_the_join_equals_item_level_documents(spark, sf):
    data = ledger_views(spark, sf)
    early = t03.reversal_document_values(data, REVERSALS)
    late = t03.reversal_documents(t03.reversal_items(data, REVERSALS)).drop("qtd_itens_documento")
    assert early.count() == late.count() > 0
    assert early.select(sorted(early.columns)).exceptAll(late.select(sorted(late.columns))).isEmpty()


def test_documents_count_distinct_items(spark):
    items = [line("1", "1", buzei="1"), line("1", "1", buzei="2"), line("1", "1", buzei="2")]
    data = ledger(spark, [customer(C)], items, [header("1", "2")])
    out = t03.reversal_documents(t03.reversal_items(data, PARAMS)).first()
    assert out.qtd_itens_documento == 2 and out.valor_documento == Decimal(3)


def test_summary_counts_keys_and_users_of_customers_with_two_names(spark):
    """Distinct counts and sums where a pair stands once per name, with other users."""
    rows = [
        ("1", "A", "e1", "k1", "u1", 10, "Duas pernas localizadas"),
        ("1", "B", "e1", "k1", "u1", 10, "Duas pernas localizadas"),
        ("1", "A", "e1", "k2", "u1, u2", 5, "Apenas uma perna localizada"),
        ("1", "B", "e1", "k2", "u3", 7, "Apenas uma perna localizada"),
        ("1", "A", "e2", "k3", None, 1, "Não classificado"),
        ("1", "A", "e0", None, "u9", 2, "Duas pernas localizadas"),
        ("2", None, None, "k1", None, None, "Apenas uma perna localizada"),
    ]
    unique = spark.createDataFrame(
        [(*r[:5], None if r[5] is None else Decimal(r[5]), r[6], date(2024, 1, 1 + i), date(2024, 2, 1 + i)) for i, r in enumerate(rows)],
        "id_cliente string, nome_cliente string, empresa string, chave_par_estorno string, usuarios_envolvidos string, "
        "valor_estorno_sem_duplicidade decimal(38,9), status_relacao_estorno string, data_primeiro_registro date, data_ultimo_registro date",
    )
    one, two = sorted(t03.customer_summary(unique).collect())
    assert tuple(one) == ("1", "B", "e0, e1, e2", 3, Decimal(35), Decimal(10), date(2024, 1, 1), date(2024, 2, 6), 4, 3, 2)
    assert tuple(two) == ("2", None, None, 1, None, None, date(2024, 1, 7), date(2024, 2, 7), 0, 0, 1)
