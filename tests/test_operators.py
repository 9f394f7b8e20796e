"""Quantiles, ordering, consolidation, numbers, sampling and scaling."""

import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from auditrank.operators import consolidate as co
from auditrank.operators.features import feature_stats
from auditrank.operators.numbers import as_numbers, brazilian_columns
from auditrank.operators.ordering import numbered, ranked, with_previous
from auditrank.operators import ordering
from auditrank.operators import quantiles as q
from auditrank.operators.quantiles import exact_quantiles
from auditrank.operators.sampling import fixed_size_sample
from auditrank.plans.indicators import model_variables, with_indicators
from auditrank.plans.levels import with_percentile_levels

SLOW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


# --- quantiles --------------------------------------------------------------


def _columns():
    rng = np.random.default_rng(3)
    n = 5_000
    return pd.DataFrame(
        {
            "smooth": rng.normal(size=n),
            "mostly_zero": np.where(rng.random(n) < 0.9, 0.0, rng.gamma(2.0, size=n)),
            "third_hot": np.where(rng.random(n) < 0.34, 7.5, rng.random(n) * 10),
            "steps": rng.integers(0, 4, n).astype(float),
            "constant": np.full(n, 2.0),
            "gaps": np.where(rng.random(n) < 0.5, np.nan, rng.random(n)),
        }
    )


@pytest.mark.parametrize("accuracy", [10_000, 50, 7])
def test_quantiles_equal_brute_force(spark, accuracy):
    """Small accuracies force sorting inside brackets."""
    data = _columns()
    df = spark.createDataFrame(data).repartition(7)
    df = df.select(*(F.when(~F.isnan(c), F.col(c)).alias(c) for c in df.columns))
    probabilities = [0.0, 0.05, 0.25, 0.5, 0.9, 0.99, 1.0]
    out = exact_quantiles(df, list(data.columns), probabilities, accuracy)
    for c in data.columns:
        expected = np.nanpercentile(data[c], [p * 100 for p in probabilities])
        assert np.allclose([out[c][p] for p in probabilities], expected, rtol=1e-12, atol=1e-12)


def _discrete(values, share):
    return sorted(values)[max(1, -(-len(values) * round(share * 100) // 100)) - 1]


@pytest.mark.parametrize("accuracy", [10_000, 7])
def test_discrete_quantiles_equal_brute_force(spark, accuracy):
    rng = np.random.default_rng(5)
    cents = pd.DataFrame({"few": rng.integers(1, 9, 3_000) * 100, "many": rng.integers(1, 10**8, 3_000)})
    shares = [0.0, 0.1, 0.75, 0.9, 1.0]
    for kind in (q.NUMERIC, "double"):
        df = spark.createDataFrame(cents).repartition(5)
        df = df.select(*((F.col(c) / 100).cast("decimal(20,2)").cast(kind).alias(c) for c in cents)).unionByName(
            spark.range(3).selectExpr(*(f"CAST(NULL AS {kind}) AS {c}" for c in cents))
        )
        found = q.discrete_quantiles(df, list(cents), shares, accuracy)
        for c in cents:
            assert [round(found[c][s] * 100) for s in shares] == [_discrete(cents[c].tolist(), s) for s in shares]
        assert q.discrete_quantiles(df.where("few < 0"), ["few"], [0.75], accuracy) == {"few": {0.75: None}}


def test_levels_rest_on_exact_cuts(spark):
    """A rough sketch must not move a cut."""
    n = 20_011
    shares = [(i * 7_919 % n + 1) / n for i in range(n)]
    df = spark.createDataFrame(pd.DataFrame({"share": shares})).repartition(7)
    out = with_percentile_levels(df, "share", "04", 10).agg(F.sum("teste_04"), F.count_if(F.col("score_teste_04") == 2))
    cuts = [_discrete(shares, cut) for cut in (0.75, 0.9)]
    assert list(out.first()) == [sum(v >= cut for v in shares) for cut in cuts]


@pytest.mark.parametrize("one_task", [1_000_000, 10])
def test_missed_bracket_becomes_the_whole_column(spark, monkeypatch, one_task):
    """A sketch that misses the wanted ranks must not change the result."""
    original = q._bracketed

    def misled(column, ranks, n, edges):
        brackets = original(column, ranks, n, edges)
        for b in brackets:
            b.low = b.high = -1e9
        return brackets

    monkeypatch.setattr(q, "_bracketed", misled)
    monkeypatch.setattr(q, "ONE_TASK", one_task)
    data = _columns()
    df = spark.createDataFrame(data).repartition(7)
    df = df.select(*(F.when(~F.isnan(c), F.col(c)).alias(c) for c in df.columns))
    probabilities = [0.0, 0.25, 0.5, 0.99]
    out = exact_quantiles(df, list(data.columns), probabilities)
    for c in data.columns:
        expected = np.nanpercentile(data[c], [p * 100 for p in probabilities])
        assert np.allclose([out[c][p] for p in probabilities], expected, rtol=1e-12, atol=1e-12)


def test_a_whole_column_is_ordered_by_ranges(spark, monkeypatch):
    """With every bracket missed and no bracket for one task, a window sees one range of
    the rows, and a value that a third of all rows share arrives folded."""
    monkeypatch.setattr(q, "ONE_TASK", 0)
    seen = []
    original = q._hits

    def watched(placed, part, wanted):
        seen.append(placed.groupBy(part.alias("part")).count().agg(F.max("count"), F.sum("count")).first())
        return original(placed, part, wanted)

    monkeypatch.setattr(q, "_hits", watched)
    monkeypatch.setattr(q, "_bracketed", lambda c, ranks, n, e: [q._Bracket(c, list(ranks), -1e9, -1e9)])
    df = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, 77.0).otherwise(F.col("id").cast("double")).alias("x"))
    values = sorted(77.0 if i % 3 == 0 else float(i) for i in range(20_000))
    # Ranges this small would be joined to one.
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = exact_quantiles(df, ["x"], [0.1, 0.5, 0.9])["x"]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert [out[p] for p in (0.1, 0.5, 0.9)] == pytest.approx(np.percentile(values, [10, 50, 90]))
    ((largest, rows),) = seen
    assert largest < 13_400 / 2 and rows <= 3 * largest  # three ranges at most, of four


def test_filled_quantiles_equal_those_of_the_filled_columns(spark):
    data = _columns()
    data["gaps"] = [None if i % 3 else float(i % 50) for i in range(len(data))]
    data["few"] = [float(i) if i < 4 else None for i in range(len(data))]
    data["none"] = [None] * len(data)
    df = spark.createDataFrame(data.astype(float)).repartition(5)
    df = df.select(*(F.when(~F.isnan(c), F.col(c)).alias(c) for c in df.columns))
    probabilities = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    medians, found = q.filled_quantiles(df, list(data.columns), probabilities, 50)
    assert medians.pop("none") is None and set(found.pop("none").values()) == {None}
    for c, median in medians.items():
        own = data[c].astype(float)
        assert median == pytest.approx(np.nanmedian(own))
        assert np.allclose([found[c][p] for p in probabilities], np.percentile(own.fillna(median), [p * 100 for p in probabilities]))


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert exact_quantiles(df, ["x"], [0.5]) == {"x": {0.5: None}}
    assert exact_quantiles(df, [], [0.5]) == {}


@SLOW
@given(st.lists(st.integers(-5, 5), min_size=1, max_size=60), st.sampled_from([0.1, 0.25, 0.5, 0.77]))
def test_quantile_property(spark, values, p):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    assert exact_quantiles(df, ["x"], [p], 20)["x"][p] == pytest.approx(np.percentile(values, p * 100))


# --- ordering ---------------------------------------------------------------


def test_ranks_equal_pandas(spark):
    rng = random.Random(5)
    data = pd.DataFrame({"id": [f"{i:04d}" for i in range(700)]})
    # one score holds a third of all rows
    data["score"] = [0.5 if rng.random() < 0.34 else round(rng.random(), 2) for _ in range(700)]
    df = spark.createDataFrame(data).repartition(5)
    out = ranked(df, "score", "id", "rank", "pct").toPandas().sort_values("id").reset_index(drop=True)
    expected_rank = data["score"].rank(method="first", ascending=False).astype(int)
    assert (out["rank"] == expected_rank).all()
    assert sorted(out["rank"]) == list(range(1, 701))
    assert np.allclose(out["pct"], data["score"].rank(pct=True) * 100)
    assert out["pct"].between(0, 100, inclusive="right").all()


def test_numbered_total_and_empty(spark):
    df = spark.range(10).select((-F.col("id")).alias("x"))
    rows = numbered(df, [F.col("x")], "n", total="t").orderBy("n").collect()
    assert [r.x for r in rows] == list(range(-9, 1)) and {r.t for r in rows} == {10}
    assert numbered(df.where("x > 5"), [F.col("x")], "n").count() == 0


def test_long_groups_get_the_same_predecessors(spark):
    """A group with a third of all rows is spread over ranges like any other."""
    rows = [("hot", i, float(i * i)) for i in range(200)] + [(f"k{i % 80}", i, float(i)) for i in range(400)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "k string, o int, v double").repartition(6)
    plain = df.withColumn("before", F.lag("v").over(Window.partitionBy("k").orderBy("o")))
    # Without coalescing, the hot group fills several ranges.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        split = with_previous(df, ["k"], ["o"], "v", "before")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert split.count() == 600
    assert plain.exceptAll(split.select(plain.columns)).isEmpty()
    hot = {r.o: r.before for r in split.where("k = 'hot'").collect()}
    assert hot[0] is None and all(hot[i] == float((i - 1) ** 2) for i in range(1, 200))


def test_small_groups_need_no_range_layout(spark, monkeypatch):
    """Groups get their predecessors from a window; those above the limit from ranges, with equal rows."""
    rows = [("hot", i, i * i) for i in range(50)] + [(k, i, i) for k in ("a", None, "b") for i in range(3)]
    df = spark.createDataFrame(rows, "k string, o int, v int").repartition(4)
    plain = df.withColumn("before", F.lag("v").over(Window.partitionBy("k").orderBy("o")))
    names = []
    staged = ordering.stage
    monkeypatch.setattr(ordering, "stage", lambda df, name: names.append(df.count()) or staged(df, name))
    for limit, laid_out in ((1_000, []), (10, [50])):
        monkeypatch.setattr(ordering, "ONE_TASK", limit)
        names.clear()
        # Without coalescing, the long group fills several ranges.
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            split = with_previous(df, ["k"], ["o"], "v", "before")
        finally:
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        assert split.count() == len(rows) and plain.exceptAll(split.select(plain.columns)).isEmpty()
        assert names == laid_out


# --- consolidation ------------------------------------------------------------


def _matrix_rows(spark):
    rows = [
        (2, "b", "Second", 0, 5.0, "late", 10, 0.5, "x"),
        (1, "b", None, 1, 3.0, None, 20, 0.2, "y"),
        (3, "b", "Third", None, None, "on time", None, None, None),
        (4, "c", "Only", 0, 1.0, None, 1, 0.1, "z"),
    ]
    return spark.createDataFrame(
        rows,
        "o int, id_cliente string, nome_cliente string, teste_01 int, valor_x double, status_y string, "
        "Dias_z int, Perc_w double, outro string",
    )


def test_consolidation_rules(spark):
    out = {r.id_cliente: r for r in co.consolidate(_matrix_rows(spark), "o").collect()}
    b = out["b"]
    assert (b.nome_cliente, b.status_y, b.outro) == ("Second", "late", "y")
    assert (b.teste_01, b.valor_x, b.Dias_z, b.Perc_w) == (1, 5.0, 20, 0.5)
    assert b.qtd_linhas_consolidadas == 3 and out["c"].qtd_linhas_consolidadas == 1
    assert "o" not in b.asDict()


def test_consolidation_does_not_depend_on_layout_and_is_idempotent(spark):
    df = _matrix_rows(spark)
    once = co.consolidate(df, "o")
    shuffled = co.consolidate(df.orderBy(F.rand(7)).repartition(4), "o")
    assert once.exceptAll(shuffled).isEmpty()
    again = co.consolidate(once)
    assert again.drop(co.ROWS).exceptAll(once.drop(co.ROWS)).isEmpty()
    assert {r[co.ROWS] for r in again.collect()} == {1}


def test_old_model_columns_and_old_row_count_go(spark):
    df = spark.createDataFrame(
        [("a", 1.0, 2.0, 3.0, 9)], "id_cliente string, score_IForest_v1 double, pca_1 double, x_isolation_forest double, qtd_linhas_consolidadas int"
    )
    row = co.consolidate(df).first().asDict()
    assert row == {"id_cliente": "a", "qtd_linhas_consolidadas": 1}


def test_rejected_keys_and_checks(spark):
    df = spark.createDataFrame([(" a ", 1), ("a", 2), ("", 3), ("  ", 4), (None, 5)], "id_cliente string, x int")
    kept, rejected = co.checked_input(df)
    assert [r.id_cliente for r in kept.collect()] == ["a", "a"]
    assert sorted(r.x for r in rejected.collect()) == [3, 4, 5]
    assert co.input_checks(df).first().asDict() == {
        "linhas_originais": 5, "linhas_id_nulo": 1, "linhas_id_em_branco": 2, "clientes_unicos": 1, "linhas_duplicadas": 1,
    }
    with pytest.raises(ValueError):
        co.checked_input(spark.range(1))


# --- numbers ------------------------------------------------------------------


def test_number_notation_is_chosen_per_column(spark):
    rows = [(f"{i}.5", f"1.{i:03d},25", f"{i},5" if i < 4 else f"{i}.0", "1d", "nan") for i in range(100)]
    df = spark.createDataFrame(rows, "plain string, br string, few string, odd string, nothing string")
    assert brazilian_columns(df, df.columns) == {"br"}
    out = as_numbers(df, df.columns).collect()
    assert out[7].plain == 7.5 and out[7].br == 1007.25
    assert out[2].few is None and out[7].few == 7.0
    assert out[0].odd is None and out[0].nothing is None


def test_exactly_95_percent_stays_plain(spark):
    df = spark.createDataFrame([("1.5",)] * 95 + [("1,5",)] * 5, "x string")
    assert brazilian_columns(df, ["x"]) == set()
    df = spark.createDataFrame([("1",)] * 94 + [("1,5",)] * 6, "x string")
    assert brazilian_columns(df, ["x"]) == {"x"}


# --- sampling -----------------------------------------------------------------


def test_sample_has_exact_size_and_repeats(spark):
    df = spark.range(5_000).select(F.col("id").cast("string").alias("k"))
    first = {r.k for r in fixed_size_sample(df, "k", 300, 42).collect()}
    again = {r.k for r in fixed_size_sample(df.repartition(9), "k", 300, 42).collect()}
    assert len(first) == 300 and first == again
    assert first != {r.k for r in fixed_size_sample(df, "k", 300, 43).collect()}
    assert fixed_size_sample(df, "k", 9_000, 42).count() == 5_000
    assert fixed_size_sample(df.where("k = 'none'"), "k", 5, 1).count() == 0


# --- features -----------------------------------------------------------------


def test_scaling_follows_imputation(spark):
    data = pd.DataFrame({"id": list("abcdefgh"), "x": [1, 2, None, 4, None, 9, None, 3], "flag": [0, 0, 0, 0, 0, 0, 0, 1]})
    df = spark.createDataFrame(
        [(r.id, None if pd.isna(r.x) else float(r.x), float(r.flag), None) for r in data.itertuples()],
        "id string, x double, flag double, empty double",
    )
    stats = feature_stats(df, ["x", "flag", "empty"])
    filled = data["x"].fillna(data["x"].median())
    spread = np.percentile(filled, 75) - np.percentile(filled, 25)
    out = df.select("id", *stats.scaled_columns()).toPandas().sort_values("id")
    assert np.allclose(out["x"], (filled - filled.median()) / spread)
    assert list(out["flag"]) == list(data["flag"])  # zero quartile range: divided by 1
    assert stats.medians["empty"] is None and "empty" not in stats.variables


# --- indicators ---------------------------------------------------------------


def test_indicators_clean_and_score(spark):
    df = spark.createDataFrame(
        [("a", "3", "0.7", "5", None, 2.0, 0.0), ("b", None, "-1", "1", 4.0, 1.0, 4.0)],
        "id_cliente string, teste_01 string, teste_04 string, score_teste_01 string, criticidade_teste_01 double, "
        "valor_total_devolvido_cliente double, valor_total_faturado_cliente double",
    )
    out = {r.id_cliente: r for r in with_indicators(df).collect()}
    a, b = out["a"], out["b"]
    assert (a.teste_01, a.teste_04, b.teste_01, b.teste_04) == (1, 0, 0, 0)
    assert a.qtd_testes_com_indicio == 1 and a.score_ponderado_binario == 3
    assert a.score_ponderado_auditoria == 5.0 and a.nivel_prioridade_score == "Baixo"
    assert b.nivel_prioridade_score == "Sem indício"  # a score of 1
    assert b.score_total_criticidade == 4.0
    assert a.perc_devolucao_sobre_faturamento_recalculado == 0.0  # nothing invoiced
    assert b.perc_devolucao_sobre_faturamento_recalculado == 0.25
    assert a.valor_referencia_priorizacao == 2.0
    assert model_variables(with_indicators(df))[:3] == ["teste_01", "teste_04", "qtd_testes_com_indicio"]


def test_no_model_variable_is_an_error(spark):
    with pytest.raises(ValueError):
        model_variables(spark.createDataFrame([("a",)], "id_cliente string"))
