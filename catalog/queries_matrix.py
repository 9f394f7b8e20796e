"""Registered queries over the analytic matrix, the model and the reports."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditrank import fixed_values as fv
from auditrank.functions import columns as fx
from auditrank.operators import consolidate as co
from auditrank.operators.exclusion import without_excluded
from auditrank.operators.features import feature_stats, median_table
from auditrank.operators.iforest import fit_forest, with_scores
from auditrank.operators.numbers import as_numbers
from auditrank.operators.ordering import ranked
from auditrank.operators.pca import fit_components, variance_table
from auditrank.operators.sampling import fixed_size_sample
from auditrank.plans import model, reports
from auditrank.plans.matrix import assembled, stacked
from auditrank.plans.pipeline import matrix_from_file
from auditrank.plans.stability import comparison_table, group_ranks, stability
from auditrank.session import shared_folder, stage
from auditrank.sources.delimited import ROW_ORDER, read_delimited, typed
from auditrank.sources.erp_views import ledger_views, sales
from auditrank.sources.sinks import MANIFEST, read_reports, write_csv, write_reports
from catalog.queries_ledger import t01, t02, t03, t04, t05, t06

KEY = co.KEY
#: Fewer than there are customers at any scale of the given tables.
SAMPLE_ROWS = 100


def _results(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """The six tests over one written join of lines, documents and customers."""
    source = sales(spark, sf, staged=True)
    tests = {"teste_01": t01, "teste_02": t02, "teste_03": t03, "teste_04": t04, "teste_05": t05, "teste_06": t06}
    return {name: test(spark, sf, source) for name, test in tests.items()}


def _with_copies(rows: DataFrame) -> DataFrame:
    """Rows with overdue items appear twice, so that ids repeat."""
    # In one pass: a union would read, or compute, the rows twice.
    copies = F.when(F.col("teste_01") == 1, F.array_repeat(F.lit(0), 2)).otherwise(F.array(F.lit(0)))
    return rows.withColumn("_copy", F.explode(copies)).drop("_copy")


def _raw_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return _with_copies(stage(assembled(_results(spark, sf)), "assembled"))


def _matrix(spark: SparkSession, sf: str) -> DataFrame:
    return stage(model.prepared(co.consolidate(_raw_matrix(spark, sf))), "matrix")


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of summation does not show."""
    doubles = [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: F.round(F.col(f"`{c}`"), digits) for c in doubles})


def _features(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, object]:
    matrix = _matrix(spark, sf)
    features, stats = model.scaled_features(matrix)
    return matrix, features, stats


# --- stand-in scores: integer formulas instead of a forest --------------------


def _stand_in(key: str, factor: int) -> Column:
    """A score_samples-like value with ties, from the number of the id."""
    number = F.col(key).cast("bigint") - fv.ID_FLOOR
    return -((number * factor) % 1009).cast("double") / 1009


def _customer_scores(spark: SparkSession, sf: str) -> DataFrame:
    kna1 = ledger_views(spark, sf).kna1
    return kna1.select(
        F.col("KUNNR").alias(KEY), _stand_in("KUNNR", 7919).alias("a"), _stand_in("KUNNR", 6007).alias("b")
    )


def _ranked_customers(spark: SparkSession, sf: str) -> DataFrame:
    scores = _customer_scores(spark, sf).select(KEY, (-F.col("a")).alias("score"))
    return ranked(scores, "score", KEY, "ranking", "percentil")


def _classified(spark: SparkSession, sf: str) -> DataFrame:
    scores = _customer_scores(spark, sf).select(KEY, "a")
    return _rounded(model.classified(scores, "a", fv.CONTAMINATION), 9)


def _scored_stand_in(spark: SparkSession, sf: str) -> DataFrame:
    matrix = _matrix(spark, sf)
    scores = matrix.select(KEY, _stand_in(KEY, 7919).alias("a"))
    return matrix.join(model.classified(scores, "a", fv.CONTAMINATION), KEY)


def rank_compare(spark: SparkSession, sf: str) -> DataFrame:
    scores = _customer_scores(spark, sf).select(KEY, (-F.col("a")).alias("a"), (-F.col("b")).alias("b"))
    ranks = group_ranks(scores, ["a", "b"])
    return _rounded(comparison_table(ranks, "a", {(300, "auto"): "a", (100, "auto"): "b"}), 9)


# --- single operators ---------------------------------------------------------


def numeric_conversion(spark: SparkSession, sf: str) -> DataFrame:
    """Four text columns: plain, Brazilian, a few Brazilian among plain, none."""
    cents = F.round(F.col("c_acctbal") * 100).cast("bigint")
    size = F.abs(cents)
    sign = F.when(cents < 0, "-").otherwise("")
    units, rest = (size - size % 100) / 100, F.lpad((size % 100).cast("string"), 2, "0")
    units = units.cast("bigint")
    plain = F.concat(sign, units.cast("string"), F.lit("."), rest)
    grouped = F.when(
        units >= 1000,
        F.concat(
            F.floor(units / 1000).cast("string"), F.lit("."), F.lpad((units % 1000).cast("string"), 3, "0")
        ),
    ).otherwise(units.cast("string"))
    brazilian = F.concat(sign, grouped, F.lit(","), rest)
    customer = spark.read.parquet(f"{sf}/customer.parquet")
    texts = customer.select(
        F.col("c_custkey").alias("id"),
        plain.alias("direto"),
        brazilian.alias("brasileiro"),
        F.when(F.col("c_custkey") % 40 == 7, brazilian).otherwise(plain).alias("misto"),
        F.col("c_mktsegment").alias("texto"),
    )
    return as_numbers(texts, ["direto", "brasileiro", "misto", "texto"])


def safe_casts(spark: SparkSession, sf: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    dated = F.col("o_orderdate").cast("date")
    status = F.col("o_orderstatus")
    price = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    texts = orders.select(
        "o_orderkey",
        F.when(status == "F", dated.cast("string"))
        .when(status == "O", F.year(dated).cast("string"))
        .otherwise("")
        .alias("d"),
        F.when(status == "P", F.concat(F.col("o_custkey").cast("string"), F.lit("x")))
        .otherwise(F.col("o_custkey").cast("string"))
        .alias("i"),
        F.when(status == "O", F.replace(price, F.lit("."), F.lit(","))).otherwise(price).alias("n"),
    )
    return texts.select(
        "o_orderkey",
        fx.safe_date(texts, "d").alias("data"),
        fx.safe_long(F.col("i")).alias("inteiro"),
        fx.safe_numeric(F.col("n")).alias("valor"),
        fx.not_blank(F.col("d")).cast("int").alias("preenchido"),
    )


def pair_key(spark: SparkSession, sf: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    a, b = F.col("o_orderpriority"), F.nullif("o_orderstatus", F.lit("P"))
    low, high = fx.strict_least(a, b), fx.strict_greatest(a, b)
    return orders.select(
        "o_orderkey", low.alias("menor"), high.alias("maior"), F.concat(low, F.lit("|"), high).alias("chave")
    )


def string_lists(spark: SparkSession, sf: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    open_only = F.nullif("o_orderstatus", F.lit("F"))
    return orders.groupBy("o_custkey").agg(
        fx.sorted_list(F.col("o_orderpriority")).alias("prioridades"), fx.sorted_list(open_only).alias("abertos")
    )


def exclusion_anti(spark: SparkSession, sf: str) -> DataFrame:
    """Customers left after dropping those with a large order: list from a table."""
    customer = spark.read.parquet(f"{sf}/customer.parquet")
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    large = orders.where(F.col("o_totalprice") > 450_000).select(F.col("o_custkey").alias("id"))
    return without_excluded(customer, "c_custkey", large).select("c_custkey", "c_name")


def exclusion_forms(spark: SparkSession, sf: str) -> DataFrame:
    """One list in every form, over keys that are NULL in places."""
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    keyed = orders.select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("chave"))
    listed = ["1-URGENT", "5-LOW"]
    table = orders.where(F.col("o_orderpriority").isin(listed)).select(F.col("o_orderpriority").alias("id"))
    forms = {
        "lista": listed,
        "lista_longa": [*listed, *(f"x{i}" for i in range(2_000))],
        "tabela": table,
        "lista_vazia": [],
        "tabela_vazia": table.where("id IS NULL"),
    }
    parts = [
        without_excluded(keyed, "chave", ids).groupBy("chave").agg(F.count("*").alias("linhas")).select(F.lit(form).alias("forma"), "*")
        for form, ids in forms.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def _file_matrix(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Orders as a delimited matrix: ids that repeat or are blank, Brazilian
    numbers, padded names, a column of an old model, semicolons and ISO-8859-1."""
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    units, rest = F.floor(cents / 100), F.lpad((cents % 100).cast("string"), 2, "0")
    thousands = F.regexp_replace(units.cast("string"), r"(?<=\d)(?=(\d{3})+$)", ".")
    grouped = F.concat(thousands, F.lit(","), rest)
    blank = F.when(F.col("o_orderpriority") == "5-LOW", "  ").otherwise(F.concat(F.lit(" "), F.col("o_custkey").cast("string")))
    text = orders.select(
        blank.alias(" id_cliente "),
        F.when(F.col("o_orderstatus") == "P", "").otherwise(F.lit("Código São João")).alias("nome_cliente"),
        grouped.alias("valor_pedido "),
        (F.col("o_orderkey") % 7).cast("string").alias("qtd_itens"),
        F.lit("1").alias("score_iforest_v1"),
    )
    path = f"{shared_folder(spark)}/matrix-{uuid.uuid4().hex}"
    text.write.option("header", True).option("sep", ";").option("encoding", "ISO-8859-1").option(
        "ignoreLeadingWhiteSpace", False
    ).option("ignoreTrailingWhiteSpace", False).csv(path)
    matrix, rejected = matrix_from_file(spark, path)
    return _rounded(matrix), rejected.agg(F.count("*").alias("linhas"), F.count_distinct(KEY).alias("chaves"))


def input_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Order rows as a matrix whose key is blank or missing in places."""
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    key = F.when(F.col("o_orderpriority") == "5-LOW", "  ").when(
        F.col("o_orderstatus") != "P", F.concat(F.lit(" "), F.col("o_custkey").cast("string"))
    )
    return co.input_checks(orders.select(key.alias(KEY)))


def delimited(spark: SparkSession, sf: str) -> DataFrame:
    """Customers written as delimited text and read back without hints."""
    customer = spark.read.parquet(f"{sf}/customer.parquet")
    path = f"{shared_folder(spark)}/customers-{uuid.uuid4().hex}"
    write_csv(customer.select(F.col("c_custkey").alias("id_cliente"), "c_name", "c_acctbal", "c_mktsegment"), path)
    return typed(read_delimited(spark, path)).drop(ROW_ORDER)


# --- reports --------------------------------------------------------------------


def medians(spark: SparkSession, sf: str) -> DataFrame:
    matrix = _matrix(spark, sf)
    variables = model.model_variables(matrix)
    numbers = as_numbers(matrix.select(KEY, *variables), variables)
    return _rounded(median_table(matrix, feature_stats(numbers, variables)))


def scaled(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_features(spark, sf)[1])


def described(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(reports.described(_scored_stand_in(spark, sf)), 4)


def top100(spark: SparkSession, sf: str) -> DataFrame:
    top = reports.top_customers(_scored_stand_in(spark, sf))
    return top.withColumn(model.SCORE, F.round(model.SCORE, 9))


def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    scored = _scored_stand_in(spark, sf)
    return reports.run_summary(scored, len(model.model_variables(scored)), model.ModelSettings())


def reports_written(spark: SparkSession, sf: str) -> DataFrame:
    """The report tables written to a folder, and what its manifest leads back to."""
    scored = stage(_scored_stand_in(spark, sf), "scored")
    summary = reports.summary_by_test(scored)
    correlation = reports.correlation_of_tests(scored)
    tables = {
        "resumo_geral": reports.run_summary(scored, len(model.model_variables(scored)), model.ModelSettings()),
        "resumo_testes": summary,
        "estatistica_descritiva": reports.described(scored),
        "correlacao_testes": reports.correlation_matrix(correlation),
        "top_100_clientes": reports.top_customers(scored),
        "sensibilidade_contaminacao": reports.sensitivity(scored),
        "pca": None,
        "vazia": scored.where("1 = 0"),
        "grafico_clientes_por_teste": reports.flag_counts(summary),
        "grafico_scores": reports.score_pairs(scored),
        "grafico_correlacao": correlation,
    }
    folder = f"{shared_folder(spark)}/reports-{uuid.uuid4().hex}"
    write_reports(tables, folder, optional=("vazia", "correlacao_testes"))
    found = read_reports(spark, folder)
    manifest = found.pop(MANIFEST).select("tabela", "formato", "linhas")
    read = [df.agg(F.count("*").alias("lidas")).select(F.lit(name).alias("tabela"), "lidas") for name, df in found.items()]
    return manifest.join(reduce(DataFrame.unionByName, read), "tabela")


def iforest_scores(spark: SparkSession, sf: str) -> DataFrame:
    _, features, stats = _features(spark, sf)
    forest = fit_forest(features, KEY, stats.variables, model.ModelSettings().forest)
    return _rounded(with_scores(features, [(forest, {forest.trees: "score_samples"})]), 9)


def iforest_rank(spark: SparkSession, sf: str) -> DataFrame:
    settings = model.ModelSettings(with_pca=False)
    run = model.run_model(co.consolidate(_raw_matrix(spark, sf)), settings)
    return _rounded(run.matrix.select(KEY, model.SCORE, model.FLAG, model.RANK, model.PERCENTILE, model.LEVEL), 9)


def pca_projection(spark: SparkSession, sf: str) -> DataFrame:
    _, features, stats = _features(spark, sf)
    features = stage(_rounded(features), "features")
    components = fit_components(features, stats.variables)
    columns = [F.col(v) for v in stats.variables]
    projected = (components.projection(i, columns).alias(f"pca_{i + 1}") for i in range(2))
    return _rounded(features.select(KEY, *projected), 4)


def pca_variance(spark: SparkSession, sf: str) -> DataFrame:
    _, features, stats = _features(spark, sf)
    features = stage(_rounded(features), "features")
    return _rounded(variance_table(features, fit_components(features, stats.variables)))


def stability_study(spark: SparkSession, sf: str) -> DataFrame:
    matrix, features, stats = _features(spark, sf)
    run = model.ModelSettings(with_pca=False)
    forest = fit_forest(features, KEY, stats.variables, run.forest)
    scores = with_scores(features, [(forest, {forest.trees: "score_samples"})])
    scored = scores.select(KEY, (-F.col("score_samples")).alias(model.SCORE))
    return _rounded(stability(scored, features, stats.variables), 9)


MATRIX_QUERIES = {
    "exclusion_anti": exclusion_anti,
    "pair_key": pair_key,
    "string_lists": string_lists,
    "safe_casts": safe_casts,
    "numeric_conversion": numeric_conversion,
    "input_checks": input_checks,
    "read_delimited": delimited,
    "matrix_assembled": lambda s, sf: assembled(_results(s, sf)),
    "matrix_consolidated": lambda s, sf: co.consolidate(_with_copies(stacked(_results(s, sf)))),
    "duplicate_diagnostics": lambda s, sf: co.input_checks(_raw_matrix(s, sf)),
    "matrix_indicators": _matrix,
    "feature_medians": medians,
    "features_scaled": scaled,
    "describe_long": described,
    "test_summary": lambda s, sf: _rounded(reports.summary_by_test(_matrix(s, sf)), 9),
    "test_correlation": lambda s, sf: _rounded(reports.correlation_of_tests(_matrix(s, sf)), 9),
    "sensitivity": lambda s, sf: reports.sensitivity(_matrix(s, sf)),
    "rank_first": lambda s, sf: _ranked_customers(s, sf).select(KEY, "score", "ranking"),
    "rank_pct_avg": lambda s, sf: _rounded(_ranked_customers(s, sf).select(KEY, "percentil"), 9),
    "priority_level": _classified,
    "rank_compare": rank_compare,
    "top100": top100,
    "run_summary": run_summary,
    "reports_written": reports_written,
    "chart_flag_counts": lambda s, sf: reports.flag_counts(reports.summary_by_test(_matrix(s, sf))),
    "chart_score_pairs": lambda s, sf: _rounded(reports.score_pairs(_scored_stand_in(s, sf)), 9),
    "sample_fixed_size": lambda s, sf: fixed_size_sample(
        ledger_views(s, sf).kna1.select("KUNNR", "NAME1"), "KUNNR", SAMPLE_ROWS, fv.SEED
    ),
    "exclusion_forms": exclusion_forms,
    "file_matrix": lambda s, sf: _file_matrix(s, sf)[0],
    "file_rejects": lambda s, sf: _file_matrix(s, sf)[1],
    "iforest_scores": iforest_scores,
    "iforest_rank": iforest_rank,
    "pca_projection": pca_projection,
    "pca_variance": pca_variance,
    "chart_pca": lambda s, sf: reports.pca_sample(pca_projection(s, sf), SAMPLE_ROWS),
    "stability": stability_study,
}
