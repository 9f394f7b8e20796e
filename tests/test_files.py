"""Delimited reader, sinks, and the whole way from files and ledger to reports."""

import pytest
from pyspark.sql import functions as F

from auditrank.operators.iforest import ForestSettings
from auditrank.plans import pipeline
from auditrank.plans.model import LEVEL, RANK, ModelSettings
from auditrank.session import shared_folder, stage
from auditrank.sources.delimited import ROW_ORDER, read_delimited, typed
from auditrank.sources.erp_views import due_date_changes, ledger_views
from auditrank.sources.sinks import write_reports
from auditrank.sources.tables import Ledger, ledger_from_catalog, read_ledger
from catalog.queries_ledger import CENTRE, FIRST, OPEN, RETURNS, REVERSALS

HEADER = ["id_cliente", "nome", "valor_x"]
ROWS = [["1", "São João", "1.5"], ["2", "Ana", ""], ["3", "NA", "7"]]


def _write(tmp_path, separator, encoding, rows=ROWS, header=HEADER):
    path = tmp_path / "in.csv"
    text = "\n".join(separator.join(r) for r in [header, *rows]) + "\n"
    path.write_bytes(text.encode(encoding))
    return str(path)


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "iso-8859-1"])
@pytest.mark.parametrize("separator", [";", ",", "\t", "|"])
def test_separator_and_encoding_are_found(spark, tmp_path, separator, encoding):
    out = read_delimited(spark, _write(tmp_path, separator, encoding)).orderBy("id_cliente")
    assert out.columns == [*HEADER, ROW_ORDER]
    assert [tuple(r)[:3] for r in out.collect()] == [("1", "São João", "1.5"), ("2", "Ana", None), ("3", None, "7")]


def test_names_are_trimmed_and_numbers_typed(spark, tmp_path):
    path = _write(tmp_path, ";", "utf-8", header=[" id_cliente ", "nome", " valor_x"])
    out = typed(read_delimited(spark, path))
    assert dict(out.drop(ROW_ORDER).dtypes) == {"id_cliente": "string", "nome": "string", "valor_x": "double"}


def test_short_rows_are_filled_and_long_rows_rule_a_separator_out(spark, tmp_path):
    short = _write(tmp_path, ";", "utf-8", [["1", "a"], ["2", "b", "3"]])
    assert [r.valor_x for r in read_delimited(spark, short).orderBy("id_cliente").collect()] == [None, "3"]
    for extra in ("9", ""):
        bad = _write(tmp_path, ";", "utf-8", [["1", "a", "2", extra]])
        with pytest.raises(ValueError):
            read_delimited(spark, bad)


def test_quotes_escapes_and_line_breaks(spark, tmp_path):
    path = tmp_path / "q.csv"
    path.write_text('id_cliente,nome\n1,"a, b"\n2,"say \\"hi\\""\n3,"two\nlines"\n')
    out = {r.id_cliente: r.nome for r in read_delimited(spark, str(path)).collect()}
    assert out == {"1": "a, b", "2": 'say "hi"', "3": "two\nlines"}


def test_one_column_is_no_table(spark, tmp_path):
    path = tmp_path / "one.csv"
    path.write_text("id_cliente\n1\n")
    with pytest.raises(ValueError):
        read_delimited(spark, str(path))


def test_input_order_follows_the_file(spark, tmp_path):
    path = _write(tmp_path, ";", "utf-8", [[str(i), "x", str(i)] for i in range(500)])
    ordered = read_delimited(spark, path).repartition(4).orderBy(ROW_ORDER).collect()
    assert [r.id_cliente for r in ordered] == [str(i) for i in range(500)]


def test_matrix_from_file_reads_brazilian_numbers_before_folding(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text(
        "id_cliente;nome_cliente;valor_total_estornos_cliente;teste_01;score_iforest_old\n"
        "1;;900,00;0;1\n1;A;1.200,50;1;1\n1;B;100,00;0;1\n2;C;5,00;0;1\n;D;6,00;0;1\n"
    )
    matrix, rejected = pipeline.matrix_from_file(spark, str(path))
    out = {r.id_cliente: r for r in matrix.collect()}
    assert set(out) == {"1", "2"} and rejected.count() == 1
    assert out["1"].valor_total_estornos_cliente == 1200.5  # as text, 900,00 would win
    assert out["1"].nome_cliente == "A" and out["1"].teste_01 == 1 and out["1"].qtd_linhas_consolidadas == 3
    assert "score_iforest_old" not in matrix.columns


def test_optional_empty_reports_are_skipped(spark, tmp_path):
    empty = spark.range(1).where("id > 5")
    written = write_reports(
        {"a": spark.range(2), "b": empty, "c": None, "d": empty}, str(tmp_path / "r"), "csv", optional=("b",)
    )
    assert written == ["a", "d"]
    assert spark.read.option("header", True).csv(str(tmp_path / "r" / "a")).count() == 2


def test_ledger_to_reports(spark, sf, tmp_path):
    params = pipeline.AuditParams(OPEN, FIRST, REVERSALS, OPEN, CENTRE, returns=RETURNS)
    matrix, rejected = pipeline.matrix_from_ledger(ledger_views(spark, sf), due_date_changes(spark, sf), params)
    rejected = rejected.unionByName(rejected.sparkSession.createDataFrame([(None,), ("",)], "id_cliente string"), allowMissingColumns=True)
    settings = ModelSettings(ForestSettings(trees=20))
    folder = str(tmp_path / "run")
    written = pipeline.write_run(matrix, folder, settings, with_stability=True, rejected=rejected)
    assert "estabilidade_hiperparametros" in written and "pca" in written
    assert spark.read.parquet(f"{folder}/estabilidade_hiperparametros").count() == 6  # the base has 20 trees
    assert spark.read.parquet(f"{folder}/linhas_rejeitadas").count() == 2
    assert spark.read.parquet(f"{folder}/contagem_rejeitadas").collect()[0].asDict() == {
        "linhas_originais": 2, "linhas_id_nulo": 1, "linhas_id_em_branco": 1}
    assert spark.read.parquet(f"{folder}/matriz_consolidada").count() == 149
    scored = spark.read.parquet(f"{folder}/matriz_com_modelo")
    n = scored.count()
    assert n == 149 and scored.select(RANK).distinct().count() == n
    assert {r[LEVEL] for r in scored.select(LEVEL).distinct().collect()} <= {"Crítica", "Alta", "Moderada", "Baixa"}
    summary = {r.indicador: r.valor for r in spark.read.parquet(f"{folder}/resumo_geral").collect()}
    assert summary["clientes_apos_consolidacao"] == str(n) and summary["n_estimators"] == "20"
    assert spark.read.parquet(f"{folder}/top_100_clientes").count() == 100
    assert spark.read.option("header", True).csv(f"{folder}/matriz_com_modelo_csv").count() == n
    assert spark.read.parquet(f"{folder}/grafico_pca").count() == n
    assert spark.read.parquet(f"{folder}/correlacao_testes").count() == 6


def test_rejected_rows_are_counted_while_they_are_written(spark, tmp_path):
    rows = spark.createDataFrame([("1",), (None,), (" ",), ("",), (None,)], "id_cliente string")
    _, rejected = pipeline.checked_input(rows)
    names = ["linhas_originais", "linhas_id_nulo", "linhas_id_em_branco"]
    for k, (given, want) in enumerate([(rejected, (4, 2, 2)), (rejected.where("id_cliente = 'x'"), (0, 0, 0)), (rejected.where("false"), (0, 0, 0))]):
        path = str(tmp_path / str(k))
        counts = pipeline._write_rejected(given, path)
        assert counts.columns == names and [tuple(r) for r in counts.collect()] == [want]
        assert spark.read.parquet(path).count() == want[0]


def test_ledger_readers(spark, sf, tmp_path):
    views = ledger_views(spark, sf)
    paths = {}
    for name in ("kna1", "bseg", "bkpf"):
        paths[name] = str(tmp_path / name)
        getattr(views, name).write.parquet(paths[name])
        spark.read.parquet(paths[name]).createOrReplaceTempView(f"t_{name}")
    stored = read_ledger(spark, paths)
    assert stored.bseg.count() == views.bseg.count()
    assert ledger_from_catalog(spark, {n: f"t_{n}" for n in paths}).kna1.columns == views.kna1.columns
    with pytest.raises(ValueError):
        Ledger(kna1=views.kna1.drop("NAME1"), bseg=views.bseg, bkpf=views.bkpf)


def test_stage_writes_to_the_shared_folder(spark):
    df = stage(spark.range(3).select(F.col("id").alias("x")), "t")
    assert df.inputFiles()[0].split("file:")[-1].lstrip("/").startswith(shared_folder(spark).lstrip("/"))
    assert sorted(r.x for r in df.collect()) == [0, 1, 2]


def test_a_run_is_read_back_by_its_manifest(spark, tmp_path):
    from auditrank.sources.sinks import MANIFEST, read_reports, write_reports

    rows = spark.createDataFrame([(1, "a", None), (2, "b;,", 0.5)], "id int, nome string, v double")
    for fmt in ("parquet", "csv"):
        folder = str(tmp_path / fmt)
        tables = {"linhas": rows, "nada": None, "vazia": rows.where("id > 9"), "contagem": rows.groupBy().count()}
        assert write_reports(tables, folder, fmt, optional=("vazia",)) == ["linhas", "contagem"]
        found = read_reports(spark, folder)
        assert sorted((r.tabela, r.formato, r.linhas) for r in found[MANIFEST].collect()) == [("contagem", fmt, 1), ("linhas", fmt, 2)]
        assert found["linhas"].schema == rows.schema
        assert sorted(found["linhas"].collect()) == sorted(rows.collect())


def test_an_unfinished_run_is_no_run(spark, tmp_path):
    from auditrank.sources.sinks import MANIFEST, read_reports, write_reports

    bad = spark.range(3).select(F.raise_error(F.lit("lost")).alias("x"))
    with pytest.raises(Exception):
        write_reports({"primeira": spark.range(2), "segunda": bad}, str(tmp_path / "run"))
    assert (tmp_path / "run" / "primeira").exists() and not (tmp_path / "run" / MANIFEST).exists()
    with pytest.raises(Exception):
        read_reports(spark, str(tmp_path / "run"))
