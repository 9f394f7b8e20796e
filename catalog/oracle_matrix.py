"""DuckDB twins of the matrix, indicator, ranking and report queries."""

from __future__ import annotations

from auditrank import fixed_values as fv
from catalog.oracle_ledger import T01, T02, T03, T04, T05, T06
from catalog.sqlparts import chain

TESTS = list(fv.TESTS)
AMOUNTS = [
    "valor_total_titulos_vencidos_abertos_30d", "valor_primeira_compra", "valor_total_estornos_cliente",
    "maior_valor_estorno_cliente", "saldo_total_aberto_cliente", "maior_saldo_aberto_em_um_centro",
    "valor_total_titulos_prorrogados", "maior_valor_titulo_prorrogado", "valor_total_faturado_cliente",
    "valor_total_devolvido_cliente",
]
REFERENCE_VALUES = list(fv.REFERENCE_VALUE_COLUMNS)
COUNTS = [
    "qtd_titulos_vencidos_abertos_30d", "qtd_estornos_cliente", "qtd_usuarios_estorno", "qtd_titulos_abertos_cliente",
    "qtd_titulos_prorrogados_cliente", "qtd_prorrogacoes_cliente", "qtd_notas_faturadas_cliente",
    "qtd_notas_devolucao_cliente", "maior_dias_vencido_teste_01", "dias_atraso_primeira_compra",
    "maior_perc_cliente_sobre_centro", "perc_devolucao_sobre_faturamento", "dias_prorrogados_total_cliente",
    "maior_dias_prorrogados_mesmo_titulo", "maior_prorrogacao_individual_dias",
]
ORDINALS = [f"{kind}_{t}" for kind in ("criticidade", "score") for t in TESTS]
TEXTS = ["nome_cliente", "nivel_risco_teste_02", "nivel_risco_teste_03"]
FOLDED = [*TESTS, *ORDINALS, *COUNTS, *AMOUNTS]

VARIABLES = [*TESTS, *fv.FREQUENCY_VARIABLES, *fv.CONTINUOUS_VARIABLES, *ORDINALS, *fv.TOTAL_SCORES]
DESCRIBED = list(fv.DESCRIBED_VARIABLES)

_fold = ", ".join([f"max({c}) AS {c}" for c in FOLDED] + [f"min({c}) AS {c}" for c in TEXTS])
_doubled = ", ".join(f"CAST(COALESCE({c}, 0) AS DOUBLE) AS {c}" for c in [*ORDINALS, *REFERENCE_VALUES])
_plus = " + ".join
_weights = dict(fv.BINARY_WEIGHTS)

MATRIX = T01 | T02 | T03 | T04 | T05 | T06 | {
    "stacked": """
SELECT * FROM t01_result
UNION ALL BY NAME
SELECT id_cliente, nome_cliente, teste_02_cliente_inadimplente_primeira_compra AS teste_02, criticidade_teste_02,
       score_teste_02, nivel_risco_teste_02, valor_primeira_compra, dias_atraso_primeira_compra FROM t02_result
UNION ALL BY NAME
SELECT id_cliente, nome_cliente, teste_03_alto_volume_estornos_financeiros AS teste_03, criticidade_teste_03,
       score_teste_03, nivel_risco_teste_03, qtd_estornos_cliente, qtd_usuarios_estorno,
       valor_total_estornos_cliente, maior_valor_estorno_cliente FROM t03_result
UNION ALL BY NAME SELECT * FROM t04_result
UNION ALL BY NAME SELECT * FROM t05_result
UNION ALL BY NAME SELECT * FROM t06_result""",
    "folded": f"SELECT id_cliente, {_fold} FROM stacked GROUP BY 1",
    "matrix_assembled": "SELECT * REPLACE ("
    + ", ".join(f"COALESCE({t}, 0) AS {t}" for t in TESTS)
    + ") FROM folded",
    "matrix_consolidated": f"""
SELECT id_cliente, {_fold}, count(*) AS qtd_linhas_consolidadas
FROM (SELECT * FROM stacked UNION ALL SELECT * FROM stacked WHERE teste_01 = 1) GROUP BY 1""",
    "raw_matrix": "SELECT * FROM matrix_assembled UNION ALL SELECT * FROM matrix_assembled WHERE teste_01 = 1",
    "duplicate_diagnostics": """
SELECT count(*) AS linhas_originais, 0 AS linhas_id_nulo, 0 AS linhas_id_em_branco,
       count(DISTINCT id_cliente) AS clientes_unicos, count(*) - count(DISTINCT id_cliente) AS linhas_duplicadas
FROM raw_matrix""",
    "cleaned": f"""
SELECT * REPLACE ({_doubled})
FROM (SELECT id_cliente, {_fold}, count(*) AS qtd_linhas_consolidadas FROM raw_matrix GROUP BY 1)""",
    "totals": f"""
SELECT *, {_plus(TESTS)} AS qtd_testes_com_indicio,
       {_plus([f"score_{t}" for t in TESTS])} AS score_ponderado_auditoria,
       {_plus([f"criticidade_{t}" for t in TESTS])} AS score_total_criticidade,
       {_plus([f"{t} * {w}" for t, w in _weights.items()])} AS score_ponderado_binario,
       {_plus(REFERENCE_VALUES)} AS valor_referencia_priorizacao,
       CASE WHEN valor_total_faturado_cliente > 0
            THEN valor_total_devolvido_cliente / CAST(valor_total_faturado_cliente AS DOUBLE)
            ELSE 0 END AS perc_devolucao_sobre_faturamento_recalculado
FROM cleaned""",
    "matrix_indicators": """
SELECT *, CASE WHEN score_ponderado_auditoria >= 10 THEN 'Alto' WHEN score_ponderado_auditoria >= 6 THEN 'Médio'
               WHEN score_ponderado_auditoria >= 3 THEN 'Baixo' ELSE 'Sem indício' END AS nivel_prioridade_score,
       CASE WHEN score_ponderado_auditoria >= 10 THEN 1 ELSE 0 END AS label_operacional_alto_risco_proxy
FROM totals""",
}


def _per(names, sql: str) -> str:
    return "\nUNION ALL ".join(sql.format(v=v) for v in names)


FEATURES = MATRIX | {
    "numbers": "SELECT id_cliente, " + ", ".join(f"CAST({v} AS DOUBLE) AS {v}" for v in VARIABLES)
    + " FROM matrix_indicators",
    "medians": "SELECT " + ", ".join(f"quantile_cont({v}, 0.5) AS {v}" for v in VARIABLES) + " FROM numbers",
    "feature_medians": _per(
        VARIABLES, "SELECT '{v}' AS variavel, round({v}, 6) AS mediana_imputacao FROM medians"
    ),
    "ranges": "SELECT "
    + ", ".join(
        f"quantile_cont(COALESCE(n.{v}, m.{v}), 0.75) - quantile_cont(COALESCE(n.{v}, m.{v}), 0.25) AS {v}"
        for v in VARIABLES
    )
    + " FROM numbers n CROSS JOIN medians m",
    "features": "SELECT id_cliente, "
    + ", ".join(
        f"(COALESCE(n.{v}, m.{v}) - m.{v}) / CASE WHEN r.{v} < 1e-14 THEN 1 ELSE r.{v} END AS {v}" for v in VARIABLES
    )
    + " FROM numbers n CROSS JOIN medians m CROSS JOIN ranges r",
    "features_scaled": "SELECT id_cliente, " + ", ".join(f"round({v}, 6) AS {v}" for v in VARIABLES) + " FROM features",
}


def _uniform(purpose: str) -> str:
    """A number in [0, 1) from the beginning of an MD5."""
    return f"CAST('0x' || left(md5({purpose}), 13) AS BIGINT) / 4503599627370496::DOUBLE"


def _mean_path(n: str) -> str:
    return (
        f"CASE WHEN {n} <= 1 THEN 0 WHEN {n} = 2 THEN 1 ELSE "
        f"round((2 * (ln({n} - 1.0::DOUBLE) + 0.5772156649015329) - 2 * ({n} - 1.0::DOUBLE) / {n}) * 1073741824) / 1073741824 END"
    )


def _forest(name: str, trees: int, sample: int, depth: int) -> dict[str, str]:
    """All customers sent down all trees of a forest, level by level; ``{name}_paths`` has
    the length of each path.  A node is cut by the rows of the tree's sample in it."""
    parts = {
        f"{name}_sizes": f"""
SELECT size, greatest(1, n // size) AS per, CAST(ceil(log2(greatest(size, 2))) AS INTEGER) AS deepest
FROM (SELECT count(*) AS n, least({sample}, count(*)) AS size FROM features)""",
        f"{name}_dealt": f"""
SELECT id_cliente, r * per + place // size AS tree
FROM (SELECT id_cliente, r, row_number() OVER (PARTITION BY r ORDER BY left(md5(id_cliente || '|42|' || r), 13), id_cliente) - 1 AS place
      FROM features, (SELECT unnest(range({trees})) AS r), {name}_sizes WHERE r * per < {trees}), {name}_sizes
WHERE place // size < per AND r * per + place // size < {trees}""",
        f"{name}_rows_0": f"""
SELECT t.tree, f.id_cliente, 0 AS node, d.tree IS NOT NULL AS sampled
FROM (SELECT unnest(range({trees})) AS tree) t CROSS JOIN feature_lists f
LEFT JOIN {name}_dealt d ON d.tree = t.tree AND d.id_cliente = f.id_cliente""",
    }
    spans = ", ".join(f"{{'i': {i}, 'low': min({v}), 'high': max({v})}}" for i, v in enumerate(VARIABLES, 1))
    for level in range(depth + 1):
        rows, cuts = f"{name}_rows_{level}", f"{name}_cuts_{level}"
        parts[cuts] = f"""
SELECT tree, node, n, pick.i AS i, CASE WHEN cut >= pick.high THEN pick.low ELSE cut END AS cut
FROM (SELECT tree, node, n, pick, pick.low + {_uniform("'42|' || tree || '|' || node || '|cut'")} * (pick.high - pick.low) AS cut
      FROM (SELECT tree, node, n,
                   CASE WHEN n > 1 AND {level} < deepest
                        THEN varying[1 + CAST(floor({_uniform("'42|' || tree || '|' || node || '|feature'")} * len(varying)) AS INTEGER)] END AS pick
            FROM (SELECT tree, node, n, list_filter(spans, lambda s: s.high > s.low) AS varying
                  FROM (SELECT tree, node, count(*) AS n, [{spans}] AS spans
                        FROM {rows} JOIN features USING (id_cliente) WHERE sampled GROUP BY tree, node)), {name}_sizes))"""
        parts[f"{name}_done_{level}"] = f"""
SELECT tree, id_cliente, {level} + {_mean_path("n")} AS path FROM {rows} JOIN {cuts} USING (tree, node) WHERE i IS NULL"""
        parts[f"{name}_rows_{level + 1}"] = f"""
SELECT tree, id_cliente, 2 * node + CASE WHEN x[i] <= cut THEN 1 ELSE 2 END AS node, sampled
FROM {rows} JOIN {cuts} USING (tree, node) JOIN feature_lists USING (id_cliente) WHERE i IS NOT NULL"""
    parts[f"{name}_paths"] = "\nUNION ALL ".join(f"SELECT * FROM {name}_done_{level}" for level in range(depth + 1))
    return parts


def _score(name: str, trees: int) -> str:
    return f"-pow(2, -sum(path) FILTER (tree < {trees}) / ({trees} * (SELECT {_mean_path('size')} FROM {name}_sizes)))"


FOREST = FEATURES | {
    "feature_lists": f"SELECT id_cliente, [{', '.join(VARIABLES)}] AS x FROM features",
    **_forest("auto", 500, 256, 8),
    **_forest("larger", 300, 512, 9),
    "auto_scores": "SELECT id_cliente, "
    + ", ".join(f"{_score('auto', n)} AS a{n}" for n in (100, 200, 300, 500))
    + " FROM auto_paths GROUP BY 1",
    "larger_scores": f"SELECT id_cliente, {_score('larger', 300)} AS b300 FROM larger_paths GROUP BY 1",
    "iforest_scores": "SELECT id_cliente, round(a300, 9) AS score_samples FROM auto_scores",
    "forest_samples": "SELECT id_cliente, a300 AS a FROM auto_scores",
}

def _leading(matrix: str, rounds: int = 600) -> str:
    """Leading eigenvector by power iteration, its largest loading positive, and
    its eigenvalue."""
    return f"""
SELECT list_transform(v, lambda x: x * sign(v[list_position(list_transform(v, lambda y: abs(y)), list_max(list_transform(v, lambda y: abs(y))))])) AS v,
       list_dot_product(v, list_transform(cov, lambda r: list_dot_product(r, v))) AS size
FROM {matrix}, (
  WITH RECURSIVE steps AS (
    SELECT 0 AS k, list_transform(cov, lambda r, i: 1.0::DOUBLE + i / 100.0) AS v FROM {matrix}
    UNION ALL
    SELECT k + 1, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w)))
    FROM (SELECT k, list_transform(cov, lambda r: list_dot_product(r, v)) AS w FROM steps, {matrix} WHERE k < {rounds})
  ) SELECT v FROM steps WHERE k = {rounds})"""


#: Covariance of the scaled variables, two leading vectors with deflation.
COMPONENTS = FEATURES | {
    "long_features": "SELECT id_cliente, v AS name, x, x - avg(x) OVER (PARTITION BY v) AS d "
    "FROM (UNPIVOT features_scaled ON COLUMNS(* EXCLUDE id_cliente) INTO NAME v VALUE x)",
    "pairs_cov": "SELECT a.name AS i, b.name AS j, sum(a.d * b.d) / (count(*) - 1) AS c "
    "FROM long_features a JOIN long_features b USING (id_cliente) GROUP BY ALL",
    "cov1": "SELECT list(r ORDER BY i) AS cov, list(i ORDER BY i) AS names "
    "FROM (SELECT i, list(c ORDER BY j) AS r FROM pairs_cov GROUP BY i)",
    "lead1": _leading("cov1"),
    "cov2": "SELECT list_transform(cov, lambda r, i: list_transform(r, lambda c, j: c - size * v[i] * v[j])) AS cov FROM cov1, lead1",
    "lead2": _leading("cov2"),
    "loadings": "SELECT unnest(names) AS name, unnest(a.v) AS w1, unnest(b.v) AS w2 FROM cov1, lead1 a, lead2 b",
    "pca_projection": "SELECT id_cliente, round(sum(d * w1), 4) AS pca_1, round(sum(d * w2), 4) AS pca_2 "
    "FROM long_features JOIN loadings USING (name) GROUP BY 1",
    "chart_pca": "SELECT * FROM pca_projection ORDER BY left(md5(id_cliente || '|42'), 15), 1 LIMIT 100",
    "shares": "SELECT a.size / t AS s1, b.size / t AS s2 FROM lead1 a, lead2 b, "
    "(SELECT sum(c) AS t FROM pairs_cov WHERE i = j)",
    "pca_variance": """
SELECT unnest(['PCA 1', 'PCA 2', 'PCA 1 + PCA 2']) AS componente,
       unnest([round(s1, 6), round(s2, 6), round(s1 + s2, 6)]) AS variancia_explicada,
       unnest([round(s1 * 100, 6), round(s2 * 100, 6), round((s1 + s2) * 100, 6)]) AS variancia_explicada_percentual
FROM shares""",
}

REPORTS = MATRIX | {
    "test_summary": _per(
        TESTS,
        "SELECT '{v}' AS teste, CAST(sum({v}) AS BIGINT) AS clientes_com_indicio, "
        "round(avg({v}), 9) AS percentual_clientes_com_indicio, round(avg(score_{v}), 9) AS score_medio, "
        "round(avg(criticidade_{v}), 9) AS criticidade_media FROM matrix_indicators",
    ),
    "chart_flag_counts": "SELECT teste, clientes_com_indicio FROM test_summary",
    "test_correlation": "\nUNION ALL ".join(
        f"SELECT '{a}' AS teste_a, '{b}' AS teste_b, round(CASE WHEN stddev_samp({a}) * stddev_samp({b}) > 0 "
        f"THEN covar_samp({a}, {b}) / (stddev_samp({a}) * stddev_samp({b})) END, 9) AS correlacao "
        "FROM matrix_indicators"
        for a in TESTS
        for b in TESTS
    ),
    "sensitivity": """
SELECT c AS contaminacao, c * 100 AS percentual, CAST(ceil(n * c) AS BIGINT) AS clientes_priorizados_aproximados
FROM (SELECT CAST(count(*) AS DOUBLE) AS n FROM matrix_indicators)
CROSS JOIN (SELECT unnest([0.01::DOUBLE, 0.03::DOUBLE, 0.05::DOUBLE, 0.10::DOUBLE]) AS c)""",
}

# Same integer stand-in for score_samples as on the Spark side.
_STAND_IN = "-CAST(({n} * {f}) % 1009 AS DOUBLE) / 1009"


def _classify(source: str, digits: int) -> dict[str, str]:
    """Score, flag, rank, percentile, level from column a of ``source``."""
    return {
        "classified": f"""
SELECT id_cliente, round(s, {digits}) AS score_anomalia_iforest_v4, f AS cliente_atipico_iforest_v4,
       row_number() OVER (ORDER BY s DESC, id_cliente) AS ranking_anomalia_iforest_v4,
       round(p, {digits}) AS percentil_anomalia_iforest_v4,
       CASE WHEN p >= 99 THEN 'Crítica' WHEN p >= 95 THEN 'Alta' WHEN p >= 90 THEN 'Moderada' ELSE 'Baixa' END
         AS nivel_prioridade_iforest_v4
FROM (SELECT *, (rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0)
              / CAST(count(*) OVER () AS DOUBLE) * 100 AS p
      FROM (SELECT id_cliente, (SELECT quantile_cont(a, 0.05) FROM {source}) - a AS s,
                   CASE WHEN a < (SELECT quantile_cont(a, 0.05) FROM {source}) THEN 1 ELSE 0 END AS f
            FROM {source}))"""
    }


FOREST_RANK = FOREST | {**_classify("forest_samples", 9), "iforest_rank": "SELECT * FROM classified"}
STABILITY = FOREST | {
    "forest_ranks": "SELECT "
    + ", ".join(
        f"row_number() OVER (ORDER BY {c}, id_cliente) AS {c}" for c in ("a100", "a200", "a300", "a500", "b300")
    )
    + " FROM auto_scores JOIN larger_scores USING (id_cliente)",
    "stability": "\nUNION ALL ".join(
        f"SELECT {trees} AS n_estimators, '{samples}' AS max_samples, "
        f"round(corr(a300, {r}), 9) AS correlacao_spearman_ranking, "
        + ", ".join(
            f"round(count(*) FILTER (a300 <= {k} AND {r} <= {k}) / CAST(greatest(1, count(*) FILTER (a300 <= {k})) AS DOUBLE), 9)"
            f" AS sobreposicao_top{k}"
            for k in fv.STABILITY_TOPS
        )
        + " FROM forest_ranks"
        for trees, samples in fv.STABILITY_SETTINGS
        for r in (f"b{trees}" if samples == "512" else f"a{trees}",)
    ),
}

CUSTOMERS = {
    "customer_scores": f"""
SELECT CAST(1000000000 + c_custkey AS VARCHAR) AS id_cliente, {_STAND_IN.format(n="c_custkey", f=7919)} AS a,
       {_STAND_IN.format(n="c_custkey", f=6007)} AS b FROM customer""",
    "rank_first": """
SELECT id_cliente, -a AS score, row_number() OVER (ORDER BY -a DESC, id_cliente) AS ranking FROM customer_scores""",
    "rank_pct_avg": """
SELECT id_cliente, round((rank() OVER (ORDER BY -a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0)
         / CAST(count(*) OVER () AS DOUBLE) * 100, 9) AS percentil FROM customer_scores""",
    **_classify("customer_scores", 9),
    "priority_level": "SELECT * FROM classified",
    "ranks": """
SELECT row_number() OVER (ORDER BY -a DESC, id_cliente) AS ra, row_number() OVER (ORDER BY -b DESC, id_cliente) AS rb
FROM customer_scores""",
    "rank_compare": "\nUNION ALL ".join(
        f"SELECT {trees} AS n_estimators, 'auto' AS max_samples, "
        f"round(corr(ra, {r}), 9) AS correlacao_spearman_ranking, "
        + ", ".join(
            f"round(count(*) FILTER (ra <= {k} AND {r} <= {k}) / CAST(greatest(1, count(*) FILTER (ra <= {k})) AS DOUBLE), 9)"
            f" AS sobreposicao_top{k}"
            for k in (100, 1000)
        )
        + " FROM ranks"
        for trees, r in ((300, "ra"), (100, "rb"))
    ),
}

_ROWS = {
    "resumo_geral": "11", "resumo_testes": len(TESTS), "estatistica_descritiva": len(DESCRIBED),
    "correlacao_testes": len(TESTS), "top_100_clientes": "least(n, 100)", "sensibilidade_contaminacao": 4,
    "grafico_clientes_por_teste": len(TESTS), "grafico_scores": "n", "grafico_correlacao": len(TESTS) ** 2,
}
SCORED = MATRIX | {
    "reports_written": "\nUNION ALL ".join(
        f"SELECT '{name}' AS tabela, 'parquet' AS formato, CAST({n} AS BIGINT) AS linhas, CAST({n} AS BIGINT) AS lidas "
        "FROM (SELECT count(*) AS n FROM matrix_indicators)"
        for name, n in _ROWS.items()
    ),
    "matrix_scores": "SELECT id_cliente, "
    + _STAND_IN.format(n="(CAST(id_cliente AS BIGINT) - 1000000000)", f=7919)
    + " AS a FROM matrix_indicators",
    **_classify("matrix_scores", 9),
    "scored": "SELECT * FROM matrix_indicators JOIN classified USING (id_cliente)",
    "describe_long": _per(
        DESCRIBED,
        "SELECT '{v}' AS variavel, count(x) AS count, round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS std, "
        'round(min(x), 4) AS min, round(quantile_cont(x, 0.25), 4) AS "25%", round(quantile_cont(x, 0.5), 4) AS "50%", '
        'round(quantile_cont(x, 0.75), 4) AS "75%", round(quantile_cont(x, 0.9), 4) AS "90%", '
        'round(quantile_cont(x, 0.95), 4) AS "95%", round(quantile_cont(x, 0.99), 4) AS "99%", '
        "round(max(x), 4) AS max FROM (SELECT CAST({v} AS DOUBLE) AS x FROM scored)",
    ),
    "top100": f"""
SELECT id_cliente, nome_cliente, qtd_linhas_consolidadas, qtd_testes_com_indicio, score_ponderado_auditoria,
       valor_referencia_priorizacao, score_anomalia_iforest_v4,
       cliente_atipico_iforest_v4, ranking_anomalia_iforest_v4, nivel_prioridade_iforest_v4, {", ".join(TESTS)}
FROM scored WHERE ranking_anomalia_iforest_v4 <= 100""",
    "chart_score_pairs": "SELECT id_cliente, score_ponderado_auditoria, score_anomalia_iforest_v4 FROM scored",
    "summary_counts": """
SELECT CAST(sum(qtd_linhas_consolidadas) AS BIGINT) AS l, count(*) AS c,
       count(*) FILTER (qtd_testes_com_indicio > 0) AS i, CAST(sum(cliente_atipico_iforest_v4) AS BIGINT) AS a
FROM scored""",
    "run_summary": f"""
SELECT unnest(['linhas_originais', 'clientes_apos_consolidacao', 'linhas_reduzidas_por_consolidacao',
               'clientes_com_algum_indicio', 'clientes_atipicos_isolation_forest',
               'percentual_atipicos_isolation_forest', 'contaminacao_parametrizada', 'variaveis_utilizadas_no_modelo',
               'n_estimators', 'max_samples', 'random_state']) AS indicador,
       unnest([CAST(l AS VARCHAR), CAST(c AS VARCHAR), CAST(l - c AS VARCHAR), CAST(i AS VARCHAR), CAST(a AS VARCHAR),
               CAST(a / CAST(c AS DOUBLE) AS VARCHAR), '0.05', '{len(VARIABLES)}', '300', 'auto', '42']) AS valor
FROM summary_counts""",
}

_CENTS = "CAST(round(c_acctbal * 100) AS BIGINT)"
SINGLE = {
    "exclusion_anti": """
SELECT c_custkey, c_name FROM customer
WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)""",
    "exclusion_forms": """
SELECT forma, chave, count(*) AS linhas
FROM (SELECT CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS chave FROM orders),
     (SELECT unnest(['lista', 'lista_longa', 'tabela', 'lista_vazia', 'tabela_vazia']) AS forma)
WHERE forma LIKE '%vazia' OR chave NOT IN ('1-URGENT', '5-LOW')
GROUP BY ALL""",
    "sample_fixed_size": """
SELECT CAST(1000000000 + c_custkey AS VARCHAR) AS "KUNNR", c_name AS "NAME1" FROM customer
ORDER BY left(md5(CAST(1000000000 + c_custkey AS VARCHAR) || '|42'), 15), 1 LIMIT 100""",
    "file_rows": """
SELECT CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE CAST(o_custkey AS VARCHAR) END AS id_cliente,
       CASE WHEN o_orderstatus <> 'P' THEN 'Código São João' END AS nome_cliente,
       CAST(round(o_totalprice * 100) AS BIGINT) / 100.0::DOUBLE AS valor_pedido, o_orderkey % 7 AS qtd_itens
FROM orders""",
    "file_matrix": """
SELECT id_cliente, max(nome_cliente) AS nome_cliente, max(valor_pedido) AS valor_pedido,
       CAST(max(qtd_itens) AS DOUBLE) AS qtd_itens, count(*) AS qtd_linhas_consolidadas
FROM file_rows WHERE id_cliente <> '' GROUP BY 1""",
    "file_rejects": "SELECT count(*) AS linhas, count(DISTINCT id_cliente) AS chaves FROM file_rows WHERE id_cliente = ''",
    "pair_key": """
SELECT o_orderkey, CASE WHEN s IS NOT NULL THEN least(p, s) END AS menor,
       CASE WHEN s IS NOT NULL THEN greatest(p, s) END AS maior, least(p, s) || '|' || greatest(p, s) || left(s, 0) AS chave
FROM (SELECT o_orderkey, o_orderpriority AS p, NULLIF(o_orderstatus, 'P') AS s FROM orders)""",
    "string_lists": """
SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ', ' ORDER BY o_orderpriority) AS prioridades,
       string_agg(DISTINCT NULLIF(o_orderstatus, 'F'), ', ' ORDER BY NULLIF(o_orderstatus, 'F')) AS abertos
FROM orders GROUP BY 1""",
    "safe_casts": """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS data,
       CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS inteiro,
       CASE WHEN o_orderstatus <> 'O' THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) END AS valor,
       CASE WHEN o_orderstatus <> 'P' THEN 1 ELSE 0 END AS preenchido
FROM orders""",
    "input_checks": """
SELECT count(*) AS linhas_originais, count(*) FILTER (k IS NULL) AS linhas_id_nulo,
       count(*) FILTER (k = '') AS linhas_id_em_branco,
       count(DISTINCT k) FILTER (k <> '') AS clientes_unicos,
       count(*) FILTER (k <> '') - count(DISTINCT k) FILTER (k <> '') AS linhas_duplicadas
FROM (SELECT CASE WHEN o_orderpriority = '5-LOW' THEN ''
                  WHEN o_orderstatus <> 'P' THEN CAST(o_custkey AS VARCHAR) END AS k FROM orders)""",
    "numeric_conversion": f"""
SELECT c_custkey AS id, {_CENTS} / 100.0::DOUBLE AS direto, {_CENTS} / 100.0::DOUBLE AS brasileiro,
       CASE WHEN c_custkey % 40 <> 7 THEN {_CENTS} / 100.0::DOUBLE END AS misto, CAST(NULL AS DOUBLE) AS texto
FROM customer""",
    "read_delimited": """
SELECT CAST(c_custkey AS VARCHAR) AS id_cliente, c_name, c_acctbal, c_mktsegment FROM customer""",
}

#: name -> (chain, money columns)
MATRIX_QUERIES = {
    **{name: (SINGLE, "") for name in SINGLE if name != "file_rows"},
    "matrix_assembled": (MATRIX, " ".join(AMOUNTS)),
    "matrix_consolidated": (MATRIX, " ".join(AMOUNTS)),
    "duplicate_diagnostics": (MATRIX, ""),
    "matrix_indicators": (MATRIX, " ".join(a for a in AMOUNTS if a not in REFERENCE_VALUES)),
    "feature_medians": (FEATURES, ""),
    "features_scaled": (FEATURES, ""),
    **{name: (COMPONENTS, "") for name in ("pca_projection", "pca_variance", "chart_pca")},
    "iforest_scores": (FOREST, ""),
    "iforest_rank": (FOREST_RANK, ""),
    "stability": (STABILITY, ""),
    **{name: (REPORTS, "") for name in (
        "test_summary", "test_correlation", "sensitivity", "chart_flag_counts")},
    **{name: (CUSTOMERS, "") for name in ("rank_first", "rank_pct_avg", "priority_level", "rank_compare")},
    **{name: (SCORED, "") for name in ("reports_written", "describe_long", "top100", "run_summary", "chart_score_pairs")},
}


def matrix_oracles() -> dict[str, str]:
    return {name: chain(parts, name, amounts) for name, (parts, amounts) in MATRIX_QUERIES.items()}
