"""Texts, names, weights and cuts that results must carry exactly.

Everything in this module is a constant of the audit method or of the output
format.  Values keep their natural order.
"""

# --- Fixed values: settlement status and first-purchase classes -------------
OPEN = "Em aberto"
SETTLED = "Compensado"

OPEN_OVERDUE = "Em aberto e vencida"
OPEN_NOT_DUE = "Em aberto e a vencer"
SETTLED_LATE = "Compensada com atraso"
SETTLED_ON_TIME = "Compensada no prazo"
UNCLASSIFIED = "Não classificado"
NO_FIRST_PURCHASE = "Sem primeira compra identificada"

# --- Fixed values: reversal relation ----------------------------------------
TWO_LEGS = "Duas pernas localizadas"
ONE_LEG = "Apenas uma perna localizada"

# --- Fixed values: risk levels ----------------------------------------------
HIGH_RISK = "Risco alto"
MODERATE_RISK = "Risco moderado"
NO_RISK = "Sem risco identificado"
NO_CLASS = "Sem classificação"
NO_OCCURRENCE = "Sem ocorrência"
BELOW_VOLUME = "Estornos abaixo do limiar de alto volume"
EXPECTED_IMPACT = "Alto"

# --- Fixed values: ledger codes ---------------------------------------------
PAYMENT_METHOD = "E"
INVOICE_TYPE = "RV"
DEBIT = "S"
REVERSAL_ACCOUNT = "1010201001"
REVERSAL_MARK = "X"
ID_FLOOR = 1_000_000_000

# --- Fixed values: the six tests and their weights --------------------------
TESTS = ("teste_01", "teste_02", "teste_03", "teste_04", "teste_05", "teste_06")
BINARY_WEIGHTS = {
    "teste_01": 3,
    "teste_02": 3,
    "teste_03": 3,
    "teste_04": 2,
    "teste_05": 3,
    "teste_06": 2,
}
TEST_02_FLAG = "teste_02_cliente_inadimplente_primeira_compra"
TEST_03_FLAG = "teste_03_alto_volume_estornos_financeiros"

# --- Fixed values: columns summed into the reference value ------------------
REFERENCE_VALUE_COLUMNS = (
    "valor_total_titulos_vencidos_abertos_30d",
    "valor_primeira_compra",
    "valor_total_estornos_cliente",
    "saldo_total_aberto_cliente",
    "valor_total_titulos_prorrogados",
    "valor_total_devolvido_cliente",
)

# --- Fixed values: audit priority cuts (score, level), highest first --------
PRIORITY_CUTS = ((10, "Alto"), (6, "Médio"), (3, "Baixo"))
PRIORITY_DEFAULT = "Sem indício"

# --- Fixed values: anomaly priority cuts (percentile, level) ----------------
ANOMALY_CUTS = ((99, "Crítica"), (95, "Alta"), (90, "Moderada"))
ANOMALY_DEFAULT = "Baixa"

# --- Fixed values: model variables by kind ----------------------------------
FREQUENCY_VARIABLES = (
    "qtd_titulos_vencidos_abertos_30d",
    "qtd_estornos_cliente",
    "qtd_usuarios_estorno",
    "qtd_titulos_abertos_cliente",
    "qtd_titulos_prorrogados_cliente",
    "qtd_prorrogacoes_cliente",
    "qtd_notas_faturadas_cliente",
    "qtd_notas_devolucao_cliente",
    "qtd_testes_com_indicio",
    "qtd_linhas_consolidadas",
)
CONTINUOUS_VARIABLES = (
    "valor_total_titulos_vencidos_abertos_30d",
    "maior_dias_vencido_teste_01",
    "valor_primeira_compra",
    "dias_atraso_primeira_compra",
    "valor_total_estornos_cliente",
    "maior_valor_estorno_cliente",
    "saldo_total_aberto_cliente",
    "maior_saldo_aberto_em_um_centro",
    "maior_perc_cliente_sobre_centro",
    "valor_total_titulos_prorrogados",
    "maior_valor_titulo_prorrogado",
    "dias_prorrogados_total_cliente",
    "maior_dias_prorrogados_mesmo_titulo",
    "maior_prorrogacao_individual_dias",
    "valor_total_faturado_cliente",
    "valor_total_devolvido_cliente",
    "perc_devolucao_sobre_faturamento_recalculado",
    "valor_referencia_priorizacao",
)
TOTAL_SCORES = (
    "score_ponderado_binario",
    "score_total_criticidade",
    "score_ponderado_auditoria",
)

# --- Fixed values: report columns -------------------------------------------
DESCRIBED_VARIABLES = (
    "qtd_testes_com_indicio",
    "score_ponderado_auditoria",
    "valor_referencia_priorizacao",
    "score_anomalia_iforest_v4",
    "valor_total_titulos_vencidos_abertos_30d",
    "valor_total_estornos_cliente",
    "saldo_total_aberto_cliente",
    "valor_total_titulos_prorrogados",
    "valor_total_devolvido_cliente",
    "perc_devolucao_sobre_faturamento_recalculado",
)
DESCRIBED_PERCENTILES = (0.25, 0.50, 0.75, 0.90, 0.95, 0.99)
TOP_CUSTOMER_COLUMNS = (
    "id_cliente",
    "nome_cliente",
    "qtd_linhas_consolidadas",
    "qtd_testes_com_indicio",
    "score_ponderado_auditoria",
    "valor_referencia_priorizacao",
    "score_anomalia_iforest_v4",
    "cliente_atipico_iforest_v4",
    "ranking_anomalia_iforest_v4",
    "nivel_prioridade_iforest_v4",
)
TOP_CUSTOMERS = 100
CHART_SAMPLE = 20_000

# --- Fixed values: model settings -------------------------------------------
TREES = 300
AUTO_SAMPLE = 256
CONTAMINATION = 0.05
SEED = 42
SENSITIVITY_CUTS = (0.01, 0.03, 0.05, 0.10)
STABILITY_SETTINGS = (
    (100, "auto"),
    (200, "auto"),
    (300, "auto"),
    (500, "auto"),
    (300, "256"),
    (300, "512"),
)
STABILITY_TOPS = (100, 1000)

# --- Fixed values: delimited files ------------------------------------------
ENCODINGS = ("UTF-8", "ISO-8859-1")
SEPARATORS = (";", ",", "\t", "|")
# Texts the common CSV readers of the Python data stack treat as missing.
MISSING_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)
