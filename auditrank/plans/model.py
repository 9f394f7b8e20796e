"""Unsupervised ranking of customers: features, forest, scores, priority.

A flagged customer is one to look at first; nothing more is claimed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditrank import fixed_values as fv
from auditrank.functions.columns import by_cuts, flag
from auditrank.operators.consolidate import KEY
from auditrank.operators.features import FeatureStats, feature_stats
from auditrank.operators.iforest import Forest, ForestSettings, fit_forest, with_scores
from auditrank.operators.numbers import as_numbers
from auditrank.operators.ordering import ranked
from auditrank.operators.pca import Components, fit_components
from auditrank.operators.quantiles import exact_quantiles
from auditrank.plans.indicators import model_variables, with_indicators
from auditrank.session import stage

SCORE = "score_anomalia_iforest_v4"
FLAG = "cliente_atipico_iforest_v4"
RANK = "ranking_anomalia_iforest_v4"
PERCENTILE = "percentil_anomalia_iforest_v4"
LEVEL = "nivel_prioridade_iforest_v4"


@dataclass(frozen=True)
class ModelSettings:
    forest: ForestSettings = ForestSettings()
    contamination: float = fv.CONTAMINATION
    with_pca: bool = True


@dataclass(frozen=True)
class ModelRun:
    """Scored matrix and what was fitted on the way."""

    matrix: DataFrame
    features: DataFrame
    stats: FeatureStats
    forest: Forest
    components: Components | None
    settings: ModelSettings


def prepared(consolidated: DataFrame) -> DataFrame:
    """Matrix with text columns read as numbers where the model needs them."""
    wanted = {*fv.TESTS, *fv.FREQUENCY_VARIABLES, *fv.CONTINUOUS_VARIABLES, *fv.REFERENCE_VALUE_COLUMNS}
    wanted |= {f"{kind}_{t}" for kind in ("score", "criticidade") for t in fv.TESTS}
    texts = [
        f.name for f in consolidated.schema if f.name in wanted and isinstance(f.dataType, T.StringType)
    ]
    return with_indicators(as_numbers(consolidated, texts))


def scaled_features(matrix: DataFrame, accuracy: int = 10_000) -> tuple[DataFrame, FeatureStats]:
    """Key and scaled model variables, and the statistics behind them."""
    variables = model_variables(matrix)
    numbers = as_numbers(matrix.select(KEY, *variables), variables)
    stats = feature_stats(numbers, variables, accuracy)
    return numbers.select(KEY, *stats.scaled_columns()), stats


def classified(scores: DataFrame, samples: str, contamination: float) -> DataFrame:
    """Score, flag, rank, percentile and level from a score_samples column.

    The cut is the ``contamination`` quantile of score_samples over all rows.
    """
    cut = exact_quantiles(scores, [samples], [contamination])[samples][contamination]
    cut = 0.0 if cut is None else cut
    scored = scores.withColumn(SCORE, F.lit(cut) - F.col(samples)).withColumn(
        FLAG, flag(F.col(samples) < F.lit(cut))
    )
    result = ranked(scored.drop(samples), SCORE, KEY, RANK, PERCENTILE)
    return result.withColumn(LEVEL, by_cuts(F.col(PERCENTILE), fv.ANOMALY_CUTS, fv.ANOMALY_DEFAULT))


def run_model(consolidated: DataFrame, settings: ModelSettings = ModelSettings()) -> ModelRun:
    """Fit and score a consolidated matrix.

    The matrix is written once; every later pass reads only the columns it
    needs from those files, never the ledger.
    """
    matrix = stage(prepared(consolidated), "matrix")
    features, stats = scaled_features(matrix)
    forest = fit_forest(features, KEY, stats.variables, settings.forest)
    components = None
    projected = features
    if settings.with_pca and len(stats.variables) >= 2:
        components = fit_components(features, stats.variables)
        columns = [F.col(v) for v in stats.variables]
        projected = features.withColumns(
            {f"pca_{i + 1}": components.projection(i, columns) for i in range(2)}
        )
    scores = stage(with_scores(projected, [(forest, {forest.trees: "_samples"})]), "scores")
    scored = matrix.join(classified(scores, "_samples", settings.contamination), KEY)
    return ModelRun(scored, features, stats, forest, components, settings)
