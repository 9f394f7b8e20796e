"""Median imputation and robust scaling as plain column expressions.

The built-in imputer and scaler are not used: the one takes an approximate
median, the other sends a column with zero quartile range to 0.0, which would
erase every rare 0/1 flag.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditrank.operators.quantiles import filled_quantiles

_EPSILON = 10 * 2.220446049250313e-16  # a smaller quartile range counts as zero


@dataclass(frozen=True)
class FeatureStats:
    """Median, centre and scale per variable, in order."""

    medians: dict[str, float | None]
    scales: dict[str, float]

    @property
    def variables(self) -> list[str]:
        """Variables that enter the model; one without any value is left out."""
        return [v for v, median in self.medians.items() if median is not None]

    def imputed(self, variable: str) -> Column:
        return F.coalesce(variable, F.lit(self.medians[variable]))

    def scaled(self, variable: str) -> Column:
        """(x - median) / quartile range, missing values at the median."""
        centre, scale = self.medians[variable], self.scales[variable]
        return (self.imputed(variable) - F.lit(centre)) / F.lit(scale)

    def scaled_columns(self) -> list[Column]:
        return [self.scaled(v).alias(v) for v in self.variables]


def feature_stats(df: DataFrame, variables: Sequence[str], accuracy: int = 10_000) -> FeatureStats:
    """Exact medians and quartile ranges of the imputed columns, from the same passes."""
    medians, quartiles = filled_quantiles(df, variables, [0.25, 0.75], accuracy)
    ranges = {v: q[0.75] - q[0.25] for v, q in quartiles.items() if medians[v] is not None}
    scales = {v: r if r >= _EPSILON else 1.0 for v, r in ranges.items()}
    return FeatureStats({v: medians[v] for v in variables}, scales)


def median_table(df: DataFrame, stats: FeatureStats) -> DataFrame:
    """Imputed median per variable; NULL for a variable without any value."""
    return df.sparkSession.createDataFrame(
        list(stats.medians.items()), "variavel string, mediana_imputacao double"
    )
