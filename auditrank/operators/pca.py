"""Two principal components of centred columns, with a fixed sign."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditrank.functions.columns import total


@dataclass(frozen=True)
class Components:
    """Means, loadings (component by variable) and explained variance shares."""

    variables: tuple[str, ...]
    means: np.ndarray
    loadings: np.ndarray
    shares: np.ndarray

    def projection(self, component: int, columns: Sequence[Column]) -> Column:
        terms = [
            (c - F.lit(float(m))) * F.lit(float(w))
            for c, m, w in zip(columns, self.means, self.loadings[component])
        ]
        return total(terms, F.lit(0.0))


def fit_components(df: DataFrame, variables: Sequence[str], k: int = 2) -> Components:
    """Fit on columns without NULLs.

    The built-in PCA works on a distributed covariance but does not centre
    what it projects, so the means are kept for the projection.  The loading
    of largest size is made positive, which fixes the sign of each component.
    """
    vectors = VectorAssembler(inputCols=list(variables), outputCol="raw").transform(df).select("raw")
    scaler = StandardScaler(inputCol="raw", outputCol="centred", withMean=True, withStd=False).fit(vectors)
    model = PCA(k=k, inputCol="centred", outputCol="pc").fit(scaler.transform(vectors))
    loadings = model.pc.toArray().T
    largest = np.abs(loadings).argmax(axis=1)
    signs = np.where(loadings[np.arange(k), largest] < 0, -1.0, 1.0)
    return Components(
        tuple(variables), scaler.mean.toArray(), loadings * signs[:, None], model.explainedVariance.toArray()
    )


def variance_table(df: DataFrame, components: Components) -> DataFrame:
    """Explained variance of both components and of their sum."""
    first, second = (float(s) for s in components.shares[:2])
    # Row labels of the report.
    rows = [("PCA 1", first), ("PCA 2", second), ("PCA 1 + PCA 2", first + second)]
    return df.sparkSession.createDataFrame(
        [(name, share, share * 100) for name, share in rows],
        "componente string, variancia_explicada double, variancia_explicada_percentual double",
    )
