"""Flag, criticality and score from the p75 and p90 of one indicator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditrank.functions.columns import flag
from auditrank.operators.quantiles import discrete_quantiles
from auditrank.session import stage


def with_percentile_levels(per_customer: DataFrame, indicator: str, test: str, accuracy: int) -> DataFrame:
    """Add ``teste_NN`` with criticality and score 0, 1 or 2.

    The cuts need all customers before any is flagged, so the table is written
    once and read again for the cuts, which are exact.  They are literals, so no join
    is planned for them.
    """
    table = stage(per_customer, f"test-{test}")
    value = F.col(indicator)
    cuts = discrete_quantiles(table.where(value > 0).select(indicator), [indicator], [0.75, 0.90], accuracy)[indicator]
    high = (value > 0) & (value >= F.lit(cuts[0.75]))
    very_high = (value > 0) & (value >= F.lit(cuts[0.90]))
    level = F.when(very_high, 2).when(high, 1).otherwise(0)
    return table.select(
        *table.columns,
        flag(high).alias(f"teste_{test}"),
        level.alias(f"criticidade_teste_{test}"),
        level.alias(f"score_teste_{test}"),
    )
