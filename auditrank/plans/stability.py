"""How far the ranking moves under other forest settings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditrank import fixed_values as fv
from auditrank.operators.consolidate import KEY
from auditrank.operators.iforest import ForestSettings, fit_forest, with_scores
from auditrank.operators.ordering import numbered
from auditrank.plans.model import SCORE
from auditrank.session import stage


def group_ranks(scores: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Falling-score rank of each column, one row per customer.

    All rankings are laid out in one sort: ranges by (column, score, key).
    """
    long = scores.unpivot([KEY], list(columns), "_list", "_score")
    rows = numbered(long, [F.col("_list"), F.desc("_score"), F.col(KEY)], "_n")
    # One row per ranking, so the broadcast is bounded by the settings.
    starts = rows.groupBy("_list").agg((F.min("_n") - 1).alias("_before"))
    placed = rows.join(F.broadcast(starts), "_list").withColumn("_rank", F.col("_n") - F.col("_before"))
    return placed.groupBy(KEY).agg(
        *(F.max(F.when(F.col("_list") == c, F.col("_rank"))).alias(c) for c in columns)
    )


def compared(base: str, other: str, tops: Sequence[int] = fv.STABILITY_TOPS) -> list[Column]:
    """Aggregates: Spearman correlation of two rank columns and shared tops.

    Ranks have no ties, so Spearman's coefficient is their plain correlation.
    """
    a, b = F.col(base).cast("double"), F.col(other).cast("double")
    spearman = F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))
    aggregates = [spearman.alias("correlacao_spearman_ranking")]
    for k in tops:
        shared = F.count_if((a <= k) & (b <= k))
        size = F.greatest(F.lit(1), F.count_if(a <= k))
        aggregates.append((shared / size).alias(f"sobreposicao_top{k}"))
    return aggregates


def comparison_table(ranks: DataFrame, base: str, settings: Mapping[tuple[int, str], str]) -> DataFrame:
    """One row per setting from one aggregate over the rank table."""
    distinct = dict.fromkeys(settings.values())
    row = ranks.agg(*(F.struct(*compared(base, c)).alias(c) for c in distinct))
    lines = F.array(
        *(
            F.struct(
                F.lit(trees).alias("n_estimators"),
                F.lit(samples).alias("max_samples"),
                *(
                    F.col(f"{column}.{field}").alias(field)
                    for field in (
                        "correlacao_spearman_ranking",
                        *(f"sobreposicao_top{k}" for k in fv.STABILITY_TOPS),
                    )
                ),
            )
            for (trees, samples), column in settings.items()
        )
    )
    return row.select(F.inline(lines))


def stability(scored: DataFrame, features: DataFrame, variables: Sequence[str], score: str = SCORE, seed: int = fv.SEED) -> DataFrame:
    """Six settings against the ranking of the run, whatever its settings were.

    ``scored`` has the run's ``score`` per customer.  Trees are seeded by their
    number, so a smaller forest is the beginning of a larger one: one fit for
    each sample size and one scoring pass serve all six settings.
    """
    wanted: dict[int | str, dict[int, str]] = {}
    columns = {}
    for trees, samples in fv.STABILITY_SETTINGS:
        size = samples if samples == "auto" or int(samples) != fv.AUTO_SAMPLE else "auto"
        columns[trees, samples] = wanted.setdefault(size, {}).setdefault(trees, f"trees_{trees}_{size}")
    forests = [
        (fit_forest(features, KEY, variables, ForestSettings(max(marks), size, seed)), marks)
        for size, marks in wanted.items()
    ]
    fitted = with_scores(features, forests)
    scores = stage(fitted.join(scored.select(KEY, F.col(score).alias("_base")), KEY), "stability")
    # Higher scores mean more unusual from here on.
    names = list(dict.fromkeys(columns.values()))
    ranks = group_ranks(scores.select(KEY, "_base", *((-F.col(n)).alias(n) for n in names)), ["_base", *names])
    return comparison_table(ranks, "_base", columns)
