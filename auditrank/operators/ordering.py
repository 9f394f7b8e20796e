"""Row numbers, ranks and predecessors over a whole table without a single task.

An unpartitioned window would sort every row in one task.  Here the rows are
range-partitioned, sorted inside each partition and written once; the written
layout fixes each row's place, and a running total over the partition sizes
turns local places into global numbers.  A key with a third of all rows is
simply spread over a third of the ranges.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditrank.session import stage

#: Rows of equal keys that a window may order in one task.
ONE_TASK = 1_000_000
_BUCKETS = 1 << 16
_PLACE_BITS = 33  # monotonically_increasing_id: partition above, row below


def numbered(df: DataFrame, order: Sequence[Column], name: str, total: str | None = None) -> DataFrame:
    """``df`` with its 1-based row number under ``order``, a total order.

    ``total`` optionally names a column for the number of rows.
    """
    # Without a fixed number, AQE may join neighbouring ranges that are small.
    laid_out = stage(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_place", F.monotonically_increasing_id()),
        "ordered",
    )
    part = F.shiftright("_place", _PLACE_BITS)
    local = F.col("_place") - F.shiftleft(part, _PLACE_BITS)

    # One row per range, so both the window and the broadcast are bounded by
    # the number of shuffle partitions.
    sizes = laid_out.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))
    running = Window.orderBy("_part")
    starts = sizes.select(
        "_part",
        (F.sum("_size").over(running) - F.col("_size")).alias("_start"),
        F.sum("_size").over(Window.partitionBy()).alias("_total"),
    )
    joined = laid_out.withColumn("_part", part).join(F.broadcast(starts), "_part")
    result = joined.withColumn(name, F.col("_start") + local + 1)
    if total:
        result = result.withColumn(total, F.col("_total"))
    return result.drop("_place", "_part", "_start", "_total")


def with_previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """``df`` with the ``value`` of the row before it among rows of equal keys.

    A window takes the row before where groups are small, which a count of hash buckets
    of the first key proves: no group has more rows than its bucket.  So a key of many
    values should come first.  The rows of buckets with more than ONE_TASK rows are laid out in ranges instead (:func:`_over_ranges`).
    The first row of a group gets NULL.
    """
    keys = list(keys)
    bucket = F.pmod(F.xxhash64(keys[0]), F.lit(_BUCKETS))
    counts = df.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    # At most rows / ONE_TASK numbers.
    crowded = [r.bucket for r in counts.where(F.col("n") > ONE_TASK).collect()]
    if not crowded:
        return _over_groups(df, keys, order, value, name)
    inside = bucket.isin(crowded)
    return _over_groups(df.where(~inside), keys, order, value, name).unionByName(
        _over_ranges(df.where(inside), keys, order, value, name)
    )


def _over_groups(df: DataFrame, keys: list[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    return df.withColumn(name, F.lag(value).over(Window.partitionBy(*keys).orderBy(*order)))


def _over_ranges(df: DataFrame, keys: list[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """Rows are laid out in ranges by (keys, order).  Within a range a window takes
    the row before; the first row of a range looks at the last row of the range
    before, of which one per range is sent to all tasks.  A long group is spread
    over ranges like any other rows.
    """
    laid_out = stage(
        df.repartitionByRange(*[F.col(c) for c in (*keys, *order)])
        .sortWithinPartitions(*keys, *order)
        .withColumn("_place", F.monotonically_increasing_id()),
        "ordered",
    ).withColumn("_part", F.shiftright("_place", _PLACE_BITS))
    last = F.max_by(F.struct(*[F.col(c).alias(f"_{c}") for c in keys], F.col(value).alias("_value")), F.col("_place"))
    ends = laid_out.groupBy("_part").agg(last.alias("_last"))
    before = ends.select("_part", F.lag("_last").over(Window.orderBy("_part")).alias("_carried"))
    inside = Window.partitionBy("_part", *keys).orderBy("_place")
    same = [F.col(f"_carried._{c}").eqNullSafe(F.col(c)) for c in keys]
    carried = F.when(F.col("_carried").isNotNull() & reduce(and_, same), F.col("_carried._value"))
    return (
        laid_out.withColumn("_first", F.row_number().over(inside) == 1)
        .withColumn(name, F.lag(value).over(inside))
        .join(F.broadcast(before), "_part")
        .withColumn(name, F.when(F.col("_first"), carried).otherwise(F.col(name)))
        .drop("_place", "_part", "_first", "_carried")
    )


def ranked(df: DataFrame, score: str, key: str, rank: str, percentile: str) -> DataFrame:
    """Rank by falling score (ties by key) and percentile by rising score.

    Equal scores share the mean of their places as percentile rank; missing
    scores are equal to each other and rank last.
    """
    rows = numbered(df, [F.desc_nulls_last(score), F.asc(key)], rank, total="_n")
    # Ties are folded before they meet the rows again; AQE splits the join if
    # one score is very common.
    ties = rows.groupBy(F.col(score).alias("_tied")).agg(((F.min(rank) + F.max(rank)) / 2).alias("_mean"))
    place = F.col("_n") + 1 - F.col("_mean")
    return (
        rows.join(ties, F.col(score).eqNullSafe(F.col("_tied")))
        .withColumn(rank, F.col(rank).cast("int"))
        .withColumn(percentile, place / F.col("_n") * 100)
        .select(*df.columns, rank, percentile)
    )
