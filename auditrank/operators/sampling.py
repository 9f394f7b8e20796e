"""Repeatable random sample of a fixed size."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sample_draw(key: str, seed: int) -> Column:
    """A number below 2^60 from the key and the seed, the same in any engine with MD5."""
    digest = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def fixed_size_sample(df: DataFrame, key: str, size: int, seed: int) -> DataFrame:
    """At most ``size`` rows, the same ones on every run.

    Rows are drawn in order of a hash of the key.  Only hashes below a bound
    that holds slightly more than ``size`` rows are sorted, so the last task
    sees about ``size`` rows however large ``df`` is; should the bound hold too
    few, all rows are sorted.
    """
    draw = sample_draw(key, seed)
    rows = df.count()
    wanted = min(size, rows)
    share = (wanted + 10 * math.sqrt(wanted) + 50) / rows if rows else 1.0
    drawn = df
    if share < 1.0:
        bound = int(share * 2**60)
        drawn = df.where(draw < F.lit(bound))
        if drawn.count() < wanted:
            drawn = df
    return drawn.orderBy(draw, key).limit(wanted)
