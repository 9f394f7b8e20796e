"""Isolation Forest: sampling, fitting and scoring as Spark jobs.

Follows the paper of Liu, Ting and Zhou (2008): each tree isolates a small
random sample by random cuts, and rows with short paths are unusual.  Samples
follow from hashes of the key, trees grow in parallel as grouped tasks,
and the forest, whose size depends on its settings alone, is sent to all
executors to score rows in Arrow batches.

Nothing is drawn from a generator with a state: each draw is the beginning of
an MD5 of what it is for (:func:`draw`), so samples and trees can be made in any
order, by any engine that has MD5, and come out the same.
"""

from __future__ import annotations

import hashlib
import math
import sys
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditrank import fixed_values as fv

# Executors receive the functions below by value, so they need numpy and pandas
# but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_EULER = 0.5772156649015329
_OVERSAMPLE = 1.2
_HASH_DIGITS = 13
_HASH_STEPS = 1 << 4 * _HASH_DIGITS
#: Path lengths are multiples of this, so their sums are exact in any order and
#: rows with equal paths tie.
_PATH_STEP = 2.0**-30

NODE_SCHEMA = (
    "tree int, node int, feature int, threshold double, left int, right int, size int, depth int"
)


@dataclass(frozen=True)
class ForestSettings:
    trees: int = fv.TREES
    max_samples: int | str = "auto"
    seed: int = fv.SEED

    def sample_size(self, rows: int) -> int:
        wanted = fv.AUTO_SAMPLE if self.max_samples == "auto" else int(self.max_samples)
        return min(wanted, rows)


def average_path(sizes: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among ``sizes`` rows."""
    sizes = np.asarray(sizes, dtype=float)
    out = np.zeros_like(sizes)
    out[sizes == 2] = 1.0
    big = sizes > 2
    n = sizes[big]
    out[big] = 2.0 * (np.log(n - 1.0) + _EULER) - 2.0 * (n - 1.0) / n
    return np.round(out / _PATH_STEP) * _PATH_STEP


def draw(*purpose: int | str) -> float:
    """A number in [0, 1) that depends on its purpose only."""
    text = "|".join(map(str, purpose)).encode()
    return int(hashlib.md5(text).hexdigest()[:_HASH_DIGITS], 16) / _HASH_STEPS


def grow_tree(x: np.ndarray, seed: int, tree: int) -> list[tuple]:
    """Nodes (node, feature, threshold, left, right, size, depth) of one tree.

    The children of node n are 2n + 1 and 2n + 2; leaves have feature -1.  A cut
    is uniform between the smallest and largest value of a feature that still
    varies in the node.  The order of the rows does not matter.
    """
    limit = math.ceil(math.log2(max(len(x), 2)))
    nodes: list[tuple] = []
    waiting = [(0, np.arange(len(x)), 0)]
    while waiting:
        node, rows, depth = waiting.pop()
        low, high = x[rows].min(axis=0), x[rows].max(axis=0)
        varying = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or not len(varying):
            nodes.append((node, -1, 0.0, -1, -1, len(rows), depth))
            continue
        feature = int(varying[min(int(draw(seed, tree, node, "feature") * len(varying)), len(varying) - 1)])
        cut = low[feature] + draw(seed, tree, node, "cut") * (high[feature] - low[feature])
        if cut >= high[feature]:
            cut = low[feature]
        goes_left = x[rows, feature] <= cut
        left, right = 2 * node + 1, 2 * node + 2
        nodes.append((node, feature, float(cut), left, right, len(rows), depth))
        waiting.append((right, rows[~goes_left], depth + 1))
        waiting.append((left, rows[goes_left], depth + 1))
    return nodes


@dataclass(frozen=True)
class Forest:
    """Trees as flat arrays; leaves point to themselves."""

    features: tuple[str, ...]
    sample_size: int
    feature: np.ndarray  # (trees, nodes)
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    path: np.ndarray  # depth of a leaf plus the mean path below it

    @property
    def trees(self) -> int:
        return len(self.feature)

    def path_sums(self, x: np.ndarray, marks: Sequence[int]) -> np.ndarray:
        """Summed path length over the first ``m`` trees, one column per mark."""
        rows = np.arange(len(x))
        sums = np.zeros(len(x))
        out = np.empty((len(x), len(marks)))
        steps = int(math.ceil(math.log2(max(self.sample_size, 2))))
        for t in range(max(marks)):
            at = np.zeros(len(x), dtype=np.int32)
            feature, threshold = self.feature[t], self.threshold[t]
            left, right = self.left[t], self.right[t]
            for _ in range(steps):
                goes_left = x[rows, feature[at]] <= threshold[at]
                at = np.where(goes_left, left[at], right[at])
            sums += self.path[t][at]
            for column in np.flatnonzero(np.asarray(marks) == t + 1):
                out[:, column] = sums
        return out

    def score_samples(self, x: np.ndarray, marks: Sequence[int]) -> np.ndarray:
        """-2^(-mean path / normal path): near -1 unusual, towards 0 usual."""
        normal = float(average_path(np.array([self.sample_size]))[0]) or 1.0
        return -np.exp2(-self.path_sums(x, marks) / (np.asarray(marks) * normal))


def _draw_of_row(key: str, seed: int, turn: Column) -> Column:
    """:func:`draw` of key, seed and round, times the number of steps."""
    text = F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)), turn.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, _HASH_DIGITS), 16, 10).cast("long")


def tree_samples(df: DataFrame, key: str, settings: ForestSettings, rows: int, slack: float) -> DataFrame:
    """The samples of all trees, as rows (tree, ...).

    A round puts the rows in the order of a hash and deals them out, ``size`` to a
    tree, so a table with more than trees x size rows hashes each row once; a smaller
    one takes as many rounds as it needs.  Only rows whose hash is below a share can
    be among the first that are dealt; ``slack`` is how many times that share is taken.
    At most trees x size rows are put in order, whatever the size of ``df``.
    """
    size = settings.sample_size(rows)
    per_round = max(1, rows // size)
    rounds = math.ceil(settings.trees / per_round)
    dealt = min(per_round, settings.trees) * size
    share = min(1.0, slack * dealt / rows)
    draws = F.transform(
        F.sequence(F.lit(0), F.lit(rounds - 1)),
        lambda r: F.struct(r.alias("round"), _draw_of_row(key, settings.seed, r).alias("hash")),
    )
    if share < 1.0:
        draws = F.filter(draws, lambda d: d["hash"] < F.lit(int(share * _HASH_STEPS)))
    drawn = df.select(*df.columns, F.explode(draws).alias("_draw"))
    # A limit on the row number is applied before the shuffle too.
    order = Window.partitionBy("_draw.round").orderBy("_draw.hash", key)
    placed = drawn.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= dealt)
    tree = F.col("_draw.round") * per_round + F.floor((F.col("_place") - 1) / size)
    return placed.select(tree.cast("int").alias("tree"), *df.columns).where(F.col("tree") < settings.trees)


def fit_forest(df: DataFrame, key: str, features: Sequence[str], settings: ForestSettings) -> Forest:
    """Fit on scaled features without NULLs; runs jobs.

    The result does not depend on how ``df`` is partitioned: samples and cuts
    follow from hashes.
    """
    features = list(features)
    rows = df.count()
    if rows == 0:
        raise ValueError("cannot fit a forest on no rows")
    size, seed = settings.sample_size(rows), settings.seed

    def grow(keys: tuple, sample: pd.DataFrame) -> pd.DataFrame:
        tree = int(keys[0])
        nodes = grow_tree(sample[features].to_numpy(dtype=float), seed, tree)
        out = pd.DataFrame(nodes, columns=["node", "feature", "threshold", "left", "right", "size", "depth"])
        out.insert(0, "tree", tree)
        return out

    slack = _OVERSAMPLE
    while True:
        samples = tree_samples(df.select(key, *features), key, settings, rows, slack)
        # Bounded by trees x (2 x sample size - 1) rows.
        nodes = samples.groupBy("tree").applyInPandas(grow, NODE_SCHEMA).toPandas()
        roots = nodes[nodes["node"] == 0]
        if len(roots) == settings.trees and (roots["size"] == size).all():
            return packed(nodes, features, size)
        slack *= 2  # too few rows below the share, which is unlikely


def packed(nodes: pd.DataFrame, features: Sequence[str], sample_size: int) -> Forest:
    """Node table to flat arrays."""
    trees = int(nodes["tree"].max()) + 1
    width = int(nodes["node"].max()) + 1
    t, n = nodes["tree"].to_numpy(), nodes["node"].to_numpy()
    leaf = nodes["feature"].to_numpy() < 0

    def table(values, dtype, fill=0):
        out = np.full((trees, width), fill, dtype=dtype)
        out[t, n] = values
        return out

    return Forest(
        features=tuple(features),
        sample_size=sample_size,
        feature=table(np.where(leaf, 0, nodes["feature"]), np.int32),
        threshold=table(nodes["threshold"], float),
        left=table(np.where(leaf, n, nodes["left"]), np.int32),
        right=table(np.where(leaf, n, nodes["right"]), np.int32),
        path=table(np.where(leaf, nodes["depth"] + average_path(nodes["size"]), 0.0), float),
    )


def with_scores(df: DataFrame, runs: Sequence[tuple[Forest, Mapping[int, str]]]) -> DataFrame:
    """Add score_samples columns; feature columns are dropped.

    Each run names, for a forest, the columns for its first so many trees.  All
    runs share one pass over Arrow batches, without a shuffle.
    """
    features = list(runs[0][0].features)
    kept = [f for f in df.schema if f.name not in features]
    names = [name for _, marks in runs for name in marks.values()]
    schema = T.StructType([*kept, *(T.StructField(n, T.DoubleType()) for n in names)])
    keep = [f.name for f in kept]
    # Only arrays and plain values travel in the broadcast; the class comes with
    # the function.
    shared = df.sparkSession.sparkContext.broadcast([(vars(forest), dict(marks)) for forest, marks in runs])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.ascontiguousarray(batch[features].to_numpy(dtype=float))
            out = batch[keep].copy()
            for fields, marks in shared.value:
                scores = Forest(**fields).score_samples(x, list(marks))
                for i, name in enumerate(marks.values()):
                    out[name] = scores[:, i]
            yield out

    return df.mapInPandas(score, schema)
