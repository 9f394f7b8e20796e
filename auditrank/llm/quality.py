"""Document quality by hierarchical empirical Bayes over hosts and paths.

A classifier on features of the text gives each document a log odds of being
good.  Its probabilities are summed per host and per path of a host over all
documents (grouped aggregation, partial before the shuffle).  The spread of host
means gives a Beta prior for hosts by the method of moments; a host's posterior
mean is the prior of its paths, whose strength comes from the spread of paths
about their hosts.  Sparse sites are thus drawn to their host and on to the
whole.  A document's own share is taken out of its path and host, so it does not
testify for itself, and the path's log odds (less those of the whole, which the
classifier knows already) are added to its own.

The classifier is a ridge logistic regression on about twenty features, fitted
on a bounded sample of labelled rows (``SAMPLE_ROWS``, drawn by a hash of the id).

Defined results: a NULL or blank text has features of an empty text.  A NULL
host or path is a site of its own.  Labels with a NULL id or value are left out;
repeated labels count once, with the lowest value.  Without labels of both kinds
every document has probability 1/2 by itself.  Repeated rows each count.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditrank.llm.frames import rows, unused
from auditrank.llm.words import NOT_SPACE, blocks, hash_words, per_row, texts
from auditrank.session import stage

#: Most labelled rows the classifier is fitted on.
SAMPLE_ROWS = 10_000
#: Posterior from which a document is kept.
KEEP = 0.5
_RIDGE = 1.0
#: Bounds of the estimated prior strengths, in documents.
_STRENGTH = (2.0, 10_000.0)

#: Byte classes whose shares are features.
_CLASSES = {
    "upper": range(65, 91),
    "digit": range(48, 58),
    "stop": b".?",
    "comma": b",;:",
    "shout": b"!",
    "bar": b"|",
    "noise": b"#$%&*^~+=_",
    "bracket": b"<>{}[]()/\\@",
    "beyond": range(128, 256),
    "break": b"\n",
}


def _byte_table() -> np.ndarray:
    out = np.zeros(256, np.int64)
    for k, members in enumerate(_CLASSES.values(), 1):
        out[list(members)] = k
    return out


_CLASS_OF = _byte_table()


def features(data: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """One row of features per text of a block."""
    n, k = len(cuts) - 1, len(_CLASSES) + 1
    length = np.diff(cuts)
    owner = np.repeat(np.arange(n), length)
    shares = np.bincount(owner * k + _CLASS_OF[data], minlength=n * k).reshape(n, k)[:, 1:]
    at, hashes = hash_words(data, cuts, NOT_SPACE)
    bounds = per_row(at, cuts)
    words = np.diff(bounds)
    of_word = np.repeat(np.arange(n), words)
    end = np.append(at[1:], len(data))
    # Distinct words and word pairs, as repetition shows.
    distinct = _distinct(of_word, hashes, n)
    pairs = hashes[:-1] * np.uint64(3) + hashes[1:] if len(hashes) else hashes
    inside = of_word[:-1] == of_word[1:] if len(hashes) else np.zeros(0, bool)
    repeated = _distinct(of_word[:-1][inside], pairs[inside], n) if len(hashes) else np.zeros(n)
    gap = np.minimum(end - at, 40).astype(float)
    mean = np.bincount(of_word, gap, n) / np.maximum(words, 1)
    square = np.bincount(of_word, gap**2, n) / np.maximum(words, 1)
    single = np.bincount(of_word, gap <= 2, n) / np.maximum(words, 1)
    size = np.maximum(length, 1)[:, None]
    return np.column_stack(
        (
            np.sqrt(shares / size),
            np.log1p(words),
            np.log1p(length) - np.log1p(words),
            distinct / np.maximum(words, 1),
            repeated / np.maximum(words - 1, 1),
            mean,
            np.sqrt(np.maximum(square - mean**2, 0)),
            single,
            shares[:, 2] / np.maximum(words, 1),
            shares[:, 3] / np.maximum(words, 1),
            np.log1p(shares[:, 9]),
        )
    )


def _distinct(owner: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((values, owner))
    owner, values = owner[order], values[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (values[1:] != values[:-1])
    return np.bincount(owner[new], minlength=n).astype(float)


@dataclass(frozen=True)
class Classifier:
    """Standardised features, their squares, and weights with the intercept first."""

    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray

    def log_odds(self, found: np.ndarray) -> np.ndarray:
        return _design(found, self.centre, self.spread) @ self.weights


def _design(found: np.ndarray, centre: np.ndarray, spread: np.ndarray) -> np.ndarray:
    z = np.clip((found - centre) / spread, -4, 4)
    return np.column_stack((np.ones(len(z)), z, z**2 - 1))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Classifier | None:
    """The classifier, or None without labels of both kinds."""
    sample = (
        labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("good"))
        .where("id IS NOT NULL AND good IS NOT NULL")
        .groupBy("id").agg(F.min("good").alias("good"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(sample_rows)
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches):
            for first, last, data, cuts in blocks(texts(batch.column(0))):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(features(data, cuts)), pa.list_(pa.float64())), batch.column(1).slice(first, last - first)],
                    names=["x", "good"],
                )

    # At most ``sample_rows`` rows of two numbers, so the texts need no shuffle.
    own = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(sample), "id")
    held = own.select("text", "good").mapInArrow(run, "x array<double>, good int").collect()
    good = np.array([r["good"] > 0 for r in held], float)
    if not len(good) or good.min() == good.max():
        return None
    x = np.array([r["x"] for r in held])
    centre, spread = x.mean(0), x.std(0) + 1e-9
    design = _design(x, centre, spread)
    # Each kind has the same weight: the prior is the business of the sites.
    weigh = np.where(good > 0, 0.5 / good.mean(), 0.5 / (1 - good.mean()))
    weights = np.zeros(design.shape[1])
    ridge = _RIDGE * np.diag(np.append(0.0, np.ones(design.shape[1] - 1)))
    for _ in range(20):
        p = 1 / (1 + np.exp(-np.clip(design @ weights, -30, 30)))
        slope = design.T @ (weigh * (p - good)) + ridge @ weights
        bend = (design * (weigh * p * (1 - p))[:, None]).T @ design + ridge + 1e-6 * np.eye(len(weights))
        weights = weights - np.linalg.solve(bend, slope)
    return Classifier(centre, spread, weights)


def evidence(docs: DataFrame, model: Classifier | None, name: str) -> DataFrame:
    """``docs`` plus ``name``, the classifier's log odds, without shuffling."""
    text_at = docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches):
            parts = [
                np.zeros(last - first) if model is None else model.log_odds(features(data, cuts))
                for first, last, data, cuts in blocks(texts(batch.column(text_at)))
            ]
            arrays = [*batch.columns, pa.array(np.concatenate(parts))]
            yield pa.RecordBatch.from_arrays(arrays, names=[f"c{k}" for k in range(len(arrays))])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def _strength(mean: float, spread: float, noise: float) -> float:
    """Beta strength from the spread of site means beyond their sampling noise."""
    between = max(spread - noise, 1e-9)
    return float(np.clip(mean * (1 - mean) / between - 1, *_STRENGTH))


def posterior(scored: DataFrame, host: str, path: str, log_odds: str) -> DataFrame:
    """``scored`` plus ``host_quality``, ``path_quality``, ``quality`` and ``keep``."""
    p = 1 / (1 + F.exp(-F.col(log_odds)))
    h, q, total, count, host_total, host_count = unused(scored, "_h", "_p", "_s", "_n", "_hs", "_hn")
    paths = stage(
        scored.groupBy(F.col(host).alias(h), F.col(path).alias(q)).agg(F.sum(p).alias(total), F.count("*").alias(count)),
        "paths",
    )
    hosts = paths.groupBy(h).agg(F.sum(total).alias(host_total), F.sum(count).alias(host_count))
    whole = hosts.agg(F.sum(host_total).alias("s"), F.sum(host_count).alias("n")).first()
    if not whole["n"]:
        mean, host_strength, path_strength = 0.5, 1.0, 1.0
    else:
        mean = min(max(whole["s"] / whole["n"], 1e-3), 1 - 1e-3)
        site = F.col(host_total) / F.col(host_count)
        about = hosts.agg(
            F.sum(F.col(host_count) * (site - mean) ** 2).alias("spread"),
            F.count("*").alias("n"),
        ).first()
        noise = mean * (1 - mean) * about["n"] / whole["n"]
        host_strength = _strength(mean, about["spread"] / whole["n"], noise)
        of_host = (F.col(host_total) + host_strength * mean) / (F.col(host_count) + host_strength)
        inner = paths.join(hosts, paths[h].eqNullSafe(hosts[h])).agg(
            F.sum(F.col(count) * (F.col(total) / F.col(count) - of_host) ** 2).alias("spread"), F.count("*").alias("n")
        ).first()
        noise = mean * (1 - mean) * inner["n"] / whole["n"]
        path_strength = _strength(mean, inner["spread"] / whole["n"], noise)
    sites = paths.join(hosts.withColumnRenamed(h, f"{h}2"), F.col(h).eqNullSafe(F.col(f"{h}2"))).drop(f"{h}2")
    joined = scored.join(sites, F.col(host).eqNullSafe(F.col(h)) & F.col(path).eqNullSafe(F.col(q)))

    def shrunk(s: Column, n: Column, prior: Column, strength: float) -> Column:
        return (s + strength * prior) / (n + strength)

    own_host = shrunk(F.col(host_total) - p, F.col(host_count) - 1, F.lit(mean), host_strength)
    own_path = shrunk(F.col(total) - p, F.col(count) - 1, F.col("host_quality"), path_strength)
    site_odds = F.log(F.col("path_quality") / (1 - F.col("path_quality"))) - float(np.log(mean / (1 - mean)))
    return (
        joined.withColumn("host_quality", own_host)
        .withColumn("path_quality", own_path)
        .withColumn("quality", 1 / (1 + F.exp(-(F.col(log_odds) + site_odds))))
        .withColumn("keep", F.col("quality") >= KEEP)
        .drop(h, q, total, count, host_total, host_count)
    )


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, host, path, log_odds, host_quality, path_quality, quality, keep);
    the source is the host and the language below it the path."""
    scored = evidence(
        docs.select("doc_id", F.col("source").alias("host"), F.concat_ws("/", "source", "lang").alias("path"), "text"),
        fit(docs, labels),
        "log_odds",
    ).drop("text")
    return posterior(stage(scored, "evidence"), "host", "path", "log_odds")
