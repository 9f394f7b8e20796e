"""Toxicity grades by cumulative-link ordinal regression over sparse words.

``P(grade >= k) = sigmoid(w . x - threshold_k)``: one weight per word for all
grades, and ordered thresholds.  The expected severity is the sum of these
probabilities over k.

The model is fitted on a bounded sample of labelled rows (``SAMPLE_ROWS``, drawn
by a hash of the id) with the ``FEATURES`` words that tell toxic from clean rows
best.  Labels that only say toxic or not are graded by how many words of a toxic
text are such signs: 0 for clean texts, 1 to 3 by thirds of the toxic ones.  A
column ``grade`` of the labels is taken as it is.  Scoring is one pass over all
texts and shuffles nothing.

Defined results: a NULL or blank text has no words and gets the severity of an
empty text.  Labels with a NULL id or grade are left out; repeated labels count
once, with the highest grade.  Without labels of both kinds nothing can be
learned: severity is 0 for all rows.  Repeated rows are each scored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditrank.llm.frames import rows, tidy, unused
from auditrank.llm.words import ALNUM_TABLE

#: Most labelled rows a model is fitted on.
SAMPLE_ROWS = 10_000
#: Words kept as features.
FEATURES = 256
#: Bytes of the beginnings of words that are features as words are.
STEMS = (4, 5, 6, 7)
#: Distinct words a scoring worker remembers before it starts anew.
MEMO_WORDS = 300_000
#: Standard errors by which its shares must differ.
LEAST_Z = 3.0
#: Rows a word must occur in to be a feature.
LEAST_ROWS = 5
#: Times a sign's share of toxic rows is its share of clean ones.
SIGN_RATIO = 5.0
#: Probability of any toxicity from which a document is rejected.
REJECT = 0.5
_RIDGE = 1.0


@dataclass(frozen=True)
class Model:
    """Weights by word or stem and rising thresholds, one per grade above 0."""

    weights: dict[bytes, float]
    thresholds: tuple[float, ...]

    def at_least(self, counts: dict[bytes, int]) -> np.ndarray:
        total = sum(self.weights[w] * np.log1p(n) for w, n in counts.items())
        return 1 / (1 + np.exp(np.array(self.thresholds) - total))


def _words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(ALNUM_TABLE).split() if text else []


def _parts(word: bytes) -> list[bytes]:
    """A word and its beginnings, which stand for words that share a stem."""
    return [word, *(word[:n] + b"*" for n in STEMS if len(word) > n)]


class _Known(dict):
    """The features that a word gives, looked up once per word and emptied when full."""

    def __init__(self, features: Iterable[bytes]):
        self.features = frozenset(features)

    def __missing__(self, word: bytes) -> tuple[bytes, ...]:
        found = tuple(p for p in _parts(word) if p in self.features)
        if len(word) <= 32:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[word] = found
        return found

    def count(self, words: list[bytes]) -> Counter:
        return Counter(f for w in words for f in self[w])


def _labelled(docs: DataFrame, labels: DataFrame, sample_rows: int) -> DataFrame:
    """(text, grade) of the sample; grade 1 stands for any toxicity if labels say no more."""
    grade = "grade" if "grade" in labels.columns else "toxic"
    sample = (
        labels.select(F.col("doc_id").cast("long").alias("id"), F.col(grade).cast("int").alias("grade"))
        .where("id IS NOT NULL AND grade IS NOT NULL")
        .groupBy("id").agg(F.max("grade").alias("grade"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(sample_rows)
    )
    # At most ``sample_rows`` rows of two numbers, so the texts need no shuffle.
    own = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    return own.join(F.broadcast(sample), "id")


def _tell_apart(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, toxic rows, clean rows) of a task's labelled rows."""
    found = (Counter(), Counter())
    for batch in rows(batches):
        for text, grade in zip(batch.column(0), batch.column(1)):
            found[grade.as_py() == 0].update({p for w in set(_words(text.as_py())) for p in _parts(w)})
    words = list(found[0].keys() | found[1].keys())
    counts = [pa.array([side[w] for w in words], pa.int64()) for side in found]
    yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), *counts], names=["word", "toxic", "clean"])


def _features(sample: DataFrame, features: int) -> list[tuple[bytes, bool]]:
    """Words whose share of toxic rows differs most from that of clean rows, in
    standard errors, and whether they are a sign of toxicity by themselves."""
    toxic, clean = sample.agg(F.count_if(F.col("grade") > 0), F.count_if(F.col("grade") == 0)).first()
    if not toxic or not clean:
        return []
    p, q = (F.col("toxic") + 0.5) / (toxic + 1), (F.col("clean") + 0.5) / (clean + 1)
    z = F.abs(p - q) / F.sqrt(p * (1 - p) / toxic + q * (1 - q) / clean)
    best = (
        sample.select("text", "grade").mapInArrow(tidy(_tell_apart), "word binary, toxic long, clean long")
        .groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .where((F.col("toxic") + F.col("clean") >= LEAST_ROWS) & (z >= LEAST_Z))
        .orderBy(z.desc(), "word")
        .limit(features)
    )
    found = best.select("word", (p > SIGN_RATIO * q).alias("sign")).collect()
    return [(bytes(r["word"]), r["sign"]) for r in found]


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, features: int = FEATURES) -> Model:
    sample = _labelled(docs, labels, sample_rows)
    graded = "grade" in labels.columns
    chosen = _features(sample, features)
    if not chosen:
        return Model({}, ())
    names, signs = [w for w, _ in chosen], frozenset(w for w, sign in chosen if sign)
    place = {w: i for i, w in enumerate(names)}

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(place)
        for batch in rows(batches):
            at, n, marked = [], [], []
            for text in batch.column(0):
                words = _words(text.as_py())
                found = known.count(words)
                at.append([place[f] for f in found])
                n.append(list(found.values()))
                marked.append(sum(not signs.isdisjoint(known[w]) for w in words))
            yield pa.RecordBatch.from_arrays(
                [pa.array(at, pa.list_(pa.int32())), pa.array(n, pa.list_(pa.int32())), pa.array(marked, pa.int64()), batch.column(1)],
                names=["at", "n", "marked", "grade"],
            )

    held = sample.select("text", "grade").mapInArrow(
        tidy(count), "at array<int>, n array<int>, marked long, grade int"
    ).collect()
    x = np.zeros((len(held), len(names)), np.float32)
    for i, r in enumerate(held):
        x[i, r["at"]] = np.log1p(np.array(r["n"], np.float32))
    grade = np.array([r["grade"] for r in held])
    if not graded:
        marked = np.array([r["marked"] for r in held])
        cuts = np.quantile(marked[grade > 0], [1 / 3, 2 / 3])
        grade = np.where(grade > 0, 1 + np.searchsorted(cuts, marked, side="left"), 0)
    weights, thresholds = _fit(x, grade)
    return Model(dict(zip(names, weights.tolist())), tuple(thresholds.tolist()))


def _fit(x: np.ndarray, grade: np.ndarray, steps: int = 25) -> tuple[np.ndarray, np.ndarray]:
    """Weights and rising thresholds of least penalised loss, by Newton's method.

    The loss is the sum over k of the log loss of "grade is at least k".  These
    events are nested, so the best thresholds rise by themselves.
    """
    levels = np.unique(grade[grade > 0])
    target = (grade[:, None] >= levels[None, :]).astype(np.float32)
    m, k = x.shape[1], len(levels)
    par = np.append(np.zeros(m), np.log((1 - target.mean(0)) / np.maximum(target.mean(0), 1e-6)))

    def loss(par: np.ndarray) -> float:
        z = (x @ par[:m].astype(np.float32))[:, None] - par[m:]
        return float((np.logaddexp(0, z) - target * z).sum()) + _RIDGE / 2 * float(par[:m] @ par[:m])

    now = loss(par)
    for _ in range(steps):
        z = (x @ par[:m].astype(np.float32))[:, None] - par[m:]
        p = 1 / (1 + np.exp(-z))
        error, spread = p - target, (p * (1 - p)).astype(np.float32)
        slope = np.append(x.T @ error.sum(1) + _RIDGE * par[:m], -error.sum(0))
        bend = np.zeros((m + k, m + k))
        bend[:m, :m] = x.T @ (x * spread.sum(1)[:, None]) + _RIDGE * np.eye(m)
        bend[:m, m:] = -(x.T @ spread)
        bend[m:, :m] = bend[:m, m:].T
        bend[m:, m:] = np.diag(spread.sum(0)) + 1e-6 * np.eye(k)
        step = np.linalg.solve(bend, slope)
        size = 1.0
        while size > 1e-4 and (after := loss(par - size * step)) > now:
            size /= 2
        if size <= 1e-4 or now - after < 1e-6 * max(1.0, now):
            break
        par, now = par - size * step, after
    return par[:m], par[m:]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` plus ``severity`` double (expected grade), ``p_toxic`` double,
    ``grade`` int (levels that are more likely reached than not) and ``toxic``
    boolean.  Columns of these names are replaced."""
    docs = docs.drop("severity", "p_toxic", "grade", "toxic")
    text_at = docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(model.weights)
        for batch in rows(batches):
            severity, chance, grade = [], [], []
            for text in batch.column(text_at):
                p = model.at_least(known.count(_words(text.as_py())))
                severity.append(float(p.sum()))
                chance.append(float(p[0]) if len(p) else 0.0)
                grade.append(int((p >= 0.5).sum()))
            arrays = [
                *batch.columns,
                pa.array(severity, pa.float64()),
                pa.array(chance, pa.float64()),
                pa.array(grade, pa.int32()),
                pa.array([c >= REJECT for c in chance], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=[f"c{k}" for k in range(len(arrays))])

    added = [
        T.StructField("severity", T.DoubleType()),
        T.StructField("p_toxic", T.DoubleType()),
        T.StructField("grade", T.IntegerType()),
        T.StructField("toxic", T.BooleanType()),
    ]
    return docs.mapInArrow(tidy(run), T.StructType([*docs.schema.fields, *added]))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, severity, p_toxic, grade, toxic) of every document."""
    return score(docs.select("doc_id", "text"), fit(docs, labels))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those that the model rejects; same columns."""
    names = ("severity", "p_toxic", "grade", "toxic")
    model = fit(docs, labels)
    safe = {c: unused(docs, f"_own_{c}")[0] for c in docs.columns if c.lower() in names}
    scored = score(docs.withColumnsRenamed(safe), model)
    return scored.where(~F.col("toxic")).drop(*names).withColumnsRenamed({v: k for k, v in safe.items()})
