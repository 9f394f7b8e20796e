"""Benchmark decontamination by multi-pattern search over words (Wu and Manber).

Patterns are windows of ten consecutive benchmark words.  A shift table says how
far a block of the last three words looked at lets the search jump; most
positions of a document are never looked at.  Where the shift is zero, the
block's bucket names the windows that end so, and words are compared one by one.

The windows are cut into shards of a bounded number of rows and documents go
through one shard after the other, so what a task holds does not grow with the
benchmark.  No row is shuffled.

Defined results: a NULL text has no words.  An item without words has no
window; one of fewer than ten words is one window.  Equal windows of several
items are hits of each of them.  Items with a NULL id mark words but are not
listed.  Repeated document rows are each answered.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditrank.llm.frames import rows, tidy, unused
from auditrank.llm.words import ALNUM_TABLE

#: Words of a window.
WINDOW = 10
#: Words of a block of the shift table.
BLOCK = 3
#: (window, item) rows in one shard; bounds what is broadcast at once.
SHARD_ROWS = 50_000


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(ALNUM_TABLE).split() if text else []


def windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct (window, item_id): the words of a window joined by spaces."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches):
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                found = {
                    b" ".join(words[i : i + window]) for i in range(max(1, len(words) - window + 1))
                } if words else set()
                for part in _parts(sorted(found), 10_000):
                    yield pa.record_batch(
                        [pa.array(part, pa.binary()), pa.array([item] * len(part), pa.int64())],
                        names=["window", "item_id"],
                    )

    items = benchmark.select(F.col("item_id").cast("long"), F.col("text"))
    return items.mapInArrow(tidy(cut), "window binary, item_id long").distinct()


def _parts(values: list, size: int) -> Iterator[list]:
    for i in range(0, len(values), size):
        yield values[i : i + size]


class Search:
    """Shift table and buckets for windows of one length."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], list[int]]):
        self.length, self.block = length, min(BLOCK, length)
        self.jump = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], dict[bytes, list]] = defaultdict(dict)
        for pattern, items in patterns.items():
            for end in range(self.block, length + 1):
                block = pattern[end - self.block : end]
                self.shift[block] = min(self.shift.get(block, self.jump), length - end)
            tail = self.buckets[pattern[-self.block :]]
            tail.setdefault(pattern[0], []).append((list(pattern), items))

    def find(self, words: list[bytes]) -> Iterator[tuple[int, list[int]]]:
        """Start and items of each occurrence."""
        length, block, jump, shift, n = self.length, self.block, self.jump, self.shift, len(words)
        end = length
        while end <= n:
            tail = tuple(words[end - block : end])
            step = shift.get(tail, jump)
            if step:
                end += step
                continue
            start = end - length
            for pattern, items in self.buckets[tail].get(words[start], ()):
                if words[start:end] == pattern:
                    yield start, items
            end += 1


def searches(found: Iterable[tuple[bytes, int | None]]) -> list[Search]:
    by_length: dict[int, dict[tuple[bytes, ...], list[int]]] = defaultdict(lambda: defaultdict(list))
    for window, item in found:
        pattern = tuple(bytes(window).split(b" "))
        by_length[len(pattern)][pattern].append(item)
    return [Search(length, patterns) for length, patterns in sorted(by_length.items())]


_BUILT: dict[str, list[Search]] = {}


def _built(shard: Broadcast, key: str) -> list[Search]:
    """The tables of a shard, kept for the next task of this worker."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = searches(shard.value)
    return _BUILT[key]


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``docs`` plus ``n_words`` long, ``spans`` array<struct<first, last>> (hit
    words, ends included, merged) and ``item_ids`` array<long> (sorted).

    Columns of ``docs`` with these names are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_words", "spans", "item_ids")
    patterns = windows(benchmark, window)
    shards = max(1, -(-patterns.count() // shard_rows))
    part = F.pmod(F.xxhash64("window", "item_id"), F.lit(shards))
    names = unused(docs, "_words", "_spans", "_items")
    state = [
        T.StructField(names[0], T.LongType()),
        T.StructField(names[1], T.ArrayType(T.IntegerType())),
        T.StructField(names[2], T.ArrayType(T.LongType())),
    ]
    out = docs
    for shard in range(shards):
        held = patterns.where(part == shard) if shards > 1 else patterns
        sent = spark.sparkContext.broadcast([(bytes(r[0]), r[1]) for r in held.collect()])
        out = out.mapInArrow(tidy(_searcher(sent, docs.columns.index("text"), shard > 0)), T.StructType([*docs.schema.fields, *state])
        )
    pairs = F.expr(
        f"transform(sequence(0, size(`{names[1]}`) div 2 - 1, 1), "
        f"i -> named_struct('first', `{names[1]}`[2 * i], 'last', `{names[1]}`[2 * i + 1]))"
    )
    return out.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.col(names[0]).alias("n_words"),
        F.when(F.size(names[1]) > 0, pairs).otherwise(F.expr("array()")).alias("spans"),
        F.col(names[2]).alias("item_ids"),
    )


def _searcher(sent: Broadcast, text_at: int, again: bool):
    key = uuid.uuid4().hex

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches):
            tables = _built(sent, key)
            own = batch.num_columns - 3 if again else batch.num_columns
            before = [batch.column(own + k) for k in (1, 2)] if again else None
            n_words, spans, items = [], [], []
            for i in range(batch.num_rows):
                words = words_of(batch.column(text_at)[i].as_py())
                hits = [
                    (start, start + table.length - 1, found)
                    for table in tables
                    for start, found in table.find(words)
                ]
                ranges = [(a, b) for a, b, _ in hits]
                known = {x for _, _, found in hits for x in found if x is not None}
                if again:
                    flat = before[0][i].as_py()
                    ranges += list(zip(flat[::2], flat[1::2]))
                    known.update(before[1][i].as_py())
                n_words.append(len(words))
                spans.append(_merged(ranges))
                items.append(sorted(known))
            arrays = [batch.column(k) for k in range(own)] + [
                pa.array(n_words, pa.int64()),
                pa.array(spans, pa.list_(pa.int32())),
                pa.array(items, pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=[f"c{k}" for k in range(len(arrays))])

    return search


def _merged(ranges: list[tuple[int, int]]) -> list[int]:
    out: list[int] = []
    for first, last in sorted(ranges):
        if out and first <= out[-1] + 1:
            out[-1] = max(out[-1], last)
        else:
            out += [first, last]
    return out


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without those that hold a benchmark window; same columns."""
    (name,) = unused(docs, "_benchmark_hit")
    columns = docs.columns
    kept = docs.select("*", *[F.col(f"`{c}`").alias(f"{name}_{c}") for c in ("n_words", "spans", "item_ids") if c in columns])
    hit = scan(kept, benchmark)
    back = [F.col(f"`{name}_{c}`").alias(c) if c in ("n_words", "spans", "item_ids") else F.col(f"`{c}`") for c in columns]
    return hit.where(F.size("spans") == 0).select(*back)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: how many words are hit, and by which items."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    listed = F.array_join(F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))), ",")
    return scan(docs.select("doc_id", "text"), benchmark).select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(listed, 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]]) -> list[tuple]:
    """The same report by comparing every window with every position; for tests."""
    out = []
    for doc_id, text in docs:
        words, hit, known = words_of(text), set(), set()
        for item, other in items:
            own = words_of(other)
            size = min(WINDOW, len(own))
            if not size:
                continue
            for i in range(len(own) - size + 1):
                for j in range(len(words) - size + 1):
                    if words[j : j + size] == own[i : i + size]:
                        hit.update(range(j, j + size))
                        if item is not None:
                            known.add(item)
        digest = hashlib.sha256(",".join(sorted(map(str, known))).encode()).hexdigest()
        out.append((doc_id, len(words), len(hit), len(known), digest, bool(hit)))
    return out
