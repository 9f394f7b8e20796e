"""Line dedup across documents by an exact set-similarity join.

A line is the set of its words (split at white space, A-Z as a-z).  Lines are
in corpus order: by doc_id, then line number.  A line goes if any line before
it has a Jaccard similarity of at least 4/5 with it.

1. Words are counted in hash buckets over all documents; the buckets' order from
   rare to frequent, a table of fixed size, is sent to all tasks.  Any one order
   gives the same result, a good one gives few candidates.
2. Equal sets are folded to their first line before anything else is compared.
3. Each remaining line puts its rarest words (the prefix that two lines as
   similar as asked must share a word of) into a shuffle by word.  Rows of a word
   stream by in order of size; pairs must pass the length, the positional and a
   bitmap filter (64 bits, 256 for long lines), and long lines must share several words
   of longer prefixes.
4. A line needs only one similar line before it.  So each line is first given its
   nearest earlier candidates of each word; lines that this did not remove, and that
   had more, get more (``ROUNDS``), and what is still open then is compared with
   every candidate.  Later rounds read only words of open lines.  A hot group of
   similar lines makes no square of pairs.
5. Pairs are verified on the words of both lines.

Defined results: a NULL text stays NULL.  Lines without words stay.  Rows equal
in doc_id and text are one document for the comparison and get the same text;
rows that share a doc_id but not the text follow the order of a hash of the
text; a NULL doc_id comes last.  Other columns pass through unchanged.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditrank.llm.frames import packed, rows, tidy, unpack, unused
from auditrank.llm.words import NOT_SPACE, blocks, hash_words, mix, texts
from auditrank.operators.ordering import numbered
from auditrank.session import stage

#: Similarity asked for: NUMERATOR / DENOMINATOR.
NUMERATOR, DENOMINATOR = 4, 5
#: log2 of the number of hash buckets in which words are counted.
BUCKET_BITS = 20
_PARTS = 16
#: Following rows of the same word that one pass compares a row with.
REACH = 1024
#: Earlier partners per line and word that each round hands on.
ROUNDS = (4, 32)
#: Words of lines that a task holds as Python objects.
WORDS_AT_ONCE = 1 << 15
#: Words, and prefix rows, of open lines up to which they are broadcast (a few MB).
SENT_WORDS, SENT_ROWS = 1 << 17, 1 << 16

#: Lines of more words have a bitmap of 256 bits instead of 64 and must share more than
#: one word of their prefixes.
LONG = 48
_BITS = ("bits", "bits_2", "bits_3", "bits_4")

_KEY = ("doc_id", "_text_key", "line_no")
_SPACES = b"\x09\x0a\x0b\x0c\x0d\x20"


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("_text_key"), "text")


def word_order(docs: DataFrame) -> np.ndarray:
    """Rank of each hash bucket, rare before frequent, over all words of all texts."""
    size = 1 << BUCKET_BITS

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in rows(batches):
            for _, _, data, cuts in blocks(texts(batch.column(0))):
                _, found = hash_words(data, cuts, NOT_SPACE)
                total += np.bincount((found >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=size)
        yield sums({i: part for i, part in enumerate(np.split(total, _PARTS))})

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in rows(batches):
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                more = np.frombuffer(counts.as_py(), np.int64)
                totals[part] = totals[part] + more if part in totals else more
        yield sums(totals)

    def sums(totals: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.record_batch(
            [pa.array(totals.keys(), pa.int32()), pa.array([x.tobytes() for x in totals.values()], pa.binary())],
            names=["part", "counts"],
        )

    kind = "part int, counts binary"
    found = docs.select("text").mapInArrow(tidy(count), kind).repartition(_PARTS, "part").mapInArrow(tidy(add), kind).collect()
    total = np.zeros((_PARTS, size // _PARTS), np.int64)
    for part, counts in found:
        total[part] += np.frombuffer(counts, np.int64)
    rank = np.empty(size, np.uint32)
    rank[np.argsort(total.ravel(), kind="stable")] = np.arange(size, dtype=np.uint32)
    return rank


def _least_overlap(size):
    """Words a line of this size shares at least with a line that is similar enough."""
    return -(-NUMERATOR * size // DENOMINATOR)


def _shared_words(size):
    """Words that two such lines share at least within prefixes so much longer."""
    return 1 + size // LONG


_SETS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("_text_key", T.LongType()),
        T.StructField("line_no", T.IntegerType()),
        T.StructField("set_a", T.LongType()),
        T.StructField("set_b", T.LongType()),
        T.StructField("size", T.IntegerType()),
        *(T.StructField(name, T.LongType()) for name in _BITS),
        T.StructField("prefix", T.ArrayType(T.IntegerType())),
    ]
)


def line_sets(docs: DataFrame, order: np.ndarray) -> DataFrame:
    """One row per line with words: hashes of its set, size, bitmap and prefix."""
    sent = docs.sparkSession.sparkContext.broadcast(order)  # 4 MB, whatever the input

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = sent.value
        for batch in rows(batches):
            ids, keys = batch.column(0), batch.column(1)
            for first, _, data, cuts in blocks(texts(batch.column(2))):
                found = _sets_of(data, cuts, rank)
                if found is not None:
                    row, *columns = found
                    at = pa.array(row + first)
                    yield pa.RecordBatch.from_arrays([ids.take(at), keys.take(at), *columns], names=_SETS.names)

    return docs.mapInArrow(tidy(run), _SETS)


def _sets_of(data: np.ndarray, cuts: np.ndarray, rank: np.ndarray) -> list | None:
    at, found = hash_words(data, cuts, NOT_SPACE)
    if not len(at):
        return None
    breaks = np.flatnonzero(data == 10)
    row = np.searchsorted(cuts, at, side="right") - 1
    line = np.searchsorted(breaks, at)
    start = np.flatnonzero(np.diff(line + row, prepend=-1))
    key = rank[(found >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(40)
    key |= found >> np.uint64(24)
    for a, b in zip(start.tolist(), [*start[1:].tolist(), len(key)]):
        key[a:b].sort()
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    new[start] = True
    row_of, line_of = row[start], line[start] - np.searchsorted(breaks, cuts)[row[start]]
    size = np.add.reduceat(new.astype(np.int64), start)
    key = key[new]
    begin = np.cumsum(size) - size
    place = mix(key)
    bit, part = np.uint64(1) << (place & np.uint64(63)), (place >> np.uint64(6)) & np.uint64(3)
    part[np.repeat(size <= LONG, size)] = 0
    bits = [np.bitwise_xor.reduceat(np.where(part == k, bit, np.uint64(0)), begin) for k in range(len(_BITS))]
    set_a = np.add.reduceat(mix(key ^ np.uint64(0x5851F42D4C957F2D)), begin)
    set_b = np.add.reduceat(mix(key ^ np.uint64(0x14057B7EF767814F)), begin)
    length = size - _least_overlap(size) + _shared_words(size)
    head = np.arange(len(key)) - np.repeat(begin, size) < np.repeat(length, size)
    prefix = pa.ListArray.from_arrays(
        pa.array(np.append(0, np.cumsum(length)), pa.int32()), pa.array(key[head].astype(np.uint32).view(np.int32))
    )
    return [
        row_of,
        pa.array(line_of, pa.int32()),
        pa.array(set_a.view(np.int64)),
        pa.array(set_b.view(np.int64)),
        pa.array(size, pa.int32()),
        *(pa.array(x.view(np.int64)) for x in bits),
        prefix,
    ]


class _Partners:
    """For each row the few earlier lines of smallest gap met so far."""

    NONE = np.iinfo(np.int64).max

    def __init__(self, best: int, n: int = 0):
        self.gap = np.full((n, best), self.NONE)
        self.line = np.full((n, best), -1, np.int64)
        self.need = np.zeros((n, best), np.int64)
        self.missed = np.zeros(n, bool)

    def grown(self, n: int) -> "_Partners":
        """The same rows and ``n`` new ones."""
        new = _Partners(self.gap.shape[1], n)
        for name, own in vars(self).items():
            setattr(new, name, np.concatenate((own, getattr(new, name))))
        return new

    def from_row(self, row: int) -> "_Partners":
        out = _Partners(self.gap.shape[1])
        for name, own in vars(self).items():
            setattr(out, name, own[row:])
        return out

    def add(self, row: np.ndarray, line: np.ndarray, gap: np.ndarray, need: np.ndarray) -> None:
        """A candidate for each of some different rows; the worst of a full list goes."""
        worst = self.gap[row, -1]
        self.missed[row[worst < self.NONE]] = True
        better = gap < worst
        row = row[better]
        self.gap[row, -1], self.line[row, -1], self.need[row, -1] = gap[better], line[better], need[better]
        if self.gap.shape[1] > 1:
            order = np.argsort(self.gap[row], axis=1, kind="stable")
            for own in (self.gap, self.line, self.need):
                own[row] = np.take_along_axis(own[row], order, 1)

    def rows(self, line: np.ndarray, upto: int) -> Iterator[pa.RecordBatch]:
        row, place = np.nonzero(self.line[:upto] >= 0)
        none = np.flatnonzero(self.missed[:upto])
        if len(row) or len(none):
            a = np.concatenate((self.line[row, place], line[none]))
            b = pa.concat_arrays([pa.array(line[row]), pa.nulls(len(none), pa.int64())])
            need = np.concatenate((self.need[row, place], np.ones(len(none), np.int64)))
            yield pa.record_batch([pa.array(a), b, pa.array(need)], names=["a", "b", "need"])


def _candidates(best: int, twice: bool = False):
    """From rows sorted by (word, size): pairs of an earlier line ``a`` and an open line
    ``b`` that pass all filters for one word, ``best`` for each b, and how many words
    they must share in all.

    A row with no ``b`` says that ``a`` had partners that were not handed on.  With
    ``twice`` open lines have a row more, which is not marked and serves as a partner.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros(0, k) for k in (np.int32, np.int64, np.int64, *[np.uint64] * len(_BITS), np.bool_)]
        partners = _Partners(best)
        for batch in rows(batches):
            new = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(len(kept))]
            kept = [np.concatenate((x, y.view(x.dtype))) for x, y in zip(kept, new)]
            word, meta, line, *bits, open_ = kept
            old, n = len(word) - batch.num_rows, len(word)
            partners = partners.grown(n - old)
            size, place = meta >> 32, meta & 0xFFFFFFFF
            folded = np.bitwise_xor.reduce(bits)  # what a bitmap of 64 bits would be
            # Words without an open line are passed over.
            start = np.flatnonzero(np.diff(word, prepend=word[0] ^ 1))
            i = np.flatnonzero(np.repeat(np.logical_or.reduceat(open_, start), np.diff(np.append(start, n))))
            for step in range(1, REACH + 2):
                i = i[i + step < n]
                j = i + step
                close = (word[i] == word[j]) & (NUMERATOR * size[j] <= DENOMINATOR * size[i])
                i, j = i[close], j[close]
                if not len(i):
                    break
                new_pair = j >= old
                i_, j_ = i[new_pair], j[new_pair]
                if step > REACH:  # an open row has more neighbours, whoever they are
                    partners.missed[i_[open_[i_]]] = True
                    partners.missed[j_[open_[j_]]] = True
                    break
                looks = (open_[i_] != open_[j_]) & (line[i_] != line[j_]) if twice else open_[i_] | open_[j_]
                a, b = i_[looks], j_[looks]
                # The later line of a pair looks for a partner.
                behind = line[a] > line[b]
                wanted = np.where(behind, open_[a], open_[b])
                a, b, behind = a[wanted], b[wanted], behind[wanted]
                both = size[a] + size[b]
                least = -(-NUMERATOR * both // (NUMERATOR + DENOMINATOR))
                after = np.minimum(size[a] - place[a], size[b] - place[b])
                gap = np.bitwise_count(folded[a] ^ folded[b]).astype(np.int64)
                long = np.flatnonzero(size[a] > LONG)  # the larger one is then long as well
                gap[long] = sum(np.bitwise_count(x[a[long]] ^ x[b[long]]).astype(np.int64) for x in bits)
                good = (np.minimum(place[a], place[b]) + after >= least) & (gap <= both - 2 * least)
                a, b, gap, behind = a[good], b[good], gap[good], behind[good]
                need = _shared_words(np.minimum(size[a], size[b]))
                for own, other, some in ((a, b, behind), (b, a, ~behind)):
                    partners.add(own[some], line[other[some]], gap[some], need[some])
            # Rows that no later row can meet are done.
            tail = max(_last_group(word), n - REACH - 1)
            yield from partners.rows(line, tail)
            partners = partners.from_row(tail)
            kept = [x[tail:] for x in kept]
        yield from partners.rows(kept[2], len(kept[2]))

    return run


def _last_group(word: np.ndarray) -> int:
    other = np.flatnonzero(word != word[-1])
    return int(other[-1]) + 1 if len(other) else 0


def _prefix_rows(lines: DataFrame) -> DataFrame:
    return lines.select(F.posexplode("prefix").alias("place", "word"), "size", "line", *_BITS).select(
        "word",
        (F.shiftleft(F.col("size").cast("long"), 32) + F.col("place")).alias("meta"),
        "line",
        *_BITS,
    )


def _of_words(rows_: DataFrame, looking: DataFrame) -> DataFrame:
    """The prefix rows whose word some row of ``looking`` has."""
    words = looking.select("word").distinct()
    few = words.limit(SENT_WORDS + 1).count() <= SENT_WORDS
    return rows_.join(F.broadcast(words) if few else words, "word", "left_semi")


def _pairs(lines: DataFrame, open_: DataFrame | None, best: int) -> DataFrame:
    """Candidates of the open lines (None: of all), ``best`` for each word."""
    rows_ = _prefix_rows(lines).withColumn("open", F.lit(open_ is None))
    if open_ is not None:
        # Open lines, few, come once more to look for partners among all rows, so no row
        # has to be joined with a mark.
        looking = stage(_prefix_rows(lines.join(open_, "line", "left_semi")), "open-rows")
        rows_ = _of_words(rows_, looking).unionByName(looking.withColumn("open", F.lit(True)))
    return (
        rows_.repartition("word").sortWithinPartitions("word", "meta", "line")
        .mapInArrow(tidy(_candidates(best, twice=open_ is not None)), "a long, b long, need long").transform(_enough_words)
    )


def _enough_words(pairs: DataFrame) -> DataFrame:
    """Pairs that share as many words of their prefixes as they must."""
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"), F.max("need").alias("need")).where("n >= need").select("a", "b")


def _rest(unsure: DataFrame, lines: DataFrame) -> DataFrame:
    """Every pair of a line of ``unsure`` and an earlier one that passes the filters."""
    looking = stage(_prefix_rows(lines.join(unsure, "line", "left_semi")), "open-rows")
    own = [f"own_{name}" for name in _BITS]
    one = looking.select(
        "word", F.col("meta").alias("m1"), F.col("line").alias("l1"), *(F.col(x).alias(y) for x, y in zip(_BITS, own))
    )
    size1, size2 = F.shiftright("m1", 32), F.shiftright("meta", 32)
    place1, place2 = F.col("m1") % (1 << 32), F.col("meta") % (1 << 32)
    both = size1 + size2
    least = F.ceil(NUMERATOR * both / F.lit(NUMERATOR + DENOMINATOR))
    differ = [F.col(x).bitwiseXOR(F.col(y)) for x, y in zip(_BITS, own)]
    gap = F.when(F.least(size1, size2) > LONG, reduce(add, map(F.bit_count, differ))).otherwise(
        F.bit_count(reduce(Column.bitwiseXOR, differ))
    )
    fits = (
        (F.col("line") < F.col("l1"))
        & (NUMERATOR * F.greatest(size1, size2) <= DENOMINATOR * F.least(size1, size2))
        & (F.least(place1, place2) + F.least(size1 - place1, size2 - place2) >= least)
        & (gap <= both - 2 * least)
    )
    need = 1 + F.floor(F.least(size1, size2) / F.lit(LONG))
    rest = _of_words(_prefix_rows(lines), looking)
    if looking.limit(SENT_ROWS + 1).count() <= SENT_ROWS:
        one = F.broadcast(one)
    found = one.join(rest, (one["word"] == rest["word"]) & fits).select(
        "l1", F.col("line").alias("l2"), need.alias("need")
    )
    return _enough_words(found.select(F.col("l2").alias("a"), F.col("l1").alias("b"), "need"))


def _words_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(line, distinct words) of the picked lines of packed texts, in batches of bounded size."""

    def table_of(found: list[tuple[int, list[bytes]]]) -> pa.RecordBatch:
        return pa.record_batch(
            [pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.list_(pa.string()))],
            names=["line", "words"],
        )

    for batch in rows(batches):
        found, n = [], 0
        for text, picks in zip(batch.column(0), batch.column(1)):
            parts = unpack(text.as_py()).lower().split(b"\n")
            for p in picks.as_py():
                words = sorted(set(parts[p["line_no"]].split()))
                found.append((p["line"], words))
                n += len(words)
                if n >= WORDS_AT_ONCE:
                    yield table_of(found)
                    found, n = [], 0
        if found:
            yield table_of(found)


def _line_words(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(line, distinct words) of the wanted lines."""
    picks = wanted.groupBy("doc_id", "_text_key").agg(F.collect_list(F.struct("line_no", "line")).alias("picks"))
    docs = packed(docs)
    same = docs["doc_id"].eqNullSafe(picks["doc_id"]) & (docs["_text_key"] == picks["_text_key"])
    # Rows equal in doc_id and text would give the same line twice.
    once = docs.join(picks, same).select("text", "picks")
    return once.mapInArrow(tidy(_words_of), "line long, words array<string>")


def _later(docs: DataFrame, lines: DataFrame, pairs: DataFrame) -> DataFrame:
    """Lines that a verified pair shows to be like an earlier one."""
    place = lines.select("line", *_KEY)
    wanted = place.join(pairs.select(F.explode(F.array("a", "b")).alias("line")).distinct(), "line", "left_semi")
    # Words as strings: Spark compares arrays of strings by hash, of binaries one by one.
    words = stage(_line_words(docs, wanted), "line-words")
    one = words.select(F.col("line").alias("a"), F.col("words").alias("wa"))
    two = words.select(F.col("line").alias("b"), F.col("words").alias("wb"))
    shared = F.size(F.array_intersect("wa", "wb"))
    enough = (NUMERATOR + DENOMINATOR) * shared >= NUMERATOR * (F.size("wa") + F.size("wb"))
    return pairs.join(one, "a").join(two, "b").where(enough).select(F.col("b").alias("line")).distinct()


def kept_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, _text_key, keep): numbers of the lines with words that stay."""
    keyed = _keyed(docs.where(F.col("text").isNotNull()))
    sets = line_sets(keyed, word_order(keyed))
    firsts = (
        sets.groupBy("set_a", "set_b", "size", *_BITS, "prefix")
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), *_KEY)).alias("at"))
        .select("at.doc_id", "at._text_key", "at.line_no", "size", *_BITS, "prefix")
    )
    # Numbers in corpus order: of a pair, the line with the larger one goes.
    lines = numbered(firsts, [F.col("doc_id").isNull(), *map(F.col, _KEY)], "line")
    gone, open_ = None, None
    for best in ROUNDS:
        found = stage(_pairs(lines, open_, best), "line-pairs")
        later = stage(_later(keyed, lines, found.where(F.col("b").isNotNull())), "later-lines")
        gone = later if gone is None else gone.unionByName(later)
        missed = found.where(F.col("b").isNull()).select(F.col("a").alias("line"))
        open_ = stage(missed.join(later, "line", "left_anti"), "open-lines")
        if open_.isEmpty():
            break
    else:
        gone = gone.unionByName(_later(keyed, lines, stage(_rest(open_, lines), "line-pairs")))
    left = lines.select("line", *_KEY).join(gone, "line", "left_anti")
    return left.groupBy("doc_id", "_text_key").agg(F.collect_list("line_no").alias("keep"))


def dedup_lines(docs: DataFrame, removed: str = "removed_lines") -> DataFrame:
    """``docs`` with later similar lines cut out of ``text``, plus ``removed``
    array<int>, their numbers from 0.  A column of that name is replaced."""
    docs = docs.drop(removed)
    kept = kept_lines(docs)
    id_name, key_name, keep = unused(docs, "_id", "_key", "_keep")
    kept = kept.select(F.col("doc_id").alias(id_name), F.col("_text_key").alias(key_name), F.col("keep").alias(keep))
    (own,) = unused(docs, "_own_key")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(id_name)) & (F.col(own) == F.col(key_name))
    text_at, width = docs.columns.index("text"), len(docs.columns)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches):
            cut, gone = [], []
            for text, keep in zip(batch.column(text_at), batch.column(width)):
                whole = unpack(text.as_py()).decode("utf-8", "surrogatepass") if text.is_valid else None
                parts = whole.split("\n") if text.is_valid else []
                stays = set(keep.as_py() or ())
                lost = [
                    i for i, part in enumerate(parts) if i not in stays and part.encode("utf-8", "surrogatepass").strip(_SPACES)
                ]
                gone.append(lost)
                if not text.is_valid:
                    cut.append(None)
                elif not lost:
                    cut.append(whole)
                else:
                    lost = set(lost)
                    cut.append("\n".join(part for i, part in enumerate(parts) if i not in lost))
            arrays = list(batch.columns[:width])
            arrays[text_at] = pa.array(cut, pa.string())
            arrays.append(pa.array(gone, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, names=[f"c{k}" for k in range(len(arrays))])

    shape = T.StructType([*docs.schema.fields, T.StructField(removed, T.ArrayType(T.IntegerType()))])
    sent = packed(docs.withColumn(own, F.xxhash64("text")))
    return sent.join(kept, same, "left").select(*[F.col(f"`{c}`") for c in docs.columns], keep).mapInArrow(tidy(run), shape)


def report(docs: DataFrame) -> DataFrame:
    """One row per document: its lines, how many went, which, and the new text's digest."""
    n_lines = F.size(F.split("text", "\n", -1)).cast("long")
    before = docs.select("doc_id", "text").withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(n_lines))
    return dedup_lines(before).select(
        "doc_id",
        "n_lines",
        F.size("removed_lines").cast("long").alias("n_removed"),
        "removed_lines",
        F.sha2(F.encode(F.coalesce("text", F.lit("")), "utf-8"), 256).alias("text_sha256"),
    )


def brute_force(docs: list[tuple[int, str | None]]) -> dict[int, list[int]]:
    """Removed lines per document by comparing every pair; for tests with distinct ids."""
    lines = []
    for doc_id, text in sorted((d for d in docs if d[1] is not None), key=lambda d: (d[0] is None, d[0])):
        for i, part in enumerate(text.encode().lower().split(b"\n")):
            if part.split():
                lines.append((doc_id, i, set(part.split())))
    gone: dict[int, list[int]] = {d[0]: [] for d in docs}
    for k, (doc_id, i, words) in enumerate(lines):
        if any((NUMERATOR + DENOMINATOR) * len(words & w) >= NUMERATOR * (len(words) + len(w)) for _, _, w in lines[:k]):
            gone[doc_id].append(i)
    return gone
