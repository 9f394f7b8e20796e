"""Align the tokens of two tokenizers over the same bytes.

A text is encoded as space+text by a byte-level BPE (A) and by a sentencepiece model
that puts the space itself (B).  Where tokens of both end at the same byte, the text is
cut into groups, and the two tokens that end there are linked.  The number of links of an
id pair, over the whole corpus, tells how far the pair is the usual one.

The spans that the libraries give are the coarse cuts: characters for A, bytes of the
sentence for B.  Where a span ends inside a character, or is empty as those of byte
fallback are, the ends follow from the decoded bytes of the tokens (:func:`span_ends`).
All is then held against the bytes of the text; a text that either tokenizer does not give
back byte by byte has no tokens.

Neither tokenizer has a token across the border between a character that is no white
space and a blank, so a text is cut there into words, and each worker keeps the
alignment of words it has met (at most :data:`MEMO_CHARS` characters; then it starts
anew).  New words are encoded many in one text.  Where a vocabulary's rules do not
exclude such a token, whole texts take the place of words.

Counts: a document hands on each distinct pair with its number.  The counts of the
:data:`COMMON` most frequent pairs are sent to all tasks, which is a fixed size and takes
hot keys out of the shuffle; other pairs meet their counts in a join.

Null and empty texts have no tokens: numbers are 0 and the digest is ''.  Texts of any
length are taken whole.  Documents with one doc_id, repeated rows and rows without id
are rows of their own, and all of them count.  An empty table gives an empty result.
Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditrank.llm.frames import rows
from auditrank.session import stage

#: Pairs whose counts are sent to all tasks: 2 MB.
COMMON = 131_072
#: Characters of words that a worker remembers, and of text that it works on at a time.
MEMO_CHARS = 5_000_000
SLICE_CHARS = 1_000_000
#: Characters of new words that are encoded in one call.
_TOGETHER = 4_000
_SPACE = "▁"


def _byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1
    letters are themselves, the other bytes follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(other)}


class Pair:
    """Both tokenizers with the bytes of their tokens."""

    def __init__(self, byte_level: str, pieces: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(byte_level)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        letters = _byte_letters()
        special = {i for i, t in self.a.get_added_tokens_decoder().items() if t.special}
        entries = {i: t for t, i in self.a.get_vocab().items()}
        self.a_bytes = [b""] * (max(entries) + 1)
        for i, t in entries.items():
            self.a_bytes[i] = t.encode() if i in special else bytes(map(letters.__getitem__, t))
        self.b_size = self.b.vocab_size()
        names = [self.b.id_to_piece(i) for i in range(self.b_size)]
        self.b_bytes = [
            bytes([int(name[3:-1], 16)]) if self.b.is_byte(i) else name.replace(_SPACE, " ").encode()
            for i, name in enumerate(names)
        ]
        #: Whether a blank behind a letter always begins a token: in A by the rule of the
        #: byte-level splitter, in B because no piece has a blank behind another character.
        made = json.loads(byte_level)
        splitter = made.get("pre_tokenizer") or {}
        self.by_word = (
            splitter.get("type") == "ByteLevel"
            and splitter.get("use_regex", True)
            and not splitter.get("add_prefix_space")
            and made.get("normalizer") is None
            and not any(re.search(rf"[^{_SPACE}]{_SPACE}", name) for name in names)
        )

    def tokens(self, text: str) -> Tokens | None:
        """The tokens of space+``text``; None if the joined bytes of A or B differ from it."""
        full = " " + text
        raw = full.encode()
        encoding = self.a.encode(full, add_special_tokens=False)
        a_ids = encoding.ids
        a_spans = np.array(encoding.offsets, np.int64).reshape(-1, 2)
        if len(raw) != len(full):  # spans of A count characters
            codes = np.frombuffer(full.encode("utf-32-le"), np.uint32)
            sizes = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
            a_spans = np.r_[0, np.cumsum(sizes)][a_spans]
        # Spans of B follow one another and count bytes, without the space before the text.
        pieces = [(p.id, p.end) for p in self.b.encode(text, return_type="proto").pieces]
        b_ids = [i for i, _ in pieces]
        b_last = np.array([end for _, end in pieces], np.int64) + 1
        b_spans = np.stack([np.r_[np.ones(min(1, len(b_last)), np.int64), b_last[:-1]], b_last], 1)
        a_parts = list(map(self.a_bytes.__getitem__, a_ids))
        b_parts = list(map(self.b_bytes.__getitem__, b_ids))
        if b"".join(a_parts) != raw or b"".join(b_parts) != raw:
            return None
        return Tokens(a_ids, span_ends(a_spans, a_parts), b_ids, span_ends(b_spans, b_parts))


class Tokens(NamedTuple):
    """Ids of A and B, and the byte behind each token."""

    a_ids: list[int]
    a_ends: np.ndarray
    b_ids: list[int]
    b_ends: np.ndarray


def span_ends(spans: np.ndarray, parts: list[bytes]) -> np.ndarray:
    """The byte behind each token, from spans that may be coarse.

    The end of a span is a cut if it lies behind the span's own beginning and no later
    token begins before it.  Tokens that share a character, and byte-fallback tokens, whose
    spans are empty but for the last, lie between cuts: there the tokens' bytes are counted.
    """
    counted = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
    first, last = spans[:, 0], spans[:, 1]
    cut = last > first
    cut[:-1] &= first[1:] >= last[:-1]
    # Spans over characters that a normaliser made are no cuts; the bytes have been compared.
    cut &= last == counted
    at = np.maximum.accumulate(np.where(cut, np.arange(len(parts)), -1))
    base, done = np.r_[last, 0][at], np.r_[counted, 0][at]
    return base + counted - done


class Groups(NamedTuple):
    """For each byte where tokens of both end: the byte, and how many tokens of A and of B
    end there or before."""

    ends: np.ndarray
    a: np.ndarray
    b: np.ndarray

    def texts(self, tokens: Tokens) -> list[str]:
        a, b = (list(map(str, ids)) for ids in (tokens.a_ids, tokens.b_ids))
        out, i, j = [], 0, 0
        for p, q in zip(self.a.tolist(), self.b.tolist()):
            left = a[i] if p - i == 1 else ",".join(a[i:p])
            right = b[j] if q - j == 1 else ",".join(b[j:q])
            out.append(f"{left}|{right}")
            i, j = p, q
        return out

    def links(self, tokens: Tokens, b_size: int) -> np.ndarray:
        """Ids of the tokens that end together, a pair as one number."""
        return np.array(tokens.a_ids, np.int64)[self.a - 1] * b_size + np.array(tokens.b_ids, np.int64)[self.b - 1]


def groups_of(tokens: Tokens) -> Groups:
    ends = np.intersect1d(tokens.a_ends, tokens.b_ends, assume_unique=True)
    return Groups(
        ends, np.searchsorted(tokens.a_ends, ends, "right"), np.searchsorted(tokens.b_ends, ends, "right")
    )


_BORDER = re.compile(r"(?<=\S) ")
_BLANK_RUN = re.compile(r"\s ")


def words(text: str) -> list[str]:
    """``text`` cut before each blank that follows no white space; that blank is left out,
    as the one that space+text begins with is."""
    if text[:1] == " " or _BLANK_RUN.search(text):
        return _BORDER.split(text)
    return text.split(" ")


class Memo:
    """Alignments of words: numbers, the groups as text, and links as a * size of B + b."""

    def __init__(self, pair: Pair):
        self.pair = pair
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.chars = 0
        self.good = array("b")
        self.numbers = array("q")  # tokens of A, tokens of B, groups
        self.groups: list[str] = []
        self.links = array("q")
        self.first = array("q", [0])

    def _put(self, some: list[str], tokens: Tokens | None) -> None:
        """Adds words that were encoded together; None: a word that does not come back."""
        for word in some:
            self.known[word] = len(self.known)
            self.chars += len(word)
        if tokens is None:
            self.good.append(0)
            self.numbers.extend((0, 0, 0))
            self.groups.append("")
            self.first.append(len(self.links))
            return
        found = groups_of(tokens)
        behind = np.cumsum(np.fromiter((len(w.encode()) + 1 for w in some), np.int64, len(some)))
        upto = [np.searchsorted(ends, behind, "right") for ends in (tokens.a_ends, tokens.b_ends, found.ends)]
        if not np.array_equal(found.ends[upto[2] - 1], behind):
            raise ValueError("a token lies across the border of two words")
        self.good.extend([1] * len(some))
        self.numbers.frombytes(np.stack([np.diff(u, prepend=0) for u in upto], 1).astype(np.int64).tobytes())
        texts, begin = found.texts(tokens), 0
        for end in upto[2].tolist():
            self.groups.append(";".join(texts[begin:end]))
            begin = end
        self.first.frombytes((upto[2] + len(self.links)).astype(np.int64).tobytes())
        self.links.frombytes(found.links(tokens, self.pair.b_size).astype(np.int64).tobytes())

    def learn(self, new: list[str]) -> None:
        """Encodes words, many in one text; apart if that text does not come back whole."""
        start = 0
        while start < len(new):
            end, size = start, 0
            while end < len(new) and (end == start or size + len(new[end]) < _TOGETHER):
                size += len(new[end]) + 1
                end += 1
            some = new[start:end]
            start = end
            tokens = self.pair.tokens(" ".join(some))
            if tokens is None and len(some) > 1:
                for word in some:
                    self._put([word], self.pair.tokens(word))
            else:
                self._put(some, tokens)


#: The worker's memos by the digest of their vocabularies; they outlive a task.
_MEMOS: dict[str, Memo] = {}


def _memo(name: str, files: tuple[str, bytes]) -> Memo:
    if name not in _MEMOS:
        _MEMOS.clear()
        _MEMOS[name] = Memo(Pair(*files))
    return _MEMOS[name]


def align(docs: DataFrame, byte_level: str, pieces: str) -> tuple[DataFrame, int]:
    """For each document doc_id, n_a, n_b, n_groups, groups_sha256 and its distinct links
    with their numbers (pairs, times); and the size of B by which a pair is encoded."""
    with open(byte_level, encoding="utf-8") as a, open(pieces, "rb") as b:
        files = a.read(), b.read()
    size = Pair(*files).b_size
    name = hashlib.sha256(files[0].encode() + files[1]).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast(files)

    def slices(texts: Iterable[str | None]) -> Iterator[list[str]]:
        held, chars = [], 0
        for text in texts:
            held.append(text or "")
            chars += len(held[-1])
            if chars >= SLICE_CHARS:
                yield held
                held, chars = [], 0
        if held:
            yield held

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _memo(name, shared.value)
        for batch in rows(batches):
            at = 0
            for texts in slices(t.as_py() for t in batch.column(1)):
                yield _aligned(memo, batch.column(0).slice(at, len(texts)), texts)
                at += len(texts)

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", "text").mapInArrow(
        run,
        f"doc_id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>, times array<int>",
    )
    return found, size


def _aligned(memo: Memo, ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
    if memo.chars > MEMO_CHARS:
        memo.clear()
    cut = [(words(t) if memo.pair.by_word else [t]) if t else [] for t in texts]
    known = memo.known
    new = {w for ws in cut for w in ws if w not in known}
    if new:
        memo.learn(list(new))
    counts = np.fromiter(map(len, cut), np.int64, len(cut))
    at = np.fromiter((known[w] for ws in cut for w in ws), np.int64, int(counts.sum()))
    owner = np.repeat(np.arange(len(cut)), counts)
    good = np.array(memo.good, dtype=bool)
    whole = np.bincount(owner, ~good[at], len(cut)) == 0
    # One bad word: the bytes of the whole text decide, as the contract says.
    digests, again = [], {}
    for k in np.flatnonzero(~whole):
        found = memo.pair.tokens(texts[k])
        if found is not None:
            again[k] = found
    numbers = np.array(memo.numbers, np.int64).reshape(-1, 3)
    keep = whole[owner]
    at, owner = at[keep], owner[keep]
    sums = np.stack([np.bincount(owner, numbers[at, c], len(cut)).astype(np.int64) for c in range(3)], 1)
    groups = memo.groups
    begin = 0
    for k, n in enumerate(np.bincount(owner, minlength=len(cut)).tolist()):
        if n:
            joined = ";".join([groups[i] for i in at[begin : begin + n].tolist()])
            digests.append(hashlib.sha256(joined.encode()).hexdigest())
        else:
            digests.append("")
        begin += n
    first = np.array(memo.first, np.int64)
    length = first[at + 1] - first[at]
    total = int(length.sum())
    places = np.arange(total) - np.repeat(np.cumsum(length) - length, length) + np.repeat(first[at], length)
    links = np.array(memo.links, np.int64)[places] if total else np.zeros(0, np.int64)
    link_owner = np.repeat(owner, length)
    for k, tokens in again.items():
        own = groups_of(tokens)
        sums[k] = len(tokens.a_ids), len(tokens.b_ids), len(own.ends)
        digests[k] = hashlib.sha256(";".join(own.texts(tokens)).encode()).hexdigest()
        links = np.concatenate([links, own.links(tokens, memo.pair.b_size)])
        link_owner = np.concatenate([link_owner, np.full(len(own.ends), k)])
    order = np.lexsort((links, link_owner))
    links, link_owner = links[order], link_owner[order]
    starts = np.flatnonzero(np.r_[True, (links[1:] != links[:-1]) | (link_owner[1:] != link_owner[:-1])]) if len(links) else np.zeros(0, np.int64)
    times = np.diff(np.r_[starts, len(links)])
    offsets = np.r_[0, np.cumsum(np.bincount(link_owner[starts], minlength=len(cut)))].astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [
            ids,
            *(pa.array(sums[:, c]) for c in range(3)),
            pa.array(digests, pa.string()),
            pa.ListArray.from_arrays(offsets, pa.array(links[starts].astype(np.int64))),
            pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32))),
        ],
        names=["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "times"],
    )


def pair_counts(aligned: DataFrame, size: int) -> DataFrame:
    """(pair, links, best): links of each pair over all documents, and whether no other
    pair with its B id has more."""
    counts = stage(
        aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("own"))
        .groupBy(F.col("own.pairs").alias("pair"))
        .agg(F.sum("own.times").alias("links")),
        "pair-counts",
    )
    b_id = F.col("pair") % size
    # One row per id of B.
    most = counts.groupBy(b_id.alias("b_id")).agg(F.max("links").alias("most"))
    return counts.join(F.broadcast(most), b_id == F.col("b_id")).select(
        "pair", "links", (F.col("links") == F.col("most")).alias("best")
    )


def report(docs: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """One row per document: numbers, the sum of its links' counts, how many of them are
    their B id's most frequent, and the digest of its groups."""
    spark = docs.sparkSession
    found, size = align(docs, byte_level, pieces)
    aligned = stage(found.withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = stage(pair_counts(aligned, size), "pair-links")
    common = counts.orderBy(F.desc("links"), "pair").limit(COMMON).toArrow()
    common = common.take(pc.sort_indices(common["pair"]))
    table = spark.sparkContext.broadcast(
        tuple(common[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("pair", "links", "best"))
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, links, best = table.value
        for batch in rows(batches):
            n = batch.num_rows
            own, times = (batch.column(k).flatten().to_numpy() for k in (1, 2))
            owner = np.repeat(np.arange(n), batch.column(1).value_lengths().fill_null(0).to_numpy())
            place = np.minimum(np.searchsorted(pair, own), max(len(pair) - 1, 0))
            hit = pair[place] == own if len(pair) else np.zeros(len(own), bool)
            place, here = place[hit], owner[hit]
            n_best = np.zeros(n, np.int64)
            total = np.zeros(n, np.int64)
            np.add.at(n_best, here, times[hit] * best[place].astype(np.int64))
            np.add.at(total, here, times[hit] * links[place])
            offsets = np.r_[0, np.cumsum(np.bincount(owner[~hit], minlength=n))].astype(np.int32)
            arrays = [batch.column(0), pa.array(n_best), pa.array(total)]
            arrays += [pa.ListArray.from_arrays(offsets, pa.array(x[~hit])) for x in (own, times)]
            yield pa.RecordBatch.from_arrays(arrays, names=["row", "n_best", "count_sum", "pairs", "times"])

    near = stage(
        aligned.select("row", "pairs", "times").mapInArrow(
            run, "row long, n_best long, count_sum long, pairs array<long>, times array<int>"
        ),
        "common-links",
    )
    rare = (
        near.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("own"))
        .select("row", F.col("own.pairs").alias("pair"), F.col("own.times").cast("long").alias("times"))
        .join(counts, "pair")
        .select("row", F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"), (F.col("times") * F.col("links")).alias("count_sum"))
    )
    sums = (
        near.select("row", "n_best", "count_sum")
        .unionByName(rare)
        .groupBy(F.col("row").alias("sum_row"))
        .agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    )
    return aligned.join(sums, F.col("row") == F.col("sum_row")).select(
        "doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256"
    )
