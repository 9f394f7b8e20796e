"""BPE encoding and decoding with a lexicon in a minimal acyclic transducer.

The words of all documents are counted; the most frequent are encoded once by
exact merges and compiled into an automaton that shares prefixes and suffixes.
Each edge carries how many words are passed over by taking it, so the sum along
a word's path is its number, and with it the place of its ids.  The file is sent
to the executors (its size is bounded by ``LEXICON_WORDS``), memory-mapped by
their workers, and any word that it lacks is merged exactly, so the result does
not depend on the lexicon.

The vocabulary is a tokenizer file of the kind with word ends: NFC, white space
to a blank, lower case, words split by class, byte-level symbols.

Defined results: a NULL text counts as empty and has no tokens.  The two
control strings of the vocabulary are one token each, also inside a text.  A
text of any length is encoded whole.  Repeated rows are each encoded.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import os
import re
import struct
import tempfile
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditrank.llm.frames import rows, tidy

#: Words compiled into the lexicon, and their longest length in bytes.
LEXICON_WORDS = 65_536
LEXICON_WORD_BYTES = 64
#: Distinct words a counting task holds before it hands them on and starts anew.
MEMO_WORDS = 300_000
#: Distinct words a worker's memo holds before it starts anew.  The words of a few tasks
#: fit, so rare ones are not merged again for each.
KEPT_MEMO_WORDS = 600_000
#: The same for a memo that ends with its task, in a run that goes on to other work.
TASK_MEMO_WORDS = 100_000

#: White space separates words, so turning runs of it into one blank first would
#: change nothing.  The second pattern is the first one for characters below
#: U+0250 in lower case, in a quicker engine.
# Letters and numbers that are symbols to the tokenizer library's splitter,
# whose Unicode tables are older than those of the ``regex`` module.
_LETTERS_AS_SYMBOLS = (
    "\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d"
    "\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb"
    "\U00011df1\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff3\U000187f8-\U000187ff\U00018cd6-\U00018cda"
    "\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168"
    "\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de"
    "\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff"
    "\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
_NUMBERS_AS_SYMBOLS = "\U00011de0-\U00011de9\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ff4-\U00016ff6"
# Capitals that the library lower-cases and this Python may not know.
_NEW_CAPITALS = str.maketrans(
    {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
    | {c: c + 0x20 for c in range(0x10D50, 0x10D66)}
    | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
)
_HAS_NEW_CAPITAL = re.compile(f"[{''.join(map(chr, _NEW_CAPITALS))}]")
_WORDS = regex.compile(
    rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}--[{_LETTERS_AS_SYMBOLS}]]+|[\p{{N}}--[{_NUMBERS_AS_SYMBOLS}]]"
    rf"|[[^\s\p{{L}}\p{{N}}]||[{_LETTERS_AS_SYMBOLS}{_NUMBERS_AS_SYMBOLS}]]+"
)
_LATIN_WORDS = re.compile(
    "'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u024f]+|[0-9\xb2\xb3\xb9\xbc-\xbe]"
    "|[^\t-\r \x85\xa0a-z0-9\xaa\xb2\xb3\xb5\xb9\xba\xbc-\xbe\xdf-\xf6\xf8-\u024f]+"
)
_BEYOND_LATIN = re.compile("[^\x00-\u024f]")


def _byte_symbols() -> list[str]:
    """Printable stand-ins for the 256 bytes: Latin-1's visible ones stay."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(seen) else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """Merges and ids of a tokenizer file, with words split as it wants them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            plan = json.load(file)
        model = plan["model"]
        self.end = model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {pair: i for i, pair in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in plan["added_tokens"]}
        self.plain_letters = not any(s.isalpha() for s in self.special)
        self.tokens = [""] * (1 + max([*self.ids.values(), *self.special.values()]))
        for token, i in [*self.ids.items(), *self.special.items()]:
            self.tokens[i] = token
        self.byte = _byte_symbols()
        self.control = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None

    def chunks(self, text: str) -> list[str]:
        """Parts of a text whose words can be found one part at a time.

        No word crosses white space.  ``str.split`` takes four separators for
        white space that count as symbols here; a text with one stays whole.
        """
        return [text] if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()

    def pieces(self, text: str) -> list[str]:
        """Words of a text; control strings stand as they are."""
        if self.plain_letters and text.isascii() and text.isalpha():
            return [text.lower()]  # one word by either pattern
        if self.control is None or not any(s in text for s in self.special):
            return self._split(text)
        out, at = [], 0
        for hit in self.control.finditer(text):
            out += self._split(text[at : hit.start()])
            out.append(hit.group())
            at = hit.end()
        return out + self._split(text[at:])

    def _split(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
            if _HAS_NEW_CAPITAL.search(text):
                text = text.translate(_NEW_CAPITALS)
        text = text.lower()
        return (_WORDS if _BEYOND_LATIN.search(text) else _LATIN_WORDS).findall(text)

    def merge(self, word: str) -> list[int]:
        """Ids of one word by exact merges: lowest rank first, then leftmost."""
        if word in self.special:
            return [self.special[word]]
        part = [self.byte[b] for b in word.encode("utf-8", "surrogatepass")]
        part[-1] += self.end
        if len(part) <= 24:
            self._merge_short(part)
            return [self.ids[p] for p in part]
        n, rank = len(part), self.rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, part[i], part[i + 1]) for i in range(n - 1) if (r := rank.get((part[i], part[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if part[i] != left or j >= n or part[j] != right:
                continue
            part[i], part[j] = left + right, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get((part[i], part[k]))) is not None:
                    heapq.heappush(heap, (r, i, part[i], part[k]))
            if (k := before[i]) >= 0 and (r := rank.get((part[k], part[i]))) is not None:
                heapq.heappush(heap, (r, k, part[k], part[i]))
        return [self.ids[p] for p in part if p is not None]

    def _merge_short(self, part: list[str]) -> None:
        """The same merges in place, without a heap."""
        rank, none = self.rank.get, len(self.rank)
        ranks = [rank(pair, none) for pair in zip(part, part[1:])]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            part[i : i + 2] = [part[i] + part[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((part[i - 1], part[i]), none)
            if i < len(ranks):
                ranks[i] = rank((part[i], part[i + 1]), none)


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def compile_lexicon(words: list[tuple[bytes, list[int]]]) -> bytes:
    """Words with ids as a minimal acyclic automaton in one block of bytes.

    States are made from the sorted words by merging each finished branch with
    an equal one, so suffixes are shared as prefixes are.
    """
    words = sorted(dict(words).items())
    register: dict[tuple, int] = {}
    states: list[tuple] = []  # (final, ((label, target), ...)), leaves first

    def finish(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(states)
            states.append(key)
        return register[key]

    path, last = [[False, []]], b""  # open nodes along the last word
    def close(depth: int) -> None:
        while len(path) - 1 > depth:
            node = path.pop()
            path[-1][1].append((last[len(path) - 1], finish(node)))

    for word, _ in words:
        same = len(os.path.commonprefix([word, last]))
        close(same)
        path += [[False, []] for _ in word[same:]]
        path[-1][0] = True
        last = word
    close(0)
    root = finish(path[0])

    counts = [0] * len(states)
    first, labels, targets, skips = [0], bytearray(), [], []
    for i, (final, edges) in enumerate(states):
        passed = int(final)
        for label, target in edges:
            labels.append(label)
            targets.append(target)
            skips.append(passed)
            passed += counts[target]
        counts[i] = passed
        first.append(len(labels))
    ids = [np.asarray(found, "<u4").tobytes() for _, found in words]
    offsets = np.cumsum([0, *map(len, ids)])
    parts = [
        np.asarray(first, "<u4").tobytes(),
        bytes(labels) + bytes(-len(labels) % 4),
        np.asarray(targets, "<u4").tobytes(),
        np.asarray(skips, "<u4").tobytes(),
        bytes(int(final) for final, _ in states) + bytes(-len(states) % 4),
        np.asarray(offsets, "<u4").tobytes(),
        b"".join(ids),
    ]
    return struct.pack("<8Q", root, *map(len, parts)) + b"".join(parts)


_ONE = [bytes([b]) for b in range(256)]


class Lexicon:
    """A compiled lexicon, read in place from a memory-mapped file."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            self.map = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        self.root, *sizes = struct.unpack_from("<8Q", self.map)
        at = [64]
        for size in sizes:
            at.append(at[-1] + size)
        first, labels, targets, skips, final, offsets, ids = zip(at, sizes)
        whole = memoryview(self.map)

        def numbers(place: tuple[int, int]) -> memoryview:
            return whole[place[0] : sum(place)].cast("I")

        # Parts of the file as arrays, without a copy.  "I" is the machine's own
        # order, which is little-endian on every platform Spark supports here.
        self.first, self.targets, self.skips, self.offsets = map(numbers, (first, targets, skips, offsets))
        self.labels, self.final, self.ids = labels[0], final[0], ids[0]

    def find(self, word: bytes) -> bytes | None:
        """Ids of ``word`` as little-endian unsigned 32-bit integers."""
        node, number, first, base, find = self.root, 0, self.first, self.labels, self.map.find
        for label in word:
            edge = find(_ONE[label], base + first[node], base + first[node + 1]) - base
            if edge < 0:
                return None
            number += self.skips[edge]
            node = self.targets[edge]
        if not self.map[self.final + node]:
            return None
        return self.map[self.ids + self.offsets[number] : self.ids + self.offsets[number + 1]]


@cache
def _mapped(digest: str) -> Lexicon:
    return Lexicon(_place(digest))


def _place(digest: str) -> str:
    return os.path.join(tempfile.gettempdir(), f"lexicon-{digest}")


def opened(digest: str, data) -> Lexicon:
    """The executor's own copy of a lexicon, written by its first worker."""
    path = _place(digest)
    if not os.path.exists(path):
        with tempfile.NamedTemporaryFile(dir=tempfile.gettempdir(), delete=False) as file:
            file.write(data())
        os.replace(file.name, path)
    return _mapped(digest)


def count_words(docs: DataFrame, path: str) -> DataFrame:
    """Every distinct word of all texts with its count: (word, n)."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, counts = vocabulary(path), Counter()

        def out() -> pa.RecordBatch:
            words: dict[str, int] = defaultdict(int)
            for chunk, n in counts.items():
                for word in split.pieces(chunk):
                    words[word] += n
            return pa.record_batch(
                [pa.array(words.keys(), pa.string()), pa.array(words.values(), pa.int64())], names=["word", "n"]
            )

        for batch in rows(batches):
            for text in batch.column(0):
                counts.update(split.chunks(text.as_py() or ""))
                if len(counts) > MEMO_WORDS:
                    yield out()
                    counts = Counter()
        if counts:
            yield out()

    return docs.select("text").mapInArrow(tidy(count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def lexicon(docs: DataFrame, path: str, size: int = LEXICON_WORDS) -> bytes:
    """The compiled lexicon of the ``size`` most frequent words."""

    def merged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merge = vocabulary(path).merge
        for batch in rows(batches):
            ids = [merge(word) for word in batch.column(0).to_pylist()]
            yield pa.record_batch(
                [batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["word", "ids"]
            )

    frequent = (
        count_words(docs, path)
        .where((F.octet_length("word") <= LEXICON_WORD_BYTES) & (F.col("n") > 1))
        .orderBy(F.desc("n"), "word")
        .limit(size)
        .select("word")
    )
    found = frequent.mapInArrow(tidy(merged), "word string, ids array<int>").collect()
    return compile_lexicon([(r["word"].encode(), r["ids"]) for r in found])


class _Memo(dict):
    """Answers of a function for short texts; emptied when it is full."""

    def __init__(self, answer, size: int):
        self.answer, self.size = answer, size

    def __missing__(self, text: str) -> bytes:
        found = self.answer(text)
        if len(text) <= LEXICON_WORD_BYTES:
            if len(self) >= self.size:
                self.clear()
            self[text] = found
        return found


class Encoder:
    """Whole texts to ids; chunks met before are answered from a bounded memo."""

    def __init__(self, path: str, words: Lexicon, memo_words: int = KEPT_MEMO_WORDS):
        self.vocabulary, self.words = vocabulary(path), words
        self.words_memo = words_memo = _Memo(self._word, memo_words)
        self.memo = _Memo(lambda chunk: b"".join(map(words_memo.__getitem__, self.vocabulary.pieces(chunk))), memo_words)

    def forget(self) -> None:
        self.memo.clear()
        self.words_memo.clear()

    def _word(self, word: str) -> bytes:
        raw = word.encode("utf-8", "surrogatepass")
        ids = self.words.find(raw) if len(raw) <= LEXICON_WORD_BYTES else None
        return ids if ids is not None else np.asarray(self.vocabulary.merge(word), "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        return b"".join(map(self.memo.__getitem__, self.vocabulary.chunks(text))) if text else b""


def decoded(tokens: pa.Array, ids: pa.ListArray) -> pa.Array:
    """The tokens of each list joined by a blank, as a tokenizer file without decoder has it."""
    values = pc.take(tokens, ids.flatten())
    offsets = pc.subtract(ids.offsets, ids.offsets[0])
    lists = pa.LargeListArray.from_arrays(offsets.cast(pa.int64()), values)
    return pc.if_else(ids.is_valid(), pc.binary_join(lists, pa.scalar(" ", pa.large_string())), None)


def _encoders(docs: DataFrame, path: str, kept: bool):
    """A function that gives a task its encoder; one that is not ``kept`` has smaller
    memos, which leave the worker with the task."""
    built = lexicon(docs, path)
    digest = hashlib.sha256(built).hexdigest()[:24]
    sent = docs.sparkSession.sparkContext.broadcast(built)
    if kept:
        return lambda: _encoder(path, digest, lambda: sent.value)
    return lambda: Encoder(path, opened(digest, lambda: sent.value), TASK_MEMO_WORDS)


#: The worker's encoder; with it the memos outlive a task.
_ENCODERS: dict[tuple[str, str], Encoder] = {}


def _encoder(path: str, digest: str, data) -> Encoder:
    if (path, digest) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path, digest] = Encoder(path, opened(digest, data))
    return _ENCODERS[path, digest]


def encode(docs: DataFrame, path: str, ids: str = "token_ids") -> DataFrame:
    """``docs`` plus ``ids`` array<int>, the tokens of the whole text.

    A column of that name is replaced.
    """
    docs = docs.drop(ids)
    encoder, text_at = _encoders(docs, path, kept=False), docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = encoder()
        for batch in rows(batches):
            for part in _slices(batch, text_at):
                found = [work.encode(t.as_py()) for t in part.column(text_at)]
                flat = pa.array(np.frombuffer(b"".join(found), "<i4"))
                starts = pa.array(np.cumsum([0, *(len(x) // 4 for x in found)]), pa.int32())
                arrays = [*part.columns, pa.ListArray.from_arrays(starts, flat)]
                yield pa.RecordBatch.from_arrays(arrays, names=[f"c{k}" for k in range(len(arrays))])
        work.forget()

    return docs.mapInArrow(tidy(run), T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))]))


def _slices(batch: pa.RecordBatch, text_at: int, rows_each: int = 500) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, rows_each):
        yield batch.slice(i, rows_each)


def decode(encoded: DataFrame, path: str, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """``encoded`` plus ``text`` string, what its ids stand for; NULL ids give NULL."""
    encoded = encoded.drop(text)
    at = encoded.columns.index(ids)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = pa.array(vocabulary(path).tokens, pa.large_string())
        for batch in rows(batches):
            for part in _slices(batch, at):
                arrays = [*part.columns, decoded(tokens, part.column(at)).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=[f"c{k}" for k in range(len(arrays))])

    return encoded.mapInArrow(tidy(run), T.StructType([*encoded.schema.fields, T.StructField(text, T.StringType())]))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Digests of the ids and of the text decoded from them, for each document.

    Encoding and decoding run in the same pass, so ids do not leave the worker.
    """
    encoder = _encoders(docs, path, kept=True)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, sha = encoder(), hashlib.sha256
        tokens = pa.array(work.vocabulary.tokens, pa.large_string())
        for batch in rows(batches):
            for part in _slices(batch, 1):
                found = [work.encode(text.as_py()) for text in part.column(1)]
                count = np.array([len(x) // 4 for x in found], np.int64)
                starts = pa.array(np.append(0, np.cumsum(count)), pa.int32())
                lists = pa.ListArray.from_arrays(starts, pa.array(np.frombuffer(b"".join(found), "<i4")))
                again = decoded(tokens, lists).cast(pa.large_binary()).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(count),
                        pa.array([sha(x).hexdigest() for x in found], pa.string()),
                        pa.array([sha(x).hexdigest() for x in again], pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    docs = docs.select(F.col("doc_id").cast("long"), "text")
    return docs.mapInArrow(tidy(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
