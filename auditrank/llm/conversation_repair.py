"""Repair the structure of conversations with the cheapest edits.

A repaired conversation is empty or an optional system turn followed by pairs of a
user and an assistant turn.  Each row is kept (K, free), given another role (R, 2) or
deleted (D, 3); empty turns are inserted anywhere (I, 2); a truncated row that stays
costs 1.  Blank rows and rows whose role and text came earlier must be deleted.  Of
the cheapest edits the one whose letters in order are least in ASCII is taken.

Weights are single integers.  The high digits are the cost; the low digits, of a width
fixed for all paths of a block of rows, are the audit letters from left to right, with
zeros behind the last one.  The letters' digits follow ASCII order, so a plain integer
minimum settles cost and ties at once (:func:`block_weights`).

A row enters that search as one symbol.  Rows are laid out in ranges and numbered, so
no task sorts a whole conversation; blocks of :data:`BLOCK` rows are searched apart, for
each state before and after.  A block's audits end with the letter of its last row and
two of them are never one the beginning of the other, so the cheapest chain of blocks,
ties by the audit's rank within its block, is the cheapest conversation.  What a
task holds of a conversation is a few numbers per block, less than the audit that ends
up in one cell; texts are streamed through a running digest.

Rows are ordered by turn (nulls first), role and text.  Null roles and texts are one
space; a null conv_id is a conversation of its own.  Equal rows are duplicates of the
first of them.  Very long texts only pass through SQL expressions.  An empty table gives
an empty result.  Other columns are left out, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditrank.llm.frames import rows
from auditrank.operators.ordering import numbered
from auditrank.session import stage

BLOCK_BITS = 8
BLOCK = 1 << BLOCK_BITS

#: What the turns so far end with; the first state is "no turn".
STATES = ("", "s", "u", "a")
#: The state that a kept row leads to, by the state before and its role's initial.
_KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: The state that an inserted row, or one with a new role, leads to.
_GIVEN = (2, 2, 3, 2)
#: Digits of the audit letters, in ASCII order; 0 is the padding.
_DIGIT = {"D": 1, "I": 2, "K": 3, "R": 4}
_LETTER = {d: x for x, d in _DIGIT.items()}
_DIGIT_BITS = 3
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Two inserted turns lead from any state to any other that inserting can reach.
_INSERTS = 2
#: Edits behind the last row, by state: cost and letters; what is not here is no end.
_CLOSING = ((0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, ""))

_BLANKS = "\\x20\\x09-\\x0D"


@lru_cache(maxsize=100_000)
def block_weights(symbols: str) -> tuple[tuple[int, str], ...]:
    """(cost, audit) of the best edits of a block for each state before and, within
    it, each state after; cost -1 if there are none.

    A symbol is the initial s, u or a of a row's role, or x; in upper case if the row is
    truncated; ``-`` if it must go.  Turns are inserted before rows only.
    """
    letters = len(symbols) * (_INSERTS + 1)
    bits = letters * _DIGIT_BITS
    low = (1 << bits) - 1
    top = bits - _DIGIT_BITS

    def put(letter: str, cost: int, rest: int | None) -> int | None:
        """The weight of an edit and the edits behind it; the rest's digits move one place
        to the right, over padding, as the width holds the longest path."""
        if rest is None:
            return None
        return ((rest >> bits) + cost << bits) | _DIGIT[letter] << top | (rest & low) >> _DIGIT_BITS

    def least(weights: Iterable[int | None]) -> int | None:
        return min((w for w in weights if w is not None), default=None)

    table: list[list[int | None]] = []
    for after in range(len(STATES)):
        best: list[int | None] = [0 if s == after else None for s in range(len(STATES))]
        for symbol in reversed(symbols):
            truncated = TRUNCATED * symbol.isupper()
            used = []
            for state in range(len(STATES)):
                found = [put("D", DELETE, best[state])]
                if symbol != "-":
                    kept = _KEPT.get((state, symbol.lower()))
                    found.append(None if kept is None else put("K", KEEP + truncated, best[kept]))
                    found.append(put("R", REROLE + truncated, best[_GIVEN[state]]))
                used.append(least(found))
            best = used
            for _ in range(_INSERTS):
                best = [least((used[s], put("I", INSERT, best[_GIVEN[s]]))) for s in range(len(STATES))]
        table.append(best)

    def read(weight: int | None) -> tuple[int, str]:
        if weight is None:
            return -1, ""
        digits = (weight >> top - _DIGIT_BITS * k & 7 for k in range(letters))
        return weight >> bits, "".join(_LETTER[d] for d in digits if d)

    return tuple(read(table[after][before]) for before in range(len(STATES)) for after in range(len(STATES)))


def chain(blocks: list[tuple[list[int], list[int]]]) -> tuple[int, list[int], str]:
    """Cost, the states between the blocks and the closing letters of a conversation,
    from each block's costs and ranks by state before and after."""
    n = len(STATES)
    rest: list[int | None] = [cost for cost, _ in _CLOSING]
    picks = []
    for costs, ranks in reversed(blocks):
        weights = [
            [
                None if rest[a] is None or costs[b * n + a] < 0 else ((costs[b * n + a] + rest[a]) * n + ranks[b * n + a]) * n + a
                for a in range(n)
            ]
            for b in range(n)
        ]
        best = [min((w for w in row if w is not None), default=None) for row in weights]
        picks.append([None if w is None else w % n for w in best])
        rest = [None if w is None else w // (n * n) for w in best]
    states = [0]
    for pick in reversed(picks):
        states.append(pick[states[-1]])
    return rest[0], states, _CLOSING[states[-1]][1]


def _names(state: int, letters: str) -> Iterator[tuple[str, int, str]]:
    """Letter, state after it and the role it gives, for letters I and R."""
    for letter in letters:
        state = _GIVEN[state]
        yield letter, state, "user" if STATES[state] == "u" else "assistant"


def row_edits(symbols: str, state: int, audit: str, closing: str) -> list[dict]:
    """For each row: the roles of the turns inserted before it, its letter, its new role
    or None, and the roles of turns behind it (the last row only)."""
    out, before = [], []
    edits = iter(audit)
    for symbol in symbols:
        before = []
        for letter in edits:
            if letter == "I":
                ((_, state, role),) = _names(state, letter)
                before.append(role)
                continue
            role = None
            if letter == "R":
                ((_, state, role),) = _names(state, letter)
            elif letter == "K":
                state = _KEPT[state, symbol.lower()]
            out.append({"before": before, "letter": letter, "role": role, "behind": []})
            break
    out[-1]["behind"] = [role for _, _, role in _names(state, closing)]
    return out


def prepared(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) without nulls in role and text."""
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """``prepared`` rows with faults put in by a hash of conversation and turn: dropped,
    emptied, without its ends of sentences, repeated, or said by the user."""
    named = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    return (
        prepared(conversations)
        .withColumn("fate", F.crc32(named.cast("binary")) % 20)
        .where("fate <> 0")
        .withColumn(
            "text",
            F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")),
        )
        .withColumn("role", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")))
        .withColumn("copy", F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
        .select("conv_id", "turn", "role", "text")
    )


def faults(conversations: DataFrame) -> DataFrame:
    """``prepared`` rows with n (their number in corpus order), block, initial and the
    first fault that counts: blank, duplicate, truncated or null."""
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    placed = numbered(prepared(conversations), order, "n")
    marked = placed.withColumn("said", F.unhex(F.sha2(F.col("text").cast("binary"), 256))).select(
        "conv_id",
        "n",
        F.shiftright("n", BLOCK_BITS).alias("block"),
        "turn",
        "role",
        "text",
        "said",
        F.substring("role", 1, 1).alias("initial"),
        (~F.col("text").rlike(f"[^{_BLANKS}]")).alias("blank"),
        (~F.col("text").rlike(f"[.!?][{_BLANKS}]*\\z")).alias("cut_off"),
    )
    # Rows meet their first occurrence as keys and numbers; only those that come later
    # are handed on, and join the rows by their number.
    key = ("conv_id", "role", "said")
    firsts = marked.groupBy(*key).agg(F.min("n").alias("first_n"), F.count("*").alias("times")).where("times > 1")
    firsts = firsts.withColumnsRenamed({c: f"first_{c}" for c in key})
    same = [F.col(c).eqNullSafe(F.col(f"first_{c}")) for c in key]
    later = marked.select(*key, "n").join(firsts, same).where("n > first_n").select(F.col("n").alias("later_n"))
    return (
        marked.join(later, F.col("n") == F.col("later_n"), "left")
        .withColumn(
            "fault",
            F.when(F.col("blank"), "blank").when(F.col("later_n").isNotNull(), "duplicate").when(F.col("cut_off"), "truncated"),
        )
        .select("conv_id", "n", "block", "turn", "role", "text", "initial", "fault")
    )


def _search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows(batches):
        costs, ranks, audits = [], [], []
        for symbols in batch.column(3).to_pylist():
            found = block_weights(symbols)
            costs.append([c for c, _ in found])
            audits.append([a for _, a in found])
            place: list[int] = []
            for b in range(0, len(found), len(STATES)):
                texts = [a for _, a in found[b : b + len(STATES)]]
                place += [sorted(texts).index(a) for a in texts]
            ranks.append(place)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(costs, pa.list_(pa.int64())), pa.array(ranks, pa.list_(pa.int64())), pa.array(audits, pa.list_(pa.string()))],
            names=["conv_id", "block", "first_n", "symbols", "costs", "ranks", "audits"],
        )


def _chained(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows(batches):
        for conv, blocks in zip(batch.column(0).to_pylist(), batch.column(1)):
            blocks = blocks.as_py()
            cost, states, closing = chain([(b["costs"], b["ranks"]) for b in blocks])
            last = len(blocks) - 1
            columns = [
                pa.array([conv] * len(blocks), pa.int64()),
                pa.array([b["block"] for b in blocks], pa.int64()),
                pa.array([cost] * len(blocks), pa.int64()),
                pa.array(states[:-1], pa.int64()),
                pa.array(states[1:], pa.int64()),
                pa.array([closing if k == last else "" for k in range(len(blocks))], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["chain_id", "chain_block", "cost", "state", "next", "closing"])


_EDIT = pa.struct([("before", pa.list_(pa.string())), ("letter", pa.string()), ("role", pa.string()), ("behind", pa.list_(pa.string()))])


def _edited(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows(batches):
        cells = zip(*(batch.column(k).to_pylist() for k in range(4, 8)))
        edits = [row_edits(symbols, state, audit, closing) for symbols, state, audit, closing in cells]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:4], pa.array(edits, pa.list_(_EDIT))], names=["edit_id", "edit_block", "first_n", "cost", "edits"]
        )


def repair(conversations: DataFrame) -> DataFrame:
    """One row per row of ``conversations``: conv_id, n, turn, role, text, initial, fault,
    the conversation's cost, and edit: before (roles of empty turns inserted before the row),
    letter, role (the new one, or null) and behind (roles of empty turns after the last row)."""
    found = stage(faults(conversations), "faults")
    initial = F.when(F.col("initial").isin(*STATES[1:]), F.col("initial")).otherwise("x")
    symbol = (
        F.when(F.col("fault").isin("blank", "duplicate"), "-")
        .when(F.col("fault") == "truncated", F.upper(initial))
        .otherwise(initial)
    )
    blocks = (
        found.select("conv_id", "block", F.struct("n", symbol.alias("symbol")).alias("row"))
        .groupBy("conv_id", "block")
        .agg(F.array_sort(F.collect_list("row")).alias("rows"))
        .select("conv_id", "block", F.col("rows")[0]["n"].alias("first_n"), F.array_join("rows.symbol", "").alias("symbols"))
    )
    searched = stage(
        blocks.mapInArrow(
            _search,
            "conv_id long, block long, first_n long, symbols string, costs array<long>, ranks array<long>, audits array<string>",
        ),
        "blocks",
    )
    chains = (
        searched.groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(F.struct("block", "costs", "ranks"))).alias("blocks"))
        .mapInArrow(_chained, "chain_id long, chain_block long, cost long, state long, next long, closing string")
    )
    chosen = searched.join(
        chains, F.col("conv_id").eqNullSafe(F.col("chain_id")) & (F.col("block") == F.col("chain_block"))
    ).select(
        "conv_id", "block", "first_n", "cost", "symbols", "state",
        F.element_at("audits", (F.col("state") * len(STATES) + F.col("next") + 1).cast("int")).alias("audit"),
        "closing",
    )
    edits = chosen.mapInArrow(
        _edited,
        "edit_id long, edit_block long, first_n long, cost long, "
        "edits array<struct<before: array<string>, letter: string, role: string, behind: array<string>>>",
    )
    return found.join(
        edits, F.col("conv_id").eqNullSafe(F.col("edit_id")) & (F.col("block") == F.col("edit_block"))
    ).select(
        "conv_id", "n", "turn", "role", "text", "initial", "fault", "cost",
        F.element_at("edits", (F.col("n") - F.col("first_n") + 1).cast("int")).alias("edit"),
    )


def repaired(edited: DataFrame) -> DataFrame:
    """The conversations that :func:`repair` makes: conv_id, turn (from 0), role, text."""
    empty = lambda roles: F.transform(roles, lambda role: F.struct(role.alias("role"), F.lit("").alias("text")))
    own = F.struct(F.coalesce("edit.role", "role").alias("role"), F.col("text").alias("text"))
    turns = F.concat(
        empty(F.col("edit.before")),
        F.when(F.col("edit.letter") != "D", F.array(own)).otherwise(F.array().cast("array<struct<role: string, text: string>>")),
        empty(F.col("edit.behind")),
    )
    placed = edited.select("conv_id", "n", F.posexplode(turns).alias("k", "said"))
    # Numbers grow with the rows, so the place within the conversation is a difference.
    order = [F.col("conv_id").asc_nulls_first(), F.col("n"), F.col("k")]
    counted = numbered(placed, order, "place")
    starts = counted.groupBy(F.col("conv_id").alias("start_id")).agg(F.min("place").alias("start"))
    return counted.join(starts, F.col("conv_id").eqNullSafe(F.col("start_id"))).select(
        "conv_id", (F.col("place") - F.col("start")).alias("turn"), "said.role", "said.text"
    )


_REPORT = {
    "conv_id": pa.int64(),
    "gaps": pa.int64(),
    "blank": pa.int64(),
    "duplicate": pa.int64(),
    "truncated": pa.int64(),
    "illegal": pa.int64(),
    "cost": pa.int64(),
    "audit": pa.string(),
    "repaired_sha256": pa.string(),
}
_LEGAL = {"su", "ua", "au"}
_EMPTY_SHA = hashlib.sha256().hexdigest()


class _Summary:
    """What is kept of a conversation while its rows pass by in order."""

    def __init__(self, conv: int | None):
        self.conv, self.initial, self.lines, self.sha = conv, None, 0, hashlib.sha256()
        self.turn = self.first = None
        self.turns = self.illegal = self.cost = 0
        self.audit: list[str] = []
        self.faults = dict.fromkeys(("blank", "duplicate", "truncated"), 0)

    def add(self, turn, initial, fault, cost, audit, lines) -> None:
        if turn is not None and turn != self.turn:
            self.first = turn if self.first is None else self.first
            self.turn, self.turns = turn, self.turns + 1
        if self.initial is not None and self.initial + initial not in _LEGAL:
            self.illegal += 1
        self.initial = initial
        if fault:
            self.faults[fault] += 1
        self.cost = cost
        self.audit.append(audit)
        for line in lines:
            self.sha.update(b"\n" * (self.lines > 0) + line.encode("utf-8", "surrogatepass"))
            self.lines += 1

    def row(self) -> tuple:
        gaps = 0 if self.first is None else self.turn - self.first + 1 - self.turns
        return (self.conv, gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest())


def _summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: _Summary | None = None

    def out(done: list[_Summary]) -> pa.RecordBatch:
        columns = zip(*(s.row() for s in done))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _REPORT.values())], names=list(_REPORT))

    for batch in rows(batches):
        done = []
        for conv, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if held is None or held.conv != conv:
                if held is not None:
                    done.append(held)
                held = _Summary(conv)
            held.add(*row)
        if done:
            yield out(done)
    if held is not None:
        yield out([held])


def report(conversations: DataFrame, whole: DataFrame) -> DataFrame:
    """One row for each conv_id of ``whole``, by the repair of ``conversations``."""
    edited = repair(conversations)
    empty = lambda roles: F.transform(roles, lambda role: F.concat(role, F.lit(":")))
    own = F.concat(F.coalesce("edit.role", "role"), F.lit(":"), "text")
    lines = F.concat(
        empty(F.col("edit.before")),
        F.when(F.col("edit.letter") != "D", F.array(own)).otherwise(F.array().cast("array<string>")),
        empty(F.col("edit.behind")),
    )
    audit = F.concat(
        F.repeat(F.lit("I"), F.size("edit.before")), F.col("edit.letter"), F.repeat(F.lit("I"), F.size("edit.behind"))
    )
    summed = (
        edited.select("conv_id", "n", "turn", "initial", "fault", "cost", audit.alias("audit"), lines.alias("lines"))
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "n")
        .drop("n")
        .mapInArrow(_summed, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
        .withColumnRenamed("conv_id", "found_id")
    )
    ids = whole.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    joined = ids.join(summed, F.col("conv_id").eqNullSafe(F.col("found_id")), "left")
    blanks = {"audit": F.lit(""), "repaired_sha256": F.lit(_EMPTY_SHA)}
    return joined.select(
        "conv_id", *(F.coalesce(F.col(c), blanks.get(c, F.lit(0).cast("long"))).alias(c) for c in list(_REPORT)[1:])
    )
