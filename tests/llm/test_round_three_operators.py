"""Token alignment, exact dedup and conversation repair against brute force."""

import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from auditrank.llm import alignment, conversation_repair, exact_dedup

BYTE_LEVEL = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
EMPTY = hashlib.sha256().hexdigest()


# --- token alignment ------------------------------------------------------


@pytest.fixture(scope="module")
def pair():
    with open(BYTE_LEVEL, encoding="utf-8") as a, open(PIECES, "rb") as b:
        return alignment.Pair(a.read(), b.read())


def _by_bytes(pair, text):
    """Tokens of a whole text with ends counted from bytes alone."""
    if not text:
        return None
    raw = f" {text}".encode()
    found = []
    for ids, parts in (
        (pair.a.encode(f" {text}", add_special_tokens=False).ids, pair.a_bytes),
        (pair.b.encode(text), pair.b_bytes),
    ):
        if b"".join(parts[i] for i in ids) != raw:
            return None
        found.append((ids, list(itertools.accumulate(len(parts[i]) for i in ids))))
    return found


def _groups(a, b):
    out, i, j = [], 0, 0
    for end in sorted({*a[1]} & {*b[1]}):
        p, q = a[1].index(end, i) + 1, b[1].index(end, j) + 1
        out.append((a[0][i:p], b[0][j:q]))
        i, j = p, q
    return out


def _text(groups):
    return ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)


def _expected_alignment(pair, docs):
    found = {k: _by_bytes(pair, t) for k, (_, t) in enumerate(docs)}
    groups = {k: _groups(*f) for k, f in found.items() if f}
    count = Counter((a[-1], b[-1]) for g in groups.values() for a, b in g)
    most = defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    out = []
    for k, (i, _) in enumerate(docs):
        if not found[k]:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(a[-1], b[-1]) for a, b in groups[k]]
        best = sum(count[x] == most[x[1]] for x in links)
        sha = hashlib.sha256(_text(groups[k]).encode()).hexdigest()
        a, b = found[k]
        out.append((i, len(a[0]), len(b[0]), len(links), len(links), best, sum(count[x] for x in links), sha))
    return sorted(out, key=str)


ODD_TEXTS = [
    None, "", " ", "   ", "\n\n a", " lead", "trail  ", "x\x00y", "中文龘字 ẃ\U0001f9ff🧿 é", "é ﬁ ①   　z",
    "<|endoftext|> <s> hi</s> <unk> <0x41>", "a▁b", "▁", "word ▁ word", "tab\t x \x1c y\x85 z  q",
    "ab" * 40_000, "中" * 9_000, "long words " * 9_000, "Ā Ġ Ċ",
]


def test_alignment_of_given_and_odd_texts(spark, sf, pair, monkeypatch):
    docs = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()]
    docs += [(900_000 + k, t) for k, t in enumerate(ODD_TEXTS)] + [(7, "twice the same id"), (None, "no id")] * 2
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in docs], "doc_id long, text string, n_a int, pairs string")
    expected = _expected_alignment(pair, docs)
    assert pair.by_word
    for common in (alignment.COMMON, 40):  # most counts sent to all tasks, and most joined
        monkeypatch.setattr(alignment, "COMMON", common)
        monkeypatch.setattr(alignment, "MEMO_CHARS", alignment.MEMO_CHARS if common > 40 else 1_000)
        assert sorted(map(tuple, alignment.report(df, BYTE_LEVEL, PIECES).collect()), key=str) == expected


def test_alignment_by_word_agrees_for_all_kinds_of_characters(pair):
    memo = alignment.Memo(pair)
    spaces = [c for c in range(0x3100) if chr(c).isspace()] + [0x180E, 0x200B, 0x2060, 0xFEFF, 0x1C, 0x1F]
    for code in [*spaces, *range(0x20, 0x1F000, 41)]:
        if 0xD800 <= code < 0xE000:
            continue
        c = chr(code)
        text = f"a{c} b{c}{c}  1{c}"
        whole = _by_bytes(pair, text)
        tokens = pair.tokens(text)
        assert (whole is None) == (tokens is None), hex(code)
        if whole is None:
            continue
        assert [list(map(int, x)) for x in tokens] == [*whole[0], *whole[1]], hex(code)
        cut = alignment.words(text)
        memo.learn([w for w in dict.fromkeys(cut) if w not in memo.known])
        assert ";".join(memo.groups[memo.known[w]] for w in cut) == _text(_groups(*whole)), hex(code)


def test_alignment_of_no_documents(spark):
    assert alignment.report(spark.createDataFrame([], "doc_id long, text string"), BYTE_LEVEL, PIECES).count() == 0
    empty = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert {r.n_links for r in alignment.report(empty, BYTE_LEVEL, PIECES).collect()} == {0}


# --- exact dedup ----------------------------------------------------------


def _fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


DOCS = "doc_id long, text string"


def test_exact_dedup_against_brute_force(spark):
    rng = random.Random(5)
    texts = ["same", "SAME", "Same ", None, "", "É", "é", "K", "k", "K", "x" * 300_000, "X" * 300_000, "a\x00b"]
    docs = [(i, rng.choice(texts)) for i in rng.sample(range(-500, 500), 300)]
    groups = defaultdict(list)
    for i, t in docs:
        groups[_fold(t)].append(i)
    expected = sorted(
        (i, max(g := groups[_fold(t)]), len(g), i == max(g), hashlib.sha256(_fold(t).encode()).hexdigest()) for i, t in docs
    )
    assert sorted(map(tuple, exact_dedup.report(spark.createDataFrame(docs, DOCS)).collect())) == expected


def test_exact_dedup_in_batches(spark):
    index = exact_dedup.new_index(spark)
    first = spark.createDataFrame([(1, "a"), (5, "A"), (2, "b")], DOCS)
    assert sorted(r.doc_id for r in exact_dedup.without_copies(first, index).collect()) == [2, 5]
    # Added again, as after a failure: same result, nothing appended.
    assert sorted(r.doc_id for r in exact_dedup.without_copies(first, index).collect()) == [2, 5]
    assert index.table().count() == 2
    second = spark.createDataFrame([(9, "a"), (3, "c"), (4, "c")], DOCS)
    found = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.annotate(second, index).collect()}
    assert found == {9: (5, 1, False), 3: (4, 2, False), 4: (4, 2, True)}
    # The files are the index: another session finds it by its path.
    again = exact_dedup.DigestIndex(spark, index.path, index.buckets)
    assert sorted(r.keep_id for r in again.table().collect()) == [2, 4, 5]


def test_exact_dedup_of_odd_rows(spark):
    docs = [(1, "a", 7), (1, "a", 7), (None, "b", 8), (None, "b", 9), (None, "a", 1), (3, "", 2), (4, None, 3)]
    df = spark.createDataFrame(docs, "doc_id long, text string, keep_id int")
    marked = exact_dedup.annotate(df, exact_dedup.new_index(spark))
    assert marked.columns == ["text_digest", "doc_id", "text", "keep_id", "_keep_id", "group_size", "kept"]
    assert marked.count() == len(docs)
    kept = exact_dedup.without_copies(df, exact_dedup.new_index(spark))
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text or "") for r in kept.collect()), key=str) == [(1, "a"), (4, ""), (None, "b")]
    none = spark.createDataFrame([], DOCS)
    assert exact_dedup.report(none).count() == 0
    assert exact_dedup.without_copies(none, exact_dedup.new_index(spark)).count() == 0


def test_exact_dedup_joins_by_sorting_and_without_python(spark, sf):
    index = exact_dedup.new_index(spark)
    rows = exact_dedup.annotate(spark.read.parquet(f"{sf}/documents.parquet"), index)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "ExistingRDD", "MapIn"))
    new = rows.select(F.col("text_digest").alias("digest")).distinct()
    anti = new.join(index.table().hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in anti and "LeftAnti" in anti and "Bucketed: true" in anti


# --- conversation repair --------------------------------------------------

KEPT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
GIVEN = {"": "u", "s": "u", "u": "a", "a": "u"}
NAMES = {"u": "user", "a": "assistant"}


def _faults(turns):
    seen, out = set(), []
    for role, text in turns:
        last = text.strip(" \t\n\x0b\x0c\r")[-1:]
        out.append("blank" if not last else "duplicate" if (role, text) in seen else None if last in ".!?" else "truncated")
        seen.add((role, text))
    return out


def _cheapest(turns):
    """(cost, audit, lines) by plain tuples, from the last row to the first."""
    best = {"": (0, "", ()), "a": (0, "", ()), "u": (2, "I", ("assistant:",)), "s": (4, "II", ("user:", "assistant:"))}
    for (role, text), fault in reversed(list(zip(turns, _faults(turns)))):
        used = {}
        for state in best:
            c, a, t = best[state]
            found = [(c + 3, f"D{a}", t)]
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                if (state, role[:1]) in KEPT:
                    c, a, t = best[KEPT[state, role[:1]]]
                    found.append((c + extra, f"K{a}", (f"{role}:{text}", *t)))
                c, a, t = best[GIVEN[state]]
                found.append((c + 2 + extra, f"R{a}", (f"{NAMES[GIVEN[state]]}:{text}", *t)))
            used[state] = min(found)
        best = used
        for _ in range(3):
            more = {s: best[GIVEN[s]] for s in best}
            best = {s: min(used[s], (c + 2, f"I{a}", (f"{NAMES[GIVEN[s]]}:", *t))) for s, (c, a, t) in more.items()}
    return best[""]


def _all_audits(turns):
    """The same by listing every edit sequence, for a few rows."""
    faults = _faults(turns)
    out = []

    def go(k, state, cost, audit, run):
        if k == len(turns) and state in ("", "a"):
            out.append((cost, audit))
        if run < 3:
            go(k, GIVEN[state], cost + 2, audit + "I", run + 1)
        if k == len(turns):
            return
        go(k + 1, state, cost + 3, audit + "D", 0)
        if faults[k] in ("blank", "duplicate"):
            return
        extra = faults[k] == "truncated"
        if (state, turns[k][0][:1]) in KEPT:
            go(k + 1, KEPT[state, turns[k][0][:1]], cost + extra, audit + "K", 0)
        go(k + 1, GIVEN[state], cost + 2 + extra, audit + "R", 0)

    go(0, "", 0, "", 0)
    return min(out)


def _expected_repair(whole, rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        turns[conv].append(((turn is not None, turn or 0), " " if role is None else role, " " if text is None else text))
    out = []
    for conv in {r[0] for r in whole}:
        own = sorted(turns[conv])
        said = [(r, t) for _, r, t in own]
        places = {p for (there, p), _, _ in own if there}
        gaps = max(places) - min(places) + 1 - len(places) if places else 0
        faults = Counter(_faults(said))
        pairs = zip(said, said[1:])
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in pairs)
        cost, audit, lines = _cheapest(said)
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, sha))
    return sorted(out, key=str)


CONVERSATIONS = "conv_id long, turn long, role string, text string"
TEXTS = ["Yes.", "No!", "open", "", " \n", "end. ", "Why?\t", "é", None]
ROLES = ["system", "user", "assistant", "tool", "User", "", None, "s", "ua"]


def _random_rows(rng, conv, n):
    return [(conv, rng.choice([*range(n), None]), rng.choice(ROLES[: rng.randint(2, 9)]), rng.choice(TEXTS)) for _ in range(n)]


def test_block_weights_take_the_cheapest_then_least_audit():
    rng = random.Random(3)
    for _ in range(400):
        turns = [(rng.choice(["system", "user", "assistant", "x"]), rng.choice(["a.", "b", "", f"c{rng.random()}."])) for _ in range(rng.randint(1, 4))]
        symbols = "".join(
            "-" if f in ("blank", "duplicate") else (c.upper() if f else c)
            for (r, _), f in zip(turns, _faults(turns))
            for c in [r[0]]
        )
        found = conversation_repair.block_weights(symbols)
        weights = [(c + close, a + letters) for (c, a), (close, letters) in zip(found[:4], conversation_repair._CLOSING) if c >= 0]
        assert min(weights) == _all_audits(turns) == _cheapest(turns)[:2]


@pytest.mark.parametrize("bits", [8, 1])
def test_repair_against_brute_force(spark, monkeypatch, bits):
    monkeypatch.setattr(conversation_repair, "BLOCK_BITS", bits)  # blocks of two rows: every conversation is a chain
    rng = random.Random(bits)
    rows = [r for conv in range(120) for r in _random_rows(rng, conv, rng.randint(1, 9))]
    rows += _random_rows(rng, None, 6) + _random_rows(rng, 500, 700 if bits == 8 else 60)
    whole = [*rows, (-7, 1, "user", "gone."), (-8, None, None, None)]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], CONVERSATIONS + ", cost string, n int")
    found = conversation_repair.report(df, spark.createDataFrame(whole, CONVERSATIONS))
    assert sorted(map(tuple, found.collect()), key=str) == _expected_repair(whole, rows)


def test_damage_and_repair_of_the_given_table(spark, sf):
    whole = [tuple(r.values()) for r in pq.read_table(f"{sf}/conversations.parquet").to_pylist()]
    whole += [(10**6, None, "user", "Null turn."), (None, 3, "user", "Null id."), (10**6 + 1, 0, None, None)]
    rows = []
    for conv, turn, role, text in whole:
        role, text = (" " if x is None else x for x in (role, text))
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fate == 1 else "".join(c for c in text if c not in ".!?") if fate == 2 else text
        if fate:
            rows += [(conv, turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    df = spark.createDataFrame(whole, CONVERSATIONS)
    found = conversation_repair.report(conversation_repair.damaged(df), df)
    assert sorted(map(tuple, found.collect()), key=str) == _expected_repair(whole, rows)


def test_repaired_conversations_are_legal(spark):
    rng = random.Random(9)
    rows = [r for conv in range(40) for r in _random_rows(rng, conv, rng.randint(1, 12))] + [(77, 0, "user", "x" * 200_000)]
    found = conversation_repair.repaired(conversation_repair.repair(spark.createDataFrame(rows, CONVERSATIONS)))
    turns = defaultdict(list)
    for r in sorted(found.collect(), key=lambda r: (r.conv_id, r.turn)):
        assert r.turn == len(turns[r.conv_id])
        turns[r.conv_id].append(r.role[:1])
    for initials in turns.values():
        said = "".join(initials).removeprefix("s")
        assert said and said == "ua" * (len(said) // 2)
    empty = spark.createDataFrame([], CONVERSATIONS)
    assert conversation_repair.report(empty, empty).count() == 0
    assert conversation_repair.repaired(conversation_repair.repair(empty)).count() == 0
