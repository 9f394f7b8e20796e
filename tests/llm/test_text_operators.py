"""Operators on texts against brute force, and on odd tables."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import zstandard
from pyspark.sql import functions as F

from auditrank.llm import bpe, decontaminate, line_dedup, near_dedup, words
from auditrank.llm.queries import vocabulary_path

DOC = "doc_id long, text string"
#: Columns named as the operators' own, a text column last.
CLASH = "doc_id long, n_words string, spans string, item_ids long, keep string, _keep int, node int, component string, removed_lines int, token_ids string, text string"


def _given(sf, table="documents"):
    return [(r[f"{'item' if table == 'benchmark' else 'doc'}_id"], r["text"]) for r in pq.read_table(f"{sf}/{table}.parquet").to_pylist()]


def _clashing(spark, texts):
    return spark.createDataFrame([(i, "a", "b", 1, "c", 2, 3, "d", 4, "e", t) for i, t in texts], CLASH)


def test_hashes_tell_words_apart():
    texts = [b"The the THE", b"", b"a\tb\x0bA", "é É".encode(), b"word"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    cuts = np.cumsum([0, *map(len, texts)])
    at, found = words.hash_words(data, cuts, words.NOT_SPACE)
    bounds = words.per_row(at, cuts)
    rows = [found[a:b].tolist() for a, b in zip(bounds, bounds[1:])]
    assert [len(r) for r in rows] == [3, 0, 3, 2, 1]
    assert len(set(rows[0])) == 1 and rows[2][0] == rows[2][2] and rows[3][0] != rows[3][1]


# --- line dedup -----------------------------------------------------------


def _lines(df):
    return {r.doc_id: list(r.removed_lines) for r in line_dedup.report(df).collect()}


def test_line_dedup_equals_brute_force(spark, sf):
    assert _lines(spark.read.parquet(f"{sf}/documents.parquet")) == line_dedup.brute_force(_given(sf))


def _similar_lines(seed, docs=80):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)]
    bases = [[rng.choice(vocabulary) for _ in range(n)] for n in (6, 12, 120)]

    def line():
        if rng.random() < 0.6:
            base = list(rng.choice(bases))
            for _ in range(rng.randint(0, max(2, len(base) // 10))):
                base[rng.randrange(len(base))] = rng.choice(vocabulary)
            return " ".join(base)
        return " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 12)))

    return [(i, "\n".join(line() for _ in range(rng.randint(1, 8)))) for i in range(docs)]


@pytest.mark.parametrize("reach, rounds", [(1024, (1, 16)), (1024, (4,)), (3, (1, 2)), (3, (1,))])
def test_line_dedup_of_many_similar_lines(spark, monkeypatch, reach, rounds):
    """With a short reach the second pass has to find what the first left."""
    monkeypatch.setattr(line_dedup, "REACH", reach)
    monkeypatch.setattr(line_dedup, "ROUNDS", rounds)
    rows = _similar_lines(reach)
    assert _lines(spark.createDataFrame(rows, DOC)) == line_dedup.brute_force(rows)


@pytest.mark.parametrize("reach, rounds", [(1024, (4, 32)), (0, (1,))])
@pytest.mark.parametrize("sent", [0, 1 << 16])
def test_line_dedup_of_lines_around_the_wide_bitmap(spark, monkeypatch, reach, rounds, sent):
    monkeypatch.setattr(line_dedup, "REACH", reach)
    monkeypatch.setattr(line_dedup, "ROUNDS", rounds)
    monkeypatch.setattr(line_dedup, "SENT_WORDS", sent)
    monkeypatch.setattr(line_dedup, "SENT_ROWS", sent)
    rng, rows = random.Random(8), []
    for base in range(12):
        words_ = [f"w{rng.randrange(700)}" for _ in range(rng.choice([44, 50, 60, 160, 500]))]
        for _ in range(6):
            line = [w if rng.random() > 0.11 else f"x{rng.randrange(10**6)}" for w in words_]
            rows.append((len(rows), " ".join(line[: len(line) - rng.randrange(8)])))
    assert _lines(spark.createDataFrame(rows, DOC)) == line_dedup.brute_force(rows)


def test_line_dedup_of_odd_rows(spark):
    rows = [(1, "a b c\n\n  \na b c"), (1, "a b c\n\n  \na b c"), (2, "A  b c"), (3, None), (4, ""), (None, "c b a\nnew one")]
    out = line_dedup.dedup_lines(_clashing(spark, rows))
    assert out.columns == CLASH.replace("removed_lines int, ", "").replace(" long", "").replace(" string", "").replace(" int", "").split(", ") + ["removed_lines"]
    found = sorted(((r.doc_id, r.text, r.removed_lines) for r in out.collect()), key=str)
    first = "a b c\n\n  "
    assert found == sorted(
        [(1, first, [3]), (1, first, [3]), (2, "", [0]), (3, None, []), (4, "", []), (None, "new one", [0])], key=str
    )
    assert line_dedup.dedup_lines(spark.createDataFrame([], DOC)).count() == 0


# --- near dedup -----------------------------------------------------------


def _brute_components(rows, size):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if sets[i] and sets[j]:
                shared = len(sets[i] & sets[j])
                if 100 * shared >= 80 * (len(sets[i]) + len(sets[j]) - shared):
                    a, b = sorted((root(i), root(j)))
                    parent[b] = a
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def _components(df, size):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.report(df, size).collect()}


@pytest.mark.parametrize("size", [2, 5])
def test_near_dedup_equals_brute_force(spark, sf, size):
    assert _components(spark.read.parquet(f"{sf}/documents.parquet"), size) == _brute_components(_given(sf), size)


def test_near_dedup_of_one_large_loose_group(spark):
    """Copies with so many edits that many are linked by a third one only."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    bases = [[rng.choice(vocabulary) for _ in range(n)] for n in (6, 10, 20, 60, 150)]
    rows = []
    for i in range(400):
        base = list(rng.choice(bases))
        for _ in range(rng.randint(0, max(1, len(base) // 15))):
            base[rng.randrange(len(base))] = rng.choice(vocabulary)
        rows.append((3 * i + 1, " ".join(base)))
    rows += [(5000, None), (5003, ""), (5006, "a"), (5007, "A"), (5009, " \n")]
    assert _components(spark.createDataFrame(rows, DOC), 2) == _brute_components(rows, 2)


def test_near_dedup_of_odd_rows(spark):
    text = " ".join(f"x{i}" for i in range(30))
    rows = [(7, text), (7, text), (3, text.upper()), (None, text), (9, "other words here"), (9, text + " y"), (10, None)]
    out = near_dedup.report(_clashing(spark, rows), 2)
    found = sorted(((r.doc_id, r.component_id, r.kept) for r in out.collect()), key=str)
    assert found == sorted(
        [(7, 3, False), (7, 3, False), (3, 3, True), (None, None, True), (9, 3, False), (9, 3, False), (10, 10, True)], key=str
    )
    kept = near_dedup.one_of_each(_clashing(spark, rows), 2)
    assert kept.columns[-1] == "text" and sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 3, 10]
    assert near_dedup.report(spark.createDataFrame([], DOC)).count() == 0


@pytest.mark.parametrize("turned", [False, True])
def test_near_dedup_links_every_text_of_a_doc_id(spark, turned):
    """Two texts under one doc_id, which is the least of both sets; each has a near copy."""
    one, two = (" ".join(f"{c}{i}" for i in range(60)) for c in "xy")
    rows = [(1, one), (1, two), (1, one), (4, two + " more"), (5, one + " more"), (6, two.upper()), (7, "alone here")]
    found = near_dedup.report(spark.createDataFrame(rows[::-1] if turned else rows, DOC), 2).collect()
    assert len(found) == 7
    assert {(r.doc_id, r.component_id, r.kept) for r in found} == {(1, 1, True), (4, 1, False), (5, 1, False), (6, 1, False), (7, 7, True)}


def test_estimates_follow_similarity():
    rng = np.random.default_rng(1)
    for share in (0.5, 0.8, 0.95):
        a = np.unique(rng.integers(0, 2**63, 2000, dtype=np.uint64))
        b = np.unique(np.append(a[: int(len(a) * share)], rng.integers(0, 2**63, int(len(a) * (1 - share)), dtype=np.uint64)))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        regs = near_dedup.registers(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)]))
        assert abs(near_dedup.estimate(regs[0], regs[1], len(a), len(b)) - true) < 0.12


def _bucket(rows, limit=8, rows_of_batch=1):
    """What a bucket of (component, size, registers, hashes) offers; nodes are 0,
    1, ..., all but those of component 0 outside of the largest one."""
    key = near_dedup.band_keys(rows[0][2][None, :])[0].view(np.int64)[0]
    both = [(n, *r, True) for n, r in enumerate(rows) if r[0]] + [(n, *r, False) for n, r in enumerate(rows)]
    columns = [
        pa.array([key] * len(both), pa.int64()),
        *[pa.array([0] * len(both), pa.int64())] * 2,
        *[pa.array([r[k] for r in both], pa.int64()) for k in range(3)],
        pa.array([r[3].tobytes() for r in both], pa.binary()),
        pa.array([None if r[4] is None else r[4].tobytes() for r in both], pa.binary()),
        pa.array([r[5] for r in both], pa.bool_()),
    ]
    names = ["key", "left", "right", "node", "component", "n", "registers", "hashes", "outside"]
    batch = pa.RecordBatch.from_arrays(columns, names=names)
    batches = [batch.slice(k, rows_of_batch) for k in range(0, len(both), rows_of_batch)]
    return sorted(tuple(r.values()) for out in near_dedup._offer(limit)(batches) for r in out.to_pylist())


def _sharing(registers, equal):
    """Registers that agree with ``registers`` in ``equal`` places, its first band among them."""
    other = registers + np.uint16(1)
    first = np.arange(near_dedup.ROWS) * near_dedup.BANDS
    places = np.concatenate((first, np.setdiff1d(np.arange(near_dedup.REGISTERS), first)))[:equal]
    other[places] = registers[places]
    return other


def test_small_sets_need_no_estimate():
    regs, hashes = np.arange(near_dedup.REGISTERS, dtype=np.uint16), np.arange(1, 101, dtype=np.uint64) << np.uint64(40)
    far = _sharing(regs, near_dedup.ROWS)
    # 80 of 100, 79 of 99 and a set too small to reach the threshold.
    rows = [(0, 100, regs, hashes), (1, 80, far, hashes[:80]), (2, 79, far, hashes[:79]), (3, 20, far, hashes[:20])]
    assert (0, 1, True) in _bucket(rows) and (0, 2, True) not in _bucket(rows)
    assert not any(3 in pair[:2] for pair in _bucket(rows))


def test_estimates_keep_five_standard_errors():
    regs = np.arange(near_dedup.REGISTERS, dtype=np.uint16)
    rows = [(k, 10**6, r, None) for k, r in enumerate((regs, _sharing(regs, 174), _sharing(regs, 172)))]
    assert [p for p in _bucket(rows) if 0 in p[:2]] == [(0, 1, False)]


def test_a_bucket_over_many_batches():
    regs, hashes = np.arange(near_dedup.REGISTERS, dtype=np.uint16), np.arange(1, 101, dtype=np.uint64) << np.uint64(40)
    rows = [(k, 100, regs, hashes) for k in range(6)]
    assert {p[:2] for p in _bucket(rows)} >= {(0, k) for k in range(1, 6)}
    assert _bucket(rows) == _bucket(rows, rows_of_batch=100)


def test_an_open_bucket_is_split_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_NODES", 10)
    shared = spark.range(95).selectExpr("7L AS key", "id AS node", "id AS place")
    # 80 nodes of one component, 12 of another and three alone.
    label = spark.range(92).selectExpr("id AS node", "if(id < 80, 0L, 80L) AS component")
    dealt = near_dedup._open(shared, label).collect()
    units, met = {}, {}
    for r in dealt:
        units.setdefault((r.left, r.right), ([], []))[0 if r.outside else 1].append(r.node)
    assert len(units) == 2 * 10 and max(len(a) + len(b) for a, b in units.values()) < 50
    for a, b in units.values():
        for pair in ((x, y) for x in a for y in b):
            met[pair] = met.get(pair, 0) + 1
    assert met == {(x, y): 1 for x in range(80, 95) for y in range(95)}


@pytest.mark.parametrize("nodes", [3, 50])
def test_near_dedup_in_blocks_equals_brute_force(spark, monkeypatch, nodes):
    monkeypatch.setattr(near_dedup, "BLOCK_NODES", nodes)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        own = list(base)
        for _ in range(rng.randint(0, 6)):
            own[rng.randrange(60)] = f"v{rng.randrange(300)}"
        rows.append((i, " ".join(own)))
    assert _components(spark.createDataFrame(rows, DOC), 2) == _brute_components(rows, 2)


def test_verification_uses_no_estimate(monkeypatch):
    """Sets at hand decide, whatever their registers say."""
    monkeypatch.setattr(near_dedup, "registers", lambda hashes, bounds: hashes[None, : near_dedup.REGISTERS])
    monkeypatch.setattr(near_dedup, "estimate", lambda *_: 0.0)
    text = [zstandard.compress(" ".join(f"w{i}" for i in range(n)).encode()) for n in (100, 90, 50)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([0, 0]), pa.array([1, 2]), pa.array([text[0]] * 2), pa.array(text[1:])], names=["one", "two", "p1", "p2"]
    )
    assert [out.to_pydict() for out in near_dedup._verified(2)([batch])] == [{"one": [0], "two": [1]}]


# --- decontamination ------------------------------------------------------


def _hits(df, items):
    return sorted((tuple(r) for r in decontaminate.report(df, items).collect()), key=str)


def test_decontamination_equals_brute_force(spark, sf):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    few = [(r.item_id, r.text) for r in items.limit(10).collect()]
    df, bench = spark.createDataFrame(rows, DOC), spark.createDataFrame(few, "item_id long, text string")
    assert _hits(df, bench) == sorted(decontaminate.brute_force(rows, few), key=str)


def test_decontamination_of_repeating_words(spark):
    rng = random.Random(2)
    word = lambda: rng.choice(["a", "b", "é", "c9"])
    items = [(i, ", ".join(word() for _ in range(rng.randint(0, 14)))) for i in range(12)] + [(99, None), (100, "!!")]
    items += [(3, items[3][1]), (None, "a b a b")]
    docs = [(i, "-".join(word().upper() for _ in range(rng.randint(0, 60)))) for i in range(40)] + [(50, None), (51, ""), (50, None)]
    df, bench = spark.createDataFrame(docs, DOC), spark.createDataFrame(items, "item_id long, text string")
    expected = sorted(decontaminate.brute_force(docs, items), key=str)
    assert _hits(df, bench) == expected
    whole = decontaminate.scan(df, bench).select("doc_id", "spans", "item_ids")
    parts = decontaminate.scan(df, bench, shard_rows=7).select("doc_id", "spans", "item_ids")
    assert sorted(map(str, whole.collect())) == sorted(map(str, parts.collect()))


def test_decontamination_keeps_columns(spark):
    rows = [(1, "one two three four five six seven eight nine ten eleven"), (2, "clean"), (3, None)]
    bench = spark.createDataFrame([(5, "Two three, four five six seven eight nine ten ELEVEN")], "item_id long, text string")
    out = decontaminate.without_contaminated(_clashing(spark, rows), bench)
    assert [(r.doc_id, r.n_words, r.item_ids) for r in out.orderBy("doc_id").collect()] == [(2, "a", 1), (3, "a", 1)]
    assert out.schema == _clashing(spark, rows).schema
    none = bench.limit(0)
    assert decontaminate.without_contaminated(_clashing(spark, rows), none).count() == 3


# --- BPE ------------------------------------------------------------------

CASES = ["don't STOP 12", "<|endoftext|>a<|startoftext|>", "ΣΑΣ ςΣ", "a" * 3000, "'stupid's", "", None, "x\x1cy z", "àb İ", "a  b　c", "🙂 中文"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path())


def test_bpe_equals_the_library(spark, sf, library):
    texts = CASES + [t for _, t in _given(sf)]
    df = spark.createDataFrame(list(enumerate(texts)), DOC)
    for r in bpe.round_trip(df, vocabulary_path()).collect():
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_bpe_columns_and_empty_table(spark, library):
    rows = list(enumerate(CASES))
    out = bpe.decode(bpe.encode(_clashing(spark, rows), vocabulary_path()), vocabulary_path())
    for r in out.collect():
        ids = library.encode(CASES[r.doc_id] or "", add_special_tokens=False).ids
        assert r.token_ids == ids and r.decoded == library.decode(ids, skip_special_tokens=False)
    assert bpe.encode(spark.createDataFrame([], DOC), vocabulary_path()).count() == 0


def test_lexicon_shares_suffixes_and_finds_its_words(tmp_path):
    entries = [(w.encode(), [i, i + 1][: 1 + i % 2]) for i, w in enumerate(["walking", "talking", "walked", "talked", "é", "a"])]
    data = bpe.compile_lexicon(entries)
    path = tmp_path / "lexicon"
    path.write_bytes(data)
    lexicon = bpe.Lexicon(str(path))
    for word, ids in entries:
        assert np.frombuffer(lexicon.find(word), "<u4").tolist() == ids
    assert lexicon.find(b"walk") is None and lexicon.find(b"zzz") is None and lexicon.find(b"") is None
    # root, w, wa, wal, walk, alki, alkin, alke, e-acute's first byte and the end
    assert len(lexicon.first) - 1 <= 12


def test_merges_agree(library):
    vocabulary = bpe.vocabulary(vocabulary_path())
    rng = random.Random(4)
    for _ in range(300):
        word = "".join(rng.choice("theandingouéß") for _ in range(rng.randint(1, 60)))
        assert vocabulary.merge(word) == library.encode(word, add_special_tokens=False).ids


def test_word_counts_cover_all_texts(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, "A, b"), (3, None)], DOC)
    counts = {r.word: r.n for r in bpe.count_words(df, vocabulary_path()).collect()}
    assert counts == {"a": 3, "b": 2, ",": 1}
    assert bpe.count_words(df, vocabulary_path()).agg(F.sum("n")).first()[0] == 6


def test_bpe_of_every_code_point():
    """Ids of each character between letters and a digit, as the library has them."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary_path())
    library.no_truncation()
    library.no_padding()
    vocabulary = bpe.vocabulary(vocabulary_path())
    texts = [f"a{chr(c)}b 1" for c in range(0x34000) if not 0xD800 <= c < 0xE000]
    for text, expected in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        found = [i for chunk in vocabulary.chunks(text) for word in vocabulary.pieces(chunk) for i in vocabulary.merge(word)]
        assert found == expected.ids, ascii(text)


def test_rows_of_a_word_stay_together_in_later_rounds(spark):
    """Also where the joins before them become broadcasts."""
    rows = [(i, " ".join(f"w{(i * 7 + k) % 40}" for k in range(6))) for i in range(300)]
    keyed = line_dedup._keyed(spark.createDataFrame(rows, DOC))
    lines = line_dedup.line_sets(keyed, line_dedup.word_order(keyed)).withColumn("line", F.monotonically_increasing_id())
    lines = line_dedup.stage(lines, "lines")
    some = line_dedup.stage(lines.where(F.col("line") % 3 == 0).select("line"), "open")
    found = line_dedup._pairs(lines, some, 1_000).where("b IS NOT NULL")
    whole = line_dedup._pairs(lines, None, 1_000).where("b IS NOT NULL").join(some.withColumnRenamed("line", "b"), "b")
    assert sorted((r.a, r.b) for r in found.collect()) == sorted((r.a, r.b) for r in whole.collect()) != []
