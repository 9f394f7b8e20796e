"""Archives, neighbours, chats, pseudonyms and models, also on odd tables."""

import hashlib
import random
import re

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from auditrank.llm import chat, pii, quality, toxicity, vptree, warc
from auditrank.llm.components import components

PAGE = "page_id long, url string, html string"


# --- components -----------------------------------------------------------


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(200, 260)] + [(259, 3), (9, 9)]
    random.Random(1).shuffle(links)
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "one long, two long")).collect()}
    assert {found[i] for i in range(100, 141)} == {100}
    assert {found[i] for i in [7, 3, *range(200, 260)]} == {3}
    assert components(spark.createDataFrame([], "one long, two long")).count() == 0


# --- WARC -----------------------------------------------------------------


def _expected_records(pages):
    first = {}
    for i, _, html in pages:
        body = (html or "").encode()
        if len(body) >= 100:
            first[body] = min(first.get(body, i), i)
    out = []
    for i, _, html in pages:
        body = (html or "").encode()
        other = first.get(body, i)
        seen = (i, len(body), hashlib.sha256(body).hexdigest())
        out.append((*seen, "response", None) if other == i else (*seen, "revisit", other))
    return sorted(out, key=str)


FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:9>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


def test_warc_round_trip_with_magic_in_payloads(spark, sf):
    pages = [(r["page_id"], r["url"], r["html"]) for r in pq.read_table(f"{sf}/pages.parquet").to_pylist()]
    pages += [
        (100001, "u\r\nContent-Length: 3", FAKE),
        (100002, "u", "x" + FAKE + "y" * 50),
        (100003, None, FAKE * 3 + "WARC/1.1\r\n"),
        (100004, "u", None),
        (100005, "u", ""),
        (100006, "u", "WARC/1.1\r\n"),
        (100007, "u", "é\r\n\r\n" * 30),
        (100008, "u", "é\r\n\r\n" * 30),
        (100009, "u", "short"),
        (100010, "u", "short"),
        (100011, "u", "WARC/1.1\r\nContent-Length: 99999\r\n\r\n"),
        (-5, "u", "WARC/1.1\r\nContent-Length: -1\r\n\r\n"),
    ]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")  # splits cut records and magic lines
    try:
        found = warc.report(spark.createDataFrame(pages, PAGE)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(map(tuple, found), key=str) == _expected_records(pages)


def test_warc_of_odd_tables(spark):
    assert warc.report(spark.createDataFrame([], PAGE)).count() == 0
    rows = [(1, "u", "z" * 100, "a", 1)] * 2 + [(2, "u", "z" * 100, "b", 2), (None, "u", "q", "c", 3)]
    df = spark.createDataFrame(rows, PAGE + ", record_type string, payload_bytes int")
    found = sorted(((r.page_id, r.record_type, r.refers_to) for r in warc.report(df).collect()), key=str)
    assert found == sorted([(1, "response", None), (1, "response", None), (2, "revisit", 1), (None, "response", None)], key=str)


def test_reachable_follows_the_chain_only(spark):
    edges = [("f", 0, 10), ("f", 10, 35), ("f", 20, 30), ("f", 35, None), ("g", 5, 9), ("g", 9, 12)]
    df = spark.createDataFrame(edges, "file string, offset long, successor long")
    assert sorted((r.file, r.offset) for r in warc.reachable(df).distinct().collect()) == [("f", 0), ("f", 10), ("f", 35)]


# --- vantage-point trees --------------------------------------------------


def _brute_neighbours(rows, every, k=20):
    out = []
    for i, x in rows:
        if i % every == 0:
            scores = sorted(((-float(np.dot(x, y)), j) for j, y in rows if j != i))[:k]
            out += [(i, n, j, round(-s, 9)) for n, (s, j) in enumerate(scores, 1)]
    return sorted(out)


def _neighbours(df):
    return sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in vptree.report(df).collect())


def test_neighbours_equal_brute_force(spark, sf, monkeypatch):
    monkeypatch.setattr(vptree, "SHARD_ROWS", 100)
    monkeypatch.setattr(vptree, "BLOCK_ROWS", 7)
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in df.collect()]
    assert _neighbours(df) == _brute_neighbours(rows, 20)


@pytest.mark.parametrize("unit", [False, True])
def test_neighbours_among_equal_vectors(spark, monkeypatch, unit):
    """Many copies of one vector, over several shards: ids and scores bit by bit."""
    monkeypatch.setattr(vptree, "SHARD_ROWS", 300)
    monkeypatch.setattr(vptree, "BLOCK_ROWS", 17)
    monkeypatch.setattr(vptree, "LEAF_ROWS", 32)
    rng = np.random.default_rng(8)
    vectors = rng.normal(size=(1000, 64))
    vectors[rng.permutation(1000)[:400]] = rng.normal(size=64) * 3
    vectors[rng.permutation(1000)[:30]] *= 1 + 1e-15
    if unit:
        vectors /= np.sqrt((vectors**2).sum(1))[:, None]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]

    def score(a, b):
        total = 0.0
        for x, y in zip(a, b):
            total += x * y
        return total

    expected = []
    for i, v in rows[::20]:
        best = sorted((-score(v, w), j) for j, w in rows if j != i)[:20]
        expected += [(i, k, j, -s) for k, (s, j) in enumerate(best, 1)]
    found = vptree.report(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert sorted(tuple(r[c] for c in ("query_id", "rank", "vec_id", "score")) for r in found.collect()) == expected


def test_neighbours_with_ties_and_odd_vectors(spark):
    rows = [(i, [1.0, float(i % 3)], "x") for i in range(60)]
    odd = [(80, None, "x"), (100, [0.0, 0.0], "x"), (120, [float("nan"), 1.0], "x"), (140, [None, 1.0], "x"), (160, [float("inf"), 1.0], "x"), (None, [1.0, 1.0], "x"), (180, [1.0, 2.0, 3.0], "x")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, score string")
    assert _neighbours(df) == _brute_neighbours([(i, np.array(x)) for i, x, _ in rows], 20)
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert _neighbours(few) == [(0, 1, 1, 2.0)]
    assert vptree.report(few.limit(0)).count() == 0


def test_a_smaller_factor_skips_more(spark, sf):
    rng = np.random.default_rng(3)
    points = rng.normal(size=(4000, 3))
    wide = np.column_stack((points, np.sqrt(np.maximum((points**2).sum(1).max() - (points**2).sum(1), 0))))
    tree = vptree.Tree.grown(wide, np.arange(4000))
    limit = float(np.sqrt((points**2).sum(1).max()))
    asked = np.column_stack((points[:50], np.zeros(50)))
    recall, looked = {}, {}
    for factor in (1.0, 0.3):
        seen = []
        top = vptree.Top(asked, limit, 10)
        offer = top.offer
        top.offer = lambda active, *rest: (seen.append(len(active) * len(rest[1])), offer(active, *rest))  # noqa: B023
        tree.search(asked, np.arange(50), top, factor)
        true = [sorted(range(4000), key=lambda j: (-points[i] @ points[j], j)) for i in range(50)]
        best = [set([j for j in t if j != i][:10]) for i, t in enumerate(true)]
        recall[factor] = np.mean([len(b & set(f)) / 10 for b, f in zip(best, top.id.tolist())])
        looked[factor] = sum(seen)
    assert recall[1.0] == 1.0 and looked[0.3] < looked[1.0] < 50 * 4000


# --- chat -----------------------------------------------------------------


def _chat(rows):
    talks = {}
    for c, t, r, x in sorted(rows, key=lambda a: (a[0] is not None, a[0], a[1], a[2] or "", a[3] or "")):
        talks.setdefault(c, []).append((r or "", x or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = []
    for c, turns in talks.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        out.append((c, len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)), len(loss), sha(loss), len(chat.render(turns))))
    return sorted(out, key=str)


def test_chat_reads_back_what_was_formatted(spark, sf):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in pq.read_table(f"{sf}/conversations.parquet").to_pylist()]
    rng = random.Random(1)
    bits = ["<|im_end|>", "<|", "|", "&", "&amp;", "&lt;|", "<", "\n", "assistant", "é", "&nl;", "im_start"]
    rows += [
        (10**6, i // 2, rng.choice(["user", "assistant", None, "a\n<|"]), "".join(rng.choices(bits, k=rng.randint(0, 6))) or None)
        for i in range(200)
    ]
    rows += [(None, 0, "assistant", "x"), (None, 0, "assistant", "x")]
    kind = "conv_id long, turn long, role string, text string, segment int"
    df = spark.createDataFrame([(*r, 1) for r in rows], kind)
    control = "<|im_end|><|im_start|>assistant ok"
    found = chat.report(chat.with_control_case(df)).collect()
    assert sorted(map(tuple, found), key=str) == _chat(rows + [(-1, 0, "user", control), (-1, 1, "assistant", control)])
    assert chat.report(df.limit(0)).count() == 0


def test_templates_that_rewrite_history_are_found():
    def forgets(turns):
        """Drops earlier assistant texts once a user speaks again."""
        last = max((i for i, (r, _) in enumerate(turns) if r == "user"), default=-1)
        return "".join(f"[{r}]{'' if r == 'assistant' and i < last else t};" for i, (r, t) in enumerate(turns))

    turns = [("user", "q"), ("assistant", "long"), ("user", "again"), ("assistant", "b")]
    assert chat.spans(forgets, [], turns)[2] == [2]
    text, places, rewritten = chat.spans(chat.render, [], turns)
    assert not rewritten and text == chat.render(turns)
    assert [text[a:b] for _, _, a, b in places] == ["q", "long", "again", "b"]


def _moves_system(turns):
    """Puts the first text into the last user turn and numbers the turns."""
    last = max((i for i, (r, _) in enumerate(turns) if r == "user"), default=-1)
    return "".join(f"{i}[{r}]{turns[0][1] if i == last else ''}{t};" for i, (r, t) in enumerate(turns))


def _blanks_first(turns):
    """Drops the first text once there are more than a hundred turns."""
    return "".join(f"[{r}]{'' if i == 0 and len(turns) > 100 else t};" for i, (r, t) in enumerate(turns))


def _recalls(turns):
    """Says after each text what was said seventy turns before."""
    return "".join(f"[{r}]{t}<{turns[i - 70][1] if i >= 70 else ''}>;" for i, (r, t) in enumerate(turns))


@pytest.mark.parametrize(
    "template, looks_back, rewritten",
    [(_moves_system, None, list(range(2, 150, 2))), (_blanks_first, None, [100]), (_recalls, None, []), (_recalls, 70, []), (chat.render, 0, [])],
)
def test_long_conversations_are_rendered_after_all_that_counts(spark, template, looks_back, rewritten):
    turns = [("user" if i % 2 == 0 else "assistant", f"text{i}") for i in range(150)]
    df = spark.createDataFrame([(1, i, *t) for i, t in enumerate(turns)], "conv_id long, turn long, role string, text string")
    out = chat.format_conversations(df, template, looks_back).orderBy("segment").collect()
    assert "".join(r.formatted for r in out) == template(turns)
    assert [k for r in out for k in r.rewritten] == rewritten
    assert len(out) == (1 if looks_back is None else 3)


# --- pseudonyms -----------------------------------------------------------


def _replaced(spark, texts):
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, n_replaced int")
    return [(r.text, r.n_replaced) for r in pii.pseudonymised(df).orderBy("doc_id").collect()]


def _luhn(text):
    digits = [int(c) for c in re.sub(r"\D", "", text)][::-1]
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits)) % 10


def test_pseudonyms_keep_format_and_links(spark):
    texts = [
        "card 4111 1111 1111 1111, again 4111111111111111; bad 4111111111111112",
        "4111-1111-1111-1111",
        "ip 10.0.0.1 not 1.2.3.4.5",
        "call +1 (274) 555-2202 or 274-555-2202",
        "Jo.Doe9@x.example.com and jo.doe9@x.example.com",
        "GB82 WEST 1234 5698 7654 32 GB82WEST12345698765432 bad GB83WEST12345698765432",
        "2024-02-29 but 2023-02-29; 29/02/2024 and 29.02.2024",
        "123-45-6789 000-12-3456 999-12-3456",
        None,
        "",
    ]
    out = _replaced(spark, texts)
    assert [n for _, n in out] == [2, 1, 1, 2, 2, 2, 3, 1, 0, 0]
    cards = re.findall(r"\d{4} \d{4} \d{4} \d{4}|\d{16}", out[0][0])
    assert cards[0].replace(" ", "") == cards[1] == out[1][0].replace("-", "") != "4111111111111111"
    assert _luhn(cards[1]) == 0 and cards[2] == "4111111111111112"
    assert re.fullmatch(r"ip (\d{1,3}\.){3}\d{1,3} not 1\.2\.3\.4\.5", out[2][0])
    assert re.fullmatch(r"call \+1 \((\d{3})\) (\d{3}-\d{4}) or \1-\2", out[3][0])
    a, b = re.findall(r"\S+@x\.example\.com", out[4][0])
    assert a.lower() == b and re.fullmatch(r"[A-Z][a-z]\.[A-Z][a-z]{2}\d@x\.example\.com", a)
    iban = re.findall(r"[A-Z]{2}\d{2}[A-Z ]+[\d ]+\d", out[5][0].replace(" bad", "\nbad"))
    plain = iban[-1].split()[-1] if " " in iban[-1] else iban[-1]
    for found in re.findall(r"\bGB[0-9A-Z]{20}\b", out[5][0])[:1]:
        value = int("".join(str(int(c, 36)) for c in found[4:] + found[:4]))
        assert value % 97 == 1 and plain
    year, month, day = re.match(r"(\d{4})-(\d\d)-(\d\d) but 2023-02-29", out[6][0]).groups()
    assert f"{day}/{month}/{year} and {day}.{month}.{year}" in out[6][0]
    assert out[7][0].endswith("000-12-3456 999-12-3456") and not out[7][0].startswith("123-45-6789")
    assert out[8:] == [(None, 0), ("", 0)]
    assert _replaced(spark, []) == []


def test_an_iban_ends_where_its_country_says(spark):
    ibans = ["DE89370400440532013000", "GB82WEST12345698765432", "FR1420041010050500013M02606", "NO9386011117947", "DE89 3704 0044 0532 0130 00"]
    after = ["BIC COBADEFFXXX", "EUR 500", "I paid", "2024", "ABC", "1", "GB82WEST12345698765432", "2024-02-29", "4111111111111111"]
    alone = [new for new, _ in _replaced(spark, ibans)]
    texts = [f"{iban} {tail}" for iban in ibans for tail in after]
    also = {tail: _replaced(spark, [tail])[0] for tail in after}
    for k, (new, n) in enumerate(_replaced(spark, texts)):
        (i, tail) = divmod(k, len(after))
        assert (new, n) == (f"{alone[i]} {also[after[tail]][0]}", 1 + also[after[tail]][1]), texts[k]
    for old, new in zip(ibans, alone):
        compact = new.replace(" ", "")
        assert new != old and len(new) == len(old) and int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1
    before = _replaced(spark, [f"{code}12ABCDEFGHIJKLM {ibans[3]}" for code in ("XY", "GB")])
    assert before == [(f"{code}12ABCDEFGHIJKLM {alone[3]}", 1) for code in ("XY", "GB")]
    # A token stuck to the number makes it another one.
    assert _replaced(spark, ["DE89370400440532013000X", "DE893704004405320130001"]) == [("DE89370400440532013000X", 0), ("DE893704004405320130001", 0)]


def test_pseudonyms_are_one_to_one(spark):
    dates = spark.range(0, 3000).select(F.col("id").alias("doc_id"), F.expr("cast(date_add(date'1990-01-01', cast(id AS int)) AS string)").alias("text"))
    out = pii.pseudonymised(dates)
    assert out.select("text").distinct().count() == 3000
    assert out.where(F.expr("try_cast(text AS date)").isNull()).count() == 0
    numbers = spark.range(1, 3000).select(F.col("id").alias("doc_id"), F.format_string("123-45-%04d", "id").alias("text"))
    assert pii.pseudonymised(numbers).select("text").distinct().count() == 2999


def test_pseudonyms_run_no_python(spark, sf):
    plan = pii.report(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


# --- models ---------------------------------------------------------------


@pytest.fixture(scope="module")
def labelled(spark):
    folder = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")


def test_toxicity_on_rows_not_fitted(labelled):
    docs, labels = labelled
    held_out = F.col("doc_id") % 4 == 0
    model = toxicity.fit(docs, labels.where(~held_out))
    assert list(model.thresholds) == sorted(model.thresholds) and len(model.thresholds) == 3
    scored = toxicity.score(docs.select("doc_id", "text"), model).withColumnRenamed("toxic", "found")
    rows = scored.join(labels.where(held_out), "doc_id").select("found", "toxic", "severity").collect()
    clean = [r for r in rows if not r.toxic]
    assert sum(r.found for r in clean) <= 0.03 * len(clean)
    toxic = [r for r in rows if r.toxic]
    assert np.mean([r.severity for r in toxic]) > 3 * np.mean([r.severity for r in clean])


def test_toxicity_of_odd_tables(spark, labelled):
    docs, labels = labelled
    rows = [(1, None, "s"), (1, None, "s"), (2, "", "s"), (3, "stupid idiot scum moron trash loser", "s")]
    odd = spark.createDataFrame(rows, "doc_id long, text string, severity string")
    kept = toxicity.without_toxic(odd.unionByName(docs.select("doc_id", "text", F.lit("s").alias("severity"))), labels)
    assert kept.columns == odd.columns and kept.where("severity != 's'").count() == 0
    nothing = toxicity.fit(docs, labels.where("toxic = 0"))
    assert {(r.severity, r.toxic) for r in toxicity.score(odd, nothing).collect()} == {(0.0, False)}
    assert toxicity.score(odd.limit(0), nothing).count() == 0
    graded = labels.select("doc_id", (2 * F.col("toxic")).alias("grade"))
    assert len(toxicity.fit(docs, graded).thresholds) == 1


def test_quality_on_rows_not_fitted(labelled):
    docs, labels = labelled
    held_out = F.col("doc_id") % 4 == 0
    found = quality.report(docs, labels.where(~held_out)).drop("quality")
    rows = found.join(labels.where(held_out), "doc_id").select("keep", "quality").collect()
    assert np.mean([r.keep == bool(r.quality) for r in rows]) > 0.9


def test_sparse_sites_are_shrunk(spark):
    rows = [("a", "a/x", 3.0)] * 300 + [("b", "b/x", -3.0)] * 300 + [("c", "c/x", 3.0), ("a", "a/y", -3.0), (None, None, 0.0)]
    df = spark.createDataFrame(rows, "host string, path string, log_odds double")
    found = {(r.host, r.path): r for r in quality.posterior(df, "host", "path", "log_odds").collect()}
    assert found["a", "a/x"].path_quality > 0.85 and found["b", "b/x"].path_quality < 0.15
    # Alone on its site, a document has the prior of the whole; alone on its path, its host's.
    assert abs(found["c", "c/x"].host_quality - 0.5) < 0.05
    assert found["a", "a/y"].path_quality > 0.8
    assert len(found) == 5


def test_quality_of_odd_tables(spark, labelled):
    docs, labels = labelled
    odd = spark.createDataFrame(
        [(1, None, None, "en"), (1, None, None, "en"), (2, "", "s", None)], "doc_id long, text string, source string, lang string"
    )
    assert quality.report(odd, labels).count() == 3
    assert quality.report(odd.limit(0), labels).count() == 0
    assert {r.keep for r in quality.report(odd, labels.limit(0)).collect()} == {True}


# --- pipeline -------------------------------------------------------------


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs
    for name, work in corpus_pipeline.STAGES[:-1]:
        after = work(spark, before, sf)
        assert after.columns == columns, name
        after = spark.createDataFrame(after.collect(), after.schema)
        assert after.join(before, "doc_id", "left_anti").count() == 0
        before = after
    assert 0 < before.count() < docs.count()
    text = [r.text for r in before.collect()]
    lines = [line for t in text for line in (t or "").split("\n") if line.split()]
    assert len(lines) == len({frozenset(line.lower().split()) for line in lines})


def test_pipeline_runs_whole(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.where("n_tokens != size(token_ids)").count() == 0 and out.count() > 0
