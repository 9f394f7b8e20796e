from auditrank.llm import bpe
from auditrank.llm.queries import vocabulary_path


def test_memos_of_a_task_are_small_and_end_with_it(spark, monkeypatch):
    texts = [(n, f"word{n} and more of it") for n in range(50)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    path = vocabulary_path()
    monkeypatch.setattr(bpe, "_ENCODERS", {})
    work = bpe._encoders(docs, path, kept=False)()
    kept = bpe._encoders(docs, path, kept=True)()
    assert list(bpe._ENCODERS.values()) == [kept]
    assert work.memo.size < kept.memo.size
    work.memo.size = 3
    assert [work.encode(t) for _, t in texts] == [kept.encode(t) for _, t in texts]
    assert len(work.memo) <= 3


def test_plain_words_need_no_pattern(monkeypatch):
    split = bpe.vocabulary(vocabulary_path())
    texts = ["Word", "word", "WORDs", "x", "don't", "naïve", "a1", "Σας", "word.", "K"]
    by_pattern = [split._split(t) for t in texts]
    assert [split.pieces(t) for t in texts] == by_pattern
    seen = []
    monkeypatch.setattr(split, "_split", lambda t: seen.append(t) or [])
    assert split.pieces("Word") == ["word"] and not seen
    monkeypatch.setattr(split, "plain_letters", False)  # a control string of letters alone
    assert split.pieces("Word") == [] and seen == ["Word"]


def test_a_kept_memo_holds_the_words_of_several_tasks(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a word")], "doc_id long, text string")
    monkeypatch.setattr(bpe, "_ENCODERS", {})
    kept = bpe._encoders(docs, vocabulary_path(), kept=True)()
    # A task of some 8,000 documents of the given tables has more than 300,000.
    assert kept.memo.size >= 2 * bpe.MEMO_WORDS
