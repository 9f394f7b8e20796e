import os

import pytest

from auditrank.llm import frames, line_dedup

PAGE = os.sysconf("SC_PAGE_SIZE")


def _resident() -> int:
    with open("/proc/self/statm") as file:
        return int(file.read().split()[1]) * PAGE


@pytest.mark.skipif(not os.path.exists("/proc/self/statm"), reason="reads Linux's process table")
def test_a_task_gives_its_memory_back():
    pins = []

    def run(batches):
        held = [bytes(100_000) for _ in range(2_000)]
        pins.append(held[-1])  # keeps the end of the heap in use
        yield from batches

    before = _resident()
    assert list(frames.tidy(run)([1, 2])) == [1, 2]
    assert _resident() - before < 50_000_000


def test_memory_is_given_back_when_a_task_is_left_early(monkeypatch):
    seen = []
    monkeypatch.setattr(frames, "give_back", lambda: seen.append(1))
    task = frames.tidy(lambda batches: iter(batches))([1, 2])
    assert next(task) == 1
    task.close()
    assert seen == [1]


def test_line_dedup_uses_it(spark, monkeypatch):
    used = []
    monkeypatch.setattr(line_dedup, "tidy", lambda run: used.append(run) or run)
    docs = spark.createDataFrame([(1, "a b c"), (2, "a b c")], "doc_id long, text string")
    found = {r.doc_id: r.removed_lines for r in line_dedup.dedup_lines(docs).collect()}
    assert found == {1: [], 2: [0]} and len(used) >= 5
