import pyarrow as pa
import zstandard

from auditrank.llm import line_dedup


def test_words_of_lines_come_in_bounded_batches():
    lines = [" ".join(f"w{n}x{k}" for k in range(100)) for n in range(2_000)]
    text = zstandard.ZstdCompressor().compress("\n".join(lines).encode())
    picks = [{"line_no": n, "line": n} for n in range(len(lines))]
    kind = pa.list_(pa.struct([("line_no", pa.int32()), ("line", pa.int64())]))
    batch = pa.record_batch([pa.array([text]), pa.array([picks], kind)], names=["text", "picks"])
    out = list(line_dedup._words_of([batch]))
    assert max(len(b.column(1).flatten()) for b in out) <= (1 << 15) + 100
    found = {line: words for b in out for line, words in zip(*(c.to_pylist() for c in b.columns))}
    assert found == {n: sorted(set(line.split())) for n, line in enumerate(lines)}
