import tracemalloc

import numpy as np
import pyarrow as pa

from corpuslens.llm import bagminhash, brown, words


class Frame:
    """Stands for a frame and keeps the function that its tasks run."""

    def mapInArrow(self, run, schema):
        self.run = run
        return self

    def __getattr__(self, name):
        return lambda *a, **b: self


def test_parts_keep_rows_and_order():
    texts = ["a" * n for n in (0, words.PART, 5, words.PART * 2, 7)] + [None, "b"] * 3000
    batch = pa.RecordBatch.from_pydict({"id": range(len(texts)), "text": texts}).slice(1)
    parts = list(words.parts(iter([batch, batch.slice(0, 0)]), 1))
    assert pa.Table.from_batches(parts).to_pylist() == batch.to_pylist()
    assert len(parts) > 3 and all(p.num_rows == 1 or sum(len(t or "") for t in p.column(1).to_pylist()) <= words.PART for p in parts)
    both = list(words.parts(iter([pa.RecordBatch.from_pydict({"a": ["x" * 1000] * 5000, "b": ["y" * 1000] * 5000})]), 0, 1))
    assert [p.num_rows for p in both[:2]] == [words.PART // 2000] * 2


def _peak(run, texts) -> float:
    """MB that numpy and Python hold at most while one batch is worked on."""
    batch = pa.RecordBatch.from_pydict({"text": texts})
    words._powers(1 << 20)
    tracemalloc.start()
    rows = sum(len(b) for b in run(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert rows
    return peak


def test_memory_does_not_grow_with_the_batch(monkeypatch):
    rng = np.random.default_rng(0)
    vocabulary = np.array([f"w{i:x}" for i in range(5000)])
    text = [" ".join(rng.choice(vocabulary, 500)) for _ in range(400)]
    monkeypatch.setattr(brown, "F", Frame())
    frame = Frame()
    brown.word_counts(frame, 64)
    few, many = _peak(frame.run, text * 4), _peak(frame.run, text * 20)
    assert many < 1.5 * few


def test_memory_of_shingles_does_not_grow_with_the_batch(monkeypatch):
    rng = np.random.default_rng(0)
    text = [" ".join(map(str, rng.integers(0, 5000, 500))) for _ in range(400)]
    monkeypatch.setattr(bagminhash, "F", Frame())
    frame = Frame()
    bagminhash._verified(frame, frame, 5)
    peaks = []
    for times in (4, 20):
        batch = pa.RecordBatch.from_pydict({"a": [1] * 400 * times, "b": [2] * 400 * times, "text_a": text * times, "text_b": text * times})
        tracemalloc.start()
        assert {s for b in frame.run(iter([batch])) for s in b.column(2).to_pylist()} == {1.0}
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.5 * peaks[0]
