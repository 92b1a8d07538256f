"""Operator 7 in bounded memory: few windows and texts at a time, with the same spans."""

import numpy as np
import pyarrow as pa

from plumbline.llm import suffix_dedup


def test_few_windows_are_ordered_at_a_time(monkeypatch):
    rng = np.random.default_rng(4)
    core = rng.integers(97, 123, 500, np.uint8).tobytes()
    contexts, low, high = [], [], []
    for i in range(60):
        h, w = int(rng.integers(10, 100)), int(rng.integers(0, 10))
        text = bytearray(core[100 - h:300 - h + w])
        if i % 3:
            text[int(rng.integers(0, len(text)))] = 33 + i % 5
        contexts.append(bytes(text))
        high.append(h)
        low.append(h - w)
    anchor, low, high = np.array([i % 2 for i in range(60)]), np.array(low), np.array(high)
    whole = suffix_dedup.repeated_windows(contexts, anchor, low, high)
    seen, groups = [], suffix_dedup.multikey_groups
    monkeypatch.setattr(suffix_dedup, "multikey_groups", lambda b, s, g: (seen.append(len(s)), groups(b, s, g))[1])
    monkeypatch.setattr(suffix_dedup, "_WINDOWS", 120)
    cut = suffix_dedup.repeated_windows(contexts, anchor, low, high)
    assert (cut == whole).all() and (whole >= 0).any() and (whole < 0).any()
    assert max(seen) <= 120 and sum(seen) == (high - low + 1).sum()


def test_texts_are_taken_by_their_bytes(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_TEXTS", 10)
    texts = ["abcd", "", None, "efghij", "k", "l" * 30, "é" * 5, "m"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    pieces = [p.column(0).to_pylist() for p in suffix_dedup._pieces(batch, "text")]
    assert pieces == [["abcd", "", None, "efghij"], ["k"], ["l" * 30], ["é" * 5], ["m"]]
