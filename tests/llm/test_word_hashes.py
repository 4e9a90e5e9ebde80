"""The word hashes of decontamination."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

from lumenlake.llm import decontamination


def test_word_hashes_of_leaks():
    texts = [None, "", " \t", "«»", "ΑΣ Σ ΑΣ.", "\"İK\" KK\x0bké\x85x\xa0y  a-b -a-", "\x1c! ab\x1f", "a b A.", None]
    batch = pa.record_batch({"text": texts})
    for text, hashes in zip(texts, decontamination._words_hashed(batch), strict=True):
        plain = [w.decode().lower().strip(decontamination._EDGES) for w in (text or "").encode().split()]
        assert hashes.tolist() == [xxhash.xxh32_intdigest(p.encode()) or 1 for p in plain if p]


def test_a_word_is_hashed_once_in_a_batch(monkeypatch):
    made = []
    plain = decontamination._plain_hashes
    monkeypatch.setattr(decontamination, "_plain_hashes", lambda words: made.extend(words) or plain(words))
    batch = pa.record_batch({"id": [1, 2], "text": ["a b a", "B a c"]})
    out = next(decontamination._hashed(iter([batch])))
    assert sorted(made) == [b"B", b"a", b"b", b"c"]
    assert [len(np.frombuffer(w, np.uint32)) for w in out.column("words").to_pylist()] == [3, 3]
