"""Words of Arrow columns, and the hashes of their windows."""

from __future__ import annotations

import random

import pyarrow as pa

from lumenlake.llm import substrings
from lumenlake.llm.common import words_of


def _texts() -> list[str | None]:
    letters = random.Random(1)
    alphabet = "ab\x1c\x1f\x85\xa0\x00éΣİK\"'!«\x0b\x0c\r\n\t   "
    made = ["".join(letters.choice(alphabet) for _ in range(letters.randrange(30))) for _ in range(500)]
    return [None, "", " \t", "\x0b", "«»", "ΑΣ Σ ΑΣ.", *made, None]


def test_words_are_those_of_split():
    texts = _texts()
    for table in (pa.table({"text": texts}), pa.table({"text": pa.chunked_array([texts[:9], texts[9:]])}), pa.table({"text": texts}).slice(3, 60)):
        numbers, distinct, sizes = words_of(table)
        wanted = [(t or "").encode().split() for t in table.column("text").to_pylist()]
        assert sizes.tolist() == [len(w) for w in wanted]
        assert [distinct[k] for k in numbers] == [w for words in wanted for w in words]
    assert [len(x) for x in words_of(pa.table({"text": pa.chunked_array([], pa.string())}))] == [0, 0, 0]


def test_runs_are_numbers_with_a_word_as_a_digit():
    words = substrings.Words(pa.table({"text": ["a b c a b", None, "d e f g h i j k l m n a b c"]}))
    for lane in (0, 1):
        digits = [int(x) for x in words.hashes[lane][words.numbers]]
        base = int(substrings._MULTIPLIERS[lane])
        for size in range(1, 24):
            wanted = []
            for k in range(len(digits) - size + 1):
                number = 0
                for digit in digits[k : k + size]:
                    number = (number * base + digit) % (1 << 64)
                wanted.append(number)
            assert words.runs(lane, size).tolist() == wanted


def test_digests_need_no_kept_text(monkeypatch):
    """op6 asks for counts and digests: no text without its repeated words is put together for them."""
    text = " ".join(f"w{k}" for k in range(20))
    chunk = pa.table({"chunk": [0, 0], "doc_id": [1, 2], "text": [text, f"new {text}  end"]})
    bits = 16
    sent = substrings._send_cells(13, bits)(chunk)
    first = substrings._merge_cells(bits)(sent).append_column("kind", pa.array([1], pa.int32()))
    keys = substrings._send_keys(13, bits)(chunk, first)
    second = substrings._merge_keys(keys).append_column("kind", pa.array([2], pa.int32()))

    def never(*_):
        raise AssertionError("not asked for")

    monkeypatch.setattr(substrings, "_without", never)
    found = substrings._Remove(13, bits, False)(chunk, pa.concat_tables([first, second])).to_pylist()
    assert [(r["doc_id"], r["n_words"], r["n_removed"]) for r in found] == [(1, 20, 0), (2, 22, 20)]
