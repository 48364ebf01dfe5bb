"""Places of grams from a worker's table: the same numbers as by hashing each gram, and few hashes."""

from __future__ import annotations

import hashlib

import numpy as np

from docloom.operators import vectors

TEXTS = ["", "a", "ab", "abc", "合同 诈骗 Ärger\nx", "😀😀a\x00b" * 40, "x\x00", "\x00\x00\x00\x00", "ab\x00", "Hello hello World " * 30]


def plain(text):
    v = np.zeros(256)
    for n in (2, 3, 4):
        for i in range(max(1, len(text) - n + 1)):
            h = hashlib.md5(text[i : i + n].encode()).digest()
            v[int.from_bytes(h[:4], "little") % 256] += 1.0
            v[int.from_bytes(h[4:8], "little") % 256] -= 0.5
    for word in text.split():
        v[int.from_bytes(hashlib.md5(word.lower().encode()).digest()[:4], "little") % 256] += 2.0
    return v / (np.linalg.norm(v) or 1)


def test_slots_and_blocks_of_any_size_give_the_same_vectors(monkeypatch):
    for slots, block in ((1, 5), (7, 37), (1 << 12, 1 << 16)):
        monkeypatch.setattr(vectors, "MEMO_GRAMS", slots)
        monkeypatch.setattr(vectors, "GRAM_BLOCK", block)
        for _ in range(2):
            assert all(np.allclose(vectors.hash_vector(t), plain(t)) for t in TEXTS)


def test_a_gram_that_is_known_is_not_hashed_again(monkeypatch):
    hashed, own = [], vectors._hashed
    monkeypatch.setattr(vectors, "_hashed", lambda g, d: hashed.append(g) or own(g, d))
    text = " ".join(f"w{i % 97}" for i in range(20_000))
    vectors.hash_vector(text)
    n = len(hashed)
    vectors.hash_vector(text + text)
    assert 0 < n < 3000 and len(hashed) < 2 * n + 10
