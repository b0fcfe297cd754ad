"""Hashes of word shingles for many texts at once, with numpy inside tasks."""

from __future__ import annotations

import numpy as np
from pandas.util import hash_array

#: Mixing constants of a 64-bit finaliser, and an odd base of a polynomial with its inverse modulo 2**64.
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
STEP = np.uint64(0x9E3779B97F4A7C15)
BASE = 0xD6E8FEB86659FD93
INVERSE = pow(BASE, -1, 1 << 64)
#: The key of the words' hashes; any 16 bytes serve.
KEY = "tmweave-shingles"
#: Bytes of text hashed together; a longer text is hashed alone.
CHUNK = 1 << 20

_powers: list[np.ndarray] = []


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, kept for texts of the usual length."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK + CHUNK // 4)
        got = []
        for b in (BASE, INVERSE):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            got.append(np.multiply.accumulate(x))
        if n > 8 * CHUNK:
            return got[0], got[1]
        _powers[:] = got
    return _powers[0], _powers[1]


def chunks(sizes: list[int], most: int = CHUNK):
    """Ranges of texts of about so many bytes together."""
    lo = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield lo, i
            lo, total = i, 0
        total += n + 1
    if lo < len(sizes):
        yield lo, len(sizes)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """SipHash of each word, keyed: no pattern of bytes makes two words meet more often than chance."""
    out = np.empty(len(words), object)
    out[:] = words
    return hash_array(out, hash_key=KEY, categorize=False)


def words_of(text: bytes) -> list[bytes]:
    """Runs of anything but the six ASCII white-space characters, A to Z in lower case: what bytes' own methods do."""
    return text.lower().split()


def shingle_sets(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """hashes, ends: each text's distinct shingle hashes in ascending order, end to end, and where each text's end.

    A text of fewer than k words has its whole sequence as one shingle, a text without words none.
    """
    words = [words_of(t) for t in texts]
    count = np.array([len(w) for w in words], np.int64)
    h = word_hashes([x for w in words for x in w])
    del words
    doc = np.repeat(np.arange(len(texts)), count)
    at = np.concatenate([[0], np.cumsum(count)])
    out_doc, out_hash = [], []
    if len(h) >= k:
        i = np.flatnonzero(doc[: len(h) - k + 1] == doc[k - 1 :])
        out_doc.append(doc[i])
        out_hash.append(chain(h, i, k))
    for m in range(1, k):
        few = np.flatnonzero(count == m)
        if len(few):
            out_doc.append(few)
            out_hash.append(chain(h, at[few], m))
    doc, h = (np.concatenate(out_doc), np.concatenate(out_hash)) if out_doc else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[keep], np.cumsum(np.bincount(doc[keep], minlength=len(texts)))


def shared_shingles(a: bytes, b: bytes, k: int) -> tuple[int, int]:
    """How many distinct shingles two texts share, and how many they have together; by the words themselves, no hashes."""
    number: dict[bytes, int] = {}
    sets = []
    for t in (a, b):
        ids = [number.setdefault(w, len(number)) for w in words_of(t)]
        sets.append(set(zip(*(ids[i:] for i in range(k)), strict=False)) if len(ids) >= k else {tuple(ids)} if ids else set())
    both = len(sets[0] & sets[1])
    return both, len(sets[0]) + len(sets[1]) - both


def chain(h: np.ndarray, i: np.ndarray, k: int) -> np.ndarray:
    x = np.full(len(i), k, np.uint64)
    for j in range(k):
        x = mixed(x * STEP + h[i + j])
    return x
