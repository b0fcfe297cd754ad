"""Ids of texts put together from the ids of their parts; each distinct part is encoded once while a worker remembers it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .shingles import STEP, chunks, mixed, powers

#: Bytes of texts put together at once.
TOGETHER = 1 << 20

_white = np.zeros(256, bool)
_white[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True


class Parts:
    """A hash table from parts' 64-bit hashes to their bytes and ids, which lie end to end in two arrays.

    The hash only finds an entry; a part is taken for it if all their bytes agree, and is solved anew otherwise. When the
    table has most entries it starts anew.
    """

    def __init__(self, kind: type, solve: Callable[[list[bytes]], list[np.ndarray]], most: int, bits: int = 22):
        self.kind, self.solve, self.most, self.bits = kind, solve, most, bits
        self.reset()

    def reset(self) -> None:
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.entry = np.zeros(1 << self.bits, np.int32)
        self.at, self.n = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self.flat, self.used, self.size = np.zeros(1 << 18, self.kind), 0, 0
        self.text, self.text_at, self.text_used = np.zeros(1 << 18, np.uint8), np.zeros(1 << 16, np.int64), 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """Entries of hashes; -1 for those not there."""
        out = np.full(len(h), -1, np.int32)
        left = np.arange(len(h))
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(left):
            k = self.keys[slot]
            hit = k == h[left]
            out[left[hit]] = self.entry[slot[hit]]
            on = ~hit & (k != 0)
            left, slot = left[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out

    def keep(self, parts: list[bytes]) -> np.ndarray:
        """Solves parts and stores them; gives their entries, which no hash leads to yet."""
        ids = self.solve(parts)
        n = np.array([len(x) for x in ids], np.int64)
        size = np.array([len(x) for x in parts], np.int64)
        while self.size + len(parts) > len(self.at):
            self.at, self.n, self.text_at = (np.concatenate([x, x * 0]) for x in (self.at, self.n, self.text_at))
        while self.used + int(n.sum()) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.text_used + int(size.sum()) > len(self.text):
            self.text = np.concatenate([self.text, np.zeros_like(self.text)])
        new = np.arange(self.size, self.size + len(parts), dtype=np.int32)
        self.flat[self.used : self.used + int(n.sum())] = np.concatenate([*ids, self.flat[:0]])
        self.text[self.text_used : self.text_used + int(size.sum())] = np.frombuffer(b"".join(parts), np.uint8)
        self.at[new], self.n[new], self.text_at[new] = self.used + np.cumsum(n) - n, n, self.text_used + np.cumsum(size) - size
        self.used, self.text_used, self.size = self.used + int(n.sum()), self.text_used + int(size.sum()), self.size + len(parts)
        return new

    def add(self, h: np.ndarray, new: np.ndarray) -> None:
        """Lets distinct hashes that aren't there lead to entries."""
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(h):
            free = np.flatnonzero(self.keys[slot] == 0)
            took, first = np.unique(slot[free], return_index=True)
            first = free[first]
            self.keys[took], self.entry[took] = h[first], new[first]
            rest = np.ones(len(h), bool)
            rest[first] = False
            h, new, slot = h[rest], new[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)

    def others(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, entry: np.ndarray) -> np.ndarray:
        """Which parts of data aren't, byte by byte, those of their entries. A part's hash has its length in it, but that proves nothing either."""
        begin = self.text_at[entry]
        stored = np.append(self.text_at[1 : self.size], self.text_used)[entry] - begin
        bad = stored != size
        n = np.where(bad, 0, size)
        ends = np.cumsum(n)
        step = np.arange(int(n.sum())) - np.repeat(ends - n, n)
        differ = np.flatnonzero(data[np.repeat(start, n) + step] != self.text[np.repeat(begin, n) + step])
        bad[np.searchsorted(ends, differ, "right")] = True
        return np.flatnonzero(bad)

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text; texts of about a chunk together."""
        out: list[np.ndarray] = []
        for lo, hi in chunks([len(t) for t in texts], TOGETHER):
            out += self._encode(texts[lo:hi])
        return out

    def _encode(self, texts: list[bytes]) -> list[np.ndarray]:
        whole = b"\n".join(texts) + b"\n"
        data = np.frombuffer(whole, np.uint8)
        size = np.array([len(t) for t in texts], np.int64)
        first = np.cumsum(size + 1) - size - 1
        white = _white[data]
        cut = np.flatnonzero((data[1:-1] == 32) & ~white[:-2] & ~white[2:]) + 1
        start = np.sort(np.concatenate([cut, first[size > 0]]))
        doc = np.searchsorted(first, start, "right") - 1
        end = np.minimum(np.append(start[1:], len(data)), (first + size)[doc])
        up, down = powers(len(data) + 1)
        total = np.concatenate([[np.uint64(0)], np.cumsum(data.astype(np.uint64) * up[: len(data)])])
        h = mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * STEP)
        h[h == 0] = 1
        entry = self.find(h)
        new = np.flatnonzero(entry < 0)
        if len(new):
            if self.size + len(new) > self.most:
                self.reset()
                new = np.arange(len(h))
            fresh, where = np.unique(h[new], return_index=True)
            where = new[where]
            self.add(fresh, self.keep([whole[a:b] for a, b in zip(start[where].tolist(), end[where].tolist(), strict=True)]))
            entry = self.find(h)
        if len(bad := self.others(data, start, end - start, entry)):
            parts = [whole[a:b] for a, b in zip(start[bad].tolist(), end[bad].tolist(), strict=True)]
            number = {p: i for i, p in enumerate(dict.fromkeys(parts))}
            entry[bad] = self.keep(list(number))[[number[p] for p in parts]]
        n = self.n[entry].astype(np.int64)
        ends = np.cumsum(n)
        ids = self.flat[np.repeat(self.at[entry] - (ends - n), n) + np.arange(int(n.sum()))]
        bounds = np.concatenate([[0], ends])[np.searchsorted(doc, np.arange(len(texts) + 1))]
        return [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
