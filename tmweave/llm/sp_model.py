"""A SentencePiece model compiled for lattice work: lexicon trie, byte fallback, and which pieces may stand side by side.

A unigram model's encoding is the path of pieces with the best sum of scores. A BPE model's is the only path on which no
two neighbours would have been merged: a pair (u, v) is barred if, while u and v are built up from characters, some right
edge of u and left edge of v are present together and form a piece that is merged before either edge is used up
inside its own piece. So both kinds are shortest paths; for BPE a barred pair weighs infinity and everything else nothing.
"""

from __future__ import annotations

import struct

import numpy as np

from .common import give_back

SPACE = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: States of a path other than the last piece: at its start, and after a character that only bytes can write.
START, RAW = -1, -2
FOREVER = 1 << 40
_cache: dict[str, "Lexicon"] = {}


def fields(data: bytes):
    """(number, value) of a protobuf message's fields; nested messages and strings stay bytes."""
    i = 0

    def varint() -> int:
        nonlocal i
        x = shift = 0
        while True:
            b = data[i]
            i += 1
            x |= (b & 127) << shift
            shift += 7
            if b < 128:
                return x

    while i < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            yield key >> 3, data[i : i + n]
            i += n
        elif kind == 5:
            yield key >> 3, data[i : i + 4]
            i += 4
        else:
            yield key >> 3, data[i : i + 8]
            i += 8


class Lexicon:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = f.read()
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.types: list[int] = []
        self.model, self.dummy_prefix, self.squeeze = UNIGRAM, True, True
        self.byte_fallback = False
        for k, v in fields(data):
            if k == 1:
                p = dict(fields(v))
                self.pieces.append(p[1].decode())
                self.scores.append(struct.unpack("<f", p.get(2, b"\0\0\0\0"))[0])
                self.types.append(p.get(3, NORMAL))
            elif k == 2:
                spec = dict(fields(v))
                self.model, self.byte_fallback = spec.get(3, UNIGRAM), bool(spec.get(35, 0))
            elif k == 3:
                spec = dict(fields(v))
                if spec.get(2):
                    raise NotImplementedError("models with a character map in their normaliser aren't supported")
                self.dummy_prefix, self.squeeze = bool(spec.get(3, 1)), bool(spec.get(4, 1))
        self.bytes = {int(p[1:-1], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t == BYTE}
        self.unk = self.types.index(UNKNOWN)
        texts = {p.replace(SPACE, " "): i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t in (NORMAL, USER)}
        if any(" " in p.lstrip(" ") or " " in p.rstrip(" ") and p.strip(" ") and not p.startswith(" ") for p in texts):
            raise NotImplementedError("pieces with white space inside aren't supported")
        self.ids = texts
        self.runs = {len(p): i for p, i in texts.items() if not p.strip(" ")}
        self.bigrams = {p[i : i + 2] for p in texts for i in range(len(p) - 1)}
        self.breaks_lines = not any("\n" in p for p in texts)
        if self.model == BPE:
            self._edges()
        self._trie()

    # which pieces may be neighbours -------------------------------------------------

    def merge(self, text: str) -> tuple[list[str], list[tuple[str, str, str]]]:
        """Plain BPE of a text: its symbols at the end, and the merges (left, right, both) in the order made."""
        s, made = list(text), []
        while True:
            best, at = None, -1
            for i in range(len(s) - 1):
                p = self.ids.get(s[i] + s[i + 1])
                if p is not None and (best is None or self.scores[p] > best):
                    best, at = self.scores[p], i
            if best is None:
                return s, made
            made.append((s[at], s[at + 1], s[at] + s[at + 1]))
            s[at : at + 2] = [s[at] + s[at + 1]]

    def _edges(self) -> None:
        order = sorted(self.ids.values(), key=lambda i: -self.scores[i])
        rank = {i: n for n, i in enumerate(order)}
        n = len(self.pieces)
        self.symbol = dict(self.ids)
        whole: dict[str, dict[str, tuple[str, str]]] = {}
        for text in list(self.ids):
            if len(text) > 1 and text.strip(" "):
                s, made = self.merge(text)
                if s != [text]:
                    del self.ids[text]  # no text is ever encoded with this piece
                    continue
                whole[text] = {m: (a, b) for a, b, m in made}
            for c in text:
                if c not in self.symbol:
                    self.symbol[c] = n
                    n += 1
        born = lambda t: rank[self.symbol[t]] if len(t) > 1 else -1
        spine: dict[int, dict[int, list]] = {0: {}, 1: {}}
        for text, i in self.ids.items():
            tree = whole.get(text, {})
            for side in (0, 1):  # 0: left edges, 1: right edges
                t, death, out = text, FOREVER, []
                while True:
                    out.append((self.symbol[t], born(t), death))
                    if t not in tree:
                        break
                    death, t = born(t), tree[t][side]
                spine[side][i] = out
        deep = max(len(x) for s in spine.values() for x in s.values())
        fill = (-1, FOREVER, -1)
        make = lambda side: np.array([spine[side].get(i, []) + [fill] * (deep - len(spine[side].get(i, []))) for i in range(len(self.pieces))], np.int64)
        self.left, self.right = make(0), make(1)
        pairs = {}
        for text, i in self.symbol.items():
            if i < len(self.pieces) and len(text) > 1 and text.strip(" "):
                for k in range(1, len(text)):
                    a, b = self.symbol.get(text[:k]), self.symbol.get(text[k:])
                    if a is not None and b is not None:
                        pairs[a << 20 | b] = rank[i]
        keys = np.array(sorted(pairs), np.int64)
        self.pair_keys, self.pair_rank = keys, np.array([pairs[k] for k in keys.tolist()], np.int64)
        self.memo_key = np.full(1 << 20, -1, np.int64)
        self.memo = np.zeros(1 << 20, bool)

    def _barred(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        out = np.zeros(len(u), bool)
        right, left = self.right[u], self.left[v]
        for i in range(right.shape[1]):
            r = right[:, i]
            for j in range(left.shape[1]):
                x = left[:, j]
                on = np.flatnonzero((r[:, 0] >= 0) & (x[:, 0] >= 0) & ~out)
                if not len(on):
                    break
                key = r[on, 0] << 20 | x[on, 0]
                at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
                hit = self.pair_keys[at] == key
                on, when = on[hit], self.pair_rank[at[hit]]
                when = np.maximum(when, np.maximum(r[on, 1], x[on, 1]))
                out[on] |= (when < r[on, 2]) & (when <= x[on, 2])
        return out

    def barred(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """For each pair whether it can't occur; u may also be START or RAW. Unigram models bar nothing."""
        out = np.zeros(len(u), bool)
        if self.model != BPE:
            return out
        real = np.flatnonzero((u >= 0) & (v >= 0))
        key = u[real].astype(np.int64) << 20 | v[real]
        slot = (key * 0x9E3779B1 >> 7) & (len(self.memo) - 1)
        new = np.flatnonzero(self.memo_key[slot] != key)
        got = self.memo[slot]
        if len(new):
            fresh, back = np.unique(key[new], return_inverse=True)
            bad = self._barred(fresh >> 20, fresh & 0xFFFFF)
            got[new] = bad[back]
            where = (fresh * 0x9E3779B1 >> 7) & (len(self.memo) - 1)
            self.memo_key[where], self.memo[where] = fresh, bad
        out[real] = got
        return out

    # lexicon ------------------------------------------------------------------------

    def _trie(self) -> None:
        edges: dict[tuple[int, str], int] = {}
        term = [-1]
        chars = sorted({c for p in self.ids for c in p})
        self.char = {c: i + 1 for i, c in enumerate(chars)}
        for p, i in self.ids.items():
            if len(p) > 1 and not p.strip(" "):
                continue  # runs of spaces are encoded by themselves
            node = 0
            for c in p:
                nxt = edges.get((node, c))
                if nxt is None:
                    nxt = edges[node, c] = len(term)
                    term.append(-1)
                node = nxt
            term[node] = i
        self.width = len(chars) + 1
        keys = sorted((n * self.width + self.char[c], to) for (n, c), to in edges.items())
        self.edge_key = np.array([k for k, _ in keys], np.int64)
        self.edge_to = np.array([t for _, t in keys], np.int32)
        self.term = np.array([*term, -1], np.int32)
        self.deepest = max(len(p) for p in self.ids if p.strip(" "))
        self.code = np.zeros(0x110000, np.int32)
        self.code[[ord(c) for c in chars]] = [self.char[c] for c in chars]
        self.cost = -np.array(self.scores, np.float64) if self.model == UNIGRAM else np.zeros(len(self.scores))
        self.raw_cost = 10.0 - min(self.scores) if self.model == UNIGRAM else 0.0

    def step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """Children in the trie; -1 where there is none."""
        key = node.astype(np.int64) * self.width + char
        at = np.minimum(np.searchsorted(self.edge_key, key), len(self.edge_key) - 1)
        return np.where((self.edge_key[at] == key) & (node >= 0) & (char > 0), self.edge_to[at], -1)

    def codes(self, words: list[str]) -> np.ndarray:
        """Character numbers of words, end to end; 0 for characters that no piece has."""
        return self.code[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)]

    def run(self, n: int) -> list[int]:
        """Ids of a run of n spaces: what plain BPE makes of it; as all its merges weigh the same, the leftmost comes first."""
        out, s = [], [1] * min(n, 64)
        longest = max(self.runs, default=1)
        left = n - len(s)
        while True:
            i = next((i for i in range(len(s) - 1) if s[i] + s[i + 1] in self.runs), None)
            if i is None:
                if not left:
                    break
                s.append(1)
                left -= 1
                continue
            s[i : i + 2] = [s[i] + s[i + 1]]
            while len(s) > 1 and s[0] == longest:
                out.append(self.runs[longest])
                s.pop(0)
                if left:
                    s.append(1)
                    left -= 1
        return out + [self.runs[x] for x in s]

    def cut(self, word: str) -> list[str]:
        """Parts of a word that can be solved apart: lines, if no piece holds a line feed, and, in long words, wherever no piece holds the two characters."""
        if "\n" in word and self.breaks_lines:
            out = []
            for x in word.split("\n"):
                out += ["\n", *self.cut(x)] if x else ["\n"]
            return out[1:]
        if len(word) <= 48:
            return [word]
        ends = [i + 1 for i in range(len(word) - 1) if word[i : i + 2] not in self.bigrams]
        return [word[a:b] for a, b in zip([0, *ends], [*ends, len(word)], strict=True)]

    def raw(self, c: str) -> list[int]:
        return [self.bytes[b] for b in c.encode("utf-8", "replace")] if self.byte_fallback else [self.unk]


def lexicon(path: str) -> Lexicon:
    """Compiled once in each worker."""
    if path not in _cache:
        _cache[path] = Lexicon(path)
        give_back()  # compiling takes more memory than what stays
    return _cache[path]
