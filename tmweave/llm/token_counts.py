"""Token counts by dynamic programming shared along a trie.

The distinct words of a batch are inserted in a trie, level by level. For each node, that is each distinct prefix, the forward
score (best sum of piece scores of a segmentation of the prefix), its last piece and its number of pieces are computed
once from the nodes above it; a word's count is its last node's. For BPE models a segmentation may only hold
neighbours that the merges would leave apart (sp_model), which makes the counts those of the model's own encoder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship
from .parts import Parts
from .sentencepiece_wfst import LONG, PARTS, SLOTS, TOGETHER, by_word, long_paths, normal
from .sp_model import RAW, START, Lexicon, lexicon


class Count(int):
    """A number of pieces whose sum keeps whether the first of them is a lone space, for texts with several spaces in a row."""

    def __new__(cls, n: int = 0, lone: bool = False):
        x = super().__new__(cls, n)
        x.lone = lone
        return x

    def __add__(self, other: int) -> Count:
        return Count(int(self) + int(other), self.lone)


def count_words(lex: Lexicon, words: list[str]) -> list[Count]:
    """Number of pieces of each word."""
    size = np.array([len(w) for w in words])
    codes, points = lex.codes(words), np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    start = size.cumsum() - size
    deep = lex.deepest
    # the root: node 0. above[k]: the node k steps up; walk[k]: where the last k characters lead in the lexicon
    above = np.zeros((1, deep + 1), np.int64)
    above[:, 1:] = -1
    walk = np.full((1, deep + 1), -1, np.int32)
    walk[:, 0] = 0
    total, first = 1, 0
    at = np.zeros(len(words), np.int64)
    most = 1 + int(size.sum())
    all_score, all_last, all_count, all_lone = np.zeros(most), np.full(most, START, np.int32), np.zeros(most, np.int64), np.zeros(most, bool)
    space = lex.runs.get(1, -3)
    for d in range(int(size.max(initial=0))):
        live = np.flatnonzero(size > d)
        key = (at[live] - first) << 21 | points[start[live] + d]
        nodes, where, index = np.unique(key, return_index=True, return_inverse=True)
        parent, char = nodes >> 21, codes[start[live[where]] + d]
        new_above = np.concatenate([np.arange(total, total + len(nodes))[:, None], above[parent][:, :-1]], 1)
        new_walk = np.full((len(nodes), deep + 1), -1, np.int32)
        new_walk[:, 0] = 0
        best = np.full(len(nodes), np.inf)
        new_last = np.full(len(nodes), RAW, np.int32)
        new_count = np.zeros(len(nodes), np.int64)
        new_lone = np.zeros(len(nodes), bool)
        for k in range(1, deep + 1):
            on = np.flatnonzero((walk[parent, k - 1] >= 0) & (new_above[:, k] >= 0))
            if not len(on):
                continue
            to = lex.step(walk[parent[on], k - 1], char[on])
            new_walk[on, k] = to
            piece = lex.term[to]
            if k == 1:
                piece = np.where(piece >= 0, piece, RAW)
            hit = (piece >= 0) | (piece == RAW)
            on, piece = on[hit], piece[hit]
            up = new_above[on, k]
            ok = ~lex.barred(all_last[up], piece)
            weight = np.where(piece >= 0, lex.cost[np.maximum(piece, 0)], lex.raw_cost)
            value = all_score[up] + weight
            ok &= value < best[on]
            on, piece, up, value = on[ok], piece[ok], up[ok], value[ok]
            p = points[start[live[where[on]]] + d].astype(np.int64)
            wide = 1 + (p > 0x7F) + (p > 0x7FF) + (p > 0xFFFF)
            best[on], new_last[on] = value, piece
            new_count[on] = all_count[up] + np.where(piece >= 0, 1, wide if lex.byte_fallback else 1)
            new_lone[on] = np.where(up == 0, piece == space, all_lone[up])
        made = slice(total, total + len(nodes))
        all_score[made], all_last[made], all_count[made], all_lone[made] = best, new_last, new_count, new_lone
        at[live] = total + index
        first, total = total, total + len(nodes)
        above, walk = new_above, new_walk
    return [Count(n, x) for n, x in zip(all_count[at].tolist(), all_lone[at].tolist(), strict=True)]


def solve(lex: Lexicon, words: list[str]) -> list[Count]:
    """Counts of words, at most so many characters together that the trie's tables stay small. Long words, which share little, are solved end to end."""
    out: list[Count] = [Count()] * len(words)
    big = [i for i, w in enumerate(words) if len(w) > LONG]
    if big:
        space = lex.runs.get(1, -3)
        for i, (ids, ends) in zip(big, long_paths(lex, [lex.codes([words[i]]) for i in big]), strict=True):
            out[i] = Count(sum(1 if p >= 0 else len(lex.raw(words[i][e - 1])) for p, e in zip(ids, ends, strict=True)), ids[0] == space)
    order = sorted((i for i in range(len(words)) if len(words[i]) <= LONG), key=words.__getitem__)
    lo = 0
    while lo < len(order):
        hi, chars = lo, 0
        while hi < len(order) and (hi == lo or chars + len(words[order[hi]]) <= 400_000):
            chars += len(words[order[hi]])
            hi += 1
        for i, c in zip(order[lo:hi], count_words(lex, [words[i] for i in order[lo:hi]]), strict=True):
            out[i] = c
        lo = hi
    return out


def with_runs(lex: Lexicon, parts: list[str], found: list[Count]) -> int:
    n = run = 0
    for w, f in zip(parts, found, strict=True):
        if w == " ":
            run += 1
            continue
        if w[0] == " " and f.lone:
            run, f = run + 1, int(f) - 1
        if run:
            n, run = n + len(lex.run(run)), 0
        n += f
    return n + (len(lex.run(run)) if run else 0)


_parts: dict[str, Parts] = {}


def count_texts(path: str, texts: list[str]) -> list[int]:
    """Number of pieces of each text."""
    lex = lexicon(path)
    if path not in _parts:
        _parts[path] = Parts(np.int64, lambda new: [np.array([x], np.int64) for x in by_word(lex, new, solve, with_runs)], PARTS, SLOTS)
    return [int(x.sum()) for x in _parts[path].encode([normal(lex, t).encode() for t in texts])]


def forget() -> None:
    """A worker goes on to other tasks, which need its memory."""
    _parts.clear()


def token_counts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, n_tokens for each row, over the whole text.

    A null or empty text has 0 tokens. Repeated rows are counted each. No rows: no rows. Other columns don't come through. Map-only.
    Long texts, and long texts without a space, are read whole, in time and memory that grow with their length.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, TOGETHER):
                x = b.slice(lo, TOGETHER)
                texts = x.column("text").to_pylist()
                n = count_texts(model, texts)
                yield pa.RecordBatch.from_arrays([x.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "n_chars", "n_tokens"])
        forget()

    return rows.mapInArrow(run, f"doc_id {kind}, n_chars bigint, n_tokens bigint")
