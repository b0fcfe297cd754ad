"""SentencePiece encoding and decoding as shortest paths of a weighted transducer.

The normaliser (spaces become the space mark, one is put in front), the lexicon of pieces and the byte fallback are
compiled once (sp_model). Composing an input with them gives a lattice whose arcs are pieces; its tropical shortest path is the
encoding. Words start at spaces, which no piece holds inside, so the lattice falls apart into words: the distinct
unseen words of a chunk of texts are composed and solved together, by length, and remembered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, tidy
from .parts import Parts
from .sp_model import RAW, SPACE, START, Lexicon, lexicon

#: Parts of texts that a worker remembers with their ids, and the power of two of slots for them. Documents solved together.
PARTS, SLOTS, TOGETHER = 400_000, 20, 1000
#: Words up to this length are solved together with others of about their length; longer ones end to end, so many characters at once.
LONG, BLOCK = 64, 4096


def shortest_paths(lex: Lexicon, chars: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """chars: character numbers, a row for each word, filled up with 0. For each position the last piece of the best path to it and that piece's length."""
    n, length = chars.shape
    dist = np.full((n, length + 1), np.inf)
    last = np.full((n, length + 1), START, np.int32)
    back = np.zeros((n, length + 1), np.int16)
    dist[:, 0] = 0
    for s in range(length):
        lanes = np.flatnonzero(np.isfinite(dist[:, s]) & (size > s))
        node = np.zeros(len(lanes), np.int32)
        for k in range(1, min(lex.deepest, length - s) + 1):
            node = lex.step(node, chars[lanes, s + k - 1])
            piece = lex.term[node]
            if k == 1:  # a character without a piece of its own may be written as bytes
                arcs(lex, dist, last, back, lanes[piece < 0], np.full(int((piece < 0).sum()), RAW, np.int32), s, k)
            on = node >= 0
            lanes, node, piece = lanes[on], node[on], piece[on]
            if not len(lanes):
                break
            hit = piece >= 0
            arcs(lex, dist, last, back, lanes[hit], piece[hit], s, k)
    return last, back


def arcs(lex: Lexicon, dist: np.ndarray, last: np.ndarray, back: np.ndarray, lanes: np.ndarray, piece: np.ndarray, s: int, k: int) -> None:
    """Relaxes the arcs of length k from position s."""
    if not len(lanes):
        return
    weight = np.where(piece >= 0, lex.cost[np.maximum(piece, 0)], lex.raw_cost)
    weight[lex.barred(last[lanes, s], piece)] = np.inf
    new = dist[lanes, s] + weight
    better = new < dist[lanes, s + k]
    at = lanes[better]
    dist[at, s + k], last[at, s + k], back[at, s + k] = new[better], piece[better], k


def long_paths(lex: Lexicon, codes: list[np.ndarray]) -> list[tuple[list[int], list[int]]]:
    """Pieces of each word's best path (RAW: a character written as bytes) and where they end.

    The words stand end to end with a gap between them. Arcs are found from all starts of a block at once, and so are the barred pairs of
    arcs that meet in it; then each position's best arc is taken in order. Time and memory grow with the words' length only.
    """
    gap = np.zeros(1, np.int32)
    seq = np.concatenate([x for c in codes for x in (c, gap)])
    ends = np.cumsum([len(c) + 1 for c in codes]) - 1  # of each word: the place of its gap
    real = np.ones(len(seq), bool)
    real[ends] = False
    dist, last, back = [np.inf] * (len(seq) + 1), [START] * (len(seq) + 1), [0] * (len(seq) + 1)
    for s in [0, *(ends[:-1] + 1).tolist()]:
        dist[s] = 0.0
    over = [np.zeros(0, np.int64), np.zeros(0, np.int64)]  # arcs that end beyond the blocks so far: end, piece
    for lo in range(0, len(seq), BLOCK):
        hi = min(lo + BLOCK, len(seq))
        start = lo + np.flatnonzero(real[lo:hi])
        node = np.zeros(len(start), np.int32)
        found = []
        for k in range(1, lex.deepest + 1):
            fits = start + k <= len(seq)
            start, node = start[fits], node[fits]
            node = lex.step(node, seq[start + k - 1])
            piece = lex.term[node]
            if k == 1:
                found.append((start[piece < 0], np.full(int((piece < 0).sum()), 1), np.full(int((piece < 0).sum()), RAW)))
            hit = piece >= 0
            found.append((start[hit], np.full(int(hit.sum()), k), piece[hit]))
            start, node = start[node >= 0], node[node >= 0]
            if not len(start):
                break
        begin, size, piece = (np.concatenate(x).astype(np.int64) for x in zip(*found, strict=True))
        order = np.lexsort((size, begin))
        begin, size, piece = begin[order], size[order], piece[order]
        at, before = np.concatenate([over[0], begin + size]), np.concatenate([over[1], piece])
        by_end = np.argsort(at, kind="stable")
        at, before = at[by_end], before[by_end]
        first, n = np.searchsorted(at, begin), np.searchsorted(at, begin, "right") - np.searchsorted(at, begin)
        which = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        u, v = before[which], np.repeat(piece, n)
        pairs = np.unique((u << 20 | v)[(u >= 0) & (v >= 0)])
        bad = set(pairs[lex.barred(pairs >> 20, pairs & 0xFFFFF)].tolist())
        cost = np.where(piece >= 0, lex.cost[np.maximum(piece, 0)], lex.raw_cost)
        for s, k, p, c in zip(begin.tolist(), size.tolist(), piece.tolist(), cost.tolist(), strict=True):
            d = dist[s] + c
            if d < dist[s + k] and not (p >= 0 and last[s] >= 0 and last[s] << 20 | p in bad):
                dist[s + k], last[s + k], back[s + k] = d, p, k
        over = [at[at >= hi], before[at >= hi]]
    out = []
    for end, c in zip(ends.tolist(), codes, strict=True):
        path, at = [], end
        while at > end - len(c):
            path.append((last[at], at - end + len(c)))
            at -= back[at]
        path.reverse()
        out.append(([p for p, _ in path], [e for _, e in path]))
    return out


def encode_words(lex: Lexicon, words: list[str]) -> list[bytes]:
    """Ids of each word (no space but at its start), packed as int32."""
    out: list[bytes] = [b""] * len(words)
    size = np.array([len(w) for w in words])
    codes = lex.codes(words)
    start = size.cumsum() - size
    padded = np.concatenate([codes, np.zeros(LONG, codes.dtype)])
    if len(big := np.flatnonzero(size > LONG)):
        for i, (ids, ends) in zip(big.tolist(), long_paths(lex, [codes[start[i] : start[i] + size[i]] for i in big.tolist()]), strict=True):
            out[i] = np.array([y for p, e in zip(ids, ends, strict=True) for y in ([p] if p >= 0 else lex.raw(words[i][e - 1]))], np.int32).tobytes()
        size = np.where(size > LONG, 0, size)
    room = 1 << np.ceil(np.log2(np.maximum(size, 1))).astype(int)
    for length in np.unique(room[size > 0]).tolist():
        which = np.flatnonzero((room == length) & (size > 0))
        step = max(1, 500_000 // (length + 1))
        for lo in range(0, len(which), step):
            w = which[lo : lo + step]
            n = size[w]
            chars = np.where(np.arange(length) < n[:, None], padded[start[w][:, None] + np.arange(length)], 0)
            last, back = shortest_paths(lex, chars, n)
            at, row = n.copy(), np.arange(len(w))
            steps = []
            while len(row):
                steps.append((row, last[row, at], at))
                at = at - back[row, at]
                row, at = row[at > 0], at[at > 0]
            order = np.concatenate([r for r, _, _ in steps])
            ids = np.concatenate([p for _, p, _ in steps])
            ends = np.concatenate([a for _, _, a in steps])
            sort = np.lexsort((ends, order))
            ids, ends = ids[sort], ends[sort]
            bounds = np.searchsorted(order[sort], np.arange(len(w) + 1)).tolist()
            raw = ids == RAW
            rawish = np.zeros(len(w), bool)
            rawish[order[sort][raw]] = True
            for i, x in enumerate(w.tolist()):
                a, b = bounds[i], bounds[i + 1]
                if rawish[i]:
                    full: list[int] = []
                    for p, e in zip(ids[a:b].tolist(), ends[a:b].tolist(), strict=True):
                        full += [p] if p >= 0 else lex.raw(words[x][e - 1])
                    out[x] = np.array(full, np.int32).tobytes()
                else:
                    out[x] = ids[a:b].tobytes()
    return out


def normal(lex: Lexicon, text: str) -> str:
    """The text as the lexicon sees it: space marks are spaces, and one space is put in front."""
    text = text.replace(SPACE, " ")
    if lex.squeeze:
        text = " ".join(x for x in text.split(" ") if x)
    return " " + text if lex.dummy_prefix and text else text


def by_word(lex: Lexicon, new: list[bytes], solve: Callable[[Lexicon, list[str]], list], joined: Callable) -> list:
    """Solutions of parts of normalised texts, from those of their distinct words.

    A part is cut before each space, and its words where no piece reaches across (Lexicon.cut); joined(lex, words, found) puts a part together
    that has several words, which happens where spaces follow each other or stand beside a line feed.
    """
    words = []
    for x in new:
        parts = x.decode().split(" ")
        words.append(parts[:1] * bool(parts[0]) + [" " + y for y in parts[1:]])
    cut = {w: lex.cut(w) for ws in words for w in ws}
    small = list({x for xs in cut.values() for x in xs})
    known = dict(zip(small, solve(lex, small), strict=True))
    for w, xs in cut.items():
        if len(xs) > 1:
            got = known[xs[0]]
            for x in xs[1:]:
                got = got + known[x]
            known[w] = got
    return [known[ws[0]] if len(ws) == 1 and ws[0] != " " else joined(lex, ws, [known[w] for w in ws]) for ws in words]


def join_runs(lex: Lexicon, words: list[str], found: list[bytes]) -> bytes:
    """Ids of a text with several spaces in a row: those merge among themselves, after all else; a word's own space belongs to the run if it stayed alone."""
    one = np.int32(lex.runs[1]).tobytes()
    out, run = [], 0
    for w, f in zip(words, found, strict=True):
        if w == " ":
            run += 1
            continue
        if w[0] == " " and f[:4] == one:
            run, f = run + 1, f[4:]
        if run:
            out.append(np.array(lex.run(run), np.int32).tobytes())
            run = 0
        out.append(f)
    if run:
        out.append(np.array(lex.run(run), np.int32).tobytes())
    return b"".join(out)


_parts: dict[str, Parts] = {}


def encode_texts(path: str, texts: list[str]) -> list[np.ndarray]:
    """Ids of each text."""
    lex = lexicon(path)
    if path not in _parts:
        _parts[path] = Parts(np.int32, lambda new: [np.frombuffer(x, np.int32) for x in by_word(lex, new, encode_words, join_runs)], PARTS, SLOTS)
    return _parts[path].encode([normal(lex, t).encode() for t in texts])


def forget() -> None:
    """A worker goes on to other tasks, which need its memory."""
    _parts.clear()


_tables: dict[str, list] = {}


def decode_ids(path: str, ids: list[int]) -> str:
    """The text of ids: pieces end to end, byte pieces as UTF-8 (what isn't: U+FFFD), space marks as spaces, without the space put in front. Control pieces write nothing."""
    lex = lexicon(path)
    if path not in _tables:
        back = {i: b for b, i in lex.bytes.items()}
        _tables[path] = [bytes([back[i]]) if i in back else b" \xe2\x81\x87 " if t == 2 else b"" if t == 3 else p.replace(SPACE, " ").encode() for i, (p, t) in enumerate(zip(lex.pieces, lex.types, strict=True))]
    text = b"".join(map(_tables[path].__getitem__, ids)).decode("utf-8", "replace")
    return text[1:] if lex.dummy_prefix and text.startswith(" ") else text


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_pieces, ids, round_trip for each row: the ids of the whole text, and whether decoding them gives it back (space marks in a text come back as spaces).

    A null or empty text has no ids. Repeated rows are encoded each. No rows: no rows. Other columns don't come through. Map-only.
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
                found = encode_texts(model, texts)
                flat = np.concatenate(found)
                n = np.array([len(p) for p in found], np.int64)
                ends = np.concatenate([[0], n.cumsum()])
                same = [decode_ids(model, p.tolist()) == t.replace(SPACE, " ") for p, t in zip(found, texts, strict=True)]
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([x.column("doc_id"), pa.array(n), ids, pa.array(same, pa.bool_())], names=["doc_id", "n_pieces", "ids", "round_trip"])
        forget()

    return rows.mapInArrow(tidy(run), f"doc_id {kind}, n_pieces bigint, ids array<int>, round_trip boolean")


def decode(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text for each row of ids. Null ids give an empty text; an id outside the model raises."""
    ship(encoded.sparkSession)
    rows = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([decode_ids(model, x or []) for x in b.column("ids").to_pylist()], pa.string())], names=["doc_id", "text"])

    return rows.mapInArrow(run, f"doc_id {kind}, text string")
