"""Alignment of two tokenizers' tokens over the same bytes, and how often their ids are linked in the corpus.

Both encodings of a text are rows of byte ranges. Places where tokens of both end cut them into groups, found by divide and
conquer: in each interval the ends of the one near its middle are looked up among the other's ends by bisection, outward from the
middle, until one is common; both halves go on, and an interval without a cut inside is a group. All intervals of a chunk of documents take a step
together. Tokens whose ranges overlap are linked.

Counts over the corpus need two passes over links. The first writes chunks of documents' links, as numbers into the chunk's own list of distinct
pairs; only those lists, with counts, are shuffled, summed and sent back to their chunks, where documents' sums are taken.
"""

from __future__ import annotations

import ctypes
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, ship, stage
from .parts import Parts
from .shingles import chunks
from .sp_model import SPACE, fields
from .token_records import Encoder

#: Bytes of texts aligned together; a longer text is a chunk alone. Chunks of about so many links are written together.
TOGETHER, LINKS = 1 << 19, 500_000
#: Distinct parts of texts that a worker remembers with the ids of either, and the power of two of slots for them. Rows of a batch that are unpacked at once.
REMEMBER, SLOTS, ROWS = 500_000, 20, 500
#: Tokens of a text that are written out at once.
STRETCH = 1 << 16
#: An id pair as one number: the one's id, shifted, and the other's.
SHIFT = 32

DOCS = ["n_a", "n_b", "n_groups", "n_links"]
CHUNK = "chunk string, docs binary, sizes binary, links binary, pairs binary, pair_n binary"

_state: dict[tuple, object] = {}


class ByteTokens:
    """A byte-level BPE of the tokenizers library; special tokens' strings inside texts are plain text."""

    def __init__(self, path: str):
        self.encoder = Encoder(path)
        self.encoder.whole.encode_special_tokens = True
        self.forget()
        back = {c: b for b, c in self.encoder.letters.items()}
        entry = [self.encoder.whole.id_to_token(i) or "" for i in range(self.encoder.size)]
        self.bytes = [bytes(back[c] for c in t) if all(c in back for c in t) else t.encode() for t in entry]

    def forget(self) -> None:
        self.encoder.parts = Parts(self.encoder.kind, lambda new: [self.encoder.part(x) for x in new], REMEMBER, SLOTS)
        self.encoder.words, self.encoder.older = {}, {}

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [x.astype(np.int32) for x in self.encoder.ids([" " + t for t in texts])]


class Pieces:
    """A SentencePiece model that puts a space in front of a text.

    Where it changes nothing else and pieces hold spaces at their start only, no piece reaches across a space between two other characters,
    and texts are cut there into parts that are remembered. Other models encode texts whole.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.sp.get_piece_size()
        pieces = self.sp.id_to_piece(list(range(n)))
        self.bytes = [bytes([int(p[3:5], 16)]) if self.sp.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        with open(path, "rb") as f:
            spec = {k: dict(fields(v)) for k, v in fields(f.read()) if k == 3}.get(3, {})
        kept = not spec.get(2) and spec.get(3, 1) and not spec.get(4, 1)
        self.plain = bool(kept) and not any(SPACE in p.lstrip(SPACE) for p in pieces)
        self.forget()

    def forget(self) -> None:
        self.parts = Parts(np.int32, self.solve, REMEMBER, SLOTS)

    def solve(self, parts: list[bytes]) -> list[np.ndarray]:
        """Pieces of parts, each of which starts with a space: the one that the model itself puts in front."""
        return [np.array(x, np.int32) for x in self.sp.encode([p[1:].decode() for p in parts], num_threads=1)]

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        if not self.plain:
            return [np.array(x, np.int32) for x in self.sp.encode(texts, num_threads=1)]
        # a mark of its own would be taken for a space's, so such a text's parts aren't the model's
        odd = [SPACE in t or not t for t in texts]
        plain = iter(self.parts.encode([(" " + t).encode() for t, o in zip(texts, odd, strict=True) if not o]))
        return [np.array(self.sp.encode(t), np.int32) if o else next(plain) for t, o in zip(texts, odd, strict=True)]


def tokens(kind: type, path: str):
    """One of each kind and file in a worker."""
    if (kind, path) not in _state:
        _state[kind, path] = kind(path)
    return _state[kind, path]


def common_ends(a: np.ndarray, b: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Places in a (ascending ends of one's tokens) whose ends are in b (the other's), ascending. docs: places in a of documents' last tokens, which are common.

    An interval (lo, hi] of places ends in a common end; its inner places are lo+1 .. hi-1. From the middle outward places are looked up until
    one is common. Intervals take turns: each that has found a cut is replaced by its halves, each that has looked at all its inner places is a group.
    """
    cut = np.zeros(len(a), bool)
    cut[docs] = True
    lo, hi = np.concatenate([[-1], docs[:-1]]), docs.copy()
    away = np.zeros(len(lo), np.int64)
    while len(lo):
        # the place to look at: the middle, then one to the right, one to the left, two to the right, ...
        at = (lo + hi + 1) // 2 + np.where(away % 2, (away + 1) // 2, -(away // 2))
        inside = (at > lo) & (at < hi)
        over = away > hi - lo
        look = np.where(inside, at, hi)
        end = a[look]
        found = inside & (b[np.minimum(np.searchsorted(b, end), len(b) - 1)] == end)
        cut[look[found]] = True
        on = ~found & ~over
        big_left, big_right = found & (look - lo > 1), found & (hi - look > 1)
        lo, hi, away = (
            np.concatenate([lo[on], lo[big_left], look[big_right]]),
            np.concatenate([hi[on], look[big_left], hi[big_right]]),
            np.concatenate([away[on] + 1, np.zeros(int(big_left.sum()) + int(big_right.sum()), np.int64)]),
        )
    return np.flatnonzero(cut)


class Aligned:
    """Groups and links of a chunk of texts.

    ok: which texts have tokens. Of all tokens end to end: n_a, n_b (of each text), groups' last places in a and b, links as places in a and b.
    """

    def __init__(self, one: ByteTokens, other: Pieces, texts: list[str]):
        self.one, self.other = one, other
        self.a, self.b, self.ok = [], [], []
        none = np.zeros(0, np.int32)
        for t, a, b in zip(texts, one.ids(texts), other.ids(texts), strict=True):
            raw = b" " + t.encode()
            same = bool(t) and spells(one.bytes, a, raw) and spells(other.bytes, b, raw)
            self.ok.append(same)
            self.a.append(a if same else none)
            self.b.append(b if same else none)
        self.n_a, self.n_b = (np.array([len(x) for x in xs], np.int64) for xs in (self.a, self.b))
        self.flat_a, self.flat_b = np.concatenate([*self.a, none]), np.concatenate([*self.b, none])
        del self.a, self.b
        end_a, end_b = np.cumsum(sizes(one)[self.flat_a]), np.cumsum(sizes(other)[self.flat_b])
        docs = (np.cumsum(self.n_a) - 1)[self.n_a > 0]
        self.group_a = common_ends(end_a, end_b, docs) if len(end_a) else none
        self.group_b = np.searchsorted(end_b, end_a[self.group_a])
        # each stretch between two neighbouring ends of either lies in one token of each, and no two such stretches in the same two
        ends = np.concatenate([end_a, end_b])
        ends.sort(kind="stable")
        ends = ends[np.append(True, ends[1:] != ends[:-1])] if len(ends) else ends
        self.link_a, self.link_b = np.searchsorted(end_a, ends).astype(np.int32), np.searchsorted(end_b, ends).astype(np.int32)
        del ends
        self.text_of_a = np.repeat(np.arange(len(texts), dtype=np.int32), self.n_a)
        self.n_groups = np.bincount(self.text_of_a[self.group_a], minlength=len(texts))
        self.n_links = np.bincount(self.text_of_a[self.link_a], minlength=len(texts))

    def pairs(self) -> np.ndarray:
        return self.flat_a[self.link_a].astype(np.int64) << SHIFT | self.flat_b[self.link_b]

    def digests(self) -> list[str]:
        """SHA-256 of each text's groups as text (ids of the one, |, ids of the other, ; between groups); '' where there are none."""
        words, width = labels(self.one, self.other)
        inner_a, inner_b = np.ones(len(self.flat_a), np.int32), np.ones(len(self.flat_b), np.int32)
        inner_a[self.group_a], inner_b[self.group_b] = 0, 0
        # where a token stands when the groups are written: after all tokens of its side and of the other side's earlier groups
        group_of_a = np.searchsorted(self.group_a, np.arange(len(self.flat_a)))
        group_of_b = np.searchsorted(self.group_b, np.arange(len(self.flat_b)))
        before_b = np.concatenate([[0], self.group_b + 1])
        at = np.empty(len(self.flat_a) + len(self.flat_b), np.int32)
        at[np.arange(len(self.flat_a)) + before_b[group_of_a]] = self.flat_a * 2 + inner_a
        at[np.arange(len(self.flat_b)) + self.group_a[group_of_b] + 1] = width + self.flat_b * 2 + inner_b
        ends, out = np.cumsum(self.n_a + self.n_b).tolist(), []
        for lo, hi in zip([0, *ends], ends, strict=False):
            sha = hashlib.sha256()
            for i in range(lo, hi, STRETCH):
                text = "".join(map(words.__getitem__, at[i : min(i + STRETCH, hi)].tolist()))
                sha.update((text if i + STRETCH < hi else text[:-1]).encode())
            out.append(sha.hexdigest() if hi > lo else "")
        return out


def spells(table: list[bytes], ids: np.ndarray, raw: bytes) -> bool:
    """Whether the bytes of ids, end to end, are these."""
    at = 0
    for i in range(0, len(ids), STRETCH):
        piece = b"".join(map(table.__getitem__, ids[i : i + STRETCH].tolist()))
        if raw[at : at + len(piece)] != piece:
            return False
        at += len(piece)
    return at == len(raw)


def sizes(kind: ByteTokens | Pieces) -> np.ndarray:
    if ("sizes", id(kind)) not in _state:
        _state["sizes", id(kind)] = np.array([len(x) for x in kind.bytes], np.int64)
    return _state["sizes", id(kind)]


def labels(one: ByteTokens, other: Pieces) -> tuple[list[str], int]:
    """What is written for a token: its id and a mark, which is the group's or the text's for the last in its group."""
    if ("labels", id(one), id(other)) not in _state:
        n = len(one.bytes)
        _state["labels", id(one), id(other)] = [f"{i}{m}" for i in range(n) for m in "|,"] + [f"{i}{m}" for i in range(len(other.bytes)) for m in ";,"], 2 * n
    return _state["labels", id(one), id(other)]


def forget() -> None:
    """What a worker remembers of texts goes, and its memory back to the system: it goes on to other tasks, or waits beside workers that need it."""
    for x in _state.values():
        if isinstance(x, ByteTokens | Pieces):
            x.forget()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def align_texts(byte_file: str, piece_file: str, texts: list[str]) -> Aligned:
    return Aligned(tokens(ByteTokens, byte_file), tokens(Pieces, piece_file), texts)


def align(docs: DataFrame, byte_file: str, piece_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row.

    Tokens of the one (byte_file) are of a space and the text, of the other (piece_file) of the text, in front of which it puts that space. A text that is null or empty, or whose
    tokens of either kind don't make up those bytes again, has no tokens: zeros and an empty string. Repeated rows are aligned, and count, each. Null ids stay. No rows: no rows.
    Other columns don't come through. Long texts are aligned whole; a worker holds a chunk of about LINKS links, or one text's.

    A pair's count is how many links hold it, over all rows; of an id's pairs those with its highest count are its best.
    """
    written = stage(chunk_rows(docs, byte_file, piece_file, id_col, text_col), "alignments")
    counts = stage(pair_counts(written), "alignment-counts")
    out = stage(with_counts(written, counts, dict(docs.dtypes)[id_col]), "aligned")
    discard(written, counts)
    return out


def chunk_rows(docs: DataFrame, byte_file: str, piece_file: str, id_col: str, text_col: str) -> DataFrame:
    """A row for each chunk: its documents' columns (docs), how many links each has (sizes), those as numbers of pairs (links), the distinct pairs, most frequent first, and their counts."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, cols, pairs, held = [], [], [], 0

        def packed() -> pa.RecordBatch:
            keys, number, n = np.unique(np.concatenate(pairs), return_inverse=True, return_counts=True)
            order = np.argsort(-n, kind="stable")
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order))
            kind = np.uint16 if len(keys) <= 1 << 16 else np.int32
            whole = [np.concatenate(c) for c in zip(*cols, strict=True)]
            table = pa.table([pa.concat_arrays(ids), *map(pa.array, whole)], names=["doc_id", *DOCS, "groups_sha256"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as w:
                w.write_table(table)
            data = [sink.getvalue().to_pybytes(), whole[3].astype(np.int64).tobytes(), rank[number].astype(kind).tobytes(), keys[order].tobytes(), n[order].astype(np.int64).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), *(pa.array([x], pa.binary()) for x in data)], names=[c.split()[0] for c in CHUNK.split(", ")])

        for x in (b.slice(lo, ROWS) for b in batches for lo in range(0, b.num_rows, ROWS)):
            texts = x.column("text").to_pylist()
            for lo, hi in chunks([len(t) for t in texts], TOGETHER):
                found = align_texts(byte_file, piece_file, texts[lo:hi])
                ids.append(x.column("doc_id").slice(lo, hi - lo))
                cols.append((found.n_a, found.n_b, found.n_groups, found.n_links, np.array(found.digests(), object)))
                pairs.append(found.pairs())
                held += len(pairs[-1])
                if held >= LINKS:
                    yield packed()
                    ids, cols, pairs, held = [], [], [], 0
        if ids:
            yield packed()
        forget()

    return rows.mapInArrow(run, CHUNK)


def pair_counts(written: DataFrame) -> DataFrame:
    """pair, n, best (whether no pair of the same id of the other has more): one row for each pair of ids that is linked somewhere, however large the corpus."""
    spark = written.sparkSession
    ship(spark)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, n in zip(b.column("pairs").to_pylist(), b.column("pair_n").to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(k, np.int64)), pa.array(np.frombuffer(n, np.int64))], names=["pair", "n"])

    sums = written.select("pairs", "pair_n").mapInArrow(each, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    other = F.col("pair").bitwiseAND(F.lit((1 << SHIFT) - 1))
    return sums.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy(other)))


def with_counts(written: DataFrame, counts: DataFrame, id_type: str) -> DataFrame:
    """Documents of chunks, with the sums over their links. A chunk gets the counts of its own pairs only."""

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c, k in zip(b.column("chunk").to_pylist(), b.column("pairs").to_pylist(), strict=True):
                keys = np.frombuffer(k, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([c] * len(keys), pa.string()), pa.array(np.arange(len(keys), dtype=np.int32)), pa.array(keys)], names=["chunk", "nth", "pair"])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                get = lambda c: b.column(c)[row].as_py()  # noqa: B023, E731
                docs = pa.ipc.open_stream(get("docs")).read_all()
                size = np.frombuffer(get("sizes"), np.int64)
                known = b.column("known").slice(row, 1).flatten()
                nth = known.field("nth").to_numpy()
                n, best = np.zeros(len(nth), np.int64), np.zeros(len(nth), np.int64)
                n[nth], best[nth] = known.field("n").to_numpy(), known.field("best").to_numpy(zero_copy_only=False)
                links = np.frombuffer(get("links"), np.uint16 if len(nth) <= 1 << 16 else np.int32)
                ends = np.concatenate([[0], np.cumsum(size)])
                over = lambda x: np.diff(np.concatenate([[0], np.cumsum(x[links])])[ends])  # noqa: B023, E731
                cols = [docs.column(c).combine_chunks() for c in ["doc_id", *DOCS]] + [pa.array(over(best)), pa.array(over(n)), docs.column("groups_sha256").combine_chunks()]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    names = ["doc_id", *DOCS, "n_best", "count_sum", "groups_sha256"]
    looked = written.select("chunk", "pairs").mapInArrow(asked, "chunk string, nth int, pair bigint").join(counts, "pair")
    known = looked.groupBy("chunk").agg(F.collect_list(F.struct("nth", "n", "best")).alias("known"))
    rows = written.select("chunk", "docs", "sizes", "links").join(known, "chunk", "left").withColumn("known", F.coalesce("known", F.array().cast("array<struct<nth:int,n:bigint,best:boolean>>")))
    return rows.mapInArrow(sums, f"doc_id {id_type}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string")
