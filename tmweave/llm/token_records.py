"""Token ids as length-delimited binary records with an offset index.

A file holds frames: length of the record (uint64), masked CRC-32C of those 8 bytes, the record, masked CRC-32C of the
record, all little-endian. A record is the document's id (int64), the width of its ids in bytes (uint8) and
the ids: 16-bit ones where the vocabulary allows, else 32-bit. Beside the files stands an index table with
each record's file, place, length and number of ids, so that a reader can shuffle records and fetch each by one range read.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, ship, stage
from .files import Ranges, Writer
from .parts import Parts

END_ID = 2
#: Bytes of records that a task reads back, about; what it reads in one go.
READ, PIECE = 64 << 20, 4 << 20
#: Parts of texts, and pre-tokens, that a worker remembers with their ids (of pre-tokens: a newer and an older set of so many).
PARTS, WORDS = 2_500_000, 150_000
#: The reflected CRC-32C polynomial and the constant that masks checksums in this record format.
POLYNOMIAL, MASK = 0x82F63B78, 0xA282EAD8
STEP = 64
#: How byte-level BPE splits a text before its merges.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: What a tokenizer file says if that is how it splits.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}

#: Marks of which a run is a pre-token of its own after a word.
MARKS = ",.;:!?#$%&*"
#: White space that isn't ASCII.
RARE_SPACE = r"[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

_state: dict[str, object] = {}


def crc_tables() -> tuple[np.ndarray, np.ndarray]:
    """One byte's step, and the step over STEP zero bytes for each byte of the register."""
    if "crc" not in _state:
        one = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            one = np.where(one & 1, (one >> 1) ^ np.uint32(POLYNOMIAL), one >> 1).astype(np.uint32)
        far = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * i) for i in range(4)])
        for _ in range(STEP):
            far = one[far & 255] ^ (far >> np.uint32(8))
        _state["crc"] = one, far
    return _state["crc"]


def crc32c(chunks: list[bytes]) -> np.ndarray:
    """CRC-32C of each chunk. All chunks' blocks of STEP bytes advance together; each chunk's blocks are then folded up.

    Zeros in front don't change a register that starts at 0, so chunks are padded there; the register's
    start value is brought in by inverting the first four bytes.
    """
    one, far = crc_tables()
    sizes = np.array([max(4, len(c)) for c in chunks], np.int64)
    if not len(chunks):
        return np.zeros(0, np.uint32)
    blocks = -(-sizes // STEP)
    data = np.zeros(int(blocks.sum()) * STEP, np.uint8)
    ends = blocks.cumsum() * STEP
    for c, end in zip(chunks, ends.tolist(), strict=True):
        if len(c) < 4:  # too short for the inversion: byte by byte
            continue
        data[end - len(c) : end] = np.frombuffer(c, np.uint8)
        data[end - len(c) : end - len(c) + 4] ^= 255
    data = np.ascontiguousarray(data.reshape(-1, STEP).T)
    crc = np.zeros(data.shape[1], np.uint32)
    for row in data:
        crc = one[(crc ^ row) & 255] ^ (crc >> np.uint32(8))
    order = np.argsort(-blocks, kind="stable")
    begin, count = (ends // STEP - blocks)[order], blocks[order]
    total, alive = np.zeros(len(chunks), np.uint32), len(chunks)
    for i in range(int(count[0])):
        while count[alive - 1] <= i:
            alive -= 1
        t = total[:alive]
        total[:alive] = far[0][t & 255] ^ far[1][(t >> 8) & 255] ^ far[2][(t >> 16) & 255] ^ far[3][t >> 24] ^ crc[begin[:alive] + i]
    # chunks of unequal length fold their blocks from the front, so each is complete after its own number of steps
    out = np.empty(len(chunks), np.uint32)
    out[order] = total
    out ^= np.uint32(0xFFFFFFFF)
    for i, c in enumerate(chunks):
        if len(c) < 4:
            x = 0xFFFFFFFF
            for y in c:
                x = int(one[(x ^ y) & 255]) ^ (x >> 8)
            out[i] = x ^ 0xFFFFFFFF
    return out


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK)


def frames(records: list[bytes]) -> list[bytes]:
    heads = [struct.pack("<Q", len(r)) for r in records]
    sums = masked(crc32c(heads + records))
    n = len(records)
    return [h + a.tobytes() + r + b.tobytes() for h, r, a, b in zip(heads, records, sums[:n], sums[n:], strict=True)]


def unframed(data: list[bytes]) -> list[bytes]:
    """Records of frames; a wrong length or checksum raises."""
    heads = [x[:8] for x in data]
    records = [x[12:-4] for x in data]
    sums = masked(crc32c(heads + records))
    n = len(data)
    for x, r, a, b in zip(data, records, sums[:n].tolist(), sums[n:].tolist(), strict=True):
        if struct.unpack("<QI", x[:12]) != (len(r), a) or struct.unpack("<I", x[-4:])[0] != b:
            raise ValueError("a record's length or checksum is wrong")
    return records


class Encoder:
    """A byte-level BPE vocabulary of the tokenizers library, each distinct part of texts encoded once while it is remembered.

    A space between two non-white-space characters always starts a pre-token, so texts are cut there. Parts not
    seen before are split into pre-tokens, and the library's model encodes those. Where the file normalises or splits texts
    in any other way, the library encodes all texts whole.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        said = json.loads(t.to_str())
        splits = said["pre_tokenizer"] or {}
        self.plain = said["normalizer"] is None and {k: splits.get(k) for k in BYTE_LEVEL} == BYTE_LEVEL and said["model"]["type"] == "BPE" and not said["model"].get("dropout") and not said["truncation"] and not said["padding"]
        self.whole, self.model, self.size = t, t.model, t.get_vocab_size()
        self.kind = np.uint16 if self.size <= 1 << 16 else np.uint32
        self.find = regex.compile(PRETOKEN).findall
        self.rare = re.compile(RARE_SPACE).search
        self.special = [x.content for x in t.get_added_tokens_decoder().values()]
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.letters = {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in keep)}
        self.words: dict[str, list[int]] = {}
        self.older: dict[str, list[int]] = {}
        self.parts = Parts(self.kind, lambda new: [self.part(x) for x in new], PARTS)

    def word(self, w: str) -> list[int]:
        """Ids of a pre-token."""
        if (got := self.words.get(w)) is None:
            if (got := self.older.get(w)) is None:
                if w.isascii() and w.isprintable():
                    s = w.replace(" ", self.letters[32])
                else:
                    s = "".join(map(self.letters.__getitem__, w.encode()))
                got = [x.id for x in self.model.tokenize(s)]
            self.words[w] = got
            if len(self.words) >= WORDS:
                self.older, self.words = self.words, {}
        return got

    def part(self, p: bytes) -> np.ndarray:
        """Ids of a part of a text: a word, a word and a run of marks, or whatever the pattern makes of it."""
        s = p.decode()
        word = s.rstrip(MARKS)
        if word[1:].isalpha() and (word[0] == " " or word[0].isalpha()) and max(word) < "\u0250":
            words = [word, s[len(word) :]] if len(word) < len(s) else [word]
        else:
            words = self.find(s)
        if len(words) == 1:
            return np.array(self.word(words[0]), self.kind)
        return np.array([i for w in words for i in self.word(w)], self.kind)

    def whole_text(self, text: str) -> np.ndarray:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, self.kind)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. Texts that hold a special token's own string, or white space of other scripts, go to the library whole."""
        odd = [not self.plain or any(x in t for x in self.special) or not t.isascii() and self.rare(t) is not None for t in texts]
        plain = iter(self.parts.encode([t.encode() for t, o in zip(texts, odd, strict=True) if not o]))
        return [self.whole_text(t) if o else next(plain) for t, o in zip(texts, odd, strict=True)]


def encoder(path: str) -> Encoder:
    if ("encoder", path) not in _state:
        _state["encoder", path] = Encoder(path)
    return _state["encoder", path]


def write_records(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """Writes records in ascending id order, a file per range of ids; gives the index, staged: doc_id, file, at, bytes, n_tokens, part, nth.

    A null text is empty and holds only the end id. A null id comes first and is written as the least 64-bit integer.
    Repeated rows are records of their own, in an order set by their texts. No rows: no files. Long texts are encoded whole, each as one record.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, out, nth = encoder(tokenizer), None, 0
        end = np.array([end_id], enc.kind).tobytes()
        part = TaskContext.get().partitionId()
        for b in batches:
            out = out or Writer(folder, ".records")
            for lo in range(0, b.num_rows, 1000):
                x = b.slice(lo, 1000)
                ids, texts = x.column("doc_id").to_pylist(), x.column("text").to_pylist()
                packed = [x.tobytes() + end for x in enc.ids(texts)]
                made = frames([struct.pack("<qB", i, enc.kind().itemsize) + p for i, p in zip(ids, packed, strict=True)])
                at = [out.write(f) for f in made]
                n = [len(p) // enc.kind().itemsize for p in packed]
                cols = [ids, [out.name] * len(ids), at, [len(f) for f in made], n, [part] * len(ids), list(range(nth, nth + len(ids)))]
                nth += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k == 1 else pa.int64()) for k, c in enumerate(cols)], names=["doc_id", "file", "at", "bytes", "n_tokens", "part", "nth"])
        if out:
            out.close()

    order = ["doc_id", "text"]
    dealt = rows.repartitionByRange("doc_id").sortWithinPartitions(*order)
    return stage(dealt.mapInArrow(write, "doc_id bigint, file string, at bigint, bytes bigint, n_tokens bigint, part bigint, nth bigint"), "token-index")


def with_starts(index: DataFrame) -> DataFrame:
    """Adds start: the ids in all records before. Sums run inside files; one row per file is summed across them."""
    files = index.groupBy("part", "file").agg(F.sum("n_tokens").alias("all"))
    files = files.withColumn("base", F.coalesce(F.sum("all").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    before = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("file").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return index.withColumn("before", before).join(files.select("file", "base"), "file").withColumn("start", F.col("base") + F.col("before")).drop("base", "before")


def read_records(index: DataFrame, folder: str, each: Callable[[list[int], list[np.ndarray]], list[pa.Array]], schema: str) -> DataFrame:
    """Range-reads each indexed record; each(ids of documents, their token ids) gives the columns beside start. Tasks get files' pieces of PIECE bytes, about READ bytes in all, however small the index is."""
    ship(index.sparkSession)
    names = ["start", *[x.split()[0] for x in schema.split(",")]]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = Ranges(folder)
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                x = b.slice(lo, 500)
                records = unframed([ranges.read(*p) for p in zip(*(x.column(c).to_pylist() for c in ("file", "at", "bytes")), strict=True)])
                heads = [struct.unpack("<qB", r[:9]) for r in records]
                ids = [np.frombuffer(r, f"<u{w}", offset=9) for r, (_, w) in zip(records, heads, strict=True)]
                yield pa.RecordBatch.from_arrays([x.column("start").cast(pa.int64()), *each([i for i, _ in heads], ids)], names=names)

    total = index.agg(F.sum("bytes")).first()[0] or 0
    tasks = max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // READ))
    dealt = index.select("file", "at", "bytes", "start").repartition(tasks, F.col("file"), F.floor(F.col("at") / PIECE)).sortWithinPartitions("file", "at")
    return dealt.mapInArrow(read, f"start bigint, {schema}")


def digests(docs: list[int], ids: list[np.ndarray]) -> list[pa.Array]:
    return [pa.array([None if d == -(2**63) else d for d in docs], pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())]


def round_trip(spark: SparkSession, docs: DataFrame, tokenizer: str, **columns) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files that were written."""
    folder = new_path(spark, "token-records")
    index = with_starts(write_records(docs, folder, tokenizer, **columns))
    return read_records(index, folder, digests, "doc_id bigint, n_tokens bigint, ids_crc32 bigint").select("doc_id", "start", "n_tokens", "ids_crc32")
