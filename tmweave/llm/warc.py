"""WARC archives with a two-level capture index.

Archives: each task writes one file of gzip members, one member a record. Captures of one payload are written once in
full; the others are revisit records that refer to it. Index: one line per record, keyed by the URL with its
host reversed, sorted over all archives and cut into compressed blocks. Each index file ends in its sparse directory, the first and last key
and the place of each block; a table has one row per file. A look-up binary-searches the files and the file's directory, range-reads
the blocks that may hold the key, binary-searches their lines, and range-reads the records.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import re
from bisect import bisect_left, bisect_right
from collections import OrderedDict
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, ship, stage
from .files import Ranges, Writer

#: Payloads below this many bytes are always written in full. Lines in an index block.
LEAST, LINES = 1000, 256
END = b"\r\n\r\n"
WRITTEN = "urlkey string, page_id bigint, file string, at bigint, bytes bigint"
#: Bytes of records handed on together; directories and blocks that a task keeps at hand.
TOGETHER, AT_HAND = 4 << 20, 4
FILES = "first_key string, last_key string, file string, at bigint, bytes bigint, n_blocks bigint"
FOUND = "urlkey string, file string, at bigint, bytes bigint"
READ = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"


def urlkey(url: str | None) -> str:
    """Host reversed and joined by commas, without www, then path and query in lower case: com,example,m)/en/25?a=1. Null or not a URL: as it is, in lower case."""
    try:
        parts = urlsplit((url or "").strip())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return (url or "").lower()
    host = re.sub(r"^www\d*\.", "", host)
    if not host:
        return (url or "").lower()
    port = f":{port}" if port and port not in (80, 443) else ""
    return f"{','.join(reversed(host.split('.')))}{port}){parts.path or '/'}{'?' + parts.query if parts.query else ''}".lower()


def one_line(text: str | None) -> str:
    """A header value: no line breaks can end it early; a null is empty."""
    return json.dumps(text or "", ensure_ascii=False)[1:-1]


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. HTTP headers tell the length of the full payload, which a revisit leaves out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    again = refers_to is not None
    body = http if again else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if again else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {one_line(url)}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response"]
    if again:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join([*head, f"Content-Length: {len(body)}"]).encode() + END + body + END


def parsed(data: bytes) -> dict:
    """What a record says; a response's payload is checked against its digest."""
    head, _, rest = data.partition(END)
    said = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    body = rest[: int(said["Content-Length"])]
    if rest[len(body) :] != END:
        raise ValueError("a record doesn't end where its length says")
    http, _, payload = body.partition(END)
    full = int(re.search(rb"Content-Length: (\d+)", http)[1])
    kind, digest = said["WARC-Type"], said["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != full or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError("a payload isn't what its record says")
    page = lambda k: int(m[1]) if (m := re.search(r"urn:page:(-?\d+)", said.get(k, ""))) else None
    return {"page_id": page("WARC-Record-ID"), "url": json.loads(f'"{said["WARC-Target-URI"]}"'), "payload_bytes": full, "payload_digest": digest, "record_type": kind, "refers_to": page("WARC-Refers-To"), "payload": payload}


def marked(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST) -> DataFrame:
    """page_id, url, html, digest, refers_to of each page. Only ids and digests meet by digest, so that a page of very many copies isn't one task's; payloads meet what was found by their ids."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    long = rows.where((F.octet_length("html") >= least) & F.col("page_id").isNotNull()).select("page_id", "digest")
    first = long.groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = long.join(first, "digest").where("page_id < first").select("page_id", "digest", F.col("first").alias("refers_to")).distinct()
    return rows.join(again, ["page_id", "digest"], "left").select("page_id", "url", "html", "digest", "refers_to")


def write_archives(pages: DataFrame, folder: str, **columns) -> DataFrame:
    """Writes the archives; gives, staged, a row for each record: its key, file, place and length.

    A null html is an empty payload, a null url an empty URL; a null page_id is written as such and never referred to
    or from. Of repeated rows with one page_id, each is written as the same kind of record. No pages: no archives.
    """
    ship(pages.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for b in batches:
            rows = []
            for p, u, h, d, r in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
                out = out or Writer(folder, ".warc.gz")
                member = gzip.compress(record(p, u, h.encode(), d, r), 6, mtime=0)
                rows.append((urlkey(u), p, out.name, out.write(member), len(member)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["urlkey", "page_id", "file", "at", "bytes"])
        if out:
            out.close()

    return stage(marked(pages, **columns).mapInArrow(write, WRITTEN), "warc-written")


def write_index(written: DataFrame, folder: str, lines: int = LINES) -> DataFrame:
    """Sorts the records' lines by key over the whole corpus and writes them in compressed blocks, each file with its directory at the end; gives, staged, a row per file."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, block, blocks = None, [], []

        def flush() -> None:
            data = gzip.compress("\n".join(json.dumps(x) for x in block).encode(), 6, mtime=0)
            blocks.append((block[0][0], block[-1][0], out.write(data), len(data)))
            block.clear()

        for b in batches:
            out = out or Writer(folder, ".idx.gz")
            for x in zip(*(b.column(c).to_pylist() for c in ("urlkey", "page_id", "file", "at", "bytes")), strict=True):
                block.append(x)
                if len(block) == lines:
                    flush()
        if block:
            flush()
        if blocks:
            data = gzip.compress("\n".join(map(json.dumps, blocks)).encode(), 6, mtime=0)
            row = [blocks[0][0], blocks[-1][1], out.name, out.write(data), len(data), len(blocks)]
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row, (pa.string(),) * 3 + (pa.int64(),) * 3, strict=True)], names=[x.split()[0] for x in FILES.split(", ")])
        if out:
            out.close()

    order = [F.col("urlkey"), F.col("page_id").asc_nulls_first(), F.col("file"), F.col("at")]
    return stage(written.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(write, FILES), "warc-files")


class Captures:
    """Look-ups by key. files: the rows of write_index, one per index file, of which there are as many as tasks wrote."""

    def __init__(self, files: list, archives: str, index: str):
        self.files = sorted(tuple(f) for f in files)
        self.last = [f[1] for f in self.files]
        self.index, self.archives = index, archives
        self.at_hand: OrderedDict[tuple, list] = OrderedDict()

    def lines(self, file: str, at: int, size: int) -> list[list]:
        """A directory or a block, kept for the next look-ups."""
        if not hasattr(self, "ranges"):
            self.ranges = Ranges(self.index), Ranges(self.archives)
        place = (file, at, size)
        if place not in self.at_hand:
            self.at_hand[place] = [json.loads(x) for x in gzip.decompress(self.ranges[0].read(*place)).decode().split("\n")]
            if len(self.at_hand) > AT_HAND:
                self.at_hand.popitem(last=False)
        self.at_hand.move_to_end(place)
        return self.at_hand[place]

    def blocks(self, key: str) -> Iterator[tuple[str, int, int]]:
        """The blocks that may hold the key: by binary search in the files, then in the directory of each."""
        for i in range(bisect_left(self.last, key), len(self.files)):
            first, _, file, at, size = self.files[i][:5]
            if first > key:
                break
            directory = self.lines(file, at, size)
            for j in range(bisect_left(directory, key, key=lambda b: b[1]), len(directory)):
                if directory[j][0] > key:
                    break
                yield file, directory[j][2], directory[j][3]

    def places(self, key: str, block: tuple[str, int, int]) -> list[tuple[str, int, int]]:
        """Where the block's records of the key lie in the archives, in order."""
        lines = self.lines(*block)
        return [tuple(x[2:]) for x in lines[bisect_left(lines, key, key=lambda x: x[0]) : bisect_right(lines, key, key=lambda x: x[0])]]

    def record(self, place: tuple[str, int, int]) -> dict:
        return parsed(gzip.decompress(self.ranges[1].read(*place)))

    def find(self, url: str) -> list[dict]:
        """All captures of the URL, by page_id; a revisit has the payload of the record that it refers to only by its digest."""
        key = urlkey(url)
        return [self.record(p) for b in self.blocks(key) for p in self.places(key, b)]


def look_up(urls: DataFrame, captures: Captures, url_col: str = "url") -> DataFrame:
    """All records of the URLs, each once. Keys are searched in sorted ranges; the blocks found are dealt out anew, so that a key of very many records isn't one task's, and each
    task reads a block once. Null URLs are looked up as empty ones; URLs that aren't there give no rows."""
    spark = urls.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast((captures.files, captures.archives, captures.index))  # one row per index file

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([urlkey(u) for u in b.column("url").to_pylist()], pa.string())], names=["urlkey"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Captures(*shared.value)
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                found = [(k, *x) for k in b.column("urlkey").slice(lo, 1000).to_pylist() for x in c.blocks(k)]
                for at in range(0, len(found), 10000):
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found[at : at + 10000], strict=True), (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["urlkey", "file", "at", "bytes"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Captures(*shared.value)
        for b in batches:
            rows, size = [], 0
            for key, *block in zip(*(b.column(x).to_pylist() for x in ("urlkey", "file", "at", "bytes")), strict=True):
                for place in c.places(key, tuple(block)):
                    rows.append(c.record(place))
                    size += len(rows[-1]["payload"]) + 1000
                    if size > TOGETHER:
                        yield rows_of(rows)
                        rows, size = [], 0
            yield rows_of(rows)

    wanted = urls.select(F.col(url_col).alias("url")).mapInArrow(keys, "urlkey string").distinct()
    blocks = wanted.repartitionByRange("urlkey").sortWithinPartitions("urlkey").mapInArrow(search, FOUND)
    # the blocks are staged: where tasks that read records run again, the same blocks are dealt to them
    blocks = stage(blocks, "warc-blocks")
    return blocks.repartition("file", "at").sortWithinPartitions("file", "at", "urlkey").mapInArrow(read, READ)


def rows_of(found: list[dict]) -> pa.RecordBatch:
    kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, t in kinds.items()], names=list(kinds))


def round_trip(spark: SparkSession, pages: DataFrame, **columns) -> DataFrame:
    """Writes pages as archives and index in the shared folder and reads every record back, by looking up the pages' URLs. Long payloads are written and read whole, a few at a time. No pages: no rows."""
    archives, index = new_path(spark, "warc"), new_path(spark, "warc-index")
    files = write_index(write_archives(pages, archives, **columns), index)
    return look_up(pages, Captures(files.collect(), archives, index), columns.get("url_col", "url"))
