"""Trees of files: listed by rules on names and paths before any content is read, and decoded one by one; what can't be decoded is a row that says why."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of version control.
VCS = (r"^(\.git|\.svn|\.hg|\.bzr|CVS)$",)


def any_of(rules: Sequence[str], *names: Column) -> Column:
    return reduce(lambda a, c: a | c, (n.rlike(r) for r in rules for n in names), F.lit(False))


def kept(path: Column, match: Sequence[str] = (), exclude: Sequence[str] = (), dir_match: Sequence[str] = (), dir_exclude: Sequence[str] = VCS, prefix: str = "") -> Column:
    """Whether a file's relative path passes the rules, each of which is tried on the name and on the path (with its prefix).

    A file must match one of match (all do if there is none) and none of exclude; each folder on its way one of dir_match, and none of dir_exclude and exclude.
    """
    parts = F.split(path, "/")
    full = F.concat(F.lit(prefix), path)
    file = (any_of(match, F.element_at(parts, -1), full) if match else F.lit(True)) & ~any_of(exclude, F.element_at(parts, -1), full)
    folders = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda n, i: F.struct(n.alias("name"), F.concat(F.lit(prefix), F.array_join(F.slice(parts, F.lit(1), i + 1), "/")).alias("path")))
    on_way = lambda d: (any_of(dir_match, d["name"], d["path"]) if dir_match else F.lit(True)) & ~any_of([*dir_exclude, *exclude], d["name"], d["path"])
    return file & F.forall(folders, on_way)


def listed(spark: SparkSession, root: str, prefix: str = "", **rules) -> DataFrame:
    """path (with prefix), size, modified, uri of the files under root that the rules (kept) keep, at any depth. No content is read.

    Empty files, and names that begin with a dot or an underscore, aren't listed by Spark.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri().toString().rstrip("/")
    # metadata spells paths as URIs, the root may be spelled with one slash or three
    plain = lambda c: F.url_decode(F.replace(F.regexp_replace(c, "^([a-z0-9]+):/+", "$1:/"), F.lit("+"), F.lit("%2B")))
    uri = F.col("_metadata.file_path")
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rows = rows.select(F.substring(plain(uri), F.length(plain(F.lit(base))) + 2, F.lit(1 << 30)).alias("relative"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.regexp_replace(uri, "^file:/+", "file:///").alias("uri"))
    return rows.where(kept(F.col("relative"), prefix=prefix, **rules)).select(F.concat(F.lit(prefix), F.col("relative")).alias("path"), "size", "modified", "uri")


def read(listing: DataFrame) -> DataFrame:
    """path, size, modified, raw of listed files: only what the rules have kept is opened, in the tasks that hold its rows. A file that is gone fails its task."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, uri in enumerate(b.column("uri").to_pylist()):
                where, name = fs.FileSystem.from_uri(uri)
                with where.open_input_file(name) as f:
                    raw = f.read()
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, 1) for c in ("path", "size", "modified")), pa.array([raw], pa.binary())], names=["path", "size", "modified", "raw"])

    return listing.mapInArrow(load, "path string, size bigint, modified timestamp, raw binary")


def files(spark: SparkSession, root: str, prefix: str = "", **rules) -> DataFrame:
    """path, size, modified, raw of the files under root that the rules keep."""
    return read(listed(spark, root, prefix, **rules))


#: Byte order marks in hexadecimal, the longest first, and what they say.
MARKS = (("FFFE0000", "UTF-32LE"), ("0000FEFF", "UTF-32BE"), ("EFBBBF", "UTF-8"), ("FFFE", "UTF-16LE"), ("FEFF", "UTF-16BE"))
#: Encodings that Spark decodes, by what a header may call them.
NAMES = {"UTF-8": "UTF-8", "UTF8": "UTF-8", "ISO-8859-1": "ISO-8859-1", "LATIN1": "ISO-8859-1", "LATIN-1": "ISO-8859-1", "US-ASCII": "US-ASCII", "ASCII": "US-ASCII", "UTF-16LE": "UTF-16LE", "UTF-16BE": "UTF-16BE"}


def encoding(raw: Column) -> Column:
    """By a file's mark, else by its XML header, else UTF-8. A header's name that isn't known comes back as it stands."""
    head = F.hex(F.substring(raw, 1, 4))
    mark = reduce(lambda c, m: c.when(head.startswith(m[0]), m[1]), MARKS[1:], F.when(head.startswith(MARKS[0][0]), MARKS[0][1]))
    start = F.decode(F.substring(raw, 1, 200), "ISO-8859-1")
    said = F.upper(F.regexp_extract(start, r"""(?is)^<\?xml\s[^>]*?encoding=['"](.+?)['"].*?\?>""", 1))
    known = reduce(lambda c, k: c.when(said == k, NAMES[k]), NAMES, F.when(F.lit(False), ""))
    return F.coalesce(mark, known, F.nullif(said, F.lit("")), F.lit("UTF-8"))


def decoded(rows: DataFrame) -> DataFrame:
    """rows (path, raw and any others but raw) with content, encoding and rejected: text by the file's own encoding, without its mark and with line feeds as line ends.

    Bytes that aren't of the encoding, and encodings that Spark can't decode, leave content null and say so in rejected; the job goes on. A null raw has null content and isn't rejected.
    """
    rows = rows.withColumn("encoding", encoding(F.col("raw")))
    head, e = F.hex(F.substring("raw", 1, 4)), F.col("encoding")
    mark = reduce(lambda c, m: c.when(head.startswith(m[0]), len(m[0]) // 2), MARKS[1:], F.when(head.startswith(MARKS[0][0]), len(MARKS[0][0]) // 2)).otherwise(0)
    body = F.substring(F.col("raw"), mark + 1, F.length("raw"))
    digits = F.hex(body)
    # whole units only, and surrogates in pairs: what isn't is left over
    unit = {"UTF-16BE": r"\G(?:(?!D[89A-F])[0-9A-F]{4}|D[89AB][0-9A-F]{2}D[C-F][0-9A-F]{2})", "UTF-16LE": r"\G(?:[0-9A-F]{2}(?!D[89A-F])[0-9A-F]{2}|[0-9A-F]{2}D[89AB][0-9A-F]{2}D[C-F])"}
    unit |= {"UTF-32BE": r"\G(?:00(?:0[0-9A-F]|10)(?!D[89A-F])[0-9A-F]{4}|00(?:0[1-9A-F]|10)D[89A-F][0-9A-F]{2})", "UTF-32LE": r"\G(?:[0-9A-F]{2}(?!D[89A-F])[0-9A-F]{2}(?:0[0-9A-F]|10)00|[0-9A-F]{2}D[89A-F](?:0[1-9A-F]|10)00)"}
    whole = lambda name: F.regexp_replace(digits, unit[name], "") == ""
    fits = F.when(e == "UTF-8", F.is_valid_utf8(body.cast("string"))).when(e == "US-ASCII", ~F.regexp_replace(digits, "[0-7][0-9A-F]", "").rlike(".")).when(e == "ISO-8859-1", True)
    fits = reduce(lambda c, name: c.when(e == name, whole(name)), unit, fits)
    rows = rows.withColumn("rejected", F.when(F.col("raw").isNull(), None).when(fits.isNull(), F.concat(F.lit("unknown encoding "), e)).when(~fits, F.concat(F.lit("not "), e)))
    text = reduce(lambda c, name: c.when(e == name, F.decode(body, name)), ["ISO-8859-1", "US-ASCII", "UTF-16LE", "UTF-16BE"], F.when(e == "UTF-8", body.cast("string")))
    text = text.when(e.startswith("UTF-32"), F.decode("raw", "UTF-32"))  # which reads the mark itself
    content = F.when(F.col("rejected").isNull(), F.replace(text, F.lit("\r\n"), F.lit("\n")))
    return rows.withColumn("content", content).withColumn("encoding", F.when(F.col("raw").isNotNull(), e)).drop("raw")
