"""N-gram Jaccard self-join with adaptive multi-match prefixes.

Documents are sets of word-shingle hashes; two link if their Jaccard likeness reaches a threshold. All shingles stand
in one order, rare ones first (by a table of counts over all documents). A document's prefix for l matches
holds so many of its first shingles that any document linked with it shares at least l of them; each document takes the l whose
estimated cost (candidates met by its prefix, and those left to verify) is least. Candidates share at
least the smaller l of the two, pass the bounds of size, position and parts, and are verified on whole sets.

Equal sets are one class from the start. So that dense groups don't yield all their pairs, each prefix shingle's documents are first
compared with its most central one; what that links is one component, and then only pairs across components are looked for.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from .common import discard, ship, stage, tidy
from .components import components
from .shingles import M1, STEP, chunks, mixed, shared_shingles, shingle_sets, words_of

WORDS, NUM, DEN = 5, 80, 100
#: Prefixes are made for up to so many matches; verifying a candidate costs as much as meeting so many.
MATCHES, VERIFY = 4, 8.0
#: Shingle counts are kept in so many cells, dealt out in parts; a filter of wanted classes has so many bits.
CELLS, PARTS, BITS = 1 << 22, 64, 1 << 24
#: Parts of a set that are counted for a bound on what two sets share; 255 stands for more.
HIST = 256
#: A class's rows are named in so many parts.
SALTS = 16


def sets_of(column: pa.Array, words: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, hashes, ends) for runs of a column's texts; few texts are unpacked at once."""
    for at in range(0, len(column), 1000):
        texts = [b"" if t is None else t.encode("utf-8", "replace") for t in column.slice(at, 1000).to_pylist()]
        for lo, hi in chunks([len(t) for t in texts]):
            yield at + lo, at + hi, *shingle_sets(texts[lo:hi], words)


def keys_of(h: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two longs for each set, alike for equal sets: sums of differently mixed 64-bit hashes; a set of one shingle has no more than its 64 bits."""
    out, begin = [], np.concatenate([[0], ends[:-1]])
    for x in (mixed(h + STEP), mixed(h * STEP + M1)):
        total = np.concatenate([[np.uint64(0)], np.cumsum(x)])
        out.append(mixed((total[ends] - total[begin]) ^ mixed((ends - begin).astype(np.uint64))).view(np.int64))
    return out[0], out[1]


def levels(docs: DataFrame, words: int) -> np.ndarray:
    """For each cell of shingle hashes how common its shingles are: 0, or 1 + log2 of the documents beyond the usual.

    Every document is counted. Each task sends its counts, compressed; cells are summed in parts; CELLS bytes come back.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.int32)
        for b in batches:
            for _, _, h, _ in sets_of(b.column("text"), words):
                cell, n = np.unique((h >> np.uint64(42)).astype(np.int64), return_counts=True)
                cells[cell] += n.astype(np.int32)
        parts = cells.reshape(PARTS, -1)
        used = [i for i in range(PARTS) if parts[i].any()]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([zlib.compress(parts[i].tobytes(), 1) for i in used], pa.binary())], names=["part", "counts"])

    def add(key: tuple, rows: pa.Table) -> pa.Table:
        total = np.zeros(CELLS // PARTS, np.int64)
        for x in rows.column("counts"):
            total += np.frombuffer(zlib.decompress(x.as_py()), np.int32)
        usual = total.mean()
        extra = total - usual
        level = np.where(extra > 4 * np.sqrt(usual) + 3, 1 + np.floor(np.log2(np.maximum(extra, 1))), 0).astype(np.uint8)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "level": pa.array([level.tobytes()], pa.binary())})

    counts = docs.select("text").mapInArrow(tidy(count), "part int, counts binary")
    out = np.zeros((PARTS, CELLS // PARTS), np.uint8)
    for r in counts.groupBy("part").applyInArrow(add, "part int, level binary").collect():
        out[r["part"]] = np.frombuffer(bytes(r["level"]), np.uint8)
    return out.ravel()


def prefix(others: np.ndarray, n: int, num: int, den: int) -> tuple[int, int, int]:
    """The number of matches with the least estimated cost, the prefix's length, and its length for partners that aren't smaller."""
    least = -(-num * n // den)  # of n shingles shared with any linked document
    same = -(-2 * num * n // (den + num))  # with one of at least this size
    met = np.cumsum(others[: n - least + min(MATCHES, least)])
    best = min(range(1, min(MATCHES, least) + 1), key=lambda m: met[n - least + m - 1] * (1 + VERIFY / m))
    return best, n - least + best, n - same + min(best, same)


def signatures(docs: DataFrame, level: np.ndarray, words: int, num: int, den: int) -> DataFrame:
    """doc_id and h of docs, with n, k1, k2, need, short, cent, hist, toks of each text: size and key of its set, its prefix in the common order, and how many of its shingles fall in each of HIST parts."""
    shared = docs.sparkSession.sparkContext.broadcast(level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared.value
        guess = np.concatenate([[0.0], 2.0 ** np.arange(64)])  # documents at each level
        for b in batches:
            for lo, hi, h, ends in sets_of(b.column("text"), words):
                lv = common[(h >> np.uint64(42)).astype(np.int64)]
                n = np.diff(ends, prepend=0)
                doc = np.repeat(np.arange(hi - lo), n)
                order = np.lexsort((h, lv, doc))
                tok, extra = h[order].view(np.int64), guess[lv[order]]
                sums = np.concatenate([[0], np.cumsum(lv.astype(np.int64))])
                cent = np.where(n > 0, (sums[ends] - sums[ends - n]) * 64 // np.maximum(n, 1), 0)
                hist = np.bincount(doc * HIST + (h >> np.uint64(34) & np.uint64(HIST - 1)).astype(np.int64), minlength=(hi - lo) * HIST)
                hist = np.minimum(hist, 255).astype(np.uint8).reshape(-1, HIST)
                need, short, toks = [], [], []
                for e, size in zip(ends.tolist(), n.tolist(), strict=True):
                    if not size:
                        need.append(0), short.append(0), toks.append(tok[:0])
                        continue
                    m, long, index = prefix(extra[e - size : e], size, num, den)
                    need.append(m), short.append(index), toks.append(tok[e - size : e - size + long])
                at = np.concatenate([[0], np.cumsum([len(t) for t in toks])])
                k1, k2 = keys_of(h, ends)
                arrays = [b.column("doc_id").slice(lo, hi - lo), b.column("h").slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(k1), pa.array(k2), pa.array(need, pa.int32()), pa.array(short, pa.int32()), pa.array(cent, pa.int64()), pa.array([x.tobytes() for x in hist], pa.binary()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(toks), pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "h", "n", "k1", "k2", "need", "short", "cent", "hist", "toks"])

    return docs.mapInArrow(tidy(run), "doc_id bigint, h bigint, n bigint, k1 bigint, k2 bigint, need int, short int, cent bigint, hist binary, toks array<bigint>")


def feasible(n: Column, pos: Column, m: Column, at: Column, num: int, den: int) -> Column:
    """Whether a shingle at these positions of sets of sizes n and m can be the first that the two share and they still reach the threshold: bounds of size and position."""
    share = F.ceil((n + m) * num / (den + num) - 1e-9)
    return (F.least(n, m) * den >= F.greatest(n, m) * num) & (F.least(n - pos, m - at) >= share)


def flagged(rows: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """rows with hit: whether their column is one of the longs wanted, or perhaps another. A filter of BITS bits, however many are wanted, which spares a join's shuffle most of what it has nothing to say of."""
    spark = rows.sparkSession
    bit = F.shiftrightunsigned(F.xxhash64("c"), 40)
    words = wanted.toDF("c").select(F.shiftright(bit, 6).alias("w"), (bit % 64).cast("int").alias("s")).groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, s)")).alias("m")).toArrow()
    mask = np.zeros(BITS // 64, np.int64)
    mask[words.column("w").to_numpy()] = words.column("m").to_numpy()
    shared = spark.sparkContext.broadcast(mask.view(np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for b in batches:
            slot = b.column("slot").to_numpy().view(np.uint64)
            hit = bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1) > 0
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(hit)], names=[*b.schema.names[:-1], "hit"])

    out = rows.withColumn("slot", F.shiftrightunsigned(F.xxhash64(column), 40))
    return out.mapInArrow(tidy(run), StructType([*rows.schema.fields, StructField("hit", BooleanType())]))


def among(rows: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """The rows that flagged() hits."""
    return flagged(rows, column, wanted).where("hit").drop("hit")


def matching(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs whose prefixes share as many shingles as the one with fewer matches to make needs."""
    some = among(classes.select("cls", "n", "need", "short", "toks"), "cls", pairs.select(F.explode(F.array("a", "b"))))
    of = lambda k, v: some.select(F.col("cls").alias(k), F.struct("n", "cls", "need", "short", "toks").alias(v))
    both = pairs.join(of("a", "x"), "a").join(of("b", "y"), "b")
    smaller = (F.col("x.n") < F.col("y.n")) | (F.col("x.n") == F.col("y.n")) & (F.col("x.cls") < F.col("y.cls"))
    part = lambda v, short: F.when(short, F.slice(F.col(f"{v}.toks"), F.lit(1), F.col(f"{v}.short"))).otherwise(F.col(f"{v}.toks"))
    shared = F.size(F.array_intersect(part("x", smaller), part("y", ~smaller)))
    return both.where(shared >= F.least("x.need", "y.need")).select("a", "b")


def likely(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of classes (a, b) that can still reach the threshold by their sizes and by the parts that their shingles fall in: they share at most the smaller count of each part."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, HIST).astype(np.float32) for c in ("hx", "hy"))
            x[x == 255], y[y == 255] = np.inf, np.inf
            n = b.column("nx").to_numpy() + b.column("ny").to_numpy()
            keep = np.minimum(x, y).sum(1) * (den + num) >= n * num
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(keep))

    some = among(classes.select("cls", "n", "hist"), "cls", pairs.select(F.explode(F.array("a", "b"))))
    of = lambda k, v: some.select(F.col("cls").alias(k), F.col("n").alias(f"n{v}"), F.col("hist").alias(f"h{v}"))
    both = pairs.join(of("a", "x"), "a").join(of("b", "y"), "b").where(F.least("nx", "ny") * den >= F.greatest("nx", "ny") * num)
    return both.select("a", "b", "nx", "ny", "hx", "hy").mapInArrow(tidy(check), "a bigint, b bigint")


def verified(docs: DataFrame, pairs: DataFrame, classes: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Those of the pairs of classes (a, b) that link, staged: their texts are compared word by word.

    Texts are read again, for the classes in the pairs only (a filter of fixed size lets others through, and a join drops those), and travel compressed.
    """
    spark = docs.sparkSession
    wanted = classes.select("cls", "k1", "k2").join(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct(), "cls")
    wanted = stage(wanted, "join-wanted")
    bit = F.shiftrightunsigned("k1", 40)  # as in among(), but by the text's own key
    found = wanted.select(F.shiftright(bit, 6).alias("w"), (bit % 64).cast("int").alias("s")).groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, s)")).alias("m")).toArrow()
    mask = np.zeros(BITS // 64, np.int64)
    mask[found.column("w").to_numpy()] = found.column("m").to_numpy()
    shared = spark.sparkContext.broadcast(mask.view(np.uint64))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen, pack = shared.value, set(), zstandard.ZstdCompressor(1).compress
        for b in batches:
            column = b.column("text")
            for lo, _, h, ends in sets_of(column, words):
                k1, k2 = keys_of(h, ends)
                slot = k1.view(np.uint64) >> np.uint64(40)
                hit = (np.diff(ends, prepend=0) > 0) & ((bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) > 0)
                rows = []
                for i in np.flatnonzero(hit).tolist():
                    if (key := (int(k1[i]), int(k2[i]))) not in seen:
                        seen.add(key)
                        rows.append((*key, pack(b" ".join(words_of(column[lo + i].as_py().encode())))))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["k1", "k2", "words"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            keep = []
            for x, y in zip(b.column("x"), b.column("y"), strict=True):
                both, together = shared_shingles(unpack(x.as_py()), unpack(y.as_py()), words)
                keep.append(both * den >= num * together)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    # a batch holds one text of a class at most, and a class that many batches hold is thinned out before the shuffle
    got = docs.select("text").mapInArrow(tidy(texts), "k1 bigint, k2 bigint, words binary").groupBy("k1", "k2").agg(F.first("words").alias("words"))
    got = stage(got.join(wanted, ["k1", "k2"]).select("cls", "words"), "join-texts")
    left = pairs.join(got.select(F.col("cls").alias("a"), F.col("words").alias("x")), "a")
    both = left.join(got.select(F.col("cls").alias("b"), F.col("words").alias("y")), "b")
    links = stage(both.select("a", "b", "x", "y").mapInArrow(tidy(check), "a bigint, b bigint"), "join-links")
    discard(got, wanted)
    return links


def linked(docs: DataFrame, id_col: str, text_col: str, words: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """rows: doc_id, h (hash of the text), n, k1, k2 of each row. named: k1, k2, name (none, doc_id, h, node) of the classes that link or have several rows; name is the least of the component's rows. Both staged."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    sig = stage(signatures(docs, levels(docs, words), words, num, den), "join-signatures")
    rows = stage(sig.select("doc_id", "h", "n", "k1", "k2"), "join-rows")
    mine = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("mine")
    classes = sig.where("n > 0").groupBy("k1", "k2").agg(F.first(F.struct("n", "need", "short", "cent", "hist", "toks")).alias("s"), mine, F.count("*").alias("times"))
    classes = classes.withColumn("cls", F.monotonically_increasing_id())
    classes = stage(classes.select("cls", "k1", "k2", "times", F.struct("mine.none", "mine.doc_id", "mine.h", F.col("cls").alias("node")).alias("name"), "s.*"), "join-classes")
    discard(sig)
    names = classes.select(F.col("cls").alias("v"), "name")
    half = 1 << 31  # sets and positions are smaller: an array's length is an int
    post = classes.select("cls", "n", "short", "cent", F.posexplode("toks").alias("pos", "tok"))
    # postings are shuffled once: each list's length and most central class are found where it stands
    list_of = Window.partitionBy("tok")
    top = F.max(F.struct("cent", "cls", (F.col("n") * half + F.col("pos")).alias("at"))).over(list_of)
    met = post.withColumn("c", F.count("*").over(list_of)).withColumn("top", top).where("c > 1")
    met = stage(met.select("tok", "cls", "n", "short", "pos", F.col("top.cls").alias("p"), F.col("top.at").alias("at")), "join-postings")
    near = feasible(F.col("n"), F.col("pos"), F.shiftright("at", 31), F.col("at") % half, num, den)
    star = met.where((F.col("cls") != F.col("p")) & near).select(F.least("cls", "p").alias("a"), F.greatest("cls", "p").alias("b")).distinct()
    pairs = stage(star, "join-pairs")
    star = stage(likely(pairs, classes, num, den), "join-stars")
    discard(pairs)
    links = verified(docs, star, classes, words, num, den)
    roots = components(links, names)
    node = roots.select("v", F.col("name.node").alias("root"))
    named = met.join(node.select(F.col("v").alias("cls"), "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    # the lists in which more than one component stands, with that of the centre; all others are done
    centre = F.max(F.when(F.col("cls") == F.col("p"), F.col("root"))).over(list_of)
    mixed_lists = named.withColumn("low", F.min("root").over(list_of)).withColumn("high", F.max("root").over(list_of)).withColumn("centre", centre).where("low < high")
    left = stage(mixed_lists.select("tok", "cls", "n", "short", "pos", "root", (F.col("root") != F.col("centre")).alias("other")), "join-mixed")
    discard(met, roots)
    y, x = left.alias("y"), left.where("other").alias("x")
    smaller = (F.col("x.n") < F.col("y.n")) | (F.col("x.n") == F.col("y.n")) & (F.col("x.cls") < F.col("y.cls"))
    once = ~F.col("y.other") | (F.col("x.cls") < F.col("y.cls"))
    index = F.when(smaller, F.col("x.pos") < F.col("x.short")).otherwise(F.col("y.pos") < F.col("y.short"))
    first = feasible(F.col("x.n"), F.col("x.pos"), F.col("y.n"), F.col("y.pos"), num, den)
    hits = x.join(y, (F.col("x.tok") == F.col("y.tok")) & (F.col("x.root") != F.col("y.root")) & once & index & first)
    rest = hits.select(F.least("x.cls", "y.cls").alias("a"), F.greatest("x.cls", "y.cls").alias("b")).distinct()
    pairs = stage(rest.join(star, ["a", "b"], "left_anti"), "join-pairs")
    rest = stage(likely(pairs, classes, num, den), "join-rest")
    discard(left, star, pairs)
    match = stage(matching(rest, classes), "join-matching")
    more = verified(docs, match, classes, words, num, den)
    discard(rest, match)
    roots = components(links.union(more), names)
    found = classes.select(F.col("cls").alias("v"), "k1", "k2", "times", F.col("name").alias("own")).join(roots, "v", "left")
    found = stage(found.where("times > 1 or name is not null").select("k1", "k2", F.coalesce("name", "own").alias("name")), "join-names")
    discard(links, more, roots, classes)
    return rows, found


def with_names(rows: DataFrame, named: DataFrame) -> DataFrame:
    """rows with the name of their component, null for those that stand alone. Names are copied SALTS times, so that a class of very many rows is joined in as many tasks."""
    salted = named.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "h"), F.lit(SALTS)).cast("int")).join(salted, ["k1", "k2", "salt"], "left")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """doc_id, n_shingles, component_id of each row: the smallest id that links reach. Two texts link if den * |common| >= num * |all| of their shingles.

    Null and empty texts, or texts without words, have no shingles and link with nothing: component_id is their own id. Rows of a null
    id take part, but give no component its name; a group of such rows only has a null. Rows that repeat an id are each a row
    of the result, and each stands in the group of its own text. No rows: no rows. Other columns don't come through.
    Texts of any length are read whole; candidates are compared by their words, and equal sets are known by two sums of their shingles' keyed 64-bit hashes (of a single shingle: by those 64 bits).
    """
    rows, named = linked(docs, id_col, text_col, words, num, den)
    return with_names(rows, named).select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("name").isNull(), F.col("doc_id")).otherwise(F.col("name.doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """docs without the near copies: of each group one row stays, that of the smallest id (null ids come last; one id on several texts: the smallest hash of the text).

    Rows are told apart by id and text, so an id that stands on different texts loses only those that are copies. Rows without words stay.
    No rows: no rows. All columns of docs come through as they are, whatever their names.
    """
    rows, named = linked(docs, id_col, text_col, words, num, den)
    both = with_names(rows, named)
    first = F.col("doc_id").eqNullSafe(F.col("name.doc_id")) & (F.col("h") == F.col("name.h"))
    gone = stage(both.where(F.col("name").isNotNull() & ~first).select(F.col("doc_id").alias("k"), "h").distinct(), "join-gone")
    again = stage(rows.where("n > 0").groupBy("doc_id", "h").count().where("count > 1").select(F.col("doc_id").alias("k"), "h"), "join-again")
    discard(rows, named)
    row = docs.select(F.col(id_col).cast("long").alias("k"), F.xxhash64(text_col).alias("h"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    # rows outside the filter are kept without a shuffle
    row = flagged(row.withColumn("c", F.xxhash64("k", "h")), "c", gone.select(F.xxhash64("k", "h"))).drop("c")
    maybe = row.where("hit")
    on = lambda t, of: of["k"].eqNullSafe(t["k"]) & of["h"].eqNullSafe(t["h"])
    kept = row.where("not hit").union(maybe.join(gone, on(gone, maybe), "left_anti"))
    if again.limit(1).count():
        # rows of one id and text: all but one of them go
        many = kept.join(again, on(again, kept), "left_semi").groupBy("k", "h").agg(F.first("row").alias("row"))
        kept = kept.join(again, on(again, kept), "left_anti").select("row").union(many.select("row"))
    return kept.select("row.*")
