"""Vector codes: each part of a vector becomes the number of its nearest codebook entry, found by equal-average search.

A part's squared distance to an entry is at least the squared gap between their component sums over the part's
dimension (Cauchy-Schwarz). Entries lie sorted by sum; the search starts at the part's own sum, goes outward on both sides, and
a side ends once its bound strictly exceeds the best distance so far, so that ties are still met and go to the lower index.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, stage

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Rows coded together in a task.
TOGETHER = 4096
#: A label is hot if it holds more than 1/HOT of the rows, so there are fewer than HOT of them.
HOT = 1000
#: Bits of a limb, in which tasks hand in their sums, however wide.
LIMB = 40
LONG = 1 << 63

Codebook = list[list[list[int]]]  # part, entry, component


def whole(x: float) -> int:
    """floor(SCALE * x) of any finite double, exactly."""
    n, d = float(x).as_integer_ratio()
    return SCALE * n // d


def integers(flat: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), as int64 if all of them are small, else as Python's own integers."""
    x = flat.astype(np.float64)
    if not len(x) or np.abs(x).max() < 2.0**40:
        return np.floor(x * SCALE).astype(np.int64)
    out = np.empty(len(x), object)
    out[:] = [whole(v) for v in x.tolist()]
    return out


def cuts(dim: int, parts: int) -> list[int]:
    """Where parts start and end: equal, or by one component longer in front where the dimension isn't a multiple."""
    return [min(i, dim % parts) + i * (dim // parts) for i in range(parts + 1)]


def narrow(x: np.ndarray, dim: int) -> np.ndarray:
    """int64 where no squared distance of such components can leave it, else Python's integers."""
    top = max(map(abs, x.ravel().tolist()), default=0) if x.dtype == object else int(np.abs(x).max(initial=0))
    return x.astype(np.int64) if 8 * dim * dim * top * top < LONG else x.astype(object)


def search(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest entry and squared distance of each row of x, and how many distances it took.

    Squared gaps are compared with distance times dimension, all in integers.
    """
    n, dim = x.shape
    if not dim:
        return np.zeros(n, np.int64), np.zeros(n, np.int64), 0
    x, entries = narrow(x, dim), narrow(entries, dim)
    if x.dtype != entries.dtype:
        x, entries = x.astype(object), entries.astype(object)
    sums = entries.sum(axis=1)
    order = np.argsort(sums, kind="stable")
    sums, ranked, k = sums[order], entries[order], len(order)
    own = x.sum(axis=1)
    up = np.searchsorted(sums, own)
    down = up - 1
    best, which = np.zeros(n, x.dtype), np.full(n, k)
    lane, took = np.arange(n), 0
    while len(lane):
        # each lane looks at the nearer of its two next sums; a side at its end has no gap
        a, b = down[lane], up[lane]
        below = np.where(a >= 0, own[lane] - sums[np.maximum(a, 0)], 0)
        above = np.where(b < k, sums[np.minimum(b, k - 1)] - own[lane], 0)
        left = (a >= 0) & ((b >= k) | (below <= above).astype(bool))
        gap = np.where(left, below, above)
        on = ((a >= 0) | (b < k)) & ((which[lane] == k) | (gap * gap <= best[lane] * dim).astype(bool))
        lane, a, b, left = lane[on], a[on], b[on], left[on]
        if not len(lane):
            break
        at = np.where(left, a, b)
        diff = x[lane] - ranked[at]
        dist, entry = (diff * diff).sum(axis=1), order[at]
        took += len(lane)
        better = (which[lane] == k) | (dist < best[lane]).astype(bool) | ((dist == best[lane]).astype(bool) & (entry < which[lane]))
        best[lane[better]], which[lane[better]] = dist[better], entry[better]
        down[lane[left]] -= 1
        up[lane[~left]] += 1
    return which, best, took


def array_of(rows: list[list[int]], dim: int) -> np.ndarray:
    out = np.empty((len(rows), dim), object)
    for i, r in enumerate(rows):
        out[i, :] = r
    return narrow(out, max(dim, 1))


def usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """vec_id, vec, label of the rows whose vector is there and holds finite components only."""
    v = F.col("vec")
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vec"), F.col(label_col).alias("label"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return rows.where(v.isNotNull() & ~bad)


def vectors_of(b: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a batch have vectors of dim components, and those as integers."""
    col = b.column("vec")
    size = np.asarray(col.value_lengths())
    fits = np.flatnonzero(size == dim)
    flat = col.take(pa.array(fits)).flatten().to_numpy(zero_copy_only=False)
    return fits, integers(flat).reshape(len(fits), dim)


def first_codebook(rows: DataFrame, parts: int, entries: int) -> tuple[int | None, Codebook]:
    """Dimension, and the parts of the vectors with the smallest ids; ties by the vectors, null ids last."""
    order = [F.col("vec_id").asc_nulls_last(), F.col("vec")]
    first = rows.orderBy(*order).select(F.size("vec").alias("n")).first()
    if first is None:
        return None, []
    head = rows.where(F.size("vec") == F.lit(first.n)).orderBy(*order).limit(entries).select("vec").collect()
    ints = [[whole(x) for x in r.vec] for r in head]
    at = cuts(len(ints[0]), parts)
    return len(ints[0]), [[v[a:b] for v in ints] for a, b in zip(at, at[1:], strict=False)]


def limbs(v: int) -> list[int]:
    """v in pieces of LIMB bits, each with v's sign."""
    sign, v, out = (-1 if v < 0 else 1), abs(v), []
    while v or not out:
        out.append(sign * (v & ((1 << LIMB) - 1)))
        v >>= LIMB
    return out


def moved(rows: DataFrame, dim: int, book: Codebook) -> Codebook:
    """The codebook after one round: floored means of what each entry is nearest to. Tasks hand in sums by entry, not vectors."""
    at = cuts(dim, len(book))
    books = [array_of(e, b - a) for e, a, b in zip(book, at, at[1:], strict=False)]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = defaultdict(int), {}
        for b in batches:
            for lo in range(0, b.num_rows, TOGETHER):
                _, x = vectors_of(b.slice(lo, TOGETHER), dim)
                for p, e in enumerate(books):
                    part = x[:, at[p] : at[p + 1]]
                    which, _, _ = search(part, e)
                    for i in np.unique(which).tolist() if len(which) else ():
                        mine = part[which == i]
                        count[p, i] += len(mine)
                        new = [int(s) for s in mine.sum(axis=0)]
                        total[p, i] = [s + t for s, t in zip(total.get((p, i), [0] * len(new)), new, strict=True)]
        out = [(p, i, -1, 0, n) for (p, i), n in count.items()]
        out += [(p, i, c, j, y) for (p, i), s in total.items() for c, v in enumerate(s) for j, y in enumerate(limbs(v))]
        names, kinds = ["part", "entry", "component", "limb", "value"], [pa.int32()] * 4 + [pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=names)

    found = rows.select("vec").mapInArrow(sums, "part int, entry int, component int, limb int, value bigint").groupBy("part", "entry", "component", "limb").agg(F.sum("value").alias("value")).collect()
    count, total = {}, defaultdict(int)
    for r in found:
        if r.component < 0:
            count[r.part, r.entry] = r.value
        else:
            total[r.part, r.entry, r.component] += r.value << (LIMB * r.limb)
    return [[[total[p, i, c] // count[p, i] for c in range(len(e))] if (p, i) in count else e for i, e in enumerate(es)] for p, es in enumerate(book)]


def digest(book: Codebook) -> str:
    return hashlib.sha256(",".join(str(c) for part in book for e in part for c in e).encode()).hexdigest()


def coded(rows: DataFrame, dim: int, book: Codebook) -> DataFrame:
    """vec_id, label, code, error of each row."""
    at = cuts(dim, len(book))
    books = [array_of(e, b - a) for e, a, b in zip(book, at, at[1:], strict=False)]
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, TOGETHER):
                s = b.slice(lo, TOGETHER)
                fits, x = vectors_of(s, dim)
                code, error = [None] * s.num_rows, [None] * s.num_rows
                found = [search(x[:, at[p] : at[p + 1]], e)[:2] for p, e in enumerate(books)]
                which = np.stack([w for w, _ in found], axis=1).astype(">u1" if len(book[0]) <= 256 else ">u2")
                width = 2 * which.dtype.itemsize * len(book)
                text = which.tobytes().hex()
                whole_error = sum(d.astype(object) for _, d in found)
                for i, r in enumerate(fits.tolist()):
                    code[r] = text[i * width : (i + 1) * width]
                    error[r] = int(whole_error[i]) if whole_error[i] < LONG else None
                yield pa.RecordBatch.from_arrays([s.column("vec_id"), s.column("label"), pa.array(code, pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    return rows.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error bigint")


def with_label_errors(codes: DataFrame) -> DataFrame:
    """Adds label_error. Hot labels, of which there are fewer than HOT, are broadcast; no other label holds more than 1/HOT of the rows."""
    # an error or a sum that no long holds makes its label's sum null
    whole_sum = F.when(F.count("error") == F.count(F.lit(1)), F.sum(F.col("error").cast("decimal(38,0)")).try_cast("bigint"))
    labels = codes.groupBy(F.col("label").alias("l")).agg(whole_sum.alias("label_error"), F.count(F.lit(1)).alias("n"))
    cut = codes.agg((F.count(F.lit(1)) / F.lit(HOT)).alias("cut")).first().cut
    hot = labels.where(F.col("n") > cut).withColumn("hot", F.lit(True))
    same = F.col("label").eqNullSafe(F.col("l"))
    seen = codes.join(F.broadcast(hot), same, "left").drop("l", "n")
    rare = seen.where("hot IS NULL").drop("hot", "label_error").join(labels.where(F.col("n") <= cut), same).drop("l", "n")
    return seen.where("hot").drop("hot").unionByName(rare)


def train(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[int | None, Codebook]:
    """Dimension and codebooks of usable rows after the rounds."""
    dim, book = first_codebook(rows, parts, entries)
    for _ in range(rounds if book else 0):
        book = moved(rows, dim, book)
    return dim, book


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, label, code, error, label_error, codebooks_sha256 of each usable row.

    Rows whose vector is null or holds null or non-finite components go. The dimension is that of the row with the smallest id; rows of other
    dimensions stay, with a null code and error, and train nothing (a label with such a row has a null sum). With fewer vectors than entries there are as many entries as vectors. A dimension that
    isn't a multiple of the parts gives the first parts one component more; empty parts have code 0 and no error. Repeated rows count each. Null ids come last.
    Integers are exact however large; an error beyond a long is null. No rows: no rows. Other columns don't come through.

    The input is read once for each round and once for the codes, never shuffled; tasks hand in sums for parts x entries.
    """
    ship(vectors.sparkSession)
    rows = usable(vectors, id_col, vector_col, label_col)
    dim, book = train(rows, parts, entries, rounds)
    if dim is None:
        out = rows.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"), F.lit(None).cast("long").alias("label_error")).where("false")
    else:
        out = with_label_errors(stage(coded(rows, dim, book), "vector-codes"))
    return out.withColumn("codebooks_sha256", F.lit(digest(book)))

