"""Exact top-k search by multi-resolution segment statistics.

Vectors are integers, floor(1024 * x). Each has, for 1, 4, 16 segments, every segment's mean and deviation. With them a
distance has the lower bound sum(L * ((mean_q - mean_v)^2 + (dev_q - dev_v)^2)) over segments of length L,
and so the inner product (|q|^2 + |v|^2 - distance) / 2 an upper one. Vectors with like signs of segment means lie in one block, and a
block knows the least and largest of each statistic, which bounds all its vectors at once.

Every block of queries first meets the candidate blocks with its best bounds; the k-th score found there is each query's
threshold. Of all other pairs of blocks only those go on in which some query's bound reaches its threshold, and only then are the vectors themselves
brought together: ever finer bounds drop candidates, and exact scores are computed for those left.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, ship, stage

K, SCALE, LEVELS = 10, 1024, (1, 4, 16)
#: Vectors in a block of candidates and of queries; candidate blocks whose bounds are looked at together; blocks that give a block of queries its thresholds.
ROWS, QUERIES, CHUNK, FIRST = 16384, 512, 512, 2
PACKED = "block bigint, dim int, n int, ids binary, vecs binary, low binary, high binary"
FOUND = "query_id bigint, q_no bigint, vec_id bigint, score bigint"


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id and the vector in doubles; vectors that are null or hold null, NaN or infinite components take no part, nor do rows without an id."""
    x = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("v")).where("vec_id is not null and v is not null")
    return rows.where(F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf"))))


def matrices(ids: pa.Array, vecs: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, positions, matrix) for the vectors of each length."""
    start, flat = vecs.offsets.to_numpy(), vecs.values.to_numpy(zero_copy_only=False)
    length = np.diff(start)
    for d in np.unique(length).tolist():
        at = np.flatnonzero(length == d)
        yield d, at, flat[(start[at][:, None] + np.arange(d)).ravel()].reshape(len(at), d)


def keyed(rows: DataFrame, scale: int) -> DataFrame:
    """vec_id, dim, code, vec: the vector times scale, rounded down; code has the signs of its segments' means as bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("vec_id").to_numpy()
            for d, at, x in matrices(b.column("vec_id"), b.column("v")):
                with np.errstate(over="ignore"):
                    m = np.floor(x * scale) + 0.0
                if not np.isfinite(m).all():
                    raise OverflowError("a component times the scale is beyond a double")
                s = min(max(LEVELS), d)
                code = np.zeros(len(at), np.int64)
                for p in np.array_split(np.arange(d), s) if s else []:
                    code = code * 2 + (m[:, p].mean(1) > 0)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(np.full(len(at), d), pa.int32()), pa.array(code), pa.array([v.tobytes() for v in m], pa.binary())], names=["vec_id", "dim", "code", "vec"])

    return rows.mapInArrow(run, "vec_id bigint, dim int, code bigint, vec binary")


def statistics(m: np.ndarray, s: int) -> np.ndarray:
    """Means and deviations of s segments, each times the root of its length: products of these rows are parts of the bound."""
    parts = np.array_split(np.arange(m.shape[1]), s)
    mean = np.stack([m[:, p].mean(1) * np.sqrt(len(p)) for p in parts], 1)
    dev = np.stack([m[:, p].std(1) * np.sqrt(len(p)) for p in parts], 1)
    return np.concatenate([mean, dev], 1)


def levels_of(dim: int) -> list[int]:
    return [s for s in LEVELS if s <= dim]


def packed(rows: DataFrame, size: int) -> DataFrame:
    """One row for each block of up to size vectors of one dimension that lie next to each other by code."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        made, held, dim = TaskContext.get().partitionId() << 32, [], None

        def emit() -> pa.RecordBatch:
            nonlocal made
            ids, m = np.array([i for i, _ in held], np.int64), np.frombuffer(b"".join(v for _, v in held)).reshape(len(held), dim)
            with np.errstate(over="ignore", invalid="ignore"):
                all_stats = np.concatenate([statistics(m, s) for s in levels_of(dim)] or [np.zeros((len(m), 0))], 1)
            low, high = all_stats.min(0), all_stats.max(0)
            made += 1
            one = [[made], [dim], [len(ids)], [ids.tobytes()], [m.tobytes()], [low.tobytes()], [high.tobytes()]]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(one, (pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 4), strict=True)], names=[x.split()[0] for x in PACKED.split(", ")])

        for b in batches:
            for i, d, v in zip(*(b.column(c).to_pylist() for c in ("vec_id", "dim", "vec")), strict=True):
                if held and (d != dim or len(held) >= size):
                    yield emit()
                dim = d
                held.append((i, v))
        if held:
            yield emit()

    order = ["dim", "code", "vec_id"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pack, PACKED)


def exact(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers: by doubles or 64-bit integers where those hold all of them, else by Python's."""
    big = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(1, q.shape[1])
    if big < 2.0**53:
        return (q @ v.T).astype(np.int64)
    if big < 2.0**62:
        return q.astype(np.int64) @ v.astype(np.int64).T
    whole = lambda m: np.array([[int(x) for x in r] for r in m.tolist()], object).reshape(m.shape)
    return np.dot(whole(q), whole(v).T)


def loose(bound: np.ndarray, q: np.ndarray, reach: float) -> np.ndarray:
    """Bounds with room for rounding; where doubles don't hold them, no bound at all."""
    slack = 1e-9 * np.sqrt((q**2).sum(1)).max(initial=0) * reach + 1e-3
    return np.nan_to_num(bound + slack, nan=np.inf, posinf=np.inf, neginf=np.inf)


def search(qi: np.ndarray, q: np.ndarray, vi: np.ndarray, v: np.ndarray, k: int, least: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its best k in this block, by score, then smaller id; never itself. least: scores below which a query needs none."""
    with np.errstate(over="ignore", invalid="ignore"):
        levels = levels_of(q.shape[1])
        qs, vs = [statistics(q, s) for s in levels], [statistics(v, s) for s in levels]
        reach = np.sqrt((v**2).sum(1)).max(initial=0)
        first = loose(qs[0] @ vs[0].T, q, reach) if levels else np.full((len(q), len(v)), np.inf)
        for i in range(len(q)):
            bound = first[i]
            alive = np.flatnonzero(vi != qi[i])
            floor = -np.inf if least is None else least[i]
            if len(alive) > 4 * k and levels:
                seeds = alive[np.argpartition(-bound[alive], k)[: 2 * k]]
                floor = max(floor, np.sort(exact(q[i : i + 1], v[seeds])[0])[-k])
                for a, b in zip(qs, vs, strict=True):
                    bound = bound[alive] if b is vs[0] else loose(b[alive] @ a[i], q, reach)
                    alive = alive[bound >= floor]
            score = exact(q[i : i + 1], v[alive])[0]
            best = np.lexsort((vi[alive], -score))[:k]
            yield i, vi[alive][best], score[best]


def read(x: dict, prefix: str = "") -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(x[f"{prefix}ids"], np.int64)
    return ids, np.frombuffer(x[f"{prefix}vecs"]).reshape(len(ids), x["dim"])


def bounds(x: dict) -> np.ndarray:
    """For a block of queries and a chunk of candidate blocks, the best score that each query may find in each block."""
    _, q = read(x, "q_")
    low, high = (np.array([np.frombuffer(b[c]) for b in x["blocks"]]) for c in ("low", "high"))
    best, at = np.full((len(q), len(low)), np.inf), 0
    with np.errstate(over="ignore", invalid="ignore"):
        for s in levels_of(x["dim"]):
            a, part = statistics(q, s), slice(at, at + 2 * s)
            lo, hi, at = low[:, part], high[:, part], at + 2 * s
            reach = np.sqrt(np.maximum(lo**2, hi**2).sum(1)).max(initial=0)
            best = np.minimum(best, loose(np.maximum(a, 0) @ hi.T + np.minimum(a, 0) @ lo.T, q, reach))
    return best


def each_cell(cells: DataFrame, f: Callable[[np.ndarray, dict], list[tuple]], schema: str) -> DataFrame:
    """Rows that f makes of the bounds of every block of queries and chunk of candidate blocks."""
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                x = b.slice(i, 1).to_pylist()[0]
                if rows := f(bounds(x), x):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if t == "bigint" else pa.float64()) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(names))

    return cells.mapInArrow(run, schema)


def searched(pairs: DataFrame, cand: DataFrame, ask: DataFrame, k: int) -> DataFrame:
    """What the queries of each pair (q_block, block) find there: query_id, q_no (its block and place), vec_id, score. The small queries travel to the blocks."""
    asking = pairs.join(ask.select(F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("vecs").alias("q_vecs"), "least"), "q_block")
    cells = asking.join(cand.select("block", "dim", "ids", "vecs"), "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                x = b.slice(i, 1).to_pylist()[0]
                (vi, v), (qi, q) = read(x), read(x, "q_")
                out = list(search(qi, q, vi, v, k, None if x["least"] is None else np.array(x["least"])))
                at = np.concatenate([np.full(len(a), n) for n, a, _ in out]).astype(np.int64)
                score = [int(y) for _, _, s in out for y in s]
                if any(not -(2**63) <= y < 2**63 for y in score):
                    raise OverflowError("a score is beyond 64 bits")
                cols = [qi[at], (x["q_block"] << 12) + at, np.concatenate([a for _, a, _ in out]), score]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[x.split()[0] for x in FOUND.split(", ")])

    return cells.select("dim", "ids", "vecs", "q_block", "q_ids", "q_vecs", "least").mapInArrow(run, FOUND)


def top_k(vectors: DataFrame, query: str = "vec_id % 100 = 0", id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best other vectors (all, if fewer) by integer inner product, ties to the smaller id.

    Vectors of another length than the query's take no part in its search. Rows with one id are candidates each, whether their vectors agree or not, but never for a query
    of that id. A query row that is repeated is answered once; one id with several different vectors is answered for each of them. No usable vectors: no rows.
    Components of any finite size take part; a score in a result that 64 bits don't hold, or a component times scale that a double doesn't, raises OverflowError.
    """
    ship(vectors.sparkSession)
    rows = keyed(usable(vectors, id_col, vec_col), scale)
    cand = stage(packed(rows, ROWS), "topk-blocks")
    ask = stage(packed(rows.where(query).dropDuplicates(["vec_id", "dim", "vec"]), QUERIES).withColumn("least", F.lit(None).cast("array<double>")), "topk-queries")
    chunks = 1 + cand.count() // CHUNK
    meta = cand.select("dim", F.pmod(F.xxhash64("block"), F.lit(chunks)).alias("chunk"), F.struct("block", "low", "high").alias("b")).groupBy("dim", "chunk").agg(F.collect_list("b").alias("blocks"))
    meta = stage(meta, "topk-bounds")  # about CHUNK rows in each list, by construction

    def cells(asking: DataFrame) -> DataFrame:
        q = asking.select("dim", F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("vecs").alias("q_vecs"), "least", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("chunk"))
        return q.join(meta, ["dim", "chunk"])

    def best(bound: np.ndarray, x: dict) -> list[tuple]:
        mean = bound.mean(0)
        return [(x["q_block"], x["blocks"][i]["block"], float(mean[i])) for i in np.argsort(-mean)[:FIRST]]

    def reached(bound: np.ndarray, x: dict) -> list[tuple]:
        return [(x["q_block"], x["blocks"][i]["block"]) for i in np.flatnonzero((bound >= np.array(x["least"])[:, None]).any(0))]

    near = each_cell(cells(ask), best, "q_block bigint, block bigint, bound double")
    nth = F.row_number().over(Window.partitionBy("q_block").orderBy(F.col("bound").desc(), "block"))
    near = stage(near.withColumn("nth", nth).where(F.col("nth") <= FIRST).select("q_block", "block"), "topk-first")
    found = stage(searched(near, cand, ask, k), "topk-found")
    place = F.row_number().over(Window.partitionBy("q_no").orderBy(F.col("score").desc(), "vec_id"))
    kth = found.withColumn("nth", place).where(F.col("nth") == k).select(F.shiftright("q_no", 12).alias("block"), F.struct((F.col("q_no") % 4096).cast("int").alias("at"), F.col("score").cast("double").alias("s")).alias("x"))
    kth = kth.groupBy("block").agg(F.map_from_entries(F.collect_list("x")).alias("kth"))  # QUERIES entries at most
    # a score in doubles may be rounded up: one part in 2**50 is taken off
    least = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.coalesce(F.try_element_at("kth", i) - F.abs(F.try_element_at("kth", i)) * 2.0**-50, F.lit(float("-inf"))))
    asked = stage(ask.drop("least").join(kth, "block", "left").withColumn("kth", F.coalesce("kth", F.create_map().cast("map<int,double>"))).withColumn("least", least).drop("kth"), "topk-asked")
    rest = stage(each_cell(cells(asked), reached, "q_block bigint, block bigint").join(near, ["q_block", "block"], "left_anti"), "topk-rest")
    more = stage(searched(rest, cand, asked, k), "topk-more")
    discard(cand, ask, meta, near, asked, rest)
    rank = F.row_number().over(Window.partitionBy("q_no").orderBy(F.col("score").desc(), "vec_id"))
    return found.union(more).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
