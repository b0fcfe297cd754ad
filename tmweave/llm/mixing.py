"""Mix sources to target weights by systematic sampling.

Each source's target is turned into an expected number of copies for each of its documents. Documents
of a source stand in one order (by size, so that small and large ones are drawn alike), the expected copies
are summed up along it, one random offset per source is added, and a document is emitted once for every
integer that the sum passes while crossing it. A document that is large against the target has a whole number as expectation, chosen from the
largest down so that what the large ones take stays nearest to their share; the small ones' expectation is whatever then leads to the target.
The running sums come from three levels of counts (rows with one size and bucket, sizes in a band, bands in a source), so no task ever holds a whole source.
"""

from __future__ import annotations

import math

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import stage, word_count

#: Rows of a source and size are ranked in so many parts; sizes are summed in bands of so many.
BUCKETS, BAND = 1024, 256
#: A document is large if so many of its size are more than the target. A source has no more than LARGE * source_size / target of them.
LARGE = 100


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """sizes: skey, source, source_size, one row per source. Adds target.

    Sources in the order of their names' code points (null last) get the weights in turn and share the sum of all
    sizes by weight; no target is over cap times its source's size, and what is cut off is shared by weight among the
    others until none is above. That is the level x with sum(least(cap_i, weight_i * x)) = total: with sources sorted by
    cap / weight it is the largest of (total - caps before) / (weights from here on). One row per source, so the
    windows over all rows are small.
    """
    everyone = Window.orderBy(F.col("source").asc_nulls_last())
    up = Window.orderBy("_full", "skey")
    picks = F.array(*[F.lit(float(w)) for w in weights])
    out = sizes.withColumn("_w", F.get(picks, ((F.row_number().over(everyone) - 1) % len(weights)).cast("int")))
    out = out.withColumn("_cap", F.col("source_size") * F.lit(float(cap))).withColumn("_full", F.col("_cap") / F.col("_w"))
    whole = Window.partitionBy()
    before = F.coalesce(F.sum("_cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("_w").over(up.rowsBetween(0, Window.unboundedFollowing))
    out = out.withColumn("_x", (F.sum("source_size").over(whole) - before) / rest)
    out = out.withColumn("target", F.least("_cap", F.col("_w") * F.max("_x").over(whole)))
    return out.select("skey", "source", "source_size", "target")


def offset(seed: int, skey: Column) -> Column:
    """A number in [0, 1) for each source; the same on every run."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), skey)), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def whole_copies(large: DataFrame, cap: float) -> DataFrame:
    """large: skey, doc_id, row_hash, size, source_size, target. Adds copies: whole numbers that keep the sum of size * copies nearest to the share of a source's documents, from the largest down."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, sort_keys=[("size", "descending"), ("doc_id", "ascending"), ("row_hash", "ascending")], null_placement="at_start"))
        rate = rows.column("target")[0].as_py() / rows.column("source_size")[0].as_py()
        owed, out = 0.0, []
        for size in rows.column("size").to_pylist():
            out.append(min(max(math.floor(rate + owed / size + 0.5), 0), math.floor(cap)))
            owed += size * (rate - out[-1])
        return rows.append_column("copies", pa.array(out, pa.int64()))

    return large.groupBy("skey").applyInArrow(run, StructType([*large.schema, StructField("copies", LongType())]))


def plan_copies(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0, seed: int = 17) -> DataFrame:
    """One row for each row of docs: doc_id, row_hash, size, source_size, target, copies.

    Null text has size 0; a null source is a source of its own; a null doc_id stands first among rows of one size.
    Repeated rows are ranked one after the other, as documents of their own. No rows: no rows. Other columns of docs
    don't matter and don't come through. A document gets 0 to ceil(cap) copies. What a source takes misses its target by about the size of a small document; by more only
    if it has too few of those: then by half of its smallest large one, at most. Texts of any length are counted whole.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        word_count(F.col(text_col)).alias("size"), F.xxhash64(F.col(text_col), F.col(source_col)).alias("row_hash"),
    )
    rows = rows.withColumn("skey", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")))
    rows = rows.withColumn("bucket", F.coalesce(F.pmod("doc_id", F.lit(BUCKETS)), F.lit(-1)).cast("int"))
    rows = stage(rows, "mix-sizes")
    cells = rows.groupBy("skey", "source", "size", "bucket").agg(F.count("*").alias("c"))
    cells = cells.withColumn("band", (F.col("size") / BAND).cast("long"))
    sizes = cells.groupBy("skey", "source").agg(F.sum(F.col("c") * F.col("size")).alias("source_size"))
    level = stage(targets(sizes, weights, cap).drop("source").coalesce(1), "mix-targets")
    is_large = F.col("size") * LARGE > F.col("target")
    split = cells.drop("source").join(level, "skey").withColumn("large", is_large & (F.col("size") > 0))

    large = rows.join(split.where("large").select("skey", "size", "bucket", "source_size", "target"), ["skey", "size", "bucket"])
    took = stage(whole_copies(large.select("skey", "doc_id", "row_hash", "size", "source_size", "target"), cap), "mix-took")

    small = split.where("not large")
    before = lambda over, by: F.coalesce(F.sum("c").over(Window.partitionBy(*over).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    by_size = small.groupBy("skey", "band", "size").agg(F.sum("c").alias("c"))
    by_band = by_size.groupBy("skey", "band").agg(F.sum("c").alias("c"), F.sum(F.col("c") * F.col("size")).alias("words"))
    left = took.groupBy("skey").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"))
    words = by_band.groupBy("skey").agg(F.sum("words").alias("words"))
    rate = (F.col("target") - F.coalesce("taken", F.lit(0))) / F.col("words")
    rates = level.join(words, "skey").join(left, "skey", "left").select("skey", "source_size", "target", F.when(F.col("words") > 0, F.least(F.greatest(rate, F.lit(0.0)), F.lit(float(cap)))).otherwise(0.0).alias("rate"))
    by_band = by_band.withColumn("b3", before(["skey"], "band")).drop("c", "words").join(rates, "skey")
    by_size = by_size.withColumn("b2", before(["skey", "band"], "size")).drop("c")
    places = small.select("skey", "band", "size", "bucket", before(["skey", "size"], "bucket").alias("b1"))
    places = places.join(by_size, ["skey", "band", "size"]).join(by_band, ["skey", "band"])
    places = places.select("skey", "size", "bucket", "source_size", "target", "rate", (F.col("b1") + F.col("b2") + F.col("b3")).alias("before"))
    out = rows.drop("source").join(places, ["skey", "size", "bucket"])
    rank = F.col("before") + F.row_number().over(Window.partitionBy("skey", "size", "bucket").orderBy("doc_id", "row_hash"))
    out = out.withColumn("rank", rank).withColumn("u", offset(seed, F.col("skey")))
    upto = lambda k: F.floor(F.col("rate") * k + F.col("u"))
    names = ["doc_id", "row_hash", "size", "source_size", "target"]
    return out.select(*names, (upto(F.col("rank")) - upto(F.col("rank") - 1)).alias("copies")).union(took.select(*names, "copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **how) -> DataFrame:
    """The mix itself: every row of docs, with all its columns, whatever their names, as often as plan_copies() says (0 times: not at all).

    Rows that agree in id, source and text are drawn together and emitted as often as all of them are. No rows: no rows.
    """
    none = F.lit(-(2**63))
    plan = plan_copies(docs, id_col, source_col, text_col, **how)
    plan = plan.select(F.coalesce("doc_id", none).alias("k"), F.col("row_hash").alias("h"), "copies").groupBy("k", "h").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    plan = stage(plan.where("copies > 0"), "mix-plan")
    keyed = docs.select(F.coalesce(F.col(id_col).cast("long"), none).alias("k"), F.xxhash64(F.col(text_col), F.col(source_col)).alias("h"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    if plan.where("rows > 1").limit(1).count():
        keyed = keyed.groupBy("k", "h").agg(F.first("row").alias("row"))
    out = keyed.join(plan, ["k", "h"])
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
