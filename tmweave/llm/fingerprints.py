"""Document fingerprints: bottom-k sketches of shingle hashes, in Spark's own functions only.

A sketch is the sorted array of the k smallest distinct 64-bit hashes of a text's five-word shingles (fewer words: the
whole sequence is one shingle; no words: none). Sketches of parts merge into the sketch of the whole; two
sketches estimate resemblance, containment and distinct counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stage

K, WORDS = 128, 5
_LEAST = -(2**63)


def with_sketch(df: DataFrame, text: str, out: str, k: int = K, words: int = WORDS) -> DataFrame:
    """Adds the sketch of df[text] as array<bigint>. A null text counts as empty and has an empty sketch."""
    w, h = f"_{out}_w", f"_{out}_h"
    df = df.withColumn(w, F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(WORD), F.lit(0)))
    df = df.withColumn(h, F.transform(F.col(w), lambda x: F.xxhash64(x)))
    long = F.transform(F.sequence(F.lit(0), F.size(h) - words), lambda i: F.xxhash64(*[F.get(F.col(h), (i + j).cast("int")) for j in range(words)]))
    short = F.when(F.size(h) > 0, F.array(F.xxhash64(F.col(h)))).otherwise(F.array().cast("array<bigint>"))
    hashes = F.when(F.size(h) >= words, long).otherwise(short)
    return df.withColumn(out, F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)).drop(w, h)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of both texts' shingles together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness, exact where both have fewer than k shingles together; two empty sketches are alike (1)."""
    both = merged(a, b, k)
    return F.when(F.size(both) == 0, 1.0).otherwise(F.size(F.array_intersect(both, F.array_intersect(a, b))) / F.size(both)).cast("double")


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    last = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(k - 1.0) / last)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated part of a's shingles that b has, too; 1 for an empty a."""
    shared = resemblance(a, b, k) * distinct_count(merged(a, b, k), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), shared / distinct_count(a, k)))


def as_string(a: Column) -> Column:
    """16 hex digits per hash, in order."""
    return F.lower(F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def in_ranges(ids: DataFrame, parts: int) -> DataFrame:
    """ids: distinct k, h. Adds part: rows by k descending, then h, in that many ranges. Written, so that they stay where they were dealt: one file a range."""
    return stage(ids.repartitionByRange(parts, F.col("k").desc(), F.col("h")).withColumn("part", F.spark_partition_id()), "next-ids")


def next_rows(dealt: DataFrame) -> DataFrame:
    """dealt: rows in ranges (in_ranges). Adds nk, nh of the following row; after the last comes the first.

    Within a range the next row is a window's lead, and only one row per range is passed on between ranges.
    """
    w = Window.partitionBy("part").orderBy(F.col("k").desc(), F.col("h"))
    led = dealt.withColumn("nx", F.lead(F.struct("k", "h")).over(w)).withColumn("nth", F.row_number().over(w))
    heads = led.where("nth = 1").select("part", F.struct("k", "h").alias("head"))
    order = Window.orderBy("part")
    heads = heads.select("part", F.coalesce(F.lead("head").over(order), F.first("head").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"))
    led = led.join(heads, "part").withColumn("nx", F.coalesce("nx", "after"))
    return led.drop("part", "nth", "after").withColumns({"nk": F.col("nx.k"), "nh": F.col("nx.h")}).drop("nx")


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, words: int = WORDS) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike it is to the edited and to the next text.

    Edited: the last floor(n/3) code points give way to the first as many (or all) of the next document, by descending
    id, after the last the first. A null text is empty; a null id comes last; rows of one id are ordered by a hash of
    their text; rows with the same id and text are one document in that order and each get its values. A single
    document is its own next. An empty table gives no rows. Other columns of docs don't come through.
    """
    spark = docs.sparkSession
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LEAST)).alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = base.withColumn("h", F.xxhash64("text"))
    ids = in_ranges(base.select("k", "h", F.length("text").alias("n")).groupBy("k", "h", "n").agg(F.count("*").alias("rows")), int(spark.conf.get("spark.sql.shuffle.partitions")))
    repeated = ids.where("rows > 1").limit(1).count() > 0
    link = next_rows(ids.drop("rows"))
    full = with_sketch(base, "text", "sketch", k, words)
    once = full.dropDuplicates(["k", "h"]) if repeated else full
    link, once = link.alias("l"), once.alias("d")
    sent = link.join(once, (F.col("l.nk") == F.col("d.k")) & (F.col("l.nh") == F.col("d.h"))).select(
        F.col("l.k").alias("k"), F.col("l.h").alias("h"), F.substring(F.col("d.text"), F.lit(1), F.floor(F.col("l.n") / 3).cast("int")).alias("tail"), F.col("d.sketch").alias("next_sketch"))
    both = full.join(sent, ["k", "h"]).withColumn("n_chars", F.length("text").cast("long"))
    keep = F.col("n_chars") - F.floor(F.col("n_chars") / 3)
    both = both.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), keep.cast("int")), F.col("tail")))
    both = with_sketch(both, "edited", "edited_sketch", k, words)
    a, e, x = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return both.select(
        F.when(F.col("k") != _LEAST, F.col("k")).alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_string(a).alias("fingerprint"), as_string(e).alias("edited_fingerprint"),
        resemblance(a, e, k).alias("near_edited"), resemblance(a, x, k).alias("near_next"), distinct_count(a, k).alias("n_shingles_est"), containment(a, e, k).alias("kept_in_edited"),
    )
