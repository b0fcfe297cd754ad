"""Incremental work: unchanged files are skipped, changes are numbered, and streams keep the memory's reports current."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def changed_files(files: DataFrame, seen: DataFrame) -> DataFrame:
    """Files whose (path, hash) wasn't seen."""
    return files.join(seen.select("path", "hash"), ["path", "hash"], "left_anti")


def changed_stream(files: DataFrame, seen: DataFrame) -> DataFrame:
    """As changed_files, for a stream of files: each version (path, hash) comes once, in the batch that brings it first; seen is static.

    Null paths and hashes count as values of their own. The state holds a row per version; a watermark on the stream doesn't shorten it.
    """
    return changed_files(files, seen).dropDuplicates(["path", "hash"])


def stale(now: DataFrame, before: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows of now that before lacks or differs from, with the reasons: missing, or the values' names."""
    b = before.select(*keys, *[F.col(v).alias(f"_{v}") for v in values], F.lit(1).alias("_has"))
    x = now.join(b, keys, "left")
    why = [F.when(F.col("_has").isNull(), "missing"), *[F.when(F.col("_has").isNotNull() & ~F.col(v).eqNullSafe(F.col(f"_{v}")), v) for v in values]]
    return x.withColumn("reason", F.array_compact(F.array(*why))).where(F.size("reason") > 0).select(*now.columns, "reason")


def latest(writes: DataFrame) -> DataFrame:
    """The last write of each item and language by usn; for batches and streams."""
    return writes.groupBy("item_id", "language").agg(F.max(F.struct("usn", "string", "fuzzy")).alias("w")).select("item_id", "language", "w.usn", "w.string", "w.fuzzy")


def high_water(writes: DataFrame) -> DataFrame:
    """The highest usn of each file and language; for batches and streams."""
    return writes.groupBy("file_id", "language").agg(F.max("usn").alias("usn"))


def completeness(done: DataFrame, totals: DataFrame) -> DataFrame:
    """Ratio of translated items as translations arrive. done: file_id, language of translations that aren't fuzzy; totals: file_id, total (static)."""
    n = done.join(totals, "file_id").groupBy("file_id", "language").agg(F.count("*").alias("translated"), F.first("total").alias("total"))
    return n.withColumn("ratio", F.col("translated") / F.col("total"))


def reuse(units: DataFrame, best: DataFrame) -> DataFrame:
    """New units looked up in the memory as they arrive. best: source, language, target (static, one row each)."""
    return units.join(best, ["source", "language"])


def run(stream: DataFrame, folder: str, mode: str, checkpoint: str, keys: list[str] | None = None) -> DataFrame:
    """Runs a stream over all that is there and gives its result table, which lies as Parquet in folder, one part for each batch.

    append: all batches' rows; a batch that is run again replaces its part. update: each batch holds the rows that it changed, and the last
    batch that wrote a key (keys) gives its row. Results never pass through the driver.
    """
    if mode not in ("append", "update") or mode == "update" and not keys:
        raise ValueError("append, or update with keys")
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    schema = StructType([*(StructField(f.name, f.dataType) for f in stream.schema), StructField("batch", LongType())])
    if not any_batch(spark, folder):
        return spark.createDataFrame([], stream.schema)
    rows = spark.read.schema(schema).parquet(folder)
    if mode == "append":
        return rows.select(*stream.columns)
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*stream.columns), "batch").alias("r"))
    return last.select("r.*")


def any_batch(spark: SparkSession, folder: str) -> bool:
    """Whether a batch has been written to folder, in this run of the stream or an earlier one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def any_reason(rows: DataFrame, reasons: list[str]) -> DataFrame:
    return rows.where(reduce(lambda a, r: a | F.array_contains("reason", r), reasons, F.lit(False)))
