"""Keyed tables that streams merge into, and look-ups of streams in such a memory as it moves.

A table lies in buckets of its keys' hashes. A batch rewrites the buckets that it touches, and then a small version file names each bucket's folder;
readers follow the newest version, so they see a batch whole or not at all, and a batch that is run again changes nothing.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tmweave.operators import reuse


class KeyedTable:
    """The newest row (largest order) of each key, in a folder that driver and executors share. Null keys count as values. One stream writes it; readers may be many."""

    def __init__(self, spark: SparkSession, folder: str, schema: StructType | str, keys: list[str], order: list[str], buckets: int = 64):
        self.spark, self.folder, self.keys, self.order, self.buckets = spark, folder, keys, order, buckets
        self.schema = schema if isinstance(schema, StructType) else spark.createDataFrame([], schema).schema
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def version(self) -> tuple[int, dict[str, str]]:
        """The last batch (-1: none yet), and the folder of each bucket that holds rows."""
        found = self.fs.globStatus(self.path(f"{self.folder}/versions/*.json"))
        names = sorted(f.getPath().toString() for f in found) if found else []
        if not names:
            return -1, {}
        text = "".join(r.value for r in self.spark.read.text(names[-1]).collect())  # as many entries as buckets
        said = json.loads(text)
        return said["batch"], said["buckets"]

    def rows(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        """The table as of its newest version: one folder for each bucket, whatever the number of batches."""
        return self.rows(sorted(self.version()[1].values()))

    def newest(self, df: DataFrame) -> DataFrame:
        named = df.select(*self.schema.names)
        return named.groupBy(*self.keys).agg(F.max_by(F.struct(*self.schema.names), F.struct(*self.order)).alias("r")).select("r.*")

    def merge(self, batch: DataFrame, number: int) -> None:
        """Puts a batch's rows in. For foreachBatch: a number that is not after the last one is left alone; one that failed on its way writes its folder anew."""
        last, folders = self.version()
        if number <= last:
            return
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        fresh = self.newest(batch)
        touched = sorted(str(r.b) for r in fresh.select(bucket.alias("b")).distinct().collect())  # as many as buckets at most
        old = self.rows([folders[b] for b in touched if b in folders])
        here = f"{self.folder}/data/batch={number}"
        self.newest(old.unionByName(fresh)).withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(here)
        folders |= {b: f"{here}/bucket={b}" for b in touched}
        self.publish(number, folders)

    def publish(self, number: int, folders: dict[str, str]) -> None:
        """Writes a version beside its place and moves it there, which readers see as one step."""
        to = self.path(f"{self.folder}/versions/{number:020d}.json")
        new = self.path(f"{self.folder}/versions/.{number:020d}.new")
        out = self.fs.create(new, True)
        out.write(json.dumps({"batch": number, "buckets": folders}).encode())
        out.close()
        if not self.fs.rename(new, to):
            raise OSError(f"{to} could not be written")

    def clean(self) -> None:
        """Deletes versions but the newest and the buckets that it doesn't name. Not while older versions are being read."""
        number, folders = self.version()
        for f in self.fs.globStatus(self.path(f"{self.folder}/versions/*.json")) or []:
            if not f.getPath().getName().startswith(f"{number:020d}"):
                self.fs.delete(f.getPath(), False)
        live = {"/".join(x.split("/")[-2:]) for x in folders.values()}
        for f in self.fs.globStatus(self.path(f"{self.folder}/data/*/*")) or []:
            if "/".join(f.getPath().toString().split("/")[-2:]) not in live:
                self.fs.delete(f.getPath(), True)

    def follow(self, stream: DataFrame, checkpoint: str) -> None:
        """Merges all that a stream has, batch by batch."""
        stream.writeStream.foreachBatch(self.merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def reuse_as_it_moves(targets: DataFrame, memory, folder: str, checkpoint: str, **how) -> DataFrame:
    """Best translations of a stream of targets (item_id, language, source, namespace, path, context), each batch against the memory as it is then.

    memory() gives the candidates' table (reuse.candidates) at its newest version. Each batch writes a part of folder, which a batch that is run again replaces.
    """
    spark = targets.sparkSession

    def look_up(batch: DataFrame, number: int) -> None:
        reuse.best(batch, memory(), **how).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    targets.writeStream.foreachBatch(look_up).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    found = "item_id bigint, language string, target string, fuzzy int, fitness int, cand_item bigint, variants int"
    return spark.read.schema(found + ", batch bigint").parquet(folder).drop("batch")
