"""Folders that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_own: dict[str, str] = {}


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir; a local master may leave it unset and gets a folder of our own."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not base and sc.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not base:
        base = _own.setdefault(sc.applicationId, "file://" + tempfile.mkdtemp(prefix="spark-tmweave-"))
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
