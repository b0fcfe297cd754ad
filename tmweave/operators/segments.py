"""Units cut into segments and put together again: what stands between segments is kept, so nothing is lost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What paragraphs, lines and sentences are parted by.
PARAGRAPHS, LINES = r"^\n|\n{2,}|\n\z", r"\n+"
SENTENCES = r"(?<=[.!?])\s+(?=\S)"


def pieces(s: Column, separator: str = PARAGRAPHS, sentences: bool = False) -> Column:
    """Array of (text, after) structs: texts in order, each with the separator after it ('' after the last). Their concatenation is the string."""
    form = f"{separator}|{SENTENCES}" if sentences else separator
    between = F.concat(F.regexp_extract_all(s, F.lit(f"({form})"), F.lit(1)), F.array(F.lit("")))
    return F.zip_with(F.split(s, form, -1), between, lambda t, a: F.struct(t.alias("text"), a.alias("after")))


def cut(units: DataFrame, separator: str = PARAGRAPHS, sentences: bool = False) -> DataFrame:
    """units (key, string and any others) as segments: n (from 1), segment_key (key:n, or the key itself of a unit that isn't cut), string, after. Null strings have one segment that is null."""
    rest = [c for c in units.columns if c != "string"]
    whole = F.array(F.struct(F.lit(None).cast("string").alias("text"), F.lit("").alias("after")))
    rows = units.withColumn("_p", F.coalesce(pieces(F.col("string"), separator, sentences), whole)).withColumn("_many", F.size("_p") > 1)
    rows = rows.select(*rest, "_many", F.posexplode("_p").alias("_n", "_s")).withColumn("n", F.col("_n") + 1)
    name = F.when(F.col("_many"), F.concat_ws(":", F.col("key").cast("string"), F.col("n").cast("string"))).otherwise(F.col("key").cast("string"))
    return rows.select(*rest, "n", name.alias("segment_key"), F.col("_s.text").alias("string"), F.col("_s.after").alias("after"))


def join(segments: DataFrame, by: list[str], text: str = "string", *more: Column) -> DataFrame:
    """Units (by, string, more: aggregates) from segments (by, n, text, after), in any order of rows. A segment whose text is null counts as missing, and so does its unit."""
    parts = F.array_sort(F.collect_list(F.struct("n", F.concat(F.col(text), F.col("after")).alias("t"))))
    rows = segments.groupBy(*by).agg(parts.alias("p"), *more)
    missing = F.exists("p", lambda x: x["t"].isNull())
    return rows.select(*by, F.when(~missing, F.array_join(F.transform("p", lambda x: x["t"]), "")).alias("string"), *rows.columns[len(by) + 1 :])
