"""Reports over the memory: completeness, usage, inconsistencies, word counts, imports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tmweave.functions import text as fx


def live(tm: dict[str, DataFrame]) -> DataFrame:
    """Items in use whose string isn't skipped."""
    return tm["items"].where("orphaned = 0").join(tm["strings"].where("skip = 0").select("string_id", F.col("string").alias("source"), "context"), "string_id")


def file_language_grid(tm: dict[str, DataFrame], source_language: str = "en") -> DataFrame:
    """Every file in use with every destination language."""
    return tm["files"].where("orphaned = 0").select("file_id", "namespace", "path").crossJoin(F.broadcast(tm["langs"].where(F.col("language") != source_language).select("language")))


def completeness(tm: dict[str, DataFrame]) -> DataFrame:
    """file_id, language, total, translated, ratio: translated has a row that isn't fuzzy; a file without strings is complete."""
    items = live(tm).select("item_id", "file_id")
    total = items.groupBy("file_id").agg(F.count("*").alias("total"))
    done = tm["translations"].where("fuzzy = 0").select("item_id", "language").join(items, "item_id").groupBy("file_id", "language").agg(F.count("*").alias("translated"))
    grid = tm["files"].select("file_id").crossJoin(F.broadcast(tm["langs"].select("language")))
    out = grid.join(total, "file_id", "left").join(done, ["file_id", "language"], "left").fillna(0, ["total", "translated"])
    return out.withColumn("ratio", F.when(F.col("total") == 0, 1.0).otherwise(F.col("translated") / F.col("total")))


def completeness_gate(ratios: DataFrame, exists: Column, create: float = 1.0, update: float = 0.0, can_delete: bool = False, always: list[str] = ()) -> DataFrame:
    """Adds action: create, update, delete, skip for each file and language."""
    new = F.when(F.col("ratio") >= create, "create").otherwise("skip")
    old = F.when(F.lit(can_delete) & (F.col("ratio") <= update), "delete").when(F.col("ratio") >= update, "update").otherwise("skip")
    pick = F.when(exists, old).otherwise(new)
    return ratios.withColumn("action", F.when(F.col("language").isin(list(always)), F.when(exists, "update").otherwise("create")).otherwise(pick))


def usage(tm: dict[str, DataFrame]) -> DataFrame:
    """Places in which each translation of a string is used, and whether all of them are orphaned."""
    i = tm["items"].withColumnRenamed("orphaned", "io").join(tm["strings"].where("skip = 0").select("string_id", F.col("string").alias("source"), "context"), "string_id")
    i = i.join(tm["files"].select("file_id", "namespace", "path", F.col("orphaned").alias("fo")), "file_id")
    t = tm["translations"].where("string is not null").select("item_id", "language", F.col("string").alias("target"), "comment").join(i, "item_id")
    place = F.concat_ws("/", "namespace", "path")
    return t.groupBy("language", "source", "context", "target", "comment").agg(F.array_join(F.array_sort(F.collect_set(place)), "; ").alias("places"), F.count("*").alias("uses"), F.min(F.greatest("io", "fo")).alias("all_orphaned"))


def inconsistencies(tm: dict[str, DataFrame]) -> DataFrame:
    """Sources that read alike but for markup and case, yet have several texts or translations."""
    keyed = tm["strings"].where("skip = 0").select("string_id", F.col("string").alias("source"), fx.consistency_key(F.col("string")).alias("key")).where("key <> ''")
    t = tm["translations"].where("string is not null").select("item_id", "language", F.col("string").alias("target")).join(tm["items"].where("orphaned = 0").select("item_id", "string_id"), "item_id").join(keyed, "string_id")
    pairs = t.groupBy("language", "key", "source", "target").agg(F.count("*").alias("uses"))
    odd = pairs.groupBy("language", "key").agg(F.count("*").alias("variants")).where("variants > 1")
    return pairs.join(odd, ["language", "key"])


def exported(tm: dict[str, DataFrame], languages: list[str], include_fuzzy: bool = False, include_empty: bool = False, force: bool = False, translated_only: bool = False, namespaces: list[str] | None = None, file_like: str | None = None) -> DataFrame:
    """Rows for export: live strings of files in use, untranslated ones by default, with the translation of each language beside them."""
    f = tm["files"].where("orphaned = 0").select("file_id", "namespace", "path")
    f = f.where(F.col("namespace").isin(namespaces)) if namespaces else f
    f = f.where(F.col("path").like(file_like.replace("*", "%").replace("?", "_"))) if file_like else f
    langs = tm["langs"].where(F.col("language").isin(languages)).select("language")
    rows = live(tm).select("item_id", "file_id", "source", "context").join(f, "file_id").crossJoin(F.broadcast(langs))
    rows = rows.join(tm["translations"].select("item_id", "language", F.col("string").alias("target"), "fuzzy", F.lit(1).alias("has")), ["item_id", "language"], "left")
    keep = F.col("has").isNull()
    if include_fuzzy:
        keep = keep | (F.col("fuzzy") == 1)
    if include_empty:
        keep = keep | (F.col("has").isNotNull() & F.col("target").isNull())
    if translated_only:
        keep = F.col("target").isNotNull()
    return (rows if force else rows.where(keep)).select("namespace", "path", "item_id", "language", "source", "context", "target", "fuzzy")


def first_occurrence(rows: DataFrame) -> DataFrame:
    """Each source once per language: the first by namespace, path and item."""
    w = Window.partitionBy("language", "source").orderBy("namespace", "path", "item_id")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def tmx(rows: DataFrame) -> DataFrame:
    """Translation units as XML text."""
    unit = F.concat(F.lit('<tu><tuv xml:lang="en"><seg>'), fx.xml_escape(F.col("source"), False), F.lit('</seg></tuv><tuv xml:lang="'), F.col("language"), F.lit('"><seg>'), fx.xml_escape(F.col("target"), False), F.lit("</seg></tuv></tu>"))
    return first_occurrence(rows).select("language", "item_id", unit.alias("unit"))


def wordcounts(rows: DataFrame) -> DataFrame:
    """Words by file, by namespace and in all."""
    return rows.withColumn("words", fx.wordcount(F.col("source"))).rollup("namespace", "path").agg(F.sum("words").alias("words"), F.count("*").alias("strings"))


def high_usn(tm: dict[str, DataFrame]) -> DataFrame:
    """file_id, language and the latest change number of anything that its exchange file shows. The tables carry usn."""
    i = tm["items"].select("item_id", "file_id", "string_id", F.col("usn").alias("iu")).join(tm["strings"].select("string_id", F.col("usn").alias("su")), "string_id")
    base = i.groupBy("file_id").agg(F.max(F.greatest("iu", "su")).alias("base"))
    own = tm["translations"].select("item_id", "language", "usn").join(i.select("item_id", "file_id"), "item_id").groupBy("file_id", "language").agg(F.max("usn").alias("own"))
    grid = base.crossJoin(F.broadcast(tm["langs"].select("language")))
    return grid.join(own, ["file_id", "language"], "left").select("file_id", "language", F.greatest("base", F.coalesce("own", F.lit(0))).alias("usn"))


def with_usn(tm: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Change numbers for tables that lack them, each above the row's own id."""
    ids = {"strings": "string_id", "items": "item_id", "translations": "translation_id"}
    return tm | {k: tm[k].withColumn("usn", F.col(v).cast("long")) for k, v in ids.items()}


def import_status(source: DataFrame, localized: DataFrame) -> DataFrame:
    """Localized rows beside source rows by file and key, each with severity and status.

    source: path, key, string. localized: path, language, key, pos, target.
    """
    src = source.groupBy("path", "key").agg(F.min("string").alias("source"), F.count("*").alias("n_source"))
    known = source.select("path").distinct().withColumn("has_file", F.lit(1))
    w = Window.partitionBy("path", "language", "key").orderBy("pos", "target")
    loc = localized.withColumn("nth", F.row_number().over(w)).withColumn("before", F.lag("target").over(w))
    x = loc.join(known, "path", "left").join(src, ["path", "key"], "left")
    say = lambda severity, status: F.struct(F.lit(severity).alias("severity"), F.lit(status).alias("status"))
    again = F.col("nth") > 1
    status = (
        F.when(F.col("has_file").isNull(), say("error", "FILE_MISSING")).when(F.col("source").isNull(), say("error", "UNKNOWN_KEY"))
        .when(F.col("n_source") > 1, say("error", "DUPLICATE_KEY")).when(F.col("source") == "", say("error", "EMPTY_SOURCE"))
        .when(again & (F.col("before") == F.col("target")), say("warning", "DUPLICATE_KEY")).when(again, say("error", "MULTIPLE_TRANSLATIONS"))
        .when(F.coalesce("target", F.lit("")) == "", say("warning", "EMPTY_TRANSLATION")).when(F.col("source") == F.col("target"), say("notice", "SAME_TRANSLATION")).otherwise(say("ok", "OK"))
    )
    return x.select("path", "language", "key", "pos", "source", "target", status.alias("s")).select("path", "language", "key", "pos", "source", "target", "s.severity", "s.status")


def import_report(rows: DataFrame) -> DataFrame:
    order = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return rows.where("severity <> 'ok'").groupBy("language", "status", "severity").agg(F.count("*").alias("n")).orderBy("language", order, "status")


def import_stats(rows: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("severity") == s)
    return rows.groupBy("language").agg(F.count_distinct("path").alias("files"), n("notice").alias("notices"), n("warning").alias("warnings"), n("error").alias("errors"))
