"""Readers of exchange files as tools write them: CSV with quotes and headers, PO with plurals, comments and line ends of any kind."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tmweave.functions import text as fx
from tmweave.operators import markup


def csv_records(files: DataFrame, delimiter: str = ",") -> DataFrame:
    """path, row (from 0), fields of CSV files (path, content): fields in quotes may hold delimiters, line ends and doubled quotes. Null and empty files have no records.

    A field that begins with a quote but doesn't end with one stands as it is. The last line's end may be missing.
    """
    d = "\\t" if delimiter == "\t" else "\\" + delimiter
    # a quoted field, or anything up to a delimiter; each with what ends it
    form = rf'("(?:[^"]++|"")*+"|[^{d}\r\n]*+)({d}|\r\n|\n|\r|\z)'
    body = F.concat(F.regexp_replace("content", r"(?:\r\n|\n|\r)\z", ""), F.lit("\n"))
    rows = markup.spread(files.where(F.coalesce("content", F.lit("")) != "")).select("path", F.regexp_extract_all(body, F.lit(form), F.lit(0)).alias("all"))
    rows = rows.select("path", F.posexplode("all").alias("pos", "raw")).where("raw <> ''")
    ends = ~F.col("raw").endswith(delimiter) | F.col("raw").rlike(r"[\r\n]\z")
    before = Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("row", F.coalesce(F.sum(ends.cast("int")).over(before), F.lit(0)))
    bare = F.regexp_replace("raw", rf"(?:{d}|\r\n|\n|\r)\z", "")
    field = F.when(bare.rlike(r'(?s)\A".*"\z') & (F.length(bare) > 1), F.replace(F.expr("substring(b, 2, length(b) - 2)"), F.lit('""'), F.lit('"'))).otherwise(F.col("b"))
    rows = rows.withColumn("b", bare).withColumn("field", field)
    return rows.groupBy("path", "row").agg(F.array_sort(F.collect_list(F.struct("pos", "field"))).alias("f")).select("path", F.col("row").cast("int").alias("row"), F.transform("f", lambda x: x["field"]).alias("fields"))


def csv_units(files: DataFrame, key: str = "Key", string: str = "String", context: str | None = None, comment: str = "Comment", delimiter: str = ",") -> tuple[DataFrame, DataFrame]:
    """Units of CSV files by the names in their first line (in upper or lower case; context: the key's column unless named): path, pos, key, string, context, comment. And the files left out whole: path, reason.

    A file goes if its header lacks the key or the string, or a record has another number of fields than it.
    """
    rows = csv_records(files, delimiter)
    head = rows.where("row = 0").select("path", F.transform("fields", lambda x: F.lower(x)).alias("names"))
    rows = rows.where("row > 0").join(head, "path")
    missing = F.filter(F.array(F.lit(key.lower()), F.lit(string.lower())), lambda n: ~F.array_contains("names", n))
    no_column = head.where(F.size(missing) > 0).select("path", F.concat(F.lit("no column "), F.array_join(missing, ", ")).alias("reason"))
    uneven = rows.where(F.size("fields") != F.size("names")).groupBy("path").agg(F.min("row").alias("row")).select("path", F.concat(F.lit("other number of fields in record "), F.col("row").cast("string")).alias("reason"))
    bad = no_column.unionByName(uneven.join(no_column.select("path"), "path", "left_anti"))
    value = lambda n: F.get("fields", F.nullif(F.array_position("names", F.lit(n.lower())), F.lit(0)).cast("int") - 1)
    good = rows.join(bad.select("path"), "path", "left_anti")
    return good.select("path", F.col("row").alias("pos"), value(key).alias("key"), value(string).alias("string"), value(context or key).alias("context"), value(comment).alias("comment")), bad


#: What stands in front of a string in PO files.
KEYWORD = r'^(msgctxt|msgid_plural|msgid|msgstr(?:\[\d+\])?)\s+"(.*)"\s*$'


def po_entries(files: DataFrame) -> DataFrame:
    """Entries of PO files (path, content): path, pos, id, context, source, plural, targets (by form), comment, notes (#.), flags.

    Line ends of any kind, strings over several lines, and entries without an empty line between them. An entry starts at the first comment, msgctxt or msgid after a msgstr. The id may stand on the line after its name. The
    header is an entry with an empty source; obsolete entries (#~) are none.
    """
    content = F.regexp_replace(F.regexp_replace("content", "^﻿", ""), "\r\n|\r", "\n")
    rows = markup.spread(files).select("path", F.posexplode(F.split(content, "\n")).alias("pos", "line"))
    rows = rows.withColumn("line", F.regexp_replace("line", r"[\x00-\x08\x0b-\x1f]", "")).where("trim(line) <> '' AND line NOT LIKE '#~%'")
    line = F.col("line")
    word = F.nullif(F.regexp_extract(line, KEYWORD, 1), F.lit(""))
    kind = F.when(line.startswith("#"), "#").when(word.isNotNull(), word).when(line.rlike(r'^\s*".*"\s*$'), '"').otherwise("?")
    w = Window.partitionBy("path").orderBy("pos")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("kind", kind)
    last = F.last(F.when(~F.col("kind").isin('"', "?"), F.col("kind")), ignorenulls=True).over(before)
    starts = F.col("kind").isin("#", "msgctxt", "msgid") & (last.isNull() | last.startswith("msgstr"))
    rows = rows.withColumn("entry", F.sum(starts.cast("int")).over(w)).withColumn("field", F.last(F.when(~F.col("kind").isin('"', "?"), F.col("kind")), ignorenulls=True).over(w))
    text = F.when(F.col("kind") == '"', F.regexp_extract(line, r'^\s*"(.*)"\s*$', 1)).when(F.col("kind").startswith("msg"), F.regexp_extract(line, KEYWORD, 2))
    rows = rows.withColumn("text", text).withColumn("said", F.lag("line").over(w))
    part = lambda name: fx.po_unescape(F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("field") == name) & text.isNotNull(), F.struct("pos", "text")))), lambda x: x["text"]), ""))
    every = lambda form: F.transform(F.array_sort(F.collect_list(F.when(line.rlike(form), F.struct("pos", F.regexp_extract(line, form, 1).alias("t"))))), lambda x: x["t"])
    forms = F.array_sort(F.collect_list(F.when(F.col("field").startswith("msgstr") & F.col("text").isNotNull(), F.struct(F.coalesce(F.nullif(F.regexp_extract("field", r"\[(\d+)\]", 1), F.lit("")).cast("int"), F.lit(0)).alias("form"), "pos", "text"))))
    own_id = F.when(line.rlike(r"^#: ID: \S"), F.regexp_extract(line, r"^#: ID: (\S+)", 1)).when((F.col("said") == "#: ID:") & line.startswith("#: "), F.regexp_extract(line, r"^#: (\S+)", 1))
    got = rows.where("entry > 0").groupBy("path", "entry").agg(
        F.min("pos").alias("pos"), F.max(own_id).alias("id"), part("msgctxt").alias("context"), part("msgid").alias("source"), F.max((F.col("field") == "msgid").cast("int")).alias("has"), part("msgid_plural").alias("plural"), forms.alias("forms"),
        every(r"^# (?!===)(.*)$").alias("comments"), every(r"^#\.\s?(.*)$").alias("notes"), every(r"^#,\s*(.*)$").alias("flags"),
    )
    numbers = F.sequence(F.lit(0), F.array_max(F.transform("forms", lambda x: x["form"])))
    targets = F.when(F.size("forms") > 0, F.transform(numbers, lambda n: fx.po_unescape(F.array_join(F.transform(F.filter("forms", lambda x: x["form"] == n), lambda x: x["text"]), "")))).otherwise(F.array().cast("array<string>"))
    comment = F.regexp_replace(F.array_join("comments", "\n"), r"\n+\z", "")
    flags = F.filter(F.split(F.lower(F.array_join("flags", ",")), r",\s*"), lambda x: x != "")
    return got.where("has = 1").select("path", "pos", "id", F.nullif("context", F.lit("")).alias("context"), "source", F.nullif("plural", F.lit("")).alias("plural"), targets.alias("targets"), comment.alias("comment"), F.array_join("notes", "\n").alias("notes"), flags.alias("flags"))


def po_import(files: DataFrame) -> DataFrame:
    """Translated or commented units of PO files whose id is that of their text and context: path, pos, id, source, context, target, fuzzy, comment. Plural forms are joined as in the memory; an empty target isn't fuzzy."""
    rows = po_entries(files).where("source <> ''")
    rows = rows.withColumn("source", fx.plural_join(F.when(F.col("plural").isNotNull(), F.array("source", "plural")).otherwise(F.array("source")))).withColumn("target", fx.plural_join(F.col("targets")))
    rows = rows.where("(target <> '' OR comment <> '')").where(F.col("id") == fx.string_key(F.col("source"), F.col("context")))
    return rows.select("path", "pos", "id", "source", "context", "target", (F.array_contains("flags", "fuzzy") & (F.col("target") != "")).cast("int").alias("fuzzy"), "comment")


def po_write(units: DataFrame, size: int | None = None) -> DataFrame:
    """PO files of units (path, language, pos, source, context, target, comment, fuzzy, hint) with plurals, hints and comments of several lines; size splits a file into numbered parts of so many positions."""
    if size:
        units = units.withColumn("path", F.concat_ws(".", "path", F.floor(F.col("pos") / size).cast("string")))
    quoted = lambda name, c: F.concat(F.lit(f'{name} "'), fx.po_escape(c), F.lit('"'))
    lined = lambda mark, c: F.when(fx.blank(c) != "", F.array_join(F.transform(F.split(c, "\n"), lambda x: F.concat(F.lit(mark), x)), "\n"))
    source, target = fx.plural_split(F.col("source")), fx.plural_split(fx.blank(F.col("target")))
    many = F.size(source) > 1
    plural = F.when(many, quoted("msgid_plural", F.get(source, F.lit(1))))
    forms = F.array_join(F.transform(target, lambda t, i: F.concat(F.lit("msgstr["), i.cast("string"), F.lit('] "'), fx.po_escape(t), F.lit('"'))), "\n")
    block = F.concat_ws(
        "\n", lined("# ", F.col("comment")), lined("#. ", F.col("hint")), F.concat(F.lit("#: ID: "), fx.string_key(F.col("source"), F.col("context"))), F.when(F.col("fuzzy") == 1, "#, fuzzy"),
        F.when(fx.blank(F.col("context")) != "", quoted("msgctxt", F.col("context"))), quoted("msgid", F.get(source, F.lit(0))), plural, F.when(many, forms).otherwise(quoted("msgstr", F.get(target, F.lit(0)))),
    )
    parts = units.groupBy("path", "language").agg(F.array_sort(F.collect_list(F.struct("pos", block.alias("b")))).alias("p"))
    head = F.concat(F.lit('msgid ""\nmsgstr ""\n"Language: '), fx.locale(F.col("language")), F.lit('\\n"'))
    return parts.select("path", "language", F.concat(head, F.lit("\n\n"), F.array_join(F.transform("p", lambda x: x["b"]), "\n\n"), F.lit("\n")).alias("content"))
