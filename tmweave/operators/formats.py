"""Readers of string tables and JSON files whose units gather hints, or hold more than keys and values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tmweave.functions import text as fx
from tmweave.operators import extract

#: Lines of string tables: empty ones, comments, and keys with values, which may go over several lines.
STRINGS_KEY = r'^\h*(?:"((?:[^"\\]++|\\.)++)"|([\w#]+))\h*=\h*"((?:[^"\\]++|\\.)*+)"\h*;\h*(?://\h*(.*?)\h*)?$'
STRINGS_COMMENT = r"^\h*/\*\h*(.*?)\h*\*/\h*$"
STRINGS = rf"(?m){STRINGS_KEY}|{STRINGS_COMMENT}|^\h*$"


def strings_unescape(s: Column) -> Column:
    """\\UXXXX, quotes, backslashes, line feeds, returns and tabs; another escaped character stays with its backslash."""
    pieces = F.regexp_extract_all(s, F.lit(r"(?s)\\U[0-9A-Fa-f]{4}|\\.|[^\\]+|\\"), F.lit(0))
    plain = {r"\\": "\\", r"\"": '"', r"\n": "\n", r"\r": "\r", r"\t": "\t"}

    def one(p: Column) -> Column:
        c = F.when(p.rlike(r"^\\U[0-9A-Fa-f]{4}$"), F.decode(F.unhex(F.substring(p, 3, 4)), "UTF-16BE"))
        for k, v in plain.items():
            c = c.when(p == k, v)
        return c.otherwise(p)

    return F.array_join(F.transform(pieces, one), "")


def strings_table(files: DataFrame) -> DataFrame:
    """Units of "key" = "value"; tables: path, pos, key, string, context, hint. Keys may lack quotes, values go over several lines.

    The hint: comments before it, the one after //, and the key up to ##, each on a line, but for those that equal the value; what follows ## is the context. An empty line forgets the comments. Values that begin with
    Placeholder:, and empty ones, are no units; what was gathered goes on to the next. Comments that begin with "Class = " say nothing.
    """
    every = lambda g: F.regexp_extract_all("content", F.lit(STRINGS), F.lit(g))
    named = {0: "raw", 1: "quoted", 2: "bare", 3: "value", 4: "tail", 5: "comment"}
    rows = files.select("path", F.posexplode(F.arrays_zip(*(every(g).alias(n) for g, n in named.items()))).alias("pos", "t")).select("path", "pos", "t.*")
    is_key = F.col("raw").rlike(rf"(?m){STRINGS_KEY}") & ~F.col("raw").rlike(STRINGS_COMMENT)
    blank = F.trim("raw") == ""
    skipped = F.col("value").startswith("Placeholder:")
    key = F.when(F.col("quoted") != "", strings_unescape(F.col("quoted"))).otherwise(F.col("bare"))
    rows = rows.withColumn("key", F.when(is_key, key)).withColumn("emits", is_key & ~skipped & ~F.col("value").isin("", "0"))
    name = F.regexp_replace("key", r"(?s)##.*$", "")
    said = F.when(is_key, F.array(F.col("tail"), F.when(~skipped, name))).otherwise(F.array(F.when(~F.col("comment").startswith("Class = "), F.col("comment"))))
    rows = rows.withColumn("said", F.filter(said, lambda x: F.coalesce(x, F.lit("")) != ""))
    w = Window.partitionBy("path").orderBy("pos")
    ends = (F.col("emits") | blank).cast("int")
    rows = rows.withColumn("g", F.coalesce(F.sum(ends).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("all", F.flatten(F.collect_list("said").over(Window.partitionBy("path", "g").orderBy("pos"))))
    context = F.nullif(F.regexp_extract("key", r"(?s)^.*?##(.*)$", 1), F.lit(""))
    hint = F.array_join(F.filter("all", lambda x: x != F.col("value")), "\n")
    value = F.regexp_replace("value", r"\r?\n", "\\\\n")
    return rows.where("emits").select("path", "pos", "key", strings_unescape(value).alias("string"), context.alias("context"), hint.alias("hint"))


def chrome_messages(files: DataFrame) -> DataFrame:
    """Messages of browser extensions ({key: {message, description}}): path, string, context (the key), hint. Files that aren't such JSON have none."""
    rows = files.select("path", F.explode(F.from_json("content", "map<string,struct<message:string,description:string>>")).alias("context", "m"))
    return rows.where("coalesce(m.message, '') <> ''").select("path", F.col("m.message").alias("string"), "context", F.col("m.description").alias("hint"))


def locjson(files: DataFrame) -> DataFrame:
    """Units of LocJSON files: path, pos, key, string (its lines joined), hint (its comments, a line each; null without)."""
    schema = "struct<units:array<struct<key:string,source:array<string>,properties:struct<comments:array<string>>>>>"
    rows = files.select("path", F.posexplode(F.from_json("content", schema)["units"]).alias("pos", "u"))
    return rows.select("path", "pos", F.col("u.key").alias("key"), F.array_join("u.source", "").alias("string"), F.array_join("u.properties.comments", "\n").alias("hint"))


def json_paths(files: DataFrame, matches: list[str] = (), excludes: list[str] = (), jsonp: bool = False) -> DataFrame:
    """String leaves of JSON by path (extract.json_leaves) that any pattern matches, if there are some, and none excludes. jsonp: what stands around the outermost braces goes first."""
    if jsonp:
        files = files.withColumn("content", F.when(F.col("content").rlike(r"(?s)\{.*\}"), F.regexp_extract("content", r"(?s)(\{.*\})", 1)).otherwise(F.col("content")))
    found = extract.json_leaves(files, matches="|".join(f"(?:{m})" for m in matches) or None)
    return found.where(~F.col("key").rlike("|".join(f"(?:{m})" for m in excludes))) if excludes else found


#: A marker may go over several lines.
MASTER = r"(?s)<%(.*?)%>"


def master(files: DataFrame) -> DataFrame:
    """<%string%%context%%hint%%flags%> markers, over any number of lines: path, pos, string, context, hint, flags (an array)."""
    rows = files.select("path", F.posexplode(F.regexp_extract_all("content", F.lit(MASTER), F.lit(1))).alias("pos", "m"))
    part = lambda n: F.nullif(F.get(F.split("m", "%%"), F.lit(n)), F.lit(""))
    flags = F.filter(F.split(fx.blank(part(3)), r"[,\s]+"), lambda x: x != "")
    return rows.select("path", "pos", part(0).alias("string"), part(1).alias("context"), part(2).alias("hint"), flags.alias("flags")).where("string IS NOT NULL")
