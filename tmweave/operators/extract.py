"""Extraction jobs: files (path, content) to rows of translatable units (path, pos, key, string, context, hint)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tmweave.functions import text as fx
from tmweave.sources import folders


def lines(files: DataFrame) -> DataFrame:
    """path, pos, line."""
    return files.select("path", F.posexplode(F.split("content", "\n")).alias("pos", "line"))


def by_line(files: DataFrame, pattern: str, key: int = 1, value: int = 2, unescape=lambda c: c) -> DataFrame:
    """Lines of one form; the key is the hint as well."""
    rows = lines(files).where(F.col("line").rlike(pattern))
    k = F.regexp_extract("line", pattern, key)
    return rows.select("path", "pos", k.alias("key"), unescape(F.regexp_extract("line", pattern, value)).alias("string"), k.alias("hint"))


#: Forms of lines.
KEYVALUE = r"^(.+?)\s*=\s*(.+)$"
KEY_SPACE_VALUE = r"^(\S+)\s+(.+)$"
HASH = r"^\s*'(.+?)'\s*=>\s*'(.*)',?\s*$"
RRC = r'^\s*(\w+#\d+)\s*=\s*"(.*)";\s*$'
JS_OBJECT = r"""^\s*['"]?([\w.]+)['"]?\s*:\s*(["'`])(.*)\2,?\s*(?://.*)?$"""
MASTER = r"<%(.*?)%>"


def keyvalue(files: DataFrame) -> DataFrame:
    return by_line(files, KEYVALUE)


def key_space_value(files: DataFrame) -> DataFrame:
    return by_line(files, KEY_SPACE_VALUE)


def hash_lines(files: DataFrame) -> DataFrame:
    return by_line(files, HASH, unescape=fx.c_unescape)


def rrc(files: DataFrame) -> DataFrame:
    return by_line(files, RRC)


def js_object(files: DataFrame) -> DataFrame:
    return by_line(files, JS_OBJECT, 1, 3, fx.c_unescape)


def with_comments(files: DataFrame, pattern: str, comment: str, closes_on_blank: bool, unescape=lambda c: c) -> DataFrame:
    """Key lines with the comment lines before them as hint; a blank line may end the comments. key##context names a context."""
    w = Window.partitionBy("path").orderBy("pos")
    rows = lines(files)
    is_comment = F.col("line").rlike(comment)
    ends = ~is_comment & (F.lit(closes_on_blank) | (F.trim("line") != ""))
    rows = rows.withColumn("c", F.when(is_comment, F.regexp_extract("line", comment, 1))).withColumn("g", F.coalesce(F.sum(ends.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    hints = F.array_join(F.collect_list("c").over(Window.partitionBy("path", "g").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), "\n")
    rows = rows.withColumn("h", hints).where(F.col("line").rlike(pattern) & ~is_comment)
    key, string = F.regexp_extract("line", pattern, 1), unescape(F.regexp_extract("line", pattern, 2))
    context = F.nullif(F.regexp_extract(key, "^.*?##(.*)$", 1), F.lit(""))
    rows = rows.select("path", "pos", F.regexp_replace(key, "##.*$", "").alias("key"), string.alias("string"), context.alias("context"), "h")
    return rows.withColumn("hint", F.concat_ws("\n", "key", F.nullif(F.when(F.col("h") != F.col("string"), F.col("h")), F.lit("")))).drop("h")


def u_unescape(s: Column) -> Column:
    """\\uXXXX alone."""
    pieces = F.regexp_extract_all(s, F.lit(r"(?s)\\u[0-9A-Fa-f]{4}|[^\\]+|\\"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(r"^\\u"), F.decode(F.unhex(F.substring(p, 3, 4)), "UTF-16BE")).otherwise(p)), "")


#: A key line of properties files and a comment line that holds a flag.
PROPERTY = r"^[\t ]*(.*?[^\\])(?:[\t ]*[=:][\t ]*| )[\t ]*(.*)$"
PROPERTY_FLAG = r"^#\.([^\s=:]+)([=:](.*))?$"


def properties(files: DataFrame) -> DataFrame:
    """key=value, key:value or key value, with the flags (#.flag, #.flag=value) of the comment lines before it; lines that end in a backslash go on.

    internal: the line is left out. context: its context. comment: goes to the hint after the key. Other flags go to the hint's last line, sorted, as #flag=value.
    Plain comments say nothing; any other line that isn't a comment ends its flags. Values that are empty or 0 are left out.
    """
    joined = files.withColumn("content", F.replace("content", F.lit("\\\n"), F.lit("")))
    rows = lines(joined).withColumn("c", F.col("line").rlike(r"^[\t ]*[#!]"))
    w = Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("g", F.coalesce(F.sum((~F.col("c")).cast("int")).over(w), F.lit(0)))
    said = F.regexp_replace("line", r"^\s+|\s+$", "")
    part = lambda n: F.regexp_extract(said, PROPERTY_FLAG, n)
    flag = F.when(F.col("c") & said.rlike(PROPERTY_FLAG), F.struct("pos", part(1).alias("k"), F.when(part(2) != "", part(3)).alias("v")))
    units = rows.groupBy("path", "g").agg(F.array_sort(F.collect_list(flag)).alias("flags"), F.max(F.when(~F.col("c"), F.col("pos"))).alias("pos"), F.max(F.when(~F.col("c"), F.col("line"))).alias("line"))
    units = units.where(F.col("line").rlike(PROPERTY) & ~F.exists("flags", lambda f: f["k"] == "internal"))

    def value(k: Column) -> Column:
        """A flag's lines, null if it has no value."""
        own = F.filter("flags", lambda f: f["k"] == k)
        return F.when(F.exists(own, lambda f: f["v"].isNotNull()), F.regexp_replace(F.array_join(F.transform(own, lambda f: F.coalesce(f["v"], F.lit(""))), "\n"), r"^\s+|\s+$", ""))

    names = F.array_distinct(F.transform("flags", lambda f: f["k"]))
    tags = F.array_sort(F.filter(names, lambda k: ~k.isin("comment", "context")))
    comment = F.when(F.array_contains(names, "comment"), F.coalesce(value(F.lit("comment")), F.lit("")))
    tagged = F.nullif(F.array_join(F.transform(tags, lambda k: F.concat(F.lit("#"), k, F.coalesce(F.concat(F.lit("="), value(k)), F.lit("")))), " "), F.lit(""))
    key, raw = F.regexp_extract("line", PROPERTY, 1), F.regexp_extract("line", PROPERTY, 2)
    string = F.replace(u_unescape(raw), F.lit("''"), F.lit("'"))
    hint = F.concat_ws("\n", F.regexp_replace(key, r"[\t ]+$", ""), comment, tagged)
    return units.where(~raw.isin("", "0")).select("path", "pos", key.alias("key"), string.alias("string"), F.nullif(value(F.lit("context")), F.lit("")).alias("context"), hint.alias("hint"))


def strings(files: DataFrame) -> DataFrame:
    """"key" = "value"; with /* comments */ before it; a blank line forgets them."""
    return with_comments(files, r'^\s*"(.+?)"\s*=\s*"(.*)";', r"^\s*/\*\s*(.*?)\s*\*/\s*$", True, fx.c_unescape)


def go_map(files: DataFrame) -> DataFrame:
    """"key": "value", or a raw string in backticks, which may have several lines; the key may lack quotes.

    Hint: the // comments before it, which a blank line forgets, and the key; key##context names a context. pos counts a raw string's lines as one.
    """
    ticks = F.split("content", "`")
    raw = F.transform(ticks, lambda x, i: F.when((i % 2 == 1) & (i < F.size(ticks) - 1), F.replace(x, F.lit("\n"), F.lit("\x01"))).otherwise(x))
    rows = lines(files.withColumn("content", F.array_join(raw, "`")))
    comment, line = r"^\s*//\s*(.*?)\s*$", r'^\s*(?:"(.*?)"|(\w+))\s*:\s*(?:"(.*)"|`(.*)`)\s*,\s*$'
    part = lambda n: F.regexp_extract("line", line, n)
    is_key = F.col("line").rlike(line) & ~F.col("line").rlike(comment)
    ends = (F.col("line").rlike(r"^\s*$") | is_key).cast("int")
    w = Window.partitionBy("path").orderBy("pos")
    rows = rows.withColumn("g", F.coalesce(F.sum(ends).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("h", F.collect_list(F.when(F.col("line").rlike(comment), F.regexp_extract("line", comment, 1))).over(Window.partitionBy("path", "g").orderBy("pos")))
    key = F.concat(part(1), part(2))
    name, context = F.regexp_replace(key, "##.*$", ""), F.nullif(F.regexp_extract(key, "^.*?##(.*)$", 1), F.lit(""))
    string = F.concat(fx.c_unescape(part(3)), F.replace(part(4), F.lit("\x01"), F.lit("\n")))
    hint = F.array_join(F.concat("h", F.when(name != "", F.array(name)).otherwise(F.array().cast("array<string>"))), "\n")
    return rows.where(is_key).select("path", "pos", key.alias("key"), string.alias("string"), context.alias("context"), hint.alias("hint")).where("string <> ''")


def rc(files: DataFrame) -> DataFrame:
    """Windows resource scripts: ID "text" inside BEGIN and END of a section, with the section's kind; in string tables the text may stand on the line after its ID. A dialog's CAPTION has the key dialog:CAPTION."""
    w = Window.partitionBy("path").orderBy("pos")
    rows = lines(files)
    kind = F.nullif(F.regexp_extract("line", r"\b(MENU|DIALOG|DIALOGEX|STRINGTABLE)\b", 1), F.lit(""))
    step = F.when(F.col("line").rlike(r"^\s*BEGIN\b"), 1).when(F.col("line").rlike(r"^\s*END\b"), -1).otherwise(0)
    rows = rows.withColumn("section", F.last(kind, ignorenulls=True).over(w)).withColumn("depth", F.sum(step).over(w))
    text = r'L?"([^"]*(?:""[^"]*)*)"'
    form, caption, alone, bare = rf"^\s*(\w+)[,\s]+{text}", rf"^\s*(CAPTION)\s+{text}", r"^\s*(\w+)\s*(?://.*)?$", rf"^\s*(){text}"
    rows = rows.withColumn("dialog", F.last(F.nullif(F.regexp_extract("line", r"^\s*(\w+)\s+DIALOG(?:EX)?\b", 1), F.lit("")), ignorenulls=True).over(w)).withColumn("before", F.lag("line").over(w))
    inside, line = F.col("depth") > 0, F.col("line")
    above = F.regexp_extract("before", alone, 1)
    kinds = [
        (inside & line.rlike(form), F.regexp_extract("line", form, 1), form),
        (~inside & F.col("section").startswith("DIALOG") & line.rlike(caption), F.concat_ws(":", "dialog", F.lit("CAPTION")), caption),
        (inside & (F.col("section") == "STRINGTABLE") & line.rlike(bare) & ~above.isin("", "BEGIN", "END"), above, bare),
    ]
    unit = reduce(lambda c, k: c.when(k[0], F.struct(k[1].alias("key"), F.regexp_extract("line", k[2], 2).alias("string"))), kinds[1:], F.when(kinds[0][0], F.struct(kinds[0][1].alias("key"), F.regexp_extract("line", form, 2).alias("string"))))
    rows = rows.where(F.col("section").isNotNull()).withColumn("u", unit).where("u is not null")
    return rows.select("path", "pos", "u.key", F.replace(F.col("u.string"), F.lit('""'), F.lit('"')).alias("string"), F.col("section").alias("hint"))


def tagged(files: DataFrame, pattern: str, key: int = 1, value: int = 2) -> DataFrame:
    """Elements of a form with a name and a text, wherever they stand."""
    every = lambda g: F.regexp_extract_all(F.col("content"), F.lit(pattern), F.lit(g))
    rows = files.select("path", F.posexplode(F.arrays_zip(every(key).alias("key"), every(value).alias("string"))).alias("pos", "u"))
    return rows.select("path", "pos", F.col("u.key").alias("key"), fx.xml_unescape(F.col("u.string")).alias("string")).where("string <> ''")


def android(files: DataFrame) -> DataFrame:
    """string, plurals (name:quantity) and string-array (name:0, name:1, ...) elements of Android resources, but for those with translatable="false"; pos counts elements. Escaped quotes are unescaped outside tags."""
    form = r"(?s)<(string|plurals|string-array) ([^/<>]*?)>(.*?)</\1>"
    every = lambda c, pattern, g: F.regexp_extract_all(c, F.lit(pattern), F.lit(g))
    found = F.arrays_zip(*[every("content", form, g).alias(n) for g, n in enumerate(("kind", "attrs", "body"), 1)])
    rows = files.select("path", F.posexplode(found).alias("pos", "e")).select("path", "pos", "e.*").where(~F.col("attrs").rlike(r'\btranslatable="false"'))
    name = F.regexp_extract("attrs", r'\bname="(.*?)"', 1)
    unit = lambda key, string, hint: F.struct(key.alias("key"), string.alias("string"), hint.alias("hint"))
    plural, item = r'(?s)<item .*?quantity="(.*?)".*?>(.*?)</item>', r"(?s)<item>(.*?)</item>"
    quantity = lambda q: F.concat(name, F.lit(":"), q)
    many = F.zip_with(every("body", plural, 1), every("body", plural, 2), lambda q, s: unit(quantity(q), s, quantity(q)))
    listed = F.transform(every("body", item, 1), lambda s, i: unit(F.concat(name, F.lit(":"), i.cast("string")), s, F.concat(name, F.lit(":item"))))
    units = F.when(F.col("kind") == "string", F.array(unit(name, F.col("body"), name))).when(F.col("kind") == "plurals", many).otherwise(listed)
    chunks = F.regexp_extract_all("string", F.lit(r"(?s)<.*?>|[^<]+|<"), F.lit(0))
    string = F.array_join(F.transform(chunks, lambda c: F.when(c.startswith("<"), c).otherwise(F.regexp_replace(c, r"\\(['\"])", "$1"))), "")
    return rows.select("path", "pos", F.inline(units)).where("string <> ''").select("path", "pos", "key", string.alias("string"), "hint")


ANDROID = r'(?s)<string name="([^"]*)"[^>]*>(.*?)</string>'
RESX = r'(?s)<data name="([^"]*)"[^>]*>\s*<value>(.*?)</value>'
PLIST = r"(?s)<key>(.*?)</key>\s*<string>(.*?)</string>"
DTD = r'(?s)<!ENTITY\s+(\S+)\s+"(.*?)">'


def master(files: DataFrame) -> DataFrame:
    """<%string%%context%%hint%%flags%> markers."""
    rows = files.select("path", F.posexplode(F.regexp_extract_all(F.col("content"), F.lit(MASTER), F.lit(1))).alias("pos", "m"))
    part = lambda n: F.nullif(F.get(F.split("m", "%%"), F.lit(n)), F.lit(""))
    return rows.select("path", "pos", part(0).alias("string"), part(1).alias("context"), part(2).alias("hint"))


def json_leaves(files: DataFrame, depth: int | None = None, matches: str | None = None) -> DataFrame:
    """String leaves of JSON with their path (/a/b[0]) as key, of all levels, or of the first depth ones. Each level is written to the shared folder, to see whether there is a next one."""
    spark = files.sparkSession
    level = files.select("path", F.lit("").alias("key"), F.try_parse_json("content").alias("v"))
    found = []
    while depth is None or len(found) < depth:
        level = spark.sql("SELECT path, concat(l.key, coalesce(concat('/', e.key), concat('[', e.pos, ']'))) AS key, e.value AS v FROM {level} AS l, LATERAL variant_explode(l.v) AS e", level=level)
        folder = folders.new_path(spark, "json-level")
        level.write.parquet(folder)
        level = spark.read.schema(level.schema).parquet(folder)
        kind = F.schema_of_variant("v")
        found.append(level.where(kind == "STRING").select("path", "key", F.try_variant_get("v", "$", "string").alias("string")))
        level = level.where(kind.startswith("OBJECT") | kind.startswith("ARRAY"))
        if not level.limit(1).count():
            break
    out = reduce(DataFrame.union, found).where("trim(string) <> ''")
    return out.where(F.col("key").rlike(matches)) if matches else out


def json_flat(files: DataFrame) -> DataFrame:
    """Key and value of a flat JSON object."""
    return files.select("path", F.explode(F.from_json("content", "map<string,string>")).alias("key", "string"))


def csv(spark, path_rows: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Units of CSV lines (path, pos, line), and files with a line of another number of fields, which are left out whole."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    fields = F.from_csv("line", schema, {"mode": "PERMISSIVE"})
    n = F.size(F.split(F.regexp_replace("line", r'"[^"]*"', ""), ",")) if columns else F.lit(0)
    rows = path_rows.withColumn("n", n)
    bad = rows.where(F.col("n") != len(columns)).select("path").distinct()
    return rows.join(bad, "path", "left_anti").select("path", "pos", fields.alias("f")).select("path", "pos", "f.*"), bad


#: The elements that hold translatable blocks.
BLOCKS = ("h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "dt", "dd", "label", "option")


def html_blocks(pages: DataFrame, tags: tuple[str, ...] = BLOCKS) -> DataFrame:
    """Innermost translatable elements of pages (path, content): tag, the how-manieth of its tag, inner markup."""
    clean = F.regexp_replace(F.regexp_replace("content", r"(?s)<!--.*?-->", ""), r"(?is)<(script|style)\b[^>]*>.*?</(script|style)>", "")
    inner = "|".join(tags)

    def found(t: str) -> Column:
        every = F.regexp_extract_all("c", F.lit(rf"(?s)<{t}(?:\s[^>]*)?>(.*?)</{t}>"), F.lit(1))
        return F.transform(every, lambda s, i: F.struct(F.lit(t).alias("tag"), i.alias("pos"), s.alias("string")))

    out = pages.select("path", clean.alias("c")).select("path", F.inline(F.concat(*map(found, tags))))
    return out.where(~F.col("string").rlike(rf"<({inner})[\s>]") & (F.trim("string") != ""))


def by_rules(files: DataFrame, rules: dict[str, str]) -> DataFrame:
    """A configured line machine: regexes for reset, skip, context, hint, keyvalue, tried in that order; a value with its key makes a unit from what was gathered since the last one."""
    w = Window.partitionBy("path").orderBy("pos")
    rows = lines(files)
    kind = reduce(lambda c, k: c.when(F.col("line").rlike(rules[k]), k), [k for k in ("reset", "skip", "context", "hint", "keyvalue") if k in rules], F.when(F.lit(False), ""))
    rows = rows.withColumn("kind", kind)
    ends = F.col("kind").isin("reset", "keyvalue").cast("int")
    rows = rows.withColumn("g", F.coalesce(F.sum(ends).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    pick = lambda k: F.last(F.when(F.col("kind") == k, F.regexp_extract("line", rules[k], 1)), ignorenulls=True).over(Window.partitionBy("path", "g").orderBy("pos")) if k in rules else F.lit(None).cast("string")
    rows = rows.withColumn("context", pick("context")).withColumn("hint", pick("hint")).where("kind = 'keyvalue'")
    return rows.select("path", "pos", F.regexp_extract("line", rules["keyvalue"], 1).alias("key"), F.regexp_extract("line", rules["keyvalue"], 2).alias("string"), "context", "hint")


def render_lines(files: DataFrame, pattern: str, translations: DataFrame, blank: bool = False) -> DataFrame:
    """Files rebuilt in each language with translations in place of the values of key lines. translations: path, key, language, target. Untranslated: the source, or nothing."""
    langs = translations.select("language").distinct()
    rows = lines(files).withColumn("hit", F.col("line").rlike(pattern)).withColumn("key", F.when(F.col("hit"), F.regexp_extract("line", pattern, 1)))
    rows = rows.crossJoin(F.broadcast(langs)).join(translations.dropDuplicates(["path", "key", "language"]), ["path", "key", "language"], "left")
    value = F.regexp_extract("line", pattern, 2)
    head = F.expr("substring(line, 1, length(line) - length(value))")
    new = F.when(F.col("hit"), F.concat(head, F.coalesce("target", F.lit("") if blank else F.col("value")))).otherwise(F.col("line"))
    rows = rows.withColumn("value", value).withColumn("out", new)
    parts = rows.groupBy("path", "language").agg(F.array_sort(F.collect_list(F.struct("pos", "out"))).alias("p"))
    return parts.select("path", "language", F.array_join(F.transform("p", lambda x: x["out"]), "\n").alias("content"))


def disambiguate(units: DataFrame) -> DataFrame:
    """Contexts that tell units of one file and text apart: own, then key, then hint, then base.1, base.2, ... in order.

    units: path, pos, string, context, key, hint. Rows of one file and text stand one after the other in one task, which passes over them once, batch by batch; it remembers the contexts that the text has,
    and for each base the next number to try. Time grows in proportion to rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, used, tried = None, set(), {}
        for b in batches:
            out = []
            for path, string, context, key, hint in zip(*(b.column(c).to_pylist() for c in ("path", "string", "context", "key", "hint")), strict=True):
                if now != (path, string):
                    now, used, tried = (path, string), set(), {}
                c = context or ""
                for other in (key, hint):
                    if c in used and other:
                        c = other
                base = c or "context"
                n = tried.get(base, 0)
                while c in used:
                    n += 1
                    c = f"{base}.{n}"
                if n:
                    tried[base] = n
                used.add(c)
                out.append(c)
            yield pa.RecordBatch.from_arrays([b.column("path"), b.column("pos").cast(pa.int32()), b.column("string"), pa.array(out, pa.string())], names=["path", "pos", "string", "context"])

    rows = units.select("path", "pos", "string", "context", "key", "hint").repartition("path", "string").sortWithinPartitions("path", "string", "pos")
    return rows.mapInArrow(run, "path string, pos int, string string, context string")


def disambiguate_plain(units: DataFrame) -> DataFrame:
    """The same for units without keys and hints, as a window."""
    w = Window.partitionBy("path", "string", F.coalesce("context", F.lit(""))).orderBy("pos")
    n = F.row_number().over(w) - 1
    base = F.coalesce(F.nullif("context", F.lit("")), F.lit("context"))
    return units.withColumn("context", F.when(n == 0, F.coalesce("context", F.lit(""))).otherwise(F.concat_ws(".", base, n.cast("string")))).select("path", "pos", "string", "context")


def segment_keys(units: DataFrame, separator: str = r"\n{2,}") -> DataFrame:
    """Segments of units' texts: the n-th has key key:n."""
    rows = units.select("path", "key", F.posexplode(fx.segment(F.col("string"), separator)).alias("n", "string")).where("string <> ''")
    return rows.select("path", F.concat(F.col("key").cast("string"), F.lit(":"), (F.col("n") + 1).cast("string")).alias("key"), "string")


def scan_files(files: DataFrame, match: list[str], exclude: list[str] = (), dir_exclude: str = r"(^|/)(\.git|\.svn|\.hg|CVS)/", prefix: str = "") -> DataFrame:
    """Paths that any pattern matches and none excludes, outside version control folders."""
    p = F.col("path")
    hit = reduce(lambda a, m: a | p.rlike(m), match, F.lit(False)) if match else F.lit(True)
    out = reduce(lambda a, m: a | p.rlike(m), exclude, F.lit(False))
    return files.where(hit & ~out & ~p.rlike(dir_exclude)).select(F.concat(F.lit(prefix), p).alias("path"))


def normalize_text(raw: Column) -> Column:
    """Text of a file's bytes: by its byte order mark, else UTF-8; without the mark, line ends as line feeds."""
    b = F.hex(F.substring(raw, 1, 3))
    s = F.when(b.startswith("FFFE"), F.decode(raw, "UTF-16LE")).when(b.startswith("FEFF"), F.decode(raw, "UTF-16BE")).otherwise(F.decode(raw, "UTF-8"))
    return F.replace(F.regexp_replace(s, "^\ufeff", ""), F.lit("\r\n"), F.lit("\n"))


def po_blocks(files: DataFrame) -> DataFrame:
    """Blocks of PO files with their fields; continued strings are joined, control characters dropped."""
    joined = F.replace("content", F.lit('"\n"'), F.lit(""))
    rows = files.select("path", F.posexplode(F.split(joined, "\n\n")).alias("pos", "b"))
    field = lambda name: fx.po_unescape(F.regexp_extract("b", rf'(?m)^{name} "(.*)"$', 1))
    rows = rows.select(
        "path", "pos", F.regexp_extract("b", r"(?m)^#: ID: ([0-9a-f]{32})", 1).alias("id"), F.regexp_extract("b", r"(?m)^# (.*)$", 1).alias("comment"), F.col("b").rlike("(?m)^#,.*fuzzy").cast("int").alias("fuzzy"),
        F.nullif(field("msgctxt"), F.lit("")).alias("context"), field("msgid").alias("source"), field(r"msgstr(?:\[0\])?").alias("target"),
    )
    return rows.where("source <> ''")


def po_source(files: DataFrame) -> DataFrame:
    """Source units of PO files, keyed by text and context."""
    return po_blocks(files).select("path", "pos", "source", "context", fx.string_key(F.col("source"), F.col("context")).alias("key"))


def po_units(files: DataFrame) -> DataFrame:
    """Translated or commented units whose id is that of their text and context; an empty target isn't fuzzy."""
    rows = po_blocks(files).where((F.col("target") != "") | (F.col("comment") != "")).where(F.col("id") == fx.string_key(F.col("source"), F.col("context")))
    return rows.withColumn("fuzzy", F.when(F.col("target") == "", 0).otherwise(F.col("fuzzy")))


def in_parts(units: DataFrame, size: int | None) -> DataFrame:
    """units with paths numbered by ranges of size positions (path.0, path.1, ...), so that no file holds more of them than its range; without a size as they are."""
    if size is None:
        return units
    return units.withColumn("path", F.concat_ws(".", "path", F.floor(F.col("pos") / size).cast("string")))


def po_text(units: DataFrame, size: int | None = None) -> DataFrame:
    """PO files of units (path, language, pos, source, context, target, comment, fuzzy): a header and blocks in order.

    A file is made whole in one task; size splits large ones into numbered parts (in_parts).
    """
    units = in_parts(units, size)
    line = lambda name, c: F.concat(F.lit(f'{name} "'), fx.po_escape(c), F.lit('"'))
    block = F.concat_ws(
        "\n", F.when(fx.blank(F.col("comment")) != "", F.concat(F.lit("# "), "comment")), F.concat(F.lit("#: ID: "), fx.string_key(F.col("source"), F.col("context"))), F.when(F.col("fuzzy") == 1, "#, fuzzy"),
        F.when(fx.blank(F.col("context")) != "", line("msgctxt", F.col("context"))), line("msgid", F.col("source")), line("msgstr", fx.blank(F.col("target"))),
    )
    parts = units.groupBy("path", "language").agg(F.array_sort(F.collect_list(F.struct("pos", block.alias("b")))).alias("p"))
    head = F.concat(F.lit('msgid ""\nmsgstr ""\n"Language: '), fx.locale(F.col("language")), F.lit('\\n"'))
    return parts.select("path", "language", F.concat(head, F.lit("\n\n"), F.array_join(F.transform("p", lambda x: x["b"]), "\n\n"), F.lit("\n")).alias("content"))


def xliff_text(units: DataFrame, size: int | None = None) -> DataFrame:
    """trans-unit elements of units, in order, one file each; size splits large files as in po_text."""
    units = in_parts(units, size)
    unit = F.concat(
        F.lit('<trans-unit id="'), fx.string_key(F.col("source"), F.col("context")), F.lit('" approved="'), F.when(F.col("fuzzy") == 1, "no").otherwise("yes"), F.lit('"><source>'), fx.xml_escape(F.col("source"), False),
        F.lit('</source><target state="'), F.when(fx.blank(F.col("target")) == "", "new").otherwise("translated"), F.lit('">'), fx.xml_escape(fx.blank(F.col("target")), False), F.lit("</target></trans-unit>"),
    )
    parts = units.groupBy("path", "language").agg(F.array_sort(F.collect_list(F.struct("pos", unit.alias("u")))).alias("p"))
    body = F.array_join(F.transform("p", lambda x: x["u"]), "\n")
    return parts.select("path", "language", F.concat(F.lit('<xliff version="1.2"><file><body>\n'), body, F.lit("\n</body></file></xliff>")).alias("content"))


def xliff_units(files: DataFrame) -> DataFrame:
    """Units of XLIFF files (path, language, content): id, source, target, fuzzy; without a target they are left out."""
    unit = r'(?s)<trans-unit id="([^"]*)" approved="([^"]*)"><source>(.*?)</source><target[^>]*>(.*?)</target>'
    every = [F.regexp_extract_all("content", F.lit(unit), F.lit(g)).alias(n) for g, n in enumerate(("id", "approved", "source", "target"), 1)]
    rows = files.select("path", "language", F.posexplode(F.arrays_zip(*every)).alias("pos", "u"))
    rows = rows.select("path", "language", "pos", F.col("u.id").alias("id"), fx.xml_unescape(F.col("u.source")).alias("source"), fx.xml_unescape(F.col("u.target")).alias("target"), (F.col("u.approved") == "no").cast("int").alias("fuzzy"))
    return rows.where("target <> ''")


#: Columns of exchange CSV files.
CSV_COLUMNS = ["ID", "Context", "Hint", "Source", "Translation", "Needs Work", "Comment"]


def csv_rows(units: DataFrame) -> DataFrame:
    """Units as rows of exchange CSV; nulls are empty fields."""
    key = fx.string_key(F.col("source"), F.col("context"))
    fuzzy = F.when(F.col("fuzzy") == 1, "1").otherwise("")
    values = [key, fx.blank(F.col("context")), F.lit(""), F.col("source"), fx.blank(F.col("target")), fuzzy, fx.blank(F.col("comment"))]
    return units.select("language", *[v.alias(c) for c, v in zip(CSV_COLUMNS, values, strict=True)])


def write_csv(units: DataFrame, folder: str) -> None:
    csv_rows(units).write.partitionBy("language").option("header", True).option("escape", '"').option("emptyValue", "").csv(folder)


def read_csv(spark, folder: str) -> DataFrame:
    schema = ", ".join(f"`{c}` string" for c in CSV_COLUMNS) + ", language string"
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).schema(schema).csv(folder)
    none = lambda c: F.nullif(F.col(c), F.lit(""))
    return rows.select("language", F.col("ID").alias("id"), none("Context").alias("context"), F.col("Source").alias("source"), none("Translation").alias("target"), F.when(none("Needs Work").isNull(), 0).otherwise(1).alias("fuzzy"), none("Comment").alias("comment"))


def bilingual_import(segments: DataFrame, tm: dict[str, DataFrame], overwrite: bool = False, force: bool = False) -> DataFrame:
    """Translations to write from (item_id, language, source, target) segments: the source must be the memory's, the target another text, and existing ones stay unless overwrite, which marks them merged."""
    s = tm["items"].select("item_id", "string_id").join(tm["strings"].select("string_id", F.col("string").alias("own")), "string_id").select("item_id", "own")
    x = segments.withColumn("target", F.replace("target", F.lit("{\\n}"), F.lit("\n"))).join(s, "item_id").where(F.col("own") == F.col("source"))
    x = x if force else x.where("target <> source")
    have = tm["translations"].where("string is not null").select("item_id", "language", F.lit(1).alias("has"))
    x = x.join(have, ["item_id", "language"], "left")
    x = x if overwrite else x.where("has is null")
    return x.select("item_id", "language", "target", F.coalesce("has", F.lit(0)).alias("merge"))


def xml_nodes(files: DataFrame, paths: list[str]) -> DataFrame:
    """Texts of XML elements on configured paths; blanks, symbols and numbers alone are left out."""

    def found(node: str) -> Column:
        return F.transform(F.xpath("content", F.lit(f"{node}/text()")), lambda s, i: F.struct(F.lit(node).alias("node"), i.alias("pos"), s.alias("string")))

    return files.select("path", F.inline(F.concat(*map(found, paths)))).where("trim(string) <> ''").where(~F.col("string").rlike(r"^(\W+|\d+)$"))


def xliff_source(files: DataFrame) -> DataFrame:
    """Source units of XLIFF files: key is the unit's id, hint its file and notes."""
    group = lambda c, p, g: F.regexp_extract_all(c, F.lit(p), F.lit(g))
    file = r'(?s)<file original="([^"]*)"[^>]*>(.*?)</file>'
    rows = files.select("path", F.explode(F.arrays_zip(group("content", file, 1).alias("original"), group("content", file, 2).alias("body"))).alias("f")).select("path", "f.*")
    unit = r'(?s)<trans-unit id="([^"]*)"[^>]*>\s*<source>(.*?)</source>(?:\s*<note>(.*?)</note>)?'
    rows = rows.select("path", "original", F.posexplode(F.arrays_zip(group("body", unit, 1).alias("key"), group("body", unit, 2).alias("string"), group("body", unit, 3).alias("note"))).alias("pos", "u"))
    return rows.select("path", "pos", "u.key", fx.xml_unescape(F.col("u.string")).alias("string"), F.concat_ws("\n", "original", F.nullif(F.col("u.note"), F.lit(""))).alias("hint"))

def ts_source(files: DataFrame) -> DataFrame:
    """Source units of Qt TS files: the context is the group's name and the message's comment, the key context and text."""
    group = lambda c, p, g: F.regexp_extract_all(c, F.lit(p), F.lit(g))
    outer = r"(?s)<context>\s*<name>(.*?)</name>(.*?)</context>"
    rows = files.select("path", F.explode(F.arrays_zip(group("content", outer, 1).alias("name"), group("content", outer, 2).alias("body"))).alias("c")).select("path", "c.*")
    inner = r"(?s)<message>\s*<source>(.*?)</source>(?:\s*<comment>(.*?)</comment>)?"
    rows = rows.select("path", "name", F.posexplode(F.arrays_zip(group("body", inner, 1).alias("string"), group("body", inner, 2).alias("note"))).alias("pos", "m"))
    context = F.concat_ws(" ", "name", F.nullif(F.col("m.note"), F.lit("")))
    string = fx.xml_unescape(F.col("m.string"))
    return rows.select("path", "pos", string.alias("string"), context.alias("context"), F.concat_ws(":", context, string).alias("key"))
