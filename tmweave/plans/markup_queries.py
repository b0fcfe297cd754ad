"""Registered queries of the markup operators. Files are put together from known units in several shapes, and the SQL gives the units, not the patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tmweave.operators import exchange, formats, markup
from tmweave.sources import folders, tree

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: Rows of which one task makes files, about, and tasks at most: a shuffle of up to 200 partitions is written without holding its rows.
ROWS, TASKS = 10_000, 200


def made(spark, d, table: str, path: str, content: str):
    """Files (path, content) of a table's rows, content in Spark SQL. Rows are dealt before files are made of them: a table has few splits for the content that comes of it, and the tasks that shuffle the files would hold all of a split's."""
    rows = spark.read.parquet(f"{d}/{table}.parquet")
    tasks = min(-(-rows.count() // ROWS), TASKS)
    rows = rows.repartition(tasks, path) if tasks > 1 else rows
    return rows.select(F.col(path).cast("string").alias("path"), F.expr(content).alias("content"))


NESTED = """concat('<html><body class="a>b"><P>', url, '</P><ul><li>lost<ul><li>inner ', page_id, '</li><li>last <b>', url, '</b></li></ul></li><li>tail<!-- <p>c</p> --></ul>',
 '<x-page lang="fr">', regexp_replace(html, '</?html[^>]*>', ''), '<p>non</p><span LANG=en>oui <i>', page_id, '</i></span></x-page>',
 CASE WHEN page_id % 3 = 0 THEN '<p>open <br>still' WHEN page_id % 3 = 1 THEN '<dl><dt>t<dd>d</dl>' ELSE '<select><option>x<option> </select><label><p></p>y</label>' END,
 '<script>"<p>no</p>"</script><div><h7>deep</h7></div></body></html>')"""


@query("""
WITH b AS (SELECT page_id, url, page_id % 3 AS m FROM pages WHERE url IS NOT NULL AND html IS NOT NULL),
u AS (SELECT page_id, 0 AS n, 'p' AS tag, url AS string FROM b UNION ALL SELECT page_id, 1, 'li', 'inner ' || page_id FROM b UNION ALL SELECT page_id, 2, 'li', 'last <b>' || url || '</b>' FROM b
 UNION ALL SELECT page_id, 3, 'li', 'tail' FROM b UNION ALL SELECT page_id, 4, 'span', 'oui <i>' || page_id || '</i>' FROM b
 UNION ALL SELECT page_id, 5, 'p', 'open <br>still' FROM b WHERE m = 0 UNION ALL SELECT page_id, 5, 'dt', 't' FROM b WHERE m = 1 UNION ALL SELECT page_id, 6, 'dd', 'd' FROM b WHERE m = 1
 UNION ALL SELECT page_id, 5, 'option', 'x' FROM b WHERE m = 2 UNION ALL SELECT page_id, 6, 'label', '<p></p>y' FROM b WHERE m = 2 UNION ALL SELECT page_id, 7, 'h7', 'deep' FROM b)
SELECT page_id::VARCHAR AS path, CAST(row_number() OVER (PARTITION BY page_id ORDER BY n) - 1 AS INT) AS pos, tag, string FROM u""")
def extract_nested_blocks(spark, d):
    return markup.html_blocks(made(spark, d, "pages", "page_id", NESTED))


#: A file of two units in the shape of one tool or another, and in version 1 or 2.
XLIFF = """CASE p_partkey % 3 WHEN 0 THEN concat('<?xml version="1.0"?><xliff version="1.2"><file source-language="en" original="', p_brand, '"><header><note>about ', p_brand, '</note></header><body><group id="g">',
 '<note>grouped</note><trans-unit approved="no" id="u', p_partkey, '"><note>see &amp; tell</note><source xml:lang="en">', p_name, ' <x id="1"/></source><target state="new">', p_type, '</target><alt-trans><source>no</source><target>no</target></alt-trans></trans-unit></group>',
 '<trans-unit id="v"><source><![CDATA[<', p_type, '>]]></source></trans-unit></body></file></xliff>')
 WHEN 1 THEN concat('<xliff xmlns="urn:x" version=''1.2''>\n<file original=''', p_brand, '''>\n<body>\n<trans-unit\n  id="u', p_partkey, '">\n <target>', p_type, '</target>\n <source>', p_name, '</source>\n <note from="x">a</note><note>b</note>\n</trans-unit>\n</body></file></xliff>')
 ELSE concat('<xliff version="2.0"><file id="f" original="', p_brand, '"><notes><note>fn</note></notes><unit id="', p_partkey, '"><notes><note>un</note></notes><segment id="s1"><source>', p_name, '</source><target>', p_type, '</target></segment><segment id="s2"><source>', p_type, '</source></segment></unit></file></xliff>') END"""

XLIFF_UNITS = """u AS (SELECT p_partkey::VARCHAR AS path, 0 AS n, 'u' || p_partkey AS key, p_name || ' <x id="1"/>' AS string, 'file-original:' || p_brand || ' group-id:g unit-id:u' || p_partkey || chr(10) || chr(10) || 'File note: about ' || p_brand || chr(10) || chr(10) || 'Group note: grouped' || chr(10) || chr(10) || 'Unit note: see & tell' AS hint FROM part WHERE p_partkey % 3 = 0
 UNION ALL SELECT p_partkey::VARCHAR, 1, 'v', '<![CDATA[<' || p_type || '>]]>', 'file-original:' || p_brand || ' unit-id:v' || chr(10) || chr(10) || 'File note: about ' || p_brand FROM part WHERE p_partkey % 3 = 0
 UNION ALL SELECT p_partkey::VARCHAR, 0, 'u' || p_partkey, p_name, 'file-original:' || p_brand || ' unit-id:u' || p_partkey || chr(10) || chr(10) || 'Unit note: a' || chr(10) || chr(10) || 'Unit note: b' FROM part WHERE p_partkey % 3 = 1
 UNION ALL SELECT p_partkey::VARCHAR, k, 's' || (k + 1), CASE k WHEN 0 THEN p_name ELSE p_type END, 'file-original:' || p_brand || ' unit-id:' || p_partkey || chr(10) || chr(10) || 'File note: fn' || chr(10) || chr(10) || 'Unit note: un' FROM part, range(2) r(k) WHERE p_partkey % 3 = 2)"""


@query(f"WITH {XLIFF_UNITS} SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY n) AS INT) AS nth, key, string, hint FROM u")
def extract_xliff_any(spark, d):
    out = markup.xliff_source(made(spark, d, "part", "p_partkey", XLIFF))
    return out.select("path", F.row_number().over(markup.Window.partitionBy("path").orderBy("pos")).alias("nth"), "key", "string", "hint")


@query("""SELECT p_partkey::VARCHAR AS path, 'u' || p_partkey AS id, p_name || CASE p_partkey % 3 WHEN 0 THEN ' ' ELSE '' END AS source, p_type AS target, CASE p_partkey % 3 WHEN 0 THEN 1 ELSE 0 END AS fuzzy, CASE p_partkey % 3 WHEN 0 THEN 'see & tell' ELSE 'a' || chr(10) || 'b' END AS comment FROM part WHERE p_partkey % 3 < 2
 UNION ALL SELECT p_partkey::VARCHAR, 's' || (k + 1), CASE k WHEN 0 THEN p_name ELSE p_type END, CASE k WHEN 0 THEN p_type ELSE '' END, 0, 'un' FROM part, range(2) r(k) WHERE p_partkey % 3 = 2""")
def xliff_exchange_read(spark, d):
    return markup.xliff_import(made(spark, d, "part", "p_partkey", XLIFF)).select("path", "id", "source", "target", "fuzzy", "comment")


TS = """concat('<?xml version="1.0"?><!DOCTYPE TS><TS language="de" version="2.1">', '<context>\n <name>', p_brand, '</name>\n <message numerus="yes"><location line="3" filename="a.cpp"/>',
 CASE p_partkey % 2 WHEN 0 THEN concat('<source>', p_name, ' &lt;b&gt;</source><comment>verb</comment><extracomment>long</extracomment>') ELSE concat('<extracomment>long</extracomment><source><![CDATA[', p_name, ' <b>]]></source><comment>verb</comment>') END,
 '<translation type="unfinished"><numerusform>', p_type, '</numerusform></translation></message><message><source></source></message></context><context><message><translation/><source>', p_type, '</source></message><name>last</name></context></TS>')"""


@query("""SELECT p_partkey::VARCHAR AS path, p_brand || chr(10) || 'verb:' || p_name || ' <b>' AS key, p_brand || chr(10) || 'verb' AS context, p_name || ' <b>' AS source, p_type AS translation, 'long' AS hint FROM part
 UNION ALL SELECT p_partkey::VARCHAR, 'last:' || p_type, 'last', p_type, '', '' FROM part""")
def extract_ts_any(spark, d):
    return markup.ts_units(made(spark, d, "part", "p_partkey", TS)).drop("pos")


#: Bytes of the documents' texts in one encoding or another; the sixth kind isn't what it says, the seventh can't be decoded.
RAW = r"""CASE doc_id % 7 WHEN 0 THEN encode(t, 'UTF-8') WHEN 1 THEN concat(X'EFBBBF', encode(t, 'UTF-8')) WHEN 2 THEN concat(X'FFFE', encode(t, 'UTF-16LE')) WHEN 3 THEN concat(X'FEFF', encode(t, 'UTF-16BE'))
 WHEN 4 THEN concat(encode('<?xml version="1.0" encoding="iso-8859-1"?>', 'UTF-8'), encode(regexp_replace(t, '[^\\n -~¡-þ]', '?'), 'ISO-8859-1')) WHEN 5 THEN concat(encode(t, 'UTF-8'), X'E9') ELSE encode(concat('<?xml version="1.0" encoding="KOI8-R"?>', t), 'UTF-8') END"""


@query(r"""WITH d AS (SELECT doc_id, doc_id % 7 AS m, text AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_id::VARCHAR AS path, CASE m WHEN 2 THEN 'UTF-16LE' WHEN 3 THEN 'UTF-16BE' WHEN 4 THEN 'ISO-8859-1' WHEN 6 THEN 'KOI8-R' ELSE 'UTF-8' END AS encoding,
 CASE m WHEN 5 THEN 'not UTF-8' WHEN 6 THEN 'unknown encoding KOI8-R' END AS rejected,
 CASE WHEN m < 4 THEN t WHEN m = 4 THEN '<?xml version="1.0" encoding="iso-8859-1"?>' || replace(regexp_replace(replace(t, chr(10), chr(13) || chr(10)), '[^\n -~¡-þ]', '?', 'g'), chr(13) || chr(10), chr(10)) END AS content FROM d""")
def decode_files(spark, d):
    """Files in several encodings, with line ends of two characters; some can't be decoded."""
    rows = spark.read.parquet(f"{d}/documents.parquet").where("text IS NOT NULL").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\r\n")).alias("t"))
    return tree.decoded(rows.select(F.col("doc_id").cast("string").alias("path"), F.expr(RAW).alias("raw")))


#: Records with quotes, commas and line ends in fields, and two kinds of faulty files.
CSV = r"""CASE p_partkey % 5 WHEN 3 THEN concat('Key,Comment\r\n', p_partkey, ',x\r\n') WHEN 4 THEN concat('Key,String\na,b\nk,', p_name, ',extra') ELSE
 concat('KEY,Other,String,comment\r\n"k', p_partkey, '",,"say ""', p_name, '"", twice",', p_brand, '\r\nplain,o"o,', p_type, ',"two\nlines"\r\n', CASE WHEN p_partkey % 5 = 1 THEN '"",x,,' ELSE 'last,,"",""\r\n' END) END"""


@query("""WITH p AS (SELECT p_partkey::VARCHAR AS path, p_partkey % 5 AS m, p_name, p_type, p_brand, p_partkey FROM part)
SELECT path, 1 AS pos, 'k' || p_partkey AS key, 'say "' || p_name || '", twice' AS string, 'k' || p_partkey AS context, p_brand AS comment, NULL AS reason FROM p WHERE m < 3
UNION ALL SELECT path, 2, 'plain', p_type, 'plain', 'two' || chr(10) || 'lines', NULL FROM p WHERE m < 3 UNION ALL SELECT path, 3, CASE m WHEN 1 THEN '' ELSE 'last' END, '', CASE m WHEN 1 THEN '' ELSE 'last' END, '', NULL FROM p WHERE m < 3
UNION ALL SELECT path, NULL, NULL, NULL, NULL, NULL, CASE m WHEN 3 THEN 'no column string' ELSE 'other number of fields in record 2' END FROM p WHERE m >= 3""")
def csv_exchange_read(spark, d):
    """Units by header, and the files that are left out with the reason."""
    units, bad = exchange.csv_units(made(spark, d, "part", "p_partkey", CSV))
    return units.withColumn("reason", F.lit(None).cast("string")).unionByName(bad, allowMissingColumns=True)


#: PO files with line ends of two characters, without empty lines, with strings over several lines, plurals, and an id on a line of its own.
PO = r"""replace(concat('msgid ""\nmsgstr ""\n"Language: de\\n"\n\n# first\n# second\n#. note\n#: ID:\n#: ', md5(concat(p_name, ' "q"', chr(1), p_brand)), '\n#, c-format, Fuzzy\nmsgctxt "', p_brand, '"\nmsgid ""\n"', p_name, ' "\n"\\"q\\""\nmsgstr "', p_type, '"\n',
 '#: ID: ', md5(concat(p_name, chr(31), p_type, chr(1))), '\nmsgid "', p_name, '"\nmsgid_plural "', p_type, '"\nmsgstr[0] "eins"\nmsgstr[1] "zwei ', p_partkey, '"\n# only\n#: ID: ', md5(concat('c', chr(1))), '\n#, fuzzy\nmsgid "c"\nmsgstr ""\n#~ msgid "old"\n#~ msgstr "alt"\n',
 '#: ID: 0\nmsgid "bad"\nmsgstr "x"\n\n\nmsgid "none"\nmsgstr "x"'), '\n', CASE WHEN p_partkey % 2 = 0 THEN '\r\n' ELSE '\n' END)"""


@query("""SELECT p_partkey::VARCHAR AS path, p_name || ' "q"' AS source, p_brand AS context, p_type AS target, 1 AS fuzzy, 'first' || chr(10) || 'second' AS comment FROM part
UNION ALL SELECT p_partkey::VARCHAR, p_name || chr(31) || p_type, NULL, 'eins' || chr(31) || 'zwei ' || p_partkey, 0, '' FROM part UNION ALL SELECT p_partkey::VARCHAR, 'c', NULL, '', 0, 'only' FROM part""")
def po_exchange_read(spark, d):
    return exchange.po_import(made(spark, d, "part", "p_partkey", PO)).drop("pos", "id")


@query("""SELECT p_partkey::VARCHAR AS path, 'de' AS language, p_name || CASE WHEN p_partkey % 2 = 0 THEN chr(31) || p_type ELSE '' END AS source, nullif(CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_brand END, '') AS context,
 'eins "' || p_type || CASE WHEN p_partkey % 2 = 0 THEN '"' || chr(31) || 'zwei' ELSE '"' END AS target, CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END AS fuzzy, CASE WHEN p_partkey % 4 = 0 THEN 'a' || chr(10) || 'b' ELSE '' END AS comment FROM part""")
def po_exchange_roundtrip(spark, d):
    """Units written as PO files in parts and read back."""
    part = spark.read.parquet(f"{d}/part.parquet")
    e = {
        "path": "CAST(p_partkey AS STRING)", "language": "'de'", "pos": "CAST(p_partkey AS INT)", "source": "concat(p_name, CASE WHEN p_partkey % 2 = 0 THEN concat(chr(31), p_type) ELSE '' END)", "context": "CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_brand END",
        "target": "concat('eins \"', p_type, CASE WHEN p_partkey % 2 = 0 THEN concat('\"', chr(31), 'zwei') ELSE '\"' END)", "fuzzy": "CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END", "comment": "CASE WHEN p_partkey % 4 = 0 THEN 'a\\nb' ELSE '' END", "hint": "p_type",
    }
    written = exchange.po_write(part.select(*(F.expr(v).alias(k) for k, v in e.items())), size=1000)
    read = exchange.po_import(written)
    return read.select(F.regexp_replace("path", r"\.\d+$", "").alias("path"), F.lit("de").alias("language"), "source", "context", "target", "fuzzy", "comment")


ANDROID = """concat('<?xml version="1.0"?>\n<resources>\n <!-- c -->\n <string\n  name=''a', p_partkey, ''' x="a/b">', p_name, '</string><string translatable="false" name="n">', p_name, '</string>\n <plurals name="p"><item quantity="one">', p_type, '</item>\n<item quantity=''many''>many <b>', p_type, '</b></item></plurals>',
 '<string-array name="l"><item>', p_brand, '</item><item/></string-array>\n</resources>\n')"""
#: The same with what the translations put in.
ANDROID_DE = """'<?xml version="1.0"?>' || chr(10) || '<resources>' || chr(10) || ' <!-- c -->' || chr(10) || ' <string' || chr(10) || '  name=''a' || p_partkey || ''' x="a/b">' || '[' || p_name || ']' || '</string><string translatable="false" name="n">' || p_name || '</string>' || chr(10) || ' <plurals name="p"><item quantity="one">' || p_type || '</item>' || chr(10)
 || '<item quantity=''many''>[many <b>' || p_type || '</b>]</item></plurals><string-array name="l"><item>' || p_brand || '</item><item>neu</item></string-array>' || chr(10) || '</resources>' || chr(10)"""


@query("""SELECT p_partkey::VARCHAR AS path, 0 AS pos, 'a' || p_partkey AS key, p_name AS string, p_name AS raw FROM part UNION ALL SELECT p_partkey::VARCHAR, 1, 'p:one', p_type, p_type FROM part
 UNION ALL SELECT p_partkey::VARCHAR, 2, 'p:many', 'many ' || p_type, 'many <b>' || p_type || '</b>' FROM part UNION ALL SELECT p_partkey::VARCHAR, 3, 'l:0', p_brand, p_brand FROM part""")
def extract_android_any(spark, d):
    return markup.tag_units(markup.android_pieces(made(spark, d, "part", "p_partkey", ANDROID)))


@query(f"SELECT p_partkey::VARCHAR AS path, 'de' AS language, {ANDROID_DE} AS content FROM part")
def render_android(spark, d):
    """Some units translated, the rest as it stands, put together from parts. Pieces are read several times, so they are written once."""
    pieces = folders.new_path(spark, "pieces")
    markup.android_pieces(made(spark, d, "part", "p_partkey", ANDROID)).write.parquet(pieces)
    found = spark.read.parquet(pieces)
    some = markup.tag_units(found).where("key LIKE 'a%' OR key = 'p:many'").select("path", "key", F.lit("de").alias("language"), F.concat(F.lit("["), "raw", F.lit("]")).alias("target"))
    new = found.where("key = 'l:1'").select("path", "key", F.lit("de").alias("language"), F.lit("neu").alias("target"))
    parts = markup.rebuilt(found, some.union(new), size=2)
    whole = parts.groupBy("path", "language").agg(F.array_sort(F.collect_list(F.struct("part", F.col("content").alias("raw")))).alias("p"))
    return whole.select("path", "language", markup.joined("p", "content"))


@query("SELECT page_id::VARCHAR AS path, 'de' AS language, html AS content FROM pages WHERE html IS NOT NULL AND html <> ''")
def rebuild_pages(spark, d):
    """Pages cut into pieces around their blocks and put together again without a translation: byte for byte what they were."""
    pages = made(spark, d, "pages", "page_id", "html")
    return markup.rebuilt(markup.html_pieces(pages), spark.createDataFrame([("", "", "de", None)], "path string, key string, language string, target string")).select("path", "language", "content")


STRINGS = r"""concat('/* first */\n/* Class = "X" */\n/* ', p_name, ' */\n"a##ctx', p_partkey, '" = "', p_name, '"; // tail \n\n/* gone */\n\n/* kept */\n"p" = "Placeholder: x"; // too\nbare1 = "say \\"', p_type, '\\"\nand \\U00e9"  ;\n/* no unit */\n"empty" = "";\n"last\\"q" = "', p_brand, '";')"""


@query(r"""SELECT p_partkey::VARCHAR AS path, 'a##ctx' || p_partkey AS key, p_name AS string, 'ctx' || p_partkey AS context, 'first' || chr(10) || 'tail' || chr(10) || 'a' AS hint FROM part
UNION ALL SELECT p_partkey::VARCHAR, 'bare1', 'say "' || p_type || '"' || chr(10) || 'and é', NULL, 'kept' || chr(10) || 'too' || chr(10) || 'bare1' FROM part
UNION ALL SELECT p_partkey::VARCHAR, 'last"q', p_brand, NULL, 'no unit' || chr(10) || 'empty' || chr(10) || 'last"q' FROM part""")
def extract_strings_table(spark, d):
    return formats.strings_table(made(spark, d, "part", "p_partkey", STRINGS)).drop("pos")


@query("""SELECT p_partkey::VARCHAR AS path, p_name AS string, 'k1' AS context, p_type AS hint FROM part UNION ALL SELECT p_partkey::VARCHAR, p_brand, 'k "2"', NULL FROM part""")
def extract_chrome_messages(spark, d):
    return formats.chrome_messages(made(spark, d, "part", "p_partkey", """concat('{"k1": {"description": "', p_type, '", "message": "', p_name, '", "placeholders": {"a": {"content": "$1"}}}, "k \\\\"2\\\\"": {"message": "', p_brand, '"}, "k3": {"message": ""}}')"""))


@query("""SELECT p_partkey::VARCHAR AS path, 0 AS pos, 'k' || p_partkey AS key, p_name || ' ' || p_type AS string, 'c1' || chr(10) || p_brand AS hint FROM part UNION ALL SELECT p_partkey::VARCHAR, 1, 'z', p_brand, NULL FROM part""")
def extract_locjson(spark, d):
    return formats.locjson(made(spark, d, "part", "p_partkey", """concat('{"properties": {"version": 1}, "units": [{"key": "k', p_partkey, '", "properties": {"comments": ["c1", "', p_brand, '"], "x": 1}, "source": ["', p_name, ' ", "', p_type, '"]}, {"source": ["', p_brand, '"], "key": "z"}]}')"""))


@query("""SELECT p_partkey::VARCHAR AS path, '/a/b[0]' AS key, p_name AS string FROM part UNION ALL SELECT p_partkey::VARCHAR, '/a/c', p_brand FROM part""")
def extract_jsonp(spark, d):
    files = made(spark, d, "part", "p_partkey", """concat('callback(\\n{"a": {"b": ["', p_name, '", 3, true], "c": "', p_brand, '", "id": "', p_partkey, '"}, "d": "', p_type, '"}\\n);')""")
    return formats.json_paths(files, matches=["^/a/"], excludes=["/id$"], jsonp=True)


@query("""SELECT p_partkey::VARCHAR AS path, 0 AS pos, p_name || chr(10) || 'two' AS string, p_brand AS context, 'h' AS hint, ['f1', 'f2'] AS flags FROM part UNION ALL SELECT p_partkey::VARCHAR, 1, p_type, NULL, 'only', [] FROM part""")
def extract_master_lines(spark, d):
    return formats.master(made(spark, d, "part", "p_partkey", """concat('x <%', p_name, '\\ntwo%%', p_brand, '%%h%%f1, f2%> y <%', p_type, '%%%%only%> <%%> 5%>')"""))
