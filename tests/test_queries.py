"""Every registered query of the library beside its SQL in DuckDB, on the smallest tables; and facts and laws of the operators."""

import math
import os
from types import SimpleNamespace as Fake

import duckdb
import pytest
from pyspark.sql import functions as F

from tmweave.functions import text as fx
from tmweave.operators import extract, reuse, rules
from tmweave.plans import registry
from tmweave.sources import folders
from tmweave.streaming import incremental

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_against_sql(spark, sf, duck, name):
    df = registry.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name not in registry.ORACLES:
        assert got
        return
    rel = duck.execute(registry.ORACLES[name])
    names = [x[0] for x in rel.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in rel.fetchall()), key=repr)
    assert got == want


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()[0]


@pytest.mark.parametrize("source,want", [("FOO BAR BAZ.", "ZAB RAB OOF."), ("foo bar baz!", "zab rab oof!"), ("<strong>Foo Bar Baz</strong>", "<strong>zaB raB ooF</strong>"), ("<strong>FOO BAR BAZ.</strong>", "<strong>ZAB RAB OOF.</strong>"), ("<strong>foo bar baz!</strong>", "<strong>zab rab oof!</strong>")])
def test_near_match(spark, source, want):
    assert one(spark, fx.near_key(F.lit(source))) == one(spark, fx.near_key(F.lit("Foo Bar Baz")))
    assert one(spark, fx.near_adjust(F.lit(source), F.lit("zaB raB ooF"), F.lit("test"))) == want


def test_key(spark):
    assert one(spark, fx.string_key(F.lit("ACME account activation"), F.lit(None).cast("string"))) == "b27b28fa4633c77743f378907ae13b73"


@pytest.mark.parametrize("width,text,want", [(10, "A short string", ["A short ", "string"]), (20, "Another string\nwith an explicit line break", ["Another string\n", "with an explicit ", "line break"]), (5, "abcdefghijk", ["abcde", "fghij", "k"]), (10, "", [])])
def test_wrap(spark, width, text, want):
    got = one(spark, fx.wrap(F.lit(text), width))
    assert got == want and "".join(got) == text


def test_laws(spark):
    for s in ('a "b" \\ \n\t', "<a href='x'>&amp; é</a>", "", "plain"):
        assert one(spark, fx.po_unescape(fx.po_escape(F.lit(s)))) == s
        assert one(spark, fx.xml_unescape(fx.xml_escape(F.lit(s)))) == s
    found = fx.placeholders(F.lit("{a} and {b} and {a}"), r"\{\w\}")
    masked = fx.placeholder_mask(F.lit("{a} and {b} and {a}"), r"\{\w\}")
    assert one(spark, masked) == "<1> and <2> and <1>"
    assert one(spark, fx.placeholder_unmask(masked, found)) == "{a} and {b} and {a}"
    assert one(spark, fx.wordcount(F.lit("Saved on May 3, 2024 to <b>%s</b> in v1.2.3 &amp; {0}"))) == 6


def test_escapes(spark):
    """Escapes of program literals, of XML with apostrophes, and of characters beyond the basic plane."""
    vectors = {
        r"a\x41\u00e9\U65E5b": "aAé日b", r"\ud83d\ude00": "😀", r"\ud83d!": r"\ud83d!", r"\ude00": r"\ude00", r"\ud83d\u0041": r"\ud83dA", r"\n\t\b\f\v": "\n\t\b\f\v",
        r"\\u0041": r"\u0041", r"\\n": r"\n", "\\": "\\", r"\"\'": "\"'", "": "", r"\x4": "x4", "\\\n": "\n",
    }
    rows = spark.createDataFrame([(k, v) for k, v in vectors.items()] + [(None, None)], "s string, want string")
    assert {r.s: r.got for r in rows.select("s", fx.c_unescape(F.col("s")).alias("got")).collect()} == vectors | {None: None}
    assert one(spark, fx.java_escape(F.lit("aé😀"))) == r"a\u00e9\ud83d\ude00"
    assert one(spark, fx.c_unescape(fx.java_escape(F.lit("aé😀日")))) == "aé😀日"
    assert one(spark, fx.xml_escape(F.lit("'\"&"), True, True)) == "&apos;&quot;&amp;"
    assert one(spark, fx.xml_escape(F.lit("'\"&"), False)) == "'\"&amp;"
    assert one(spark, fx.xml_unescape(F.lit("&apos;&quot;&amp;lt;"), False, False)) == "&apos;&quot;&lt;"


def test_names(spark):
    got = spark.createDataFrame([("ru",), ("pt-br",), ("en",), ("zh-hans-CN",)], "l string").select(fx.locale(F.col("l")), fx.culture(F.col("l")), fx.locale_android(F.col("l"))).collect()
    assert [tuple(r) for r in got] == [("ru", "ru-RU", "ru"), ("pt_BR", "pt-BR", "pt-rBR"), ("en", "en-US", "en"), ("zh_HANS-CN", "zh-HANS-CN", "zh-rHANS-CN")]


def test_disambiguate(spark):
    rows = [("f", i, "x", None, k, h) for i, (k, h) in enumerate([("k1", "h1"), ("k2", "h2"), ("k2", "h2"), ("k2", "h2"), (None, None)])]
    df = spark.createDataFrame(rows, "path string, pos int, string string, context string, key string, hint string")
    assert [r.context for r in extract.disambiguate(df).orderBy("pos").collect()] == ["", "k2", "h2", "h2.1", "context.1"]


def test_reuse_flags(spark):
    cand = spark.createDataFrame([(1, "de", "s", "n", "p", "", 0, "A", 0, None), (2, "de", "s", "n", "q", "", 1, "A", 1, None), (3, "de", "t", "n", "p", "", 0, "B", 0, None), (4, "de", "t", "n", "p", "", 0, "C", 0, None)], "item_id long, language string, source string, namespace string, path string, context string, orphaned int, target string, fuzzy int, comment string")
    want = spark.createDataFrame([(10, "de", "s", "n", "q", ""), (11, "de", "t", "n", "p", "")], "item_id long, language string, source string, namespace string, path string, context string")
    get = lambda **k: {r.item_id: (r.target, r.fitness, r.cand_item) for r in reuse.best(want, cand, **k).collect()}
    assert get() == {10: ("A", 3, 1)}
    assert get(uncertain=True) == {10: ("A", 3, 1), 11: ("B", 4, 3)}
    assert get(reuse_orphaned=False) == {10: ("A", 3, 1)}


def test_no_rules(spark):
    assert one(spark, rules.rule_filter([])) is True and one(spark, rules.combine_and([])) is True and one(spark, rules.combine_and([], None)) is False


def test_empty_tables(spark):
    files = spark.createDataFrame([], "path string, content string")
    for f in (extract.keyvalue, extract.properties, extract.strings, extract.rc, extract.master, extract.json_leaves, extract.html_blocks, extract.po_units):
        assert f(files).count() == 0
    assert extract.keyvalue(spark.createDataFrame([("a", None), ("b", "")], "path string, content string")).count() == 0


def test_stream_batches(spark, tmp_path):
    """Results over several batches lie in Parquet, not in the memory sink; a key's row is that of the last batch that changed it."""
    schema = "item_id long, language string, usn long, string string, fuzzy int"
    for i, rows in enumerate([[(1, "de", 1, "a", 0), (2, "de", 2, "b", 0)], [(1, "de", 5, "c", 1)], [(1, "de", 3, "d", 0), (3, None, 4, "e", 0)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    got = incremental.run(incremental.latest(read()), f"{tmp_path}/latest", "update", f"{tmp_path}/c1", ["item_id", "language"])
    assert {tuple(r) for r in got.collect()} == {(1, "de", 5, "c", 1), (2, "de", 2, "b", 0), (3, None, 4, "e", 0)} and got.count() == 3
    assert len(os.listdir(tmp_path / "latest")) == 3
    got = incremental.run(read(), f"{tmp_path}/all", "append", f"{tmp_path}/c2")
    assert got.count() == 5 and all("/all/batch=" in f for f in got.inputFiles())


def test_changed_stream(spark, tmp_path):
    """A version of a file comes through once over all batches, and not at all if it was seen before the stream."""
    schema = "path string, hash string, size int"
    for i, rows in enumerate([[("a", "1", 5), ("b", "1", 6)], [("a", "1", 5), ("a", "2", 7), (None, "1", 0)], [("a", "1", 5), ("b", "2", 8), (None, "1", 0)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    seen = spark.createDataFrame([("b", "2", "extra")], "path string, hash string, note string")
    got = incremental.run(incremental.changed_stream(stream, seen), f"{tmp_path}/out", "append", f"{tmp_path}/c")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([("a", "1", 5), ("b", "1", 6), ("a", "2", 7), (None, "1", 0)], key=repr)


def test_shared_folder():
    """Without spark.checkpoint.dir a local master gets a folder of its own, a cluster an error."""
    session = lambda master, base: Fake(conf=Fake(get=lambda k, d: base), sparkContext=Fake(master=master, applicationId="app", getConf=lambda: Fake(get=lambda k, d: None)))
    assert folders.new_path(session("spark://host:7077", "hdfs://x/y/"), "n").startswith("hdfs://x/y/n-")
    assert folders.new_path(session("local[2]", None), "n").startswith("file://")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        folders.new_path(session("spark://host:7077", None), "n")


def test_exchange_parts(spark):
    """A large file goes out in numbered parts of bounded size, and all of it comes back."""
    rows = [("f", "de", i, f"source {i}", None, f"target {i}", None, 0) for i in range(250)]
    units = spark.createDataFrame(rows, "path string, language string, pos long, source string, context string, target string, comment string, fuzzy int")
    for write, read in ((extract.po_text, extract.po_units), (extract.xliff_text, extract.xliff_units)):
        files = write(units, size=100)
        assert {r.path for r in files.collect()} == {"f.0", "f.1", "f.2"} and write(units).count() == 1
        assert {(r.source, r.target) for r in read(files).collect()} == {(r[3], r[5]) for r in rows}


def units(spark, f, content, *columns):
    got = f(spark.createDataFrame([("f", content)], "path string, content string")).orderBy("pos").collect()
    return [tuple(r[c] for c in columns) for r in got]


def test_properties_flags(spark):
    content = "# plain\n#.comment=first\n  #.comment: second\n#.width=10\n#.beta\nkey = it''s \\u00e9\n\n#.internal\nhidden=x\n#.context:menu\nopen file:\\\n name\n#.comment=lost\n\nother x y\nempty=\nzero=0\nlone"
    want = [("key", "it's é", None, "key\nfirst\n second\n#beta #width=10"), ("open", "file: name", "menu", "open"), ("other", "x y", None, "other")]
    assert units(spark, extract.properties, content, "key", "string", "context", "hint") == want


def test_go_raw(spark):
    content = '// lost\n\n// one\n// two \n"a##menu": "x\\ty",\nb: `raw\n\\t "text"`,\n\t"c": "",\n// `\nd: "last",'
    want = [("a##menu", "x\ty", "menu", "one\ntwo\na"), ("b", 'raw\n\\t "text"', None, "b"), ("d", "last", None, "`\nd")]
    assert units(spark, extract.go_map, content, "key", "string", "context", "hint") == want


def test_rc_forms(spark):
    content = 'IDD_A DIALOGEX 0, 0\nCAPTION "The ""title"""\nBEGIN\nLTEXT "Name",IDC_X\nEND\nSTRINGTABLE\nBEGIN\nIDS_1 "one"\nIDS_2 // note\n  L"two"\nEND\nIDS_3 "out"'
    want = [("IDD_A:CAPTION", 'The "title"'), ("LTEXT", "Name"), ("IDS_1", "one"), ("IDS_2", "two")]
    assert units(spark, extract.rc, content, "key", "string") == want


def test_android_quotes(spark):
    content = '<string name="a">it\\\'s <b x=\\"1\\">\\"bold\\"</b></string><string name="e"></string><string name="z" translatable="false">x</string><string name="b">1 < 2</string>'
    assert units(spark, extract.android, content, "key", "string") == [("a", 'it\'s <b x=\\"1\\">"bold"</b>'), ("b", "1 < 2")]


def test_json_depth(spark):
    """Strings are found however deep they lie."""
    deep = '"x"'
    for i in range(12):
        deep = f'{{"k": {deep}, "n": "at {i}"}}' if i % 2 else f"[{deep}, 1]"
    got = {(r.key, r.string) for r in extract.json_leaves(spark.createDataFrame([("f", deep), ("g", '{"a": "b"}'), ("h", "no json")], "path string, content string")).collect()}
    assert ("/k[0]" * 6, "x") in got and ("/a", "b") in got and len(got) == 8
    assert ("/k[0]" * 3 + "/n", "at 5") in got
