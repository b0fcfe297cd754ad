"""Facts and laws of the markup, tree, version, segment, phase and upsert operators."""

import os
import random
import tempfile
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tmweave.functions import text as fx
from tmweave.operators import change, extract, markup, reuse, segments
from tmweave.operators.phases import Phases
from tmweave.sources import folders, tree
from tmweave.streaming import versions


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()[0]


def blocks(spark, pages, **how):
    got = defaultdict(list)
    for r in markup.html_blocks(table(spark, list(enumerate(pages)), "path int, content string"), **how).orderBy("path", "pos").collect():
        got[r.path].append((r.tag, r.string))
    return [got[i] for i in range(len(pages))]


def test_html_blocks(spark):
    pages = {
        "<ul><li>a<ul><li>b</li></ul></li><li>c</li></ul>": [("li", "b"), ("li", "c")],
        "<P>Up <b>x</b></P><p>one<p>two<div>no</div>": [("p", "Up <b>x</b>"), ("p", "one"), ("p", "two")],
        "<ul><li>a<li>b<ul><li>c<li>d</ul><li>e</ul>": [("li", "a"), ("li", "c"), ("li", "d"), ("li", "e")],
        "plain <b>text</b> only": [("", "plain <b>text</b> only")],
        "<div lang='fr'><p>non</p><span lang=\"en\">yes <p>it</p></span></div><p>ja</p>": [("span", "yes <p>it</p>"), ("p", "ja")],
        "<div><p>a<span lang=de>b</span></p></div>": [],
        "<p></p><p> </p><script>var a='<p>no</p>';</script><!-- <p>c</p> --><h1 title='a>b'>T</h1>": [("h1", "T")],
        "<p>open <a href=\"x>y\">b</a><br>c": [("p", "open <a href=\"x>y\">b</a><br>c")],
        "</li></p>stray<p>x</p></div>": [("p", "x")],
        "": [], "<p": [("", "<p")], "a < b": [("", "a < b")],
    }
    assert blocks(spark, list(pages)) == list(pages.values())
    assert blocks(spark, ["<td>x</td><p>y</p>", None], include=("td",), exclude=("p",)) == [[("td", "x")], []]
    assert markup.html_blocks(table(spark, [], "path int, content string")).count() == 0


def tree_blocks(node):
    """What blocks a well-formed random tree has, by the rules. node: (tag, lang, children), children nodes or texts."""
    out = []

    def written(n):
        return n if isinstance(n, str) else f"<{n[0]}{f' lang={n[1]}' if n[1] else ''}>{''.join(map(written, n[2]))}</{n[0]}>"

    def walk(n, banned):
        tag, lang, children = n
        could = tag in markup.EXTRACTED and not banned
        if lang == "en":
            out.append((tag, "".join(map(written, children))))
            return True, True
        banned = banned or lang is not None
        some, text = False, False
        mark = len(out)
        for c in children:
            if isinstance(c, str):
                text = text or bool(c.strip())
            else:
                hit, holds = walk(c, banned)
                some, text = some or hit, text or (holds and not hit)
        if could and lang is None and text and not some:
            out[mark:] = [(tag, "".join(map(written, children)))]
            return True, text
        return some or lang is not None, text

    walk(("", None, node), False)
    return out, "".join(map(written, node))


def test_html_blocks_random(spark):
    rnd = random.Random(8)

    def node(depth):
        # a paragraph ends at any block, so only inline elements stand in one; lists are left to the cases above
        tag = rnd.choice(["div", "h1", "b", "i", "span", "label", "div", "td"])
        return (tag, rnd.choice([None] * 8 + ["en", "fr"]), children(depth - 1))

    def children(depth):
        return [node(depth) if depth and rnd.random() < 0.6 else rnd.choice(["text", " ", "x &amp; y", ""]) for _ in range(rnd.randint(0, 4))]

    want, pages = zip(*(tree_blocks(children(4)) for _ in range(300)), strict=True)
    assert blocks(spark, pages) == [list(w) for w in want]


def test_xml_attributes(spark):
    get = lambda s, n: one(spark, markup.attr(F.lit(s), n))
    assert get(" a='1' id=\"x &amp; y\" b=id", "id") == "x & y" and get(" data-id='1'", "id") is None and get(" x=' id=2' id = 3", "id") == "3" and get("", "id") is None


def test_xliff_odd_files(spark):
    files = ["<xliff version='1.2'><file original='f'><body><trans-unit id='a'><target/><source>s</source></trans-unit><trans-unit id='b'><note>n</note></trans-unit></body></file></xliff>", "", None, "no markup", "<xliff><file><body><group id='g'><group id='h'><trans-unit id='c'><source>q<g id='1'>w</g></source>"]
    df = table(spark, list(enumerate(files)), "path int, content string")
    got = {(r.path, r.key): r for r in markup.xliff(df).collect()}
    assert set(got) == {(0, "a"), (4, "c")} and got[0, "a"].target == "" and got[4, "c"].source == "q<g id='1'>w</g>" and got[4, "c"].hint.startswith("group-id:g group-id:h unit-id:c")
    assert markup.ts_units(df).count() == 0


def test_tree(spark):
    root = tempfile.mkdtemp(prefix="spark-tree ")
    files = {"a/b/c d+e.txt": "é\r\nx".encode(), "a/x.po": b"\xff\xfeh\x00i\x00", "a/CVS/y.txt": b"no", "lat.xml": b'<?xml version="1.0" encoding="iso-8859-1"?>\xe9', "bad.txt": b"\xff\xe9x", "a/be.txt": "﻿ab\U0001f916".encode("utf-16-be"), "le32.txt": "﻿ab\U0001f916".encode("utf-32-le"), "bad16.txt": b"\xfe\xff\xd8\x00\x00", "koi.xml": b"<?xml version='1.0' encoding='KOI8-R'?>x", "empty.txt": b""}
    for p, b in files.items():
        os.makedirs(os.path.dirname(f"{root}/{p}"), exist_ok=True)
        with open(f"{root}/{p}", "wb") as f:
            f.write(b)
    got = {r.path: (r.encoding, r.rejected, r.content) for r in tree.decoded(tree.files(spark, root, prefix="p/")).collect()}
    assert got == {
        "p/a/b/c d+e.txt": ("UTF-8", None, "é\nx"), "p/a/x.po": ("UTF-16LE", None, "hi"), "p/lat.xml": ("ISO-8859-1", None, '<?xml version="1.0" encoding="iso-8859-1"?>é'), "p/bad.txt": ("UTF-8", "not UTF-8", None),
        "p/a/be.txt": ("UTF-16BE", None, "ab\U0001f916"), "p/le32.txt": ("UTF-32LE", None, "ab\U0001f916"), "p/bad16.txt": ("UTF-16BE", "not UTF-16BE", None), "p/koi.xml": ("KOI8-R", "unknown encoding KOI8-R", None),
    }
    names = lambda **rules: {r.path for r in tree.listed(spark, root, **rules).collect()}
    assert names(match=[r"\.txt$"], exclude=["^bad"], dir_exclude=[*tree.VCS, "^b$"]) == {"a/be.txt", "le32.txt"}
    assert names(dir_match=["^a$"]) == set(files) - {"a/b/c d+e.txt", "a/CVS/y.txt", "empty.txt"} and names(match=["^a/b/"], dir_exclude=[]) == {"a/b/c d+e.txt"}


@pytest.mark.parametrize(
    "translation,source,wanted,want",
    [
        ('Klick <a href="1">', 'Click <a href="1">', 'Click <a href="2">', 'Klick <a href="2">'), ("<i>Y</i> <b>X</b>", "<b>x</b> <i>y</i>", "<u>x</u> <em>y</em>", "<em>Y</em> <u>X</u>"),
        ("<b>a</b><b>c</b>", "<b>a</b><b>c</b>", "<b>a</b><i>c</i>", "<b>a</b><i>c</i>"), ("<x>", "<b>", "<i>", None), ("a", "a", "<b>", None), ("plain", "text", "other", "plain"), ("", "<b>", "<i>", ""), ("<b>only", "<b>x</b>", "<i>x</i>", "<i>only"),
    ],
)
def test_substitute_tags(spark, translation, source, wanted, want):
    assert one(spark, fx.substitute_tags(F.lit(translation), F.lit(source), F.lit(wanted))) == want


def test_near_made(spark):
    made = lambda s, f, t: one(spark, fx.near_made(F.lit(s), F.lit(f), F.lit(t), F.lit("fr")))
    assert made('Click <a href="2">Here</a> Now!', 'click <a href="1">here</a> now', 'ici <a href="1">cliquez</a> vite').endswith("!")
    assert made('<p id="2">Go <b>on</b></p>', '<p id="1">Go <i>on</i></p>', '<p id="1"><i>Va</i> donc</p>') == '<p id="2"><b>Va</b> donc</p>'
    assert made("Go", "<b>Go</b>", "<b>Va</b>") == "Va" and made("<b>Go</b>", "Go", "Va") == "<b>Va</b>"


def test_keyed_table(spark):
    t = versions.KeyedTable(spark, folders.new_path(spark, "keyed"), "k bigint, l string, usn bigint, v string", ["k", "l"], ["usn"], 4)
    assert t.read().count() == 0
    rnd, best = random.Random(1), {}
    batches = [[(rnd.choice([None, *range(20)]), rnd.choice(["a", None]), b * 1000 + i, f"{b}.{i}") for i in range(30)] for b in range(4)]
    batches.append([(1, "a", -5, "late")])
    rows = lambda b: table(spark, b, t.schema)
    for n, b in enumerate(batches):
        for k, lang, usn, v in b:
            if best.get((k, lang), (-10**9, ""))[0] < usn:
                best[k, lang] = (usn, v)
        t.merge(rows(b), n)
        t.merge(rows([(7, "a", 10**9, "again")]), n)  # the batch's number was there before
        assert {(r.k, r.l): (r.usn, r.v) for r in t.read().collect()} == best
    # a batch that failed before its version was written leaves readers where they were, and writes its folder anew
    t.newest(rows([(50, "x", 1, "half")])).write.parquet(f"{t.folder}/data/batch=5/bucket=0")
    assert {(r.k, r.l): (r.usn, r.v) for r in t.read().collect()} == best
    t.merge(rows([(51, "y", 1, "whole")]), 5)
    best[51, "y"] = (1, "whole")
    assert {(r.k, r.l): (r.usn, r.v) for r in t.read().collect()} == best
    files = len(t.read().inputFiles())
    t.clean()
    assert {(r.k, r.l): (r.usn, r.v) for r in t.read().collect()} == best and files <= 4 and t.version()[0] == 5
    t.merge(rows([]), 6)
    assert t.version()[0] == 6 and t.read().count() == len(best)


def test_memory_moves(spark):
    """Each batch of targets is looked up in the memory as it is then."""
    came = folders.new_path(spark, "cand")
    row = lambda i, s, t: (i, "de", s, "n", "p", "", 0, t, 0, None)
    schema = "item_id bigint, language string, source string, namespace string, path string, context string, orphaned int, target string, fuzzy int, comment string"
    asked, out, progress = (folders.new_path(spark, x) for x in ("asked", "out", "progress"))
    target = "item_id bigint, language string, source string, namespace string, path string, context string"
    look = lambda: versions.reuse_as_it_moves(spark.readStream.schema(target).parquet(asked), lambda: spark.read.schema(schema).parquet(came), out, progress)
    table(spark, [row(1, "a", "A")], schema).write.parquet(came)
    table(spark, [(11, "de", "a", "n", "q", ""), (12, "de", "b", "n", "q", "")], target).write.parquet(asked)
    assert {(r.item_id, r.target) for r in look().collect()} == {(11, "A")}
    table(spark, [row(2, "b", "B"), row(3, "a", "A2")], schema).write.mode("append").parquet(came)
    table(spark, [(13, "de", "a", "n", "q", ""), (14, "de", "b", "n", "q", "")], target).write.mode("append").parquet(asked)
    assert {(r.item_id, r.target) for r in look().collect()} == {(11, "A"), (14, "B")}


@pytest.mark.parametrize("how", [{}, {"separator": segments.LINES}, {"sentences": True}, {"separator": r"\|", "sentences": True}])
def test_segments_lose_nothing(spark, how):
    rnd = random.Random(9)
    texts = [None, "", "\n", "\n\n", "a\n", "\na", "a. b! c", *("".join(rnd.choices("ab.! \n|", k=rnd.randint(1, 40))) for _ in range(300))]
    units = table(spark, [(i, t) for i, t in enumerate(texts)], "key int, string string")
    cut = segments.cut(units, **how)
    assert {r.key: r.string for r in segments.join(cut.repartition(5), ["key"]).collect()} == dict(enumerate(texts))
    for r in cut.groupBy("key").agg(F.collect_set("segment_key").alias("s"), F.count("*").alias("n")).collect():
        assert set(r.s) == ({str(r.key)} if r.n == 1 else {f"{r.key}:{i + 1}" for i in range(r.n)})


def test_disambiguate_random(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice("pq"), i, rnd.choice("xy"), rnd.choice([None, "", "c", "c.1"]), rnd.choice([None, "k", "c"]), rnd.choice([None, "h"])) for i in range(600)]
    used, want = defaultdict(set), {}
    for path, pos, string, context, key, hint in rows:
        mine, c = used[path, string], context or ""
        for other in (key, hint):
            if c in mine and other:
                c = other
        base, n = c or "context", 0
        while c in mine:
            n += 1
            c = f"{base}.{n}"
        mine.add(c)
        want[path, pos] = c
    schema = "path string, pos int, string string, context string, key string, hint string"
    df = table(spark, rows, schema)
    assert {(r.path, r.pos): r.context for r in extract.disambiguate(df.repartition(5)).collect()} == want
    many = spark.range(200_000).select(F.lit("p").alias("path"), F.col("id").cast("int").alias("pos"), F.lit("same").alias("string"), *(F.lit(None).cast("string").alias(c) for c in ("context", "key", "hint")))
    got = extract.disambiguate(many)
    assert got.agg(F.count_distinct("context")).first()[0] == 200_000 and got.where("pos = 199999").first().context == "context.199999"


def test_upsert_again(spark, sf):
    from tmweave.sources import memory

    tm = memory.derived(spark, sf)
    tm["items"] = tm["items"].withColumn("hint", F.lit(None).cast("string"))
    units = table(spark, [("n", "j", "p1", 1, "one", None, "h"), ("n", "j", "p1", 2, "one", "", "last"), ("n", None, None, 3, "two", "c", None), ("n", "j", "p2", 4, "one", None, "")], "namespace string, job string, path string, pos int, string string, context string, hint string")
    once = change.upsert_memory(tm, units)
    new = {k: [r for r in v.where("change <> 'none'").collect()] for k, v in once.items()}
    assert [len(new[k]) for k in ("files", "strings", "items")] == [3, 2, 3] and Counter(r.hint for r in new["items"]) == Counter(["last", None, None])
    again = change.upsert_memory({k: v.drop("change") for k, v in once.items()}, units)
    assert all(v.where("change <> 'none'").count() == 0 for v in again.values())
    ids = once["items"].select("item_id").collect()
    assert len({r.item_id for r in ids}) == len(ids)


def test_phases(spark):
    files = table(spark, [("a.txt", "x"), ("b.po", "y"), (None, "z")], "path string, content string")
    p = Phases().on("can_process_source_file", lambda f: F.col("path").endswith(".txt")).on("can_process_source_file", lambda f: F.lit(None).cast("boolean"))
    assert [r.path for r in p.filter(files, "can_process_source_file").collect()] == ["a.txt", None]
    orphans = lambda p: {r.path for r in files.where(p.votes(files, "is_file_orphaned")).collect()}
    assert orphans(Phases()) == set() and orphans(Phases().on("is_file_orphaned", lambda f: F.col("path").endswith(".po"))) == {"b.po"}
    p.on("after_load_file", lambda c, _: F.concat(c, F.lit("!"))).on("after_load_file", lambda c, _: F.upper(c)).on("add_hint", lambda d: F.array(F.lit(" "), F.col("content"))).on("add_hint", lambda d: F.array(F.lit(None).cast("string"), F.lit("end")))
    assert [r.content for r in p.content(files, "after_load_file").collect()] == ["X!", "Y!", "Z!"] and p.hints(files).first().hints == ["x", "end"]
    p.on("rewrite_parsed_ts_file_item", lambda d: d.withColumn("content", F.lit("q")).withColumn("more", F.lit(1))).on("rewrite_parsed_ts_file_item", lambda d: d.where("path is not null"))
    assert [tuple(r) for r in p.rows(files).collect()] == [("a.txt", "q"), ("b.po", "q")]
    with pytest.raises(ValueError):
        p.on("no_phase", lambda: None)
    units = table(spark, [("f", "k", "A {x}\n\nB"), ("f", "l", " "), ("f", "m", None)], "path string, key string, source string").withColumns({"context": F.lit(""), "hint": F.lit("")})
    half = Phases().on("segment_source", lambda: (segments.PARAGRAPHS, False)).on("get_translation", lambda rows: rows.where("source = 'B'").select("path", "segment_key", "language", F.lit("b").alias("target"), F.lit(1).alias("fuzzy")))
    memory = lambda rows: rows.where("source LIKE 'A%'").select("path", "segment_key", "language", F.lower("source").alias("target"), F.lit(0).alias("fuzzy"))
    got = {r.key: (r.target, r.fuzzy) for r in half.translate(units, table(spark, [("de",)], "language string"), memory).collect()}
    assert got["k"] == ("a {x}\n\nb", 1) and got["l"] == (" ", 0) and got["m"][0] is None


def test_resolve_blocks(spark):
    """A skipped string and a conflict end the chain; other languages are asked past their own."""
    tm = {
        "files": table(spark, [(1, "n", "p", 0)], "file_id bigint, namespace string, path string, orphaned int"),
        "strings": table(spark, [(1, "s1", None, 0), (2, "s2", None, 1), (3, "s3", None, 0), (4, "S1", "c", 0)], "string_id bigint, string string, context string, skip int"),
        "items": table(spark, [(11, 1, 1, 0), (12, 1, 2, 0), (13, 1, 3, 0), (14, 1, 4, 0), (15, 1, 1, 0), (16, 1, 1, 0)], "item_id bigint, file_id bigint, string_id bigint, orphaned int"),
        "langs": table(spark, [("fr",), ("de",)], "language string"),
        "translations": table(spark, [(11, "fr", "u", None, 0), (15, "fr", "v", None, 0), (11, "de", "w", None, 0), (13, "it", "i", None, 0), (12, "fr", "no", None, 0)], "item_id bigint, language string, string string, comment string, fuzzy int"),
    }
    got = {(r.item_id, r.language): (r.target, r.provenance) for r in reuse.resolve(tm, [("fr", ["de", "it"], True), ("de", ["fr"], False)]).collect()}
    assert got[11, "fr"] == ("u", "exact") and got[12, "fr"] == (None, "skip") and got[16, "fr"] == (None, "conflict") and got[16, "de"] == ("w", "reuse")
    assert got[13, "fr"] == ("i", "similar") and got[13, "de"] == (None, None) and got[14, "de"] == ("W", "near") and got[14, "fr"] == ("W", "similar")
