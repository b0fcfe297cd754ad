"""Markup as rows of tokens: elements at any depth, whatever the order of attributes and children.

A file is cut into tokens that make it up again, so what is read by places in the stream can be rebuilt by them. Depth is a running sum over a file's
tokens; an element ends at the next closing tag of its name on its level. Whole files are dealt over partitions of bounded size before they are cut (spread),
so tokens are never shuffled; all windows are over one file's tokens in order, and XML's all in the same one, so a partition is sorted once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tmweave.functions import text as fx

_TAG = r"""</?[A-Za-z_](?:[^'"<>]++|"[^"]*+"|'[^']*+')*+>"""
#: Tokens: comments, CDATA, declarations and instructions, tags, texts; whatever is none of these is text, character by character.
XML = rf"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<![^<>\[]*(?:\[[^\]]*\])?[^<>]*>|{_TAG}|[^<]+|<"
#: The same of HTML, where scripts and styles are one token.
HTML = rf"(?is)<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>|<![^<>]*>|<\?[^<>]*>|{_TAG}|[^<]+|<"
#: Elements of HTML without an end.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
#: Elements that end an open paragraph.
BLOCK = (
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 h7 header hgroup hr html li main menu nav ol p pre search section summary "
    "table tbody td tfoot th thead tr ul".split()
)
#: Elements whose end may be left out, those that end them, and the containers in which only the same level counts.
IMPLIED = [(("p",), (*BLOCK,), ()), (("option",), ("option", "optgroup", "select"), ()), (("li",), ("li",), ("ul", "ol", "menu", "dir")), (("dt", "dd"), ("dt", "dd"), ("dl",))]
#: Elements of HTML that hold translatable text, and '' for a page without any of them.
EXTRACTED = ("h1", "h2", "h3", "h4", "h5", "h6", "h7", "p", "li", "dt", "dd", "label", "option", "")
#: Ancestors of a token that are kept, from the root.
LEVELS = 16

ORDER = ["pos", "sub"]
#: Characters of content in a partition of files, about; its tokens take some twenty times as much memory.
SPREAD = 500_000
#: Characters that a file counts for beside its content: one without any has two tokens as well.
EACH = 20


def spread(files: DataFrame, size: int = SPREAD, content: str = "content") -> DataFrame:
    """Files (path, content) dealt over as many partitions by path as their content and number need, a file whole. It counts the content's length first, so that a partition doesn't grow with the input; no task sorts more than its partition's tokens."""
    total = files.agg(F.sum(F.coalesce(F.length(content), F.lit(0)) + EACH)).first()[0] or 0
    return files.repartition(-(-total // size) or 1, "path")


def tokens(files: DataFrame, pattern: str = XML, bounds: bool = False) -> DataFrame:
    """path, pos, sub (0), raw, kind (open, close, empty, text, cdata, other), tag (# of what isn't one), attrs of each token of files (path, content). HTML's tags are in lower case. bounds: an element named '' around each file, null ones too."""
    html = pattern == HTML
    found, ends = F.regexp_extract_all("content", F.lit(pattern), F.lit(0)), F.array(F.lit(""))
    if bounds:  # no token is empty
        rows = spread(files).select("path", F.posexplode(F.concat(ends, F.coalesce(found, F.array().cast("array<string>")), ends)).alias("pos", "raw")).withColumn("pos", F.col("pos") - 1)
    else:
        rows = spread(files).select("path", F.posexplode(found).alias("pos", "raw"))
    raw, second = F.col("raw"), F.substring("raw", 2, 1)
    # of the pattern's tokens only tags, comments, CDATA, declarations and instructions begin with < and go on
    rows = rows.withColumn("_name", F.when(raw.startswith("<") & (F.length(raw) > 1) & ~second.isin("!", "?"), F.regexp_extract("raw", r"^</?([^\s/<>]+)", 1)))
    name = F.col("_name")
    tag = F.lower(name) if html else name
    empty = raw.endswith("/>") | (tag.isin(*VOID) if html else F.lit(False))
    whole = F.lower(second).eqNullSafe("s") & F.contains(raw, F.lit("</")) & raw.rlike(r"(?is)^<(script|style)\b.*</(script|style)\s*>$") if html else F.lit(False)
    edge = F.when(raw == "", F.when(F.col("pos") < 0, "open").otherwise("close")) if bounds else F
    kind = edge.when(~raw.startswith("<") | (F.length(raw) == 1), "text").when(raw.startswith("<![CDATA["), "cdata").when(second.isin("!", "?") | whole, "other").when(second == "/", "close").when(empty, "empty").otherwise("open")
    rows = rows.withColumn("kind", kind).withColumn("tag", F.when(F.col("kind").isin("open", "close", "empty"), F.coalesce(tag, F.lit(""))).otherwise("#"))
    own = F.length("_name") + F.when(raw.endswith("/>"), 3).otherwise(2)
    attrs = F.when(F.col("kind").isin("open", "empty") & (raw != ""), raw.substr(F.length("_name") + 2, F.length(raw) - own)).otherwise("")
    return rows.select("path", "pos", F.lit(0).alias("sub"), "raw", "kind", "tag", attrs.alias("attrs"))


def attr(attrs: Column, name: str) -> Column:
    """An attribute's value, in either kind of quotes or none, unescaped; null if it isn't there. Names count in upper and lower case."""
    form = rf"""(?is)^(?:[^'"]|"[^"]*"|'[^']*')*?\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    part = lambda n: F.regexp_extract(attrs, form, n)
    return F.when(attrs.rlike(form), fx.xml_unescape(F.concat(part(1), part(2), part(3))))


def text_of(inner: Column) -> Column:
    """The text of inner markup: without tags and comments, CDATA as it stands, entities decoded."""
    pieces = F.regexp_extract_all(inner, F.lit(XML), F.lit(0))
    plain = F.transform(pieces, lambda p: F.when(p.startswith("<![CDATA["), F.regexp_extract(p, r"(?s)^<!\[CDATA\[(.*)\]\]>$", 1)).when(p.rlike(r"(?s)^<.*>$"), "").otherwise(fx.xml_unescape(p)))
    return F.array_join(plain, "")


def in_order(*by: str):
    return Window.partitionBy("path", *by).orderBy(*ORDER)


def so_far(c: Column, w=None, before: bool = False) -> Column:
    """Running sum of a condition or number, with or without this row's own."""
    w = (w or in_order()).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    return F.coalesce(F.sum(c.cast("long")).over(w), F.lit(0))


def since(count: str, c: Column) -> Column:
    """What a running number has grown by since the last row for which c holds, or the first."""
    return F.col(count) - F.coalesce(F.last(F.when(c, F.col(count)), ignorenulls=True).over(in_order().rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0))


def opens() -> Column:
    return F.col("kind") == "open"


def closes() -> Column:
    return F.col("kind") == "close"


# XML ----------------------------------------------------------------------------------


def placed(toks: DataFrame, names: tuple[str, ...], levels: int = LEVELS) -> DataFrame:
    """Adds depth (open elements around a token; around its element for tags) and, for opening and empty tags, up (places and tags of those, from the root, levels at most; a tag not among names is ''). Well-formed XML."""
    step = F.when(opens(), 1).when(closes(), -1).otherwise(0)
    rows = toks.withColumn("depth", so_far(step) - opens().cast("int"))
    w = in_order().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # the last element opened on each level, as one number of its place and name: places grow
    room = len(names) + 1
    known = F.array(*map(F.lit, names))
    here = F.col("pos").cast("long") * room + F.array_position(known, F.col("tag"))
    rows = rows.withColumn("_here", F.when(opens(), here))
    at = [F.max(F.when(F.col("depth") == i, F.col("_here"))).over(w).alias(f"_at{i}") for i in range(levels)]
    rows = rows.select(*toks.columns, "depth", *at)
    held = F.slice(F.array(*(f"_at{i}" for i in range(levels))), F.lit(1), F.greatest(F.least(F.col("depth"), F.lit(levels)), F.lit(0)).cast("int"))
    spelt = F.array(F.lit(""), *map(F.lit, names))
    up = F.transform(held, lambda x: F.struct((x / room).cast("int").alias("pos"), F.get(spelt, (x % room).cast("int")).alias("tag")))
    return rows.select(*toks.columns, "depth", F.when(F.col("kind").isin("open", "empty"), up).alias("up"))


def within(rows: DataFrame, wanted: Column, name: str = "inside") -> DataFrame:
    """Adds start (wanted tags, opening or empty) and inside: whether a token stands in the last element wanted. The element ends where its depth comes again, which only a closing tag can bring about."""
    rows = rows.withColumn("start", F.coalesce(F.col("kind").isin("open", "empty") & wanted, F.lit(False)))
    upto = in_order().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_at", F.last(F.when(F.col("start"), F.when(opens(), F.col("depth")).otherwise(F.lit(1 << 30))), ignorenulls=True).over(upto))
    on = F.last(F.when(F.col("start"), True).when(F.col("depth") <= F.col("_at"), False), ignorenulls=True).over(upto)
    return rows.withColumn(name, ~F.col("start") & F.coalesce(on, F.lit(False))).drop("_at")


def elements(rows: DataFrame, wanted: Column, also: Column | None = None) -> DataFrame:
    """path, pos, tag, attrs, depth, up, inner of the elements wanted (a condition on their opening tags, of which none may stand inside another). also: a condition on opening tags outside of those, which come too, with a null inner."""
    rows = within(rows, wanted)
    other = ~F.col("start") & ~F.col("inside") & opens() & also if also is not None else F.lit(False)
    rows = rows.withColumn("other", F.coalesce(other, F.lit(False))).withColumn("nth", so_far(F.col("start") | F.col("other"))).where("start OR other OR inside")
    piece = F.array_sort(F.collect_list(F.when(F.col("inside"), F.struct("pos", "raw"))))
    own = lambda c: F.max(F.when(~F.col("inside"), F.col(c))).alias(c)
    got = rows.groupBy("path", "nth").agg(own("pos"), own("tag"), own("attrs"), own("depth"), own("up"), own("start"), piece.alias("p"))
    return got.select("path", "pos", "tag", "attrs", "depth", "up", F.when(F.col("start"), joined("p")).alias("inner"))


def parent(n: int = 1) -> Column:
    """The n-th open element around, from the inside: place and tag; null beyond."""
    return F.try_element_at("up", F.lit(-n))


def nearest(owner: Callable[[Column], Column]) -> Column:
    """Place of the nearest element around for which owner (of the struct of place and tag) holds."""
    return F.try_element_at(F.filter("up", owner), F.lit(-1))["pos"]


def first_of(tag: str, value: Column) -> Column:
    """In groups by owner: the value of the first child of a tag."""
    return F.min_by(F.when(F.col("tag") == tag, value), F.when(F.col("tag") == tag, F.col("pos")))


UNITS = ("trans-unit", "unit", "segment")


def xliff(files: DataFrame) -> DataFrame:
    """Units of XLIFF 1 and 2 files (path, content): path, pos, key, source, target (inner markup; null without a target), approved, notes, hint.

    A unit of version 2 has one row for each segment. Attributes and children may stand in any order; alternatives (alt-trans) are no units. The
    hint: file, groups and unit (file-original:, group-id:, unit-id:), then their notes, each a paragraph. Files that aren't well-formed give rows up to where they break.

    Nothing is joined: a unit and what is around it meet in groups and windows of their file, which stays in its partition.
    """
    is_unit = lambda x: x["tag"].isin(*UNITS)
    named = lambda x: x["tag"].isin("file", "group", "trans-unit", "unit")
    is_text = F.col("tag").isin("source", "target") & is_unit(parent())
    is_note = F.col("tag").isin("note") & (named(parent()) | (parent()["tag"].isin("header", "notes") & named(parent(2))))
    found = elements(placed(tokens(files), ("header", "notes", "file", "group", *UNITS)), is_text | is_note, F.col("tag").isin("file", "group", *UNITS))
    owner, note = F.col("inner").isNull(), F.col("tag") == "note"
    # by owner: what it is, its notes, and the source and target of a unit
    at = F.when(owner, F.col("pos")).when(note, nearest(named)).otherwise(nearest(is_unit))
    owners = found.groupBy("path", at.alias("at")).agg(
        F.max(F.when(owner, F.col("tag"))).alias("what"), F.max(F.when(owner, F.col("attrs"))).alias("attrs"), first_of("source", F.col("inner")).alias("source"), first_of("target", F.col("inner")).alias("target"),
        F.max(F.when(F.col("tag").isin("source", "target"), F.col("up"))).alias("up"), F.array_sort(F.collect_list(F.when(note, F.struct("pos", text_of(F.col("inner")).alias("note"))))).alias("notes"),
    )
    # a unit goes to all that is around it, and takes its own texts to itself only
    around = F.transform("up", lambda o: F.struct(o["pos"].alias("at"), F.col("at").alias("pos")))
    places = F.concat(F.array(F.struct("at", F.lit(None).cast("int").alias("pos"))), F.when(F.col("source").isNotNull(), around).otherwise(F.array().cast("array<struct<at:int,pos:int>>")))
    rows = owners.withColumn("_o", F.explode(places)).withColumn("_own", F.col("_o.pos").isNull())
    only = lambda c, when: F.when(when, F.col(c)).alias(c)
    itself = F.col("_o.pos") == F.col("_o.at")
    rows = rows.select("path", F.col("_o.at").alias("at"), F.col("_o.pos").alias("pos"), F.when(F.col("_own") & F.col("what").isNotNull(), F.struct("what", "attrs", "notes")).alias("_own"), only("source", itself), only("target", itself))
    rows = rows.withColumn("_own", F.first("_own", ignorenulls=True).over(Window.partitionBy("path", "at"))).where("pos IS NOT NULL AND _own IS NOT NULL").select("path", "at", "pos", "source", "target", "_own.*")
    kind = F.when(F.col("what").isin("trans-unit", "unit"), "unit").otherwise(F.col("what"))
    name = F.when(kind == "file", attr(F.col("attrs"), "original")).when(kind.isin("group", "unit"), attr(F.col("attrs"), "id"))
    label = F.when(F.coalesce(name, F.lit("")) != "", F.concat(kind, F.when(kind == "file", "-original:").otherwise("-id:"), name))
    said = F.transform("notes", lambda n: F.concat(F.initcap(kind), F.lit(" note: "), n["note"]))
    unit = F.when(kind == "unit", F.col("at"))
    out = rows.groupBy("path", "pos").agg(
        F.array_sort(F.collect_list(F.struct("at", label.alias("label"), said.alias("said")))).alias("a"), F.max_by("attrs", unit).alias("unit_attrs"), F.max_by("notes", unit).alias("unit_notes"),
        F.max(F.when(F.col("at") == F.col("pos"), F.col("attrs"))).alias("own_attrs"), F.max("source").alias("source"), F.max("target").alias("target"),
    )
    tags = F.array_join(F.filter(F.transform("a", lambda x: x["label"]), lambda x: x.isNotNull()), " ")
    hint = F.array_join(F.concat(F.array(tags), F.flatten(F.transform("a", lambda x: x["said"]))), "\n\n")
    notes = F.array_join(F.transform("unit_notes", lambda n: n["note"]), "\n")
    return out.select("path", "pos", attr(F.col("own_attrs"), "id").alias("key"), "source", "target", attr(F.col("unit_attrs"), "approved").alias("approved"), F.coalesce(notes, F.lit("")).alias("notes"), hint.alias("hint"))


def xliff_source(files: DataFrame) -> DataFrame:
    """Source units: path, pos, key, string, hint."""
    return xliff(files).where("source <> ''").select("path", "pos", "key", F.col("source").alias("string"), "hint")


def xliff_import(files: DataFrame) -> DataFrame:
    """Translated or commented units of exchange files whose id is that of their source: path, pos, id, source, target, fuzzy, comment. An empty target isn't fuzzy."""
    rows = xliff(files).select("path", "pos", F.col("key").alias("id"), text_of(F.col("source")).alias("source"), F.coalesce(text_of(F.col("target")), F.lit("")).alias("target"), "approved", F.col("notes").alias("comment"))
    rows = rows.where((F.col("target") != "") | (F.col("comment") != ""))
    fuzzy = ((F.col("approved") == "no") & (F.col("target") != "")).cast("int")
    return rows.withColumn("fuzzy", F.coalesce(fuzzy, F.lit(0))).drop("approved")


def ts_units(files: DataFrame) -> DataFrame:
    """Messages of Qt TS files: path, pos, key, context, source, translation, hint.

    The context is the group's name and the message's comment on a line each, the key context and source, the hint the extra comment. Places and other children don't matter; messages without a source go.
    """
    part = F.col("tag").isin("source", "translation", "comment", "extracomment") & (parent()["tag"] == "message")
    found = elements(placed(tokens(files), ("message", "context")), part | (F.col("tag") == "name") & (parent()["tag"] == "context"))
    group = F.when(F.col("tag") == "name", parent()["pos"]).when(parent(2)["tag"] == "context", parent(2)["pos"])
    message = F.when(F.col("tag") != "name", nearest(lambda x: x["tag"] == "message"))
    said = lambda t: first_of(t, text_of(F.col("inner"))).alias(t)
    rows = found.groupBy("path", message.alias("pos"), group.alias("group")).agg(*(said(t) for t in ("name", "source", "translation", "comment", "extracomment")))
    # a group's name may stand behind its messages; messages without a group have none
    name = F.first("name", ignorenulls=True).over(Window.partitionBy("path", "group"))
    rows = rows.withColumn("name", F.when(F.col("group").isNotNull(), name)).where("pos IS NOT NULL AND source <> ''").withColumn("context", F.concat_ws("\n", "name", "comment"))
    return rows.select("path", "pos", F.concat_ws(":", "context", "source").alias("key"), "context", "source", F.coalesce("translation", F.lit("")).alias("translation"), F.coalesce("extracomment", F.lit("")).alias("hint"))


# HTML ---------------------------------------------------------------------------------


def with_ends(toks: DataFrame) -> DataFrame:
    """Adds the closing tags that HTML lets one leave out, as rows with sub = -1 in front of what ends their element, and the whole page as an element named ''."""
    for tags, enders, containers in IMPLIED:
        is_it = F.col("tag").isin(*tags)
        change = F.when(F.col("tag").isin(*containers), F.when(opens(), 1).when(closes(), -1)).otherwise(0) if containers else F.lit(0)
        level = so_far(change) - F.when(F.col("tag").isin(*containers) & opens(), 1).otherwise(0) if containers else F.lit(0)
        # a container's own end stands on the level of what it holds
        rows = toks.withColumn("level", level + (F.when(F.col("tag").isin(*containers) & closes(), 1).otherwise(0) if containers else F.lit(0)))
        ends = F.col("tag").isin(*enders, *tags) & F.col("kind").isin("open", "close", "empty") | (F.col("tag").isin(*containers) & closes() if containers else F.lit(False)) | (F.col("tag") == "") & closes()
        w = in_order("level").rowsBetween(Window.unboundedPreceding, -1)
        last = F.last(F.when(ends, F.struct("kind", "tag")), ignorenulls=True).over(w)
        rows = rows.withColumn("before", F.when(ends, last)).drop("level")
        due = F.col("before.tag").isin(*tags) & (F.col("before.kind") == "open") & ~(is_it & closes())
        close = F.struct(F.lit(-1).alias("sub"), F.lit("").alias("raw"), F.lit("close").alias("kind"), F.col("before.tag").alias("tag"), F.lit("").alias("attrs"))
        own = F.struct("sub", "raw", "kind", "tag", "attrs")
        toks = rows.select("path", "pos", F.explode(F.when(due, F.array(close, own)).otherwise(F.array(own))).alias("t")).select("path", "pos", "t.*")
    return toks


def html_blocks(pages: DataFrame, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), language: str = "en") -> DataFrame:
    """Translatable blocks of pages (path, content): path, pos (the how-manieth), tag, string (inner markup without comments, scripts and styles).

    A block is an element of the list (EXTRACTED, with include, without exclude) that holds text and neither another such element nor one with a lang attribute. An element whose lang is language is a block,
    whatever its name; nothing inside elements of other languages is, but for such ones. A page without any block is one itself (tag '').
    Tags are matched by name and level, so an element left open harms no other; ends that HTML lets one leave out are put in (with_ends).
    """
    rows = html_rows(pages, include, exclude, language).where("nth > 0")
    shown = F.when(F.col("inside") & (F.col("kind") != "other"), F.struct("pos", "raw"))
    out = rows.groupBy("path", "nth").agg(F.max(F.when(F.col("unit"), F.col("tag"))).alias("tag"), F.array_sort(F.collect_list(shown)).alias("p"))
    return out.select("path", (F.col("nth") - 1).cast("int").alias("pos"), "tag", joined("p"))


def joined(pieces: str, name: str = "string") -> Column:
    return F.array_join(F.transform(pieces, lambda x: x["raw"]), "").alias(name)


def html_rows(pages: DataFrame, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), language: str = "en") -> DataFrame:
    """Tokens of pages with nth (how many blocks have started), unit (whether a block starts here) and inside (whether it stands in the block)."""
    names = [t for t in (*EXTRACTED, *include) if t not in exclude]
    rows = with_ends(tokens(pages, HTML, bounds=True))
    # an opening tag's end is the next closing tag of its name on its level; levels are counted from the back for ends
    step = F.when(opens(), 1).when(closes(), -1).otherwise(0)
    rows = rows.withColumn("level", so_far(step, in_order("tag")) + closes().cast("int"))
    lang = attr(F.col("attrs"), "lang")
    rows = rows.withColumn("lang", F.when(opens(), F.lower(lang)))
    after = in_order("tag", "level").rowsBetween(1, 1)
    rows = rows.withColumn("end", F.when(opens() & (F.lead("kind").over(in_order("tag", "level")) == "close"), F.first(F.struct("pos", "sub")).over(after)))
    element = opens() & F.col("end").isNotNull()
    rows = rows.withColumn("own", element & F.col("lang").eqNullSafe(language)).withColumn("other", element & F.col("lang").isNotNull() & ~F.col("lang").eqNullSafe(language))
    before = F.lag("kind").over(in_order("tag", "level"))
    start = lambda c: F.lag(c).over(in_order("tag", "level"))
    # closing tags end what their opening tag began
    rows = rows.withColumn("own_end", closes() & (before == "open") & F.coalesce(start("own"), F.lit(False))).withColumn("other_end", closes() & (before == "open") & F.coalesce(start("other"), F.lit(False)))
    rows = rows.withColumn("in_own", so_far(F.col("own").cast("int") - F.col("own_end").cast("int"), before=True)).withColumn("in_other", so_far(F.col("other").cast("int") - F.col("other_end").cast("int"), before=True))
    text = F.col("kind").isin("text", "cdata") & F.col("raw").rlike(r"[^\r\n\t ]")
    rows = rows.withColumn("texts", so_far(text))
    at_end = lambda c: F.first(c).over(after)
    holds = F.coalesce(at_end("texts") > F.col("texts"), F.lit(False))
    could = element & F.col("tag").isin(*names) & (F.col("in_other") == 0) & holds & F.col("lang").isNull()
    rows = rows.withColumn("own", F.col("own") & (F.col("in_own") == 0)).withColumn("could", could & (F.col("in_own") == 0))
    stops = F.col("own") | F.col("could") | (F.col("other") & (F.col("in_own") == 0))
    rows = rows.withColumn("stops", so_far(stops))
    rows = rows.withColumn("unit", F.col("own") | F.col("could") & (at_end("stops") == F.col("stops")))
    rows = rows.withColumn("unit", F.coalesce("unit", F.lit(False))).withColumn("nth", so_far(F.col("unit")))
    rows = rows.withColumn("until", F.when(F.col("nth") > 0, F.first("end").over(in_order("nth"))))
    inside = ~F.col("unit") & F.coalesce(F.struct("pos", "sub") < F.col("until"), F.lit(False)) & (F.col("raw") != "")
    return rows.select("path", "pos", "sub", "raw", "kind", "tag", "attrs", "unit", "nth", inside.alias("inside"))


# rebuilding ---------------------------------------------------------------------------


def pieces(rows: DataFrame, *more: Column) -> DataFrame:
    """path, nth, head, inner, tail of rows with nth, unit and inside: a unit's opening tag, what it holds, and all up to the next unit. Piece 0 is what stands before the first. Their concatenation in order is the file. more: aggregates."""
    some = lambda c, name: F.array_sort(F.collect_list(F.when(c & (F.col("raw") != ""), F.struct("pos", "raw")))).alias(name)
    got = rows.groupBy("path", "nth").agg(some(F.col("unit"), "h"), some(F.col("inside"), "i"), some(~F.col("unit") & ~F.col("inside"), "t"), *more)
    return got.select("path", "nth", joined("h", "head"), joined("i", "inner"), joined("t", "tail"), *got.columns[5:])


def html_pieces(pages: DataFrame, **how) -> DataFrame:
    """Pieces of pages; key is the block's text as html_blocks gives it."""
    shown = F.array_sort(F.collect_list(F.when(F.col("inside") & (F.col("kind") != "other"), F.struct("pos", "raw")))).alias("s")
    out = pieces(html_rows(pages, **how), shown)
    return out.withColumn("key", F.when(F.col("nth") > 0, joined("s", "key"))).drop("s")


def xml_pieces(files: DataFrame, unit: Column, key: Column, names: tuple[str, ...], context: dict[str, Column] | None = None) -> DataFrame:
    """Pieces of XML files. unit: condition on opening tags, of which none may stand inside another; key: a column of the tag's row. names: tags that unit asks its parents for. context: conditions on opening tags; name_attrs is the last such tag's attributes, name_nth how many units have come since."""
    rows = placed(tokens(files), names).withColumn("unit", F.col("kind").isin("open", "empty") & unit)
    w = in_order()
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for name, c in (context or {}).items():
        rows = rows.withColumn(f"{name}_attrs", F.last(F.when(opens() & c, F.col("attrs")), ignorenulls=True).over(upto))
        rows = rows.withColumn(f"{name}_nth", so_far(F.col("unit"), before=True)).withColumn(f"{name}_nth", since(f"{name}_nth", opens() & c))
    rows = rows.withColumn("nth", so_far(F.col("unit"))).withColumn("key", F.when(F.col("unit"), key))
    return pieces(within(rows, F.col("unit")), F.max("key").alias("key"))


def android_pieces(files: DataFrame) -> DataFrame:
    """Android resources: strings by name, plural forms by name:quantity, array items by name:index; what isn't to be translated is no unit. The list's or the string's own attributes may stand in any order and in either kind of quotes."""
    group = F.col("tag").isin("plurals", "string-array")
    free = ~F.coalesce(attr(F.col("attrs"), "translatable"), F.lit("")).eqNullSafe("false")
    unit = (F.col("tag") == "string") & free | (F.col("tag") == "item") & parent()["tag"].isin("plurals", "string-array") & ~F.coalesce(attr(F.col("list_attrs"), "translatable"), F.lit("")).eqNullSafe("false")
    rows = placed(tokens(files), ("plurals", "string-array"))
    upto = in_order().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("list_attrs", F.last(F.when(opens() & group, F.col("attrs")), ignorenulls=True).over(upto))
    rows = rows.withColumn("unit", F.coalesce(F.col("kind").isin("open", "empty") & unit, F.lit(False)))
    rows = rows.withColumn("item_no", so_far(F.col("unit") & (F.col("tag") == "item"), before=True)).withColumn("item_no", since("item_no", opens() & group))
    inner = F.when(F.col("tag") == "string", attr(F.col("attrs"), "name")).otherwise(F.concat_ws(":", attr(F.col("list_attrs"), "name"), F.coalesce(attr(F.col("attrs"), "quantity"), F.col("item_no").cast("string"))))
    rows = rows.withColumn("nth", so_far(F.col("unit"))).withColumn("key", F.when(F.col("unit"), inner))
    return pieces(within(rows, F.col("unit")), F.max("key").alias("key"))


def resx_pieces(files: DataFrame) -> DataFrame:
    """Values of .resx data elements, by name."""
    return xml_pieces(files, (F.col("tag") == "value") & (parent()["tag"] == "data"), attr(F.col("data_attrs"), "name"), ("data",), {"data": F.col("tag") == "data"})


def tag_units(found: DataFrame) -> DataFrame:
    """Units of pieces: path, pos, key, string (its text), raw (as it stands); blank ones are none."""
    rows = found.where("nth > 0").select("path", (F.col("nth") - 1).cast("int").alias("pos"), "key", text_of(F.col("inner")).alias("string"), F.col("inner").alias("raw"))
    return rows.where("trim(string) <> ''")


def rebuilt(found: DataFrame, translations: DataFrame, size: int | None = None) -> DataFrame:
    """Files in each language of translations (path, key, language, target: markup as it is to stand): path, language, part, content. What has no translation stays as it is, byte by byte.

    A file is put together in parts of size pieces, if given, so that no task needs to hold a large one whole; parts in order make it up. Languages are few.
    """
    langs = translations.select("language").distinct()
    # as many rows as units: never for the driver to broadcast
    have = translations.where("target IS NOT NULL").groupBy("path", "key", "language").agg(F.min("target").alias("target")).hint("merge")
    rows = found.crossJoin(langs).join(have, ["path", "key", "language"], "left")
    hollow = F.col("head").endswith("/>")
    name = F.regexp_extract("head", r"^<([^\s/>]+)", 1)
    filled = F.concat(F.regexp_replace("head", r"\s*/>$", ">"), "target", F.lit("</"), name, F.lit(">"))
    text = F.when(F.col("target").isNull() | (F.col("nth") == 0), F.concat("head", "inner", "tail")).when(hollow, F.concat(filled, "tail")).otherwise(F.concat("head", "target", "tail"))
    part = F.floor(F.col("nth") / size).cast("int") if size else F.lit(0)
    got = rows.groupBy("path", "language", part.alias("part")).agg(F.array_sort(F.collect_list(F.struct("nth", text.alias("raw")))).alias("p"))
    return got.select("path", "language", "part", joined("p", "content"))
