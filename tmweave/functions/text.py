"""Scalar functions on strings as Spark columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

W = r"\p{L}\p{M}\p{N}_"
#: Regions of languages whose code isn't their region's.
REGIONS = {"en": "US", "ja": "JP", "sv": "SE", "zh": "CN", "ko": "KR", "da": "DK", "sr": "RS", "sh": "RS", "el": "GR", "cs": "CZ", "nb": "NO", "nn": "NO", "ca": "ES", "et": "EE", "ka": "GE", "te": "IN", "he": "IL", "ar": "AE", "gl": "ES", "uk": "UA", "vi": "VN", "ms": "MY"}
#: What isn't translated inside a string, in the order in which it is masked.
NOT_WORDS = [r"&lt;/?\w+.*?>", r"</?\w+.*?>", r"\\\{\d+\\\}|\{\d+\}", r"\$\{[\w.:]+\}", r"%\d\$\w", r"%\d*(?:.\d+)*(?:h|l|I|I32|I64)*[cdiouxefgns]", r"%@", r"\$\w+?\$", r"%\w+?%", r"\{\\n\}", r"\\+[rnt]", r"&#\d+;|&\w+;", r"Ctrl\+\w$|Shift\+\w$|Alt\+\w$", r"Ctrl\+$|Shift\+$|Alt\+$"]
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
#: What doesn't tell two sources apart.
NOT_KEY = [r"\\[rnt]", r"&.+?;", r"<.+?>", r"%\w+%", r"%\d+\$\w", r"%[\w\d.]+", r"%\d+(\$@)?", r"%([%idufs@]|qu)", r"%\{\w+\}@", r"\{\d+\}", r"\{.+?\}", r"\[\w+\]"]
#: Win32 primary and full language ids, constants and code pages.
LANG_IDS = [("de", 7, 1031, "LANG_GERMAN", "SUBLANG_GERMAN", "DEU", 1252), ("en", 9, 1033, "LANG_ENGLISH", "SUBLANG_ENGLISH_US", "ENU", 1252), ("fr", 12, 1036, "LANG_FRENCH", "SUBLANG_FRENCH", "FRA", 1252), ("ja", 17, 1041, "LANG_JAPANESE", "SUBLANG_DEFAULT", "JPN", 932), ("pt-br", 22, 1046, "LANG_PORTUGUESE", "SUBLANG_PORTUGUESE_BRAZILIAN", "PTB", 1252), ("es", 10, 3082, "LANG_SPANISH", "SUBLANG_SPANISH_MODERN", "ESN", 1252), ("ru", 25, 1049, "LANG_RUSSIAN", "SUBLANG_DEFAULT", "RUS", 1251)]
#: Look-alikes of a to z and A to Z for pseudo-translation.
PLAIN, FAKE = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "áƀçđéƒǧĥíĵķĺɱñóƥʠŕšťúṽŵẋýžÁƁÇĐÉƑǦĤÍĴĶĹṀÑÓƤɊŔŠŤÚṼŴẊÝŽ"


def blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def string_key(s: Column, context: Column) -> Column:
    """Identity of a string in a context."""
    return F.md5(F.concat(s, F.lit("\x01"), blank(context)))


def tuple_hash(*values: Column) -> Column:
    return F.md5(F.concat_ws("\x01", *[blank(v.cast("string")) for v in values]))


def normalize_ws(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def locale(lang: Column) -> Column:
    """pt-br: pt_BR."""
    return F.concat_ws("_", F.split_part(lang, F.lit("-"), F.lit(1)), F.nullif(F.upper(F.regexp_extract(lang, "^[^-]+-(.*)$", 1)), F.lit("")))


def culture(lang: Column) -> Column:
    """ru: ru-RU; pt-br: pt-BR; with a region of its own for some languages."""
    region = reduce(lambda c, kv: c.when(lang == kv[0], kv[1]), REGIONS.items(), F.when(F.lit(False), "")).otherwise(F.upper(lang))
    tail = F.regexp_extract(lang, "^[^-]+-[^-]+(-.*)?$", 1)
    return F.when(lang.rlike(r"^\w+$"), F.concat(lang, F.lit("-"), region)).otherwise(F.concat(F.regexp_extract(lang, "^([^-]+)", 1), F.lit("-"), F.upper(F.regexp_extract(lang, "^[^-]+-([^-]+)", 1)), tail))


def locale_full(lang: Column) -> Column:
    return F.replace(culture(lang), F.lit("-"), F.lit("_"))


def locale_android(lang: Column) -> Column:
    """pt-br: pt-rBR."""
    return F.when(lang.contains("-"), F.concat(F.regexp_extract(lang, "^([^-]+)", 1), F.lit("-r"), F.upper(F.regexp_extract(lang, "^[^-]+-([^-]+)", 1)), F.regexp_extract(lang, "^[^-]+-[^-]+(-.*)?$", 1))).otherwise(lang)


def locale_iphone(lang: Column) -> Column:
    """As locale(), with Portuguese and Brazilian Portuguese named as that platform does."""
    x = locale(lang)
    return F.when(x == "pt_BR", "pt").when(x == "pt", "pt_PT").otherwise(x)


def path_parts(path: Column) -> dict[str, Column]:
    """dir (with its slash), file, name and ext at the last dot, lname and lext at the first dot."""
    file = F.regexp_extract(path, r"([^/]*)$", 1)
    return {
        "dir": F.regexp_extract(path, r"^(.*/)[^/]*$", 1), "file": file,
        "name": F.when(file.contains("."), F.regexp_extract(file, r"^(.*)\.[^.]*$", 1)).otherwise(file), "ext": F.regexp_extract(file, r"\.([^.]*)$", 1),
        "lname": F.regexp_extract(file, r"^([^.]*)", 1), "lext": F.regexp_extract(file, r"^[^.]*\.(.*)$", 1),
    }


def render_path(template: str, path: Column, lang: Column) -> Column:
    """A path template's macros filled in for a file and a language."""
    p = path_parts(path)
    macros = {"%FILE%": path, "%PATH%": p["dir"], "%NAME%": p["name"], "%EXT%": p["ext"], "%LNAME%": p["lname"], "%LEXT%": p["lext"], "%LANG%": lang, "%LOCALE%": locale(lang), "%CULTURE%": culture(lang), "%LOCALE:ANDROID%": locale_android(lang), "%LOCALE:IPHONE%": locale_iphone(lang), "%LOCALE:FULL%": locale_full(lang)}
    return reduce(lambda s, kv: F.replace(s, F.lit(kv[0]), kv[1]), macros.items(), F.lit(template))


ESCAPES = [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t"), ("\b", "\\b"), ("\r", "\\r"), ("\f", "\\f"), ("\v", "\\v"), ("\a", "\\a")]


def po_escape(s: Column) -> Column:
    return reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), ESCAPES, s)


def po_unescape(s: Column) -> Column:
    s = F.replace(s, F.lit("\\\\"), F.lit("\x01"))
    s = reduce(lambda c, e: F.replace(c, F.lit(e[1]), F.lit(e[0])), ESCAPES[1:], s)
    return F.replace(s, F.lit("\x01"), F.lit("\\"))


def java_escape(s: Column) -> Column:
    """Characters beyond ASCII as \\uXXXX; those beyond the basic plane as two of these, a surrogate pair."""
    units = lambda c: F.regexp_replace(F.lower(F.hex(F.encode(c, "UTF-16BE"))), "(.{4})", r"\\u$1")
    one = lambda c: F.when(F.length(F.encode(c, "UTF-8")) > 1, units(c)).otherwise(c)
    return F.array_join(F.transform(F.split(s, ""), one), "")


def xml_escape(s: Column, quotes: bool = True, apostrophes: bool = False) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *([('"', "&quot;")] if quotes else []), *([("'", "&apos;")] if apostrophes else [])):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def xml_unescape(s: Column, quotes: bool = True, apostrophes: bool = True) -> Column:
    for a, b in (*([("&quot;", '"')] if quotes else []), *([("&apos;", "'")] if apostrophes else []), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def c_unescape(s: Column) -> Column:
    """\\uXXXX (or \\UXXXX), \\xXX, control characters by letter, \\" and \\' of program literals. Surrogate pairs are one character; half a pair stays as it is written."""
    unit, high, low = r"\\[uU][0-9A-Fa-f]{4}", r"\\[uU][dD][89abAB][0-9A-Fa-f]{2}", r"\\[uU][dD][c-fC-F][0-9A-Fa-f]{2}"
    pieces = F.regexp_extract_all(s, F.lit(rf"(?s)({high}{low}|{unit}|\\x[0-9A-Fa-f]{{2}}|\\.|[^\\]+|\\$)"), F.lit(1))
    letters = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v"}

    def one(p: Column) -> Column:
        half = (F.length(p) == 6) & p.rlike(rf"^(?:{high}|{low})$")
        digits = F.when(p.rlike(r"^\\x[0-9A-Fa-f]{2}$"), F.concat(F.lit("00"), F.substring(p, 3, 2))).when(p.rlike(rf"^(?:{unit})+$"), F.regexp_replace(p, r"\\[uU]", ""))
        c = F.when(half, p).when(digits.isNotNull(), F.decode(F.unhex(digits), "UTF-16BE"))
        for letter, char in letters.items():
            c = c.when(p == "\\" + letter, char)
        return c.when(p.rlike(r"(?s)^\\."), F.substring(p, 2, 1)).otherwise(p)

    return F.array_join(F.transform(pieces, one), "")


def plural_split(s: Column) -> Column:
    return F.split(s, "\x1f")


def plural_join(forms: Column) -> Column:
    return F.regexp_replace(F.array_join(forms, "\x1f"), "\x1f+$", "")


def wrap(s: Column, width: int) -> Column:
    """Pieces of at most width characters where spaces allow it; white space stays with the word before it, and line feeds end pieces. Longer words are cut."""
    tokens = F.regexp_extract_all(s, F.lit(rf"(?s)(\n|[^\s]{{1,{width}}}[^\S\n]*\n?|[^\S\n]+\n?)"), F.lit(1))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("line"))

    def add(acc, t):
        fits = (F.length(F.rtrim(F.concat(acc["line"], F.rtrim(t)))) <= width) & ~acc["line"].endswith("\n")
        return F.struct(F.when(fits | (acc["line"] == ""), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["line"]))).alias("done"), F.when(fits | (acc["line"] == ""), F.concat(acc["line"], t)).otherwise(t).alias("line"))

    return F.aggregate(tokens, start, add, lambda a: F.when(a["line"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["line"]))))


def segment(s: Column, separator: str = r"\n{2,}") -> Column:
    """Text pieces between separators."""
    return F.split(s, separator)


def consistency_key(s: Column) -> Column:
    """A source without escapes, entities, tags, placeholders, anything but letters and digits, or case."""
    s = reduce(lambda c, p: F.regexp_replace(c, p, ""), NOT_KEY, s)
    return F.lower(F.replace(F.regexp_replace(s, f"[^{W}]+", ""), F.lit("_"), F.lit("")))


def wordcount(s: Column) -> Column:
    """Words of a string to be translated: markup and placeholders hide what they cover, dates count as their month, dots join."""
    s = F.replace(s, F.lit("\n"), F.lit("{\\n}"))
    s = reduce(lambda c, p: F.regexp_replace(c, p, "\x01"), NOT_WORDS, s)
    s = F.regexp_replace(s, rf"(^|[^{W}])({MONTHS})\s+\d{{1,2}},\s+(?:\d{{2}})?\d{{2}}([^{W}]|$)", "$1$2$3")
    s = F.regexp_replace(s, r"\.+", "")
    return F.coalesce(F.regexp_count(s, F.lit(f"[{W}]+")), F.lit(0)).cast("long")


TAG = r"<[^<>]*>"
END = rf"[^{W}\])>]+$"


def near_key(s: Column) -> Column:
    """Alike for strings that differ in a wrapper tag, tags' contents, white space, case and end punctuation."""
    s = F.regexp_replace(s, r"^\s*<(\w+)[^<>]*>(.+)</\1>\s*$", "$2")
    tags = F.regexp_replace(s, TAG, "")
    parts = F.split(s, TAG)
    numbered = F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit("[tag:"), (i - 1).cast("string"), F.lit("]"), p))), "")
    s = F.when(F.trim(tags) == "", "").otherwise(numbered)
    return F.md5(F.regexp_replace(F.lower(normalize_ws(s)), END, ""))


def near_adjust(source: Column, target: Column, lang: Column) -> Column:
    """A near match's translation with the source's white space, wrapper tag, case and end punctuation."""
    wrapped = r"^(<(\w+)[^<>]*>)(.+)(</\2>)$"
    bare = F.trim(target)
    src = F.trim(source)
    has, wants = bare.rlike(wrapped), src.rlike(wrapped)
    x = F.when(has & ~wants, F.regexp_extract(bare, wrapped, 3)).when(~has & wants, F.concat(F.regexp_extract(src, wrapped, 1), bare, F.regexp_extract(src, wrapped, 4))).otherwise(bare)
    open_, inner, close = F.regexp_extract(x, wrapped, 1), F.when(x.rlike(wrapped), F.regexp_extract(x, wrapped, 3)).otherwise(x), F.regexp_extract(x, wrapped, 4)
    plain = F.regexp_replace(src, TAG, "")
    german = lang.rlike("^de(-|$)")
    sentence = lambda c: F.concat(F.upper(F.substring(c, F.lit(1), F.lit(1))), F.substring(F.lower(c), F.lit(2), F.length(c)))
    gentle = lambda c: F.concat(F.upper(F.substring(c, F.lit(1), F.lit(1))), F.substring(c, F.lit(2), F.length(c)))
    cased = F.when(F.lower(plain) == plain, F.when(german, inner).otherwise(F.lower(inner))).when(F.upper(plain) == plain, F.upper(inner)).when(sentence(plain) == plain, F.when(german, gentle(inner)).otherwise(sentence(inner))).otherwise(inner)
    end = F.regexp_extract(plain, f"({END})", 1)
    end = F.when(lang.rlike("^ja(-|$)"), F.translate(F.replace(end, F.lit("..."), F.lit("…")), ".?!", "。？！")).otherwise(end)
    x = F.concat(open_, F.regexp_replace(cased, END, ""), end, close)
    return F.concat(F.regexp_extract(source, r"^\s*", 0), x, F.regexp_extract(source, r"\s*$", 0))


WRAPPED = r"(?s)^(\s*<(\w+)[^<>]*>)(.+)(</\2>\s*)$"


def unwrapped(s: Column) -> Column:
    """Without a tag pair around the whole string."""
    return F.when(s.rlike(WRAPPED), F.regexp_extract(s, WRAPPED, 3)).otherwise(s)


def tags(s: Column) -> Column:
    return F.regexp_extract_all(s, F.lit(f"({TAG})"), F.lit(1))


def _occurrences(found: Column) -> Column:
    """Each tag with how many of the same stand up to it, so that repeated tags differ."""
    return F.transform(found, lambda t, i: F.concat(t, F.lit("\x01"), F.size(F.filter(F.slice(found, F.lit(1), i + 1), lambda x: x == t)).cast("string")))


def let(value: Column, f) -> Column:
    """f of a value that is written into the plan once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def substitute_tags(translation: Column, source: Column, wanted: Column) -> Column:
    """A translation of source with the tags of wanted, a string with as many tags as source.

    The n-th tag of source stands for the n-th of wanted; a translation's tag is the source's it equals (of equal ones: the one that is as manieth), wherever the translation has
    moved it. Null if the numbers of tags differ, or the translation has a tag that its source hasn't.
    """

    def aligned(v: Column) -> Column:
        at = lambda k: F.array_position(v["have"], k).cast("int") - 1
        new = F.transform(v["mine"], lambda k: F.get(v["want"], F.when(at(k) >= 0, at(k))))
        between = lambda p, i, ts: F.concat(F.when(i == 0, "").otherwise(F.coalesce(F.get(ts, i - 1), F.lit(""))), p)
        made = lambda ts: F.when(~F.exists(ts, lambda t: t.isNull()), F.array_join(F.transform(v["parts"], lambda p, i: between(p, i, ts)), ""))
        return F.when(F.size(v["have"]) == F.size(v["want"]), let(new, made))

    numbered = lambda c: let(tags(c), _occurrences)
    return let(F.struct(numbered(source).alias("have"), tags(wanted).alias("want"), numbered(translation).alias("mine"), F.split(translation, TAG).alias("parts")), aligned)


#: Stands for a tag while a text is adjusted: a letter without case, so that case and end punctuation pass it by. Texts that hold it find no near match.
MARK = "ꀀ"


def near_made(source: Column, found: Column, translation: Column, lang: Column) -> Column:
    """The translation of a near match (found) made to fit source: its own tags, then case and end punctuation of what stands between them, white space, and its own wrapper. Null where tags can't be aligned."""
    own = F.struct(unwrapped(source).alias("own"), unwrapped(found).alias("found"), F.when(found.rlike(WRAPPED), unwrapped(translation)).otherwise(translation).alias("translation"))
    inner = let(own, lambda v: F.struct(v["own"].alias("own"), substitute_tags(v["translation"], v["found"], v["own"]).alias("inner")))

    def parts(v: Column) -> Column:
        masked = F.regexp_replace(v["inner"], TAG, MARK)
        form = rf"(?s)^([{MARK}\s]*)(.*?)([{MARK}\s]*)$"
        part = lambda n: F.regexp_extract(masked, form, n)
        return F.struct(v["own"].alias("own"), F.trim(F.regexp_replace(v["own"], TAG, "")).alias("plain"), tags(v["inner"]).alias("tags"), part(1).alias("lead"), part(2).alias("core"), part(3).alias("tail"), v["inner"].contains(MARK).alias("odd"))

    def whole(v: Column) -> Column:
        new = F.when(v["core"] == "", "").otherwise(near_adjust(v["plain"], v["core"], lang))
        texts = F.split(F.concat(v["lead"], new, v["tail"]), MARK)
        joined = F.array_join(F.transform(texts, lambda t, i: F.concat(F.when(i == 0, "").otherwise(F.coalesce(F.get(v["tags"], i - 1), F.lit(""))), t)), "")
        return F.when(~v["odd"], fit_whitespace(v["own"], joined))

    made = let(let(inner, parts), whole)
    return F.when(source.rlike(WRAPPED), F.concat(F.regexp_extract(source, WRAPPED, 1), made, F.regexp_extract(source, WRAPPED, 4))).otherwise(made)


HIDDEN = r"\$\{.*?\}|\{\{.*?\}\}|\{.*?\}|%[\w.]+%|%\d*\$?\w|\\[nrt]|</?\w+.*?>|&#?\w+;|https?://\S+|mailto:\S+"


def pseudo_translate(s: Column, expand: bool = False) -> Column:
    """Letters outside markup and placeholders become accented look-alikes; expand adds length as translations do, in brackets."""
    pieces = F.regexp_extract_all(s, F.lit(rf"(?s)({HIDDEN}|.)"), F.lit(1))
    out = F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(f"^(?:{HIDDEN})$"), p).otherwise(F.translate(p, PLAIN, FAKE))), "")
    if not expand:
        return out
    n = F.length(s)
    rate = F.when(n < 10, 2.0).when(n < 20, 1.7).when(n < 200, 1.5).otherwise(1.4)
    return F.concat(F.lit("["), out, F.repeat(F.lit("~"), F.greatest(F.lit(0), F.ceil(n * rate).cast("int") - n).cast("int")), F.lit("]"))


def placeholders(s: Column, pattern: str) -> Column:
    """The distinct matches in order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(s, F.lit(f"({pattern})"), F.lit(1)))


def placeholder_mask(s: Column, pattern: str) -> Column:
    """Each distinct match as <1>, <2>, ... by first appearance."""
    found = placeholders(s, pattern)
    pieces = F.regexp_extract_all(s, F.lit(rf"(?s)({pattern}|.)"), F.lit(1))
    mark = lambda p: F.when(F.array_contains(found, p) & p.rlike(f"^(?:{pattern})$"), F.concat(F.lit("<"), F.array_position(found, p).cast("string"), F.lit(">"))).otherwise(p)
    return F.array_join(F.transform(pieces, mark), "")


def placeholder_unmask(s: Column, found: Column) -> Column:
    return F.aggregate(F.transform(found, lambda x, i: F.struct(F.concat(F.lit("<"), (i + 1).cast("string"), F.lit(">")).alias("k"), x.alias("v"))), s, lambda acc, kv: F.replace(acc, kv["k"], kv["v"]))


def replace_rules(s: Column, rules: list[tuple[str, str]]) -> Column:
    return reduce(lambda c, r: F.regexp_replace(c, r[0], r[1]), rules, s)


def trademark_hint(s: Column, names: list[str]) -> Column:
    """A sentence that names the trademarks in a string; null if there are none."""
    found = F.array_sort(F.array_distinct(F.regexp_extract_all(s, F.lit(rf"(?i)\b({'|'.join(names)})\b"), F.lit(1))))
    return F.when(F.size(found) > 0, F.concat(F.lit("Don't translate: "), F.array_join(found, ", ")))


def hint_assemble(source: Column, hint: Column, messages: Column, comment: Column) -> Column:
    """Hint (unless it is the source), messages, an empty line and the comment."""
    top = F.filter(F.concat(F.array(F.when(blank(hint) != source, hint)), messages), lambda x: blank(x) != "")
    top = F.array_join(top, "\n")
    return F.when(blank(comment) == "", top).when(top == "", comment).otherwise(F.concat(top, F.lit("\n\n"), comment))


def keys_language(seed: str, namespace: Column, path: Column, s: Column, context: Column, template: str = "[%KEY%] %STRING%") -> Column:
    key = tuple_hash(F.lit(seed), namespace, path, s, context)
    return F.replace(F.replace(F.lit(template), F.lit("%KEY%"), key), F.lit("%STRING%"), s)


def fit_whitespace(source: Column, target: Column) -> Column:
    """A translation with its source's leading and trailing white space."""
    return F.concat(F.regexp_extract(source, r"^\s*", 0), F.regexp_replace(F.regexp_replace(target, r"^\s+", ""), r"\s+$", ""), F.regexp_extract(source, r"\s*$", 0))


def pad(s: Column, n: int) -> Column:
    return F.when(F.length(s) < n, F.rpad(s, n, " ")).otherwise(s)


def path_normalize(p: Column) -> Column:
    return F.regexp_replace(F.replace(F.replace(p, F.lit("\\"), F.lit("/")), F.lit("//"), F.lit("/")), "/+$", "")


def parse_command(comment: Column) -> Column:
    """@ text: replace the item's comment; + text: add to it; @rewrite_all[_as_fuzzy]: spread the translation."""
    c = F.trim(blank(comment))
    name = F.when(c.rlike(r"^@rewrite_all_as_fuzzy\b"), "rewrite_all_as_fuzzy").when(c.rlike(r"^@rewrite_all\b"), "rewrite_all").when(c.rlike(r"^@\s"), "set_comment").when(c.rlike(r"^\+\s"), "add_comment").otherwise("none")
    return F.struct(name.alias("command"), F.when(name.isin("set_comment", "add_comment"), F.trim(F.substring(c, F.lit(2), F.length(c)))).alias("value"))
