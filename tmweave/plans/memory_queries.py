"""Registered queries over the derived translation memory, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tmweave.functions import text as fx
from tmweave.operators import reuse
from tmweave.sources import memory

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, over_memory: bool = True):
    """Registers a function of the memory's tables (and, by name, of the driver's) with its SQL."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(memory.derived(spark, sf_dir) | {"spark": spark, "dir": sf_dir})
        if sql:
            ORACLES[f.__name__] = memory.with_sql(sql) if over_memory else sql
        return f

    return add


TARGETS = """targets AS (SELECT i.item_id, l.language, s.string AS source, f.namespace, f.path, coalesce(s.context,'') AS context
FROM tm_items i JOIN tm_strings s ON s.string_id=i.string_id AND s.skip=0 JOIN tm_files f ON f.file_id=i.file_id CROSS JOIN tm_langs l
WHERE i.orphaned=0 AND NOT EXISTS (SELECT 1 FROM tm_translations t WHERE t.item_id=i.item_id AND t.language=l.language))"""
CAND = """cand AS (SELECT t.item_id, t.language, s.string AS source, f.namespace, f.path, coalesce(s.context,'') AS context, greatest(i.orphaned,f.orphaned) AS orphaned,
coalesce(t.string,'') AS target, t.fuzzy, t.comment FROM tm_translations t JOIN tm_items i ON i.item_id=t.item_id JOIN tm_strings s ON s.string_id=i.string_id JOIN tm_files f ON f.file_id=i.file_id)"""
BEST = f"""{TARGETS}, {CAND}, v AS (SELECT source, language, count(DISTINCT target) AS n FROM cand GROUP BY ALL), scored AS (
SELECT t.item_id, t.language, c.target, c.fuzzy, c.item_id AS cand_item,
 (c.namespace=t.namespace)::INT + (c.path=t.path)::INT + (c.context=t.context)::INT + (c.orphaned=0)::INT AS fitness
FROM targets t JOIN cand c ON c.source=t.source AND c.language=t.language JOIN v ON v.source=t.source AND v.language=t.language AND v.n=1),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id, language ORDER BY fitness DESC, target, cand_item) AS rn FROM scored) WHERE rn=1)"""


@query(f"WITH {BEST} SELECT item_id, language, target, fuzzy, fitness, cand_item, 0 AS variants FROM best")
def best_translation(tm):
    return reuse.best(reuse.missing(tm), reuse.candidates(tm))


@query("SELECT t.item_id, t.language, CASE WHEN s.skip=0 THEN t.string END AS target, CASE WHEN s.skip=0 THEN t.fuzzy END AS fuzzy, CASE WHEN s.skip=0 THEN t.comment END AS comment, s.skip FROM tm_translations t JOIN tm_items i USING (item_id) JOIN tm_strings s USING (string_id)")
def exact_translation(tm):
    return reuse.exact(tm)


@query(f"WITH {CAND} SELECT * FROM cand")
def tm_candidates(tm):
    return reuse.candidates(tm)


@query(f"WITH {CAND} SELECT source, language, count(DISTINCT target) AS variants FROM cand GROUP BY ALL")
def variants(tm):
    return reuse.variants(reuse.candidates(tm))


@query("SELECT f.namespace, f.path, i.item_id, s.string AS source, s.context, s.skip, f.orphaned AS file_orphaned, i.orphaned AS item_orphaned, t.language, t.string AS target, t.fuzzy FROM tm_files f LEFT JOIN tm_items i ON i.file_id=f.file_id LEFT JOIN tm_strings s ON s.string_id=i.string_id LEFT JOIN tm_translations t ON t.item_id=i.item_id AND t.language IN ('de','ja') WHERE f.namespace IN ('ns0','ns1') AND f.job IN ('job0','job1')")
def tm_scan(tm):
    return memory.scan(tm, ["ns0", "ns1"], ["job0", "job1"], ["de", "ja"])


SIMILAR = [("fr", ["de"], True), ("pt-br", ["fr", "de"], False), ("pt-br", ["ja"], True)]


@query(f"""WITH {TARGETS}, r(language, rule, from_language, rule_fuzzy) AS (VALUES ('fr',0,'de',1),('pt-br',1,'de',0),('pt-br',1,'fr',0),('pt-br',2,'ja',1)),
hit AS (SELECT t.item_id, t.language, r.from_language, x.string AS target, greatest(x.fuzzy, r.rule_fuzzy) AS fuzzy, x.comment,
row_number() OVER (PARTITION BY t.item_id, t.language ORDER BY rule, from_language) AS rn FROM targets t JOIN r ON r.language=t.language
JOIN tm_translations x ON x.item_id=t.item_id AND x.language=r.from_language AND (coalesce(x.string,'')<>'' OR coalesce(x.comment,'')<>''))
SELECT item_id, language, from_language, target, fuzzy, comment FROM hit WHERE rn=1""")
def similar_language(tm):
    have = tm["translations"].select("item_id", "language", F.col("string").alias("target"), "fuzzy", "comment")
    return reuse.similar(reuse.missing(tm), have, SIMILAR)


@query(f"""WITH {BEST}, r(language, rule, from_language, rule_fuzzy) AS (VALUES ('fr',0,'de',1),('pt-br',1,'de',0),('pt-br',1,'fr',0),('pt-br',2,'ja',1)),
hit AS (SELECT t.item_id, t.language, x.string AS target, greatest(x.fuzzy, r.rule_fuzzy) AS fuzzy,
row_number() OVER (PARTITION BY t.item_id, t.language ORDER BY rule, from_language) AS rn FROM targets t JOIN r ON r.language=t.language
JOIN tm_translations x ON x.item_id=t.item_id AND x.language=r.from_language AND (coalesce(x.string,'')<>'' OR coalesce(x.comment,'')<>''))
SELECT t.item_id, t.language, CASE WHEN b.item_id IS NOT NULL THEN b.target ELSE h.target END AS target, CASE WHEN b.item_id IS NOT NULL THEN 1 ELSE h.fuzzy END AS fuzzy,
CASE WHEN b.item_id IS NOT NULL THEN 'reuse' WHEN h.item_id IS NOT NULL THEN 'similar' END AS provenance
FROM targets t LEFT JOIN best b ON b.item_id=t.item_id AND b.language=t.language LEFT JOIN hit h ON h.item_id=t.item_id AND h.language=t.language AND h.rn=1""")
def candidate_fallback(tm):
    want = reuse.missing(tm)
    found = reuse.best(want, reuse.candidates(tm))
    found = found.withColumn("fuzzy", reuse.as_fuzzy(F.col("language"), F.col("fuzzy")))
    have = tm["translations"].select("item_id", "language", F.col("string").alias("target"), "fuzzy", "comment")
    return reuse.chain(want, [("reuse", found), ("similar", reuse.similar(want, have, SIMILAR))])


@query(f"""WITH {BEST} SELECT item_id, language, min(target) AS target, max(fitness) AS fitness FROM best GROUP BY ALL""")
def pick_best(tm):
    return reuse.best(reuse.missing(tm), reuse.candidates(tm)).select("item_id", "language", "target", "fitness")


@query("""WITH changes AS (SELECT t.item_id, t.language, CASE WHEN t.item_id%2=0 THEN 'new text' END AS target, 1 AS as_fuzzy FROM tm_translations t WHERE t.item_id%500=7),
x AS (SELECT i.item_id, s.string AS source FROM tm_items i JOIN tm_strings s USING (string_id)),
hit AS (SELECT o.item_id, o.language, o.comment, c.item_id AS by, coalesce(c.target,'') AS new, c.as_fuzzy, row_number() OVER (PARTITION BY o.item_id, o.language ORDER BY c.item_id DESC, coalesce(c.target,'') DESC) AS rn
FROM tm_translations o JOIN x ON x.item_id=o.item_id JOIN x y ON y.source=x.source JOIN changes c ON c.item_id=y.item_id AND c.language=o.language
WHERE o.item_id<>c.item_id AND CASE WHEN coalesce(c.target,'')='' THEN o.string IS NOT NULL ELSE coalesce(o.string,'')<>c.target END)
SELECT item_id, language, CASE WHEN new<>'' THEN new END AS target, CASE WHEN new='' THEN 0 ELSE as_fuzzy END AS fuzzy, CASE WHEN new='' THEN 'Translation removed' ELSE comment END AS comment, 1 AS merge FROM hit WHERE rn=1""")
def rewrite_all(tm):
    changed = tm["translations"].where("item_id % 500 = 7").select("item_id", "language", F.expr("CASE WHEN item_id % 2 = 0 THEN 'new text' END").alias("target"), F.lit(1).alias("as_fuzzy"))
    return reuse.rewrite_all(tm, changed)


@query()
def near_match(tm):
    """Targets in another case or with end punctuation, matched to the memory by near key."""
    want = reuse.missing(tm).withColumn("source", F.concat(F.upper("source"), F.lit(".")))
    return reuse.near(want, tm, reuse.candidates(tm))


TAGGED = "concat('Open <a href=\"', string_id % 5, '\">', string, '</a> <b>now</b>')"


@query("""WITH have AS (SELECT s.string_id, s.string, t.language, min(t.string) AS t, min(t.fuzzy) AS fuzzy FROM tm_translations t JOIN tm_items i USING (item_id) JOIN tm_strings s USING (string_id) JOIN tm_files f ON f.file_id=i.file_id
WHERE i.orphaned=0 AND f.orphaned=0 AND t.string IS NOT NULL GROUP BY ALL),
src AS (SELECT 'Open <a href="'||(string_id%5)||'">'||string||'</a> <b>now</b>' AS cand_source, string, language, list(DISTINCT x) AS ts FROM (SELECT s.string_id, s.string, t.language, t.string AS x FROM tm_translations t JOIN tm_items i USING (item_id)
 JOIN tm_strings s USING (string_id) JOIN tm_files f ON f.file_id=i.file_id WHERE i.orphaned=0 AND f.orphaned=0 AND t.string IS NOT NULL) GROUP BY ALL),
one AS (SELECT cand_source, string, language, ts[1] AS t FROM src WHERE len(ts)=1),
want AS (SELECT i.item_id, l.language, s.string FROM tm_items i JOIN tm_strings s ON s.string_id=i.string_id AND s.skip=0 CROSS JOIN tm_langs l WHERE i.orphaned=0 AND NOT EXISTS (SELECT 1 FROM tm_translations t WHERE t.item_id=i.item_id AND t.language=l.language)),
hit AS (SELECT item_id, w.language, cand_source, t, row_number() OVER (PARTITION BY item_id, w.language ORDER BY cand_source) AS rn FROM want w JOIN one o ON o.string=w.string AND o.language=w.language)
SELECT item_id, language, '<b>jetzt</b> <a href="x">'||t||'</a>' AS target, 1 AS fuzzy, cand_source FROM hit WHERE rn=1""")
def near_match_tags(tm):
    """The memory's texts in links, with translations that move the tags, and targets with links of their own."""
    link = lambda c: F.expr(f"CASE WHEN {c} IS NOT NULL THEN concat('<b>jetzt</b> <a href=\"', string_id % 5, '\">', {c}, '</a>') END")
    t = tm["translations"].join(tm["items"].select("item_id", "string_id"), "item_id").withColumn("string", link("string")).drop("string_id")
    linked = tm | {"strings": tm["strings"].withColumn("string", F.expr(TAGGED)), "translations": t}
    want = reuse.missing(linked).withColumn("source", F.regexp_replace("source", 'href="[0-9]"', 'href="x"'))
    return reuse.near(want, linked, reuse.candidates(linked))


RULES = [("fr", ["de"], True), ("pt-br", ["fr", "de"], False), ("pt-br", ["ja"], True)]


@query("""WITH st AS MATERIALIZED (SELECT string_id, CASE WHEN string_id%3=1 THEN upper(string) ELSE string END AS string, coalesce(context,'') AS context, skip FROM tm_strings),
cand AS MATERIALIZED (SELECT t.item_id, t.language, s.string AS source, f.namespace, f.path, s.context, greatest(i.orphaned,f.orphaned) AS orphaned, coalesce(t.string,'') AS target, t.fuzzy, t.comment
 FROM tm_translations t JOIN tm_items i USING (item_id) JOIN st s USING (string_id) JOIN tm_files f ON f.file_id=i.file_id),
grid AS MATERIALIZED (SELECT i.item_id, l.language, s.string AS source, f.namespace, f.path, s.context, s.skip, t.string AS target, t.fuzzy, t.comment, coalesce(t.string,'')<>'' OR coalesce(t.comment,'')<>'' AS found
 FROM tm_items i JOIN st s USING (string_id) JOIN tm_files f ON f.file_id=i.file_id CROSS JOIN tm_langs l LEFT JOIN tm_translations t ON t.item_id=i.item_id AND t.language=l.language WHERE i.orphaned=0),
want AS MATERIALIZED (SELECT * FROM grid WHERE skip=0 AND NOT found),
v AS MATERIALIZED (SELECT source, language, count(DISTINCT target) AS n FROM cand GROUP BY ALL),
w1 AS MATERIALIZED (SELECT w.*, v.n FROM want w LEFT JOIN v ON v.source=w.source AND v.language=w.language),
subset AS MATERIALIZED (SELECT source, language, m, CASE WHEN m&1>0 THEN namespace ELSE '' END AS a, CASE WHEN m&2>0 THEN path ELSE '' END AS b, CASE WHEN m&4>0 THEN context ELSE '' END AS c, min({'o':orphaned,'t':target,'i':item_id,'f':fuzzy,'c':comment}) AS x FROM cand, range(8) r(m) GROUP BY ALL),
scored AS (SELECT w.item_id, w.language, s.x, row_number() OVER (PARTITION BY w.item_id, w.language ORDER BY bit_count(s.m::TINYINT)+1-s.x.o DESC, s.x.t, s.x.i) AS rn FROM w1 w JOIN subset s ON s.source=w.source AND s.language=w.language AND s.a=CASE WHEN m&1>0 THEN w.namespace ELSE '' END
 AND s.b=CASE WHEN m&2>0 THEN w.path ELSE '' END AND s.c=CASE WHEN m&4>0 THEN w.context ELSE '' END WHERE w.n=1),
reuse AS MATERIALIZED (SELECT item_id, language, x.t AS target, CASE WHEN x.f=1 OR language='de' THEN 1 ELSE x.f END AS fuzzy, x.c AS comment FROM scored WHERE rn=1),
one AS (SELECT source, language, min({'f':fuzzy,'t':target}) AS c FROM cand WHERE target<>'' AND orphaned=0 GROUP BY ALL HAVING min(target)=max(target)),
near AS MATERIALIZED (SELECT w.item_id, w.language, min({'s':o.source,'t':CASE WHEN upper(w.source)=w.source THEN upper(o.c.t) WHEN w.language='de' THEN upper(o.c.t[1])||o.c.t[2:] ELSE upper(o.c.t[1])||lower(o.c.t[2:]) END}) AS x
 FROM w1 w JOIN one o ON o.language=w.language AND lower(o.source)=lower(w.source) AND o.source<>w.source GROUP BY ALL),
own AS MATERIALIZED (SELECT g.item_id, g.language, CASE WHEN g.skip=1 THEN 'skip' WHEN g.found THEN 'exact' WHEN w.n>1 THEN 'conflict' WHEN r.target<>'' OR r.comment<>'' THEN 'reuse' WHEN k.x IS NOT NULL THEN 'near' END AS provenance,
 g.target AS t0, g.fuzzy AS f0, g.comment AS c0, r.target AS t1, r.fuzzy AS f1, r.comment AS c1, k.x.t AS t2 FROM grid g LEFT JOIN w1 w USING (item_id, language) LEFT JOIN reuse r USING (item_id, language) LEFT JOIN near k USING (item_id, language)),
res AS MATERIALIZED (SELECT item_id, language, provenance, CASE provenance WHEN 'exact' THEN t0 WHEN 'reuse' THEN t1 WHEN 'near' THEN t2 END AS target, CASE provenance WHEN 'exact' THEN f0 WHEN 'reuse' THEN f1 WHEN 'near' THEN 1 END AS fuzzy, CASE provenance WHEN 'exact' THEN c0 WHEN 'reuse' THEN c1 END AS comment FROM own),
r(language, rule, from_language, rule_fuzzy) AS (VALUES ('fr',0,'de',1),('pt-br',1,'de',0),('pt-br',1,'fr',0),('pt-br',2,'ja',1)),
sim AS (SELECT a.item_id, a.language, b.target, greatest(b.fuzzy, r.rule_fuzzy) AS fuzzy, b.comment, row_number() OVER (PARTITION BY a.item_id, a.language ORDER BY rule, from_language) AS rn FROM res a JOIN r USING (language) JOIN res b ON b.item_id=a.item_id AND b.language=r.from_language AND (coalesce(b.target,'')<>'' OR coalesce(b.comment,'')<>'') WHERE a.provenance IS NULL)
SELECT a.item_id, a.language, CASE WHEN a.provenance IS NULL THEN s.target ELSE a.target END AS target, CASE WHEN a.provenance IS NULL THEN s.fuzzy ELSE a.fuzzy END AS fuzzy, CASE WHEN a.provenance IS NULL THEN s.comment ELSE a.comment END AS comment,
 CASE WHEN a.provenance IS NULL AND s.item_id IS NOT NULL THEN 'similar' ELSE a.provenance END AS provenance FROM res a LEFT JOIN sim s ON s.item_id=a.item_id AND s.language=a.language AND s.rn=1""")
def resolved_translation(tm):
    """The whole chain over a memory in which every third string is in capitals, so that near matches occur."""
    shouted = tm | {"strings": tm["strings"].withColumn("string", F.expr("CASE WHEN string_id % 3 = 1 THEN upper(string) ELSE string END"))}
    return reuse.resolve(shouted, RULES, default=False, fuzzy_for=["de"])


def over_strings(name: str, sql: str, columns):
    """A query of string functions over the memory's strings; columns gives them by name."""

    def run(spark, sf_dir):
        return memory.derived(spark, sf_dir)["strings"].select("string_id", *[c.alias(k) for k, c in columns().items()])

    QUERIES[name] = run
    ORACLES[name] = memory.with_sql(f"SELECT string_id, {sql} FROM tm_strings")


def S():
    return F.col("string")


def C():
    return F.col("context")


def E():
    return F.concat(F.lit('<b class="x">'), F.col("string"), F.lit(" & co</b>"))


def P():
    return F.concat(F.col("string"), F.lit('\t"q"\\\n'))


ESQL = "('<b class=\"x\">' || string || ' & co</b>')"
over_strings("string_key", "md5(string || chr(1) || coalesce(context,'')) AS key", lambda: dict(key=fx.string_key(S(), C())))
over_strings("tuple_hash", "md5(coalesce(context,'') || chr(1) || string) AS h", lambda: dict(h=fx.tuple_hash(C(), S())))
over_strings("normalize_ws", r"trim(regexp_replace('  ' || replace(string,' ','   ') || chr(10), '\s+', ' ', 'g')) AS s", lambda: dict(s=fx.normalize_ws(F.concat(F.lit("  "), F.replace(S(), F.lit(" "), F.lit("   ")), F.lit("\n")))))
over_strings("xml_escape", f"replace(replace(replace(replace({ESQL},'&','&amp;'),'<','&lt;'),'>','&gt;'),'\"','&quot;') AS escaped, {ESQL} AS back", lambda: dict(escaped=fx.xml_escape(E()), back=fx.xml_unescape(fx.xml_escape(E()))))
over_strings("po_escape", "string || '\\t\\\"q\\\"\\\\\\n' AS escaped, string || chr(9) || '\"q\"\\' || chr(10) AS back", lambda: dict(escaped=fx.po_escape(P()), back=fx.po_unescape(fx.po_escape(P()))))
over_strings("java_escape", "string || '\\u00e9\\u65e5' AS s", lambda: dict(s=fx.java_escape(F.concat(S(), F.lit("é日")))))
over_strings("c_unescape", "string || 'é\"' || chr(10) || '\\' AS s", lambda: dict(s=fx.c_unescape(F.concat(S(), F.lit('\\u00e9\\"\\n\\\\')))))
over_strings("plural_forms", "len(string_split(string || chr(31) || string || chr(31), chr(31))) AS n, string || chr(31) || string AS joined", lambda: dict(n=F.size(fx.plural_split(F.concat(S(), F.lit("\x1f"), S(), F.lit("\x1f")))), joined=fx.plural_join(fx.plural_split(F.concat(S(), F.lit("\x1f"), S(), F.lit("\x1f"))))))
over_strings("segment", "len(string_split_regex(replace(string,' ',chr(10)||chr(10)), '\\n{2,}')) AS n, string_split_regex(replace(string,' ',chr(10)||chr(10)), '\\n{2,}')[1] AS first", lambda: dict(n=F.size(fx.segment(F.replace(S(), F.lit(" "), F.lit("\n\n")))), first=fx.segment(F.replace(S(), F.lit(" "), F.lit("\n\n")))[0]))


def _chain(column: str, patterns: list[str], to: str) -> str:
    for p in patterns:
        column = f"regexp_replace({column}, '{p}', {to}, 'g')"
    return column


CKEY = "lower(replace(regexp_replace(" + _chain("string", fx.NOT_KEY, "''") + r", '[^\p{L}\p{M}\p{N}_]+', '', 'g'), '_', ''))"
WORDS = "len(regexp_extract_all(regexp_replace(regexp_replace(" + _chain("replace(string, chr(10), '{\\n}')", fx.NOT_WORDS, "chr(1)") + rf", '(^|[^\p{{L}}\p{{M}}\p{{N}}_])({fx.MONTHS})\s+\d{{1,2}},\s+(?:\d{{2}})?\d{{2}}([^\p{{L}}\p{{M}}\p{{N}}_]|$)', '\1\2\3', 'g'), '\.+', '', 'g'), '[\p{{L}}\p{{M}}\p{{N}}_]+'))"
over_strings("consistency_key", f"{CKEY} AS key", lambda: dict(key=fx.consistency_key(S())))
over_strings("wordcount", f"CAST({WORDS} AS BIGINT) AS words", lambda: dict(words=fx.wordcount(S())))
over_strings("near_key", r"md5(regexp_replace(lower('[tag:0]' || string || '[tag:1] and'), '[^\p{L}\p{M}\p{N}_\])>]+$', '')) AS key", lambda: dict(key=fx.near_key(F.concat(F.lit("<i>"), S(), F.lit("</i> And!! ")))))
over_strings("pseudo_translate", f"'<b>' || translate(string, '{fx.PLAIN}', '{fx.FAKE}') || '</b>{{x}}' AS s", lambda: dict(s=fx.pseudo_translate(F.concat(F.lit("<b>"), S(), F.lit("</b>{x}")))))
over_strings("placeholder_mask", "'<1> ' || string || ' <2> <1>' AS masked, '{a} ' || string || ' {b} {a}' AS back", lambda: dict(masked=fx.placeholder_mask(F.concat(F.lit("{a} "), S(), F.lit(" {b} {a}")), r"\{\w+\}"), back=fx.placeholder_unmask(fx.placeholder_mask(F.concat(F.lit("{a} "), S(), F.lit(" {b} {a}")), r"\{\w+\}"), fx.placeholders(F.concat(F.lit("{a} "), S(), F.lit(" {b} {a}")), r"\{\w+\}"))))
over_strings("replace_rules", r"regexp_replace(regexp_replace(string, '[aeiou]+', '*', 'g'), '(\w)\*', '\1-', 'g') AS s", lambda: dict(s=fx.replace_rules(S(), [("[aeiou]+", "*"), (r"(\w)\*", "$1-")])))
over_strings("trademark_hint", r"CASE WHEN len(regexp_extract_all(string, '(?i)\b(brass|steel|copper)\b')) > 0 THEN 'Don''t translate: ' || array_to_string(list_sort(list_distinct(regexp_extract_all(string, '(?i)\b(brass|steel|copper)\b'))), ', ') END AS hint", lambda: dict(hint=fx.trademark_hint(S(), ["brass", "steel", "copper"])))
over_strings("hint_assemble", "CASE WHEN coalesce(context,'')='' THEN 'note' ELSE context || chr(10) || 'note' END || chr(10) || chr(10) || 'remark' AS hint", lambda: dict(hint=fx.hint_assemble(S(), C(), F.array(F.lit("note")), F.lit("remark"))))
over_strings("keys_language", "'[' || md5('7' || chr(1) || 'ns' || chr(1) || 'p' || chr(1) || string || chr(1) || coalesce(context,'')) || '] ' || string AS s", lambda: dict(s=fx.keys_language("7", F.lit("ns"), F.lit("p"), S(), C())))
over_strings("fit_whitespace", "'  ' || string || chr(10) AS s", lambda: dict(s=fx.fit_whitespace(F.lit("  x\n"), F.concat(S(), F.lit("   ")))))
over_strings("pad", "rpad(string, CAST(greatest(length(string), 30) AS INT), ' ') AS s", lambda: dict(s=fx.pad(S(), 30)))
over_strings("path_normalize", "'a/b/' || string AS p", lambda: dict(p=fx.path_normalize(F.concat(F.lit("a\\b//"), S(), F.lit("//")))))
over_strings("flag_ops", "list_contains(['a', context], context) AS has, len(list_distinct(['a', coalesce(context,'a'), 'b'])) AS n", lambda: dict(has=F.array_contains(F.array(F.lit("a"), C()), C()), n=F.size(F.array_distinct(F.array(F.lit("a"), F.coalesce(C(), F.lit("a")), F.lit("b"))))))
over_strings("parse_command", "CASE string_id%4 WHEN 0 THEN 'set_comment' WHEN 1 THEN 'add_comment' WHEN 2 THEN 'rewrite_all' ELSE 'none' END AS command, CASE WHEN string_id%4<2 THEN string END AS value",
    lambda: dict(command=fx.parse_command(F.expr("CASE string_id%4 WHEN 0 THEN concat('@ ', string) WHEN 1 THEN concat('+ ', string) WHEN 2 THEN '@rewrite_all' ELSE string END"))["command"], value=fx.parse_command(F.expr("CASE string_id%4 WHEN 0 THEN concat('@ ', string) WHEN 1 THEN concat('+ ', string) WHEN 2 THEN '@rewrite_all' ELSE string END"))["value"]))


@query("""SELECT language, CASE WHEN language='pt-br' THEN 'pt_BR' ELSE language END AS locale, CASE language WHEN 'pt-br' THEN 'pt-BR' WHEN 'ja' THEN 'ja-JP' ELSE language || '-' || upper(language) END AS culture,
CASE language WHEN 'pt-br' THEN 'pt_BR' WHEN 'ja' THEN 'ja_JP' ELSE language || '_' || upper(language) END AS full_locale, CASE WHEN language='pt-br' THEN 'pt-rBR' ELSE language END AS android,
CASE WHEN language='pt-br' THEN 'pt' ELSE language END AS iphone, count(*) AS n FROM tm_translations GROUP BY ALL""")
def locales(tm):
    x = F.col("language")
    t = tm["translations"].groupBy("language").agg(F.count("*").alias("n"))
    return t.select("language", fx.locale(x).alias("locale"), fx.culture(x).alias("culture"), fx.locale_full(x).alias("full_locale"), fx.locale_android(x).alias("android"), fx.locale_iphone(x).alias("iphone"), "n")


@query("SELECT t.language, CASE t.language WHEN 'de' THEN 1031 WHEN 'fr' THEN 1036 WHEN 'ja' THEN 1041 ELSE 1046 END AS lang_id, CASE t.language WHEN 'ja' THEN 932 ELSE 1252 END AS code_page, count(*) AS n FROM tm_translations t GROUP BY ALL")
def lang_id(tm):
    ids = tm["spark"].createDataFrame([(a, i, p) for a, _, i, _, _, _, p in fx.LANG_IDS], "language string, lang_id int, code_page int")
    return tm["translations"].groupBy("language").agg(F.count("*").alias("n")).join(F.broadcast(ids), "language", "left").withColumn("code_page", F.coalesce("code_page", F.lit(1252)))


@query("""SELECT f.file_id, l.language, 'res/' AS dir, regexp_extract(f.path,'res/(.*)\\.properties',1) AS name, 'properties' AS ext,
'out/' || CASE WHEN l.language='pt-br' THEN 'pt_BR' ELSE l.language END || '/res/' || regexp_extract(f.path,'res/(.*)\\.properties',1) || '.properties' AS out FROM tm_files f CROSS JOIN tm_langs l""")
def render_path(tm):
    p = fx.path_parts(F.col("path"))
    return tm["files"].crossJoin(F.broadcast(tm["langs"])).select("file_id", "language", p["dir"].alias("dir"), p["name"].alias("name"), p["ext"].alias("ext"), fx.render_path("out/%LOCALE%/%PATH%%NAME%.%EXT%", F.col("path"), F.col("language")).alias("out"))


@query()
def wrap(tm):
    return tm["strings"].select("string_id", F.explode(fx.wrap(F.col("string"), 10)).alias("piece"))
