"""Registered queries of reports, rules and changes, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tmweave.functions import text as fx
from tmweave.operators import change, report, reuse, rules
from tmweave.plans import memory_queries as m
from tmweave.sources import memory

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(memory.derived(spark, sf_dir) | {"spark": spark, "dir": sf_dir})
        if sql:
            ORACLES[f.__name__] = memory.with_sql(sql)
        return f

    return add


LIVE = "live AS (SELECT i.item_id, i.file_id, i.string_id, s.string AS source, s.context FROM tm_items i JOIN tm_strings s ON s.string_id=i.string_id AND s.skip=0 WHERE i.orphaned=0)"
RATIO = f"""{LIVE}, ratios AS (SELECT f.file_id, l.language, (SELECT count(*) FROM live x WHERE x.file_id=f.file_id) AS total, coalesce(d.translated,0) AS translated
FROM tm_files f CROSS JOIN tm_langs l LEFT JOIN (SELECT x.file_id, t.language, count(*) AS translated FROM tm_translations t JOIN live x ON x.item_id=t.item_id WHERE t.fuzzy=0 GROUP BY ALL) d ON d.file_id=f.file_id AND d.language=l.language),
r AS (SELECT *, CASE WHEN total=0 THEN 1.0::DOUBLE ELSE translated::DOUBLE/total END AS ratio FROM ratios)"""


@query(f"WITH {RATIO} SELECT * FROM r")
def completeness(tm):
    return report.completeness(tm)


@query(f"WITH {RATIO} SELECT *, CASE WHEN language='de' THEN CASE WHEN file_id%2=0 THEN 'update' ELSE 'create' END WHEN file_id%2=0 THEN CASE WHEN ratio<=0.4 THEN 'delete' WHEN ratio>=0.4 THEN 'update' ELSE 'skip' END WHEN ratio>=0.5 THEN 'create' ELSE 'skip' END AS action FROM r")
def completeness_gate(tm):
    return report.completeness_gate(report.completeness(tm), F.col("file_id") % 2 == 0, 0.5, 0.4, True, ["de"])


@query("SELECT t.language, s.string AS source, s.context, t.string AS target, t.comment, array_to_string(list_sort(list_distinct(list(f.namespace || '/' || f.path))), '; ') AS places, count(*) AS uses, min(greatest(i.orphaned,f.orphaned)) AS all_orphaned FROM tm_translations t JOIN tm_items i USING (item_id) JOIN tm_strings s ON s.string_id=i.string_id AND s.skip=0 JOIN tm_files f ON f.file_id=i.file_id WHERE t.string IS NOT NULL GROUP BY ALL")
def usage_report(tm):
    return report.usage(tm)


@query(f"""WITH p AS (SELECT t.language, {m.CKEY} AS key, s.string AS source, t.string AS target, count(*) AS uses FROM tm_translations t JOIN tm_items i ON i.item_id=t.item_id AND i.orphaned=0 JOIN tm_strings s ON s.string_id=i.string_id AND s.skip=0 WHERE t.string IS NOT NULL GROUP BY ALL)
SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY language, key) AS variants FROM p WHERE key<>'') WHERE variants>1""".replace("replace(regexp_replace(string", "replace(regexp_replace(s.string").replace("(string, '\\\\", "(s.string, '\\\\"))
def inconsistencies(tm):
    return report.inconsistencies(tm)


EXPORT = f"{LIVE}, rows AS (SELECT f.namespace, f.path, x.item_id, l.language, x.source, x.context, t.string AS target, t.fuzzy, t.item_id AS has FROM live x JOIN tm_files f ON f.file_id=x.file_id AND f.orphaned=0 JOIN tm_langs l ON l.language IN ('de','fr') LEFT JOIN tm_translations t ON t.item_id=x.item_id AND t.language=l.language)"


@query(f"WITH {EXPORT} SELECT namespace, path, item_id, language, source, context, target, fuzzy FROM rows")
def export_join(tm):
    return report.exported(tm, ["de", "fr"], force=True)


@query(f"WITH {EXPORT} SELECT namespace, path, item_id, language, source, context, target, fuzzy FROM rows WHERE (has IS NULL OR fuzzy=1 OR target IS NULL) AND namespace IN ('ns1','ns2') AND path LIKE 'res/Supplier#%1.prop%'")
def export_filter(tm):
    return report.exported(tm, ["de", "fr"], include_fuzzy=True, include_empty=True, namespaces=["ns1", "ns2"], file_like="res/Supplier#*1.prop*")


@query(f"WITH {EXPORT} SELECT namespace, path, item_id, language, source, context, target, fuzzy FROM (SELECT *, row_number() OVER (PARTITION BY language, source ORDER BY namespace, path, item_id) AS n FROM rows WHERE has IS NULL) WHERE n=1")
def first_occurrence(tm):
    return report.first_occurrence(report.exported(tm, ["de", "fr"]))


@query(f"WITH {EXPORT} SELECT language, item_id, '<tu><tuv xml:lang=\"en\"><seg>' || source || '</seg></tuv><tuv xml:lang=\"' || language || '\"><seg>' || target || '</seg></tuv></tu>' AS unit FROM (SELECT *, row_number() OVER (PARTITION BY language, source ORDER BY namespace, path, item_id) AS n FROM rows WHERE target IS NOT NULL) WHERE n=1")
def tmx_export(tm):
    return report.tmx(report.exported(tm, ["de", "fr"], translated_only=True))


@query(f"WITH {EXPORT}, w AS (SELECT namespace, path, len(string_split(source,' ')) AS words FROM rows WHERE has IS NULL) SELECT namespace, path, CAST(sum(words) AS BIGINT) AS words, count(*) AS strings FROM w GROUP BY ROLLUP(namespace, path)")
def wordcount_report(tm):
    return report.wordcounts(report.exported(tm, ["de", "fr"]))


@query("""WITH b AS (SELECT i.file_id, max(greatest(i.item_id, s.string_id)) AS base FROM tm_items i JOIN tm_strings s USING (string_id) GROUP BY ALL), o AS (SELECT i.file_id, t.language, max(t.translation_id) AS own FROM tm_translations t JOIN tm_items i USING (item_id) GROUP BY ALL)
SELECT b.file_id, l.language, greatest(b.base, coalesce(o.own,0)) AS usn FROM b CROSS JOIN tm_langs l LEFT JOIN o ON o.file_id=b.file_id AND o.language=l.language""")
def high_usn(tm):
    return report.high_usn(report.with_usn(tm))


@query(f"WITH {LIVE} SELECT x.file_id, l.language, count(DISTINCT x.item_id) AS units FROM live x JOIN tm_files f ON f.file_id=x.file_id AND f.orphaned=0 CROSS JOIN tm_langs l WHERE NOT regexp_matches(x.source, '^[0-9]+$') GROUP BY ALL")
def ts_item_count(tm):
    rows = report.live(tm).where(~F.col("source").rlike("^[0-9]+$")).join(report.file_language_grid(tm).select("file_id", "language"), "file_id")
    return rows.groupBy("file_id", "language").agg(F.count_distinct("item_id").alias("units"))


@query("SELECT f.file_id, f.namespace, f.path, l.language FROM tm_files f CROSS JOIN tm_langs l WHERE f.orphaned=0")
def file_language_grid(tm):
    return report.file_language_grid(tm)


@query("SELECT 'namespace' AS kind, namespace AS name FROM tm_files GROUP BY ALL UNION ALL SELECT 'language', language FROM tm_translations WHERE string IS NOT NULL GROUP BY ALL")
def catalog(tm):
    a = tm["files"].select(F.lit("namespace").alias("kind"), F.col("namespace").alias("name")).distinct()
    return a.union(tm["translations"].where("string is not null").select(F.lit("language"), "language").distinct())


@query("SELECT x.language FROM (VALUES ('de'),('xx'),('fr'),('yy')) x(language) WHERE x.language NOT IN (SELECT language FROM tm_translations)")
def validate_values(tm):
    asked = tm["spark"].createDataFrame([("de",), ("xx",), ("fr",), ("yy",)], "language string")
    return asked.join(tm["translations"].select("language"), "language", "left_anti")


@query("SELECT count(*) FILTER (WHERE (item_id%7)=0) AS n, count(*) AS rows FROM tm_translations")
def merge_flag_count(tm):
    return tm["translations"].withColumn("merge", (F.col("item_id") % 7 == 0).cast("int")).agg(F.count_if(F.col("merge") == 1).alias("n"), F.count("*").alias("rows"))


@query(f"WITH {LIVE} SELECT namespace, path, x.item_id FROM live x JOIN tm_files f ON f.file_id=x.file_id")
def export_order(tm):
    return report.live(tm).join(tm["files"].select("file_id", "namespace", "path"), "file_id").select("namespace", "path", "item_id").orderBy("namespace", "path", "item_id")


@query("SELECT t.language, s.string AS source, s.context, i.item_id, f.namespace, f.path FROM tm_translations t JOIN tm_items i USING (item_id) JOIN tm_strings s ON s.string_id=i.string_id JOIN tm_files f ON f.file_id=i.file_id")
def report_order(tm):
    t = tm["translations"].select("item_id", "language").join(tm["items"].select("item_id", "string_id", "file_id"), "item_id").join(tm["strings"].select("string_id", F.col("string").alias("source"), "context"), "string_id").join(tm["files"].select("file_id", "namespace", "path"), "file_id")
    return t.select("language", "source", "context", "item_id", "namespace", "path").repartition("language").sortWithinPartitions("language", "source", "context", "item_id", "namespace", "path")


IMPORT = """src AS (SELECT 'f' || (o_orderkey%50) AS path, 'k' || o_orderkey AS key, CASE WHEN o_orderkey%41=0 THEN '' ELSE o_orderpriority END AS string FROM orders
UNION ALL SELECT 'f' || (o_orderkey%50), 'k' || o_orderkey, o_orderpriority FROM orders WHERE o_orderkey%37=0),
loc AS (SELECT 'f' || (o_orderkey%52) AS path, CASE WHEN o_orderkey%2=0 THEN 'de' ELSE 'fr' END AS language, 'k' || o_orderkey AS key, l_linenumber AS pos,
CASE WHEN o_orderkey%5=0 THEN '' WHEN o_orderkey%7=0 THEN o_orderpriority WHEN o_orderkey%11=0 THEN l_returnflag ELSE 'x' || o_orderpriority END AS target FROM orders JOIN lineitem ON l_orderkey=o_orderkey WHERE l_linenumber<=1+o_orderkey%2)"""
STATUS = f"""{IMPORT}, s AS (SELECT path, key, min(string) AS source, count(*) AS n_source FROM src GROUP BY ALL),
x AS (SELECT l.*, s.source, s.n_source, l.path IN (SELECT path FROM src) AS has_file, row_number() OVER w AS nth, lag(l.target) OVER w AS before FROM loc l LEFT JOIN s ON s.path=l.path AND s.key=l.key WINDOW w AS (PARTITION BY l.path, l.language, l.key ORDER BY l.pos, l.target)),
st AS (SELECT path, language, key, pos, source, target, CASE WHEN NOT has_file THEN 'FILE_MISSING' WHEN source IS NULL THEN 'UNKNOWN_KEY' WHEN n_source>1 THEN 'DUPLICATE_KEY' WHEN source='' THEN 'EMPTY_SOURCE' WHEN nth>1 AND before=target THEN 'DUPLICATE_KEY_W' WHEN nth>1 THEN 'MULTIPLE_TRANSLATIONS' WHEN target='' THEN 'EMPTY_TRANSLATION' WHEN source=target THEN 'SAME_TRANSLATION' ELSE 'OK' END AS st FROM x),
fin AS (SELECT path, language, key, pos, source, target, replace(st,'_W','') AS status, CASE WHEN st IN ('DUPLICATE_KEY_W','EMPTY_TRANSLATION') THEN 'warning' WHEN st='SAME_TRANSLATION' THEN 'notice' WHEN st='OK' THEN 'ok' ELSE 'error' END AS severity FROM st)"""


def imported(tm):
    o, li = (tm["spark"].read.parquet(f"{tm['dir']}/{t}.parquet") for t in ("orders", "lineitem"))
    tables = {"orders": o, "lineitem": li}
    src = tm["spark"].sql("""SELECT concat('f', o_orderkey%50) AS path, concat('k', o_orderkey) AS key, CASE WHEN o_orderkey%41=0 THEN '' ELSE o_orderpriority END AS string FROM {orders}
UNION ALL SELECT concat('f', o_orderkey%50), concat('k', o_orderkey), o_orderpriority FROM {orders} WHERE o_orderkey%37=0""", orders=o)
    loc = tm["spark"].sql("""SELECT concat('f', o_orderkey%52) AS path, CASE WHEN o_orderkey%2=0 THEN 'de' ELSE 'fr' END AS language, concat('k', o_orderkey) AS key, l_linenumber AS pos,
CASE WHEN o_orderkey%5=0 THEN '' WHEN o_orderkey%7=0 THEN o_orderpriority WHEN o_orderkey%11=0 THEN l_returnflag ELSE concat('x', o_orderpriority) END AS target FROM {orders} JOIN {lineitem} ON l_orderkey=o_orderkey WHERE l_linenumber<=1+o_orderkey%2""", **tables)
    return src, loc


@query(f"WITH {STATUS} SELECT * FROM fin")
def import_align(tm):
    return report.import_status(*imported(tm))


@query(f"WITH {STATUS} SELECT language, status, severity, count(*) AS n FROM fin WHERE severity<>'ok' GROUP BY ALL")
def import_report(tm):
    return report.import_report(report.import_status(*imported(tm)))


@query(f"WITH {STATUS} SELECT language, count(DISTINCT path) AS files, count(*) FILTER (WHERE severity='notice') AS notices, count(*) FILTER (WHERE severity='warning') AS warnings, count(*) FILTER (WHERE severity='error') AS errors FROM fin GROUP BY ALL")
def import_stats(tm):
    return report.import_stats(report.import_status(*imported(tm)))


@query(f"WITH {IMPORT} SELECT path, key, language FROM loc l WHERE NOT EXISTS (SELECT 1 FROM src s WHERE s.path=l.path AND s.key=l.key)")
def unknown_keys(tm):
    src, loc = imported(tm)
    return loc.join(src, ["path", "key"], "left_anti").select("path", "key", "language")


@query(f"WITH {IMPORT} SELECT path, key, string, row_number() OVER (PARTITION BY path, key ORDER BY string) AS nth, CASE WHEN row_number() OVER (PARTITION BY path, key ORDER BY string)=1 THEN key ELSE key || '.' || row_number() OVER (PARTITION BY path, key ORDER BY string) END AS unique_key FROM src")
def duplicate_keys(tm):
    src, _ = imported(tm)
    n = reuse.numbered(src, ["path", "key"], ["string"], "nth")
    return n.withColumn("unique_key", F.when(F.col("nth") == 1, F.col("key")).otherwise(F.concat_ws(".", "key", F.col("nth").cast("string"))))


NEW = "new AS (SELECT item_id, language, CASE WHEN item_id%3=0 THEN '' WHEN item_id%3=1 THEN string ELSE string || '?' END AS string, '' AS comment, fuzzy, 0 AS merge FROM tm_translations WHERE item_id%10<4 UNION ALL SELECT item_id, 'es', 'nuevo', '', 0, 0 FROM tm_items WHERE item_id%17=0)"


def new_rows(tm):
    t = tm["translations"].where("item_id % 10 < 4")
    text = F.when(F.col("item_id") % 3 == 0, "").when(F.col("item_id") % 3 == 1, F.col("string")).otherwise(F.concat("string", F.lit("?")))
    a = t.select("item_id", "language", text.alias("string"), F.lit("").alias("comment"), "fuzzy", F.lit(0).alias("merge"))
    return a.union(tm["items"].where("item_id % 17 = 0").select("item_id", F.lit("es"), F.lit("nuevo"), F.lit(""), F.lit(0), F.lit(0)))


UPSERT = f"""{NEW}, n AS (SELECT item_id, language, nullif(string,'') AS string, nullif(comment,'') AS comment, fuzzy, merge FROM new),
up AS (SELECT coalesce(n.item_id,o.item_id) AS item_id, coalesce(n.language,o.language) AS language, CASE WHEN n.item_id IS NULL THEN o.string ELSE n.string END AS string, CASE WHEN n.item_id IS NULL THEN o.comment ELSE n.comment END AS comment,
CASE WHEN n.item_id IS NULL THEN o.fuzzy ELSE n.fuzzy END AS fuzzy, CASE WHEN n.item_id IS NULL THEN o.merge ELSE n.merge END AS merge,
CASE WHEN o.item_id IS NULL THEN 'insert' WHEN n.item_id IS NOT NULL AND (n.string IS DISTINCT FROM o.string OR n.comment IS DISTINCT FROM o.comment OR n.fuzzy<>o.fuzzy OR n.merge<>o.merge) THEN 'update' ELSE 'none' END AS change
FROM tm_translations o FULL JOIN n ON n.item_id=o.item_id AND n.language=o.language)"""


@query(f"WITH {UPSERT} SELECT * FROM up")
def upsert_translation(tm):
    return change.upsert_translations(tm["translations"], new_rows(tm))


@query(f"WITH {UPSERT} SELECT item_id, language, change, 1000 + row_number() OVER (ORDER BY md5(item_id::VARCHAR || chr(1) || language)) AS usn FROM up WHERE change<>'none'")
def assign_usn(tm):
    x = change.upsert_translations(tm["translations"], new_rows(tm)).where("change <> 'none'")
    return change.assign_usn(x.select("item_id", "language", "change"), 1000)


@query("""WITH u AS (SELECT DISTINCT CASE WHEN string_id%3=0 THEN string ELSE string || ' new' END AS string, context FROM tm_strings), k AS (SELECT string, context, md5(string || chr(1) || coalesce(context,'')) AS k FROM u)
SELECT (SELECT max(string_id) FROM tm_strings) + row_number() OVER (ORDER BY k) AS string_id, string, context FROM k WHERE k NOT IN (SELECT md5(string || chr(1) || coalesce(context,'')) FROM tm_strings)""")
def upsert_units(tm):
    units = tm["strings"].select(F.when(F.col("string_id") % 3 == 0, F.col("string")).otherwise(F.concat("string", F.lit(" new"))).alias("string"), "context")
    return change.upsert_units(tm["strings"], units)


@query("SELECT item_id, language, string, CASE WHEN item_id%9=0 AND string IS NOT NULL THEN 1 ELSE fuzzy END AS fuzzy FROM tm_translations")
def comment_to_item(tm):
    said = tm["items"].select("item_id", F.when(F.col("item_id") % 9 == 0, "@ see the manual").otherwise("just a remark").alias("comment"))
    return change.comment_to_item(tm, said)


@query("""WITH changes AS (SELECT t.item_id, t.language, CASE WHEN t.item_id%2=0 THEN 'new text' END AS target, 1 AS as_fuzzy FROM tm_translations t WHERE t.item_id%500=7),
x AS (SELECT i.item_id, s.string AS source FROM tm_items i JOIN tm_strings s USING (string_id)),
hit AS (SELECT o.item_id, o.language, o.comment, coalesce(c.target,'') AS new, row_number() OVER (PARTITION BY o.item_id, o.language ORDER BY c.item_id DESC, coalesce(c.target,'') DESC) AS rn
FROM tm_translations o JOIN x ON x.item_id=o.item_id JOIN x y ON y.source=x.source JOIN changes c ON c.item_id=y.item_id AND c.language=o.language
WHERE o.item_id<>c.item_id AND CASE WHEN coalesce(c.target,'')='' THEN o.string IS NOT NULL ELSE coalesce(o.string,'')<>c.target END)
SELECT o.item_id, o.language, CASE WHEN h.item_id IS NULL THEN o.string ELSE nullif(h.new,'') END AS string, CASE WHEN h.item_id IS NULL THEN o.comment WHEN h.new='' THEN 'Translation removed' ELSE h.comment END AS comment,
CASE WHEN h.item_id IS NULL THEN o.fuzzy WHEN h.new='' THEN 0 ELSE 1 END AS fuzzy, CASE WHEN h.item_id IS NULL THEN o.merge ELSE 1 END AS merge FROM tm_translations o LEFT JOIN hit h ON h.item_id=o.item_id AND h.language=o.language AND h.rn=1""")
def apply_rewrite_all(tm):
    changed = tm["translations"].where("item_id % 500 = 7").select("item_id", "language", F.expr("CASE WHEN item_id % 2 = 0 THEN 'new text' END").alias("target"), F.lit(1).alias("as_fuzzy"))
    return change.apply(tm["translations"], reuse.rewrite_all(tm, changed))


@query("SELECT t.item_id, t.language, '  ' || t.string AS old, t.string AS new FROM tm_translations t JOIN tm_items i ON i.item_id=t.item_id AND i.orphaned=0 WHERE t.string IS NOT NULL AND t.item_id%4=0")
def fit_all_whitespace(tm):
    t = tm["translations"].withColumn("string", F.when(F.col("item_id") % 4 == 0, F.concat(F.lit("  "), "string")).otherwise(F.col("string")))
    return change.fit_all_whitespace(tm | {"translations": t})


@query("SELECT language, sum(0)::BIGINT AS merge, count(*) AS n FROM tm_translations GROUP BY ALL")
def clear_merge(tm):
    t = tm["translations"].withColumn("merge", F.lit(1))
    return change.clear_merge(t).groupBy("language").agg(F.sum("merge").alias("merge"), F.count("*").alias("n"))


FILES = "known AS (SELECT path, orphaned FROM tm_files), found AS (SELECT CASE WHEN file_id%7=0 THEN path || '.new' ELSE path END AS path FROM tm_files WHERE file_id%11<>0)"
DIFF = f"{FILES}, d AS (SELECT coalesce(k.path,f.path) AS path, CASE WHEN k.path IS NULL THEN 'new' WHEN f.path IS NULL THEN CASE WHEN k.orphaned=1 THEN 'gone' ELSE 'orphaned' END WHEN k.orphaned=1 THEN 'revived' ELSE 'kept' END AS state FROM known k FULL JOIN found f ON f.path=k.path)"


def diffed(tm):
    found = tm["files"].where("file_id % 11 <> 0").select(F.when(F.col("file_id") % 7 == 0, F.concat("path", F.lit(".new"))).otherwise(F.col("path")).alias("path"))
    return change.file_diff(tm["files"], found)


@query(f"WITH {DIFF} SELECT * FROM d")
def file_diff(tm):
    return diffed(tm)


@query(f"WITH {DIFF} SELECT state, count(*) AS n FROM d GROUP BY ALL")
def file_delta(tm):
    return diffed(tm).groupBy("state").agg(F.count("*").alias("n"))


@query(f"WITH {DIFF}, h AS (SELECT path, state, replace(path,'.new','') AS base FROM d) SELECT o.path AS old_path, n.path AS new_path FROM h o JOIN h n ON n.base=o.base WHERE o.state IN ('orphaned','gone') AND n.state='new'")
def rename_detect(tm):
    d = diffed(tm).withColumn("base", F.replace("path", F.lit(".new"), F.lit(""))).select("path", "state", F.length("base").alias("size"), F.md5("base").alias("hash"))
    return change.renames(d.where("state in ('orphaned', 'gone')"), d.where("state = 'new'"))


@query("SELECT item_id, CASE WHEN item_id%3=0 THEN 1 ELSE 0 END AS orphaned, CASE WHEN (CASE WHEN item_id%3=0 THEN 1 ELSE 0 END)<>orphaned THEN 1 ELSE 0 END AS changed FROM tm_items WHERE file_id IN (SELECT file_id FROM tm_items WHERE item_id%3<>0 AND file_id%4<>0)")
def item_orphans(tm):
    return change.item_orphans(tm["items"], tm["items"].where("item_id % 3 <> 0 and file_id % 4 <> 0"))


@query("WITH s AS (SELECT item_id FROM tm_items WHERE item_id%3<>0 AND file_id%4<>0) SELECT orphaned_now, count(*) AS n FROM (SELECT CASE WHEN file_id IN (SELECT file_id FROM tm_items WHERE item_id%3<>0 AND file_id%4<>0) THEN CASE WHEN item_id IN (SELECT item_id FROM s) THEN 0 ELSE 1 END ELSE orphaned END AS orphaned_now FROM tm_items) GROUP BY ALL")
def orphan_update(tm):
    new = change.item_orphans(tm["items"], tm["items"].where("item_id % 3 <> 0 and file_id % 4 <> 0")).select("item_id", F.col("orphaned").alias("now"))
    return tm["items"].join(new, "item_id", "left").select(F.coalesce("now", "orphaned").alias("orphaned_now")).groupBy("orphaned_now").agg(F.count("*").alias("n"))


@query("""SELECT u.item_id, u.language, CASE WHEN s.skip IS NULL THEN 'no_item' WHEN s.skip=1 THEN 'skipped' WHEN u.item_id%13=0 THEN 'clear_merge' WHEN u.item_id%5=0 THEN 'write' ELSE 'same' END AS action
FROM (SELECT CASE WHEN item_id%19=0 THEN -item_id ELSE item_id END AS item_id, language, string FROM tm_translations WHERE string IS NOT NULL) u LEFT JOIN tm_items i ON i.item_id=u.item_id LEFT JOIN tm_strings s ON s.string_id=i.string_id""")
def merge_guard(tm):
    t = tm["translations"].where("string is not null")
    units = t.select(F.when(F.col("item_id") % 19 == 0, -F.col("item_id")).otherwise(F.col("item_id")).alias("item_id"), "language", F.when(F.col("item_id") % 5 == 0, F.concat("string", F.lit("~"))).otherwise(F.col("string")).alias("target"), F.lit("").alias("comment"), "fuzzy")
    return change.merge_guard(units, tm | {"translations": tm["translations"].withColumn("merge", (F.col("item_id") % 13 == 0).cast("int"))})


@query("""SELECT f.file_id, l.language FROM tm_files f CROSS JOIN tm_langs l WHERE f.orphaned=0 AND NOT regexp_matches(f.path, '5\\.prop') AND (regexp_matches(f.namespace,'^ns[0-2]$') AND l.language<>'ja' OR NOT regexp_matches(f.namespace,'^ns[0-2]$') AND l.language='ja')""")
def rule_filter(tm):
    x = report.file_language_grid(tm)
    ns, path, lang = F.col("namespace"), F.col("path"), F.col("language")
    keep = rules.rule_filter([([rules.matches(path, [r"5\.prop"])], False), ([rules.matches(ns, ["^ns[0-2]$"]), rules.matches(lang, ["^ja$"], True)], True), ([rules.matches(ns, ["^ns[0-2]$"], True), rules.matches(lang, ["^ja$"])], True)])
    return x.where(keep).select("file_id", "language")


@query("SELECT file_id, CASE WHEN namespace='ns1' THEN 'x' ELSE 'a,x' END AS flags, CASE WHEN namespace='ns1' THEN false ELSE true END AS has_both, regexp_extract(path,'#0*([0-9]+)',1) AS captured FROM tm_files")
def rule_flags(tm):
    flags = rules.rule_flags(F.array(F.lit("a"), F.lit("x")), F.col("namespace") == "ns1", ["x"], ["a"])
    return tm["files"].select("file_id", F.array_join(flags, ",").alias("flags"), rules.has_flags(flags, ["a", "x"], "all").alias("has_both"), F.regexp_extract("path", "#0*([0-9]+)", 1).alias("captured"))


@query("SELECT file_id, CASE WHEN file_id%2=0 AND namespace<>'ns0' THEN 1 ELSE 0 END AS can_process, 0 AS is_orphaned, CASE WHEN file_id%2=0 OR namespace='ns0' THEN 1 ELSE 0 END AS any_vote FROM tm_files")
def can_gates(tm):
    a, b = F.col("file_id") % 2 == 0, F.col("namespace")
    return tm["files"].select("file_id", rules.combine_and([a, b != "ns0"]).cast("int").alias("can_process"), rules.combine_and([], None).cast("int").alias("is_orphaned"), rules.combine_or([a, b == "ns0"]).cast("int").alias("any_vote"))


@query("SELECT file_id, namespace, l.language, CASE WHEN l.language IS NULL THEN 1 ELSE 0 END AS orphaned FROM tm_files f LEFT JOIN tm_langs l ON CASE f.file_id%4 WHEN 0 THEN l.language IN ('de') WHEN 1 THEN l.language IN ('de','ja') WHEN 2 THEN false ELSE l.language IN ('fr','ja','pt-br','de') AND l.language<>'de' END")
def limit_languages(tm):
    job = F.array(*[F.lit(x) for x in ("de", "fr", "ja", "pt-br")])
    content = F.expr("CASE file_id%4 WHEN 0 THEN 'x L10N_LIMIT=de y' WHEN 1 THEN 'L10N_LIMIT=de, L10N_LIMIT=ja ' WHEN 2 THEN 'L10N_LIMIT=xx' ELSE 'L10N_EXCLUDE=de' END")
    limited, excluded = rules.gather(content, r"L10N_LIMIT=([\w-]+)"), rules.gather(content, r"L10N_EXCLUDE=([\w-]+)")
    langs = rules.limit_languages(job, [("limit", limited), ("exclude", excluded)])
    return rules.file_languages(tm["files"].select("file_id", "namespace"), langs)


@query("SELECT file_id, 'de,en,ja' AS destination, CASE WHEN file_id%2=0 THEN 'de' ELSE '' END AS modified FROM tm_files")
def language_sets(tm):
    job = F.array(*[F.lit(x) for x in ("ja", "de", "de", "fr")])
    x = rules.language_sets(job, "en", F.when(F.col("file_id") % 2 == 0, F.array(F.lit("de"), F.lit("xx"))).otherwise(F.array(F.lit("fr"))), ["de", "ja", "en"], True)
    return tm["files"].select("file_id", F.array_join(x["destination"], ",").alias("destination"), F.array_join(x["modified"], ",").alias("modified"))


@query(f"WITH {LIVE} SELECT file_id, count(*) AS n FROM live GROUP BY ALL")
def drop_skipped(tm):
    return report.live(tm).groupBy("file_id").agg(F.count("*").alias("n"))


@query("SELECT i.item_id, s.string<>'' AS extract, s.string<>'' AND NOT regexp_matches(s.string,'^[A-M]') AS translate FROM tm_items i JOIN tm_strings s USING (string_id)")
def translatable_units(tm):
    x = tm["items"].join(tm["strings"], "string_id")
    can = F.col("string") != ""
    return x.select("item_id", can.alias("extract"), rules.combine_and([can, ~F.col("string").rlike("^[A-M]")]).alias("translate"))


@query("""WITH m AS (SELECT md5(f.path || chr(1) || s.string || chr(1) || coalesce(s.context,'')) AS k FROM tm_items i JOIN tm_strings s USING (string_id) JOIN tm_files f ON f.file_id=i.file_id WHERE i.item_id%3=0)
SELECT i.item_id FROM tm_items i JOIN tm_strings s USING (string_id) JOIN tm_files f ON f.file_id=i.file_id WHERE md5(f.path || chr(1) || s.string || chr(1) || coalesce(s.context,'')) NOT IN (SELECT k FROM m)""")
def feature_branch_extract(tm):
    x = tm["items"].join(tm["strings"], "string_id").join(tm["files"].select("file_id", "path"), "file_id").withColumn("k", fx.tuple_hash(F.col("path"), F.col("string"), F.col("context")))
    return x.join(x.where("item_id % 3 = 0").select("k"), "k", "left_anti").select("item_id")


@query("""SELECT t.item_id, t.language, CASE WHEN t.item_id%3=0 AND t.fuzzy=0 AND t.string IS NOT NULL THEN 'master:' || t.string ELSE t.string END AS target FROM tm_translations t""")
def feature_branch_overlay(tm):
    master = tm["translations"].where("item_id % 3 = 0 and fuzzy = 0").select("item_id", "language", F.concat(F.lit("master:"), "string").alias("m"))
    return tm["translations"].join(master, ["item_id", "language"], "left").select("item_id", "language", F.coalesce("m", "string").alias("target"))


@query("SELECT 'out/' || l.language || '/' || f.path || '.x' AS path FROM tm_files f CROSS JOIN tm_langs l WHERE f.file_id%3=0")
def orphan_ts_files(tm):
    path = lambda df: df.select(F.concat(F.lit("out/"), "language", F.lit("/"), "path").alias("path"))
    want = path(tm["files"].crossJoin(F.broadcast(tm["langs"])))
    disk = want.union(path(tm["files"].where("file_id % 3 = 0").withColumn("path", F.concat("path", F.lit(".x"))).crossJoin(F.broadcast(tm["langs"]))))
    return disk.join(want, "path", "left_anti")


@query("SELECT f.file_id, l.language, concat_ws(',', CASE WHEN f.file_id%2=0 THEN 'usn' END, CASE WHEN f.file_id%3=0 THEN 'hash' END, CASE WHEN l.lang_ord=1 THEN 'missing' END) AS reason FROM tm_files f CROSS JOIN tm_langs l WHERE f.file_id%2=0 OR f.file_id%3=0 OR l.lang_ord=1")
def stale_targets(tm):
    from tmweave.streaming import incremental

    grid = tm["files"].crossJoin(F.broadcast(tm["langs"])).select("file_id", "language", "lang_ord", F.col("file_id").alias("usn"), F.md5("path").alias("hash"))
    old = grid.where("lang_ord <> 1").select("file_id", "language", F.when(F.col("file_id") % 2 == 0, F.col("usn") - 1).otherwise(F.col("usn")).alias("usn"), F.when(F.col("file_id") % 3 == 0, F.lit("x")).otherwise(F.col("hash")).alias("hash"))
    new = incremental.stale(grid.drop("lang_ord"), old, ["file_id", "language"], ["usn", "hash"])
    one = new.join(grid.select("file_id", "language", "lang_ord"), ["file_id", "language"])
    return one.select("file_id", "language", F.concat_ws(",", F.when(F.col("file_id") % 2 == 0, "usn"), F.when(F.col("file_id") % 3 == 0, "hash"), F.when(F.array_contains("reason", "missing"), "missing")).alias("reason"))


@query("SELECT t, n FROM (SELECT 'files' AS t, count(*) AS n FROM tm_files UNION ALL SELECT 'items', count(*) FROM tm_items UNION ALL SELECT 'langs', count(*) FROM tm_langs UNION ALL SELECT 'strings', count(*) FROM tm_strings UNION ALL SELECT 'translations', count(*) FROM tm_translations)")
def tm_copy(tm):
    from tmweave.sources import folders

    tables = {k: v for k, v in tm.items() if k in ("files", "items", "langs", "strings", "translations")}
    return memory.counts(memory.copy_tables(tables, folders.new_path(tm["spark"], "copy"))).select(F.col("table").alias("t"), F.col("rows").alias("n"))
