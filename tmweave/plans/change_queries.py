"""Registered queries of versioned tables, upserts, segments and phases, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tmweave.functions import text as fx
from tmweave.operators import change, reuse, segments
from tmweave.operators.phases import Phases
from tmweave.plans.corpus_queries import ORACLES as CORPUS
from tmweave.plans.corpus_queries import WRITES, stream
from tmweave.plans.memory_queries import ORACLES as MEMORY
from tmweave.sources import folders, memory
from tmweave.streaming import versions

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(CORPUS["latest_translation_stream"])
def latest_translation_versions(spark, d):
    """A stream of writes merged into a keyed table, which is read at its newest version."""
    table = versions.KeyedTable(spark, folders.new_path(spark, "latest"), "item_id bigint, language string, usn bigint, string string, fuzzy int", ["item_id", "language"], ["usn", "string", "fuzzy"], 8)
    table.follow(stream(spark, d, "lineitem").selectExpr(*[x.strip() for x in WRITES.split(", ")]), folders.new_path(spark, "latest-progress"))
    return table.read()


@query(MEMORY["best_translation"])
def reuse_versions_stream(spark, d):
    """A stream of translations merged into the memory, and a stream of targets looked up in it."""
    tm = memory.derived(spark, d)
    came, asked = folders.new_path(spark, "came"), folders.new_path(spark, "asked")
    columns = ["item_id", "language", "translation_id", "string", "comment", "fuzzy", "merge"]
    tm["translations"].select(*columns).write.parquet(came)
    reuse.missing(tm).write.parquet(asked)
    table = versions.KeyedTable(spark, folders.new_path(spark, "memory"), spark.read.parquet(came).schema, ["item_id", "language"], ["translation_id"], 8)
    table.follow(spark.readStream.schema(table.schema).parquet(came), folders.new_path(spark, "memory-progress"))
    targets = spark.readStream.schema(spark.read.parquet(asked).schema).parquet(asked)
    return versions.reuse_as_it_moves(targets, lambda: reuse.candidates(tm | {"translations": table.read()}), folders.new_path(spark, "reused"), folders.new_path(spark, "reuse-progress"))


@query(r"""SELECT doc_id::VARCHAR AS key, '[' || regexp_replace(text, '(\n{2,}|\n\z|\A\n)', ']\1[', 'g') || ']' AS string FROM documents WHERE text IS NOT NULL""")
def segment_roundtrip(spark, d):
    """Each document's segments in brackets, joined again with what stood between them."""
    docs = spark.read.parquet(f"{d}/documents.parquet").where("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("key"), F.col("text").alias("string"))
    return segments.join(segments.cut(docs).withColumn("string", F.concat(F.lit("["), "string", F.lit("]"))), ["key"])


UNITS = """SELECT f.namespace, f.job, CASE WHEN f.file_id % 10 = 3 THEN concat(f.path, '.v2') ELSE f.path END AS path, i.item_id AS pos, CASE WHEN s.string_id % 5 = 0 THEN concat(s.string, ' again') ELSE s.string END AS string, s.context,
 CASE WHEN i.item_id % 3 = 0 THEN '' ELSE 'hint' END AS hint FROM {items} i JOIN {files} f ON f.file_id = i.file_id JOIN {strings} s ON s.string_id = i.string_id"""


@query(memory.with_sql(f"""WITH u AS ({UNITS.replace('{items}', 'tm_items').replace('{files}', 'tm_files').replace('{strings}', 'tm_strings')}),
nf AS (SELECT namespace, job, path, (SELECT max(file_id) FROM tm_files) + row_number() OVER (ORDER BY md5(concat_ws(chr(1), namespace, job, path))) AS id FROM (SELECT DISTINCT namespace, job, path FROM u) x WHERE NOT EXISTS (SELECT 1 FROM tm_files f WHERE f.namespace=x.namespace AND f.job=x.job AND f.path=x.path)),
fs AS (SELECT file_id AS id, namespace, job, path, 'none' AS change FROM tm_files UNION ALL SELECT id, namespace, job, path, 'insert' FROM nf),
ns AS (SELECT string, context, (SELECT max(string_id) FROM tm_strings) + row_number() OVER (ORDER BY md5(string || chr(1) || coalesce(context,''))) AS id FROM (SELECT DISTINCT string, context FROM u) x WHERE NOT EXISTS (SELECT 1 FROM tm_strings s WHERE s.string=x.string AND s.context IS NOT DISTINCT FROM x.context)),
ss AS (SELECT string_id AS id, string, context, 'none' AS change FROM tm_strings UNION ALL SELECT id, string, context, 'insert' FROM ns),
said AS (SELECT fs.id AS file_id, ss.id AS string_id, nullif(arg_max(u.hint, u.pos),'') AS hint FROM u JOIN fs ON fs.namespace=u.namespace AND fs.job=u.job AND fs.path=u.path JOIN ss ON ss.string=u.string AND ss.context IS NOT DISTINCT FROM u.context GROUP BY ALL),
have AS (SELECT item_id, file_id, string_id, CASE WHEN item_id%2=0 THEN 'hint' END AS hint FROM tm_items),
its AS (SELECT h.item_id AS id, h.file_id, h.string_id, CASE WHEN s.file_id IS NULL THEN h.hint ELSE s.hint END AS hint, CASE WHEN s.file_id IS NOT NULL AND s.hint IS DISTINCT FROM h.hint THEN 'update' ELSE 'none' END AS change FROM have h LEFT JOIN said s ON s.file_id=h.file_id AND s.string_id=h.string_id
 UNION ALL SELECT (SELECT max(item_id) FROM have) + row_number() OVER (ORDER BY md5(s.file_id || ':' || s.string_id)), s.file_id, s.string_id, s.hint, 'insert' FROM said s WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.file_id=s.file_id AND h.string_id=s.string_id))
SELECT 'file' AS what, id, path AS a, namespace AS b, change FROM fs UNION ALL SELECT 'string', id, string, context, change FROM ss UNION ALL SELECT 'item', id, file_id || ':' || string_id, hint, change FROM its"""))
def upsert_memory(spark, d):
    """All three tables after units of which some bring new files, texts and hints."""
    tm = memory.derived(spark, d)
    tm["items"] = tm["items"].withColumn("hint", F.expr("CASE WHEN item_id % 2 = 0 THEN 'hint' END"))
    out = change.upsert_memory(tm, spark.sql(UNITS, items=tm["items"], files=tm["files"], strings=tm["strings"]))
    row = lambda df, what, i, a, b: df.select(F.lit(what).alias("what"), F.col(i).alias("id"), a.alias("a"), F.col(b).alias("b"), "change")
    item = F.concat_ws(":", F.col("file_id").cast("string"), F.col("string_id").cast("string"))
    return row(out["files"], "file", "file_id", F.col("path"), "namespace").union(row(out["strings"], "string", "string_id", F.col("string"), "context")).union(row(out["items"], "item", "item_id", item, "hint"))


@query(r"""WITH p AS (SELECT p_partkey, p_name, p_type, p_brand, p_partkey % 4 AS m FROM part),
s AS (SELECT p_partkey::VARCHAR AS path, CASE m WHEN 3 THEN '' ELSE p_name END AS name, p_type, p_brand, m FROM p WHERE m <> 2)
SELECT path, 'k' AS key, language, CASE WHEN m = 3 THEN '<' || language || ':' || p_type || ' {' || p_brand || '}>' ELSE '<' || language || ':' || name || '>' || chr(10) || chr(10) || '<' || CASE WHEN m = 1 AND language = 'de' THEN 'eigen' ELSE language || ':' || p_type || ' {' || p_brand || '}' END || '>' END AS target,
 CASE WHEN m = 1 AND language = 'de' THEN 1 ELSE 0 END AS fuzzy FROM s, (VALUES ('de'), ('fr')) l(language)""")
def phased_translation(spark, d):
    """Placeholders masked, texts cut at empty lines, a provider of its own for some, translated by a memory, joined and unmasked."""
    content = "CASE WHEN p_partkey % 4 = 3 THEN concat(p_type, ' {', p_brand, '}') ELSE concat(p_name, '\\n\\n', p_type, ' {', p_brand, '}') END"
    units = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").cast("string").alias("path"), F.lit("k").alias("key"), F.expr(content).alias("source"), F.lit("").alias("context"), F.lit("").alias("hint"))
    braces = r"\{.*?\}"
    plan = Phases().on("can_extract", lambda u: F.col("path").cast("long") % 4 != 2)
    plan.on("rewrite_source", lambda s, _: (fx.placeholder_mask(s, braces), fx.placeholders(s, braces)), state="hidden").on("rewrite_translation", lambda t, found: fx.placeholder_unmask(t, found), state="hidden")
    plan.on("segment_source", lambda: (segments.PARAGRAPHS, False))
    own = lambda rows: rows.where("language = 'de' AND n = 2 AND CAST(path AS BIGINT) % 4 = 1").select("path", "segment_key", "language", F.lit("<eigen>").alias("target"), F.lit(1).alias("fuzzy"))
    plan.on("get_translation_pre", own)
    langs = spark.createDataFrame([("de",), ("fr",)], "language string")
    return plan.translate(units, langs, lambda rows: rows.select("path", "segment_key", "language", F.concat(F.lit("<"), "language", F.lit(":"), "source", F.lit(">")).alias("target"), F.lit(0).alias("fuzzy")))
