"""Plans that must not grow with their input: what is shuffled, joined or computed again, and by how many partitions."""

import re
import tempfile

from pyspark.sql import functions as F

from tmweave.llm import fingerprints, mixing
from tmweave.operators import exchange, markup, segments
from tmweave.operators.phases import Phases
from tmweave.plans import corpus_queries, markup_queries


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def files(spark, n=40, size=40_000):
    return spark.range(n).select(F.col("id").cast("string").alias("path"), F.repeat(F.lit("x"), size).alias("content"))


def dealt(df):
    """How many partitions the only shuffle of a plan has."""
    text = plan(df)
    assert text.count("Exchange ") == 1, text
    return int(re.search(r"Exchange hashpartitioning\(path#\d+, (\d+)\)", text)[1])


def test_rrc_keys_of_letters(spark):
    d = tempfile.mkdtemp(prefix="tmweave-")
    spark.createDataFrame([(1, "42 no\nab yes\na_1 no\nc2 no\nÈ no")], "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    assert [tuple(r) for r in corpus_queries.extract_rrc(spark, d).collect()] == [("1", 1, "ab#0", "yes", "ab#0")]


def test_xliff_joins_nothing(spark):
    for df in (markup.xliff_source(files(spark)), markup.xliff_import(files(spark))):
        assert "Join" not in plan(df)
        assert dealt(df) == 4


def test_blocks_are_dealt_by_content(spark):
    assert dealt(markup.html_blocks(files(spark))) == 4
    assert dealt(markup.html_blocks(files(spark, 80))) == 7
    # a page without content is still one
    assert markup.html_pieces(spark.createDataFrame([("a", None)], "path string, content string")).count() == 1


def test_pages_without_content_are_dealt_too(spark):
    empty = spark.range(100_000).select(F.col("id").cast("string").alias("path"), F.lit(None).cast("string").alias("content"))
    assert dealt(markup.html_blocks(empty)) == 4


def rows_dealt(spark, query, table, key, rows=25_000):
    """Over how many partitions the rows of a table are dealt before a query makes files of them."""
    d = tempfile.mkdtemp(prefix="tmweave-")
    few = spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet").limit(1).drop(key)
    few.crossJoin(spark.range(rows).withColumnRenamed("id", key)).coalesce(1).write.parquet(f"{d}/{table}.parquet")
    return [int(n) for n in re.findall(rf"Exchange hashpartitioning\({key}#\d+L?, (\d+)\)", plan(query(spark, d)))]


def test_rows_of_nested_blocks_are_dealt_before_files_are_made(spark):
    assert rows_dealt(spark, markup_queries.extract_nested_blocks, "pages", "page_id") == [3]


def test_rows_of_android_are_dealt_before_files_are_made(spark):
    assert rows_dealt(spark, markup_queries.extract_android_any, "part", "p_partkey") == [3]


def test_rows_of_ts_are_dealt_before_files_are_made(spark):
    assert rows_dealt(spark, markup_queries.extract_ts_any, "part", "p_partkey") == [3]


def test_android_is_dealt_by_content_and_sorted_once(spark):
    df = markup.android_pieces(files(spark))
    assert dealt(df) == 4
    assert plan(df).count("Sort [path") <= 1


def test_ts_is_dealt_by_content(spark):
    df = markup.ts_units(files(spark))
    assert dealt(df) == 4 and "Join" not in plan(df)
    odd = """<TS><message><source>m</source></message><context><message><source>a</source></message><name>last</name></context><context><message><source>b</source></message></context></TS>"""
    got = markup.ts_units(spark.createDataFrame([("p", odd)], "path string, content string")).collect()
    assert sorted((r.key, r.context) for r in got) == [(":b", ""), (":m", ""), ("last:a", "last")]


def test_po_is_dealt_by_content(spark):
    assert dealt(exchange.po_entries(files(spark))) == 4


def test_render_reads_its_files_once(spark, sf):
    df = markup_queries.render_android(spark, sf)
    assert df.inputFiles() and not any("part.parquet" in f for f in df.inputFiles())
    assert "BroadcastHashJoin" not in plan(df)


def test_translate_computes_segments_for_each_provider_only(spark):
    units = spark.createDataFrame([("p", "k", "a\n\nb", "", "")], "path string, key string, source string, context string, hint string")
    job = Phases().on("segment_source", lambda: (segments.PARAGRAPHS, False)).on("get_translation_pre", lambda r: r.where("n = 2").select("path", "segment_key", "language", F.lit("B").alias("target"), F.lit(1).alias("fuzzy")))
    out = job.translate(units, spark.createDataFrame([("de",)], "language string"), lambda r: r.select("path", "segment_key", "language", F.upper("source").alias("target"), F.lit(0).alias("fuzzy")))
    assert len(re.findall(r"(?:SortMergeJoin|BroadcastHashJoin) \[", plan(out))) == 3
    assert [(r.target, r.fuzzy) for r in out.collect()] == [("A\n\nB", 1)]


def staged(monkeypatch, module, f):
    """Names of the tables that f writes."""
    names, stage = [], module.stage
    monkeypatch.setattr(module, "stage", lambda df, name: names.append(name) or stage(df, name))
    f()
    return names


def test_mixing_writes_three_tables(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert staged(monkeypatch, mixing, lambda: mixing.plan_copies(docs).count()) == ["mix-sizes", "mix-targets", "mix-took"]


def test_fingerprints_write_one_table(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert staged(monkeypatch, fingerprints, lambda: fingerprints.fingerprint_edits(docs).count()) == ["next-ids"]
