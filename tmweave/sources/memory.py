"""The translation memory's tables, and a memory derived from the driver's tables that plays their part at any scale."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FILES = T.StructType([T.StructField(n, t) for n, t in (("file_id", T.LongType()), ("usn", T.LongType()), ("job", T.StringType()), ("namespace", T.StringType()), ("path", T.StringType()), ("orphaned", T.IntegerType()))])
STRINGS = T.StructType([T.StructField(n, t) for n, t in (("string_id", T.LongType()), ("usn", T.LongType()), ("string", T.StringType()), ("context", T.StringType()), ("skip", T.IntegerType()))])
ITEMS = T.StructType([T.StructField(n, t) for n, t in (("item_id", T.LongType()), ("usn", T.LongType()), ("file_id", T.LongType()), ("string_id", T.LongType()), ("hint", T.StringType()), ("comment", T.StringType()), ("orphaned", T.IntegerType()))])
TRANSLATIONS = T.StructType([T.StructField(n, t) for n, t in (("translation_id", T.LongType()), ("usn", T.LongType()), ("item_id", T.LongType()), ("language", T.StringType()), ("string", T.StringType()), ("comment", T.StringType()), ("fuzzy", T.IntegerType()), ("merge", T.IntegerType()))])

#: The derived memory, in Spark SQL that DuckDB reads as well; later ones read the earlier ones.
DERIVED = {
    "tm_files": """SELECT s_suppkey+1 AS file_id, concat('ns',CAST(s_nationkey%5 AS STRING)) AS namespace,
       concat('job',CAST(s_nationkey%5 AS STRING)) AS job, concat('res/',s_name,'.properties') AS path,
       CASE WHEN s_suppkey%10=0 THEN 1 ELSE 0 END AS orphaned FROM {supplier}""",
    "tm_strings": """SELECT min(p_partkey)+1 AS string_id, string, context, CASE WHEN min(p_partkey)%50=7 THEN 1 ELSE 0 END AS skip
FROM (SELECT p_partkey, concat(upper(substr(p_name,1,1)),substr(p_name,2),' ',lower(p_type)) AS string,
             CASE WHEN p_partkey%3=0 THEN NULL ELSE p_brand END AS context FROM {part}) x GROUP BY string, context""",
    "tm_items": """SELECT DISTINCT CAST((l_suppkey+1) AS BIGINT)*1000000+s.string_id AS item_id, l_suppkey+1 AS file_id, s.string_id AS string_id,
       CASE WHEN (l_suppkey+s.string_id)%13=0 THEN 1 ELSE 0 END AS orphaned FROM {lineitem} JOIN {tm_strings} s ON s.string_id=l_partkey+1""",
    "tm_langs": "SELECT * FROM (VALUES (0,'de'),(1,'fr'),(2,'ja'),(3,'pt-br')) AS t(lang_ord,language)",
    "tm_translations": """SELECT i.item_id*10+l.lang_ord AS translation_id, i.item_id, l.language,
       CASE WHEN length(s.string)%3=1 AND (i.file_id+i.string_id)%17=0 THEN NULL
            ELSE concat(l.language,':',s.string, CASE WHEN length(s.string)%3=0 AND (i.file_id*3+i.string_id)%11=0 THEN '!' ELSE '' END) END AS string,
       CASE WHEN length(s.string)%3=1 AND (i.file_id+i.string_id)%17=0 THEN 'needs review' ELSE NULL END AS comment,
       CASE WHEN (i.string_id+i.file_id+l.lang_ord)%5=0 THEN 1 ELSE 0 END AS fuzzy, 0 AS merge
FROM {tm_items} i JOIN {tm_strings} s ON s.string_id=i.string_id CROSS JOIN {tm_langs} l WHERE (i.file_id*7+i.string_id+l.lang_ord*3)%10<6""",
}


def derived(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """files, strings, items, langs, translations of the derived memory."""
    known = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("supplier", "part", "lineitem")}
    for name, sql in DERIVED.items():
        known[name] = spark.sql(sql, **{k: v for k, v in known.items() if "{" + k + "}" in sql})
    return {k.removeprefix("tm_"): v for k, v in known.items() if k.startswith("tm_")}


def with_sql(query: str) -> str:
    """A query over the derived memory with its tables in front, for DuckDB."""
    views = {k: v.replace("{", "").replace("}", "") for k, v in DERIVED.items()}
    return "WITH " + ", ".join(f"{k} AS ({v})" for k, v in views.items()) + " " + query.strip().removeprefix("WITH ") if not query.strip().startswith("WITH ") else "WITH " + ", ".join(f"{k} AS ({v})" for k, v in views.items()) + ", " + query.strip().removeprefix("WITH ")


def scan(tm: dict[str, DataFrame], namespaces: list[str], jobs: list[str], languages: list[str]) -> DataFrame:
    """All of some jobs' items with their file, string and, per wanted language, translation; items without one stay, once."""
    f = tm["files"].where(F.col("namespace").isin(namespaces) & F.col("job").isin(jobs)).select("file_id", "namespace", "path", F.col("orphaned").alias("file_orphaned"))
    i = tm["items"].select("item_id", "file_id", "string_id", F.col("orphaned").alias("item_orphaned"))
    s = tm["strings"].select("string_id", F.col("string").alias("source"), "context", "skip")
    t = tm["translations"].where(F.col("language").isin(languages)).select("item_id", "language", F.col("string").alias("target"), "fuzzy")
    return f.join(i, "file_id", "left").join(s, "string_id", "left").join(t, "item_id", "left").select("namespace", "path", "item_id", "source", "context", "skip", "file_orphaned", "item_orphaned", "language", "target", "fuzzy")


def copy_tables(tm: dict[str, DataFrame], to: str) -> dict[str, DataFrame]:
    """Writes every table to a folder, translations by language, in place of what is there; gives the copies."""
    spark = next(iter(tm.values())).sparkSession
    for k, v in tm.items():
        w = v.write.mode("overwrite")
        (w.partitionBy("language") if k == "translations" else w).parquet(f"{to}/{k}")
    return {k: spark.read.schema(v.schema).parquet(f"{to}/{k}") for k, v in tm.items()}


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of each table."""
    out = [v.agg(F.count("*").alias("rows")).select(F.lit(k).alias("table"), "rows") for k, v in sorted(tables.items())]
    first = out[0]
    for x in out[1:]:
        first = first.union(x)
    return first
