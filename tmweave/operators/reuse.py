"""Looking translations up: exact, reused, near and from a similar language."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tmweave.functions import text as fx
from tmweave.sources import folders

SUBSETS = range(8)


def missing(tm: dict[str, DataFrame]) -> DataFrame:
    """item_id, language, source, namespace, path, context of live items that a language has no translation row for."""
    items = tm["items"].where("orphaned = 0").join(tm["strings"].where("skip = 0"), "string_id").join(tm["files"].select("file_id", "namespace", "path"), "file_id")
    grid = items.crossJoin(F.broadcast(tm["langs"].select("language")))
    grid = grid.select("item_id", "language", F.col("string").alias("source"), "namespace", "path", F.coalesce("context", F.lit("")).alias("context"))
    return grid.join(tm["translations"].select("item_id", "language"), ["item_id", "language"], "left_anti")


def exact(tm: dict[str, DataFrame]) -> DataFrame:
    """Each translation row with whether its string is skipped: a skipped string has no translation and no fallback."""
    s = tm["items"].select("item_id", "string_id").join(tm["strings"].select("string_id", "skip"), "string_id")
    t = tm["translations"].join(s, "item_id")
    blank = F.col("skip") == 1
    return t.select("item_id", "language", F.when(~blank, F.col("string")).alias("target"), F.when(~blank, F.col("fuzzy")).alias("fuzzy"), F.when(~blank, F.col("comment")).alias("comment"), "skip")


def candidates(tm: dict[str, DataFrame]) -> DataFrame:
    """Every translation with what its fitness is judged by; orphaned if its item or file is."""
    t = tm["translations"].join(tm["items"].withColumnRenamed("orphaned", "io"), "item_id").join(tm["strings"].select("string_id", F.col("string").alias("source"), "context"), "string_id")
    t = t.join(tm["files"].select("file_id", "namespace", "path", F.col("orphaned").alias("fo")), "file_id")
    return t.select("item_id", "language", "source", "namespace", "path", F.coalesce("context", F.lit("")).alias("context"), F.greatest("io", "fo").alias("orphaned"), F.coalesce(F.col("string"), F.lit("")).alias("target"), "fuzzy", "comment")


def _keys(df: DataFrame) -> DataFrame:
    """A row for each subset of {namespace, path, context}, with the values of that subset as key."""
    part = lambda bit, c: F.when(F.col("mask").bitwiseAND(bit) > 0, F.col(c)).otherwise("")
    df = df.withColumn("mask", F.explode(F.array(*[F.lit(m) for m in SUBSETS])))
    return df.withColumn("key", F.md5(F.concat_ws("\x01", part(1, "namespace"), part(2, "path"), part(4, "context"))))


def best(targets: DataFrame, cand: DataFrame, reuse_orphaned: bool = True, reuse_fuzzy: bool = True, uncertain: bool = False) -> DataFrame:
    """The fittest candidate of each target: item_id, language, target, fuzzy, fitness, cand_item, variants.

    Fitness counts the same namespace, path and context and a candidate that isn't orphaned; ties go to the alphabetically first
    translation. With more than one distinct translation of the text and not uncertain there is none. A candidate's
    fitness is the largest over the subsets of what it agrees in, so one aggregation and one join by subset replace the
    product of targets with all candidates of the same text.
    """
    out = best_or_conflict(targets, cand, reuse_orphaned, reuse_fuzzy)
    out = out if uncertain else out.where("not many")
    return out.select("item_id", "language", "target", "fuzzy", "fitness", "cand_item", F.col("many").cast("int").alias("variants"))


def best_or_conflict(targets: DataFrame, cand: DataFrame, reuse_orphaned: bool = True, reuse_fuzzy: bool = True) -> DataFrame:
    """item_id, language, target, fuzzy, fitness, cand_item, comment (the candidate's), and whether the text has more than one translation (many), of every target with a candidate."""
    cand = cand.where((F.lit(reuse_orphaned) | (F.col("orphaned") == 0)) & (F.lit(reuse_fuzzy) | (F.col("fuzzy") == 0)))
    top = _keys(cand).groupBy("source", "language", "mask", "key").agg(F.min(F.struct("orphaned", "target", F.col("item_id").alias("cand_item"), "fuzzy", "comment")).alias("c"), (F.min("target") != F.max("target")).alias("many"))
    hit = _keys(targets.select("item_id", "language", "source", "namespace", "path", "context")).join(top, ["source", "language", "mask", "key"])
    fitness = F.bit_count("mask") + 1 - F.col("c.orphaned")
    pick = F.min(F.struct((-fitness).alias("worse"), F.col("c.target").alias("target"), F.col("c.cand_item").alias("cand_item"), F.col("c.fuzzy").alias("fuzzy"), F.col("c.comment").alias("comment")))
    out = hit.groupBy("item_id", "language").agg(pick.alias("b"), F.max(F.when(F.col("mask") == 0, F.col("many"))).alias("many"))
    return out.select("item_id", "language", "b.target", "b.fuzzy", (-F.col("b.worse")).cast("int").alias("fitness"), "b.cand_item", "b.comment", F.coalesce("many", F.lit(False)).alias("many"))


def as_fuzzy(language: Column, fuzzy: Column, default: bool = True, fuzzy_for: list[str] = (), not_fuzzy_for: list[str] = ()) -> Column:
    """A reused translation is fuzzy if it was, if its language is in fuzzy_for, or by default unless in not_fuzzy_for."""
    force = language.isin(list(fuzzy_for)) | (F.lit(default) & ~language.isin(list(not_fuzzy_for)))
    return F.when(force, 1).otherwise(fuzzy)


def similar(targets: DataFrame, resolved: DataFrame, rules: list[tuple[str, list[str], bool]]) -> DataFrame:
    """Translations borrowed from another language. rules: (destination, sources, as fuzzy), in order; sources go by name.

    resolved: item_id, language, target, fuzzy, comment of the whole chain but this step. The first source with a translation or comment wins.
    """
    flat = [(d, n, s, int(z)) for n, (d, sources, z) in enumerate(rules) for s in sorted(sources)]
    spark = targets.sparkSession
    rule = F.broadcast(spark.createDataFrame(flat, "language string, rule int, from_language string, rule_fuzzy int"))
    have = resolved.where("coalesce(target, '') <> '' or coalesce(comment, '') <> ''").select("item_id", F.col("language").alias("from_language"), "target", "fuzzy", "comment")
    hit = targets.select("item_id", "language").join(rule, "language").join(have, ["item_id", "from_language"])
    pick = F.min(F.struct("rule", "from_language", "target", F.greatest("fuzzy", "rule_fuzzy").alias("fuzzy"), "comment")).alias("b")
    return hit.groupBy("item_id", "language").agg(pick).select("item_id", "language", "b.from_language", "b.target", "b.fuzzy", "b.comment")


def variants(cand: DataFrame) -> DataFrame:
    """Number of distinct translations of each source text; none at all counts as one."""
    return cand.groupBy("source", "language").agg(F.count_distinct("target").alias("variants"))


def near(targets: DataFrame, tm: dict[str, DataFrame], cand: DataFrame) -> DataFrame:
    """Translations of texts that differ only in tags, white space, case and end punctuation, made to look like the source.

    Joined on the near key; the candidate's own best translation gets the target's tags where it has its source's, is adjusted step by step, and kept if the same steps turn its source into the target's.
    """
    sources = tm["strings"].select(F.col("string").alias("source")).distinct().withColumn("near", fx.near_key(F.col("source")))
    have = cand.where("target <> '' and orphaned = 0").groupBy("source", "language").agg(F.min(F.struct("fuzzy", "target")).alias("c"), (F.min("target") == F.max("target")).alias("one")).where("one")
    have = have.join(sources, "source").select(F.col("source").alias("cand_source"), "language", "near", "c.target", "c.fuzzy")
    want = targets.select("item_id", "language", "source").withColumn("near", fx.near_key(F.col("source")))
    hit = want.join(have, ["near", "language"]).where(F.col("source") != F.col("cand_source"))
    made = fx.near_made(F.col("source"), F.col("cand_source"), F.col("target"), F.col("language"))
    back = fx.near_made(F.col("source"), F.col("cand_source"), F.col("cand_source"), F.lit("en"))
    hit = hit.where((back == F.col("source")) & made.isNotNull()).select("item_id", "language", F.struct("cand_source", made.alias("target")).alias("c"))
    return hit.groupBy("item_id", "language").agg(F.min("c").alias("c")).select("item_id", "language", "c.target", F.lit(1).alias("fuzzy"), "c.cand_source")


def chain(targets: DataFrame, steps: list[tuple[str, DataFrame]]) -> DataFrame:
    """The first step that has a translation: steps are (name, item_id, language, target, fuzzy). Adds target, fuzzy, provenance."""
    out = targets.select("item_id", "language")
    for n, (_, df) in enumerate(steps):
        out = out.join(df.select("item_id", "language", F.struct("target", "fuzzy").alias(f"s{n}")), ["item_id", "language"], "left")
    first = F.coalesce(*[F.col(f"s{n}") for n in range(len(steps))])
    name = reduce(lambda c, n: c.when(F.col(f"s{n}").isNotNull(), steps[n][0]), range(len(steps)), F.when(F.lit(False), ""))
    return out.select("item_id", "language", first["target"].alias("target"), first["fuzzy"].alias("fuzzy"), name.alias("provenance"))


def resolve(tm: dict[str, DataFrame], rules: list[tuple[str, list[str], bool]] = (), reuse_orphaned: bool = True, reuse_fuzzy: bool = True, uncertain: bool = False, near_match: bool = True, **fuzzy) -> DataFrame:
    """Every live item in every language, resolved in order: exact, reuse, near, similar.

    A step counts if it gives a text or a comment. Two things end the chain without a result: the string is skipped, or its text has several translations and uncertain isn't set (provenance skip and
    conflict). Otherwise the languages of the rules are asked in order, each through its own exact, reuse and near steps (similar); what ends a chain there leaves the next language to be asked.
    fuzzy: as_fuzzy's parameters. Gives item_id, language, target, fuzzy, comment, provenance (null: nothing found).
    """
    spark = tm["items"].sparkSession
    items = tm["items"].where("orphaned = 0").join(tm["strings"], "string_id").join(tm["files"].select("file_id", "namespace", "path"), "file_id")
    items = items.select("item_id", F.col("string").alias("source"), "namespace", "path", F.coalesce("context", F.lit("")).alias("context"), "skip")
    asked = sorted({s for _, sources, _ in rules for s in sources})
    own = tm["langs"].select("language")
    more = spark.createDataFrame([(x,) for x in asked], "language string")
    langs = own.withColumn("own", F.lit(True)).unionByName(more.join(own, "language", "left_anti").withColumn("own", F.lit(False)))
    said = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    have = tm["translations"].select("item_id", "language", F.col("string").alias("target"), "fuzzy", "comment").where(said("target") | said("comment"))
    grid = items.crossJoin(langs).join(have, ["item_id", "language"], "left")
    grid = grid.withColumn("provenance", F.when(F.col("skip") == 1, "skip").when(said("target") | said("comment"), "exact"))
    done = grid.where("provenance IS NOT NULL").select("item_id", "language", "own", *(F.when(F.col("provenance") == "exact", F.col(c)).alias(c) for c in ("target", "fuzzy", "comment")), "provenance")
    want = grid.where("provenance IS NULL").select("item_id", "language", "source", "namespace", "path", "context", "own")
    cand = candidates(tm)
    found = best_or_conflict(want, cand, reuse_orphaned, reuse_fuzzy).withColumn("fuzzy", F.when(F.col("fuzzy") == 1, 1).otherwise(as_fuzzy(F.col("language"), F.col("fuzzy"), **fuzzy)))
    ends = F.col("many") & F.lit(not uncertain)
    found = found.where(ends | said("target") | said("comment"))
    found = found.select("item_id", "language", *(F.when(~ends, F.col(c)).alias(c) for c in ("target", "fuzzy", "comment")), F.when(ends, "conflict").otherwise("reuse").alias("provenance"))
    steps = [found]
    if near_match:
        steps.append(near(want, tm, cand).select("item_id", "language", "target", "fuzzy", F.lit(None).cast("string").alias("comment"), F.lit("near").alias("provenance")))
    out = want.select("item_id", "language", "own")
    for n, df in enumerate(steps):
        out = out.join(df.select("item_id", "language", F.struct("target", "fuzzy", "comment", "provenance").alias(f"s{n}")), ["item_id", "language"], "left")
    out = out.withColumn("s", F.coalesce(*(F.col(f"s{n}") for n in range(len(steps))))).select("item_id", "language", "own", "s.target", "s.fuzzy", "s.comment", "s.provenance")
    out = done.unionByName(out)
    if rules:
        # read three times from here on
        path = folders.new_path(spark, "resolved")
        out.write.parquet(path)
        out = spark.read.schema(out.schema).parquet(path)
        there = out.where(said("target") | said("comment")).select("item_id", "language", "target", "fuzzy", "comment")
        borrowed = similar(out.where("own AND provenance IS NULL"), there, rules)
        out = out.join(borrowed.select("item_id", "language", F.struct("target", "fuzzy", "comment").alias("b")), ["item_id", "language"], "left")
        pick = lambda c: F.coalesce(F.col(c), F.when(F.col("provenance").isNull(), F.col(f"b.{c}"))).alias(c)
        out = out.select("item_id", "language", "own", pick("target"), pick("fuzzy"), pick("comment"), F.coalesce("provenance", F.when(F.col("b").isNotNull(), F.lit("similar"))).alias("provenance"))
    return out.where("own").drop("own")


def rewrite_all(tm: dict[str, DataFrame], changes: DataFrame) -> DataFrame:
    """Translations of other items with a changed item's source text, in its language, that differ from the new text.

    changes: item_id, language, target (null or '': the translation is taken away), as_fuzzy. Gives item_id, language, target, fuzzy, comment, merge.
    """
    text = tm["items"].select("item_id", "string_id").join(tm["strings"].select("string_id", F.col("string").alias("source")), "string_id").select("item_id", "source")
    new = changes.join(text, "item_id").select(F.col("item_id").alias("by"), "source", "language", F.coalesce("target", F.lit("")).alias("new"), "as_fuzzy")
    old = tm["translations"].select("item_id", "language", F.col("string").alias("old"), "comment").join(text, "item_id")
    hit = old.join(new, ["source", "language"]).where("item_id <> by")
    hit = hit.where(F.when(F.col("new") == "", F.col("old").isNotNull()).otherwise(F.coalesce("old", F.lit("")) != F.col("new")))
    hit = hit.groupBy("item_id", "language").agg(F.max(F.struct("by", "new", "as_fuzzy")).alias("n"), F.first("comment").alias("comment"))
    gone = F.col("n.new") == ""
    return hit.select("item_id", "language", F.when(~gone, F.col("n.new")).alias("target"), F.when(gone, 0).otherwise(F.col("n.as_fuzzy")).alias("fuzzy"), F.when(gone, F.lit("Translation removed")).otherwise(F.col("comment")).alias("comment"), F.lit(1).alias("merge"))


def numbered(df: DataFrame, by: list[str], order: list, out: str) -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
