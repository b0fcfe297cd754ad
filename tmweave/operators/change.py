"""Changes to the memory as new versions of its tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tmweave.functions import text as fx


def null_if_blank(c):
    return F.nullif(c, F.lit(""))


def upsert_translations(old: DataFrame, new: DataFrame) -> DataFrame:
    """item_id, language, string, comment, fuzzy, merge, change: insert, update or none. Empty texts are null; a row changes only if a value does."""
    keys, values = ["item_id", "language"], ["string", "comment", "fuzzy", "merge"]
    n = new.select(*keys, null_if_blank(F.col("string")).alias("string"), null_if_blank(F.col("comment")).alias("comment"), "fuzzy", "merge")
    n = n.select(*keys, F.struct(*values).alias("n"))
    o = old.select(*keys, F.struct(*values).alias("o"))
    x = o.join(n, keys, "full_outer")
    change = F.when(F.col("o").isNull(), "insert").when(F.col("n").isNotNull() & ~F.col("n").eqNullSafe(F.col("o")), "update").otherwise("none")
    return x.select(*keys, F.coalesce("n", "o").alias("v"), change.alias("change")).select(*keys, "v.*", "change")


def upsert_units(strings: DataFrame, units: DataFrame) -> DataFrame:
    """Strings of units that the memory lacks, with new ids after the largest: string_id, string, context. Only numbers of partitions' rows meet in one task."""
    key = lambda df: df.withColumn("k", fx.string_key(F.col("string"), F.col("context")))
    fresh = key(units.select("string", null_if_blank(F.col("context")).alias("context"))).dropDuplicates(["k"]).join(key(strings).select("k"), "k", "left_anti")
    top = strings.agg(F.coalesce(F.max("string_id"), F.lit(0)).alias("top"))
    return numbered(fresh, "k").crossJoin(F.broadcast(top)).select((F.col("top") + F.col("nth")).alias("string_id"), "string", "context")


def upsert_memory(tm: dict[str, DataFrame], units: DataFrame) -> dict[str, DataFrame]:
    """Files, strings and items with those of units (namespace, job, path, pos, string, context, hint) put in, each with change: insert, update or none.

    A file is known by namespace, job and path, a string by text and context, an item by both; what isn't known yet gets the numbers after the largest, in the order of its key's digest. Of several units of
    one item the last one's hint counts; an item whose hint differs (null is empty) is updated. A second run over the same units changes nothing. Null jobs, namespaces and paths are values of their own.
    """
    none = lambda c: F.coalesce(F.col(c), F.lit(""))
    file_key = F.md5(F.concat_ws("\x01", none("namespace"), none("job"), none("path")))
    units = units.withColumn("fk", file_key).withColumn("context", null_if_blank(F.col("context"))).withColumn("sk", fx.string_key(F.col("string"), F.col("context")))

    def grown(old: DataFrame, key: str, id_col: str, fresh: DataFrame) -> DataFrame:
        """old with the rows of fresh whose key it lacks, numbered; both have key and all columns but the id."""
        new = fresh.dropDuplicates([key]).join(old.select(key), key, "left_anti")
        top = old.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("top"))
        new = numbered(new, key).crossJoin(F.broadcast(top)).withColumn(id_col, F.col("top") + F.col("nth")).withColumn("change", F.lit("insert"))
        return old.withColumn("change", F.lit("none")).unionByName(new.drop("nth", "top"))

    files = grown(tm["files"].select("file_id", "namespace", "job", "path").withColumn("fk", file_key), "fk", "file_id", units.select("fk", "namespace", "job", "path"))
    strings = grown(tm["strings"].select("string_id", "string", "context").withColumn("sk", fx.string_key(F.col("string"), F.col("context"))), "sk", "string_id", units.select("sk", "string", "context"))
    said = units.groupBy("fk", "sk").agg(F.max_by(F.struct(null_if_blank(F.col("hint")).alias("hint")), F.struct("pos", none("hint"))).alias("h"))
    said = said.join(files.select("fk", "file_id"), "fk").join(strings.select("sk", "string_id"), "sk").select("file_id", "string_id", "h")
    have = tm["items"].select("item_id", "file_id", "string_id", null_if_blank(F.col("hint")).alias("hint"))
    both = have.withColumn("known", F.lit(True)).join(said, ["file_id", "string_id"], "full_outer")
    change = F.when(F.col("known").isNull(), "insert").when(F.col("h").isNotNull() & ~F.col("h.hint").eqNullSafe(F.col("hint")), "update").otherwise("none")
    both = both.select("item_id", "file_id", "string_id", F.when(F.col("h").isNotNull(), F.col("h.hint")).otherwise(F.col("hint")).alias("hint"), change.alias("change"))
    new = both.where("change = 'insert'").withColumn("k", F.md5(F.concat_ws(":", F.col("file_id").cast("string"), F.col("string_id").cast("string"))))
    top = tm["items"].agg(F.coalesce(F.max("item_id"), F.lit(0)).alias("top"))
    new = numbered(new, "k").crossJoin(F.broadcast(top)).withColumn("item_id", F.col("top") + F.col("nth")).select("item_id", "file_id", "string_id", "hint", "change")
    return {"files": files.drop("fk"), "strings": strings.drop("sk"), "items": both.where("change <> 'insert'").unionByName(new)}


def numbered(df: DataFrame, order: str, buckets: int = 65536) -> DataFrame:
    """Adds nth: 1, 2, ... by order, a hex string: rows are ranked in buckets (a power of 16) of its first digits, and buckets' sizes are summed."""
    df = df.withColumn("b", F.substring(F.col(order), 1, (buckets.bit_length() - 1) // 4))
    before = df.groupBy("b").agg(F.count("*").alias("c")).withColumn("before", F.coalesce(F.sum("c").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("c")
    ranked = df.withColumn("r", F.row_number().over(Window.partitionBy("b").orderBy(order)))
    return ranked.join(F.broadcast(before), "b").withColumn("nth", F.col("before") + F.col("r")).drop("b", "r", "before")


def comment_to_item(tm: dict[str, DataFrame], comments: DataFrame) -> DataFrame:
    """Translations of items whose comment a command sets or adds to: those that aren't empty become fuzzy. comments: item_id, comment."""
    c = fx.parse_command(F.col("comment"))
    hit = comments.where(c["command"].isin("set_comment", "add_comment")).select("item_id").distinct().withColumn("hit", F.lit(1))
    t = tm["translations"].join(hit, "item_id", "left")
    return t.withColumn("fuzzy", F.when((F.col("hit") == 1) & F.col("string").isNotNull(), 1).otherwise(F.col("fuzzy"))).select("item_id", "language", "string", "fuzzy")


def item_comments(items: DataFrame, comments: DataFrame) -> DataFrame:
    """Items' comments after commands. items: item_id, comment."""
    c = fx.parse_command(F.col("said"))
    x = items.select("item_id", "comment").join(comments.select("item_id", F.col("comment").alias("said")), "item_id")
    new = F.when(c["command"] == "set_comment", c["value"]).when(c["command"] == "add_comment", F.concat_ws("\n\n", "comment", c["value"])).otherwise(F.col("comment"))
    return x.select("item_id", new.alias("comment"))


def apply(translations: DataFrame, changes: DataFrame) -> DataFrame:
    """translations with changes (item_id, language, target, fuzzy, comment, merge) put in."""
    c = changes.select("item_id", "language", F.struct("target", "comment", "fuzzy", "merge").alias("c"))
    x = translations.select("item_id", "language", F.struct(F.col("string").alias("target"), "comment", "fuzzy", "merge").alias("o")).join(c, ["item_id", "language"], "left")
    return x.select("item_id", "language", F.coalesce("c", "o").alias("v")).select("item_id", "language", F.col("v.target").alias("string"), "v.comment", "v.fuzzy", "v.merge")


def fit_all_whitespace(tm: dict[str, DataFrame]) -> DataFrame:
    """Translations whose outer white space differs from their source's, with the fitted text."""
    s = tm["items"].where("orphaned = 0").select("item_id", "string_id").join(tm["strings"].select("string_id", F.col("string").alias("source")), "string_id")
    t = tm["translations"].where("string is not null").select("item_id", "language", F.col("string").alias("old")).join(s, "item_id")
    return t.withColumn("new", fx.fit_whitespace(F.col("source"), F.col("old"))).where("old <> new").select("item_id", "language", "old", "new")


def clear_merge(translations: DataFrame) -> DataFrame:
    return translations.withColumn("merge", F.lit(0))


def assign_usn(changed: DataFrame, base: int) -> DataFrame:
    """Change numbers after base for changed rows, in an order of their keys' hash."""
    keyed = changed.withColumn("k", F.md5(F.concat_ws("\x01", F.col("item_id").cast("string"), "language")))
    return numbered(keyed, "k").withColumn("usn", F.lit(base) + F.col("nth")).drop("k", "nth")


def file_diff(known: DataFrame, found: DataFrame) -> DataFrame:
    """path and state: new, orphaned, revived or kept. known: path, orphaned; found: path."""
    x = known.select("path", "orphaned").join(found.select("path", F.lit(1).alias("here")), "path", "full_outer")
    state = F.when(F.col("orphaned").isNull(), "new").when(F.col("here").isNull(), F.when(F.col("orphaned") == 1, "gone").otherwise("orphaned")).when(F.col("orphaned") == 1, "revived").otherwise("kept")
    return x.select("path", state.alias("state"))


def renames(gone: DataFrame, new: DataFrame) -> DataFrame:
    """One-to-one pairs of orphaned and new files of the same size and hash: the last new one takes the first orphan. Both: path, size, hash."""
    o = gone.groupBy("size", "hash").agg(F.min("path").alias("old_path"))
    n = new.groupBy("size", "hash").agg(F.max("path").alias("new_path"))
    return o.join(n, ["size", "hash"]).select("old_path", "new_path")


def item_orphans(items: DataFrame, seen: DataFrame) -> DataFrame:
    """Items of parsed files with their new orphaned flag. items: file_id, string_id, item_id, orphaned; seen: file_id, string_id."""
    parsed = seen.select("file_id").distinct()
    s = seen.select("file_id", "string_id").distinct().withColumn("here", F.lit(1))
    x = items.join(parsed, "file_id", "left_semi").join(s, ["file_id", "string_id"], "left")
    return x.select("item_id", F.when(F.col("here") == 1, 0).otherwise(1).alias("orphaned"), (F.when(F.col("here") == 1, 0).otherwise(1) != F.col("orphaned")).cast("int").alias("changed"))


def merge_guard(units: DataFrame, tm: dict[str, DataFrame]) -> DataFrame:
    """What importing each unit does: no_item, skipped, clear_merge, same, write or none. units: item_id, language, target, comment, fuzzy."""
    i = tm["items"].select("item_id", "string_id").join(tm["strings"].select("string_id", "skip"), "string_id").select("item_id", "skip")
    t = tm["translations"].select("item_id", "language", F.col("string").alias("ot"), F.col("comment").alias("oc"), F.col("fuzzy").alias("of"), F.col("merge").alias("om"))
    u = units.withColumn("fuzzy", F.when(fx.blank(F.col("target")) == "", 0).otherwise(F.col("fuzzy")))
    x = u.join(i, "item_id", "left").join(t, ["item_id", "language"], "left")
    same = (fx.blank(F.col("ot")) == fx.blank(F.col("target"))) & (fx.blank(F.col("oc")) == fx.blank(F.col("comment"))) & (F.col("of") == F.col("fuzzy"))
    any_ = (fx.blank(F.col("target")) != "") | (fx.blank(F.col("comment")) != "") | F.col("of").isNotNull()
    action = F.when(F.col("skip").isNull(), "no_item").when(F.col("skip") == 1, "skipped").when(F.col("om") == 1, "clear_merge").when(same, "same").when(any_, "write").otherwise("none")
    return x.select("item_id", "language", action.alias("action"))
