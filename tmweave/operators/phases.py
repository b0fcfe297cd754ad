"""Jobs as ordered phases: functions hooked into the way from files to units to translations and back.

Each phase has its own kind of function. Column phases get the columns that they rewrite and may keep state, in a column of that name, for the phase that turns it back; table phases get and give a whole DataFrame. Functions of one
phase run in the order in which they were hooked, so a plan stays one declarative query that Catalyst sees whole.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tmweave.operators import markup, segments

#: Conditions on files and on units; rewriters of one column (source, context, hint, key, translation, path, content); arrays of hints; tables.
FILTERS = ("is_file_orphaned", "can_process_source_file", "can_process_ts_file", "can_generate_ts_file", "can_generate_localized_file", "can_save_localized_file", "can_extract", "can_translate")
REWRITES = {
    "rewrite_source": "source", "rewrite_context": "context", "rewrite_hint": "hint", "rewrite_key": "key", "rewrite_translation": "target", "rewrite_path": "path", "rewrite_relative_output_path": "path", "rewrite_absolute_output_path": "path",
    "rewrite_relative_ts_file_path": "path", "rewrite_absolute_ts_file_path": "path", "after_load_file": "content", "before_deserialize_ts_file": "content", "after_serialize_ts_file": "content", "before_save_localized_file": "content",
}
HINTS, SEGMENTS, PROVIDERS, ROWS = "add_hint", "segment_source", ("get_translation_pre", "get_translation"), "rewrite_parsed_ts_file_item"
KINDS = (*FILTERS, *REWRITES, HINTS, SEGMENTS, *PROVIDERS, ROWS)


class Phases:
    """Functions by phase.

    Filters: a function of a DataFrame that gives a boolean Column; null votes say nothing; all must agree (a file is orphaned if all that vote say so, and not without a vote). Rewriters: a function of a Column and of the state's
    Column (null before) that gives the new value, or the value and the state in a tuple. Hints: a DataFrame to an array of strings. Segments: separator and whether sentences part, see segments.cut.
    Providers: a DataFrame of (item columns, source, language) to rows (unit, language, target, fuzzy). Rows: a DataFrame to one of the same columns.
    """

    def __init__(self):
        self.hooks: dict[str, list] = {k: [] for k in KINDS}

    def on(self, phase: str, f: Callable, state: str | None = None) -> Phases:
        if phase not in self.hooks:
            raise ValueError(f"no phase {phase}")
        self.hooks[phase].append((f, state))
        return self

    def votes(self, df: DataFrame, phase: str) -> Column:
        """The verdict of a filter phase."""
        said = [f(df) for f, _ in self.hooks[phase]]
        if phase == "is_file_orphaned":
            return reduce(lambda a, b: a & F.coalesce(b, F.lit(True)), said, F.lit(True)) & reduce(lambda a, b: a | b.isNotNull(), said, F.lit(False))
        return reduce(lambda a, b: a & F.coalesce(b, F.lit(True)), said, F.lit(True))

    def filter(self, df: DataFrame, phase: str) -> DataFrame:
        return df.where(self.votes(df, phase)) if self.hooks[phase] else df

    def rewrite(self, df: DataFrame, phase: str, column: str | None = None) -> DataFrame:
        """A rewriting phase over its column, with state columns kept beside it."""
        column = column or REWRITES[phase]
        for f, state in self.hooks[phase]:
            before = F.col(state) if state and state in df.columns else F.lit(None).cast("string")
            new = f(F.col(column), before)
            if isinstance(new, tuple):
                if not state:
                    raise ValueError(f"{phase}: a function that gives state needs its name")
                # both from the value before the rewriting
                df = df.withColumns({column: new[0], state: new[1]})
            else:
                df = df.withColumn(column, new)
        return df

    def hints(self, df: DataFrame, column: str = "hints") -> DataFrame:
        """Adds all hooks' hints, in order, without nulls and blanks."""
        every = F.flatten(F.array(*(F.coalesce(f(df), F.array().cast("array<string>")) for f, _ in self.hooks[HINTS]))) if self.hooks[HINTS] else F.array().cast("array<string>")
        return df.withColumn(column, F.filter(every, lambda x: F.coalesce(F.trim(x), F.lit("")) != ""))

    def rows(self, df: DataFrame) -> DataFrame:
        """Imported rows ahead of the merge."""
        return reduce(lambda d, h: h[0](d).select(*df.columns), self.hooks[ROWS], df)

    def content(self, files: DataFrame, phase: str) -> DataFrame:
        return self.rewrite(files, phase, "content")

    def extract(self, units: DataFrame) -> DataFrame:
        """Units of files: filtered, rewritten, then cut into segments. units: path, key, source, context, hint. Adds n, segment_key, after."""
        units = self.filter(units, "can_extract")
        for phase in ("rewrite_source", "rewrite_context", "rewrite_hint", "rewrite_key"):
            units = self.rewrite(units, phase)
        separator, sentences = self.hooks[SEGMENTS][-1][0]() if self.hooks[SEGMENTS] else (None, False)
        if separator is None:
            return units.withColumns({"n": F.lit(1), "segment_key": F.col("key").cast("string"), "after": F.lit("")})
        return segments.cut(units.withColumnRenamed("source", "string"), separator, sentences).withColumnRenamed("string", "source")

    def provide(self, rows: DataFrame, phase: str, found: str = "found") -> DataFrame:
        """Adds found (target, fuzzy) of the first provider that has one for (segment_key, path, language); null without."""
        have = []
        for i, (f, _) in enumerate(self.hooks[phase]):
            given = f(rows).select("path", "segment_key", "language", F.struct("target", F.col("fuzzy").cast("int").alias("fuzzy")).alias(f"_{i}"))
            rows = rows.join(given.where(F.coalesce(F.col(f"_{i}.target"), F.lit("")) != ""), ["path", "segment_key", "language"], "left")
            have.append(f"_{i}")
        none = F.lit(None).cast("struct<target:string,fuzzy:int>")
        return rows.withColumn(found, F.coalesce(*map(F.col, have), none)).drop(*have)

    def translate(self, units: DataFrame, languages: DataFrame, memory: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """path, key, language, target, fuzzy of extracted units: per segment the first of get_translation_pre, memory and get_translation that has a text; a unit has a text if all its segments that aren't white space do.

        Translations are turned back (rewrite_translation) with the states that extract() kept, after segments are joined. languages: one column, language, of few rows.
        """
        kept = sorted({state for p in ("rewrite_source", "rewrite_translation") for _, state in self.hooks[p] if state})
        rows = self.filter(self.extract(markup.spread(units, content="source")).join(languages.select("language")), "can_translate")
        rows = self.provide(rows, "get_translation_pre", "f0")
        given = memory(rows).select("path", "segment_key", "language", F.struct("target", F.col("fuzzy").cast("int").alias("fuzzy")).alias("f1")).where("coalesce(f1.target, '') <> ''")
        rows = self.provide(rows.join(given, ["path", "segment_key", "language"], "left"), "get_translation", "f2")
        blank = F.when(F.coalesce(F.trim(F.regexp_replace("source", r"\s+", " ")), F.lit("")) == "", F.struct(F.col("source").alias("target"), F.lit(0).alias("fuzzy")))
        rows = rows.withColumn("f", F.coalesce(blank, "f0", "f1", "f2")).select("path", "key", "language", "n", "after", F.col("f.target").alias("target"), F.col("f.fuzzy").alias("fuzzy"), *kept)
        # states belong to the unit, so all its segments have them
        unit = ["path", "key", "language"]
        out = segments.join(rows, unit, "target", F.max("fuzzy").alias("fuzzy"), *(F.first(k).alias(k) for k in kept)).withColumnRenamed("string", "target")
        return self.rewrite(out, "rewrite_translation").drop(*kept)
