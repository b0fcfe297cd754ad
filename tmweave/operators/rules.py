"""Rules as columns: filters, flags, language limits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matches(column: Column, patterns: list[str], negative: bool = False) -> Column:
    """Any pattern matches; negative: none does. Dots match line feeds; a null is an empty text."""
    c = F.coalesce(column, F.lit(""))
    hit = reduce(lambda a, p: a | c.rlike(f"(?s){p}"), patterns, F.lit(False))
    return ~hit if negative else hit


def rule_filter(blocks: list[tuple[list[Column], bool]]) -> Column:
    """Blocks of conditions, all of which must hold; the first block that holds decides. No block: true; none holds: false."""
    if not blocks:
        return F.lit(True)
    held = [reduce(lambda a, b: a & b, conds, F.lit(True)) for conds, _ in blocks]
    out = F.when(held[0], blocks[0][1])
    for h, (_, v) in zip(held[1:], blocks[1:], strict=True):
        out = out.when(h, v)
    return out.otherwise(False)


def rule_flags(flags: Column, when: Column, add: list[str] = (), remove: list[str] = ()) -> Column:
    """Flags set and removed where a condition holds."""
    lit = lambda x: F.array(*[F.lit(v) for v in x]) if x else F.array().cast("array<string>")
    return F.when(when, F.array_except(F.array_union(flags, lit(add)), lit(remove))).otherwise(flags)


def has_flags(flags: Column, of: list[str], how: str = "any") -> Column:
    tests = [F.array_contains(flags, f) for f in of]
    one = reduce(lambda a, b: a | b, tests)
    return reduce(lambda a, b: a & b, tests) if how == "all" else ~one if how == "none" else one


def combine_and(votes: list[Column], default: bool | None = True) -> Column:
    """All votes hold. Nobody votes: default, or false without one."""
    return reduce(lambda a, b: a & b, votes) if votes else F.lit(bool(default))


def combine_or(votes: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, votes) if votes else F.lit(False)


def gather(content: Column, pattern: str, split_by: str = r"[\s,]+") -> Column:
    """Languages named in a text: all matches of a pattern's group, split."""
    found = F.regexp_extract_all(content, F.lit(pattern), F.lit(1))
    return F.array_distinct(F.filter(F.flatten(F.transform(found, lambda x: F.split(x, split_by))), lambda x: x != ""))


def limit_languages(job: Column, rules: list[tuple[str, Column | None]]) -> Column:
    """A file's languages after rules in order: exclude_all, include_all, limit, include, exclude; always among the job's."""
    langs = job
    for what, arg in rules:
        if what == "exclude_all":
            langs = F.array().cast("array<string>")
        elif what == "include_all":
            langs = job
        elif what == "limit":
            langs = F.when(F.size(arg) > 0, F.array_intersect(langs, arg)).otherwise(langs)
        elif what == "include":
            langs = F.array_union(langs, arg)
        else:
            langs = F.array_except(langs, arg)
    return F.array_sort(F.array_intersect(job, langs))


def file_languages(files: DataFrame, languages: Column) -> DataFrame:
    """(file, language) rows of files that keep a language; without any a file is orphaned."""
    x = files.withColumn("languages", languages)
    return x.withColumn("orphaned", (F.size("languages") == 0).cast("int")).withColumn("language", F.explode_outer("languages")).drop("languages")


def language_sets(job: Column, source_language: str, modified: Column, limit: list[str] | None = None, output_source: bool = False) -> Column:
    """destination and modified languages of a job, as sorted sets."""
    dest = F.array_distinct(F.concat(job, F.array(F.lit(source_language))) if output_source else job)
    dest = F.array_intersect(dest, F.array(*[F.lit(x) for x in limit])) if limit else dest
    return F.struct(F.array_sort(dest).alias("destination"), F.array_sort(F.array_intersect(modified, dest)).alias("modified"))
