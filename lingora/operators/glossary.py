"""Glossaries: presets, lookup by context, seeds; terms inside of texts are in operators/terms.py."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lingora.operators.folds import running_sum


def merge_presets(fragments: DataFrame) -> DataFrame:
    """(key, value, ord) of fragments (preset_ord, key, value, ord): a later fragment overrides an earlier one."""
    by = F.struct("preset_ord", "ord")
    return fragments.groupBy("key").agg(F.max_by("value", by).alias("value"), F.min(by).alias("first")).select("key", "value", F.col("first.ord").alias("ord"))


def invert(glossary: DataFrame) -> DataFrame:
    """(key, value, ord) with keys and values swapped; the first source of a translation wins."""
    return glossary.groupBy(F.col("value").alias("key")).agg(F.min_by("key", "ord").alias("value"), F.min("ord").alias("ord"))


def contexts(path: Column) -> Column:
    """Folders of a path and pairs of neighbours, the deepest first."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    n = F.size(parts)
    folders = F.when((n > 0) & F.contains(F.element_at(parts, -1), F.lit(".")), F.slice(parts, F.lit(1), n - 1)).otherwise(parts)
    m = F.size(folders)
    ends = F.when(m > 0, F.sequence(m, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(ends, lambda e: F.array_join(F.slice(folders, F.greatest(e - 1, F.lit(1)), F.least(e, F.lit(2))), "/")))


def match(texts: DataFrame, glossary: DataFrame) -> DataFrame:
    """texts (path, text, ...) with glossary_value: in a context, then anywhere, then a context's wildcard.

    Candidates of a row are a handful; they meet the glossary in one equi-join on the lower-cased key, which Spark
    broadcasts if the glossary is small enough, and the best rank is taken with partial minima.
    """
    where = contexts(F.col("path"))
    candidates = F.concat(
        F.transform(where, lambda c: F.struct(F.concat(c, F.lit("/"), F.col("text")).alias("key"), F.lit(True).alias("loose"))),
        F.array(F.struct(F.col("text").alias("key"), F.lit(True).alias("loose"))),
        F.transform(where, lambda c: F.struct(F.concat(c, F.lit("/*")).alias("key"), F.lit(False).alias("loose"))),
    )
    asked = texts.select("path", "text").distinct().select("path", "text", F.posexplode(candidates).alias("rank", "c"))
    asked = asked.select("path", "text", "rank", F.col("c.key").alias("asked"), "c.loose", F.lower("c.key").alias("low"))
    terms = glossary.where("value <> ''").select(F.col("key").alias("term"), "value", "ord", F.lower("key").alias("low"))
    hits = asked.join(terms, "low").where((F.col("asked") == F.col("term")) | (F.col("loose") & F.col("asked").rlike("[A-Za-z]")))
    order = F.struct("rank", (F.col("asked") != F.col("term")).alias("inexact"), "ord")
    best = hits.groupBy("path", "text").agg(F.min_by("value", order).alias("glossary_value"))
    return texts.join(best, ["path", "text"], "left")


def seed_counts(seed: DataFrame, current: DataFrame, overwrite: bool = False) -> DataFrame:
    """(added, updated, unchanged, skipped) of putting a seed (key, value) into a glossary."""
    both = seed.select("key", F.col("value").alias("new")).join(current.select("key", F.col("value").alias("old")), "key", "full")
    differ = F.col("old") != F.col("new")
    return both.agg(
        F.count_if(F.col("old").isNull()).alias("added"), F.count_if(differ & F.lit(overwrite)).alias("updated"),
        F.count_if(F.col("old") == F.col("new")).alias("unchanged"), F.count_if(differ & ~F.lit(overwrite)).alias("skipped"),
    )


def in_locale_order(text: Column) -> Column:
    """What sorts texts as readers of a language would, accents and case after letters; equal ones need the text itself as well."""
    return F.collate(text, "UNICODE")


def seeded(seed: DataFrame, current: DataFrame, overwrite: bool = False) -> DataFrame:
    """(key, value, state, place): a glossary with a seed put in, in the order in which it is written.

    Entries that are there stay, work by hand among them, unless overwrite; state is added, updated, unchanged or skipped
    for keys of the seed, as seed_counts() counts them, and kept for others.
    """
    both = seed.select("key", F.col("value").alias("new"), F.lit(True).alias("asked")).join(current.select("key", F.col("value").alias("old"), F.lit(True).alias("there")), "key", "full")
    asked, there = (F.coalesce(c, F.lit(False)) for c in ("asked", "there"))
    same = F.col("old").eqNullSafe(F.col("new"))
    state = F.when(~asked, "kept").when(~there, "added").when(same, "unchanged").otherwise("updated" if overwrite else "skipped")
    value = F.when(state.isin("added", "updated"), F.col("new")).otherwise(F.col("old"))
    return ordered(both.select("key", value.alias("value"), state.alias("state")), "key", "place")


def ordered(rows: DataFrame, key: str, name: str, within: list[str] | None = None) -> DataFrame:
    """rows with their place, from 1, by the key in a locale's order; within other columns, or over all: a sum over sorted ranges, no single task."""
    o = rows.withColumns({"__in": F.to_json(F.struct(*(within or [F.lit(0).alias("all")]))), "__order": in_locale_order(F.col(key))})
    return running_sum(o, ["__in"], ["__order", key], F.lit(1), name).drop("__in", "__order")
