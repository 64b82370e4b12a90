"""Translation maps: merging new segments with earlier entries, deprecation, keys, approval, packages, statistics."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lingora.functions.text import first_candidate, key_candidates, key_hash, locale_output_path
from lingora.operators.backends import dictionary, echo  # noqa: F401
from lingora.operators.fuzzy import FUZZY, merge_fuzzy  # noqa: F401
from lingora.operators.glossary import in_locale_order


def merge_exact(segments: DataFrame, previous: DataFrame) -> DataFrame:
    """Segments (source_path, text) beside the earlier entry of the same text; one row for each text of a path."""
    own = segments.groupBy("source_path", "text").agg(F.max_by(F.struct("id", "ord"), "ord").alias("s"))
    old = previous.select("source_path", "text", F.struct(*[c for c in previous.columns if c not in ("source_path", "text")]).alias("p"))
    return own.join(old, ["source_path", "text"], "left").select("source_path", "text", "s.id", "s.ord", F.col("p"))


def deprecated(segments: DataFrame, previous: DataFrame) -> DataFrame:
    """Earlier entries whose text is gone."""
    return previous.join(segments.select("source_path", "text").distinct(), ["source_path", "text"], "left_anti")


def merged_entry(previous: Column, new: Column, fuzzy: Column) -> Column:
    """The entry that stays of an earlier and a new one, with its flags; either may be null."""
    glossary = F.coalesce(new["translation_source"] == "glossary", F.lit(False))
    keep = F.coalesce((previous["translation_source"] == "manual") | previous["approved"], F.lit(False))
    base = F.when(previous.isNull(), new).when(new.isNull(), previous).when(glossary, new).when(keep, previous).otherwise(new)
    machine = F.coalesce((previous["translation_source"] == "machine") & (previous["translation"] != new["translation"]), F.lit(False))
    changed = fuzzy | machine
    own_key = F.coalesce(fuzzy & (F.coalesce(previous["key_source"], F.lit("")) != "manual"), F.lit(False))
    flag = lambda value, off: F.when(glossary, True).when(off, False).otherwise(F.coalesce(value, F.lit(False)))
    return F.struct(
        base["translation"].alias("translation"), base["translation_source"].alias("translation_source"), flag(base["approved"], changed).alias("approved"),
        flag(F.coalesce(base["translation_approved"], base["approved"]), changed).alias("translation_approved"),
        F.when(own_key, new["key"]).otherwise(F.coalesce(base["key"], new["key"])).alias("key"),
        F.when(own_key, new["key_source"]).otherwise(F.coalesce(base["key_source"], new["key_source"])).alias("key_source"),
        flag(F.coalesce(base["key_approved"], base["approved"]), own_key).alias("key_approved"), F.lit(False).alias("deprecated"),
    )


_KINDS = {
    "id": "string", "translation": "string", "translation_source": "string", "approved": "boolean", "translation_approved": "boolean", "key": "string",
    "key_source": "string", "key_approved": "boolean", "skip": "boolean", "deprecated": "boolean",
}


def as_previous(entries: DataFrame) -> DataFrame:
    """(source_path, text, ord, fields of an entry) of a map, its fields named as in its file or with underscores."""
    camel = lambda c: re.sub("_(.)", lambda m: m[1].upper(), c)
    named = lambda c: next((F.col(x) for x in (c, camel(c)) if x in entries.columns), F.lit(None))
    return entries.select("source_path", "text", F.col("ord").cast("int").alias("ord"), *[named(c).cast(k).alias(c) for c, k in _KINDS.items()])


def merge_maps(new: DataFrame, previous: DataFrame, clean_deprecated: bool = False) -> DataFrame:
    """New entries merged with the earlier ones of their files, and the earlier ones that are gone, as deprecated.

    new: (source_path, text, ord, glossary_value, fields of an entry); both have each text of a path once.
    """
    claims = merge_fuzzy(new, previous).select("source_path", "text", "previous_text")
    entry = lambda: F.struct(*_KINDS)
    old = previous.select("source_path", F.col("text").alias("previous_text"), entry().alias("p"))
    both = new.select("source_path", "text", "ord", "glossary_value", entry().alias("n")).join(claims, ["source_path", "text"], "left").join(old, ["source_path", "previous_text"], "left")
    p, n = F.col("p"), F.col("n")
    fuzzy = F.coalesce(F.col("previous_text") != F.col("text"), F.lit(False))
    glossary = n["translation_source"] == "glossary"
    stays = ~glossary & F.coalesce((p["translation_source"] == "manual") | p["approved"], F.lit(False))
    kept = both.withColumn("e", merged_entry(p, n, fuzzy)).withColumn("id", F.when(fuzzy & ~glossary, F.coalesce(p["id"], n["id"])).otherwise(n["id"]))
    kept = kept.withColumn("skip", F.coalesce(F.when(stays, p["skip"]).otherwise(n["skip"]), F.lit(False)))
    now = kept.select("source_path", "text", "ord", "glossary_value", *[c if c in ("id", "skip") else F.col(f"e.{c}").alias(c) for c in _KINDS])
    if clean_deprecated:
        return now
    claimed = claims.where("previous_text IS NOT NULL").select("source_path", F.col("previous_text").alias("text"))
    gone = deprecated(claimed.unionByName(new.select("source_path", "text")), previous).withColumn("deprecated", F.lit(True)).withColumn("glossary_value", F.lit(None).cast("string"))
    after = new.groupBy("source_path").agg((F.max("ord") + 1).alias("after"))
    gone = gone.join(after, "source_path", "left").withColumn("ord", (F.coalesce("after", F.lit(0)) + F.col("ord")).cast("int"))
    return now.unionByName(gone.select(now.columns))


def base_key(text: Column, translation: Column, glossary_value: Column, existing: Column, ascii_only: bool = False) -> Column:
    return F.coalesce(existing, first_candidate(text, translation, glossary_value, ascii_only), F.concat(F.lit("message_"), key_hash(text)))


def unique_keys(entries: DataFrame) -> DataFrame:
    """entries (path, text, ord, base_key) with key: the first text of a path keeps it, later ones add their hash."""
    first = Window.partitionBy("path", "base_key").orderBy("ord")
    return entries.withColumn("key", F.when(F.row_number().over(first) > 1, F.concat("base_key", F.lit("_"), key_hash(F.col("text")))).otherwise(F.col("base_key")))


def status(e: dict[str, Column]) -> Column:
    """deprecated, skipped, untranslated, ready or pending, in this order of tests."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    ok = yes(e["approved"]) & F.coalesce(e["translation_approved"], F.lit(True)) & F.coalesce(e["key_approved"], F.lit(True)) & (F.coalesce(e["key"], F.lit("")) != "")
    return (
        F.when(yes(e["deprecated"]), "deprecated").when(yes(e["skip"]), "skipped").when(F.trim(F.coalesce(e["translation"], F.lit(""))) == "", "untranslated")
        .when(ok, "ready").otherwise("pending")
    )


def file_stats(entries: DataFrame) -> DataFrame:
    """Counters of each file, from entries (path, status, source)."""
    n = lambda c: F.count_if(c).alias
    states = [n(F.col("status") == s)(s) for s in ("ready", "pending", "skipped", "deprecated", "untranslated")]
    sources = [n((F.col("source") == s) & ~F.col("status").isin("deprecated", "skipped", "untranslated"))(f"by_{s}") for s in ("glossary", "machine", "manual")]
    return entries.groupBy("path").agg(F.count("*").alias("entries"), *states, *sources)


def report(files: DataFrame) -> DataFrame:
    """Ratios over file_stats(): active, translated, approved share, translated share."""
    total = files.agg(*[F.sum(c).alias(c) for c in ("entries", "ready", "pending", "skipped", "deprecated", "untranslated")])
    share = lambda a, b: F.when(b == 0, 0.0).otherwise(F.round(a / b * 100, 1))
    active, done = F.col("ready") + F.col("pending") + F.col("untranslated"), F.col("ready") + F.col("pending")
    return total.select("*", active.alias("active"), done.alias("translated"), (F.col("skipped") + F.col("deprecated")).alias("excluded"), share(F.col("ready"), active).alias("ready_percent"), share(done, active).alias("translated_percent"))


def approve(entries: DataFrame, force: bool = False, include_skipped: bool = False, include_deprecated: bool = False, allow_empty: bool = False) -> DataFrame:
    """entries with `eligible` and the three approvals set where they are.

    Skipped, deprecated and untranslated entries are eligible only if asked for, those without a key never; see derived_keys.
    """
    no = lambda c: ~F.coalesce(c, F.lit(False))
    eligible = (F.lit(include_skipped) | no("skip")) & (F.lit(include_deprecated) | no("deprecated")) & (F.lit(allow_empty) | (F.trim(F.coalesce("translation", F.lit(""))) != "")) & (F.coalesce("key", F.lit("")) != "")
    eligible = eligible | F.lit(force)
    done = {c: F.when(F.col("eligible"), True).otherwise(F.coalesce(c, F.lit(False))) for c in ("approved", "translation_approved", "key_approved")}
    before = {"already": F.coalesce("approved", F.lit(False)), "was_translation": F.coalesce("translation_approved", F.lit(True)), "was_key": F.coalesce("key_approved", F.lit(True)), "eligible": eligible}
    return entries.withColumns(before).withColumns(done)


def derived_keys(entries: DataFrame, ascii_only: bool = False) -> DataFrame:
    """entries (text, translation, key, key_source) with the first candidate where a key is missing."""
    missing = F.coalesce("key", F.lit("")) == ""
    first = first_candidate(F.col("text"), F.col("translation"), F.lit(None).cast("string"), ascii_only)
    found = entries.withColumn("__first", first)
    take = missing & F.col("__first").isNotNull()
    return found.withColumns({"key": F.when(take, F.col("__first")).otherwise(F.col("key")), "key_source": F.when(take, F.coalesce("key_source", F.lit("generated"))).otherwise(F.col("key_source"))}).drop("__first")


def approval_counts(entries: DataFrame) -> DataFrame:
    """Of approve()d entries (source_path, ...): (source_path, total, approved, already, skipped, changed) of each file."""
    done = F.col("already") & F.col("was_translation") & F.col("was_key")
    n = lambda c, name: F.count_if(c).alias(name)
    counts = entries.groupBy("source_path").agg(F.count("*").alias("total"), n(F.col("eligible") & ~done, "approved"), n(F.col("eligible") & done, "already"), n(~F.col("eligible"), "skipped"))
    return counts.withColumn("changed", F.col("approved") > 0)


def adapt_counts(stats: DataFrame, status: DataFrame, files: DataFrame) -> DataFrame:
    """file_stats() with adapt_ready, adapted (of adapt_status) and source_exists (of the files that are there)."""
    out = stats.join(status.select(F.col("source_path").alias("path"), "adapted"), "path", "left").join(files.select("path", F.lit(True).alias("source_exists")).distinct(), "path", "left")
    no = F.lit(False)
    return out.withColumns({"adapt_ready": F.col("ready") > 0, "adapted": F.coalesce("adapted", no), "source_exists": F.coalesce("source_exists", no)})


def top_orphans(stats: DataFrame, most: int = 5) -> DataFrame:
    """The maps without a source that have the most entries."""
    return stats.where("NOT source_exists").orderBy(F.desc("entries"), "path").limit(most)


def top_waiting(stats: DataFrame, most: int = 5) -> DataFrame:
    """The sources that are ready for an adapt and not adapted, those with the most ready entries first."""
    return stats.where("source_exists AND adapt_ready AND NOT adapted").orderBy(F.desc("ready"), "path").limit(most)


def key_conflicts(entries: DataFrame) -> DataFrame:
    """(output, key, owners): keys of an output that several texts claim."""
    return entries.groupBy("output", "key").agg(F.count_distinct("text").alias("owners")).where("owners > 1")


def pretty(package: Column) -> Column:
    """A map of strings as JSON, sorted by key in a locale's order, a pair to each line."""
    text = lambda v: F.substr(F.to_json(F.array(v)), F.lit(2), F.length(F.to_json(F.array(v))) - 2)
    placed = F.array_sort(F.transform(F.map_entries(package), lambda e: F.struct(in_locale_order(e["key"]).alias("order"), e["key"].alias("key"), e["value"].alias("value"))))
    pairs = F.transform(placed, lambda e: F.concat(F.lit("  "), text(e["key"]), F.lit(": "), text(e["value"])))
    return F.when(F.size(package) > 0, F.concat(F.lit("{\n"), F.array_join(pairs, ",\n"), F.lit("\n}"))).otherwise("{}")


def packages(entries: DataFrame, locale: Column, out_dir: str = "locales", kind: str = "json", namespace: str = "") -> DataFrame:
    """(output, package, sources): one map of keys to translations for each output, in a locale's order, and the files that fed it."""
    rows = entries.withColumn("output", locale_output_path(F.col("path"), locale, out_dir, kind, namespace))
    one = rows.groupBy("output", "key").agg(F.max_by("translation", "ord").alias("translation"), F.collect_set("path").alias("paths"))
    return one.groupBy("output").agg(F.to_json(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct(in_locale_order(F.col("key")).alias("order"), "key", "translation"))), lambda e: F.struct(e["key"], e["translation"])))).alias("package"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("paths")))).alias("sources"))


def translate(texts: DataFrame, backend, retries: int = 3, beside: list[str] | None = None) -> DataFrame:
    """(text, translation): distinct texts only, in Arrow batches, each batch tried again and then text by text.

    beside: columns of strings that tell texts apart too, and stay.

    backend(list of texts) -> list of translations; it runs in Python workers and is made once for each partition.
    """

    def attempt(batch: list[str]) -> list[str]:
        for left in range(retries, -1, -1):
            try:
                out = backend(batch)
                if len(out) != len(batch):
                    raise ValueError("a backend must answer every text")
                return out
            except Exception as error:
                if not left:
                    if len(batch) > 1:
                        return [x for t in batch for x in attempt([t])]
                    raise RuntimeError(f"no translation of {batch[0][:40]!r}") from error
        return []

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(translation=attempt(frame.text.tolist()))

    columns = ["text", *(beside or [])]
    return texts.select(*columns).distinct().mapInPandas(run, ", ".join(f"`{c}` string" for c in [*columns, "translation"]))


def changed_files(now: DataFrame, before: DataFrame) -> DataFrame:
    """Files (path, hash) that are new or have another hash than before."""
    old = before.select("path", F.col("hash").alias("old_hash"))
    return now.join(old, "path", "left").where(~F.col("hash").eqNullSafe(F.col("old_hash"))).select("path", "hash")
