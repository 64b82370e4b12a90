"""The commands of the workflow as functions from tables to tables; writing is the caller's last step."""

from __future__ import annotations

import json
import re
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from lingora.functions import text as T
from lingora.operators import glossary as G
from lingora.operators import mapping as M
from lingora.operators import segments as S
from lingora.operators import terms as W
from lingora.operators.script import script_segments
from lingora.sources import files as S_files

SCRIPTS = ["vue", "js", "ts", "jsx", "tsx", "mjs", "cjs"]


def all_segments(files: DataFrame) -> DataFrame:
    """Segments of all kinds of files: scripts by the lexer, the others by built-in functions on their content."""
    kind = F.lower(F.element_at(F.split("path", r"\."), -1))
    simple = F.when(kind == "json", S.json_values(F.col("content"))).when(kind == "html", S.html_texts(F.col("content")))
    simple = simple.when(kind.isin("css", "scss", "less"), S.css_contents(F.col("content"))).when(kind.isin("yaml", "yml"), S.yaml_values(F.col("content")))
    context = F.when(kind == "json", "json-value").when(kind == "html", "html-text").when(kind.isin("css", "scss", "less"), "style").otherwise("yaml-value")
    others = files.where(~kind.isin(*SCRIPTS, "md")).select("path", context.alias("context"), F.posexplode(simple).alias("seg_idx", "text"))
    marked = S.lines(files.where(kind == "md").withColumn("content", S.masked_markdown(F.col("content"))), F.col("path"), "content").select("path", F.lit("markdown").alias("context"), "seg_idx", "text")
    coded = script_segments(files.where(kind.isin(*SCRIPTS))).select("path", "context", "seg_idx", "text")
    return others.unionByName(marked).unionByName(coded)


def scan(files: DataFrame, known: DataFrame, glossary: DataFrame, settings: dict, backend, previous: DataFrame | None = None, clean_deprecated: bool = False) -> DataFrame:
    """Entries (source_path, ord, text, translation, translation_source, key, ...) of the files that changed.

    A glossary answers first, then terms compose, then the backend translates what is left: each distinct text once,
    over all files, with its placeholders protected. Entries of `previous` (the map before) are merged before keys are
    given: work by hand, approvals and keys stay, and what is gone from a changed file comes last, deprecated.
    """
    changed = M.changed_files(files.select("path", "hash"), known)
    segments = all_segments(files.join(changed.select("path"), "path", "left_semi"))
    wanted = segments.where(S.should_translate(F.col("text"), F.col("context"), F.lit(settings["source_locale"]), settings["rules"]))
    matched = G.match(wanted, glossary)
    placed = W.occurrences(matched.withColumn("key", F.struct("path", "context", "seg_idx")), glossary).drop("key")
    composed = placed.withColumn("known", F.coalesce("glossary_value", W.composed("text", "found")))
    left = composed.where("known IS NULL").select(T.protect(F.col("text")).alias("text"))
    machine = M.translate(left, backend, settings["translator"]["retries"]).withColumnRenamed("text", "shielded")
    done = composed.withColumn("shielded", T.protect(F.col("text"))).join(machine, "shielded", "left")
    plain = T.restore(F.col("translation"), T.placeholders(F.col("text")))
    put_right = W.enforced(plain, F.col("found"))
    one = done.select("path", "text", "seg_idx", F.coalesce("known", put_right).alias("translation"), F.when(F.col("known").isNotNull(), "glossary").otherwise("machine").alias("translation_source"), "glossary_value")
    first = one.groupBy("path", "text").agg(F.min_by(F.struct("seg_idx", "translation", "translation_source", "glossary_value"), "seg_idx").alias("s")).select("path", "text", F.col("s.seg_idx").alias("ord"), "s.translation", "s.translation_source", "s.glossary_value")
    approved = F.col("translation_source") == "glossary"
    candidate = F.try_element_at(T.key_candidates(F.col("text"), F.col("translation"), F.col("glossary_value")), F.lit(1))
    fresh = first.withColumnRenamed("path", "source_path").withColumns({
        "id": T.segment_id(F.col("text"), F.col("source_path")), "approved": approved, "translation_approved": approved, "key": candidate, "key_source": F.lit("generated"),
        "key_approved": approved, "skip": F.lit(False), "deprecated": F.lit(False),
    })
    if previous is not None:
        before = M.as_previous(previous).join(changed.select(F.col("path").alias("source_path")), "source_path", "left_semi")
        fresh = M.merge_maps(fresh, before, clean_deprecated).withColumn("key", T.normalize_key(F.col("key")))
    keyed = fresh.withColumn("own_key", F.col("key")).withColumn("path", F.col("source_path"))
    keyed = M.unique_keys(keyed.withColumn("base_key", M.base_key(F.col("text"), F.col("translation"), F.col("glossary_value"), F.col("own_key"))))
    yes = F.coalesce("translation_approved", "approved", F.lit(False)) & F.coalesce("key_approved", "approved", F.lit(False)) & F.col("key").eqNullSafe(F.col("own_key"))
    manual = F.when(F.col("own_key").isNotNull() & (F.col("key_source") == "manual"), "manual").otherwise("generated")
    return keyed.select(
        "source_path", "ord", "text", "translation", "translation_source", "key", yes.alias("approved"), "id", "translation_approved", manual.alias("key_source"),
        F.coalesce("key_approved", "approved").alias("key_approved"), "skip", "deprecated",
    )


def call(callee: Column, key: Column, params: Column) -> Column:
    """callee('key') or callee('key', { name: expression, ... })."""
    quoted = F.concat(F.lit("'"), F.replace(F.replace(key, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.concat(callee, F.lit("("), quoted, F.when(F.size(params) > 0, F.concat(F.lit(", { "), F.array_join(params, ", "), F.lit(" }"))).otherwise(""), F.lit(")"))


def replacement(segment: dict[str, Column], content: Column, key: Column, params: Column, settings: dict) -> Column:
    """struct(start, end, value) that puts a call in a segment's place; null where its kind has none."""
    start, end, node = segment["start"], segment["end"], segment["node_type"]
    vue, script = call(F.lit(settings["vue"]), key, params), call(F.lit(settings["script"]), key, params)
    before, after = F.substr(content, start, F.lit(1)), F.substr(content, end + 1, F.lit(1))
    in_quotes = (before == after) & before.isin("'", '"')
    attr = F.regexp_extract(F.substr(content, F.lit(1), start), r"""([:@A-Za-z_][\w:.-]*)\s*=\s*["'][^"'<>]*\z""", 0)
    name = F.regexp_extract(attr, r"^([:@A-Za-z_][\w:.-]*)", 1)
    edit = lambda a, b, v: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"), v.alias("value"))
    braces = lambda v: F.concat(F.lit("{"), v, F.lit("}"))
    return (
        F.when(node == "VueTemplateText", edit(start, end, F.concat(F.lit("{{ "), vue, F.lit(" }}"))))
        .when((node == "VueStaticAttribute") & (attr != ""), edit(start - F.length(attr), end + 1, F.concat(F.lit(":"), name, F.lit('="'), vue, F.lit('"'))))
        .when((node == "VueDirectiveStringLiteral") & in_quotes, edit(start - 1, end + 1, vue))
        .when((node == "StringLiteral") & in_quotes, edit(start - 1, end + 1, script))
        .when((node == "JSXStringLiteral") & in_quotes, edit(start - 1, end + 1, braces(script)))
        .when(node == "JSXText", edit(start, end, braces(script)))
        .when((node == "TemplateElement") & (before == "`") & (after == "`"), edit(start - 1, end + 1, script))
    )


# Calls that a component's compiler hoists out of its setup.
MACROS = ["defineProps", "defineEmits", "defineModel", "defineOptions", "defineSlots", "withDefaults"]


@F.pandas_udf(BooleanType())
def in_call(content: pd.Series, place: pd.Series, names: pd.Series) -> pd.Series:
    """Whether a place is between the parentheses of a call of one of the names (joined by bars)."""

    def one(text: str, at: int, pattern: str) -> bool:
        for m in re.finditer(rf"\b(?:{pattern})\s*(?:<[^()]*?>)?\(", text[:at]):
            if 1 + text.count("(", m.end(), at) - text.count(")", m.end(), at) > 0:
                return True
        return False

    return pd.Series([one(t, int(a), n) for t, a, n in zip(content, place, names)], dtype=bool)


def _spliced(files: DataFrame, edits: DataFrame) -> DataFrame:
    """(path, content, changed) with the edits (path, e) made."""
    per = edits.groupBy("path").agg(F.collect_list("e").alias("edits"))
    out = files.select("path", F.col("content").alias("old")).join(per, "path")
    return out.select("path", "old", S.splice(F.col("old"), F.col("edits")).alias("content"), F.size("edits").alias("changed"))


def adapt(files: DataFrame, entries: DataFrame, settings: dict, imports: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Files with ready texts as calls (path, old, content, changed), and what was skipped (path, text, key, reason).

    imports: a line that scripts with a changed text and without it get at their top.
    """
    ready = entries.where("approved AND coalesce(translation_approved, true) AND coalesce(key_approved, true) AND NOT coalesce(skip, false) AND NOT coalesce(deprecated, false)")
    found = script_segments(files).join(ready.select(F.col("source_path").alias("path"), "text", "key"), ["path", "text"]).join(files.select("path", "content"), "path")
    holes = F.array_distinct(T.placeholders(F.col("text")))
    params = F.transform(holes, lambda h: F.regexp_replace(h, r"^(?:\{\{|\$\{)\s*|\s*(?:\}\}|\})\z", ""))
    params = F.transform(params, lambda p: F.concat(F.regexp_replace(p, r"[^\w$]+", "_"), F.lit(": "), p))
    reference = T.namespace_key(F.col("path"), F.col("key"), settings["separator"], settings.get("namespace", ""), settings.get("mode") == "local")
    no_key = F.coalesce("key", F.lit("")) == ""
    macro = F.col("path").endswith(".vue") & in_call(F.col("content"), F.col("start"), F.lit("|".join(settings.get("skip_macros", MACROS))))
    edit = replacement({c: F.col(c) for c in ("start", "end", "node_type")}, F.col("content"), reference, params, settings)
    placed = found.withColumn("macro", macro).withColumn("e", F.when(~no_key & ~F.col("macro"), edit))
    reason = F.when(no_key, "missing-key").when(F.col("macro"), "vue-compiler-macro").otherwise("unsupported-context")
    skipped = placed.where("e IS NULL").select("path", "text", "key", reason.alias("reason"))
    edits = placed.where("e IS NOT NULL").select("path", F.struct("e.start", "e.end", F.col("seg_idx").alias("ord"), "e.value").alias("e"))
    out = _spliced(files, edits)
    if imports:
        lacks = ~F.contains("content", F.lit(imports))
        in_script = F.regexp_replace("content", r"(<script[^>]*>)", "$1\n" + re.sub(r"([\\$])", r"\\\1", imports))
        out = out.withColumn("content", F.when(lacks & F.col("path").endswith(".vue"), in_script).when(lacks, F.concat(F.lit(imports + "\n"), F.col("content"))).otherwise(F.col("content")))
    return out, skipped


def apply(files: DataFrame, entries: DataFrame) -> DataFrame:
    """Files with approved translations in place of their texts (path, old, content, changed); old is the backup.

    Skipped entries stay as they are. Scripts, data, pages, styles and texts are rewritten, each with its own escapes.
    """
    ready = entries.where("approved AND coalesce(translation, '') <> '' AND NOT coalesce(skip, false)").select(F.col("source_path").alias("path"), "text", "translation")
    kind = F.lower(F.element_at(F.split("path", r"\."), -1))
    scripts = files.where(kind.isin(*SCRIPTS))
    coded = script_segments(scripts).join(scripts.select("path", "content"), "path")
    before, after = F.substr("content", F.col("start"), F.lit(1)), F.substr("content", F.col("end") + 1, F.lit(1))
    quote = F.when((before == after) & before.isin("'", '"', "`"), before).otherwise("")
    coded = coded.select("path", "text", "start", "end", "seg_idx", "context", quote.alias("quote"))
    placed = files.where(~kind.isin(*SCRIPTS)).select("path", F.posexplode(S.places(F.col("content"), kind)).alias("seg_idx", "p"))
    placed = placed.select("path", "p.text", "p.start", "p.end", "seg_idx", "p.context", "p.quote")
    found = coded.unionByName(placed).join(ready, ["path", "text"])
    edits = found.select("path", F.struct("start", "end", F.col("seg_idx").alias("ord"), T.escape(F.col("translation"), F.col("context"), F.col("quote")).alias("value")).alias("e"))
    return _spliced(files, edits)


def restore(applied: DataFrame) -> DataFrame:
    """(path, content) as it was before this one apply; operators/versions.py keeps all of them, by batch."""
    return applied.select("path", F.col("old").alias("content"))


def dry_run(applied: DataFrame) -> DataFrame:
    """(path, diff) of what a command would change."""
    return applied.select("path", F.array_join(S.line_diff(F.col("old"), F.col("content")), "\n").alias("diff"))


def convert(entries: DataFrame, locale: str, settings: dict) -> DataFrame:
    """(output, package, sources) of ready entries; fails if two texts claim one key of an output."""
    stated = entries.withColumn("status", M.status({c: F.col(c) for c in entries.columns})).where("status = 'ready'").withColumn("path", F.col("source_path"))
    c = settings["convert"]
    rows = stated.withColumn("output", T.locale_output_path(F.col("path"), F.lit(locale), c["out_dir"], c["format"], c.get("namespace", "")))
    clash = M.key_conflicts(rows).limit(1).collect()
    if clash:
        raise ValueError(f"key {clash[0].key!r} of {clash[0].output} has {clash[0].owners} texts")
    body = M.pretty(F.from_json("package", "map<string,string>"))
    written = F.concat(F.lit("" if c["format"] == "json" else "export default "), body, F.lit("\n"))
    packages = M.packages(stated, F.lit(locale), c["out_dir"], c["format"], c.get("namespace", ""))
    return packages.withColumn("package", written)


def translate_package(files: DataFrame, backend, retries: int = 3) -> DataFrame:
    """Existing JSON packages (path, content) with their values translated, keys and layout as they were."""
    values = files.select("path", "content", F.explode(F.array_distinct(S.json_values(F.col("content")))).alias("text")).where("text <> ''")
    done = M.translate(values, backend, retries)
    pairs = values.join(done, "text").groupBy("path").agg(F.collect_list(F.struct((-F.length("text")).alias("less"), "text", "translation")).alias("pairs"))
    quoted = lambda t: F.concat(F.lit('"'), t, F.lit('"'))
    filled = F.aggregate(F.array_sort("pairs"), F.col("content"), lambda acc, p: F.regexp_replace(acc, F.concat(F.lit(r"\Q"), quoted(p["text"]), F.lit(r"\E(?!\s*:)")), F.regexp_replace(quoted(T.escape_json(p["translation"])), r"([\\$])", r"\\$1")))
    return files.join(pairs, "path", "left").select("path", F.when(F.col("pairs").isNull(), F.col("content")).otherwise(filled).alias("content"))


def package_paths(path: Column, source_dir: str, source_locale: str, target_locale: str, output_dir: str | None = None) -> Column:
    """Where the translation of a package's file goes; a folder in the source's own is refused."""
    source = source_dir.rstrip("/")
    parent, _, name = source.rpartition("/")
    same = name.lower().replace("_", "-") == source_locale.lower().replace("_", "-")
    target = (output_dir or "/".join(x for x in (parent, target_locale if same else f"{name}-{target_locale}") if x)).rstrip("/")
    if f"{target}/".startswith(f"{source}/"):
        raise ValueError("a translation's folder must be outside of its source")
    return F.concat(F.lit(target), F.substr(path, F.lit(len(source) + 1)))


def translate_locale(files: DataFrame, existing: DataFrame, backend, source_dir: str, source_locale: str, target_locale: str, output_dir: str | None = None, overwrite: bool = False, retries: int = 3) -> DataFrame:
    """(source_path, path, content, skipped, changed): packages of a folder in another locale.

    existing: files (path, content) at the targets; these are left alone unless overwrite.
    """
    done = translate_package(files, backend, retries).select(F.col("path").alias("source_path"), package_paths(F.col("path"), source_dir, source_locale, target_locale, output_dir).alias("path"), "content")
    there = done.join(existing.select("path", F.col("content").alias("before")), "path", "left")
    skipped = F.col("before").isNotNull() & ~F.lit(overwrite)
    return there.select("source_path", "path", "content", skipped.alias("skipped"), (~skipped & ~F.col("before").eqNullSafe(F.col("content"))).alias("changed"))


def init(root: str, settings: dict, overwrite: bool = True) -> dict[str, list[str]]:
    """Makes a project's folder with its configuration and an empty glossary; what is there stays unless overwrite."""
    home, made, left = Path(root) / ".tmigrate", [], []
    for folder in ("maps", "cache", "backups"):
        (home / folder).mkdir(parents=True, exist_ok=True)
        made.append(f".tmigrate/{folder}")
    wanted = {"config.json": (json.dumps(settings, indent=2, ensure_ascii=False) + "\n", overwrite), "glossary.json": ("{}\n", overwrite)}
    wanted |= {f"{folder}/.gitkeep": ("", False) for folder in ("maps", "cache", "backups")}
    for name, (text, again) in wanted.items():
        if (home / name).exists() and not again:
            left.append(f".tmigrate/{name}")
        else:
            (home / name).write_text(text)
            made.append(f".tmigrate/{name}")
    return {"created": made, "skipped": left}


def adapt_status(entries: DataFrame, refs: DataFrame) -> DataFrame:
    """(source_path, adapted): whether the references id:key of ready entries are those of the last adapt (refs)."""
    now = entries.where("approved AND key IS NOT NULL").groupBy("source_path").agg(F.array_sort(F.collect_list(F.concat("id", F.lit(":"), "key"))).alias("now"))
    return now.join(refs.select("source_path", F.array_sort("refs").alias("was")), "source_path", "left").select("source_path", F.col("now").eqNullSafe(F.col("was")).alias("adapted"))


source_files = S_files.source_files
