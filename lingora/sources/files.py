"""Source files, translation maps and configuration as tables."""

from __future__ import annotations

import copy
import fnmatch
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lingora.sources import dims

# Extensions that have a parser, and the default configuration.
EXTENSIONS = ["vue", "ts", "tsx", "js", "jsx", "json", "html", "css", "scss", "less", "md", "yaml", "yml"]
DEFAULTS = {
    "source_locale": "zh", "target_locale": "en", "include": ["src/**/*.{" + ",".join(EXTENSIONS) + "}"], "exclude": ["node_modules", "dist", "**/*.test.ts", "**/*.spec.ts", "**/i18n/**"],
    "rules": dims.RULES, "translator": {"timeout": 30000, "retries": 3, "concurrency": 5}, "batch_size": 20, "convert": {"out_dir": "locales", "format": "json"},
    "adapt": {"separator": ".", "namespace": "", "vue": "$t", "script": "t"},
}
MAP_ROOT = ".tmigrate/maps/"
ENTRY = (
    "id string, translation string, translationSource string, approved boolean, translationApproved boolean, key string, keySource string, keyApproved boolean,"
    " keyCandidates array<string>, skip boolean, location struct<line:int,column:int,context:string>, deprecated boolean"
)
MAP = f"version int, generatedAt string, entries map<string, struct<{ENTRY.replace(' ', ':').replace(',:', ',').replace('struct<line:int,column:int,context:string>', 'struct<line:int,column:int,context:string>')}>>"


def merged(base: dict, *layers: dict) -> dict:
    """Nested settings, later layers over earlier ones; lists are replaced whole."""
    out = copy.deepcopy(base)
    for layer in layers:
        for k, v in layer.items():
            out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def config(file: dict | None = None, override: dict | None = None) -> dict:
    """Defaults under a file's settings under a caller's; the output folder is never scanned."""
    out = merged(DEFAULTS, file or {}, override or {})
    out["exclude"] = [*out["exclude"], f"{out['convert']['out_dir']}/**"]
    return out


def glob_regex(pattern: str) -> str:
    """A path pattern with **, * and {a,b} as a regular expression for whole paths."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "{" and "}" in pattern[i:]:
            end = pattern.index("}", i)
            out, i = out + "(?:" + "|".join(map(re.escape, pattern[i + 1 : end].split(","))) + ")", end + 1
        else:
            out, i = out + re.escape(pattern[i]), i + 1
    return f"^{out}\\z"


def selected(path: Column, include: list[str], exclude: list[str]) -> Column:
    """Whether a path is included and not excluded; a bare exclusion also covers what is below it."""
    wider = [y for x in exclude for y in ((x,) if any(c in x for c in "*{") else (x, f"{x}/**"))]
    any_of = lambda ps: path.rlike("|".join(map(glob_regex, ps))) if ps else F.lit(False)
    return any_of(include) & ~any_of(wider)


def narrowed(target: str) -> list[str]:
    """The include list for one file or folder."""
    return [target] if fnmatch.fnmatch(target.rsplit("/", 1)[-1], "*.*") else [f"{target.rstrip('/')}/**/*.{{{','.join(EXTENSIONS)}}}"]


def source_files(spark: SparkSession, root: str, settings: dict, target: str | None = None) -> DataFrame:
    """(path, content, hash) of a project's files; content is decoded once, hashes are of bytes."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").removeprefix("file:")
    path = F.regexp_replace("path", "^.*?" + re.escape(base) + "/", "")
    include = narrowed(target) if target else settings["include"]
    found = raw.select(path.alias("path"), "content").where(selected(F.col("path"), include, settings["exclude"]))
    return found.select("path", F.decode("content", "UTF-8").alias("content"), F.sha2("content", 256).alias("hash"))


def map_path(path: Column) -> Column:
    return F.concat(F.lit(MAP_ROOT), path, F.lit(".json"))


def source_of_map(path: Column) -> Column:
    ok = path.startswith(MAP_ROOT) & path.endswith(".json")
    inner = F.substr(path, F.lit(len(MAP_ROOT) + 1), F.length(path) - len(MAP_ROOT) - 5)
    return F.when(ok, inner).otherwise(F.raise_error(F.concat(F.lit("not a map file: "), path)))


def of_target(files: DataFrame, target: str | None) -> DataFrame:
    """Map files (path, content) of a source file, or of those in a folder."""
    wanted = (target or "").replace("\\", "/").rstrip("/")
    source = source_of_map(F.col("path"))
    return files.where((source == wanted) | source.startswith(f"{wanted}/")) if wanted else files


def maps(files: DataFrame, target: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Map files (path, content) as entries (source_path, text, entry fields), and those that do not parse (path, error)."""
    parsed = of_target(files, target).withColumn("map", F.from_json("content", MAP)).withColumn("ok", F.try_parse_json("content").isNotNull() & F.col("map.entries").isNotNull())
    entries = parsed.where("ok").select(source_of_map(F.col("path")).alias("source_path"), F.posexplode("map.entries").alias("ord", "text", "e")).select("source_path", "ord", "text", "e.*")
    return entries, parsed.where("NOT ok").select("path", F.lit("not a translation map").alias("error"))


def first_invalid(invalid: DataFrame, most: int = 5) -> DataFrame:
    """The first of the map files that do not parse, and how many there are besides."""
    return invalid.orderBy("path").limit(most).join(invalid.agg(F.greatest(F.count("*") - most, F.lit(0)).alias("others")))


def package_files(spark: SparkSession, root: str, settings: dict) -> DataFrame:
    """(path, content, hash) of the locale packages of a folder, in a locale's order."""
    found = source_files(spark, root, settings | {"include": ["**/*.{json,js,ts}"], "exclude": []})
    return found.orderBy(F.collate("path", "UNICODE"), "path")


def orphaned(entries: DataFrame, files: DataFrame) -> DataFrame:
    """Source paths of maps whose file is gone."""
    return entries.select("source_path").distinct().join(files.select(F.col("path").alias("source_path")), "source_path", "left_anti")


def map_json(entries: DataFrame, stamp: str) -> DataFrame:
    """(path, content) of map files for entries; a file's entries are kept in their order."""
    fields = [c for c in entries.columns if c not in ("source_path", "ord", "text")]
    rows = entries.groupBy("source_path").agg(F.array_sort(F.collect_list(F.struct("ord", "text", F.struct(*fields).alias("e")))).alias("r"))
    body = F.map_from_entries(F.transform("r", lambda x: F.struct(x["text"], x["e"])))
    return rows.select(map_path(F.col("source_path")).alias("path"), F.to_json(F.struct(F.lit(2).alias("version"), F.lit(stamp).alias("generatedAt"), body.alias("entries"))).alias("content"))
