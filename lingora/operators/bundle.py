"""Page scripts' table operations: recognition of a text's language, node queue, histories, keys, object translation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lingora.functions.text import java_hash
from lingora.operators import runs as R
from lingora.session import durable

# Languages whose words have no spaces between them; those that a page may declare for romance text.
UNSPACED = ["chinese_simplified", "chinese_traditional", "korean", "japanese"]
VARIETIES = ["french", "italian", "deutsch", "portuguese"]


def recognized(runs: DataFrame, texts: DataFrame, key: str = "id", local: str | None = None) -> DataFrame:
    """(key, language, chars) for runs (key, run_idx, lang, text) of texts (key, text).

    The language with the most characters (the first on a tie), then four corrections in order.
    """
    sizes = runs.groupBy(key, "lang").agg(F.sum(F.length("text")).alias("n"), F.min("run_idx").alias("first"))
    n = lambda lang: F.coalesce(F.sum(F.when(F.col("lang") == lang, F.col("n"))), F.lit(0))
    one = sizes.groupBy(key).agg(
        F.min_by("lang", F.struct(-F.col("n"), "first")).alias("l0"), F.sum("n").alias("chars"), n("english").alias("en"), n("romance").alias("ro"),
        n("japanese").alias("ja"), n("chinese_simplified").alias("zs"), n("chinese_traditional").alias("zt"),
    )
    one = one.join(texts.select(key, "text"), key)
    own = F.lit(local) if local in VARIETIES else R.romance(F.col("text"))
    over = lambda a, b, share: (b > 0) & (a > 0) & (a / b > share)
    steps = [
        lambda l: F.when((l == "english") & over(F.col("ro"), F.col("en"), 0.008), own).otherwise(l),
        lambda l: F.when((l != "japanese") & over(F.col("ja"), F.col("chars"), 0.08), "japanese").otherwise(l),
        lambda l: F.when((l == "english") & over(F.col("zs") + F.col("zt"), F.col("en"), 0.05), "chinese_simplified").otherwise(l),
        lambda l: F.when((l == "chinese_simplified") & over(F.col("zt"), F.col("zs"), 0.03), "chinese_traditional").otherwise(l),
    ]
    for i, step in enumerate(steps):
        one = one.withColumn(f"l{i + 1}", step(F.col(f"l{i}")))
    return one.select(key, F.col("l4").alias("language"), "chars")


def spaced(runs: DataFrame, local: str, target: str, key: str = "id") -> DataFrame:
    """runs with before and after: a space at a boundary where the page's language needs none and the target's does."""
    if local not in UNSPACED or target in UNSPACED:
        return runs.select("*", F.lit("").alias("before"), F.lit("").alias("after"))
    w = Window.partitionBy(key).orderBy("run_idx")
    edge = lambda other, ends: F.when(other.isNotNull() & ~other.rlike(ends), " ").otherwise("")
    return runs.select("*", edge(F.lag("text").over(w), r"\s\z").alias("before"), edge(F.lead("text").over(w), r"^\s").alias("after"))


def node_queue(nodes: DataFrame, target: str) -> DataFrame:
    """(lang, hash, original, n_nodes, first_node) of nodes (node, lang, text): texts of a language once.

    The nodes that show a text stay rows (queued), for a text may be on very many of them.
    """
    return queued(nodes, target).groupBy("lang", "hash").agg(F.min_by("text", "node").alias("original"), F.count("*").cast("int").alias("n_nodes"), F.min("node").alias("first_node"))


def queued(nodes: DataFrame, target: str) -> DataFrame:
    """nodes (node, lang, text) that wait for a translation, once each, with the hash of their text."""
    return nodes.where(F.col("lang") != target).withColumn("hash", java_hash(F.col("text"))).dropDuplicates(["node", "lang", "text"])


def without_echo(source: Column, result: Column) -> Column:
    """A result that just repeats its source within other words gives way to the source."""
    return F.when(F.contains(F.lower(result), F.lower(source)), source).otherwise(result)


def histories(renders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(original, result) and (result, original) of renders (seq, original, result): the last one counts."""
    forth = renders.groupBy("original").agg(F.max_by("result", "seq").alias("result"))
    return forth, renders.groupBy("result").agg(F.max_by("original", "seq").alias("original"))


def matching_keys(keys: DataFrame, pattern: str, column: str = "key") -> DataFrame:
    """Keys that a pattern with * for anything matches whole."""
    regex = ".*".join("\\Q" + p + "\\E" for p in pattern.split("*"))
    return keys.where(F.col(column).rlike(rf"^(?s:{regex})\z"))


def cached(asked: DataFrame, cache: DataFrame) -> DataFrame:
    """asked (to, text) with the cached translation of its hash, if any: texts of equal hash share an entry."""
    rows = asked.withColumn("hash", java_hash(F.col("text")))
    return rows.join(cache.select("to", "hash", "translation"), ["to", "hash"], "left")


#: Copies of a translation that the objects with its text are dealt over.
SALTS = 8
_STRING = r'"[^"\\]*(?:\\.[^"\\]*)*"'


def objects_of(objects: DataFrame) -> DataFrame:
    """Those of (id, value) that are JSON objects or arrays, with `v`, the value as a variant."""
    return objects.withColumn("v", F.try_parse_json("value")).where(F.schema_of_variant("v").rlike("^(OBJECT|ARRAY)"))


def object_strings(objects: DataFrame) -> DataFrame:
    """(id, path, text) of the values in JSON objects and arrays (id, value), to any depth; null values stay out.

    Variants are opened level by level, until a level has nothing nested in it.
    """
    spark = objects.sparkSession
    level = objects_of(objects).select("id", F.array().cast("array<string>").alias("at"), "v")
    out = None
    while True:
        inside = level.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).toDF("pos", "key", "item")).select("id", F.array_append("at", F.coalesce("key", F.col("pos").cast("string"))).alias("at"), F.col("item").alias("v"))
        rows = durable(inside.withColumn("kind", F.schema_of_variant("v")).withColumn("nested", F.col("kind").rlike("^(OBJECT|ARRAY)")))
        text = F.when(F.col("kind") == "STRING", F.try_variant_get("v", "$", "string")).otherwise(F.to_json("v"))
        leaves = rows.where("NOT nested AND kind <> 'VOID'").select("id", F.array_join("at", ".").alias("path"), text.alias("text"))
        out = leaves if out is None else out.unionByName(leaves)
        level = rows.where("nested").select("id", "at", "v")
        if level.isEmpty():
            return out


def object_tokens(objects: DataFrame) -> DataFrame:
    """(id, pos, token, text) of JSON objects and arrays: their characters in order, with the text of those tokens that are string values."""
    pieces = F.regexp_extract_all("value", F.lit(rf'(?s)({_STRING}\s*:?|[^"]+)'), 1)
    rows = objects_of(objects).select("id", F.posexplode(pieces).alias("pos", "token"))
    value = F.col("token").startswith('"') & ~F.col("token").endswith(":")
    return rows.withColumn("text", F.when(value, F.get(F.from_json(F.concat(F.lit("["), F.trim("token"), F.lit("]")), "array<string>"), F.lit(0))))


def looked_up(tokens: DataFrame, translations: DataFrame) -> DataFrame:
    """tokens with the translation of their text, if any.

    Most tokens have no text to look up, and some texts are in very many objects: neither goes to one task.
    """
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt")
    known = translations.where("translation IS NOT NULL").select("*", copies)
    own = F.xxhash64("id", "pos")
    salted = tokens.withColumn("salt", F.when(F.col("text").isNull(), own).otherwise(F.pmod(own, F.lit(SALTS))))
    return salted.join(known, ["text", "salt"], "left").drop("salt")


def translated_objects(objects: DataFrame, translations: DataFrame) -> DataFrame:
    """objects (id, value) with their strings translated where translations (text, translation) have them.

    Each string value is put back in its place, so keys, other values, their order and the spaces between them stay. id tells
    objects apart; what is no object or array stays as it is.
    """
    tokens = looked_up(object_tokens(objects), translations)
    put = F.to_json(F.array("translation"))
    token = F.when(F.col("translation").isNull(), F.col("token")).otherwise(F.concat(F.substr(put, F.lit(2), F.length(put) - 2), F.regexp_extract("token", r"(\s*)\z", 1)))
    whole = tokens.select("id", "pos", token.alias("token")).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("all"))
    done = whole.select("id", F.array_join(F.transform("all", lambda t: t["token"]), "").alias("__done"))
    return objects.join(done, "id", "left").select("id", F.coalesce("__done", "value").alias("value"))


def filled(entries: DataFrame, fresh: DataFrame) -> DataFrame:
    """entries with fresh translations (text, translation, translation_source) where they have none."""
    new = fresh.select("text", F.col("translation").alias("__new"), F.col("translation_source").alias("__from"))
    empty = F.coalesce("translation", F.lit("")) == ""
    take = empty & (F.coalesce("__new", F.lit("")) != "")
    out = {"translation": F.when(take, F.col("__new")).otherwise(F.col("translation")), "translation_source": F.when(take, F.col("__from")).otherwise(F.col("translation_source"))}
    return entries.join(new, "text", "left").withColumns(out).select(*entries.columns)


def strided(items: DataFrame, order: list[str], partition: list[str], size: int, workers: int) -> DataFrame:
    """items with batch (by `size` in order) and worker (batches dealt in turn)."""
    place = F.row_number().over(Window.partitionBy(*partition).orderBy(*order)) - 1
    return items.withColumn("batch", F.floor(place / max(1, size)).cast("int")).withColumn("worker", F.pmod("batch", F.lit(workers)))


def next_files(files: DataFrame, whole: bool = False) -> DataFrame:
    """Files that wait for an adapt, by path: the first, or all of them."""
    waiting = files.where("ready > 0").orderBy("path")
    return waiting if whole else waiting.limit(1)


def lru_victim(models: DataFrame) -> DataFrame:
    """The model (id, last_access, ref_count, loading) of each pool that is dropped next: unused, and unused for longest."""
    free = models.where("ref_count = 0 AND NOT loading")
    return free.groupBy("pool").agg(F.min_by("id", F.struct("last_access", "id")).alias("victim"))


def batch_summary(texts: Column, most: int = 40) -> Column:
    """A short sample of a batch for an error message."""
    joined = F.array_join(texts, ", ")
    return F.when(F.length(joined) > most, F.concat(F.substr(joined, F.lit(1), F.lit(most)), F.lit("..."))).otherwise(joined)
