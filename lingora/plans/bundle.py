"""Queries on page scripts' operations, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lingora.functions import text as T
from lingora.operators import bundle as B
from lingora.operators import runs as R
from lingora.plans.workflow import _ENTRIES, _entries
from lingora.plans.language import _values
from lingora.session import table

TEXTS = [(1, "Hello world"), (2, "bonjour à tous, été"), (3, "これは日本語の文です"), (4, "你好 hello"), (5, "國家國家国"), (6, "ñandú llama hello there"), (7, "Привет мир"), (8, "漢字とかな text in English here")]


def recognize_language(spark, sf_dir):
    texts = spark.createDataFrame(TEXTS, "id int, text string")
    return B.recognized(R.language_runs(texts), texts)


def recognize_documents(spark, sf_dir):
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return B.recognized(R.language_runs(texts), texts)


def run_spacing(spark, sf_dir):
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return B.spaced(R.language_runs(texts), "chinese_simplified", "english").select("id", "run_idx", "lang", "text", "before", "after")


def node_queue(spark, sf_dir):
    """Parts as nodes: their types are texts, brands the languages."""
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("lang"), F.col("p_type").alias("text"))
    return B.node_queue(nodes, "Brand#11")


def render_history(spark, sf_dir):
    """Orders as renders: the last status of each priority, and the last priority of each status."""
    renders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("original"), F.col("o_orderstatus").alias("result"))
    forth, back = B.histories(renders)
    return forth.select(F.lit("forth").alias("way"), F.col("original").alias("key"), F.col("result").alias("value")).unionByName(back.select(F.lit("back").alias("way"), F.col("result").alias("key"), F.col("original").alias("value")))


def wildcard_keys(spark, sf_dir):
    return B.matching_keys(table(spark, sf_dir, "part").select("p_partkey", "p_type"), "*ED*", "p_type")


def bundle_cache(spark, sf_dir):
    """Part types asked in two languages, against a cache of some of them."""
    types = table(spark, sf_dir, "part").select(F.col("p_type").alias("text")).distinct()
    asked = types.join(spark.createDataFrame([("de",), ("fr",)], "to string"))
    cache = types.where(F.length("text") % 2 == 0).select(F.lit("de").alias("to"), T.java_hash(F.col("text")).alias("hash"), F.concat(F.lit("de:"), "text").alias("translation"))
    return B.cached(asked, cache).select("to", "text", "translation")


def echo_results(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", B.without_echo(F.lower("c_mktsegment"), F.concat(F.lit("to "), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise("x"))).alias("shown"))


def locale_fill(spark, sf_dir):
    e = _entries(spark, sf_dir).select("path", "ord", "text", "translation", "translation_source")
    fresh = e.where("translation = ''").select("text").distinct().select("text", F.concat(F.lit("f "), F.sha1("text")).alias("translation"), F.lit("machine").alias("translation_source"))
    return B.filled(e, fresh).select("path", "ord", "translation", "translation_source")




def strided_batches(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    return B.strided(c, ["turn"], ["conv_id"], 2, 3)


def pool_victims(spark, sf_dir):
    """Suppliers as models of their nation's pool."""
    s = table(spark, sf_dir, "supplier")
    return B.lru_victim(s.select(F.col("s_nationkey").alias("pool"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("last_access"), (F.col("s_suppkey") % 3).alias("ref_count"), (F.col("s_suppkey") % 7 == 0).alias("loading")))


def object_translation(spark, sf_dir):
    """The events' properties within an object of lists, each text put in upper case and written back."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.format_string('{"type": "%s", "all": [{"of": [{"is": "%s"}, 7]}, null]}', "event_type", "user_id").alias("value"))
    known = B.object_tokens(e).select("text").where("text IS NOT NULL").distinct().withColumn("translation", F.upper("text"))
    return B.translated_objects(e, known)


def object_strings(spark, sf_dir):
    """Values of the events' properties."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("props").alias("value"))
    return B.object_strings(e).groupBy("path").agg(F.count("*").alias("n"), F.count_distinct("text").alias("texts"))


_HASH = "(SELECT CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END FROM (SELECT list_reduce(list_prepend(0::BIGINT, list_transform(string_split({t}, ''), lambda c: ord(c)::BIGINT)), lambda a, c: (a * 31 + c) % 4294967296) AS h))::VARCHAR"
QUERIES = {
    "recognize_language": recognize_language, "run_spacing": run_spacing, "node_queue": node_queue, "render_history": render_history, "wildcard_keys": wildcard_keys, "bundle_cache": bundle_cache,
    "echo_results": echo_results, "locale_fill": locale_fill, "strided_batches": strided_batches, "pool_victims": pool_victims, "object_strings": object_strings, "object_translation": object_translation, "recognize_documents": recognize_documents,
}
ORACLES = {
    "recognize_language": "SELECT id, language, chars::BIGINT AS chars FROM " + _values([(1, "english", 11), (2, "french", 19), (3, "japanese", 10), (4, "chinese_simplified", 8), (5, "chinese_traditional", 5), (6, "spanish", 23), (7, "russian", 10), (8, "japanese", 26)], "id, language, chars"),
    "node_queue": f"""SELECT lang, hash, arg_min(text, node) AS original, count(*)::INT AS n_nodes, min(node) AS first_node
FROM (SELECT p_partkey AS node, p_brand AS lang, p_type AS text, {_HASH.format(t='p_type')} AS hash FROM part WHERE p_brand <> 'Brand#11') GROUP BY ALL""",
    "render_history": """SELECT 'forth' AS way, o_orderpriority AS key, arg_max(o_orderstatus, o_orderkey) AS value FROM orders GROUP BY 2
UNION ALL SELECT 'back', o_orderstatus, arg_max(o_orderpriority, o_orderkey) FROM orders GROUP BY 2""",
    "wildcard_keys": "SELECT p_partkey, p_type FROM part WHERE p_type LIKE '%ED%'",
    "bundle_cache": "SELECT t.to, text, CASE WHEN t.to = 'de' AND length(text) % 2 = 0 THEN 'de:' || text END AS translation FROM (SELECT DISTINCT p_type AS text FROM part), (VALUES ('de'), ('fr')) AS t(\"to\")",
    "echo_results": "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN lower(c_mktsegment) ELSE 'to x' END AS shown FROM customer",
    "locale_fill": f"WITH {_ENTRIES} SELECT path, ord, CASE WHEN translation = '' THEN 'f ' || sha1(text) ELSE translation END AS translation, CASE WHEN translation = '' THEN 'machine' ELSE translation_source END AS translation_source FROM entries",
    "strided_batches": "SELECT conv_id, turn, batch, batch % 3 AS worker FROM (SELECT conv_id, turn, ((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 2)::INT AS batch FROM conversations)",
    "pool_victims": "SELECT s_nationkey AS pool, arg_min(s_suppkey, {'a': s_acctbal, 'b': s_suppkey}) AS victim FROM supplier WHERE s_suppkey % 3 = 0 AND s_suppkey % 7 <> 0 GROUP BY 1",
    "object_translation": """SELECT event_id AS id, '{"type": "' || upper(event_type) || '", "all": [{"of": [{"is": "' || user_id || '"}, 7]}, null]}' AS value FROM events""",
    "object_strings": """SELECT path, count(*) AS n, count(DISTINCT text) AS texts FROM (SELECT unnest(json_keys(props)) AS path, unnest(list_transform(json_keys(props), lambda k: json_extract_string(props, '$."' || k || '"'))) AS text FROM events) GROUP BY 1""",
}
