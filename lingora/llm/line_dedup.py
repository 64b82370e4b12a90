"""Line dedup by site-relative frequency, in DataFrame operations alone.

Pages are grouped by host. For each line of a host, the pages that contain it are divided by the host's pages, and a
line that exceeds the boilerplate ratio is dropped from all pages of the host, however few these are: on a host of up to
1 / ratio pages that is every line. Callers who want small hosts left alone give `least`, the pages that a line must be
on; it has no effect unless given. The host is a column, or what `host_of` finds in a URL.

Each page's distinct lines are counted by 16-byte keys with partial sums before the shuffle, so a line that a third of
all pages share arrives as one row from each task. What exceeds the ratio is small: a page has
L lines on average, so at most L / ratio lines of a host can exceed the ratio, whatever its size. They are kept as one
array to a host and joined to the pages by host; Spark sends the arrays to all executors if their measured size is under
spark.sql.autoBroadcastJoinThreshold, and otherwise shuffles by host and a salt, which deals a hot host's pages to many
tasks.

Defined results: a line is what lies between line breaks, compared as it is; lines without a word never count and are
never dropped; a null text stays null; a null host is the host ''; repeated rows are pages of their own; an empty table
gives no rows; other columns stay as they are (n_chars follows the text if there is one).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lingora.llm.common import looked_up

RATIO, LEAST = 0.08, 1
#: A host's pages meet its lines in this many groups.
SALTS = 32
_BLANK = " \t\n\x0b\x0c\r"


def host_of(url: Column) -> Column:
    """The host of a URL, in lower case; '' without one."""
    return F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))


def _key(line: Column) -> Column:
    return F.unhex(F.md5(line))


def _has_word(line: Column) -> Column:
    return F.btrim(line, F.lit(_BLANK)) != ""


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def boilerplate(pages: DataFrame, ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """(host, keys) for pages (host, text): keys of the lines that exceed the ratio on their host."""
    distinct = F.transform(F.array_distinct(F.filter(_lines(F.col("text")), _has_word)), _key)
    counts = pages.where(F.col("text").isNotNull()).select("host", F.explode(distinct).alias("key")).groupBy("host", "key").agg(F.count("*").alias("on"))
    totals = pages.groupBy("host").agg(F.count("*").alias("pages"))
    frequent = looked_up(counts.where(F.col("on") >= least), totals, "host", "key").where(F.col("on") > ratio * F.col("pages"))
    return frequent.groupBy("host").agg(F.collect_list("key").alias("keys"))


def drop_lines(docs: DataFrame, host: str = "source", ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """The input's rows and columns with boilerplate lines gone from text, then n_lines and n_dropped."""
    site = F.coalesce(F.col(host), F.lit(""))
    found = boilerplate(docs.select(site.alias("host"), "text"), ratio, least)
    found = found.select(F.col("host").alias("__host"), F.col("keys").alias("__keys"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))
    salt = F.pmod(F.xxhash64(*[c for c in docs.columns if c in ("doc_id", "text")]), F.lit(SALTS))
    joined = docs.join(found, (site == F.col("__host")) & (salt == F.col("__salt")), "left")
    keep = F.when(
        F.col("__keys").isNotNull(),
        F.filter(_lines(F.col("text")), lambda line: ~_has_word(line) | ~F.array_contains(F.col("__keys"), _key(line))),
    ).otherwise(_lines(F.col("text")))
    cut = joined.withColumn("__kept", keep)
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(_lines(F.col("text"))))
    n_kept = F.when(F.col("text").isNull(), 0).otherwise(F.size("__kept"))
    new_text = F.array_join("__kept", "\n")
    out = []
    for c in docs.columns:
        if c == "text":
            out.append(new_text.alias("text"))
        elif c == "n_chars":
            out.append(F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length(new_text)).cast(docs.schema[c].dataType).alias(c))
        elif c not in ("n_lines", "n_dropped"):
            out.append(F.col(c))
    return cut.select(*out, n_lines.cast("long").alias("n_lines"), (n_lines - n_kept).cast("long").alias("n_dropped"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return drop_lines(docs).select("doc_id", "n_lines", "n_dropped", "text")


def sql(documents: str, ratio: float = RATIO, least: int = LEAST) -> str:
    """(doc_id, n_lines, n_dropped, text) in SQL over a table of documents."""
    word = r"regexp_matches(line, '[^\x20\x09-\x0D]')"
    return f"""
WITH lines AS (
  SELECT doc_id, coalesce(source, '') AS host, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos
  FROM {documents} WHERE text IS NOT NULL
),
counts AS (SELECT host, line, count(DISTINCT doc_id) AS n FROM lines WHERE {word} GROUP BY host, line),
totals AS (SELECT coalesce(source, '') AS host, count(*) AS pages FROM {documents} GROUP BY 1),
bad AS (SELECT host, line FROM counts JOIN totals USING (host) WHERE n >= {least} AND n > {ratio}::DOUBLE * pages),
kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text, count(*) AS n
  FROM lines ANTI JOIN bad USING (host, line) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0)::BIGINT AS n_lines,
  (coalesce(len(string_split(d.text, chr(10))), 0) - coalesce(k.n, 0))::BIGINT AS n_dropped,
  CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text
FROM {documents} d LEFT JOIN kept k USING (doc_id)
"""


ORACLE_SQL = sql("documents")
