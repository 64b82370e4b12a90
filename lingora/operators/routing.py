"""Which model translates a pair of languages, or none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lingora.functions.lang import normalize, to_flores
from lingora.sources import dims


def route(pairs: DataFrame, extra: list[tuple] = ()) -> DataFrame:
    """pairs (from, to, ...) with model, src_lang, tgt_lang and error: a model of just this pair, else a tagged one.

    The model table is a few rows by construction, so its broadcast needs no check; distinct pairs are routed, not rows.
    Pairs of languages are few too: they are sent to the rows, since the rows of a pair, dealt by it, would be one task's.
    """
    spark = pairs.sparkSession
    models = dims.models(spark, list(extra))
    keys = pairs.select("from", "to").distinct()
    keys = keys.select("*", normalize(F.col("from")).alias("f"), normalize(F.col("to")).alias("t"))
    keys = keys.select("*", to_flores(F.col("f")).alias("src"), to_flores(F.col("t")).alias("tgt"))
    exact = models.where(~F.col("type").isin("nllb", "m2m100")).select("ord", "id", F.explode("pairs").alias("p"))
    exact = exact.select("ord", "id", normalize(F.col("p.from")).alias("f"), normalize(F.col("p.to")).alias("t")).groupBy("f", "t").agg(F.min_by("id", "ord").alias("exact"))
    tagged = models.where("tagged").agg(F.min_by("id", "ord").alias("tagged"))
    found = keys.join(F.broadcast(exact), ["f", "t"], "left").join(F.broadcast(tagged), F.lit(True), "left")
    able = F.col("src").isNotNull() & F.col("tgt").isNotNull() & F.col("tagged").isNotNull()
    use_tags = F.col("exact").isNull() & able
    routed = found.select(
        "from", "to", F.coalesce("exact", F.when(able, F.col("tagged"))).alias("model"), F.when(use_tags, F.col("src")).alias("src_lang"),
        F.when(use_tags, F.col("tgt")).alias("tgt_lang"), (F.col("exact").isNull() & ~able).alias("error"),
    )
    return pairs.join(F.broadcast(routed), ["from", "to"], "left")
