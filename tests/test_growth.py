from pyspark.sql import functions as F

from lingora.functions import text as T


def test_first_candidate_is_the_first_of_all(spark):
    rows = [("Save the file", "Datei speichern"), ("確認删除", "Löschen bestätigen"), ("", ""), (None, "x y"), ("é", None), ("{{ n }} the", "__TM_0__"), ("ﬁne ＡＢＣ", "the of")]
    e = spark.createDataFrame(rows, "text string, translation string")
    none = F.lit(None).cast("string")
    both = e.select(T.first_candidate(F.col("text"), F.col("translation"), none).alias("a"), F.try_element_at(T.key_candidates(F.col("text"), F.col("translation"), none), F.lit(1)).alias("b")).collect()
    assert [r.a for r in both] == [r.b for r in both]
    assert any(r.a is None for r in both) and sum(r.a is not None for r in both) >= 4
    kept = [r.a for r in e.select(T.unaccented(F.col("text")).alias("a")).collect()]
    assert kept == ["Save the file", "確認删除", "", None, "e", "{{ n }} the", "fine ABC"]


def test_rows_of_a_language_pair_stay_in_their_tasks(spark):
    from lingora.operators import routing

    rows = spark.range(0, 200, 1, 4).select("id", F.lit("en").alias("from"), F.lit("zh").alias("to"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        got = routing.route(rows).select("model", F.spark_partition_id().alias("task")).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert len(got) == 200 and len({r.model for r in got}) == 1 and len({r.task for r in got}) == 4
