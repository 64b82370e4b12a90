"""Translation end to end: detect, skip, look the cache up, route, translate what is left; for tables and for streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lingora.functions.lang import detect, normalize, trim
from lingora.operators import mapping, routing
from lingora.operators.backends import Backend

CACHE = "text string, from string, to string, translation string"


def languages(rows: DataFrame, to: str, source: str | None = None, batch: list[str] | None = None, order: str | None = None) -> DataFrame:
    """rows (text, ...) with from, to and confidence.

    source: the language of all rows. batch: columns of a batch, whose first text by `order` decides for all of it.
    """
    target = normalize(F.lit(to))
    if source:
        return rows.withColumns({"from": normalize(F.lit(source)), "to": target, "confidence": F.lit(None).cast("double")})
    if batch:
        first = rows.groupBy(*batch).agg(F.min_by("text", order).alias("__text"))
        found = first.withColumn("__d", detect(F.col("__text"))).drop("__text")
        rows = rows.join(found, batch)
    else:
        rows = rows.withColumn("__d", detect(F.col("text")))
    return rows.withColumns({"from": F.col("__d.lang"), "to": target, "confidence": F.col("__d.confidence")}).drop("__d")


def translated(rows: DataFrame, backend: Backend, cache: DataFrame | None = None, skip_target: bool = False, retries: int = 3) -> DataFrame:
    """rows of languages() with translation, model (`cache` for what was known) and state.

    States: `blank` and `target` (nothing is done to a blank text, nor, if skip_target, to one in the target language),
    `cached`, `translated`, and `unroutable` where no model takes the pair. Each distinct text of a pair is translated
    once. cache: (text, from, to, translation), a row for each.
    """
    routed = routing.route(rows)
    known = cache if cache is not None else rows.sparkSession.createDataFrame([], CACHE)
    seen = routed.join(known.withColumnRenamed("translation", "__known"), ["text", "from", "to"], "left")
    blank = trim(F.coalesce("text", F.lit(""))) == ""
    state = F.when(blank, "blank").when(F.lit(skip_target) & (F.col("from") == F.col("to")), "target").when(F.col("__known").isNotNull(), "cached").when(F.col("error"), "unroutable").otherwise("translated")
    stated = seen.withColumn("state", state)
    fresh = mapping.translate(stated.where("state = 'translated'").select("text", "from", "to"), backend, retries, ["from", "to"])
    # Rows meet their translation by a digest, so whole texts are neither dealt nor sorted with every row that has them.
    digest = F.sha2("text", 256).alias("__digest")
    fresh = fresh.select(digest, "from", "to", F.col("translation").alias("__fresh"))
    done = stated.select("*", digest).join(fresh, ["__digest", "from", "to"], "left").select(*stated.columns, "__fresh")
    model: Column = F.when(F.col("state") == "cached", "cache").when(F.col("state") == "translated", F.col("model"))
    return done.withColumns({"translation": F.coalesce("__known", "__fresh"), "model": model}).drop("__known", "__fresh", "error")


STATES = ("blank", "target", "cached", "translated", "unroutable")


def counted(done: DataFrame, name: str = "translation") -> tuple[DataFrame, Observation]:
    """Rows of translated(), and how many of each state there were, once an action has passed over them."""
    seen = Observation(name)
    return done.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col("state") == s).alias(s) for s in STATES]), seen


#: Folders that the texts of a compacted cache are dealt to by hash, and batches between compactions.
BUCKETS, EVERY = 64, 8


class StreamCache:
    """Translations that a stream has made: a table (text, from, to, translation, set_at) in a shared folder.

    A batch adds `batch=n`. Every few batches all is put together as `gen=n`, one row for each text and pair, without rows older than
    `ttl` seconds, dealt to folders by hash. A batch reads the last generation at or before it, of that only the folders that its
    texts fall into, and the few batches since; never its own or later ones, so a batch that is run again sees what it saw.
    What a rerun cannot need any more is deleted.
    """

    def __init__(self, spark: SparkSession, path: str, ttl: int | None = None, every: int = EVERY) -> None:
        self.spark, self.path, self.ttl, self.every = spark, path.rstrip("/"), ttl, every
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._path = lambda name: hadoop(f"{self.path}/{name}" if name else self.path)
        self._files = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self, kind: str) -> list[int]:
        if not self._files.exists(self._path("")):
            return []
        names = [x.getPath().getName() for x in self._files.listStatus(self._path(""))]
        done = [n for n in names if n.startswith(f"{kind}=") and self._files.exists(self._path(f"{n}/_SUCCESS"))]
        return sorted(int(n.split("=")[1]) for n in done)

    def parts(self, number: int) -> tuple[int | None, list[int]]:
        """The generation and the batches that batch `number` reads."""
        gen = max((g for g in self._numbers("gen") if g <= number), default=None)
        return gen, [b for b in self._numbers("batch") if (gen or 0) <= b < number]

    def read(self, number: int, texts: DataFrame | None = None) -> DataFrame:
        gen, batches = self.parts(number)
        out = self.spark.createDataFrame([], f"{CACHE}, set_at timestamp")
        if gen is not None:
            kept = self.spark.read.schema(f"{CACHE}, set_at timestamp, bucket int").parquet(f"{self.path}/gen={gen}")
            if texts is not None:
                kept = kept.where(F.col("bucket").isin([r.b for r in texts.select(_bucket().alias("b")).distinct().collect()]))
            out = out.unionByName(kept.drop("bucket"))
        if batches:
            out = out.unionByName(self.spark.read.schema(f"{CACHE}, set_at timestamp").parquet(*[f"{self.path}/batch={b}" for b in batches]))
        if self.ttl is not None:
            out = out.where(F.col("set_at") >= F.current_timestamp() - F.make_dt_interval(secs=F.lit(self.ttl)))
        return out.groupBy("text", "from", "to").agg(F.max_by("translation", F.struct("set_at", "translation")).alias("translation"), F.max("set_at").alias("set_at"))

    def add(self, number: int, fresh: DataFrame) -> None:
        """Writes the translations (text, from, to, translation) of a batch, and a new generation when it is time."""
        fresh.distinct().withColumn("set_at", F.current_timestamp()).write.mode("overwrite").parquet(f"{self.path}/batch={number}")
        gen, batches = self.parts(number)
        if number + 1 - (gen or 0) < self.every:
            return
        whole = self.read(number + 1).withColumn("bucket", _bucket())
        whole.repartition(BUCKETS, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/gen={number + 1}")
        for kind in ("gen", "batch"):
            for old in self._numbers(kind):
                if old < (gen or 0):
                    self._files.delete(self._path(f"{kind}={old}"), True)


def _bucket() -> Column:
    return F.pmod(F.xxhash64("text"), F.lit(BUCKETS)).cast("int")


def stream(changes: DataFrame, to: str, backend: Backend, cache_path: str, out_path: str, checkpoint: str, ttl: int | None = None, every: int = EVERY):
    """A started query that translates a stream of changes (id, text) batch by batch.

    Texts in the target language are left out, known ones come from the cache (StreamCache), and new translations are
    added to it. The cache and the output are written by batch number, so a batch that is run again after a failure replaces its files.
    """

    def run(frame: DataFrame, number: int) -> None:
        frame = frame.persist()
        store = StreamCache(frame.sparkSession, cache_path, ttl, every)
        out = translated(languages(frame, to), backend, store.read(number, frame).drop("set_at"), skip_target=True).persist()
        try:
            out.where("state IN ('cached', 'translated')").select("id", "text", "translation", "state").write.mode("overwrite").parquet(f"{out_path}/batch={number}")
            store.add(number, out.where("state = 'translated'").select("text", "from", "to", "translation"))
        finally:
            out.unpersist()
            frame.unpersist()

    return changes.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
