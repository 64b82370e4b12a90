"""What the operators of this subpackage share: column hygiene, durable intermediates, packed shuffles."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lingora.session import as_leaf

#: Documents with these columns flow through the pipeline.
DOC_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, raw): only these two columns leave the scan; raw is the text's UTF-8, a null text is empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.encode(F.col("text"), "UTF-8"), F.lit(b"")).alias("raw"))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir.

    A local session that names none, as in tests, gets a temporary one; a cluster has to name one, since a folder of the
    driver's machine is no place for what other machines write.
    """
    context = spark.sparkContext
    named, known = spark.conf.get("spark.checkpoint.dir", None), context._jsc.sc().getCheckpointDir()
    if known.isEmpty():
        if not named and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="lingora-checkpoint-"))
    return named or context._jsc.sc().getCheckpointDir().get()


def durable(df: DataFrame, small: bool = False) -> DataFrame:
    """Computes df now and keeps it in the shared checkpoint folder, so a lost executor costs no recomputation.

    small: few bytes in many partitions are likely; they are put together as their measured size allows.
    """
    checkpoint_dir(df.sparkSession)
    return as_leaf((df.hint("rebalance") if small else df).checkpoint(eager=True))


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle and checkpoint files of tables that are no longer in use.

    Spark does so when the driver's collectors find them unreachable, which on a driver with free memory may be long
    after an iterative job has filled the executors' disks.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    """The cluster operator sizes this for the input, as for any shuffle."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def looked_up(big: DataFrame, table: DataFrame, key: str, spread: str, how: str = "inner", salts: int = 32) -> DataFrame:
    """big with the columns that table, which has a row for each key, adds to it.

    Rows of a key are dealt by `spread` into groups that each meet a copy of the key's row, so that a key of very many
    rows is not joined in one task. Meant for tables of a few numbers a row.
    """
    copies = table.select("*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("__salt"))
    return big.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).join(copies, [key, "__salt"], how).drop("__salt")


def spread_keys(spark: SparkSession, n: int) -> np.ndarray:
    """key[b] is an integer that Spark's hash partitioning over n partitions sends to partition b.

    Packed rows that are dealt by key[b] meet one bucket to a partition, with no partition left empty by chance.
    """
    rows = spark.range(n * 32).select(F.col("id").cast("int").alias("k"), F.expr(f"pmod(hash(cast(id as int)), {n})").alias("b"))
    found = {r.b: r.k for r in rows.groupBy("b").agg(F.min("k").alias("k")).collect()}
    return np.array([found.get(b, b) for b in range(n)], np.int64)


def batches(source: Iterable[pa.RecordBatch], limit: int = 4 << 20, column: int = 1) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that one column of each, of texts or bytes, has about `limit` bytes at most."""
    for batch in source:
        start = 0
        if batch.num_rows == 0:
            continue
        ends = np.cumsum(sizes(batch.column(column)))
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def sizes(column: pa.Array) -> np.ndarray:
    """Bytes of each value."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column as one array, and the n + 1 offsets of its values."""
    lengths = sizes(column)
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8), offsets


#: Finaliser constants of the public-domain splitmix64 generator (fixed values).
_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(_MIX[0])
    x ^= x >> np.uint64(27)
    x *= np.uint64(_MIX[1])
    x ^= x >> np.uint64(31)
    return x


class WordCodes(dict):
    """64-bit codes of words, remembered for as many words as fit the bound."""

    BOUND = 150_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        code = xxhash.xxh3_64_intdigest(word, 7)
        if len(self) < self.BOUND and len(word) <= 64:
            self[word] = code
        return code

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def rolling(codes: np.ndarray, width: int, odd: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Codes of all runs of `width` consecutive items; none if there are fewer items."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, k = np.zeros(n, np.uint64), np.uint64(odd)
    for i in range(width):
        out *= k
        out += codes[i : i + n]
    return mix(out)


def runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of equal values."""
    if not len(sorted_values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]])
    return starts, np.diff(np.r_[starts, len(sorted_values)])


def covered(n: int, starts: np.ndarray, width: int) -> np.ndarray:
    """Which of n items lie in a window of `width` that begins at one of the starts."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + width, n), -1)
    return np.cumsum(change[:n]) > 0
