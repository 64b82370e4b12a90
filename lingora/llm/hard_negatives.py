"""Hard-negative mining as a two-dimensional block matrix multiplication.

Scores of anchors against all rows are one product of two integer matrices. Rows of both sides are sorted by label and cut
into blocks, and blocks into shards of dimensions. A grid of P x Q cells and each shard of dimensions is one key of a
shuffle: a block of rows is copied to the P cells of its grid column, a block of anchors to the Q cells of its grid row, so
copying costs |A| * Q + |B| * P whatever the number of tiles. Cells multiply their pairs of blocks to partial int64 tiles;
a second shuffle adds the partial tiles of a pair of blocks and reduces each at once to its best rows.

The product is made once. Tiles whose blocks share labels come first and give the positives; their windows of scores then
travel with the anchors' blocks to the tiles that have other labels, and only a tile of both kinds is made twice. A tile is at most
ANCHORS x ROWS, whatever label, row or vector is common, and returns at most `negatives` rows for each window.

Defined results: rows with a null label, vec_id or vector, or with an entry that is null, NaN or infinite, take no part; of
rows that share a vec_id the least by (label, vector) does; entries beyond 2**26 on the grid stay at that bound, so that
scores of up to 2,048 dimensions fit a long; a shorter vector counts as continued by zeros; an anchor that is alone in its
label, or a window that no row falls into, gives no rows; an empty table gives none; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lingora.llm.common import durable, partitions
from lingora.llm.whitening import finite

ANCHORS, ROWS, WIDTH = 256, 2048, 32
EDGE = 2.0**26
BLOCK = "block long, shard int, low long, high long, n int, ids binary, labels binary, x binary"
PARTIAL = "a long, b long, shard int, a_ids binary, a_labels binary, b_ids binary, b_labels binary, windows binary, tile binary"
BEST = "anchor_block long, anchor_id long, positive_id long, rival_id long, score long, positive_score long"
NONE = np.iinfo(np.int64).min


def grid(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, label, x): one row for each id, x the vector floor(scale * c) as 4-byte integers."""

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            lists = batch.column(2)
            with np.errstate(over="ignore"):
                x = np.clip(np.floor(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale), -EDGE, EDGE).astype("<i4")
            ends = np.r_[0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]
            packed = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer((4 * ends).astype(np.int32)), pa.py_buffer(x)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed], ["vec_id", "label", "x"])

    valid = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite("embedding"))
    columns = F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding")
    rows = valid.select(*columns).mapInArrow(run, "vec_id long, label long, x binary")
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("v")).select("vec_id", "v.label", "v.x")


def blocks(rows: DataFrame, count: int, size: int, width: int) -> DataFrame:
    """Rows by label in blocks of at most `size`, each in shards of `width` dimensions; a block is named by its first id."""

    def cut(ids: np.ndarray, labels: np.ndarray, xs: list[bytes]) -> pa.RecordBatch:
        d = max(1, max(map(len, xs)) // 4)
        x = np.zeros((len(xs), d), "<i4")
        for i, raw in enumerate(xs):
            x[i, : len(raw) // 4] = np.frombuffer(raw, "<i4")
        shards = range(-(-d // width))
        named = [int(ids[0]), int(labels.min()), int(labels.max()), len(ids)]
        made = [[named[0], k, *named[1:], *((ids.tobytes(), labels.tobytes()) if k == 0 else (b"", b"")), x[:, k * width : (k + 1) * width].tobytes()] for k in shards]
        kinds = {"block": pa.int64(), "shard": pa.int32(), "low": pa.int64(), "high": pa.int64(), "n": pa.int32(), "ids": pa.binary(), "labels": pa.binary(), "x": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*made), kinds.values())], list(kinds))

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, xs = np.zeros(0, np.int64), np.zeros(0, np.int64), []
        for batch in it:
            ids, labels = (np.r_[old, batch.column(c).to_numpy()] for c, old in enumerate((ids, labels)))
            xs += batch.column(2).to_pylist()
            while len(xs) >= size:
                yield cut(ids[:size], labels[:size], xs[:size])
                ids, labels, xs = ids[size:], labels[size:], xs[size:]
        if xs:
            yield cut(ids, labels, xs)

    dealt = rows.repartitionByRange(max(1, -(-count // size)), "label", "vec_id").sortWithinPartitions("label", "vec_id")
    return dealt.select("vec_id", "label", "x").mapInArrow(run, BLOCK)


def multiply(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x y' as int64: by float64 BLAS where every sum stays below 2**53, else by integers."""
    most = float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * x.shape[1]
    if most < 2.0**53:
        return (x.astype(np.float64) @ y.astype(np.float64).T).astype(np.int64)
    return x.astype(np.int64) @ y.astype(np.int64).T


def partial_tiles(anchors: DataFrame, rows: DataFrame, p: int, q: int, meets: Column) -> DataFrame:
    """Products of all pairs of blocks that meet, one for each shard of dimensions."""
    a = anchors.select(*(F.col(c).alias(f"a_{c}") for c in anchors.columns)).withColumn("row", F.pmod(F.xxhash64("a_block"), F.lit(p)))
    b = rows.select(*(F.col(c).alias(f"b_{c}") for c in rows.columns)).withColumn("column", F.pmod(F.xxhash64("b_block"), F.lit(q)))
    a = a.withColumn("column", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(q - 1).cast("long"))))
    b = b.withColumn("row", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(p - 1).cast("long"))))
    cells = a.join(b, (a["a_shard"] == b["b_shard"]) & (a["row"] == b["row"]) & (a["column"] == b["column"]) & meets)

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for i in range(batch.num_rows):
                r = {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}
                x, y = (np.frombuffer(r[f"{side}_x"], "<i4").reshape(r[f"{side}_n"], -1) for side in "ab")
                w = min(x.shape[1], y.shape[1])  # the last shard of a block of shorter vectors is narrower
                tile = multiply(x[:, :w], y[:, :w])
                named = [r["a_block"], r["b_block"], r["a_shard"], r["a_ids"], r["a_labels"], r["b_ids"], r["b_labels"], r["a_windows"], tile.tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(named, (pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 6))], [c.split()[0] for c in PARTIAL.split(", ")])

    return cells.select("a_block", "b_block", "a_shard", "a_ids", "a_labels", "a_n", "a_windows", "a_x", "b_ids", "b_labels", "b_n", "b_x").mapInArrow(run, PARTIAL)


def whole_tile(parts: pa.Table) -> tuple[np.ndarray, ...]:
    """The sum of a tile's parts, columns by rising id; ids and labels of both sides, windows."""
    first = parts.column("shard").to_pylist().index(0)
    a_ids, a_labels, b_ids, b_labels, windows = (np.frombuffer(parts.column(c)[first].as_py() or b"", np.int64) for c in ("a_ids", "a_labels", "b_ids", "b_labels", "windows"))
    tile = np.zeros((len(a_ids), len(b_ids)), np.int64)
    for part in parts.column("tile"):
        tile += np.frombuffer(part.as_py(), np.int64).reshape(tile.shape)
    order = np.argsort(b_ids)
    return tile[:, order], a_ids, a_labels, b_ids[order], b_labels[order], windows.reshape(-1, 3)


def _best(*columns: np.ndarray | list) -> pa.Table:
    return pa.table({c.split()[0]: pa.array(v, pa.int64()) for c, v in zip(BEST.split(", "), columns)})


def positives_of(tile: np.ndarray, a_ids: np.ndarray, a_labels: np.ndarray, b_ids: np.ndarray, b_labels: np.ndarray, count: int) -> tuple[np.ndarray, ...]:
    """(row, column) of the first `count` other columns of each row's label."""
    fits = (a_labels[:, None] == b_labels) & (a_ids[:, None] != b_ids)
    order = np.argsort(-np.where(fits, tile, NONE + 1), axis=1, kind="stable")[:, :count]
    keep = np.take_along_axis(fits, order, 1)
    return np.nonzero(keep)[0], order[keep]


def negatives_of(tile: np.ndarray, a_ids: np.ndarray, a_labels: np.ndarray, b_ids: np.ndarray, b_labels: np.ndarray, windows: np.ndarray, count: int, low: int, high: int) -> list[tuple[int, int, int]]:
    """(window, row, column) of the first `count` columns of another label in each window of scores."""
    place = {int(i): r for r, i in enumerate(a_ids)}
    found: list[tuple[int, int, int]] = []
    sorted_row, order, scores = -1, np.zeros(0, np.int64), np.zeros(0, np.int64)
    for w in np.argsort(windows[:, 0], kind="stable").tolist():
        anchor, _, score = windows[w].tolist()
        row = place[anchor]
        if row != sorted_row:
            other = np.flatnonzero(b_labels != a_labels[row])
            order = other[np.argsort(-tile[row, other], kind="stable")]
            sorted_row, scores = row, -tile[row, order]
        least, most = -(-low * score // 100), high * score // 100
        start, end = np.searchsorted(scores, -most, "left"), np.searchsorted(scores, -least, "right")
        found += [(w, row, c) for c in order[start : min(end, start + count)].tolist()]
    return found


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    A negative's score lies between low and high hundredths of the positive's.
    """
    spark = vectors.sparkSession
    base = durable(grid(vectors, scale))
    sizes = base.agg(F.count("*").alias("n"), F.count_if(is_anchor).alias("m"), F.max(F.length("x") / 4).alias("d")).collect()[0]
    n, m, tasks = sizes["n"], sizes["m"], partitions(spark)
    width = max(WIDTH, -(-int(sizes["d"] or 0) // 2))
    q = max(1, min(round((tasks * n / max(m, 1)) ** 0.5), tasks, -(-n // ROWS)))
    p = max(1, min(tasks // q, -(-m // ANCHORS)))
    b = durable(blocks(base, n, ROWS, width))
    a = durable(blocks(base.where(is_anchor), m, ANCHORS, width))

    def first(parts: pa.Table) -> pa.Table:
        tile, a_ids, a_labels, b_ids, b_labels, _ = whole_tile(parts)
        r, c = positives_of(tile, a_ids, a_labels, b_ids, b_labels, positives)
        return _best(np.full(len(r), parts.column("a")[0].as_py()), a_ids[r], b_ids[c], b_ids[c], tile[r, c], tile[r, c])

    shared = (F.col("a_low") <= F.col("b_high")) & (F.col("b_low") <= F.col("a_high"))
    near = partial_tiles(a.withColumn("windows", F.lit(None).cast("binary")), b, p, q, shared).groupBy("a", "b").applyInArrow(first, BEST)
    rank = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("score"), "rival_id"))
    near = durable(near.withColumn("rank", rank).where(F.col("rank") <= positives), small=True)

    def packed(rows: pa.Table) -> pa.Table:
        each = np.stack([rows.column(c).to_numpy() for c in ("anchor_id", "positive_id", "score")], 1)
        return pa.table({"block": pa.array([rows.column("anchor_block")[0].as_py()], pa.int64()), "windows": pa.array([np.ascontiguousarray(each).tobytes()], pa.binary())})

    windows = near.groupBy("anchor_block").applyInArrow(packed, "block long, windows binary")

    def second(parts: pa.Table) -> pa.Table:
        tile, a_ids, a_labels, b_ids, b_labels, wanted = whole_tile(parts)
        found = negatives_of(tile, a_ids, a_labels, b_ids, b_labels, wanted, negatives, low, high)
        w, r, c = np.array(found, np.int64).reshape(-1, 3).T
        return _best(np.full(len(w), parts.column("a")[0].as_py()), wanted[w, 0], wanted[w, 1], b_ids[c], tile[r, c], wanted[w, 2])

    alike = (F.col("a_low") == F.col("a_high")) & (F.col("a_low") == F.col("b_low")) & (F.col("b_low") == F.col("b_high"))
    far = partial_tiles(a.join(windows, "block"), b, p, q, ~alike).groupBy("a", "b").applyInArrow(second, BEST)
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "rival_id"))
    far = far.withColumn("rank", rank).where(F.col("rank") <= negatives)
    return far.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("rival_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0)


ORACLE_SQL = """
WITH valid AS (
  SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
         list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, a.label AS anchor_label, r.vec_id, r.label, CAST(list_inner_product(a.x, r.x) AS BIGINT) AS score
  FROM valid a JOIN valid r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id
), positives AS (
  SELECT anchor_id, anchor_label, vec_id AS positive_id, score AS positive_score
  FROM scored WHERE label = anchor_label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), ranked AS (
  SELECT p.anchor_id, p.positive_id, p.positive_score, s.vec_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND s.label <> p.anchor_label
  WHERE 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 10
"""
