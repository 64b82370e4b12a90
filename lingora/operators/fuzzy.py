"""Fuzzy merge: new texts claim earlier ones that are similar, each in the order of its file, as rows.

A text that was there before claims itself. Another claims, of the earlier texts that are similar enough and that no text
before it has claimed, the most similar, and of equals the first. That is a serial dictatorship. A path of few texts is
gone through in order, by one task together with other such paths, and only free candidates are compared.

Of a larger path each text has a list of its best candidates, and claims are proposals that are made in any order: a
candidate keeps the earliest of those that ask for it, the others go on to the next of their lists, and what comes out is
the same. So a chunk of a path, of texts that follow each other, is folded on its own; where chunks hold the same candidate
the earlier one keeps it, and after as many rounds as a path has chunks nothing changes any more.

Lists come from two sources. Of texts that few others are like, all similar pairs are found by a filter that loses nothing.
Where many are alike, pairs grow with the square of a path: blocks of new and of old texts are compared in memory, each text
gets the best of those that are still free to it, and a text whose list is used up asks again.

Similar pairs are found without comparing all texts of a path. Of a pair with similarity 2 * lcs / (a + b) >= 0.8, at least
(a + b) / 5 - 1 bigrams are shared: the common subsequence has 0.4 * (a + b) characters or more, and each of the at most
0.2 * (a + b) others breaks one of its pairs of neighbours. So two such texts share one of their rarest bigrams, of which so
many are keys that fewer than the bound are left (the prefix filter); pairs of very short texts share a character.

Defined results: a null text is no candidate and claims nothing; rows alike in path, text and ord count once; of an earlier
text that repeats in a path the first row counts; a path without earlier texts has no claims.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lingora.functions.text import similarity, similarity_of
from lingora.session import durable

FUZZY = 0.8
#: Pairs that a single task folds.
FOLD = 400_000
#: Pairs of texts of a path, new times old, up to which it is gone through in order; and the same for characters.
DIRECT, CELLS = 20_000, 1 << 30
#: Texts in a block of those that are compared with another block, and characters of a text that fits the bits of a word.
BLOCK, WORD = 8192, 64
#: Candidates of a text's first list, and meetings of a path by its keys, for each text, beyond which it is compared in blocks.
LIST, MEETINGS = 16, 256
SHORT = 3
NEVER = 9223372036854775807
LISTED = "source_path string, who_ord long, who_hash long, what_ord long, what_hash long, score double, cut boolean"


def _bound(a: Column, b: Column) -> Column:
    """Bigrams that texts of these lengths share at least if they are similar."""
    return F.floor((a + b + 4) / 5) - 1


def keyed(texts: DataFrame, name: str) -> DataFrame:
    """(source_path, name, size, gram, nth): the grams of each text; of a gram that repeats, each occurrence by number."""
    n = F.col("size")
    grams = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.substr("text", i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    each = F.when(n <= SHORT, F.concat(grams(1), grams(2))).otherwise(grams(2))
    rows = texts.withColumn("size", F.length("text")).where("size > 0").select("source_path", name, "size", F.explode(each).alias("gram"))
    counted = rows.groupBy("source_path", name, "size", "gram").agg(F.count("*").cast("int").alias("times"))
    return counted.select("source_path", name, "size", "gram", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("nth"))


def _prefix(grams: DataFrame, rarity: DataFrame, name: str) -> DataFrame:
    """The rarest grams of each text, as many as the bound leaves no way around."""
    n = F.col("size")
    least = _bound(n, F.ceil(n * 2 / 3))
    take = F.when((n > SHORT) & (least >= 1), n - 1 - least + 1).otherwise(F.size("all")).cast("int")
    each = grams.join(rarity, ["source_path", "gram", "nth"]).groupBy("source_path", name, "size").agg(F.array_sort(F.collect_list(F.struct("n", "gram", "nth"))).alias("all"))
    return each.select("source_path", F.col(name), F.col("size").alias(f"{name}_size"), F.explode(F.slice("all", F.lit(1), take)).alias("g")).select("source_path", name, f"{name}_size", "g.gram", "g.nth")


def _prefixes(new: DataFrame, old: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The keys by which similar texts of new and old meet."""
    a, b = keyed(new, "who"), keyed(old, "what")
    rarity = a.select("source_path", "gram", "nth").unionAll(b.select("source_path", "gram", "nth")).groupBy("source_path", "gram", "nth").agg(F.count("*").alias("n"))
    return _prefix(a, rarity, "who"), _prefix(b, rarity, "what")


def similar_pairs(new: DataFrame, old: DataFrame) -> DataFrame:
    """(source_path, who, what, score) of the similar ones of new (source_path, who, text) and old (source_path, what, text)."""
    counts = new.groupBy("source_path").agg(F.count("*").alias("a")).join(old.groupBy("source_path").agg(F.count("*").alias("b")), "source_path")
    counts = counts.select("source_path", (F.col("a") * F.col("b") <= DIRECT).alias("few"))
    new, old = (df.join(counts, "source_path") for df in (new, old))
    near = lambda a, b: 3 * F.least(a, b) >= 2 * F.greatest(a, b)
    plain = new.where("few").select("source_path", "who", F.col("text").alias("a")).join(old.where("few").select("source_path", "what", F.col("text").alias("b")), "source_path").where(near(F.length("a"), F.length("b")))

    new, old = (df.where("NOT few").drop("few") for df in (new, old))
    left, right = _prefixes(new, old)
    met = left.join(right, ["source_path", "gram", "nth"]).where(near(F.col("who_size"), F.col("what_size"))).select("source_path", "who", "what").distinct()
    beside = met.join(new.withColumnRenamed("text", "a"), ["source_path", "who"]).join(old.withColumnRenamed("text", "b"), ["source_path", "what"])
    both = plain.unionByName(beside.select(plain.columns))
    return both.select("source_path", "who", "what", similarity_of("a", "b").alias("score")).where(F.col("score") >= FUZZY)


class _Text:
    """A text with what bounds its common subsequences."""

    def __init__(self, text: str):
        self.text, self.size = text, len(text)
        self.bag, self.grams = Counter(text), Counter(map(str.__add__, text, text[1:]))

    def most(self, other: _Text) -> float:
        """No less than the similarity: by characters shared, and by bigrams shared, of which each character left out breaks one."""
        shared = min(self.size, other.size, sum((self.bag & other.bag).values()))
        if 2 * shared < FUZZY * (self.size + other.size):
            return 0.0
        shared = min(shared, (sum((self.grams & other.grams).values()) + 1 + self.size + other.size) // 3)
        return 2 * shared / (self.size + other.size)


def _in_turn(new: list[tuple[int, int, str | None]], old: dict[str, tuple[int, int]]) -> Iterator[tuple[str | None, str | None, float]]:
    """(text, claimed, score) of new in their order, against old texts with their places."""
    seen: dict[str, _Text] = {}
    known = lambda t: seen.get(t) or seen.setdefault(t, _Text(t))
    scores: dict[tuple[str, str], float] = {}
    taken = set()
    for _, _, text in new:
        best: tuple | None = None
        if text in old:
            taken.add(text)
            yield text, text, 1.0
            continue
        if text:
            bounds = [(-known(text).most(known(t)), what, t) for t, what in old.items() if t and t not in taken and 3 * min(len(t), len(text)) >= 2 * max(len(t), len(text))]
            for bound, what, t in sorted(bounds):
                if -bound < FUZZY or (best and bound > best[0]):
                    break
                if (text, t) not in scores:
                    scores[text, t] = similarity(text, t)
                if scores[text, t] >= FUZZY and (best is None or (-scores[text, t], what) < best[:2]):
                    best = (-scores[text, t], what, t)
        if best:
            taken.add(best[2])
        yield text, best and best[2], -best[0] if best else 0.0


def _merged_in_turn(rows: DataFrame) -> DataFrame:
    """(source_path, text, previous_text, score) of paths of few texts: rows (source_path, new, ord, hash, text)."""
    schema = "source_path string, text string, previous_text string, score double"
    kinds = pa.schema([("source_path", pa.string()), ("text", pa.string()), ("previous_text", pa.string()), ("score", pa.float64())])
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ready = rows.select("source_path", "new", "ord", "hash", "text").repartition(n, "source_path").sortWithinPartitions("source_path", "new", "ord", "hash")

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                yield from zip(*(c.to_pylist() for c in batch.slice(i, 1024).columns))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for path, group in groupby(each(batches), lambda r: r[0]):
            new: dict[tuple, None] = {}
            old: dict[str, tuple[int, int]] = {}
            for _, is_new, ord_, hash_, text in group:
                if is_new:
                    new[ord_, hash_, text] = None
                else:
                    old.setdefault(text, (ord_, hash_))
            out += [(path, *claim) for claim in _in_turn(list(new), old)]
            if len(out) > 1024:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds.types)], schema=kinds)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds.types)], schema=kinds)

    return ready.mapInArrow(run, schema)


def _scores(asked: list[str], texts: list[str]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(text, places, scores) of distinct sorted asked: the similar ones of texts, all of them compared at once.

    A row of each table is a word; texts asked that begin alike share its rows. Texts that do not fit a word go one by one.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    fits, rest = np.flatnonzero((sizes <= WORD) & (sizes > 0)), np.flatnonzero(sizes > WORD)
    held, long_ = [texts[j] for j in fits], {j: _Text(texts[j]) for j in rest.tolist()}
    lengths = sizes[fits]
    codes = np.frombuffer("".join(held).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(held)), lengths)
    bit = np.uint64(1) << (np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.uint64)
    order = np.argsort(codes, kind="stable")
    letters, begins = np.unique(codes[order], return_index=True)
    masks: dict[str, tuple[np.ndarray | None, np.ndarray]] = {}
    for letter, some in zip(letters.tolist(), np.split(order, begins[1:])):
        mask = np.zeros(len(held), np.uint64)
        np.bitwise_or.at(mask, owner[some], bit[some])
        where = np.flatnonzero(mask)
        masks[chr(letter)] = (None, mask) if len(where) * 16 > len(held) else (where, mask[where])
    every = np.full(len(held), 2**64 - 1, np.uint64)
    full = every >> (np.uint64(64) - lengths.astype(np.uint64))
    rows, last = [every], ""
    for text in asked:
        same = next((i for i, (x, y) in enumerate(zip(last, text)) if x != y), min(len(last), len(text)))
        del rows[same + 1 :]
        last = text[: 2 * WORD]  # a longer one is not like any that fits a word
        for c in last[same:]:
            row = rows[-1]
            where, mask = masks.get(c, (None, None))
            if mask is None:
                rows.append(row)
            elif where is None:
                hit = row & mask
                rows.append((row + hit) | (row - hit))
            else:
                part, row = row[where], row.copy()
                hit = part & mask
                row[where] = (part + hit) | (part - hit)
                rows.append(row)
        score = 2 * (lengths - np.bitwise_count(rows[-1] & full)) / (lengths + len(text))
        like = np.flatnonzero(score >= FUZZY)
        places, found = fits[like], score[like]
        if long_ and 3 * len(text) >= 2 * WORD:
            own = _Text(text)
            more = [(j, similarity(text, t.text)) for j, t in long_.items() if 3 * min(t.size, own.size) >= 2 * max(t.size, own.size) and own.most(t) >= FUZZY]
            more = [(j, s) for j, s in more if s >= FUZZY]
            places, found = np.r_[places, np.array([j for j, _ in more], np.int64)], np.r_[found, [s for _, s in more]]
            sort = np.argsort(places)
            places, found = places[sort], found[sort]
        yield text, places, found


def _lists(new: DataFrame, old: DataFrame, counts: DataFrame, most: int) -> DataFrame:
    """Rows LISTED: for each of new (source_path, who, text) its best `most` of old (source_path, what, text, holder), in blocks.

    Only those count that are held by none before it. cut says that there are more. counts: (source_path, a, b), texts of a path.
    """
    n = int(new.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = counts.select("source_path", *[F.ceil(F.col(c) / max(1, BLOCK)).cast("int").alias(f"{c}s") for c in "ab"])
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    dealt = lambda side, c: F.pmod(F.xxhash64(side), F.col(c)).cast("int")
    keys = ["source_path", "i", "j"]
    asked = new.join(blocks, "source_path").select("source_path", dealt("who", "as").alias("i"), every("bs").alias("j"), F.col("bs").alias("parts"), "who.ord", "who.hash", "text")
    free = F.coalesce("holder.ord", F.lit(NEVER)).alias("held_ord"), F.coalesce("holder.hash", F.lit(NEVER)).alias("held_hash")
    given = old.join(blocks, "source_path").select("source_path", every("as").alias("i"), dealt("what", "bs").alias("j"), "what.ord", "what.hash", "text", *free)

    def compared(whos: pd.DataFrame, whats: pd.DataFrame) -> pd.DataFrame:
        out: list[list[np.ndarray]] = [[] for _ in range(6)]
        if len(whos) and len(whats):
            whats, whos = whats.sort_values(["ord", "hash"]), whos.sort_values("text")
            ords, hashes, held_ord, held_hash = (whats[c].to_numpy() for c in ("ord", "hash", "held_ord", "held_hash"))
            askers = {t: list(g) for t, g in groupby(zip(whos["text"], whos["ord"].tolist(), whos["hash"].tolist()), lambda r: r[0])}
            for text, places, scores in _scores(sorted(askers), whats["text"].tolist()):
                for _, ord_, hash_ in askers[text]:
                    open_ = (held_ord[places] > ord_) | ((held_ord[places] == ord_) & (held_hash[places] > hash_))
                    mine, score = places[open_], scores[open_]
                    if cut := len(mine) > most:
                        first = np.argsort(-score, kind="stable")[:most]
                        mine, score = mine[first], score[first]
                    for column, value in zip(out, (np.full(len(mine), ord_), np.full(len(mine), hash_), ords[mine], hashes[mine], score, np.full(len(mine), cut))):
                        column.append(value)
        kinds = (np.int64,) * 4 + (np.float64, bool)
        columns = [np.concatenate(c).astype(k) if c else np.zeros(0, k) for c, k in zip(out, kinds)]
        frame = pd.DataFrame(dict(zip(("who_ord", "who_hash", "what_ord", "what_hash", "score", "cut"), columns)))
        frame.insert(0, "source_path", whos["source_path"].iloc[0] if len(whos) else None)
        return frame.assign(parts=int(whos["parts"].iloc[0]) if len(whos) else 1)

    found = asked.repartition(n, *keys).groupBy(*keys).cogroup(given.repartition(n, *keys).groupBy(*keys)).applyInPandas(compared, f"{LISTED}, parts int")
    found = found.select("source_path", F.struct(F.col("who_ord").alias("ord"), F.col("who_hash").alias("hash")).alias("who"), F.struct(F.col("what_ord").alias("ord"), F.col("what_hash").alias("hash")).alias("what"), "score", "cut", "parts")
    whole, parts = durable(found), Window.partitionBy("source_path", "who")
    ranked = whole.where("parts > 1").withColumn("rank", F.row_number().over(parts.orderBy(F.desc("score"), "what"))).withColumn("cut", F.max("cut").over(parts) | (F.count("*").over(parts) > most))
    return whole.where("parts = 1").drop("parts").unionByName(ranked.where(F.col("rank") <= most).drop("parts", "rank"))


def _fold(pairs: pd.DataFrame) -> pd.DataFrame:
    """The pairs of one chunk that are left, and which are claims; a text whose list was cut and is used up has null for what it claims."""
    columns = ["who_ord", "who_hash", "what_ord", "what_hash", "score", "cut", "dead"]
    order = np.lexsort((pairs["what_hash"], pairs["what_ord"], -pairs["score"].to_numpy(), pairs["who_hash"], pairs["who_ord"]))
    taken: set = set()
    out = []
    for who, group in groupby(zip(*(pairs[c].to_numpy()[order].tolist() for c in columns)), lambda r: r[:2]):
        got, cut = None, False
        for row in group:
            cut |= row[5]
            if not row[6] and row[2:4] not in taken:
                got = got or row[2:4]
                out.append((*row[:6], got == row[2:4]))
        if got:
            taken.add(got)
        elif cut:
            out.append((*who, None, None, None, True, False))
    frame = pd.DataFrame(out, columns=[*columns[:6], "got"], dtype=object)
    return frame.assign(source_path=pairs["source_path"].iloc[0], chunk=pairs["chunk"].iloc[0])


def _folded(pairs: DataFrame) -> DataFrame:
    what = lambda p: F.coalesce(F.col(f"what.{p}"), F.lit(0)).alias(f"what_{p}")
    flat = pairs.select("source_path", "chunk", "who.ord", "who.hash", what("ord"), what("hash"), F.coalesce("score", F.lit(0.0)).alias("score"), "cut", (F.col("dead") | F.col("what").isNull()).alias("dead"))
    flat = flat.withColumnsRenamed({"ord": "who_ord", "hash": "who_hash"})
    left = flat.groupBy("source_path", "chunk").applyInPandas(_fold, f"{LISTED}, got boolean, chunk int")
    what = F.when(F.col("what_ord").isNotNull(), F.struct(F.col("what_ord").alias("ord"), F.col("what_hash").alias("hash"))).alias("what")
    return left.select("source_path", F.struct(F.col("who_ord").alias("ord"), F.col("who_hash").alias("hash")).alias("who"), what, "score", "cut", "got", "chunk")


def claims(pairs: DataFrame) -> DataFrame:
    """(source_path, who, what, score, cut, got): the pairs that are left of some with the columns before got, which says who gets what.

    what is null for those who have to ask again.
    """
    spark = pairs.sparkSession
    pairs = pairs.select("source_path", "who", "what", "score", "cut", F.lit(False).alias("dead"))
    counts = pairs.groupBy("source_path").agg(F.count("*").alias("n"))
    most, total = counts.agg(F.max("n"), F.sum(F.when(F.col("n") > FOLD, F.col("n")))).first()
    if (most or 0) <= FOLD:
        return durable(_folded(pairs.withColumn("chunk", F.lit(0)))).drop("chunk")
    many = durable(counts.where(F.col("n") > FOLD).select("source_path"))
    done = durable(_folded(pairs.join(many, "source_path", "left_anti").withColumn("chunk", F.lit(0))))
    # Chunks follow each other in the order of who: the first is final at once, and after each round one more is.
    n = min(-(-total // max(1, FOLD)), 16 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    left = durable(pairs.join(many, "source_path", "left_semi").repartitionByRange(n, "source_path", "who").withColumn("chunk", F.spark_partition_id()))
    while True:
        local = durable(_folded(left))
        best = local.where("got").groupBy("source_path", "what").agg(F.min("who").alias("holder"), F.count("*").alias("n"))
        if best.where("n > 1").isEmpty():
            return done.unionByName(local).drop("chunk")
        left = local.join(best.drop("n"), ["source_path", "what"], "left").withColumn("dead", F.coalesce(F.col("who") > F.col("holder"), F.lit(False)))
        left = left.where("cut OR NOT dead").select("source_path", "chunk", "who", "what", "score", "cut", "dead")


def _claimed(open_: DataFrame, old: DataFrame) -> DataFrame:
    """(source_path, who, what, score) of open_ (source_path, who, text) among old (source_path, what, text, holder); a holder keeps out those after it."""
    sizes = lambda df, name: df.groupBy("source_path").agg(F.count("*").alias(name), F.max(F.length("text")).alias(f"{name}_long"))
    counts = sizes(open_, "a").join(sizes(old, "b"), "source_path")
    dense = (F.greatest("a_long", "b_long") <= WORD) & (F.least("a", "b") <= BLOCK)
    counts = durable(counts.select("source_path", "a", "b", dense.alias("dense")))
    some = lambda df, paths: df.join(paths.select("source_path"), "source_path", "left_semi")
    sparse = counts.where("NOT dense")
    if not sparse.isEmpty():
        keys = [df.groupBy("source_path", "gram", "nth").agg(F.count("*").alias(c)) for df, c in zip(_prefixes(some(open_, sparse), some(old, sparse)), ("x", "y"))]
        meetings = keys[0].join(keys[1], ["source_path", "gram", "nth"]).groupBy("source_path").agg(F.sum(F.col("x") * F.col("y")).alias("met"))
        counts = durable(counts.join(meetings, "source_path", "left").withColumn("dense", F.col("dense") | (F.coalesce("met", F.lit(0)) > MEETINGS * (F.col("a") + F.col("b")))).drop("met"))
        sparse = counts.where("NOT dense")
    blocks = counts.where("dense")
    left = None
    if not sparse.isEmpty():
        pairs = similar_pairs(some(open_, sparse), some(old, sparse).drop("holder")).join(old.select("source_path", "what", "holder"), ["source_path", "what"])
        left = durable(pairs.where(F.col("holder").isNull() | (F.col("who") < F.col("holder"))).select("source_path", "who", "what", "score", F.lit(False).alias("cut")))
    budget = LIST * (blocks.agg(F.sum("a")).first()[0] or 0)
    if budget:
        open_, old = some(open_, blocks), some(old, blocks)
        lists = _lists(open_, old, blocks, LIST)
        left = lists if left is None else left.unionByName(lists)
    done = None
    while left is not None:
        left = claims(left)
        asking = left.where("what IS NULL").select("source_path", "who")
        n, paths = asking.count(), asking.select("source_path").distinct()
        final = left.where("got").select("source_path", "who", "what", "score")
        final = final.join(paths, "source_path", "left_anti") if n else final
        done = final if done is None else done.unionByName(final)
        if not n:
            break
        # Who asks again gets a list as long as the first lists were in all, so the last few get all there is.
        left = some(left, paths)
        taken = left.where("got").select("source_path", "what", F.col("who").alias("by"))
        free = some(old, paths).join(taken, ["source_path", "what"], "left").withColumn("holder", F.least("holder", "by")).drop("by")
        again = _lists(open_.join(asking, ["source_path", "who"], "left_semi"), free, some(blocks, paths), max(LIST, budget // n))
        left = left.where("what IS NOT NULL").select("source_path", "who", "what", "score", "cut").unionByName(again)
    return done


def merge_fuzzy(segments: DataFrame, previous: DataFrame) -> DataFrame:
    """(source_path, text, previous_text, score) of segments (source_path, text, ord) against an earlier map."""
    place = [F.col("ord").cast("long").alias("ord"), F.xxhash64("text").alias("hash")]
    rows = segments.select("source_path", F.lit(True).alias("new"), *place, "text").unionByName(previous.where("text IS NOT NULL").select("source_path", F.lit(False).alias("new"), *place, "text"))
    each = [F.count_if(F.col("new") == side).alias(f"n{i}") for i, side in enumerate((True, False))]
    chars = [F.coalesce(F.sum(F.when(F.col("new") == side, F.length("text"))), F.lit(0)).alias(f"c{i}") for i, side in enumerate((True, False))]
    large = rows.where("source_path IS NOT NULL").groupBy("source_path").agg(*each, *chars).where(((F.col("n0") + 1) * (F.col("n1") + 1) > DIRECT) | (F.col("c0") * F.col("c1") > CELLS))
    large = durable(large.select("source_path"))
    nowhere = segments.where("source_path IS NULL").select("source_path", "text", "ord").distinct().select("source_path", "text", F.lit(None).cast("string").alias("previous_text"), F.lit(0.0).alias("score"))
    placed = rows.where("source_path IS NOT NULL")
    if large.isEmpty():
        return _merged_in_turn(placed).unionByName(nowhere)
    few = _merged_in_turn(placed.join(large, "source_path", "left_anti")).unionByName(nowhere)

    placed = placed.join(large, "source_path", "left_semi")
    name = lambda alias: F.struct("ord", "hash").alias(alias)
    new = placed.where("new").select("source_path", "text", name("who")).distinct()
    old = placed.where("NOT new").groupBy("source_path", "text").agg(F.min("ord").alias("ord"), F.min("hash").alias("hash")).select("source_path", "text", name("what"))
    known = durable(new.join(old, ["source_path", "text"], "left"))
    exact = known.where("what IS NOT NULL")
    first = exact.groupBy("source_path", "what").agg(F.min("who").alias("holder"))
    old = durable(old.join(first, ["source_path", "what"], "left").select("source_path", "what", "text", "holder"))
    got = _claimed(known.where("what IS NULL AND text != ''").select("source_path", "who", "text"), old.where("text != ''"))
    fuzzy = known.where("what IS NULL").select("source_path", "who", "text")
    if got is not None:
        got = got.join(old.select("source_path", "what", F.col("text").alias("previous_text")), ["source_path", "what"]).select("source_path", "who", "previous_text", "score")
        fuzzy = fuzzy.join(got, ["source_path", "who"], "left")
    else:
        fuzzy = fuzzy.select("*", F.lit(None).cast("string").alias("previous_text"), F.lit(0.0).alias("score"))
    exact = exact.select("source_path", "text", F.col("text").alias("previous_text"), F.lit(1.0).alias("score"))
    return few.unionByName(exact).unionByName(fuzzy.select("source_path", "text", "previous_text", F.coalesce("score", F.lit(0.0)).alias("score")))
