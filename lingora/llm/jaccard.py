"""N-gram Jaccard self-join with vertical partitioning: links of similar documents, and their components.

A document's set has its distinct five-word shingles as 64-bit codes. The global order of codes is cut into fragments,
one to a shuffle partition. A fragment holds its part of every set; overlaps are counted in each fragment separately and
summed per pair. Nothing of a set but the part in the fragment is ever in one place, and sets travel packed.

 1. Equal sets are one class, known by a digest. A batch of text ships a class once, so a group of copies that holds a
    third of all rows adds no more than one set to each batch.
 2. First cut. Of each set, only the first p = n - ceil(t n) + max(1, n // 8) codes travel. Two linked sets share at
    least max(1, m // 8) of these, m being the smaller one's size, so a class with fewer codes that occur in another
    class too has no link. Most text ends here.
 3. Second cut. The full sets of the classes left are counted by fragment. Ordered by frequency among them (then by
    code), the first n - ceil(t n) + 1 codes of two linked sets have one in common (the prefix filter). Codes that occur
    once come first; a class that has that many of them has no link.
 4. Rounds. The classes with a common prefix code form a group. Comparing all pairs of a group would be quadratic for
    near copies, and is not needed for components: members are ranked, those with the fewest codes of their own first
    (of two sets that have their first common code here, the codes before it and those that no other class has bound
    the overlap from above, which rules out most pairs);
    a round takes the next ranks (32, then 1024, ...) as pivots and compares them with the later members that are in
    another component by now; where the pairs across components are few for a group's size, all are compared at once.
    A first round compares each class with its best-supported pivot alone, which joins most near copies at once.
    Comparisons are verified exactly, by overlaps per fragment. Rounds end when the members not yet compared with each
    other are in one component in every group: no link can be missing between components.
 5. Large groups. A code of more than BLOCK classes has its members dealt into blocks, which are groups of their own in
    the rounds, so no task holds more than a block. One in SAMPLED members is in a block of the next level too, and so
    on, which joins the blocks of near copies. Codes whose members are then in one component are done; for others all
    pairs of blocks go through the rounds, each a group of two blocks.

Defined results: words are runs of bytes other than ASCII white space, A-Z lower-cased; a text of one to four words has
its whole sequence as one shingle; null and blank texts have an empty set and link with nothing; a null doc_id is later
than any other; repeated rows are members of one class; an empty table gives no rows; other columns are ignored.

Codes have 64 bits. Links are decided by overlaps of hundreds of codes, which one chance collision hardly moves; two
texts with unlike sets share a class with a chance of 2**-64 for each pair of texts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lingora.llm import packed
from lingora.llm.common import WordCodes, batches, durable, looked_up, mix, partitions, release, rolling, runs, spread_keys
from lingora.llm.components import components
from lingora.llm.substring import _in_two

WIDTH, SALTS = 5, 16
PAIRS = "b long, c long, nb long, nc long, part long"
#: Two sets link when HUNDRED * overlap >= PERCENT * union.
PERCENT, HUNDRED = 75, 100
#: Members of a group that one task holds at most, give or take chance; and how many of them go to the next level.
BLOCK, SAMPLED = 4096, 128
#: Pairs that a task has in hand at once, and partners that travel with a set.
AT_ONCE, PARTNERS = 4_000_000, 4096


def least_overlap(n):
    """ceil(t n): what a set of n shares at least with any set that it links with."""
    return -(-PERCENT * n // HUNDRED)


def shingles(raw: bytes, memo: WordCodes) -> np.ndarray:
    """The set of a text, as sorted codes."""
    codes = memo.of(raw.lower().split())
    if len(codes) < WIDTH:
        return mix(rolling(codes, len(codes), 0xD6E8FEB86659FD93) + np.uint64(len(codes))) if len(codes) else codes
    return np.unique(rolling(codes, WIDTH))


def class_id(codes: np.ndarray) -> int:
    """A digest of a set: two sums of differently mixed codes."""
    one, two = codes.sum(dtype=np.uint64), mix(codes ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64)
    return int(mix(np.array([one ^ mix(np.array([two + np.uint64(len(codes))]))[0]], np.uint64)).view(np.int64)[0])


def _shared_head(n):
    """How many of the first codes two linked sets share, the smaller one having n."""
    return np.maximum(1, n // 8)


def classes_of(source: DataFrame) -> DataFrame:
    """Rows (doc, tag, cid, n, shared): a document's class; and, with shared not null, each class once.

    The row of a class names its earliest document and counts the codes at its head that another class has too. Heads
    and descriptions travel together, so all texts are read and cut into shingles just once.
    """
    spark = source.sparkSession
    n_parts = partitions(spark)
    keys = spread_keys(spark, n_parts)

    def scatter(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs():
            memo = WordCodes()
            for batch in batches(it, 4 << 20):
                seen, heads, owners, cids, sizes = set(), [], [], [], []
                for raw in batch.column(1).to_pylist():
                    codes = shingles(raw, memo)
                    n = len(codes)
                    cids.append(class_id(codes))
                    sizes.append(n)
                    if n and cids[-1] not in seen:
                        seen.add(cids[-1])
                        heads.append(codes[: n - least_overlap(n) + int(_shared_head(n))])
                        owners.append(np.full(len(heads[-1]), cids[-1], np.int64))
                doc, tag = batch.column(0).to_numpy(), batch.column(2).to_numpy()
                cid = np.array(cids, np.int64)
                size = np.array(sizes, np.int32)
                for b, x in packed.deal(packed.chunk_of(doc, n_parts), cid, doc, tag, size):
                    yield int(keys[b]), b"\1" + packed.pack(*x)
                order = np.lexsort((tag, doc, cid))
                lead = order[runs(cid[order])[0]]  # of each class of the batch, its earliest document
                for b, x in packed.deal(packed.chunk_of(cid[lead], n_parts), cid[lead], doc[lead], tag[lead], size[lead]):
                    yield int(keys[b]), b"\3" + packed.pack(*x)
                if not heads:
                    continue
                # Heads hold the least codes; mixed again, they spread over all buckets.
                code, owner = mix(np.concatenate(heads)), np.concatenate(owners)
                order = np.argsort(code, kind="stable")
                start, n = runs(code[order])
                several = np.zeros(len(code), bool)
                several[order] = np.repeat(n, n) > 1
                ship = ~several
                ship[order[start]] = ship[order[start + n - 1]] = True  # two of a repeated code tell the other batches
                for b, (c, o) in packed.deal(packed.bucket_of(code[ship], n_parts), code[ship], owner[ship]):
                    yield int(keys[b]), b"\0" + packed.pack_places(o, np.zeros(len(o), np.uint32), np.zeros(len(o), np.int32), c)
                sure, count = np.unique(owner[several & ~ship], return_counts=True)
                for b, (c, k) in packed.deal(packed.chunk_of(sure, n_parts), sure, count.astype(np.int32)):
                    yield int(keys[b]), b"\2" + packed.pack(c, k)

        return packed.rows(pairs())

    def gather(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs():
            parts = []
            for batch in it:
                for key, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if blob[0]:
                        yield key, blob
                    else:
                        parts.append(packed.unpack_places(blob[1:]))
            if not parts:
                return
            owner, _, _, code = (np.concatenate(x) for x in zip(*parts))
            parts.clear()
            order = packed.by_code(code, owner)
            shared = np.zeros(len(code), bool)
            shared[order] = _in_two(code[order], owner[order])
            # Copies of a class in several batches count once for each code.
            new = np.zeros(len(code), bool)
            new[order] = np.r_[True, (code[order][1:] != code[order][:-1]) | (owner[order][1:] != owner[order][:-1])]
            found, count = np.unique(owner[shared & new], return_counts=True)
            for b, (c, k) in packed.deal(packed.chunk_of(found, n_parts), found, count.astype(np.int32)):
                yield int(keys[b]), b"\2" + packed.pack(c, k)

        return packed.rows(pairs())

    def settle(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leads, counted = [], []
        names = ["doc", "tag", "cid", "n", "shared"]

        def out(cid, doc, tag, n, shared=None) -> pa.RecordBatch:
            last = pa.nulls(len(cid), pa.int64()) if shared is None else pa.array(shared)
            return pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int64)) for x in (doc, tag, cid, n)), last], names)

        for batch in it:
            for blob in batch.column(1).to_pylist():
                if blob[0] == 1:
                    yield out(*packed.unpack(blob[1:]))
                else:
                    (leads if blob[0] == 3 else counted).append(packed.unpack(blob[1:]))
        if not leads:
            return
        cid, doc, tag, n = (np.concatenate(x) for x in zip(*leads))
        order = np.lexsort((tag, doc, cid))
        first = order[runs(cid[order])[0]]
        cid, doc, tag, n = cid[first], doc[first], tag[first], n[first]
        shared = np.zeros(len(cid), np.int64)
        if counted:
            of, count = (np.concatenate(x) for x in zip(*counted))
            np.add.at(shared, np.searchsorted(cid, of), count)
        for i in range(0, len(cid), 10000):
            yield out(*(x[i : i + 10000] for x in (cid, doc, tag, n, shared)))

    dealt = source.mapInArrow(scatter, packed.PACKED).repartition(n_parts, "key")
    return dealt.mapInArrow(gather, packed.PACKED).repartition(n_parts, "key").mapInArrow(settle, "doc long, tag long, cid long, n long, shared long")


def _sets(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each class; repeated rows of the document that stands for it add none."""
    memo, seen = WordCodes(), set()
    for batch in batches(it):
        cids = batch.column(2).to_pylist()
        first = [i for i, c in enumerate(cids) if c not in seen and not seen.add(c)]
        batch = batch.take(pa.array(first, pa.int64()))
        sets = [shingles(raw, memo) for raw in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(list(map(len, sets)), pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["cid", "n", "codes"])


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows (cid, n, codes, ...) as entries: code, cid, n, row."""
    each = [np.frombuffer(x, np.uint64) for x in batch.column(2).to_pylist()]
    lengths = np.fromiter(map(len, each), np.int64, len(each))
    row = np.repeat(np.arange(len(each)), lengths)
    return np.concatenate([*each, np.zeros(0, np.uint64)]), batch.column(0).to_numpy()[row], batch.column(1).to_numpy()[row], row


def _gathered(it: Iterable[pa.RecordBatch]) -> list[np.ndarray] | None:
    parts = [packed.unpack_places(blob) for batch in it for blob in batch.column(1).to_pylist()]
    return [np.concatenate(x) for x in zip(*parts)] if parts else None


def fragments(spark: SparkSession, codes: int) -> int:
    """How many fragments a number of codes is cut into: some megabytes each, as many as the shuffle has at most."""
    return max(1, min(partitions(spark), -(-codes * 16 // (4 << 20))))


def prefixes(sets: DataFrame, n_parts: int) -> DataFrame:
    """(cid, n, codes, most, df, largest): prefixes in the order of frequency, with it and its greatest.

    most: the codes of the set that others have too.
    """
    keys = spread_keys(sets.sparkSession, n_parts)

    def scatter(it):
        def pairs():
            for batch in batches(_third_first(it), 8 << 20):
                code, cid, n, _ = _columns(_third_back(batch))
                for b, (c, d, t) in packed.deal(packed.bucket_of(code, n_parts), code, cid, n):
                    yield int(keys[b]), packed.pack_places(d, t, np.zeros(len(d), np.int32), c)

        return packed.rows(pairs())

    def gather(it):
        def pairs():
            got = _gathered(it)
            if got is None:
                return
            cid, n, _, code = got
            order = np.lexsort((cid, code))
            cid, n, code = cid[order], n[order], code[order]
            new = np.r_[True, (code[1:] != code[:-1]) | (cid[1:] != cid[:-1])]
            cid, n, code = cid[new], n[new], code[new]
            _, size = runs(code)
            df = np.minimum(np.repeat(size, size), 2**32 - 1).astype(np.uint32)
            shared = df > 1
            cid, n, code, df = cid[shared], n[shared], code[shared], df[shared]
            order = np.argsort(cid, kind="stable")
            cid, n, code, df = cid[order], n[order], code[order], df[order]
            for b, (d, t, c, f) in packed.deal(packed.chunk_of(cid, n_parts), cid, n, code, df):
                yield int(keys[b]), packed.pack_places(d, t, np.zeros(len(d), np.int32), c, f)

        return packed.rows(pairs())

    def settle(it):
        got = _gathered(it)
        if got is None:
            return
        cid, n, _, code, df = got
        order = np.lexsort((code, df, cid))
        cid, n, code, df = cid[order], n[order].astype(np.int64), code[order], df[order]
        starts, shared = runs(cid)
        size = n[starts]
        take = size - least_overlap(size) + 1 - (size - shared)
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int64()]
        out = [(int(cid[s]), int(m), code[s : s + t].tobytes(), int(k), df[s : s + t].tobytes(), int(df[s + t - 1])) for s, k, m, t in zip(starts, shared, size, take) if t > 0]
        for i in range(0, len(out), 2000):
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out[i : i + 2000]), kinds)], ["cid", "n", "codes", "most", "df", "largest"])

    dealt = sets.select("cid", "n", "codes").mapInArrow(scatter, packed.PACKED).repartition(n_parts, "key")
    return dealt.mapInArrow(gather, packed.PACKED).repartition(n_parts, "key").mapInArrow(settle, "cid long, n long, codes binary, most long, df binary, largest long")


def _third_first(it):
    """batches() measures the second column; codes are the third."""
    for batch in it:
        yield batch.select([0, 2, 1, *range(3, batch.num_columns)])


def _third_back(batch: pa.RecordBatch) -> pa.RecordBatch:
    return batch.select([0, 2, 1, *range(3, batch.num_columns)])


def _expand(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each count, in a row."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


def first_rank(turn: int) -> int:
    """Members of a lower rank have been compared with all others when a round begins: 0, 32, 1056, ..."""
    return 0 if turn <= 1 else 32 * first_rank(turn - 1) + 32


def needed(na, nb):
    """The least overlap of two sets that link: the union is na + nb less the overlap."""
    return -(-PERCENT * (na + nb) // (HUNDRED + PERCENT))


def _able(code, n, most) -> np.ndarray:
    """Entries of classes that can reach the overlap needed with the smallest set of the group that they may link with."""
    order = np.argsort(code, kind="stable")
    start, size = runs(code[order])
    least = np.empty(len(code), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(n[order], start), size) if len(start) else 0
    return most >= needed(n, np.maximum(least, least_overlap(n)))


def _ranked_pairs(code, cid, n, most, label, turn: int, side=None) -> tuple[list[np.ndarray], bool]:
    """Pairs (later, pivot) of all groups for a round, and whether pairs are left for later rounds.

    turn 0: every group's first member is the pivot, whatever the labels. most: the codes of a set, from this one on,
    that others have too. If this is the first common code of a pair, its overlap is no larger; a pair that links meets
    in the group of its first common code, so pairs and members that the bound rules out are left out of this group.
    side: if given, only members of unlike sides are paired.
    """
    side = np.arange(len(code)) if side is None else side
    able = _able(code, n, most)
    code, cid, n, most, label, side = (x[able] for x in (code, cid, n, most, label, side))
    order = np.lexsort((cid, 1000 * (n - most) // n, code))
    code, cid, n, most, label, side = (x[order] for x in (code, cid, n, most, label, side))
    starts, size = runs(code)
    b, c = [], []

    def pair(later: np.ndarray, pivot: np.ndarray) -> None:
        ok = (label[pivot] != label[later]) & (side[pivot] != side[later]) & (np.minimum(most[pivot], most[later]) >= needed(n[pivot], n[later]))
        b.append(later[ok])
        c.append(pivot[ok])

    more = False
    if turn == 0:
        pivot = np.repeat(starts, size - 1)
        pair(_expand(starts + 1, size - 1), pivot)
    else:
        low, high = first_rank(turn), first_rank(turn + 1)
        left = size > low + 1
        s, k = starts[left] + low, size[left] - low
        member = _expand(s, k)
        group = np.repeat(np.arange(len(s)), k)
        by = np.lexsort((label[member], group))
        member, group = member[by], group[by]
        block, width = runs_of_pairs(group, label[member])
        squares = np.bincount(group[block], width.astype(np.float64) ** 2, len(s))
        across = (k.astype(np.float64) ** 2 - squares) / 2
        # Few pairs for the group's size: all of them now. Else its next pivots against all later members.
        few = across <= 8 * k + 120
        ends = np.cumsum(k)
        rest = np.where(few[group] & (across[group] > 0), ends[group] - np.repeat(block + width, width), 0)
        one, two = np.repeat(np.arange(len(member)), rest), _expand(np.repeat(block + width, width), rest)
        wide = np.repeat(width, width)
        swap = wide[one] > wide[two]  # the pivot is the one of the smaller component
        one, two = np.where(swap, two, one), np.where(swap, one, two)
        pair(member[two], member[one])
        for rank in range(low, high):
            use = ~few & (k > rank - low + 1)
            if not use.any():
                break
            at, count = s[use] + rank - low, k[use] - (rank - low) - 1
            pair(_expand(at + 1, count), np.repeat(at, count))
        more = bool((~few & (k > high - low + 1)).any())
    b, c = np.concatenate([*b, np.zeros(0, np.int64)]).astype(np.int64), np.concatenate([*c, np.zeros(0, np.int64)]).astype(np.int64)
    b_id, c_id = cid[b], cid[c]
    order = np.lexsort((c_id, b_id))
    b_id, c_id, nb, nc = b_id[order], c_id[order], n[b][order], n[c][order]
    at, support = runs_of_pairs(b_id, c_id)
    return [b_id[at], c_id[at], nb[at], nc[at], support], more


def runs_of_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of equal pairs."""
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    return at, np.diff(np.r_[at, len(a)])


def _entries(batch: pa.RecordBatch) -> list[np.ndarray]:
    """Prefixes with labels as entries: mixed code, cid, n, most, label, df."""
    code, cid, n, row = _columns(batch)
    # Of two sets' first common code, each set has just the codes from there on to share.
    at, count = runs(row)
    most = batch.column(3).to_numpy()[row] - (np.arange(len(row)) - np.repeat(at, count))
    df = np.concatenate([*(np.frombuffer(x, np.uint32) for x in batch.column(4).to_pylist()), np.zeros(0, np.uint32)]).astype(np.int64)
    return [mix(code), cid, n, most, batch.column(5).to_numpy()[row], df]


def _blocked(code: np.ndarray, cid: np.ndarray, df: np.ndarray, size: int, sampled: int) -> tuple[np.ndarray, np.ndarray]:
    """(entry, group): every entry's block of its code, and the blocks of the levels that it is sampled for."""
    entry, group = np.arange(len(code)), code.copy()
    chance = mix(code ^ mix(cid.view(np.uint64)))
    entries, groups, level = [entry], [group], 0
    here, of = np.flatnonzero(df > size), df
    while len(here):
        blocks = -(-of[here] // size)
        block = block_of(code[here], cid[here], blocks, level)
        named = mix(code[here] + (block + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(level) * np.uint64(0xD6E8FEB86659FD93))
        if level == 0:
            group[here] = named
        else:
            entries.append(here)
            groups.append(named)
        level += 1
        above = here[blocks > 1]
        here = above[chance[above] < np.uint64(2**64 // sampled**level)]
        of = -(-df // sampled**level)
    return np.concatenate(entries), np.concatenate(groups)


def block_of(code: np.ndarray, cid: np.ndarray, blocks: np.ndarray, level: int = 0) -> np.ndarray:
    """The block of each member, by a hash of its own."""
    return mix(mix(cid.view(np.uint64) + np.uint64(level)) + code) % blocks.astype(np.uint64)


def _slices(code: np.ndarray, turn: int, limit: int) -> Iterator[np.ndarray]:
    """Entries in parts of whole groups with about `limit` pairs at most, or of one group."""
    order = np.argsort(code, kind="stable")
    start, size = runs(code[order])
    cost = size if turn == 0 else np.minimum(size * size, size * (first_rank(turn + 1) - first_rank(turn)) + 8 * size + 120)
    ends, stops, at = np.cumsum(cost), np.r_[start[1:], len(code)], 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
        yield order[start[at] : stops[to - 1]]
        at = to


def candidates(prefix: DataFrame, turn: int, n_parts: int) -> DataFrame:
    """(b, c, nb, nc, part) to compare in a round, for prefixes with labels; a row (null, ...) says that more may follow.

    part numbers the partners of b in portions of PARTNERS.
    """
    keys = spread_keys(prefix.sparkSession, n_parts)
    size, sampled, at_once, partners = BLOCK, SAMPLED, AT_ONCE, PARTNERS

    def scatter(it):
        def pairs():
            for batch in batches(_third_first(it), 8 << 20):
                code, cid, n, most, label, df = _entries(_third_back(batch))
                at, code = _blocked(code, cid, df, size, sampled)
                for b, (c, d, t, o, k) in packed.deal(packed.bucket_of(code, n_parts), code, cid[at], n[at], most[at], label[at]):
                    yield int(keys[b]), packed.pack_places(d, t, np.zeros(len(d), np.int32), c, o, k)

        return packed.rows(pairs())

    def gather(it):
        def pairs():
            got = _gathered(it)
            if got is None:
                return
            cid, n, _, code, most, label = got
            left = False
            for s in _slices(code, turn, at_once):
                found, more = _ranked_pairs(code[s], cid[s], n[s].astype(np.int64), most[s], label[s], turn)
                left |= more
                for b, parts in packed.deal(packed.chunk_of(found[0], n_parts), *found):
                    yield int(keys[b]), b"\0" + packed.pack(*parts)
            if left:
                yield int(keys[0]), b"\1"

        return packed.rows(pairs())

    def settle(it):
        parts, more = [], False
        for batch in it:
            for blob in batch.column(1).to_pylist():
                if blob[0]:
                    more = True
                else:
                    parts.append(packed.unpack(blob[1:]))
        names = ["b", "c", "nb", "nc", "part"]
        if parts:
            b, c, nb, nc, support = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((c, b))
            b, c, nb, nc, support = b[order], c[order], nb[order], nc[order], support[order]
            at = np.flatnonzero(np.r_[True, (b[1:] != b[:-1]) | (c[1:] != c[:-1])])
            support = np.add.reduceat(support, at)
            b, c, nb, nc = b[at], c[at], nb[at], nc[at]
            if turn == 0:
                order = np.lexsort((c, -support, b))
                first, _ = runs(b[order])
                b, c, nb, nc = (x[order][first] for x in (b, c, nb, nc))
            at, count = runs(b)
            part = (np.arange(len(b)) - np.repeat(at, count)) // partners
            for i in range(0, len(b), 10000):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 10000].astype(np.int64)) for x in (b, c, nb, nc, part)], names)
        if more:
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64())] * 5, names)

    dealt = prefix.select("cid", "n", "codes", "most", "df", "label").mapInArrow(scatter, packed.PACKED).repartition(n_parts, "key")
    return dealt.mapInArrow(gather, packed.PACKED).repartition(n_parts, "key").mapInArrow(settle, PAIRS)


def _large(size: int, it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries (code, cid, n, most, label, blocks, block) of codes that have several blocks."""
    for batch in batches(_third_first(it), 8 << 20):
        code, cid, n, most, label, df = (x[e[5] > size] for e in [_entries(_third_back(batch))] for x in e)
        blocks = -(-df // size)
        arrays = (code.view(np.int64), cid, n, most, label, blocks, block_of(code, cid, blocks).astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["code", "cid", "n", "most", "label", "blocks", "block"])


def open_members(prefix: DataFrame) -> DataFrame:
    """Entries of large groups whose members are in several components, in each pair of blocks that they belong to."""
    entries = prefix.select("cid", "n", "codes", "most", "df", "label").mapInArrow(partial(_large, BLOCK), "code long, cid long, n long, most long, label long, blocks long, block long")
    spread = entries.groupBy("code").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("code")
    other = F.explode(F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda x: x != F.col("block"))).alias("other")
    pairs = looked_up(entries, spread, "code", "cid").select("*", other)
    return pairs.select("code", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("k"), "cid", "n", "most", "label", (F.col("block") > F.col("other")).alias("side"))


def block_candidates(members: DataFrame, turn: int) -> DataFrame:
    """candidates() of open_members(): every pair of blocks is a group."""

    def run(table: pa.Table) -> pa.Table:
        cid, n, most, label, side = (table.column(c).to_numpy() for c in ("cid", "n", "most", "label", "side"))
        (b, c, nb, nc, _), more = _ranked_pairs(np.zeros(len(cid), np.uint64), cid, n, most, label, turn, side)
        columns = [np.r_[x, np.zeros(int(more), np.int64)] for x in (b, c, nb, nc)]
        last = np.arange(len(columns[0])) >= len(b)
        part = mix(columns[1].astype(np.uint64)) % np.uint64(SALTS)
        return pa.table([pa.array(x.astype(np.int64), mask=last) for x in (*columns, part)], ["b", "c", "nb", "nc", "part"])

    return members.groupBy("code", "i", "k").applyInArrow(run, PAIRS).distinct()


def _partial_overlaps(code, cid, pair_b, pair_c, step: int = 4_000_000) -> np.ndarray:
    """Overlap of each pair in one fragment."""
    ids, of = np.unique(cid, return_inverse=True)
    _, code = np.unique(code, return_inverse=True)
    where = np.unique(code.astype(np.int64) * len(ids) + of)
    code, of = np.divmod(where, len(ids))
    order = np.argsort(of, kind="stable")
    starts = np.searchsorted(of[order], np.arange(len(ids) + 1))
    b, c = np.searchsorted(ids, pair_b), np.searchsorted(ids, pair_c)
    here = (c < len(ids)) & (ids[np.minimum(c, len(ids) - 1)] == pair_c)
    counts = np.where(here, starts[b + 1] - starts[b], 0)
    out = np.zeros(len(pair_b), np.int64)
    ends = np.cumsum(counts)
    i = 0
    while i < len(counts):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + step, "right")))
        k = counts[i:j]
        pair = np.repeat(np.arange(i, j), k)
        entry = order[np.repeat(starts[b[i:j]], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)]
        key = code[entry] * len(ids) + c[pair]
        at = np.minimum(np.searchsorted(where, key), len(where) - 1)
        out[i:j] = np.bincount(pair - i, where[at] == key, j - i)
        i = j
    return out


def links(sets: DataFrame, pairs: DataFrame, n_parts: int) -> DataFrame:
    """Those pairs (a, b) of the given (b, c, nb, nc, part) whose sets link; a set travels once for each part of its partners."""
    keys = spread_keys(sets.sparkSession, n_parts)
    # As needed() has it.
    need_ = F.ceil(F.lit(PERCENT) * (F.col("nb") + F.col("nc")) / (HUNDRED + PERCENT)).cast("long")
    partner = F.struct(F.col("c").alias("c"), need_.alias("need"))
    partners = pairs.groupBy(F.col("b").alias("cid"), "part").agg(F.collect_list(partner).alias("partners"))
    pivots = pairs.select(F.col("c").alias("cid"), F.lit(0).cast("long").alias("part")).distinct().withColumn("partners", F.array().cast("array<struct<c:long,need:long>>"))
    wanted = partners.unionByName(pivots).groupBy("cid", "part").agg(F.flatten(F.collect_list("partners")).alias("partners"))
    need = sets.join(wanted, "cid").select("cid", "n", "codes", "partners")

    def scatter(it):
        def pairs_():
            for batch in batches(_third_first(it), 8 << 20):
                batch = _third_back(batch)
                code, cid, n, row = _columns(batch)
                partners = [np.array([(y["c"], y["need"]) for y in x], np.int64).reshape(-1, 2) for x in batch.column(3).to_pylist()]
                ids = batch.column(0).to_numpy()
                for b, (c, r) in packed.deal(packed.bucket_of(code, n_parts), code, row):
                    # Sets by their place in the blob, pairs in the order of their pivots: little of a pair is left.
                    at, count = runs(r)
                    here = r[at]
                    pivot, need_of = np.concatenate([partners[i] for i in here]).T
                    of = np.repeat(np.arange(len(here)), [len(partners[i]) for i in here])
                    table, index = np.unique(pivot, return_inverse=True)
                    order = np.argsort(index, kind="stable")
                    small = [np.diff(index[order], prepend=0).astype(np.int32), of[order].astype(np.int32), need_of[order].astype(np.int32)]
                    yield int(keys[b]), packed.pack(c, ids[here], count.astype(np.int32), table, *small)

        return packed.rows(pairs_())

    def gather(it):
        def pairs_():
            parts = []
            for batch in it:
                for blob in batch.column(1).to_pylist():
                    c, ids, count, table, index, of, need = packed.unpack(blob)
                    parts.append((c, np.repeat(ids, count), ids[of], table[np.cumsum(index)], need))
            if not parts:
                return
            code, cid, pair_b, pair_c, need_of = (np.concatenate(x) for x in zip(*parts))
            parts.clear()
            order = np.lexsort((pair_c, pair_b))
            at, _ = runs_of_pairs(pair_b[order], pair_c[order])
            pair_b, pair_c, need_of = (x[order[at]] for x in (pair_b, pair_c, need_of))
            overlap = _partial_overlaps(code, cid, pair_b, pair_c)
            some = overlap > 0
            found = (pair_b[some], pair_c[some], overlap[some].astype(np.int32), need_of[some].astype(np.int32))
            for b, out in packed.deal(packed.chunk_of(found[0], n_parts), *found):
                yield int(keys[b]), packed.pack(*out)

        return packed.rows(pairs_())

    def settle(it):
        parts = [packed.unpack(blob) for batch in it for blob in batch.column(1).to_pylist()]
        if not parts:
            return
        b, c, overlap, need_of = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((c, b))
        b, c, overlap, need_of = b[order], c[order], overlap[order], need_of[order]
        at, _ = runs_of_pairs(b, c)
        if len(at):
            at = at[np.add.reduceat(overlap.astype(np.int64), at) >= need_of[at]]
        for i in range(0, len(at), 10000):
            yield pa.RecordBatch.from_arrays([pa.array(b[at[i : i + 10000]]), pa.array(c[at[i : i + 10000]])], ["a", "b"])

    dealt = need.mapInArrow(scatter, packed.PACKED).repartition(n_parts, "key")
    return dealt.mapInArrow(gather, packed.PACKED).repartition(n_parts, "key").mapInArrow(settle, "a long, b long")


def similar(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id) of every row."""
    return _membership(*_linked(packed.keyed(docs)))


def _linked(source: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows (doc, tag, cid, n), and the component (node, label) of each class that has a link."""
    spark = source.sparkSession
    rows = durable(classes_of(source), small=True)
    described = rows.where("shared IS NULL").select("doc", "tag", "cid", "n")
    smaller = F.ceil(F.col("n") * PERCENT / HUNDRED)
    left = rows.where((F.col("n") > 0) & (F.col("shared") >= F.greatest(F.lit(1), F.floor(smaller / 8)))).select("doc", "tag", "cid")
    sets = durable(source.join(left, ["doc", "tag"]).select("doc", "raw", "cid").mapInArrow(_sets, "cid long, n long, codes binary"))
    cut = fragments(spark, sets.agg(F.sum("n")).first()[0] or 0)
    prefix = durable(prefixes(sets, cut), small=True)
    size, largest = prefix.agg(F.sum(F.length("codes")), F.max("largest")).first()
    thin = fragments(spark, (size or 0) // 4)
    labels = compared = None
    # Rounds within blocks; then, for the codes of several blocks that are left, rounds within pairs of blocks.
    for across in (False, True) if (largest or 0) > BLOCK else (False,):
        turn, members = 0, None
        while True:
            if labels is None:
                known = prefix.withColumn("label", F.col("cid"))
            else:
                known = prefix.join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
            if across:
                members = durable(open_members(known), small=True)
                if members.isEmpty():
                    return described, labels
            found = durable(block_candidates(members, turn) if across else candidates(known, turn, thin), small=True)
            pairs = found.where("b IS NOT NULL")
            either = [F.least("b", "c").alias("low"), F.greatest("b", "c").alias("high")]
            if compared is not None:
                pairs = pairs.select("*", *either).join(compared, ["low", "high"], "left_anti").select("b", "c", "nb", "nc", "part")
            if not pairs.isEmpty():
                new = durable(links(sets, pairs, cut), small=True)
                if not new.isEmpty():
                    joined = new if labels is None else new.unionByName(labels.select(F.col("node").alias("a"), F.col("label").alias("b")))
                    labels = components(joined)
                this = found.where("b IS NOT NULL").select(*either)
                compared = this if compared is None else compared.unionByName(this)
            if turn and found.where("b IS NULL").isEmpty():
                break
            turn += 1
            release(spark)
    return described, labels


def _membership(described: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Rows with the least document of their component; classes without a link are components of their own."""
    classes = described.where("n > 0").groupBy("cid").agg(F.min("doc").alias("least"))
    if labels is not None:
        labelled = classes.join(labels.withColumnRenamed("node", "cid"), "cid")
        least = labelled.groupBy("label").agg(F.min("least").alias("of_label"))
        linked = looked_up(labelled, least, "label", "cid").select("cid", "of_label")
        classes = classes.join(linked, "cid", "left").select("cid", F.coalesce("of_label", "least").alias("least"))
    out = looked_up(described, classes, "cid", "doc", "left")
    component = F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc"))
    late = F.lit(packed.LAST)
    return out.select(F.nullif("doc", late).alias("doc_id"), F.col("n").alias("n_shingles"), F.nullif(component, late).alias("component_id"), F.col("cid").alias("class_id"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents, all columns, without those that are in a component with an earlier one.

    Of rows that share both doc_id and text one stays; texts without words link with nothing and all stay.
    """
    from pyspark.sql import Window

    source = packed.keyed(docs)
    described, labels = _linked(source)
    classes = described.where("n > 0").groupBy("cid").agg(F.min(F.struct("doc", "tag")).alias("first"))
    if labels is not None:
        classes = classes.join(labels.withColumnRenamed("node", "cid"), "cid", "left").groupBy(F.coalesce("label", "cid").alias("label")).agg(F.min("first").alias("first"))
    stay = classes.select(F.col("first.doc").alias("__doc"), F.col("first.tag").alias("__tag"), F.lit(True).alias("__one"))
    blank = described.where("n = 0").select(F.col("doc").alias("__doc"), F.col("tag").alias("__tag"), F.lit(False).alias("__one")).distinct()
    raw = F.coalesce(F.encode(F.col("text"), "UTF-8"), F.lit(b""))
    rows = docs.withColumns({"__doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(packed.LAST)), "__tag": F.xxhash64(raw).bitwiseAND(F.lit(0xFFFFFFFF))})
    kept = rows.join(stay.unionByName(blank), ["__doc", "__tag"])
    nth = F.row_number().over(Window.partitionBy("__doc", "__tag").orderBy("__one"))
    return kept.withColumn("__nth", nth).where("__nth = 1 OR NOT __one").select(*docs.columns)


#: Components by all pairs that share a shingle; for small tables.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w
), e AS (SELECT doc_id, unnest(sh) AS g FROM s),
n AS (SELECT doc_id, len(sh)::BIGINT AS n FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * shared >= 75 * (a.n + b.n - shared)),
z AS MATERIALIZED (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT doc_id AS node, doc_id AS root FROM n UNION SELECT z.y, r.root FROM r JOIN z ON z.x = r.node AND z.y > r.root)
SELECT n.doc_id, any_value(n.n) AS n_shingles, min(root) AS component_id FROM n JOIN r ON r.node = n.doc_id GROUP BY n.doc_id
"""
