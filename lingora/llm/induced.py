"""Suffix arrays with common prefixes by external induced sorting, in numpy.

The queue holds suffix tuples (position, common prefix with the tuple before), in a region for each first character,
which is the order in which induction takes them. What waits under the least character leaves together, as a wave, and
puts its predecessors at the tails of their characters' regions; the common prefix of two neighbours there is one more
than the least of all common prefixes between the two suffixes that they come from. All arrays that grow with the
shard - text, types, queues, names, the order itself - are in memory up to a limit and in files beyond it; regions are
read and written in order, and a wave is taken in parts of WAVE tuples.

Suffixes are of type S or L (less or greater than the next). The leftmost S suffixes (LMS) are sorted first: induction
sorts their substrings, whose common prefixes tell which are equal and so give names; unless all names differ, the
string of names is sorted by the same procedure, one level down, and its common prefixes, in names, are turned into
characters. Recursion ends with names that all differ, or with a string of names that fits into the memory limit, which
is sorted there outright. From the sorted LMS suffixes the L suffixes are induced upwards, and from these the S suffixes
downwards. A name that is too large for a character of the next level is written in two digits there; order is the same.

Common prefixes are counted up to `cap`, and the order among suffixes that agree so far is left open.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

#: A separator: less than all characters, less than any later separator, and equal to none.
SEPARATOR = 0
WAVE = 1 << 20
#: Names up to this number are characters of the next level, larger ones have two digits.
NAMES = 256
#: Bytes that sorting a name in memory takes.
INNER = 24
_LOG2 = np.frexp(np.arange(1, WAVE + 1, dtype=np.float64))[1].astype(np.int8) - 1


class Store:
    """Arrays of a shard: in memory up to `limit` bytes, beyond that in temporary files that go with the array."""

    def __init__(self, limit: int) -> None:
        self.limit, self.held, self.spilled = limit, 0, 0

    def array(self, n: int, kind) -> np.ndarray:
        """An array of n zeros."""
        size = n * np.dtype(kind).itemsize
        if self.held + size <= self.limit or not n:
            self.held += size
            return np.zeros(n, kind)
        self.spilled += size
        with tempfile.TemporaryFile(prefix="induced-") as file:
            return np.asarray(np.memmap(file, kind, "w+", shape=(n,)))

    def free(self, *arrays: np.ndarray) -> None:
        """Tells that arrays are no longer in use; the files of those on disk go with their last reference."""
        for a in arrays:
            if a.base is None:
                self.held -= a.nbytes


def range_min(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least of values[low..high], both included, for many ranges."""
    level = (_LOG2[high - low] if len(values) <= WAVE else np.frexp((high - low + 1).astype(np.float64))[1] - 1).astype(np.int64)
    n = int(level.max()) + 1
    table = np.empty((n, len(values)), values.dtype)
    table[0] = values
    half = 1
    for k in range(1, n):
        np.minimum(table[k - 1, :-half], table[k - 1, half:], out=table[k, :-half])
        half *= 2
    return np.minimum(table[level, low], table[level, high - (1 << level) + 1])


class RangeMin:
    """range_min() over one long array, with a table of its blocks alone."""

    BLOCK = 64

    def __init__(self, values: np.ndarray, store: Store) -> None:
        self.values, n, size = values, len(values), self.BLOCK
        self.down, self.up = store.array(n, values.dtype), store.array(n, values.dtype)
        least = []
        for at in range(0, n, WAVE * size):
            part = values[at : at + WAVE * size]
            whole = np.full(-(-len(part) // size) * size, 255, values.dtype)
            whole[: len(part)] = part
            whole = whole.reshape(-1, size)
            self.up[at : at + len(part)] = np.minimum.accumulate(whole, 1).ravel()[: len(part)]
            self.down[at : at + len(part)] = np.minimum.accumulate(whole[:, ::-1], 1)[:, ::-1].ravel()[: len(part)]
            least.append(whole.min(1))
        self.least = np.concatenate(least)

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        a, b = low // self.BLOCK, high // self.BLOCK
        out = np.minimum(self.down[low], self.up[high])
        far = np.flatnonzero(b > a + 1)
        if len(far):
            out[far] = np.minimum(out[far], range_min(self.least, a[far] + 1, b[far] - 1))
        near = np.flatnonzero(a == b)
        out[near] = self.values[low[near]]
        at = low[near] + 1
        while len(near):
            more = at <= high[near]
            near, at = near[more], at[more]
            out[near] = np.minimum(out[near], self.values[at])
            at = at + 1
        return out


class Queue:
    """Suffix tuples by first character: a region for each, filled at the tail and taken from the head."""

    def __init__(self, level: Level, wanted: bool) -> None:
        self.level = level
        count = level.s_count if wanted else level.count - level.s_count
        self.start = np.cumsum(count) - count
        self.tail = self.start.copy()
        self.position = level.store.array(int(count.sum()), level.index)
        self.common = level.store.array(int(count.sum()), np.uint8)
        # For each character, the least common prefix since the last suffix that put one into its region.
        self.since = np.zeros(len(count), np.uint8)
        # The characters of suffixes of the wanted type; others, and separators, which nothing precedes, are 0.
        self.wanted = level.store.array(len(level.text), level.text.dtype)
        for i in range(0, len(level.text), WAVE):
            part = slice(i, i + WAVE)
            np.multiply(level.text[part], level.is_s[part] == wanted, out=self.wanted[part])

    def done(self) -> None:
        """All are queued that will be."""
        self.level.store.free(self.wanted)
        self.wanted = None

    def free(self) -> None:
        self.level.store.free(self.position, self.common)

    def waves(self, c: int, at: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """What waits under a character, and what is put there meanwhile; the first has nothing in common with any before."""
        at = self.start[c]
        if at < self.tail[c]:
            self.common[at] = 0
        while at < self.tail[c]:
            to = min(self.tail[c], at + WAVE)
            yield self.position[at:to], self.common[at:to]
            at = to

    def push(self, after: np.ndarray, common: np.ndarray) -> None:
        """Queues the predecessors, if of the wanted type, of suffixes in order; common: with the one before.

        The predecessor of place 0 is found to be the last separator, which is not wanted.
        """
        most = self.level.cap - 1
        if len(after) < 8:
            for p, k in zip((after - 1).tolist(), common.tolist()):
                np.minimum(self.since, k, out=self.since)
                c = int(self.wanted[p])
                if c:
                    at = self.tail[c]
                    self.position[at], self.common[at] = p, min(int(self.since[c]), most) + 1
                    self.tail[c], self.since[c] = at + 1, 255
            return
        before = after - 1
        character = self.wanted[before]
        at = character.nonzero()[0]
        if not len(at):
            np.minimum(self.since, common.min(), out=self.since)
            return
        character = character[at]
        order = character.argsort(kind="stable")
        at, character = at[order], character[order]
        new = np.empty(len(at), bool)
        new[0] = True
        np.not_equal(character[1:], character[:-1], out=new[1:])
        head = new.nonzero()[0]
        end = np.empty(len(head), np.int64)
        end[:-1], end[-1] = head[1:], len(at)
        count = end - head
        low = np.empty(len(at), np.int64)
        low[1:] = at[:-1] + 1
        low[head] = 0
        shared = range_min(common, low, at)
        to = character[head].astype(np.int64)
        shared[head] = np.minimum(shared[head], self.since[to])
        place = np.repeat(self.tail[to] - head, count) + np.arange(len(at))
        self.position[place] = before[at]
        self.common[place] = np.minimum(shared, most) + 1
        self.tail[to] += count
        rest = np.empty(len(common) + 1, np.uint8)
        rest[-1] = 255
        np.minimum.accumulate(common[::-1], out=rest[-2::-1])
        np.minimum(self.since, rest[0], out=self.since)
        self.since[to] = rest[at[end - 1] + 1]


class Level:
    """A string of small integers that ends with a separator, its types, and the induction of its suffixes."""

    def __init__(self, text: np.ndarray, cap: int, store: Store) -> None:
        if not 1 <= cap <= 254:
            raise ValueError("common prefixes are counted up to 254 at most")
        self.text, self.cap, self.store = text, cap, store
        n = len(text)
        self.index = np.int32 if n < 2**31 else np.int64
        self.count = sum(np.bincount(text[i : i + WAVE], minlength=int(text.max()) + 1) for i in range(0, n, WAVE))
        self.s_count = np.zeros_like(self.count)
        self.is_s = store.array(n, bool)
        later, after = True, text[-1]  # of what follows the part
        for i in range((n - 1) // WAVE * WAVE, -1, -WAVE):
            x = text[i : i + WAVE]
            y = np.r_[x[1:], after]
            unlike = np.where(x != y, np.arange(len(x)), len(x))
            end = np.minimum.accumulate(unlike[::-1])[::-1]  # of the run that each is in
            here = np.r_[x < y, later][end]
            self.is_s[i : i + WAVE] = here
            self.s_count += np.bincount(x[here], minlength=len(self.count))
            later, after = here[0], x[0]

    def lms(self) -> np.ndarray:
        """LMS positions in order of place; separators are among them."""
        parts, at = [], 0
        for i in range(0, len(self.text), WAVE):
            here = self.is_s[i : i + WAVE]
            before = np.r_[self.is_s[i - 1] if i else True, here[:-1]]
            parts.append(np.flatnonzero(here & ~before | (self.text[i : i + WAVE] == SEPARATOR)).astype(self.index) + self.index(i))
        out = self.store.array(sum(map(len, parts)), self.index)
        for part in parts:
            out[at : at + len(part)] = part
            at += len(part)
        return out

    def by_character(self, positions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions by first character, in their order; and which have the character of the one before."""
        total = sum(np.bincount(self.text[positions[i : i + WAVE]], minlength=len(self.count)) for i in range(0, len(positions), WAVE))
        tail = np.cumsum(total) - total
        out, alike = self.store.array(len(positions), self.index), self.store.array(len(positions), np.uint8)
        alike[:] = 1
        alike[tail[total > 0]] = 0
        alike[: total[SEPARATOR]] = 0
        for i in range(0, len(positions), WAVE):
            part = positions[i : i + WAVE]
            character = self.text[part]
            order = np.argsort(character, kind="stable")
            head = np.flatnonzero(np.r_[True, character[order][1:] != character[order][:-1]])
            count, to = np.diff(np.r_[head, len(part)]), character[order][head]
            out[np.repeat(tail[to] - head, count) + np.arange(len(part))] = part[order]
            tail[to] += count
        return out, alike

    def measured(self, a: int, b: int) -> int:
        """The common prefix of two suffixes, on the text."""
        x, y = self.text[a : a + self.cap], self.text[b : b + self.cap]
        k = min(len(x), len(y))
        unlike = np.flatnonzero((x[:k] != y[:k]) | (x[:k] == SEPARATOR))
        return int(unlike[0]) if len(unlike) else k

    def extended(self, a: np.ndarray, b: np.ndarray, common: np.ndarray) -> np.ndarray:
        """Common prefixes of pairs of suffixes that have at least so much in common."""
        common = np.minimum(common, self.cap).astype(np.uint8)
        live = np.flatnonzero(common < self.cap)
        while len(live):
            k = common[live]
            x = self.text[a[live] + k]
            same = (x == self.text[b[live] + k]) & (x != SEPARATOR)
            live = live[same]
            common[live] += 1
            live = live[common[live] < self.cap]
        return common

    def induced(self, seeds: np.ndarray, common: np.ndarray, substrings: bool) -> tuple[Queue, Queue]:
        """L and S suffixes in order, from LMS suffixes in order (of their first characters only, if substrings).

        A region of the second queue is in falling order.
        """
        total = sum(np.bincount(self.text[seeds[i : i + WAVE]], minlength=len(self.count)) for i in range(0, len(seeds), WAVE))
        bounds = np.r_[0, np.cumsum(total)]
        up = Queue(self, False)
        present = np.flatnonzero(self.count)
        for c in present.tolist():
            for wave in up.waves(c):
                up.push(*wave)
            at, to = bounds[c], bounds[c + 1]
            if at < to:
                here = common[at:to].copy()
                large = up.tail[c] > up.start[c]
                here[0] = 0 if not large else 1 if substrings else self.measured(up.position[up.tail[c] - 1], seeds[at])
                for i in range(0, to - at, WAVE):
                    up.push(seeds[at + i : min(at + i + WAVE, to)], here[i : i + WAVE])
        up.done()
        down = Queue(self, True)
        for c in present[::-1].tolist():
            if c == SEPARATOR:  # as they stand in the text; none of their predecessors is of type S
                down.position[down.start[c] : down.start[c] + bounds[1]] = seeds[: bounds[1]][::-1]
                down.tail[c] += bounds[1]
                break
            for wave in down.waves(c):
                down.push(*wave)
            at, to = int(up.start[c]), int(up.tail[c])
            if at < to:
                first = np.uint8(self.boundary(up, down, c))
                for high in range(to, at, -WAVE):
                    low = max(at, high - WAVE)
                    here = np.r_[first, up.common[low + 1 : high][::-1]]
                    down.push(up.position[low:high][::-1], here)
                    first = up.common[low]
        down.done()
        return up, down

    def boundary(self, up: Queue, down: Queue, c: int) -> int:
        """What the greatest L suffix and the least S suffix of a character have in common."""
        if up.start[c] == up.tail[c] or down.start[c] == down.tail[c]:
            return 0
        return self.measured(up.position[up.tail[c] - 1], down.position[down.tail[c] - 1])

    def ordered(self, up: Queue, down: Queue, only_s: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All suffixes in order, in parts: positions, and common prefixes with the one before."""
        for c in np.flatnonzero(self.count).tolist():
            if not only_s and up.start[c] < up.tail[c]:
                up.common[up.start[c]] = 0
                for at in range(int(up.start[c]), int(up.tail[c]), WAVE):
                    to = min(at + WAVE, int(up.tail[c]))
                    yield up.position[at:to], up.common[at:to]
            at, to = int(down.start[c]), int(down.tail[c])
            before = 0 if only_s else self.boundary(up, down, c)
            for high in range(to, at, -WAVE):
                low = max(at, high - WAVE)
                here = np.r_[np.uint8(before), down.common[low + 1 : high][::-1]]
                yield down.position[low:high][::-1], here
                before = down.common[low]

    def sorted_lms(self) -> tuple[np.ndarray, np.ndarray]:
        """LMS suffixes in order, and common prefixes with the one before."""
        lms, store = self.lms(), self.store
        m = len(lms)
        by_char, alike = self.by_character(lms)
        if m == 1:
            return by_char, np.zeros(1, np.uint8)
        up, down = self.induced(by_char, alike, True)
        up.free()
        store.free(by_char, alike)
        order, common = self._only_lms(up, down, lms)
        down.free()
        del up, down, by_char, alike
        # Names: equal substrings have all of their length in common.
        name, between = store.array(m, self.index), store.array(m, np.uint8)
        names, last = 0, -1
        for i in range(0, m, WAVE):
            here = order[i : i + WAVE]
            number = np.searchsorted(lms, here)
            length = lms[np.minimum(number + 1, m - 1)] - here + 1
            shared = common[i : i + WAVE]
            new = (shared < length) | (length != np.r_[last, length[:-1]])
            new[0] |= i == 0
            name[number] = names + np.cumsum(new) - 1
            found = int(new.sum())
            between[names : names + found] = shared[new]
            names, last = names + found, length[-1]
        if names < m:
            store.free(order, common)
            del order, common
            rank, common = _reduced(name, names, len(self.text), self.cap // 2 + 1, store)
            order, least = store.array(m, self.index), RangeMin(between[:names], store)
            for i in range(0, m, WAVE):
                order[i : i + WAVE] = lms[rank[i : i + WAVE]]
            for i in range(1, m, WAVE):
                x, y, k = rank[i - 1 : i - 1 + WAVE][: m - i], rank[i : i + WAVE], common[i : i + WAVE].astype(np.int64)
                chars = lms[x + k].astype(np.int64) - lms[x]
                short = np.flatnonzero(chars < self.cap)
                if len(short):
                    a, b = name[x[short] + k[short]].astype(np.int64), name[y[short] + k[short]].astype(np.int64)
                    chars[short] += least.of(np.minimum(a, b) + 1, np.maximum(a, b))
                common[i : i + WAVE] = np.minimum(chars, self.cap)
            store.free(rank, least.up, least.down)
        for i in range(1, m, WAVE):
            common[i : i + WAVE] = self.extended(order[i : i + WAVE], order[i - 1 : i - 1 + WAVE][: m - i], common[i : i + WAVE])
        store.free(lms, name, between)
        return order, common

    def _only_lms(self, up: Queue, down: Queue, lms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        is_lms = self.store.array(len(self.text), bool)
        is_lms[lms] = True
        order, common = self.store.array(len(lms), self.index), self.store.array(len(lms), np.uint8)
        at, least = 0, 255
        for position, shared in self.ordered(up, down, only_s=True):
            at, least = _picked(is_lms[position], position, shared, order, common, at, least)
        self.store.free(is_lms)
        return order, common

    def suffixes(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All suffixes in order, in parts: positions, and common prefixes with the one before."""
        order, common = self.sorted_lms()
        up, down = self.induced(order, common, False)
        self.store.free(order, common)
        yield from self.ordered(up, down)
        up.free()
        down.free()
        self.store.free(self.is_s)


def _picked(wanted, position, shared, order, common, at: int, least: int) -> tuple[int, int]:
    """Appends the wanted ones of a part of an order, with the least common prefix since the one before."""
    here = np.flatnonzero(wanted)
    if not len(here):
        return at, min(least, int(shared.min()))
    order[at : at + len(here)] = position[here]
    found = np.minimum.reduceat(shared[: here[-1] + 1], np.r_[0, here[:-1] + 1])
    found[0] = min(int(found[0]), least)
    common[at : at + len(here)] = found
    rest = shared[here[-1] + 1 :]
    return at + len(here), int(rest.min()) if len(rest) else 255


def _reduced(name: np.ndarray, names: int, n: int, cap: int, store: Store) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes of a string of names, and common prefixes in names with the one before."""
    m = len(name)
    if INNER * m <= store.limit:
        return _inner(name, cap)
    digits = 2 if names > NAMES and 2 * m <= 0.85 * n else 1
    base = int(np.ceil(np.sqrt(names))) if digits == 2 else names
    text = store.array(digits * m + 1, np.uint8 if base < 255 else np.uint16 if base < 65535 else np.int64)
    for i in range(0, m, WAVE):
        part = name[i : i + WAVE]
        if digits == 2:
            text[2 * i : 2 * (i + len(part)) : 2], text[2 * i + 1 : 2 * (i + len(part)) : 2] = part // base + 1, part % base + 1
        else:
            text[i : i + len(part)] = part + 1
    level = Level(text, min(254, digits * cap), store)
    order, common = store.array(m, level.index), store.array(m, np.uint8)
    at, least = 0, 255
    for position, shared in level.suffixes():
        wanted = (position % digits == 0) & (position < digits * m) if digits == 2 else position < m
        at, least = _picked(wanted, position, shared, order, common, at, least)
    store.free(text)
    if digits == 2:
        order >>= 1
        common >>= 1
    return order, common


def _inner(name: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """_reduced() in memory: ranks by one name, by two, by four, until all differ or `cap` names are told apart."""
    m, step, rank = len(name), 1, name.astype(np.int64)
    while True:
        key = rank * (m + 1)
        key[: m - step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.empty(m, bool)
        new[0] = True
        np.not_equal(key[1:], key[:-1], out=new[1:])
        step *= 2
        if new.all() or step >= cap:
            break
        rank[order] = np.cumsum(new) - 1
    common = np.zeros(m, np.uint8)
    live = np.arange(1, m)
    while len(live):
        a, b = order[live] + common[live], order[live - 1] + common[live]
        live = live[(np.maximum(a, b) < m) & (name[np.minimum(a, m - 1)] == name[np.minimum(b, m - 1)])]
        common[live] += 1
        live = live[common[live] < cap]
    return order, common


def suffixes(text: np.ndarray, cap: int, store: Store) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Suffixes of an array of small integers that ends with a separator, in order and in parts, with common prefixes."""
    if len(text):
        yield from Level(text, cap, store).suffixes()
