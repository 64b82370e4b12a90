"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A word is the sum of two inputs: the mean of learned vectors of its character n-grams (with marks for its beginning and
end), and a learned vector of its own if it is frequent enough among the labelled texts. Both feed a gated recurrent
network in either direction over a window of words; attention pools the states to one vector, and a logistic output
scores the window. Windows overlap by half, every window of the whole text is scored, and a document has the score of
its worst window. A word is what stands between ASCII white space; longer ones enter the windows as overlapping pieces.

Training sees only document labels. All windows of clean documents are clean; of a toxic document, the window that the
network now finds worst is toxic. The network learns from at most `rows` labelled documents outside the held-out fold, of BYTES in all and LONGEST each (documented
bounds).

When scoring, what the two inputs contribute to the gates is worked out once for each distinct word of a batch and
remembered for frequent ones, so that a step of the recurrence is one small matrix product for thousands of windows.

Defined results: null, empty and blank texts score as one window without words; each row is scored for itself; without
labels of both kinds all scores are 0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lingora.llm import stats
from lingora.llm.common import batches, texts

ROWS = 6_000
#: Bytes of text that training reads in all, and of the longest text that it reads.
BYTES, LONGEST = 96 << 20, 1 << 20
WINDOW, STRIDE = 32, 16
GRAMS, SIZE, HIDDEN = 1 << 15, 12, 8
VOCABULARY = 4096
#: The share of words that training hides from a window at random.
DROP = 0.1
#: The share of clean windows that training shows as one of their words over and over, as some junk is written.
REPEAT = 0.08
#: Bytes of a word; text without white space is cut into pieces of so many.
LONG = 64
#: Words whose n-grams are worked out at once: a bound on memory where hardly a word is met twice.
AT_ONCE = 8192
THRESHOLD = 0.5
RESULT = "doc_id long, held_out boolean, score double, predicted int"
_ORDERS = (3, 4, 6)
_EDGES = b" .,;:!?\"'()"


def _f(x) -> np.ndarray:
    return np.asarray(x, np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def words_of(raw: bytes) -> list[bytes]:
    """Words in lower case, without punctuation at their ends; what has nothing else is dropped.

    Of a word over LONG bytes its pieces of LONG bytes are words; they overlap so that each n-gram is whole in one.
    """
    words = [w for w in (x.strip(_EDGES) for x in raw.lower().split()) if w]
    if max(map(len, words), default=0) <= LONG:
        return words
    step = LONG - max(_ORDERS) + 1
    return [w[i : i + LONG] for w in words for i in range(0, max(1, len(w) - max(_ORDERS) + 1), step)]


def gram_ids(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character n-grams of all words in a row, and the word that each belongs to."""
    marked = [b"^" + w + b"$" for w in words]
    text = np.frombuffer(b"".join(marked) + b"\0" * max(_ORDERS), np.uint8).astype(np.uint32)
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    owner = np.repeat(np.arange(len(marked)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(owner))
    ids, owners = [], []
    code = np.zeros(len(owner), np.uint32)
    for k in range(max(_ORDERS)):
        code = code * np.uint32(0x01000193) + text[k : k + len(owner)] + np.uint32(1)
        if k + 1 in _ORDERS:
            fits = left > k
            mixed = code[fits] * np.uint32(0x9E3779B1)
            ids.append((mixed >> np.uint32(17)).astype(np.int64))
            owners.append(owner[fits])
    ids, owners = np.concatenate(ids), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return ids[order], owners[order]


def _summed(index: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of each index below n."""
    out = np.empty((n, rows.shape[1]), np.float32)
    for k in range(rows.shape[1]):
        out[:, k] = np.bincount(index, rows[:, k], n)
    return out


class Network:
    """Parameters by name; all float32."""

    def __init__(self, vocabulary: dict[bytes, int], seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        n = lambda *s, k: _f(rng.standard_normal(s) * k)
        self.vocabulary = vocabulary
        self.p = {"grams": n(GRAMS, SIZE, k=0.3), "words": np.zeros((len(vocabulary) + 1, SIZE), np.float32)}
        for d in ("f", "b"):
            self.p |= {f"w{d}": n(SIZE, 3 * HIDDEN, k=SIZE**-0.5), f"u{d}": n(HIDDEN, 3 * HIDDEN, k=HIDDEN**-0.5), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.p |= {"a": n(2 * HIDDEN, HIDDEN, k=0.3), "v": n(HIDDEN, k=0.3), "o": n(2 * HIDDEN, k=0.3), "z": _f([-1.0])}

    def word_vectors(self, words: list[bytes]) -> np.ndarray:
        ids, owner = gram_ids(words)
        starts = np.searchsorted(owner, np.arange(len(words)))
        total = np.add.reduceat(self.p["grams"][ids], starts, axis=0) if len(ids) else np.zeros((0, SIZE), np.float32)
        total /= np.maximum(np.bincount(owner, minlength=len(words)), 1)[:, None].astype(np.float32)
        own = np.fromiter((self.vocabulary.get(w, -1) for w in words), np.int64, len(words))
        return total + self.p["words"][own]

    def run(self, gates: dict[str, np.ndarray], mask: np.ndarray, keep: bool = False):
        """Scores of windows. gates: what inputs give to the gates, (steps, windows, 3 * HIDDEN) by direction."""
        steps, n = mask.shape
        states, saved = np.zeros((steps, n, 2 * HIDDEN), np.float32), {}
        for at, d in enumerate("fb"):
            u, h = self.p[f"u{d}"], np.zeros((n, HIDDEN), np.float32)
            for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                x, hu, m = gates[d][t], h @ u, mask[t][:, None]
                zr = _sigmoid(x[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                c = np.tanh(x[:, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
                new = (h + z * (c - h)) * m + h * (1 - m)
                if keep:
                    saved[d, t] = h, z, r, c, hu[:, 2 * HIDDEN :]
                h = new
                states[t, :, at * HIDDEN : (at + 1) * HIDDEN] = h
        e = np.tanh(states @ self.p["a"])
        logits = np.where(mask > 0, e @ self.p["v"], -1e9)
        weight = np.exp(logits - logits.max(0))
        weight = weight * mask / np.maximum((weight * mask).sum(0), 1e-9)
        pooled = (states * weight[:, :, None]).sum(0)
        out = pooled @ self.p["o"] + self.p["z"][0]
        return (out, states, saved, e, weight, pooled) if keep else out

    def project(self, vectors: np.ndarray) -> dict[str, np.ndarray]:
        return {d: vectors @ self.p[f"w{d}"] + self.p[f"c{d}"] for d in "fb"}

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, weigh: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
        """By backpropagation: gradients of all parameters but the tables, of the word vectors, and the scores."""
        out, states, saved, e, weight, pooled = self.run(self.project(x), mask, keep=True)
        g = {k: np.zeros_like(v) for k, v in self.p.items() if k not in ("grams", "words")}
        d_out = (_sigmoid(out) - y) * weigh / len(y)
        g["o"], g["z"] = pooled.T @ d_out, _f([d_out.sum()])
        d_pooled = d_out[:, None] * self.p["o"]
        d_weight = (states * d_pooled).sum(2)
        d_states = weight[:, :, None] * d_pooled
        d_logit = weight * (d_weight - (weight * d_weight).sum(0))
        g["v"] = np.einsum("tnh,tn->h", e, d_logit)
        d_e = d_logit[:, :, None] * self.p["v"] * (1 - e * e)
        g["a"] = np.einsum("tns,tnh->sh", states, d_e)
        d_states = d_states + d_e @ self.p["a"].T
        d_x = np.zeros_like(x)
        for at, d in enumerate("fb"):
            w, u = self.p[f"w{d}"], self.p[f"u{d}"]
            carry = np.zeros(pooled[:, :HIDDEN].shape, np.float32)
            for t in range(len(mask) - 1, -1, -1) if d == "f" else range(len(mask)):
                h, z, r, c, hc = saved[d, t]
                m = mask[t][:, None]
                dh = carry + d_states[t, :, at * HIDDEN : (at + 1) * HIDDEN]
                dn = dh * m
                dc = dn * z * (1 - c * c)
                dz = dn * (c - h) * z * (1 - z)
                dr = dc * hc * r * (1 - r)
                d_in = np.concatenate([dz, dr, dc], 1)
                d_hu = np.concatenate([dz, dr, dc * r], 1)
                g[f"u{d}"] += h.T @ d_hu
                g[f"w{d}"] += x[t].T @ d_in
                g[f"c{d}"] += d_in.sum(0)
                d_x[t] += d_in @ w.T
                carry = dh * (1 - m) + dn * (1 - z) + d_hu @ u.T
        return g, d_x, out


def windows_of(n: int) -> list[tuple[int, int]]:
    """(start, stop) of the overlapping windows that cover n words; one, if there are no words."""
    last = max(0, -(-(n - WINDOW) // STRIDE))
    return [(i * STRIDE, min(i * STRIDE + WINDOW, n)) for i in range(last + 1)]


def _layout(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers (0: none) by step and window, and which are words. parts: numbers by document."""
    spans = [(k, a, b) for k, p in enumerate(parts) for a, b in windows_of(len(p))]
    ids = np.zeros((WINDOW, len(spans)), parts[0].dtype if parts else np.int64)
    for j, (k, a, b) in enumerate(spans):
        ids[: b - a, j] = parts[k][a:b]
    return ids, np.fromiter((k for k, _, _ in spans), np.int64, len(spans))


def _begin_with_odds(net: Network, said: list[np.ndarray], y: np.ndarray, vocabulary: np.ndarray, grams: np.ndarray, first: np.ndarray) -> None:
    """Starts the tables of words and n-grams along one direction by how much more often toxic texts have them.

    said: word numbers by text, from 1; vocabulary: by word, its place among the frequent ones or one past these.

    A table of small random vectors would fit each text by the words that it alone has, before the shared ones matter.
    """
    way = _f(np.random.default_rng(9).standard_normal(SIZE))
    way /= np.linalg.norm(way)
    seen = {"words": np.zeros((2, len(net.p["words"]))), "grams": np.zeros((2, GRAMS))}
    for words, kind in zip(said, y):
        own = np.unique(words) - 1
        frequent = vocabulary[own]
        seen["words"][int(kind), frequent[frequent < len(net.vocabulary)]] += 1
        if len(own):
            seen["grams"][int(kind), np.unique(np.concatenate([grams[first[k] : first[k + 1]] for k in own]))] += 1
    texts_by = np.bincount(y.astype(np.int64), minlength=2)
    for name, (clean, toxic) in seen.items():
        odds = np.log((toxic + 1) / (texts_by[1] + 2)) - np.log((clean + 1) / (texts_by[0] + 2))
        sure = (clean + toxic) / (clean + toxic + 6)
        net.p[name] = _f(0.3 * net.p[name] + np.clip(odds * sure, -1, 4)[:, None] * way)
    net.p["words"][-1] = 0


def learn(docs: Iterable[bytes], labels: list[int] | np.ndarray, epochs: int = 7, batch: int = 256, rate: float = 0.02, seed: int = 3) -> Network | None:
    """Fits a network to whole labelled texts; None if they are all of one kind.

    Texts are taken one after another, and only word numbers are kept of them. labels may fill up meanwhile.
    """
    rng = np.random.default_rng(seed)
    index: dict[bytes, int] = {}
    said = [np.array([index.setdefault(w, len(index)) for w in words_of(x)], np.int32) for x in docs]
    y = np.array(labels, np.int64)
    if len(np.unique(y)) < 2:
        return None
    counts = np.zeros(len(index), np.int64)
    for words in said:
        counts[np.unique(words)] += 1
    distinct = sorted(index)
    old = np.fromiter((index[w] for w in distinct), np.int64, len(distinct))
    number = np.empty(len(distinct), np.int32)
    number[old] = np.arange(1, len(distinct) + 1)
    of = dict(zip(distinct, counts[old].tolist()))
    frequent = sorted((w for w in distinct if of[w] >= 5), key=lambda w: (-of[w], w))[:VOCABULARY]
    del index, of, old
    said = [number[words] for words in said]
    net = Network({w: i for i, w in enumerate(frequent)})
    ids, owner = _layout(said)
    grams, sizes = [], [np.zeros(1, np.int64)]
    for i in range(0, len(distinct), AT_ONCE):
        found, whose = gram_ids(distinct[i : i + AT_ONCE])
        grams.append(found.astype(np.int32))
        sizes.append(np.bincount(whose, minlength=len(distinct[i : i + AT_ONCE])))
    grams, first = np.concatenate(grams or [np.zeros(0, np.int32)]), np.cumsum(np.concatenate(sizes))
    vocabulary = np.array([net.vocabulary.get(w, len(frequent)) for w in distinct], np.int64)
    label = y[owner]
    _begin_with_odds(net, said, y, vocabulary, grams, first)
    starts = np.searchsorted(owner, np.arange(len(said)))
    del said, distinct
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0

    def vectors(used: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the words `used` (numbers from 0), with the grams that they are made of."""
        n = first[used + 1] - first[used]
        at = np.repeat(first[used] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        g = grams[at]
        table = np.add.reduceat(net.p["grams"][g], np.r_[0, np.cumsum(n)[:-1]], axis=0) / n[:, None].astype(np.float32)
        net.p["words"][-1] = 0
        return _f(table + net.p["words"][vocabulary[used]]), g, np.repeat(np.arange(len(used)), n), n

    def scored(columns: np.ndarray) -> np.ndarray:
        out = []
        for i in range(0, len(columns), 4096):
            part = ids[:, columns[i : i + 4096]]
            used, back = np.unique(part, return_inverse=True)
            v = np.zeros((len(used), SIZE), np.float32)
            if (used > 0).any():
                v[used > 0] = vectors(used[used > 0] - 1)[0]
            gates = {d: x[back.reshape(part.shape)] for d, x in net.project(v).items()}
            out.append(net.run(gates, _f(part > 0)))
        return np.concatenate(out) if out else np.zeros(0)

    for epoch in range(epochs):
        toxic = np.flatnonzero(label == 1)
        if epoch >= 1 and len(toxic):
            s = np.full(len(label), -np.inf)
            s[toxic] = scored(toxic)
            best = np.maximum.reduceat(s, starts)
            toxic = toxic[s[toxic] >= best[owner[toxic]]]
            toxic = toxic[np.unique(owner[toxic], return_index=True)[1]]
        clean = np.flatnonzero(label == 0)
        if epoch >= 2 and len(clean):  # all of them in time, those that look toxic in every epoch
            s = scored(clean)
            clean = np.union1d(clean[s > -2], rng.choice(clean, min(len(clean), max(2000, 4 * len(toxic))), replace=False))
        else:
            clean = rng.choice(clean, min(len(clean), max(2000, 4 * len(toxic))), replace=False)
        times = max(1, min(8, len(clean) // max(1, 2 * len(toxic))))
        pool = rng.permutation(np.concatenate([np.repeat(toxic, times), clean]))
        for i in range(0, len(pool), batch):
            columns = pool[i : i + batch]
            part = ids[:, columns]
            one = part[rng.integers(0, WINDOW, len(columns)), np.arange(len(columns))]
            again = (label[columns] == 0) & (one > 0) & (rng.random(len(columns)) < REPEAT)
            part = np.where(again & (part > 0), one, part)
            part = np.where(rng.random(part.shape) < DROP, 0, part)
            used, back = np.unique(part, return_inverse=True)
            back = back.reshape(part.shape)
            real = used > 0
            v = np.zeros((len(used), SIZE), np.float32)
            if not real.any():
                continue
            v[real], g, who, n = vectors(used[real] - 1)
            grads, d_x, _ = net.gradients(v[back], _f(part > 0), _f(label[columns]), np.ones(len(columns), np.float32))
            d_v = _summed(back.ravel(), d_x.reshape(-1, SIZE), len(v))[real]
            grads["grams"] = _summed(g, (d_v / n[:, None])[who], GRAMS)
            grads["words"] = _summed(vocabulary[used[real] - 1], d_v, len(net.p["words"]))
            grads["words"][-1] = 0
            step += 1
            for k, w in net.p.items():
                m, s2 = moments[k]
                m += 0.1 * (grads[k] - m)
                s2 += 0.01 * (grads[k] * grads[k] - s2)
                w -= rate * (1 - 0.8 * epoch / epochs) * (m / (1 - 0.9**step)) / (np.sqrt(s2 / (1 - 0.99**step)) + 1e-5)
    net.p["words"][-1] = 0
    return net


class Scorer:
    """Scores whole texts; remembers what frequent words give to the gates."""

    BOUND = 200_000

    def __init__(self, net: Network) -> None:
        self.net = net
        self.known: dict[bytes, int] = {}
        self.table = {d: np.zeros((1, 3 * HIDDEN), np.float32) for d in "fb"}

    def _number(self, said: list[list[bytes]]) -> list[np.ndarray]:
        """Row numbers of words in the table, which gets the words that are new."""
        if len(self.known) > self.BOUND:
            self.known, self.table = {}, {d: t[:1] for d, t in self.table.items()}
        known, fresh = self.known, []
        out = []
        for words in said:
            row = list(map(known.get, words))
            if None in row:
                for i, (w, k) in enumerate(zip(words, row)):
                    if k is None:
                        k = known.get(w)
                        if k is None:
                            k = known[w] = len(known) + 1
                            fresh.append(w)
                        row[i] = k
            out.append(np.array(row, np.int64))
        if fresh:
            new = self.net.project(np.concatenate([self.net.word_vectors(fresh[i : i + AT_ONCE]) for i in range(0, len(fresh), AT_ONCE)]))
            self.table = {d: np.concatenate([t, new[d]]) for d, t in self.table.items()}
        return out

    def score(self, raws: list[bytes]) -> np.ndarray:
        ids, owner = _layout(self._number([words_of(x) for x in raws]))
        best = np.full(len(raws), -np.inf)
        for i in range(0, ids.shape[1], 4096):
            part = ids[:, i : i + 4096]
            out = self.net.run({d: t[part] for d, t in self.table.items()}, _f(part > 0))
            np.maximum.at(best, owner[i : i + 4096], out)
        return _sigmoid(best)


def train(docs: DataFrame, labels: DataFrame, rows: int = ROWS, size: int = BYTES) -> Network | None:
    """A network from a bounded sample of labelled whole texts, half of it toxic at most; None without both kinds.

    The sample reaches the driver a sorted partition at a time and ends at `rows` texts or `size` bytes; of each text only
    word numbers are kept. Texts over LONGEST bytes are not learned from.
    """
    toxic = stats.labelled_sample(labels, "toxic", rows // 3, 1)
    clean = stats.labelled_sample(labels, "toxic", rows - rows // 3, 0)
    raw = F.coalesce(F.encode("text", "UTF-8"), F.lit(b"")).alias("raw")
    picked = stats.sampled(docs, toxic.unionByName(clean)).select("y", raw, "doc_id").where(F.length("raw") <= LONGEST)
    y: list[int] = []

    def streamed() -> Iterator[bytes]:
        left = size
        for r in picked.orderBy(F.xxhash64("doc_id"), "doc_id", "y", "raw").toLocalIterator():
            left -= len(r.raw)
            if left < 0 or len(y) == rows:
                return
            y.append(r.y)
            yield bytes(r.raw)

    return learn(streamed(), y)


def score(docs: DataFrame, net: Network | None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value) if sent.value else None
        for batch in batches(it, 3 << 20):
            s = scorer.score(batch.column(1).to_pylist()) if scorer else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s.astype(np.float64))], ["doc_id", "score"])

    fold = F.coalesce(stats.held_out(), F.lit(False))
    scored = texts(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", fold.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
