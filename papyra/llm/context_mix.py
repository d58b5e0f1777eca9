"""LM scoring by logistic context mixing.

A text is its tokens, each spelled byte by byte, closed by a space, and bit by bit within a byte; the end of the text is a
byte of its own. Each bit is predicted from several contexts, which have counts of 0 and 1 for the bits so far, and these give log
odds; a gate (how much a context has seen, and where in the token the bit is) picks the weights by which the log odds are added; the
sum is squashed to a probability and refined by an adaptive map from (gate, sum) to what came true. There are three kinds of bits.

* Within a token, behind its first byte: from the last 1, 2, 3, 4 and 6 bytes of the token, hashed, and from all of it, unhashed, over
  all documents and over those of one class.
* A token's first byte: from the class, and from the token before, hashed.
* At every place with ``DEPTH`` tokens of its text before it: is the token the one that most often followed these tokens? If it is,
  its bytes cost nothing more. A training document isn't evidence for itself: its own occurrence is taken off the counts.

A document's class (by default its language; of the training documents only) is gated too: each class predicts the whole text, and
each next token's prediction is their mean weighted by how well they did so far, which comes to the mean of the products.

Learning goes over the training documents. Words are counted, by class; so are first bytes by the token before, and which token
follows which ``DEPTH``. All folds but one fill the contexts for learning, and all folds those that score, in one pass: the hashed
ones are tables of fixed size that tasks fill and Spark adds up; the whole beginnings need no table, as words are dealt to tasks in
sorted ranges (ranges of distinct words, so that no beginning makes one hot), and what is cut by a range's bounds (the edges behind
beginnings that its first or last word has in common with its neighbours) is exchanged by a join. Over the fold that is left each task
learns the weights online, by Newton steps over small blocks, and counts for the adaptive map each prediction before it learns
from it; tasks' weights are averaged by what they saw, their maps added. Words with the same spelling have the same bits, so each
distinct word is scored once, bits of a common beginning too.

A document's sums need each word's count and scores. The ``HEAD`` most frequent words go to every task (a bounded table); the
others are joined by word, and no word among them is frequent enough to be a hot key. What follows what is joined by the hash of the
tokens before, where a Bloom filter (bounded too) lets a place pass.

Edges: a null or empty text has one token, its end; rows with a null id are training rows; a null class is the class of all
that are not among the ``CLASSES`` largest; rows with the same id and text each get their row; without training documents N is
0 and every bit costs about one bit.
"""

from __future__ import annotations

import itertools
import math
import operator
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyra.llm.ngram_join import _bloom, _holds
from papyra.llm.shared import alike, once, release, small_batches, table, written

FOLDS, HEAD, SMOOTH, CLASSES = 10, 300_000, 0.1, 4
#: Bytes of hashed context and the binary logarithm of the table's size, for each order.
ORDERS = ((1, 16), (2, 18), (3, 20), (4, 20), (6, 21))
INPUTS = len(ORDERS) + 2
EASE, PRIOR, SHARD = 0.4, 300.0, 1 << 16
END, CLOSE = b"\n", b" "
#: Tokens that predict the next one; buckets of a token that predicts the next one's first byte; places passed on at once.
DEPTH, BUCKETS, WINDOW, PASSED = 4, 1 << 12, 1_000_000, 100_000
FIRSTS = BUCKETS * 256
FLUSH, RANGE = 600_000, 60_000  # distinct words that a task counts before it passes them on; that a range of words has
#: Bytes of the words of a range, where its words are long: some hundred MB while it is worked on.
EDGES = 600_000
_B = np.uint64(0x9E3779B97F4A7C15)
_B_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: How much the longest context has seen: bounds of its count, each with or without both bits seen.
SEEN = np.array([0.5, 1.5, 3.5, 10.5, 50.5, 300.5, 3000.5])
PLACES, PHASES, CELLS = 3, 3, 97
PHASE = (0, 1, 1, 1, 2, 2, 2, 2)
GATES = PLACES * PHASES * 2 * (len(SEEN) + 1)
#: The part of the map in the refined probability: a context that has seen much is right as it is.
DOUBT = np.repeat(0.5 - 0.5 * np.arange(len(SEEN) + 1) / len(SEEN), GATES // (len(SEEN) + 1))


def fold_of(doc_id: int | None) -> int:
    """0: held out."""
    return 1 if doc_id is None else zlib.crc32(str(doc_id).encode()) % FOLDS


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Bits:
    """The bits of some words: an edge is a byte after a beginning, shared by all words that begin so."""

    def __init__(self, words: list[bytes], counts: np.ndarray | None = None, shared: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> None:
        """counts: words x classes, what fills the contexts; shared: beginnings (hashes), next bytes and such counts of the
        edges that words of other ranges may have as well."""
        spelled = [w if w == END else w + CLOSE for w in words]
        x = np.frombuffer(b"".join(spelled), dtype=np.uint8)
        size = np.array([len(s) for s in spelled], dtype=np.int64)
        starts = np.concatenate(([0], np.cumsum(size)))[:-1]
        self.owner = np.repeat(np.arange(len(words)), size)
        self.begins = starts
        start = starts[self.owner]
        at = np.arange(len(x))
        power = np.concatenate(([np.uint64(1)], np.cumprod(np.full(max(len(x), 1), _B, dtype=np.uint64))))
        back = np.concatenate(([np.uint64(1)], np.cumprod(np.full(max(len(x), 1), _B_INVERSE, dtype=np.uint64))))
        sums = np.concatenate(([np.uint64(0)], np.cumsum((x.astype(np.uint64) + np.uint64(1)) * power[: len(x)])))
        piece = lambda i, j: (sums[j] - sums[i]) * back[i]  # noqa: E731  hash of x[i:j]
        _, first, self.edge = np.unique(_mixed(piece(start, at + 1)) + (at - start).astype(np.uint64), return_index=True, return_inverse=True)
        at, start = at[first], start[first]
        self.byte = x[first].astype(np.int64)
        self.place = np.minimum((at - start + 1) // 2, PLACES - 1)
        begin_hash = lambda begin: _mixed(piece(begin, at) * _B + (at - begin).astype(np.uint64))
        self.contexts = [begin_hash(np.maximum(start, at - k)) for k, _ in ORDERS]
        self.whole = begin_hash(start)
        if counts is not None:
            self._fill(self.spread(counts), shared)

    def _fill(self, filled: np.ndarray, shared: tuple[np.ndarray, np.ndarray, np.ndarray] | None) -> None:
        whole, byte = self.whole, self.byte
        if shared is not None and len(shared[0]):
            begin, extra, counts = shared
            here = np.flatnonzero(np.isin(whole, begin))
            local = {k: i for k, i in zip(zip(whole[here].tolist(), byte[here].tolist()), here.tolist())}
            at = np.array([local.get(k, -1) for k in zip(begin.tolist(), extra.tolist())])
            filled[at[at >= 0]] = counts[at >= 0]
            whole, byte = np.concatenate((whole, begin[at < 0])), np.concatenate((byte, extra[at < 0]))
            filled = np.concatenate((filled, counts[at < 0]))
        order = np.lexsort((byte, whole))
        w = np.ascontiguousarray(np.concatenate((filled.sum(axis=1, keepdims=True), filled), axis=1)[order].T)  # class 0: all
        sorted_byte = byte[order]
        apart = np.concatenate(([True], whole[order][1:] != whole[order][:-1])) if len(order) else np.zeros(0, dtype=bool)
        back = np.empty(len(order), dtype=np.int64)
        back[order] = np.arange(len(order))
        back = back[: len(self)]
        self.exact = np.empty((8, w.shape[0], len(self)), dtype=np.float32)
        self.level = np.empty((8, w.shape[0], len(self)), dtype=np.int8)
        for b in range(8 if len(order) else 0):
            node = sorted_byte >> (8 - b)
            new = apart.copy()
            new[1:] |= node[1:] != node[:-1]
            at_ = (np.cumsum(new) - 1)[back]
            heads = np.flatnonzero(new)
            all_ = np.add.reduceat(w, heads, axis=1)
            ones = np.add.reduceat(w * ((sorted_byte >> (7 - b)) & 1), heads, axis=1)
            np.take((np.log(ones + EASE) - np.log(all_ - ones + EASE)).astype(np.float32), at_, axis=1, out=self.exact[b])
            level = ((ones > 0) & (ones < all_)).astype(np.int8)
            for bound in SEEN.tolist():
                level += np.int8(2) * (all_ > bound)
            np.take(level, at_, axis=1, out=self.level[b])

    def __len__(self) -> int:
        return len(self.byte)

    def bit(self, b: int, some: slice | np.ndarray = slice(None)) -> np.ndarray:
        return (self.byte[some] >> (7 - b)) & 1

    def slots(self, order: int, b: int, some: slice | np.ndarray = slice(None)) -> np.ndarray:
        node = ((1 << b) | (self.byte[some] >> (8 - b))).astype(np.uint64)
        return (_mixed(self.contexts[order][some] + node * np.uint64(0xA0761D6478BD642F)) >> np.uint64(64 - ORDERS[order][1])).astype(np.int64)

    def spread(self, counts: np.ndarray) -> np.ndarray:
        """Words' counts (words x classes), added up by edge."""
        return np.stack([np.bincount(self.edge, weights=counts[self.owner, g].astype(float), minlength=len(self)) for g in range(counts.shape[1])], axis=1)

    def gathered(self, values: np.ndarray, words: int) -> np.ndarray:
        """Edges' values, added up by word."""
        return np.bincount(self.owner, weights=values[self.edge], minlength=words)


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x, y = np.frombuffer(a, dtype=np.uint8, count=n), np.frombuffer(b, dtype=np.uint8, count=n)
    return int(np.flatnonzero(x != y)[0])


def open_beginnings(bits: Bits, words: list[bytes], before: int, behind: int) -> np.ndarray:
    """Hashes of the beginnings that the first of the sorted words has in common with the range before (its ``before`` first
    bytes), and the last with the range behind."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    sizes = [len(w) + (w != END) for w in words]
    first = bits.edge[: min(before + 1, sizes[0])]
    last = bits.edge[len(bits.edge) - sizes[-1] :][: min(behind + 1, sizes[-1])]
    return np.unique(bits.whole[np.concatenate((first, last))])


class Model:
    def __init__(self, tables: list[np.ndarray], weights: np.ndarray, hits: np.ndarray, seen: np.ndarray) -> None:
        """tables: log odds of each order in 1/1000; hits, seen: the adaptive map's ones and all, by gate and cell."""
        self.tables, self.weights, self.hits, self.seen = tables, weights, hits, seen

    @classmethod
    def blank(cls, tables: list[np.ndarray]) -> Model:
        trust = np.repeat(np.arange(len(SEEN) + 1) / len(SEEN), GATES // (len(SEEN) + 1))[:, None]  # of what has seen much
        start = np.concatenate((np.repeat((1 - trust) * 0.1, len(ORDERS), axis=1), (1 - trust) * 0.5, trust), axis=1)
        return cls(tables, start, np.zeros((GATES, CELLS)), np.zeros((GATES, CELLS)))

    def inputs(self, bits: Bits, b: int, some: slice | np.ndarray = slice(None)) -> np.ndarray:
        """Log odds of the hashed contexts and of the whole beginning over all documents; the class's place is left open."""
        x = [t[bits.slots(k, b, some)] * np.float32(0.001) for k, t in enumerate(self.tables)]
        whole = bits.exact[b][0][some]
        return np.stack([*x, whole, whole], axis=1)

    def gate(self, bits: Bits, b: int, g: int, some: slice | np.ndarray = slice(None)) -> np.ndarray:
        return (bits.level[b][g][some].astype(np.int64) * PLACES + bits.place[some]) * PHASES + PHASE[b]

    def predict(self, x: np.ndarray, gate: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The mixed and the refined probability of a 1, and the map's cell."""
        z = np.clip(np.einsum("ij,ij->i", x, self.weights[gate]), -14, 14)
        p = 1 / (1 + np.exp(-z))
        cell = np.rint(np.clip(z, -12, 12) * 4).astype(np.int64) + 48
        refined = (self.hits[gate, cell] + 20 * p) / (self.seen[gate, cell] + 20)
        return p, np.clip(p + DOUBT[gate] * (refined - p), 1e-6, 1 - 1e-6), cell

    def learn(self, bits: Bits, counts: np.ndarray, curve: np.ndarray, block: int = 8192) -> None:
        """Online over the edges; counts: how often each came up in each class; curve: of each gate, what it has met so far."""
        order = np.flatnonzero(counts.any(axis=1))
        order = order[np.argsort(_mixed(bits.whole[order] + bits.byte[order].astype(np.uint64)))]  # in no particular order
        for i in range(0, len(order), block):
            some = order[i : i + block]
            for b in range(8):
                x, y = self.inputs(bits, b, some), bits.bit(b, some)
                for g in range(counts.shape[1]):
                    if not (on := np.flatnonzero(counts[some, g])).size:
                        continue
                    z = x[on]
                    z[:, -1] = bits.exact[b][g + 1][some[on]]
                    self._learn(z, self.gate(bits, b, g + 1, some[on]), y[on], counts[some[on], g], curve)

    def _learn(self, x: np.ndarray, gate: np.ndarray, y: np.ndarray, w: np.ndarray, curve: np.ndarray) -> None:
        p, _, cell = self.predict(x, gate)
        flat = gate * CELLS + cell
        self.hits += np.bincount(flat, weights=w * y, minlength=GATES * CELLS).reshape(GATES, CELLS)
        self.seen += np.bincount(flat, weights=w, minlength=GATES * CELLS).reshape(GATES, CELLS)
        for g in np.unique(gate).tolist():
            m = gate == g
            z, v = x[m], w[m]
            curve[g] += (z * (v * np.maximum(p[m] * (1 - p[m]), 0.02))[:, None]).T @ z
            self.weights[g] += np.linalg.solve(curve[g], z.T @ (v * (y[m] - p[m])))

    def cost(self, bits: Bits, words: int, *, first: bool = True, block: int = 1 << 14) -> np.ndarray:
        """log10 of each word's probability (words x classes), class 0 first: all documents; without ``first``, of all behind
        its first byte."""
        classes = bits.exact.shape[1]
        log = np.zeros((classes, len(bits)))
        # The refined probability, as predict has it, is linear in the mixed one: one table for its rise, one for its start.
        rise = (1 + DOUBT[:, None] * (20 / (self.seen + 20) - 1)).astype(np.float32).ravel()
        start = (DOUBT[:, None] * self.hits / (self.seen + 20)).astype(np.float32).ravel()
        weights = self.weights.astype(np.float32)
        for i in range(0, len(bits), block):
            some = slice(i, i + block)
            for b in range(8):
                x, y = self.inputs(bits, b, some), bits.bit(b, some) == 1
                for g in range(classes):
                    x[:, -1] = bits.exact[b][g][some]
                    gate = self.gate(bits, b, g, some)
                    z = np.einsum("ij,ij->i", x, weights[gate])
                    np.clip(z, -14, 14, out=z)
                    cell = gate * CELLS + np.rint(np.clip(z, -12, 12) * 4).astype(np.int64) + 48
                    p = start[cell] + rise[cell] / (1 + np.exp(-z))
                    log[g, some] += np.log10(np.clip(np.where(y, p, 1 - p), 1e-6, 1 - 1e-6))
        whole = np.stack([bits.gathered(log[g], words) for g in range(classes)], axis=1)
        return whole if first or not words else whole - log[:, bits.edge[bits.begins]].T


def nodes_of(counts: np.ndarray) -> list[np.ndarray]:
    """(..., 256) counts of bytes -> for each bit, counts of 0 and 1 after the bits before: (..., 2 ** b, 2)."""
    return [counts.reshape(*counts.shape[:-1], 1 << b, 2, 128 >> b).sum(axis=-1) for b in range(8)]


def _odds(n: np.ndarray) -> np.ndarray:
    return np.log((n[..., 1] + EASE) / (n[..., 0] + EASE))


class Openings:
    """The first bytes of tokens, by class and by the bucket of the token before. weights: by gate (how much a bucket has seen at
    the bit), of what it says beyond all documents."""

    def __init__(self) -> None:
        self.weights = np.linspace(0.2, 1.0, 2 * (len(SEEN) + 1))
        self.curve = np.full(len(self.weights), PRIOR)

    @staticmethod
    def gate(n: np.ndarray) -> np.ndarray:
        return np.searchsorted(SEEN, n.sum(axis=-1)) * 2 + (n.min(axis=-1) > 0)

    def learn(self, all_: np.ndarray, pairs: np.ndarray, new: np.ndarray, block: int = 64) -> Openings:
        """Online, by blocks of buckets: all_ (256) and pairs (buckets x 256) fill the contexts, new (the same) comes up."""
        for i in range(0, len(pairs), block):
            for a, n, v in zip(nodes_of(all_), nodes_of(pairs[i : i + block]), nodes_of(new[i : i + block])):
                z, g, w = _odds(a)[None, :], self.gate(n), v.sum(axis=-1)
                x = np.where(n.sum(axis=-1) > 0, _odds(n) - z, 0.0)
                p = 1 / (1 + np.exp(-(z + self.weights[g] * x)))
                up = np.bincount(g.ravel(), weights=(x * (v[..., 1] - w * p)).ravel(), minlength=len(self.weights))
                self.curve += np.bincount(g.ravel(), weights=(x * x * w * np.maximum(p * (1 - p), 0.02)).ravel(), minlength=len(self.weights))
                self.weights += up / self.curve
        return self

    def costs(self, by_class: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        """log10 of each first byte's probability after each bucket: (buckets * 256) x classes, class 0 being all documents."""
        out = np.zeros((len(pairs), 256, len(by_class)), dtype=np.float32)
        byte = np.arange(256)
        for b, (c, n) in enumerate(zip(nodes_of(by_class), nodes_of(pairs))):
            z, g = _odds(c), self.gate(n)
            x = np.where(n.sum(axis=-1) > 0, self.weights[g] * (_odds(n) - z[0]), 0.0)
            for k in range(len(by_class)):
                p = np.clip(1 / (1 + np.exp(-(z[k] + x))), 1e-6, 1 - 1e-6)
                both = np.log10(np.stack((1 - p, p), axis=-1)).astype(np.float32)
                out[:, :, k] += both.reshape(len(pairs), -1)[:, byte >> (7 - b)]
        return out.reshape(-1, len(by_class))


def checks_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), dtype=np.int64, count=len(words))


_FIRST = operator.itemgetter(0)


def firsts_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_FIRST, words), dtype=np.int64, count=len(words))


def first_cells(first: np.ndarray, check: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each token the cell of (bucket of the token before, first byte); before a text stands its end."""
    before = np.empty(len(check), dtype=np.int64)
    before[1:] = check[:-1]
    before[starts] = zlib.crc32(END)
    return (before >> 20) * 256 + first


def preceded(check: np.ndarray, starts: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places with ``DEPTH`` tokens of their text before them, and the hash of these (48 bits, above all buckets)."""
    c = check.astype(np.uint64)
    h = np.zeros(max(0, len(c) - DEPTH), dtype=np.uint64)
    for k in range(DEPTH):
        h = h * _B + c[k : k + len(h)] + np.uint64(1)
    h = _mixed(h)
    at = np.flatnonzero(np.arange(len(c)) - np.repeat(starts, count) >= DEPTH)
    return at, ((h[at - DEPTH] >> np.uint64(17)) | np.uint64(1 << 47)).astype(np.int64)


def tokens_of(texts: list[str | None]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """All tokens in a row, where each text's begin, and how many it has."""
    words = [[*words_of(t), END] for t in texts]
    count = np.array([len(w) for w in words], dtype=np.int64)
    return list(itertools.chain.from_iterable(words)), np.cumsum(count) - count, count


FOLLOWS = "ctx long, nx long, n long, total long, learnt long, of long, hits long, trials long"
#: Tokens whose contexts one task brings together.
MET = 2_000_000


def grouped(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by keys, the first one first, and where in it each group of equal ones begins."""
    order = np.lexsort(keys[::-1])
    apart = np.zeros(len(order), dtype=bool)
    apart[:1] = True
    for k in keys:
        apart[1:] |= k[order][1:] != k[order][:-1]
    return order, np.flatnonzero(apart)


def following(ctx: np.ndarray, nx: np.ndarray, kind: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """What is told of each context, see ``followers``: n times (ctx, nx) in documents that are held out, fill or are left (kind)."""
    order, new = grouped(ctx)
    if not len(order):
        return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 8, names=[c.split()[0] for c in FOLLOWS.split(", ")])
    add = lambda x, order, new: np.add.reduceat(x[order], new)
    trained, held = (add(np.where((kind > 0) == t, n, 0), order, new) for t in (True, False))
    tells = (ctx[order][new] < FIRSTS) | (trained >= 2) | ((trained >= 1) & (held >= 1))
    some = order[np.repeat(tells, np.diff(np.append(new, len(order))))]
    ctx, nx, kind, n = ctx[some], nx[some], kind[some], n[some]
    order, new = grouped(ctx, nx)
    f, l = (add(np.where(kind == k, n, 0), order, new) if len(new) else np.zeros(0, dtype=np.int64) for k in (1, 2))  # noqa: E741
    ctx, nx = ctx[order][new], nx[order][new]
    by, new = grouped(ctx)
    last = np.append(new, len(ctx))[1:] - 1
    sums = lambda x: add(x, by, new) if len(new) else np.zeros(0, dtype=np.int64)
    top, best = np.lexsort((nx, f + l, ctx))[last], np.lexsort((nx, f, ctx))[last]
    columns = [ctx[top], nx[top], (f + l)[top], sums(f + l), f[best], sums(f), l[best], sums(l)]
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=[c.split()[0] for c in FOLLOWS.split(", ")])


def followers(docs: DataFrame, key: str, text: str, parts: int = 1) -> DataFrame:
    """(ctx, nx, n, total, learnt, of, hits, trials): for each hash of tokens the one that follows most often (as its check),
    how often, and of how many; what the learning folds say and how that fares in the fold that is left; only where there can be
    something to predict. A cell of ``first_cells`` (ctx below FIRSTS) has its counts in the learning folds and in the one left as
    ``of`` and ``trials``. Contexts are brought together in so many parts, each a task's; they go there packed, as most come up
    once only: 6 bytes of context in order, 4 of what follows, 4 of a count that is nearly always 1."""
    schema = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("high", pa.binary()), ("low", pa.binary()), ("nx", pa.binary()), ("n", pa.binary())])

    def packed(ctx: np.ndarray, nx: np.ndarray, kind: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        part = ctx % parts
        order, new = grouped(part, kind, ctx)
        _, new = grouped(part[order], kind[order])
        rows = [(int(part[order[i]]), int(kind[order[i]]), order[i:j]) for i, j in zip(new.tolist(), [*new.tolist()[1:], len(order)])]
        raw = lambda x, as_: [x[o].astype(as_).tobytes() for _, _, o in rows]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), *(pa.array(x, pa.binary()) for x in (raw(ctx >> 32, "<u2"), raw(ctx & 0xFFFFFFFF, "<u4"), raw(nx, "<u4"), raw(n, "<u4")))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, met = np.zeros((2, FIRSTS), dtype=np.int64), [[], []]
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def added() -> pa.RecordBatch:
            ctx, nx, kind = (np.concatenate(x) for x in zip(*held))
            order, new = grouped(ctx, nx, kind)
            held.clear()
            return packed(ctx[order][new], nx[order][new], kind[order][new], np.diff(np.append(new, len(order))))

        for b in batches:
            for i in range(0, b.num_rows, 200):
                keys, texts = b.column(0)[i : i + 200].to_pylist(), b.column(1)[i : i + 200].to_pylist()
                words, starts, count = tokens_of(texts)
                check = checks_of(words)
                fold = np.array([fold_of(k) for k in keys])
                kind = np.repeat(np.where(fold == 0, 0, np.where(fold == FOLDS - 1, 2, 1)), count)  # held out, fills, is left
                cell = first_cells(firsts_of(words), check, starts)
                for k, m in enumerate(met, 1):
                    m.append(cell[kind == k])
                    if sum(map(len, m)) > WINDOW:
                        cells[k - 1] += np.bincount(np.concatenate(m), minlength=FIRSTS)
                        m.clear()
                at, ctx = preceded(check, starts, count)
                held.append((ctx, check[at], kind[at]))
                if sum(len(h[0]) for h in held) > WINDOW:
                    yield added()
        if any(len(h[0]) for h in held):
            yield added()
        for k, m in enumerate(met):
            if m:
                cells[k] += np.bincount(np.concatenate(m), minlength=FIRSTS)
        for k, c in enumerate(cells, 1):
            some = np.flatnonzero(c)
            yield packed(some, np.zeros(len(some), dtype=np.int64), np.full(len(some), k), c[some])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[list[np.ndarray]] = [[], [], [], []]
        for b in batches:
            kinds, high, low, nx, n = (b.column(c).to_pylist() for c in ("kind", "high", "low", "nx", "n"))
            for k, h, w, x, c in zip(kinds, high, low, nx, n):
                of = [np.frombuffer(h, "<u2").astype(np.int64) << 32 | np.frombuffer(w, "<u4"), np.frombuffer(x, "<u4"), np.full(len(h) // 2, k, dtype=np.int8), np.frombuffer(c, "<u4")]
                for g, v in zip(got, of):
                    g.append(v)
        if got[0]:
            found = following(*(np.concatenate(g).astype(t) for g, t in zip(got, (np.int64, np.int64, np.int8, np.int64))))
            for i in range(0, found.num_rows, PASSED):
                yield found.slice(i, PASSED)

    sent = docs.select(F.col(key), F.col(text)).mapInArrow(run, "part int, kind int, high binary, low binary, nx binary, n binary")
    return sent.repartitionById(parts, "part").mapInArrow(merge, FOLLOWS)


#: Gates of what follows: how often it did, and in how many of a hundred times.
OFTEN, SURE = (2, 3, 5, 10, 100), (50, 95)
FOLLOW_GATES = (len(OFTEN) + 1) * (len(SURE) + 1)


def follow_gate(n: Column, total: Column) -> Column:
    steps = lambda x, bounds: sum(((x >= b).cast("int") for b in bounds), F.lit(0))
    return steps(n, OFTEN) * (len(SURE) + 1) + steps(n * 100 / total, SURE)


#: Of the contexts that come up most, more often than so, at most so many are known to every task; places behind others ask for theirs.
HOT_LEAST, HOT = 1000, 100_000
ASKS = "part int, high binary, low binary, code binary, token binary, ks binary, hs binary, count binary, own binary, words binary"


def asks_of(part: np.ndarray, ctx: np.ndarray, number: np.ndarray, cell: np.ndarray, doc: np.ndarray, rare: list[bytes], docs: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[dict]:
    """Places, in the order of documents, as one row of ``ASKS`` for each part: 6 bytes of context, 6 of the token (its number
    among the head's, or none, and its cell of ``first_cells``), and the documents (key, hash, own) with how many places each has.
    rare: the words of tokens without a number."""
    order, rows = np.argsort(part, kind="stable"), []
    nth = np.cumsum(number < 0) - 1
    cuts = np.flatnonzero(np.diff(part[order], prepend=-1, append=1 << 40)).tolist()
    for i, j in zip(cuts, cuts[1:]):
        some = order[i:j]
        of, count = np.unique(doc[some], return_counts=True)
        token = (number[some] + 1) << 20 | cell[some]
        raw = {"high": (ctx[some] >> 32, "<u2"), "low": (ctx[some] & 0xFFFFFFFF, "<u4"), "code": (token >> 32, "<u2"), "token": (token & 0xFFFFFFFF, "<u4"), "ks": (docs[0][of], "<i8"), "hs": (docs[1][of], "<i8"), "own": (docs[2][of], "u1"), "count": (count, "<u4")}
        words = b" ".join(rare[k] for k in nth[some[number[some] < 0]].tolist())
        rows.append({"part": int(part[some[0]]), **{c: x.astype(t).tobytes() for c, (x, t) in raw.items()}, "words": words})
    return rows


def asked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ctx, number, cell, doc, rare, docs) of a row of ``asks_of``."""
    x = {c: np.frombuffer(row[c], t).astype(np.int64) for c, t in (("high", "<u2"), ("low", "<u4"), ("code", "<u2"), ("token", "<u4"), ("ks", "<i8"), ("hs", "<i8"), ("own", "u1"), ("count", "<u4"))}
    token = x["code"] << 32 | x["token"]
    number = (token >> 20) - 1
    rare = row["words"].split(b" ") if (number < 0).any() else []
    return x["high"] << 32 | x["low"], number, token & 0xFFFFF, np.repeat(np.arange(len(x["count"])), x["count"]), rare, (x["ks"], x["hs"], x["own"])


class Answers:
    """What follows some contexts, sorted: ctx, nx, n, total. What it comes to where a token is what followed, or isn't."""

    def __init__(self, found: pa.Table, chance: list[float], value: np.ndarray, opens: np.ndarray, check_of_head: np.ndarray) -> None:
        order = np.argsort(np.asarray(found["ctx"]))
        self.ctx, self.nx, self.n, self.total = (np.asarray(found[c])[order] for c in ("ctx", "nx", "n", "total"))
        self.chance, self.value, self.opens, self.check_of_head = np.array(chance), value, opens, check_of_head

    def has(self, ctx: np.ndarray) -> np.ndarray:
        if not len(self.ctx):
            return np.zeros(len(ctx), dtype=bool)
        return self.ctx[np.minimum(np.searchsorted(self.ctx, ctx), len(self.ctx) - 1)] == ctx

    def told(self, ctx: np.ndarray, number: np.ndarray, cell: np.ndarray, doc: np.ndarray, rare: list[bytes], docs: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
        """(k, h, word, s0.., extra): for each document what its predicted tokens no longer cost by class (less than 0 comes off) and what the
        predictions cost, and a row for each rare word that was predicted, whose cost is not known here. A training document's own
        occurrence is no evidence."""
        nth, here = np.cumsum(number < 0) - 1, np.flatnonzero(self.has(ctx))
        at = np.searchsorted(self.ctx, ctx[here])
        number, doc, nth = number[here], doc[here], nth[here]
        mine = self.check_of_head[number]
        odd = number < 0
        mine[odd] = checks_of([rare[k] for k in nth[odd].tolist()])
        own, same = (docs[2][doc] > 0).astype(np.int64), self.nx[at] == mine
        others, of = self.n[at] - np.where(same, own, 0), self.total[at] - own
        came, some = same & (others >= 1), np.flatnonzero(of >= 1)
        gate = np.searchsorted(OFTEN, np.maximum(others, 1), side="right") * (len(SURE) + 1) + np.searchsorted(SURE, np.maximum(others, 1) * 100 / np.maximum(of, 1), side="right")
        p = self.chance[gate]
        extra = np.log10(np.where(came, p, 1 - p))
        on = some[came[some]]
        cost = self.value[number[on], 1:].astype(np.float64) + self.opens[cell[here[on]]]
        met = np.unique(doc[some])
        sums = [-np.bincount(doc[on], weights=c, minlength=len(docs[0]))[met] for c in cost.T]
        words = on[odd[on]]
        which = np.concatenate((met, doc[words]))
        of_word = pa.array([None] * len(met) + [rare[k] for k in nth[words].tolist()], pa.binary()).cast(pa.string())
        pad = lambda x: pa.array(np.concatenate((x, np.zeros(len(words)))))
        every = [*sums, np.bincount(doc[some], weights=extra[some], minlength=len(docs[0]))[met]]
        names = [*(f"s{i}" for i in range(cost.shape[1])), "extra"]
        return pa.RecordBatch.from_arrays([pa.array(docs[0][which], mask=docs[2][which] == 2), pa.array(docs[1][which]), of_word, *map(pad, every)], names=["k", "h", "word", *names])


def classes_of(docs: DataFrame, key: str, by: str | None, most: int = CLASSES) -> tuple[dict[str, int], int]:
    """The largest classes among the training documents, numbered from 0, and the number of classes: all other documents, if
    there are any, share one more."""
    if by is None:
        return {}, 1
    training = docs.filter(F.coalesce(F.crc32(F.col(key).cast("string")) % FOLDS != 0, F.lit(True)))
    sizes = written(training.groupBy(F.col(by).cast("string").alias("c")).count(), "lm-classes")
    top = sizes.filter("c is not null").orderBy(F.desc("count"), "c").limit(most).collect()
    number = {r.c: i for i, r in enumerate(top)}
    return number, len(number) + int(not number or sizes.count() > len(number))


def vocabulary(docs: DataFrame, number: dict[str, int], classes: int, *, key: str = "doc_id", text: str = "text", by: str | None = None) -> DataFrame:
    """(word, f, l): all distinct words, with their training counts by class, in the folds that fill and in the one left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [Counter() for _ in range(2 * classes + 1)]  # the last: held out

        def flush() -> Iterator[pa.RecordBatch]:
            for i, c in enumerate(counts):
                if c:
                    n = pa.array(c.values(), pa.int64()) if i < 2 * classes else pa.array(np.zeros(len(c), dtype=np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(c.keys(), pa.binary()).cast(pa.string()), pa.array(np.full(len(c), i, dtype=np.int32)), n], ["word", "place", "n"])
                c.clear()

        for b in batches:
            for k, t, c in zip(*(v.to_pylist() for v in b.columns)):
                f = fold_of(k)
                at = counts[-1 if f == 0 else number.get(c, classes - 1) + classes * (f == FOLDS - 1)]
                at.update(words_of(t))
                at[END] += 1
                if sum(map(len, counts)) > FLUSH:
                    yield from flush()
        yield from flush()

    c = F.col(by).cast("string") if by else F.lit(None).cast("string")
    parts = docs.select(F.col(key), F.col(text), c.alias("c")).mapInArrow(run, "word string, place int, n long")
    sums = [F.sum(F.when(F.col("place") == i, F.col("n")).otherwise(F.lit(0))).alias(f"n{i}") for i in range(2 * classes)]
    words = parts.groupBy("word").agg(*sums)
    return words.select("word", F.array(*(f"n{i}" for i in range(classes))).alias("f"), F.array(*(f"n{i}" for i in range(classes, 2 * classes))).alias("l"))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), len(flat) // max(1, len(column)))


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def _bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    return [w.encode() for w in column.to_pylist()]


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one range of words at a time; they come sorted."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        part = np.asarray(b.column(0))
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]
        for i, j in zip(cuts, cuts[1:]):
            if i == j:
                continue
            if held and held[-1].column(0)[0].as_py() != part[i]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held)


def _dealt(words: DataFrame, count: int, shared: DataFrame | None = None) -> DataFrame:
    """words with ``part``, each part's rows together and sorted; the edges it shares with others come first, without a word."""
    empty = [F.lit(None).cast("long").alias("begin"), F.lit(None).cast("long").alias("byte")]
    rows = words.select("part", "word", "f", "l", *(["before", "behind"] if shared is None else empty))
    if shared is not None:
        rows = rows.unionByName(shared.select("part", F.lit(None).cast("string").alias("word"), "f", "l", "begin", "byte"))
    return rows.repartitionById(max(1, count), "part").sortWithinPartitions("part", "word")


def in_ranges(words: DataFrame, ranges: int, most: int = EDGES) -> tuple[DataFrame, int]:
    """words (word, f, l) with ``part``, written, and the number of parts: sorted ranges of about ``RANGE`` words, cut again where their
    bytes come to ``most``. Parts are numbered from 0 in the order of their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, part = 0, TaskContext.get().partitionId()
        for b in batches:
            size = at + np.cumsum(pc.binary_length(b.column(0)).to_numpy() + 1)
            if len(size):
                at = int(size[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(size), part, dtype=np.int32)), pa.array((size - 1) // most)], ["word", "f", "l", "p", "sub"])

    cut = words.select("word", "f", "l").repartitionByRange(ranges, "word").sortWithinPartitions("word").mapInArrow(run, "word string, f array<bigint>, l array<bigint>, p int, sub long")
    cut = written(cut, "lm-ranges")
    parts = cut.select("p", "sub").distinct()  # a row a part
    numbered = parts.select("p", "sub", (F.row_number().over(Window.orderBy("p", "sub")) - 1).cast("int").alias("part"))
    numbered = written(numbered, "lm-parts-numbered")
    return alike(cut.join(F.broadcast(numbered), ["p", "sub"]).drop("p", "sub"), cut), numbered.count()


def with_bounds(words: DataFrame) -> DataFrame:
    """words (part, word, f, l) with what the first and the last of each part have in common with the neighbouring parts'
    last and first: so many bytes."""

    @F.arrow_udf(T.LongType())
    def common(a: pa.Array, b: pa.Array) -> pa.Array:
        spelled = lambda w: w if w == END else w + CLOSE
        return pa.array([-1 if x is None or y is None else common_prefix(spelled(x.encode()), spelled(y.encode())) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.int64())

    ends = words.groupBy("part").agg(F.min("word").alias("first"), F.max("word").alias("last"))  # a row for each range
    w = Window.orderBy("part")
    ends = ends.withColumns({"last_before": F.lag("last").over(w), "first_behind": F.lead("first").over(w)})
    ends = written(ends.select("part", common("first", "last_before").alias("before"), common("last", "first_behind").alias("behind")), "lm-bounds")
    return words.join(ends, "part")


def _read(t: pa.Table) -> tuple[list[bytes], pa.Table, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """A range's words, their rows, and the edges that it shares: beginnings, bytes, f, l."""
    shared = pc.is_null(t["word"])
    edges, rows = t.filter(shared), t.filter(pc.invert(shared))
    begin, byte = (np.asarray(edges[c]).astype(np.int64) for c in ("begin", "byte"))
    return _bytes(rows["word"]), rows, (begin.view(np.uint64), byte, _matrix(edges["f"]), _matrix(edges["l"]))


def filled(words: DataFrame) -> tuple[list[np.ndarray], list[np.ndarray], DataFrame]:
    """What fills the contexts, in one pass: log odds of the hashed ones, tables of fixed size (``ORDERS``) whatever the data,
    first without the fold that is left, for learning on it, then with it, for scoring; and for each range the edges that its
    bounds cut, with their counts over all ranges: (part, begin, byte, f, l). words: dealt, with bounds."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros((4, 1 << size), dtype=np.float32) for _, size in ORDERS]  # 0 and 1 by f, by l
        for t in _ranges(batches):
            w, f, l = _bytes(t["word"]), _matrix(t["f"]), _matrix(t["l"])  # noqa: E741
            bits = Bits(w)
            cut = np.flatnonzero(np.isin(bits.whole, open_beginnings(bits, w, t["before"][0].as_py(), t["behind"][0].as_py())))
            both = np.concatenate((f, l), axis=1)
            if len(cut):
                n = np.stack([np.bincount(bits.edge, weights=both[bits.owner, g].astype(float), minlength=len(bits))[cut] for g in range(both.shape[1])], axis=1).astype(np.int64)
                part = pa.array(np.full(len(cut), t["part"][0].as_py(), dtype=np.int32))
                yield pa.RecordBatch.from_arrays([pa.nulls(len(cut), pa.int32()), part, pa.nulls(len(cut), pa.binary()), pa.array(bits.whole[cut].view(np.int64)), pa.array(bits.byte[cut]), _lists(n)], schema=_PARTS)
            w = bits.spread(np.stack((f.sum(axis=1), l.sum(axis=1)), axis=1))
            ones = [bits.bit(b) == 1 for b in range(8)]
            sides = [np.concatenate([w[~y] for y in ones]), np.concatenate([w[y] for y in ones])]
            for k, c in enumerate(counts):
                slots = [bits.slots(k, b) for b in range(8)]
                for y in range(2):
                    at = np.concatenate([s[o == y] for s, o in zip(slots, ones)])
                    for j in range(2):
                        c[2 * j + y] += np.bincount(at, weights=sides[y][:, j], minlength=c.shape[1])
        for k, c in enumerate(counts):
            for i in range(0, c.shape[1], SHARD):
                part = c[:, i : i + SHARD]
                if part.any():
                    yield pa.RecordBatch.from_pylist([{"k": k, "i": i, "v": zlib.compress(part.tobytes(), 1)}], _PARTS)

    def merge(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0)
        for b in parts:
            for v in b.column("v"):
                part = np.frombuffer(zlib.decompress(v.as_buffer()), dtype=np.float32).reshape(4, -1)
                total = total + part if total.size else part.astype(np.float64)
        total[2:] += total[:2]
        odds = np.rint(np.clip(np.log((total[1::2] + EASE) / (total[::2] + EASE)), -14, 14) * 1000).astype(np.int16)
        yield pa.RecordBatch.from_pydict({"k": pa.array([key[0].as_py()], pa.int32()), "i": pa.array([key[1].as_py()], pa.int32()), "v": pa.array([odds.tobytes()], pa.binary())})

    found = written(words.mapInArrow(add, "k int, i int, v binary, begin long, byte long, n array<long>"), "lm-filled")
    odds = [np.zeros((2, 1 << size), dtype=np.int16) for _, size in ORDERS]
    for r in found.filter("k is not null").select("k", "i", "v").groupBy("k", "i").applyInArrow(merge, "k int, i int, v binary").collect():  # tables of fixed size
        part = np.frombuffer(r.v, dtype=np.int16).reshape(2, -1)
        odds[r.k][:, r.i : r.i + part.shape[1]] = part
    cut = found.filter("k is null").select(F.col("i").alias("part"), "begin", "byte", F.posexplode("n").alias("g", "n"))
    total = cut.groupBy("begin", "byte", "g").agg(F.sum("n").alias("n"))
    total = total.groupBy("begin", "byte").agg(F.array_sort(F.collect_list(F.struct("g", "n"))).alias("n"))
    half = F.size("n") / 2
    total = total.select("begin", "byte", F.transform("n", lambda x: x["n"]).alias("n")).select("begin", "byte", F.slice("n", F.lit(1), half.cast("int")).alias("f"), F.slice("n", half.cast("int") + 1, half.cast("int")).alias("l"))
    shared = written(cut.select("part", "begin").distinct().join(total, "begin"), "lm-shared")
    release(found)
    return [t[0].copy() for t in odds], [t[1].copy() for t in odds], shared


_PARTS = pa.schema([("k", pa.int32()), ("i", pa.int32()), ("v", pa.binary()), ("begin", pa.int64()), ("byte", pa.int64()), ("n", pa.list_(pa.int64()))])


def learnt(words: DataFrame, odds: list[np.ndarray]) -> Model:
    """Weights and adaptive map over the fold that is left. A range's words are alike, so each task's weights count, for each
    gate, by the curvature that it met: together they are the weights that suit all ranges. words: dealt, with what they share."""
    shipped = words.sparkSession.sparkContext.broadcast(odds)
    prior = np.tile(np.eye(INPUTS) * PRIOR, (GATES, 1, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, curve = Model.blank(shipped.value), prior.copy()
        begun = np.einsum("gij,gj->gi", prior, model.weights)
        for t in _ranges(batches):
            w, rows, (begin, byte, f, _) = _read(t)
            bits = Bits(w, _matrix(rows["f"]), (begin, byte, f))
            model.learn(bits, bits.spread(_matrix(rows["l"])), curve)
        found = [curve - prior, np.einsum("gij,gj->gi", curve, model.weights) - begun, model.hits, model.seen]
        yield pa.RecordBatch.from_pydict({"v": pa.array([np.concatenate([f.ravel() for f in found]).tolist()], pa.list_(pa.float64()))})

    with once(words.sparkSession):
        got = words.mapInArrow(run, "v array<double>").select(F.posexplode("v").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
    shipped.destroy()
    model = Model.blank(odds)
    if got:  # some numbers for each gate
        flat = np.zeros(len(got))
        for r in got:
            flat[r.i] = r.v
        cuts = np.cumsum([prior.size, model.weights.size, model.hits.size])
        curve, pull, hits, seen = np.split(flat, cuts)
        pull = pull.reshape(model.weights.shape) + np.einsum("gij,gj->gi", prior, model.weights)
        model.weights = np.linalg.solve(curve.reshape(prior.shape) + prior, pull[:, :, None])[:, :, 0]
        model.hits, model.seen = hits.reshape(GATES, CELLS), seen.reshape(GATES, CELLS)
    return model


def costed(words: DataFrame, model: Model | Broadcast) -> DataFrame:
    """(word, c, by, cost) for each distinct word: its training counts, all and by class, and its log10 probability behind its
    first byte, over all and by class, from contexts that all training folds have filled (of the hashed ones model.tables)."""
    shipped = words.sparkSession.sparkContext.broadcast(model) if isinstance(model, Model) else model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _ranges(batches):
            w, rows, (begin, byte, f, l) = _read(t)  # noqa: E741
            by = _matrix(rows["f"]) + _matrix(rows["l"])
            cost = shipped.value.cost(Bits(w, by, (begin, byte, f + l)), len(w), first=False).astype(np.float32)
            c, word = by.sum(axis=1), rows["word"].combine_chunks()
            for i in range(0, len(w), 10_000):
                yield pa.RecordBatch.from_arrays([word[i : i + 10_000], pa.array(c[i : i + 10_000]), _lists(by[i : i + 10_000]), _lists(cost[i : i + 10_000])], ["word", "c", "by", "cost"])

    return words.mapInArrow(run, "word string, c long, by array<long>, cost array<float>")


def openings(known: DataFrame, follow: DataFrame, classes: int) -> np.ndarray:
    """The table of first bytes' costs, see ``Openings.costs``: of fixed size."""
    by_class = np.zeros((classes + 1, 256))
    first = F.when(F.col("word") == END.decode(), F.lit(END[0])).otherwise(F.conv(F.substring(F.hex(F.encode("word", "utf-8")), 1, 2), 16, 10).cast("int"))
    for r in known.groupBy(first.alias("byte")).agg(*[F.sum(F.col("by")[i]).alias(f"n{i}") for i in range(classes)]).collect():  # at most 256
        by_class[1:, r.byte] = [r[f"n{i}"] for i in range(classes)]
    by_class[0] = by_class[1:].sum(axis=0)
    pairs = np.zeros((2, FIRSTS))
    got = follow.filter(F.col("ctx") < FIRSTS).select("ctx", "of", "trials").toArrow()  # FIRSTS rows at most
    pairs[:, np.asarray(got["ctx"])] = np.asarray(got["of"]), np.asarray(got["trials"])
    old, new = pairs.reshape(2, BUCKETS, 256)
    return Openings().learn(old.sum(axis=0), old, new).costs(by_class, old + new)


def scores(docs: DataFrame, *, key: str = "doc_id", text: str = "text", by: str | None = "lang", head: int = HEAD) -> DataFrame:
    """One row per document, see op7."""
    small_batches(docs.sparkSession)
    spark, kind = docs.sparkSession, docs.schema[key].dataType.simpleString()
    number, classes = classes_of(docs, key, by)
    words = written(vocabulary(docs, number, classes, key=key, text=text, by=by), "lm-words")
    ranges = max(1, -(-words.count() // RANGE))
    ranged, ranges = in_ranges(words, ranges)
    release(words)
    odds, all_odds, shared = filled(_dealt(with_bounds(ranged), ranges))
    dealt = _dealt(ranged, ranges, shared)
    model = learnt(dealt, odds)
    model.tables = all_odds
    shipped = spark.sparkContext.broadcast(model)
    known = written(costed(dealt, shipped), "lm-costs")
    shipped.destroy()
    release(ranged, shared)
    n, v = known.filter("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    parts = max(1, -(-n // MET))
    follow = written(followers(docs, key, text, parts), "lm-follow")
    opens = openings(known, follow, classes)
    tried = {r.gate: r for r in follow.filter((F.col("ctx") >= FIRSTS) & (F.col("of") > 0) & (F.col("trials") > 0)).groupBy(follow_gate(F.col("learnt"), F.col("of")).alias("gate")).agg(F.sum("hits").alias("hits"), F.sum("trials").alias("trials")).collect()}
    chance = [(tried[g].hits + 0.5) / (tried[g].trials + 1) if g in tried else 0.5 for g in range(FOLLOW_GATES)]
    bottom = n + SMOOTH * (v + 1)
    # The head: the classes of counts, from the top, that hold at most ``head`` words.
    rank = F.floor(F.log2(F.col("c") + 1) * 16).cast("int")
    least, held = 1 << 30, 0
    for r in known.groupBy(rank.alias("r")).count().orderBy(F.desc("r")).collect():  # some hundred classes
        if held + r["count"] > head:
            break
        least, held = r.r, held + r["count"]
    top = known.filter(rank >= least).toArrow()  # at most ``head`` rows
    place = {w: i for i, w in enumerate(_bytes(top["word"]))}
    c = np.asarray(top["c"])[:, None]
    g = classes + 1
    base = np.append(np.log10((c[:, 0] + SMOOTH) / bottom), 0.0)  # the last row: of rare words, nothing
    rows = np.concatenate((c > 0, _matrix(top["cost"]) if len(c) else np.zeros((0, g))), axis=1).astype(np.float32)
    check_of_head = np.append(checks_of(list(place)), 0)
    first_of_head = np.append(firsts_of(list(place)), 0)
    contexts = follow.filter(F.col("ctx") >= FIRSTS).select("ctx", "nx", "n", "total")
    hot = contexts.filter(F.col("total") > n // HOT + HOT_LEAST).toArrow()  # HOT rows at most, as all totals come to n at most
    value = np.concatenate((rows, np.zeros((1, g + 1), dtype=np.float32)))
    with once(spark):
        bloom = _bloom(contexts.select("ctx"))
    shipped = spark.sparkContext.broadcast((place, base, first_of_head, hot, bloom))
    tables = value, opens
    # Every executor has a copy on its disk: most cells are of buckets that were hardly seen, and alike.
    fixed = spark.sparkContext.broadcast((chance, check_of_head, [(zlib.compress(x.T.tobytes(), 1), x.shape) for x in tables]))

    def unpacked() -> tuple[list[float], np.ndarray, np.ndarray, np.ndarray]:
        chance, check_of_head, packed = fixed.value
        value, opens = (np.ascontiguousarray(np.frombuffer(zlib.decompress(x), dtype=np.float32).reshape(shape[::-1]).T) for x, shape in packed)
        return chance, value, opens, check_of_head

    names, costs = ["known", "base", *(f"s{i}" for i in range(g)), "bytes"], [f"s{i}" for i in range(g)]
    every = [*names, "extra"]
    schema = pa.schema([("k", pa.int64()), ("h", pa.int64()), ("word", pa.string()), ("kind", pa.int32()), ("n", pa.int64()), *((c, pa.float64()) for c in every), ("part", pa.int32()), *((c.split()[0], pa.binary()) for c in ASKS.split(", ")[1:])])
    WHOLE, RARE, TOLD, ASK = range(4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, base, first_of_head, hot, bloom = shipped.value
        chance, value, opens, check_of_head = unpacked()
        known_here = Answers(hot, chance, value, opens, check_of_head)
        held: list[tuple] = []

        def batch(rows: int, kind: int, columns: dict[str, pa.Array]) -> pa.RecordBatch:
            columns = {"kind": pa.array(np.full(rows, kind, dtype=np.int32)), **columns}
            return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(rows, f.type) for f in schema], schema=schema)

        def packed() -> Iterator[pa.RecordBatch]:
            starts = np.cumsum([0, *(len(x[5][0]) for x in held)])
            ctx, number, cell = (np.concatenate([x[i] for x in held]) for i in range(3))
            doc = np.concatenate([x[3] + i for x, i in zip(held, starts.tolist())])
            rare, docs_ = list(itertools.chain.from_iterable(x[4] for x in held)), tuple(np.concatenate([x[5][i] for x in held]) for i in range(3))
            held.clear()
            for r in asks_of(ctx % parts, ctx, number, cell, doc, rare, docs_):
                yield batch(1, ASK, {c: pa.array([v], schema.field(c).type) for c, v in r.items()})

        for b in batches:
            for i in range(0, b.num_rows, 200):
                keys, texts = b.column(0)[i : i + 200], [t or "" for t in b.column(1)[i : i + 200].to_pylist()]
                hashes = np.array([hash_of(t) for t in texts], dtype=np.int64)
                flat, starts, count = tokens_of(texts)
                number = np.fromiter(map(place.get, flat, itertools.repeat(-1)), dtype=np.int64, count=len(flat))
                owner, rare = np.repeat(np.arange(len(texts)), count), np.flatnonzero(number < 0)
                check, first = check_of_head[number], first_of_head[number]
                odd = [flat[j] for j in rare.tolist()]
                check[rare], first[rare] = checks_of(odd), firsts_of(odd)
                cell = first_cells(first, check, starts)
                total = np.add.reduceat(value[number], starts, axis=0, dtype=np.float64)
                total[:, 1:] += np.add.reduceat(opens[cell], starts, axis=0, dtype=np.float64)
                sums = {"known": total[:, 0], "base": np.add.reduceat(base[number], starts), "bytes": np.array([float(len(t.encode())) for t in texts]), **{c: total[:, j] for j, c in enumerate(costs, 1)}}
                yield batch(len(rare), RARE, {"k": keys.take(pa.array(owner[rare])), "h": pa.array(hashes[owner[rare]]), "word": pa.array(odd, pa.binary()).cast(pa.string())})
                yield batch(len(texts), WHOLE, {"k": keys, "h": pa.array(hashes), "n": pa.array(count), **{c: pa.array(v) for c, v in sums.items()}})
                at, ctx = preceded(check, starts, count)
                some = _holds(bloom, ctx) if len(ctx) else np.zeros(0, dtype=bool)
                at, ctx = at[some], ctx[some]
                listed = keys.to_pylist()
                docs_ = np.array([k or 0 for k in listed], dtype=np.int64), hashes, np.array([2 if k is None else int(fold_of(k) != 0) for k in listed])
                now = known_here.has(ctx)
                for here in (True, False):
                    a, c = at[now == here], ctx[now == here]
                    these = c, number[a], cell[a], owner[a], [flat[j] for j in a[number[a] < 0].tolist()], docs_
                    if here and len(a):
                        told = known_here.told(*these)
                        yield batch(told.num_rows, TOLD, dict(zip(told.schema.names, told.columns)))
                    elif len(a):
                        held.append(these)
                if sum(len(x[0]) for x in held) > WINDOW:
                    yield from packed()
        if held:
            yield from packed()

    told_shape = "k long, h long, word string, " + ", ".join(f"{c} double" for c in [*costs, "extra"])
    empty = pa.schema([("k", pa.int64()), ("h", pa.int64()), ("word", pa.string()), *((c, pa.float64()) for c in [*costs, "extra"])]).empty_table()

    def answer(asks: pa.Table, found: pa.Table) -> pa.Table:
        if not asks.num_rows or not found.num_rows:
            return empty
        answers = Answers(found, *unpacked())
        return pa.Table.from_batches([answers.told(*asked({c: asks[c][i].as_py() for c in asks.column_names})) for i in range(asks.num_rows)])

    shape = "k long, h long, word string, kind int, n long, " + ", ".join(f"{c} double" for c in every) + ", " + ASKS
    sent = written(docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(run, shape), "lm-parts")
    # Where something is predicted: by how often it followed in other documents.
    asks = sent.filter(F.col("kind") == ASK).select(*(c.split()[0] for c in ASKS.split(", ")))
    there = asks.groupBy("part").cogroup(contexts.withColumn("part", (F.col("ctx") % parts).cast("int")).groupBy("part")).applyInArrow(answer, told_shape)
    there = there.unionByName(sent.filter(F.col("kind") == TOLD).select("k", "h", "word", *costs, "extra"))
    there = written(there.groupBy("k", "h", "word").agg(F.count("*").alias("m"), *[F.sum(c).alias(c) for c in [*costs, "extra"]]), "lm-there")
    shipped.destroy()
    fixed.destroy()
    release(follow)
    zero, nothing = F.lit(0).cast("long"), F.lit(0.0)
    row = lambda total, values, rows=zero: ["k", "h", rows.alias("rows"), total.alias("total"), *[x.cast("double").alias(c) for c, x in zip(every, values)]]
    # Rare words: those of the texts, and once more, less, those that were predicted.
    rare = sent.filter(F.col("kind") == RARE).select("k", "h", "word", F.lit(1).cast("long").alias("n"), F.lit(1).cast("long").alias("m"))
    rare = rare.unionByName(there.filter("word is not null").select("k", "h", "word", F.lit(0).cast("long").alias("n"), (-F.col("m")).alias("m"))).join(known.filter(rank < least), "word")
    rare = rare.select(*row(zero, [F.col("n") * (F.col("c") > 0).cast("int"), F.col("n") * F.log10((F.col("c") + F.lit(SMOOTH)) / F.lit(float(bottom))), *(F.col("m") * F.col("cost")[i] for i in range(g)), nothing, nothing]))
    whole = sent.filter(F.col("kind") == WHOLE).select(*row(F.col("n"), [*(F.col(c) for c in names), nothing], F.lit(1).cast("long")))
    told = there.filter("word is null").select(*row(zero, [nothing, nothing, *(F.col(c) for c in costs), nothing, F.col("extra")]))
    # Rare words don't count in ``total``: the whole row has all tokens.
    sums = rare.unionByName(whole).unionByName(told).groupBy("k", "h").agg(*[F.sum(c).alias(c) for c in ("rows", "total", *every)])
    one = lambda c: F.col(c) / F.col("rows")
    # The mean over classes of the text's probability, in logarithms; all classes weigh the same beforehand.
    best = F.greatest(*[one(f"s{i}") for i in range(g)]) if g > 1 else one("s0")
    mean = best + F.log10(sum((F.pow(F.lit(10.0), one(f"s{i}") - best) for i in range(g)), F.lit(0.0)) / g) + one("extra")
    each = sums.select(
        F.col("k").cast(kind).alias("doc_id"), F.coalesce(F.crc32(F.col("k").cast("string")) % FOLDS == 0, F.lit(False)).alias("held_out"),
        F.round(one("total")).cast("long").alias("n_tokens"), F.round(one("known")).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        one("base").alias("base_score"), mean.alias("score"), (-mean / math.log10(2) / F.greatest(one("bytes"), F.lit(1))).alias("bits_per_byte"),
        F.sequence(F.lit(1).cast("long"), F.col("rows")).alias("copies"),
    )
    return each.withColumn("copies", F.explode("copies")).drop("copies")


def hash_of(text: str | None) -> int:
    b = (text or "").encode()
    return (zlib.crc32(b) << 31) ^ zlib.adler32(b)


def op7_context_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"))
