"""Token counts by trie-shared dynamic programming.

The distinct pre-tokens of a batch are inserted in a trie: sorted, neighbours share the nodes of their common prefix. Level by
level, each node gets the forward state of its prefix, once for all pre-tokens below it: among the pieces that end there
(looked up by hash, longest first) the one that continues the state of the node where it begins. For a unigram model the state
is the best sum of scores; for a BPE model, the last piece of the prefix's encoding, of which there is exactly one. With it
goes the number of tokens, and the terminal node's number is the pre-token's count; a text's is the sum over its pre-tokens.

Edges: a null or empty text has 0 tokens, words and characters; a character that no piece covers counts as its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.llm.piece_encode import KEPT_WORDS, slices
from papyra.llm.pieces import LONG, MODEL, START, UNKNOWN, Pieces, load
from papyra.llm.shared import small_batches, table

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
CHUNK = 50_000  # pre-tokens in one trie


def _powers(n: int) -> np.ndarray:
    return np.concatenate(([np.uint64(1)], np.cumprod(np.full(n, _BASE, dtype=np.uint64))))


class Lookup:
    """Pieces of each length by the polynomial hash of their bytes."""

    def __init__(self, pieces: Pieces) -> None:
        self.of: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        power = _powers(int(pieces.lengths.max(initial=1)))
        for size in sorted(set(pieces.lengths.tolist()), reverse=True):
            some = np.flatnonzero((pieces.lengths == size) & pieces.usable)
            if len(some):
                x = np.frombuffer(b"".join(pieces.utf8[i] for i in some.tolist()), dtype=np.uint8).reshape(-1, size).astype(np.uint64) + np.uint64(1)
                h = (x * power[size - 1 :: -1][:size]).sum(axis=1, dtype=np.uint64)
                order = np.argsort(h)
                self.of[size] = h[order], some[order]


def counted(words: list[str], pieces: Pieces, lookup: Lookup) -> np.ndarray:
    """Token counts of distinct pre-tokens."""
    utf8 = [w.encode() for w in words]
    back = sorted(range(len(words)), key=utf8.__getitem__)
    out = np.zeros(len(words), dtype=np.int64)
    short = [i for i in back if len(utf8[i]) <= LONG]
    for part in [short[i : i + CHUNK] for i in range(0, len(short), CHUNK)]:
        out[part] = _trie([utf8[i] for i in part], pieces, lookup)
    for i in back:
        if len(utf8[i]) > LONG:
            out[i] = _chain(utf8[i], pieces, lookup)
    return out


def _chain(word: bytes, pieces: Pieces, lookup: Lookup) -> int:
    """A trie of one long pre-token is a chain: all its nodes' hashes are known at once, and so are the pieces that end there."""
    x = np.frombuffer(word, dtype=np.uint8)
    n = len(x)
    power, inverse = _powers(n), np.concatenate(([np.uint64(1)], np.cumprod(np.full(n, _INVERSE, dtype=np.uint64))))
    # h[j] - h[i] * base ** (j - i), with h as in the trie: from sums of (x + 1) / base ** k.
    sums = np.concatenate(([np.uint64(0)], np.cumsum((x.astype(np.uint64) + np.uint64(1)) * inverse[1:])))
    starts, ends, which = [], [], []
    head = np.flatnonzero((x & 0xC0) != 0x80)
    size = np.where(x < 0x80, 1, np.where(x < 0xE0, 2, np.where(x < 0xF0, 3, 4)))[head]
    lone = np.ones(len(head), dtype=bool)
    for length, (of, piece) in lookup.of.items():
        i = head[head + length <= n]
        h = (sums[i + length] - sums[i]) * power[i + length]
        k = np.minimum(np.searchsorted(of, h), len(of) - 1)
        hit = of[k] == h
        starts.append(i[hit])
        ends.append(i[hit] + length)
        which.append(piece[k[hit]])
        lone[: len(i)] &= ~(hit & (size[: len(i)] == length))
    starts, ends, which = (np.concatenate(a).astype(np.int64) for a in ([*starts, head[lone]], [*ends, (head + size)[lone]], [*which, np.full(int(lone.sum()), UNKNOWN)]))
    order = np.lexsort((starts, ends))
    starts, ends, which = starts[order], ends[order], which[order]
    final = np.append(ends[1:] != ends[:-1], True)
    cuts = range(0, len(order), 1 << 16)
    edges = chain.from_iterable(zip(*(a[c : c + (1 << 16)].tolist() for a in (starts, ends, which, final))) for c in cuts)
    last, back = pieces.path(edges, n)
    at, count = n, 0
    while at > 0:
        count += at - back[at] if last[at] == UNKNOWN else 1
        at = back[at]
    return count


def _trie(words: list[bytes], pieces: Pieces, lookup: Lookup) -> np.ndarray:
    """words: sorted and distinct."""
    x = np.frombuffer(b"".join(words) + b"\0", dtype=np.uint8)
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    starts = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    # Hashes of each word's prefixes: h[p] = h[p - 1] * base + x[p] + 1, level by level; h0 is 0.
    longest = int(lengths.max(initial=0))
    power = _powers(longest)
    result = np.zeros(len(words), dtype=np.int64)
    # Nodes of a level: (hash, last piece, tokens, score); at[level][word]: the word's node there.
    hashes, last, tokens, score = [np.zeros(1, np.uint64)], [np.array([START])], [np.zeros(1, np.int64)], [np.zeros(1)]
    at = [np.zeros(len(words), dtype=np.int32)]
    alive = np.arange(len(words))
    for level in range(1, longest + 1):
        alive = np.flatnonzero(lengths >= level) if level == 1 else alive[lengths[alive] >= level]
        byte = x[starts[alive] + level - 1]
        above = at[level - 1][alive]
        new = np.concatenate(([True], (above[1:] != above[:-1]) | (byte[1:] != byte[:-1])))
        node = np.cumsum(new) - 1
        here = np.zeros(len(words), dtype=np.int32)
        here[alive] = node
        at.append(here)
        first = alive[new]
        mine = hashes[level - 1][above[new]] * _BASE + byte[new].astype(np.uint64) + np.uint64(1)
        n = len(first)
        best, piece, count = np.full(n, -np.inf), np.full(n, START), np.zeros(n, dtype=np.int64)
        edge = (starts[first] + level >= starts[first] + lengths[first]) | ((x[starts[first] + level] & 0xC0) != 0x80)
        todo = np.flatnonzero(edge)  # prefixes that end inside a character have no state
        for size, (of, which) in lookup.of.items():
            if size > level or not len(todo):
                continue
            i = todo
            before = at[level - size][first[i]]
            h = mine[i] - hashes[level - size][before] * power[size]
            k = np.minimum(np.searchsorted(of, h), len(of) - 1)
            hit = of[k] == h
            i, before, t = i[hit], before[hit], which[k[hit]]
            if pieces.kind == "unigram":
                s = score[level - size][before] + pieces.scores[t]
                up = s > best[i]
            else:
                s = np.zeros(len(i))
                up = pieces.distinct_joins(last[level - size][before], t)
            i, before = i[up], before[up]
            best[i], piece[i], count[i] = s[up], t[up], tokens[level - size][before] + 1
            if pieces.kind == "bpe" and len(i):
                todo = todo[~np.isin(todo, i)]
        # A character that no piece covers by itself.
        for size in (1, 2, 3, 4):
            if size > level:
                break
            i = np.flatnonzero(edge)
            lead = x[starts[first[i]] + level - size]
            i = i[np.where(lead < 0x80, 1, np.where(lead < 0xC0, 0, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))) == size]
            h = mine[i] - hashes[level - size][at[level - size][first[i]]] * power[size]
            of = lookup.of.get(size, (np.zeros(1, np.uint64),))[0]
            lone = of[np.minimum(np.searchsorted(of, h), len(of) - 1)] != h
            i = i[lone]
            before = at[level - size][first[i]]
            s = score[level - size][before] + pieces.worst
            up = (s > best[i]) if pieces.kind == "unigram" else piece[i] == START
            i, before = i[up], before[up]
            best[i], piece[i], count[i] = s[up], UNKNOWN, tokens[level - size][before] + size
        hashes.append(mine)
        last.append(piece)
        tokens.append(count)
        score.append(np.where(np.isfinite(best), best, 0.0))
        ends = alive[lengths[alive] == level]
        result[ends] = count[here[ends]]
    return result


class Counter:
    def __init__(self, pieces: Pieces) -> None:
        self.pieces, self.lookup, self.seen = pieces, Lookup(pieces), {}

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens and pre-tokens of each text."""
        if len(self.seen) > KEPT_WORDS:
            self.seen = {}
        words = [self.pieces.pretokens(t) for t in texts]
        new = list(set(chain.from_iterable(words)).difference(self.seen))
        if new:
            self.seen.update(zip(new, counted(new, self.pieces, self.lookup).tolist()))
        get = self.seen.__getitem__
        return np.array([sum(map(get, ws)) for ws in words], dtype=np.int64), np.array([len(ws) for ws in words], dtype=np.int64)


def token_counts(docs: DataFrame, *, key: str = "doc_id", text: str = "text", model: str = MODEL) -> DataFrame:
    """(doc_id, n_tokens, n_pretokens, n_chars) of each whole text."""
    small_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(load(model))  # a vocabulary: its size is the model's, not the data's

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter(shipped.value)
        for b in batches:
            for at, part in slices(b.column(1)):
                texts = [t or "" for t in part]
                tokens, pre = count(texts)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(part)), pa.array(tokens), pa.array(pre), pa.array([len(t) for t in texts], pa.int64())], ["doc_id", "n_tokens", "n_pretokens", "n_chars"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"doc_id {kind}, n_tokens long, n_pretokens long, n_chars long")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
