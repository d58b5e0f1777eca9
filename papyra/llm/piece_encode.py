"""SentencePiece encoding and decoding by suffix-array matching.

The distinct pre-tokens of a batch, put one after the other, are indexed by a suffix array (prefix doubling, to the length of
the longest piece). Every piece of the vocabulary is found in it by binary search: a range of the array, its occurrences, each
an edge from its first byte to its end. The edges are sorted by end position, longest first, and relaxed position by position
for all pre-tokens at once; a pre-token of more than ``LONG`` bytes edge by edge. A character that no piece covers is an edge of its own and becomes its bytes' ids. A document's ids
are its pre-tokens' ids in a row; decoding puts the pieces together again.

Edges: a null text has null ids (and null decoded text), an empty one no ids. Decoding gives the text back exactly, but for
the mark U+2581, which the model reads as a space.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.llm.pieces import LONG, MODEL, SPACE, START, UNKNOWN, Pieces, load
from papyra.llm.shared import small_batches, table

GAP = 0xFF  # between pre-tokens; no byte of UTF-8
BATCH_BYTES, KEPT_WORDS = 1_000_000, 200_000


def suffix_array(x: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``x`` (bytes) in the order of the next ``depth`` bytes; beyond the end are GAPs."""
    return _by_prefix(x, depth)[0]


def _words(x: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number."""
    p = np.concatenate((x, np.full(8, GAP, dtype=np.uint8))).astype(np.uint64)
    key = np.zeros(len(x), dtype=np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | p[k : k + len(x)]
    return key


def _by_prefix(x: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    key = _words(x)
    order = np.argsort(key)
    new = np.concatenate(([False], key[order][1:] != key[order][:-1]))
    size = 8
    while size < depth:
        rank = np.empty(len(x), dtype=np.int64)
        rank[order] = np.cumsum(new)
        # Only ties are sorted again, by what comes ``size`` bytes on.
        tied = np.flatnonzero(~new[1:]) + 1
        if not len(tied):
            break
        members = np.unique(np.concatenate((tied - 1, tied)))
        at = order[members]
        on = at + size
        then = np.where(on < len(x), rank[np.minimum(on, len(x) - 1)], np.int64(len(x)))
        again = np.lexsort((then, rank[at]))
        order[members] = at[again]
        differs = (np.diff(rank[at][again]) != 0) | (np.diff(then[again]) != 0)
        new[members[1:]] |= differs
        size *= 2
    return order, key


def occurrences(x: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """All edges (start, piece) in ``x``."""
    sa, key = _by_prefix(x, int(pieces.lengths.max()))
    firsts = key[sa]
    low = np.array([int.from_bytes(b[:8].ljust(8, b"\0"), "big") for b in pieces.utf8], dtype=np.uint64)
    high = np.array([int.from_bytes(b[:8].ljust(8, b"\xff"), "big") for b in pieces.utf8], dtype=np.uint64)
    lo, hi = np.searchsorted(firsts, low, "left"), np.searchsorted(firsts, high, "right")
    for i in np.flatnonzero((pieces.lengths > 8) & (hi > lo)).tolist():
        b, skip = pieces.utf8[i], 8
        while skip < len(b) and hi[i] > lo[i]:  # inside the range the next eight bytes are sorted too
            on = sa[lo[i] : hi[i]] + skip
            part = np.where(on < len(x), key[np.minimum(on, len(x) - 1)], np.uint64(2**64 - 1))
            w = b[skip : skip + 8]
            base = lo[i]
            lo[i] = base + np.searchsorted(part, np.uint64(int.from_bytes(w.ljust(8, b"\0"), "big")), "left")
            hi[i] = base + np.searchsorted(part, np.uint64(int.from_bytes(w.ljust(8, b"\xff"), "big")), "right")
            skip += 8
    count = np.where(pieces.usable, np.maximum(hi - lo, 0), 0)
    piece = np.repeat(np.arange(len(count), dtype=np.int32), count)
    within = np.arange(len(piece), dtype=np.int32) + np.repeat((lo - np.cumsum(count) + count).astype(np.int32), count)
    return sa.astype(np.int32)[within], piece


def relaxed(words: list[str], pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Encodings of distinct pre-tokens: offsets, and ids one after the other."""
    utf8 = [w.encode() for w in words]
    x = np.frombuffer(bytes([GAP]).join([*utf8, b""]), dtype=np.uint8)
    lengths = np.array([len(b) for b in utf8], dtype=np.int64)
    starts = np.concatenate(([0], np.cumsum(lengths + 1)))[:-1]
    start, piece = occurrences(x, pieces)
    end = start + pieces.lengths.astype(np.int32)[piece]
    # Characters that no piece covers by itself.
    head = ((x & 0xC0) != 0x80) & (x != GAP)
    size = np.where(x < 0x80, 1, np.where(x < 0xE0, 2, np.where(x < 0xF0, 3, 4)))
    covered = np.zeros(len(x), dtype=bool)
    covered[start[end - start == size[start]]] = True
    lone = np.flatnonzero(head & ~covered)
    start, end, piece = (np.concatenate(x).astype(np.int32) for x in ((start, lone), (end, lone + size[lone]), (piece, np.full(len(lone), UNKNOWN))))
    order = np.argsort(end.astype(np.int64) * 64 + (63 - np.minimum(end - start, 63)))
    start, end, piece = start[order], end[order], piece[order]
    # Positions are gaps between bytes; position p of the text ends at p. All positions by their distance from the start.
    n = len(x) + 1
    first = np.searchsorted(end, np.arange(n))
    count = np.diff(np.append(first, len(end)))
    origin = np.repeat(starts, lengths + 1)
    large = np.flatnonzero(lengths > LONG)
    places = np.flatnonzero(count)
    if len(large):
        places = places[np.repeat(lengths <= LONG, lengths + 1)[places - 1]]
    far = places - origin[places - 1]
    places = places[np.argsort(far, kind="stable")]
    cuts = np.concatenate(([0], np.cumsum(np.bincount(far))))[1:] if len(far) else np.array([0])
    last, back, tokens = np.full(n, START), np.full(n, -1), np.zeros(n, dtype=np.int64)
    cost = lambda e: np.where(piece[e] == UNKNOWN, end[e] - start[e], 1)
    total = np.zeros(n)
    for level in range(len(cuts) - 1):
        todo = places[cuts[level] : cuts[level + 1]]
        if pieces.kind == "unigram":
            best = np.full(len(todo), -np.inf)
            for k in range(int(count[todo].max(initial=0))):
                live = np.flatnonzero(count[todo] > k)
                e = first[todo[live]] + k
                sum_ = total[start[e]] + np.where(piece[e] == UNKNOWN, pieces.worst, pieces.scores[piece[e]])
                up = sum_ > best[live]
                p, e = todo[live[up]], e[up]
                best[live[up]] = sum_[up]
                total[p], last[p], back[p], tokens[p] = sum_[up], piece[e], start[e], tokens[start[e]] + cost(e)
            continue
        k = 0
        while len(todo):
            todo = todo[count[todo] > k]
            e = first[todo] + k
            # The last edge is right if no other is.
            good = (count[todo] == k + 1) | pieces.distinct_joins(last[start[e]], piece[e])
            p, e = todo[good], e[good]
            last[p], back[p], tokens[p] = piece[e], start[e], tokens[start[e]] + cost(e)
            todo = todo[~good]
            k += 1
    ends = starts + lengths
    long_ids: dict[int, np.ndarray] = {}
    for i in large.tolist():
        begin, stop = int(starts[i]), int(ends[i])
        lo, hi = int(first[begin + 1]), int(first[stop] + count[stop])
        pace = range(lo, hi, 1 << 16)
        lists = ((e, min(e + (1 << 16), hi)) for e in pace)
        final = np.append(end[lo + 1 : hi] != end[lo : hi - 1], True) if hi > lo else np.zeros(0, dtype=bool)
        edges = chain.from_iterable(zip((start[a:b] - begin).tolist(), (end[a:b] - begin).tolist(), piece[a:b].tolist(), final[a - lo : b - lo].tolist()) for a, b in lists)
        long_ids[i] = _ids_of(*pieces.path(edges, stop - begin), x[begin:stop], pieces)
        tokens[stop] = len(long_ids[i])
    offsets = np.concatenate(([0], np.cumsum(tokens[ends])))
    ids = np.empty(offsets[-1], dtype=np.int32)
    p, base = ends.copy(), offsets[:-1]
    for i, some in long_ids.items():
        ids[offsets[i] : offsets[i + 1]] = some
        p[i] = starts[i]
    while True:
        live = p > starts
        if not live.any():
            return offsets, ids
        q = p[live]
        plain = last[q] >= 0
        ids[base[live][plain] + tokens[q[plain]] - 1] = pieces.ids[last[q[plain]]]
        for w, at in zip(base[live][~plain].tolist(), q[~plain].tolist()):
            ids[w + tokens[back[at]] : w + tokens[at]] = pieces.byte_ids[x[back[at] : at]]
        p[live] = back[q]


def _ids_of(last: list[int], back: list[int], x: np.ndarray, pieces: Pieces) -> np.ndarray:
    """The ids of one long pre-token."""
    at, out = len(x), []
    while at > 0:
        if last[at] == UNKNOWN:
            out += pieces.byte_ids[x[back[at] : at]][::-1].tolist()
        else:
            out.append(int(pieces.ids[last[at]]))
        at = back[at]
    return np.array(out[::-1], dtype=np.int32)


class Encoder:
    """Encodes texts, batch after batch, and keeps the encodings of pre-tokens seen (at most about ``KEPT_WORDS``)."""

    def __init__(self, pieces: Pieces) -> None:
        self.pieces = pieces
        self._forget()

    def _forget(self) -> None:
        self.seen: dict[str, int] = {}
        self.sizes, self.ids = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets of the texts, and ids one after the other."""
        if len(self.seen) > KEPT_WORDS:
            self._forget()
        words = [self.pieces.pretokens(t) for t in texts]
        flat = list(chain.from_iterable(words))
        new = list(set(flat).difference(self.seen))
        if new:
            offsets, ids = relaxed(new, self.pieces)
            self.seen.update(zip(new, range(len(self.seen), len(self.seen) + len(new))))
            self.sizes, self.ids = np.concatenate((self.sizes, np.diff(offsets))), np.concatenate((self.ids, ids))
        number = np.fromiter(map(self.seen.__getitem__, flat), dtype=np.int64, count=len(flat))
        count = self.sizes[number] if len(number) else np.zeros(0, dtype=np.int64)
        at = np.concatenate(([0], np.cumsum(self.sizes)))[:-1]
        offsets = np.concatenate(([0], np.cumsum(count)))
        source = np.repeat(at[number] - offsets[:-1], count) + np.arange(offsets[-1]) if len(number) else np.zeros(0, dtype=np.int64)
        by_text = offsets[np.concatenate(([0], np.cumsum([len(ws) for ws in words]))).astype(np.int64)]
        return by_text, self.ids[source]


def slices(column: pa.Array, limit: int = BATCH_BYTES) -> Iterator[tuple[int, list[str | None]]]:
    """The texts of an Arrow column, some at a time: at most ``limit`` bytes or a single text; with the place of the first."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at, done = 0, 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield at, column.slice(at, to - at).to_pylist()
        at, done = to, int(ends[to - 1])


class Decoder:
    """Puts pieces together again: the bytes of all ids of a batch are gathered at once."""

    def __init__(self, pieces: Pieces) -> None:
        spelled = {int(i): b for i, b in zip(pieces.ids, pieces.utf8)} | {int(i): bytes([b]) for b, i in enumerate(pieces.byte_ids)}
        self.size = np.zeros(max(spelled) + 1, dtype=np.int64)
        for i, b in spelled.items():
            self.size[i] = len(b)
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(spelled[i] for i in sorted(spelled)), dtype=np.uint8)
        self.prefix = pieces.prefix

    def __call__(self, offsets: np.ndarray, ids: np.ndarray) -> list[str]:
        """The texts of ids that stand one after the other."""
        size = self.size[ids]
        ends = np.concatenate(([0], np.cumsum(size)))
        source = np.repeat(self.start[ids] - ends[:-1], size) + np.arange(ends[-1])
        data, cuts = self.bytes[source].tobytes(), ends[offsets].tolist()
        texts = (data[i:j].decode("utf-8", "replace") for i, j in zip(cuts, cuts[1:]))
        return [t[1:] if self.prefix and t.startswith(" ") else t for t in texts]


def encoded(docs: DataFrame, *, key: str = "doc_id", text: str = "text", model: str = MODEL) -> DataFrame:
    """(doc_id, n_tokens, ids, intact): ids of each whole text, and whether decoding gave the text back."""
    small_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(load(model))  # a vocabulary: its size is the model's, not the data's

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shipped.value
        encode, decode = Encoder(pieces), Decoder(pieces)
        for b in batches:
            for at, part in slices(b.column(1)):
                offsets, ids = encode([t or "" for t in part])
                null = np.array([t is None for t in part])
                intact = [None if t is None else d == t.replace(SPACE, " ") for t, d in zip(part, decode(offsets, ids))]
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids), mask=pa.array(null))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(part)), pa.array(np.diff(offsets), mask=null), lists, pa.array(intact, pa.bool_())], ["doc_id", "n_tokens", "ids", "intact"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids array<int>, intact boolean")


def decoded(tokens: DataFrame, *, key: str = "doc_id", ids: str = "ids", model: str = MODEL) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""
    shipped = tokens.sparkSession.sparkContext.broadcast(load(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = Decoder(shipped.value)
        for b in batches:
            lists = b.column(1)
            offsets = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)))).astype(np.int64)
            texts = decode(offsets, lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
            texts = [t if ok else None for t, ok in zip(texts, lists.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = tokens.schema[key].dataType.simpleString()
    return tokens.select(F.col(key), F.col(ids)).mapInArrow(run, f"doc_id {kind}, text string")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"))
