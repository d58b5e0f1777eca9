"""N-gram Jaccard join with prefix trees.

A document is the set of its distinct word n-grams (64-bit hashes, in the order of their numbers); equal sets are one vertex.
Two sets link when whole * intersection >= part * union (``Likeness``). That is decided in prefix trees: the sets of a unit are stored in one, so
that common beginnings are one path; a set probes it from the root with its overlap so far, shared by all sets below a node,
and leaves a subtree when the grams left on either side can't bring the overlap that the smallest set below needs. Sets
that are connected already needn't be probed again.

Which sets meet in a unit is settled without loss by pigeonhole. Linked sets of about some size differ in at most d grams, so
if the number space is cut into k = d + 1 + e parts, they have at least e + 1 parts in common, whole. Each set emits a
signature for each part (its grams there), for its own class of sizes and the next smaller, but leaves out up to e parts, less a
few, that are common among strangers: empty ones, and small ones whose signature many documents have (counted over all). As all
sets leave out the most common first, the least common parts that two linked sets share are emitted by both: so many, that strangers
that have a passage in common seldom have as many. Sets that share so many signatures are candidates, and so are, without a count, those
with a signature that many have; components of candidates make units of at most ``BLOCK`` sets and ``GRAMS`` grams, and larger ones are cut into blocks of
one class of sizes: first all blocks against the first, then what is not yet in the largest part against all of like sizes. Full sets
travel only for candidates.

Edges: a null text, or one without words, has an empty set and links with nothing; with fewer than n words the whole
sequence is the one gram; rows with the same id each get their row; a null id counts as a document, with a null id in its component
if it has no other; hot sets of copies are one vertex.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.llm.components import Forest, components
from papyra.llm.piece_encode import slices
from papyra.llm.shared import WRITTEN, alike, discard, partitions, release, small_batches, table, written

#: Sets and grams of a unit: a cluster of more is cut into blocks; in the late round, blocks and groups of probes.
BLOCK, LATE_BLOCK, GRAMS = 64, 512, 500_000
#: Sets with a common signature of which all pairs are counted; pairs that a task counts before it passes them on; how many common
#: signatures are asked for at most; the bits of a Bloom filter, by the number of its keys, at least and at most.
TOGETHER_MOST, PAIRS, AGREE, BLOOM_BITS = 6, 300_000, 16, (16, 28)


@dataclass(frozen=True)
class Likeness:
    """Grams of so many words; sets link with part / whole of their union in common."""

    words: int
    part: int
    whole: int


#: What the query's contract asks for, and what holds for near duplicates otherwise.
CONTRACT, NEAR = Likeness(3, 90, 100), Likeness(5, 80, 100)
#: Parts of at most so many grams are counted: signatures that more sets than these bounds have are common, by degrees.
FEW, COMMON = 3, (2, 12, 128, 2048)
_B = np.uint64(0x9E3779B97F4A7C15)
_B_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(32))


#: Bytes of text that are worked on together: each takes some hundred bytes of memory.
TOGETHER, SEEN = 100_000, 50_000


@cache
def _powers(n: int, base: int) -> np.ndarray:
    return np.concatenate(([np.uint64(1)], np.cumprod(np.full(n, np.uint64(base), dtype=np.uint64))))


def gram_sets(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the texts and their sets, each sorted, one after the other."""
    data = [(t or "").encode() for t in texts]
    x = _LOWER[np.frombuffer(b" ".join([*data, b""]) or b" ", dtype=np.uint8)]
    text_ends = np.cumsum([len(d) + 1 for d in data], dtype=np.int64)
    gap = _SPACE[x]
    before = np.concatenate(([True], gap[:-1]))
    starts, ends = np.flatnonzero(before & ~gap), np.flatnonzero(gap & ~before)
    upto = 1 << len(x).bit_length()
    power, back = _powers(upto, int(_B)), _powers(upto, int(_B_INVERSE))
    sums = np.concatenate(([np.uint64(0)], np.cumsum((x.astype(np.uint64) + np.uint64(1)) * power[: len(x)])))
    word = _mixed((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))
    owner = np.searchsorted(text_ends, starts, side="right")
    count = np.bincount(owner, minlength=len(texts)).astype(np.int64)
    first = np.concatenate(([0], np.cumsum(count)))[:-1]
    # A gram at each word that has n - 1 more in its text; in shorter texts, one at the first word.
    left = np.repeat(first + count, count) - np.arange(len(word))
    short = np.repeat(count, count) < n
    at = np.flatnonzero((left >= n) | (short & (left == np.repeat(count, count))))
    gram = np.zeros(len(at), dtype=np.uint64)
    for i in range(n):
        has = left[at] > i
        gram = np.where(has, _mixed(gram + word[np.minimum(at + i, max(0, len(word) - 1))] + np.uint64(i + 1)), gram) if len(at) else gram
    owner = owner[at]
    order = np.lexsort((gram, owner))
    gram, owner = gram[order], owner[order]
    new = np.concatenate(([True], (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1]))) if len(gram) else np.zeros(0, dtype=bool)
    gram, owner = gram[new], owner[new]
    return np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(texts)), dtype=np.int64))), gram


def _segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    c = np.concatenate(([np.uint64(0)], np.cumsum(values, dtype=np.uint64)))
    return c[offsets[1:]] - c[offsets[:-1]]


def set_keys(offsets: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """A number for each set that depends on its grams only."""
    key = _mixed(_segment_sums(_mixed(grams + np.uint64(7)), offsets) + np.diff(offsets).astype(np.uint64))
    return key.view(np.int64)


@cache
def size_classes(most: int, like: Likeness) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least size of each class up to ``most``; the number of parts and the margin for sets of the class with the next."""
    least = [1]
    while least[-1] <= most:
        least.append(least[-1] * like.whole // like.part + 1)
    largest = [n - 1 for n in least[1:]] + [least[-1] * like.whole // like.part]
    differ = [(like.whole - like.part) * (m + m * like.whole // like.part) // (like.whole + like.part) for m in largest]
    margin = [d // 4 + (d >= 2) for d in differ]
    return np.array(least), np.array([d + 1 + e for d, e in zip(differ, margin)]), np.array(margin)


def signatures(offsets: np.ndarray, grams: np.ndarray, like: Likeness) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All parts of all sets, for both classes: index of the set, signature, number of grams, and how many more parts than
    one linked sets have in common at least (the margin)."""
    size = np.diff(offsets)
    least, parts, margin = size_classes(1 << int(size.max(initial=1)).bit_length(), like)
    own = np.searchsorted(least, size, side="right") - 1
    mixed, owner = _mixed(grams + np.uint64(11)), np.repeat(np.arange(len(size)), size)
    high = (grams >> np.uint64(32)).astype(np.uint64)
    out = []
    for down in (0, 1):
        scheme = own - down
        ok = (size > 0) & (scheme >= 0)
        k = np.where(ok, parts[np.maximum(scheme, 0)], 0)
        base = np.concatenate(([0], np.cumsum(k)))
        cell = base[:-1][owner] + ((high * k[owner].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        inside = ok[owner]
        # Grams are sorted, so those of a part stand together.
        count = np.bincount(cell[inside], minlength=base[-1])
        total = _segment_sums(mixed[inside], np.concatenate(([0], np.cumsum(count))))
        of = np.repeat(np.arange(len(size)), k)
        part = np.arange(base[-1]) - base[:-1][of]
        sig = _mixed(total + _mixed((scheme[of].astype(np.uint64) << np.uint64(32)) + part.astype(np.uint64) + np.uint64(1)))
        out.append((of, sig.view(np.int64), count, margin[np.maximum(scheme, 0)][of]))
    return tuple(np.concatenate(x) for x in zip(*out))


def agreeing(margin: np.ndarray) -> np.ndarray:
    """How many emitted signatures linked sets have in common at least: part of the margin is kept for that."""
    return 1 + np.minimum(margin // 4, AGREE - 1)


def emitted(of: np.ndarray, sig: np.ndarray, count: np.ndarray, margin: np.ndarray, blooms: list[np.ndarray]) -> np.ndarray:
    """Which parts a set emits: all but its ``spare`` most common ones. Linked sets have at least margin + 1 parts in common;
    in one order of all signatures (how common, then the number) what either leaves out of these are the first ``spare`` at
    most, so both emit the last margin + 1 - spare of them: as many as ``agreeing`` says. Signatures come in runs of one set and
    class."""
    spare = margin + 1 - agreeing(margin)
    level = np.where(count == 0, len(blooms) + 1, 0)
    some = np.flatnonzero((count > 0) & (count <= FEW))
    for b in blooms:
        level[some] += _holds(b, sig[some])
    rare = np.lexsort((sig, -level))
    run = np.cumsum(np.concatenate(([True], (of[1:] != of[:-1]) | (margin[1:] != margin[:-1])))) if len(of) else np.zeros(0, dtype=np.int64)
    rare = rare[np.argsort(run[rare], kind="stable")]  # by run, the most common first
    starts = np.searchsorted(run[rare], run[rare], side="left")
    keep = np.ones(len(of), dtype=bool)
    keep[rare[(np.arange(len(of)) - starts < spare[rare]) & (level[rare] > 0)]] = False
    return keep


class Node:
    __slots__ = ("children", "ends", "grams", "least", "most", "sets")

    def __init__(self, grams: np.ndarray) -> None:
        self.grams, self.children, self.ends = grams, [], []
        self.least = self.most = 0
        self.sets: list[int] = []


def prefix_tree(sets: list[np.ndarray]) -> Node:
    """sets: sorted gram numbers. Paths are cut only where they part or a set ends."""
    root = Node(np.zeros(0, dtype=np.int64))

    def grow(node: Node, members: list[int], depth: int) -> None:
        node.sets = members
        node.least, node.most = min(len(sets[i]) for i in members), max(len(sets[i]) for i in members)
        node.ends = [i for i in members if len(sets[i]) == depth]
        split: dict[int, list[int]] = {}
        for i in members:
            if len(sets[i]) > depth:
                split.setdefault(int(sets[i][depth]), []).append(i)
        for some in split.values():
            first, stop = sets[some[0]], min(len(sets[i]) for i in some)
            for i in some[1:]:
                apart = np.flatnonzero(first[depth:stop] != sets[i][depth:stop])
                stop = depth + int(apart[0]) if len(apart) else stop
            child = Node(first[depth:stop])
            node.children.append(child)
            todo.append((child, some, stop))

    todo = [(root, [i for i in range(len(sets)) if len(sets[i])], 0)]
    while todo:
        node, members, depth = todo.pop()
        if members:
            grow(node, members, depth)
    return root


def tree_links(sets: list[np.ndarray], probes: list[int], forest: Forest, like: Likeness) -> list[tuple[int, int]]:
    """Links the indexes of sets in ``forest``, as far as they aren't connected yet; pairs have at least one of ``probes``.
    Returns the links that connected something."""
    made: list[tuple[int, int]] = []
    part, whole = like.part, like.whole
    every, number = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.uint64), return_inverse=True)
    cuts = np.cumsum([len(s) for s in sets])[:-1]
    small = np.split(number.ravel(), cuts) if sets else []
    root = prefix_tree(small)
    has = np.zeros(len(every), dtype=bool)
    needs = lambda a, b: -(-part * (a + b) // (part + whole))  # noqa: E731  least overlap of sets of these sizes
    for x in probes:
        mine = small[x]
        if not len(mine):
            continue
        has[mine] = True
        todo = [(root, 0, 0)]
        while todo:
            node, depth, overlap = todo.pop()
            if not node.sets:
                continue
            r = forest.root(x)
            if all(forest.root(i) == r for i in node.sets):
                continue
            depth += len(node.grams)
            if len(node.grams):
                overlap += int(np.count_nonzero(has[node.grams]))
                left = len(mine) - int(np.searchsorted(mine, node.grams[-1], side="right"))
            else:
                left = len(mine)
            least = max(node.least, -(-part * len(mine) // whole))
            if node.least * part > len(mine) * whole or node.most < least or overlap + min(left, node.most - depth) < needs(len(mine), least):
                continue
            for i in node.ends:
                if i != x and whole * overlap >= part * (len(mine) + len(small[i]) - overlap) and forest.link(x, i):
                    made.append((x, i))
            todo += [(c, depth, overlap) for c in node.children]
        has[mine] = False
    return made


_KEYED = "k long, n long, key long, size_class int"


def keyed(docs: DataFrame, key: str, text: str, like: Likeness) -> DataFrame:
    """(k, n, key, size_class) for each row: its set's size, number (null for an empty set) and class of sizes: linked sets are
    of one class or of neighbouring ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, t in slices(b.column(1), TOGETHER):
                offsets, grams = gram_sets(t, like.words)
                size = np.diff(offsets)
                least = size_classes(1 << int(size.max(initial=1)).bit_length(), like)[0]
                place = pa.array((np.searchsorted(least, size, side="right") - 1).astype(np.int32))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(t)), pa.array(size), pa.array(set_keys(offsets, grams), mask=size == 0), place], ["k", "n", "key", "size_class"])

    return docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(run, _KEYED)


def common_signatures(docs: DataFrame, text: str, like: Likeness) -> list[np.ndarray]:
    """For each bound of COMMON a Bloom filter of the small parts' signatures that more documents have. What it holds by
    chance is common to all tasks alike, so nothing is lost by that."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, t in slices(b.column(0), TOGETHER):
                _, sig, count, _ = signatures(*gram_sets(t, like.words), like)
                sig, n = np.unique(sig[(count > 0) & (count <= FEW)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(n)], ["key", "n"])

    least = COMMON[0]
    counts = written(docs.select(text).mapInArrow(emit, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") > least), "common")
    blooms = [_bloom(counts.filter(F.col("n") > c).select("key")) for c in COMMON]
    release(counts)
    return blooms


def counted_pairs(a: np.ndarray, b: np.ndarray, t: np.ndarray) -> pa.RecordBatch:
    order = np.lexsort((t, b, a))
    a, b, t = a[order], b[order], t[order]
    new = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (t[1:] != t[:-1])))) if len(a) else np.zeros(0, dtype=np.int64)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (a[new], b[new], t[new].astype(np.int32), np.diff(np.append(new, len(a))))], ["a", "b", "t", "n"])


def pairs_of(key: np.ndarray, t: np.ndarray, start: np.ndarray, size: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted sets of each signature -> (a, b, t): all pairs of up to ``most`` sets; of more, each with the first, t 0."""
    out = []
    for k in range(2, most + 1):
        at, of = start[size == k], np.triu_indices(k, 1)
        i, j = (at[:, None] + of[0]).ravel(), (at[:, None] + of[1]).ravel()
        out.append((key[i], key[j], t[i]))
    large = size > most
    first, rest = np.repeat(start[large], size[large] - 1), size[large] - 1
    other = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(rest) - rest, rest)
    out.append((key[first], key[other], np.zeros(len(first), dtype=t.dtype)))
    return tuple(np.concatenate(x) for x in zip(*out))


def candidate_edges(docs: DataFrame, text: str, like: Likeness) -> DataFrame:
    """(a, b): what connects candidates. Pairs of sets that have a signature in common with few others must have as many in common
    as linked sets have (``agreeing``); of a signature that more sets have, each is connected with the first, whatever else they
    have in common. So a linked pair either meets in a signature of the second kind, or all that they share are counted."""
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(common_signatures(docs, text, like))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies within a task emit once
        for b in batches:
            for _, t in slices(b.column(0), TOGETHER):
                if len(seen) > SEEN:
                    seen.clear()
                offsets, grams = gram_sets(t, like.words)
                keys = set_keys(offsets, grams)
                new = np.array([not (k in seen or seen.add(k)) for k in keys.tolist()], dtype=bool) & (np.diff(offsets) > 0)
                of, sig, count, margin = signatures(offsets, grams, like)
                keep = emitted(of, sig, count, margin, shipped.value) & new[of]
                yield pa.RecordBatch.from_arrays([pa.array(sig[keep]), pa.array(keys[of[keep]]), pa.array(agreeing(margin[keep]).astype(np.int8))], ["sig", "key", "t"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sig, key, t = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int8)
        held: list[tuple] = []

        def told(sig: np.ndarray, key: np.ndarray, t: np.ndarray) -> None:
            start = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1]))) if len(sig) else np.zeros(0, dtype=np.int64)
            held.append(pairs_of(key, t, start, np.diff(np.append(start, len(sig))), TOGETHER_MOST))

        def passed_on() -> pa.RecordBatch:
            out = counted_pairs(*(np.concatenate(x) for x in zip(*held)))
            held.clear()
            return out

        for b in batches:
            if not b.num_rows:
                continue
            # The last signature's sets wait for more; of many, the first and enough to be many.
            sig, key, t = (np.concatenate((x, np.asarray(c))) for x, c in zip((sig, key, t), b.columns))
            once = np.concatenate(([True], (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])))
            sig, key, t = sig[once], key[once], t[once]
            cut = int(np.searchsorted(sig, sig[-1]))
            told(sig[:cut], key[:cut], t[:cut])
            sig, key, t = sig[cut:], key[cut:], t[cut:]
            if len(sig) > TOGETHER_MOST + 1:
                told(sig, key, t)
                keep = np.r_[0 : TOGETHER_MOST + 1]
                sig, key, t = sig[keep], key[keep], t[keep]
            if sum(len(h[0]) for h in held) > PAIRS:
                yield passed_on()
        told(sig, key, t)
        yield passed_on()

    sigs = docs.select(text).mapInArrow(emit, "sig long, key long, t byte")
    met = sigs.repartition(partitions(spark), "sig").sortWithinPartitions("sig", "key").mapInArrow(meet, "a long, b long, t int, n long")
    return met.groupBy("a", "b", "t").agg(F.sum("n").alias("n")).filter("n >= t").select("a", "b")


def _bloom(keys: DataFrame, shard: int = 21) -> np.ndarray:
    """A Bloom filter of the keys (a table): of some 16 bits a key, but no more than ``BLOOM_BITS``, so what is broadcast is
    bounded; more keys only let more others pass. Places are dealt to shards of the filter, and only the shards' bits come to
    the driver."""
    bits = int(np.clip((16 * keys.count()).bit_length(), *BLOOM_BITS))
    shard = min(shard, bits)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = np.unique(_places(np.asarray(b.column(0)), bits))
            yield pa.RecordBatch.from_arrays([pa.array((p >> shard).astype(np.int32)), pa.array((p & ((1 << shard) - 1)).astype(np.int32))], ["i", "p"])

    def merge(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = np.zeros(1 << shard, dtype=bool)
        for b in parts:
            on[np.asarray(b.column("p"))] = True
        yield pa.RecordBatch.from_pydict({"i": pa.array([key[0].as_py()], pa.int32()), "v": pa.array([np.packbits(on).tobytes()], pa.binary())})

    out = np.zeros((1 << bits) // 8, dtype=np.uint8)
    for r in keys.mapInArrow(places, "i int, p int").groupBy("i").applyInArrow(merge, "i int, v binary").collect():
        part = np.frombuffer(r.v, dtype=np.uint8)
        out[r.i * len(part) : (r.i + 1) * len(part)] = part
    return out


def _holds(bloom: np.ndarray, keys: np.ndarray) -> np.ndarray:
    p = _places(keys, (8 * len(bloom)).bit_length() - 1)
    return ((bloom[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1).all(axis=1)


def _places(keys: np.ndarray, bits: int) -> np.ndarray:
    h = _mixed(keys.view(np.uint64))
    return np.stack([(h >> np.uint64(s)) & np.uint64((1 << bits) - 1) for s in (0, 18, 36)], axis=1).astype(np.int64)


def candidate_sets(docs: DataFrame, text: str, members: DataFrame, like: Likeness) -> DataFrame:
    """members (key, ...) with their sets (6 bytes a gram; two grams of a unit are the same number by chance about never)."""
    shipped = docs.sparkSession.sparkContext.broadcast(_bloom(members.select("key")))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom, seen = shipped.value, set()
        for b in batches:
            for _, t in slices(b.column(0), TOGETHER):
                if len(seen) > SEEN:
                    seen.clear()
                offsets, grams = gram_sets(t, like.words)
                keys = set_keys(offsets, grams)
                passed = _holds(bloom, keys) & (np.diff(offsets) > 0)
                rows = [i for i in np.flatnonzero(passed).tolist() if not (int(keys[i]) in seen or seen.add(int(keys[i])))]
                short = (grams >> np.uint64(16)).astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:]
                yield pa.RecordBatch.from_arrays([pa.array(keys[rows]), pa.array([short[offsets[i] : offsets[i + 1]].tobytes() for i in rows], pa.binary())], ["key", "grams"])

    found = docs.select(text).mapInArrow(emit, "key long, grams binary").groupBy("key").agg(F.first("grams").alias("grams"))
    return written(found.join(members, "key"), "candidate-sets")


def _unpacked(b: pa.Buffer) -> np.ndarray:
    x = np.frombuffer(b, dtype=np.uint8).reshape(-1, 6)
    return np.concatenate((np.zeros((len(x), 2), dtype=np.uint8), x), axis=1).view(">u8").ravel().astype(np.uint64)


def unit_links(units: DataFrame, like: Likeness) -> DataFrame:
    """(a, b): links that connect the sets of each unit. units: (unit, probe, key, grams, known); sets of the same ``known``
    are connected already, and a pair has at least one probe."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, probe, known, sets = [], [], [], []
        for b in batches:
            for held, name in ((keys, "key"), (probe, "probe"), (known, "known")):
                held += b.column(name).to_pylist()
            sets += [np.unique(_unpacked(g.as_buffer())) for g in b.column("grams")]
        forest = Forest()
        first: dict[int, int] = {}
        for i, k in enumerate(known):
            forest.link(i, first.setdefault(k, i))
        made = tree_links(sets, [i for i, p in enumerate(probe) if p], forest, like)
        yield pa.RecordBatch.from_pydict({"a": pa.array([keys[i] for i, _ in made], pa.int64()), "b": pa.array([keys[j] for _, j in made], pa.int64())})

    return units.select("unit", "probe", "key", "grams", "known").groupBy("unit").applyInArrow(run, "a long, b long")


def linked_sets(docs: DataFrame, text: str, like: Likeness, sized: DataFrame) -> DataFrame:
    """(key, label) for each set that is linked with another: the components of links. sized: (key, n, size_class) of each set."""
    edges = written(candidate_edges(docs, text, like), "candidates")
    clusters = components(edges)
    members = written(clusters.select(F.col("node").alias("key"), F.col("label").alias("cluster")).join(sized, "key"), "members")
    release(edges, clusters)
    # Small clusters are one unit. Others are cut by size class, and classes into blocks, which are numbered by a hash, so that
    # no cluster is sorted in one task; about half of what a unit holds.
    pieces = lambda count, size, most: F.greatest(F.lit(1), F.ceil(count / most), F.ceil(size / GRAMS)).cast("int")
    size = written(members.groupBy("cluster", "size_class").agg(F.count("*").alias("count"), F.sum("n").alias("grams")), "class-sizes")
    whole = size.groupBy("cluster").agg(((F.sum("count") > BLOCK) | (F.sum("grams") > GRAMS)).alias("large"))
    size = written(size.join(whole, "cluster").select("cluster", "size_class", "large", pieces(F.col("count") * 2, F.col("grams") * 2, BLOCK).alias("blocks"), pieces(F.col("count"), F.col("grams"), LATE_BLOCK).alias("late_blocks")), "class-blocks")
    placed = members.join(size, ["cluster", "size_class"]).withColumn("block", F.when(F.col("large"), F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")).otherwise(F.lit(0)))
    placed = written(placed.select("key", "cluster", "large", F.when(F.col("large"), F.col("size_class")).otherwise(F.lit(-1)).alias("size_class"), "block", "blocks", "late_blocks"), "placed")
    release(members)
    sets = candidate_sets(docs, text, placed, like)
    release(placed)
    # First round: each block with itself and the first block of its class; the first blocks of neighbouring classes.
    own = sets.select("*", F.lit(True).alias("probe"), F.col("size_class").alias("to_class"), F.col("block").alias("to"))
    first = sets.filter("block = 0 and large")
    anchors = first.filter("blocks > 1").select("*", F.lit(False).alias("probe"), F.col("size_class").alias("to_class"), F.explode(F.sequence(F.lit(1), F.col("blocks") - 1)).alias("to"))
    above = first.select("*", F.lit(False).alias("probe"), (F.col("size_class") + 1).alias("to_class"), F.lit(0).alias("to"))
    unit = F.xxhash64("cluster", "to_class", "to").alias("unit")
    links = written(unit_links(own.unionByName(anchors).unionByName(above).select(unit, "probe", "key", "grams", F.xxhash64("key").alias("known")), like), "links")
    found = components(links)
    # Second round, for large clusters: sets outside their cluster's largest component against all of their class and its neighbours.
    large = written(sets.filter("large").select("key", "cluster"), "large")
    if not large.isEmpty():
        state = large.join(found.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))
        counts = state.groupBy("cluster", "label").agg(F.count("*").alias("c"))
        largest = written(counts.groupBy("cluster").agg(F.max_by("label", F.struct("c", "label")).alias("main")), "largest")
        state = written(state.join(largest, "cluster").select("key", "label", (F.col("label") != F.col("main")).alias("outside")), "states")
        late = sets.filter("large").select("key", "cluster", "size_class", "grams", "late_blocks").join(state, "key")
        late = late.withColumn("block", F.pmod(F.xxhash64("key", F.lit(2)), F.col("late_blocks")).cast("int"))
        outside = written(late.filter("outside"), "outside")
        if not outside.isEmpty():
            groups = pieces(F.count("*"), F.sum(F.length("grams")) / 6, LATE_BLOCK)
            few = written(outside.groupBy("cluster", "size_class").agg(groups.alias("groups")), "outside-sizes")
            near = F.explode(F.array(*[(F.col("size_class") + i).cast("int") for i in (-1, 0, 1)]))
            upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
            every = late.withColumn("from_class", near).join(few.withColumnRenamed("size_class", "from_class"), ["cluster", "from_class"])
            every = every.select("cluster", "from_class", upto("groups").alias("from"), F.col("size_class").alias("to_class"), F.col("block").alias("to"), F.lit(False).alias("probe"), "key", "grams", "label")
            probes = outside.drop("late_blocks", "block").join(few, ["cluster", "size_class"]).withColumn("from", F.pmod(F.xxhash64("key", F.lit(1)), F.col("groups")).cast("int")).withColumn("to_class", near)
            probes = probes.join(size.filter("large").select("cluster", F.col("size_class").alias("to_class"), "late_blocks"), ["cluster", "to_class"])
            probes = probes.select("cluster", F.col("size_class").alias("from_class"), "from", "to_class", upto("late_blocks").alias("to"), F.lit(True).alias("probe"), "key", "grams", "label")
            unit = F.xxhash64("cluster", "from_class", "from", "to_class", "to").alias("unit")
            pairs = every.unionByName(probes).select(unit, "probe", "key", "grams", F.col("label").alias("known"))
            more = written(unit_links(pairs, like), "links-late")
            release(found, few)
            found = components(links.unionByName(more))
            release(more)
        release(state, largest, outside)
    release(sets, links, large, size)
    return alike(found.select(F.col("node").alias("key"), "label"), found)


def joined(docs: DataFrame, *, key: str = "doc_id", text: str = "text", like: Likeness = NEAR) -> DataFrame:
    """(doc_id, n_shingles, component_id), see op4."""
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    sets = written(keyed(docs, key, text, like), "sets")
    least = written(sets.filter("key is not null").groupBy("key").agg(F.min("k").alias("least"), F.first("n").alias("n"), F.first("size_class").alias("size_class")), "least")
    labels = linked_sets(docs, text, like, least.select("key", "n", "size_class"))
    groups = least.select("key", "least").join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    components_ = groups.groupBy("label").agg(F.min("least").alias("component_id"))
    of = written(groups.join(components_, "label").select("key", "component_id"), "components")
    release(labels, least)
    rows = sets.filter("key is not null").join(of, "key").select("k", "n", "component_id")
    rows = rows.unionByName(sets.filter("key is null").select("k", "n", F.col("k").alias("component_id")))
    return rows.select(F.col("k").cast(kind).alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component_id").cast(kind).alias("component_id"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(table(spark, sf_dir, "documents").select("doc_id", "text"), like=CONTRACT)


def deduplicated(docs: DataFrame, *, key: str = "doc_id", text: str = "text", like: Likeness = NEAR) -> DataFrame:
    """``docs`` with one document of each component, that with the least id. Rows with the same id are one document here:
    it stays if any of its rows is to stay. Documents without an id stay."""
    before = len(WRITTEN)
    members = joined(docs.select(key, text), key=key, text=text, like=like)
    gone = members.groupBy("doc_id").agg(F.bool_or(F.col("doc_id") == F.col("component_id")).alias("stays")).filter("not stays")
    gone = written(gone.select(F.col("doc_id").alias(key)), "gone")
    discard(docs.sparkSession, before, (gone,))
    return docs.join(gone, key, "left_anti")
