"""Document fingerprints: an improbable-feature digest.

Every window of ``WINDOW`` bytes of a text is a feature. Its Shannon entropy is rolled along the text, and a fixed rule ranks
entropies by how improbable they are (how many spreads from the usual entropy of such a window; windows of nearly one byte
value are too weak and never chosen). In each stretch of ``STRETCH`` neighbouring features the most improbable, leftmost at a
tie, gets a vote; features with ``VOTES`` votes are chosen. So that short texts have features enough, others are chosen by the hash
of the ``SMALL`` bytes that they begin with: of a text with n features a share of ``FEW`` / n, all of them up to ``FEW``. And so that
an edit leaves very short texts something, windows of ``SMALL`` bytes are features too, a share of (``FEW`` / n) squared of them:
all in texts of some 64 bytes, four of a thousand bytes. Neither jumps with a text's size. Their hashes go, in text order and each once, into a chain of
Bloom filters of 2048 bits with five bits a feature and at most 160 features a filter. Two chains are compared by bit overlap,
normalised between what chance gives and the most possible: each filter of the smaller chain takes its best partner in the
other, weighted by its features. Equal texts have equal fingerprints and likeness 1.

The fingerprint is text: window size, then for each filter its feature count and its bits in hexadecimal.

Edges: a null text is an empty one; an empty text has an empty chain, with likeness 1 to another empty one and else 0; a text
of less than ``SMALL`` bytes, or of one byte value, is one feature. The next document is the next row by (doc_id, text), nulls first; that of the last is
the first; a single document is its own next.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyra.llm.shared import partitions, small_batches, table

WINDOW, STRETCH, VOTES, FEW, SMALL = 16, 32, 8, 64, 4
BITS, PER_FEATURE, PER_FILTER = 2048, 5, 160
#: The usual entropy of a window in bits and its spread, the least entropy of a feature, and the scale of the integer sums.
USUAL, SPREAD, LEAST, SCALE = 3.2, 0.3, 1.5, 1 << 16
_MULTIPLIERS = (np.arange(1, WINDOW + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_LOG = np.array([c * np.log2(c) if c else 0.0 for c in range(WINDOW + 1)])
#: What the sum of c*log2(c) gains when a byte that occurs c times comes in once more.
_GAIN = np.rint(np.diff(_LOG) * SCALE).astype(np.int32)
_WEAK = np.int64(1) << 62


def _ranks() -> np.ndarray:
    """By the scaled sum of c*log2(c), in steps of 1/64: 0 is the most improbable entropy."""
    entropy = np.log2(WINDOW) - np.arange(64 * int(np.ceil(_LOG[WINDOW])) + 65) / 64 / WINDOW
    away = np.minimum(np.abs(entropy - USUAL) / SPREAD, 10.0)
    return np.where(entropy < LEAST, -1, np.rint((10.0 - away) * 100)).astype(np.int64)


_RANK = _ranks()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def _beginnings(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each window of SMALL bytes its number and a hash of it."""
    m = len(x) - SMALL + 1
    v = np.zeros(m, dtype=np.uint64)
    for i in range(SMALL):
        v |= x[i : i + m].astype(np.uint64) << np.uint64(8 * i)
    return v, _mixed(v * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))


def _below(h: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Whether a hash, as a number from 0 to 1, is below a share."""
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53 < share


def _features(x: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the chosen features. x: padded texts one after the other, each followed by WINDOW + STRETCH zeros."""
    n = len(x)
    earlier = np.zeros(n, dtype=np.uint8)  # how often x[i] is among the WINDOW - 1 bytes before it
    later = np.zeros(n, dtype=np.uint8)
    for d in range(1, WINDOW):
        same = (x[d:] == x[:-d]).view(np.uint8)
        earlier[d:] += same
        later[:-d] += same
    # Sum of c*log2(c) over each window: roll from the first window, whose bytes came in one by one.
    m = n - WINDOW + 1
    sums = np.empty(m, dtype=np.int64)
    sums[0] = _GAIN[earlier[:WINDOW]].sum()
    sums[1:] = sums[0] + np.cumsum(_GAIN[earlier[WINDOW:]].astype(np.int64) - _GAIN[later[: m - 1]])
    rank = _RANK[sums * 64 // SCALE]
    valid = np.zeros(m + 1, dtype=np.int32)  # windows wholly in a text
    whole = lengths >= WINDOW
    valid[starts[whole]] += 1
    valid[(starts + lengths - WINDOW + 1)[whole]] -= 1
    inside = np.cumsum(valid[:-1]).astype(bool)
    at = np.arange(m, dtype=np.int64)
    order = np.where(inside & (rank >= 0), (rank << 40) | at, _WEAK)
    best, width = order.copy(), 1
    while width < STRETCH:
        best[: m - width] = np.minimum(best[: m - width], best[width:])
        width *= 2
    chosen = best[inside & (best < _WEAK)] & ((1 << 40) - 1)
    votes = np.bincount(chosen, minlength=m)
    elected = votes >= VOTES
    number, begin = (v[:m] for v in _beginnings(x))
    size = np.repeat(lengths, lengths + WINDOW + STRETCH)[:m]
    elected |= inside & (rank >= 0) & _below(begin, FEW / np.maximum(size - WINDOW + 1, FEW))
    position = np.flatnonzero(elected)
    bytes_of = np.lib.stride_tricks.sliding_window_view(x, WINDOW)[position].astype(np.uint64)
    hashes = _mixed((bytes_of * _MULTIPLIERS).sum(axis=1, dtype=np.uint64) ^ _mixed((bytes_of * _MULTIPLIERS[::-1]).sum(axis=1, dtype=np.uint64)))
    again = _mixed(begin ^ np.uint64(0xD1B54A32D192ED03))
    ends = np.repeat(starts + lengths, lengths + WINDOW + STRETCH)[:m]
    small = np.flatnonzero((at + SMALL <= ends) & _below(again, np.square(FEW / np.maximum(size - SMALL + 1, FEW))) & (number != (number & np.uint64(255)) * np.uint64(0x01010101)))
    position, hashes = np.concatenate((position, small)), np.concatenate((hashes, _mixed(again[small] + np.uint64(7))))
    order = np.argsort(position, kind="stable")
    return position[order], hashes[order]


Chain = tuple[np.ndarray, np.ndarray]  # features of each filter, bits of each filter (filters x 256 bytes)


def _chain(hashes: np.ndarray) -> Chain:
    if len(hashes) > 1:
        _, first = np.unique(hashes, return_index=True)
        hashes = hashes[np.sort(first)]
    k = len(hashes)
    of = np.arange(k) // PER_FILTER
    bits = np.zeros((k + PER_FILTER - 1) // PER_FILTER * BITS, dtype=np.uint8)
    for j in range(PER_FEATURE):
        bits[of * BITS + ((hashes >> np.uint64(11 * j)) & np.uint64(BITS - 1)).astype(np.int64)] = 1
    return np.bincount(of, minlength=0), np.packbits(bits.reshape(-1, BITS), axis=1)


def chains(texts: list[bytes], block: int = 1 << 18) -> list[Chain]:
    """The chain of each text; texts are worked on together in blocks of about ``block`` bytes."""
    out: list[Chain] = []
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= block):
            size += len(texts[j]) + WINDOW + STRETCH
            j += 1
        pad = bytes(WINDOW + STRETCH)
        x = np.frombuffer(pad.join([*texts[i:j], b""]), dtype=np.uint8)
        lengths = np.array([len(t) for t in texts[i:j]])
        starts = np.concatenate(([0], np.cumsum(lengths + len(pad))[:-1]))
        position, hashes = _features(x, starts, lengths)
        cut = np.searchsorted(position, [*starts, len(x)])
        for k, t in enumerate(texts[i:j]):
            h = hashes[cut[k] : cut[k + 1]]
            if t and not len(h):  # shorter than a small window, or only weak ones: the whole text is the feature
                h = np.frombuffer(hashlib.blake2b(t, digest_size=8).digest(), dtype=np.uint64)
            out.append(_chain(h))
        i = j
    return out


def encoded(c: Chain) -> str:
    return f"{WINDOW}:" + ":".join(f"{n}.{b.tobytes().hex()}" for n, b in zip(c[0].tolist(), c[1])) if len(c[0]) else ""


def likeness(a: Chain, b: Chain) -> float:
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    if len(a[0]) == len(b[0]) and np.array_equal(a[1], b[1]):
        return 1.0
    if (len(a[0]), a[0].sum()) > (len(b[0]), b[0].sum()):
        a, b = b, a
    p, q = (np.unpackbits(c[1], axis=1).astype(np.float32) for c in (a, b))
    m, k = p.sum(axis=1)[:, None], q.sum(axis=1)[None, :]
    most, chance = np.minimum(m, k), m * k / BITS
    score = np.clip((p @ q.T - chance) / np.maximum(most - chance, 1e-9), 0, 1).max(axis=1)
    return float((score * a[0]).sum() / a[0].sum())


_NULL = -(1 << 63)


def _in_order(docs: DataFrame, key: str, text: str, parts: int) -> DataFrame:
    """(part, tail, k, t): the rows dealt to ranges of the order by key; each range's last row is followed, as its tail, by
    the next range's first row (the last range's by the very first). Rows with one key are in one range."""
    d = docs.select(F.coalesce(F.col(key), F.lit(_NULL)).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    # At most ``parts`` numbers each: the ranges' bounds, then their least keys.
    cuts = np.array(sorted({int(c) for c in d.approxQuantile("k", [i / parts for i in range(1, parts)], 0.2 / parts)}), dtype=np.int64)

    @F.arrow_udf(T.IntegerType())
    def part(k: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(cuts, k.to_numpy(zero_copy_only=False), side="left"), pa.int32())

    d = d.withColumn("part", part("k"))
    first = d.groupBy("part").agg(F.min("k").alias("k")).orderBy("part").collect()
    least = np.array([r.k for r in first], dtype=np.int64)
    before = np.array([first[i - 1].part for i in range(len(first))], dtype=np.int32)

    @F.arrow_udf(T.IntegerType())
    def to(k: pa.Array) -> pa.Array:
        """The range whose tail a row may be: the one before its own, for a range's least key."""
        v = k.to_numpy(zero_copy_only=False)
        i = np.minimum(np.searchsorted(least, v), max(0, len(least) - 1))
        return pa.array(before[i], pa.int32(), mask=least[i] != v) if len(least) else pa.nulls(len(v), pa.int32())

    tails = d.select(to("k").alias("to"), "k", "t").filter("to is not null").groupBy("to").agg(F.min(F.struct("k", "t")).alias("r"))
    return d.select("part", F.lit(False).alias("tail"), "k", "t").unionByName(tails.select(F.col("to").alias("part"), F.lit(True).alias("tail"), "r.k", "r.t"))


def fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document, see op1."""
    small_batches(docs.sparkSession)
    parts = partitions(docs.sparkSession)
    rows = _in_order(docs, key, text, parts).repartitionById(parts, "part").sortWithinPartitions("part", "tail", "k", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []  # the last row seen: it waits for its next
        for b in batches:
            todo = list(zip(*(c.to_pylist() for c in b.columns)))
            for i in range(0, len(todo), 500):
                chunk = held + todo[i : i + 500]
                held = chunk[-1:]
                pairs = [(a, z) for a, z in zip(chunk, chunk[1:]) if not a[1]]
                if pairs:
                    yield answer(pairs)
        # the last row of a task is always a tail

    def answer(pairs: list) -> pa.RecordBatch:
        texts, edits, following = [], [], []
        for (_, _, _, t), (_, _, _, z) in pairs:
            q = len(t) // 4
            texts.append(t.encode())
            edits.append((t[: len(t) - q] + z[:q]).encode())
            following.append(z.encode())
        known: dict[bytes, Chain] = {}
        new = list(dict.fromkeys([*texts, *following[-1:], *[f for f, g in zip(following, texts[1:]) if f != g]]))
        known.update(zip(new, chains(new)))
        changed = chains(edits)
        c = [known[t] for t in texts]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([None if a[2] == _NULL else a[2] for a, _ in pairs], pa.int64()), pa.array([len(a[3]) for a, _ in pairs], pa.int64()),
                pa.array([hashlib.sha256(e).hexdigest() for e in edits]), pa.array([encoded(x) for x in c]), pa.array([encoded(x) for x in changed]),
                pa.array([likeness(x, y) for x, y in zip(c, changed)]), pa.array([likeness(x, known[f]) for x, f in zip(c, following)]),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    return rows.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
