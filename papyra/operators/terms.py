"""Many terms looked for in many texts at once: which owners' terms a text has, and where first.

While the terms are small (measured, not assumed) every task has all of them as one automaton that finds all of them in one pass
over a text, and texts stay where they are. Otherwise a text is taken apart into its pieces that are as long as some term; a Bloom
filter of the terms, of bounded size, lets few others pass, and those that pass are joined with the terms by equality. So work grows
with the letters of the texts times the number of different lengths, and no task holds the terms. In neither way is a term
joined with a text as a pair."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from papyra.session import small_batches

#: Up to so many bytes of terms and owners go to every task.
SHARD = 8 << 20
#: Letters of text that are taken apart at once.
CELL = 1 << 17
#: Bounds of the binary logarithm of the Bloom filter's bits (32 MB at most), the bits that a term has in it, and those of a part of it.
BLOOM, PROBES, PART = (10, 28), 4, 21
#: What an owner of a term takes besides its letters, and a text besides its own.
ROW = 64
#: Texts that are Python objects at once, with what is found in them.
TEXTS = 50


class Finder:
    """The automaton of some terms: (term, scope, owner)."""

    def __init__(self, rows: Iterator[tuple]) -> None:
        import ahocorasick

        of: dict[str, dict] = {}
        for term, scope, owner in rows:
            of.setdefault(term, {}).setdefault(scope, []).append(owner)
        self.automaton = ahocorasick.Automaton()
        for term, owners in of.items():
            self.automaton.add_word(term, (term, owners))
        if of:
            self.automaton.make_automaton()
        self.empty = not of

    def first(self, text: str | None, scope: object) -> dict:
        """owner -> (place, term): the first place where one of its terms stands, and the longest that stands there."""
        best: dict = {}
        if self.empty or not text:
            return best
        for end, (term, owners) in self.automaton.iter(text):
            mine = owners.get(scope)
            if mine:
                found = (end - len(term) + 1, -len(term), term)
                for o in mine:
                    if o not in best or found < best[o]:
                        best[o] = found
        return {o: (at, term) for o, (at, _, term) in best.items()}


def _found(finder: Finder, batch: pa.RecordBatch | pa.Table, owner_type: pa.DataType) -> pa.Table:
    return pa.concat_tables([_found_of(finder, batch.slice(i, TEXTS), owner_type) for i in range(0, max(1, batch.num_rows), TEXTS)]).combine_chunks()


def _found_of(finder: Finder, batch: pa.RecordBatch | pa.Table, owner_type: pa.DataType) -> pa.Table:
    take, owners, words, at = [], [], [], []
    for i, (text, scope) in enumerate(zip(batch.column("text").to_pylist(), batch.column("scope").to_pylist())):
        for owner, (place, term) in finder.first(text, scope).items():
            take.append(i)
            owners.append(owner)
            words.append(term)
            at.append(place)
    keys = batch.column("key").take(pa.array(take, pa.int64()))
    return pa.table([keys, pa.array(owners, owner_type), pa.array(words, pa.string()), pa.array(at, pa.int64())], ["key", "owner", "term", "at"])


_B = np.uint64(0x9E3779B97F4A7C15)
_B_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _salts(scopes: list[str]) -> np.ndarray:
    return np.array([zlib.crc32(s.encode()) for s in scopes], dtype=np.uint64)


class Hashed:
    """Hashes of all pieces of some text."""

    def __init__(self, text: str) -> None:
        x = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.uint64) + np.uint64(1)
        powers = lambda b: np.concatenate(([np.uint64(1)], np.cumprod(np.full(len(x), b, dtype=np.uint64))))
        self.sums = np.concatenate(([np.uint64(0)], np.cumsum(x * powers(_B)[:-1])))
        self.back = powers(_B_INVERSE)

    def pieces(self, start: np.ndarray, size: np.ndarray, salt: np.ndarray) -> np.ndarray:
        sums = self.sums[start + size] - self.sums[start]
        return _mixed((sums * self.back[start] + salt) * _B + size.astype(np.uint64))

    def every(self, n: int, salt: np.ndarray) -> np.ndarray:
        """Of all pieces of n letters; salt has one for each letter."""
        h = (self.sums[n:] - self.sums[:-n]) * self.back[: len(self.sums) - n]
        return _mixed((h + salt[: len(h)]) * _B + np.uint64(n))


def _probe(h: np.ndarray, i: int, bits: int) -> np.ndarray:
    return (_mixed(h + np.uint64(i)) >> np.uint64(64 - bits)).astype(np.int64)


def _holds(bloom: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of the hashes may be a term's."""
    bits, some = (len(bloom) * 8).bit_length() - 1, np.arange(len(h))
    for i in range(PROBES):
        at = _probe(h[some], i, bits)
        some = some[(bloom[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1]
    return some


def _bloom(terms: DataFrame, count: int) -> np.ndarray:
    """A Bloom filter of so many (term, scope), of some 16 bits a term within the bounds; more terms only let more others pass.
    Only the bits of its parts come to the driver."""
    bits = int(np.clip((16 * count).bit_length(), *BLOOM))
    part = min(PART, bits)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = b.column(0).to_pylist()
            size = np.array([len(w) for w in words], dtype=np.int64)
            h = Hashed("".join(words)).pieces(np.cumsum(size) - size, size, _salts(b.column(1).to_pylist()))
            p = np.unique(np.concatenate([_probe(h, i, bits) for i in range(PROBES)]))
            yield pa.RecordBatch.from_arrays([pa.array((p >> part).astype(np.int32)), pa.array((p & ((1 << part) - 1)).astype(np.int32))], ["i", "p"])

    def merge(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = np.zeros(1 << part, dtype=bool)
        for b in parts:
            on[np.asarray(b.column("p"))] = True
        yield pa.RecordBatch.from_pydict({"i": pa.array([key[0].as_py()], pa.int32()), "v": pa.array([np.packbits(on).tobytes()], pa.binary())})

    out = np.zeros((1 << bits) // 8, dtype=np.uint8)
    for r in terms.select("term", "scope").mapInArrow(places, "i int, p int").groupBy("i").applyInArrow(merge, "i int, v binary").collect():
        v = np.frombuffer(r.v, dtype=np.uint8)
        out[r.i * len(v) : (r.i + 1) * len(v)] = v
    return out


def _windows(texts: list[str | None], most: int, longest: int) -> Iterator[list[tuple[int, int, str, int]]]:
    """The texts in blocks of about ``most`` letters: (text, where in it, letters, at how many of these a piece may begin); a longer
    one in windows that overlap by what a term may be longer than one letter."""
    block, size = [], 0
    for i, text in enumerate(texts):
        for at in range(0, len(text or ""), most):
            block.append((i, at, text[at : at + most + longest - 1], min(most, len(text) - at)))
            size += len(block[-1][2])
            if size >= most:
                yield block
                block, size = [], 0
    if block:
        yield block


def _passed(batch: pa.RecordBatch, bloom: np.ndarray, lengths: list[int], most: int) -> pa.RecordBatch:
    """(key, scope, term, at): pieces of the texts that may be terms, each at its first place in a text."""
    scopes = batch.column("scope").to_pylist()
    salts, first = _salts(scopes), {}
    for block in _windows(batch.column("text").to_pylist(), most, lengths[-1]):
        joined = "".join(b[2] for b in block)
        size = np.array([len(b[2]) for b in block], dtype=np.int64)
        begin, of = np.cumsum(size) - size, np.repeat(np.arange(len(block)), size)
        place = np.arange(len(joined))
        left, salt = (begin + size)[of] - place, salts[np.array([b[0] for b in block])][of]
        left[place - begin[of] >= np.array([b[3] for b in block])[of]] = 0
        hashed = Hashed(joined)
        for n in lengths:
            if n > len(joined):
                break
            h = hashed.every(n, salt)
            start = np.flatnonzero(left[: len(h)] >= n)
            start = start[_holds(bloom, h[start])]
            for p, k in zip(start.tolist(), of[start].tolist()):
                row, at = block[k][:2]
                at += p - int(begin[k])
                if first.get(found := (row, joined[p : p + n]), at) >= at:
                    first[found] = at
    take = pa.array([row for row, _ in first], pa.int64())
    columns = [batch.column("key").take(take), batch.column("scope").take(take), pa.array([w for _, w in first], pa.string()), pa.array(first.values(), pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["key", "scope", "term", "at"])


def earliest_hits(texts: DataFrame, terms: DataFrame, *, key: list[str], text: str, scope: str | None = None, owner: str = "owner", term: str = "term", shard: int = SHARD, cell: int = CELL) -> DataFrame:
    """(*key, owner, term, at): for each text and each owner with a term in it (of the same scope, such as a book) the earliest
    place, counted from 0 in characters, and the longest term there. texts: key, text, scope; terms: owner, term, scope. Null
    and empty terms are nobody's, null texts have none; texts with the same key count as one; terms that several own are found
    for each of them."""
    spark = texts.sparkSession
    small_batches(spark)
    of = F.col(scope).cast("string") if scope else F.lit("")
    t = terms.select(F.col(term).alias("term"), F.coalesce(of, F.lit("")).alias("scope"), F.col(owner).alias("owner")).filter("term <> ''").distinct()
    d = texts.select(F.struct(*key).alias("key"), F.col(text).alias("text"), F.coalesce(of, F.lit("")).alias("scope"))
    by_length = t.groupBy(F.length("term").alias("n")).agg(F.sum(F.octet_length("term") + F.octet_length("scope") + ROW).alias("bytes"), F.count("*").alias("count")).collect()  # as many rows as lengths
    size = sum(r.bytes for r in by_length)
    owner_type, key_type = t.schema["owner"].dataType, d.schema["key"].dataType
    out = T.StructType([T.StructField("key", key_type), T.StructField("owner", owner_type), T.StructField("term", T.StringType()), T.StructField("at", T.LongType())])
    owner_arrow = to_arrow_type(owner_type)
    if size <= shard:
        rows = spark.sparkContext.broadcast([tuple(r) for r in t.collect()])  # at most ``shard`` bytes, as measured

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder = Finder(iter(rows.value))
            for batch in batches:
                yield from _found(finder, batch, owner_arrow).to_batches()

        hits = d.mapInArrow(run, out)
    else:
        shipped = spark.sparkContext.broadcast(_bloom(t, sum(r["count"] for r in by_length)))
        lengths = sorted(r.n for r in by_length)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield _passed(batch, shipped.value, lengths, cell)

        passed = T.StructType([out["key"], T.StructField("scope", T.StringType()), out["term"], out["at"]])
        # How large it is what passes isn't known beforehand: it must not be taken for small and broadcast.
        hits = d.mapInArrow(run, passed).join(t.hint("merge"), ["scope", "term"]).select("key", "owner", "term", "at")
    best = F.min(F.struct("at", (-F.length("term")).alias("n"), "term")).alias("b")
    return hits.groupBy("key", "owner").agg(best).select("key.*", "owner", F.col("b.term").alias("term"), F.col("b.at").alias("at"))
