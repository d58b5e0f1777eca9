"""Extraction by registered functions over scenes, checks by a model, and what a model's free answers are taken for."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyra.functions.embed import Embedder, HashedGrams, Model, Reranker
from papyra.functions.jsonx import recovered
from papyra.operators.relational import first_per_key
from papyra.operators.vector import reranked
from papyra.session import small_batches

#: The kinds of extraction, in the order in which they run.
KINDS = ("entity", "entity_snapshot", "relation", "timeline", "location", "foreshadowing", "conflict", "rule")
#: (scene's text, level of shrinking, names known beforehand) -> records.
Extractor = Callable[[str, int, Sequence[str]], list[dict]]
BATCH, SHOWN = 50, 64
#: Scenes that are read at once, and records after which what is there is passed on.
SCENES, RECORDS = 20, 5000


class Extractors:
    """Which function extracts what; a kind without one extracts nothing."""

    def __init__(self) -> None:
        self.of: dict[str, Extractor] = {}

    def register(self, kind: str, extract: Extractor) -> None:
        if kind not in KINDS:
            raise ValueError(f"{kind} isn't one of {', '.join(KINDS)}")
        self.of[kind] = extract

    def get(self, kind: str) -> Extractor:
        return self.of.get(kind, lambda text, level, names: [])


_json = json.JSONEncoder(ensure_ascii=False).encode
EXTRACTED = "book_id string, chapter_index long, scene long, kind string, ord long, record string, error string"


def extracted(scenes: DataFrame, kind: str, extractors: Extractors) -> tuple[DataFrame, DataFrame]:
    """(records, errors) of one kind: a record is JSON, in its scene's order; a scene whose extraction fails is an error and
    spoils no other. scenes: book_id, chapter_index, scene, text, level, names."""
    extract = extractors.get(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list] = [[] for _ in range(6)]  # book_id, chapter_index, scene, ord, record, error

        def first(n: int) -> pa.RecordBatch:
            book, chapter, scene, ord_, record, error = (c[:n] for c in rows)
            for c in rows:
                del c[:n]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((book, chapter, scene, [kind] * len(book), ord_, record, error), _SCHEMA)], schema=_SCHEMA)

        for b in batches:
            for s in (s for i in range(0, b.num_rows, SCENES) for s in b.slice(i, SCENES).to_pylist()):
                try:
                    found = [(_json(r), None) for r in extract(s["text"] or "", s["level"] or 0, s["names"] or [])]
                    places = range(len(found))
                except Exception as e:  # whatever an extractor raises concerns its scene only
                    found, places = [(None, f"{type(e).__name__}: {e}")], [None]
                for c, name in zip(rows, ("book_id", "chapter_index", "scene")):
                    c += [s[name]] * len(found)
                rows[3] += places
                rows[4] += [r for r, _ in found]
                rows[5] += [e for _, e in found]
                while len(rows[0]) >= RECORDS:
                    yield first(RECORDS)
        yield first(RECORDS)

    small_batches(scenes.sparkSession)
    all_ = scenes.select("book_id", "chapter_index", "scene", "text", "level", "names").mapInArrow(run, EXTRACTED)
    return all_.filter("error is null").drop("error"), all_.filter("error is not null").drop("record", "ord")


_SCHEMA = pa.schema([("book_id", pa.string()), ("chapter_index", pa.int64()), ("scene", pa.int64()), ("kind", pa.string()), ("ord", pa.int64()), ("record", pa.string()), ("error", pa.string())])


def every_kind(scenes: DataFrame, extractors: Extractors) -> tuple[DataFrame, DataFrame]:
    """``extracted`` for all kinds that have an extractor."""
    parts = [extracted(scenes, k, extractors) for k in KINDS if k in extractors.of] or [extracted(scenes, KINDS[0], extractors)]
    return tuple(reduce(DataFrame.unionByName, p) for p in zip(*parts))


def newest(df: DataFrame, order: Sequence[Column], n: int = BATCH) -> DataFrame:
    """The newest rows of each book."""
    w = Window.partitionBy("book_id").orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).filter(F.col("__rank") <= n)


def review_batches(relations: DataFrame, snapshots: DataFrame, events: DataFrame, n: int = BATCH) -> DataFrame:
    """(book_id, batch): for each book a JSON text of its newest relations, snapshots and events, at most n of each."""

    def listed(df: DataFrame, name: str, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
        rows = newest(df, [F.desc(c) for c in order], n)
        rows = rows.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("__rank", F.struct(*columns).alias("r")))).alias("l"))
        return rows.select("book_id", F.transform("l", lambda x: x["r"]).alias(name))

    r = listed(relations, "relations", ["relation_id", "source_entity_id", "target_entity_id", "relation_type", "relation_desc"], ["chapter_index", "relation_id"])
    s = listed(snapshots, "snapshots", ["entity_name", "status_desc"], ["chapter_index", "snapshot_id"])
    e = listed(events, "events", ["event_id", "event_title", "event_content", "time_desc"], ["global_sort", "event_id"])
    whole = r.join(s, "book_id", "full_outer").join(e, "book_id", "full_outer")
    return whole.select("book_id", F.to_json(F.struct("relations", "snapshots", "events")).alias("batch"))


FINDING = "record_type string, target string, conflict_desc string, severity string, suggested_value string"


def model_findings(batches: DataFrame, model: Model) -> DataFrame:
    """Issues that a model sees in each book's batch; an answer that can't be read, or a failure, gives none."""

    @F.arrow_udf(T.StringType())
    def ask(batch: pa.Array) -> pa.Array:
        def one(prompt: str | None) -> str | None:
            try:
                return recovered(model.answer(prompt), "items") if prompt else None
            except Exception:  # as a failed call
                return None

        return pa.array([one(p) for p in batch.to_pylist()], pa.string())

    found = batches.withColumn("answer", ask("batch")).select("book_id", F.posexplode(F.from_json("answer", f"items array<struct<{', '.join(f.replace(' ', ': ') for f in FINDING.split(', '))}>>")["items"]).alias("ord", "f"))
    blank = lambda c: F.coalesce(f"f.{c}", F.lit(""))
    return found.select("book_id", "ord", blank("record_type").alias("record_type"), F.lit("semantic_conflict").alias("issue_type"), F.coalesce("f.severity", F.lit("warning")).alias("severity"), blank("conflict_desc").alias("description"), blank("suggested_value").alias("suggested_value"))


def intent_of(answer: Column, categories: Sequence[str], default: str) -> Column:
    """The intent in a model's answer (from the first brace to the last, fences and all around it dropped), if it is one of the
    categories; else the default."""
    part = F.regexp_extract(answer, r"(?s)(\{.*\})", 1)
    intent = F.get_json_object(part, "$.intent")
    return F.when(intent.isin(*categories), intent).otherwise(F.lit(default))


def suggestion_prompt(question: Column, answer: Column, *, question_chars: int = 200, answer_chars: int = 500) -> Column:
    return F.concat_ws("\n", F.substring(question, 1, question_chars), F.substring(answer, 1, answer_chars))


def suggestions_of(prompts: Column, model: Model, most: int = 3) -> Column:
    """Up to ``most`` suggestions from a model's answer, a JSON list somewhere in it or lines; null if it fails."""

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def run(c: pa.Array) -> pa.Array:
        def one(p: str | None) -> list[str] | None:
            try:
                answer = model.answer(p or "")
                begin, end = answer.find("["), answer.rfind("]")
                items = json.loads(answer[begin : end + 1]) if 0 <= begin < end else answer.splitlines()
                return [s.strip() for s in items if isinstance(s, str) and s.strip()][:most]
            except Exception:  # none, as after a time-out
                return None

        return pa.array([one(p) for p in c.to_pylist()], pa.list_(pa.string()))

    return run(prompts)


def embedder(kind: str, size: int = 64, others: dict[str, Callable[[], Embedder]] | None = None) -> Embedder:
    """An embedder by name: ``hashed``, or one of the others given."""
    if others and kind in others:
        return others[kind]()
    if kind == "hashed":
        return HashedGrams(size)
    raise ValueError(f"unknown embedder {kind}")


def embedded(texts: DataFrame, embedder_: Embedder, *, key: str = "chunk_id", text: str = "text", batch: int = SHOWN, query: str = "") -> DataFrame:
    """(key, batch, embedding): texts in batches of at most ``batch``, numbered within a task; blank ones get zeros in their
    place. query: what goes before each text that asks (some models want that)."""
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for b in batches:
            for i in range(0, b.num_rows, batch):
                part = b.slice(i, batch)
                vectors = embedder_.embed([query + t.strip() if t and t.strip() else "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n] * part.num_rows, pa.int64()), pa.array([v.tolist() for v in vectors], pa.list_(pa.float64()))], [key, "batch", "embedding"])
                n += 1

    return texts.select(key, text).mapInArrow(run, f"`{key}` {kind}, batch long, embedding array<double>")


#: Hits of a query that a reranker gets at once.
CALL = 500


def rescored(hits: DataFrame, reranker: Reranker, k: int, *, call: int = CALL) -> DataFrame:
    """Hits (query_id, question, vec_id, text, score) in a reranker's order; a query of which a call fails, or answers with another
    number of scores than it has hits, keeps the order of the search. A query with many hits is several calls, so that no
    task holds all of them."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        try:
            scores = list(reranker.scores(group["question"][0].as_py(), group["text"].to_pylist()))
        except Exception:  # as without a reranker
            scores = []
        failed = len(scores) != group.num_rows
        scores = [None] * group.num_rows if failed else scores
        return pa.table({"query_id": group["query_id"], "vec_id": group["vec_id"], "score": group["score"], "again": pa.array(scores, pa.float64()), "failed": pa.array([failed] * group.num_rows)})

    calls = hits.groupBy("query_id").agg(F.ceil(F.count("*") / call).alias("__calls"))
    rows = hits.join(calls, "query_id").withColumn("__call", F.pmod(F.xxhash64("vec_id"), F.col("__calls"))).drop("__calls")
    again = rows.groupBy("query_id", "__call").applyInArrow(run, "query_id long, vec_id long, score double, again double, failed boolean")
    whole = F.max("failed").over(Window.partitionBy("query_id"))
    again = again.withColumn("again", F.when(~whole, F.col("again"))).drop("failed")
    return reranked(again, F.col("again"), k).drop("again")


def collection_of(key: Column, known: Sequence[str]) -> Column:
    """A collection that is known, else the first."""
    return F.when(key.isin(*known), key).otherwise(F.lit(known[0]))


def mapped(chunks: DataFrame, mapper: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """Chunks with a user's change of their metadata; chunk_id and text must stay."""
    out = chunks if mapper is None else chunks.transform(mapper)
    if missing := {"chunk_id", "text"} - set(out.columns):
        raise ValueError(f"the mapper drops {', '.join(sorted(missing))}")
    return out


def first_by(df: DataFrame, keys: Sequence[Column], order: Sequence[Column]) -> DataFrame:
    """The first row of each key; rows of which a key can't be told (null) all stay."""
    named = {f"__k{i}": k for i, k in enumerate(keys)}
    rows = df.withColumns(named)
    none = reduce(lambda a, b: a | b, [F.col(n).isNull() for n in named])
    return first_per_key(rows.filter(~none), list(named), order).unionByName(rows.filter(none)).drop(*named)
