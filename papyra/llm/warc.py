"""WARC archives: writing pages as records, and reading archives back by boundary-chain verification.

Writing is Spark's text writer: a row is one record, and what separates rows is the empty lines that end a WARC record. The
archives are gzipped parts in the shared folder, bounded by records and by bytes: pages of more than ``LARGE`` bytes are
dealt to parts of about ``ARCHIVE_BYTES``, the others stand ``PER_ARCHIVE`` to a part. Of records with equal payloads of at least
``LEAST`` bytes the one with the largest id is a response; the others are revisits that refer to it and hold only headers.

Reading: a task looks for the record magic anywhere in its archive's bytes and notes each candidate with the offset where its
record would end, the successor; a candidate's header end and length are looked up among all header ends and lengths of the
archive, found in one pass, so hostile text costs no more than other text. Pointer jumping (each pointer is replaced by its
pointer's pointer, so n steps take log2 n rounds) from offset 0 marks what the chain reaches; magic inside payloads isn't
reached. Only reached records are parsed and hashed. A chain ends at the first offset that is no candidate, so records behind
damage aren't returned. Payloads never leave the task that read them.

Edges: null html is an empty payload; control characters and spaces of a URL are escaped; a null id stays null, is never
referred to, and revisits if a copy has an id; rows with the largest id of their group, if several, are all responses; an
empty table gives an empty result; a length or id of a reached record that is no number of 64 bits is null.
"""

from __future__ import annotations

import gzip
import hashlib
import itertools
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.llm.shared import shared_dir, table, written

LEAST, PER_ARCHIVE, DATE = 1000, 1000, "2024-01-01T00:00:00Z"
LARGE, ARCHIVE_BYTES = 1 << 16, 1 << 26
MAGIC, END = "WARC/1.0\r\n", "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def write_archives(pages: DataFrame, path: str, *, key: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST) -> None:
    """Writes one record per row as gzipped WARC files under ``path``."""
    p = pages.select(F.col(key).alias("k"), F.col(url).alias("u"), F.coalesce(F.col(html), F.lit("")).alias("t"))
    p = p.withColumns({"digest": F.sha1("t"), "n": F.octet_length("t").cast("long")})
    large = pages.select(F.octet_length(html).alias("n")).filter(F.col("n") > LARGE).agg(F.sum("n")).first()[0]
    groups = p.filter(F.col("n") >= least).groupBy("digest", "n").agg(F.max("k").alias("keep"), F.count("*").alias("c"))
    # A table of its own: then Spark can split the hot digests of the join below.
    copies = written(groups.filter("c > 1 and keep is not null").drop("c"), "warc-copies")
    p = p.join(copies, ["digest", "n"], "left").withColumn("revisit", F.expr("keep is not null and (k is null or k < keep)"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), line("Content-Length", F.col("n").cast("string")), F.lit("\r\n"))
    block = F.concat(http, F.when(F.col("revisit"), F.lit("")).otherwise(F.col("t")))
    page = lambda k: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(k).cast("string"), F.lit("")), F.lit(">"))
    head = F.concat(
        F.lit(MAGIC), line("WARC-Type", F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))), line("WARC-Record-ID", page("k")), line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", F.coalesce(F.regexp_replace("u", r"[\x00-\x20\x7f]", "%20"), F.lit(""))), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(F.col("revisit"), F.concat(line("WARC-Refers-To", page("keep")), line("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")), F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(END),
    )
    records = p.select("n", F.concat(head, block).alias("value"))
    write = lambda r, at: r.select("value").write.option("lineSep", END).option("maxRecordsPerFile", PER_ARCHIVE).option("compression", "gzip").text(f"{path}/{at}")
    write(records.filter(F.col("n") <= LARGE), "small")
    if large:
        write(records.filter(F.col("n") > LARGE).repartition(-(-large // ARCHIVE_BYTES), F.xxhash64("value")), "large")


_MAGIC, _END = re.compile(rb"WARC/1\.[01]\r\n"), END.encode()
_LENGTH = re.compile(rb"(?i)\r\ncontent-length:[ \t]*(\d{1,18})[ \t]*(?=\r\n)")
_PAGE, _NUMBER = re.compile(rb"<urn:page:(-?\d{1,19})>"), re.compile(rb"\d{1,18}")


def _header(data: bytes) -> dict[bytes, bytes]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in data.split(b"\r\n"))}


def _id(value: bytes) -> int | None:
    return n if (m := _PAGE.fullmatch(value)) and -(1 << 63) <= (n := int(m[1])) < 1 << 63 else None


def candidates(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every place in an archive's bytes that looks like a record: its offset, where its block begins, its successor's offset."""
    at = np.array([m.end() for m in _MAGIC.finditer(data)], dtype=np.int64)
    ends = np.array([m.start() for m in re.finditer(rb"(?=\r\n\r\n)", data)], dtype=np.int64)
    lengths = [(m.start(), int(m[1])) for m in _LENGTH.finditer(data)]
    where, length = np.array(lengths, dtype=np.int64).reshape(-1, 2).T
    # The first header end behind the magic (its own line's end may begin it), and the first length in between.
    stop = np.append(ends, len(data))[np.searchsorted(ends, at - 2)]
    k = np.searchsorted(where, at - 2)
    ok = np.append(where, len(data))[k] < stop
    begin = stop + len(_END)
    to = begin + np.append(length, 0)[k] + len(_END)
    ok &= to <= len(data)
    return at[ok] - len(MAGIC), begin[ok], to[ok]


def reachable(at: np.ndarray, successor: np.ndarray) -> np.ndarray:
    """Marks what the chain from offset 0 reaches. at: sorted offsets of candidates."""
    n = len(at)
    to = np.searchsorted(at, successor)
    to = np.append(np.where((to < n) & (at[np.minimum(to, n - 1)] == successor), to, n), n)  # n: no candidate there
    on = np.append(at == 0, False)
    for _ in range(max(1, n).bit_length()):
        on[to[on]] = True
        to = to[to]
    return on[:n]


def record(data: bytes, at: int, begin: int, to: int) -> dict:
    """What the record from ``at`` on says; its block begins at ``begin``, its successor at ``to``."""
    h, end = _header(data[at + len(MAGIC) : begin - len(_END)]), to - len(_END)
    body = data.find(_END, begin, end)
    http, payload = (_header(data[begin:body]), data[body + len(_END) : end]) if body >= 0 else ({}, b"")
    size, digest = len(payload), ""
    if revisit := h.get(b"warc-type") == b"revisit":
        told = http.get(b"content-length", b"0")
        size, digest = int(told) if _NUMBER.fullmatch(told) else None, h.get(b"warc-payload-digest", b"").removeprefix(b"sha1:").decode("utf-8", "replace")
    return {
        "page_id": _id(h.get(b"warc-record-id", b"")), "payload_bytes": size, "payload_digest": digest if revisit else hashlib.sha1(payload).hexdigest(),
        "record_type": h.get(b"warc-type", b"").decode("utf-8", "replace"), "refers_to": _id(h.get(b"warc-refers-to", b"")),
    }


def records(data: bytes) -> Iterator[dict]:
    """The records of one archive."""
    at, begin, to = candidates(data)
    on = reachable(at, to)
    for some in zip(at[on].tolist(), begin[on].tolist(), to[on].tolist()):
        yield record(data, *some)


_FIELDS = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
_FOUND = pa.schema(_FIELDS)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under ``path``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").load(path).select("content")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                found = records(gzip.decompress(content.as_buffer()))
                while rows := list(itertools.islice(found, PER_ARCHIVE)):
                    yield pa.RecordBatch.from_pylist(rows, _FOUND)

    kinds = {pa.int64(): "long", pa.string(): "string"}
    return files.mapInArrow(scan, ", ".join(f"`{f.name}` {kinds[f.type]}" for f in _FOUND))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path)


OP10_SQL = f"""
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS payload_digest, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS keep FROM p),
r AS (SELECT *, payload_bytes >= {LEAST} AND keep IS NOT NULL AND (page_id IS NULL OR page_id < keep) AS again FROM k)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN keep END AS refers_to FROM r"""
