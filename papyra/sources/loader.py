"""Loading a folder of texts: decode, clean, and tell what failed."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyra.functions.split import by_type_of
from papyra.functions.text import clean_lines, clean_markdown

#: Tried after what is detected, by type of file.
CODECS = {".md": ("utf-8", "gb18030"), ".txt": ("utf-8", "gb18030", "utf-16", "latin-1")}
SAMPLE, SURE, LEAST = 4096, 0.7, 10


def detected(data: bytes) -> str:
    """The encoding of the first bytes, if it's sure enough, else utf-8; with a mark, utf-8-sig."""
    if data.startswith(b"\xef\xbb\xbf"):
        return "utf-8-sig"
    try:
        from charset_normalizer import from_bytes
    except ImportError:
        return "utf-8"
    best = from_bytes(data[:SAMPLE]).best()
    return best.encoding if best is not None and max(0.0, 1 - best.chaos / 100) >= SURE else "utf-8"


def decoded(data: bytes, kind: str) -> tuple[str, str] | None:
    """(text, encoding)."""
    for codec in dict.fromkeys((detected(data), *CODECS.get(kind, ("utf-8",)))):
        try:
            return data.decode(codec), codec
        except (UnicodeDecodeError, LookupError):
            continue
    return None


def pdf_text(data: bytes) -> str | None:
    """Pages with text, joined by line ends; needs pdfplumber."""
    import io

    try:
        import pdfplumber
    except ImportError as e:
        raise RuntimeError("reading PDF needs pdfplumber, which isn't installed") from e
    with pdfplumber.open(io.BytesIO(data)) as pdf:
        return "\n".join(t for p in pdf.pages if (t := (p.extract_text() or "").strip())) or None


def _places(spark: SparkSession, paths: Sequence[str]) -> tuple[list[str], list[str]]:
    """(paths that are there, whole and without those below another, paths that are missing)."""
    there, missing = [], []
    for p in dict.fromkeys(paths):
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        (there if fs.exists(path) else missing).append(fs.makeQualified(path).toString().rstrip("/"))
    there = list(dict.fromkeys(there))
    return [p for p in there if not any(p.startswith(f"{q}/") for q in there)], missing


_READ = T.StructType([T.StructField("text", T.StringType()), T.StructField("encoding", T.StringType())])


def load(spark: SparkSession, paths: str | Sequence[str], *, kinds: Sequence[str] = (".md", ".txt"), skip: Sequence[str] = (), hidden: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents, failures). Files are found below the paths, each once; hidden ones and folders in ``skip``, below the paths,
    and empty ones are passed over. A document has source, file_name, file_type, file_size, modified, encoding, content_length and
    text; a failure has source and reason: a path that is missing, a file that can't be decoded or says too little."""
    there, missing = _places(spark, [paths] if isinstance(paths, str) else list(paths))
    lost = spark.createDataFrame([(p, "missing") for p in missing], "source string, reason string")
    if not there:
        nothing = "source string, file_name string, file_type string, file_size long, modified timestamp, encoding string, content_length int, text string"
        return spark.createDataFrame([], nothing), lost
    names = "{" + ",".join(f"*{k}" for k in kinds) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", names).load(there)
    below = F.coalesce(*[F.when(F.startswith("path", F.lit(f"{p}/")), F.substring("path", len(p) + 2, 1 << 20)) for p in there], F.element_at(F.split("path", "/"), -1))
    files = files.withColumn("parts", F.split(below, "/"))
    if not hidden:
        files = files.filter(~F.exists("parts", lambda p: p.startswith(".")))
    if skip:
        files = files.filter(~F.arrays_overlap("parts", F.array(*map(F.lit, skip))))
    kind = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))

    @F.arrow_udf(_READ)
    def decode(content: pa.Array, kinds_: pa.Array) -> pa.Array:
        def one(c: bytes | None, k: str) -> dict:
            found = ((pdf_text(c), None) if k == ".pdf" else decoded(c, k)) if c else None
            return {"text": found and found[0], "encoding": found and found[1]}

        return pa.array([one(c, k) for c, k in zip(content.to_pylist(), kinds_.to_pylist())], pa.struct([("text", pa.string()), ("encoding", pa.string())]))

    read = files.select(F.col("path").alias("source"), F.element_at("parts", -1).alias("file_name"), kind.alias("file_type"), F.col("length").alias("file_size"), F.col("modificationTime").alias("modified"), decode("content", kind).alias("raw"))
    raw = F.col("raw.text")
    text = F.when(F.col("file_type") == ".md", clean_markdown(raw)).otherwise(clean_lines(raw))
    reason = F.when(raw.isNull(), "not decoded").when(F.length("text") < LEAST, "too short")
    read = read.withColumns({"encoding": F.col("raw.encoding"), "text": text}).withColumn("reason", reason)
    documents = read.filter("reason is null").select("source", "file_name", "file_type", "file_size", "modified", "encoding", F.length("text").alias("content_length"), "text")
    return documents, read.filter("reason is not null").select("source", "reason").unionByName(lost)


def load_and_split(spark: SparkSession, paths: str | Sequence[str], **how) -> tuple[DataFrame, DataFrame]:
    """(chunks, failures) of ``load``: each document split by its type of file."""
    documents, failures = load(spark, paths, **how)
    each = documents.select("source", "file_name", "file_type", F.explode(by_type_of(F.col("text"), F.col("file_type"), F.col("file_name"))).alias("c"))
    return each.select("source", "file_name", "file_type", "c.*"), failures


def ensured(spark: SparkSession, path: str, wanted: T.StructType) -> str:
    """Makes a Parquet table fit to be written to: 'created' if there was none, 'rebuilt', empty, if its columns were others,
    else 'kept'."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
    if there and not schema_differs(spark.read.parquet(path), wanted):
        return "kept"
    spark.createDataFrame([], wanted).write.mode("overwrite").parquet(path)
    return "rebuilt" if there else "created"


def save(articles: DataFrame, path: str, *, title: str = "title", text: str = "text") -> None:
    """One folder for each title (fit to be a file's name) with its text."""
    from papyra.functions.text import file_name

    articles.select(file_name(F.col(title)).alias("name"), F.col(text).alias("value")).write.partitionBy("name").mode("overwrite").text(path)


def schema_differs(df: DataFrame, wanted: T.StructType) -> list[str]:
    """What a table lacks, has beyond, or has of another type."""
    have, want = ({f.name: f.dataType.simpleString() for f in s.fields} for s in (df.schema, wanted))
    return [f"missing {n}" for n in want if n not in have] + [f"unexpected {n}" for n in have if n not in want] + [f"{n} is {have[n]}, not {want[n]}" for n in want if n in have and have[n] != want[n]]
