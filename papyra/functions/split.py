"""Splitting texts: chapters, Markdown blocks, chunks and scenes.

The plain functions work on one text; the ``*_of`` columns apply them to Arrow batches and give arrays, to be exploded.
Markdown is read in a subset: ATX and setext headings, fences of backticks or tildes, and pipe tables.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyra.session import small_batches

#: Fixed value: what opens a chapter.
HEADING = re.compile(r"^\s*(第[一二三四五六七八九十百千万零〇0-9]+[章回节卷集部]\s*.*?)\s*$", re.MULTILINE)
#: Where texts may be cut, the best first.
SEPARATORS = ("\n\n", "\n", "。", "！", "？", "，", "；", " ", "")
CHUNK, OVERLAP, SCENE, UNTITLED = 500, 120, 10_000, "无章节"
#: Texts of an Arrow batch that are Python objects, with what is cut from them, at once.
TEXTS = 20


def chapters(text: str, name: str) -> list[dict]:
    """Chapters by their heading lines; what stands before the first is left out; without any, the whole text is one."""
    found = list(HEADING.finditer(text))
    bounds = [m.start() for m in found] + [len(text)]
    if not found:
        return [{"title": name, "text": text, "start": 0, "end": len(text)}]
    return [{"title": m[1].strip(), "text": text[i:j].strip(), "start": i, "end": j} for m, i, j in zip(found, bounds, bounds[1:])]


_FENCE, _ATX = re.compile(r" {0,3}(`{3,}|~{3,})(.*)$"), re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_SETEXT, _RULE = re.compile(r" {0,3}(=+|-+)[ \t]*$"), re.compile(r"[ \t|:-]*-[ \t|:-]*$")


def blocks(text: str) -> list[dict]:
    """Runs of lines of one kind (code, heading, table, text), in order; headings with level and title, code with content."""
    lines = text.splitlines()
    out: list[dict] = []
    i, n = 0, len(lines)

    def put(kind: str, start: int, end: int, **more) -> None:
        if kind == "text" and out and out[-1]["type"] == "text":
            out[-1]["end"] = end
        else:
            out.append({"type": kind, "start": start, "end": end, "level": None, "title": None, "content": None} | more)

    while i < n:
        if (m := _FENCE.match(lines[i])) and not ("`" in m[2] and m[1][0] == "`"):
            j = i + 1
            while j < n and not re.fullmatch(rf" {{0,3}}{re.escape(m[1][0])}{{{len(m[1])},}}[ \t]*", lines[j]):
                j += 1
            end = min(n, j + 1)
            put("code", i, end, content="\n".join(lines[i + 1 : j]) + ("\n" if j > i + 1 else ""))
            i = end
        elif m := _ATX.match(lines[i]):
            put("heading", i, i + 1, level=len(m[1]), title=(m[2] or "").strip())
            i += 1
        elif i + 1 < n and "|" in lines[i] and "|" in lines[i + 1] and _RULE.match(lines[i + 1]):
            j = i + 2
            while j < n and lines[j].strip() and "|" in lines[j]:
                j += 1
            put("table", i, j)
            i = j
        elif i + 1 < n and lines[i].strip() and (m := _SETEXT.match(lines[i + 1])) and (i == 0 or not lines[i - 1].strip() or (out and out[-1]["type"] != "text")):
            put("heading", i, i + 2, level=1 if m[1][0] == "=" else 2, title=lines[i].strip())
            i += 2
        else:
            put("text", i, i + 1)
            i += 1
    return out


def markdown_chapters(text: str, name: str) -> list[dict]:
    """Each heading opens a chapter; chapters without a body are left out."""
    lines, found = text.splitlines(), blocks(text)
    if all(b["type"] != "heading" for b in found):
        return [{"title": name, "text": text, "start": 0, "end": len(text)}]
    at = [0, *accumulate(len(x) + 1 for x in lines)]  # where each line begins
    opens = [k for k, b in enumerate(found) if b["type"] == "heading"]
    cuts = ([0] if opens[0] else []) + opens + [len(found)]
    out = []
    for i, j in zip(cuts, cuts[1:]):
        head = found[i] if found[i]["type"] == "heading" else None
        body = "\n".join(lines[found[i]["start"] : found[j - 1]["end"]]).strip("\n")
        if body.strip():
            out.append({"title": (head and head["title"]) or UNTITLED, "text": body, "start": at[found[i]["start"]] if head else 0, "end": at[found[j - 1]["end"]]})
    return out


def _packed(parts: list[str], size: int, overlap: int, joiner: str) -> Iterator[str]:
    """Parts in a row joined to chunks of at most ``size``, each chunk beginning with what fits in ``overlap`` of the last."""
    held: list[str] = []
    length = 0
    for p in parts:
        more = len(p) + (len(joiner) if held else 0)
        if held and length + more > size:
            yield joiner.join(held)
            while held and (length > overlap or length + len(p) + len(joiner) > size):
                length -= len(held.pop(0)) + (len(joiner) if held else 0)
            more = len(p) + (len(joiner) if held else 0)
        held.append(p)
        length += more
    if held:
        yield joiner.join(held)


def chunks(text: str, size: int = CHUNK, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Recursive character split: cut at the first separator that occurs (kept at the head of what follows), pieces that are
    still too long by the next ones, short neighbours packed together with an overlap."""
    k = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    sep, finer = separators[k], separators[k + 1 :]
    pieces = list(text) if sep == "" else [p for p in re.split(f"(?={re.escape(sep)})", text) if p]
    out: list[str] = []
    short: list[str] = []
    for p in [*pieces, None]:
        if p is not None and len(p) < size:
            short.append(p)
            continue
        out += _packed(short, size, overlap, "")
        short = []
        if p is not None:
            out += chunks(p, size, overlap, finer) if finer else [p]
    return [c for c in (x.strip() for x in out) if c]


def _runs(sizes: list[int], room: int) -> Iterator[slice]:
    """Neighbours taken together as long as their sizes fit in ``room``; what doesn't fit at all is a run by itself."""
    upto = [0, *accumulate(sizes)]
    i = 0
    while i < len(sizes):
        j = max(i + 1, bisect_right(upto, upto[i] + room) - 1)
        yield slice(i, j)
        i = j


def by_lines(text: str, size: int = CHUNK) -> list[str]:
    """Whole lines, with their ends, in parts of at most ``size``; only a line that is longer by itself is cut."""
    lines = text.splitlines()
    parts = ["\n".join(lines[r]) for r in _runs([len(x) + 1 for x in lines], size)] if len(text) > size else [text]
    return [p[i : i + size] for p in parts for i in range(0, max(1, len(p)), size)] if len(text) > size else parts


_RULED = re.compile(r"[|: -]*")


def table_parts(text: str, size: int = CHUNK) -> list[str]:
    """A table whole, or its rows in parts of at most ``size``, each under a copy of its head (and of the rule below it)."""
    first, *rows = text.splitlines() or [""]
    head = [first] + (rows[:1] if rows and _RULED.fullmatch(rows[0]) else [])
    rows = [r.rstrip() for r in rows[len(head) - 1 :]]
    if len(text) <= size or not rows:
        return [text.strip("\n")] if text else []
    top = "\n".join([first.rstrip(), *head[1:]])
    return ["\n".join([top, *rows[r]]) for r in _runs([len(r) + 1 for r in rows], size - len(top))]


def markdown_chunks(text: str, size: int = CHUNK, overlap: int = OVERLAP) -> list[dict]:
    """Chunks with the path of headings above them; tables and code stay whole as far as they fit."""
    lines, path, section, out = text.splitlines(), [], 0, []
    for b in blocks(text):
        body = "\n".join(lines[b["start"] : b["end"]])
        if b["type"] == "heading":
            path = [p for p in path if p[0] < b["level"]] + [(b["level"], b["title"])]
            section += 1
            continue
        parts = {"table": lambda: [q for p in table_parts(body, size) for q in by_lines(p, size)], "code": lambda: by_lines(body, size)}.get(b["type"], lambda: chunks(body, size, overlap))()
        out += [{"type": b["type"], "path": " > ".join(t for _, t in path), "section": section, "text": p} for p in parts if p.strip()]
    return out


def by_type(text: str, kind: str, name: str, size: int = CHUNK, overlap: int = OVERLAP) -> list[dict]:
    """Chunks by type of file, numbered through the text: Markdown with headings by its structure; all else, and Markdown
    without any, by chapters. Each with the title of its chapter (of Markdown, the headings above it)."""
    marked = markdown_chunks(text, size, overlap) if kind.strip().lower() == ".md" and any(b["type"] == "heading" for b in blocks(text)) else []
    found = [(p["path"], p["text"]) for p in marked] or [(c["title"], p) for c in chapters(text, name) for p in chunks(c["text"], size, overlap)]
    return [{"title": t, "text": p, "chunk_index": i, "chunk_total": len(found), "chunk_size": len(p)} for i, (t, p) in enumerate(found)]


def scenes(text: str, limit: int = SCENE) -> list[str]:
    """The text whole, or its paragraphs packed to scenes; longer paragraphs by sentences, longer sentences cut."""
    if len(text) <= limit:
        return [text]
    out: list[str] = []
    run: list[str] = []
    for p in [*filter(None, (x.strip() for x in text.split("\n\n"))), None]:
        long = p is not None and len(p) > limit
        if run and (p is None or long or sum(len(x) + 2 for x in run) + len(p) + 2 > limit):
            out.append("\n\n".join(run))
            run = []
        if long:
            out += _sentences(p, limit)
        elif p is not None:
            run.append(p)
    return out


def _sentences(text: str, limit: int) -> list[str]:
    parts = [s.strip() for s in re.findall(r"[^。！？]*[。！？]|[^。！？]+", text) if s.strip()]
    out: list[str] = [""]
    for s in parts:
        if len(s) > limit:
            out += [s[i : i + limit] for i in range(0, len(s), limit)] + [""]
        elif len(out[-1]) + len(s) > limit:
            out.append(s)
        else:
            out[-1] += s
    return [x for x in out if x]


def _column(f: Callable, kind: T.DataType) -> Callable[..., Column]:
    arrow = {"title": pa.string(), "text": pa.string(), "start": pa.int64(), "end": pa.int64(), "type": pa.string(), "path": pa.string(), "section": pa.int64(), "level": pa.int64(), "content": pa.string(), "chunk_index": pa.int64(), "chunk_total": pa.int64(), "chunk_size": pa.int64()}

    def apply(*columns: Column) -> Column:
        @F.arrow_udf(T.ArrayType(kind))
        def run(*args: pa.Array) -> pa.Array:
            item = pa.string() if isinstance(kind, T.StringType) else pa.struct([(n, arrow[n]) for n in kind.names])
            some = [slice(i, i + TEXTS) for i in range(0, len(args[0]), TEXTS)] or [slice(0, 0)]
            return pa.concat_arrays([pa.array([None if r[0] is None else f(*r) for r in zip(*(a[s].to_pylist() for a in args))], pa.list_(item)) for s in some])

        if (spark := SparkSession.getActiveSession()) is not None:
            small_batches(spark)
        return run(*columns)

    return apply


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, k) for n, k in fields.items()])


_S, _L = T.StringType(), T.LongType()
chapters_of = _column(chapters, _struct(title=_S, text=_S, start=_L, end=_L))
markdown_chapters_of = _column(markdown_chapters, _struct(title=_S, text=_S, start=_L, end=_L))
blocks_of = _column(blocks, _struct(type=_S, start=_L, end=_L, level=_L, title=_S, content=_S))
markdown_chunks_of = _column(markdown_chunks, _struct(type=_S, path=_S, section=_L, text=_S))
chunks_of = _column(chunks, _S)
by_type_of = _column(by_type, _struct(title=_S, text=_S, chunk_index=_L, chunk_total=_L, chunk_size=_L))
scenes_of = _column(scenes, _S)


