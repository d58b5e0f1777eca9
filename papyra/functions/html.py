"""What pages say: title, chapter links and chapter text, by the standard library's parser."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Titles that are chapters, and those of extras.
CHAPTER = re.compile(r"(?:第[0-9〇零一二两三四五六七八九十百千]+章|^\s*\d{1,})")
EXTRA = re.compile(r"外传|番外|同人|活动|书评|公告|感言|请假|漫画|新书|合作|上线")
#: Marks of a line that advertises the site, and where lists and texts stand.
ADVERTS, LIST_CLASS, TEXT_ID = ("笔趣阁", "biquge"), "fen_4", "txt"
_VOID = {"br", "img", "meta", "link", "hr", "input"}


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, dict]] = []
        self.og, self.texts, self.links, self.parts, self.lists = "", {"h1": None, "title": None}, [], None, 0
        self.depth = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "meta" and a.get("property") == "og:title" and not self.og:
            self.og = a.get("content", "").strip()
        if tag in self.texts and self.texts[tag] is None:
            self.texts[tag] = ""
        if tag == "ul" and LIST_CLASS in a.get("class", "").split():
            self.lists += 1
        if tag == "a" and self._in_list():
            self.links.append([a.get("href", "").strip(), ""])
        if self.parts is not None and self._in_text() and len(self.stack) == self.depth:
            self.parts.append("")
        if tag not in _VOID:
            self.stack.append((tag, a))
            if tag == "div" and a.get("id") == TEXT_ID and self.parts is None:
                self.parts, self.depth = [""], len(self.stack)

    def handle_endtag(self, tag: str) -> None:
        while any(t == tag for t, _ in self.stack):
            if self.stack.pop()[0] == tag:
                break
        if self.parts is not None and self._in_text() and len(self.stack) == self.depth:
            self.parts.append("")

    def _in_list(self) -> bool:
        return self.lists == 1 and any(t == "ul" and LIST_CLASS in a.get("class", "").split() for t, a in self.stack)

    def _in_text(self) -> bool:
        return self.depth > 0 and len(self.stack) >= self.depth and self.stack[self.depth - 1][1].get("id") == TEXT_ID

    def handle_data(self, data: str) -> None:
        for tag in ("h1", "title"):
            if any(t == tag for t, _ in self.stack) and self.texts[tag] is not None:
                self.texts[tag] += data.strip()
        if self.links and self.stack and any(t == "a" for t, _ in self.stack) and self._in_list():
            self.links[-1][1] += data.strip()
        if self.parts is not None and self._in_text():
            self.parts[-1] += data


def read(html: str | None) -> dict:
    """title; links (title, url, kind) of the chapter list, null without a list; text of the chapter, null without one."""
    p = _Page()
    p.feed(html or "")
    p.close()
    links = [{"title": t, "url": u, "kind": "chapter" if CHAPTER.search(t) else "extra"} for u, t in p.links if u and t and (CHAPTER.search(t) or EXTRA.search(t))]
    text = None
    if p.parts is not None:
        tidy = lambda s: re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", re.sub(r"\r\n?", "\n", s))).strip()
        text = "\n\n".join(tidy(s) for s in p.parts if s.strip() and not any(a in s.lower() for a in ADVERTS))
    return {"title": p.og or p.texts["h1"] or p.texts["title"] or "untitled", "links": links if p.lists else None, "text": text}


_LINK = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("title", "url", "kind")]))
PAGE = T.StructType([T.StructField("title", T.StringType()), T.StructField("links", _LINK), T.StructField("text", T.StringType())])


def read_of(column):
    @F.arrow_udf(PAGE)
    def run(c: pa.Array) -> pa.Array:
        s = pa.string()
        return pa.array([read(h) for h in c.to_pylist()], pa.struct([("title", s), ("links", pa.list_(pa.struct([("title", s), ("url", s), ("kind", s)]))), ("text", s)]))

    return run(column)


def joined_url(base, link):
    """A link as seen from a page's address; null if either is, or can't be read."""

    @F.arrow_udf(T.StringType())
    def run(b: pa.Array, u: pa.Array) -> pa.Array:
        def one(x: str | None, y: str | None) -> str | None:
            try:
                return None if x is None or y is None else urljoin(x, y)
            except ValueError:
                return None

        return pa.array([one(x, y) for x, y in zip(b.to_pylist(), u.to_pylist())], pa.string())

    return run(base, link)


RESULT = T.StructType([T.StructField("success", T.BooleanType()), T.StructField("error", T.StringType()), T.StructField("title", T.StringType()), T.StructField("content", T.StringType())])


def result_of(column):
    """What came of a page: (success, error, title, content); a page that is empty or can't be read fails by itself."""

    def one(h: str | None) -> dict:
        if not (h or "").strip():
            return {"success": False, "error": "empty page", "title": None, "content": None}
        try:
            page = read(h)
        except Exception as e:  # concerns this page only
            return {"success": False, "error": f"{type(e).__name__}: {e}", "title": None, "content": None}
        return {"success": True, "error": None, "title": page["title"], "content": page["text"]}

    @F.arrow_udf(RESULT)
    def run(c: pa.Array) -> pa.Array:
        return pa.array([one(h) for h in c.to_pylist()], pa.struct([("success", pa.bool_()), ("error", pa.string()), ("title", pa.string()), ("content", pa.string())]))

    return run(column)
