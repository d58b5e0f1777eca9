"""Text transforms as column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Unicode counts as white space, for Java's expressions.
_WS = r"\s\x{1c}-\x{1f}\x{85}\x{a0}"


def strip(c: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(c, rf"(?U)^[{_WS}]+|[{_WS}]+\z", "")


def clean_lines(c: Column) -> Column:
    """Without a byte-order mark; each line stripped; at most one blank line in a row."""
    c = strip(F.regexp_replace(c, r"^\x{feff}+", ""))
    return F.regexp_replace(F.array_join(F.transform(F.split(c, "\r\n|\n|\r"), strip), "\n"), "\n{3,}", "\n\n")


def clean_markdown(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"^\x{feff}+", ""))


def clean_web(c: Column) -> Column:
    """One kind of line end, single spaces, at most one blank line, ends trimmed."""
    c = F.regexp_replace(F.regexp_replace(c, "\r\n?", "\n"), "[ \t]+", " ")
    return strip(F.regexp_replace(c, "\n{3,}", "\n\n"))


def file_name(c: Column) -> Column:
    """Fit to be a file's name; ``untitled`` if nothing is left."""
    c = F.regexp_replace(strip(F.regexp_replace(c, r'[\\/:*?"<>|]', "_")), r"\.+$", "")
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("untitled"))


def chapter_id(book: Column, file: Column, index: Column) -> Column:
    return F.concat(F.lit("nch_"), F.substring(F.sha1(F.concat_ws("|", book, file, index.cast("string"))), 1, 20))


def chunk_id(file: Column, chapter: Column, index: Column) -> Column:
    return F.concat(F.substring(file, 1, 10), F.lit("_ch"), chapter.cast("string"), F.lit("_"), F.format_string("%04d", index), F.md5(file))


def shrink(text: Column, level: Column | int) -> Column:
    """The text's first half, a level at a time."""
    level = F.lit(level) if isinstance(level, int) else level
    return F.substring(text, F.lit(1), F.floor(F.length(text) / F.pow(F.lit(2), level)).cast("int"))


def first_class(text: Column, rules: Sequence[tuple[str, Sequence[str]]], default: str) -> Column:
    """The first class with a keyword in the text."""
    any_word = lambda words: reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])
    out = F.lit(default)
    for name, words in reversed(list(rules)):
        out = F.when(any_word(words), F.lit(name)).otherwise(out)
    return out


#: Intents in the order that decides, with their keywords; the last is the default.
INTENTS = (
    ("投诉", ("投诉", "差评", "太差", "垃圾", "气死", "欺诈", "虚假宣传", "被骗", "诈骗", "坑人", "骗子", "态度差", "客服不回复", "举报", "投诉电话", "黑心", "赔偿", "要求道歉")),
    ("售后问题", ("退货", "退款", "换货", "维修", "保修", "发票", "物流", "快递", "发货", "补发", "破损", "少件", "安装", "售后", "售后电话", "联系客服", "客服热线", "售后政策")),
    ("产品咨询", ("价格", "多少钱", "购买", "怎么买", "套餐", "功能", "产品", "优惠", "活动", "折扣", "介绍", "区别", "版本", "试用", "订阅", "收费", "支持哪些", "有什么", "政策", "怎么样")),
    ("闲聊", ("你好", "在吗", "谢谢", "再见", "你是谁", "你叫什么", "吃了吗", "哈哈", "天气", "无聊", "辛苦了", "早安", "晚安", "hello", "hi", "在干嘛")),
)
DEFAULT_INTENT = "其他"
#: Phrases that ask for an answer without search.
NO_SEARCH = (
    r"不调用知识库|不要调用知识库|不用调用知识库|不需要知识库|不要用知识库|不用知识库|无需知识库|用模型知识|用模型自身知识|用模型自己的知识|用自身知识|"
    r"用你自己的知识|用你的知识|用你的自身知识|靠模型知识|靠自身知识|靠你自己的知识|靠你的知识|凭模型知识|凭自身知识|凭你自己的知识|凭你的知识|"
    r"基于模型知识|基于自身知识|基于你自己的知识|基于你的知识|自由回答|不查知识库|不查资料|不检索|不用检索|不要检索|don'?t use rag|no rag|不用rag|不开知识库"
)


def wants_search(c: Column) -> Column:
    return ~F.coalesce(c, F.lit("")).rlike(NO_SEARCH)


#: What a phone number and an e-mail address look like.
PHONE, EMAIL = r"^1\d{10}$", r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"


def highlighted(text: Column, terms: Sequence[str], begin: str = "<mark>", end: str = "</mark>") -> Column:
    """Each term marked, the longest first."""
    from re import escape

    words = sorted({t for t in terms if t}, key=len, reverse=True)
    return F.regexp_replace(text, "(" + "|".join(map(escape, words)) + ")", f"{begin}$1{end}") if words else text


def confidence_bucket(c: Column) -> Column:
    return F.when(c.isNull(), "unreviewed").when(c < 0.6, "low").otherwise("ok")
