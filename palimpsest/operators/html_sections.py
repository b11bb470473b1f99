"""HTML bodies to sections: a page is a stream of tokens, and what a tag parser remembers is a window over them.

``tokens`` cuts a page into comments, scripts, tags and texts in one regular expression and explodes them in order.
Sections are runs between marks (opening tags that begin something); a mark's number is a running count. Texts are put
together by section. Statute pages need more state (chapters, cells, addenda) and are read page by page inside their
tasks, so that no token is shuffled, sorted or spilled.

Defined results: null and empty pages have no rows; comments, scripts and styles are no text; unclosed tags end where
the next one begins; a ``<`` that opens nothing is text; character references are decoded once, after tags are gone;
sections without text take no number; a page without marks is one section of the first kind.
"""

from __future__ import annotations

import html as html_entities
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions import text as T
from .records import unescaped

TOKEN = r"(?is)<!--.*?(?:-->|$)|<script\b.*?(?:</script\s*>|$)|<style\b.*?(?:</style\s*>|$)|</?[a-z!][^>]*+>?|[^<]++|<"
SILENT = r"(?i)^<(!|script\b|style\b)"

# Classes of the parts of a statute page, the anchor of its attachments, forms of numbers and dates.
ATTACHMENTS = r'(?i)<a\s+name="inclosure"|\[\s*별표\s*/\s*서식\s*파일\s*\]'
CHAPTER, SECTION, ARTICLE, ADDENDA = "chapter", "section", "JO", "addenda"
BREAKS = r'(?i)^<(br\b|tr\b|div\b[^>]*class="(?:hang|ho|dann|none)")'
NUMBERED = r"^제\s*\d+(?:-\d+)?조"
RETITLED = "제목개정"
ROMAN = r"^([ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ]+|[IVX]{1,4})[.\s]\s*(.{0,60})$"
ITEM = r"^\d{1,2}\.\s*.{0,60}$"
PREAMBLE = "머리말"
#: Pages of which a task holds the sections at a time.
_PAGES = 256
DATE = r"(\d{4})\s*\.\s*(\d{1,2})\s*\.\s*(\d{1,2})"


def cut_at(html: Column, anchor: str = ATTACHMENTS) -> Column:
    """What stands before the first match of ``anchor``."""
    at = F.regexp_instr(html, F.lit(anchor))
    return F.when(at > 0, F.substring(html, F.lit(1), at - 1)).otherwise(html)


def tokens(pages: DataFrame, doc: str, html: Column) -> DataFrame:
    """(doc, pos, token, tag): ``tag`` is the lower-case name of a tag, with ``/`` before a closing one; null for texts."""
    rows = pages.select(F.col(doc).alias("doc"), F.posexplode(F.regexp_extract_all(html, F.lit(TOKEN), F.lit(0))).alias("pos", "token"))
    tag = F.lower(F.regexp_extract("token", r"^<(/?[a-zA-Z][\w-]*)", 1))
    return rows.where(~F.col("token").rlike(SILENT)).select("doc", F.col("pos").cast("long").alias("pos"), "token", F.nullif(tag, F.lit("")).alias("tag"))


def by_marks(found: DataFrame, marks: dict[str, str]) -> DataFrame:
    """Tokens with ``mark``, the number of their section (0 before the first), and ``kind``, by what opened it.

    ``marks``: a pattern of opening tags for each kind.
    """
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(marks.items()):
        kind = F.when(F.col("token").rlike(pattern), name).otherwise(kind)
    so_far = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = found.withColumn("opens", kind)
    return rows.withColumns({"mark": F.count("opens").over(so_far), "kind": F.last("opens", ignorenulls=True).over(so_far)})


def _joined(piece: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("pos"), piece.alias("piece")))), lambda x: x["piece"]), "")


def _lines(text: Column) -> Column:
    """Lines without blanks at their ends and with single ones inside, without empty lines."""
    plain = F.regexp_replace(F.translate(text, "\u00a0", " "), r"[ \t]+", " ")
    return F.filter(F.transform(F.split(plain, "\n"), T.unicode_strip), lambda x: x != "")


def section_texts(pages: DataFrame, doc: str, html: Column, marks: dict[str, str], breaks: str = BREAKS, closed: bool = False) -> DataFrame:
    """(doc, seq, kind, text): the sections of a page that have text, in order, tags out and lines broken at ``breaks``.

    ``closed``: character references without their semicolon are text.
    """
    rows = by_marks(tokens(pages, doc, html), marks)
    piece = F.when(F.col("tag").isNull(), F.col("token")).when(F.col("token").rlike(breaks), "\n").otherwise("")
    first = next(iter(marks))
    joined = rows.groupBy("doc", "mark", "kind").agg(_joined(piece).alias("text"))
    texts = joined.withColumn("text", unescaped(F.col("text"), closed)).select("doc", "mark", F.coalesce("kind", F.lit(first)).alias("kind"), F.array_join(_lines(F.col("text")), "\n").alias("text"))
    seq = F.row_number().over(Window.partitionBy("doc").orderBy("mark")).cast("long")
    return texts.where("text <> ''").withColumn("seq", seq).select("doc", "seq", "kind", "text")


def _of_class(name: str) -> str:
    return rf'(?i)^<div[^>]*class="{name}"'


_tokens_of = re.compile(TOKEN, re.ASCII).finditer
_silent = re.compile(SILENT, re.ASCII).match
_tag_of = re.compile(r"<(/?[a-zA-Z][\w-]*)", re.ASCII).match
_break = re.compile(BREAKS, re.ASCII).match
_attachments = re.compile(ATTACHMENTS, re.ASCII).search
_opening = {k: re.compile(_of_class(k), re.ASCII).match for k in (CHAPTER, SECTION, ARTICLE, ADDENDA)}
_head = re.compile(_of_class("article"), re.ASCII).match
_numbered = re.compile(NUMBERED, re.ASCII).match
_roman, _item = (re.compile(x.replace(".{", r"[^\n\r\x85\u2028\u2029]{"), re.ASCII).match for x in (ROMAN, ITEM))
_line_end = re.compile(r"(br|/p|/div|/tr|/li|/h\d|/td|/th)", re.ASCII).fullmatch
#: What ``T.unicode_strip`` takes off.
_WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_blanks = re.compile(r"[ \t]+")


def _stream(text: str) -> Iterator[tuple[str, str | None]]:
    """(token, tag) as ``tokens`` gives them."""
    for found in _tokens_of(text):
        token = found[0]
        if token[0] != "<":
            yield token, None
        elif not _silent(token):
            tag = _tag_of(token)
            yield token, tag and tag[1].lower()


def _before(text: str, found: re.Match | None) -> str:
    return text[: found.start()] if found else text


def _plain_line(text: str) -> str:
    return _blanks.sub(" ", text).strip(_WHITE)


def _statute_parts(text: str) -> list[tuple[str, str | None, str]]:
    """(kind, title, body) of the marks of a page, in order: state of a tag parser, kept while tokens pass once."""
    found: list[tuple[str, dict[int, list[str]]]] = []
    kind, added = None, False
    for token, tag in _stream(text):
        opens = next((k for k, match in _opening.items() if match(token)), None) if tag and tag.startswith("div") else None
        if opens and (not added or opens == ADDENDA):
            kind, added = opens, opens == ADDENDA
            pieces: dict[int, list[str]] = {}
            found.append((kind, pieces))
            heads = shut = in_cell = False
            cells, divs = 0, 0
        if kind is None:
            continue
        if tag is not None:
            heads = heads or bool(tag.startswith("div") and _head(token))
            shut = shut or (heads and tag == "/table")
            cells, divs = cells + (tag == "td"), divs + (tag == "/div")
            in_cell = tag == "td" if tag in ("td", "/td") else in_cell
        if kind == ARTICLE and heads and not shut:
            part = cells if in_cell else -1
        else:
            part = 0 if kind in (CHAPTER, SECTION) or (kind == ADDENDA and not divs) else -2
        if part != -1:
            pieces.setdefault(part, []).append(token if tag is None else "\n" if part == -2 and _break(token) else "")
    out = []
    for kind, pieces in found:
        texts = {part: html_entities.unescape("".join(x)).replace("\u00a0", " ") for part, x in pieces.items()}
        lines = [(not _numbered(line), part, line) for part, t in texts.items() if part >= 0 and (line := _plain_line(t))]
        body = "\n".join(filter(None, map(_plain_line, texts.get(-2, "").split("\n"))))
        if texts:
            out.append((kind, min(lines)[2] if lines else None, body))
    return out


def _outline(text: str) -> list[tuple[str, str, str]]:
    """(chapter, title, body) by Roman numbers and numbered lines, before any addenda."""
    text = _before(text, _attachments(text)).partition('<div class="addenda"')[0]
    plain = html_entities.unescape("".join(token if tag is None else "\n" if _line_end(tag) else " " for token, tag in _stream(text)))
    out: list[tuple[str, str, list[str]]] = [("", "", [])]
    for line in filter(None, map(_plain_line, plain.split("\n"))):
        if roman := _roman(line):
            out.append((f"{roman[1]} {roman[2]}".strip(" "), "", []))
        elif len(line) <= 62 and _item(line):
            out.append((out[-1][0], line, []))
        else:
            out[-1][2].append(line)
    return [(chapter, title, "\n".join(body)) for chapter, title, body in out if title or body]


def _statute(text: str) -> list[tuple[str, str, str, str, str]]:
    articles, addenda, chapter, section = [], [], "", ""
    for kind, title, body in _statute_parts(_before(text, _attachments(text))):
        named = title if title is not None and not title.startswith("<") and RETITLED not in title else None
        if kind == CHAPTER and named is not None:
            chapter, section = named, ""  # a chapter ends the section before it
        elif kind == SECTION and named is not None:
            section = named
        elif kind == ADDENDA:
            addenda.append(("addenda", "", "", title or "", body))
        elif kind == ARTICLE:
            articles.append(("article", chapter, section, title if title is not None else "" if articles else PREAMBLE, body))
    if not articles:
        articles = [("article", chapter, "", title, body) for chapter, title, body in _outline(text)]
    return [x for x in articles if x[3] or x[4]] + addenda


def _by_page(pages: DataFrame, doc: str, html: str, sections: Callable[[str], list[tuple]], names: list[str]) -> DataFrame:
    """(doc, seq, *names): the sections of each page, a page at a time, in its task; nothing is shuffled or sorted."""
    rows = pages.select(F.col(doc).alias("doc"), F.col(html).alias("html")).where("html is not null")
    schema = StructType([rows.schema["doc"], StructField("seq", LongType()), *(StructField(n, StringType()) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _PAGES):
                part = batch.slice(at, _PAGES)
                found = [(i, n, *x) for i, text in enumerate(part.column(1).to_pylist()) for n, x in enumerate(sections(text), 1)]
                page, seq, *columns = zip(*found) if found else [()] * (2 + len(names))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(page, pa.int32())), pa.array(seq, pa.int64()), *(pa.array(c, pa.string()) for c in columns)], ["doc", "seq", *names])

    return rows.mapInArrow(run, schema)


def statute_sections(pages: DataFrame, doc: str, html: str) -> DataFrame:
    """(doc, seq, kind, chapter, section, title, body) of statute pages; ``kind``: article or addenda.

    An article's title is the first cell of its head that begins with a number, else the first that is not empty; an
    untitled first article is the preamble. Addenda begin at their own class and hold all after it. A page without
    articles is cut by its outline: Roman numbers are chapters, numbered lines are articles.
    """
    return _by_page(pages, doc, html, _statute, ["kind", "chapter", "section", "title", "body"])


def outline_sections(pages: DataFrame, doc: str, html: str) -> DataFrame:
    """(doc, seq, chapter, title, body): pages numbered by an outline, before any addenda.

    A Roman number opens a chapter, a numbered line of up to 62 characters an item; deeper levels stay in the body.
    """
    return _by_page(pages, doc, html, _outline, ["chapter", "title", "body"])


def last_date(title: Column) -> Column:
    """YYYYMMDD of the first dotted date of a title; null without one."""
    part = lambda i: F.regexp_extract(title, DATE, i)
    return F.when(title.rlike(DATE), F.concat(part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0")))
