"""Records of any shape to sections: a walk over VARIANT values, and the hierarchy put together again from its leaves.

A record is one JSON text. Spark explodes it down to its items (an article, an addendum, an annex) without a shuffle, and
``leaves`` walks each item: each leaf has the names it lies under (null for a place in a list) and its places, so that
order and depth are columns. Neighbouring leaves of an item move as one row; an item is one group, and lines, keys and
titles are array expressions inside it. So tasks hold items, and a document only as the JSON text of its row.

Defined results: null, unreadable and scalar records have no leaves; null leaves, empty lists and empty objects are
leaves without text and give no lines; one object in place of a list of objects is a list of one; a list or an object
with ``content`` in place of a text is its texts, joined by line breaks; scalars in place of items count for nothing;
items without text take no number; repeated records of an id are told apart by nothing and mix, so ids are to be unique.
"""

from __future__ import annotations

import html
import html.entities
import json
import re
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import plain_text, sections

#: Names and places below which a value is kept as JSON: articles, paragraphs, items and sub-items need eight.
DEPTH = 10
#: A text that came as an object stands under this name.
CONTENT = "content"

# Field names of the records, forms of article numbers, marks of sections.
ARTICLES, ADDENDA, ANNEXES = "조문", "부칙", "별표"
ARTICLE_NUMBER = r"제\s*\d+(?:-\d+)?조(?:의\s*\d+)?"
ARTICLE_NUMBER_LOOSE = r"제\s*\d+-\d+(?:의\s*\d+)?(?=\s*\()"


#: A character reference that ends as it should.
_CLOSED = re.compile(r"&(?:#\d+|#[xX][0-9a-fA-F]+|[a-zA-Z]\w*);", re.ASCII)


def _closed_alone(text: str) -> str:
    return _CLOSED.sub(lambda m: html.unescape(m[0]) if m[0][1] == "#" or m[0][1:] in html.entities.html5 else m[0], text)


def unescaped(text: Column, closed: bool = False) -> Column:
    """All character references of HTML decoded once, those of the whole entity table; texts without ``&`` stay as they are.

    ``closed``: only those that end with a semicolon; ``&amp`` at the end of a text that was cut off stays.
    """
    decode = _closed_alone if closed else html.unescape

    @F.arrow_udf("string")
    def decoded(texts: pa.Array) -> pa.Array:
        return _decoded(texts, decode)

    return decoded(text)


def _decoded(texts: pa.Array, decode: Callable[[str], str]) -> pa.Array:
    return pa.array([t if t is None or "&" not in t else decode(t) for t in texts.to_pylist()], pa.string())


#: Levels that Spark explodes; what lies below, one item of a list at the most, is walked in its task.
EXPLODED = 2
#: Leaves that a task gathers before it passes them on.
GATHERED = 20_000
_ESCAPES = {i: f"\\u{i:04X}" for i in range(32)} | {ord(c): "\\" + e for c, e in zip('"\\\b\f\n\r\t', '"\\bfnrt')}


class _Number(str):
    """A number as the record's canonical JSON has it."""


def _json(value) -> str:
    """``value`` as ``to_json`` writes it."""
    if isinstance(value, _Number):
        return str(value)
    if isinstance(value, str):
        return '"' + value.translate(_ESCAPES) + '"'
    if value is None or isinstance(value, bool):
        return "null" if value is None else str(value).lower()
    parts = []
    for x in value:
        parts.append(f"{_json(x)}:{_json(value[x])}" if isinstance(value, dict) else _json(x))
    return ("{%s}" if isinstance(value, dict) else "[%s]") % ",".join(parts)


def _nodes(records: DataFrame, doc: str, raw: str, depth: int) -> DataFrame:
    """(doc, names, at, text, below): the values ``EXPLODED`` levels down; ``below`` is the JSON of those that are nested."""
    spark = records.sparkSession
    rows = records.select(F.col(doc).alias("doc"), F.try_parse_json(raw).alias("v"), F.array().cast("array<string>").alias("names"), F.array().cast("array<int>").alias("at"))
    rows = rows.where("v is not null")
    for _ in range(min(depth, EXPLODED)):
        below = spark.tvf.variant_explode_outer(F.col("v").outer())
        rows = rows.lateralJoin(below, how="left").select(
            "doc", F.coalesce("value", "v").alias("v"),
            F.when(F.col("pos").isNull(), F.col("names")).otherwise(F.concat("names", F.array("key"))).alias("names"),
            F.when(F.col("pos").isNull(), F.col("at")).otherwise(F.concat("at", F.array("pos"))).alias("at"),
        )
    nested = F.schema_of_variant("v").rlike("^(ARRAY|OBJECT)")
    return rows.where(F.size("at") > 0).select("doc", "names", "at", F.when(~nested, F.try_variant_get("v", "$", "string")).alias("text"), F.when(nested, F.to_json("v")).alias("below"))


def _walked(depth: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of ``_nodes`` to leaves, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 5_000))  # as deep as Spark reads JSON
        read = json.JSONDecoder(parse_int=_Number, parse_float=_Number).decode
        for batch in batches:
            rows, names, at, ends, texts = [], [], [], [0], []

            def leaf(n: tuple, a: tuple, text: str | None) -> None:
                names.extend(n)  # noqa: B023
                at.extend(a)  # noqa: B023
                ends.append(len(at))  # noqa: B023
                texts.append(text)  # noqa: B023

            def walk(value, n: tuple, a: tuple) -> None:
                if isinstance(value, str) or value is None:
                    leaf(n, a, value)
                elif isinstance(value, bool):
                    leaf(n, a, "true" if value else "false")
                elif not value:
                    leaf(n, a, None)
                elif len(a) == depth:
                    leaf(n, a, _json(value))
                elif isinstance(value, dict):
                    for i, k in enumerate(value):
                        walk(value[k], (*n, k), (*a, i))
                else:
                    n = (*n, None)
                    for i, x in enumerate(value):
                        walk(x, n, (*a, i))

            def gathered() -> pa.RecordBatch:
                bounds = pa.array(ends, pa.int32())  # noqa: B023
                lists = pa.ListArray.from_arrays(bounds, pa.array(names, pa.string())), pa.ListArray.from_arrays(bounds, pa.array(at, pa.int32()))  # noqa: B023
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *lists, pa.array(texts, pa.string())], ["doc", "names", "at", "text"])  # noqa: B023

            columns = [batch.column(i).to_pylist() for i in range(1, 5)]
            for row, (n, a, text, below) in enumerate(zip(*columns)):
                walk(text if below is None else read(below), tuple(n), tuple(a))
                rows.extend([row] * (len(texts) - len(rows)))
                if len(texts) >= GATHERED:
                    yield gathered()
                    rows, names, at, ends, texts = [], [], [], [0], []
            yield gathered()

    return run


def leaves(records: DataFrame, doc: str, raw: str, depth: int = DEPTH) -> DataFrame:
    """(doc, names, at, text): every leaf of the JSON text ``raw``, in the order of ``at`` (names of an object: by name)."""
    rows = _nodes(records, doc, raw, depth)
    return rows.mapInArrow(_walked(depth), f"doc {rows.schema['doc'].dataType.simpleString()}, names array<string>, at array<int>, text string")


@dataclass(frozen=True)
class Part:
    """A list of items in a record: the texts of an item (the first that is there), and of the lists nested in it.

    ``levels``: (list, text) from the outermost; a list without a text field holds texts themselves.
    """

    field: str
    texts: tuple[str, ...]
    levels: tuple[tuple[str, str | None], ...] = ()


@dataclass(frozen=True)
class _Shape:
    """What all leaves under the same names are to their item; places are positions in ``at``, below 0 fixed values."""

    part: str
    item: int
    order: tuple[int, ...]
    depth: int
    field: str | None
    is_line: bool


#: Places of leaves outside of a list, and where one object stands for it.
_OUTSIDE, _ALONE = -1, -2


def _place(names: list[str | None], field: str) -> int:
    """Where ``at`` has the place in the list ``field``."""
    if field not in names:
        return _OUTSIDE
    p = names.index(field) + 1
    return p if len(names) > p and names[p] is None else _ALONE


def _shape(names: list[str | None], parts: dict[str, Part], width: int) -> _Shape | None:
    """None for names that are no item's."""
    part = parts[names[0]]
    below = [n for n in names if n is not None][1 : DEPTH + 1]
    if not below and len(names) <= 2:
        return None
    lists = [field for field, _ in part.levels]
    depth = max(i for i in range(len(lists) + 1) if below[:i] == lists[:i])
    rest = below[depth:]
    if rest and rest[-1] == CONTENT:
        rest.pop()
    own = part.levels[depth - 1][1] if depth else None
    order = [_place(names, f) for f in lists]
    return _Shape(part.field, _place(names, part.field), (*order, *[_OUTSIDE] * (width - len(order))), depth, rest[0] if depth == 0 and len(rest) == 1 else None, depth > 0 and rest == ([] if own is None else [own]))


def _classified(parts: list[Part]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(doc, names, at, text) to (doc, part, item, leaves): names are few, so each shape is looked at once a batch."""
    by_field, width = {p.field: p for p in reversed(parts)}, max(len(p.levels) for p in parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, at = batch.column(1), batch.column(2)
            coded = names.values.dictionary_encode()
            words, bounds = [*coded.dictionary.to_pylist(), None], names.offsets.to_numpy()
            codes = coded.indices.fill_null(len(words) - 1).to_numpy()
            raw, seen = codes.astype("<i4").tobytes(), {}
            kinds = np.array([seen.setdefault(raw[4 * a : 4 * b], len(seen)) for a, b in pairwise(bounds.tolist())], np.int32)
            shapes = [_shape([words[c] for c in np.frombuffer(k, "<i4")], by_field, width) for k in seen]
            kept = np.flatnonzero(np.array([s is not None for s in shapes], bool)[kinds])
            shapes = [s or _Shape("", 0, (_OUTSIDE,) * width, 0, None, False) for s in shapes]
            kinds, rows = kinds[kept], pa.array(kept)
            first, places = at.offsets.to_numpy()[:-1][kept], np.append(at.values.to_numpy(), 0)

            def placed(values: list[int], kinds=kinds, first=first, places=places) -> np.ndarray:
                p = np.array(values, np.int64)[kinds]
                return np.where(p >= 0, places[np.where(p >= 0, first + p, 0)], np.where(p == _OUTSIDE, -1, 0))

            def of_shape(values: list, kind: pa.DataType, kinds=kinds) -> pa.Array:
                return pa.array(values, kind).take(pa.array(kinds))

            order = np.stack([placed([s.order[i] for s in shapes]) for i in range(width)], 1).astype(np.int32) if width else np.zeros((len(kept), 0), np.int32)
            order = pa.ListArray.from_arrays(pa.array(np.arange(len(kept) + 1, dtype=np.int32) * width), pa.array(order.reshape(-1)))
            leaf = [
                order, at.take(rows), of_shape([s.depth for s in shapes], pa.int32()), of_shape([s.field for s in shapes], pa.string()),
                of_shape([s.is_line for s in shapes], pa.bool_()), _decoded(batch.column(3).take(rows), html.unescape),
            ]
            leaf = pa.StructArray.from_arrays(leaf, ["order", "at", "depth", "field", "is_line", "text"])
            part, item = of_shape([s.part for s in shapes], pa.string()), np.maximum(placed([s.item for s in shapes]), 0).astype(np.int64) + 1
            doc, alone = batch.column(0).take(rows), np.array([x.part for x in shapes])[kinds] if len(kept) else np.array([], str)
            # neighbours of one item move as one row
            docs = doc.dictionary_encode(null_encoding="encode").indices.to_numpy()
            begins = np.flatnonzero(np.append(True, (docs[1:] != docs[:-1]) | (alone[1:] != alone[:-1]) | (item[1:] != item[:-1]))[: len(kept)])
            runs = pa.ListArray.from_arrays(pa.array(np.append(begins, len(kept)).astype(np.int32)), leaf)
            yield pa.RecordBatch.from_arrays([doc.take(pa.array(begins)), part.take(pa.array(begins)), pa.array(item[begins]), runs], ["doc", "part", "item", "leaves"])

    return run


def items(records: DataFrame, doc: str, raw: str, parts: list[Part], indent: str = "  ") -> DataFrame:
    """(doc, part, item, fields, body) of every item of ``parts``, from 1 in each: its own fields flattened, and its lines.

    ``body`` has the item's text, then what is nested in it, each level further indented, in the record's order.
    """
    def of_part(value: Callable[[Part], Column]) -> Column:
        out = None
        for p in parts:
            out = F.when(F.col("part") == p.field, value(p)) if out is None else out.when(F.col("part") == p.field, value(p))
        return out

    walked, classified = _walked(DEPTH), _classified(parts)
    rows = _nodes(records, doc, raw, DEPTH).where(F.get("names", F.lit(0)).isin(*[p.field for p in parts]))
    leaf = "struct<order: array<int>, at: array<int>, depth: int, field: string, is_line: boolean, text: string>"
    rows = rows.mapInArrow(lambda batches: classified(walked(batches)), f"doc {rows.schema['doc'].dataType.simpleString()}, part string, item long, leaves array<{leaf}>")
    grouped = rows.groupBy("doc", "part", "item").agg(F.sort_array(F.flatten(F.collect_list("leaves"))).alias("leaves"))
    texts = lambda keep: F.filter(F.transform(F.filter("leaves", keep), lambda x: x["text"]), lambda t: F.coalesce(t, F.lit("")) != "")
    named = F.array_distinct(F.filter(F.transform("leaves", lambda x: x["field"]), lambda f: f.isNotNull()))
    fields = F.map_from_arrays(named, F.transform(named, lambda f: F.array_join(texts(lambda x: x["field"] == f), "\n")))
    lines = F.filter("leaves", lambda x: x["is_line"] & (F.coalesce(x["text"], F.lit("")) != ""))
    grouped = grouped.select("doc", "part", "item", fields.alias("fields"), lines.alias("lines"))
    first = of_part(lambda p: F.coalesce(*[F.nullif(F.try_element_at("fields", F.lit(t)), F.lit("")) for t in p.texts]))
    # a text that came as a list is indented once, at its first line
    before = lambda x, i: F.when(i > 0, F.get("lines", i - 1)["order"] == x["order"]).otherwise(False)
    shifted = F.transform("lines", lambda x, i: F.concat(F.when(before(x, i), "").otherwise(F.repeat(F.lit(indent), x["depth"])), x["text"]))
    body = F.array_join(F.concat(F.filter(F.array(first), lambda t: t.isNotNull()), shifted), "\n")
    return grouped.select("doc", "part", "item", "fields", T.unicode_strip(body).alias("body"))


def _field(*names: str) -> Column:
    """The first of the fields that is not empty; null if none is."""
    return F.coalesce(*[F.nullif(T.unicode_strip(F.try_element_at("fields", F.lit(n))), F.lit("")) for n in names])


def _branch(name: str) -> Column:
    value = _field(name)
    return F.when(value.isNull() | value.isin("0", "00"), "").otherwise(F.concat(F.lit("의"), value))


def _matched(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_replace(F.regexp_extract(F.coalesce(text, F.lit("")), pattern, 0), r"\s", ""), F.lit(""))


def numbered_key(number: str, branch: str, text: str) -> Column:
    """The key of an article by its number fields, else by the number its text has, else by its place."""
    by_field = F.concat(F.lit("제"), _field(number), F.lit("조"), _branch(branch))
    return F.coalesce(by_field, _matched(_field(text), ARTICLE_NUMBER), _by_place())


def titled_key(title: str) -> Column:
    """The key of an article by the number in its title, also where the title lacks the word for article, else by its place."""
    return F.coalesce(_matched(_field(title), ARTICLE_NUMBER), _matched(_field(title), ARTICLE_NUMBER_LOOSE), _by_place())


def _by_place() -> Column:
    return F.concat(F.lit("조문"), T.padded(F.col("item").cast("string")))


@dataclass(frozen=True)
class Reading:
    """How items of a part become sections."""

    part: Part
    kind: str
    key: Callable[[], Column]
    title: Callable[[], Column]
    body: Callable[[], Column] = lambda: F.col("body")


def _files(*names: str) -> Column:
    return F.array_join(F.filter(F.array(*[_field(n) for n in names]), lambda f: f.isNotNull()), " / ")


_NESTED = (("항", "항내용"), ("호", "호내용"), ("목", None))
_STATUTE = (
    Reading(Part(ARTICLES, ("조문내용", "조내용"), _NESTED), "조문", lambda: numbered_key("조문번호", "조문가지번호", "조문내용"), lambda: _field("조문제목")),
    Reading(
        Part(ADDENDA, ("내용",)), "부칙", lambda: F.concat(F.lit("부칙"), F.col("item").cast("string")),
        lambda: T.unicode_strip(F.concat(F.lit("부칙 "), F.coalesce(_field("공포일자"), F.lit("")), F.lit(" 제"), F.coalesce(_field("공포번호"), F.lit("")), F.lit("호"))),
    ),
    Reading(
        Part(ANNEXES, ("내용",)), "별표",
        lambda: F.concat(F.lit("["), F.coalesce(_field("구분"), F.lit("별표")), F.coalesce(_field("별표번호"), F.lit("")), _branch("별표가지번호"), F.lit("]")), lambda: _field("제목"),
        lambda: F.coalesce(F.nullif("body", F.lit("")), F.concat(F.lit("(본문 텍스트 없음 · 원본 파일: "), F.coalesce(F.nullif(_files("저장PDF", "저장HWP"), F.lit("")), F.lit("없음")), F.lit(")"))),
    ),
)
_OUTLINE = (
    Reading(Part(ARTICLES, ("조내용",)), "조문", lambda: titled_key("조제목"), lambda: _field("조제목"), lambda: F.concat_ws("\n", _field("조제목"), F.nullif("body", F.lit("")))),
    Reading(Part(ADDENDA, ("내용",)), "부칙", lambda: F.concat(F.lit("부칙"), F.col("item").cast("string")), lambda: _field("부칙명")),
    Reading(
        Part(ANNEXES, ("파일명",)), "별표",
        lambda: F.concat(F.lit("["), F.coalesce(_field("구분"), F.lit("별표")), F.coalesce(_field("번호"), F.lit("")), F.lit("]")), lambda: _field("파일명"),
        lambda: F.concat(F.lit("(첨부 파일: "), F.coalesce(_field("파일명"), F.lit("")), F.lit(")"), F.when(_field("삭제여부") == "true", " · 삭제됨").otherwise("")),
    ),
)
#: Kinds of records, and the field of those that are one plain text.
READINGS = {"law": _STATUTE, "admrul": _STATUTE, "kofia": _OUTLINE}
PLAIN_FIELD = "본문"


def record_sections(records: DataFrame, doc: str, raw: str, kind: str) -> DataFrame:
    """(doc, seq, section_key, section_type, title, content, content_hash) of JSON records of one ``kind``.

    Kinds without a reading of their own hold one text, which is cut by its headings. A key that comes again in a
    document is ``key#2``; sections without content take no number.
    """
    if kind not in READINGS:
        body = F.try_variant_get(F.try_parse_json(raw), f"$['{PLAIN_FIELD}']", "string")
        return _plain(records.select(F.col(doc).alias("doc"), body.alias("text")))
    readings = READINGS[kind]
    found = items(records, doc, raw, [r.part for r in readings])

    def chosen(value: Callable[[Reading], Column]) -> Column:
        out = F.lit(None)
        for r in readings:
            out = F.when(F.col("part") == r.part.field, value(r)).otherwise(out)
        return out

    place = F.struct(chosen(lambda r: F.lit(readings.index(r))).alias("part"), F.col("item"))
    rows = found.select("doc", place.alias("pos"), chosen(lambda r: r.key()).alias("key"), chosen(lambda r: F.lit(r.kind)).alias("section_type"), chosen(lambda r: r.title()).alias("title"), T.unicode_strip(chosen(lambda r: r.body())).alias("content"))
    # each row is made once: a filter on it would be pushed down, with all that its columns are made of, once for each mention of a field
    return _finished(rows.select(F.inline(F.array(F.struct(*rows.columns)))))


def _finished(rows: DataFrame) -> DataFrame:
    rows = sections.unique_keys(sections.numbered(rows, F.coalesce("content", F.lit("")) != ""), "key")
    return rows.select("doc", "seq", "section_key", "section_type", "title", "content", F.sha2("content", 256).alias("content_hash"))


def _plain(docs: DataFrame) -> DataFrame:
    lines = docs.where("text is not null").select("doc", F.posexplode(T.lines(F.col("text"))).alias("pos", "line"))
    lines = lines.select("doc", (F.col("pos") + 1).cast("long").alias("pos"), "line")
    keyed = plain_text.plain_sections(lines)
    rows = keyed.groupBy("doc", "section_key").agg(F.min("pos").alias("pos"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("content"))
    kind = F.when(F.startswith("section_key", F.lit("부칙")), "부칙").when(F.startswith("section_key", F.lit("[별표")), "별표").when(F.col("section_key") == "머리말", "머리말").otherwise("조문")
    rows = rows.select("doc", "pos", F.col("section_key").alias("key"), kind.alias("section_type"), F.lit(None).cast("string").alias("title"), T.unicode_strip(F.col("content")).alias("content"))
    return _finished(rows)
