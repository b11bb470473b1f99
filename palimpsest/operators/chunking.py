"""Texts to chunks over offsets: where to cut is found from lengths, and each text is sliced once.

A cut depends on the one before it, so the places come from small Arrow functions over arrays of lengths, linear in
them; finding pieces, joining and numbering are array expressions. Texts of any length take linear time.

Defined results: null texts give no chunks; blank texts neither; a piece longer than any limit that has no place to
be cut at is cut at the limit, or kept where only whole pieces are packed.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# What opens a paragraph, an item, a sub-item; heads and cases of manuals; heads and labels of advertisements; ends of sentences.
PARAGRAPH = r"^\s*(?:[①-⑳]|\d+\.|[가-힣]\.|\(\d+\))"
SENTENCE_END = r"(?<=[.。」』\]])\s+|\n"
MANUAL_HEAD = r"^(?:[ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ]+\s*[.．]?\s*|제\s*\d+\s*[장절편]\s*|별첨\s*\d+\s*[.．]?\s*|\d{1,2}\s*[.．]\s*|[가-힣]\s*[.．]\s*|[■□◆◇○●▶]\s*)(?=\S)"
MANUAL_CASE = r"^\s*[\[［]\s*(사례|참고|예시|Q&?A)"
AD_HEAD = r"^\s*(?:[□■▶◾◆●○*※&#8251;]|\d+\.\s|[①-⑮]|[-–]\s)"
AD_LABEL = r"^[가-힣A-Za-z][가-힣A-Za-z\s및·]{1,14}$"
TARGET, MAXIMUM, HEAD_LENGTH = 900, 1400, 60


def _once(function):
    """Marked so that Spark computes it where it stands, and not again in filters that it derives from an ``explode``."""
    return function.asNondeterministic()


def _lists(name: str, compute, *columns: Column) -> Column:
    """An Arrow function of arrays, a row at a time, to an array of whole numbers."""

    @F.arrow_udf("array<int>")
    def run(*batch: pa.Array) -> pa.Array:
        return pa.array([None if row[0] is None else compute(*row) for row in zip(*(b.to_pylist() for b in batch))], pa.list_(pa.int32()))

    return _once(run)(*columns).alias(name)


def _greedy(lengths: list[int], target: int, maximum: int) -> list[int]:
    starts, size = [], 0
    for i, n in enumerate(lengths):
        if not starts or size >= target or size + n + 1 > maximum:
            starts.append(i)
            size = n
        else:
            size += n + 1
    return starts


def greedy_starts(lengths: Column, target: int, maximum: int) -> Column:
    """Where the groups of a greedy packing begin, from 0: a group is closed once it has ``target`` characters, or if the
    next piece and a break would pass ``maximum``."""
    return _lists("starts", lambda row: _greedy(row, target, maximum), lengths)


def _rising(numbers: list[int | None]) -> list[int]:
    kept, top = [], None
    for i, n in enumerate(numbers):
        if n is not None and (top is None or n > top):
            kept.append(i)
            top = n
    return kept


def rising(numbers: Column) -> Column:
    """Places of the numbers that exceed all before them, from 0; nulls are passed over."""
    return _lists("kept", _rising, numbers)


def _buffered(lengths: list[int], before: list[int], after: list[int], maximum: int) -> list[int]:
    starts, size, first = [], 0, True
    for i, n in enumerate(lengths):
        if starts and size and size + n + 1 > maximum:
            starts.append(i)
            size = n
        elif not starts or not size:
            starts = starts or [i]
            size = n
        else:
            # blanks at both ends of what is joined do not count
            size += n + 1 - after[i] - (before[starts[-1]] if first else 0)
            first = False
            continue
        first = True
    return starts


def buffered(rows: DataFrame, pieces: str, maximum: int) -> DataFrame:
    """``rows`` with each of the ``pieces`` as its buffers: its sentences gathered up to ``maximum``; pieces within it stay.

    A buffer of several sentences has no blanks at its ends, nor at the end of any but the first.
    """
    left, right = (lambda p: F.regexp_replace(p, r"(?U)^\s+", "")), (lambda p: F.regexp_replace(p, r"(?U)\s+$", ""))
    rows = rows.withColumn("_sentences", F.transform(pieces, lambda p: F.when(F.length(p) > maximum, F.filter(F.split(p, SENTENCE_END), lambda s: s != "")).otherwise(F.array(p))))
    sentences = F.col("_sentences")
    each = lambda f: F.transform(sentences, lambda row: F.transform(row, f))

    @F.arrow_udf("array<array<int>>")
    def starts(*batch: pa.Array) -> pa.Array:
        rows = [None if row[0] is None else [_buffered(*piece, maximum) for piece in zip(*row)] for row in zip(*(b.to_pylist() for b in batch))]
        return pa.array(rows, pa.list_(pa.list_(pa.int32())))

    at = _once(starts)(each(F.length), each(lambda p: F.length(p) - F.length(left(p))), each(lambda p: F.length(p) - F.length(right(p))))
    rows = rows.withColumn("_starts", at)

    several = lambda g: T.unicode_strip(F.array_join(F.concat(F.slice(g, 1, 1), F.transform(F.slice(g, F.lit(2), F.size(g) - 1), right)), "\n"))
    joined = lambda row, begins: F.transform(slices(row, begins), lambda g: F.when(F.size(g) == 1, F.get(g, F.lit(0))).otherwise(several(g)))
    return rows.withColumn(pieces, F.flatten(F.zip_with(sentences, F.col("_starts"), joined))).drop("_sentences", "_starts")


def _heads(lengths: list[int], heads: list[int], least: int) -> list[int]:
    starts, body = [], -1
    for i, (n, head) in enumerate(zip(lengths, heads)):
        if not starts:
            starts.append(0)
            body = -1 if head else n
        elif head and max(body, 0) >= least:
            starts.append(i)
            body = -1
        else:
            body += n + 1
    return starts


def head_starts(lines: Column, is_head, least: int) -> Column:
    """Where sections begin: at the first line, and at each head that has ``least`` characters of body before it."""
    return _lists("starts", lambda a, b: _heads(a, b, least), F.transform(lines, F.length), F.transform(lines, lambda x: is_head(x).cast("int")))


def _look_back(text: str, separators: tuple[tuple[str, int], ...], least: int, most: int) -> list[int]:
    """Begin and end of each piece, blanks at ends left out."""
    out, at, end = [], 0, len(text)
    while end > at and text[end - 1].isspace():
        end -= 1
    while at < end and text[at].isspace():
        at += 1
    while end - at > most:
        cut = max(text.rfind(s, at + skip, at + most) for s, skip in separators) - at
        cut = at + (most if cut < max(least, 1) else cut)
        last = cut
        while last > at and text[last - 1].isspace():
            last -= 1
        out += [at, last]
        at = cut
        while at < end and text[at].isspace():
            at += 1
    return out + [at, end]


def looked_back(text: Column, separators: tuple[tuple[str, int], ...], least: int, most: int) -> Column:
    """``text`` in pieces of up to ``most`` characters, each cut at the last separator in reach, or at ``most`` if that
    would leave less than ``least``. A separator may not stand among the first characters that its number says."""

    @F.arrow_udf("array<string>")
    def run(texts: pa.Array) -> pa.Array:
        rows = []
        for t in texts.to_pylist():
            at = None if t is None else _look_back(t, separators, least, most)
            rows.append(None if at is None else [t[a:b] for a, b in zip(at[0::2], at[1::2])])
        return pa.array(rows, pa.list_(pa.string()))

    return _once(run)(text)


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, and arrays of it held as objects, of which ``slice`` copies only its part."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _same(array: Column) -> Column:
    return F.transform(array, lambda x: x)


def slices(pieces: Column, starts: Column) -> Column:
    """The groups of ``pieces`` that begin at ``starts``."""

    def cut(v: Column) -> Column:
        ends = F.concat(F.slice(v["starts"], F.lit(2), F.greatest(F.size(v["starts"]) - 1, F.lit(0))), F.array(F.size(v["pieces"])))
        return F.zip_with(v["starts"], ends, lambda a, b: F.slice(v["pieces"], a + 1, b - a))

    return F.when(starts.isNotNull(), _let(F.struct(_same(pieces).alias("pieces"), _same(starts).alias("starts")), cut))


def sliced(pieces: Column, starts: Column, separator: str = "\n") -> Column:
    """The groups of ``pieces`` that begin at ``starts``, joined."""
    return F.transform(slices(pieces, starts), lambda g: F.array_join(g, separator))


def starts_where(lines: Column, opens) -> Column:
    """0, and the place of every later line that ``opens``."""
    at = F.transform(lines, lambda x, i: F.when((i == 0) | opens(x), i))
    return F.filter(at, lambda i: i.isNotNull())


def full_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: T.unicode_strip(x) != "")


def stripped_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), T.unicode_strip), lambda x: x != "")


def article_chunks(sections: DataFrame, target: int = TARGET, maximum: int = MAXIMUM, boundary: str = PARAGRAPH) -> DataFrame:
    """(reg, seq, key, part, parts, id, chunk, chars, sha) of sections (reg, seq, key, title, text).

    A text over ``maximum`` is cut before paragraphs, items and sub-items; such a piece that is still too long is cut
    after sentences, which are gathered again; all are packed. Every chunk begins with a line that says where it is from.
    The second section of a key of a regulation is ``key@2``.
    """
    rows = sections.where(F.length("text") > 0).select("reg", "seq", "key", "title", "text")
    occurrence = F.row_number().over(Window.partitionBy("reg", "key").orderBy("seq"))
    rows = rows.withColumn("occ", occurrence).withColumn("lines", F.when(F.length("text") > maximum, full_lines(F.col("text"))))
    rows = rows.withColumn("pieces", sliced(F.col("lines"), starts_where(F.col("lines"), lambda x: x.rlike(boundary))))
    packs = buffered(rows, "pieces", maximum)
    packs = packs.withColumn("starts", greedy_starts(F.transform("pieces", F.length), target, maximum))
    packs = packs.withColumn("packs", F.when(F.length("text") <= maximum, F.array("text")).otherwise(sliced(F.col("pieces"), F.col("starts"))))
    label = F.concat(F.lit("["), F.coalesce("reg", F.lit("")), F.lit("] "), F.coalesce("key", F.lit("")), F.when(F.coalesce("title", F.lit("")) != "", F.concat(F.lit("("), F.col("title"), F.lit(")"))).otherwise(""))
    out = packs.select("reg", "seq", "key", "occ", label.alias("label"), F.size("packs").alias("parts"), F.posexplode("packs").alias("n", "body"))
    place = F.when(F.col("parts") > 1, F.concat(F.lit(" ("), (F.col("n") + 1).cast("string"), F.lit("/"), F.col("parts").cast("string"), F.lit(")"))).otherwise("")
    chunk = F.concat(T.unicode_strip(F.concat("label", place)), F.lit("\n"), F.col("body"))
    base = F.concat(F.coalesce("reg", F.lit("")), F.lit("#"), F.coalesce("key", F.lit("")), F.when(F.col("occ") > 1, F.concat(F.lit("@"), F.col("occ").cast("string"))).otherwise(""))
    out = out.withColumn("chunk", chunk)
    return out.select("reg", "seq", "key", (F.col("n") + 1).cast("long").alias("part"), F.col("parts").cast("long").alias("parts"), F.concat(base, F.lit("#"), (F.col("n") + 1).cast("string")).alias("id"), "chunk", F.length("chunk").cast("long").alias("chars"), F.substring(F.sha2("chunk", 256), 1, 16).alias("sha"))


def manual_sections(texts: DataFrame, doc: str, text: str = "text", least: int = 120, most: int = MAXIMUM, head: str = MANUAL_HEAD, case: str = MANUAL_CASE) -> DataFrame:
    """(doc, seq, title, body) of manuals: heads and cases open a section once the one before has ``least`` characters;
    bodies over ``most`` are cut at line ends."""
    is_head = lambda x: (x.rlike(head) & (F.length(x) <= HEAD_LENGTH)) | x.rlike(case)
    rows = texts.select(F.col(doc).alias("doc"), stripped_lines(F.col(text)).alias("lines")).where(F.size("lines") > 0)
    rows = rows.withColumn("starts", head_starts(F.col("lines"), is_head, least))
    parts = rows.select("doc", F.posexplode(slices(F.col("lines"), F.col("starts"))).alias("at", "part"))
    titled = is_head(F.col("part")[0])
    parts = parts.select("doc", "at", F.when(titled, F.col("part")[0]).otherwise("").alias("title"), F.array_join(F.when(titled, F.slice("part", F.lit(2), F.greatest(F.size("part") - 1, F.lit(0)))).otherwise(F.col("part")), "\n").alias("body"))
    pieces = parts.select("doc", "at", "title", F.posexplode(looked_back(F.col("body"), (("\n", 0),), least, most)).alias("n", "body"))
    seq = F.row_number().over(Window.partitionBy("doc").orderBy("at", "n")).cast("long")
    return pieces.where("title <> '' or body <> ''").withColumn("seq", seq).select("doc", "seq", "title", "body")


def ad_pieces(texts: DataFrame, doc: str, text: str = "text", least: int = 25, most: int = 600, shortest: int = 10, head: str = AD_HEAD, label: str = AD_LABEL) -> DataFrame:
    """(doc, seq, piece) of advertisements: heads and labels open a piece, short ones go to the one before, long ones are
    cut after a sentence, before a note or at a line end."""
    rows = texts.select(F.col(doc).alias("doc"), stripped_lines(F.col(text)).alias("lines")).where(F.size("lines") > 0)
    rows = rows.withColumn("parts", sliced(F.col("lines"), starts_where(F.col("lines"), lambda x: x.rlike(head) | x.rlike(label))))
    rows = rows.withColumn("merged", sliced(F.col("parts"), starts_where(F.col("parts"), lambda p: F.length(p) >= least)))
    pieces = rows.select("doc", F.posexplode("merged").alias("at", "part")).select("doc", "at", F.posexplode(looked_back(F.col("part"), ((". ", 0), ("※", 1), ("\n", 0)), least, most)).alias("n", "piece"))
    pieces = pieces.where(F.length("piece") >= shortest)
    seq = F.row_number().over(Window.partitionBy("doc").orderBy("at", "n")).cast("long")
    return pieces.withColumn("seq", seq).select("doc", "seq", "piece")
