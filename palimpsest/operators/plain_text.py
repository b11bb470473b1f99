"""Plain texts of statutes to keyed lines: parts, addenda, articles and annexes as windows over lines.

Rows are those of ``sections.text_lines``: (doc, pos, line). Each state of the scan is a running value of its document,
so the whole split is windows over one partitioning and one order: lines are shuffled and sorted once at most. The pass
that numbers keys takes the rows as the windows leave them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sections import keys_in_force

# How articles, annexes, addenda and their numbers and dates are written.
HEADING = r"제\s*\d+(?:-\d+)?조(?:의\d+)?|[\[<](?:별표|별지|서식|별책|첨부)[^\]>]*[\]>]|부\s*칙"
ADDENDA = r"^\s*부\s*칙"
ADDENDA_NUMBER = r"제\s*(\d+)\s*호"
DOTTED_DATE = r"(\d{4})\s*[.\-]\s*(\d{1,2})\s*[.\-]\s*(\d{1,2})"
SPOKEN_DATE = r"(\d{4})\s*년\s*(\d{1,2})\s*월\s*(\d{1,2})\s*일"
PREAMBLE = "머리말"


def addenda_name(line: Column) -> Column:
    """부칙제N호 by a promulgation number, else 부칙YYYY.MM.DD by a date, else null."""

    def dated(pattern: str) -> Column:
        part = lambda i, n: F.lpad(F.regexp_extract(line, pattern, i), n, "0")
        return F.when(line.rlike(pattern), F.concat(F.lit("부칙"), F.concat_ws(".", part(1, 4), part(2, 2), part(3, 2))))

    number = F.when(line.rlike(ADDENDA_NUMBER), F.concat(F.lit("부칙제"), F.regexp_extract(line, ADDENDA_NUMBER, 1), F.lit("호")))
    return F.coalesce(number, dated(DOTTED_DATE), dated(SPOKEN_DATE))


def plain_sections(lines: DataFrame, ahead: int = 3, behind: int = 6) -> DataFrame:
    """``lines`` with ``section_key``: the heading that each line stands under, prefixed by its addenda and its part.

    An addenda heading counts where it or one of the ``ahead`` lines after it names a number or a date; all headings
    after it are of that addenda. Outside of addenda, article 1 after a number of 3 or more begins another part, named
    by the nearest title-like line among the ``behind`` before it. A heading that returns is numbered. Lines before
    any heading are the preamble's; null lines are lines without a heading.
    """
    order = Window.partitionBy("doc").orderBy("pos")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    line = F.coalesce("line", F.lit(""))
    rows = lines.withColumns({"_name": addenda_name(line), "_found": F.regexp_extract(line, HEADING, 0), "_bare": F.trim(F.regexp_replace(line, r"\s+", " "))})
    names = F.coalesce("_name", *[F.lead("_name", i).over(order) for i in range(1, ahead + 1)])
    title_like = (F.length(F.trim("line")).between(1, 40)) & (F.col("_found") == "") & ~F.col("_bare").rlike(r"^[|<①\d]")
    rows = rows.withColumns({"_opens": F.when(line.rlike(ADDENDA), names), "_title": F.when(title_like, F.col("_bare"))})
    heads = (F.col("_found") != "") & ((F.instr(line, F.col("_found")) <= 3) | F.startswith(F.ltrim(line), F.col("_found"))) & F.col("_opens").isNull()
    rows = rows.withColumns({
        "_tag": F.last("_opens", ignorenulls=True).over(so_far),
        "_label": F.when(heads, F.replace("_found", F.lit(" "))),
        "_before": F.coalesce(*[F.lag("_title", i).over(order) for i in range(1, behind + 1)]),
    })
    # A part begins where the numbers since the last article 1 had reached 3: had they not, no part began there either.
    body = F.when(F.col("_tag").isNull() & F.col("_label").isNotNull(), F.coalesce(F.expr(r"try_cast(regexp_extract(_label, '^제\\s*(\\d+)', 1) AS int)"), F.lit(0)))
    rows = rows.withColumn("_n", body)
    reached = F.last(F.when(F.col("_n") >= 3, True).when(F.col("_n") == 1, False), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_begins", (F.col("_n") == 1) & F.coalesce(reached, F.lit(False)))
    rows = rows.withColumn("_nth", F.count_if("_begins").over(so_far))
    named = F.coalesce("_before", F.when(F.col("_nth") == 1, "제2편").otherwise("제3편"))
    rows = rows.withColumn("_part", F.last(F.when(F.col("_begins"), named), ignorenulls=True).over(so_far))
    tag = F.when(F.col("_label") != "부칙", F.col("_tag"))
    key = F.when(F.col("_opens").isNotNull(), F.concat_ws(":", "_part", "_opens")).when(F.col("_label").isNotNull(), F.concat_ws(":", "_part", tag, "_label"))
    keyed = keys_in_force(rows.select(*lines.columns, key.alias("_key"), F.col("_label").isNotNull().alias("_numbered")), "_key", "_numbered", "section_key")
    return keyed.select(*lines.columns, F.coalesce("section_key", F.lit(PREAMBLE)).alias("section_key"))


def cut_by_sequence(text: Column, marks: Column) -> Column:
    """``text`` with a line break before each of the ``marks``, each sought after the one before it, up to the first that is missing.

    A mark right after a digit, 의 or 제 is part of another number and is passed over.
    """

    def step(state: Column, mark: Column) -> Column:
        pattern = F.concat(F.lit("(?s)^.{"), state["start"].cast("string"), F.lit(r",}?(?<![\p{Nd}의제])\Q"), mark, F.lit(r"\E"))
        end = F.length(F.regexp_substr(text, pattern))
        more = F.struct(end.alias("start"), F.array_append(state["cuts"], end - F.length(mark)).alias("cuts"), F.lit(True).alias("open"))
        ended = F.struct(state["start"].alias("start"), state["cuts"].alias("cuts"), F.lit(False).alias("open"))
        return F.when(state["open"] & end.isNotNull(), more).otherwise(ended)

    begin = F.struct(F.lit(0).alias("start"), F.array().cast("array<int>").alias("cuts"), F.lit(True).alias("open"))
    cuts = F.aggregate(marks, begin, step)["cuts"]
    pieces = F.transform(F.concat(F.array(F.lit(0)), cuts), lambda at, i: F.substring(text, at + 1, F.coalesce(F.get(cuts, i), F.length(text)) - at))
    return F.when(text.isNotNull(), F.array_join(F.filter(pieces, lambda p: p != ""), "\n"))


def without_divisions(rows: DataFrame, division: str, body: str) -> DataFrame:
    """Rows but for those whose body only repeats the name of their division."""
    name = F.coalesce(F.col(division), F.lit(""))
    return rows.where((name == "") | (F.coalesce(F.col(body), F.lit("")) != F.trim(name)))
