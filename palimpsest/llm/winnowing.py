"""Document fingerprints by winnowing, in DataFrame operations only.

Each word is hashed once; the hash of a run of ``k`` words is the cyclic polynomial of its words' hashes (each turned
left once for every word after it, all joined by exclusive or). It rolls from one run to the next by turns alone, and
is made here for all runs at once: runs of 2, 4, 8 … words join two of half the length. Of every ``w`` consecutive
hashes the least signed one is kept, the rightmost of equals, with its position. So any ``w + k - 1`` words that two
documents share give both a common mark. Texts of fewer words than ``k`` have one gram of all their words; texts of
fewer grams than ``w``, one window.

Defined results: null or wordless texts have no marks (two of them are alike: 1.0; one of them and another: 0.0);
equal texts have equal marks, by construction; a text of any length is one row of arrays of its words' hashes; other
columns of the caller are not read.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, word_array

K, W = 5, 4


def _turned(h: Column, by: int) -> Column:
    """``h`` rotated left by ``by`` bits."""
    by %= 64
    return h if by == 0 else F.shiftleft(h, by).bitwiseOR(F.shiftrightunsigned(h, 64 - by))


def _joined(left: Column, right: Column, ahead: int, length: int) -> Column:
    """Hashes of runs from those of their first parts and of their last ``length`` words, ``ahead`` places on."""
    return F.transform(left, lambda h, i: _turned(h, length).bitwiseXOR(F.get(right, i + ahead)))


def grams(words: Column, k: int = K) -> Column:
    """array<bigint>: the hash of every run of ``k`` words; of all words if they are fewer; none of none."""

    def runs(hashes: Column, length: int) -> Column:
        # Hashes of the runs of ``length`` words; places past the last whole run are null and are cut off at the end.
        if length == 1:
            return hashes
        if length % 2:
            return let(hashes, lambda h: _joined(runs(h, length - 1), h, length - 1, 1))
        return let(runs(hashes, length // 2), lambda h: _joined(h, h, length // 2, length // 2))

    n = F.size(words)
    each = F.transform(words, lambda w: F.xxhash64(w))
    few = F.aggregate(each, F.lit(0).cast("bigint"), lambda a, h: _turned(a, 1).bitwiseXOR(h))
    return F.when(n >= k, F.slice(runs(each, k), F.lit(1), n - k + 1)).when(n > 0, F.array(few)).otherwise(F.array().cast("array<bigint>"))


def winnow(hashes: Column, w: int = W) -> Column:
    """array<struct<hash, pos>>: the kept marks of an array of gram hashes, in the order of positions."""
    n = F.size(hashes)
    rightmost = lambda s, i: (i - 1 + F.size(s) - F.array_position(F.reverse(s), F.array_min(s))).cast("int")
    places = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - w + 1)), lambda i: let(F.slice(hashes, i, w), lambda s: rightmost(s, i)))
    marks = F.transform(F.array_distinct(places), lambda p: F.struct(F.get(hashes, p).alias("hash"), p.alias("pos")))
    return F.when(n > 0, marks).otherwise(F.array().cast("array<struct<hash:bigint,pos:int>>"))


def marks_of(text: Column, k: int = K, w: int = W) -> Column:
    return let(word_array(text), lambda words: let(grams(words, k), lambda g: winnow(g, w)))


def document_marks(docs: DataFrame, k: int = K, w: int = W, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``marks`` (hash and word position) of every row: what an index of passages holds."""
    return docs.select(F.col(id_col).alias("doc_id"), marks_of(F.col(text_col), k, w).alias("marks"))


def digest(marks: Column) -> Column:
    """A fixed-length name of a list of marks."""
    return F.md5(F.array_join(F.transform(marks, lambda m: F.concat_ws(":", F.hex(m["hash"]), m["pos"].cast("string"))), ","))


def likeness(a: Column, b: Column) -> Column:
    """Shared marks over all marks of two hash lists."""
    both = F.size(F.array_intersect(a, b))
    all_ = F.size(F.array_union(a, b))
    return F.when(all_ == 0, 1.0).otherwise(both / all_)


def with_next(docs: DataFrame, make, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row (doc_id, text, and what ``make`` adds) with ``next``, the same of the row after it by descending id.

    Rows are dealt to ranges by quantiles of ids, an id that holds several quantiles being cut further by the hashes of
    its texts, and every range is one partition. A range's first row is also sent to the range before it, which lacks
    its last row's next. So one shuffle moves each text once, and no task holds more than a range. Equal ids are in the
    order of their texts' hashes, then texts; null ids come last; after the last row comes the first.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    low = -(1 << 63)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", F.struct(F.coalesce("doc_id", F.lit(low)).alias("id"), F.xxhash64("text").alias("hash")).alias("_at"))
    quantiles = rows.select("_at.id").stat.approxQuantile("id", [i / parts for i in range(1, parts)], 0.2 / parts) if parts > 1 else []
    held = Counter(int(q) for q in quantiles)
    bounds = sorted((q, low + (j << 64) // n) for q, n in held.items() for j in range(n))
    # One literal, however many ranges: text that is parsed once when the plan is made.
    literal = lambda values, kind: F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")
    edges = F.arrays_zip(literal([b[0] for b in bounds], "bigint").alias("id"), literal([b[1] for b in bounds], "bigint").alias("hash")) if bounds else F.array().cast("array<struct<id:bigint,hash:bigint>>")
    rows = rows.withColumn("range", F.size(F.filter(edges, lambda b: b < F.col("_at"))))
    firsts = {r["range"]: r["top"] for r in rows.groupBy("range").agg(F.max("_at").alias("top")).collect()}  # a row for each range
    filled = sorted(firsts)
    above = {r: filled[(i + 1) % len(filled)] for i, r in enumerate(filled)}
    tops = [firsts.get(i) or (low, low) for i in range(len(bounds) + 1)]
    nth = lambda values, kind: F.element_at(literal(values, kind), F.col("range") + 1)
    top = F.struct(nth([t[0] for t in tops], "bigint").alias("id"), nth([t[1] for t in tops], "bigint").alias("hash"))
    here = F.struct(F.col("range").alias("range"), F.lit(False).alias("guest"))
    there = F.struct(nth([above.get(i, 0) for i in range(len(tops))], "int").alias("range"), F.lit(True).alias("guest"))
    sent = rows.select("doc_id", "_at", "text", F.explode(F.when(F.col("_at") == top, F.array(here, there)).otherwise(F.array(here))).alias("to"))
    dealt = sent.select("doc_id", "_at", "text", "to.range", "to.guest").repartitionById(len(tops), F.col("range"))
    made = make(dealt)
    kept = [c for c in made.columns if c not in ("doc_id", "_at", "range", "guest")]
    after = Window.partitionBy("range").orderBy("guest", F.desc("_at"), "text")
    return made.withColumn("next", F.lead(F.struct(*kept)).over(after)).where("not guest").drop("_at", "range", "guest")


def compare_edited(docs: DataFrame, k: int = K, w: int = W, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Marks of every text, of its edited form (the last third taken from the next document's start), and their likeness."""
    rows = with_next(docs, lambda r: r.withColumn("marks", marks_of(F.col("text"), k, w)), id_col=id_col, text_col=text_col)
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - third), F.substring("next.text", F.lit(1), third))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "marks", F.col("next.marks.hash").alias("_next"), edited.alias("edited"))
    rows = rows.withColumn("edited_marks", marks_of(F.col("edited"), k, w))
    own, other = F.col("marks.hash"), F.col("edited_marks.hash")
    return rows.select("doc_id", "n_chars", "edited", "marks", "edited_marks", likeness(own, other).alias("near_edited"), likeness(own, F.col("_next")).alias("near_next"))
