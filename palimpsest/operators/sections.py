"""Documents to sections and chunks: ordered scans as windows, greedy packing as folds.

Rows of sections carry (doc, pos); ``pos`` orders them inside their document, so every window is per document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from . import chunking


def text_lines(docs: DataFrame, doc: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(doc, pos, line, …): every line, from 1."""
    return docs.select(F.col(doc).alias("doc"), *(keep or []), F.posexplode(F.split(text, "\n")).alias("pos", "line")).withColumn("pos", (F.col("pos") + 1).cast("long"))


def numbered(rows: DataFrame, present: Column, out: str = "seq") -> DataFrame:
    """Numbers in emission order; absent rows are dropped and take no number."""
    return rows.where(present).withColumn(out, F.row_number().over(Window.partitionBy("doc").orderBy("pos")).cast("long"))


def unique_keys(rows: DataFrame, key: str, out: str = "section_key", mark: str = "#", ties: tuple[str, ...] = ()) -> DataFrame:
    """The second row of a key is ``key#2``, and so on, past every key that the document has had by then.

    One shuffle by document, then one pass over its rows in order; a task holds the keys of one document at a time. Null keys stay.
    ``ties``: columns that order rows of one ``pos``, which else have no order.
    """
    ordered = rows.repartition("doc").sortWithinPartitions("doc", "pos", *ties)
    schema = StructType([*ordered.schema.fields, StructField(out, StringType())])
    at, doc_at = ordered.columns.index(key), ordered.columns.index("doc")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, number = object(), _numbering(mark)
        for batch in batches:
            keys = []
            for d, k in zip(batch.column(doc_at).to_pylist(), batch.column(at).to_pylist()):
                if d != doc:
                    doc, number = d, _numbering(mark)
                keys.append(None if k is None else number(k))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.string())], [*batch.schema.names, out])

    return ordered.mapInArrow(fold, schema)


def _numbering(mark: str) -> Callable[[str], str]:
    """The keys of one document, each made unlike all before it."""
    used, last = set(), {}

    def number(key: str) -> str:
        new, n = key, last.get(key, 2)
        while new in used:
            new, n = f"{key}{mark}{n}", n + 1
        last[key] = n
        used.add(new)
        return new

    return number


def keys_in_force(rows: DataFrame, key: str, numbered: str, out: str = "section_key", mark: str = "#") -> DataFrame:
    """``rows`` without ``key`` and ``numbered``, with the key that each row stands under: its own, else the last before it.

    Keys of ``numbered`` rows are made unique as in ``unique_keys``, others stay. The row number asks for rows by document in
    order of ``pos``; rows that windows left so are neither shuffled nor sorted again. A task holds the keys of one document.
    """
    plain = [c for c in rows.columns if c not in (key, numbered)]
    placed = rows.select(*plain, key, numbered, F.row_number().over(Window.partitionBy("doc").orderBy("pos")).alias("_at"))
    schema = StructType([*(placed.schema[c] for c in plain), StructField(out, StringType())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, own = _numbering(mark), None
        for batch in batches:
            keys = []
            for k, new, at in zip(*(c.to_pylist() for c in batch.columns[-3:])):
                if at == 1:
                    number, own = _numbering(mark), None
                if k is not None:
                    own = number(k) if new else k
                keys.append(own)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-3], pa.array(keys, pa.string())], [*plain, out])

    return placed.mapInArrow(fold, schema)


def carried(rows: DataFrame, value: Column, out: str) -> DataFrame:
    """The last value that is not null, up to and with the row: chapter titles, addenda tags, names of statutes."""
    return rows.withColumn(out, F.last(value, ignorenulls=True).over(Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))


def parts_by_reset(rows: DataFrame, number: Column, out: str = "part_no") -> DataFrame:
    """A new part begins where a number does not exceed the greatest one before it in sequence, that is the last one."""
    w = Window.partitionBy("doc").orderBy("pos")
    reset = F.when(number <= F.lag(number).over(w), 1).otherwise(0)
    return rows.withColumn("_reset", reset).withColumn(out, (F.sum("_reset").over(w.rowsBetween(Window.unboundedPreceding, 0)) + 1).cast("long")).drop("_reset")


def rising_only(items: Column, number) -> Column:
    """Items of an array whose ``number`` exceeds all accepted before: headings, while citations of earlier ones fall out."""
    kept = chunking.rising(F.transform(items, number))
    return F.transform(kept, lambda i: F.get(items, i))


def packed(pieces: Column, target: int, maximum: int) -> Column:
    """Greedy packing: a chunk is closed once it has ``target`` characters, or if the next piece and a break would pass ``maximum``."""
    return chunking.sliced(pieces, chunking.greedy_starts(F.transform(pieces, F.length), target, maximum))


def sentence_pieces(lines: Column, maximum: int) -> Column:
    """Lines, those over ``maximum`` cut after sentence ends."""
    cut = lambda x: F.regexp_extract_all(x, F.lit(r"[^.!?]*[.!?]*\s*"), F.lit(0))
    pieces = F.flatten(F.transform(lines, lambda x: F.when(F.length(x) <= maximum, F.array(x)).otherwise(F.transform(cut(x), lambda y: F.trim(y)))))
    return F.filter(pieces, lambda p: F.length(p) > 0)


def chunks(docs: DataFrame, doc: str, text: str = "text", target: int = 500, maximum: int = 800, header: Column | None = None) -> DataFrame:
    """(doc, part, parts, chunk, chars, sha): whole texts of up to ``maximum`` characters, others packed."""
    pieces = sentence_pieces(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""), maximum)
    rows = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text"), *([header.alias("header")] if header is not None else []), F.when(F.length(text) > maximum, pieces).alias("pieces"))
    rows = rows.withColumn("packs", packed(F.col("pieces"), target, maximum))
    rows = rows.withColumn("packs", F.when(F.length("text") <= maximum, F.array("text")).otherwise(F.col("packs"))).drop("text", "pieces")
    rows = rows.select("*", F.size("packs").cast("long").alias("parts"), F.posexplode("packs").alias("part", "body")).drop("packs")
    if header is not None:
        many = F.concat(F.lit(" ("), (F.col("part") + 1).cast("string"), F.lit("/"), F.col("parts").cast("string"), F.lit(")"))
        rows = rows.withColumn("body", F.concat("header", F.when(F.col("parts") > 1, many).otherwise(""), F.lit("\n"), "body")).drop("header")
    return rows.select("doc", (F.col("part") + 1).cast("long").alias("part"), "parts", F.col("body").alias("chunk"), F.length("body").cast("long").alias("chars"), F.substring(F.sha2("body", 256), 1, 16).alias("sha"))


def index_percentiles(rows: DataFrame, value: str, percents: tuple[int, ...], by: list[str] | None = None) -> DataFrame:
    """(…, p, value): the value at place round-half-even((n - 1) p / 100) of the sorted values.

    Values are counted first: the places are found in a window over distinct values, not over rows.
    """
    by = by or []
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*(by or [F.lit(0)]))
    upto = w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumn("_upto", F.sum("_n").over(upto)).withColumn("_all", F.sum("_n").over(w))
    asked = placed.select("*", F.explode(F.array(*map(F.lit, percents))).alias("p"))
    at = F.bround((F.col("_all") - 1) * F.col("p") / 100.0, 0).cast("long")
    hit = asked.where((at < F.col("_upto")) & (at >= F.col("_upto") - F.col("_n")))
    return hit.select(*by, F.col("p").cast("long").alias("p"), F.col(value).alias("value"))


def histogram(rows: DataFrame, value: Column, edges: tuple[int, ...]) -> DataFrame:
    """(bucket, n): buckets begin at their edge, the last is open."""
    bucket = F.lit(0)
    for i, e in enumerate(edges, 1):
        bucket = F.when(value >= e, i).otherwise(bucket) if i == 1 else F.when(value >= e, F.lit(i)).otherwise(bucket)
    return rows.groupBy(bucket.cast("long").alias("bucket")).agg(F.count("*").alias("n"))


def over_limits(rows: DataFrame, chars: str, limits: tuple[int, ...], chars_per_token: tuple[float, ...]) -> DataFrame:
    """(lim, cpt, n_over): rows whose estimated tokens pass each limit; one pass, one row of counters."""
    pairs = [(a, b) for a in limits for b in chars_per_token]
    one = rows.agg(*[F.count_if(F.col(chars) / b > a).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    table = F.array(*[F.struct(F.lit(a).cast("long").alias("lim"), F.lit(float(b)).alias("cpt"), F.col(f"c{i}").alias("n_over")) for i, (a, b) in enumerate(pairs)])
    return one.select(F.inline(table))


def distinct_cells(rows: DataFrame, line: str = "line", sep: str = " | ") -> DataFrame:
    """(doc, pos, line): table lines without the cells that an earlier line of the document had; empty lines go."""
    w = Window.partitionBy("doc", "cell").orderBy("pos", "at")
    cells = rows.select("doc", "pos", F.posexplode(F.split(line, sep.replace("|", "\\|"))).alias("at", "cell")).withColumn("cell", F.trim("cell")).where("cell <> ''")
    first = cells.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return first.groupBy("doc", "pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "cell"))), lambda c: c["cell"]), sep).alias(line))


def dedupe_first(rows: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each key; ``dropDuplicates`` would keep any."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
