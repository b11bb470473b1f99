"""Benchmark decontamination with a broadcast hash set of n-grams, in DataFrame operations only.

The set holds every window of ``n`` consecutive words of a benchmark item (an item of fewer words is one window).
A window can only start where its anchor, its longest word, stands; so documents are scanned word by word against
the anchors, the n-gram around each hit is cut out and looked up in the hash set, and equal n-grams are hits.
Covered words are counted once. The benchmark is broadcast in slices of ``BROADCAST_WINDOWS`` windows: one slice
for benchmarks of usual size, more scans of the documents beyond it.

Defined results: null texts have no words; rows that agree in id and text have equal results, one row each; an item
without words has no window; a null item id is shown as ``null``; without a benchmark nothing is hit.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, word_array

#: Windows in one broadcast: at about 150 bytes a window, 75 MB at most.
BROADCAST_WINDOWS = 500_000


def benchmark_windows(items: DataFrame, n: int = 10, *, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """gram, its number of words, anchor with place in the gram, and the ids of the items that hold it; a row for each distinct gram."""
    words = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), word_array(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - n + 1))
    grams = words.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, F.least(F.lit(n), F.size("w"))))).alias("g"))
    distinct = grams.groupBy("g").agg(F.array_sort(F.collect_set("item")).alias("items"))
    longest = F.array_max(F.transform("g", lambda w, i: F.struct(F.char_length(w).alias("n"), (-i).alias("at"), w.alias("w"))))
    return distinct.select(F.concat_ws(" ", "g").alias("gram"), F.size("g").alias("len"), longest["w"].alias("anchor"), (-longest["at"]).alias("at"), "items")


def _scan(words: DataFrame, grams: DataFrame) -> DataFrame:
    """Hits (key columns, start, len, items) of one slice; an extra empty word at each document's end always hits."""
    end = words.sparkSession.createDataFrame([("", 0, "", 0, [])], "gram string, len int, anchor string, at int, items array<string>")
    grams = grams.union(end.select("gram", "len", "anchor", "at", "items"))
    anchors = grams.select("anchor", "at", "len").distinct()
    each = words.select("id", "text_hash", "n_words", "w", F.posexplode(F.concat("w", F.array(F.lit("")))).alias("pos", "anchor"))
    near = each.join(F.broadcast(anchors), "anchor").where("pos >= at and pos - at + len <= n_words")
    gram = F.concat_ws(" ", F.slice("w", F.col("pos") - F.col("at") + 1, F.col("len")))
    near = near.select("id", "text_hash", "n_words", (F.col("pos") - F.col("at")).alias("start"), "len", gram.alias("gram"))
    return near.join(F.broadcast(grams.select("gram", "len", "items")), ["gram", "len"]).select("id", "text_hash", "n_words", "start", "len", "items")


def find_contamination(docs: DataFrame, items: DataFrame, n: int = 10, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, n_words, n_hit, hit_items (sorted strings) and spans (merged word ranges) of every row."""
    grams = cut(benchmark_windows(items, n, item_col=item_col, text_col=item_text_col))
    slices = -(-grams.count() // BROADCAST_WINDOWS) or 1
    words = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), word_array(F.col(text_col)).alias("w")).withColumn("n_words", F.size("w"))
    part = F.pmod(F.xxhash64("gram"), F.lit(slices))
    hits = reduce(DataFrame.union, (_scan(words, grams if slices == 1 else grams.where(part == i)) for i in range(slices)))
    keys = ["id", "text_hash", "n_words"]
    found = hits.groupBy(*keys).agg(
        F.array_sort(F.collect_set(F.when(F.col("len") > 0, F.struct("start", (F.col("start") + F.col("len")).alias("end"))))).alias("windows"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("hit_items"),
        F.count_if(F.col("len") == 0).alias("ends"),
    )
    empty = F.array().cast("array<struct<start:int,end:int>>")
    merged = F.aggregate(
        "windows",
        F.struct(empty.alias("done"), F.lit(0).alias("start"), F.lit(-1).alias("end")),
        lambda a, x: F.when(x["start"] <= a["end"], F.struct(a["done"].alias("done"), a["start"].alias("start"), F.greatest(a["end"], x["end"]).alias("end"))).otherwise(
            F.struct(F.when(a["end"] >= 0, F.concat(a["done"], F.array(F.struct(a["start"].alias("start"), a["end"].alias("end"))))).otherwise(a["done"]).alias("done"), x["start"].alias("start"), x["end"].alias("end"))
        ),
        lambda a: F.when(a["end"] >= 0, F.concat(a["done"], F.array(F.struct(a["start"].alias("start"), a["end"].alias("end"))))).otherwise(a["done"]),
    )
    found = found.select(*keys, "hit_items", merged.alias("spans"), (F.col("ends") / slices).cast("int").alias("copies"))
    n_hit = F.aggregate("spans", F.lit(0), lambda a, s: a + s["end"] - s["start"])
    found = found.select(*keys, "hit_items", "spans", n_hit.alias("n_hit"), F.explode(F.array_repeat(F.lit(1), F.col("copies"))).alias("_"))
    return found.select(F.col("id").alias("doc_id"), "text_hash", F.col("n_words").cast("long").alias("n_words"), F.col("n_hit").cast("long").alias("n_hit"), "hit_items", "spans")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Each row whole, in one struct, so that no name of the caller's can clash; beside it the keys of a find."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(whole.alias("doc"), F.col(f"`{id_col}`").alias("row_id"), F.xxhash64(F.col(f"`{text_col}`")).alias("row_hash"))


def _met() -> Column:
    return F.col("row_id").eqNullSafe(F.col("bad_id")) & (F.col("row_hash") == F.col("bad_hash"))


def drop_contaminated(docs: DataFrame, items: DataFrame, n: int = 10, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` without the rows that hold a benchmark window. Null texts and empty tables pass; columns stay as they were."""
    found = find_contamination(docs, items, n, id_col=id_col, text_col=text_col, **how)
    bad = found.where("n_hit > 0").select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct()
    return _rows(docs, id_col, text_col).join(bad, _met(), "left_anti").select("doc.*")


def remove_spans(docs: DataFrame, items: DataFrame, n: int = 10, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with the hit words taken out of the text; texts without a hit stay as they are, character by character."""
    found = find_contamination(docs, items, n, id_col=id_col, text_col=text_col, **how)
    bad = found.where("n_hit > 0").select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash"), F.col("spans").alias("bad_spans")).dropDuplicates(["bad_id", "bad_hash"])
    old = F.col(f"doc.`{text_col}`")
    pieces = F.regexp_extract_all(old, F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"), F.lit(0))
    lead = F.regexp_extract(old, r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", 0)
    kept = F.filter(F.transform(pieces, lambda p, i: F.when(~F.exists("bad_spans", lambda s: (s["start"] <= i) & (i < s["end"])), p)), lambda p: p.isNotNull())
    text = F.when(F.col("bad_spans").isNull(), old).otherwise(F.concat(lead, F.array_join(kept, "")))
    rows = _rows(docs, id_col, text_col).join(bad, _met(), "left")
    return rows.select(*[(text if c == text_col else F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])
