"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

A source's target is its weight's part of all words, held below ``max_ratio`` times the source's own words, the
excess going back to the others (water filling). Inside a source every document expects ``rho`` copies, the same
for all documents of one size class and larger for longer classes (``tilt``), water-filled under ``max_ratio``
again. ``floor(rho)`` copies are certain; the rest is an unequal-probability sample of fixed size in words:
documents are ranked by random odds over inclusion odds and taken in that order until the source's remaining
target is reached.

Only one row per source and size class, and a histogram of 4,096 rank buckets a source, is ever gathered; the
exact order is needed in the one bucket where the target falls. No document is moved by source. Rows that agree in
id, text and source are numbered, and each draws for itself: those that agree in every column are counted where they
stand and dealt out again from one row with its number, so that a third of all rows being equal is one row a task.

Defined results: a null text has size 0; null sources form one source, ranked last; ids may be null or come again;
an empty table gives no rows; sources without words have target 0 and take nothing; texts of any length are counted
whole; the columns of ``docs`` come back inside ``doc``, whatever their names. Columns must be of types that can be
grouped; maps and variants tell no rows apart.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NON_SPACE_WORD, cut

RANK_BUCKETS = 4096
#: Hashes of rows that come again, up to which they are broadcast.
BROADCAST_ROWS = 1_000_000
SEED = 20_240_607


def word_size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(NON_SPACE_WORD)), F.lit(0)).cast("long")


def _size_class(size: Column) -> Column:
    return F.when(size > 0, F.floor(F.log2(size.cast("double")))).otherwise(0).cast("int")


def _uniform(row_key: Column, nth: Column) -> Column:
    """A uniform number in (0, 1) fixed by the row, and by its number among equal ones."""
    return (F.shiftrightunsigned(F.xxhash64(row_key, nth, F.lit(SEED)), 12).cast("double") + 0.5) / float(1 << 52)


def _row_key(id_col: str, text_col: str, source_col: str) -> Column:
    return F.xxhash64(*[F.col(f"`{c}`") for c in (id_col, text_col, source_col)])


def _beside(docs: DataFrame, *keys: str) -> Column:
    """A hash of the columns besides the ``keys``."""
    other = [F.col(f"`{f.name}`") for f in docs.schema.fields if f.name not in keys and not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
    return F.xxhash64(*other) if other else F.lit(0).cast("long")


def _dealt(counted: DataFrame) -> DataFrame:
    """Each row as often as its ``n`` says, with ``nth`` from 1; by blocks, so that no long array is made."""
    at = F.col("_block") * 65_536
    blocks = counted.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / 65_536))))
    return blocks.withColumn("nth", F.explode(F.sequence(at + 1, F.least(F.col("n"), at + 65_536)))).drop("n", "_block")


def _rank(u: Column, residual: Column) -> Column:
    """Pareto rank Q = odds(u) / odds(residual), carried to (0, 1) as Q / (1 + Q). Null where nothing is sampled."""
    a, b = u * (1 - residual), (1 - u) * residual
    return F.when(residual > 0, a / (a + b))


def _water_fill(rows: DataFrame, keys: list[str], total: Column, cap: Column, weight: Column, order: list[str]) -> DataFrame:
    """``level``: the water level at which sum of min(cap, weight * level) is ``total`` within ``keys``.

    Rows are small aggregates. In the order of cap / weight the level after capping a prefix rises until the first
    row that stays uncapped, so the answer is the largest of them.
    """
    ranked = rows.withColumns({"_cap": cap, "_weight": weight, "_total": total}).withColumn("_ratio", F.col("_cap") / F.col("_weight"))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    by_ratio = w.orderBy("_ratio", *order)
    before = F.coalesce(F.sum("_cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("_weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    ranked = ranked.withColumn("_level", (F.col("_total") - before) / left)
    return ranked.withColumn("level", F.max("_level").over(w)).drop("_level", "_ratio", "_total")


def plan_mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (5.0, 2.0, 1.0), share: float = 1.0, max_ratio: float = 3.0, tilt: float = 0.02) -> DataFrame:
    """One row per source and size class: how many copies are certain, and which ranks are sampled.

    ``weights`` repeat over the sources in code point order, null last. ``share`` is the mix's part of all words.
    """
    keys = docs.select(F.col(f"`{source_col}`").alias("source"), word_size(F.col(f"`{text_col}`")).alias("size"), _row_key(id_col, text_col, source_col).alias("row_key"))
    equal = cut(keys.groupBy("source", "size", "row_key").agg(F.count("*").alias("n")))
    sized = _dealt(equal).select("source", "size", _uniform(F.col("row_key"), F.col("nth")).alias("u"), _size_class(F.col("size")).alias("size_class"))
    classes = cut(sized.groupBy("source", "size_class").agg(F.sum("size").cast("double").alias("class_size")))
    sources = classes.groupBy("source").agg(F.sum("class_size").alias("source_size"))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (place % len(weights) + 1).cast("int"))
    total = F.sum("source_size").over(Window.partitionBy(F.lit(0))) * share
    filled = _water_fill(sources.withColumns({"w": weight, "t": total}), [], F.col("t"), F.col("source_size") * max_ratio, F.col("w"), ["w"])
    targets = filled.select("source", "source_size", F.least("_cap", F.col("w") * F.col("level")).alias("target"))
    tilted = (1 + tilt * F.col("size_class")) * F.greatest("class_size", F.lit(1e-9))
    inner = classes.join(targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).select("source", "size_class", "class_size", "source_size", "target")
    inner = _water_fill(inner, ["source"], F.col("target"), F.greatest("class_size", F.lit(1e-9)) * max_ratio, tilted, ["size_class"])
    rho = F.when(F.col("class_size") > 0, F.least(F.lit(float(max_ratio)), F.col("_weight") * F.col("level") / F.col("class_size"))).otherwise(0.0)
    inner = inner.withColumn("rho", rho).withColumn("certain", F.floor(F.col("rho") + 1e-9))
    residual = F.greatest(F.lit(0.0), F.col("rho") - F.col("certain"))
    inner = inner.withColumn("residual", F.when(residual > 1e-9, residual).otherwise(0.0))
    wanted = F.sum(F.col("residual") * F.col("class_size")).over(Window.partitionBy("source"))
    plan = cut(inner.select("source", "size_class", "source_size", "target", F.col("certain").cast("long").alias("certain"), "residual", wanted.alias("wanted")))

    ranked = _with_plan(sized, plan).withColumn("x", _rank(F.col("u"), F.col("residual"))).where("x is not null and size > 0").withColumn("bucket", F.floor(F.col("x") * RANK_BUCKETS).cast("int"))
    up_to = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    filled_up = ranked.groupBy("source", "bucket", "wanted").agg(F.sum("size").alias("words")).withColumn("cum", F.sum("words").over(up_to))
    edge = filled_up.where("cum >= wanted").groupBy("source").agg(F.min_by(F.struct("bucket", (F.col("cum") - F.col("words")).alias("before")), "bucket").alias("e")).select("source", "e.*")
    edge = cut(edge)
    inside = ranked.join(edge.withColumnsRenamed({"source": "_s", "bucket": "_b"}), F.col("source").eqNullSafe(F.col("_s")) & (F.col("bucket") == F.col("_b"))).select("source", "x", "size", "wanted", "before")
    order = Window.partitionBy("source").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.groupBy("source", "x", "wanted", "before").agg(F.sum("size").alias("size")).withColumn("cum", F.col("before") + F.sum("size").over(order))
    last = inside.where("cum - size / 2.0 <= wanted").groupBy("source").agg(F.max("x").alias("cut_x"))
    cuts = edge.join(last.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").select(F.col("source").alias("_s"), F.col("bucket").alias("cut_bucket"), "cut_x")
    return cut(plan.join(cuts, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s", "wanted"))


def _with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Small aggregates meet the rows; Spark broadcasts them only below its own size threshold."""
    p = plan.withColumnsRenamed({"source": "_s", "size_class": "_c"})
    return rows.join(p, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size_class") == F.col("_c"))).drop("_s", "_c")


def apply_mix(docs: DataFrame, plan: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: bool = True) -> DataFrame:
    """``docs`` (all columns in a struct ``doc`` if ``keep``, else its id alone) with size, source_size, target, copies, taken."""
    held = F.struct(*[F.col(f"`{c}`") for c in docs.columns]) if keep else F.struct(F.col(f"`{id_col}`"))
    named = (id_col, text_col, source_col)
    key, beside = _row_key(*named).alias("row_key"), _beside(docs, *named).alias("beside")
    rows = docs.select(held.alias("doc"), F.col(f"`{source_col}`").alias("source"), word_size(F.col(f"`{text_col}`")).alias("size"), key, beside)
    grouped = docs.select(key, beside).groupBy("row_key", "beside").agg(F.count("*").alias("n"))
    equal = cut(grouped.groupBy("row_key").agg(F.sum("n").alias("n")).where("n > 1").select("row_key"))
    n_equal = equal.count()
    if n_equal:
        side = F.broadcast(equal) if n_equal <= BROADCAST_ROWS else equal
        before = F.coalesce(F.sum("n").over(Window.partitionBy("row_key").orderBy("beside").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        offsets = cut(grouped.join(side, "row_key", "left_semi").select("row_key", "beside", before.alias("before")))
        again = rows.join(side, "row_key", "left_semi").groupBy("doc", "source", "size", "row_key", "beside").agg(F.count("*").alias("n"))
        again = _dealt(again.join(offsets, ["row_key", "beside"])).select("doc", "source", "size", "row_key", (F.col("nth") + F.col("before")).alias("nth"))
        rows = rows.join(side, "row_key", "left_anti").select("doc", "source", "size", "row_key", F.lit(1).cast("long").alias("nth")).unionByName(again)
    else:
        rows = rows.withColumn("nth", F.lit(1).cast("long"))
    rows = rows.select("doc", "source", "size", _uniform(F.col("row_key"), F.col("nth")).alias("u"))
    rows = _with_plan(rows.withColumn("size_class", _size_class(F.col("size"))), plan)
    x = _rank(F.col("u"), F.col("residual"))
    bucket = F.floor(x * RANK_BUCKETS).cast("int")
    below = F.col("cut_bucket").isNull() | (bucket < F.col("cut_bucket")) | ((bucket == F.col("cut_bucket")) & F.coalesce(x <= F.col("cut_x"), F.lit(False)))
    sampled = F.when(x.isNotNull() & below, 1).otherwise(0)
    rows = rows.withColumn("copies", F.when(F.col("size") > 0, F.col("certain") + sampled).otherwise(F.lit(0)).cast("long"))
    return rows.select("doc", "source", "size", F.col("source_size").cast("long").alias("source_size"), "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of ``docs``."""
    rows = apply_mix(docs, plan_mix(docs, **how), **{k: v for k, v in how.items() if k.endswith("_col")})
    return rows.select("doc", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("doc.*")
