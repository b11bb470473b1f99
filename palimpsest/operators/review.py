"""Checklists, audits, triggers, classification by features, quality findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merged_items(items: DataFrame, question: str, basis: str, item: str) -> DataFrame:
    """Items of one question (white space aside) as one: the first row's, the ids of all, and each basis that is not part of those before it.

    Of a basis only the first row matters, so a group folds its distinct bases and not its rows.
    """
    key = F.regexp_replace(question, r"\s+", "")
    rows = items.withColumn("_key", key)
    firsts = rows.groupBy("_key", F.col(basis).alias("_basis")).agg(F.min(item).alias("_at"))
    bases = firsts.groupBy("_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_basis"))), lambda x: x["_basis"]).alias("_bases"))
    fold = F.aggregate(F.slice("_bases", 2, F.size("_bases")), F.element_at("_bases", 1), lambda a, x: F.when(F.contains(a, x), a).otherwise(F.concat(a, F.lit(" / "), x)))
    heads = rows.groupBy("_key").agg(F.min_by(question, item).alias(question), F.min(item).alias(item), F.count("*").alias("n_items"))
    return heads.join(bases, "_key").select(F.col("_key").alias("key"), item, question, fold.alias("bases"), "n_items")


def keyword_verdicts(items: DataFrame, ads: DataFrame, product: str = "product", text: str = "text", words: str = "words", require: str = "require", conditional: str = "conditional") -> DataFrame:
    """Items of an ad's product: a required item none of whose words is in the ad is NG (N/A? if conditional), else undecided."""
    asked = items.select("*", F.col(product).alias("_p"))
    met = ads.withColumn("_p", F.explode(F.array(F.col(product), F.lit("all")))).drop(product).join(asked, "_p").drop("_p")
    present = F.exists(words, lambda w: F.contains(F.lower(text), w))
    verdict = F.when(F.col(require) & (F.size(words) > 0) & ~present, F.when(F.col(conditional), "N/A?").otherwise("NG"))
    return met.withColumn("verdict", verdict)


def triggered(text: Column, rules: list[tuple[str, str]], most: int, fallback: int = 300) -> Column:
    """Queries of the rules whose pattern the text has, distinct, at most ``most``; else the text's start."""
    hits = F.array_distinct(F.filter(F.array(*[F.when(text.rlike(p), F.lit(q)) for p, q in rules]), lambda q: q.isNotNull()))
    return F.when(F.size(hits) > 0, F.slice(hits, 1, most)).otherwise(F.array(F.substring(text, 1, fallback)))


def text_features(text: Column) -> dict[str, Column]:
    """Densities per 1,000 characters and shares of lines, rounded to 6 places."""
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    lines = F.split(text, "\n")
    blank = F.size(F.filter(lines, lambda x: F.trim(x) == ""))
    per = lambda c: F.round(c * 1000.0 / n, 6)
    return {
        "sentence_density": per(F.regexp_count(text, F.lit("[.!?]"))),
        "bar_density": per(F.regexp_count(text, F.lit(r"\|"))),
        "digit_share": F.round(F.regexp_count(text, F.lit("[0-9]")) / n, 6),
        "blank_share": F.round(blank / F.size(lines).cast("double"), 6),
    }


def decided(rules: list[tuple[Column, str, str]], otherwise: tuple[str, str]) -> tuple[Column, Column]:
    """The class and the reason of the first rule that holds."""
    kind, why = F.lit(otherwise[0]), F.lit(otherwise[1])
    for condition, k, w in reversed(rules):
        kind, why = F.when(condition, F.lit(k)).otherwise(kind), F.when(condition, F.lit(w)).otherwise(why)
    return kind, why


def cross_table(rows: DataFrame, by: str, column: str, values: list) -> DataFrame:
    return rows.groupBy(by).agg(*[F.count_if(F.col(column).eqNullSafe(F.lit(v))).alias(f"n_{v}") for v in values])


def finding(rows: DataFrame, target: Column, severity: str, item: str, detail: Column) -> DataFrame:
    return rows.select(target.cast("string").alias("target"), F.lit(severity).alias("severity"), F.lit(item).alias("item"), detail.cast("string").alias("detail"))


def first_contaminant(text: Column, patterns: list[tuple[str, str]]) -> Column:
    """The name of the first pattern that a text has."""
    return F.coalesce(*[F.when(text.rlike(p), F.lit(name)) for name, p in patterns], F.lit(None).cast("string"))


def duplicate_keys(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def counted_loss(expected: DataFrame, got: DataFrame, keys: list[str], part: float = 0.9) -> DataFrame:
    """Groups of which under ``part`` arrived."""
    want, have = expected.groupBy(*keys).agg(F.count("*").alias("want")), got.groupBy(*keys).agg(F.count("*").alias("got"))
    return want.join(have, keys, "left").withColumn("got", F.coalesce("got", F.lit(0))).where(F.col("got") < F.col("want") * part)


def most_common(rows: DataFrame, value: str, k: int, order: str) -> DataFrame:
    """The ``k`` commonest values; of equally common ones, those seen first."""
    counts = rows.groupBy(value).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    return counts.orderBy(F.desc("n"), "_first").limit(k).drop("_first")


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


# How deletions and dates are written.
DELETED = r"삭제\s*[<(]?\s*\d{4}|[<(]\s*삭제"
DATE = r"(\d{4})\s*[.년-]\s*(\d{1,2})\s*[.월-]\s*(\d{1,2})"


def deleted_shell(text: Column, most: int = 120) -> Column:
    """Whether a short text is all that is left of a deleted rule."""
    return (F.length(text) <= most) & text.rlike(DELETED)


def deleted_article(title: Column, body: Column, head: int = 40) -> Column:
    """Whether an article is deleted, by its title or by how it begins."""
    return F.coalesce(F.contains(title, F.lit("삭제")), F.lit(False)) | F.coalesce(F.contains(F.substring(body, 1, head), F.lit("삭제")), F.lit(False))


def latest_date(text: Column, head: int = 1500) -> Column:
    """The latest date in a text's first characters, as YYYY-MM-DD; null if there is none."""
    start = F.substring(text, 1, head)
    year, month, day = (F.regexp_extract_all(start, F.lit(DATE), F.lit(i)) for i in (1, 2, 3))
    zipped = F.arrays_zip(year.alias("y"), month.alias("m"), day.alias("d"))
    return F.array_max(F.transform(zipped, lambda x: F.concat_ws("-", x["y"], F.lpad(x["m"], 2, "0"), F.lpad(x["d"], 2, "0"))))


def char_shares(rows: DataFrame, by: str, text: str) -> DataFrame:
    """Characters of each class, and their share of all: one aggregate, and a window over as many rows as classes."""
    sums = rows.groupBy(by).agg(F.sum(F.length(text)).alias("chars"))
    return sums.withColumn("share", F.round(F.col("chars") / F.sum("chars").over(Window.partitionBy()), 6))


def accuracy_by(rows: DataFrame, expected: str, verdict: str) -> DataFrame:
    right = F.when(F.col(expected) == F.col(verdict), 1.0).otherwise(0.0)
    return rows.groupBy(expected).agg(F.count("*").alias("n"), F.round(F.avg(right), 6).alias("accuracy"))


def by_severity(rows: DataFrame, target: str, severity: str, order: str, ranks: tuple[str, ...]) -> DataFrame:
    """``place`` of each finding of its target by the rank of its severity; unknown severities come last."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, ranks)), F.col(severity)), F.lit(0)), F.lit(len(ranks) + 1))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(target).orderBy(rank, order)).cast("long"))


def capped(rows: DataFrame, by: str, value: str, most: int, out: str) -> DataFrame:
    """The first ``most`` values of each owner as text and how many were left out; the cut is made before gathering."""
    w = Window.partitionBy(by).orderBy(value)
    ranked = rows.select(by, F.col(value).alias("_v"), F.row_number().over(w).alias("_n"))
    told = ranked.groupBy(by).agg(F.count("*").alias("_all"), F.array_sort(F.collect_list(F.when(F.col("_n") <= most, F.struct("_n", F.col("_v").cast("string").alias("v"))))).alias("_first"))
    rest = F.when(F.col("_all") > most, F.concat(F.lit(" +"), (F.col("_all") - most).cast("string"), F.lit(" more"))).otherwise("")
    return told.select(by, F.concat(F.array_join(F.transform("_first", lambda x: x["v"]), ", "), rest).alias(out))
