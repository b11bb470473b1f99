"""Checklist items of an audit: which way they point, when they apply, which are asked, and what an answer says of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Endings of prohibitions, conditions, particles, and marks of items for investments alone.
PROHIBITS = r"않았는가|없는가|아닌가|하지\s*아니하였는가|금지"
CONDITION = r"^\s*[(（]([^)）]{2,40})[)）]"
CONDITION_END = r"(?:하는|인|있는|받는)\s*경우|시\s|때\s"
PARTICLES = r"(?:으로서|에서의|에게서|으로|에서|에게|이나|하는|한|인|을|를|이|가|은|는|의|에|와|과|로|도|만|및|께|랑|나|든|나마)$"
ENDINGS = r"(?:하였는가|않았는가|있는가|없는가|하는가|인가|하여|하고|한다)$"
INVESTMENT_BASIS = r"협회규정|금투업규정|증발공|자본시장|투자광고"
INVESTMENT_WORDS = r"투자원금|금융투자상품|공모증권|투자설명서|집합투자|수익증권|파생결합|랩\s?어카운트|투자자문|투자일임|퇴직연금|월지급식|펀드|신탁|ELS|DLS|ELB|DLB|ELF|ETF|ETN|ELW|IMA|CMA|CFD"
EVERY, INVESTMENT = "전체", "투자"


def direction(question: Column) -> Column:
    """PROHIBIT for what must not be there, REQUIRE for what must."""
    return F.when(F.coalesce(question, F.lit("")).rlike(PROHIBITS), "PROHIBIT").otherwise("REQUIRE")


def conditional(question: Column, topic: Column) -> Column:
    """Whether an item holds under a condition alone, by its question or its topic."""
    q, t = F.coalesce(question, F.lit("")), F.coalesce(topic, F.lit(""))
    return q.rlike(CONDITION) | F.substring(q, 1, 40).rlike(CONDITION_END) | t.rlike(CONDITION_END) | F.contains(t, F.lit("시 ")) | F.endswith(t, F.lit("시"))


def terms(text: Column) -> Column:
    """Words of two letters and more without endings and particles, in order."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[가-힣A-Za-z0-9]{2,}"), F.lit(0))
    return F.filter(F.transform(words, lambda w: F.regexp_replace(F.regexp_replace(w, ENDINGS, ""), PARTICLES, "")), lambda w: F.length(w) >= 2)


def investment_only(product: Column, question: Column, basis: Column) -> Column:
    """Items for every product that by their basis or words are for investments alone."""
    marked = F.coalesce(basis, F.lit("")).rlike(INVESTMENT_BASIS) | F.coalesce(question, F.lit("")).rlike(INVESTMENT_WORDS)
    return (product == EVERY) & (direction(question) == "REQUIRE") & marked


def asked_of(items: DataFrame, product: str | None) -> DataFrame:
    """Items (product, question, basis) that an advertisement of ``product`` is asked; of an unknown product, all."""
    if product is None:
        return items
    chosen = items.where(F.col("product").isin(product, EVERY))
    return chosen if product == INVESTMENT else chosen.where(~investment_only(F.col("product"), F.col("question"), F.col("basis")))


def answered(items: DataFrame, responses: DataFrame, batch: str = "batch", item: str = "item", response: str = "response") -> DataFrame:
    """Every expected item with its verdict from its batch's response, and how that came about.

    A response holds one JSON array, from the first bracket to the last; of its elements those that are objects with an
    id count, the last of an id. ``state``: ``no_response`` (none came), ``no_array``,
    ``unreadable``, ``left_out`` (the array has no such item) or ``judged``; without a judgement the verdict is null.
    """
    raw = F.regexp_extract(response, r"(?s)\[.*\]", 0)
    parsed = F.try_parse_json(raw)
    # elements are read one by one: what is no object is passed over, whatever stands beside it
    elements = F.coalesce(F.try_variant_get(parsed, "$", "array<variant>"), F.array().cast("array<variant>"))
    named = lambda x, name: F.try_variant_get(x, f"$.{name}", "string")
    listed = F.filter(F.transform(elements, lambda x: F.struct(named(x, "id").alias("id"), named(x, "verdict").alias("verdict"), named(x, "reason").alias("reason"))), lambda x: x["id"].isNotNull())
    read = responses.select(batch, F.lit(True).alias("_came"), raw.alias("_raw"), listed.alias("_list"), parsed.isNotNull().alias("_json"))
    rows = items.join(read, batch, "left")
    mine = F.try_element_at(F.filter("_list", lambda x: x["id"] == F.col(item)), F.lit(-1))
    rows = rows.withColumn("_mine", mine)
    state = F.when(F.col("_came").isNull(), "no_response").when(F.col("_raw") == "", "no_array").when(~F.col("_json"), "unreadable").when(F.col("_mine").isNull(), "left_out").otherwise("judged")
    return rows.select(*items.columns, state.alias("state"), F.col("_mine.verdict").alias("verdict"), F.col("_mine.reason").alias("reason"))
