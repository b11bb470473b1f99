"""Versions of documents: detection, collapse gate, diffs, one current version, upserts, notifications.

Tables are append-only; each constraint a database would hold is a window or an anti-join here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: States of a poll.
NEW, CHANGED, SAME, FAILED, MISSING, BLOCKED = "new", "changed", "same", "error", "not_found", "blocked"


def collapsed(old: Column, new: Column, ratio: float = 0.5, floor: int = 3) -> Column:
    """Whether a collection shrank so far that it is held back: to nothing, or under ``ratio`` of more than ``floor``."""
    return F.coalesce((old > floor) & ((new == 0) | (new < old * ratio)), F.lit(False))


def poll_status(prev_key: Column, key: Column, prev_hash: Column, hash_: Column, error: Column | None = None, old_count: Column | None = None, new_count: Column | None = None) -> Column:
    """The state of a poll against the last state kept. A hash seen for the first time is only noted, it is no change."""
    status = F.when(prev_key.isNull(), NEW).when(~key.eqNullSafe(prev_key), CHANGED).when(hash_.isNotNull() & prev_hash.isNotNull() & (hash_ != prev_hash), CHANGED).otherwise(SAME)
    status = F.when(key.isNull(), MISSING).otherwise(status)
    if old_count is not None and new_count is not None:
        status = F.when(status.isin(NEW, CHANGED) & collapsed(old_count, new_count), BLOCKED).otherwise(status)
    return F.when(error.isNotNull(), FAILED).otherwise(status) if error is not None else status


def last_good(value: str | Column, good: Column, over) -> Column:
    """``value`` of the last good poll before this one in the window: failed and missing polls leave the state alone."""
    return F.last(F.when(good, F.col(value) if isinstance(value, str) else value), ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1))


def classify_polls(polls: DataFrame, state: DataFrame, name: str = "name") -> DataFrame:
    """Polls left-joined to the last state; ``advance`` says whether the new state replaces the old."""
    kept = state.select(name, *[F.col(c).alias(f"prev_{c}") for c in ("key", "hash", "sections")])
    row = polls.join(kept, name, "left")
    status = poll_status(F.col("prev_key"), F.col("key"), F.col("prev_hash"), F.col("hash"), F.col("error"), F.col("prev_sections"), F.col("sections"))
    return row.withColumn("status", status).withColumn("advance", F.col("status").isin(NEW, CHANGED) | ((F.col("status") == SAME) & F.col("prev_hash").isNull() & F.col("hash").isNotNull()))


def status_counts(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    return rows.groupBy(*(by or [])).agg(F.count("*").alias("n"), *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in (NEW, CHANGED, SAME, FAILED, MISSING, BLOCKED)])


def section_diff(old: DataFrame, new: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """Keyed full outer join: added, removed and modified sections; equal ones are dropped."""
    a = old.select(*keys, F.col(content).alias("old_content"), F.lit(True).alias("_old"))
    b = new.select(*keys, F.col(content).alias("new_content"), F.lit(True).alias("_new"))
    kind = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(~F.col("old_content").eqNullSafe(F.col("new_content")), "modified")
    return a.join(b, keys, "full").withColumn("change_type", kind).where("change_type is not null").drop("_old", "_new")


def diff_summary(diff: DataFrame, by: list[str]) -> DataFrame:
    """Counters of a change and its summary line."""
    counts = diff.groupBy(*by).agg(*[F.count_if(F.col("change_type") == t).alias(f"n_{t}") for t in ("added", "removed", "modified")])
    return counts.withColumn("summary", F.format_string("added %d · removed %d · modified %d", "n_added", "n_removed", "n_modified"))


def with_current(versions: DataFrame, owner: str, order: list[Column], flag: str = "is_current") -> DataFrame:
    """Exactly one current version of each owner: the last by ``order``."""
    w = Window.partitionBy(owner).orderBy(*order)
    return versions.withColumn(flag, F.row_number().over(w) == 1)


def with_previous(versions: DataFrame, owner: str, order: list[str], value: str, out: str = "previous") -> DataFrame:
    return versions.withColumn(out, F.lag(value).over(Window.partitionBy(owner).orderBy(*order)))


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], prefer_old: tuple[str, ...] = ()) -> DataFrame:
    """Incoming values win where they are not null; for ``prefer_old`` columns existing ones do."""
    values = [c for c in existing.columns if c not in keys]
    a = existing.select(*keys, *[F.col(c).alias(f"_a_{c}") for c in values])
    b = incoming.select(*keys, *[F.col(c).alias(f"_b_{c}") for c in values])
    merged = [F.coalesce(*((f"_a_{c}", f"_b_{c}") if c in prefer_old else (f"_b_{c}", f"_a_{c}"))).alias(c) for c in values]
    return a.join(b, keys, "full").select(*keys, *merged)


def insert_if_absent(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Incoming rows whose keys do not exist yet, the first of each. Nulls in keys never collide."""
    fresh = incoming.join(existing.select(*keys).distinct(), keys, "left_anti")
    nullable = F.when(sum((F.col(k).isNull().cast("int") for k in keys), F.lit(0)) > 0, F.monotonically_increasing_id()).otherwise(F.lit(-1))
    w = Window.partitionBy(*keys, "_null").orderBy(*order)
    return fresh.withColumn("_null", nullable).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_null")


def fan_out(changes: DataFrame, profiles: DataFrame, code: str = "code", name: str = "name") -> DataFrame:
    """A notification for each active profile and change that its code and name filters let pass; empty filters pass all.

    Code filters are equalities, so subscriptions are exploded to (code or *) and met by an equi join; only the name
    filter is a predicate on what has met.
    """
    active = profiles.where(F.coalesce("active", F.lit(True)))
    wild = F.when(F.coalesce(F.size("codes"), F.lit(0)) <= 0, F.array(F.lit("*"))).otherwise(F.array_distinct("codes"))
    asked = active.select("profile_id", "names", F.explode(wild).alias("_code"))
    told = changes.select("*", F.explode(F.array(F.col(code), F.lit("*"))).alias("_code"))
    named = (F.coalesce(F.size("names"), F.lit(0)) <= 0) | F.coalesce(F.array_contains("names", F.col(name)), F.lit(False))
    return told.join(asked, "_code").where(named).drop("_code", "names")


def unread_once(failures: DataFrame, unread: DataFrame, keys: list[str]) -> DataFrame:
    """Failure notices that no unread notice of the same keys stands for already."""
    return failures.dropDuplicates(keys).join(unread.select(*keys).distinct(), keys, "left_anti")


def fresh_notices(notices: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Notices of a fan-out that are not stored yet, each once: an insert that ignores what is there."""
    return notices.dropDuplicates(keys).join(existing.select(*keys).distinct(), keys, "left_anti")


def marked_read(notices: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """(key, state): ``read`` for asked notices, ``not_found`` for asked ids without one, ``as it was`` for the rest."""
    met = notices.select(key, F.lit(True).alias("_there")).join(asked.select(key, F.lit(True).alias("_asked")).distinct(), key, "full")
    return met.select(key, F.when(F.col("_there").isNull(), "not_found").when(F.col("_asked").isNull(), "as it was").otherwise("read").alias("state"))


def without(gone: DataFrame, key: str, tables: dict[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """Tables (rows, name of their key) without what hangs on ``gone`` keys; rows whose key is null stay."""
    return {name: rows.join(gone.select(F.col(key).alias("_gone")).distinct(), F.col(of) == F.col("_gone"), "left_anti") for name, (rows, of) in tables.items()}


def reconciled(stored: DataFrame, live: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Stored rows against live ones: ``not_live``, ``differs`` in any of ``values``, or ``agrees``."""
    now = live.select(*keys, F.lit(True).alias("_live"), *[F.col(v).alias(f"_{v}") for v in values])
    differs = F.lit(False)
    for v in values:
        differs |= ~F.col(v).eqNullSafe(F.col(f"_{v}"))
    return stored.join(now, keys, "left").select(*keys, F.when(F.col("_live").isNull(), "not_live").when(differs, "differs").otherwise("agrees").alias("state"))


def ids_and_new(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Existing rows and the incoming ones that were absent, with ``is_new``."""
    fresh = insert_if_absent(existing, incoming, keys, order)
    return existing.withColumn("is_new", F.lit(False)).unionByName(fresh.withColumn("is_new", F.lit(True)))
