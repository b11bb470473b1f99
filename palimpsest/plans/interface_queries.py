"""The read interface on stand-ins: customers are documents, orders their versions, events notices and polls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import versions as V
from .registry import query, table
from .version_queries import _PAIRS, _order_diff, list_changes


def document_detail(spark: SparkSession, sf_dir: str, document: int | None = None) -> DataFrame:
    """A document, or all, with its versions newest first, each with the number of its sections."""
    sections = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_sections"))
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    if document is not None:
        orders, customers = orders.where(F.col("o_custkey") == document), customers.where(F.col("c_custkey") == document)
    versions = orders.join(sections, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    newest = F.struct((-F.unix_date(F.to_date("o_orderdate"))).alias("day"), (-F.col("o_orderkey")).alias("key"), F.coalesce("n_sections", F.lit(0)).alias("n"))
    told = versions.groupBy("o_custkey").agg(F.array_sort(F.collect_list(newest)).alias("v"))
    rows = customers.join(told, F.col("c_custkey") == F.col("o_custkey"), "left")
    shown = F.array_join(F.transform(F.coalesce("v", F.array().cast("array<struct<day:int,key:bigint,n:bigint>>")), lambda v: F.concat_ws(":", (-v["key"]).cast("string"), v["n"].cast("string"))), ",")
    return rows.select("c_custkey", "c_name", F.coalesce(F.size("v"), F.lit(0)).cast("long").alias("n_versions"), shown.alias("versions"))


@query("""WITH s AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY ALL), v AS (SELECT o_custkey, count(*) AS n_versions, string_agg(o_orderkey || ':' || coalesce(n, 0), ',' ORDER BY o_orderdate DESC, o_orderkey DESC) AS versions FROM orders LEFT JOIN s ON l_orderkey = o_orderkey GROUP BY ALL)
    SELECT c_custkey, c_name, coalesce(n_versions, 0) AS n_versions, coalesce(versions, '') AS versions FROM customer LEFT JOIN v ON o_custkey = c_custkey""")
def api_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_detail(spark, sf_dir)


def change_detail(spark: SparkSession, sf_dir: str, change: int | None = None, most: int = 4000) -> DataFrame:
    """The sections of a change, or of all, with the keys of both versions and texts of at most ``most`` characters."""
    diff = _order_diff(spark, sf_dir)
    versions = V.with_previous(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderpriority", "old_key")
    if change is not None:
        diff, versions = diff.where(F.col("change") == change), versions.where(F.col("o_orderkey") == change)
    rows = diff.join(versions.select(F.col("o_orderkey").alias("change"), "old_key", F.col("o_orderpriority").alias("new_key")), "change")
    return rows.select("change", "section_key", "change_type", "old_key", "new_key", T.truncated(F.col("old_content"), most).alias("old_content"), T.truncated(F.col("new_content"), most).alias("new_content"))


_CUT = "CASE WHEN length({c}) > 8 THEN substr({c}, 1, 8) || chr(10) || '…(' || (length({c}) - 8) || ' more)' ELSE {c} END AS {c}"


@query(f"WITH {_PAIRS}, k AS (SELECT o_orderkey, o_orderpriority AS new_key, lag(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS old_key FROM orders) SELECT change, section_key, change_type, old_key, new_key, {_CUT.format(c='old_content')}, {_CUT.format(c='new_content')} FROM d JOIN k ON o_orderkey = change")
def api_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return change_detail(spark, sf_dir, None, 8)


@query("SELECT count(*) AS total, 50::BIGINT AS \"limit\", 100::BIGINT AS \"offset\", least(50, greatest(0, count(*) - 100))::BIGINT AS n_items, 0::BIGINT AS n_shared FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey")
def api_page_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page with the total of all, and how many items it shares with the page before it."""
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    page, before = (list_changes(spark, sf_dir, 50, at).select("change_id") for at in (100, 50))
    one = orders.agg(F.count("*").alias("total")).crossJoin(page.agg(F.count("*").alias("n_items"))).crossJoin(page.join(before, "change_id").agg(F.count("*").alias("n_shared")))
    return one.select("total", F.lit(50).cast("long").alias("limit"), F.lit(100).cast("long").alias("offset"), "n_items", "n_shared")


def list_runs(spark: SparkSession, sf_dir: str, limit: int = 20) -> DataFrame:
    """The last runs, newest first: days of polls, with their counts by state."""
    runs = table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("run_id"))
    counts = runs.agg(F.count("*").alias("total_count"), F.count_if(F.col("event_type") == "error").alias("error_count"), F.count_distinct("user_id").alias("n_targets"))
    return counts.withColumn("status", F.when(F.col("error_count") == F.col("total_count"), "failed").when(F.col("error_count") > 0, "partial").otherwise("done")).orderBy(F.desc("run_id")).limit(limit)


@query("""SELECT strftime(ts, '%Y-%m-%d') AS run_id, count(*) AS total_count, count(*) FILTER (WHERE event_type = 'error') AS error_count, count(DISTINCT user_id) AS n_targets,
    CASE WHEN count(*) FILTER (WHERE event_type = 'error') = count(*) THEN 'failed' WHEN count(*) FILTER (WHERE event_type = 'error') > 0 THEN 'partial' ELSE 'done' END AS status FROM events GROUP BY run_id ORDER BY run_id DESC LIMIT 20""")
def api_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return list_runs(spark, sf_dir)


@query("SELECT n_nationkey AS profile_id, CASE WHEN n_nationkey % 4 = 0 THEN r_name ELSE '' END AS codes, CASE WHEN n_nationkey % 4 = 0 THEN 1 ELSE 0 END::BIGINT AS n_codes, n_nationkey % 4 <> 0 AS every_source FROM nation JOIN region ON r_regionkey = n_regionkey")
def api_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Watch profiles with their stored filters read; null, empty and unreadable ones are empty and so pass all."""
    n = F.col("n_nationkey") % 4
    stored = F.when(n == 0, F.concat(F.lit('["'), "r_name", F.lit('"]'))).when(n == 1, "[broken").when(n == 2, "[]")
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = rows.select("n_nationkey", F.coalesce(F.filter(F.from_json(stored, "array<string>"), lambda c: c.isNotNull()), F.array().cast("array<string>")).alias("c"))
    return rows.select(F.col("n_nationkey").alias("profile_id"), F.array_join("c", ",").alias("codes"), F.size("c").cast("long").alias("n_codes"), T.shares_or_empty(F.col("c"), F.array(F.lit("-"))).alias("every_source"))


@query("SELECT coalesce(event_id, o_orderkey) AS notice, CASE WHEN event_id IS NULL THEN 'not_found' WHEN o_orderkey IS NULL THEN 'as it was' ELSE 'read' END AS state FROM events FULL JOIN (SELECT o_orderkey FROM orders WHERE o_custkey % 10 = 0) ON event_id = o_orderkey")
def mark_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notices after some are marked as read; an id without a notice is told as not found."""
    asked = table(spark, sf_dir, "orders").where(F.col("o_custkey") % 10 == 0).select(F.col("o_orderkey").alias("notice"))
    return V.marked_read(table(spark, sf_dir, "events").select(F.col("event_id").alias("notice")), asked, "notice")


@query("""WITH gone AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')
    SELECT 'versions' AS name, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT 'sections', count(*) FROM lineitem WHERE l_orderkey NOT IN (FROM gone) UNION ALL SELECT 'notices', count(*) FROM events WHERE event_id NOT IN (FROM gone)""")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left once some versions go with all that hangs on them."""
    gone = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_orderkey")
    left = V.without(gone, "o_orderkey", {"versions": (table(spark, sf_dir, "orders"), "o_orderkey"), "sections": (table(spark, sf_dir, "lineitem"), "l_orderkey"), "notices": (table(spark, sf_dir, "events"), "event_id")})
    counts = [rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, rows in left.items()]
    return counts[0].union(counts[1]).union(counts[2])


@query("""WITH m AS (SELECT o_orderkey AS k, o_orderpriority AS stored, CASE WHEN o_custkey % 9 = 0 THEN '0-NEW' ELSE o_orderpriority END AS live FROM orders WHERE o_custkey % 11 <> 0)
    SELECT o_orderkey AS k, CASE WHEN m.k IS NULL THEN 'not_live' WHEN stored <> live THEN 'differs' ELSE 'agrees' END AS state FROM orders LEFT JOIN m ON m.k = o_orderkey""")
def stored_and_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored versions against what a source shows now."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("key"), "o_custkey")
    live = orders.where(F.col("o_custkey") % 11 != 0).withColumn("key", F.when(F.col("o_custkey") % 9 == 0, "0-NEW").otherwise(F.col("key")))
    return V.reconciled(orders.drop("o_custkey"), live.drop("o_custkey"), ["k"], ["key"])


@query("SELECT c_custkey, c_name, false AS is_new FROM customer UNION ALL SELECT s_suppkey + 100000000, s_name, true FROM supplier WHERE s_suppkey % 2 = 0")
def ids_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert if absent that gives every document's id and whether it is new: half of what comes is there already."""
    old = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    new = table(spark, sf_dir, "supplier").where(F.col("s_suppkey") % 2 == 0).select((F.col("s_suppkey") + 100_000_000).cast("long").alias("c_custkey"), F.col("s_name").alias("c_name"))
    again = old.where(F.col("c_custkey") % 2 == 0)
    return V.ids_and_new(old, new.union(again), ["c_custkey"], [F.col("c_name")])
