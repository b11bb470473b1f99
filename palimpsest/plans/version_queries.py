"""Version histories on stand-ins: customers are documents, orders their versions, lineitems the sections; events are polls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import versions as V
from .registry import query, table

_SECTION = "l_partkey || '|' || l_quantity::BIGINT || '|' || l_returnflag"
_PAIRS = f"""v AS (SELECT o_custkey, o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS old_key FROM orders),
    p AS (SELECT * FROM v WHERE old_key IS NOT NULL), s AS (SELECT l_orderkey, l_linenumber, {_SECTION} AS content FROM lineitem),
    o AS (SELECT o_orderkey AS change, l_linenumber AS section_key, content FROM p JOIN s ON l_orderkey = old_key), n AS (SELECT o_orderkey AS change, l_linenumber AS section_key, content FROM p JOIN s ON l_orderkey = o_orderkey),
    d AS (SELECT coalesce(o.change, n.change) AS change, coalesce(o.section_key, n.section_key) AS section_key, o.content AS old_content, n.content AS new_content,
      CASE WHEN o.change IS NULL THEN 'added' WHEN n.change IS NULL THEN 'removed' ELSE 'modified' END AS change_type
      FROM o FULL JOIN n ON o.change = n.change AND o.section_key = n.section_key WHERE o.change IS NULL OR n.change IS NULL OR o.content <> n.content)"""


def _order_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order of a customer against the one before it, section by section."""
    versions = V.with_previous(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderkey", "old_key").where("old_key is not null").select("o_orderkey", "old_key")
    content = F.concat_ws("|", F.col("l_partkey").cast("string"), F.col("l_quantity").cast("bigint").cast("string"), "l_returnflag")
    sections = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("section_key"), content.alias("content"))
    old = versions.join(sections, F.col("old_key") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("change"), "section_key", "content")
    new = versions.join(sections, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("change"), "section_key", "content")
    return V.section_diff(old, new, ["change", "section_key"])


@query(f"WITH {_PAIRS} SELECT change, section_key, old_content, new_content, change_type FROM d")
def section_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_diff(spark, sf_dir)


@query(f"WITH {_PAIRS}, c AS (SELECT change, count(*) FILTER (WHERE change_type = 'added') AS n_added, count(*) FILTER (WHERE change_type = 'removed') AS n_removed, count(*) FILTER (WHERE change_type = 'modified') AS n_modified FROM d GROUP BY change) SELECT *, 'added ' || n_added || ' · removed ' || n_removed || ' · modified ' || n_modified AS summary FROM c")
def section_diff_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.diff_summary(_order_diff(spark, sf_dir), ["change"])


_BEFORE = "(PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_POLLS = f"""e AS (SELECT event_id, user_id, ts, event_type AS k, regexp_extract(props, '[0-9]+') AS h FROM events),
    p AS (SELECT *, last_value(CASE WHEN k <> 'error' THEN k END IGNORE NULLS) OVER {_BEFORE} AS pk, last_value(CASE WHEN k <> 'error' THEN h END IGNORE NULLS) OVER {_BEFORE} AS ph FROM e),
    s AS (SELECT event_id, user_id, CASE WHEN k = 'error' THEN 'error' WHEN pk IS NULL THEN 'new' WHEN k <> pk THEN 'changed' WHEN h <> ph THEN 'changed' ELSE 'same' END AS status FROM p)"""


def poll_states(events: DataFrame) -> DataFrame:
    """Every poll of a target against the last good poll before it."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    digest, good = F.regexp_extract("props", "[0-9]+", 0), F.col("event_type") != "error"
    status = V.poll_status(V.last_good("event_type", good, w), F.col("event_type"), V.last_good(digest, good, w), digest, F.when(~good, F.lit("error")))
    return events.select("event_id", "user_id", status.alias("status"))


@query("""WITH n AS (SELECT l_orderkey, count(*) AS sections FROM lineitem GROUP BY ALL),
    v AS (SELECT o_custkey AS name, o_orderpriority AS key, (o_orderkey % 4)::VARCHAR AS hash, o_orderstatus, coalesce(sections, 0) AS sections, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS a, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS b FROM orders LEFT JOIN n ON l_orderkey = o_orderkey),
    p AS (SELECT name, CASE WHEN key = '5-LOW' THEN NULL ELSE key END AS key, hash, sections, o_orderstatus = 'F' AS failed FROM v WHERE b = 1),
    j AS (SELECT p.*, s.key AS pk, s.hash AS ph, s.sections AS ps FROM p LEFT JOIN v s ON s.name = p.name AND s.a = 1 AND s.b > 1),
    c AS (SELECT *, CASE WHEN failed THEN 'error' WHEN key IS NULL THEN 'not_found' WHEN (pk IS NULL OR key <> pk OR hash <> ph) AND coalesce(ps > 3 AND (sections = 0 OR sections < ps * 0.5), false) THEN 'blocked' WHEN pk IS NULL THEN 'new' WHEN key <> pk OR hash <> ph THEN 'changed' ELSE 'same' END AS status FROM j)
    SELECT name, status, status IN ('new', 'changed') AS advance FROM c""")
def poll_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last order of a customer as a poll against the first as the state kept: failed, missing and collapsed ones do not advance."""
    sections = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("sections"))
    versions = table(spark, sf_dir, "orders").join(sections, "o_orderkey", "left").select(F.col("o_custkey").alias("name"), F.col("o_orderpriority").alias("key"), (F.col("o_orderkey") % 4).cast("string").alias("hash"), F.coalesce("sections", F.lit(0)).alias("sections"), "o_orderstatus", "o_orderdate", "o_orderkey")
    w = Window.partitionBy("name")
    placed = versions.withColumns({"a": F.row_number().over(w.orderBy("o_orderdate", "o_orderkey")), "b": F.row_number().over(w.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))})
    polls = placed.where("b = 1").select("name", F.when(F.col("key") != "5-LOW", F.col("key")).alias("key"), "hash", "sections", F.when(F.col("o_orderstatus") == "F", F.lit("down")).alias("error"))
    return V.classify_polls(polls, placed.where("a = 1 and b > 1")).select("name", "status", "advance")


@query(f"WITH {_POLLS} SELECT event_id, user_id, status FROM s")
def change_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return poll_states(table(spark, sf_dir, "events"))


@query(f"WITH {_POLLS} SELECT user_id, count(*) AS n, " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS n_{s}" for s in ("new", "changed", "same", "error", "not_found", "blocked")) + " FROM s GROUP BY user_id")
def change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.status_counts(poll_states(table(spark, sf_dir, "events")), ["user_id"])


@query("""WITH d AS (SELECT user_id, CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY ALL), o AS (SELECT *, lag(n) OVER (PARTITION BY user_id ORDER BY d) AS old_n FROM d)
    SELECT user_id, strftime(d, '%Y-%m-%d') AS day, old_n, n, coalesce(old_n > 3 AND (n = 0 OR n < old_n * 0.5), false) AS blocked FROM o""")
def collapse_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts of a user against the day before: a fall under half of more than three is held back."""
    days = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("d")).agg(F.count("*").alias("n"))
    days = V.with_previous(days, "user_id", ["d"], "n", "old_n")
    return days.select("user_id", F.date_format("d", "yyyy-MM-dd").alias("day"), "old_n", "n", V.collapsed(F.col("old_n"), F.col("n")).alias("blocked"))


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1 AS is_current FROM orders")
def current_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.with_current(table(spark, sf_dir, "orders"), "o_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "is_current")


@query("SELECT o_custkey, o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous FROM orders")
def previous_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.with_previous(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderkey").select("o_custkey", "o_orderkey", "previous")


@query("""WITH i AS (SELECT s_suppkey + 50 AS s_suppkey, upper(s_name) AS s_name, CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey END AS s_nationkey, s_acctbal + 1 AS s_acctbal FROM supplier)
    SELECT coalesce(i.s_suppkey, s.s_suppkey) AS s_suppkey, coalesce(i.s_name, s.s_name) AS s_name, coalesce(i.s_nationkey, s.s_nationkey) AS s_nationkey, coalesce(s.s_acctbal, i.s_acctbal) AS s_acctbal FROM supplier s FULL JOIN i ON s.s_suppkey = i.s_suppkey""")
def upsert_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier")
    incoming = rows.select((F.col("s_suppkey") + 50).alias("s_suppkey"), F.upper("s_name").alias("s_name"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_nationkey")).alias("s_nationkey"), (F.col("s_acctbal") + 1).alias("s_acctbal"))
    return V.upsert(rows, incoming, ["s_suppkey"], prefer_old=("s_acctbal",))


@query("""WITH e AS (SELECT c_custkey, c_nationkey, c_mktsegment FROM customer WHERE c_acctbal > 0), i AS (SELECT c_custkey, c_nationkey, c_mktsegment FROM customer)
    SELECT min(c_custkey) AS c_custkey, c_nationkey, c_mktsegment FROM i WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.c_nationkey = i.c_nationkey AND e.c_custkey = i.c_custkey) GROUP BY c_nationkey, c_mktsegment, c_custkey""")
def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    return V.insert_if_absent(rows.where("c_acctbal > 0"), rows, ["c_nationkey", "c_custkey"], [F.col("c_custkey")]).drop("c_acctbal")


#: Inline watch profiles: id, codes, names, active.
_PROFILES = [(1, [], [], True), (2, ["purchase"], [], True), (3, ["error", "click"], ["7", "8", "9"], True), (4, ["click"], [], False), (5, [], ["3"], True), (6, ["purchase", "purchase"], ["12"], True)]
_PROFILE_SQL = "prof AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {c or '[]::VARCHAR[]'}, {n or '[]::VARCHAR[]'}, {str(a).lower()})" for i, c, n, a in _PROFILES) + ") t(profile_id, codes, names, active))"


@query(f"""WITH {_PROFILE_SQL} SELECT event_id, profile_id::BIGINT AS profile_id, event_type || ' ' || user_id AS title FROM events JOIN prof ON active AND (len(codes) = 0 OR list_contains(codes, event_type)) AND (len(names) = 0 OR list_contains(names, user_id::VARCHAR))""")
def notify_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = spark.createDataFrame(_PROFILES, "profile_id long, codes array<string>, names array<string>, active boolean")
    changes = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("code"), F.col("user_id").cast("string").alias("name"))
    return V.fan_out(changes, profiles).select("event_id", "profile_id", F.concat_ws(" ", "code", "name").alias("title"))


@query("""WITH f AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d FROM events WHERE event_type = 'error'), u AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d FROM events WHERE event_type = 'purchase')
    SELECT user_id, strftime(d, '%Y-%m-%d') AS day FROM f WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.user_id = f.user_id AND u.d = f.d)""")
def notify_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One failure notice a user and day, unless one is already there unread (here: a purchase of that day)."""
    rows = table(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    failures = rows.where("event_type = 'error'").select("user_id", "day")
    return V.unread_once(failures, rows.where("event_type = 'purchase'"), ["user_id", "day"])


# -- the read interface ------------------------------------------------------


@query("SELECT (SELECT count(*) FROM customer) AS documents, (SELECT count(*) FROM orders) AS versions, (SELECT count(*) FROM lineitem) AS sections, (SELECT count(*) FROM events WHERE event_type = 'error') AS failures, (SELECT max(t) FROM (SELECT max(o_orderdate) AS t FROM orders UNION ALL SELECT max(l_shipdate) FROM lineitem)) AS newest")
def api_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda t, where="true": table(spark, sf_dir, t).where(where).agg(F.count("*"))
    newest = table(spark, sf_dir, "orders").agg(F.max("o_orderdate").alias("t")).union(table(spark, sf_dir, "lineitem").agg(F.max("l_shipdate"))).agg(F.max("t").alias("newest"))
    return one("customer").toDF("documents").crossJoin(one("orders").toDF("versions")).crossJoin(one("lineitem").toDF("sections")).crossJoin(one("events", "event_type = 'error'").toDF("failures")).crossJoin(newest)


def list_documents(spark: SparkSession, sf_dir: str, source: str | None = None, include_inactive: bool = False) -> DataFrame:
    """Documents with their source, current version and numbers of versions; parameters that are null filter nothing."""
    orders = table(spark, sf_dir, "orders")
    counts = orders.groupBy("o_custkey").agg(F.count("*").alias("n_versions"), F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("current_version"))
    dims = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, sf_dir, "customer").join(dims, F.col("c_nationkey") == F.col("n_nationkey")).join(counts, F.col("c_custkey") == F.col("o_custkey"), "left")
    if source is not None:
        rows = rows.where(F.col("r_name") == source)
    if not include_inactive:
        rows = rows.where("c_acctbal >= 0")
    return rows.select("c_custkey", "c_name", F.col("n_name").alias("source_name"), F.col("r_name").alias("source_code"), "current_version", F.coalesce("n_versions", F.lit(0)).alias("n_versions"))


@query("SELECT c_custkey, c_name, n_name AS source_name, r_name AS source_code, (SELECT max_by(o_orderkey, {'d': o_orderdate, 'k': o_orderkey}) FROM orders WHERE o_custkey = c_custkey) AS current_version, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_versions FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE c_acctbal >= 0")
def api_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return list_documents(spark, sf_dir)


def list_changes(spark: SparkSession, sf_dir: str, limit: int = 50, offset: int = 0, source: str | None = None) -> DataFrame:
    """A page of changes, newest first, with old and new version keys."""
    versions = V.with_previous(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderkey", "old_version")
    old = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("old_version"), F.col("o_orderstatus").alias("old_key"))
    rows = versions.join(old, "old_version", "left").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    if source is not None:
        rows = rows.where(F.col("n_name") == source)
    page = rows.select(F.col("o_orderkey").alias("change_id"), "c_name", F.col("n_name").alias("source_name"), "old_version", "old_key", F.col("o_orderstatus").alias("new_key"), F.col("o_orderdate").alias("created_at"))
    return page.orderBy(F.desc("created_at"), F.desc("change_id")).offset(offset).limit(limit)


@query("""WITH v AS (SELECT *, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS old_version FROM orders)
    SELECT v.o_orderkey AS change_id, c_name, n_name AS source_name, v.old_version, o.o_orderstatus AS old_key, v.o_orderstatus AS new_key, v.o_orderdate AS created_at
    FROM v LEFT JOIN orders o ON o.o_orderkey = v.old_version JOIN customer ON c_custkey = v.o_custkey JOIN nation ON n_nationkey = c_nationkey ORDER BY created_at DESC, change_id DESC LIMIT 50 OFFSET 50""")
def api_changes_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return list_changes(spark, sf_dir, 50, 50)


@query("SELECT doc_id, CASE WHEN length(text) > 400 THEN substr(text, 1, 400) || chr(10) || '…(' || (length(text) - 400) || ' more)' ELSE text END AS content FROM documents")
def api_change_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.truncated(F.col("text"), 400).alias("content"))


def list_sections(spark: SparkSession, sf_dir: str, kind: str | None = None, include_content: bool = True) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    if kind is not None:
        rows = rows.where(F.col("lang") == kind)
    return rows.select("doc_id", "lang", (F.col("text") if include_content else F.substring("text", 1, 120)).alias("content"), F.sha2("text", 256).alias("content_hash"))


@query("SELECT doc_id, lang, substr(text, 1, 120) AS content, sha256(text) AS content_hash FROM documents WHERE lang = 'fr'")
def api_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return list_sections(spark, sf_dir, "fr", False)


@query("""SELECT event_id, user_id, CASE WHEN o_orderkey IS NULL THEN 'failure' ELSE 'change' END AS kind, c_name FROM events LEFT JOIN orders ON o_orderkey = event_id AND event_type <> 'error' LEFT JOIN customer ON c_custkey = o_custkey""")
def api_notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notices with what they are about; those without a change stay, so both joins are left."""
    events, orders, customers = (table(spark, sf_dir, t) for t in ("events", "orders", "customer"))
    rows = events.join(orders, (F.col("o_orderkey") == F.col("event_id")) & (F.col("event_type") != "error"), "left").join(customers, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.select("event_id", "user_id", F.when(F.col("o_orderkey").isNull(), "failure").otherwise("change").alias("kind"), "c_name")


def search_text(docs: DataFrame, q: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Substring search that folds case, with a snippet around the first exact match. Queries have two characters at least."""
    if len(q) < 2:
        raise ValueError("a query has two characters at least")
    part, at = T.snippet(F.col(text_col), q)
    rows = docs.where(F.col(text_col).ilike(f"%{q}%"))
    return rows.select(id_col, F.when(at > 61, F.concat(F.lit("…"), part)).otherwise(part).alias("snippet"), at.cast("long").alias("match_pos"))


@query("SELECT doc_id, CASE WHEN instr(text, 'license') > 61 THEN '…' ELSE '' END || substr(text, greatest(1, instr(text, 'license') - 60), 240) AS snippet, instr(text, 'license') AS match_pos FROM documents WHERE text ILIKE '%license%'")
def text_search_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_text(table(spark, sf_dir, "documents"), "license")
