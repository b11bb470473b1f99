"""Checklists on stand-ins: every part is an item whose question, product, topic and basis follow from its number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import checklist as K
from ..operators import matching as M
from ..operators import review as V
from .registry import query, table

_HEADS = ("", "(예금의 경우) ", "광고하는 경우 ")
_BODIES = ("수수료를 표시하였는가", "확정수익을 보장하지 않았는가", "펀드 위험을 기재하였는가", "금리 과장이 없는가", "심의필 번호가 있는가")
_PRODUCTS = ("전체", "예금", "투자", "대출")


def _of(values: tuple[str, ...], number: F.Column) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (number % len(values) + 1).cast("int"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    columns = [F.concat(_of(_HEADS, p), _of(_BODIES, p)).alias("question"), _of(_PRODUCTS, p).alias("product")]
    columns += [F.when(p % 6 == 0, "전송 시 준수사항").otherwise("일반").alias("topic"), F.when(p % 7 == 0, "협회규정 제3조").otherwise("금소법").alias("basis")]
    return table(spark, sf_dir, "part").select(p.alias("item"), *columns)


_ONLY = "item % 4 = 0 AND item % 5 IN (0, 2, 4) AND (item % 7 = 0 OR item % 5 = 2)"


@query(f"""SELECT item, CASE WHEN item % 5 IN (1, 3) THEN 'PROHIBIT' ELSE 'REQUIRE' END AS direction, item % 3 <> 0 OR item % 6 = 0 AS conditional, {_ONLY} AS investment_only,
    CASE item % 3 WHEN 0 THEN '' WHEN 1 THEN '예금 경우 ' ELSE '광고 경우 ' END || CASE item % 5 WHEN 0 THEN '수수료 표시' WHEN 1 THEN '확정수익 보장하지' WHEN 2 THEN '펀드 위험 기재' WHEN 3 THEN '금리 과장' ELSE '심의필 번호' END AS terms
    FROM (SELECT p_partkey AS item FROM part)""")
def checklist_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which way each item points, whether it has a condition, whether it is for investments alone, and its terms."""
    q = F.col("question")
    return _items(spark, sf_dir).select("item", K.direction(q).alias("direction"), K.conditional(q, F.col("topic")).alias("conditional"), K.investment_only(F.col("product"), q, F.col("basis")).alias("investment_only"), F.array_join(K.terms(q), " ").alias("terms"))


@query(f"SELECT item FROM (SELECT p_partkey AS item FROM part) WHERE item % 4 IN (0, 1) AND NOT ({_ONLY})")
def checklist_for_ad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items that a deposit advertisement is asked."""
    return K.asked_of(_items(spark, sf_dir), "예금").select("item")


@query("""SELECT 'CL-' || item AS item, CASE batch % 5 WHEN 0 THEN 'no_response' WHEN 1 THEN 'no_array' WHEN 2 THEN 'unreadable' ELSE CASE WHEN item % 7 = 0 THEN 'left_out' ELSE 'judged' END END AS state,
    CASE WHEN batch % 5 > 2 AND item % 7 <> 0 THEN CASE WHEN item % 2 = 0 THEN 'OK' ELSE 'NG' END END AS verdict FROM (SELECT p_partkey AS item, p_partkey // 12 AS batch FROM part)""")
def audit_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item asked in batches of twelve, with what its batch's answer says of it, or why it says nothing."""
    p = F.col("p_partkey")
    batch = F.floor(p / 12).cast("long")
    items = table(spark, sf_dir, "part").select(p, batch.alias("batch"), F.concat(F.lit("CL-"), p.cast("string")).alias("item"))
    verdict = F.struct(F.col("item").alias("id"), F.when(p % 2 == 0, "OK").otherwise("NG").alias("verdict"), F.lit("why [so]").alias("reason"))
    said = items.groupBy("batch").agg(F.to_json(F.collect_list(F.when(p % 7 != 0, verdict))).alias("json"))
    b = F.col("batch") % 5
    said = said.where(b != 0).select("batch", F.when(b == 1, "no list at all").when(b == 2, "it is [ {broken ]").otherwise(F.concat(F.lit("answer: "), "json", F.lit(" done"))).alias("response"))
    return K.answered(items.select("batch", "item"), said).select("item", "state", "verdict")


@query("""SELECT o_orderkey, o_orderkey % 4 IN (0, 3) AS shell, o_orderkey % 4 IN (0, 3) OR o_custkey % 5 = 0 AS deleted FROM orders""")
def deleted_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shells of deleted rules, and articles deleted by title or by how they begin."""
    m = F.col("o_orderkey") % 4
    body = F.when(m == 0, "제5조 삭제 <2019. 1. 1.>").when(m == 1, "제5조(목적) 본문").when(m == 2, F.concat(F.repeat(F.lit("가"), 130), F.lit("삭제 <2019>"))).otherwise("<삭제>")
    title = F.when(F.col("o_custkey") % 5 == 0, "제5조 (삭제)").otherwise("제5조")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", body.alias("body"), title.alias("title"))
    return rows.select("o_orderkey", V.deleted_shell(F.col("body")).alias("shell"), V.deleted_article(F.col("title"), F.col("body")).alias("deleted"))


@query("SELECT o_orderkey, strftime(greatest(o_orderdate::DATE, o_orderdate::DATE - (o_custkey % 40)::INT), '%Y-%m-%d') AS latest FROM orders")
def latest_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest of the dates at a text's head, written in different ways; one far down does not count."""
    day = F.to_date("o_orderdate")
    other = F.date_sub(day, (F.col("o_custkey") % 40).cast("int"))
    text = F.concat(F.lit("시행 "), F.date_format(other, "yyyy. M. d."), F.lit(" 개정 "), F.date_format(day, "yyyy.MM.dd"), F.repeat(F.lit(" x"), 800), F.lit(" 2999. 1. 1."))
    return table(spark, sf_dir, "orders").select("o_orderkey", V.latest_date(text).alias("latest"))


@query("SELECT lang, sum(length(text))::BIGINT AS chars, round(sum(length(text)) / sum(sum(length(text))) OVER (), 6) AS share FROM documents GROUP BY lang")
def char_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.char_shares(table(spark, sf_dir, "documents"), "lang", "text")


@query("SELECT toxic::BIGINT AS expected, count(*) AS n, round(avg(CASE WHEN (doc_id % 3 = 0) = (toxic = 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM labels GROUP BY toxic")
def directional_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a verdict is right, for what should pass and for what should not."""
    rows = table(spark, sf_dir, "labels").select(F.col("toxic").cast("long").alias("expected"), (F.col("doc_id") % 3 == 0).cast("long").alias("verdict"))
    return V.accuracy_by(rows, "expected", "verdict")


_SEVERITY = ("error", "warn", "info")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END, event_id) AS place FROM events")
def severity_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of each target, the gravest first."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", _of(_SEVERITY, F.col("event_id")).alias("severity"))
    return V.by_severity(rows, "user_id", "severity", "event_id", _SEVERITY).select("event_id", "place")


@query("""SELECT o_custkey, array_to_string(list_slice(ks, 1, 5), ', ') || CASE WHEN len(ks) > 5 THEN ' +' || (len(ks) - 5) || ' more' ELSE '' END AS shown FROM (SELECT o_custkey, list(o_orderkey::VARCHAR ORDER BY o_orderkey) AS ks FROM orders GROUP BY ALL)""")
def capped_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five versions of each document and how many there are beside."""
    return V.capped(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", 5, "shown")


@query("""WITH f AS (SELECT p_partkey // 2 AS stem, CASE WHEN p_partkey % 2 = 0 THEN 'hwp' ELSE 'pdf' END AS ext FROM part WHERE p_partkey % 7 <> 0)
    SELECT 'file.' || stem || '.hwp' AS name, EXISTS (SELECT 1 FROM f g WHERE g.stem = f.stem AND g.ext = 'pdf') AS twin FROM f WHERE ext = 'hwp'""")
def file_twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which files have one of the same stem in another format."""
    p = F.col("p_partkey")
    name = F.concat(F.lit("file."), F.floor(p / 2).cast("string"), F.when(p % 2 == 0, ".hwp").otherwise(".PDF"))
    return M.twins(table(spark, sf_dir, "part").where(p % 7 != 0).select(name.alias("name")), "name", "hwp", "pdf")


@query("""WITH t AS (SELECT p_partkey AS target, p_partkey % 50 AS no, p_partkey % 3 AS branch, CASE WHEN p_partkey % 2 = 0 THEN 'form' ELSE 'table' END AS kind, 'f' || p_partkey AS file FROM part WHERE p_partkey % 4 <> 0),
    r AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 3 = 0 THEN 'f' || l_partkey END AS file, CASE WHEN l_suppkey % 3 = 1 THEN CASE WHEN l_partkey % 2 = 0 THEN 'form' ELSE 'table' END END AS kind, l_partkey % 60 AS no, l_partkey % 3 AS branch FROM lineitem),
    a AS (SELECT file, min(target) AS t FROM t GROUP BY ALL), b AS (SELECT kind, no, branch, min(target) AS t FROM t GROUP BY ALL), c AS (SELECT no, branch, min(target) AS t FROM t GROUP BY ALL HAVING count(DISTINCT target) = 1)
    SELECT l_orderkey, l_linenumber, coalesce(a.t, b.t, c.t) AS target, CASE WHEN a.t IS NOT NULL THEN 0 WHEN b.t IS NOT NULL THEN 1 WHEN c.t IS NOT NULL THEN 2 END::BIGINT AS how
    FROM r LEFT JOIN a USING (file) LEFT JOIN b ON b.kind = r.kind AND b.no = r.no AND b.branch = r.branch LEFT JOIN c ON c.no = r.no AND c.branch = r.branch""")
def guarded_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to attachments by file, else by kind and number, else by number where that is not ambiguous."""
    p, q = F.col("p_partkey"), F.col("l_partkey")
    kind = lambda x: F.when(x % 2 == 0, "form").otherwise("table")
    targets = table(spark, sf_dir, "part").where(p % 4 != 0).select(p.alias("target"), (p % 50).alias("no"), (p % 3).alias("branch"), kind(p).alias("kind"), F.concat(F.lit("f"), p.cast("string")).alias("file"))
    s = F.col("l_suppkey") % 3
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(s == 0, F.concat(F.lit("f"), q.cast("string"))).alias("file"), F.when(s == 1, kind(q)).alias("kind"), (q % 60).alias("no"), (q % 3).alias("branch"))
    return M.link_with_guard(rows, targets, "target", [["file"], ["kind", "no", "branch"], ["no", "branch"]]).select("l_orderkey", "l_linenumber", "target", "how")


@query("""WITH a AS (SELECT DISTINCT item_id, unnest(list_distinct(regexp_extract_all(lower(substr(text, 1, 60)), '[a-z0-9]+'))) AS t FROM benchmark), b AS (SELECT DISTINCT page_id, unnest(list_distinct(regexp_extract_all(lower(url), '[a-z0-9]+'))) AS t FROM pages),
    s AS (SELECT item_id, page_id, count(*) AS n FROM a JOIN b USING (t) GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, page_id) AS r FROM s)
    SELECT item_id, page_id, n AS shared FROM (SELECT DISTINCT item_id FROM benchmark) LEFT JOIN (SELECT * FROM k WHERE r = 1) USING (item_id)""")
def overlap_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page whose address shares most words with each item's head; the least of equals."""
    items = table(spark, sf_dir, "benchmark").select("item_id", T.latin_tokens(F.substring("text", 1, 60)).alias("tokens"))
    pages = table(spark, sf_dir, "pages").select("page_id", T.latin_tokens(F.col("url")).alias("tokens"))
    return M.most_overlap(items, "item_id", pages, "page_id", "tokens")


@query("SELECT p_partkey, p_partkey % 3 <> 1 AS chosen FROM part")
def name_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets by parts of their names, spaces aside."""
    name = _of(("금융 소비자 보호 법", "은행 업 감독 규정", "여신 전문 금융업법"), F.col("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey", T.names_any(name, ["소비자보호", "전문금융 업"]).alias("chosen"))


@query("SELECT doc_id, coalesce(nullif(lang, 'en'), '') || ' ' || doc_id || ' ' || substr(text, 1, 40) AS index_text, contains(regexp_replace(text, '\\s', '', 'g'), 'of' || 'the') AS present, regexp_replace(regexp_replace(text, '<[^>]*>|\\[[^\\]]*\\]', '', 'g'), '[\\s\"'']', '', 'g') AS compared FROM documents")
def compared_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index text without a token for what is absent; presence and comparison without white space."""
    text = F.col("text")
    index = T.index_text(F.nullif("lang", F.lit("en")), F.col("doc_id").cast("string"), F.substring(text, 1, 40))
    return table(spark, sf_dir, "documents").select("doc_id", index.alias("index_text"), T.present(text, "of the").alias("present"), T.compared(text).alias("compared"))
