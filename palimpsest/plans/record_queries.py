"""JSON records to sections, on stand-ins: a customer's orders are the articles of one record, order lines its paragraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import records as R
from .registry import query, table


def statute_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, raw): lists, one object in place of a list, lists in place of a text, nulls, numbers and character references."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("ln")).agg(F.max("l_quantity").cast("long").alias("q"), F.max("l_returnflag").alias("rf"), F.max("l_linestatus").alias("ls"))
    ho = F.expr("""if(q % 2 = 0, concat('{"호내용":"', rf, '","목":["', ls, '",{"content":', ln, '}]}'), concat('[{"호내용":"a', ln, '"},{"호내용":null,"목":["m"]}]'))""")
    hang = F.concat(F.expr("""concat('{"항내용":', if(ln % 3 = 0, 'null', concat('"① ', ln, '"')), ',"호":')"""), ho, F.lit("}"))
    nested = items.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("ln", hang.alias("o")))).alias("hs")).select(F.col("l_orderkey").alias("o_orderkey"), F.array_join(F.transform("hs", lambda h: h["o"]), ",").alias("hang"))
    orders = table(spark, sf_dir, "orders").join(nested, "o_orderkey", "left")
    article = F.expr("""concat('{"조문제목":"', o_orderpriority, '","조문번호":', if(o_orderkey % 4 = 0, 'null', cast(o_orderkey % 6 as string)), ',"조문가지번호":"', if(o_orderkey % 3 = 0, '2', '00'), '","조문내용":',
        case when o_orderkey % 8 = 0 then concat('"제', o_orderkey % 6, '조의3 x"') when o_orderkey % 4 = 0 then '"plain"' when o_orderkey % 5 = 0 then concat('["Total &lt;",null,["', o_orderstatus, '"]]') else concat('"', o_orderstatus, ' &amp;lt; ', o_orderkey, '"') end,
        ',"항":[', coalesce(hang, ''), ']}')""")
    articles = orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", article.alias("o")))).alias("a")).select(F.col("o_custkey").alias("c_custkey"), F.array_join(F.transform("a", lambda x: x["o"]), ",").alias("articles"))
    raw = F.expr("""concat('{"조문":[', articles, '],"부칙":', if(c_nationkey % 2 = 0, concat('{"내용":"', c_mktsegment, '","공포일자":"2020', c_nationkey, '"}'), concat('[{"내용":null},{"내용":"', c_mktsegment, '","공포번호":["1","2"]},"stray"]')),
        ',"별표":', case when c_nationkey % 3 = 0 then concat('{"별표번호":', c_nationkey, ',"저장PDF":"p.pdf","저장HWP":"q.hwp"}') when c_nationkey % 3 = 1 then '[{"구분":"별지","별표번호":"1","별표가지번호":"2","내용":"b"}]' else '{}' end, '}')""")
    return table(spark, sf_dir, "customer").join(articles, "c_custkey").select(F.col("c_custkey").alias("doc"), raw.alias("raw"))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber AS ln, max(l_quantity)::BIGINT AS q, max(l_returnflag) AS rf, max(l_linestatus) AS ls FROM lineitem GROUP BY ALL),
    h AS (SELECT l_orderkey, string_agg(CASE WHEN ln % 3 <> 0 THEN '  ① ' || ln || chr(10) ELSE '' END || CASE WHEN q % 2 = 0 THEN '    ' || rf || chr(10) || '      ' || ls || chr(10) || '      ' || ln ELSE '    a' || ln || chr(10) || '      m' END, chr(10) ORDER BY ln) AS body FROM l GROUP BY l_orderkey),
    a AS (SELECT o_custkey AS doc, 1 AS part, o_orderkey AS item, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, o_orderkey % 6 AS x, o_orderkey AS k, o_orderpriority AS title,
      CASE WHEN k % 8 = 0 THEN '제' || x || '조의3 x' WHEN k % 4 = 0 THEN 'plain' WHEN k % 5 = 0 THEN 'Total <' || chr(10) || o_orderstatus ELSE o_orderstatus || ' &lt; ' || k END || coalesce(chr(10) || body, '') AS content FROM orders LEFT JOIN h ON l_orderkey = o_orderkey),
    s AS (SELECT doc, part, item, CASE WHEN k % 8 = 0 THEN '제' || x || '조의3' WHEN k % 4 = 0 THEN '조문' || lpad(n::VARCHAR, greatest(4, length(n::VARCHAR))::INT, '0') ELSE '제' || x || '조' || CASE WHEN k % 3 = 0 THEN '의2' ELSE '' END END AS key, '조문' AS section_type, title, content FROM a
      UNION ALL SELECT c_custkey, 2, 1, CASE WHEN c_nationkey % 2 = 0 THEN '부칙1' ELSE '부칙2' END, '부칙', CASE WHEN c_nationkey % 2 = 0 THEN '부칙 2020' || c_nationkey || ' 제호' ELSE '부칙  제1' || chr(10) || '2호' END, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)
      UNION ALL SELECT c_custkey, 3, 1, CASE WHEN c_nationkey % 3 = 0 THEN '[별표' || c_nationkey || ']' ELSE '[별지1의2]' END, '별표', NULL, CASE WHEN c_nationkey % 3 = 0 THEN '(본문 텍스트 없음 · 원본 파일: p.pdf / q.hwp)' ELSE 'b' END FROM customer WHERE c_nationkey % 3 < 2 AND c_custkey IN (SELECT o_custkey FROM orders)),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY part, item) AS seq, row_number() OVER (PARTITION BY doc, key ORDER BY part, item) AS nth FROM s)
    SELECT doc, seq, CASE WHEN nth = 1 THEN key ELSE key || '#' || nth END AS section_key, section_type, title, content, sha256(content) AS content_hash FROM r""")
def record_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles, addenda and annexes of nested records, by number, by the number in the text, or by place."""
    return R.record_sections(statute_records(spark, sf_dir), "doc", "raw", "law")


@query("""WITH p AS (SELECT p_size AS doc, p_partkey AS k, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS n, p_brand, p_type, p_name FROM part),
    a AS (SELECT doc, 1 AS part, k AS item, CASE WHEN k % 5 = 0 THEN '제2-' || k % 9 || '조의1' WHEN k % 5 = 1 THEN '제7-' || k % 9 ELSE '조문' || lpad(n::VARCHAR, greatest(4, length(n::VARCHAR))::INT, '0') END AS key, '조문' AS section_type,
      CASE WHEN k % 5 = 0 THEN '제 2-' || k % 9 || '조의 1(' || p_brand || ')' WHEN k % 5 = 1 THEN '제7-' || k % 9 || ' (t)' ELSE p_name END AS title, p_type AS body FROM p),
    s AS (SELECT doc, part, item, key, section_type, title, title || CASE WHEN item % 7 = 0 THEN '' ELSE chr(10) || body END AS content FROM a
      UNION ALL SELECT doc, 2, 1, '부칙1', '부칙', 'n' || doc, 'q' FROM (SELECT DISTINCT doc FROM p)
      UNION ALL SELECT doc, 3, k, '[별지' || n || ']', '별표', p_brand || '.hwp', '(첨부 파일: ' || p_brand || '.hwp)' || CASE WHEN k % 2 = 0 THEN ' · 삭제됨' ELSE '' END FROM p),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY part, item) AS seq, row_number() OVER (PARTITION BY doc, key ORDER BY part, item) AS nth FROM s)
    SELECT doc::BIGINT AS doc, seq, CASE WHEN nth = 1 THEN key ELSE key || '#' || nth END AS section_key, section_type, title, content, sha256(content) AS content_hash FROM r""")
def outline_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles that have their number in the title alone, and annexes that are files."""
    parts = table(spark, sf_dir, "part").withColumn("n", F.expr("row_number() over (partition by p_size order by p_partkey)"))
    article = F.expr("""concat('{"조제목":"', case p_partkey % 5 when 0 then concat('제 2-', p_partkey % 9, '조의 1(', p_brand, ')') when 1 then concat('제7-', p_partkey % 9, ' (t)') else p_name end, '","조내용":', if(p_partkey % 7 = 0, 'null', concat('"', p_type, '"')), '}')""")
    annex = F.expr("""concat('{"파일명":"', p_brand, '.hwp","구분":"별지","번호":', n, ',"삭제여부":', p_partkey % 2 = 0, '}')""")
    listed = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", c.alias("o")))), lambda x: x["o"]), ",")
    raw = F.concat(F.lit('{"조문":['), listed(article), F.lit('],"부칙":[{"부칙명":"n'), F.col("p_size").cast("string"), F.lit('","내용":"q"}],"별표":['), listed(annex), F.lit("]}"))
    return R.record_sections(parts.groupBy("p_size").agg(raw.alias("raw")), "p_size", "raw", "kofia").withColumn("doc", F.col("doc").cast("long"))
