"""Plain statute texts on stand-ins: each supplier's order lines are the lines of one text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import plain_text as P
from .registry import query, table


@query("""WITH RECURSIVE l AS (SELECT l_suppkey AS doc, l_orderkey * 8 + l_linenumber AS pos, l_partkey % 100 AS x, l_orderkey % 50 AS a, l_linenumber AS b, l_quantity::BIGINT % 5 + 1 AS n FROM (SELECT l_suppkey, l_orderkey, l_linenumber, max(l_partkey) AS l_partkey, max(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL)),
    t AS (SELECT doc, pos, n, CASE WHEN x < 1 THEN 'number' WHEN x < 3 THEN 'bare' WHEN x < 10 THEN 'date' WHEN x < 70 THEN 'article' WHEN x < 72 THEN 'annex' WHEN x < 80 THEN 'title' ELSE 'other' END AS kind,
      CASE WHEN x < 1 THEN '부칙제' || a || '호' WHEN x BETWEEN 3 AND 9 THEN '부칙2020.0' || b || '.15' END AS named, '기준 ' || a || ' 편' AS title, row_number() OVER (PARTITION BY doc ORDER BY pos) AS i FROM l),
    w AS (SELECT *, coalesce(named, lead(named, 1) OVER o, lead(named, 2) OVER o, lead(named, 3) OVER o) AS ahead,
      coalesce(lag(CASE kind WHEN 'title' THEN title WHEN 'date' THEN NULL END, 1) OVER o, lag(CASE kind WHEN 'title' THEN title END, 2) OVER o, lag(CASE kind WHEN 'title' THEN title END, 3) OVER o, lag(CASE kind WHEN 'title' THEN title END, 4) OVER o, lag(CASE kind WHEN 'title' THEN title END, 5) OVER o, lag(CASE kind WHEN 'title' THEN title END, 6) OVER o) AS near FROM t WINDOW o AS (PARTITION BY doc ORDER BY pos)),
    s AS (SELECT doc, 0::BIGINT AS i, 0::BIGINT AS pos, NULL::VARCHAR AS tag, NULL::VARCHAR AS part, 0::BIGINT AS seen, NULL::VARCHAR AS head, false AS article FROM (SELECT DISTINCT doc FROM w)
      UNION ALL SELECT doc, i, pos, tag, part, seen, CASE WHEN opens THEN concat_ws(':', part, tag) WHEN kind = 'bare' THEN concat_ws(':', part, '부칙') WHEN kind = 'annex' THEN concat_ws(':', part, tag, '[별표' || n || ']') WHEN kind = 'article' THEN concat_ws(':', part, tag, '제' || n || '조') END, NOT opens AND kind IN ('article', 'bare', 'annex')
      FROM (SELECT *, CASE WHEN opens THEN 0 WHEN tag IS NOT NULL OR kind <> 'article' THEN seen0 WHEN fresh THEN 1 ELSE greatest(seen0, n) END AS seen, CASE WHEN fresh THEN coalesce(near, CASE WHEN part0 IS NULL THEN '제2편' ELSE '제3편' END) ELSE part0 END AS part
        FROM (SELECT w.doc, w.i, w.pos, w.kind, w.n, w.near, s.seen AS seen0, s.part AS part0, w.kind IN ('number', 'bare') AND w.ahead IS NOT NULL AS opens, CASE WHEN w.kind IN ('number', 'bare') AND w.ahead IS NOT NULL THEN w.ahead ELSE s.tag END AS tag, s.tag IS NULL AND w.kind = 'article' AND w.n = 1 AND s.seen >= 3 AS fresh FROM s JOIN w ON w.doc = s.doc AND w.i = s.i + 1))),
    k AS (SELECT doc, pos, CASE WHEN article AND row_number() OVER (PARTITION BY doc, head, article ORDER BY pos) > 1 THEN head || '#' || row_number() OVER (PARTITION BY doc, head, article ORDER BY pos) ELSE head END AS key FROM s WHERE i > 0)
    SELECT doc, pos::BIGINT AS pos, coalesce(last_value(key IGNORE NULLS) OVER (PARTITION BY doc ORDER BY pos ROWS UNBOUNDED PRECEDING), '머리말') AS section_key FROM k""")
def plain_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, a, n = F.col("l_partkey") % 100, (F.col("l_orderkey") % 50).cast("string"), (F.col("l_quantity").cast("long") % 5 + 1).cast("string")
    line = F.when(x < 1, F.concat(F.lit("부칙 <제 "), a, F.lit("호>")))
    line = line.when(x < 3, "부    칙")
    line = line.when(x < 10, F.concat(F.lit("2020년 "), F.col("l_linenumber").cast("string"), F.lit("월 15일부터 시행한다")))
    line = line.when(x < 70, F.concat(F.lit("제 "), n, F.lit("조(목적) 제9조를 따른다")))
    line = line.when(x < 72, F.concat(F.lit("  [별표 "), n, F.lit("] 한도")))
    line = line.when(x < 80, F.concat(F.lit(" 기준   "), a, F.lit(" 편")))
    line = line.when(x < 90, "| 표 | 값 |").otherwise("1. 광고는 제2조에 따른다")
    items = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("l_partkey"), F.max("l_quantity").alias("l_quantity"))
    lines = items.select(F.col("l_suppkey").alias("doc"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long").alias("pos"), line.alias("line"))
    return P.plain_sections(lines).select("doc", "pos", "section_key")
