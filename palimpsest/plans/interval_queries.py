"""Intervals of texts of several parts, on stand-ins: each supplier's order lines are the lines of one text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import intervals as I
from .registry import query, table


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, n, b = F.col("l_partkey") % 100, (F.col("l_quantity").cast("long") % 5 + 1).cast("string"), F.col("l_linenumber").cast("string")
    line = F.when(x < 40, F.concat(F.lit("  제 "), n, F.lit("조(가"), b, F.lit(") 본문")))
    line = line.when(x < 44, F.concat(F.lit("부 칙 <2020.0"), b, F.lit(".15.>"))).when(x < 46, "부칙")
    line = line.when(x < 50, F.concat(F.lit("<별표"), n, F.lit("> <신설 2022.8.25.>"))).when(x < 53, F.concat(F.lit("[서식 별지 "), n, F.lit("] 양식 "), b, F.lit(" ,")))
    line = line.when(x < 56, F.concat(F.lit("| 목차 <별표 "), n, F.lit("> 제출 기준"), b, F.lit("9 | [별지"), n, F.lit("호] <x"))).when(x < 58, "").otherwise("본문은 제3조와 [별표1]을 따른다")
    items = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("l_partkey"), F.max("l_quantity").alias("l_quantity"))
    rows = items.select(F.col("l_suppkey").alias("doc"), F.struct("l_orderkey", "l_linenumber", line.alias("line")).alias("r"))
    return rows.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["line"]), "\n").alias("text"))


@query("""WITH l AS (SELECT l_suppkey AS doc, l_orderkey, l_linenumber AS b, max(l_partkey) % 100 AS x, max(l_quantity)::BIGINT % 5 + 1 AS n FROM lineitem GROUP BY ALL),
    t AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY l_orderkey, b) AS pos, CASE WHEN x < 40 THEN '  제 ' || n || '조(가' || b || ') 본문' WHEN x < 44 THEN '부 칙 <2020.0' || b || '.15.>' WHEN x < 46 THEN '부칙' WHEN x < 50 THEN '<별표' || n || '> <신설 2022.8.25.>'
      WHEN x < 53 THEN '[서식 별지 ' || n || '] 양식 ' || b || ' ,' WHEN x < 56 THEN '| 목차 <별표 ' || n || '> 제출 기준' || b || '9 | [별지' || n || '호] <x' WHEN x < 58 THEN '' ELSE '본문은 제3조와 [별표1]을 따른다' END AS line FROM l),
    o AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place,
      CASE WHEN x < 40 THEN '조문' WHEN x < 46 THEN '부칙' WHEN x < 53 THEN '별표' END AS kind0, CASE WHEN x < 40 THEN '제' || n || '조' WHEN x < 44 THEN '부칙2020.0' || b || '.15' WHEN x < 46 THEN '부칙' WHEN x < 50 THEN '[별표 ' || n || ']' WHEN x < 53 THEN '[별지 ' || n || ']' END AS key0,
      CASE WHEN x < 40 THEN '가' || b WHEN x BETWEEN 50 AND 52 THEN '양식 ' || b END AS title0 FROM t),
    h AS (SELECT *, count(*) FILTER (WHERE kind0 IN ('부칙', '별표')) OVER w AS segment, last_value(CASE WHEN kind0 IN ('부칙', '별표') THEN kind0 END IGNORE NULLS) OVER w AS held, last_value(CASE WHEN kind0 IN ('부칙', '별표') THEN key0 END IGNORE NULLS) OVER w AS held_key, count(kind0) OVER w AS mark FROM o WINDOW w AS (PARTITION BY doc ORDER BY pos ROWS UNBOUNDED PRECEDING)),
    f AS (SELECT *, CASE WHEN kind0 = '조문' THEN n <= coalesce(lag(CASE WHEN kind0 = '조문' THEN n END) OVER (PARTITION BY doc, segment ORDER BY pos), 0) ELSE false END AS falls FROM h WHERE kind0 IS NOT NULL),
    e AS (SELECT *, kind0 = '조문' AND coalesce(held, '') = '부칙' AND NOT max(falls) OVER (PARTITION BY doc, segment ORDER BY pos ROWS UNBOUNDED PRECEDING) AS added FROM f),
    named AS (SELECT doc, key, arg_min(title, pos) AS title FROM (SELECT doc, pos, '[별표 ' || n || ']' AS key, '제출 기준' AS title FROM t WHERE x BETWEEN 53 AND 55 UNION ALL SELECT doc, pos, '[별표 1]', '을 따른다' FROM t WHERE x >= 58 UNION ALL SELECT doc, pos, key0, title0 FROM o WHERE x BETWEEN 50 AND 52) GROUP BY doc, key),
    g AS (SELECT e.doc, mark, CASE WHEN added THEN '부칙' ELSE kind0 END AS kind, CASE WHEN added THEN held_key || ':' || key0 ELSE key0 END AS key, coalesce(title0, named.title, '') AS title FROM e LEFT JOIN named ON named.doc = e.doc AND named.key = e.key0),
    b AS (SELECT doc, mark, min(place) AS lo, max(place + length(line)) AS stop, trim(string_agg(line, chr(10) ORDER BY pos), ' ' || chr(10)) AS body FROM h GROUP BY doc, mark),
    s AS (SELECT * FROM b WHERE mark > 0 OR body <> '' OR doc NOT IN (SELECT doc FROM b WHERE mark > 0))
    SELECT s.doc, row_number() OVER w AS seq, CASE WHEN row_number() OVER w = 1 THEN 0 ELSE lo END AS begin, coalesce(lead(lo) OVER w, stop) AS "end", coalesce(kind, '조문') AS kind, coalesce(key, CASE WHEN max(s.mark) OVER (PARTITION BY s.doc) > 0 THEN '머리말' ELSE '' END) AS key, coalesce(title, '') AS title, body
    FROM s LEFT JOIN g ON g.doc = s.doc AND g.mark = s.mark WINDOW w AS (PARTITION BY s.doc ORDER BY s.mark)""")
def text_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles, addenda with their articles, annexes with titles of the table of contents; disjoint and covering."""
    return I.text_intervals(texts(spark, sf_dir), "doc")
