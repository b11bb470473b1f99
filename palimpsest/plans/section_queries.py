"""Sections and chunks of ``documents``: a line is a section, its first word the key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking as C
from ..operators import sections as S
from .registry import query, table

_LINES = "SELECT doc_id AS doc, i::BIGINT AS pos, ls[i] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))"
_SECTIONS = f"""l AS ({_LINES}), s AS (SELECT doc, pos, line, row_number() OVER (PARTITION BY doc ORDER BY pos) AS seq, coalesce(nullif(regexp_extract(lower(line), '[a-z0-9]+'), ''), 'section') AS word FROM l WHERE trim(line, ' ') <> ''),
    k AS (SELECT *, row_number() OVER (PARTITION BY doc, word ORDER BY pos) AS nth FROM s), sec AS (SELECT doc, seq, CASE WHEN nth = 1 THEN word ELSE word || '#' || nth END AS section_key, line AS content FROM k)"""


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.numbered(S.text_lines(table(spark, sf_dir, "documents"), "doc_id"), F.trim("line") != "")
    word = F.regexp_extract(F.lower("line"), "[a-z0-9]+", 0)
    rows = S.unique_keys(rows.withColumn("word", F.when(word == "", "section").otherwise(word)), "word")
    return rows.select("doc", "seq", "section_key", F.col("line").alias("content"))


@query(f"WITH {_SECTIONS} SELECT doc, seq, section_key, length(content)::BIGINT AS n_chars FROM sec")
def section_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections(spark, sf_dir).select("doc", "seq", "section_key", F.length("content").cast("long").alias("n_chars"))


@query(f"WITH {_SECTIONS} SELECT doc, section_key, sha256(content) AS content_hash, substr(sha256(content), 1, 16) AS short_hash FROM sec")
def section_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.sha2("content", 256)
    return sections(spark, sf_dir).select("doc", "section_key", digest.alias("content_hash"), F.substring(digest, 1, 16).alias("short_hash"))


_PACK = """WITH RECURSIVE base AS (SELECT doc_id AS doc, text, list_filter(flatten(list_transform(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> ''), lambda x: CASE WHEN length(x) <= 800 THEN [x] ELSE list_transform(regexp_extract_all(x, '[^.!?]*[.!?]*\\s*'), lambda y: trim(y, ' ')) END)), lambda y: length(y) > 0) AS pieces FROM documents),
    pack(doc, i, pieces, done, cur) AS (
      SELECT doc, 1, pieces, NULL::VARCHAR, pieces[1] FROM base WHERE length(text) > 800
      UNION ALL
      SELECT doc, i + 1, pieces, CASE WHEN shut THEN cur END, CASE WHEN shut THEN pieces[i + 1] ELSE cur || chr(10) || pieces[i + 1] END
      FROM (SELECT *, length(cur) >= 500 OR length(cur) + length(pieces[i + 1]) + 1 > 800 AS shut FROM pack WHERE i < len(pieces))),
    parts AS (SELECT doc, i, done AS chunk FROM pack WHERE done IS NOT NULL UNION ALL SELECT doc, i + 1, cur FROM pack WHERE i = len(pieces) UNION ALL SELECT doc, 1, text FROM base WHERE length(text) <= 800),
    ch AS (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY i) AS part, count(*) OVER (PARTITION BY doc) AS parts, chunk FROM parts)"""


def chunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.chunks(table(spark, sf_dir, "documents"), "doc_id")


@query(f"{_PACK} SELECT doc, part, parts, length(chunk)::BIGINT AS chars, substr(sha256(chunk), 1, 16) AS sha FROM ch")
def chunk_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_rows(spark, sf_dir).drop("chunk")


@query("WITH v AS (SELECT list_sort(list(n_chars)) AS x, count(*) AS n FROM documents) SELECT p::BIGINT AS p, x[round_even((n - 1) * p / 100.0, 0)::BIGINT + 1] AS value FROM v, (SELECT unnest([0, 50, 90, 99, 100]) AS p)")
def chunk_length_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.index_percentiles(table(spark, sf_dir, "documents"), "n_chars", (0, 50, 90, 99, 100))


@query("SELECT (CASE WHEN n_chars >= 16000 THEN 7 WHEN n_chars >= 8000 THEN 6 WHEN n_chars >= 4000 THEN 5 WHEN n_chars >= 2000 THEN 4 WHEN n_chars >= 1000 THEN 3 WHEN n_chars >= 500 THEN 2 WHEN n_chars >= 200 THEN 1 ELSE 0 END)::BIGINT AS bucket, count(*) AS n FROM documents GROUP BY ALL")
def chunk_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.histogram(table(spark, sf_dir, "documents"), F.col("n_chars"), (200, 500, 1000, 2000, 4000, 8000, 16000))


@query("SELECT lim::BIGINT AS lim, cpt, count(*) FILTER (WHERE n_chars / cpt > lim)::BIGINT AS n_over FROM documents, (SELECT unnest([512, 1024, 8192]) AS lim), (SELECT unnest([1.5::DOUBLE, 2.0::DOUBLE, 4.0::DOUBLE]) AS cpt) GROUP BY ALL")
def over_limit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.over_limits(table(spark, sf_dir, "documents"), "n_chars", (512, 1024, 8192), (1.5, 2.0, 4.0))


@query(f"WITH l AS ({_LINES}) SELECT doc, pos, last_value(CASE WHEN length(line) < 40 AND trim(line, ' ') <> '' THEN trim(line, ' ') END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY pos ROWS UNBOUNDED PRECEDING) AS heading FROM l")
def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short lines are headings of what follows."""
    rows = S.text_lines(table(spark, sf_dir, "documents"), "doc_id")
    return S.carried(rows, F.when((F.length("line") < 40) & (F.trim("line") != ""), F.trim("line")), "heading").select("doc", "pos", "heading")


@query("""WITH e AS (SELECT user_id AS doc, event_id AS pos, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS number FROM events),
    r AS (SELECT *, CASE WHEN number <= lag(number) OVER (PARTITION BY doc ORDER BY pos) THEN 1 ELSE 0 END AS reset FROM e)
    SELECT doc, pos, number, (1 + sum(reset) OVER (PARTITION BY doc ORDER BY pos ROWS UNBOUNDED PRECEDING))::BIGINT AS part_no FROM r""")
def number_reset_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc"), F.col("event_id").alias("pos"), F.regexp_extract("props", "[0-9]+", 0).cast("long").alias("number"))
    return S.parts_by_reset(rows, F.col("number")).select("doc", "pos", "number", "part_no")


@query(f"""WITH l AS ({_LINES}), cell AS (SELECT doc, pos, ix, trim(cs[ix], ' ') AS cell FROM (SELECT doc, pos, cs, unnest(range(1, len(cs) + 1)) AS ix FROM (SELECT doc, pos, string_split(line, ' | ') AS cs FROM l WHERE contains(line, ' | ')))),
    f AS (SELECT *, row_number() OVER (PARTITION BY doc, cell ORDER BY pos, ix) AS n FROM cell WHERE cell <> '')
    SELECT doc, pos, string_agg(cell, ' | ' ORDER BY ix) AS line FROM f WHERE n = 1 GROUP BY doc, pos""")
def cell_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.text_lines(table(spark, sf_dir, "documents"), "doc_id").where(F.contains("line", F.lit(" | ")))
    return S.distinct_cells(rows)


@query(r"""SELECT page_id, html LIKE '%</html>%' AND contains(lower(right(html, 2000)), '</html>') AS whole,
    array_to_string(list_filter(list_transform(string_split(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?i)<(br|/p|/div|/tr|/li|/h[1-6])[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[ \t]+', ' ', 'g'), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> ''), chr(10)) AS body FROM pages""")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain text of pages, and whether the response came whole."""
    whole = F.contains("html", F.lit("</html>")) & F.contains(F.lower(F.substring("html", -2000, 2000)), F.lit("</html>"))
    return table(spark, sf_dir, "pages").select("page_id", whole.alias("whole"), T.html_to_text(F.col("html")).alias("body"))


@query(r"""WITH h AS (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, '<a href="([^"]*)"', 1))) AS link FROM pages) SELECT page_id, link, row_number() OVER (PARTITION BY page_id ORDER BY length(link) DESC, link) AS n FROM h""")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    links = table(spark, sf_dir, "pages").select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1)))).alias("link"))
    return links.withColumn("n", F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc(F.length("link")), "link")).cast("long"))


@query()
def article_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of whole documents as sections of their sources; tests hold them against plain loops."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.col("source").alias("reg"), F.col("doc_id").alias("seq"), F.col("lang").alias("key"), F.lit(None).cast("string").alias("title"), "text")
    return C.article_chunks(rows).drop("chunk")


@query()
def manual_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of documents by heads; lines of up to 60 characters that begin with a capital stand for heads."""
    return C.manual_sections(table(spark, sf_dir, "documents"), "doc_id", head="^[A-Z]")


@query()
def ad_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of conversations' turns; tests hold them against plain loops."""
    turns = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("turn_id"), "text")
    return C.ad_pieces(turns, "turn_id")
