"""Citations on stand-ins: lines and orders write citations of the numbers they hold, parts are the articles there are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import citations as C
from ..functions import text as T
from ..operators import matching as M
from .registry import query, table

#: Short names of statutes; a table of the caller's in earnest.
ALIASES = {"금소법": "금융소비자 보호에 관한 법률", "여전법": "여신전문금융업법", "자본시장법": "자본시장과 금융투자업에 관한 법률"}
_A, _Y, _J = ALIASES.values()
_LINES = "SELECT l_orderkey, l_linenumber, (l_partkey % 1200 + 1)::VARCHAR AS a, l_linenumber::VARCHAR AS b, (l_suppkey % 9 + 2)::VARCHAR AS c, l_orderkey % 4 AS m FROM lineitem"


def _said(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, c = ((F.col("l_partkey") % 1200 + 1).cast("string"), F.col("l_linenumber").cast("string"), (F.col("l_suppkey") % 9 + 2).cast("string"))
    m = F.col("l_orderkey") % 4
    text = F.when(m == 0, F.concat(F.lit("제 "), a, F.lit("-"), b, F.lit("조 광고물 ABC"), c))
    text = text.when(m == 1, F.concat(F.lit("제"), a, F.lit("조의"), c, F.lit("에 따른 첨부")))
    text = text.when(m == 2, F.concat(F.lit("[별표 000"), a, F.lit("] 한도")))
    text = text.otherwise(F.concat(F.lit("별지 제"), a, F.lit("호, 별표"), b, F.lit("의"), c, F.lit(" 값")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.alias("text"))


@query(f"""WITH l AS ({_LINES}) SELECT l_orderkey, l_linenumber, CASE m
    WHEN 0 THEN '조' || a || '-' || b || ' 조' || a || ' abc' || c || ' 광고 고물'
    WHEN 1 THEN '조' || a || '의' || c || ' 조' || a || ' 첨부 에 따른'
    WHEN 2 THEN '별표 별표' || a || ' 별표' || lpad(a, 4, '0') || ' 한도'
    ELSE '별지 별지' || a || ' 별지' || lpad(a, 4, '0') || ' 별표 별표' || b || '의' || c || ' 별표' || lpad(b, 4, '0') || '의' || c || ' 값' END AS tokens FROM l""")
def korean_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _said(spark, sf_dir).select("l_orderkey", "l_linenumber", F.array_join(T.korean_tokens(F.col("text")), " ").alias("tokens"))


@query(f"""WITH l AS ({_LINES}) SELECT l_orderkey, l_linenumber, CASE m
    WHEN 0 THEN '제' || a || '-' || b || '조' WHEN 1 THEN '제' || a || '조의' || c
    WHEN 2 THEN '[별표 ' || lpad(a, 4, '0') || ']|[별표 ' || a || ']'
    ELSE '[별지 ' || lpad(a, 4, '0') || ']|[별지 ' || a || '];[별표 ' || lpad(b, 4, '0') || '의' || c || ']|[별표 ' || b || '의' || c || ']|[별표 ' || lpad(b, 4, '0') || ']|[별표 ' || b || ']' END AS keys FROM l""")
def citation_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate keys of every article and annex cited."""
    keys = F.concat(C.article_keys(F.col("text")), C.annex_keys(F.col("text")))
    return _said(spark, sf_dir).select("l_orderkey", "l_linenumber", F.array_join(F.transform(keys, lambda k: F.array_join(k, "|")), ";").alias("keys"))


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_custkey") % 500 + 1
    a, b = n.cast("string"), (n % 7 + 1).cast("string")
    m = F.col("o_orderkey") % 6
    basis = F.when(m == 0, "").when(m == 1, "-")
    basis = basis.when(m == 2, F.concat(F.lit("금소법 제"), a, F.lit("조제1항, 시행령 제"), a, F.lit("조의2")))
    basis = basis.when(m == 3, F.concat(F.lit("협회 「여전법」 제"), a, F.lit("-"), b, F.lit("조; 별표"), a))
    basis = basis.when(m == 4, "해당 없음").otherwise("금융위 자본시장법, -")
    return table(spark, sf_dir, "orders").select("o_orderkey", basis.alias("basis"))


@query(f"""WITH o AS (SELECT o_orderkey, o_orderkey % 6 AS m, (o_custkey % 500 + 1)::VARCHAR AS a, ((o_custkey % 500 + 1) % 7 + 1)::VARCHAR AS b FROM orders)
    SELECT o_orderkey, CASE m WHEN 2 THEN '{_A}:제' || a || '조;{_A} 시행령:제' || a || '조의2'
      WHEN 3 THEN '{_Y}:제' || a || '-' || b || '조;{_Y}:[별표 ' || lpad(a, 4, '0') || ']|[별표 ' || a || ']' WHEN 5 THEN '{_J}' ELSE '' END AS refs FROM o""")
def citation_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each basis cites: names by alias or taken over, keys with their candidates."""
    refs = F.transform(C.parsed_basis(F.col("basis"), ALIASES), lambda r: F.concat_ws(":", r["name"], F.when(r["keys"].isNotNull(), F.array_join(r["keys"], "|"))))
    return _rules(spark, sf_dir).select("o_orderkey", F.array_join(refs, ";").alias("refs"))


def _articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, n = F.col("p_partkey"), F.col("p_partkey").cast("string")
    article = lambda *x: F.concat(F.lit("제"), *x)
    kinds = F.array(
        F.when(p % 2 == 0, F.struct(F.lit(_A).alias("name"), article(n, F.lit("조")).alias("key"))),
        F.when(p % 3 == 0, F.struct(F.lit(f"{_A} 시행령").alias("name"), article(n, F.lit("조의2")).alias("key"))),
        F.when(p % 5 < 3, F.struct(F.lit(_Y).alias("name"), article(n, F.lit("-"), (p % 7 + 1).cast("string"), F.lit("조")).alias("key"))),
        F.when(p % 4 == 0, F.struct(F.lit(_Y).alias("name"), F.concat(F.lit("[별표 "), T.padded(n), F.lit("]")).alias("key"))),
        F.when(p % 4 == 1, F.struct(F.lit(_Y).alias("name"), F.concat(F.lit("[별표 "), n, F.lit("]")).alias("key"))),
    )
    return table(spark, sf_dir, "part").select(F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("k")).select("k.*")


@query("""WITH o AS (SELECT o_orderkey, o_orderkey % 6 AS m, o_custkey % 500 + 1 AS a FROM orders), j AS (SELECT o.*, p_partkey IS NOT NULL AS there FROM o LEFT JOIN part ON p_partkey = a),
    h AS (SELECT o_orderkey, m, CASE m WHEN 2 THEN 2 WHEN 3 THEN 2 WHEN 5 THEN 1 ELSE 0 END AS n_refs, CASE m WHEN 2 THEN (there AND a % 2 = 0)::INT + (there AND a % 3 = 0)::INT WHEN 3 THEN (there AND a % 5 < 3)::INT + (there AND a % 4 < 2)::INT ELSE 0 END AS n_hits FROM j)
    SELECT o_orderkey, CASE WHEN m < 2 THEN 'manual' WHEN n_refs = 0 THEN 'unparsed' WHEN n_hits = n_refs THEN 'all' WHEN n_hits > 0 THEN 'some' ELSE 'none' END AS outcome, n_refs::BIGINT AS n_refs, n_hits::BIGINT AS n_hits FROM h""")
def rule_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules against the articles there are: all, some or none of their references found, none understood, or the manual alone."""
    rules = _rules(spark, sf_dir).withColumn("refs", C.parsed_basis(F.col("basis"), ALIASES))
    return M.matched_rules(rules, "o_orderkey", "basis", "refs", _articles(spark, sf_dir)).select("o_orderkey", "outcome", "n_refs", "n_hits")


@query("""WITH RECURSIVE b AS (SELECT l_orderkey AS doc, list('k' || l_partkey % 2 || CASE WHEN l_suppkey % 4 = 0 THEN '#2' ELSE '' END ORDER BY l_linenumber) AS ks, list(l_linenumber ORDER BY l_linenumber) AS ps FROM lineitem GROUP BY ALL),
    f AS (SELECT doc, ks, ps, 0 AS i, NULL::VARCHAR AS section_key, []::VARCHAR[] AS used FROM b
      UNION ALL SELECT doc, ks, ps, i + 1, nk, list_append(used, nk) FROM (SELECT *, CASE WHEN NOT list_contains(used, ks[i + 1]) THEN ks[i + 1] ELSE list_filter(list_transform(range(2, len(ks) + 3), lambda n: ks[i + 1] || '#' || n), lambda x: NOT list_contains(used, x))[1] END AS nk FROM f WHERE i < len(ks)))
    SELECT doc, ps[i]::BIGINT AS pos, section_key FROM f WHERE i > 0""")
def section_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of which some end like numbered ones. Lines of one number come in the order of the table's files."""
    from ..operators import sections as S

    mark = F.when(F.col("l_suppkey") % 4 == 0, "#2").otherwise("")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").cast("long").alias("pos"), F.concat(F.lit("k"), (F.col("l_partkey") % 2).cast("string"), mark).alias("k"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    return S.unique_keys(rows, "k", ties=("file", "at")).select("doc", "pos", "section_key")
