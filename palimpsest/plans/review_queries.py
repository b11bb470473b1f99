"""Matching and review queries on stand-ins: conversations are ads, benchmark items questions, parts named things."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import matching as M
from ..operators import retrieval as R
from ..operators import review as V
from ..operators import text_diff as D
from .registry import query, table
from .retrieval_queries import _WORDS, _bm25, _bm25_sql
from .version_queries import _order_diff

_NAMES = ["ring", "widget", "red widget", "small", "small ring", "gear", "blue"]


@query("""WITH n AS (SELECT unnest(['ring', 'widget', 'red widget', 'small', 'small ring', 'gear', 'blue']) AS name), c AS (SELECT DISTINCT p_name AS candidate FROM part),
    m AS (SELECT name, candidate, replace(name, ' ', '') AS nn, replace(candidate, ' ', '') AS cc FROM n, c WHERE contains(replace(candidate, ' ', ''), replace(name, ' ', ''))),
    k AS (SELECT * FROM m a WHERE nn = cc OR NOT EXISTS (SELECT 1 FROM m b WHERE b.candidate = a.candidate AND length(b.nn) > length(a.nn) AND contains(b.nn, a.nn)))
    SELECT name, min_by(candidate, {'far': nn <> cc, 'n': length(candidate), 'c': candidate}) AS candidate FROM k GROUP BY name""")
def name_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([(n,) for n in _NAMES], "name string")
    candidates = table(spark, sf_dir, "part").select(F.col("p_name").alias("candidate"))
    return M.pick_names(names, candidates, key=lambda c: F.replace(c, F.lit(" ")))


_URL = "SELECT page_id, regexp_extract(url, '/([a-z]{2})/([0-9]+)', 1) AS lang, regexp_extract(url, '/([a-z]{2})/([0-9]+)', 2) AS num FROM pages"


@query(f"""WITH u AS ({_URL}), r AS (SELECT page_id, unnest([0, 1, 2]) AS place, unnest([lang || ':' || num, '*:' || num, lang || ':0']) AS key FROM u),
    d AS (SELECT lang || ':' || doc_id AS key, doc_id FROM documents UNION ALL SELECT '*:' || doc_id, doc_id FROM documents),
    f AS (SELECT page_id, min(place) AS place, min_by(doc_id, place) AS doc_id FROM r JOIN d USING (key) GROUP BY page_id)
    SELECT u.page_id, f.place::BIGINT AS place, f.doc_id FROM u LEFT JOIN f USING (page_id)""")
def citation_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's path names a language and a number; the document of both, else of the number, else the language's first."""
    path = r"/([a-z]{2})/([0-9]+)"
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", path, 1).alias("lang"), F.regexp_extract("url", path, 2).alias("num"))
    docs = table(spark, sf_dir, "documents")
    keys = docs.select(F.concat_ws(":", "lang", F.col("doc_id").cast("string")).alias("key"), "doc_id").union(docs.select(F.concat(F.lit("*:"), F.col("doc_id").cast("string")), "doc_id"))
    tried = F.array(F.concat_ws(":", "lang", "num"), F.concat(F.lit("*:"), "num"), F.concat("lang", F.lit(":0")))
    return M.first_existing(pages, "page_id", tried, keys, "key", "doc_id").select("page_id", "place", "doc_id")


@query("""WITH r AS (SELECT DISTINCT ref FROM (SELECT split_part(p_name, ' ', 1) AS ref FROM part UNION ALL SELECT p_name FROM part)), k AS (SELECT DISTINCT p_name AS key FROM part),
    e AS (SELECT ref, key, 'exact' AS how FROM r JOIN k ON ref = key) SELECT * FROM e UNION ALL SELECT ref, key, 'prefix' FROM r JOIN k ON starts_with(key, ref) WHERE ref NOT IN (SELECT ref FROM e)""")
def citation_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    refs = parts.select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("ref")).union(parts.select("p_name"))
    return M.exact_else_prefix(refs, "ref", parts, "p_name")


@query("""WITH a AS (SELECT conv_id, turn, regexp_replace(lower(text), '[^a-z0-9]+', '', 'g') AS t FROM conversations), n AS (SELECT item_id, regexp_extract(lower(text), '[a-z0-9]+') AS name FROM benchmark)
    SELECT conv_id, turn, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS items FROM a JOIN n ON length(name) > 0 AND contains(t, name) GROUP BY ALL""")
def ad_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns whose text, without anything but letters and digits, contains the first word of an item."""
    ads = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.regexp_replace(F.lower("text"), "[^a-z0-9]+", "").alias("t"))
    names = table(spark, sf_dir, "benchmark").select("item_id", F.regexp_extract(F.lower("text"), "[a-z0-9]+", 0).alias("name"))
    linked = M.contains_join(ads, "t", names, "name").groupBy("conv_id", "turn").agg(F.array_sort(F.collect_set("item_id")).alias("i"))
    return linked.select("conv_id", "turn", F.array_join(F.transform("i", lambda x: x.cast("string")), ",").alias("items"))


_ALIASES = [("small", "S"), ("small ring", "SR"), ("red", "R"), ("red w", "RW"), ("blue", "B"), ("large", "L")]


@query("""WITH a AS (SELECT unnest(['small', 'small ring', 'red', 'red w', 'blue', 'large']) AS alias, unnest(['S', 'SR', 'R', 'RW', 'B', 'L']) AS name)
    SELECT p_partkey, p_name, (SELECT max_by(name, length(alias)) FROM a WHERE starts_with(p_name, alias)) AS canonical FROM part""")
def alias_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.longest_alias(table(spark, sf_dir, "part"), "p_name", _ALIASES).select("p_partkey", "p_name", "canonical")


@query("""WITH i AS (SELECT conv_id * 2147483648 + turn AS item, role || ' ' || turn AS question, regexp_extract(lower(text), '[a-z0-9]+') AS basis FROM conversations),
    k AS (SELECT *, regexp_replace(question, '\\s+', '', 'g') AS key FROM i), f AS (SELECT key, basis, min(item) AS pos FROM k GROUP BY ALL), b AS (SELECT key, list(basis ORDER BY pos) AS bs FROM f GROUP BY key),
    h AS (SELECT key, min(item) AS item, min_by(question, item) AS question, count(*) AS n_items FROM k GROUP BY key)
    SELECT key, item, question, list_reduce(bs, lambda a, x: CASE WHEN contains(a, x) THEN a ELSE a || ' / ' || x END) AS bases, n_items FROM h JOIN b USING (key)""".replace("\\\\s", "\\s"))
def checklist_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    items = rows.select((F.col("conv_id") * (1 << 31) + F.col("turn")).alias("item"), F.concat_ws(" ", "role", F.col("turn").cast("string")).alias("question"), F.regexp_extract(F.lower("text"), "[a-z0-9]+", 0).alias("basis"))
    return V.merged_items(items, "question", "basis", "item")


_ITEMS = [(1, "user", ["license", "terms"], True, False), (2, "assistant", ["the", "und"], True, False), (3, "all", ["est", "que"], True, True), (4, "system", [], True, False), (5, "user", ["and"], False, False)]


@query("""WITH i AS (SELECT * FROM (VALUES (1, 'user', ['license', 'terms'], true, false), (2, 'assistant', ['the', 'und'], true, false), (3, 'all', ['est', 'que'], true, true), (4, 'system', []::VARCHAR[], true, false), (5, 'user', ['and'], false, false)) t(item, product, words, require, conditional))
    SELECT conv_id, turn, item::BIGINT AS item, CASE WHEN require AND len(words) > 0 AND len(list_filter(words, lambda w: contains(lower(text), w))) = 0 THEN CASE WHEN conditional THEN 'N/A?' ELSE 'NG' END END AS verdict FROM conversations JOIN i ON product = role OR product = 'all'""")
def keyword_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.createDataFrame(_ITEMS, "item long, product string, words array<string>, require boolean, conditional boolean")
    ads = table(spark, sf_dir, "conversations").withColumnRenamed("role", "product")
    return V.keyword_verdicts(items, ads).select("conv_id", "turn", "item", "verdict")


_TRIGGERS = [("(?i)license", "licence terms"), (r"\|", "table layout"), ("[0-9]{3}", "numbers"), ("(?i)licensed", "licence terms")]


@query(r"""SELECT doc_id, array_to_string(CASE WHEN text SIMILAR TO '(?s).*(?i)license.*' OR regexp_matches(text, '\|') OR regexp_matches(text, '[0-9]{3}') THEN
    list_filter([CASE WHEN regexp_matches(text, '(?i)license') THEN 'licence terms' END, CASE WHEN regexp_matches(text, '\|') THEN 'table layout' END, CASE WHEN regexp_matches(text, '[0-9]{3}') THEN 'numbers' END], lambda q: q IS NOT NULL)[1:2] ELSE [substr(text, 1, 300)] END, ';') AS queries FROM documents""")
def trigger_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(V.triggered(F.col("text"), _TRIGGERS, 2), ";").alias("queries"))


_FEATURES = r"""f AS (SELECT doc_id, text, round(len(regexp_extract_all(text, '[.!?]')) * 1000.0::DOUBLE / greatest(length(text), 1), 6) AS sentence_density, round(len(regexp_extract_all(text, '\|')) * 1000.0::DOUBLE / greatest(length(text), 1), 6) AS bar_density,
    round(len(regexp_extract_all(text, '[0-9]')) / greatest(length(text), 1)::DOUBLE, 6) AS digit_share, round(len(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') = '')) / len(string_split(text, chr(10)))::DOUBLE, 6) AS blank_share FROM documents)"""
_CLASSES = f"""{_FEATURES}, c AS (SELECT doc_id, CASE WHEN bar_density > 5 THEN 'form' WHEN digit_share > 0.1 THEN 'form' WHEN sentence_density > 8 THEN 'criteria' WHEN length(text) < 200 THEN 'short' ELSE 'criteria' END AS kind,
    CASE WHEN bar_density > 5 THEN 'cells' WHEN digit_share > 0.1 THEN 'digits' WHEN sentence_density > 8 THEN 'sentences' WHEN length(text) < 200 THEN 'length' ELSE 'default' END AS reason FROM f)"""


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "text", *[c.alias(k) for k, c in V.text_features(F.col("text")).items()])


@query(f"WITH {_FEATURES} SELECT doc_id, sentence_density, bar_density, digit_share, blank_share FROM f")
def doc_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir).drop("text")


@query(f"WITH {_CLASSES} SELECT doc_id, kind, reason FROM c")
def doc_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [(F.col("bar_density") > 5, "form", "cells"), (F.col("digit_share") > 0.1, "form", "digits"), (F.col("sentence_density") > 8, "criteria", "sentences"), (F.length("text") < 200, "short", "length")]
    kind, why = V.decided(rules, ("criteria", "default"))
    return _features(spark, sf_dir).select("doc_id", kind.alias("kind"), why.alias("reason"))


@query(f"WITH {_CLASSES} SELECT kind, count(*) FILTER (WHERE quality = 0) AS n_0, count(*) FILTER (WHERE quality = 1) AS n_1 FROM c JOIN labels USING (doc_id) GROUP BY kind")
def classify_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.cross_table(doc_classify(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id"), "kind", "quality", [0, 1])


_DIRT = [("email", r"[a-z0-9.]+@[a-z0-9.]+"), ("url", "https?://"), ("markup", "<[a-z]+>"), ("placeholder", "(?i)lorem ipsum")]


@query(r"""SELECT doc_id::VARCHAR AS target, 'MEDIUM' AS severity, 'contaminant' AS item, CASE WHEN regexp_matches(text, '[a-z0-9.]+@[a-z0-9.]+') THEN 'email' WHEN regexp_matches(text, 'https?://') THEN 'url' WHEN regexp_matches(text, '<[a-z]+>') THEN 'markup' ELSE 'placeholder' END AS detail FROM documents WHERE regexp_matches(text, '[a-z0-9.]+@[a-z0-9.]+') OR regexp_matches(text, 'https?://') OR regexp_matches(text, '<[a-z]+>') OR regexp_matches(text, '(?i)lorem ipsum')
    UNION ALL SELECT sha256(text), 'LOW', 'duplicate', count(*)::VARCHAR FROM documents GROUP BY text HAVING count(*) > 1
    UNION ALL SELECT doc_id::VARCHAR, 'HIGH', 'length', n_chars::VARCHAR FROM documents WHERE n_chars <> length(text)
    UNION ALL SELECT doc_id::VARCHAR, 'LOW', 'short', length(text)::VARCHAR FROM documents WHERE length(text) < 50
    UNION ALL SELECT page_id::VARCHAR, 'HIGH', 'truncated', length(html)::VARCHAR FROM pages WHERE NOT contains(lower(right(html, 2000)), '</html>')""")
def quality_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    text, dirt = F.col("text"), V.first_contaminant(F.col("text"), _DIRT)
    found = V.finding(docs.where(dirt.isNotNull()), F.col("doc_id"), "MEDIUM", "contaminant", dirt)
    found = found.union(V.finding(V.duplicate_keys(docs.withColumn("h", F.sha2("text", 256)), "h"), F.col("h"), "LOW", "duplicate", F.col("n")))
    found = found.union(V.finding(docs.where(F.col("n_chars") != F.length(text)), F.col("doc_id"), "HIGH", "length", F.col("n_chars")))
    found = found.union(V.finding(docs.where(F.length(text) < 50), F.col("doc_id"), "LOW", "short", F.length(text)))
    cut = pages.where(~F.contains(F.lower(F.substring("html", -2000, 2000)), F.lit("</html>")))
    return found.union(V.finding(cut, F.col("page_id"), "HIGH", "truncated", F.length("html")))


@query(f"""WITH {_bm25_sql(_WORDS, 3)}, e AS (SELECT query, string_agg(doc || ':' || score, ';' ORDER BY rnk) AS evidence FROM (SELECT query, doc, round(score, 3)::VARCHAR AS score, rnk FROM (SELECT query, doc, floor(score)::BIGINT AS score, rnk FROM rk)) GROUP BY query)
    SELECT 'rule:' || item_id AS evidence_id, 'rule' AS evidence_type, length(text)::BIGINT AS n_chars, evidence FROM benchmark LEFT JOIN e ON query = item_id UNION ALL SELECT 'article:' || doc_id, 'article', length(text), NULL FROM documents""")
def evidence_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules with the best articles as evidence, then all articles, in one index."""
    top = _bm25(spark, sf_dir, 3).select(F.col("query").alias("item_id"), "doc", F.floor("score").cast("long").alias("score"), "rnk")
    told = M.gathered(top, "item_id", "rnk", ["doc", "score"], most=3)
    told = told.select("item_id", F.array_join(F.transform("evidence", lambda e: F.concat_ws(":", e["doc"].cast("string"), e["score"].cast("string"))), ";").alias("evidence"))
    rules = table(spark, sf_dir, "benchmark").join(told, "item_id", "left").select(F.concat(F.lit("rule:"), F.col("item_id").cast("string")).alias("evidence_id"), F.lit("rule").alias("evidence_type"), F.length("text").cast("long").alias("n_chars"), "evidence")
    articles = table(spark, sf_dir, "documents").select(F.concat(F.lit("article:"), F.col("doc_id").cast("string")).alias("evidence_id"), F.lit("article").alias("evidence_type"), F.length("text").cast("long").alias("n_chars"), F.lit(None).cast("string").alias("evidence"))
    return rules.unionByName(articles)


@query(r"""SELECT doc_id, len(string_split(t, chr(10)))::BIGINT AS n_parts, replace(t, chr(10), '') = line AS lossless FROM (SELECT doc_id, line, regexp_replace(line, '([.!?] )([A-Z0-9])', '\1' || chr(10) || '\2', 'g') AS t FROM (SELECT doc_id, replace(text, chr(10), ' ') AS line FROM documents))""")
def lossless_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit(" ")).alias("line"))
    rows = rows.withColumn("t", D.with_line_breaks(F.col("line")))
    return rows.select("doc_id", F.size(F.split("t", "\n")).cast("long").alias("n_parts"), (F.replace("t", F.lit("\n")) == F.col("line")).alias("lossless"))


@query()
def inline_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character segments of each modified section; difflib is beyond SQL, golden cases are in the tests."""
    changed = _order_diff(spark, sf_dir).where("change_type = 'modified'").withColumn("s", D.inline_diff(F.col("old_content"), F.col("new_content")))
    return changed.select("change", "section_key", F.size("s").cast("long").alias("n_segments"), D.changed_share(F.col("s")).alias("changed_percent"), F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["op"], x["old"], x["new"])), ";").alias("segments"))


@query()
def line_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed orders as texts of lines, their lines paired."""
    changed = _order_diff(spark, sf_dir).select("change", F.struct("section_key", "old_content", "new_content").alias("s"))
    sections = changed.repartition("change").groupBy("change").agg(F.collect_list("s").alias("s"))  # moved as rows, not as lists
    text = lambda c: F.array_join(F.transform(F.array_sort(F.transform("s", lambda x: F.struct(x["section_key"], x[c].alias("v")))), lambda x: x["v"]), "\n")
    texts = sections.select("change", text("old_content").alias("old"), text("new_content").alias("new"))
    return texts.select("change", F.explode(D.line_pairs(F.col("old"), F.col("new"))).alias("p")).select("change", F.col("p.old").alias("old_line"), F.col("p.new").alias("new_line"))
