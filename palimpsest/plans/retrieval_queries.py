"""Retrieval over ``documents`` (corpus), ``benchmark`` (queries), ``embeddings`` (vectors) and ``labels`` (classes)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import retrieval as R
from .registry import query, table

_WORDS = "regexp_extract_all(lower({c}), '[a-z0-9]+')"
_BIGRAMS = "list_concat(regexp_extract_all(lower({c}), '[0-9]+'), flatten(list_transform(regexp_extract_all(lower({c}), '[a-z]+'), lambda w: CASE WHEN length(w) < 2 THEN [w] ELSE list_transform(range(1, length(w)), lambda i: substr(w, i, 2)) END)))"


def _bm25_sql(tokens: str, k: int, name: str = "", docs: str = "documents", doc: str = "doc_id") -> str:
    d, q = tokens.format(c="text"), tokens.format(c="text")
    return f"""
    {name}tok AS (SELECT {doc} AS doc, {d} AS t FROM {docs}),
    {name}stats AS (SELECT count(*)::DOUBLE AS n_docs, avg(len(t)) AS avgdl FROM {name}tok),
    {name}post AS (SELECT doc, dl, token, count(*)::DOUBLE AS tf FROM (SELECT doc, len(t)::DOUBLE AS dl, unnest(t) AS token FROM {name}tok) GROUP BY ALL),
    {name}df AS (SELECT token, count(*)::DOUBLE AS df FROM {name}post GROUP BY token),
    {name}ask AS (SELECT item_id AS query, unnest(list_distinct({q})) AS token FROM benchmark),
    {name}sc AS (SELECT a.query, p.doc, round(sum(ln(1 + (n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score
      FROM {name}ask a JOIN {name}post p USING (token) JOIN {name}df USING (token) CROSS JOIN {name}stats GROUP BY ALL),
    {name}rk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rnk FROM {name}sc) WHERE rnk <= {k})"""


def _bm25(spark: SparkSession, sf_dir: str, k: int, tokens=T.latin_tokens) -> DataFrame:
    return R.bm25(table(spark, sf_dir, "benchmark"), "item_id", tokens(F.col("text")), table(spark, sf_dir, "documents"), "doc_id", tokens(F.col("text")), k)


@query(f"WITH {_bm25_sql(_WORDS, 5)} SELECT query, doc, score, rnk FROM rk")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25(spark, sf_dir, 5)


@query(f"WITH {_bm25_sql(_BIGRAMS, 5)} SELECT query, doc, score, rnk FROM rk")
def bm25_bigram_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25(spark, sf_dir, 5, T.latin_bigram_tokens)


@query(f"""WITH tok AS (SELECT doc_id, unnest({_WORDS.format(c='text')}) AS token FROM documents),
    per AS (SELECT doc_id, token, count(*) AS tf FROM tok GROUP BY ALL), n AS (SELECT count(*)::DOUBLE AS n FROM documents)
    SELECT token, count(*)::BIGINT AS df, sum(tf)::BIGINT AS cf, round(ln(1 + (max(n) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)), 6) AS idf FROM per CROSS JOIN n GROUP BY token""")
def term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tokens = T.latin_tokens(F.col("text"))
    stats = R.postings(docs, "doc_id", tokens).groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    return stats.crossJoin(R.corpus_stats(docs, tokens).select("n_docs")).select("token", "df", "cf", F.round(R.idf(F.col("n_docs"), F.col("df")), 6).alias("idf"))


@query(f"SELECT doc_id, len({_WORDS.format(c='text')})::BIGINT AS dl, round(avg(len({_WORDS.format(c='text')})) OVER (), 6) AS avgdl FROM documents")
def doc_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tokens = T.latin_tokens(F.col("text"))
    return docs.select("doc_id", F.size(tokens).cast("long").alias("dl")).crossJoin(R.corpus_stats(docs, tokens).select(F.round("avgdl", 6).alias("avgdl")))


_VECTORS = """WITH s AS (SELECT a.vec_id AS query, b.vec_id AS doc, a.label AS ql, b.label AS dl, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score
    FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rnk FROM s)"""


def _vectors(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """Queries are the rows whose id is divisible by 20, against all rows."""
    rows = table(spark, sf_dir, "embeddings")
    return R.vector_top_k(rows.where("vec_id % 20 = 0"), rows, "vec_id", "embedding", k)


@query(f"{_VECTORS} SELECT query, doc, score, rnk FROM r WHERE rnk <= 10")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir, 10)


def _fused_sql(top: int) -> str:
    return f"""{_bm25_sql(_WORDS, 50, 'a_')}, {_bm25_sql(_BIGRAMS, 50, 'b_')},
    u AS (SELECT query, doc, rnk, 0 AS n FROM a_rk UNION ALL SELECT query, doc, rnk, 1 FROM b_rk),
    f AS (SELECT query, doc, round(sum(1.0::DOUBLE / (60 + rnk)), 12) AS score, min(n * 1000 + rnk) AS first FROM u GROUP BY ALL),
    fr AS (SELECT * FROM (SELECT query, doc, round(score, 6) AS score, row_number() OVER (PARTITION BY query ORDER BY score DESC, first) AS rnk FROM (SELECT query, doc, score, first FROM f)) WHERE rnk <= {top})"""


def _fused(spark: SparkSession, sf_dir: str, top: int) -> DataFrame:
    return R.reciprocal_rank_fusion([_bm25(spark, sf_dir, 50), _bm25(spark, sf_dir, 50, T.latin_bigram_tokens)], top=top)


@query(f"WITH {_fused_sql(20)} SELECT query, doc, score, rnk FROM fr")
def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir, 20)


@query(f"""WITH {_bm25_sql(_WORDS, 50)},
    live AS (SELECT rk.query, rk.doc, rk.rnk, coalesce(l.quality, 0) = 1 AS is_rule FROM rk LEFT JOIN labels l ON l.doc_id = rk.doc WHERE coalesce(l.toxic, 0) = 0),
    c AS (SELECT *, row_number() OVER (PARTITION BY query, is_rule ORDER BY rnk) AS nth FROM live),
    p AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY CASE WHEN is_rule THEN nth <= 3 ELSE nth <= 2 END DESC, rnk) AS place FROM c)
    SELECT query, doc, is_rule, rnk, row_number() OVER (PARTITION BY query ORDER BY rnk) AS pos FROM p WHERE place <= 5""")
def hybrid_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over-fetched ranking, then the active filter, then the class quota: filters below the over-fetch would change it."""
    flags = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("doc"), "quality", "toxic")
    live = _bm25(spark, sf_dir, 50).join(flags, "doc", "left").where(F.coalesce("toxic", F.lit(0)) == 0)
    ranked = live.select("query", "doc", "rnk", (F.coalesce("quality", F.lit(0)) == 1).alias("is_rule"))
    return R.quota(ranked, 5).select("query", "doc", "is_rule", "rnk", "pos")


@query(f"""WITH {_bm25_sql(_WORDS, 20)},
    g AS (SELECT query // 4 AS grp, doc, round(sum(1.0::DOUBLE / (60 + rnk)), 6) AS score, string_agg(query::VARCHAR, ',' ORDER BY query) AS origins FROM rk GROUP BY ALL)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, doc) AS rnk FROM g) WHERE rnk <= 30""")
def multi_query_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four benchmark items are the queries of one review."""
    ranked = _bm25(spark, sf_dir, 20).withColumn("grp", F.expr("query div 4"))
    return R.merge_queries(ranked).select("grp", "doc", "score", "origins", "rnk")


_HITS = f"""{_VECTORS}, top AS (SELECT * FROM r WHERE rnk <= 50), h AS (SELECT query, ql, min(CASE WHEN ql = dl THEN rnk END) AS hit FROM top GROUP BY ALL)"""
_METRICS = "count(*)::BIGINT AS n, " + ", ".join(f"round(avg(CASE WHEN hit <= {k} THEN 1.0::DOUBLE ELSE 0 END), 6) AS r{k}" for k in (1, 5, 10)) + ", round(avg(coalesce(1.0::DOUBLE / hit, 0)), 6) AS mrr"


def _label_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a vector are the vectors of its label; labels meet ranked rows, so the answer sets are never built."""
    labels = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    ranked = _vectors(spark, sf_dir, 50)
    asked = labels.select(F.col("vec_id").alias("query"), F.col("label").alias("asked"))
    found = labels.select(F.col("vec_id").alias("doc"), F.col("label").alias("found"))
    return ranked.join(asked, "query").join(found, "doc").groupBy("query", "asked").agg(F.min(F.when(F.col("asked") == F.col("found"), F.col("rnk"))).alias("hit"))


@query(f"{_HITS} SELECT {_METRICS} FROM h")
def recall_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.recall_metrics(_label_hits(spark, sf_dir))


@query(f"{_HITS} SELECT ql AS field, {_METRICS} FROM h GROUP BY GROUPING SETS ((), (ql))")
def recall_by_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _label_hits(spark, sf_dir).withColumnRenamed("asked", "field")
    return R.recall_metrics(hits, by=["field"]).unionByName(R.recall_metrics(hits).withColumn("field", F.lit(None).cast("int")))


@query(f"""WITH {_bm25_sql(_WORDS, 10)} SELECT query, round(avg(CASE WHEN coalesce(l.quality, 0) = 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS rule_share FROM rk LEFT JOIN labels l ON l.doc_id = rk.doc GROUP BY query""")
def topk_class_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("doc"), "quality")
    rule = F.when(F.coalesce("quality", F.lit(0)) == 1, 1.0).otherwise(0.0)
    return _bm25(spark, sf_dir, 10).join(flags, "doc", "left").groupBy("query").agg(F.round(F.avg(rule), 6).alias("rule_share"))


@query(f"""WITH {_bm25_sql(_WORDS, 10, 'a_')}, {_bm25_sql(_BIGRAMS, 10, 'b_')}, q AS (SELECT query FROM a_rk UNION SELECT query FROM b_rk),
    o AS (SELECT a_rk.query, count(*) AS n FROM a_rk JOIN b_rk USING (query, doc) GROUP BY ALL) SELECT query, round(coalesce(n, 0) / 10.0::DOUBLE, 6) AS overlap FROM q LEFT JOIN o USING (query)""")
def topk_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top_overlap(_bm25(spark, sf_dir, 10), _bm25(spark, sf_dir, 10, T.latin_bigram_tokens))


_PIECES = "(SELECT doc_id * 2147483648 + i AS piece, l AS text FROM (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS l FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)) WHERE trim(l, ' ') <> '')"


@query(f"""WITH {_bm25_sql(_WORDS, 400, docs=_PIECES, doc='piece')}, o AS (SELECT query, doc // 2147483648 AS owner, min(rnk) AS best FROM rk GROUP BY ALL)
    SELECT * FROM (SELECT query, owner, best, row_number() OVER (PARTITION BY query ORDER BY best) AS rnk FROM o) WHERE rnk <= 20""")
def fold_pieces_to_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents are searched by line and come back whole."""
    docs = table(spark, sf_dir, "documents")
    pieces = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text")).where("trim(text) <> ''").select((F.col("doc_id") * (1 << 31) + F.col("i") + 1).alias("piece"), "text")
    tokens = T.latin_tokens(F.col("text"))
    ranked = R.bm25(table(spark, sf_dir, "benchmark"), "item_id", tokens, pieces, "piece", tokens, 400)
    return R.fold_to_owner(ranked.withColumn("owner", F.expr("doc div 2147483648"))).select("query", "owner", "best", "rnk")


@query("""WITH cited AS (SELECT d.doc_id FROM documents d WHERE d.doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
    m AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS new_id FROM cited) SELECT doc_id, new_id::BIGINT AS new_id FROM m""")
def cited_only_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cited part of the corpus with dense new ids: offsets of ranges of ids, then places within a range."""
    cited = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi")
    return dense_ids(cited, "doc_id", "new_id")


def dense_ids(rows: DataFrame, key: str, out: str, width: int = 100_000) -> DataFrame:
    """0, 1, 2, … in the order of an integer key; only totals of key ranges pass one task."""
    from pyspark.sql import Window

    part = rows.withColumn("_range", F.floor(F.col(key) / width))
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = part.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(key)) - 1
    return part.withColumn("_place", place).join(starts, "_range").withColumn(out, (F.col("_first") + F.col("_place")).cast("long")).drop("_range", "_place", "_first")


def _overlap(pairs: list) -> list:
    """Shared words of two texts over the words of the first; fails on texts with a table, and has no answer for blank ones."""
    out = []
    for a, b in pairs:
        if " | " in b:
            raise ValueError("a table")
        words = set(a.split(" "))
        out.append(round(len(words & set(b.split(" "))) / len(words), 6) if b.strip() else None)
    return out


@query("""WITH p AS (SELECT b.item_id AS query, d.doc_id AS doc, row_number() OVER (PARTITION BY b.item_id ORDER BY d.doc_id) AS before, b.text AS q, d.text AS t FROM benchmark b JOIN documents d ON d.doc_id % (SELECT count(*) FROM benchmark) = b.item_id),
    s AS (SELECT *, CASE WHEN contains(t, ' | ') THEN 'failed' WHEN trim(t, chr(9) || chr(10) || chr(13) || ' ') = '' THEN 'passed' ELSE 'scored' END AS state,
      CASE WHEN NOT contains(t, ' | ') AND trim(t, chr(9) || chr(10) || chr(13) || ' ') <> '' THEN round(len(list_intersect(list_distinct(string_split(q, ' ')), list_distinct(string_split(t, ' ')))) / len(list_distinct(string_split(q, ' '))), 6) END AS score FROM p),
    r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC NULLS LAST, before) AS rnk FROM s)
    SELECT query, doc, before, score, state, rnk FROM r WHERE rnk <= 10""")
def rerank_hook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ranking scored again by a caller's function that fails on some rows; none is lost."""
    from ..operators import scoring

    items, docs = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")
    n = items.count()
    pairs = docs.select("doc_id", F.col("text").alias("t"), (F.col("doc_id") % n).alias("item_id")).join(items.select("item_id", F.col("text").alias("q")), "item_id")
    before = F.row_number().over(Window.partitionBy("item_id").orderBy("doc_id")).cast("long")
    ranking = pairs.select(F.col("item_id").alias("query"), F.col("doc_id").alias("doc"), before.alias("rnk"), "q", "t")
    return scoring.reranked(ranking, ["q", "t"], _overlap, 10).select("query", "doc", "before", "score", "state", "rnk")
