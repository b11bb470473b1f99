"""Ranked retrieval: BM25 over relational postings, exact vectors, rank fusion, quotas, and their evaluation.

Rankings are rows (query, doc, rnk). Every ranking has a total order: rounded score descending, then doc.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import kept, spread


def postings(docs: DataFrame, doc: str, tokens: Column) -> DataFrame:
    """(doc, token, tf, dl): a row for each distinct token of a document; dl counts all of its tokens."""
    base = docs.select(F.col(doc).alias("doc"), tokens.alias("tokens"))
    each = base.select("doc", F.size("tokens").cast("long").alias("dl"), F.explode("tokens").alias("token"))
    return each.groupBy("doc", "token", "dl").agg(F.count("*").alias("tf"))


def corpus_stats(docs: DataFrame, tokens: Column) -> DataFrame:
    """One row: number of documents and mean length; documents without tokens count."""
    return docs.select(F.coalesce(F.size(tokens), F.lit(0)).alias("dl")).agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))


def idf(n_docs: Column, df: Column) -> Column:
    return F.log(1 + (n_docs - df + 0.5) / (df + 0.5))


#: (query, token) rows up to which queries are broadcast: 2 million are about 100 MB with their words.
ASKED_ROWS = 2_000_000
#: Scores of queries by documents with the postings that make them, and tokens, that a task holds at a time (some 100 MB).
_BLOCK = 1_000_000


def bm25(queries: DataFrame, query: str, query_tokens: Column, docs: DataFrame, doc: str, doc_tokens: Column, k: int = 50, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query, doc, score, rnk) of the ``k`` best documents of each query, over its distinct tokens.

    Up to ``ASKED_ROWS`` distinct (query, token) rows, counted first, the queries are broadcast: documents are tokenized
    once into counts of asked tokens, document frequencies are one small aggregate of these, and every task scores its
    own documents and keeps ``k`` of each query, so that no posting is shuffled. More queries, and keys that are no whole
    numbers, meet the postings in joins.
    """
    asked = queries.select(F.col(query).alias("query"), F.explode(F.array_distinct(query_tokens)).alias("token")).distinct()
    whole = all(t in ("bigint", "int") for t in (dict(docs.select(F.col(doc).alias("doc")).dtypes)["doc"], dict(asked.dtypes)["query"]))
    few = asked.limit(ASKED_ROWS + 1).toArrow() if whole else None
    if few is None or len(few) > ASKED_ROWS:
        return _bm25_joined(asked, docs, doc, doc_tokens, k, k1, b)
    context = docs.sparkSession.sparkContext
    tokens = few.column("token").combine_chunks().dictionary_encode()
    words = context.broadcast({w: i for i, w in enumerate(tokens.dictionary.to_pylist())})
    names, of = np.unique(few.column("query").to_numpy(), return_inverse=True)
    token = tokens.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(token, kind="stable")
    starts = np.searchsorted(token[order], np.arange(len(words.value) + 1))
    counted = kept(spread(docs).select(F.col(doc).cast("long").alias("doc"), doc_tokens.alias("tokens")).mapInArrow(_asked_counts(words), "doc long, dl long, token array<int>, tf array<int>"))
    stats = counted.agg(F.count("*"), F.coalesce(F.avg("dl"), F.lit(1.0))).first()
    df = counted.select(F.explode("token").alias("token")).groupBy("token").count().toArrow()
    found = np.zeros(len(words.value))
    found[df.column("token").to_numpy()] = df.column("count").to_numpy()
    side = context.broadcast((names, of[order], starts, np.log(1 + (stats[0] - found + 0.5) / (found + 0.5))))
    scores = counted.mapInArrow(_best_of_task(side, float(stats[1]), k, k1, b), "query long, doc long, score double")
    kind = dict(asked.dtypes)["query"]
    return top_k(scores.select(F.col("query").cast(kind), F.col("doc").cast(dict(docs.select(F.col(doc).alias("d")).dtypes)["d"]), "score"), k)


def _rounded(score: np.ndarray) -> np.ndarray:
    """Six decimals, halves up, as ``F.round`` does in the joined form."""
    return np.floor(score * 1e6 + 0.5) / 1e6


def _stretches(costs: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of rows whose costs add up to ``limit`` at most; a row beyond it stands alone."""
    upto, first = np.concatenate([[0], np.cumsum(costs, dtype=np.int64)]), 0
    while first < len(costs):
        end = max(first + 1, int(np.searchsorted(upto, upto[first] + limit, "right")) - 1)
        yield first, end
        first = end


def _sizes(lists: pa.Array) -> np.ndarray:
    return np.nan_to_num(pc.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(np.int64)


def _asked_counts(words) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each document its length, and its asked tokens with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = words.value
        for batch in (whole.slice(a, b - a) for whole in batches for a, b in _stretches(_sizes(whole.column(1)), _BLOCK)):
            lists = batch.column(1)
            sizes = _sizes(lists)
            flat = lists.flatten().dictionary_encode()
            known = np.array([number.get(w, -1) for w in flat.dictionary.to_pylist()], np.int64)
            token = known[flat.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.zeros(0, np.int64)
            row = np.repeat(np.arange(batch.num_rows), sizes)[token >= 0]
            width = max(len(number), 1)
            pair, tf = np.unique(row * width + token[token >= 0], return_counts=True)
            offsets = pa.array(np.searchsorted(pair, np.arange(batch.num_rows + 1) * width).astype(np.int32))
            columns = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (pair % width, tf)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), *columns], ["doc", "dl", "token", "tf"])

    return run


def _best_of_task(side, avgdl: float, k: int, k1: float, b: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From counts to the ``k`` best documents of each query in this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, queries, starts, idf_of = side.value
        asked_by = np.diff(starts)
        best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for batch in batches:
            # what a document costs: a score of each query, and a row of each of its tokens with each query that asks it
            asking = asked_by[batch.column(2).flatten().to_numpy(zero_copy_only=False)]
            ends = np.cumsum(_sizes(batch.column(2)))
            rows_upto = np.concatenate([[0], np.cumsum(asking, dtype=np.int64)])[np.concatenate([[0], ends])]
            for at, end in _stretches(np.diff(rows_upto) + len(names), _BLOCK):
                part = batch.slice(at, end - at)
                docs, dl = part.column(0).to_numpy(zero_copy_only=False), part.column(1).to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(part.num_rows), pc.list_value_length(part.column(2)).to_numpy(zero_copy_only=False))
                token, tf = (part.column(i).flatten().to_numpy(zero_copy_only=False) for i in (2, 3))
                weight = idf_of[token] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl[row] / avgdl))
                asking = starts[token + 1] - starts[token]
                first = np.repeat(starts[token] - np.concatenate([[0], np.cumsum(asking)[:-1]]), asking) if len(token) else np.zeros(0, np.int64)
                query = queries[first + np.arange(len(first))]
                cell = query * part.num_rows + np.repeat(row, asking)
                score = np.bincount(cell, np.repeat(weight, asking), len(names) * part.num_rows).reshape(len(names), -1)
                score = _rounded(score)
                kth = np.partition(score, -k, axis=1)[:, -k, None] if score.shape[1] > k else np.zeros((len(names), 1))
                q, d = np.nonzero((score >= kth) & (score > 0))
                best = tuple(np.concatenate(x) for x in zip(best, (q, docs[d], score[q, d])))
                order = np.lexsort((best[1], -best[2], best[0]))
                q = best[0][order]
                place = np.arange(len(q)) - np.searchsorted(q, q)
                best = tuple(x[order[place < k]] for x in best)
        yield pa.RecordBatch.from_arrays([pa.array(names[best[0]].astype(np.int64)), pa.array(best[1]), pa.array(best[2])], ["query", "doc", "score"])

    return run


def _bm25_joined(asked: DataFrame, docs: DataFrame, doc: str, doc_tokens: Column, k: int, k1: float, b: float) -> DataFrame:
    """The same by joins: only postings of asked tokens are kept before document frequencies are counted."""
    found = postings(docs, doc, doc_tokens).join(asked.select("token").distinct(), "token", "left_semi")
    df = found.groupBy("token").agg(F.count("*").alias("df"))
    weight = idf(F.col("n_docs"), F.col("df")) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    weighted = found.join(df, "token").crossJoin(corpus_stats(docs, doc_tokens)).select("token", "doc", weight.alias("w"))
    scores = asked.join(weighted, "token").groupBy("query", "doc").agg(F.round(F.sum("w"), 6).alias("score"))
    return top_k(scores, k)


def top_k(scores: DataFrame, k: int, rank: str = "rnk") -> DataFrame:
    """The ``k`` best rows of each query; Spark limits each group before the shuffle."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc("doc"))
    return scores.withColumn(rank, F.row_number().over(order).cast("long")).where(F.col(rank) <= k)


#: Query vectors and row values of one cell of the grid, and the tiles in which a cell is multiplied.
_CELL_QUERIES, _CELL_VALUES = 16_384, 4_194_304
_TILE_QUERIES, _TILE_ROWS = 2_048, 1_024


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def _nearest(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The ``k`` best rows of every query of a cell. Only scores that reach a query's k-th best so far are kept and sorted."""

    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if asked.num_rows and rows.num_rows:
            # Equal rows came as one with their number; no ranking holds more than k of them.
            times = np.minimum(rows["n"].to_numpy(), k)
            docs, vectors = np.repeat(rows["key"].to_numpy(), times), np.repeat(_matrix(rows["vector"]), times, axis=0)
            names, matrix = asked["key"].to_numpy(), _matrix(asked["vector"])
            for q0 in range(0, len(names), _TILE_QUERIES):
                name, part = names[q0 : q0 + _TILE_QUERIES], matrix[q0 : q0 + _TILE_QUERIES]
                best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
                floor = np.full((len(name), 1), -np.inf)
                for d0 in range(0, len(docs), _TILE_ROWS):
                    doc = docs[d0 : d0 + _TILE_ROWS]
                    score = np.round(part @ vectors[d0 : d0 + _TILE_ROWS].T, 6)
                    score[name[:, None] == doc[None, :]] = -np.inf
                    if score.shape[1] > k:
                        floor = np.maximum(floor, np.partition(score, -k, axis=1)[:, -k, None])
                    q, d = np.nonzero((score >= floor) & (score > -np.inf))
                    best = tuple(np.concatenate(x) for x in zip(best, (q, doc[d], score[q, d])))
                    order = np.lexsort((best[1], -best[2], best[0]))
                    q = best[0][order]
                    best = tuple(x[order[np.arange(len(q)) - np.searchsorted(q, q) < k]] for x in best)
                    ends = np.searchsorted(best[0], np.arange(len(name)), "right") - 1
                    full = np.bincount(best[0], minlength=len(name)) == k
                    floor[full, 0] = np.maximum(floor[full, 0], best[2][ends[full]])
                found.append((name[best[0]], best[1], best[2]))
        query, doc, score = (np.concatenate(x) for x in zip(*found))
        return pa.table({"query": query.astype(np.int64), "doc": doc.astype(np.int64), "score": score})

    return run


def finite(vector: Column) -> Column:
    """Whether a vector has elements, and each is a finite number."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def vector_top_k(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int, cell_queries: int = _CELL_QUERIES, cell_rows: int | None = None) -> DataFrame:
    """Exact inner-product neighbours (query, doc, score, rnk), self excluded.

    Rows and queries of a null key, of a null or empty vector, or of one with an element that is null, NaN or infinite
    take no part; vectors of different lengths are never neighbours.

    Queries and rows are dealt by hash to blocks of about ``cell_queries`` and ``cell_rows`` vectors (as many as make
    ``_CELL_VALUES`` numbers by default), and every block of queries meets every block of rows of its length in a cell of
    its own, by equality of the cell's number. A cell gives its k best of each query. So nothing passes the driver but
    two counts and the greatest length, a task holds one cell (some 40 MB), and no pair of vectors is ever written. Rows
    that agree in key and vector move as one, with their number. Counts run when this is called.
    """
    spark = queries.sparkSession
    taken = lambda df: df.where(F.col(key).isNotNull() & finite(F.col(vector))).select(F.col(key).cast("long").alias("key"), F.col(vector).alias("vector"))
    asked, data = taken(queries).distinct(), taken(rows).groupBy("key", "vector").agg(F.count("*").alias("n"))
    tasks = spark.sparkContext.defaultParallelism
    n_asked = max(1, -(-taken(queries).count() // cell_queries))
    counted = taken(rows).agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(1))).first()
    cell_rows = cell_rows or max(1024, _CELL_VALUES // counted[1])
    n_rows = max(-(-counted[0] // cell_rows), -(-tasks // n_asked))
    block = lambda n: F.pmod(F.xxhash64("key", "vector"), F.lit(n))
    cells = min(n_asked * n_rows, 20 * max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    left = asked.withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0), F.lit(n_rows - 1)), lambda i: block(n_asked) * n_rows + i)))
    right = data.withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0), F.lit(n_asked - 1)), lambda i: i * n_rows + block(n_rows))))
    left, right = (df.withColumn("length", F.size("vector")).repartition(cells, "cell", "length") for df in (left, right))
    found = left.groupBy("cell", "length").cogroup(right.groupBy("cell", "length")).applyInArrow(_nearest(k), "query long, doc long, score double")
    return top_k(found, k)


def reciprocal_rank_fusion(rankings: list[DataFrame], k: int = 60, top: int = 50) -> DataFrame:
    """(query, doc, score, rnk): sums of 1 / (k + rank). Ties keep the order of the rankings, then of their ranks."""
    every = reduce(DataFrame.unionByName, [r.select("query", "doc", "rnk", F.lit(i).alias("ranking")) for i, r in enumerate(rankings)])
    fused = every.groupBy("query", "doc").agg(F.round(F.sum(1.0 / (k + F.col("rnk"))), 12).alias("score"), F.min(F.struct("ranking", "rnk")).alias("first"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "first")
    return fused.withColumn("rnk", F.row_number().over(order).cast("long")).where(F.col("rnk") <= top).select("query", "doc", F.round("score", 6).alias("score"), "rnk")


def quota(ranking: DataFrame, k: int, slots: int | None = None, rule: str = "is_rule") -> DataFrame:
    """At most ``slots`` rules first (3/5 of k if none is said), then others up to k, then whoever is next; in the ranking's order."""
    slots = max(1, 3 * k // 5) if slots is None else slots
    by_class = Window.partitionBy("query", rule).orderBy("rnk")
    marked = ranking.withColumn("_nth", F.row_number().over(by_class))
    chosen = F.when(F.col(rule), F.col("_nth") <= slots).otherwise(F.col("_nth") <= k - slots)
    fill = Window.partitionBy("query").orderBy(F.desc("_chosen"), "rnk")
    marked = marked.withColumn("_chosen", chosen).withColumn("_place", F.row_number().over(fill)).where(F.col("_place") <= k)
    final = Window.partitionBy("query").orderBy("rnk")
    return marked.withColumn("pos", F.row_number().over(final).cast("long")).drop("_nth", "_chosen", "_place")


def fold_to_owner(ranking: DataFrame, owner: str = "owner", k: int = 20, depth: int = 400) -> DataFrame:
    """Ranked pieces to their owners, each by its first piece among the first ``depth``."""
    owners = ranking.where(F.col("rnk") <= depth).groupBy("query", owner).agg(F.min("rnk").alias("best"))
    order = Window.partitionBy("query").orderBy("best")
    return owners.withColumn("rnk", F.row_number().over(order).cast("long")).where(F.col("rnk") <= k)


def merge_queries(rankings: DataFrame, group: str = "grp", k: int = 60, top: int = 30) -> DataFrame:
    """Fuses the rankings of a group's queries; keeps which queries found each document, in order."""
    fused = rankings.groupBy(group, "doc").agg(F.round(F.sum(1.0 / (k + F.col("rnk"))), 6).alias("score"), F.array_join(F.transform(F.array_sort(F.collect_set("query")), lambda q: q.cast("string")), ",").alias("origins"))
    order = Window.partitionBy(group).orderBy(F.desc("score"), "doc")
    return fused.withColumn("rnk", F.row_number().over(order).cast("long")).where(F.col("rnk") <= top)


def first_hits(ranking: DataFrame, answers: DataFrame) -> DataFrame:
    """(query, hit): the rank of the first right document of each ranked query, null if none. ``answers``: query, doc."""
    asked = ranking.select("query").distinct().join(answers.select("query").distinct(), "query", "left_semi")
    hits = ranking.join(answers.distinct(), ["query", "doc"]).groupBy("query").agg(F.min("rnk").alias("hit"))
    return asked.join(hits, "query", "left")


def recall_metrics(hits: DataFrame, ks: tuple[int, ...] = (1, 5, 10), by: list[str] | None = None) -> DataFrame:
    """n, recall at each k, and the mean reciprocal rank."""
    recall = [F.round(F.avg(F.when(F.col("hit") <= k, 1.0).otherwise(0.0)), 6).alias(f"r{k}") for k in ks]
    mrr = F.round(F.avg(F.coalesce(1.0 / F.col("hit"), F.lit(0.0))), 6).alias("mrr")
    return hits.groupBy(*(by or [])).agg(F.count("*").alias("n"), *recall, mrr)


def top_overlap(a: DataFrame, b: DataFrame, k: int = 10) -> DataFrame:
    """Of each query, the part of the first ``k`` that two rankings share."""
    x, y = a.where(F.col("rnk") <= k), b.where(F.col("rnk") <= k)
    both = x.join(y.select("query", "doc"), ["query", "doc"]).groupBy("query").agg(F.count("*").alias("n"))
    asked = x.select("query").union(y.select("query")).distinct()
    return asked.join(both, "query", "left").select("query", F.round(F.coalesce("n", F.lit(0)) / float(k), 6).alias("overlap"))
