"""Ranked lexical search over an index of compressed posting blocks with maximum impacts (block-max WAND).

Index: every task cuts its documents into shards of at most ``SHARD_POSTINGS`` postings. In a shard documents have
ordinals, and a term's postings are blocks of ``BLOCK``: variable-byte gaps of ordinals and counts, with the first
and last ordinal and the maximum impact of each block beside them, readable without decompression. No posting is
shuffled to build it; a lost task builds its shards again. Impacts need the number and length of all documents,
which are counted first.

Search: the rows of the queries' terms meet by shard. For each query the ends of all its terms' blocks cut the
shard into intervals; the lists' pointers move over them shallowly, by binary search over block ends. The sum of
the block maxima bounds every score of an interval, and intervals below the query's threshold are skipped. The rest
are entered from the highest bound on, and term by term from the heaviest: a term's block is decompressed only if
its interval can still bring in a document, or if a document that can still reach the threshold falls into it. The
heaviest terms' lists, up to ``SHORT`` postings together, are opened at once, and their documents are intervals of
their own. The threshold starts at the best of the terms' k-th largest block maxima over all shards (k blocks hold k
documents of such scores), or at the k-th best of the sums over the opened lists, and rises to the k-th best score
of the shard. Bounds are exact integers, so results are too.

Defined results: null, empty and wordless texts are not in the index and are not counted; a null or wordless query
has no results; rows of equal ids are documents of their own; a null id ranks behind others of equal score;
repeated rows of a query are one query; empty tables give no rows; texts of any length are read whole, one document
at a time; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import NON_WORD, cut, fresh_path, word_array

#: Postings of a block, postings and documents of a shard, and (query, term) rows broadcast at once; more take more passes.
BLOCK, SHARD_POSTINGS, SHARD_DOCUMENTS, QUERY_ROWS = 128, 2_000_000, 100_000, 1_000_000
#: Intervals that are entered first, to raise the threshold; each further round enters four times as many.
FIRST = 8
#: Postings of the heaviest terms' lists that are opened at once.
SHORT = 512
_TERM = re.compile("[0-9a-z\x80-\U0010ffff]+")
_DOCS = "shard string, ids array<long>, sizes array<int>"
_POSTINGS = "shard string, term string, n int, first array<int>, last array<int>, best array<int>, at array<int>, data binary"


def terms_of(text: str | None) -> list[str]:
    return _TERM.findall((text or "").encode().lower().decode())  # bytes: lower-cases A-Z only


def impacts(tf: np.ndarray, sizes: np.ndarray, total_docs: int, total_size: int) -> np.ndarray:
    """(10^9 tf) div (1000 tf + 8 m), where m = 10 + (90 size N) div L."""
    tf, m = tf.astype(np.int64), 10 + (90 * total_docs * sizes.astype(np.int64)) // total_size
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Variable-byte code of unsigned ``values`` (seven bits a byte, the last with its high bit set) and the end of each."""
    values = values.astype(np.uint64)
    lengths = np.ones(len(values), np.int64)
    for bits in range(7, 64, 7):
        lengths += values >= np.uint64(1 << bits)
    ends = np.cumsum(lengths)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(lengths.max(initial=0))):
        here = np.flatnonzero(lengths > k)
        byte = (values[here] >> np.uint64(7 * k)) & np.uint64(127)
        byte[lengths[here] == k + 1] |= np.uint64(128)
        out[ends[here] - lengths[here] + k] = byte
    return out, ends


def decode(code: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(code >= 128)
    if not len(ends):
        return np.empty(0, np.int64)
    if len(ends) == len(code):
        return (code & 127).astype(np.int64)
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(code)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((code & 127).astype(np.int64) << (7 * place), starts)


class _Shard:
    """The postings of the documents seen since the last flush."""

    def __init__(self, name: str, total_docs: int, total_size: int):
        self.name, self.n, self.total = name, 0, (total_docs, total_size)
        self.clear()

    def clear(self) -> None:
        self.terms: defaultdict[str, int] = defaultdict()
        self.terms.default_factory = self.terms.__len__
        self.ids, self.sizes, self.found, self.counts, self.postings = [], [], [], [], 0

    def add(self, doc_id: int | None, words: list[str]) -> bool:
        """Takes a document; whether the shard is full."""
        terms = self.terms
        found, counts = np.unique(np.fromiter((terms[w] for w in words), np.int32, len(words)), return_counts=True)
        self.ids.append(doc_id)
        self.sizes.append(len(words))
        self.found.append(found)
        self.counts.append(counts.astype(np.int32))
        self.postings += len(found)
        return self.postings >= SHARD_POSTINGS or len(self.ids) >= SHARD_DOCUMENTS

    def rows(self) -> Iterator[pa.RecordBatch]:
        """The shard as one row of documents and a row for each term."""
        if not self.ids:
            return
        shard, self.n = f"{self.name}-{self.n}", self.n + 1
        sizes = np.array(self.sizes, np.int32)
        term = np.concatenate(self.found)
        doc = np.repeat(np.arange(len(sizes), dtype=np.int32), [len(f) for f in self.found])
        tf = np.concatenate(self.counts)
        order = np.argsort(term, kind="stable")
        term, doc, tf = term[order], doc[order], tf[order]
        impact = impacts(tf, sizes[doc], *self.total).astype(np.int32)
        starts = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))  # of a term
        sizes_of = np.diff(np.concatenate([starts, [len(term)]]))
        inside = np.arange(len(term)) - np.repeat(starts, sizes_of)
        opens = inside % BLOCK == 0
        blocks = np.flatnonzero(opens)
        gaps = np.where(opens, 0, doc - np.concatenate([[0], doc[:-1]]))  # the first of a block stands beside it
        code, ends = encode(np.stack([gaps, tf], 1).reshape(-1))
        ends = np.concatenate([[0], ends[1::2]])
        block_ends = np.concatenate([blocks[1:], [len(term)]])
        of_term = np.concatenate([np.flatnonzero(inside[blocks] == 0), [len(blocks)]]).astype(np.int32)
        data_at = ends[np.concatenate([starts, [len(term)]])]
        names = list(self.terms)
        listed = lambda values: pa.ListArray.from_arrays(pa.array(of_term), pa.array(values.astype(np.int32)))
        at = ends[blocks] - np.repeat(data_at[:-1], np.diff(of_term))
        step = max(1, 50_000)
        columns = [
            pa.array([names[t] for t in term[starts].tolist()], pa.string()), pa.array(sizes_of.astype(np.int32)),
            listed(doc[blocks]), listed(doc[block_ends - 1]), listed(np.maximum.reduceat(impact, blocks)), listed(at),
            pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(data_at.astype(np.int32)), pa.py_buffer(code)]),
        ]
        docs = pa.array([self.ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int32()))
        yield _row_batch(shard, 1, docs, None)
        for a in range(0, len(starts), step):
            part = [c.slice(a, step) for c in columns]
            yield _row_batch(shard, len(part[0]), None, part)
        self.clear()


def _row_batch(shard: str, n: int, docs: tuple[pa.Array, pa.Array] | None, columns: list[pa.Array] | None) -> pa.RecordBatch:
    ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
    types = [pa.string(), pa.int32(), ints, ints, ints, ints, pa.binary()]
    columns = columns or [pa.nulls(n, t) for t in types]
    docs = docs or (pa.nulls(n, longs), pa.nulls(n, ints))
    return pa.RecordBatch.from_arrays([pa.array([shard] * n, pa.string()), *docs, *columns], ["shard", "ids", "sizes", "term", "n", "first", "last", "best", "at", "data"])


def _shards(run_name: str, total_docs: int, total_size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = _Shard(f"{run_name}-{TaskContext.get().partitionId()}", total_docs, total_size)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = terms_of(text.as_py())
                if words and shard.add(doc_id, words):
                    yield from shard.rows()
        yield from shard.rows()

    return run


@dataclass
class LexicalIndex:
    path: str
    total_docs: int
    total_size: int

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path)


def build_index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> LexicalIndex:
    """Writes the index of all documents to ``path`` (a new folder of the shared one by default). Runs two scans."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")), F.lit(0))
    total = rows.select(size.alias("size")).agg(F.count_if(F.col("size") > 0).alias("docs"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()
    path = path or fresh_path(docs.sparkSession, "lexical")
    schema = "shard string, ids array<long>, sizes array<int>, " + _POSTINGS.removeprefix("shard string, ")
    rows.mapInArrow(_shards("s", total["docs"], total["size"]), schema).write.parquet(path)
    return LexicalIndex(path, total["docs"], total["size"])


@dataclass
class _List:
    """A term's posting list in a shard, decompressed block by block."""

    weight: int
    first: np.ndarray
    last: np.ndarray
    best: np.ndarray
    at: np.ndarray
    data: np.ndarray
    n: int
    whole: tuple[np.ndarray, np.ndarray] | None = None
    opened: int = 0
    single: _List | None = None

    def opened_at_once(self, sizes: np.ndarray, total_docs: int, total_size: int) -> _List:
        """The same list with a block for each posting."""
        if self.single is None:
            doc, tf = self.whole = self.whole or self._decoded(np.arange(len(self.last)))
            self.single = _List(self.weight, doc, doc, impacts(tf, sizes[doc], total_docs, total_size), self.at, self.data, self.n, self.whole)
            self.single.single = self.single
        return self.single

    def open(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ordinals and counts of some ``blocks``, ascending."""
        if self.single is self:
            return self.whole[0][blocks], self.whole[1][blocks]
        if self.whole is None and 2 * len(blocks) >= len(self.last):
            self.whole = self._decoded(np.arange(len(self.last)))
        if self.whole is not None:
            if len(blocks) == len(self.last):
                return self.whole
            keep = np.zeros(len(self.last), bool)
            keep[blocks] = True
            keep = np.repeat(keep, np.minimum(BLOCK, self.n - np.arange(len(self.last)) * BLOCK))
            return self.whole[0][keep], self.whole[1][keep]
        return self._decoded(blocks)

    def _decoded(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        self.opened += len(blocks)
        ends = np.append(self.at, len(self.data))
        if len(blocks) == len(self.last):
            code = self.data
        else:
            code = np.concatenate([self.data[ends[b] : ends[b + 1]] for b in blocks.tolist()])
        values = decode(code)
        gaps, tf = values[0::2], values[1::2]
        sizes = np.minimum(BLOCK, self.n - blocks * BLOCK)
        starts = np.cumsum(sizes) - sizes
        run = np.cumsum(gaps)
        return run + np.repeat(self.first[blocks] - run[starts], sizes), tf


def _best_of_shard(lists: list[_List], sizes: np.ndarray, order: np.ndarray, k: int, floor: int, total_docs: int, total_size: int) -> tuple[np.ndarray, np.ndarray]:
    """Ordinals and scores of the shard's ``k`` best documents of score ``floor`` at least; ``order``: rank of the ids."""
    none = np.empty(0, np.int64), np.empty(0, np.int64)
    lists = sorted(lists, key=lambda x: -x.weight * int(x.best.max()))
    floor = max(floor, 1)
    if sum(x.weight * int(x.best.max()) for x in lists) < floor:
        return none
    partial, held = np.zeros(len(sizes), np.int64), 0
    for t, x in enumerate(lists):
        held += x.n
        if held > SHORT:
            break
        lists[t] = x = x.opened_at_once(sizes, total_docs, total_size)
        partial[x.first] += x.weight * x.best
    if len(partial) >= k:
        floor = max(floor, int(np.partition(partial, -k)[-k]))
    ends = np.unique(np.concatenate([x.last for x in lists] + [x.first - 1 for x in lists]))
    ends = ends[ends >= 0]
    bound, block_of = np.zeros((len(lists) + 1, len(ends)), np.int64), np.empty((len(lists), len(ends)), np.int64)
    for t, x in enumerate(lists):
        b = np.searchsorted(x.last, ends)
        block_of[t] = b = np.minimum(b, len(x.last) - 1)
        here = (x.last[b] >= ends) & (x.first[b] <= ends)
        bound[t] = np.where(here, x.weight * x.best[b], 0)
        block_of[t][~here] = -1
    bound = np.cumsum(bound[::-1], 0)[::-1]  # of the terms from t on
    n = len(sizes)
    interval = np.searchsorted(ends, np.arange(n))
    inside = interval < len(ends)
    interval = np.minimum(interval, len(ends) - 1)
    best, scores = none
    by_bound = np.argsort(-bound[0], kind="stable")
    done, size = 0, FIRST
    while done < len(by_bound):
        part = by_bound[done : done + size]
        part = part[bound[0][part] >= floor]
        if not len(part):
            break  # bounds fall from here on
        done, size = done + size, 4 * size
        mine = np.zeros(len(ends), bool)
        mine[part] = True
        score, seen = np.zeros(n, np.int64), np.zeros(n, bool)
        for t, x in enumerate(lists):
            enters = mine & (bound[t] >= floor)
            alive = np.flatnonzero(seen)
            alive = alive[score[alive] + bound[t][interval[alive]] >= floor]
            wanted = block_of[t][enters]
            if len(alive):
                wanted = np.concatenate([wanted, block_of[t][interval[alive]]])
            wanted = np.unique(wanted)
            wanted = wanted[wanted >= 0]
            if not len(wanted):
                continue
            doc, tf = x.open(wanted)
            ok = seen[doc] | (enters[interval[doc]] & inside[doc])
            doc, tf = doc[ok], tf[ok]
            score[doc] += x.weight * impacts(tf, sizes[doc], total_docs, total_size)
            seen[doc] = True
        found = np.flatnonzero(seen & (score >= floor))
        best, scores = np.concatenate([best, found]), np.concatenate([scores, score[found]])
        top = np.lexsort((order[best], -scores))[:k]
        best, scores = best[top], scores[top]
        if len(best) == k:
            floor = max(floor, int(scores[-1]))
    return best, scores


def _searcher(index: LexicalIndex, queries, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From rows sorted by shard, documents first: (query, doc_id, score) of each shard's best."""

    def best_of(ids: list, sizes: np.ndarray, found: dict[str, list]) -> Iterator[pa.RecordBatch]:
        order = np.empty(len(ids), np.int64)
        order[sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))] = np.arange(len(ids))
        lists: dict[str, _List] = {}
        out: tuple[list, list, list] = ([], [], [])
        for query, floor, terms in queries.value:
            mine = []
            for term, weight in terms:
                if weight and term in found:
                    if term not in lists:
                        n, first, last, best, at, data = found[term]
                        lists[term] = _List(weight, *(np.array(c, np.int64) for c in (first, last, best, at)), np.frombuffer(data, np.uint8), n)
                    mine.append(lists[term])
            if mine:
                best, scores = _best_of_shard(mine, sizes, order, k, floor, index.total_docs, index.total_size)
                out[0].extend([query] * len(best))
                out[1].extend(ids[i] for i in best.tolist())
                out[2].extend(scores.tolist())
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["query", "doc_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ids, sizes, found = None, [], np.empty(0, np.int64), {}
        for batch in batches:
            for i, (name, term) in enumerate(zip(batch.column(0).to_pylist(), batch.column(3).to_pylist())):
                if name != shard:
                    if found:
                        yield from best_of(ids, sizes, found)
                    shard, ids, found = name, [], {}
                if term is None:
                    ids, sizes = batch.column(1)[i].as_py(), batch.column(2)[i].values.to_numpy().astype(np.int64)
                else:
                    found[term] = [batch.column(4)[i].as_py(), *(batch.column(c)[i].values.to_numpy() for c in (5, 6, 7, 8)), batch.column(9)[i].as_py()]
        if found:
            yield from best_of(ids, sizes, found)

    return run


def search(index: LexicalIndex, queries: DataFrame, k: int = 10, *, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """query_id, rank, doc_id, score: the ``k`` best documents of score above 0 of each distinct row of ``queries``.

    Queries go to the tasks in slices of ``QUERY_ROWS`` (query, term) rows; each slice reads the index once.
    """
    spark = queries.sparkSession
    asked = cut(queries.select(F.col(f"`{id_col}`").alias("query_id"), F.col(f"`{text_col}`").alias("text")).distinct().withColumn("query", F.monotonically_increasing_id()))
    terms = asked.select("query", F.explode(F.array_distinct(word_array(F.col("text")))).alias("term"))
    rows = index.rows(spark)
    wanted = terms.select("term").distinct()
    held = cut(rows.join(wanted, "term", "left_semi").select("shard", "ids", "sizes", "term", "n", "first", "last", "best", "at", "data"))
    weight = F.floor(1000 * F.ln(F.lit(2.0 * index.total_docs + 2.0) / (2.0 * F.col("df") + 1.0))).cast("long")
    weights = held.groupBy("term").agg(F.sum("n").alias("df")).select("term", weight.alias("weight"))
    place = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("best")))
    kth = held.select("term", F.explode(F.slice(F.sort_array("best", asc=False), 1, k)).alias("best")).withColumn("place", place).where(F.col("place") <= k)
    kth = kth.where(F.col("place") == k).select("term", "best")
    weighted = weights.join(kth, "term", "left").select("term", "weight", (F.col("weight") * F.coalesce("best", F.lit(0))).alias("floor"))
    planned = terms.join(weighted, "term").groupBy("query").agg(F.max("floor").alias("floor"), F.collect_list(F.struct("term", "weight")).alias("terms"))
    planned = cut(planned)
    total = planned.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    slices = -(-total // QUERY_ROWS)
    documents = rows.where("term is null").select(*held.columns)
    sorted_rows = held.unionByName(documents).repartition("shard").sortWithinPartitions("shard", F.col("term").asc_nulls_first())
    best = None
    for one in range(slices):
        mine = planned.where(F.pmod(F.xxhash64("query"), F.lit(slices)) == one)
        packed = [(r["query"], r["floor"], [(t["term"], t["weight"]) for t in r["terms"]]) for r in mine.toLocalIterator()]
        found = sorted_rows.mapInArrow(_searcher(index, spark.sparkContext.broadcast(packed), k), "query long, doc_id long, score long")
        best = found if best is None else best.unionByName(found)
    if best is None:
        best = spark.createDataFrame([], "query long, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    ranked = best.withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.join(asked.select("query", "query_id"), "query").select("query_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
