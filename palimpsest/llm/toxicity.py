"""Toxicity by maximum-scoring segments.

Fitting: of at most ``SAMPLE`` labelled rows a class (the least hashes of the ids; all rows where there are fewer),
features are words and word stems (the first 4 and 5 letters, with a ``*``). Features seen in at least three toxic
rows are counted by the distinct contexts (the words before and after) in which they stand, so copies of a text
count once. A feature's score is its log-odds between the classes under a Dirichlet prior drawn from both; it
counts where its z-score is 3 or more. Every other word has a small negative score.

Scoring: one linear scan a text finds all maximal scoring segments (disjoint, each of the largest sum that cannot
be extended). By extreme-value theory n words hold a chance segment of score S or more ``K n exp(-lambda S)``
times; lambda solves sum p exp(lambda s) = 1 over the clean words, K is the part of it that positive words have.
Segments expected less than once are significant; their evidence is joined by the sum statistic of the best r of
them, and two numbers fitted on the sample carry the evidence to a probability.

Defined results: null, empty and wordless texts hold no passage and get the score of no evidence; null labels are
not used; repeated labels of an id are used once, toxic if any is; without toxic or clean labels every score is 0.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_remainder, cut, give_memory_back, trimmed

#: Bound on the labelled rows of each class that the model is fitted on.
SAMPLE = 6000
#: Bound on the features of a model, by z-score.
MAX_FEATURES = 50_000
STEMS = (5, 4)
#: Score of a word that tells nothing, and the least z-score of one that does.
BACKGROUND, MIN_Z = -0.02, 3.0
#: Part of a feature's count that its prior holds.
PRIOR = 0.05
_WORD = re.compile(r"[^\W_]+")
_CACHE = 300_000

_PASSAGES = "array<struct<start:int,end:int,score:double,expected:double>>"


@dataclass
class ToxicityModel:
    scores: dict[str, float] = field(default_factory=dict)
    scale: float = 1.0  # lambda
    rate: float = 1.0  # K
    intercept: float = -math.inf
    slope: float = 0.0


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def features_of(word: str) -> list[str]:
    return [word, *[f"{word[:n]}*" for n in STEMS if len(word) > n]]


def maximal_segments(hits: list[tuple[int, float]], background: float = BACKGROUND) -> list[tuple[int, int, float]]:
    """(first, last, score) of the maximal scoring segments of a sequence that is ``background`` but for ``hits``.

    Each candidate remembers the last one before it that began lower, so the search back takes linear time in all.
    """
    kept: list[tuple[int, int, float, float, int]] = []  # first, last, sum before, sum after, link
    total, before = 0.0, -1
    for at, score in hits:
        total += background * (at - before - 1)
        before = at
        low, total = total, total + score
        if score <= 0:
            continue
        first = at
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= low:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= total:
                kept.append((first, at, low, total, j))
                break
            first, low = kept[j][0], kept[j][2]
            del kept[j:]
    return [(a, b, high - low) for a, b, low, high, _ in kept]


def _log_factorial(n: int) -> float:
    return math.lgamma(n + 1)


class Scorer:
    """Words of ``model`` looked up with their stems, each distinct word once while it is cached."""

    def __init__(self, model: ToxicityModel):
        self.model, self.cache = model, {}

    def word(self, word: str) -> float | None:
        scores = self.model.scores
        return next((scores[f] for f in features_of(word) if f in scores), None)

    def passages(self, text: str | None) -> tuple[float, list[tuple[int, int, float, float]]]:
        """Evidence, and the significant segments with the number of such expected by chance."""
        if len(self.cache) > _CACHE:
            self.cache.clear()
        cache, hits = self.cache, []
        words = words_of(text)
        for i, w in enumerate(words):
            try:
                s = cache[w]
            except KeyError:
                s = cache[w] = self.word(w)
            if s is not None:
                hits.append((i, s))
        if not hits:
            return 0.0, []
        m = self.model
        chance = math.log(m.rate * len(words))
        found = [(a, b, s, chance - m.scale * s) for a, b, s in maximal_segments(hits)]
        found = [f for f in found if f[3] < 0]
        best = total = 0.0
        for r, f in enumerate(sorted(found, key=lambda f: f[3]), 1):
            total -= f[3]
            # P(sum of the r best >= total) is about exp(-total) total^(r-1) / (r! (r-1)!)
            best = max(best, total - (r - 1) * math.log(max(total, 1e-9)) + _log_factorial(r) + _log_factorial(r - 1) - (r - 1) * math.log(2))
        return best, [(a, b, s, math.exp(max(e, -700.0))) for a, b, s, e in found]

    def probability(self, evidence: float) -> float:
        z = self.model.intercept + self.model.slope * evidence
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(text, toxic, weight) of the labelled rows fitted on; ids are at most 2 x SAMPLE and so may be broadcast."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where("toxic in (0, 1)").withColumn("order", F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("toxicity")), 12))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    span = float(1 << 52)
    limit = F.lit(-1.0)
    weight = F.lit(1.0)
    for toxic, n in counts.items():
        part = min(1.0, SAMPLE / n)
        limit = F.when(F.col("toxic") == toxic, F.lit(part * span)).otherwise(limit)
        weight = F.when(F.col("toxic") == toxic, F.lit(1 / part)).otherwise(weight)
    chosen = known.where(F.col("order") < limit).select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic"), weight.alias("weight"))
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "_id").select("text", "toxic", "weight")


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: tuple[Counter, Counter, Counter] = (Counter(), Counter(), Counter())
    for batch in batches:
        for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
            words = words_of(text.as_py())
            counts[toxic].update({f for w in set(words) for f in features_of(w)})
            counts[2][f"\0{toxic}"] += len(words)
        if len(counts[0]) + len(counts[1]) > 1_000_000:
            yield _flush(counts)
    yield _flush(counts)


def _flush(counts: tuple[Counter, Counter, Counter]) -> pa.RecordBatch:
    clean, toxic, sizes = counts
    names = [*(clean.keys() | toxic.keys()), *sizes]
    columns = [pa.array(names, pa.string()), pa.array([clean[n] if n[0] != "\0" else sizes[n] for n in names], pa.int64()), pa.array([toxic[n] for n in names], pa.int64())]
    for c in counts:
        c.clear()
    return pa.RecordBatch.from_arrays(columns, ["feature", "clean", "toxic"])


def _contexts(wanted: set[str]):
    """Distinct (feature, class, context) of the candidate features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[str]] = {}
        for batch in batches:
            seen: set[tuple[str, int, str]] = set()
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
                words = ["", *words_of(text.as_py()), ""]
                for i in range(1, len(words) - 1):
                    w = words[i]
                    features = known.get(w)
                    if features is None:
                        features = known[w] = [f for f in features_of(w) if f in wanted]
                    for f in features:
                        seen.add((f, toxic, f"{words[i - 1]} {w} {words[i + 1]}"))
                if len(known) > _CACHE:
                    known.clear()
            rows = list(seen)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string())], ["feature", "toxic", "context"])

    return run


def _log_odds(counts: dict[str, tuple[int, int]], n_clean: int, n_toxic: int) -> dict[str, float]:
    """Scores of the features that tell; ``counts``: (clean, toxic). The prior is ``PRIOR`` of the joint count, split by class size."""
    out = {}
    for f, (clean, toxic) in counts.items():
        both = (clean + toxic) * PRIOR
        a, b = toxic + both * n_toxic / (n_toxic + n_clean), clean + both * n_clean / (n_toxic + n_clean)
        delta = math.log(a / max(n_toxic - a, 1)) - math.log(b / max(n_clean - b, 1))
        z = delta / math.sqrt(1 / a + 1 / b)
        if abs(z) >= MIN_Z and delta > 0:
            out[f] = (z, delta)
    best = sorted(out, key=lambda f: (-out[f][0], f))[:MAX_FEATURES]
    return {f: out[f][1] for f in best}


def _scale(positive: list[tuple[float, float]]) -> float:
    """The positive root of sum p exp(lambda s) = 1, with the background taking the rest of p."""
    rest = 1 - sum(p for p, _ in positive)

    def excess(x: float) -> float:
        return rest * math.exp(x * BACKGROUND) + sum(p * math.exp(min(x * s, 600)) for p, s in positive) - 1

    low, high = 1e-4, 1.0
    while excess(high) < 0 and high < 64:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return low


def _logistic(rows: list[tuple[float, int, float]]) -> tuple[float, float]:
    """Intercept and slope of weighted logistic regression with a weak pull to 0, by Newton's method."""
    x, y, w = (np.array(c, float) for c in zip(*rows))
    X, beta = np.stack([np.ones_like(x), x], 1), np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(X @ beta, -30, 30)))
        grad = X.T @ (w * (y - p)) - 0.1 * beta
        step = np.linalg.solve((X * (w * p * (1 - p) + 1e-9)[:, None]).T @ X + 0.1 * np.eye(2), grad)
        beta += np.clip(step, -2, 2)
    return float(beta[0]), float(max(beta[1], 0.0))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """``labels``: doc_id and toxic (0, 1) of the rows that may be learned from."""
    sample = cut(_sample(docs, labels, id_col, text_col).select(F.coalesce("text", F.lit("")).alias("text"), "toxic", "weight"))
    parts = sample.select("text", "toxic")
    counted = parts.mapInArrow(trimmed(_document_counts), "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counted = cut(counted.where((F.col("toxic") >= 3) | F.col("feature").startswith("\0")))
    sizes = {r["feature"]: r["clean"] for r in counted.where(F.col("feature").startswith("\0")).collect()}
    n_clean, n_toxic = sizes.get("\x000", 0), sizes.get("\x001", 0)
    if not n_clean or not n_toxic:
        return ToxicityModel()
    rows = parts.groupBy("toxic").count().collect()
    docs_of = {r["toxic"]: r["count"] for r in rows}
    lift = (F.col("toxic") / docs_of.get(1, 1)) / ((F.col("clean") + 0.5) / docs_of.get(0, 1))
    likely = counted.where(~F.col("feature").startswith("\0") & (lift > 3)).orderBy(F.desc(F.col("toxic") * F.log(lift)), "feature").limit(4 * MAX_FEATURES)
    wanted = {r["feature"] for r in likely.select("feature").collect()}
    contexts = parts.mapInArrow(trimmed(_contexts(wanted)), "feature string, toxic int, context string").distinct().groupBy("feature").agg(F.count_if(F.col("toxic") == 0).alias("clean"), F.count_if(F.col("toxic") == 1).alias("toxic"))
    counts = {r["feature"]: (r["clean"], r["toxic"]) for r in contexts.collect()}
    model = ToxicityModel(_log_odds(counts, n_clean, n_toxic))
    if model.scores:
        share = n_clean / (n_toxic + n_clean)
        # a word and its stems tell of the same places: only whole words have mass of their own, stems what words leave
        clean_rate = {f: (counts[f][0] + PRIOR * sum(counts[f]) * share) / n_clean for f in model.scores}
        positive = [(clean_rate[f], s) for f, s in model.scores.items()]
        model.scale = _scale(positive)
        model.rate = sum(p * math.exp(model.scale * s) for p, s in positive)
    scored = sample.select("toxic", "weight", F.round(evidence(model)(F.col("text"))["evidence"], 1).alias("x"))
    binned = scored.groupBy("x", "toxic", "weight").count().collect()
    rows = [(min(r["x"], 200.0), r["toxic"], r["weight"] * r["count"]) for r in binned]
    model.intercept, model.slope = _logistic(rows)
    return model


def evidence(model: ToxicityModel):
    """A column function: struct<score, evidence, passages> of a text column."""

    @F.arrow_udf(f"struct<score:double,evidence:double,passages:{_PASSAGES}>")
    def scored(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(model)
        item = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())])
        for batch in texts:
            found = [scorer.passages(t.as_py()) for t in batch]
            scores = pa.array([scorer.probability(e) for e, _ in found], pa.float64())
            flat = [p for _, ps in found for p in ps]
            offsets = np.concatenate([[0], np.cumsum([len(ps) for _, ps in found])]).astype(np.int32)
            values = pa.StructArray.from_arrays([pa.array([p[i] for p in flat], item[i].type) for i in range(4)], fields=list(item))
            passages = pa.ListArray.from_arrays(pa.array(offsets), values)
            yield pa.StructArray.from_arrays([scores, pa.array([e for e, _ in found], pa.float64()), passages], ["score", "evidence", "passages"])
        del scorer
        give_memory_back()

    return scored


def score_documents(docs: DataFrame, model: ToxicityModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, evidence and passages (word ranges, scores, numbers expected by chance) of every row."""
    return docs.select(F.col(id_col).alias("doc_id"), evidence(model)(F.col(text_col)).alias("t")).select("doc_id", "t.*")


def training_labels(labels: DataFrame) -> DataFrame:
    """The labels that may be learned from: crc32 of the id as text, modulo 4, is not 2."""
    return labels.where(crc_remainder(F.col("doc_id"), 4) != 2)


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3, *, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more. Null and empty texts score as texts without a passage,
    texts of any length are scanned whole, an empty table stays empty, and the columns come back whatever their names."""
    score: Column = evidence(model)(F.col(f"`{text_col}`"))["score"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), score.alias("score"))
    return rows.where(F.col("score") < threshold).select("doc.*")
