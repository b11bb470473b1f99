"""Quality of documents by kernel ridge regression on document statistics.

Statistics of a text (lengths, letter classes, repetition inside windows of words and of lines, decorated and
capital words, compressibility) are standardised, and random Fourier features of them approximate a Gaussian kernel:
with frequencies drawn from a normal law of the kernel's width, inner products of the cosines are the kernel in
expectation. Ridge weights solve the normal equations, whose sums are taken by task and added up in two rounds, a
fold of the rows apart, so that every row can be scored by weights that have not seen it. Those scores choose the
ridge, and their isotonic regression on the labels (pool adjacent violators over ``BINS`` counted bins) carries any
score to a probability.

Texts are read once; labels meet statistics and not texts. All labelled rows are used. The driver gets sums of
fixed size: moments, ``FOLDS`` matrices of ``FEATURES`` + 1 rows, ``BINS`` counts.

Defined results: null and empty texts have statistics of 0 and are scored like any other; null labels, and labels
other than 0 and 1, are not used; repeated labels of an id count once, by the least; rows of equal id are scored
each; without labels of both kinds every score is the labels' mean, 0.5 without any; an empty table gives no rows;
texts of any length are read whole, in windows; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_remainder, cut

FEATURES, FOLDS, BINS, SEED = 512, 4, 4096, 7
RIDGES = (1e-4, 1e-3, 1e-2, 1e-1, 1.0)
#: Width of the kernel over the root of the number of statistics.
WIDTH = 1.0
#: Words of a window of repetition, and characters of a piece that is compressed (16 of them are split into words at a time).
WINDOW, PIECE = 500, 1 << 16
#: Tasks that add up partial sums before the last one does.
ADDERS = 32
_LINE = re.compile(r"[^\n]+")
_CORE = re.compile(r"[^\W_]+")
_DIGIT = re.compile(r"\d")
_PLAIN = re.compile(r"^[\"'(«¿¡]*[^\W\d_]+(?:['’-][^\W\d_]+)*[.,;:!?\"')»]*$")
NAMES = (
    "characters", "words", "lines", "word_length", "word_spread", "longest_word", "letters", "capitals", "digits",
    "spaces", "marks", "beyond_ascii", "kinds_of_marks", "entropy", "bytes_compressed", "capital_words", "title_words", "plain_words",
    "digit_words", "mark_words", "short_words", "long_words", "distinct_words", "top_word", "distinct_pairs", "distinct_triples",
    "words_doubled", "line_length", "short_lines", "distinct_lines", "ended_lines", "sentence_length", "vowels",
)
_VOWELS = frozenset("aeiouyáéíóúàèìòùâêîôûäëïöüãõæøåœ")


class _Table:
    """Numbered values with a row of ``width`` properties each, computed once while held."""

    def __init__(self, properties: Callable[[str], tuple], width: int, most: int):
        self.properties, self.width, self.most = properties, width, most
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.matrix = np.empty((1024, self.width))

    def numbers(self, values: list[str]) -> np.ndarray:
        if len(self.number) > self.most:
            self.clear()
        number, properties, new = self.number, self.properties, []
        first = len(number)
        for value in set(values):
            if value not in number:
                number[value] = len(number)
                new.append(properties(value))
        if new:
            if len(number) > len(self.matrix):
                self.matrix = np.concatenate([self.matrix[:first], np.empty((max(first, len(new)) + 1024, self.width))])
            self.matrix[first : len(number)] = new
        return np.fromiter(map(number.__getitem__, values), np.int64, len(values))


def _letter(c: str) -> tuple:
    """Letter, capital, digit, space, mark, beyond ASCII, vowel, end of a sentence."""
    return c.isalpha(), c.isupper(), c.isdigit(), c.isspace(), not (c.isalnum() or c.isspace()), c > "\x7f", c.lower() in _VOWELS, c in ".!?"


def _word(w: str) -> tuple:
    """Length, its square, capital, title, plain, digit and mark words, short and long ones; a hash of the lower-cased word."""
    size, low = len(w), w.lower()
    code = zlib.crc32(low.encode())
    if w.isalpha():
        return size, size * size, w.isupper() and size > 1, w.istitle(), _PLAIN.match(w) is not None, False, False, size <= 2, size > 14, code
    core = _CORE.search(w)
    marked = core is None or len(core[0]) < size - 2
    return size, size * size, w.isupper() and size > 1, w.istitle(), _PLAIN.match(w) is not None, _DIGIT.search(w) is not None, marked, size <= 2, size > 14, code


class Statistics:
    """The values of ``NAMES`` of one text after the other; words and letters are looked at once while they are held."""

    def __init__(self):
        self.letters, self.words = _Table(_letter, 8, 20_000), _Table(_word, 10, 200_000)

    def __call__(self, text: str | None) -> list[float]:
        text = text or ""
        n = len(text)
        if not n:
            return [0.0] * len(NAMES)
        letters = Counter(text)
        at, counts = self.letters.numbers(list(letters)), np.fromiter(letters.values(), float, len(letters))
        alpha, upper, digit, space, marks, beyond, vowels, ended = counts @ self.letters.matrix[at]
        kinds = self.letters.matrix[at, 4].sum()
        entropy = -float((counts / n) @ np.log2(counts / n))
        packed = sum(len(zlib.compress(text[a : a + PIECE].encode(), 1)) for a in range(0, n, PIECE)) / len(text.encode())
        sums, words, longest, windows = np.zeros(9), 0, 0.0, []
        for piece in _pieces(text):
            found = piece.split()
            if not found:
                continue
            at = self.words.numbers(found)
            rows = self.words.matrix[at]
            sums += rows[:, :9].sum(0)
            words += len(found)
            longest = max(longest, rows[:, 0].max())
            lower = rows[:, 9].astype(np.uint64)
            for a in range(0, len(lower), WINDOW):
                windows.append(_window(lower[a : a + WINDOW]))
        if not words:
            return [math.log1p(n), *[0.0] * (len(NAMES) - 1)]
        total, squares, capital, title, plain, digits, marked, short, long_ = sums.tolist()
        distinct, top, pairs, triples, doubled = np.sum(windows, 0).tolist()
        lines = line_total = line_short = line_ended = 0
        seen: set[int] = set()
        for found in _LINE.finditer(text):
            line = found[0].strip()
            if line:
                lines += 1
                line_total += len(line)
                line_short += len(line) < 30
                line_ended += line[-1] in ".!?"
                seen.add(hash(line))
        lines = max(lines, 1)
        mean, per = total / words, max(alpha, 1)
        return [
            math.log1p(n), math.log1p(words), math.log1p(lines), mean, math.sqrt(max(squares / words - mean * mean, 0.0)), math.log1p(longest), alpha / n, upper / per, digit / n,
            space / n, marks / n, beyond / n, math.log1p(kinds), entropy, packed, capital / words, title / words, plain / words,
            digits / words, marked / words, short / words, long_ / words, distinct / words, top / words, pairs / words, triples / words,
            doubled / words, math.log1p(line_total / lines), line_short / lines, len(seen) / lines, line_ended / lines, math.log1p(words / (ended + 1)), vowels / per,
        ]


def _pieces(text: str, size: int = 16 * PIECE) -> Iterator[str]:
    """``text`` in pieces of about ``size`` characters, cut at white space, so that few words are held at a time."""
    at = 0
    while at < len(text):
        end = at + size
        if end < len(text):
            found = re.compile(r"\s").search(text, end)
            end = found.start() if found else len(text)
        yield text[at:end]
        at = end


def _window(words: np.ndarray) -> tuple[int, int, int, int, int]:
    """Distinct words, times of the commonest one, distinct pairs and triples, words that follow themselves."""
    _, times = np.unique(words, return_counts=True)
    pairs = words[1:] * np.uint64(0x9E3779B97F4A7C15) + words[:-1]
    triples = pairs[1:] * np.uint64(0x9E3779B97F4A7C15) + words[:-2]
    count = lambda x: len(np.unique(x)) if len(x) else 1
    return len(times), int(times.max()), count(pairs), count(triples), int((words[1:] == words[:-1]).sum())


def statistics_of(text: str | None) -> list[float]:
    return Statistics()(text)


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    of = Statistics()
    for batch in batches:
        values = [of(t.as_py()) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.list_(pa.float64()))], ["doc_id", "stats"])


def document_statistics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``stats``, the values of ``NAMES``, of every row."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(_statistics, f"doc_id {docs.schema[id_col].dataType.simpleString()}, stats array<double>")


@dataclass
class QualityModel:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray | None = None
    grid: np.ndarray | None = None
    levels: np.ndarray | None = None
    base: float = 0.5

    def __post_init__(self):
        random = np.random.default_rng(SEED)
        d = len(NAMES)
        self.frequencies = random.normal(0, 1 / (WIDTH * math.sqrt(d)), (d, FEATURES))
        self.phases = random.uniform(0, 2 * math.pi, FEATURES)

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.spread, -6, 6)
        return np.hstack([np.cos(x @ self.frequencies + self.phases) * math.sqrt(2 / FEATURES), np.ones((len(x), 1))])

    def probability(self, raw: np.ndarray) -> np.ndarray:
        """The isotonic level, and in flat parts a thousandth by the raw score, so that ranks stay."""
        level = np.interp(raw, self.grid, self.levels)
        return np.clip(0.999 * level + 0.001 * np.clip(raw, 0, 1), 0, 1)

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(stats), self.base)
        return self.probability(self.features(stats) @ self.weights)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.values.to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.empty((0, len(NAMES)))


def _sums(model: QualityModel) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of the rows (stats, good, fold) of a task: each fold's normal equations, targets in the last column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            z = model.features(_matrix(batch.column(0)))
            z = np.hstack([z, batch.column(1).to_numpy(zero_copy_only=False).astype(float)[:, None]])
            fold = batch.column(2).to_numpy(zero_copy_only=False)
            for k in np.unique(fold).tolist():
                part = z[fold == k]
                sums[k] = sums.get(k, 0) + part.T @ part
        yield _sum_rows(sums)

    return run


def _sum_rows(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["fold", "sums"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, part in zip(batch.column(0).to_pylist(), batch.column(1)):
            sums[k] = sums.get(k, 0) + np.frombuffer(part.as_buffer())
    yield _sum_rows(sums)


def isotonic(counts: np.ndarray, means: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence nearest to ``means`` by squares weighted with ``counts``: pooled neighbours."""
    pooled: list[list[float]] = []  # weight, mean, length
    for c, m in zip(counts.tolist(), means.tolist()):
        pooled.append([c, m, 1])
        while len(pooled) > 1 and pooled[-2][1] >= pooled[-1][1]:
            c2, m2, n2 = pooled.pop()
            c1, m1, n1 = pooled[-1]
            pooled[-1] = [c1 + c2, (c1 * m1 + c2 * m2) / (c1 + c2), n1 + n2]
    return np.repeat([p[1] for p in pooled], [int(p[2]) for p in pooled])


def _solve(sums: np.ndarray, ridge: float) -> np.ndarray:
    gram, target = sums[:-1, :-1], sums[:-1, -1]
    pull = np.full(len(gram), ridge * gram[-1, -1] / len(gram) + 1e-9)
    pull[-1] = 1e-9  # the constant is free
    return np.linalg.solve(gram + np.diag(pull), target)


def fit(stats: DataFrame, labels: DataFrame) -> QualityModel:
    """``stats``: of ``document_statistics``; ``labels``: doc_id and quality (0, 1) of the rows that may be learned from."""
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("good"))
    fold = F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(FOLDS)).cast("int")
    rows = cut(stats.join(known, "doc_id").select("stats", "good", fold.alias("fold")))
    d = len(NAMES)
    moments = rows.agg(*[f(F.col("stats")[i]) for i in range(d) for f in (F.avg, F.stddev_pop)], F.avg("good"), F.count("*")).first()
    rate, n = moments[2 * d], moments[2 * d + 1]
    if not n:
        return QualityModel(np.zeros(d), np.ones(d))
    model = QualityModel(np.array(moments[0 : 2 * d : 2], float), np.maximum(np.array(moments[1 : 2 * d : 2], float), 1e-6), base=rate)
    if rate in (0, 1):
        return model
    schema = "fold int, sums binary"
    parts = rows.mapInArrow(_sums(model), schema).withColumn("adder", F.pmod(F.spark_partition_id(), F.lit(ADDERS)))
    added = parts.repartition(ADDERS, "adder").select("fold", "sums").mapInArrow(_added, schema)
    sums = np.zeros((FOLDS, FEATURES + 2, FEATURES + 2))
    for r in added.toLocalIterator():  # FOLDS x ADDERS matrices at most
        sums[r["fold"]] += np.frombuffer(r["sums"]).reshape(FEATURES + 2, -1)
    whole = sums.sum(0)

    errors = []
    for ridge in RIDGES:
        off = 0.0
        for own in sums:
            w = np.append(_solve(whole - own, ridge), -1.0)
            off += w @ own @ w  # squared errors of the fold's rows
        errors.append(off)
    ridge = RIDGES[int(np.argmin(errors))]
    folded = np.stack([_solve(whole - own, ridge) for own in sums])

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, good = np.zeros(BINS), np.zeros(BINS)
        for batch in batches:
            z = model.features(_matrix(batch.column(0)))
            raw = (z * folded[batch.column(2).to_numpy(zero_copy_only=False)]).sum(1)
            at = np.clip(((raw + 1) / 3 * BINS).astype(int), 0, BINS - 1)  # raw scores of 0 and 1 lie well inside -1 to 2
            counts += np.bincount(at, minlength=BINS)
            good += np.bincount(at, weights=batch.column(1).to_numpy(zero_copy_only=False), minlength=BINS)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some]), pa.array(good[some])], ["bin", "n", "good"])

    bins = rows.mapInArrow(binned, "bin long, n double, good double").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).orderBy("bin").collect()
    counts = np.array([b["n"] for b in bins])
    means = np.array([b["good"] for b in bins]) / counts
    model.weights = _solve(whole, ridge)
    model.grid = (np.array([b["bin"] for b in bins]) + 0.5) / BINS * 3 - 1
    model.levels = isotonic(counts, means)
    return model


def score_statistics(stats: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id and score of every row of ``stats``."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(_matrix(batch.column(1))))], ["doc_id", "score"])

    return stats.mapInArrow(scored, f"doc_id {stats.schema['doc_id'].dataType.simpleString()}, score double")


def training_labels(labels: DataFrame) -> DataFrame:
    """The labels that may be learned from: crc32 of the id as text, modulo 3, is not 1."""
    return labels.where(crc_remainder(F.col("doc_id"), 3) != 1)


def score_documents(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of every row, by a model of ``labels``; texts are read once, for their statistics."""
    stats = cut(document_statistics(docs, id_col=id_col, text_col=text_col))
    return score_statistics(stats, fit(stats, labels))
