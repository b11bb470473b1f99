"""Spelling variants grouped under their commonest form, by a rare-first q-gram prefix filter.

Words are counted where they stand, so only distinct words move. The bigrams of all distinct words, at most
``ALPHABET`` squared of them, are ordered by how many words they are in, rarest first. Two words that differ by one
code point lose at most two bigrams each, and what both keep is in the same order in both: by rarity, then by place.
So of the three rarest bigrams of each, one is kept by both, at the same place from the start or from the end. All
before it is equal in the first case but for an edit behind it, all from it on in the second. A word is therefore
sent to six buckets: each of its three rarest bigrams, with all that stands before it, or with all that stands
behind it. Inside a bucket what is left of each word meets by equality: with one code point taken out, or with one
place left open; both are verified edits, so a bucket costs time by its letters and not by its pairs.

Buckets of more than ``SPLIT`` words are keyed once more: of the rest, by its length, half of it is equal.

Near words of a word are bounded by the alphabet (deletions, and ``ALPHABET`` replacements or insertions a place),
whatever the number of words.

Defined results: null and empty texts have no words; a null id counts as the empty text in the edit rule; repeated
rows count again; an empty table gives no rows; texts of any length are read whole; columns besides id and text are
not looked at, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Letters of a word: a to z and U+00C0 to U+00FF.
ALPHABET = 26 + 64
LETTERS = "a-zÀ-ÿ"
#: Words in a bucket above which it is keyed once more.
SPLIT = 50_000
#: Distinct words that a task counts before it hands its counts on.
HELD = 300_000


def _edited(word: str, prefix: int, edits: int) -> str:
    h = zlib.crc32(word.encode(), prefix)
    if h % edits:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def _counts(least: int, edits: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Word counts of a task. A run shorter than ``least`` cannot become a word, as edits only take letters away."""
    runs = re.compile(f"[{LETTERS}]{{{least},}}")

    def flush(total: Counter) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
        total.clear()
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = Counter(runs.findall((text.as_py() or "").encode().lower().decode()))  # bytes: A-Z only
                if edits is None:
                    total.update(own)
                else:
                    prefix = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                    for word, n in own.items():
                        word = _edited(word, prefix, edits)
                        if len(word) >= least:
                            total[word] += n
                if len(total) > HELD:
                    yield flush(total)
        yield flush(total)

    return run


def word_counts(docs: DataFrame, least_length: int = 7, least_count: int = 2, edits: int | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of all words of at least so many letters and occurrences.

    ``edits``: where this divides the crc32 of ``<id>:<word>``, a letter of the word is taken out first.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").alias("text"))
    counted = rows.mapInArrow(_counts(least_length, edits), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def bigram_order(words: DataFrame) -> dict[str, int]:
    """The place of each bigram, rarest first. Bounded by the alphabet: 8,100 bigrams at most."""
    grams = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.char_length("word") - 1), lambda i: F.substring("word", i, F.lit(2)))).alias("gram"))
    counts = {r["gram"]: r["n"] for r in grams.groupBy("gram").agg(F.count("*").alias("n")).collect()}
    return {g: i for i, g in enumerate(sorted(counts, key=lambda g: (counts[g], g)))}


def _buckets(order: dict[str, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (bucket, cut, word, n): a bucket's name is the part that its words have in common, which is ``word[:cut]``
    where the rest is behind it, and ``word[cut:]`` (cut <= 0) where it is before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, cuts, words, ns = [], [], [], []
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                last = len(word) - 1
                for at in sorted(range(last), key=lambda p: (order[word[p : p + 2]], p))[:3]:
                    names += ["<" + word[: at + 2], ">" + word[at:]]
                    cuts += [at + 2, at - len(word)]
                    words += [word, word]
                    ns += [n, n]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(cuts, pa.int32()), pa.array(words, pa.string()), pa.array(ns, pa.int64())], ["bucket", "cut", "word", "n"])

    return run


def _halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of large buckets, keyed by half of the rest as well: of words with rests of k letters, or of k and k + 1,
    that differ by one edit, the first k // 2 letters or the last k - k // 2 are equal."""
    for batch in batches:
        rows: list[tuple[str, int, str, int]] = []
        for name, at, word, n in zip(*(c.to_pylist() for c in batch.columns)):
            rest = _rest(word, at)
            for k in (len(rest), len(rest) - 1):
                if k >= 0:
                    half = k // 2
                    rows.append((f"{name}|{k}^{rest[:half]}", at, word, n))
                    rows.append((f"{name}|{k}${rest[len(rest) - (k - half) :]}", at, word, n))
        columns = list(zip(*rows)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.int64())], ["bucket", "cut", "word", "n"])


def _rest(word: str, at: int) -> str:
    return word[at:] if at > 0 else word[: len(word) + at]


def near_rests(rests: list[str]) -> Iterator[tuple[int, int]]:
    """Places of all pairs of distinct ``rests`` that differ by exactly one edit."""
    whole = {r: i for i, r in enumerate(rests)}
    open_at: dict[tuple[int, str], list[int]] = {}
    for i, rest in enumerate(rests):
        before = None
        for j, letter in enumerate(rest):
            without = rest[:j] + rest[j + 1 :]
            if letter != before:  # taking any letter of a run of equal ones gives the same word
                other = whole.get(without)
                if other is not None:
                    yield other, i
            before = letter
            met = open_at.setdefault((j, without), [])
            for other in met:
                yield other, i
            met.append(i)


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by bucket: both directions of all pairs of near words of a bucket."""
    name, words, rests, counts = None, [], [], []
    out: list[tuple[str, str, int]] = []

    def close() -> None:
        if len(words) > 1:
            for i, j in near_rests(rests):
                out.append((words[i], words[j], counts[j]))
                out.append((words[j], words[i], counts[i]))

    def flush() -> pa.RecordBatch:
        a, b, n = list(zip(*out)) or ([], [], [])
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(n, pa.int64())], ["word", "near", "near_n"])

    for batch in batches:
        for bucket, at, word, n in zip(*(c.to_pylist() for c in batch.columns)):
            if bucket != name:
                close()
                name, words, rests, counts = bucket, [], [], []
                if len(out) > 50_000:
                    yield flush()
            words.append(word)
            rests.append(_rest(word, at))
            counts.append(n)
    close()
    yield flush()


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n), both ways, of all words that differ by one edit; a pair may come more than once."""
    order = bigram_order(words)
    schema = "bucket string, cut int, word string, n long"
    keyed = cut(words.select("word", "n").mapInArrow(_buckets(order), schema))
    counts = keyed.groupBy("bucket").agg(F.count("*").alias("rows"))
    large = cut(counts.where(F.col("rows") > SPLIT).select("bucket"))
    split = not large.isEmpty()
    small = keyed.join(large, "bucket", "left_anti") if split else keyed
    small = small.select("bucket", "cut", "word", "n")
    if split:
        small = small.union(keyed.join(large, "bucket", "left_semi").select("bucket", "cut", "word", "n").mapInArrow(_halves, schema))
    return small.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_near, "word string, near string, near_n long")


def roots_of(forms: DataFrame) -> DataFrame:
    """(word, root): the end of each chain of (word, form). Chains double a round, so rounds are their logarithm."""
    roots = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        above = roots.select(F.col("word").alias("root"), F.col("root").alias("above"))
        met = roots.join(above, "root", "left")
        moved = cut(met.select("word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("open")))
        roots = moved.select("word", "root")
        if moved.where("open").isEmpty():
            return roots


def group_spellings(docs: DataFrame, least_length: int = 7, least_count: int = 2, ratio: int = 10, edits: int | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n, n_near, form, form_n and root of every word.

    A word's form is its commonest near word (ties: the least in code-point order), if that is at least ``ratio``
    times as common; its root is the last form of the chain, the word itself if there is none.
    """
    words = cut(word_counts(docs, least_length, least_count, edits, id_col=id_col, text_col=text_col))
    best = near_words(words).groupBy("word").agg(F.count_distinct("near").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    strong = -F.col("best.less") >= ratio * F.col("n")
    found = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(strong, F.col("best.near")).alias("form"), F.when(strong, -F.col("best.less")).alias("form_n"),
    )
    found = cut(found)
    roots = roots_of(found.where("form is not null"))
    return found.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
