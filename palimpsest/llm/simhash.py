"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is the bitwise majority of the XXH64 of a text's word shingles. Two fingerprints that differ
in at most ``distance`` bits, cut into ceil((distance + 1) / 2) segments, agree but for one bit in some segment.
So every distinct fingerprint is indexed under each segment with each one of its bits deleted; an equality join
on these variants (rows of one key meet in one partition) finds all candidates, and the full distance is verified.

Buckets never become pairs. Fingerprints are made distinct first. A bucket of more than ``SPLIT`` of them is keyed
once more by deletion variants of its other bits, which bounds any bucket at 2^18 fingerprints; inside, each
fingerprint looks for the masks of up to ``distance`` bits, or meets its bucket in blocks, whichever is less. A
partition gives a spanning forest of its links, not the links. Components are then joined by rounds of minimum
labels over the distributed forest.

Defined results: null or empty texts have fingerprint 0 and are linked like any other; equal texts share a
component; rows of equal id are kept; a component's id is its smallest doc_id, null only if all its ids are null.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, trimmed

#: Distinct fingerprints in a bucket above which it is split by further deletion variants.
SPLIT = 2048
SEED = 42
#: Of a sixteenth of all texts, how many a common shingle is in; and how many common ones are ordered last at most.
COMMON, MOST_COMMON = 8, 500_000
#: Links that a task of the components' rounds holds.
TASK_LINKS = 200_000
#: Rows of hashes and ids up to which a counted side is broadcast.
BROADCAST_ROWS = 1_000_000


def fingerprint_of(text: str | None, shingle: int) -> int:
    words = (text or "").encode().lower().split()  # bytes: lower-cases A-Z only, splits at ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[: -shingle] + 1])
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist())], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(shingle: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.array([fingerprint_of(t.as_py(), shingle) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks)], ["doc_id", "mark"])

    return run


def fingerprints(docs: DataFrame, shingle: int = 3, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``mark``, the fingerprint as a signed 64-bit integer, of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(trimmed(_fingerprints(shingle)), "doc_id long, mark long")


def _variants(values: np.ndarray, bits: int, shift: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of ``values``: which segment of the ``bits`` from ``shift`` on, which bit is deleted, what is left. (n, keys)"""
    width = -(-bits // segments)
    keys, wild = [], []
    for s in range(segments):
        at, size = s * width, min(width, bits - s * width)
        piece = (values >> np.uint64(shift + at)) & np.uint64((1 << size) - 1)
        for b in range(size):
            keys.append((piece & ~np.uint64(1 << b)) | np.uint64((s << 6 | b) << 40))
            wild.append(1 << (shift + at + b))
    return np.stack(keys, 1), np.array(wild, np.uint64)


def _index(distance: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                marks = batch.slice(at, 4096).column(0).to_numpy(zero_copy_only=False).view(np.uint64)
                keys, _ = _variants(marks, 64, 0, (distance + 2) // 2)
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(marks, keys.shape[1]).view(np.int64))], ["key", "mark"])

    return run


def _split(distance: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Second keys for rows of a large bucket, on the bits outside its segment. Distances of 3 have two halves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                first = part.column(0).to_numpy(zero_copy_only=False)
                marks = part.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
                segments = (distance + 2) // 2
                width = -(-64 // segments)
                segment = (first.view(np.uint64) >> np.uint64(46)).astype(np.int64)
                for s in range(segments):
                    here = np.flatnonzero(segment == s)
                    if not len(here):
                        continue
                    low = np.uint64(s * width)
                    size = min(width, 64 - s * width)
                    rest = (marks[here] & np.uint64((1 << (s * width)) - 1)) | ((marks[here] >> low >> np.uint64(size - 1) >> np.uint64(1)) << low)
                    keys, _ = _variants(rest, 64 - size, 0, segments)
                    n = keys.shape[1]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(first[here], n)), pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(marks[here], n).view(np.int64))], ["key", "key2", "mark"])

    return run


def _root(parent: np.ndarray) -> np.ndarray:
    while True:
        above = parent[parent]
        if np.array_equal(above, parent):
            return parent
        parent = above


def _union(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of ``n`` nodes over links a-b."""
    parent = np.arange(n)
    while len(a):
        ra, rb = parent[a], parent[b]
        open_ = ra != rb
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        parent = _root(parent)
    return parent


def _close(marks: np.ndarray, distance: int) -> np.ndarray:
    """The smallest index linked to each of the sorted distinct ``marks`` of one bucket, over links of the bucket."""
    n = len(marks)
    free = int(np.bitwise_or.reduce(marks ^ marks[0]))
    bits = [1 << i for i in range(64) if free >> i & 1]
    masks = [0]
    for _ in range(distance):
        masks = sorted({m | b for m in masks for b in bits} | set(masks))
        if len(masks) > n:
            break
    parent = np.arange(n)
    if len(masks) <= n:  # look up every mark's neighbours
        for m in masks[1:]:
            other = marks ^ np.uint64(m)
            at = np.minimum(np.searchsorted(marks, other), n - 1)
            hit = np.flatnonzero((marks[at] == other) & (at > np.arange(n)))
            if len(hit) and not np.array_equal(parent[hit], parent[at[hit]]):
                parent = _union(n, np.concatenate([np.arange(n), hit]), np.concatenate([parent, at[hit]]))
        return parent
    for at in range(0, n, 512):
        far = np.bitwise_count(marks[at : at + 512, None] ^ marks[None, at:])
        i, j = np.nonzero(far <= distance)
        i, j = i + at, j + at
        parent = _union(n, np.concatenate([np.arange(n), i[i < j]]), np.concatenate([parent, j[i < j]]))
    return parent


def _forest(distance: int, keys: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows come sorted by key and mark; gives links (mark, smaller mark) that span the components of the task's buckets."""

    def links(key: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1)]))
        sizes = np.diff(np.concatenate([first, [len(marks)]]))
        out = []
        two = first[sizes == 2]
        two = two[np.bitwise_count(marks[two] ^ marks[two + 1]) <= distance]
        out.append((marks[two + 1], marks[two]))
        for a, n in zip(first[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            group = np.sort(marks[a : a + n])
            parent = _close(group, distance)
            moved = np.flatnonzero(parent != np.arange(n))
            out.append((group[moved], group[parent[moved]]))
        return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held = np.empty((0, keys), np.int64), np.empty(0, np.uint64)
        forest = _Forest()
        ended = False
        batches = iter(batches)
        while not ended:
            batch = next(batches, None)
            ended = batch is None
            if batch is not None:
                key = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)], 1)
                held_key = np.concatenate([held_key, key])
                held = np.concatenate([held, batch.column(keys).to_numpy(zero_copy_only=False).view(np.uint64)])
            if not len(held):
                continue
            whole = len(held) if ended else int(np.flatnonzero(np.concatenate([[True], (held_key[1:] != held_key[:-1]).any(1)]))[-1])
            if whole:
                a, b = links(held_key[:whole], held[:whole])
                held_key, held = held_key[whole:], held[whole:]
                new = np.array(forest.new(a.tolist(), b.tolist()), bool)
                if new.any():
                    yield pa.RecordBatch.from_arrays([pa.array(a[new].view(np.int64)), pa.array(b[new].view(np.int64))], ["a", "b"])

    return run


def mark_links(marks: DataFrame, distance: int = 3) -> DataFrame:
    """(a, b): links between distinct ``mark`` values at most ``distance`` bits apart; their components are exact."""
    parts = int(marks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = marks.repartition(parts, "mark").mapInArrow(_index(distance), "key long, mark long")
    counts = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    large = cut(counts.where(F.col("n") > SPLIT).select("key"))
    shared = keyed.repartition("key").sortWithinPartitions("key", "mark") if large.isEmpty() else keyed.join(large, "key", "left_anti").repartition("key").sortWithinPartitions("key", "mark")
    found = shared.mapInArrow(trimmed(_forest(distance, 1)), "a long, b long")
    if not large.isEmpty():
        again = keyed.join(large, "key").select("key", "mark").mapInArrow(_split(distance), "key long, key2 long, mark long")
        again = again.repartition("key", "key2").sortWithinPartitions("key", "key2", "mark")
        found = found.union(again.mapInArrow(trimmed(_forest(distance, 2)), "a long, b long"))
    return found.distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every linked node; ``root`` is the smallest node of its component.

    Alternating large-star and small-star rounds: in each, a node's links are re-hung on the least of its
    neighbours. Rounds grow with the logarithm of the component's size; each is one shuffle of the links, in as many
    tasks as ``TASK_LINKS`` of them make, and eight at least.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    tasks = max(8, -(-edges.count() // TASK_LINKS))
    while True:
        held = edges.coalesce(tasks)
        both = held.union(held.select(F.col("b"), F.col("a"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).coalesce(tasks)
        hung = both.join(least, "u")
        large = hung.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct().coalesce(tasks)
        low = large.groupBy("a").agg(F.min("b").alias("m")).coalesce(tasks)
        down = large.join(low, "a")
        small = down.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        edges = cut(small.coalesce(tasks))
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.toDF("node", "root")
        before = state


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 3, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, mark and component_id of every row. Texts are read once."""
    marked = cut(fingerprints(docs, shingle, id_col=id_col, text_col=text_col))
    return _with_components(marked, distance)


def _with_components(marked: DataFrame, distance: int) -> DataFrame:
    distinct = cut(marked.groupBy("mark").agg(F.min("doc_id").alias("least")))
    roots = components(mark_links(distinct.select("mark"), distance))
    rooted = distinct.join(roots, distinct.mark == roots.node, "left").select("mark", "least", F.coalesce("root", "mark").alias("root"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_mark = rooted.join(names, "root").select("mark", "component_id")
    return marked.join(by_mark, "mark").select("doc_id", "mark", "component_id")


def hex_mark(mark):
    return F.lower(F.lpad(F.hex(mark), 16, "0"))


def _gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``n`` words, from the words' hashes; fewer words are one run, none none."""
    runs = max(1, len(words) - n + 1) if len(words) else 0
    h = np.full(runs, min(n, len(words)), np.uint64)
    for k in range(min(n, len(words))):
        h = (h ^ words[k : k + runs]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(h ^ (h >> np.uint64(32)))


def _text_grams(text: str | None, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of a text's words, and those of its distinct runs of ``n``."""
    digest = xxhash.xxh64_intdigest
    words = np.array([digest(w, SEED) for w in (text or "").encode().lower().split()], np.uint64)
    return words, _gram_hashes(words, n)


def _parities(grams: np.ndarray) -> bytes:
    """A bit for each class of hashes: whether an odd number of ``grams`` is in it. Twice as many classes as hashes at least, 1,024 to 8,192."""
    classes = 1 << min(13, max(10, 1 + int(len(grams) - 1).bit_length() if len(grams) else 0))
    return np.packbits(np.bincount((grams & np.uint64(classes - 1)).astype(np.int64), minlength=classes) & 1, bitorder="little").tobytes()


SKETCH = "node long, mark long, size long, odd binary, first array<long>"


def _sketches(shingle: int, similarity: float, common) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each text: the fingerprint of its distinct word pairs, the size and parities of its set of shingles, and the
    first of them: of two sets so alike, these have one in common.

    Any order of all shingles will do, if it is one for all texts: by hash, those in ``common`` last. Empty sets meet in key 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = common.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                seen: set[int] = set()
                rows = [], [], [], [], []
                for node, text in zip(part.column(0).to_pylist(), part.column(1)):
                    if node in seen:
                        continue
                    seen.add(node)
                    words, grams = _text_grams(text.as_py(), shingle)
                    pairs = _gram_hashes(words, 2)
                    ones = np.unpackbits(pairs.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
                    n = len(grams)
                    ordered = grams
                    if len(late) and n:
                        is_late = late[np.minimum(np.searchsorted(late, grams), len(late) - 1)] == grams
                        ordered = np.concatenate([grams[~is_late], grams[is_late]])
                    first = ordered[: n - math.ceil(similarity * n - 1e-9) + 1] if n else np.zeros(1, np.uint64)
                    mark = np.packbits(ones * 2 > max(len(pairs), 1), bitorder="little").view(np.int64)[0]
                    for column, value in zip(rows, (node, mark, n, _parities(grams), first.view(np.int64))):
                        column.append(value)
                node, mark, size, odd, first = rows
                ends = np.concatenate([[0], np.cumsum([len(f) for f in first])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(first)))
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(mark, pa.int64()), pa.array(size, pa.int64()), pa.array(odd, pa.binary()), lists], ["node", "mark", "size", "odd", "first"])

    return run


def _common(texts: DataFrame, shingle: int) -> np.ndarray:
    """Sorted hashes of common shingles, estimated from a sixteenth of the texts. They only set the order of shingles."""

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(1):
                yield pa.RecordBatch.from_arrays([pa.array(_text_grams(text.as_py(), shingle)[1].view(np.int64))], ["gram"])

    some = texts.where(F.pmod("node", F.lit(16)) == 0).dropDuplicates(["node"])
    counts = some.mapInArrow(trimmed(every), "gram long").groupBy("gram").count()
    often = counts.where(F.col("count") >= COMMON).orderBy(F.desc("count"), "gram").limit(MOST_COMMON).select("gram").toArrow()
    return np.sort(often.column(0).to_numpy().view(np.uint64))


def _whole_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list, np.ndarray, np.ndarray]]:
    """From rows sorted by their first column: blocks of whole keys (longs as a row for each column, the last column if it
    is binary), where each key starts, and its size."""
    held: list[np.ndarray] = []
    held_odd: list[bytes] = []
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            if not batch.num_rows:
                continue
            longs = [c for c in batch.columns if pa.types.is_integer(c.type)]
            new = np.stack([c.to_numpy(zero_copy_only=False) for c in longs])
            held.append(new)
            if len(longs) < batch.num_columns:
                held_odd += batch.column(batch.num_columns - 1).to_pylist()
            if held[0][0, 0] == new[0, -1]:
                continue  # all of one key so far
        if not held:
            return
        rows = np.concatenate(held, 1)
        first = np.flatnonzero(np.concatenate([[True], rows[0, 1:] != rows[0, :-1]]))
        whole = rows.shape[1] if batch is None else int(first[-1])
        held = [rows[:, whole:]] if whole < rows.shape[1] else []
        odd, held_odd = held_odd[:whole], held_odd[whole:]
        first = first[first < whole]
        if len(first):
            yield rows[:, :whole], odd, first, np.diff(np.concatenate([first, [whole]]))


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows (key, node, place) whose key another node has; each node once a key."""
    for rows, _, first, sizes in _whole_keys(batches):
        order = np.lexsort((rows[1], rows[0]))
        rows = rows[:, order]
        rows = rows[:, np.concatenate([[True], (rows[:2, 1:] != rows[:2, :-1]).any(0)])]
        edge = rows[0, 1:] == rows[0, :-1]
        rows = rows[:, np.concatenate([[False], edge]) | np.concatenate([edge, [False]])]
        yield pa.RecordBatch.from_arrays([pa.array(r.copy()) for r in rows], ["key", "node", "place"])


def _live(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows (key, node, place, group) of keys that several groups have."""
    for rows, _, first, sizes in _whole_keys(batches):
        several = np.minimum.reduceat(rows[3], first) != np.maximum.reduceat(rows[3], first)
        rows = rows[:, np.repeat(several, sizes)]
        yield pa.RecordBatch.from_arrays([pa.array(r.copy()) for r in rows], ["key", "node", "place", "group"])


def _fold(odd: np.ndarray, words: int) -> np.ndarray:
    """Parities of fewer classes: those of the two halves, added."""
    while odd.shape[1] > words:
        half = odd.shape[1] // 2
        odd = odd[:, :half] ^ odd[:, half:]
    return odd


class _Likely:
    """Tests pairs of rows, given as places i and j: whether their sets can be so alike, by sizes, places and parities.

    ``expected``: whether they are rather than can be, by as many odd classes as so many differences leave on average.
    """

    def __init__(self, rows: np.ndarray, odd: list[bytes], similarity: float, expected: bool = False):
        self.expected = expected
        self.node, place, self.group = rows[1:4]
        self.pos, self.size = place >> 32, place & 0xFFFFFFFF
        self.similarity = similarity
        self.words = np.array([len(o) for o in odd]) // 8
        self.odd = odd
        self.short = self._matrix(np.arange(len(odd)), 16)

    def _matrix(self, at: np.ndarray, words: int) -> np.ndarray:
        out = np.zeros((len(at), words), np.uint64)
        for w in np.unique(self.words[at]).tolist():
            here = np.flatnonzero(self.words[at] == w)
            raw = np.frombuffer(b"".join([self.odd[k] for k in at[here].tolist()]), np.uint64).reshape(-1, w)
            out[here] = _fold(raw, words)
        return out

    def _limit(self, most: np.ndarray, words: int) -> np.ndarray:
        return 32 * words * (1 - np.exp(-most / (32 * words))) if self.expected else most

    def __call__(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = self.similarity
        m, n = self.size[i], self.size[j]
        least = s / (1 + s) * (m + n)  # that many shingles in common, at least
        ok = (self.group[i] != self.group[j]) & (np.minimum(m, n) >= s * np.maximum(m, n) - 1e-9)
        ok &= np.minimum(m - self.pos[i], n - self.pos[j]) >= least - 1e-6  # the first common key has all others behind it
        i, j, most = i[ok], j[ok], (m + n)[ok] * (1 - s) / (1 + s) + 1e-6
        near = np.bitwise_count(self.short[i] ^ self.short[j]).sum(1, dtype=np.int64) <= self._limit(most, 16)
        i, j, most = i[near], j[near], most[near]
        level = np.minimum(self.words[i], self.words[j])
        for w in np.unique(level[level > 16]).tolist():
            at = np.flatnonzero(level == w)
            ends, back = np.unique(np.concatenate([i[at], j[at]]), return_inverse=True)
            odd = self._matrix(ends, w)
            far = at[np.bitwise_count(odd[back[: len(at)]] ^ odd[back[len(at) :]]).sum(1, dtype=np.int64) > self._limit(most[at], w)]
            keep = np.ones(len(i), bool)
            keep[far] = False
            i, j, most, level = i[keep], j[keep], most[keep], level[keep]
        return i, j


def _pairs(first: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs inside each key, as places, in blocks that are tested and gone before the next."""
    for n in np.unique(sizes[(sizes > 1) & (sizes <= 64)]).tolist():
        i, j = np.triu_indices(n, 1)
        step = max(1, (1 << 18) // len(i))
        starts = first[sizes == n]
        for at in range(0, len(starts), step):
            here = starts[at : at + step, None]
            yield (here + i).ravel(), (here + j).ravel()
    for a, n in zip(first[sizes > 64].tolist(), sizes[sizes > 64].tolist()):
        for at in range(0, n, 256):
            i, j = np.divmod(np.arange(min(256, n - at) * (n - at)), n - at)
            below = i < j
            yield a + at + i[below], a + at + j[below]


class _Forest:
    """Components of what one task has seen: of links, those that joined two."""

    def __init__(self):
        self.above: dict[int, int] = {}

    def root(self, x: int) -> int:
        above = self.above
        while (up := above.get(x, x)) != x:
            above[x] = x = above.get(up, up)
        return x

    def new(self, a: list[int], b: list[int]) -> list[bool]:
        out = []
        for x, y in zip(a, b):
            x, y = self.root(x), self.root(y)
            out.append(x != y)
            if x != y:
                self.above[max(x, y)] = min(x, y)
        return out


def _candidates(similarity: float, all_pairs: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links between groups that sizes, places and parities allow, from rows (key, node, place, group, odd): a forest of
    the task's groups, or all of them, each once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, seen = _Forest(), set()
        for rows, odd, first, sizes in _whole_keys(batches):
            likely = _Likely(rows, odd, similarity, not all_pairs)
            for i, j in _pairs(first, sizes):
                i, j = likely(i, j)
                if not len(i):
                    continue
                if all_pairs:
                    a, b = np.maximum(likely.node[i], likely.node[j]).tolist(), np.minimum(likely.node[i], likely.node[j]).tolist()
                    new = [p for p in dict.fromkeys(zip(a, b)) if p not in seen]
                    if len(seen) > 100_000:
                        seen.clear()  # repeats only cost a little
                    seen.update(new)
                    ab = np.array(new, np.int64).reshape(-1, 2)
                else:
                    keep = np.array(forest.new(likely.group[i].tolist(), likely.group[j].tolist()), bool)
                    ab = np.stack([likely.node[i][keep], likely.node[j][keep]], 1)
                if len(ab):
                    yield pa.RecordBatch.from_arrays([pa.array(ab.max(1)), pa.array(ab.min(1))], ["a", "b"])

    return run


def _similar(similarity: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links whose whole shingle sets are alike; two empty sets are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return run


def _possible(similarity: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links (a, b, parities and sizes) but for those whose sets surely differ by too much: a class that is odd in one
    alone holds a difference."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                a, b, x, y, m, n = batch.slice(at, 4096).columns
                rows = len(a)
                place = np.concatenate([c.to_numpy(zero_copy_only=False) for c in (m, n)])
                both = np.stack([np.zeros(2 * rows, np.int64), np.zeros(2 * rows, np.int64), place, np.arange(2 * rows)])
                i, _ = _Likely(both, x.to_pylist() + y.to_pylist(), similarity)(np.arange(rows), np.arange(rows, 2 * rows))
                yield pa.RecordBatch.from_arrays([a.take(pa.array(i)), b.take(pa.array(i))], ["a", "b"])

    return run


def _grams(shingle: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [_text_grams(t.as_py(), shingle)[1].tobytes() for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], ["node", "grams"])

    return run


def _limited(rows: DataFrame) -> DataFrame:
    """``rows`` as a side to broadcast, if its counted size allows; a shuffle joins it else."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _verified(links: DataFrame, sketches: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The links (a, b) whose sets are alike. Texts move only for those that parities cannot rule out."""
    short = sketches.select("node", "odd", "size")
    met = links.join(short.toDF("a", "xa", "na"), "a").join(short.toDF("b", "xb", "nb"), "b").select("a", "b", "xa", "xb", "na", "nb")
    return _alike(cut(met.mapInArrow(trimmed(_possible(similarity)), "a long, b long")), texts, shingle, similarity)


def _alike(links: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The links (a, b) whose sets are alike, by the whole sets of both texts."""
    ends = cut(links.select("a").union(links.select("b")).distinct().toDF("node"))
    linked = texts.join(_limited(ends), "node", "left_semi").dropDuplicates(["node"]).mapInArrow(trimmed(_grams(shingle)), "node long, grams binary")
    met = links.join(linked.toDF("a", "ga"), "a").join(linked.toDF("b", "gb"), "b").select("a", "b", "ga", "gb")
    return cut(met.mapInArrow(trimmed(_similar(similarity)), "a long, b long"))


def similar_texts(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, distance: int = 7, *, text_col: str = "text") -> DataFrame:
    """(node, root) of every distinct text, by the xxhash64 of it, that is linked to another: the components over all
    pairs of texts whose sets of ``shingle`` words have a Jaccard similarity of at least ``similarity``.

    Candidates are first the spanning forests of fingerprints of word pairs. Then texts meet in the buckets of a prefix
    filter, where those of different components are compared by sizes, places and parities; first a forest of the expected
    links is verified on whole sets, last every possible link still between two components. Texts so alike meet in some
    bucket and pass there, so none is missed. Nulls, empty and blank texts have the empty set and are alike. Texts of
    any length are taken whole.
    """
    texts = docs.select(F.xxhash64(F.col(f"`{text_col}`")).alias("node"), F.col(f"`{text_col}`").alias("text"))
    common = docs.sparkSession.sparkContext.broadcast(_common(texts, shingle))
    sketches = cut(texts.mapInArrow(trimmed(_sketches(shingle, similarity, common)), SKETCH))
    single = cut(sketches.select("node", "mark", "size", "odd").dropDuplicates(["node"]))
    firsts = cut(single.groupBy("mark").agg(F.min("node").alias("first")))
    found = mark_links(firsts.select("mark"), distance)
    a = firsts.select(F.col("mark").alias("a"), F.col("first").alias("na"))
    b = firsts.select(F.col("mark").alias("b"), F.col("first").alias("nb"))
    near = found.join(a, "a").join(b, "b").select("na", "nb").union(single.select("node", "mark").join(firsts, "mark").where("node <> first").select("node", "first"))
    tried = cut(near.select(F.greatest("na", "nb").alias("a"), F.least("na", "nb").alias("b")).distinct())
    links = _verified(tried, single, texts, shingle, similarity)
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root")).where("false")

    keyed = sketches.select("node", "size", F.posexplode("first").alias("pos", "key")).select("key", "node", (F.shiftleft(F.col("pos").cast("long"), 32) + F.col("size")).alias("place"))
    shared = cut(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(trimmed(_shared), "key long, node long, place long"))
    for all_pairs in (False, True):
        grouped = shared.join(roots, "node", "left").select("key", "node", "place", F.coalesce("root", "node").alias("group"))
        shared = cut(grouped.repartition("key").sortWithinPartitions("key").mapInArrow(trimmed(_live), "key long, node long, place long, group long"))
        rows = shared.join(single.select("node", "odd"), "node").select("key", "node", "place", "group", "odd")
        likely = rows.repartition("key").sortWithinPartitions("key").mapInArrow(trimmed(_candidates(similarity, all_pairs)), "a long, b long")
        new = cut(likely.distinct().join(tried, ["a", "b"], "left_anti"))
        shared = shared.drop("group")
        some = not new.isEmpty()
        if some:
            links, tried = links.union(_alike(new, texts, shingle, similarity)), tried.union(new)
        if some or not all_pairs:
            roots = components(links)
    return roots


def similar_documents(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, distance: int = 7, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, component (a text hash) and component_id (its least doc_id, null if all are) of every row.

    Null and repeated ids are kept apart by text; null, empty and blank texts are one component; an empty table gives none.
    """
    roots = similar_texts(docs, shingle, similarity, distance, text_col=text_col).toDF("text_hash", "root")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(F.col(f"`{text_col}`")).alias("text_hash"))
    texts = rows.groupBy("text_hash").agg(F.min("doc_id").alias("least")).join(roots, "text_hash", "left")
    texts = texts.select("text_hash", "least", F.coalesce("root", "text_hash").alias("component"))
    names = texts.groupBy("component").agg(F.min("least").alias("component_id"))
    named = texts.join(names, "component").select("text_hash", "component", "component_id")
    return rows.join(named, "text_hash").select("doc_id", "text_hash", "component", "component_id")


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of similar documents: that of the smallest id, null ids last, and then of the least text hash.

    Documents are texts: rows of a null or a repeated id whose texts differ stay apart. Null, empty and blank texts are
    one group. The columns come back as they were, whatever their names; an empty table stays empty.
    """
    roots = similar_texts(docs, shingle, similarity, text_col=text_col).toDF("hash", "root")
    keys = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("hash"))
    counts = cut(keys.groupBy("hash", "id").agg(F.count("*").alias("n")).join(roots, "hash", "left").withColumn("root", F.coalesce("root", "hash")))
    best = counts.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "hash")).alias("best")).select(F.col("best.hash").alias("best_hash"), F.col("best.id").alias("best_id"), F.lit(True).alias("kept"))
    # the kept rows are met by their own hashes: a join by root would bring a large group into one task
    ranked = counts.join(best, (F.col("hash") == F.col("best_hash")) & F.col("id").eqNullSafe(F.col("best_id")), "left").withColumn("kept", F.coalesce("kept", F.lit(False)))
    gone = cut(ranked.where("not kept or n > 1").select("hash", "id", "kept"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(f"`{id_col}`").cast("long").alias("row_id"), F.xxhash64(F.col(f"`{text_col}`")).alias("row_hash"))
    met = (F.col("row_hash") == F.col("hash")) & F.col("row_id").eqNullSafe(F.col("id"))
    found = rows.join(_limited(gone), met, "left_anti")
    repeated = gone.where("kept").select("hash", "id")
    if not repeated.isEmpty():
        found = found.unionByName(rows.join(_limited(repeated), met, "left_semi").dropDuplicates(["row_hash"]))
    return found.select("doc.*")
