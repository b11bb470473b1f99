"""Exact substring dedup with suffix arrays: every byte covered by a ``length``-byte string that also starts earlier.

1. Copies. Of rows with equal texts (by SHA-256) only the earliest goes on; the others are covered whole.
2. Routing. A string of ``length`` bytes is routed by the least hash of its ``GRAM``-byte grams, which depends on
   the string alone; strings that start next to each other mostly share it, so a document falls into runs of about
   35 starts. Runs are counted by hash, and only those whose hash occurs again go on, as segments: the bytes that
   the strings of a run cover. Equal strings are always in segments of equal hash.
3. Shards. The segments of a hash meet in one partition, in shards of ``SHARD_BYTES`` and whole hashes, sorted by
   their bytes. Equal segments of a hash are neighbours there: all but the earliest are covered whole. What can still
   hold equal strings is sorted into a suffix array (Larsson-Sadakane: ranks of 8-byte prefixes, then doubling inside
   unsorted groups), as deep as ``length`` asks for; of the suffixes that share ``length`` bytes all but the earliest
   are marked.
4. Merging. A hash with more than ``PIECE`` runs is cut into pieces by document, so no key fills a task. What is
   first in its piece goes on as a string; equal strings of all pieces meet, sorted, and all but the earliest are
   marked. The marks of the shards take the same exchange, so that shards are made once.
5. Marked ranges are gathered by document and merged; bytes outside them are kept.

Order: doc_id, null ids first, then start. Defined results: a null text has no bytes; rows that agree in id and
text are one document and get equal results; rows that agree in id alone are ordered by a hash of the text; texts
under ``length`` bytes lose nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LENGTH, GRAM = 100, 32
#: Text of one suffix array.
SHARD_BYTES = 2 << 20
#: Runs of one hash above which it is cut into pieces.
PIECE = 32_768
#: Bytes hashed or compared at once, whose hashes stay in a core's cache; strings handed over at once.
_BATCH_BYTES = 1 << 17
_BATCH_STRINGS = 1 << 16

_random = np.random.default_rng(20_240_607)
_LETTERS = _random.integers(1, 1 << 63, 256).astype(np.uint64)
_FACTORS = (_random.integers(1, 1 << 62, 64).astype(np.uint64) << np.uint64(1)) | np.uint64(1)

_NULL_ID = -(1 << 63)


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes (a power of two) from each place on."""
    h, size, step = _LETTERS[data], 1, 0
    while size < gram:
        h = h[:-size] * _FACTORS[step] + h[size:]
        size, step = size * 2, step + 1
    h ^= h >> np.uint64(29)
    h *= _FACTORS[step]
    h ^= h >> np.uint64(32)
    return h


def _sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    rest = width - size
    return np.minimum(h[: len(h) - rest], h[rest:]) if rest else h


def runs(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts laid end to end: hash, text number, first start in the text, number of starts, of every run, and
    whether its gram may stand in it twice, so that it may hold equal strings by itself."""
    none = np.empty(0, np.int64)
    if len(data) < length:
        return np.empty(0, np.uint64), none, none, none, none
    hashes, width = gram_hashes(data, gram), length - gram + 1
    least = _sliding_min(hashes, width)  # one for each start of `length` bytes
    starts = np.concatenate([[0], ends[:-1]])
    text = np.repeat(np.arange(len(ends)), ends - starts)[: len(least)]
    inside = np.arange(len(least)) + length <= ends[text]
    fresh = np.concatenate([[True], (least[1:] != least[:-1]) | (text[1:] != text[:-1])])
    fresh &= inside
    at = np.flatnonzero(fresh)
    stop = np.flatnonzero(inside & np.concatenate([~inside[1:] | fresh[1:], [True]])) + 1
    return least[at], text[at], at - starts[text[at]], stop - at, _twice(hashes, least, width, at)


def _twice(hashes: np.ndarray, least: np.ndarray, width: int, at: np.ndarray) -> np.ndarray:
    """Whether a run meets a string that has its least gram twice, or next to one that has it.

    Grams ``width`` apart are in no string together, but all strings between have one of them: one run, which is marked.
    """
    # A gram is the least of some string if it is the greatest of the least grams around it.
    edge = np.zeros(width - 1, np.uint64)
    around = ~_sliding_min(~np.concatenate([edge, least, edge]), width)
    chosen = np.flatnonzero(around == hashes[: len(around)])
    pair = np.flatnonzero((hashes[chosen[1:]] == hashes[chosen[:-1]]) & (np.diff(chosen) <= width))
    if not len(pair) or not len(at):
        return np.zeros(len(at), bool)
    cover = np.zeros(len(least) + 1, np.int64)
    low, high = chosen[pair], chosen[pair + 1] - width + 1
    np.add.at(cover, np.minimum(np.maximum(np.minimum(low, high), 0), len(least)), 1)
    np.add.at(cover, np.minimum(np.maximum(low, high) + 1, len(least)), -1)
    return np.maximum.reduceat((np.cumsum(cover[:-1]) > 0).astype(np.int8), at) > 0


def _laid(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Texts or byte strings end to end: their edges and the bytes; null is empty."""
    column = column.cast(pa.binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.zeros(1, np.int64), np.empty(0, np.uint8)
    edges, data = column.buffers()[1:]
    edges = np.frombuffer(edges, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return edges, np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)


def _places(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of byte strings, each by its begin and size, all places one after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - size), size)


def _binary(data: np.ndarray, size: np.ndarray) -> pa.Array:
    edges = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))])


def _stretches(edges: np.ndarray) -> Iterator[tuple[int, int]]:
    """Neighbouring texts of about ``_BATCH_BYTES``."""
    at = 0
    while at < len(edges) - 1:
        to = max(at + 1, int(np.searchsorted(edges, edges[at] + _BATCH_BYTES, "right")) - 1)
        yield at, to
        at = to


def _all_runs(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, salts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            edges, data = _laid(batch.column(2))
            for at, to in _stretches(edges):
                h, text, _, _, twice = runs(data[edges[at] : edges[to]], edges[at + 1 : to + 1] - edges[at], length)
                text = text + at
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ids[text]), pa.array(salts[text]), pa.array(twice.astype(np.int32) + np.int32(1))], ["h", "id", "salt", "n"])

    return run


_RUN = "h long, id long, salt long, n int"


def _segments(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From (id, salt, text, hashes of the text that go on) to segments. Runs are found again: cheaper than moving them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, salts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            edges, data = _laid(batch.column(2))
            lists = batch.column(3)
            offsets, parts = lists.offsets.to_numpy().astype(np.int64), lists.values
            wanted, pieces = parts.field(0).to_numpy(zero_copy_only=False), parts.field(1).to_numpy(zero_copy_only=False)
            for at, to in _stretches(edges):
                h, text, start, n, twice = runs(data[edges[at] : edges[to]], edges[at + 1 : to + 1] - edges[at], length)
                h, asked = h.view(np.int64), slice(offsets[at], offsets[to])
                names, code = np.unique(np.concatenate([h, wanted[asked]]), return_inverse=True)
                key = np.repeat(np.arange(to - at), np.diff(offsets[at : to + 1])) * len(names) + code[len(h) :]
                if not len(key):
                    continue
                by = np.argsort(key)
                key, mine = key[by], text * len(names) + code[: len(h)]
                place = np.minimum(np.searchsorted(key, mine), len(key) - 1)
                hit = np.flatnonzero(key[place] == mine)
                piece, docs, size = pieces[asked][by][place[hit]], text[hit] + at, n[hit] + length - 1
                found = _binary(data[_places(edges[docs] + start[hit], size)], size)
                yield pa.RecordBatch.from_arrays([pa.array(h[hit]), pa.array(piece.astype(np.int32)), pa.array(ids[docs]), pa.array(salts[docs]), pa.array(start[hit].astype(np.int32)), pa.array(twice[hit]), found], ["h", "piece", "id", "salt", "start", "twice", "bytes"])

    return run


_SEGMENT = "h long, piece int, id long, salt long, start int, twice boolean, bytes binary"


def _prefixes(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one number, most significant first; zeros beyond the end."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(text), np.uint64)
    for i in range(8):
        out |= padded[i : i + len(text)] << np.uint64(56 - 8 * i)
    return out


def suffix_array(text: np.ndarray, deep: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of ``text`` and its inverse, by Larsson-Sadakane refinement.

    With ``deep``, a power of two from 8 on, suffixes that share so many bytes stay in any order and have one rank.
    """
    n = len(text)
    rank = np.zeros(n, np.int64)
    if not n:
        return rank, rank
    key = _prefixes(text)
    order = np.argsort(key)
    key = key[order]
    slots = np.arange(n)
    depth = 8
    first = np.concatenate([[True], key[1:] != key[:-1]])
    if n < 8:  # zeros beyond the end are no letters: settle short texts plainly
        order = np.array(sorted(range(n), key=lambda i: text[i:].tobytes()))
        rank[order] = slots
        return order, rank
    # Suffixes shorter than 8 look like longer ones that go on with zeros; a shorter one comes first.
    tail = np.minimum(n - order, 8)
    if (tail < 8).any():
        order = order[np.lexsort((tail, key))]
        tail = np.minimum(n - order, 8)
        first |= np.concatenate([[True], tail[1:] != tail[:-1]])
    while True:
        # `slots` are the places of the array still in groups, `order[slots]` their suffixes, `first` opens groups.
        group = np.flatnonzero(first)
        sizes = np.diff(np.concatenate([group, [len(slots)]]))
        rank[order[slots]] = np.repeat(slots[group], sizes)
        slots = slots[np.repeat(sizes > 1, sizes)]
        if not len(slots) or depth == deep:
            return order, rank
        suffix = order[slots]
        ahead = suffix + depth
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        both = rank[suffix] << 32 | second
        by = np.argsort(both)
        order[slots], both = suffix[by], both[by]
        first = np.concatenate([[True], both[1:] != both[:-1]])
        depth *= 2


def common_prefixes(text: np.ndarray, order: np.ndarray, rank: np.ndarray, cap: int, chunk: int = 256) -> np.ndarray:
    """Of each suffix in order, the bytes it shares with the one before (at least ``cap`` counts as ``cap``).

    Kasai's scan in text order, where a prefix is at most one shorter than the last; all chunks take each step together.
    """
    n = len(text)
    key = np.concatenate([_prefixes(text), np.zeros(1, np.uint64)])
    out = np.zeros(n, np.int64)
    base = np.arange(0, n, chunk)
    have = np.zeros(len(base), np.int64)
    for step in range(min(chunk, n)):
        if base[-1] + step >= n:
            base, have = base[:-1], have[:-1]
        i = base + step
        r = rank[i]
        j = order[np.maximum(r - 1, 0)]
        have = np.maximum(have - 1, 0)
        limit = np.where(r > 0, np.minimum(n - np.maximum(i, j), cap), 0)
        have = np.minimum(have, limit)
        todo = np.flatnonzero(have < limit)
        while len(todo):
            x = key[i[todo] + have[todo]] ^ key[j[todo] + have[todo]]
            same = np.zeros(len(todo), np.int64)
            for b in range(1, 9):
                same += (x >> np.uint64(64 - 8 * b)) == 0
            have[todo] = np.minimum(have[todo] + same, limit[todo])
            todo = todo[(same == 8) & (have[todo] < limit[todo])]
        out[r] = have
    return out


def _spans(where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of every run of true values."""
    edge = np.diff(np.concatenate([[0], where.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


_MARK = "id long, salt long, start int, end int, bytes binary"


def _mark_batch(ids: np.ndarray, salts: np.ndarray, start: np.ndarray, end: np.ndarray | None = None, strings: np.ndarray | None = None) -> pa.RecordBatch:
    """Marked ranges, or strings of one length (a row each) that begin at ``start``."""
    n = len(ids)
    found = pa.nulls(n, pa.binary()) if strings is None else _binary(strings, np.full(n, strings.shape[1]))
    ends = pa.nulls(n, pa.int32()) if end is None else pa.array(end.astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(salts), pa.array(start.astype(np.int32)), ends, found], ["id", "salt", "start", "end", "bytes"])


def _equal_before(edges: np.ndarray, data: np.ndarray, maybe: np.ndarray) -> np.ndarray:
    """Whether the byte strings ``maybe`` equal the ones before them, which are as long."""
    size = (edges[1:] - edges[:-1])[maybe]
    equal = np.empty(len(size), bool)
    for at, to in _stretches(np.concatenate([[0], np.cumsum(size)])):
        n = size[at:to]
        place = _places(edges[maybe[at:to]], n)
        equal[at:to] = np.logical_and.reduceat(data[place] == data[place - np.repeat(n, n)], np.cumsum(n) - n)
    return equal


def _marked(batch: pa.RecordBatch, length: int) -> Iterator[pa.RecordBatch]:
    """Of segments of whole hashes and pieces, sorted by these, bytes, id, salt and start: marked ranges; of hashes in
    pieces also the strings first in their piece."""
    h, piece, ids, salts, start, twice = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
    edges, data = _laid(batch.column(6))
    size = np.diff(edges)
    alike = (h[1:] == h[:-1]) & (piece[1:] == piece[:-1])
    group = np.cumsum(np.concatenate([[0], ~alike]))
    copy = np.zeros(len(h), bool)
    maybe = np.flatnonzero(alike & (size[1:] == size[:-1])) + 1
    copy[maybe] = _equal_before(edges, data, maybe)
    yield _mark_batch(ids[copy], salts[copy], start[copy], start[copy] + size[copy])
    # A lone segment has equal strings only if the gram that named it stands in it twice.
    go = np.flatnonzero(~copy & ((np.bincount(group[~copy])[group] > 1) | twice | (piece >= 0)))
    if not len(go):
        return
    go = go[np.lexsort((start[go], salts[go], ids[go], group[go]))]  # in order of documents
    text = data[_places(edges[go], size[go])]
    ends = np.cumsum(size[go])
    begins = ends - size[go]
    seg = np.repeat(np.arange(len(go)), size[go])
    place = np.flatnonzero(np.arange(len(text)) + length <= ends[seg])  # of strings inside one segment
    deep = 8 << ((length // 8).bit_length() - 1)
    _, rank = suffix_array(text, deep)
    # Strings are equal if both their first and their last ``deep`` bytes are, which overlap.
    first, last, many = rank[place], rank[place + length - deep], np.bincount(rank) > 1
    again = many[first] & many[last]
    key, at = first[again] << 32 | last[again], place[again]
    by = np.lexsort((group[go][seg[at]], key))
    key, at = key[by], at[by]
    of = group[go][seg[at]]
    later = np.zeros(len(text), bool)
    later[at[1:][(key[1:] == key[:-1]) & (of[1:] == of[:-1])]] = True
    low, high = _spans(later)  # strings end in their segment, so no span reaches the next one
    r = seg[low]
    yield _mark_batch(ids[go][r], salts[go][r], start[go][r] + low - begins[r], start[go][r] + high - begins[r] + length)
    alone = place[~later[place] & (piece[go][seg[place]] >= 0)]
    for i in range(0, len(alone), _BATCH_STRINGS):
        at = alone[i : i + _BATCH_STRINGS]
        r = seg[at]
        yield _mark_batch(ids[go][r], salts[go][r], start[go][r] + at - begins[r], strings=text[at[:, None] + np.arange(length)])


def _shards(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows come sorted by hash and piece; those of whole hashes and pieces are taken as far as ``SHARD_BYTES``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, least = 0, SHARD_BYTES

        def take(more: bool) -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            h, piece, at = rows.column(0).to_numpy(), rows.column(1).to_numpy(), 0
            keys = np.concatenate([[0], np.flatnonzero((h[1:] != h[:-1]) | (piece[1:] != piece[:-1])) + 1, [len(h)]])
            weight, stop = _laid(rows.column(6))[0][keys], len(keys) - 1 - more
            while at < stop:
                to = min(stop, int(np.searchsorted(weight, weight[at] + SHARD_BYTES)))
                if more and weight[to] - weight[at] < SHARD_BYTES:
                    break
                yield from _marked(rows.slice(keys[at], keys[to] - keys[at]), length)
                at = to
            held[:] = [rows.slice(keys[at])]

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.column(6).nbytes
            if size >= least:
                yield from take(more=True)
                size = held[0].column(6).nbytes
                least = max(SHARD_BYTES, 2 * size)  # a large hash is not laid together again for every batch
        if held:
            yield from take(more=False)

    return run


def _merge(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows come sorted by bytes, id, salt and start: ranges, which pass, then strings, which are marked if they equal the one before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            ranges = batch.column(4).null_count
            if ranges:
                yield batch.slice(0, ranges).select([0, 1, 2, 3])
            batch = batch.slice(ranges)
            if batch.num_rows:
                edges, data = _laid(batch.column(4))
                strings = data[edges[0] : edges[-1]].reshape(-1, length)
                again = np.concatenate([[last is not None and bool((strings[0] == last).all())], (strings[1:] == strings[:-1]).all(1)])
                last = strings[-1].copy()
                ids, salts, start = (batch.column(i).to_numpy()[again] for i in range(3))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(salts), pa.array(start), pa.array(start + np.int32(length))], ["id", "salt", "start", "end"])

    return run


def _joined(ranges: list[tuple[int, int]]) -> list[list[int]]:
    merged: list[list[int]] = []
    for a, b in sorted(ranges):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return merged


def _kept(length: int, keep_bytes: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From (doc_id, text, ranges); a text without a list of ranges is a copy of an earlier one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sizes, removed, spans, kept = [], [], [], []
                edges, data = _laid(part.column(1))
                lists = part.column(2)
                first, known, both = lists.offsets.to_numpy(), lists.is_valid().to_pylist(), lists.values
                start, end = both.field(0).to_numpy(zero_copy_only=False), both.field(1).to_numpy(zero_copy_only=False)
                for i in range(part.num_rows):
                    raw = data[edges[i] : edges[i + 1]].tobytes()
                    if known[i]:
                        of = slice(first[i], first[i + 1])
                        merged = _joined(list(zip(start[of].tolist(), end[of].tolist())))
                    else:
                        merged = [[0, len(raw)]] if len(raw) >= length else []
                    out, done = [], 0
                    for a, b in merged:
                        out.append(raw[done:a])
                        done = b
                    out.append(raw[done:])
                    rest = b"".join(out)
                    sizes.append(len(raw))
                    removed.append(len(raw) - len(rest))
                    spans.append(merged)
                    kept.append(rest)
                spans_type = pa.list_(pa.list_(pa.int32()))
                columns = [part.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, spans_type), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
                names = ["doc_id", "n_bytes", "n_removed", "spans", "kept_sha256"]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.binary())] * keep_bytes, names + ["kept"] * keep_bytes)

    return run


_KEPT = "doc_id long, n_bytes long, n_removed long, spans array<array<int>>, kept_sha256 string"


def remove_repeats(docs: DataFrame, length: int = LENGTH, *, keep_bytes: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (byte ranges), kept_sha256 and, if asked, kept (the remaining bytes) of every row."""
    ids = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("id"))
    repeated = not ids.groupBy("id").count().where("count > 1").limit(1).isEmpty()
    # neither a constant nor null: Spark would take it out of some keys, or filter one side, and deal the texts out twice
    no_salt = F.xxhash64(F.col(id_col)).bitwiseAND(F.lit(0).cast("long"))
    salt = F.xxhash64(text_col) if repeated else no_salt
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("id"), salt.alias("salt"), F.col(text_col).alias("text"))
    one = (lambda df: df.dropDuplicates(["id", "salt"])) if repeated else (lambda df: df)

    dealt = rows.repartition("id", "salt")  # texts move once: the same exchange serves all joins
    digest = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    earliest = rows.select("id", "salt", digest.alias("digest")).groupBy("digest").agg(F.min(F.struct("id", "salt")).alias("first")).select("first.id", "first.salt").repartition("id", "salt")
    texts = one(dealt.join(earliest.hint("shuffle_hash"), ["id", "salt"]))  # a semi join would be pushed below the exchange
    counted = texts.mapInArrow(_all_runs(length), _RUN).withColumn("n_runs", F.sum("n").over(Window.partitionBy("h")))
    pieces = F.ceil(F.col("n_runs") / PIECE).cast("int")
    piece = F.when(pieces > 1, F.pmod(F.xxhash64("id", "salt"), pieces)).otherwise(-1).cast("int")
    by_document = counted.where("n_runs > 1").select("id", "salt", "h", piece.alias("piece")).repartition("id", "salt").groupBy("id", "salt").agg(F.collect_set(F.struct("h", "piece")).alias("hashes"))
    found = one(dealt.join(by_document, ["id", "salt"]).select("id", "salt", "text", "hashes"))
    segments = found.mapInArrow(_segments(length), _SEGMENT).repartition("h", "piece").sortWithinPartitions("h", "piece", "bytes", "id", "salt", "start")
    meeting = F.when(F.col("bytes").isNull(), F.xxhash64("id", "salt", "start")).otherwise(F.xxhash64("bytes"))
    marks = segments.mapInArrow(_shards(length), _MARK).repartition(meeting).sortWithinPartitions("bytes", "id", "salt", "start")
    ranges = marks.mapInArrow(_merge(length), "id long, salt long, start int, end int")
    # Of every earliest text a list, which may be empty: null elements are not collected.
    bare = earliest.select("id", "salt", F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"))
    lists = ranges.union(bare).repartition("id", "salt").groupBy("id", "salt").agg(F.collect_set(F.when(F.col("start").isNotNull(), F.struct("start", "end"))).alias("ranges"))
    rest = dealt.join(lists, ["id", "salt"], "left").select(F.nullif("id", F.lit(_NULL_ID)).alias("doc_id"), "text", "ranges")
    return rest.mapInArrow(_kept(length, keep_bytes), _KEPT + ", kept binary" * keep_bytes)
