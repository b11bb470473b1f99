"""Ratcliff-Obershelp matching of many short texts at once: the bits of a word are the places of one text, rows those of the other.

``difflib`` takes the longest common run (the first of equals), then those before and behind it. What is before and behind
does not depend on each other, so the longest run of both may come next: it is found in the same table of equal symbols once
the cells that cross a run are cleared. The blocks are difflib's own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WIDEST = 64  # symbols of a line and lines of a text; what is longer goes to difflib
_WORDS = ((16, np.uint16), (32, np.uint32), (64, np.uint64))
_ROOM = 1 << 17  # cells of a table at a time, so that it stays in the cache
_LINES = 1 << 17  # lines of both sides that are matched together


def _blocks(a: np.ndarray, b: np.ndarray, word: type, total: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Bits of the matched places of each column of ``a`` and of ``b``; no more than some of them once they fall short of ``least``."""
    n = a.shape[1]
    in_a, in_b = np.zeros(n, word), np.zeros(n, word)
    same = np.zeros(a.shape, word)
    for j in range(len(b)):
        same |= np.left_shift((a == b[j]).view(np.uint8), word(j), dtype=word)
    at = np.arange(n)
    one = word(1)
    while at.size:
        left = np.bitwise_or.reduce(same, axis=0)
        most = np.bitwise_count(in_b[at]).astype(np.int64) + np.bitwise_count(left)
        go = np.flatnonzero((left != 0) & (2.0 * most / total[at] >= least))
        if go.size < at.size:
            at, same = at[go], same.take(go, axis=1)
            if not at.size:
                break
        runs, longest, size = same, same.copy(), np.ones(at.size, word)  # longest: where the longest runs of a column end
        for k in range(1, len(same)):
            runs = same[k:] & (runs[:-1] << one)
            more = np.bitwise_or.reduce(runs, axis=0) != 0
            if not more.any():
                break
            longest &= more.astype(word) - one  # all bits where no run is that long
            longest[k:] |= runs
            size += more
        end, bits = np.zeros(at.size, word), np.zeros(at.size, word)
        for i in range(len(same) - 1, -1, -1):
            found = longest[i] != 0
            end[found] = i
            np.copyto(bits, longest[i], where=found)
        last = bits & (~bits + one)
        first = last >> (size - one)
        begin = end + one - size
        before, behind = first - one, ~((last << one) - one)
        in_a[at] |= (((one << (size - one)) << one) - one) << begin
        in_b[at] |= (last << one) - first
        for i in range(len(same)):
            same[i] &= (before & -(begin > i).astype(word)) | (behind & -(end < i).astype(word))
    return in_a, in_b


def matched(a: np.ndarray, a_size: np.ndarray, i: np.ndarray, b: np.ndarray, b_size: np.ndarray, j: np.ndarray, least: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Bits of the places that difflib matches in column ``i`` of ``a`` and column ``j`` of ``b``, which are no wider than ``WIDEST``.

    Symbols behind the end of a column must be in no other. Pairs whose ratio is below ``least`` may have less than all.
    """
    in_a, in_b = np.zeros(len(i), np.uint64), np.zeros(len(i), np.uint64)
    rows, cols = a_size[i], b_size[j]
    wide, narrow = np.maximum(rows, cols), 0
    for width, word in _WORDS:
        fit = np.flatnonzero((wide > narrow) & (wide <= width))
        step = max(1, _ROOM // width)
        for s in range(0, len(fit), step):
            x = fit[s : s + step]
            high, across = rows[x].max(), cols[x].max()
            in_a[x], in_b[x] = _blocks(a[:high].take(i[x], axis=1), b[:across].take(j[x], axis=1), word, rows[x] + cols[x], least)
        narrow = width
    return in_a, in_b


def _symbols(lines: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all lines, where each line starts and how many it has."""
    size = pc.utf8_length(lines).to_numpy(zero_copy_only=False).astype(np.int64)
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(lines)], pa.int32()), lines), "")[0].as_py()
    codes = np.frombuffer(joined.encode("ascii"), np.uint8) if joined.isascii() else np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    return codes, np.cumsum(size) - size, size


def _columns(codes: np.ndarray, start: np.ndarray, size: np.ndarray, behind: int) -> np.ndarray:
    """One column a line, as high as the longest of them; ``behind`` follows the end."""
    high = int(size.max(initial=0))
    out = np.full((high, len(start)), behind, codes.dtype)
    for i in range(high):
        has = np.flatnonzero(size > i)
        out[i, has] = codes[start[has] + i]
    return out


def _free(change: np.ndarray, first: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines outside the equal blocks of their text, and how many equal lines stand before each."""
    place = np.arange(len(change)) - first[change]
    equal = ((bits[change] >> place.astype(np.uint64)) & np.uint64(1)).astype(bool)
    before = np.bitwise_count(bits[change] & ((np.uint64(1) << place.astype(np.uint64)) - np.uint64(1))).astype(np.int64)
    free = np.flatnonzero(~equal)
    return free, before[free]


def is_short(texts: pa.Array) -> np.ndarray:
    """Which texts, each a list of lines, have neither more lines nor longer ones than the tables take."""
    count = pc.list_value_length(texts).to_numpy(zero_copy_only=False)
    size = pc.utf8_length(texts.flatten()).to_numpy(zero_copy_only=False)
    return (count <= WIDEST) & (np.maximum.reduceat(size, np.cumsum(count) - count) <= WIDEST)


def short_pairs(old: pa.Array, new: pa.Array, least: float) -> pa.Array:
    """For texts that are short on both sides, what ``paired_lines`` makes of each; in stretches of bounded memory."""
    lines = np.cumsum(pc.add(pc.list_value_length(old), pc.list_value_length(new)).to_numpy(zero_copy_only=False))
    cuts = np.r_[0, np.flatnonzero(np.diff(lines // _LINES)) + 1, len(old)]
    return pa.concat_arrays([_pairs(old[s:e], new[s:e], least) for s, e in zip(cuts[:-1], cuts[1:])])


def _pairs(old: pa.Array, new: pa.Array, least: float) -> pa.Array:
    n = len(old)
    counts = [pc.list_value_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (old, new)]
    firsts = [np.cumsum(c) - c for c in counts]
    changes = [np.repeat(np.arange(n), c) for c in counts]
    lines = [x.flatten() for x in (old, new)]
    # Equal blocks, of the texts that share a line.
    ids = pc.dictionary_encode(pa.concat_arrays(lines)).indices.to_numpy().astype(np.int64)
    sides = [ids[: len(lines[0])], ids[len(lines[0]) :]]
    keys = [c * (len(ids) + 1) + k for c, k in zip(changes, sides)]
    bits = [np.zeros(n, np.uint64), np.zeros(n, np.uint64)]
    both = np.unique(changes[0][np.isin(keys[0], keys[1])])
    if both.size:
        size = [c[both] for c in counts]
        tall = [_columns(k, f[both], s, -1 - side) for side, (k, f, s) in enumerate(zip(sides, firsts, size))]
        every = np.arange(len(both))
        for side, found in enumerate(matched(tall[0], size[0], every, tall[1], size[1], every)):
            bits[side][both] = found
    # Lines between the same two blocks may be matched; all old lines of one rank among them choose at once.
    (free, stretch), (free_new, stretch_new) = (_free(c, f, x) for c, f, x in zip(changes, firsts, bits))
    group = changes[0][free] * (WIDEST + 1) + stretch
    group_new = changes[1][free_new] * (WIDEST + 1) + stretch_new
    low, high = np.searchsorted(group_new, group, "left"), np.searchsorted(group_new, group, "right")
    rank = np.arange(len(free)) - np.searchsorted(group, group, "left")
    codes = [_symbols(x) for x in lines]
    wide = np.uint8 if all(c.dtype == np.uint8 for c, _, _ in codes) else np.uint32
    tall = [_columns(c.astype(wide), s, size, np.iinfo(wide).max - side) for side, (c, s, size) in enumerate(codes)]
    taken, partner = np.zeros(len(free_new), bool), np.full(len(free), -1)
    for turn in range(int(rank.max(initial=-1)) + 1):
        asking = np.flatnonzero((rank == turn) & (high > low))
        many = high[asking] - low[asking]
        who = np.repeat(asking, many)
        whom = np.arange(len(who)) - np.repeat(np.cumsum(many) - many - low[asking], many)
        left = np.flatnonzero(~taken[whom])
        if not left.size:
            continue
        who, whom = who[left], whom[left]
        i, j = free[who], free_new[whom]
        total = codes[0][2][i] + codes[1][2][j]
        ratio = 2.0 * np.bitwise_count(matched(tall[0], codes[0][2], i, tall[1], codes[1][2], j, least)[0]) / np.maximum(total, 1)
        ratio[total == 0] = 1.0
        starts = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
        best = np.repeat(np.maximum.reduceat(ratio, starts), np.diff(np.r_[starts, len(who)]))
        hit = np.flatnonzero((ratio == best) & (ratio >= least) & (ratio > 0))
        hit = hit[np.r_[True, who[hit][1:] != who[hit][:-1]]] if hit.size else hit
        partner[who[hit]] = whom[hit]
        taken[whom[hit]] = True
    # Old lines of a stretch come first, then what is left of the new ones.
    alone = np.flatnonzero(~taken)
    order = np.argsort(np.r_[group * 2, group_new[alone] * 2 + 1], kind="stable")
    at_old = np.r_[free, np.full(len(alone), -1)][order]
    met = np.where(partner >= 0, free_new[partner], -1) if len(free_new) else partner
    at_new = np.r_[met, free_new[alone]][order]
    owner = np.r_[changes[0][free], changes[1][free_new[alone]]]
    taken_lines = [x.take(pa.array(at, mask=at < 0)) for x, at in zip(lines, (at_old, at_new))]
    offsets = np.r_[0, np.cumsum(np.bincount(owner, minlength=n))].astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(taken_lines, ["old", "new"]))
