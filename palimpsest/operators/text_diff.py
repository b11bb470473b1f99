"""Character and line diffs. Ratcliff-Obershelp matching is recursive, so it runs in Arrow functions, a pair at a time; short
lines are matched a batch at a time."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import pairing

SEGMENTS = "array<struct<op:string,old:string,new:string>>"
_PAIRS = pa.list_(pa.struct([("old", pa.string()), ("new", pa.string())]))


def inline_segments(old: str, new: str, merge_gap: int = 6, min_run: int = 2) -> list[tuple[str, str, str]]:
    """(op, old, new) segments: equal, replace, delete or insert. Short equal runs inside changes are part of them."""
    codes = difflib.SequenceMatcher(None, old, new, autojunk=False).get_opcodes()
    out: list[list] = []  # changed?, old from, old to, new from, new to
    for i, (op, a, b, c, d) in enumerate(codes):
        size = b - a
        inside = 0 < i < len(codes) - 1
        equal = op == "equal" and not (inside and size <= merge_gap) and not (i > 0 and size < min_run)
        if out and not equal and out[-1][0]:
            out[-1][2], out[-1][4] = b, d
        else:
            out.append([not equal, a, b, c, d])
    name = lambda a, b, c, d: "replace" if a < b and c < d else "delete" if a < b else "insert"
    return [(name(a, b, c, d) if changed else "equal", old[a:b], new[c:d]) for changed, a, b, c, d in out]


def paired_lines(old: list[str], new: list[str], least: float = 0.5) -> list[tuple[str | None, str | None]]:
    """Changed lines side by side: each old line takes the unused new line most like it, the first of equals.

    What a new line is indexed by is made once. Lines are matched in the order of what their letters leave room for, which
    is never below their ratio, until that is less than the best ratio found.
    """
    out: list[tuple[str | None, str | None]] = []
    for op, a, b, c, d in difflib.SequenceMatcher(None, old, new, autojunk=False).get_opcodes():
        if op == "equal":
            continue
        free = list(range(c, d))
        against = {j: difflib.SequenceMatcher(None, "", new[j], autojunk=False) for j in free} if a < b else {}
        for i in range(a, b):
            best, at = 0.0, None
            bounds = []
            for j in free:
                against[j].set_seq1(old[i])
                most = against[j].real_quick_ratio()
                if most >= least and (most := against[j].quick_ratio()) >= least:
                    bounds.append((-most, j))
            for most, j in sorted(bounds):
                if -most < best:
                    break
                if -most > best or (at is not None and j < at):
                    ratio = against[j].ratio()
                    if ratio >= least and (ratio > best or (ratio == best and at is not None and j < at)):
                        best, at = ratio, j
            if at is not None:
                free.remove(at)
            out.append((old[i], new[at] if at is not None else None))
        out += [(None, new[j]) for j in free]
    return out


def _pairs(left: Iterator, right: Iterator):
    return ((x.as_py() or "", y.as_py() or "") for x, y in zip(left, right))


def inline_diff(old: Column, new: Column, merge_gap: int = 6, min_run: int = 2) -> Column:
    @F.arrow_udf(SEGMENTS)
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        item = pa.struct([("op", pa.string()), ("old", pa.string()), ("new", pa.string())])
        return pa.array([[dict(zip(("op", "old", "new"), s)) for s in inline_segments(x, y, merge_gap, min_run)] for x, y in _pairs(a, b)], pa.list_(item))

    return run(old, new)


def paired_batch(old: pa.Array, new: pa.Array, least: float = 0.5) -> pa.Array:
    """``paired_lines`` of each two texts: all short ones at once, the others one by one."""
    if not len(old):
        return pa.array([], _PAIRS)
    a, b = (pc.split_pattern(pc.fill_null(x, ""), "\n") for x in (old, new))
    short = pairing.is_short(a) & pairing.is_short(b)
    if short.all():
        return pairing.short_pairs(a, b, least)
    at, rest = np.flatnonzero(short), np.flatnonzero(~short)
    found = [pairing.short_pairs(a.take(at), b.take(at), least)] if at.size else []
    found.append(pa.array([[{"old": o, "new": n} for o, n in paired_lines(x, y, least)] for x, y in zip(a.take(rest).to_pylist(), b.take(rest).to_pylist())], _PAIRS))
    return pa.concat_arrays([x.cast(_PAIRS) for x in found]).take(pa.array(np.argsort(np.r_[at, rest])))


def line_pairs(old: Column, new: Column) -> Column:
    @F.arrow_udf("array<struct<old:string,new:string>>")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return paired_batch(a, b)

    return run(old, new)


def unified_diff(old: Column, new: Column, context: int = 1) -> Column:
    @F.arrow_udf("string")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(["\n".join(difflib.unified_diff(x.split("\n"), y.split("\n"), lineterm="", n=context)) for x, y in _pairs(a, b)], pa.string())

    return run(old, new)


def changed_share(segments: Column) -> Column:
    """The longer of what went and what came over the longer text, in percent with one decimal, at most 100."""
    size = lambda side: F.aggregate(segments, F.lit(0), lambda a, s: a + F.length(s[side]))
    changed = lambda side: F.aggregate(segments, F.lit(0), lambda a, s: a + F.when(s["op"] == "equal", 0).otherwise(F.length(s[side])))
    return F.round(F.least(F.lit(1.0), F.greatest(changed("old"), changed("new")) / F.greatest(size("old"), size("new"), F.lit(1))) * 100, 1)


def with_line_breaks(text: Column, pattern: str = r"([.!?] )([A-Z0-9])") -> Column:
    """Breaks put in after sentence ends; taking them out again gives the text back."""
    return F.regexp_replace(text, pattern, "$1\n$2")
