"""Spelling variants against all pairs of words compared letter by letter."""

import random
import re
import zlib

import pytest

from palimpsest.llm import queries, spelling

from .conftest import SF, rows_of


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def by_loops(rows, least=7, count=2, ratio=10, edits=31):
    totals = {}
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if edits and h % edits == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            totals[run] = totals.get(run, 0) + 1
    words = {w: n for w, n in totals.items() if len(w) >= least and n >= count}
    by_length = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    out = {}
    for w, n in words.items():
        near = [v for size in (len(w) - 1, len(w), len(w) + 1) for v in by_length.get(size, ()) if one_edit(w, v)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        form = best if best is not None and words[best] >= ratio * n else None
        out[w] = [w, n, len(near), form, words[form] if form else None]
    for row in out.values():
        root = row[0]
        while out[root][3]:
            root = out[root][3]
        row.append(root)
    return sorted(map(tuple, out.values()))


def got(frame):
    return sorted((r["word"], r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in frame.collect())


@pytest.fixture(scope="module")
def planted():
    """Families of edited words, chains of forms, equal letters, words at the least length, letters beyond ASCII."""
    r = random.Random(5)
    text = []
    for n in range(40):
        base = "".join(r.choice("aabéþÿ") for _ in range(r.randint(7, 12)))
        text += [base] * r.choice([2, 30, 300])
        for _ in range(6):
            at, kind = r.randrange(len(base)), r.randrange(3)
            other = base[:at] + ("" if kind == 0 else r.choice("abéß")) + base[at + (kind < 2) :]
            text += [other] * r.choice([1, 2, 3, 25])
    text += ["chainaaaaa"] * 2 + ["chainaaaab"] * 20 + ["chainaaabb"] * 200 + ["chainaabbb"] * 2000 + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa"] * 2
    return [(n, " ".join(text[n::25])) for n in range(25)]


@pytest.mark.parametrize("split", [50_000, 3])
def test_planted_families(spark, planted, monkeypatch, split):
    monkeypatch.setattr(spelling, "SPLIT", split)
    docs = spark.createDataFrame(planted, "doc_id long, text string").repartition(3)
    want = by_loops(planted, edits=None)
    assert got(spelling.group_spellings(docs)) == want
    assert {r[5] for r in want if r[0].startswith("chain")} == {"chainaabbb"} and max(r[2] for r in want) >= 5


def test_query_is_what_loops_find(spark):
    want = by_loops([(r["doc_id"], r["text"]) for r in rows_of("documents")])
    frame = queries.op11_spelling(spark, SF)
    assert frame.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    assert got(frame) == want and any(r[3] for r in want)


def test_odd_rows(spark, clashing, doc_rows, empty):
    assert got(spelling.group_spellings(clashing, edits=31)) == by_loops([(r[0], r[1]) for r in doc_rows])
    assert spelling.group_spellings(empty, edits=31).count() == 0
    null_id = [(None, "wordword wordword"), (None, "wordword"), (1, None), (1, "short words only")]
    assert got(spelling.group_spellings(spark.createDataFrame(null_id, "doc_id long, text string"), edits=31)) == by_loops(null_id)
    long_word = [(1, "x" * 3000 + " " + "x" * 3000), (2, "x" * 2999 + " " + "x" * 2999)]
    assert [r[2] for r in got(spelling.group_spellings(spark.createDataFrame(long_word, "doc_id long, text string")))] == [1, 1]
