"""Block-max search against every document scored for every query."""

import math
import random
import re

import numpy as np

from palimpsest.llm import lexical, queries

from .conftest import SF, rows_of


def terms(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)


def by_loops(docs, items, k=10):
    found = [(d, terms(t)) for d, t in docs]
    found = [(d, t) for d, t in found if t]
    n, size = len(found), sum(len(t) for _, t in found)
    counts = [{w: t.count(w) for w in set(t)} for _, t in found]
    df = {}
    for c in counts:
        for w in c:
            df[w] = df.get(w, 0) + 1
    out = []
    for item_id, text in sorted(set(items), key=str):
        scored = []
        for (doc_id, words), c in zip(found, counts):
            m = 10 + (90 * len(words) * n) // size
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (1_000_000_000 * c[w] // (1000 * c[w] + 8 * m)) for w in set(terms(text)) if w in c)
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, i, d, -s) for i, (s, _, _, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def got(frame):
    return sorted(((r[0], r["rank"], r["doc_id"], r["score"]) for r in frame.collect()), key=str)


def test_query_is_what_loops_find(spark):
    docs = [(r["doc_id"], r["text"]) for r in rows_of("documents")]
    items = [(r["item_id"], r["text"]) for r in rows_of("benchmark")]
    frame = queries.op12_lexical_search(spark, SF)
    assert frame.columns == ["item_id", "rank", "doc_id", "score"]
    assert got(frame) == by_loops(docs, items)


def test_odd_rows_and_slices(spark, clashing, doc_rows, empty, monkeypatch):
    items = [(1, "one"), (2, None), (3, "..."), (4, "ALPHA alpha gamma tower École"), (4, "delta"), (5, "東京 3x7"), (6, "absent nowhere"), (1, "one"), (None, "été stop")]
    asked = spark.createDataFrame(items, "item_id long, text string")
    rows = [(r[0], r[1]) for r in doc_rows]
    want = by_loops(rows, items)
    index = lexical.build_index(clashing)
    assert got(lexical.search(index, asked)) == want and {r[0] for r in want} == {1, 4, 5, None}
    monkeypatch.setattr(lexical, "QUERY_ROWS", 2)
    assert got(lexical.search(index, asked)) == want
    assert lexical.search(lexical.build_index(empty), asked).count() == 0
    assert lexical.search(index, asked.where("false")).count() == 0
    repeated = rows + rows + [(None, "one one"), (None, "one one")]
    again = spark.createDataFrame(repeated, "doc_id long, text string").repartition(3)
    assert got(lexical.search(lexical.build_index(again), asked, 4)) == by_loops(repeated, items, 4)


def test_codes():
    values = np.array([0, 1, 127, 128, 300, 16383, 16384, 2**31, 2**40, 5])
    code, ends = lexical.encode(values)
    assert lexical.decode(code).tolist() == values.tolist() and ends[-1] == len(code)
    assert lexical.decode(np.empty(0, np.uint8)).tolist() == []


def test_small_blocks_skip(monkeypatch):
    """Every shard and block size gives what loops give, and blocks below the threshold stay compressed."""
    r = random.Random(3)
    common, rare = [f"c{i}" for i in range(8)], [f"r{i}" for i in range(300)]
    docs = [(i, " ".join(r.choices(common, k=r.randint(1, 40)) + r.choices(rare, k=r.randint(0, 3)))) for i in range(900)]
    items = [(i, " ".join(r.sample(common, 3) + r.sample(rare, 4))) for i in range(30)]
    n, size = len(docs), sum(len(terms(t)) for _, t in docs)
    df = {}
    for _, t in docs:
        for w in set(terms(t)):
            df[w] = df.get(w, 0) + 1
    want = by_loops(docs, items)
    for block, postings in ((1, 400), (4, 2000), (4, 10**6), (128, 10**6)):
        monkeypatch.setattr(lexical, "BLOCK", block)
        monkeypatch.setattr(lexical, "SHARD_POSTINGS", postings)
        shard, batches = lexical._Shard("t", n, size), []
        for d, t in docs:
            if shard.add(d, terms(t)):
                batches += list(shard.rows())
        batches += list(shard.rows())
        shards = {}
        for b in batches:
            for row in b.to_pylist():
                held = shards.setdefault(row["shard"], {})
                held[row["term"]] = row
        assert len(shards) > 1 or postings == 10**6
        found, opened, there = {i: [] for i, _ in items}, 0, 0
        for held in shards.values():
            sizes, ids = np.array(held[None]["sizes"]), held[None]["ids"]
            for i, text in items:
                lists = [lexical._List(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))), *(np.array(held[w][c]) for c in ("first", "last", "best", "at")), np.frombuffer(held[w]["data"], np.uint8), held[w]["n"]) for w in set(terms(text)) if w in held]
                if lists:
                    best, scores = lexical._best_of_shard(lists, sizes, np.arange(len(ids)), 10, 0, n, size)
                    found[i] += [(-s, ids[d]) for d, s in zip(best.tolist(), scores.tolist())]
                    opened += sum(x.opened for x in lists)
                    there += sum(len(x.last) for x in lists)
        rows = [(i, rank, d, -s) for i, f in found.items() for rank, (s, d) in enumerate(sorted(f)[:10], 1)]
        assert sorted(rows, key=str) == want
        if (block, postings) == (4, 10**6):
            assert opened < there / 2, (opened, there)


def test_query_agrees_with_its_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel = con.sql(queries.oracle_sql()["op12_lexical_search"])
    frame = queries.op12_lexical_search(spark, SF)
    assert sorted(rel.columns) == sorted(frame.columns)
    assert sorted(rel.select("item_id", "rank", "doc_id", "score").fetchall()) == sorted(map(tuple, frame.select("item_id", "rank", "doc_id", "score").collect()))
