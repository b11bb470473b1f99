import math
import random

from palimpsest.llm import queries, toxicity

from .conftest import SF


def maximal_brute(values):
    """Recursive definition: the best segment (leftmost, shortest), then left and right of it."""

    def best(lo, hi):
        found = None
        for i in range(lo, hi):
            total = 0.0
            for j in range(i, hi):
                total += values[j]
                if total > 1e-12 and (found is None or total > found[2] + 1e-9):
                    found = (i, j, total)
        if found is None:
            return []
        i, j, s = found
        return best(lo, i) + [found] + best(j + 1, hi)

    return best(0, len(values))


def test_maximal_segments():
    rng = random.Random(4)
    for _ in range(200):
        n = rng.randint(0, 25)
        hits = [(i, rng.choice([3.1, 1.7, 0.9, -1.3, -0.4]) + rng.random() / 50) for i in range(n) if rng.random() < 0.4]
        values = [-0.21] * n
        for i, s in hits:
            values[i] = s
        got = toxicity.maximal_segments(hits, -0.21)
        want = maximal_brute(values)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert all(math.isclose(x[2], y[2], abs_tol=1e-9) for x, y in zip(got, want))


def test_long_scan_is_linear():
    hits = [(i, 1.0 if i % 2 else -1.0) for i in range(300_000)]
    assert toxicity.maximal_segments(hits)
    falling = [(2 * i, 5.0) for i in range(200_000)]
    assert len(toxicity.maximal_segments(falling, -6.0)) == 200_000


def test_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op1_toxicity(spark, sf).collect()
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    hit = [(labels[r["doc_id"]], r["predicted"]) for r in held]
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    toxic = [p for y, p in hit if y]
    clean = [p for y, p in hit if not y]
    assert sum(toxic) >= 0.9 * len(toxic) and sum(clean) <= 0.03 * len(clean)


def test_odd_rows(spark, docs, clashing, empty, doc_rows):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    odd = labels.select("doc_id", "toxic").union(spark.createDataFrame([(None, 1), (3, None), (3, 1), (4, 7)], "doc_id long, toxic int"))
    model = toxicity.fit(clashing, odd)
    scored = toxicity.score_documents(clashing, model).collect()
    assert sorted(r["doc_id"] for r in scored) == sorted(r[0] for r in doc_rows) and all(0 <= r["score"] <= 1 for r in scored)
    kept = toxicity.drop_toxic(clashing, model)
    assert kept.columns == clashing.columns and kept.count() == sum(r["score"] < 0.3 for r in scored)
    assert toxicity.score_documents(empty, model).count() == 0
    none = toxicity.fit(docs, labels.where("false"))
    assert {r["score"] for r in toxicity.score_documents(docs, none).collect()} == {0.0}


def test_copies_count_once(spark):
    """A thousand copies of one toxic text don't make its other words toxic."""
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefghijkl", k=5))
    words = [word() for _ in range(400)]
    text = lambda bad: " ".join([*rng.choices(words, k=60), *(["zzvile"] if bad else []), *rng.choices(words, k=60)])
    copied = " ".join([word() for _ in range(50)]) + " zzvile"
    rows = [(i, text(i % 4 == 0), i % 4 == 0) for i in range(400)] + [(1000 + i, copied, True) for i in range(300)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], int(r[2])) for r in rows], "doc_id long, toxic int")
    assert set(toxicity.fit(docs, labels).scores) == {"zzvile", "zzvil*", "zzvi*"}
