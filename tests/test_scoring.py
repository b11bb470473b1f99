"""A scorer that fails on some rows loses none."""

import math

from palimpsest.operators import scoring as S


def test_halving_scores_all_that_can_be_scored():
    calls = []

    def scorer(items):
        calls.append(len(items))
        if any(x == "bad" for x in items):
            raise RuntimeError("no")
        return [None if x == "none" else math.nan if x == "nan" else len(x) for x in items]

    got = S.answers(scorer, ["a", "bb", "bad", "none", "nan", "ccc", "bad"])
    assert [g[:2] for g in got] == [(1.0, "scored"), (2.0, "scored"), (None, "failed"), (None, "passed"), (None, "failed"), (3.0, "scored"), (None, "failed")]
    assert got[2][2] == "RuntimeError: no" and len(calls) < 2 * 7 + 2
    assert [g[1] for g in S.answers(lambda items: [1.0], ["a", "b"])] == ["scored", "scored"] and S.answers(lambda items: [], ["a"])[0][1] == "failed"


def test_rows_come_back_once_and_in_order(spark):
    def scorer(items):
        if "x" in items:
            raise ValueError("x")
        return [float(len(t)) if t else None for t in items]

    rows = [("q", i, i, t) for i, t in enumerate(["aa", "x", "b", None, "aa", "cccc"], 1)] + [("r", 1, 1, "x")]
    ranking = spark.createDataFrame(rows, "query string, doc long, rnk long, t string").coalesce(1)
    got = [(r["query"], r["doc"], r["rnk"], r["state"]) for r in S.reranked(ranking, ["t"], scorer, 9, size=4).orderBy("query", "rnk").collect()]
    assert got == [("q", 6, 1, "scored"), ("q", 1, 2, "scored"), ("q", 5, 3, "scored"), ("q", 3, 4, "scored"), ("q", 2, 5, "failed"), ("q", 4, 6, "passed"), ("r", 1, 1, "failed")]
    plain = S.reranked(ranking, ["t"], None, 2).orderBy("query", "rnk").collect()
    assert [(r["query"], r["doc"], r["state"]) for r in plain] == [("q", 1, "passed"), ("q", 2, "passed"), ("r", 1, "passed")]
    assert S.scored(ranking.where("false"), ["t"], scorer).count() == 0


def test_only_the_rows_of_a_call_are_held():
    import tracemalloc

    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 10_000] * 3000), pa.array(["y" * 10_000] * 3000)], ["q", "t"])
    tracemalloc.start()
    (out,) = S._scoring([0, 1], lambda pairs: [float(len(a) + len(b)) for a, b in pairs], 32)(iter([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10e6 and out.column("score").to_pylist() == [20_000.0] * 3000
