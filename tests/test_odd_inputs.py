"""Rows that are no good beside rows that are: what each operator does with them is defined."""

import math

import numpy as np

from palimpsest.operators import checklist as K
from palimpsest.operators import retrieval as R


def test_vectors_that_cannot_be_compared_take_no_part(spark):
    good = [(1, [1.0, 0.0]), (2, [0.5, 0.4]), (3, [0.0, 1.0]), (4, [-0.5, 0.1])]
    bad = [(5, [math.nan, 1.0]), (6, [None, 1.0]), (7, [math.inf, 0.0]), (8, None), (None, [1.0, 1.0]), (9, [])]
    longer = [(10, [1.0, 0.0, 2.0]), (11, [0.5, 0.5, 0.5])]
    rows = spark.createDataFrame(good + bad + longer, "id long, v array<double>").repartition(3)
    got = R.vector_top_k(rows, rows, "id", "v", 2).collect()
    found = sorted((r["query"], r["rnk"], r["doc"], r["score"]) for r in got)
    want = []
    for group in (good, longer):
        for q, a in group:
            scores = sorted(((-round(float(np.dot(a, b)), 6), d) for d, b in group if d != q))[:2]
            want += [(q, i, d, -s) for i, (s, d) in enumerate(scores, 1)]
    assert found == sorted(want)


def test_stray_elements_lose_no_item(spark):
    items = spark.createDataFrame([(b, i) for b in range(7) for i in ("a", "b", "c")], "batch int, item string")
    said = [
        (0, 'so: [{"id":"a","verdict":"OK","reason":"r"}, "stray", {"id":"b","verdict":"NG"}] end'),
        (1, '[{"id":"a","verdict":"OK"}, null, 7, [1], {"verdict":"OK"}, {"id":"a","verdict":"NG"}, {"id":"c"}]'),
        (2, "no array"), (3, "[broken"), (4, '["only", "strings"]'), (5, '[{"id":"a",]'),
    ]
    got = K.answered(items, spark.createDataFrame(said, "batch int, response string")).collect()
    states = {(r["batch"], r["item"]): (r["state"], r["verdict"]) for r in got}
    assert [states[0, i] for i in "abc"] == [("judged", "OK"), ("judged", "NG"), ("left_out", None)]
    assert [states[1, i] for i in "abc"] == [("judged", "NG"), ("left_out", None), ("judged", None)]
    assert {states[b, i][0] for b in (2, 3) for i in "abc"} == {"no_array"}
    assert {states[4, i][0] for i in "abc"} == {"left_out"}
    assert {states[5, i][0] for i in "abc"} == {"unreadable"} and {states[6, i][0] for i in "abc"} == {"no_response"}
