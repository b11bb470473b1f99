from collections import defaultdict

from pyspark.sql import functions as F

from palimpsest.llm import mixing, queries

from .conftest import SF, rows_of


def expected_targets(rows):
    sizes = defaultdict(int)
    for _, text, _, source, _ in rows:
        sizes[source] += len((text or "").encode().split())
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        free = [s for s in order if s not in capped]
        target = {s: 3 * sizes[s] for s in capped} | {s: left * weight[s] / sum(weight[t] for t in free) for s in free}
        over = {s for s in free if target[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return sizes, target
        capped |= over


def test_targets_and_taken(docs, doc_rows):
    got = mixing.apply_mix(docs, mixing.plan_mix(docs)).select("doc.doc_id", "source", "size", "source_size", "target", "taken").collect()
    sizes, target = expected_targets(doc_rows)
    assert len(got) == len(doc_rows)
    taken, longest = defaultdict(int), defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - target[r["source"]]) < 1e-6 * max(1, r["target"])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        longest[r["source"]] = max(longest[r["source"]], r["size"])
    for s in sizes:
        assert abs(taken[s] - target[s]) <= longest[s] + 1


def test_reruns_agree(docs):
    a = {tuple(r) for r in mixing.apply_mix(docs, mixing.plan_mix(docs)).select("doc.doc_id", "taken").collect()}
    b = {tuple(r) for r in mixing.apply_mix(docs.repartition(3), mixing.plan_mix(docs.repartition(2))).select("doc.doc_id", "taken").collect()}
    assert a == b


def test_longer_classes_are_likelier(spark):
    rows = [(i, "w " * (1 + (i % 2) * 63), "en", "s", 1) for i in range(4000)] + [(9999, "w " * 400000, "en", "t", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    plan = mixing.plan_mix(docs, weights=(1.0, 9.0), share=0.5, tilt=0.5)
    got = mixing.apply_mix(docs, plan).where("source = 's'").groupBy("size").avg("copies").collect()
    mean = {r["size"]: r[1] for r in got}
    assert mean[64] > 1.5 * mean[1]


def test_mix_repeats_rows(docs, clashing, empty):
    mixed = mixing.mixed_documents(clashing)
    assert mixed.columns == clashing.columns
    copies = mixing.apply_mix(docs, mixing.plan_mix(docs)).agg({"copies": "sum"}).first()[0]
    assert mixed.count() == copies
    assert mixing.mixed_documents(empty).count() == 0


def test_equal_rows_are_drawn_one_by_one(spark):
    """A source of equal rows alone comes near its target, also where its rows differ in a column beside."""
    rows = [(7, "w w w w w w w w w w", "en", "s", 1)] * 1000 + [(i, "w " * 10, "en", "t", 1) for i in range(3000)]
    rows += [(8, "w w w", "en", "u", i % 2) for i in range(400)] + [(None, None, None, None, None)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    sizes, target = expected_targets(rows)
    got = mixing.apply_mix(docs, mixing.plan_mix(docs)).select("doc.doc_id", "source", "size", "taken", "copies").collect()
    assert len(got) == len(rows)
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r["copies"] <= 3
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 10 for s in "stu"), (taken, target)
    assert mixing.mixed_documents(docs).count() == sum(r["copies"] for r in got)
    again = mixing.apply_mix(docs.repartition(2), mixing.plan_mix(docs.repartition(3))).select("doc.doc_id", "source", "size", "taken", "copies").collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_numbers_beyond_one_block(spark):
    counted = spark.createDataFrame([("a", 65_537), ("b", 1)], "k string, n long")
    got = {r["k"]: (r["a"], r["b"], r["c"]) for r in mixing._dealt(counted).groupBy("k").agg(F.count("*").alias("a"), F.min("nth").alias("b"), F.max("nth").alias("c")).collect()}
    assert got == {"a": (65_537, 1, 65_537), "b": (1, 1, 1)}


def test_query(spark):
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in rows_of("documents")]
    sizes, target = expected_targets(rows)
    got = queries.op5_mixing(spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in rows)
    by_id = {r[0]: r for r in rows}
    taken = defaultdict(int)
    for r in got:
        source = by_id[r["doc_id"]][3]
        assert abs(r["target"] - target[source]) < 1e-6 * max(1, r["target"])
        taken[source] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= max(len((r[1] or "").split()) for r in rows if r[3] == s) + 1 for s in sizes)
