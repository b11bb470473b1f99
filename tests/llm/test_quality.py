"""The quality model: held-out accuracy, its parts against plain computations, odd rows."""

import zlib

import numpy as np

from palimpsest.llm import quality, queries

from .conftest import rows_of

SF = "/root/testdata/sf0.01"


def test_held_out_rows(spark):
    rows = queries.op13_quality(spark, SF).collect()
    import pyarrow.parquet as pq

    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}
    assert len(rows) == pq.read_metadata(f"{SF}/documents.parquet").num_rows
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    held = [(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    good, bad = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    assert np.mean([(g > b) + (g == b) / 2 for g in good for b in bad]) > 0.98
    assert np.mean([(s >= 0.5) == y for s, y in held]) > 0.97


def test_labels_decide_nothing_held_out(spark):
    """Turning the held-out labels over changes no score."""
    docs, labels = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    from pyspark.sql import functions as F

    from palimpsest.llm.common import crc_remainder

    turned = labels.withColumn("quality", F.when(crc_remainder(F.col("doc_id"), 3) == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    a = sorted(map(tuple, quality.score_documents(docs, quality.training_labels(labels)).collect()))
    b = sorted(map(tuple, quality.score_documents(docs, quality.training_labels(turned)).collect()))
    assert [x[0] for x in a] == [x[0] for x in b] and np.allclose([x[1] for x in a], [x[1] for x in b], atol=1e-6)


def test_isotonic_is_the_nearest_rising_sequence():
    r = np.random.default_rng(1)
    for _ in range(50):
        n = int(r.integers(1, 9))
        counts, means = r.integers(1, 5, n).astype(float), r.integers(0, 4, n) / 3
        got = quality.isotonic(counts, means)
        assert (np.diff(got) >= -1e-12).all()
        # max over starts of the min over ends of the means of ranges
        want = [max(min(np.average(means[a : b + 1], weights=counts[a : b + 1]) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
        assert np.allclose(got, want)


def test_features_are_the_kernel():
    d = len(quality.NAMES)
    model = quality.QualityModel(np.zeros(d), np.ones(d))
    x = np.random.default_rng(2).normal(size=(40, d))
    z = model.features(x)[:, :-1]
    far = ((x[:, None] - x[None]) ** 2).sum(2)
    assert np.abs(z @ z.T - np.exp(-far / (2 * quality.WIDTH**2 * d))).mean() < 0.06


def test_sums_are_the_normal_equations(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    stats = quality.document_statistics(docs).repartition(5)
    model = quality.fit(stats, labels)
    known = {r["doc_id"]: r["quality"] for r in rows_of("labels")}
    rows = [(r["stats"], known[r["doc_id"]]) for r in stats.collect() if r["doc_id"] in known]
    z, y = model.features(np.array([s for s, _ in rows])), np.array([g for _, g in rows], float)
    fits = []
    for ridge in quality.RIDGES:
        pull = np.full(z.shape[1], ridge * len(z) / z.shape[1] + 1e-9)
        pull[-1] = 1e-9
        fits.append(np.linalg.solve(z.T @ z + np.diag(pull), z.T @ y))
    assert min(np.abs(z @ w - z @ model.weights).max() for w in fits) < 1e-4


def test_odd_rows(spark, clashing, doc_rows, empty):
    labels = spark.createDataFrame([(r["doc_id"], r["quality"]) for r in rows_of("labels")] + [(9001, 0), (9002, None), (None, 1), (9003, 7), (9008, 1), (9008, 0)], "doc_id long, quality int")
    rows = quality.score_documents(clashing, labels).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(r[0] for r in doc_rows) and all(0 <= r["score"] <= 1 for r in rows)
    by_id = {r["doc_id"]: r["score"] for r in rows}
    assert by_id[9001] == by_id[9002]
    assert quality.score_documents(empty, labels).count() == 0
    docs = clashing.select("doc_id", "text")
    assert {r["score"] for r in quality.score_documents(docs, labels.where("quality = 1")).collect()} == {1.0}
    assert {r["score"] for r in quality.score_documents(docs, labels.where("false")).collect()} == {0.5}
