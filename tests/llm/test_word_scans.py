"""Decontamination, license scans and winnowing against plain loops."""

import hashlib
import random

import pytest
import xxhash

from palimpsest.llm import decontaminate, license_scan, queries, winnowing
from palimpsest.llm.license_scan import words_of

from .conftest import SF, rows_of


def contaminated(text, items, n=10):
    grams = {}
    for item_id, item in items:
        w = words_of(item or "")
        for i in range(max(1, len(w) - n + 1)) if w else []:
            grams.setdefault(tuple(w[i : i + n]), set()).add(str(item_id))
    words, hit, found = words_of(text or ""), set(), set()
    for length in {len(g) for g in grams}:
        for at in range(len(words) - length + 1):
            if g := grams.get(tuple(words[at : at + length])):
                hit |= set(range(at, at + length))
                found |= g
    return len(words), len(hit), sorted(found)


def items_of():
    items = [(r["item_id"], r["text"]) for r in rows_of("benchmark")]
    return items + [(500, "alpha beta"), (501, None), (502, "..."), (503, "Gamma delta ALPHA beta gamma delta alpha beta gamma delta alpha"), (504, "tower BLOCK"), (505, items[3][1])]


def test_decontamination(spark, docs, doc_rows, clashing, monkeypatch):
    items = items_of()
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted((r[0], *contaminated(r[1], items)) for r in doc_rows)
    for size in (500_000, 300):
        monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", size)
        got = decontaminate.find_contamination(clashing, bench).collect()
        assert sorted((r["doc_id"], r["n_words"], r["n_hit"], r["hit_items"]) for r in got) == want
    assert any(w[2] for w in want) and any(not w[2] for w in want)


def test_decontamination_effects(spark, docs, doc_rows, clashing, empty):
    items = items_of()
    bench = spark.createDataFrame(items, "item_id long, text string")
    bad = {r[0] for r in doc_rows if contaminated(r[1], items)[1]}
    kept = decontaminate.drop_contaminated(clashing, bench)
    assert kept.columns == clashing.columns and {r["doc_id"] for r in kept.collect()} == {r[0] for r in doc_rows} - bad
    left = {r["doc_id"]: r["text"] for r in decontaminate.remove_spans(docs, bench).collect()}
    for r in doc_rows:
        if r[0] not in bad:
            assert left[r[0]] == r[1]
        elif len(r[1]) < 5000:
            n, hit, _ = contaminated(r[1], items)
            assert len(words_of(left[r[0]])) == n - hit
    assert decontaminate.find_contamination(empty, bench).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_contamination(docs, none).where("n_hit > 0").count() == 0


def test_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "alpha beta x"), (1, "alpha beta x"), (None, "beta"), (None, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "alpha beta")], "item_id long, text string")
    assert sorted(r["n_hit"] for r in decontaminate.find_contamination(docs, bench).collect()) == [0, 0, 2, 2]
    assert license_scan.scan_licenses(docs).count() == 4 and winnowing.compare_edited(docs).count() == 4


def licensed(text):
    words, starts, labels = words_of(text or ""), [], set()
    for phrase, label in (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")):
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                starts.append(i)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


LICENCES = [
    "Released under the MIT License. released UNDER the mit license",
    "x Licensed under the Apache License, Version 2.0 (the 'License'); you may not use this file except in compliance with the License. y",
    "This work is licensed under the GNU General Public License, version 2. CC BY-NC 4.0, apache license version 2",
    "Redistribution and use in source and binary forms, with or without any modification, are permitted provided that the following conditions are met:",
    "Redistribution and use in source and binary forms",
    "Permission is hereby granted, free of charge, to any other person obtaining a copy of this software and associated documentation files (the Software)",
    "the license of the public in binary forms",
]


def test_base_phrases(spark, doc_rows):
    rows = [(r[0], r[1]) for r in doc_rows] + [(8000 + i, t) for i, t in enumerate(LICENCES)]
    spark.createDataFrame(rows, "doc_id long, text string").createOrReplaceTempView("licence_rows")
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(spark.table("licence_rows")).collect()}
    assert len(got) == len(rows)
    for doc_id, text in rows:
        r, want = got[doc_id], licensed(text)
        starts = r["base_starts"]
        assert (r["n_words"], len(starts), min(starts, default=None), max(starts, default=None), ",".join(r["base_labels"])) == want
        assert set(r["base_labels"]) <= set(r["labels"])
    labels = [got[8000 + i]["labels"] for i in range(len(LICENCES))]
    assert labels == [["mit"], ["apache-2"], ["apache-2", "cc-by-nc", "gpl"], ["bsd"], [], ["mit"], []]


def marks(text, k=5, w=4):
    words = words_of(text)
    if not words:
        return []

    # The hash rolls: turned by one bit, the word that leaves taken out, the next one put in.
    turned = lambda h, by: (h << by % 64 | h >> (64 - by % 64)) & (1 << 64) - 1
    each = [xxhash.xxh64_intdigest(x.encode(), 42) for x in words]
    size, rolled, hashes = min(k, len(words)), 0, []
    for i, h in enumerate(each):
        rolled = turned(rolled, 1) ^ h
        if i >= size:
            rolled ^= turned(each[i - size], size)
        if i >= size - 1:
            hashes.append(rolled)
    signed = [h - (1 << 64) if h >> 63 else h for h in hashes]
    out = []
    for i in range(max(1, len(hashes) - w + 1)):
        window = [(h, -j) for j, h in enumerate(signed[i : i + w], i)]
        j = -min(window)[1]
        if j not in out[-1:]:
            out.append(j)
    return [(hashes[j], j) for j in out]


def test_winnowing(docs, doc_rows, clashing, empty):
    got = {r["doc_id"]: r for r in winnowing.compare_edited(clashing).collect()}
    order = sorted(doc_rows, key=lambda r: -r[0])
    assert len(got) == len(order)

    def near(a, b):
        a, b = {h for h, _ in a}, {h for h, _ in b}
        return len(a & b) / len(a | b) if a | b else 1.0

    for r, after in zip(order, order[1:] + order[:1]):
        text, follow = r[1] or "", after[1] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + follow[:third]
        g = got[r[0]]
        assert g["n_chars"] == len(text) and g["edited"] == edited
        assert [(m["hash"] & (1 << 64) - 1, m["pos"]) for m in g["marks"]] == marks(text)
        assert [(m["hash"] & (1 << 64) - 1, m["pos"]) for m in g["edited_marks"]] == marks(edited)
        assert abs(g["near_edited"] - near(marks(text), marks(edited))) < 1e-12
        assert abs(g["near_next"] - near(marks(text), marks(follow))) < 1e-12
    assert winnowing.compare_edited(empty).count() == 0
    assert winnowing.compare_edited(docs.where("doc_id = 9006")).first()["near_next"] == 1.0


def test_next_of_equal_and_null_ids(spark):
    """An id that holds most rows spans ranges; the order is by id, hash of the text, text, and each row has one next."""
    rows = [(None if i % 3 else 7, f"text {i} " + "x" * i) for i in range(90)] + [(7, "same text of all")] * 20 + [(i, None) for i in range(5)]
    got = winnowing.compare_edited(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    signed = lambda t: (lambda h: h - (1 << 64) if h >> 63 else h)(xxhash.xxh64_intdigest(t.encode(), 42))
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (-(1 << 63) if r[0] is None else r[0], signed(r[1])), reverse=True)
    want = []
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        want.append((i, t[: len(t) - len(t) // 3] + after[: len(t) // 3]))
    assert sorted(((r["doc_id"], r["edited"]) for r in got), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("k", [1, 2, 3, 4, 7, 8])
def test_run_lengths(spark, k):
    texts = [" ".join(random.Random(n).choices(["a", "b", "longer"], k=n)) for n in range(12)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in winnowing.document_marks(rows, k, 3).collect():
        assert [(m["hash"] & (1 << 64) - 1, m["pos"]) for m in r["marks"]] == marks(texts[r["doc_id"]], k, 3)


def test_match_guarantee():
    shared = "one two three four five six seven eight".split()
    a = marks(" ".join(["x%d" % i for i in range(20)] + shared + ["y%d" % i for i in range(9)]))
    b = marks(" ".join(["z%d" % i for i in range(7)] + shared + ["q%d" % i for i in range(30)]))
    assert {h for h, _ in a} & {h for h, _ in b}


def test_queries(spark):
    assert queries.op4_decontamination(spark, SF).where(f"n_items > 0 or items_sha256 = '{hashlib.sha256(b'').hexdigest()}'").count() == 200
    assert queries.op9_license_scan(spark, SF).where("score between 0 and 1").count() == 200
    assert queries.op10_winnowing(spark, SF).where("near_edited between 0 and 1 and length(fingerprint) = 32").count() == 200
