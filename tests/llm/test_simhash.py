import random
from collections import defaultdict

import numpy as np
import xxhash

from palimpsest.llm import simhash


def mark(text, k=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(marks, distance=3):
    """Least index reachable from each."""
    parent = list(range(len(marks)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(marks)):
        for j in range(i):
            if (marks[i] ^ marks[j]).bit_count() <= distance:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(marks))]


def test_against_brute_force(docs, doc_rows, clashing):
    got = {r["doc_id"]: (r["mark"] & (1 << 64) - 1, r["component_id"]) for r in simhash.near_duplicates(clashing).collect()}
    rows = sorted(doc_rows, key=lambda r: r[0])
    marks = [mark(r[1]) for r in rows]
    roots = brute(marks)
    assert len(got) == len(rows)
    for r, m, root in zip(rows, marks, roots):
        assert got[r[0]] == (m, rows[root][0])


def clusters(seed):
    rng, marks = random.Random(seed), []
    for size in (1, 2, 40, 300):
        m = rng.getrandbits(64)
        for _ in range(size):
            marks.append(m)
            for b in rng.sample(range(64), rng.choice([0, 1, 2, 3, 4])):
                m ^= 1 << b
    return [m - (1 << 64) if m >> 63 else m for m in marks]


def reached(spark, marks, distance=3):
    frame = spark.createDataFrame([(m,) for m in set(marks)], "mark long").repartition(3)
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.mark_links(frame, distance)).collect()}
    groups = defaultdict(set)
    for m in set(marks):
        groups[roots.get(m, m)].add(m)
    return {frozenset(g) for g in groups.values()}


def test_links_of_clusters(spark, monkeypatch):
    for seed, distance, split in ((1, 3, 2048), (2, 3, 3), (3, 2, 3), (4, 4, 2048)):
        monkeypatch.setattr(simhash, "SPLIT", split)
        marks = sorted(set(clusters(seed)))
        groups = defaultdict(set)
        for m, root in zip(marks, brute([m & (1 << 64) - 1 for m in marks], distance)):
            groups[root].add(m)
        assert reached(spark, marks, distance) == {frozenset(g) for g in groups.values()}


def test_close_both_ways():
    rng = np.random.default_rng(5)
    for n in (3, 60, 3000):
        base = np.uint64(rng.integers(0, 1 << 63))
        marks = np.unique(base ^ rng.integers(0, 1 << 14, n).astype(np.uint64))
        want = brute(marks.tolist(), 1) if len(marks) < 400 else None
        for distance in (1, 3):
            parent = simhash._close(marks, distance)
            while not np.array_equal(parent, parent[parent]):
                parent = parent[parent]
            if want and distance == 1:
                assert parent.tolist() == want


def test_chain_components(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(300)] + [(1001, 1000), (1000, 1001)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(links).collect()}
    assert all(got[i] == 0 for i in range(1, 301)) and got[1001] == 1000


def shingles(text, k=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def test_keep_one(docs, doc_rows, clashing, empty):
    kept = simhash.keep_one(clashing)
    assert kept.columns == clashing.columns
    left = {r["doc_id"] for r in kept.collect()}
    rows = sorted(doc_rows, key=lambda r: r[0])
    sets = [shingles(r[1]) for r in rows]
    alike = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for i, r in enumerate(rows):
        best = max((alike(sets[i], sets[j]) for j in range(i)), default=0.0)
        if best >= 0.85 or best == 0.0:
            assert (r[0] in left) == (best == 0.0), (r[0], best)
    assert simhash.keep_one(empty).count() == 0 and simhash.near_duplicates(empty).count() == 0


def test_keep_one_of_repeated_ids(spark):
    """Different texts are different documents, whatever their ids; only copies go."""
    rows = [(1, "a b c"), (1, "a b c"), (1, "x y z"), (None, None), (None, ""), (2, "a b c"), (3, "q")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept) == [(0, ""), (1, "a b c"), (1, "x y z"), (3, "q")]


def test_keep_one_beside_clashing_names(spark):
    names = ["hash", "id", "doc", "row_id", "row_hash", "kept", "_hash", "_id", "node", "root", "n"]
    rows = [(1, "a b c", *range(11)), (2, "a b c", *range(11)), (None, "x y z", *range(11))]
    docs = spark.createDataFrame(rows, ["doc_id", "text", *names])
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(tuple(r)[1] for r in kept.collect()) == ["a b c", "x y z"]


def test_edited_copies_are_caught(spark):
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(3000)]
    rows, copies = [], set()
    for i in range(150):
        t = rng.choices(words, k=rng.randint(150, 500))
        rows.append((i, " ".join(t)))
        for c in range(2):
            e = list(t)
            for at in rng.sample(range(len(t)), max(1, len(t) // 100)):
                e[at] = rng.choice(words)
            rows.append((1000 + 10 * i + c, " ".join(e)))
            copies.add(1000 + 10 * i + c)
    left = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert set(range(150)) <= left and len(copies & left) <= 6


def exact_groups(rows, similarity=0.8):
    """Components of distinct texts over all pairs of a Jaccard similarity of at least ``similarity``."""
    texts = sorted({t for _, t in rows})
    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= similarity * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    groups = defaultdict(set)
    for i, t in enumerate(texts):
        groups[find(i)].add(t)
    return {frozenset(g) for g in groups.values()}


def found_groups(spark, rows):
    groups = defaultdict(set)
    text = {i: t for i, t in rows}
    for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect():
        groups[r["component"]].add(text[r["doc_id"]])
    return {frozenset(g) for g in groups.values()}


def edited(rng, t, words, jaccard, block):
    """A copy of ``t`` whose five-word sets are just about as similar as ``jaccard`` or a little more."""
    out, spots = list(t), rng.sample(range(len(t)), len(t))
    at, n = rng.randrange(len(t) // 2), 0
    while True:
        trial = list(out)
        trial[at + n if block else spots[n]] = rng.choice(words)
        x, y = shingles(" ".join(t)), shingles(" ".join(trial))
        if len(x & y) < jaccard * len(x | y):
            return out
        out, n = trial, n + 1


def test_every_pair_of_the_similarity_is_linked(spark):
    """Recall 1 at 0.80, 0.85 and 0.90, for edits in one block and scattered ones."""
    rng = random.Random(21)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(5000)]
    rows, pairs = [], []
    for kind in range(6):
        for _ in range(12):
            t = rng.choices(words, k=rng.randint(40, 260))
            i = len(rows)
            rows += [(i, " ".join(t)), (i + 1, " ".join(edited(rng, t, words, (0.8, 0.85, 0.9)[kind // 2], kind % 2 == 0)))]
            pairs.append((i, i + 1))
    of = {r["doc_id"]: r["component"] for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert [p for p in pairs if of[p[0]] != of[p[1]]] == [] and len(set(of.values())) == len(pairs)


def test_large_groups_of_edited_copies(spark):
    """Chains, and copies alike to their source but not to each other, beside a line that all texts share."""
    rng = random.Random(22)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(3000)]
    line, rows = "this very common line stands at the end of each text here", []
    for _ in range(3):
        t = rng.choices(words, k=150)
        texts, last = [t], t
        for n in range(25):
            last = edited(rng, last, words, 0.8, n % 2 == 0)
            texts += [last, edited(rng, t, words, 0.8, n % 2 == 0)]
        rows += [(len(rows) + k, " ".join(x) + " " + line) for k, x in enumerate(texts)]
    rows += [(len(rows) + k, " ".join(rng.choices(words, k=rng.randint(1, 60))) + " " + line) for k in range(60)]
    assert found_groups(spark, rows) == exact_groups(rows)


def test_threshold_is_exact(spark):
    """Short texts under and at 0.8, long ones just under it: 80 of 101 and 80 of 100 shingles, 720 of 1000 and so on."""
    rng = random.Random(23)
    rows, word = [], lambda: "".join(rng.choices("abcdefghij", k=9))
    want = {}
    for both, more in [(80, 20), (80, 21), (40, 10), (40, 11), (4, 1), (3, 1), (800, 200), (790, 210), (780, 220)] * 3:
        start = [word() for _ in range(both + 4)]
        i = len(rows)
        rows += [(i, " ".join(start)), (i + 1, " ".join(start + [word() for _ in range(more)]))]
        want[i] = both >= 0.8 * (both + more)
    of = {r["doc_id"]: r["component"] for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert {i: of[i] == of[i + 1] for i in want} == want


def test_texts_without_ids_are_kept(spark):
    rows = [(None, f"text number {i} of those without an id at all") for i in range(20)] * 2 + [(5, "text number 3 of those without an id at all"), (6, "q r s")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(r["text"] for r in kept) == sorted({t for _, t in rows})
    assert {r["doc_id"] for r in kept if "number 3 " in r["text"] or r["text"] == "q r s"} == {5, 6}
