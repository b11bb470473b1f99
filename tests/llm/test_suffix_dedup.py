import hashlib
import random

import numpy as np
import pytest

from palimpsest.llm import suffix_dedup as sd


def brute(rows, length=100):
    """rows: (doc_id, text), in order."""
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            s = raw[i : i + length]
            if s in seen:
                gone[i : i + length] = True
            seen.add(s)
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        spans = int(np.sum(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        out.append((doc_id, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(frame):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept_sha256"]) for r in frame.collect()), key=str)


def near_copies(seed, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefgh é", k=rng.randint(1, 9))) for _ in range(300)]
    base = [" ".join(rng.choices(words, k=120)) for _ in range(5)]
    passage, line = " ".join(rng.choices(words, k=40)), "a very common line of text, of less than the length. "
    rows = []
    for i in range(n):
        t = rng.choice(base) if rng.random() < 0.6 else " ".join(rng.choices(words, k=rng.randint(1, 150)))
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(t) + 1)
            t = t[:at] + rng.choice(["x", "", passage, line, t[:130], "=" * 250, "ab" * 90]) + t[at + rng.randint(0, 5) :]
        rows.append((i * 7 % 101, t))
    return rows + [(1000, None), (1001, ""), (1002, "a" * 99), (1003, "a" * 100), (1004, "a" * 101), (1005, "b" * 3000)]


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(3)
    texts = [rng.integers(97, 97 + k, n).astype(np.uint8) for k in (1, 2, 26) for n in (1, 5, 8, 9, 300, 1000)]
    texts += [np.frombuffer(b"\0" * 40, np.uint8), np.frombuffer(b"ab\0\0\0ab\0\0" * 9, np.uint8), np.frombuffer(b"abcdefgh" * 50, np.uint8)]
    for t in texts:
        order, rank = sd.suffix_array(t)
        raw = t.tobytes()
        assert order.tolist() == sorted(range(len(t)), key=lambda i: raw[i:])
        assert (order[rank] == np.arange(len(t))).all()
        for chunk in (7, 256):
            shared = sd.common_prefixes(t, order, rank, 100, chunk)
            for r in range(1, len(t)):
                a, b = raw[order[r - 1] :], raw[order[r] :]
                n = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
                assert shared[r] == min(n, 100)


def test_runs_cover_every_start():
    rng = np.random.default_rng(1)
    sizes = [0, 50, 100, 101, 900, 99, 400]
    data = rng.integers(97, 100, sum(sizes)).astype(np.uint8)
    h, text, start, n, _ = sd.runs(data, np.cumsum(sizes))
    starts = {(t, s + i) for t, s, k in zip(text.tolist(), start.tolist(), n.tolist()) for i in range(k)}
    assert starts == {(t, s) for t, size in enumerate(sizes) for s in range(size - 99)} and int(n.sum()) == len(starts)


@pytest.mark.parametrize(("piece", "shard"), [(16_384, 2 << 20), (4, 2000)])
def test_against_brute_force(spark, monkeypatch, piece, shard):
    monkeypatch.setattr(sd, "PIECE", piece)
    monkeypatch.setattr(sd, "SHARD_BYTES", shard)
    rows = near_copies(piece)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(sd.remove_repeats(frame)) == brute(rows)


def test_documents(docs, doc_rows, clashing):
    assert got(sd.remove_repeats(clashing)) == brute([(r[0], r[1]) for r in doc_rows if r[0] is not None])


def test_repeated_and_null_ids(spark, empty):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(1, text), (1, text), (None, text), (None, None), (2, "x" + text), (2, "y" + text)]
    out = {(r["doc_id"], r["n_bytes"]): [] for r in ()}
    for r in sd.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        out.setdefault(r["doc_id"], []).append((r["n_bytes"], r["n_removed"]))
    n = len(text)
    assert sorted(out[None]) == [(0, 0), (n, 0)] and out[1] == [(n, n), (n, n)] and sorted(out[2]) == [(n + 1, n), (n + 1, n)]
    assert sd.remove_repeats(empty).count() == 0


def test_lone_repeats_of_every_period(spark):
    rng = random.Random(17)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    text = lambda n: "".join(rng.choices(letters, k=n))
    rows = []
    for period in range(1, 141):
        for more in (-1, 0, 1, 150):
            around = text(rng.randint(0, 200))
            rows.append((len(rows), around + (text(period) * 400)[: 100 + period + more] + around[: rng.randint(0, 90)]))
    assert got(sd.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))) == brute(rows)


def segments_seen(spark, monkeypatch, rows):
    """What ``remove_repeats`` gives, and how many segments came to its shards."""
    seen, shards = spark.sparkContext.accumulator(0), sd._shards

    def counted(length):
        inner = shards(length)

        def run(batches):
            def passing():
                for batch in batches:
                    seen.add(batch.num_rows)
                    yield batch

            yield from inner(passing())

        return run

    with monkeypatch.context() as patch:
        patch.setattr(sd, "_shards", counted)
        out = got(sd.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)))
    return out, seen.value


def test_shards_are_made_once(spark, monkeypatch):
    rows = near_copies(5)
    whole, once = segments_seen(spark, monkeypatch, rows)
    monkeypatch.setattr(sd, "PIECE", 4)
    pieces, again = segments_seen(spark, monkeypatch, rows)
    assert pieces == whole == brute(rows) and again == once > 0


def test_copies_make_no_segments(spark, monkeypatch):
    rows = list({r[0]: r for r in near_copies(9)}.values()) + [(2000, "a short text"), (2001, "é" * 50)]
    rows = list({r[1]: r for r in rows}.values())
    copies = [(5000 * k + (r[0] or 0), r[1]) for k in range(5) for r in rows] + [(None, rows[3][1])]
    _, once = segments_seen(spark, monkeypatch, rows)
    out, five = segments_seen(spark, monkeypatch, copies)
    assert out == brute(copies) and 0 < five < 1.1 * once  # which texts lie side by side may add a lone segment
