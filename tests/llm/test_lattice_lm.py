import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import lattice_lm as lm
from palimpsest.llm.queries import PIECES, vocabulary_path


def cuts(word):
    if not word:
        yield []
    for n in range(1, len(word) + 1):
        for rest in cuts(word[n:]):
            yield [word[:n], *rest]


def test_forward_sums_all_cuts():
    rng = np.random.default_rng(2)
    weights = np.log(rng.dirichlet(np.ones(256 + 4 + 1)))
    pieces = lm.Pieces([b"ab", b"abc", b"ca", b"bcabcabc"], weights)
    p = dict(zip(pieces.pieces, np.exp(weights)))
    words = [b"", b"a", b"abc", b"abcab", b"bcabcabca", "é".encode()]
    got = pieces.log_words(words, [weights, weights - 1])
    for i, w in enumerate(words):
        want = sum(math.prod(p.get(x, 0.0) for x in c) for c in cuts(w)) * math.exp(weights[-1])
        assert math.isclose(math.exp(got[i, 0]), want, rel_tol=1e-9)


def test_expected_uses():
    pieces = lm.Pieces([b"ab", b"ba"])
    letters = np.frombuffer(b"abab", np.uint8).reshape(1, 4).astype(np.uint64)
    p = dict(zip(pieces.pieces, np.exp(pieces.weights)))
    all_cuts = [(c, math.prod(p.get(x, 0.0) for x in c)) for c in cuts(b"abab")]
    total = sum(q for _, q in all_cuts)
    got = pieces.expected(letters, np.ones(1))
    for i, piece in enumerate(pieces.pieces):
        assert math.isclose(got[i], sum(q * c.count(piece) for c, q in all_cuts) / total, abs_tol=1e-12)


def test_split_word():
    for w in (b"", b"a", b"(ab).", b"...", b"a.b", "«é»".encode(), b"'"):
        core, key = lm.split_word(w)
        before, after = key[1:].split(b"\0")
        assert before + core + after == w


def test_probabilities_sum_to_one_at_most(spark):
    """All texts of one or no word over a small alphabet: their mass is below one, and most of it for common ones."""
    docs = [(i, t, "en") for i, t in enumerate(["a b", "ab a", "ba", "a.", "b b b", "(ab)"])]
    words = ["".join(x) for n in range(1, 5) for x in np.array(np.meshgrid(*[list("ab.")] * n)).T.reshape(-1, n).tolist()]
    ask = docs + [(100 + i, w, None) for i, w in enumerate(["", *words])]
    frame = spark.createDataFrame(ask, "doc_id long, text string, lang string")
    got = lm.score_documents(frame, F.col("doc_id") < 100, [b"ab", b"ba"]).where("doc_id >= 100").collect()
    mass = sum(10 ** r["score"] for r in got)
    assert len(got) == len(words) + 1 and 0.2 < mass <= 1


def crc(doc_id, m):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % m


@pytest.mark.parametrize("frequent", [100_000, 50])
def test_base_against_brute_force(spark, docs, doc_rows, clashing, monkeypatch, frequent):
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    pieces = lm.sentencepiece_vocabulary(vocabulary_path(PIECES))
    got = {r["doc_id"]: r for r in lm.score_documents(clashing, lm.learned_from(), pieces).collect()}
    tokens = {r[0]: [*(r[1] or "").encode().lower().split(), None] for r in doc_rows}
    counts = Counter(t for r in doc_rows if crc(r[0], 7) != 2 for t in tokens[r[0]])
    n, v = sum(counts.values()), len(counts)
    assert len(got) == len(doc_rows)
    for doc_id, words in tokens.items():
        r = got[doc_id]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words), sum(w in counts for w in words), n)
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words), rel_tol=1e-9)
        assert r["score"] < 0
    if frequent == 50:
        monkeypatch.setattr(lm, "FREQUENT", 100_000)
        again = {r["doc_id"]: r["score"] for r in lm.score_documents(docs, lm.learned_from(), pieces).collect()}
        assert all(math.isclose(again[d], got[d]["score"], rel_tol=1e-9) for d in again)


def test_no_rows_and_no_training(spark, docs, empty):
    assert lm.score_documents(empty, lm.learned_from(), [b"ab"]).count() == 0
    rows = lm.score_documents(docs.where("doc_id >= 9001"), F.lit(False), [b"ab"]).collect()
    assert len(rows) == 10 and all(r["n_known"] == 0 and r["train_tokens"] == 0 and r["score"] < 0 for r in rows)
    twice = spark.createDataFrame([(1, "a b", "en"), (1, "a b", "en"), (None, None, None)], "doc_id long, text string, lang string")
    assert sorted(r["n_tokens"] for r in lm.score_documents(twice, F.lit(True), [b"ab"]).collect()) == [1, 3, 3]


def by_hand(texts, ask, vocabulary):
    """Scores from plain loops over every cut of every core: the prior, two rounds of expected uses, discounted counts."""
    names = lm.Pieces(vocabulary).pieces
    prior = np.exp(lm.Pieces(vocabulary).weights)
    parts = [lm.split_word(w) for t in texts for w in lm.words_of(t)]
    cores = Counter(c for c, _ in parts)
    cores[lm.END] = len(texts)
    shapes = Counter(s for _, s in parts)
    p = prior
    for _ in range(lm.ROUNDS):
        of, n = dict(zip(names, p)), Counter()
        for core in cores:
            if core in (b"", lm.END):
                continue
            found = [(c, math.prod(of.get(x, 0.0) for x in c)) for c in cuts(core)]
            total = sum(q for _, q in found)
            for c, q in found:
                for x in c:
                    if q:
                        n[x] += q / total
            n[None] += 1
        p = lm.PRIOR * prior + np.array([*[n[x] for x in names], n[None]])
        p = p / p.sum()
    of, end = dict(zip(names, p)), p[-1]

    def share(counts, word, unseen):
        once, twice = (sum(c == k for c in counts.values()) for k in (1, 2))
        d = min(0.95, max(0.05, once / max(once + 2 * twice, 1)))
        total = sum(counts.values())
        return max(counts[word] - d, 0) / total + d * len(counts) / total * unseen

    v = len(cores)
    out = []
    for t in ask:
        score, had = 0.0, Counter()
        for n, w in enumerate([*lm.words_of(t), None]):
            core, shape = lm.split_word(w) if w else (lm.END, None)
            lattice = 1 / (v + 1) if not w else sum(math.prod(of.get(x, 0.0) for x in c) for c in cuts(core)) * end * v / (v + 1)
            chances = [(core, share(cores, core, lattice))]
            if w:
                chances.append((shape, share(shapes, shape, 257.0 ** -len(shape))))
            for part, p in chances:
                score += math.log10((had[part] + lm.OWN * p) / (n + lm.OWN))
                had[part] += 1
        out.append(score)
    return out


@pytest.mark.parametrize("frequent", [100_000, 3])
def test_score_is_the_sum_over_all_cuts(spark, monkeypatch, frequent):
    """Pieces of three to ten bytes with scores of their own, words seen and not, punctuation seen and not."""
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    vocabulary = {b"ab": 0.2, b"abc": 0.1, b"cabcabcabc": 0.05, b"ca": 0.3, b"bcabcabca": 0.02}
    texts = ["abc ab, abc", "cabcabcabc (ab)", "b c! abcab", "ab"]
    ask = ["", "abc", "ab!", "xcabcabcabcx ...", "zz-z (ab) bcabcabca", "(b), c! c!", "ab " * 40 + "q " * 9]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(100 + i, t) for i, t in enumerate(ask)], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in lm.score_documents(frame, F.col("doc_id") < 100, vocabulary).collect()}
    for i, want in enumerate(by_hand(texts, ask, vocabulary)):
        assert math.isclose(got[100 + i], want, rel_tol=1e-9), ask[i]


def test_scores_of_the_vocabulary_order_its_pieces():
    pieces = lm.sentencepiece_vocabulary(vocabulary_path(PIECES))
    assert max(map(len, pieces)) > 8 and pieces[b"the"] > pieces[b"international"] > 0


def test_training_helps_held_out_rows(docs):
    """Against the vocabulary's own scores alone."""
    pieces = lm.sentencepiece_vocabulary(vocabulary_path(PIECES))
    held = lambda train: sum(r["score"] for r in lm.score_documents(docs, train, pieces).collect() if crc(r["doc_id"], 7) == 2)
    assert held(lm.learned_from()) > 0.75 * held(F.lit(False))
