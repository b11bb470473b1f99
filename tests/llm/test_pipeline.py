"""The stages of the pipeline, each on what the one before it kept, against plain loops."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from palimpsest.llm.license_scan import words_of

from .conftest import SCHEMA, SF, rows_of

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows after each stage, by its name; the input is that of the driver, with copies planted."""
    rows = [tuple(r[c] for c in COLUMNS) for r in rows_of("documents")]
    first = next(r for r in rows if r[1] and len(r[1].split()) > 60)
    words = first[1].split()
    near = " ".join([*words[:-1], "otherwise"])
    leak = "quite unlike all other rows here " + rows_of("benchmark")[0]["text"] + " and on it goes"
    planted = [(800_001, first[1], "en", "s1", 1), (800_002, near, "en", "s1", 1), (800_003, leak, "en", "s1", 1), (None, "a row without an id", None, None, None), (800_004, None, None, None, None)]
    docs = spark.createDataFrame(rows + planted, SCHEMA)
    out = {"input": [*rows, *planted]}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out[name] = [tuple(r) for r in docs.collect()]
        if name != "tokens":
            assert docs.columns == COLUMNS
    return out


def test_toxic_rows_go_and_clean_ones_stay(stages):
    toxic = {r["doc_id"]: r["toxic"] for r in rows_of("labels")}
    kept = {r[0] for r in stages["toxicity"]}
    clean = [d for d, t in toxic.items() if t == 0]
    assert sum(d in kept for d in clean) >= 0.97 * len(clean)
    assert not set(stages["toxicity"]) - set(stages["input"])


def test_one_of_each_group_of_copies_stays(stages):
    before, after = stages["toxicity"], stages["near_duplicates"]
    texts = Counter(r[1] for r in after)
    assert all(n == 1 for n in texts.values())
    assert not set(after) - set(before)
    assert not {800_001, 800_002} & {r[0] for r in after}
    grams = lambda t: {tuple(w[i : i + 5]) for w in [(t or "").lower().split()] for i in range(max(1, len(w) - 4))}
    kept = [grams(r[1]) for r in after]
    gone = [grams(r[1]) for r in before if r[0] not in {x[0] for x in after}]
    # what went is like something that stayed, if only by links between copies
    assert all(max((len(g & k) / len(g | k) for k in kept), default=0) > 0.5 for g in gone)


def test_leaks_go_and_only_they(stages):
    windows = set()
    for item in rows_of("benchmark"):
        w = words_of(item["text"] or "")
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in windows}

    def leaks(text):
        w = words_of(text or "")
        return any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))

    want = [r for r in stages["near_duplicates"] if not leaks(r[1])]
    assert Counter(want) == Counter(stages["decontamination"])
    assert 800_003 not in {r[0] for r in stages["decontamination"]}


def test_mix_repeats_rows_at_most_three_times_and_keeps_the_size(stages):
    size = lambda r: len((r[1] or "").encode().split())
    before, after = Counter(stages["decontamination"]), Counter(stages["mixing"])
    assert all(n <= 3 * before[r] for r, n in after.items())
    total, taken = (sum(size(r) * n for r, n in c.items()) for c in (before, after))
    longest = max(map(size, before))
    sources = {r[3] for r in before}
    assert abs(taken - total) <= longest * len(sources)


def test_token_rows_follow_each_other(stages):
    from tokenizers import Tokenizer

    from palimpsest.llm.queries import END_ID, vocabulary_path

    whole = Tokenizer.from_file(vocabulary_path())
    docs = sorted(stages["mixing"], key=lambda r: (r[0] is not None, r[0], r[1] or ""))
    rows = sorted(stages["tokens"], key=lambda r: r[1])
    assert len(docs) == len(rows)
    at = 0
    for doc, row in zip(docs, rows):
        ids = np.array([*whole.encode(doc[1] or "", add_special_tokens=False).ids, END_ID], "<u4")
        assert row == (doc[0], at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
