"""Chunks against plain loops over strings."""

import random
import re
import time

import pyarrow.parquet as pq
import pytest

from palimpsest.operators import chunking as C


def article_loop(text, target, most, boundary):
    if len(text) <= most:
        return [text]
    pieces = []
    for line in text.split("\n"):
        if not line.strip():
            continue
        if pieces and not re.search(boundary, line):
            pieces[-1] += "\n" + line
        else:
            pieces.append(line)
    fine = []
    for p in pieces:
        if len(p) <= most:
            fine.append(p)
            continue
        held = ""
        for s in filter(None, re.split(C.SENTENCE_END, p)):
            if held and len(held) + 1 + len(s) > most:
                fine.append(held)
                held = ""
            held = f"{held}\n{s}".strip() if held else s
        fine += [held] if held else []
    packs = []
    for p in fine:
        if packs and len(packs[-1]) < target and len(packs[-1]) + 1 + len(p) <= most:
            packs[-1] += "\n" + p
        else:
            packs.append(p)
    return packs


def cut_loop(text, marks, least, most):
    text, out = text.strip(), []
    while len(text) > most:
        at = max(text.rfind(m, skip, most) for m, skip in marks)
        at = most if at < least else at
        out.append(text[:at].strip())
        text = text[at:].strip()
    return out + [text]


def manual_loop(text, least, most, head_like=C.MANUAL_HEAD):
    sections = []
    for line in (x.strip() for x in text.split("\n")):
        if not line:
            continue
        head = bool((re.search(head_like, line) and len(line) <= 60) or re.search(C.MANUAL_CASE, line))
        if not sections or (head and len("\n".join(sections[-1][1])) >= least):
            sections.append((line if head else "", [] if head else [line]))
        else:
            sections[-1][1].append(line)
    return [(t, p) for t, b in sections for p in cut_loop("\n".join(b), (("\n", 0),), least, most) if t or p]


def ad_loop(text, least=25, most=600):
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    parts = []
    for x in lines:
        if parts and not (re.search(C.AD_HEAD, x) or re.search(C.AD_LABEL, x)):
            parts[-1] += "\n" + x
        else:
            parts.append(x)
    merged = []
    for p in parts:
        if merged and len(p) < least:
            merged[-1] += "\n" + p
        else:
            merged.append(p)
    return [q for p in merged for q in cut_loop(p, ((". ", 0), ("※", 1), ("\n", 0)), least, most) if len(q) >= 10]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(11)
    heads = ["① 첫", "1. 둘", "가. 셋", "(3) 넷", "Ⅰ. 목적", "제2장 총칙", "[사례] 하나", "□ 혜택", "대출대상", "- 주의", "  들여쓴", "word"]
    out = [None, "", "  \n ", "one", "x" * 4000, "가나다. " * 900, ("긴 문장입니다。 " * 40 + "\n") * 8]
    for _ in range(60):
        lines = [r.choice(heads) + " " + "".join(r.choice(["가나", "다.", " ", "※", "글자", ". ", "」 ", "\t"]) for _ in range(r.choice([0, 3, 30, 300, 900]))) for _ in range(r.randint(1, 25))]
        out.append("\n".join(lines))
    return out + [t["text"] for t in pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()]


def test_article_chunks(spark, texts):
    rows = [(f"r{i % 7}", i, f"k{i % 3}", "t" if i % 2 else None, t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "reg string, seq int, key string, title string, text string").repartition(3)
    got = {}
    for r in C.article_chunks(frame, 300, 500).collect():
        got.setdefault(r["seq"], []).append(r)
    nth = {}
    for reg, seq, key, title, text in rows:
        if not text:
            assert seq not in got
            continue
        nth[reg, key] = nth.get((reg, key), 0) + 1
        want = article_loop(text, 300, 500, C.PARAGRAPH)
        mine = sorted(got.get(seq, []), key=lambda r: r["part"])
        head = f"[{reg}] {key}" + (f"({title})" if title else "")
        assert [r["chunk"] for r in mine] == [head + (f" ({n}/{len(want)})" if len(want) > 1 else "") + "\n" + p for n, p in enumerate(want, 1)]
        assert [r["id"] for r in mine] == [f"{reg}#{key}" + (f"@{nth[reg, key]}" if nth[reg, key] > 1 else "") + f"#{n}" for n in range(1, len(want) + 1)]
        assert all(r["chars"] == len(r["chunk"]) for r in mine)


def test_manuals_and_ads(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    manual, ads = {}, {}
    for r in C.manual_sections(frame, "id", least=40, most=200).orderBy("seq").collect():
        manual.setdefault(r["doc"], []).append((r["title"], r["body"]))
    for r in C.ad_pieces(frame, "id", most=120).orderBy("seq").collect():
        ads.setdefault(r["doc"], []).append(r["piece"])
    for i, t in enumerate(texts):
        assert manual.get(i, []) == manual_loop(t or "", 40, 200)
        assert ads.get(i, []) == ad_loop(t or "", most=120)


def test_queries_on_whole_tables(spark):
    from palimpsest.plans import section_queries as Q

    sf = "/root/testdata/sf0.001"
    docs = pq.read_table(f"{sf}/documents.parquet").to_pylist()
    sizes = {}
    for r in Q.article_chunks(spark, sf).orderBy("seq", "part").collect():
        sizes.setdefault(r["seq"], []).append(r["chars"])
    for d in docs:
        want = article_loop(d["text"], C.TARGET, C.MAXIMUM, C.PARAGRAPH)
        head = len(f"[{d['source']}] {d['lang']}") + 1
        assert sizes[d["doc_id"]] == [head + len(p) + (len(f" ({n}/{len(want)})") if len(want) > 1 else 0) for n, p in enumerate(want, 1)]
    pieces = {}
    for r in Q.ad_pieces(spark, sf).orderBy("seq").collect():
        pieces.setdefault(r["doc"], []).append(r["piece"])
    for t in pq.read_table(f"{sf}/conversations.parquet").to_pylist():
        assert pieces.get(f"{t['conv_id']}-{t['turn']}", []) == ad_loop(t["text"])
    manual = {}
    for r in Q.manual_sections(spark, sf).orderBy("seq").collect():
        manual.setdefault(r["doc"], []).append((r["title"], r["body"]))
    for d in docs:
        assert manual[d["doc_id"]] == manual_loop(d["text"], 120, C.MAXIMUM, "^[A-Z]")


def test_long_texts_take_linear_time(spark):
    def took(n):
        frame = spark.createDataFrame([("r", 1, "k", None, "① 글자 글자 글자. 문장입니다.\n" * n)], "reg string, seq int, key string, title string, text string")
        began = time.perf_counter()
        chunks = C.article_chunks(frame).count() + C.manual_sections(frame, "seq").count() + C.ad_pieces(frame, "seq").count()
        return time.perf_counter() - began, chunks

    took(100)
    short, long_ = took(10_000), took(100_000)  # the second: 2.5 million characters
    assert long_[1] > 9 * short[1] and long_[0] < 20 * max(short[0], 1)
