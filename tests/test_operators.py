"""Golden cases of the operators that SQL does not hold: gates, polls, diffs, texts, sources and sinks."""

from __future__ import annotations

import datetime
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators import matching as M
from palimpsest.operators import retrieval as R
from palimpsest.operators import review as V
from palimpsest.operators import sections as S
from palimpsest.operators import text_diff as D
from palimpsest.operators import versions as W
from palimpsest.plans.version_queries import search_text
from palimpsest.sources import readers, writers
from palimpsest.streaming import detect


def one(spark, column, row=(None,), schema="x string"):
    return spark.createDataFrame([row], schema).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("old", "new", "held"),
    [(None, 0, False), (None, 50, False), (2, 1, False), (3, 0, False), (50, 0, True), (4, 0, True), (50, 20, True), (50, 24, True), (50, 26, False), (50, 49, False), (50, 93, False)],
)
def test_collapse_gate(spark, old, new, held):
    assert one(spark, W.collapsed(F.col("a"), F.col("b")), (old, new), "a int, b int") is held


def test_polls_are_classified_and_blocked_ones_keep_their_state(spark):
    state = [("same", "k1", "h1", 10), ("key", "k1", "h1", 10), ("hash", "k1", "h1", 10), ("noted", "k1", None, 10), ("fell", "k1", "h1", 10), ("bad", "k1", "h1", 10), ("gone", "k1", "h1", 10)]
    polls = [("first", "k1", "h1", 5, None), ("same", "k1", "h1", 10, None), ("key", "k2", "h1", 10, None), ("hash", "k1", "h2", 10, None), ("noted", "k1", "h9", 10, None), ("fell", "k2", "h2", 3, None), ("bad", "k2", None, None, "timeout"), ("gone", None, None, None, None)]
    rows = W.classify_polls(spark.createDataFrame(polls, "name string, key string, hash string, sections int, error string"), spark.createDataFrame(state, "name string, key string, hash string, sections int"))
    got = {r["name"]: (r["status"], r["advance"]) for r in rows.collect()}
    assert got == {"first": ("new", True), "same": ("same", False), "key": ("changed", True), "hash": ("changed", True), "noted": ("same", True), "fell": ("blocked", False), "bad": ("error", False), "gone": ("not_found", False)}


def test_section_diff_counts_one_of_each(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("n", None)], "key string, content string")
    new = spark.createDataFrame([("a", "1"), ("b", "two"), ("d", "4"), ("n", None)], "key string, content string")
    diff = W.section_diff(old, new, ["key"])
    assert {(r["key"], r["change_type"]) for r in diff.collect()} == {("b", "modified"), ("c", "removed"), ("d", "added")}
    assert W.diff_summary(diff.withColumn("g", F.lit(1)), ["g"]).first()["summary"] == "added 1 · removed 1 · modified 1"


def test_current_version_is_one_and_history_stays(spark):
    rows = W.with_current(spark.createDataFrame([(1, 1), (1, 2), (2, 3)], "owner int, version int"), "owner", [F.desc("version")])
    assert {(r["version"], r["is_current"]) for r in rows.collect()} == {(1, False), (2, True), (3, True)}


def test_insert_if_absent_never_matches_nulls(spark):
    old = spark.createDataFrame([("a", "1"), (None, "1")], "k string, v string")
    new = spark.createDataFrame([("a", "2"), ("b", "2"), ("b", "1"), (None, "2"), (None, "3")], "k string, v string")
    got = W.insert_if_absent(old, new, ["k"], [F.col("v")])
    assert sorted((r["k"] or "", r["v"]) for r in got.collect()) == [("", "2"), ("", "3"), ("b", "1")]


def test_unread_failures_are_not_told_twice(spark):
    failures = spark.createDataFrame([("p", "t1"), ("p", "t1"), ("p", "t2")], "profile string, title string")
    unread = spark.createDataFrame([("p", "t2")], "profile string, title string")
    assert [r["title"] for r in W.unread_once(failures, unread, ["profile", "title"]).collect()] == ["t1"]


def test_inline_segments_absorb_short_equal_runs_and_give_both_texts_back():
    draw = random.Random(7)
    for _ in range(200):
        old = "".join(draw.choice("ab ") for _ in range(draw.randrange(30)))
        new = "".join(draw.choice("ab ") for _ in range(draw.randrange(30)))
        parts = D.inline_segments(old, new)
        assert "".join(p[1] for p in parts) == old
        assert "".join(p[2] for p in parts) == new
        assert all((p[0] == "equal") == (p[1] == p[2]) or p[0] != "equal" for p in parts)
    assert D.inline_segments("within 30 days of notice", "within 45 days of notice") == [("equal", "within ", "within "), ("replace", "30", "45"), ("equal", " days of notice", " days of notice")]


def test_lines_are_paired_with_the_most_alike():
    assert D.paired_lines(["alpha beta", "x"], ["alpha beta!", "completely other"]) == [("alpha beta", "alpha beta!"), ("x", None), (None, "completely other")]
    assert D.paired_lines(["same"], ["same"]) == []


def test_line_breaks_can_be_taken_out_again(spark):
    text = "One ends. Two begins! 3 follows? no. Yes."
    broken = one(spark, D.with_line_breaks(F.col("x")), (text,))
    assert broken.count("\n") == 3
    assert broken.replace("\n", "") == text


def test_sections_number_what_is_present_and_tell_equal_keys_apart(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, ""), (1, 3, "a"), (1, 4, "b")], "doc int, pos int, line string")
    out = S.unique_keys(S.numbered(rows, F.col("line") != ""), "line")
    assert [(r["seq"], r["section_key"]) for r in out.orderBy("pos").collect()] == [(1, "a"), (2, "a#2"), (3, "b")]


def test_headings_must_rise(spark):
    got = one(spark, S.rising_only(F.col("x"), lambda v: v), ([1, 2, 1, 5, 3, 6],), "x array<bigint>")
    assert got == [1, 2, 5, 6]


def test_chunks_keep_every_piece(spark):
    lines = [f"line {i} " + "word " * (i % 40) + "end." for i in range(60)]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, "short"), (3, ""), (4, None)], "doc_id int, text string")
    rows = S.chunks(docs, "doc_id").orderBy("doc", "part").collect()
    mine = [r for r in rows if r["doc"] == 1]
    assert "\n".join(r["chunk"] for r in mine) == "\n".join(lines)
    assert all(r["chars"] <= 800 and r["parts"] == len(mine) for r in mine)
    assert [(r["chunk"], r["parts"]) for r in rows if r["doc"] == 2] == [("short", 1)]


def test_percentiles_take_the_place_of_bankers_rounding(spark):
    rows = spark.createDataFrame([(v,) for v in (10, 20, 30, 40)], "v int")
    got = {r["p"]: r["value"] for r in S.index_percentiles(rows, "v", (0, 50, 90, 100)).collect()}
    values = [10, 20, 30, 40]
    assert got == {p: values[round(3 * p / 100)] for p in (0, 50, 90, 100)}


def test_korean_tokens(spark):
    got = one(spark, T.korean_tokens(F.col("x")), ("제12조의3 별표 5 개인정보 ABC",))
    assert got == ["조12의3", "조12", "별표", "별표5", "별표0005", "abc", "개인", "인정", "정보"]
    assert one(spark, T.korean_tokens(F.col("x")), ("가",)) == ["가"]
    assert one(spark, T.korean_tokens(F.col("x")), ("제 4-11 조 [별표 0005] 규정 첨부",)) == ["조4-11", "조4", "별표", "별표5", "별표0005", "첨부", "규정"]


def test_names_strip_and_dates(spark):
    assert one(spark, T.name_key(F.col("x")), ("전자 금융·거래법 (시행령)",)) == "전자금융거래법시행령"
    assert one(spark, T.unicode_strip(F.col("x")), ("　 a b \n",)) == "a b"
    assert one(spark, T.iso_date(F.col("x")), ("20260102",)) == "2026-01-02"
    assert one(spark, T.iso_date(F.col("x")), ("2026",)) is None
    assert one(spark, T.lines(F.col("x")), ("a\r\nb c\n",)) == ["a", "b", "c"]
    assert one(spark, T.version_key(F.col("x"), F.lit("d"), F.lit(None).cast("string"))) == "|d|"


def test_hash_tells_white_space_apart(spark):
    rows = spark.createDataFrame([("a  b",), ("a\nb",), (None,)], "x string").select(T.canonical_hash(F.col("x")).alias("h"))
    assert len({r["h"] for r in rows.collect()}) == 3


def test_search_wants_two_characters_and_shows_the_match(spark):
    docs = spark.createDataFrame([(1, "x" * 100 + "Needle" + "y" * 300), (2, "needle"), (3, None)], "doc_id int, text string")
    got = {r["doc_id"]: r for r in search_text(docs, "needle").collect()}
    assert set(got) == {1, 2}
    assert got[2]["match_pos"] == 1
    assert got[1]["match_pos"] == 0  # another case
    with pytest.raises(ValueError, match="two characters"):
        search_text(docs, "n")


def test_longest_sibling_wins_a_name(spark):
    names = spark.createDataFrame([("law",), ("law decree",), ("act",)], "name string")
    found = spark.createDataFrame([("banking law",), ("banking law decree",), ("act",), ("act two",)], "candidate string")
    got = {r["name"]: r["candidate"] for r in M.pick_names(names, found).collect()}
    assert got == {"law": "banking law", "law decree": "banking law decree", "act": "act"}


def test_exact_reference_before_prefix(spark):
    refs = spark.createDataFrame([("art1",), ("art2",)], "ref string")
    corpus = spark.createDataFrame([("art1",), ("art1-2",), ("art2-1",), ("art2-2",)], "key string")
    got = sorted((r["ref"], r["key"], r["how"]) for r in M.exact_else_prefix(refs, "ref", corpus, "key").collect())
    assert got == [("art1", "art1", "exact"), ("art2", "art2-1", "prefix"), ("art2", "art2-2", "prefix")]


def test_quota_fills_up_from_the_rest(spark):
    ranked = spark.createDataFrame([(1, d, d, d > 4) for d in range(1, 8)], "query int, doc int, rnk int, is_rule boolean")
    assert [r["doc"] for r in R.quota(ranked, 5).orderBy("pos").collect()] == [1, 2, 5, 6, 7]
    none = spark.createDataFrame([(1, d, d, False) for d in range(1, 8)], "query int, doc int, rnk int, is_rule boolean")
    assert [r["doc"] for r in R.quota(none, 5).orderBy("pos").collect()] == [1, 2, 3, 4, 5]


@pytest.mark.parametrize("rows", [2_000_000, 3])
def test_bm25_of_broadcast_and_of_joined_queries(spark, monkeypatch, rows):
    monkeypatch.setattr(R, "ASKED_ROWS", rows)
    docs = [(1, "a b c"), (2, "a a b"), (3, "c"), (4, ""), (5, None), (6, "a b c")]
    asks = [(10, "a c a"), (11, "b"), (12, "zz"), (13, None)]
    words = lambda t: (t or "").split()
    split = lambda: F.split("text", " ")
    got = R.bm25(spark.createDataFrame(asks, "q long, text string"), "q", split(), spark.createDataFrame(docs, "d long, text string").repartition(3), "d", split(), k=3).collect()
    n, mean = len(docs), sum(len(t.split(" ")) for _, t in docs if t is not None) / len(docs)
    want = {}
    for q, ask in asks:
        scores = []
        for d, t in docs:
            s = 0.0
            for w in set(words(ask)):
                df, tf = sum(w in words(x) for _, x in docs), words(t).count(w)
                s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len((t or "").split(" ")) / mean))
            if s > 0:
                scores.append((-round(s, 6), d))
        want |= {(q, d): i + 1 for i, (_, d) in enumerate(sorted(scores)[:3])}
    assert {(r["query"], r["doc"]): r["rnk"] for r in got} == want


def test_recall_counts_missing_answers_as_misses(spark):
    ranking = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 12, 1)], "query int, doc int, rnk int")
    answers = spark.createDataFrame([(1, 11), (1, 99), (2, 98), (3, 12)], "query int, doc int")
    row = R.recall_metrics(R.first_hits(ranking, answers), (1, 5)).first()
    assert (row["n"], row["r1"], row["r5"], row["mrr"]) == (2, 0.0, 0.5, 0.25)


def test_merged_items_skip_bases_that_are_part_of_those_before(spark):
    rows = [(1, "is it so", "art 10"), (2, "is  it so", "art 1"), (3, "isitso", "art 2"), (4, "other", "x")]
    got = {r["item"]: (r["bases"], r["n_items"]) for r in V.merged_items(spark.createDataFrame(rows, "item int, q string, b string"), "q", "b", "item").collect()}
    assert got == {1: ("art 10 / art 2", 3), 4: ("x", 1)}


def test_tree_links_and_cut_off_pages(spark):
    pages = spark.createDataFrame([(1, "<a onclick=\"gotoLawList('12', 'x', 'Rule A', '34', '')\">x</a></html>"), (2, "<p>cut"), (3, None)], "page_id int, html string")
    link = readers.tree_links(pages).first()
    assert (link["title"], link["seq"], link["history_seq"]) == ("Rule A", "12", "34")
    whole, broken = readers.whole_pages(pages)
    assert [r["page_id"] for r in whole.collect()] == [1]
    assert sorted(r["page_id"] for r in broken.collect()) == [2, 3]


def test_rows_of_sheets_are_skipped_by_number(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1,title\nno,name\n1,a\nx,b\n2,c\n")
    assert sorted(tuple(r) for r in readers.sheet_rows(spark, str(tmp_path / "a.csv"), ["no", "name"], "no", skip=2).collect()) == [("1", "a"), ("2", "c")]


def test_newest_post_with_a_fitting_file(spark):
    posts = spark.createDataFrame([("b", 1, "rule_old.HWP", 5000), ("b", 2, "rule_new.hwp", 9000), ("b", 3, "rule_newer.hwp", 10), ("b", 4, "other.hwp", 9000)], "board string, at int, file string, size int")
    assert [r["at"] for r in readers.newest_attachment(posts, "board", "at", "file", ".hwp", ["rule"], "size").collect()] == [2]


def test_keys_go_past_all_that_were(spark):
    rows = spark.createDataFrame([(1, i, k) for i, k in enumerate(["a", "a", "a#2", "a", "b"])] + [(2, i, k) for i, k in enumerate(["a#2", "a", "a", "a"])] + [(3, 0, "a"), (3, 1, "a")], "doc int, pos int, k string")
    got = S.unique_keys(rows, "k").orderBy("doc", "pos").collect()
    assert [r["section_key"] for r in got] == ["a", "a#2", "a#2#2", "a#3", "b", "a#2", "a", "a#3", "a#4", "a", "a#2"]


def test_records_and_attachments_are_read_and_checked(spark, tmp_path):
    (tmp_path / "records").mkdir()
    (tmp_path / "records" / "a.json").write_text('{"name": "A",\n "articles": []}')
    (tmp_path / "records" / "b.json").write_text('{"name": ')
    rows = readers.json_records(spark, str(tmp_path / "records"))
    assert sorted((r["path"].rsplit("/", 1)[1], r["broken"]) for r in rows.select("path", "broken").collect()) == [("a.json", False), ("b.json", True)]
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "ok.pdf").write_bytes(b"x" * 2000)
    (tmp_path / "files" / "tiny.pdf").write_bytes(b"x")
    files = readers.attachments(spark, str(tmp_path / "files"))
    assert {r["name"]: r["valid"] for r in files.collect()} == {"ok.pdf": True, "tiny.pdf": False}
    manifest = spark.createDataFrame([("ok.pdf", 2000), ("tiny.pdf", 9), ("gone.pdf", 1)], "name string, size long")
    assert {r["name"] for r in readers.manifest_mismatch(files, manifest).collect()} == {"tiny.pdf", "gone.pdf"}


def test_snapshots_are_seen_once_their_pointer_is(spark, tmp_path):
    base = str(tmp_path / "table")
    writers.commit_snapshot(spark.range(3).toDF("x"), base, 1)
    spark.range(9).toDF("x").write.parquet(f"{base}/snapshot-{2:012d}")  # written, but never committed
    assert writers.latest_snapshot(spark, base).count() == 3
    writers.commit_snapshot(spark.range(5).toDF("x"), base, 2)
    assert writers.latest_snapshot(spark, base).count() == 5


def test_quarantine_keeps_broken_rows_apart(spark, tmp_path):
    df = spark.createDataFrame([(1, "ok"), (2, ""), (3, "ok")], "id int, body string")
    writers.quarantine(df, F.col("body") == "", F.lit("empty"), str(tmp_path / "good"), str(tmp_path / "bad"))
    assert spark.read.parquet(str(tmp_path / "good")).count() == 2
    assert spark.read.parquet(str(tmp_path / "bad")).first()["reason"] == "empty"


def test_stream_over_several_files_equals_the_batch_form(spark, tmp_path):
    draw, start = random.Random(3), datetime.datetime(2026, 1, 1)
    rows = [(draw.randrange(6), start + datetime.timedelta(minutes=i), i, draw.choice("ab"), draw.choice("xy"), draw.choice([None, None, "down"])) for i in range(90)]
    schema = "name long, ts timestamp_ntz, poll_id long, key string, hash string, error string"
    for part in range(3):  # one file a batch, in order of time
        spark.createDataFrame(rows[30 * part : 30 * part + 30], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    from pyspark.sql.types import _parse_datatype_string

    out = detect.run_stream(spark, str(tmp_path / "in"), _parse_datatype_string(schema), str(tmp_path / "base"), lambda b: b)
    got = {r["poll_id"]: r["status"] for r in out.collect()}
    last: dict[int, tuple[str, str]] = {}
    for name, _, poll, key, digest, error in rows:
        prev = last.get(name)
        want = "error" if error else "new" if prev is None else "changed" if prev != (key, digest) else "same"
        if not error:  # a failed poll leaves the state alone
            last[name] = (key, digest)
        assert got[poll] == want


def test_vector_cells_agree_with_plain_loops(spark):
    rng = np.random.default_rng(1)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.integers(-2, 3, (120, 4)).astype(float))]
    rows += [(7, rows[7][1])] * 9 + [(None, [1.0] * 4), (999, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = R.vector_top_k(df.where("vec_id % 20 = 0"), df, "vec_id", "embedding", 5, cell_queries=2, cell_rows=40).collect()
    whole = [(i, v) for i, v in rows if i is not None and v is not None]
    want = []
    for q, qv in ((i, v) for i, v in whole if i % 20 == 0):
        near = sorted((-round(float(np.dot(qv, v)), 6), d) for d, v in whole if d != q)[:5]
        want += [(q, d, -s, n + 1) for n, (s, d) in enumerate(near)]
    assert sorted((r.query, r.rnk, r.doc, r.score) for r in got) == sorted((q, n, d, s) for q, d, s, n in want)
    assert R.vector_top_k(df.where("false"), df, "vec_id", "embedding", 5).count() == 0


def test_contains_join_agrees_with_plain_loops(spark):
    texts = [(1, "abcdef"), (2, "abcdef"), (3, None), (4, ""), (5, "xxab"), (6, "a\nb 가나다\U0001F600라")]
    names = [("abc", 1), ("abc", 2), ("ab", 3), ("", 4), (None, 5), ("bcdef", 6), ("다\U0001F600라", 7), ("\nb", 8)]
    got = M.contains_join(spark.createDataFrame(texts, "i int, t string"), "t", spark.createDataFrame(names, "n string, j int"), "n")
    assert got.columns == ["i", "t", "n", "j"]
    assert sorted((r.i, r.j) for r in got.collect()) == sorted((i, j) for i, t in texts for n, j in names if t and n and n in t)


def test_plain_sections(spark):
    from palimpsest.operators import plain_text as P

    text = "여신 규정\n제1조(목적) 가\n나\n제 3조 다\n다른   규정\n제1조 라\n제2조의2 마\n제2조의2 바\n부   칙\n부칙 (2016.9.3 제정)\n제1조 사\n부칙\n제1조(시행일)\n2022년 10월 17일부터\n[별표 1] 아"
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "부칙\n가")], "d int, t string")
    got = P.plain_sections(S.text_lines(docs, "d", "t")).orderBy("doc", "pos").collect()
    assert [r.section_key for r in got if r.doc == 1] == [
        "머리말", "제1조", "제1조", "제3조", "제3조", "다른 규정:제1조", "다른 규정:제2조의2", "다른 규정:제2조의2#2",
        "다른 규정:부칙2016.09.03", "다른 규정:부칙2016.09.03", "다른 규정:부칙2016.09.03:제1조",
        "다른 규정:부칙2022.10.17", "다른 규정:부칙2022.10.17:제1조", "다른 규정:부칙2022.10.17:제1조", "다른 규정:부칙2022.10.17:[별표1]",
    ]
    assert [r.section_key for r in got if r.doc == 4] == ["부칙", "부칙"]


def test_plain_sections_move_lines_once(spark):
    from palimpsest.operators import plain_text as P

    lines = ["서문", "제1조", "제3조", "제2조", "제1조 가", "제1조 나", "제2조", "제4조", "새 규정", "제1조 다", "제3조", "제1조 라", "부칙 제7호", "제1조 마", "제1조 바"]
    rows = [(d, i, x, d) for d in (2, None, 1) for i, x in enumerate(lines)]
    frame = spark.createDataFrame(rows[::-1], "doc int, pos long, line string, more int").repartition(3)
    found = P.plain_sections(frame)
    assert found.columns == ["doc", "pos", "line", "more", "section_key"]
    got = sorted(found.collect(), key=lambda r: (r.doc or 0, r.pos))
    want = [
        "머리말", "제1조", "제3조", "제2조", "서문:제1조", "서문:제1조#2", "서문:제2조", "서문:제4조", "서문:제4조", "새 규정:제1조", "새 규정:제3조", "새 규정:제1조#2",
        "새 규정:부칙제7호", "새 규정:부칙제7호:제1조", "새 규정:부칙제7호:제1조#2",
    ]
    assert [r.section_key for r in got] == want * 3
    plan = P.plain_sections(frame)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(doc") == 1 and plan.count("Sort [doc") == 1


@pytest.mark.parametrize(
    ("text", "want"),
    [("머리 1. 가 11. 나 2. 다 4. 라", "머리 \n1. 가 11. 나 \n2. 다 4. 라"), ("1. 가 제2. 나 1의2. 2. 다", "1. 가 제2. 나 1의2. \n2. 다"), ("2. 가", "2. 가"), ("", ""), ("가\n1. 나", "가\n\n1. 나"), (None, None)],
)
def test_cut_by_sequence(spark, text, want):
    from palimpsest.operators import plain_text as P

    marks = F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.concat(i.cast("string"), F.lit(".")))
    assert one(spark, P.cut_by_sequence(F.col("x"), marks), (text,)) == want


def test_without_divisions(spark):
    from palimpsest.operators import plain_text as P

    rows = [(1, "제1편 총칙", "제1편 총칙"), (2, "제1편", "본문"), (3, None, "본문"), (4, "", ""), (5, "제2편", None)]
    assert [r.i for r in P.without_divisions(spark.createDataFrame(rows, "i int, g string, b string"), "g", "b").orderBy("i").collect()] == [2, 3, 4, 5]


def test_section_keys_of_equal_line_numbers_come_in_the_order_of_the_files(spark, tmp_path):
    import duckdb

    from palimpsest.plans import citation_queries, registry

    folder = tmp_path / "lineitem.parquet"
    folder.mkdir()
    lines = "SELECT d AS l_orderkey, {n}::BIGINT AS l_linenumber, 0::BIGINT AS l_partkey, {s}::BIGINT AS l_suppkey FROM range({k}) t(d)"
    with duckdb.connect() as con:
        # the second file is the larger one, which Spark reads first
        con.execute(f"COPY ({lines.format(n=1, s=1, k=300)} UNION ALL {lines.format(n=2, s=4, k=300)}) TO '{folder}/a.parquet'")
        con.execute(f"COPY ({lines.format(n=2, s=1, k=300)} UNION ALL SELECT 1000 + d // 2, 5, d, d * 7919 % 1009 FROM range(60000) t(d)) TO '{folder}/b.parquet'")
        con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/*.parquet'")
        want = sorted(con.sql(registry.ORACLES["section_keys"]).fetchall())
    got = sorted(tuple(r) for r in citation_queries.section_keys(spark, str(tmp_path)).select("doc", "pos", "section_key").collect())
    assert got == want


def test_bm25_tasks_hold_no_batch_multiplied_by_its_queries():
    import tracemalloc
    from types import SimpleNamespace

    import numpy as np
    import pyarrow as pa

    from palimpsest.operators import retrieval as R

    n_docs, n_tokens, n_queries, k = 3000, 100, 200, 5
    starts = np.arange(n_tokens + 1) * n_queries
    rng = np.random.default_rng(7)
    idf = rng.random(n_tokens)
    tf = rng.integers(1, 9, (n_docs, n_tokens)).astype(np.int32)
    lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(n_docs + 1, dtype=np.int32) * n_tokens), pa.array(x.ravel()))
    tokens = np.tile(np.arange(n_tokens, dtype=np.int32), (n_docs, 1))
    dl = tf.sum(axis=1).astype(np.int64)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(n_docs)), pa.array(dl), lists(tokens), lists(tf)], ["doc", "dl", "token", "tf"])
    side = SimpleNamespace(value=(np.arange(n_queries), np.tile(np.arange(n_queries), n_tokens), starts, idf))
    tracemalloc.start()
    (found,) = R._best_of_task(side, float(dl.mean()), k, 1.2, 0.75)(iter([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300e6  # 60 million (document, token, query) rows are 480 MB a column
    score = np.floor((idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl[:, None] / dl.mean()))).sum(axis=1) * 1e6 + 0.5) / 1e6
    best = np.lexsort((np.arange(n_docs), -score))[:k]
    got = found.to_pandas().groupby("query")["doc"].apply(list)
    assert len(got) == n_queries and all(x == list(best) for x in got)


def test_bm25_counts_the_same_in_any_stretches(monkeypatch):
    from types import SimpleNamespace

    import pyarrow as pa

    from palimpsest.operators import retrieval as R

    docs = [["a", "b", "a"], None, [], ["c", "a", "x"] * 4, ["b"]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(docs, pa.list_(pa.string()))], ["doc", "tokens"])
    run = R._asked_counts(SimpleNamespace(value={"a": 0, "b": 1, "c": 2}))
    whole = pa.Table.from_batches(run(iter([batch]))).to_pylist()
    assert whole[0] == {"doc": 0, "dl": 3, "token": [0, 1], "tf": [2, 1]} and whole[3] == {"doc": 3, "dl": 12, "token": [0, 2], "tf": [4, 4]}
    monkeypatch.setattr(R, "_BLOCK", 3)
    cut = list(run(iter([batch])))
    assert len(cut) == 3 and pa.Table.from_batches(cut).to_pylist() == whole


def test_line_pairs_match_few_lines_and_as_plain_matching_does(monkeypatch):
    import difflib
    import random

    from palimpsest.operators import text_diff as D

    def plain(old, new, least=0.5):
        out = []
        for op, a, b, c, d in difflib.SequenceMatcher(None, old, new, autojunk=False).get_opcodes():
            if op == "equal":
                continue
            free = list(range(c, d))
            for i in range(a, b):
                best, at = 0.0, None
                for j in free:
                    ratio = difflib.SequenceMatcher(None, old[i], new[j], autojunk=False).ratio()
                    if ratio >= least and ratio > best:
                        best, at = ratio, j
                if at is not None:
                    free.remove(at)
                out.append((old[i], new[at] if at is not None else None))
            out += [(None, new[j]) for j in free]
        return out

    rng = random.Random(5)
    line = lambda: "".join(rng.choice("ab 가1") for _ in range(rng.randrange(9)))
    texts = [([line() for _ in range(rng.randrange(9))], [line() for _ in range(rng.randrange(9))]) for _ in range(400)]
    for least in (0.0, 0.5, 0.9):
        assert [D.paired_lines(o, n, least) for o, n in texts] == [plain(o, n, least) for o, n in texts]
    calls, ratio = [], difflib.SequenceMatcher.ratio
    monkeypatch.setattr(difflib.SequenceMatcher, "ratio", lambda self: calls.append(1) or ratio(self))
    old, new = [f"{i:04d}" * 9 for i in range(60)], [f"{i:04d}" * 9 + "!" for i in range(60)]
    assert len(D.paired_lines(old, new)) == 60 and len(calls) < 900  # 1,830 pairs are free to be matched


def test_line_pairs_of_short_lines_are_matched_a_batch_at_a_time(monkeypatch):
    import difflib
    import random

    import pyarrow as pa

    from palimpsest.operators import text_diff as D

    rng = random.Random(11)

    def texts(alphabet, width, lines, n):
        text = lambda: None if rng.random() < 0.02 else "\n".join("".join(rng.choice(alphabet) for _ in range(rng.randrange(width))) for _ in range(rng.randrange(lines)))
        return [(text(), text()) for _ in range(n)]

    cases = texts("ab", 4, 9, 300) + texts("ab 가😀", 9, 9, 300) + texts("abc", 36, 7, 100) + texts("abcd", 65, 4, 60) + texts("ab", 12, 60, 20)
    order = lambda: "\n".join(f"{rng.randrange(200000)}|{rng.randrange(1, 51)}|{rng.choice('ANR')}" for _ in range(rng.randrange(8)))
    cases += [(order(), order()) for _ in range(300)] + [("a\nb\na", "b\na\nb"), ("", None), ("\n", "")]
    long = texts("ab", 90, 4, 40) + texts("ab", 3, 90, 10)

    def plain(least, cases):
        return [[{"old": o, "new": n} for o, n in D.paired_lines((a or "").split("\n"), (b or "").split("\n"), least)] for a, b in cases]

    want = {least: (plain(least, cases), plain(least, cases[:50] + long + cases[50:99])) for least in (0.0, 0.5, 0.9, 1.0)}
    sides = lambda cases: [pa.array(x, pa.string()) for x in zip(*cases)]
    for least, (_, mixed) in want.items():
        assert D.paired_batch(*sides(cases[:50] + long + cases[50:99]), least).to_pylist() == mixed
    assert D.paired_batch(*[x[:0] for x in sides(cases)]).to_pylist() == []
    monkeypatch.setattr(difflib, "SequenceMatcher", None)  # a matcher a pair took 0.2 ms a change
    for least, (short, _) in want.items():
        assert D.paired_batch(*sides(cases), least).to_pylist() == short
    monkeypatch.setattr(D.pairing, "_LINES", 7)
    assert D.paired_batch(*sides(cases)).to_pylist() == want[0.5][0]


def test_line_pairs_column_matches_short_and_long_texts(spark):
    from palimpsest.operators import text_diff as D

    cases = [(1, "abcd\nxyz", "abce\nq"), (2, None, "b"), (3, "a" * 99, "a" * 98 + "b\nc"), (4, "same", "same")]
    found = spark.createDataFrame(cases, "id int, old string, new string").select("id", D.line_pairs(F.col("old"), F.col("new")).alias("p")).collect()
    want = {i: [tuple(x) for x in D.paired_lines((o or "").split("\n"), (n or "").split("\n"))] for i, o, n in cases}
    assert {r["id"]: [tuple(x) for x in r["p"]] for r in found} == want
