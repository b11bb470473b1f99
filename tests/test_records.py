"""Records of every shape to sections."""

import html
import json
from html.entities import html5

from pyspark.sql import functions as F

from palimpsest.operators import records, sections

LAW = {
    "조문": [
        {"조문번호": "1", "조문제목": "목적", "조문내용": "제1조(목적) &lt;x&gt; &amp;lt;", "항": [{"항내용": "① 가", "호": {"호내용": ["1. 나", "둘째"], "목": ["가. 다", {"content": "나. 라"}, None]}}, {"항내용": None, "호": [{"호내용": "2. 마"}]}]},
        {"조문번호": "1", "조문가지번호": "2", "조문내용": ["a", ["b", None, "c"]]},
        {"조문내용": "제7조의 3(x) y"}, {"조문내용": ""}, {"조문내용": "zz"}, {"조문번호": 1, "조문내용": "again"}, None, "stray",
    ],
    "부칙": {"내용": "첫", "공포일자": "20200101", "공포번호": "3"},
    "별표": [{"별표번호": "1", "저장PDF": "a.pdf"}, {"구분": "별지", "별표번호": "3", "별표가지번호": "2", "내용": "몸"}],
    "이름": None, "빈": [], "개": {},
}


def read(spark, rows, kind):
    frame = spark.createDataFrame([(i, r if r is None or isinstance(r, str) else json.dumps(r, ensure_ascii=False)) for i, r in rows], "id long, raw string")
    found = records.record_sections(frame, "id", "raw", kind).orderBy("doc", "seq").collect()
    return [(r["doc"], r["seq"], r["section_key"], r["section_type"], r["title"], r["content"]) for r in found]


def test_statute(spark):
    got = read(spark, [(1, LAW), (2, None), (3, "[1,2"), (4, '"s"'), (5, "{}"), (6, {"조문": {"조문내용": "제2조 한 개"}}), (7, {"조문": "text"})], "law")
    assert got == [
        (1, 1, "제1조", "조문", "목적", "제1조(목적) <x> &lt;\n  ① 가\n    1. 나\n둘째\n      가. 다\n      나. 라\n    2. 마"),
        (1, 2, "제1조의2", "조문", None, "a\nb\nc"),
        (1, 3, "제7조의3", "조문", None, "제7조의 3(x) y"),
        (1, 4, "조문0005", "조문", None, "zz"),
        (1, 5, "제1조#2", "조문", None, "again"),
        (1, 6, "부칙1", "부칙", "부칙 20200101 제3호", "첫"),
        (1, 7, "[별표1]", "별표", None, "(본문 텍스트 없음 · 원본 파일: a.pdf)"),
        (1, 8, "[별지3의2]", "별표", None, "몸"),
        (6, 1, "제2조", "조문", None, "제2조 한 개"),
    ]


def test_outline_and_plain(spark):
    outline = {"조문": [{"조제목": "제2-5조(목적)", "조내용": "b"}, {"조제목": "제7-33(채권)"}, {"조내용": "d"}], "부칙": [{"부칙명": "n", "내용": "q"}], "별표": [{"파일명": "f.hwp", "구분": "별지", "번호": 3, "삭제여부": True}]}
    assert [r[2:] for r in read(spark, [(1, outline)], "kofia")] == [
        ("제2-5조", "조문", "제2-5조(목적)", "제2-5조(목적)\nb"),
        ("제7-33", "조문", "제7-33(채권)", "제7-33(채권)"),
        ("조문0003", "조문", None, "d"),
        ("부칙1", "부칙", "n", "q"),
        ("[별지3]", "별표", "f.hwp", "(첨부 파일: f.hwp) · 삭제됨"),
    ]
    plain = read(spark, [(1, {"본문": "머리\n제1조(a) b\nc\n부칙 <제3호>\n제1조 x"}), (2, {"본문": None}), (3, None)], "kfb")
    assert [r[2:4] + r[5:] for r in plain] == [("머리말", "머리말", "머리"), ("제1조", "조문", "제1조(a) b\nc"), ("부칙제3호", "부칙", "부칙 <제3호>"), ("부칙제3호:제1조", "부칙", "제1조 x")]


def test_leaves_keep_order_and_depth(spark):
    raw = {"a": [[["x"], "y"], {"b": {"c": 1.5, "a": True}}], "z": "last", "n": None, "e": []}
    frame = spark.createDataFrame([(1, json.dumps(raw)), (2, "7"), (3, "[]")], "id long, raw string")
    got = records.leaves(frame, "id", "raw").orderBy("doc", "at").collect()
    assert [(r["names"], r["at"], r["text"]) for r in got if r["doc"] == 1] == [
        (["a", None, None, None], [0, 0, 0, 0], "x"), (["a", None, None], [0, 0, 1], "y"), (["a", None, "b", "a"], [0, 1, 0, 0], "true"), (["a", None, "b", "c"], [0, 1, 0, 1], "1.5"),
        (["e"], [1], None), (["n"], [2], None), (["z"], [3], "last"),
    ]
    assert not [r for r in got if r["doc"] != 1]
    cut = records.leaves(frame.where("id = 1"), "id", "raw", depth=2).orderBy("at").first()
    assert cut["text"] == '[["x"],"y"]'


def test_entities_are_all_decoded_once(spark):
    texts = [f"a &{n} b" for n in html5] + ["&#60;&#x3C &#xD800; &#0; &#128; &#x110000; &#1; &ampamp; &ampx &notit; &nope; & &amp;lt;", None, "none"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    got = {r["i"]: r["t"] for r in rows.select("i", records.unescaped(F.col("t")).alias("t")).collect()}
    assert [got[i] for i in range(len(texts))] == [None if t is None else html.unescape(t) for t in texts]


def test_keys_past_numbered_ones(spark):
    keys = ["a", "a#2", "a", "a", "b", "a#2", None, None]
    rows = spark.createDataFrame([(d, i, k) for d in (1, 2) for i, k in enumerate(keys)], "doc long, pos long, k string")
    got = sections.unique_keys(rows, "k").where("doc = 2").orderBy("pos").collect()
    assert [r["section_key"] for r in got] == ["a", "a#2", "a#3", "a#4", "b", "a#2#2", None, None]


def test_items_are_made_once_and_cut_values_stay_json(spark):
    frame = spark.createDataFrame([(1, json.dumps(LAW, ensure_ascii=False))], "id long, raw string")
    plan = records.record_sections(frame, "id", "raw", "law")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("map_from_arrays") <= 2  # a filter pushed into the items had made them anew for each field it named
    deep = '{"a":[{"b":["\\u0001\\n\\"\\\\é",1.50,1e2,-0,true,null,{"z":[],"y":{}}]}]}'
    got = records.leaves(spark.createDataFrame([(1, deep)], "id long, raw string"), "id", "raw", depth=3).collect()
    assert [(r["names"], r["at"]) for r in got] == [(["a", None, "b"], [0, 0, 0])]
    assert got[0]["text"] == spark.createDataFrame([(deep,)], "raw string").selectExpr("to_json(variant_get(parse_json(raw), '$.a[0].b', 'variant')) as t").first()["t"]
