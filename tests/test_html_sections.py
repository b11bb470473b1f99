"""Tags as a stream: sections of pages, also of broken ones."""

from pyspark.sql import functions as F

from palimpsest.operators import html_sections as H


def sections(spark, pages, marks, **how):
    frame = spark.createDataFrame(pages, "id long, html string")
    return [(r["doc"], r["seq"], r["kind"], r["text"]) for r in H.section_texts(frame, "id", F.col("html"), marks, **how).orderBy("doc", "seq").collect()]


def test_odd_pages(spark):
    marks = {"p": "(?i)^<p\\b", "h": "(?i)^<h1\\b"}
    pages = [
        (1, "before<P class='x'>a &lt;b&gt;<br>c   d<script>if (a < b) { '<p>' }</script><!-- <p>no --><h1>t</h1><p> </p><p>3 < 4 &amp;amp; 5"), (2, None), (3, ""), (4, "plain &copy &#xAC00; text"),
        (5, "<p>open <b bold text"), (6, "<!-- never closed <p>x"), (7, "<style>p{}</style><p>" + "word " * 50_000),
    ]
    got = sections(spark, pages, marks, breaks="(?i)^<br\\b")
    assert got[:-1] == [
        (1, 1, "p", "before"), (1, 2, "p", "a <b>\nc d"), (1, 3, "h", "t"), (1, 4, "p", "3 < 4 &amp; 5"), (4, 1, "p", "plain © 가 text"), (5, 1, "p", "open"),
    ]
    assert got[-1][:3] == (7, 1, "p") and len(got[-1][3]) == 249_999


def test_outline_where_there_are_no_articles(spark):
    body = "<div>머리글</div><p>Ⅰ. 목적</p><p>1. 첫째</p><p>가. 세부</p><table><tr><td>a</td><td>b</td></tr></table><p>II 범위</p><p>2. 둘째 &amp; 셋</p><div class=\"addenda\">부칙</div><p>x</p>"
    frame = spark.createDataFrame([(1, body), (2, '<div class="JO"><div class="article"><table><tr><td></td><td>제 2-5조(가)</td></tr></table></div>몸</div>'), (3, None)], "id long, html string")
    got = [(r["doc"], r["kind"], r["chapter"], r["section"], r["title"], r["body"]) for r in H.statute_sections(frame, "id", "html").orderBy("doc", "seq").collect()]
    assert got == [
        (1, "article", "", "", "", "머리글"), (1, "article", "Ⅰ 목적", "", "1. 첫째", "가. 세부\na\nb"), (1, "article", "II 범위", "", "2. 둘째 & 셋", ""), (1, "addenda", "", "", "부칙", "x"),
        (2, "article", "", "", "제 2-5조(가)", "몸"),
    ]


def test_dates_and_anchors(spark):
    rows = spark.createDataFrame([("부칙 2026. 1. 2. 시행",), ("none",), (None,)], "t string")
    assert [r[0] for r in rows.select(H.last_date(F.col("t"))).collect()] == ["20260102", None, None]
    cut = spark.createDataFrame([("ab [ 별표/ 서식 파일 ] cd",), ('x<A NAME="inclosure">y',), ("all",), (None,)], "t string")
    assert [r[0] for r in cut.select(H.cut_at(F.col("t"))).collect()] == ["ab ", "x", "all", None]


def test_references_without_their_end_are_text_where_asked(spark):
    marks = {"p": "(?i)^<p\\b"}
    pages = [(1, "<p>a &amp;amp; b &amp"), (2, "<p>&copy; &copy &notit; &#xAC00; &#44032 &zzz; &&amp;&")]
    assert sections(spark, pages, marks, closed=True) == [(1, 1, "p", "a &amp; b &amp"), (2, 1, "p", "© &copy &notit; 가 &#44032 &zzz; &&&")]
    assert sections(spark, pages, marks) == [(1, 1, "p", "a &amp; b &"), (2, 1, "p", "© © ¬it; 가 가 &zzz; &&&")]


def test_page_sections_of_pages_cut_off_agree_with_sql(spark, tmp_path):
    import duckdb

    from palimpsest.plans import html_queries, registry

    spark.createDataFrame([(1, "<title>ores&amp;&amp</title><h1>ores&amp;&amp</h1><p>x &quot;y&quot;</p>")], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(tuple(r) for r in html_queries.page_sections(spark, str(tmp_path)).select("doc", "seq", "kind", "text").collect())
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
        assert got == sorted(con.sql(registry.ORACLES["page_sections"]).fetchall())


def test_no_token_of_a_statute_page_is_shuffled_or_sorted(spark):
    frame = spark.createDataFrame([(1, '<div class="chapter">제1장 가</div><div class="JO"><div class="article"><table><td>제1조</td></table></div>a &lt;b<br>c</div><div class="JO">d</div>')], "id long, html string")
    found = H.statute_sections(frame, "id", "html")
    assert [tuple(r) for r in found.collect()] == [(1, 1, "article", "제1장 가", "", "제1조", "a <b\nc"), (1, 2, "article", "제1장 가", "", "", "d")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any(step in plan for step in ("Exchange", "Sort", "Window"))
