"""Pages as trees: intervals, sections with panes, wrappers, nested labels and duplicates, links and records."""

import duckdb
import pytest

import __spark_entry__ as entry
from corroborate.operators import dom

LABELS = ["Question", "Answer", "Summary", "Words"]
NESTED = ["Summary"]


def read(spark, pages, **options):
    doms = dom.dom(spark.createDataFrame(list(pages.items()), "page_id long, html string"))
    wanted = spark.createDataFrame([(x, [y for y in LABELS if y != x and not (x == "Answer" and y == "Summary")]) for x in LABELS], "label string, stops array<string>")
    out = dom.sections(doms, wanted, NESTED, **options).collect()
    assert len(out) == len(pages) * len(LABELS)
    return {(r.page_id, r.label): r for r in out}


def test_tree_of_a_page():
    text, nodes = dom.tree("<html lang=ar><body><p>a<b>b<br><p>c</p><ul><li>x<li>y</ul><nav>n<i>m</i></nav><script>var t='</p>';</script>z<img>&amp;</div>")
    nodes = [dict(zip(dom._NODE, n)) for n in nodes]
    at = {n["tag"]: n for n in reversed(nodes) if n["tag"]}
    own = lambda n: text[n["a"] : n["b"]]
    assert own(at["body"]) == "ab\n\nc\nx\ny\nz&" and own(at["nav"]) == "" and own(at["i"]) == "m" and own(at["html"]) == own(at["body"])
    assert [own(n) for n in nodes if n["tag"] == "p"] == ["ab\n\n", "c\n"] and [own(n) for n in nodes if n["tag"] == "li"] == ["x\n", "y\n"]
    for i, n in enumerate(nodes):
        assert n["pre"] == i
        inside = [m for m in nodes if n["pre"] < m["pre"] <= n["last"]]
        assert all(m["depth"] > n["depth"] for m in inside)
        assert n["parent"] == max((m["pre"] for m in nodes if m["pre"] < i <= m["last"]), default=-1)
    assert dom.tree(None)[0] == "" and list(dom.tree("")[1]) == []


def test_sections(spark):
    pages = {
        1: "<h2>Question:</h2>who <b>is</b> it?<p>more</p><h2>Answer</h2><p>yes</p><h3>Summary</h3><p>short</p><h3>Other</h3><p>not this</p>",
        2: "<div class='head'><h2> Question </h2></div><div>after the wrapper</div><h2>Answer</h2>",  # alone in its wrapper; nothing follows
        3: "<ul><li><a href='#q'>Question</a></li><li><a role=tab aria-controls='ans' href='x'><span>Answer</span></a></li></ul><div id=q><h2>Question</h2><p>in the pane</p></div><div id=ans><p class='share x'>button</p>text<ul><li>one</li><li>two</li></ul></div>",
        4: "<p>Words</p><p>a</p><p>b</p><p>Words</p><p>c</p>",  # two that differ
        5: "<div id=full><h2>Answer</h2><p>copy</p></div><h2>Answer</h2><p>own</p>",
        6: "<div id=own><h2>Answer</h2><p>best</p></div><div><h2>Answer</h2><p>other</p></div>",
        7: "<div id=second>from a pane</div>",
        8: "<div><div><span>Summary</span></div></div><p>x  y</p><h1>stop</h1><p>no</p>",
        9: "<p>Words</p><p>a b</p><h1>x</h1><p>Words</p><p>a  b</p><h2>y</h2>",  # the same text twice
        10: None,
        11: "<nav><p>Words</p><p>hidden from the page, not from itself</p></nav>",
        12: "<a href='#none'><b>Question</b></a><p>text</p>",  # a tab without a pane
    }
    got = read(spark, pages, panes={"Answer": ["first", "second"]}, full_pane="full", preferred={"Answer": "own"})
    text = {k: (r.status, r.text) for k, r in got.items()}
    assert text[1, "Question"] == ("ok", "who is it?more")
    assert text[1, "Answer"] == ("ok", "yes\nSummaryshort") and text[1, "Summary"] == ("ok", "short")
    assert text[2, "Question"] == ("ok", "after the wrapper") and text[2, "Answer"] == ("missing", None)
    assert text[3, "Question"] == ("ok", "in the pane") and text[3, "Answer"][1].startswith("text") and list(got[3, "Answer"]["items"]) == ["one", "two"]
    assert text[4, "Words"] == ("ambiguous", None)
    assert text[5, "Answer"] == ("ok", "own") and text[6, "Answer"] == ("ok", "best")
    assert text[7, "Answer"] == ("ok", "from a pane") and text[7, "Words"] == ("missing", None)
    assert text[8, "Summary"] == ("ok", "x y") and text[9, "Words"] == ("ok", "a b")
    assert text[10, "Answer"] == text[12, "Question"] == ("missing", None)
    assert text[11, "Words"] == ("ok", "hidden from the page, not from itself")
    assert list(got[1, "Question"]["items"]) == ["who is it?more"]


def test_sections_of_own_labels_and_no_pages(spark):
    doms = dom.dom(spark.createDataFrame([(1, "<h1>A</h1><p>x</p>"), (2, "<h1>B</h1><p>y</p>"), (2, "<p>repeated</p>")], "page_id long, html string").limit(2))
    wanted = spark.createDataFrame([(1, "A", []), (2, "B", []), (2, "A", [])], "page_id long, label string, stops array<string>")
    assert {(r.page_id, r.label, r.text) for r in dom.sections(doms, wanted).collect()} == {(1, "A", "x"), (2, "B", "y"), (2, "A", None)}
    assert dom.sections(doms.limit(0), wanted).count() == 0


def test_links(spark):
    html = "<a href='/a/b'>x</a><a href='c?page=2#z'>y</a><a href='https://other.example/a/q'>z</a><a href='/a/../b'>d</a><a href=' '>e</a><a>f</a><a href='http://[bad'>g</a><A HREF=/a/b>h</A><a href='mailto:x'>m</a>"
    pages = spark.createDataFrame([(1, "https://h.example/a/", html), (2, None, "<a href='q'>x</a>"), (3, "https://h.example/", None)], "page_id long, url string, html string")
    got = {(r.page_id, r.target): r.allowed for r in dom.links(dom.dom(pages), pages, ["h.example"], [r"/a/[^/]+/?"]).collect()}
    assert got == {(1, "https://h.example/a/b"): True, (1, "https://h.example/a/c?page=2"): True, (1, "https://other.example/a/q"): False, (1, "https://h.example/b"): False, (1, "https://h.example/a/"): False, (1, "mailto:x"): False, (2, "q"): False}


@pytest.mark.parametrize("title_for", [None, "Question"])
def test_records_and_reasons(spark, title_for):
    body = "<h2>Answer</h2><p>نعم</p>"
    pages = {
        1: f"<html lang='ar-EG'><h1>عنوان</h1><h2>Question</h2><p>سؤال</p>{body}<h2>Summary</h2>",
        2: f"<html lang=en><h1>عنوان</h1>{body}",
        3: f"<html lang=ar>{body}",
        4: f"<html lang=ar><h1>title</h1>{body}",
        5: f"<html lang=ar><h1>عنوان</h1>{body}",
        6: f"<html lang=ar><h1>عنوان</h1><h2>Question</h2><p>latin</p>{body}",
        7: f"<html lang=ar><h1>عنوان</h1><h2>Question</h2><p>س</p><h2>Question</h2><p>ص</p>{body}",
        8: f"<html lang=ar><h1>عنوان</h1><h2>Question</h2><p>س</p>{body}<h2>Words</h2><p>أ</p><h2>Words</h2><p>ب</p>",
        9: None,
    }
    doms = dom.dom(spark.createDataFrame(list(pages.items()), "page_id long, html string"))
    wanted = spark.createDataFrame([(x, [y for y in LABELS if y != x]) for x in LABELS], "label string, stops array<string>")
    out = {r.page_id: r for r in dom.records(doms, dom.sections(doms, wanted, NESTED), ["Question", "Answer"], ["Summary", "Words"], title_for).collect()}
    assert {i: r.reason for i, r in out.items()} == {1: None, 2: "not_ar_page", 3: "missing_h1", 4: "not_ar_record", 5: None if title_for else "missing_Question", 6: "not_ar_record", 7: "ambiguous_Question", 8: "ambiguous_Words", 9: "not_ar_page"}
    assert out[1].fields == {"Question": "سؤال", "Answer": "نعم"} and (out[5].fields or {}).get("Question") == ("عنوان" if title_for else None)


def test_label_text():
    assert dom._label(" a\t b：\n") == "a b" and dom._label("x:") == "x"


@pytest.mark.parametrize("name", ["page_sections", "page_records"])
def test_queries_of_headings_that_recur_or_end_in_a_reference(spark, tmp_path, name):
    """A heading's text outside the article heads nothing; a reference without a semicolon is text."""
    long = "Words of a heading that has more than forty letters in all"
    page = lambda before, head: f'<html lang="en"><body><div class="ad">{before}</div><article><h1>{head}</h1><p>{long}.</p><p>And more.</p></article></body></html>'
    rows = [(0, page(long, long)), (1, page("ad", long + "&amp")), (2, page("ad", long + "&amp;lt")), (3, page("ad", long + "&am"))]
    spark.createDataFrame(rows, "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    df = entry.queries()[name](spark, str(tmp_path))
    rel = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in rel.description]
    want = sorted(repr(row) for row in rel.fetchall())
    assert sorted(repr(tuple(r[c] for c in cols)) for r in df.collect()) == want
