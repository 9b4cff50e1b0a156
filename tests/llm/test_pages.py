"""Main texts of pages."""

from hypothesis import given
from hypothesis import strategies as st

from fixhound.llm import pages


def texts(spark, rows):
    table = spark.createDataFrame([(i, u, h, "x") for i, u, h in rows], "page_id bigint, url string, html string, text string")
    return {r.page_id: r for r in pages.extract(table).collect()}


def test_structured_page(spark):
    page = (
        "<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a='</p>';</script></head><body>"
        "<nav><ul><li><a href=/>home</a></ul></nav><form><input></form><article><header><h1>Head &amp; tail</h1><span>by me</span></header>"
        "<p>one<br>two   <b>three</b>&nbsp;four<div class='share-box'>share</div><p>a < b<aside>no</aside><ul><li>x<li>y</ul>"
        "<!-- gone --></article><section id=comments><article class=comment>hi</article></section><footer>&copy; me"
    )
    got = texts(spark, [(1, "http://h/a", page), (2, None, None), (3, "http://h/b", ""), (4, "http://h/c", "<article></article>")])
    assert got[1].text == "Head & tail\none two three four\na < b\nx\ny"
    assert got[1].n_chars == len(got[1].text)
    assert [got[i].text for i in (2, 3, 4)] == ["", "", ""]


def test_shared_lines_go(spark):
    page = lambda own: f"<body><div>Our site</div><div>{own}</div><p>more of {own}, and so on</p><div>All rights reserved</div>"
    rows = [(i, f"http://h{i % 2}/news/{i}", page(f"story number {i} is told here")) for i in range(12)]
    rows.append((50, "http://alone/x", page("single")))
    rows += [(60, "http://copy/a", page("the same")), (61, "http://copy/b", page("the same"))]
    got = texts(spark, rows)
    alone = 0
    for i in range(12):
        alone += got[i].text.startswith("Our site")
        assert f"story number {i} is told here\nmore of story number {i}" in got[i].text
    assert alone <= 2
    assert got[50].text.startswith("Our site") and "the same" in got[60].text and "the same" in got[61].text


def test_marked_pages_are_differenced(spark):
    """Shared blocks of no kind go, the article's paragraphs, headings and lists stay though shared."""
    page = lambda own: (
        "<body><div>Our site</div><article><h1>Notes</h1><div>Read us for three euros a month</div><p>" + own + "</p><div>last words on " + own + "</div>"
        "<h2>Sources</h2><ul><li>the same<div>in a list</div></ul><p>the same</p></article><p>All rights reserved</p>"
    )
    rows = [(i, f"http://h/news/{i}", page(f"story number {i} " + f"is told here {i * 7} " * 20)) for i in range(12)]
    got = texts(spark, rows)
    alone = 0
    for i in range(12):
        lines = got[i].text.split("\n")
        alone += lines.pop(1).startswith("Read us") if lines[1].startswith("Read us") else 0
        own = f"story number {i} " + f"is told here {i * 7} " * 20
        assert lines == ["Notes", own.strip(), f"last words on {own}".strip(), "Sources", "the same", "in a list", "the same"]
    assert alone <= 1


@given(st.lists(st.sampled_from("abcd"), max_size=12), st.lists(st.sampled_from("abcd"), max_size=12))
def test_common_lines_are_longest(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    places = pages.common_lines(a, b)
    assert len(places) == table[-1][-1] and places == sorted(set(places))
    rest = iter(b)
    assert all(a[i] in rest for i in places)


def test_no_pages(spark):
    assert texts(spark, []) == {}
