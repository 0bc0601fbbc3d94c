import collections
import time

import pytest

from quadrat.llm import html

PAGES = "page_id long, url string, html string"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p>a<p>b<br>c", "a\nb\nc"),
        ("<ul><li>x<li>y &amp; z</ul>", "x\ny & z"),
        ("<script>var t='</p><b>'</script><style>p{}</style>k<!-- <p>no</p> -->", "k"),
        ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n2\n3"),
        ("<a title='1 > 0' href=x>l</a> &lt;b&gt;", "l <b>"),
        ("<p>one</div> two</b></p>", "one two"),
        ("plain", "plain"),
        ("", ""),
        ("<<p>x", "<\nx"),
        ("<p", "<p"),
        ("<!DOCTYPE html><html><head><title>t</title></head><body><h1>h</h1>  <p>a  b</p></body></html>", "h\na b"),
        ("<div><p>a<div>b</div>c</div>", "a\nb\nc"),
    ],
)
def test_text_of_pages(page, text):
    assert html.extract(page, set())[0] == text


def test_equal_subtrees_have_equal_hashes():
    a, b = html.subtrees("<div><p class='x'>t</p></div><i>1</i>"), html.subtrees("<p class='x'>t </p>")
    assert len(a) == 2 and set(b) <= set(a)
    assert sorted(x % 2 for x in a) == [0, 1]  # a container and a block of text
    assert not set(html.subtrees("<p class='y'>t</p>")) & set(a)


def test_long_and_hostile_pages_are_linear():
    assert html.extract("<p>x" * 20_000, set())[0].count("x") == 20_000
    assert html.extract("<a b=\"" * 20_000, set())[1] == 0
    assert html.extract("<b>" * 5_000 + "deep", set())[0] == "deep"
    pages = ["<div>" * 16_000, "</b>" * 50_000, "<p>" + "<b>" * 16_000 + "<table>" + "<form>" * 16_000, "<ul>" + "<b>" * 16_000 + "<li>" * 16_000, "<li><div>" * 16_000, "<p><span>" * 16_000 + "</div>" * 16_000, "<b><i></b>" * 16_000]
    for page in pages:
        began = time.perf_counter()
        html.extract(page, set())
        assert time.perf_counter() - began < 2, page[:40]


def test_copies_of_a_page_are_one_page(spark):
    rows = [(k, f"http://h/{k}", f"<div><p>Text {k}</p></div>") for k in range(50)] + [(100 + k, f"http://h/c{k}", "<div><p>Text of the copies</p></div>") for k in range(20)] + [(200, "http://h/c0", "<div><p>Text of the copies</p></div>")] * 9
    out = html.extracted(spark.createDataFrame(rows, PAGES).repartition(4), share=0.05, block_share=0.05).collect()
    assert len(out) == len(rows) and all(r.removed == 0 for r in out)
    assert {r.text for r in out if r.page_id >= 100} == {"Text of the copies"}


def test_inline_elements_and_cells_stay_and_text_needs_most_pages(spark):
    rows = []
    for k in range(40):
        note = "<p>Please log in.</p>" if k < 30 else ""
        some = "<p>Released under terms.</p>" if k < 12 else ""
        rows.append((k, f"http://h/{k}", f"<aside>Menu</aside>{note}<p>This is <b>important</b> text {k}</p>{some}<table><tr><td>0</td><td>n{k}</td></tr></table>"))
    out = {r.page_id: r for r in html.extracted(spark.createDataFrame(rows, PAGES)).collect()}
    assert out[3].text == "This is important text 3\nReleased under terms.\n0\nn3" and out[3].removed == 2
    assert out[35].text == "This is important text 35\n0\nn35" and out[35].removed == 1


def _site(n):
    rows = []
    for k in range(n):
        rows.append((k, f"https://Site.example/{k}", f"<html><body><nav><a href='/'>Home</a></nav><article><p>Body {k}</p><p>{'twice' if k % 40 == 0 else k * 7}</p></article><footer>All <b>rights</b></footer></body></html>"))
    rows += [(1000 + k, "http://other.example/", f"<footer>All <b>rights</b></footer><p>{k}</p>") for k in range(3)]
    return rows


def test_template_is_removed_per_host(spark):
    df = spark.createDataFrame(_site(120), PAGES).repartition(5)
    out = {r.page_id: r for r in html.extracted(df).collect()}
    assert out[7].text == "Body 7\n49" and out[7].removed == 2
    assert out[40].text == "Body 40\ntwice"
    assert out[1000].text == "All rights\n0" and out[1000].removed == 0


@pytest.mark.parametrize("shares", [(), (0.3, 0.3), (0.02, 0.2)])
def test_against_brute_force(spark, shares):
    rows = _site(60) + _site(60)[:30] + [(3000 + k, "https://site.example/x", f"<div><ul><li>a</li><li>b{k % 7}</li></ul></div><p>again {k % 3}</p>") for k in range(25)]
    share, block = shares or (html.SHARE, html.BLOCK_SHARE)
    count, pages = collections.Counter(), collections.Counter()
    host = lambda u: u.split("/")[2].lower()
    for u, h in {(host(u), h) for _, u, h in rows}:
        pages[u] += 1
        count.update((u, s) for s in set(html.subtrees(h)))
    want = sorted((i, *html.extract(h, {s for (o, s), n in count.items() if o == host(u) and n >= 5 and n >= (block if s % 2 else share) * pages[o]})) for i, u, h in rows)
    named = dict(zip(("share", "block_share"), shares))
    assert sorted(map(tuple, html.extracted(spark.createDataFrame(rows, PAGES), **named).collect())) == want


def test_odd_rows(spark):
    extra = "host string, k long, drop string, x string"
    rows = [(1, None, "<p>a</p>"), (2, "no host", "<p>a</p>"), (3, "http://h/", None), (4, "http://h/", ""), (None, "http://h/", "<p>a</p>"), (5, "http://u:p@h:80/x?y", "<p>a</p>"), (5, "http://u:p@h:80/x?y", "<p>a</p>")] + [(9, None, "<p>a</p>")] * 8
    df = spark.createDataFrame([(*r, "q", 1, "d", "e") for r in rows], f"{PAGES}, {extra}")
    out = html.extracted(df, min_pages=3).collect()
    assert len(out) == len(rows)
    by = {r.page_id: r for r in out}
    assert by[1].text == "a" and by[2].text == "a" and by[3].text is None and by[3].removed == 0 and by[4].text == ""
    assert by[5].text == "a" and by[None].text == "a" and by[9].text == "a"
    assert html.extracted(spark.createDataFrame([], PAGES)).count() == 0
