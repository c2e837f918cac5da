import time

import pytest
from hypothesis import given, settings, strategies as st

from causeway.llm import html_text as ht
from causeway.llm.html_text import render

SCHEMA = "page_id bigint, url string, html string, visible string, row string"


@pytest.mark.parametrize("page, text", [
    ("", ""),
    ("plain  text\n here", "plain text here"),
    ("<p>one<p>two", "one\n\ntwo"),
    ("<div>a</div><div>b</div>c", "a\nb\nc"),
    ("a<br>b<br/><br>c", "a\nb\n\nc"),
    ("<p> x <b> y</b>z </p> ", "x yz"),
    ("a &amp; b &lt;c&gt; &eacute;&#33;", "a & b <c> é!"),
    ("<ul><li>a<li>b<ol start=9><li>c<li>d</ol><li>e</ul>", "- a\n- b\n  9. c\n  10. d\n- e"),
    ("<dl><dt>t<dd>d1<dd>d2</dl>", "t\n  d1\n  d2"),
    ("<table><tr><th>Name<th>Q<tr><td>pear<td>12<tr><td>fig<td></table>", "Name  Q\npear  12\nfig"),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"),
    ("<table><tr><td colspan=2>wide cell<td>z<tr><td>1<td>2<td>3</table>", "wide cell  z\n1  2  3"),
    ("<table><tr><td><p>x<p>y<td>z</table>", "x  z\n\ny".replace("\n\n", "\n")),
    ("<table><tr><td><table><tr><td>in<td>ner</table><td>out</table>", "in  ner  out"),
    ("<pre>  a\n\n b </pre>c", "  a\n\n b \n\nc"),
    ("<head><title>t</title><style>s</style></head><script>var x='<p>no</p>'</script>yes", "yes"),
    ("<div hidden>no</div><p style='color:red; DISPLAY : none'>no</p><template>no</template>yes", "yes"),
    ("<div style='visibility:hidden'>no<b style='visibility:visible'>yes</b></div>", "yes"),
    ("<details>no<summary>s</summary><p>no</p></details><details open><summary>t</summary>shown</details>", "s\nt\nshown"),
    ("<!-- no <p> -->a<![CDATA[x]]>b<!doctype html>", "ab"),
    ("<select><option>a<option>b</select><textarea> c\n d</textarea>", "a\nb\n c\n d"),
    ("</p></div>a</b>b<p", "ab<p"),
    ("<a href=\"x>y\">link</a> <a href='unclosed>z</a>", "link z"),
    ("<nav>n</nav><footer>f &copy;</footer>", "n\nf ©"),
    ("<script>never ended <p>x", ""),
    ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"),
    ("<blockquote>q<br>r</blockquote>s", "  q\n  r\n\ns"),
    ("<pre>\n  two</pre>", "  two"), ("<pre>\r\na</pre>", "a"), ("x<pre>\n\na</pre>", "x\n\n\na"),
    ("<ol reversed><li>a<li>b<li>c</ol>", "3. a\n2. b\n1. c"), ("<ol reversed start=9><li>a<li>b</ol>", "9. a\n8. b"),
    ("<ol><li value=4>a<li>b<li value=-1>c<li value=x>d</ol>", "4. a\n5. b\n-1. c\n0. d"),
    ("a<b>c</b>d</x y<!-- z", "acd</x y"), ("a<!-- b > c", "a"), ("a > b <!doctype c", "a > b"),
])
def test_pages(page, text):
    assert render(page) == text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(
    ["<p>", "</p>", "<li>", "<ul>", "</ul>", "<table>", "</table>", "<tr>", "<td>", "</td>", "<td colspan=3>", "<b>", "</b>", "<br>",
     "<pre>", "</pre>", "<div", ">", "<", "\"", "word", " ", "\n", "<li></li>", "<blockquote>", "</li>", "<ol>", "</ol>", "<dd>"]), max_size=30))
def test_broken_pages_never_fail_and_lose_no_words(parts):
    page = "".join(parts)
    text = render(page)
    # Words that can't be inside a tag are all shown.
    shown = sum(1 for i, p in enumerate(parts) if p == "word" and "<div" not in parts[:i] and "<" not in parts[:i])
    assert text.count("word") >= shown


def test_depth_and_length():
    assert render("<div>" * 50000 + "x") == "x"
    assert render("<p>a" * 20000).count("a") == 20000
    assert render("<ul><li>" * 300 + "x").endswith("- x")


@pytest.mark.parametrize("unit", ["x", "<x", "</x", "<x ", "<!x", "<x\"", "</", "<", "<!-- ", "<x y='"])
@pytest.mark.parametrize("end", ["", ">"])
def test_unended_tags_take_linear_time(unit, end):
    page = ("<" + unit if unit == "x" else "") + unit * (1_000_000 // len(unit)) + end
    start = time.perf_counter()
    render(page)
    assert time.perf_counter() - start < 8


def test_rows(spark):
    rows = [(1, "u", "<p>a", "v", "r"), (1, "u", "<p>a", "v", "r"), (2, None, None, None, None), (None, "u", "", "v", "r")]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = sorted(((r.row.page_id, r.visible, r.row.visible) for r in ht.extract(frame).collect()), key=str)
    assert got == sorted([(1, "a", "v"), (1, "a", "v"), (2, None, None), (None, "", "v")], key=str)
    assert ht.extract(frame.limit(0)).count() == 0
