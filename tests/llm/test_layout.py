"""Layouts as a reader expects them, and no visible character lost or invented."""

import random
from html.parser import HTMLParser

import pytest

from verdikt.llm import layout

CASES = {
    "": "", "plain": "plain", "  a \n b ": "a b", "<p>a<p>b": "a\n\nb", "<div>a</div><div>b</div>": "a\nb", "a<br>b<br><br>c": "a\nb\n\nc",
    "<b>a</b><i> b</i>c": "a bc", "a &amp; &lt;b&gt; &eacute;": "a & <b> é", "a < b and c > d": "a < b and c > d",
    "<ul><li>a<li>b<ul><li>c</ul></ul>d": "* a\n* b\n\n  * c\n\nd", "<ol start=9><li>a<li value=20>b<li>c</ol>": "9. a\n20. b\n21. c",
    "<ul><li><p>a</p><p>b</p></li></ul>": "* a\n\n  b", "<h1>T</h1>x<hr>y": "T\n\nx\n\n---\n\ny", "<blockquote>a<br>b</blockquote>c": "  a\n  b\n\nc",
    "<pre>\n a\n  b &lt;\n</pre>": " a\n  b <", "x<!-- no <p> -->y<!---->z": "xyz", "<script>if(a<b)'</p>'</script>x": "x", "<style>.h{}</style>x": "x",
    "<title>t</title><head><meta a=b><title>u</title></head><body>x": "x", "<p hidden>a</p><p style='DISPLAY : none'>b</p><p>c": "c",
    "<style>.h, #i {display:none} div.k{visibility:hidden}</style><p class='z h'>a<p id=i>b<p class=k>c<div class=k>d<b style='visibility:visible'>e</b></div>": "c\n\ne",
    "<details>no<summary>yes</summary>no</details><details open><summary>s</summary>t</details>": "yes\ns\nt",
    "<select><option>a<option selected>b</select><input type=hidden value=q><input type=submit value=Go>": "b Go",
    "<table><tr><td>a<td>bbb<tr><td>cccc<td align=right>d</table>": "a     bbb\ncccc    d",
    "<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td colspan=2>wide one<td>d</table>": "a  b\n   c\nwide one  d",
    "<table><caption>Cap</caption><tr><th>h<td><p>x<p>y</table>": "Cap\nh  x\n\n   y",
    "<table><tr><td><table><tr><td>in<td>ner</table><td>out</table>": "in  ner  out",
    "<td>alone</td>": "alone", "<dl><dt>a<dd>b<dt>c<dd>d</dl>": "a\n  b\nc\n  d", "a</p>b": "a\n\nb", "<a href='x>y'>l</a>": "l", "<b": "", "a<p title='": "a",
    "<textarea>\nq <b></textarea>": "q <b>", "<![CDATA[a<b]]>c": "a<bc", "<q>a</q>": '"a"',
}


@pytest.mark.parametrize("page", CASES)
def test_cases(page):
    assert layout.render(page) == CASES[page]


class Visible(HTMLParser):
    def __init__(self):
        super().__init__()
        self.out, self.off = [], 0

    def handle_starttag(self, tag, attrs):
        self.off += tag in ("script", "style", "title")

    def handle_endtag(self, tag):
        self.off -= tag in ("script", "style", "title")

    def handle_data(self, data):
        if not self.off:
            self.out.append(data)


def test_no_character_is_lost():
    rng = random.Random(14)
    tags = "div p ul li b span table tr td th h2 blockquote pre section em dl dt dd center".split()
    for _ in range(300):
        parts = []
        for _ in range(rng.randint(1, 60)):
            kind = rng.random()
            tag = rng.choice(tags)
            parts.append(f"<{tag} class='c{tag}'>" if kind < 0.35 else f"</{tag}>" if kind < 0.6 else f"w{rng.randrange(999)} &eacute;" if kind < 0.95
                         else "<script>x<y</script><style>p{}</style>")
        page = "".join(parts)
        seen = Visible()
        seen.feed(page)
        seen.close()
        got = layout.render(page)
        strip = lambda t: sorted("".join(t.replace("*", "").split()))
        assert strip(got) == strip("".join(seen.out)), page


def test_hostile_pages_end():
    assert layout.render("<div>" * 5000 + "deep" + "</div>" * 5000).strip() == "deep"
    assert layout.render("<ul><li>" * 3000 + "x").count("x") == 1
    for page in ("<" * 20_000, "<a '" * 5000, '<a b="' * 5000, "<!--" * 5000, "&" * 20_000, "<table>" * 400 + "y", "<td colspan=999999 rowspan=99999999>z" * 300, "<script>" + "<" * 9000):
        layout.render(page)
    wide = "<table>" + "<tr><td>" + "x" * 50_000 + "<td>y" + "<tr><td>a<td>b" * 2000 + "</table>"
    assert len(layout.render(wide)) < 2 * len(wide)


def test_frames(spark):
    rows = [(1, "u", "<p>a"), (1, "u", "<p>a"), (2, None, None), (None, "v", ""), (4, "w", "<p>word " * 50_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'old' as text", "1 as rendered")
    got = layout.extract(df.drop("rendered")).collect()
    assert sorted(((r.page_id, r.url, r.text) for r in got), key=str) == sorted(((p, u, layout.render(h)) for p, u, h in rows), key=str)
    assert layout.extract(df.limit(0)).collect() == []


def test_depth_changes_neither_visibility_nor_layout():
    for deep in ("<font>" * 400, "<div>" * 400, "<b>" * 60_000):
        assert layout.render(deep + "a<div hidden>no<div>no</div>no</div><div style='display:none'><p>no</div><details>no<summary>s</summary>no</details>b") == "a\ns\nb"
        assert layout.render(deep + "<table><tr><td>a<td>b<tr><td>cc<td>d</table><ul><li>e<li>f</ul><pre>g  h</pre>") == "a   b\ncc  d\n\n* e\n* f\n\ng  h"
        assert layout.render(deep + "<table><tr><td>" * 3 + "x").strip() == "x"
    assert layout.render("<div hidden>" + "<i>" * 400 + "<div>no</div>no</div>yes") == "yes"


def test_one_long_cell_leaves_the_other_rows_aligned():
    page = "<table><tr><td>a<td>b<td>c<tr><td>aaaa<td>" + "x" * 61 + "<td>c<tr><td>aa<td>bbb<td>c</table>"
    assert layout.render(page).split("\n") == ["a     b    c", "aaaa  " + "x" * 61 + "  c", "aa    bbb  c"]
