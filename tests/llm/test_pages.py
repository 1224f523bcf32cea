"""Trees, their alignment and the main text of pages."""

import html
import re

import pytest

from sparkprof.llm import dom, pages

SCHEMA = "page_id bigint, url string, html string, text string, host string, shape int"


def text(source):
    return pages.content(dom.parse(source), ("", ()), None)


@pytest.mark.parametrize("source, want", [
    ("", ""), (None, ""), ("plain &amp; simple", "plain & simple"), ("<p>a <b>b<br>c</b><p>d", "a b c\nd"),
    ("<article><p>x&nbsp;&#233;\n y</p></article><footer>f</footer>", "x é y"),
    ("<div class='site-Sidebar'>no</div><article>yes<div id=comments>no</div><p class=\"ad box\">no</p></article>", "yes"),
    ("<header>top</header><article><header><h1>T</h1></header><p>b</p></article>", "T\nb"),
    ("<article>a<script>var x='</p>';</script><style>p{}</style><!-- no --><form>no<input></form>b</article>", "a\nb"),
    ("<nav><ul><li><a href=x>m</a></ul></nav><div><div><h1>T</h1><p>long text here</p><p>and more</p></div></div>",
     "T\nlong text here\nand more"),
    ("<ARTICLE><P HIDDEN>no</P><P style='display: none'>no</P><P>yes</P></ARTICLE>", "yes"),
    ("<article><ul><li>a<li>b<ul><li>c</ul></ul><table><tr><td>1<td>2</table></article>", "a\nb\nc\n1\n2"),
    ("<div>" * 3_000 + "deep" + "</div>" * 3_000, "deep"), ("<" * 100, "<" * 100), ("</p></div>x", "x"),
    ("<main><p>m</p></main><p>outside of it</p>", "m"),
])
def test_main_text_of_a_page(source, want):
    assert text(source) == want


def plain_matching(a, b):
    """Simple tree matching without memory."""
    if a[0] != b[0]:
        return 0
    left, right = a[1], b[1]
    best = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
    for i in range(1, len(left) + 1):
        for j in range(1, len(right) + 1):
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + plain_matching(left[i - 1], right[j - 1]))
    return best[-1][-1] + 1


def test_alignment_is_a_best_matching():
    sources = [
        "<div><p>a<p>b</div><ul><li>c<li>d</ul>", "<ul><li>c</ul><div><p>a</div><p>x",
        "<div class=k><p>a</div><div><p>b<p>c<ul><li>d</ul></div>", "<div><p>b<h1>t</h1></div><div class=k><p>q</div>",
    ]
    shapes = [dom.parse(s).shape for s in sources]
    for a in shapes:
        for b in shapes:
            assert dom._matched(a, b)[0] == plain_matching(a, b)
            pairs = dom.aligned(a, b)
            assert pairs == sorted(pairs) and len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)


def page(n, body):
    return f"<html><body><div class=x1>{body}</div><div class=x2>Site of all, est. 1999, read on</div></body></html>"


def test_constant_nodes_are_template(spark):
    rows = [(i, f"https://h.example/{i}", page(i, f"<article><div>Written for everybody</div><p>story number {i} of many</p></article>"))
            for i in range(8)]
    rows += [(100 + i, "http://H.example:80/x", rows[0][2]) for i in range(5)]  # another host: one page, five times
    rows += [(200, None, None), (None, "x", "<p>no id</p>"), (201, "", ""), (0, "https://h.example/0", rows[0][2]),
             (202, "https://long.example/", "<article>" + "<p>word</p>" * 50_000 + "</article>")]
    df = spark.createDataFrame([(*r, "t", "h", 1) for r in rows], SCHEMA)
    found = {}
    for r in pages.main_text(df).collect():
        found.setdefault(r["page_id"], []).append((r["text"], r["n_chars"]))
    for i in range(1, 8):
        assert found[i] == [(f"story number {i} of many", len(f"story number {i} of many"))]
    assert len(found[0]) == 2 and len(set(found[0])) == 1
    assert found[100][0][0] == "Written for everybody\nstory number 0 of many"
    assert found[200] == found[201] == [("", 0)] and found[None] == [("no id", 5)]
    assert found[202][0][1] == 5 * 50_000 - 1


def test_pages_of_the_table(spark, small):
    df = spark.read.parquet(f"{small}/pages.parquet")
    found = {r["page_id"]: r["text"] for r in pages.main_text(df).collect()}
    for r in df.collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S).group(1)
        blocks = re.split(r"</?(?:p|h1)>", article.replace("<br>", " "))
        plain = (" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in blocks)
        assert found[r["page_id"]] == "\n".join(b for b in plain if b)
    assert pages.main_text(df.limit(0)).collect() == []


@pytest.mark.parametrize("source, want", [
    ('<main class="content has-sidebar"><p>m</p><div class=sidebar>no</div></main>', "m"),
    ('<div id=content class="no-sidebar"><p>long text</p></div><div class="widget-box">no</div>', "long text"),
    ('<article class="post comments-open"><p>a</p></article><p>out</p>', "a"),
    ('<body><div class="social">all there is</div><nav>menu</nav></body>', "all there is"),
    ("<div><article>" + "<div>" * 200 + "deep" + "</div>" * 200 + "<p>after</p></article></div><p>out</p>", "deep\nafter"),
    ("<article>" + "<div>" * 200 + "deep<nav>no</nav>" + "</div>" * 200 + "</article>", "deep"),
])
def test_names_and_depth_do_not_lose_the_article(source, want):
    assert text(source) == want


@pytest.mark.parametrize("source, want", [
    ('<article><p>a</p><div class="related-work">b</div><div class="social-studies">c</div></article>', "a\nb\nc"),
    ('<div class="share-price-history"><p>a b c</p></div>', "a b c"),
    ('<article><p>a</p><div class="related-posts">b</div><div class="comment-list">c</div><div id=commentSection>d</div></article>', "a"),
    ('<article><p>let <math><mi>x</mi></math> be <label>one</label> of them</p></article>', "let x be one of them"),
    ("<body><div id=content><section><p>long long text</p></section><section><p>and more</p></section></div><nav>n</nav></body>",
     "long long text\nand more"),
    ('<div><p>some text that is here</p><p><a href="x">all of it a link</a></p><ul><li><a href=y>menu</a></li></ul></div>',
     "some text that is here\nall of it a link"),
])
def test_no_text_is_lost_by_a_part_of_a_name_or_place(source, want):
    assert text(source) == want


def test_template_that_the_reference_page_lacks(spark):
    """An empty page or one of another layout may lend its tree to the host."""
    notice = "<div>Prices may change at any time</div>"
    rows = [(i, f"https://h.example/{i}", f"<article>{notice}<p>story {i}</p></article>") for i in range(8)]
    place = "xxhash64(page_id, url)"
    other = spark.range(100, 400).selectExpr("id AS page_id", "concat('https://h.example/', id) AS url")
    first = other.selectExpr("page_id", "url", f"{place} AS place").orderBy("place").first()
    rows.append((first["page_id"], first["url"], None))  # of the smallest hash
    df = spark.createDataFrame([(*r, "t", "h", 1) for r in rows], SCHEMA)
    assert df.selectExpr(f"min_by(page_id, {place})").first()[0] == first["page_id"]
    found = {r["page_id"]: r["text"] for r in pages.main_text(df).collect()}
    assert found == {**{i: f"story {i}" for i in range(8)}, first["page_id"]: ""}
