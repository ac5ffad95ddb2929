"""Plans of pages and what is written back: places, modes, and pages that stay as they are but for the texts that change."""

import html as H
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexweave.operators import book
from lexweave.sources import html

PIECES = ["<p>", "</p>", "<div>", "</div>", "<li>", "</li>", "<ul>", "</ul>", '<a href="x&amp;y">', "<a>", "</a>", "<b>", "</b>", "<br>", "<br/>", "<img src=i>", "<h2>", "</h2>", "<ruby>漢<rt>かん</rt></ruby>", "<!-- 注 -->", "<script>var t = '</p>'; あ</script>", "<?pi x?>", "<td>", "かな", "text", " ", "\n", "&amp;", "&lt;b&gt;", "&copy", "&#x3042;", "🙂", "<", "<body>", "</body>", "<blockquote>", "</blockquote>"]


def texts(node):
    return [n for n in node.children if isinstance(n, str)] + [t for n in node.children if not isinstance(n, str) for t in texts(n)]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=40).map("".join))
def test_places_are_those_of_the_page(page):
    root = html.parsed(page)
    for t in texts(root):
        assert H.unescape(page[t.start : t.end]) == str(t) or page[t.start : t.end] == str(t)  # scripts hold no references
    for n in root.walk():
        assert n.start <= n.inner <= n.end <= n.after <= len(page)
        if n is not root:
            assert page[n.start : n.inner].lower().startswith("<" + n.tag) and n.parent.inner <= n.start
            assert n.after <= n.parent.end or n.parent is root
    edits = [(start, end, mode, head, page[start:end]) for mode, _, head, start, end, _ in html.planned(page)]
    assert html.replaced(page, []) == page
    # one text after the other, exchanged for a mark, is found again in its place
    for k, (start, end, mode, head, _) in enumerate(edits):
        out = html.replaced(page, [(start, end, mode, head, f"«{k}»")])
        assert out.startswith(page[:start]) and out.endswith(page[end:]) and f"«{k}»" in out
    done = html.replaced(page, [(*e[:4], f"«{k}»") for k, e in enumerate(edits)])
    assert all(done.count(f"«{k}»") <= 1 for k in range(len(edits)))


def test_modes_of_blocks():
    page = '<body><p>前文 <a href="a">リンクA</a> 中間 <a href="b">リンクB</a>\n後文</p><p>注<a id="n" href="c">一</a></p><h2>題 &amp; 名</h2><p> </p></body>'
    rows = html.planned(page)
    assert [(r[0], r[1], r[5]) for r in rows] == [
        ("multi_anchor", "p", "前文"), ("multi_anchor", "p", "リンクA"), ("multi_anchor", "p", "中間"), ("multi_anchor", "p", "リンクB"), ("multi_anchor", "p", "後文"),
        ("single_anchor", "p", "注一"), ("plain", "h2", "題 & 名"),
    ]
    done = html.replaced(page, [(r[3], r[4], r[0], r[2], f"{k}&") for k, r in enumerate(rows)])
    assert done == '<body><p>0&amp;<a href="a">1&amp;</a>2&amp;<a href="b">3&amp;</a>4&amp;</p><p><a id="n" href="c">5&amp;</a></p><h2>6&amp;</h2><p> </p></body>'


def test_loose_texts_and_images():
    page = '<body>一行目<b>です</b><br/>二行目<img src="i.png">三行目<div class="d">四<i>行目</i></div><div><img></div></body>'
    rows = html.planned(page)
    assert [(r[0], r[5]) for r in rows] == [("loose", "一行目です"), ("loose", "二行目"), ("image", ""), ("loose", "三行目"), ("plain", "四行目"), ("image", "")]
    done = html.replaced(page, [(r[3], r[4], r[0], r[2], "x") for r in rows if r[5]])
    assert done == '<body><p>x</p><br/><p>x</p><img src="i.png"><p>x</p><div class="d">x</div><div><img></div></body>'


def test_outer_blocks_stand_for_inner_ones():
    page = "<li>外<p>内</p>尾</li>"
    outer, inner = html.planned(page)
    assert (outer[5], inner[5]) == ("外内尾", "内")
    both = [(r[3], r[4], r[0], r[2], t) for r, t in ((outer, "O"), (inner, "I"))]
    assert html.replaced(page, both) == "<li>O</li>" and html.replaced(page, both[1:]) == "<li>外<p>I</p>尾</li>"
    # texts of a block with links give way to a whole block within it
    page = '<li><a>一</a><p>二</p><a>三</a></li>'
    edits = [(r[3], r[4], r[0], r[2], f"{r[0][0]}{k}") for k, r in enumerate(html.planned(page))]
    assert html.replaced(page, edits) == "<li><a>m0</a><p>p3</p><a>m2</a></li>"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "<p>夜の<a>犬</a>と<a>猫</a></p><h1>第一章</h1>"), (2, None), (3, ""), (4, "<p>plain english</p>"), (5, "<p>" * 2000 + "夜" * 50_000)]
    return spark.createDataFrame(rows, "page_id long, html string")


def test_plan_and_write_back_through_books(spark, pages):
    plan = html.text_plan(html.plan(pages), spark.createDataFrame([(1, 0, "第一章"), (4, 0, "only in contents")], "id long, ord int, title string"))
    rows = [(r.id, r.seq, r.mode, r.text) for r in plan.orderBy("id", "seq").collect()]
    assert rows[:6] == [(1, 0, "multi_anchor", "夜の"), (1, 1, "multi_anchor", "犬"), (1, 2, "multi_anchor", "と"), (1, 3, "multi_anchor", "猫"), (1, 4, "plain", "第一章"), (1, 5, "toc", "第一章")]
    assert [r for r in rows if r[0] == 4] == [(4, 0, "toc", "only in contents")] and [len(r[3]) for r in rows if r[0] == 5] == [50_000]
    results = spark.createDataFrame([(1, 0, "夜の", "夜里的"), (1, 1, "犬", "狗<>"), (1, 3, "猫", ""), (1, 4, "第一章", "第一章 开始"), (1, 5, "第一章", "别的")], "id long, seq int, text string, translation string")
    done = book.written_back(plan, results)
    out = {r.id: r.html for r in html.written(pages, done).collect()}
    before = {r.page_id: r.html for r in pages.collect()}
    assert out[1] == "<p>夜里的<a>狗&lt;&gt;</a>と<a>猫</a></p><h1>第一章 开始</h1>"
    assert {k: out[k] for k in (2, 3, 4, 5)} == {k: before[k] for k in (2, 3, 4, 5)}
    assert {r.title: r.translation for r in book.title_map(done).collect()} == {"第一章": "第一章 开始"}  # as the heading has it


def test_pages_stay_when_nothing_changes(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")
    plan = html.plan(pages).withColumn("seq", html.F.col("pos"))
    same = html.written(pages, plan.withColumn("translation", html.F.col("text")))
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, pages.collect()))
    other = {r.id: r.html for r in html.written(pages, plan.withColumn("translation", html.F.lit("Ω"))).collect()}
    tags = re.compile("<[^>]*>")
    for r in random.Random(1).sample(pages.collect(), 20):
        # head, script, comments and footer are no blocks
        assert other[r.page_id].split("<nav>")[0] == r.html.split("<nav>")[0] and other[r.page_id].split("<footer>")[1] == r.html.split("<footer>")[1]
        assert "Ω" in other[r.page_id] and len(tags.findall(other[r.page_id])) <= len(tags.findall(r.html))
