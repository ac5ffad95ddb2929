"""EPUB books: navigation documents, notices, broken archives; pages whose text the tree loses."""

import io
import zipfile

from lexweave.sources import epub, html

PAGE = "<html><body><h1>第一章</h1><p>本文</p></body></html>"
COVER = '<html><body><img src="c.jpg"/></body></html>'


def files(data):
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return {n: z.read(n) for n in z.namelist()}


def test_navigation_is_read_and_renamed():
    nav = '<html><body><nav epub:type="landmarks"><ol><li><a href="x">Other</a></li></ol></nav>\n<nav epub:type="toc"><h2>目次</h2><ol><li id="k"><a href="a.xhtml">第一章 &amp; 夜</a><ol><li><a href="a.xhtml#s">節</a></li></ol></li><li><span>部</span><ol><li><a href="b.xhtml"> 第二章 </a></li></ol></li></ol></nav></body></html>'
    assert [p[:4] for p in epub.nav_points(nav)] == [(0, "k", "第一章 & 夜", "a.xhtml"), (1, "", "節", "a.xhtml#s"), (0, "", "部", ""), (1, "", "第二章", "b.xhtml")]
    out = epub._nav_renamed(nav, {"第一章 & 夜": "章 <一>", "第二章": "二"})
    assert out == nav.replace("第一章 &amp; 夜", "章 &lt;一&gt;").replace(" 第二章 ", "二")
    assert epub._nav_renamed(nav, {}) == nav and list(epub.nav_points("<p>no contents</p>")) == []


def test_a_notice_goes_after_the_cover_once():
    book = epub.new_book("題", "ja", [("cover.xhtml", "表紙", COVER), ("a.xhtml", "第一章", PAGE)])
    page = epub.notice_page("one\n\ntwo <b>", {"title": "題"}, "原題", "n")
    once = epub.rewritten(book, {}, {}, notice=page)
    twice = epub.rewritten(once, {}, {}, notice=page)
    assert files(once) == files(twice) and files(once)[epub.NOTICE_FILE].decode() == page
    order = [d["file_name"] for d in epub.read_book("x", once)]
    assert order == ["cover.xhtml", epub.NOTICE_FILE, "a.xhtml", "nav.xhtml"]
    assert html.visible_text(html.parsed(page)).endswith("onetwo <b>[[ja:原題]]題n")
    other = epub.rewritten(epub.new_book("題", "ja", [("a.xhtml", "第一章", PAGE)]), {}, {}, notice=page)
    assert [d["file_name"] for d in epub.read_book("x", other)][0] == epub.NOTICE_FILE
    # a page with a picture is a cover too, one with a picture and much text is none
    assert [d["file_name"] for d in epub.read_book("x", epub.rewritten(epub.new_book("題", "ja", [("p1.xhtml", "t", PAGE + "本" * 30), ("p2.xhtml", "t", COVER)]), {}, {}, notice=page))][2] == epub.NOTICE_FILE


def test_broken_archives_are_salvaged(spark, tmp_path):
    book = epub.new_book("題", "ja", [("a.xhtml", "第一章", PAGE), ("b.xhtml", "第二章", PAGE * 300)])
    end = book.rfind(b"PK\x01\x02", 0, book.find(b"PK\x05\x06"))
    cut = book[: book.find(b"PK\x01\x02")]  # without the directory at the end
    assert [d["file_name"] for d in epub.read_book("x", cut)] == ["a.xhtml", "b.xhtml", "nav.xhtml"] and end > 0
    hole = cut[:-20]  # the last file is cut off in the middle
    rows = epub.read_book("x", hole)
    assert [d["file_name"] for d in rows] == ["a.xhtml", "nav.xhtml"] and rows[0]["missing"] == ["b.xhtml"] and rows[0]["html"] == PAGE
    spoiled = bytearray(book)
    at = book.find(b"b.xhtml") + 40
    spoiled[at : at + 20] = b"\0" * 20  # the directory is whole, a file is not
    assert epub.read_book("x", bytes(spoiled))[0]["html"] == PAGE
    for k, data in enumerate((cut, hole, b"nothing")):
        (tmp_path / f"{k}.epub").write_bytes(data)
    got = epub.read(spark, str(tmp_path)).collect()
    assert sorted((r.path[-6], r.error is None) for r in got if not r.file_name or r.file_name == "a.xhtml") == [("0", True), ("1", True), ("2", False)]
    assert epub.rewritten(cut, {"a.xhtml": "<p>新</p>"}, {}) and files(epub.rewritten(cut, {"a.xhtml": "<p>新</p>"}, {}))["a.xhtml"].decode() == "<p>新</p>"
    assert [r.title for r in epub.contents(spark, str(tmp_path / "0.epub")).orderBy("ord").collect()] == ["第一章", "第二章"]


def test_pages_that_the_tree_loses_are_scanned():
    lost = "<html><head><script>var x = 1;<title>t</title></head><body><p>本文 &amp; <b>夜</b></p><!-- 注 --><div>二<br>三</div><style>p{}</style></body></html>"
    rows = html.planned(lost)
    assert [(r[0], r[5]) for r in rows] == [("loose", "本文 & 夜"), ("loose", "二"), ("loose", "三")]
    assert [b[2] for b in html.page_blocks(lost)] == ["本文 & 夜", "二", "三"]
    done = html.replaced(lost, [(r[3], r[4], r[0], r[2], f"T{k}") for k, r in enumerate(rows)])
    assert done == lost.replace("本文 &amp; <b>夜", "<p>T0</p>").replace("二", "<p>T1</p>").replace("三", "<p>T2</p>")
    whole = "<html><head><script>var x = 1;</script></head><body><p>本文</p></body></html>"
    assert [r[0] for r in html.planned(whole)] == ["plain"] and html.planned("<script>あ") == [] or html.planned("<script>あ")[0][0] == "loose"
    assert html.planned("<html><body><script>x</script></body></html>") == []
