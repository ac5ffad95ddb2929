"""The library's own operators: registered queries against DuckDB, and small cases of what SQL can't say."""

import glob
import io
import math
import os
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from lexweave.functions import text as T
from lexweave.operators import batching, glossary, quality, runs
from lexweave.plans import catalogue, more, tables  # noqa: F401
from lexweave.plans import fixtures as X
from lexweave.sources import epub, html
from lexweave.streaming import logs


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return round(float(v), 6) if hasattr(v, "as_tuple") else v


@pytest.mark.parametrize("name", sorted(catalogue.CASE_SQL))
def test_case_equals_its_answer(spark, duck, sf_dir, name):
    compared(duck, catalogue.CASES[name](spark, sf_dir), catalogue.CASE_SQL[name])


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, duck, sf_dir, name):
    compared(duck, catalogue.QUERIES[name](spark, sf_dir), catalogue.ORACLE_SQL[name])


def compared(duck, df, sql):
    columns = sorted(df.columns)
    own = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    found = duck.sql(sql)
    assert sorted(found.columns) == columns
    other = sorted(repr(tuple(plain(r[found.columns.index(c)]) for c in columns)) for r in found.fetchall())
    assert own == other


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_other_queries_run(spark, sf_dir, name):
    assert catalogue.QUERIES[name](spark, sf_dir).count() > 0


def test_split_text():
    assert batching.split_text("  ", 5) == [] and batching.split_text(" ab ", 5) == ["ab"]
    value = "一二三。四五六！七八\n短\n" + "长" * 23
    parts = batching.split_text(value, 10)
    assert all(0 < len(p) <= 10 for p in parts) and "".join(parts).replace("\n", "") == value.replace("\n", "")
    assert batching.split_text("a\nb\ncccc", 4) == ["a\nb", "cccc"]


def test_batches_hold_their_limits(spark):
    df = spark.createDataFrame([("x", i, "w" * n) for i, n in enumerate([10] * 30 + [100, 150, 199, 60] * 4 + [900])], "lane string, ord int, text string").orderBy(F.rand(3))
    out = batching.packed(df, "lane", "ord", "text", 4, 400).toPandas()
    for (c, b), g in out.groupby(["class", "batch"]):
        assert len(g) <= {0: 8, 1: 4, 2: 1}[c] and (len(g) == 1 or g.n_chars.sum() < {0: 800, 1: 400, 2: 0}[c])
        assert g.ord.sort_values().is_monotonic_increasing


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_batches_are_those_of_one_pass(spark, parts):
    """However the order is cut into ranges, also into ranges of fewer items than a batch holds."""
    import numpy as np

    rng = np.random.default_rng(parts)
    rows = [(f"l{rng.integers(3)}", i, "w" * int(n)) for i, n in enumerate(rng.choice([1, 5, 28, 60, 150, 190, 300], 400, p=[0.3, 0.3, 0.1, 0.1, 0.1, 0.05, 0.05]))]
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = {r.ord: (r["class"], r.batch) for r in batching.packed(spark.createDataFrame(rows, "lane string, ord int, text string"), "lane", "ord", "text", 4, 400).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    state = {}
    for lane, i, t in rows:
        c = 0 if len(t) <= 30 else 1 if len(t) <= 200 else 2
        most, width = {0: (8, 800), 1: (4, 400), 2: (1, 0)}[c]
        b, n, total = state.get((lane, c), (0, 0, 0))
        if n and (n >= most or total + len(t) >= width):
            b, n, total = b + 1, 0, 0
        assert got[i] == (c, b)
        state[lane, c] = (b, n + 1, total + len(t))


def test_occurrences_keep_katakana_whole(spark):
    rows = [("ローラとロー。", "ロー", [4]), ("ローラ", "ローラ", [0]), ("aaa", "aa", [0, 1]), ("", "a", []), ("𠮷ローラ", "ローラ", [1]), ("a.b*c", "b*", [2]), ("x", "xx", [])]
    df = spark.createDataFrame(rows, "t string, term string, want array<int>")
    got = df.select("want", glossary.occurrences(F.col("t"), F.col("term")).alias("got")).collect()
    assert all(r.got == r.want for r in got)


def test_matching_both_ways_agrees(spark, sf_dir):
    docs, terms = spark.read.parquet(f"{sf_dir}/documents.parquet"), catalogue._terms(spark, sf_dir)
    one, two = (sorted(map(repr, f(docs, terms, "doc_id", "text").collect())) for f in (glossary.matches, glossary.matches_nested))
    three = sorted(map(repr, glossary.matches(docs, terms, "doc_id", "text", automaton_chars=0).collect()))
    assert one == two == three and one


def test_selection_takes_the_longest_free_place(spark):
    texts = spark.createDataFrame([(1, "abcab x ab")], "i int, t string")
    terms = spark.createDataFrame([("ab", "1"), ("abc", "2"), ("b", "3"), ("bca", "4")], "original string, translation string")
    got = glossary.selected(glossary.matches(texts, terms, "i", "t")).orderBy("place").collect()
    assert [(r.original, r.start) for r in got] == [("abc", 0), ("ab", 3), ("b", 9)]


def test_replacement_goes_in_turn(spark):
    texts = spark.createDataFrame([(1, "ローラとロー aaa"), (2, None)], "i int, t string")
    got = {r.id: r for r in glossary.replace_terms(texts, [("ロー", "罗"), ("aa", "b"), ("ba", "c")], "i", "t").collect()}
    assert got[1].text == "ローラと罗 c" and [(c.match, c.n) for c in got[1].changes] == [("ロー", 1), ("aa", 1), ("ba", 1)] and got[2].text == ""


def test_merge_keeps_what_exists(spark):
    schema = "category string, ord int, original string, translation string, aliases array<string>"
    old = spark.createDataFrame([("Item", 0, "a", "1", ["xx"])], schema)
    new = spark.createDataFrame([("Item", 0, "a", "1", ["yy", "a"]), ("Item", 1, "a", "2", []), ("Item", 2, "b", "3", None), ("Item", 3, "b", "4", None)], schema)
    got = {r.original: r for r in glossary.merged(old, new).collect()}
    assert got["a"].aliases == ["xx", "yy"] and got["b"].translation == "3" and got["b"].outcome == "added"
    assert tuple(glossary.merge_statistics(old, new).first()) == (1, 3, 2)


@pytest.mark.parametrize("text,risk,blocking", [("ありがとう", "high", True), ("这是の测试", "weak", False), ("", "none", False), (None, "none", False), ("「あ」", "low", False), ("他说学術の権威のことを知っている", "high", True)])
def test_residue(spark, text, risk, blocking):
    r = quality.classified(spark.createDataFrame([(text,)], "t string"), "t").first().residue
    assert (r.risk, r.blocking) == (risk, blocking)


def test_repair_leaves_marked_spans(spark):
    df = spark.createDataFrame([("「東」[[ja:「東京」]]的チロリ",)], "t string")
    assert df.select(quality.repaired(F.lit(""), F.col("t"))).first()[0] == "“東”[[ja:「東京」]]的烫酒壶"


def test_html_blocks():
    page = "<html><script>no</script><h1>Title &amp; more</h1><p>one<p>two<br>three <ruby>漢<rt>かん</rt></ruby><ul><li>a<li>b</ul><p>open"
    plain = lambda page: [(t, x) for t, _, x in html.page_blocks(page)]
    assert plain(page) == [("h1", "Title & more"), ("p", "one"), ("p", "twothree 漢"), ("li", "a"), ("li", "b"), ("p", "open")]
    assert plain("<h1>a</h1><p>b</p><p>c</p>") == [("h1", "a"), ("p", "b"), ("p", "c")]
    assert plain("<ul><li>a<li>b<li>c</ul><p>d</p>") == [("li", "a"), ("li", "b"), ("li", "c"), ("p", "d")]
    assert plain("bare<br>text") == [("p", "bare"), ("p", "text")] and plain(None) == []
    assert plain('<p>a<span lang="ja-JP">かな<rt>x</rt></span></p>') == [("p", "a[[ja:かな]]")]
    assert plain("<blockquote>q<p>in</p></blockquote>") == [("blockquote", "qin"), ("p", "in")]


def test_html_fallbacks():
    line = "これは本文です。" * 30
    got = html.page_blocks(f'<html><body><h1>題</h1></body></html>'), html.page_blocks(f'<html><body><span id="toc-001"></span>{line}<br/><ruby>久<rt>く</rt>堂<rt>どう</rt></ruby>は尾根を歩いた。<br/></body></html>')
    assert got[0] == [("h1", "", "題")] and got[1] == [("p", "toc-001", line), ("p", "", "久堂は尾根を歩いた。")]
    short = html.page_blocks('<html><body><span id="#pagestart"></span>本作品は電子書籍として刊行されたものです。<br/>ご利用の端末によって表示が異なることがあります。<br/></body></html>')
    assert [x for _, _, x in short] == ["本作品は電子書籍として刊行されたものです。", "ご利用の端末によって表示が異なることがあります。"]
    sparse = html.page_blocks(f"<body><h1>題</h1><div>{line}</div></body>")
    assert [x for _, _, x in sparse] == ["題", line]
    links = html.page_blocks('<body><span>目次</span><br/><a href="1">第一章　探偵力</a><br/><a href="2">第二章　なんだか</a><br/><a href="3"><ruby>前<rt>まえ</rt>口上</ruby></a></body>')
    assert [(t, x) for t, _, x in links] == [("a", "第一章　探偵力"), ("a", "第二章　なんだか"), ("a", "前口上")]
    assert [x for _, _, x in html.page_blocks("<body><p><ruby>能<rt>のう</rt>面<rt>めん</rt></ruby>島へ行く。</p><span>これは</span></body>")] == ["能面島へ行く。"]


def test_epub(spark, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></container>')
        z.writestr("O/p.opf", '<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title> Book </dc:title><dc:language>ja</dc:language></metadata><manifest><item id="b" href="b%20c.xhtml" media-type="application/xhtml+xml"/><item id="a" href="a.html" media-type="text/html"/><item id="x" href="gone.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="a"/><itemref idref="x"/><itemref idref="b"/></spine></package>')
        z.writestr("O/a.html", "<p>A</p>")
        z.writestr("O/b c.xhtml", "<p>B</p>")
    (tmp_path / "one.epub").write_bytes(data.getvalue())
    (tmp_path / "two.epub").write_bytes(b"broken")
    rows = epub.read(spark, str(tmp_path)).collect()
    good = sorted((r for r in rows if r.error is None), key=lambda r: r.doc_idx)
    assert [(r.title, r.author, r.file_name, r.html, list(r.missing)) for r in good] == [("Book", None, "O/a.html", "<p>A</p>", ["gone.xhtml"]), ("Book", None, "O/b c.xhtml", "<p>B</p>", ["gone.xhtml"])]
    assert sum(r.error is not None for r in rows) == 1


def test_epub_is_written_and_read_back(spark, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></container>')
        z.writestr("O/p.opf", '<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>本</dc:title><dc:title>old</dc:title><dc:language>ja</dc:language></metadata><manifest><item id="a" href="a.html" media-type="text/html"/><item id="n" href="toc.ncx" media-type="application/x-dtbncx+xml"/><item id="x" href="gone.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="a"/><itemref idref="x"/></spine></package>')
        z.writestr("O/toc.ncx", '<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap><navPoint id="k"><navLabel><text> 第一章 </text></navLabel><content src="a.html"/><navPoint><navLabel><text>節</text></navLabel><content src="a.html#s"/></navPoint></navPoint></navMap></ncx>')
        z.writestr("O/a.html", "<p>あ</p>")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.epub").write_bytes(data.getvalue())
    (tmp_path / "in" / "two.epub").write_bytes(b"broken")
    files = spark.read.format("binaryFile").load(str(tmp_path / "in")).select("path", "content")
    path = next(r.path for r in files.select("path").collect() if r.path.endswith("one.epub"))
    assert [(r.ord, r.depth, r.uid, r.title, r.href) for r in epub.contents(spark, str(tmp_path / "in")).orderBy("ord").collect()] == [(0, 0, "k", "第一章", "a.html"), (1, 1, None, "節", "a.html#s")]
    docs = spark.createDataFrame([(path, "O/a.html", "<p>一</p>")], "path string, file_name string, html string")
    names = spark.createDataFrame([(path, "第一章", "章一")], "path string, title string, translation string")
    books = files.select("path").withColumn("name", F.regexp_replace(F.substring_index("path", "/", -1), "epub$", "zh.epub")).withColumn("title", F.lit("书")).withColumn("direction", F.lit("ltr")).withColumn("language", F.lit("zh"))
    out = {r.path: r for r in epub.write(files, docs, names, books, f"file://{tmp_path}/out").collect()}
    assert out[path].error is None and sum(r.error is not None for r in out.values()) == 1
    assert sorted(f.name for f in (tmp_path / "out").iterdir()) == ["one.zh.epub"]
    back = epub.read(spark, str(tmp_path / "out")).collect()
    assert [(r.title, r.language, r.html, list(r.missing)) for r in back] == [("书", "zh", "<p>一</p>", [])]
    assert [(r.uid, r.title) for r in epub.contents(spark, str(tmp_path / "out")).orderBy("ord").collect()] == [("k", "章一"), ("navpoint-1", "節")]
    with zipfile.ZipFile(tmp_path / "out" / "one.zh.epub") as z:
        assert z.namelist()[0] == "mimetype" and b'page-progression-direction="ltr"' in z.read("O/p.opf")


def test_latency_control(spark):
    slow = spark.createDataFrame([("k", i, 100.0) for i in range(16)] + [("q", i, 1.0) for i in range(40)], "key string, ord int, elapsed_s double")
    got = [r for r in runs.latency_control(slow, "key", "ord", 4, 6, 50.0).orderBy("key", "ord").collect()]
    assert [(r.ord, r.batch) for r in got if r.key == "k" and r.action == "down"] == [(7, 5), (15, 4)]
    assert all(r.action == "none" for r in got if r.key == "q")


def test_stream_of_events(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text("".join(f'{{"id": "{i % 3}", "ts": "2025-01-01T00:0{i}:00Z", "outcome": "ok"}}\n' for i in range(5)))
    events = logs.deduplicated(logs.tail(spark, str(src)))
    q = events.writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("seen").count() == 3
    batch = spark.read.schema(logs.EVENT).json(str(src))
    assert logs.sessions(batch, "outcome", gap="90 seconds").collect()[0].n == 5


def test_keys_of_models_that_begin_with_g(spark):
    key = "v2:b:glm-4-flash:" + "0" * 64
    got = spark.createDataFrame([(key,)], "k string").select(*[c.alias(n) for c, n in zip(T.key_scope(F.col("k")), "pmf")]).first()
    assert (got.p, got.m, got.f) == ("b", "glm-4-flash", None)
    assert X.TEXTS.df(spark).count() == len(X.TEXTS.rows)
