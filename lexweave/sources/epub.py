"""EPUB books as rows: bibliography, documents and contents, through Spark's binary files; broken archives become rows with an error. Translated books are written the same way, one a task."""

from __future__ import annotations

import io
import posixpath
import struct
import urllib.parse
import uuid
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Iterator
from html import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.sources import html as H

SCHEMA = "path string, title string, author string, publisher string, language string, doc_idx int, file_name string, html string, missing array<string>, error string"
_DC = "{http://purl.org/dc/elements/1.1/}"


def salvaged(data: bytes) -> bytes:
    """An archive of the files that can still be read in a broken one: from their own headers, as the directory at the end is gone or wrong."""
    out, at, names = io.BytesIO(), data.find(b"PK\x03\x04"), set()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        while at >= 0 and len(data) >= at + 30:
            _, flags, method, _, _, _, packed, size, name_n, extra_n = struct.unpack_from("<HHHHHIIIHH", data, at + 4)
            name = data[at + 30 : at + 30 + name_n].decode("utf-8", "replace")
            start, content = at + 30 + name_n + extra_n, None
            if method == 8:
                inflater = zlib.decompressobj(-15)
                try:
                    content = inflater.decompress(data[start:])
                    content = content if inflater.eof else None  # cut off in the middle
                except zlib.error:
                    content = None
                start = len(data) - len(inflater.unused_data) if content is not None else start
            elif method == 0 and not flags & 8 and len(data) >= start + packed:
                content, start = data[start : start + packed], start + packed
            if content is not None and name not in names and not name.endswith("/"):
                names.add(name)
                z.writestr(name, content)
            at = data.find(b"PK\x03\x04", max(start, at + 4))
    if "META-INF/container.xml" not in names:
        raise zipfile.BadZipFile("no container is left")
    return out.getvalue()


def opened(data: bytes) -> zipfile.ZipFile:
    """An archive, what can be salvaged of it if it is broken."""
    try:
        book = zipfile.ZipFile(io.BytesIO(data))
        if book.testzip() is None:
            return book
    except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, struct.error):
        pass
    return zipfile.ZipFile(io.BytesIO(salvaged(data)))


def read_book(path: str, data: bytes) -> list[dict]:
    """A row per document in spine order; manifest items without a file are left out and named in missing."""
    try:
        book = opened(data)
        names = set(book.namelist())
        root = ET.fromstring(book.read("META-INF/container.xml"))
        package_path = next(e.get("full-path") for e in root.iter() if e.tag.endswith("rootfile"))
        package = ET.fromstring(book.read(package_path))
        top = posixpath.dirname(package_path)
        first = lambda tag: next((e.text.strip() for e in package.iter(f"{_DC}{tag}") if e.text and e.text.strip()), None)
        said = {"path": path, "title": first("title"), "author": first("creator"), "publisher": first("publisher"), "language": first("language")}
        items, missing = {}, []
        for e in package.iter():
            if e.tag.endswith("}item"):
                href = e.get("href", "")
                found = next((n for n in (posixpath.normpath(posixpath.join(top, h)) for h in (href, urllib.parse.unquote(href))) if n in names), None)
                if found is None:
                    missing.append(href)
                elif e.get("media-type") in ("application/xhtml+xml", "text/html") or found.lower().endswith((".html", ".xhtml", ".htm")):
                    items[e.get("id")] = found
        spine = [e.get("idref") for e in package.iter() if e.tag.endswith("}itemref")]
        order = list(dict.fromkeys([i for i in spine if i in items] + list(items)))
        return [said | {"doc_idx": k, "file_name": items[i], "html": book.read(items[i]).decode("utf-8", "replace"), "missing": missing, "error": None} for k, i in enumerate(order)] or [said | {"doc_idx": None, "file_name": None, "html": None, "missing": missing, "error": None}]
    except (KeyError, ValueError, OSError, zipfile.BadZipFile, ET.ParseError, StopIteration) as e:
        return [dict.fromkeys(("title", "author", "publisher", "language", "doc_idx", "file_name", "html", "missing")) | {"path": path, "error": f"{type(e).__name__}: {e}"}]


def read(spark: SparkSession, path: str) -> DataFrame:
    """Documents of all books under a path."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for p, data in part.itertuples(index=False):
                out = pd.DataFrame(read_book(p, data))
                yield out[[c.split()[0] for c in SCHEMA.split(", ")]].astype({"doc_idx": "Int32"})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, SCHEMA)


_OPF, _NCX, _DIRECTION = "http://www.idpf.org/2007/opf", "http://www.daisy.org/z3986/2005/ncx/", "page-progression-direction"
TOC = "path string, ord int, depth int, uid string, title string, href string"


def _package(book: zipfile.ZipFile) -> tuple[str, ET.Element]:
    root = ET.fromstring(book.read("META-INF/container.xml"))
    path = next(e.get("full-path") for e in root.iter() if e.tag.endswith("rootfile"))
    return path, ET.fromstring(book.read(path))


def _contents(book: zipfile.ZipFile) -> tuple[str, ET.Element] | None:
    """The table of contents in its own file, if the book has one."""
    path, package = _package(book)
    names = set(book.namelist())
    hrefs = [e.get("href", "") for e in package.iter() if e.tag.endswith("}item") and e.get("media-type") == "application/x-dtbncx+xml"]
    found = next((n for h in hrefs if (n := posixpath.normpath(posixpath.join(posixpath.dirname(path), urllib.parse.unquote(h)))) in names), None)
    return (found, ET.fromstring(book.read(found))) if found else None


def _nav(book: zipfile.ZipFile) -> tuple[str, str] | None:
    """The navigation document of an EPUB 3 book: its name and source."""
    path, package = _package(book)
    names = set(book.namelist())
    hrefs = [e.get("href", "") for e in package.iter() if e.tag.endswith("}item") and "nav" in (e.get("properties") or "").split()]
    found = next((n for h in hrefs if (n := posixpath.normpath(posixpath.join(posixpath.dirname(path), urllib.parse.unquote(h)))) in names), None)
    return (found, book.read(found).decode("utf-8", "replace")) if found else None


def nav_points(source: str) -> Iterator[tuple[int, str, str, str, H.Node]]:
    """(depth, id, title, href, element) of the entries of a navigation document's table of contents, depth first.

    An entry is the link, or else the heading, that a list item begins with.
    """
    root = H.parsed(source)
    navs = [n for n in root.walk() if n.tag == "nav"]
    top = next((n for n in navs if "toc" in n.attrs.get("epub:type", "").split() or n.attrs.get("role") == "doc-toc"), navs[0] if navs else None)
    for li in top.walk() if top else ():
        entry = next((c for c in li.children if isinstance(c, H.Node) and c.tag in ("a", "span")), None) if li.tag == "li" else None
        if entry is not None:
            depth, up = 0, li.parent
            while up is not top and up is not None:
                depth, up = depth + (up.tag == "li"), up.parent
            yield depth, entry.attrs.get("id") or li.attrs.get("id", ""), H.visible_text(entry), entry.attrs.get("href", ""), entry


def _nav_renamed(source: str, titles: dict[str, str]) -> str:
    """A navigation document with the titles that the map names replaced, and nothing else of it changed."""
    return H.replaced(source, [(e.inner, e.end, "plain", "", titles[title]) for _, _, title, _, e in nav_points(source) if title in titles])


#: Names of the notice, signs of a cover in names, characters that a page with a picture may have as a cover.
NOTICE_ID, NOTICE_FILE = "translation-notice", "translation-notice.xhtml"
COVERS, COVER_CHARS = ("cover", "frontcover", "titlepage", "封面"), 20


def notice_page(text: str, said: dict[str, str | None] | None = None, original_title: str = "", note: str = "") -> str:
    """A page of its own: a line a paragraph, what is said of the book, the original title marked as Japanese, and a note."""
    lines = [f"<p>{escape(x.strip())}</p>" for x in text.splitlines() if x.strip()]
    if original_title:
        lines.append(f'<p class="original"><span lang="ja">{escape(original_title)}</span></p>')
    lines += [f'<p class="{k}">{escape(v)}</p>' for k, v in (said or {}).items() if v]
    if note:
        lines.append(f'<p class="note">{escape(note)}</p>')
    return f'<?xml version="1.0" encoding="utf-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml"><head><title>{NOTICE_ID}</title></head><body>{"".join(lines)}</body></html>'


def _is_cover(book: zipfile.ZipFile, top: str, item: ET.Element | None, ref: str) -> bool:
    """By its names, or as a page with a picture and hardly any text."""
    if item is None:
        return any(c in ref.lower() for c in COVERS)
    if any(c in f"{ref} {item.get('id', '')} {item.get('href', '')} {item.get('properties') or ''}".lower() for c in COVERS):
        return True
    name = posixpath.normpath(posixpath.join(top, urllib.parse.unquote(item.get("href", ""))))
    if name not in book.namelist():
        return False
    root = H.parsed(book.read(name).decode("utf-8", "replace"))
    body = next((n for n in root.walk() if n.tag == "body"), root)
    return any(n.tag in ("img", "svg", "image") for n in body.walk()) and H.compact(H.visible_text(body)) <= COVER_CHARS


def _with_notice(book: zipfile.ZipFile, path: str, package: ET.Element, page: str) -> dict[str, bytes]:
    """Put the notice into manifest and spine, after the cover if one of the first three documents is that; one that is there is moved and written anew."""
    top = posixpath.dirname(path)
    manifest = next(e for e in package.iter() if e.tag.endswith("}manifest"))
    spine = next(e for e in package.iter() if e.tag.endswith("}spine"))
    items = {e.get("id"): e for e in manifest}
    for old in [e for e in manifest if e.get("id") == NOTICE_ID]:
        manifest.remove(old)
    for old in [e for e in spine if e.get("idref") == NOTICE_ID]:
        spine.remove(old)
    ET.SubElement(manifest, f"{{{_OPF}}}item", {"id": NOTICE_ID, "href": NOTICE_FILE, "media-type": "application/xhtml+xml"})
    covers = [k for k, ref in enumerate(list(spine)[:3]) if _is_cover(book, top, items.get(ref.get("idref")), ref.get("idref", ""))]
    ref = ET.Element(f"{{{_OPF}}}itemref", {"idref": NOTICE_ID})
    spine.insert(covers[0] + 1 if covers else 0, ref)
    return {posixpath.normpath(posixpath.join(top, NOTICE_FILE)): page.encode()}


def new_book(title: str, language: str, documents: list[tuple[str, str, str]]) -> bytes:
    """An EPUB 3 book of documents (file name, title, html) in order, with a navigation document."""
    items = "".join(f'<item id="d{k}" href="{escape(n)}" media-type="application/xhtml+xml"/>' for k, (n, _, _) in enumerate(documents))
    refs = "".join(f'<itemref idref="d{k}"/>' for k in range(len(documents)))
    entries = "".join(f'<li><a href="{escape(n)}">{escape(t, quote=False)}</a></li>' for n, t, _ in documents)
    files = {
        "META-INF/container.xml": '<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="book.opf" media-type="application/oebps-package+xml"/></rootfiles></container>',
        "book.opf": f'<?xml version="1.0" encoding="utf-8"?><package xmlns="{_OPF}" version="3.0" unique-identifier="id"><metadata xmlns:dc="{_DC.strip("{}")}"><dc:identifier id="id">{escape(title)}</dc:identifier><dc:title>{escape(title)}</dc:title><dc:language>{escape(language)}</dc:language></metadata>'
        f'<manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>{items}</manifest><spine>{refs}</spine></package>',
        "nav.xhtml": f'<?xml version="1.0" encoding="utf-8"?><html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><title>{escape(title)}</title></head><body><nav epub:type="toc"><ol>{entries}</ol></nav></body></html>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(zipfile.ZipInfo("mimetype"), "application/epub+zip", zipfile.ZIP_STORED)
        for name, text in [*files.items(), *((n, h) for n, _, h in documents)]:
            z.writestr(name, text)
    return out.getvalue()


def _points(root: ET.Element) -> Iterator[tuple[int, ET.Element]]:
    """Entries of a table of contents, depth first, with their depths; a stack, since they may nest deeply."""
    stack = [(0, e) for e in reversed(root.findall(f".//{{{_NCX}}}navMap/{{{_NCX}}}navPoint"))]
    while stack:
        depth, e = stack.pop()
        yield depth, e
        stack += [(depth + 1, c) for c in reversed(e.findall(f"{{{_NCX}}}navPoint"))]


def _label(point: ET.Element) -> ET.Element | None:
    return point.find(f"{{{_NCX}}}navLabel/{{{_NCX}}}text")


def contents(spark: SparkSession, path: str) -> DataFrame:
    """(path, ord, depth, uid, title, href) of all books' entries of contents, depth first; blank titles are left out."""
    def rows(p: str, data: bytes) -> Iterator[tuple]:
        try:
            book = opened(data)
            found = _contents(book)
            nav = None if found else _nav(book)
        except (KeyError, ValueError, OSError, zipfile.BadZipFile, ET.ParseError, StopIteration):
            return
        if nav:
            yield from ((p, k, depth, uid or None, title, href) for k, (depth, uid, title, href, _) in enumerate(nav_points(nav[1])) if title)
            return
        for k, (depth, e) in enumerate(_points(found[1]) if found else ()):
            label, target = _label(e), e.find(f"{{{_NCX}}}content")
            title = ((label.text if label is not None else "") or "").strip()
            if title:
                yield p, k, depth, e.get("id"), title, "" if target is None else target.get("src", "")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([r for p, data in part.itertuples(index=False) for r in rows(p, data)], columns=[c.split()[0] for c in TOC.split(", ")])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, TOC)


def rewritten(data: bytes, documents: dict[str, str], titles: dict[str, str], title: str | None = None, direction: str | None = None, language: str | None = None, notice: str | None = None) -> bytes:
    """An archive with documents and titles of contents replaced, its own title, reading direction and language set, entries without ids numbered, manifest items without a file left out with what refers to them, and a notice page put in after the cover."""
    book = opened(data)
    names = set(book.namelist())
    for prefix, uri in (("", _OPF), ("dc", _DC.strip("{}")), ("opf", _OPF)):
        ET.register_namespace(prefix, uri)
    path, package = _package(book)
    top = posixpath.dirname(path)
    gone = set()
    for manifest in [e for e in package.iter() if e.tag.endswith("}manifest")]:
        for item in list(manifest):
            forms = {posixpath.normpath(posixpath.join(top, h)) for h in (item.get("href", ""), urllib.parse.unquote(item.get("href", "")))}
            if not forms & names:
                gone.add(item.get("id"))
                manifest.remove(item)
    for spine in [e for e in package.iter() if e.tag.endswith("}spine")]:
        for ref in [r for r in spine if r.get("idref") in gone]:
            spine.remove(ref)
        if direction:
            spine.set(_DIRECTION, direction)
    for tag, value in (("title", title), ("language", language)):
        own = list(package.iter(f"{_DC}{tag}"))
        if value and own:
            own[0].text = value
            for metadata in [e for e in package.iter() if e.tag.endswith("}metadata")]:
                for other in own[1:]:
                    if other in list(metadata):
                        metadata.remove(other)
    added = _with_notice(book, path, package, notice) if notice else {}
    changed = {path: ET.tostring(package, encoding="utf-8", xml_declaration=True), **{n: t.encode() for n, t in documents.items()}, **added}
    nav = _nav(book)
    if nav and titles:
        changed[nav[0]] = _nav_renamed(nav[1], titles).encode()
    found = _contents(book)
    if found:
        ET.register_namespace("", _NCX)
        number = 0
        for _, e in _points(found[1]):
            if not e.get("id"):
                number += 1
                e.set("id", f"navpoint-{number}")
            label = _label(e)
            if label is not None and (label.text or "").strip() in titles:
                label.text = titles[(label.text or "").strip()]
        changed[found[0]] = ET.tostring(found[1], encoding="utf-8", xml_declaration=True)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        # the type comes first, and as it is
        z.writestr(zipfile.ZipInfo("mimetype"), "application/epub+zip", zipfile.ZIP_STORED)
        for n in [*book.namelist(), *(n for n in added if n not in names)]:
            if n != "mimetype":
                z.writestr(n, changed[n] if n in changed else book.read(n))
    return out.getvalue()


def write(originals: DataFrame, documents: DataFrame, titles: DataFrame, books: DataFrame, folder: str) -> DataFrame:
    """Write translated books and return (path, written, error).

    originals: (path, content binary); documents: (path, file_name, html) that changed; titles: (path, title, translation) of
    contents; books: (path, name, title, direction, language, and notice where given: the text of a page after the cover). A book is rewritten by one task, under a name of its own that is
    moved into place when complete, so a lost or repeated task leaves no half book.
    """
    docs = documents.groupBy("path").agg(F.collect_list(F.struct("file_name", "html")).alias("docs"))
    names = titles.groupBy("path").agg(F.collect_list(F.struct("title", "translation")).alias("names"))
    asked = books if "notice" in books.columns else books.withColumn("notice", F.lit(None).cast("string"))
    own = originals.select("path", "content").join(asked, "path").join(docs, "path", "left").join(names, "path", "left").select("path", "name", "title", "direction", "language", "notice", "docs", "names", "content")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(folder)
        store.create_dir(top, recursive=True)
        for part in parts:
            rows = []
            for p, name, title, direction, language, notice, docs, names, content in part.itertuples(index=False):
                try:
                    data = rewritten(content, {d["file_name"]: d["html"] for d in docs if d["html"]} if docs is not None else {}, {n["title"]: n["translation"] for n in names} if names is not None else {}, title, direction, language, notice_page(notice) if notice else None)
                    own_name = f"{top}/.{uuid.uuid4().hex}.part"
                    with store.open_output_stream(own_name, compression=None) as f:
                        f.write(data)
                    store.move(own_name, f"{top}/{name}")
                    rows.append((p, f"{folder}/{name}", None))
                except (KeyError, ValueError, OSError, zipfile.BadZipFile, ET.ParseError, StopIteration) as e:
                    rows.append((p, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "written", "error"])

    return own.mapInPandas(run, "path string, written string, error string")
