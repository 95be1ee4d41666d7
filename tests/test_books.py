import io
import zipfile

import pytest

from quire.sources import docx, epub
from quire.sources.archives import CorruptArchiveError, Limits, UnsafeArchiveError, UnsupportedFormatError, is_safe_name, sniff

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
STYLES = f'<w:styles {W}><w:style w:styleId="Heading1"><w:name w:val="heading 1"/></w:style><w:style w:styleId="Mine"><w:basedOn w:val="Heading1"/><w:rPr><w:b/></w:rPr></w:style></w:styles>'


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return out.getvalue()


def paragraph(text, style=None, extra=""):
    props = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    return f"<w:p>{props}<w:r>{extra}<w:t>{text}</w:t></w:r></w:p>"


def make_docx():
    long = "a long paragraph of body text " * 5
    body = "".join(paragraph(t, s) for t, s in [("Alpha", "Heading1"), (long, None), (long, None), ("Beta", "Mine"), (long, None), (long, None), ("Gamma", "Heading1"), (long, None)])
    return zipped({"[Content_Types].xml": "<Types/>", "word/styles.xml": STYLES, "word/document.xml": f'<?xml version="1.0"?><w:document {W}><w:body>{body}<w:sectPr><w:pgSz/></w:sectPr></w:body></w:document>', "word/media/a.bin": bytes(range(256))})


def make_epub():
    text = "<p>" + "words of a story that goes on and on " * 3 + "</p>"
    page = "<html><head><title>x</title><link rel='stylesheet' href='s.css'/></head><body><div>" + "".join(f"<h2 id='c{k}'>Tale {t}</h2>{text}{text}{text}" for k, t in enumerate(("One", "Two", "Three"))) + "</div></body></html>"
    nav = "<html><body><nav epub:type='toc'><ol>" + "".join(f"<li><a href='text/a%20b.xhtml#c{k}'>Tale {k}</a></li>" for k in range(3)) + "</ol></nav></body></html>"
    opf = "<package xmlns='http://www.idpf.org/2007/opf' xmlns:dc='http://purl.org/dc/elements/1.1/'><metadata><dc:title>Tales</dc:title><dc:language>en</dc:language></metadata><manifest><item id='n' href='nav.xhtml' media-type='application/xhtml+xml' properties='nav'/><item id='a' href='text/a%20b.xhtml' media-type='application/xhtml+xml'/><item id='s' href='text/s.css' media-type='text/css'/><item id='f' href='font.ttf' media-type='font/ttf'/></manifest><spine><itemref idref='a'/></spine></package>"
    container = "<container xmlns='urn:oasis:names:tc:opendocument:xmlns:container'><rootfiles><rootfile full-path='OEBPS/b.opf'/></rootfiles></container>"
    return zipped({"mimetype": "application/epub+zip", "META-INF/container.xml": container, "OEBPS/b.opf": opf, "OEBPS/nav.xhtml": nav, "OEBPS/text/a b.xhtml": page, "OEBPS/text/s.css": "@font-face{src:url(../font.ttf)}", "OEBPS/font.ttf": b"font"})


def test_sniff():
    assert sniff(make_docx()) == "docx"
    assert sniff(make_epub()) == "epub"
    for content, error in ((b"", CorruptArchiveError), (b"%PDF-1.4", UnsupportedFormatError), (make_docx()[:200], CorruptArchiveError), (zipped({"a.txt": "x"}), UnsupportedFormatError)):
        with pytest.raises(error):
            sniff(content)


def test_unsafe_archives():
    for parts, limits in (({f"{k}": "x" for k in range(20)}, Limits(entries=5)), ({"a": "x" * 5000}, Limits(member=1000)), ({"a": "x" * 800, "b": "y" * 800}, Limits(total=1000)), ({"../../evil.xml": "x"}, Limits()), ({"a": bytes(2 << 20)}, Limits(ratio=50))):
        with pytest.raises(UnsafeArchiveError):
            sniff(zipped(parts), limits)
    assert is_safe_name("a/../b") and not is_safe_name("a\\..\\..\\b") and not is_safe_name("C:/x")


def test_docx_parse_and_clone():
    content = make_docx()
    found = docx.parse(content)
    assert [b["style_level"] for b in found["blocks"]] == [0, None, None, 0, None, None, 0, None]
    assert found["blocks"][3]["bold"] and not found["blocks"][0]["bold"]
    part = docx.clone(content, 3, 5)
    assert [b["text"][:4] for b in docx.parse(part)["blocks"]] == ["Beta", "a lo"]
    with zipfile.ZipFile(io.BytesIO(part)) as a, zipfile.ZipFile(io.BytesIO(content)) as b:
        assert a.namelist() == b.namelist()
        assert all(a.read(n) == b.read(n) for n in a.namelist() if n != docx.MAIN)
    whole = docx.clone(content, 0, 8)
    with zipfile.ZipFile(io.BytesIO(whole)) as a, zipfile.ZipFile(io.BytesIO(content)) as b:
        assert a.read(docx.MAIN) == b.read(docx.MAIN)
    assert docx.clone(content, 0, 3) == docx.clone(content, 0, 3)


def test_epub_parse_and_chapter():
    content = make_epub()
    found = epub.parse(content)
    assert [b["tag"] for b in found["blocks"]][:5] == ["h2", "p", "p", "p", "h2"]
    assert [n["href"] for n in found["nav"]] == [f"OEBPS/text/a%20b.xhtml#c{k}" for k in range(3)]
    made = epub.chapter(content, 4, 8, "Tale <Two>", "tale_two")
    assert sniff(made) == "epub"
    again = epub.parse(made)
    assert [b["tag"] for b in again["blocks"]] == ["h2", "p", "p", "p"] and again["title"] == "Tale <Two>"
    with zipfile.ZipFile(io.BytesIO(made)) as z:
        assert {"OEBPS/text/s.css", "OEBPS/font.ttf"} <= set(z.namelist())


def test_split(spark, tmp_path):
    from quire.api import split
    from quire.sources.books import save_files, verify
    from quire.sources.archives import read_files

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.docx").write_bytes(make_docx())
    (tmp_path / "in/b.epub").write_bytes(make_epub())
    (tmp_path / "in/c.docx").write_bytes(b"%PDF-1.4 no")
    done = split(spark, str(tmp_path / "in"), yes=True)
    report = {r.path.rsplit("/", 1)[1]: r for r in done.report.collect()}
    assert report["c.docx"].code == "unsupported" and report["c.docx"].skipped == "unreadable"
    assert not report["a.docx"].abstained and [c.title for c in report["a.docx"].chapters] == ["Alpha", "Beta", "Gamma"]
    assert [c.title for c in report["b.epub"].chapters] == ["Tale 0", "Tale 1", "Tale 2"] and report["b.epub"].method == "toc_authority"
    files = {(r.file): r for r in done.files.collect()}
    assert set(files) == {"00_alpha.docx", "01_beta.docx", "02_gamma.docx", "00_tale_0.epub", "01_tale_1.epub", "02_tale_2.epub"}
    assert all(r.ok for r in verify(read_files(spark, str(tmp_path / "in")).where("path not like '%c.docx'"), done.files).collect())
    assert save_files(done.files, str(tmp_path / "out")).count() == 6
