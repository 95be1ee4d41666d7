"""EPUB: blocks of its documents, navigation, and files of single chapters."""

from __future__ import annotations

import hashlib
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser
from urllib.parse import unquote
from xml.etree import ElementTree

from .archives import is_safe_name
from .blocks import CONTAINERS, PARAGRAPHS

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_URL = re.compile(r"""url\(\s*['"]?([^'")]+)['"]?\s*\)|@import\s+['"]([^'"]+)['"]""", re.I)


class Node:
    def __init__(self, tag: str, attrs: dict[str, str], at: int):
        self.tag, self.attrs, self.children, self.span = tag, attrs, [], [at, at]

    def elements(self) -> list[Node]:
        return [x for x in self.children if isinstance(x, Node)]

    def walk(self) -> Iterator[Node]:
        for x in self.elements():
            yield x
            yield from x.walk()

    def strings(self) -> Iterator[str]:
        for x in self.children:
            if isinstance(x, Node):
                if x.tag not in ("script", "style"):
                    yield from x.strings()
            else:
                yield x

    def text(self) -> str:
        return " ".join(s for x in self.strings() if (s := x.strip()))


class _Tree(HTMLParser):
    def __init__(self, source: str):
        super().__init__(convert_charrefs=True)
        self.lines = [0]
        for m in re.finditer("\n", source):
            self.lines.append(m.end())
        self.root = Node("", {}, 0)
        self.open = [self.root]
        self.source = source
        self.feed(source)
        self.close()
        for node in self.open:
            node.span[1] = len(source)

    def _at(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = Node(tag, {k: v or "" for k, v in attrs}, self._at())
        self.open[-1].children.append(node)
        node.span[1] = self._at() + len(self.get_starttag_text() or "")
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        if any(n.tag == tag for n in self.open[1:]):
            stop = self.source.find(">", self._at()) + 1
            while True:
                node = self.open.pop()
                node.span[1] = stop if node.tag == tag else self._at()
                if node.tag == tag:
                    return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def block_nodes(body: Node) -> Iterator[Node]:
    """The block elements in reading order: containers with block elements directly inside are descended."""
    for node in body.elements():
        if node.tag in CONTAINERS and any(x.tag in (*PARAGRAPHS, "table", *CONTAINERS) for x in node.elements()):
            yield from block_nodes(node)
        else:
            yield node


class Book:
    def __init__(self, content: bytes):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            self.parts = {m.filename: z.read(m.filename) for m in z.infolist() if not m.is_dir() and is_safe_name(m.filename)}
        container = ElementTree.fromstring(self.parts["META-INF/container.xml"])
        self.opf = next(x.get("full-path") for x in container.iter() if x.tag.endswith("}rootfile"))
        package = ElementTree.fromstring(self.parts[self.opf])
        local = lambda x: x.tag.rpartition("}")[2]
        self.title = next((x.text or "" for x in package.iter() if local(x) == "title"), "")
        self.language = next((x.text or "en" for x in package.iter() if local(x) == "language"), "en")
        self.items = [dict(x.attrib) for x in package.iter() if local(x) == "item"]
        self.spine = [x.get("idref") for x in package.iter() if local(x) == "itemref"]
        folder = posixpath.dirname(self.opf)
        for item in self.items:
            item["path"] = posixpath.normpath(posixpath.join(folder, unquote(item.get("href", ""))))

    def documents(self) -> list[dict]:
        """Content documents in the order of the manifest; the navigation document isn't one."""
        return [i for i in self.items if i.get("media-type") in ("application/xhtml+xml", "text/html") and "nav" not in i.get("properties", "").split() and i["path"] in self.parts]

    def tree(self, path: str) -> tuple[str, Node, Node]:
        source = self.parts[path].decode("utf-8", "replace")
        root = _Tree(source).root
        return source, root, next((n for n in root.walk() if n.tag == "body"), root)

    def navigation(self) -> list[dict]:
        """(ord, title, level, href), the hrefs relative to the book's own folder, from the navigation document or the NCX."""
        out: list[dict] = []
        nav = next((i for i in self.items if "nav" in i.get("properties", "").split() and i["path"] in self.parts), None)
        if nav:
            _, root, _ = self.tree(nav["path"])
            place = next((n for n in root.walk() if n.tag == "nav" and "toc" in n.attrs.get("epub:type", "toc")), root)

            def listed(node: Node, level: int) -> None:
                for x in node.elements():
                    if x.tag == "a" and "href" in x.attrs:
                        out.append({"ord": len(out), "title": x.text(), "level": level, "href": _joined(nav["path"], x.attrs["href"])})
                    else:
                        listed(x, level + (x.tag in ("ol", "ul") and node.tag == "li"))

            listed(place, 0)
        ncx = next((i for i in self.items if i.get("media-type") == "application/x-dtbncx+xml" and i["path"] in self.parts), None)
        if ncx and not out:

            def points(node: ElementTree.Element, level: int) -> None:
                for x in node:
                    if x.tag.endswith("}navPoint"):
                        title = next((t.text or "" for t in x.iter() if t.tag.endswith("}text")), "")
                        src = next((c.get("src") or "" for c in x if c.tag.endswith("}content")), "")
                        out.append({"ord": len(out), "title": title.strip(), "level": level, "href": _joined(ncx["path"], src)})
                        points(x, level + 1)
                    elif x.tag.endswith("}navMap"):
                        points(x, level)

            points(ElementTree.fromstring(self.parts[ncx["path"]]), 0)
        return out


def _joined(base: str, href: str) -> str:
    file, mark, anchor = href.partition("#")
    return (posixpath.normpath(posixpath.join(posixpath.dirname(base), file)) if file else base) + mark + anchor


def resolve(base: str, ref: str) -> str:
    """A reference as a path of the archive; empty for references to elsewhere."""
    ref = re.split("[#?]", ref or "", maxsplit=1)[0].strip()
    return "" if not ref or ref.startswith(("http://", "https://", "data:", "//")) else posixpath.normpath(posixpath.join(posixpath.dirname(base), ref))


def parse(content: bytes) -> dict:
    book = Book(content)
    blocks, files, anchors = [], [], []
    for item in book.documents():
        _, _, body = book.tree(item["path"])
        for n, node in enumerate(block_nodes(body)):
            k, paragraph = len(blocks), node.tag in PARAGRAPHS
            text = node.text() if paragraph or node.tag == "table" else ""
            level = int(node.tag[1]) - 1 if re.fullmatch("h[1-6]", node.tag) else None
            inner = [*node.walk()]
            blocks.append({"index": k, "tag": node.tag, "is_paragraph": paragraph, "is_table": node.tag == "table", "text": text, "is_empty": not text, "word_count": len(text.split()), "style_id": None, "style_level": level, "bold": any(x.tag in ("b", "strong") for x in inner), "all_caps_prop": False, "max_size": None, "alignment": None, "page_break_before": False, "num": None, "anchor_id": node.attrs.get("id") or None, "starts_page": False, "starts_section": False, "starts_spine": n == 0})
            if n == 0:
                files.append({"file": item["path"], "index": k})
            for x in (node, *inner):
                anchors += [{"file": item["path"], "anchor": a, "index": k} for a in (x.attrs.get("id"), x.attrs.get("name") if x.tag == "a" else None) if a]
    return {"title": book.title, "blocks": blocks, "bookmarks": [], "links": [], "field": [], "nav": book.navigation(), "files": files, "anchors": anchors}


def assets(book: Book, path: str) -> list[str]:
    """The style sheets, images and fonts that a document uses, also over style sheets, each once."""
    source, root, _ = book.tree(path)
    todo: list[tuple[str, str]] = []
    for x in root.walk():
        ref = x.attrs.get("href") if x.tag == "link" and "stylesheet" in x.attrs.get("rel", "") else x.attrs.get("src") if x.tag == "img" else x.attrs.get("xlink:href") or x.attrs.get("href") if x.tag == "image" else None
        if ref:
            todo.append((path, ref))
        if x.tag == "style":
            todo += [(path, a or b) for a, b in _URL.findall("".join(s for s in x.children if isinstance(s, str)))]
    found: dict[str, None] = {}
    while todo:
        base, ref = todo.pop()
        at = resolve(base, ref)
        if at and is_safe_name(at) and at in book.parts and at not in found:
            found[at] = None
            if at.endswith(".css"):
                todo += [(at, a or b) for a, b in _URL.findall(book.parts[at].decode("utf-8", "replace"))]
    return sorted(found)


def chapter(content: bytes, start: int, end: int, title: str, slug: str) -> bytes:
    """A book of the blocks from start to end, with the style sheets and media their documents use; its id is a hash, not random."""
    book = Book(content)
    pieces, sheets, used, k = [], [], set(), 0
    for item in book.documents():
        source, root, body = book.tree(item["path"])
        nodes = [*block_nodes(body)]
        mine = [n for i, n in enumerate(nodes) if start <= k + i < end]
        k += len(nodes)
        if mine:
            pieces += [source[n.span[0] : n.span[1]] for n in mine]
            sheets += [s for x in root.walk() if x.tag == "link" and "stylesheet" in x.attrs.get("rel", "") and (s := resolve(item["path"], x.attrs.get("href", ""))) and s not in sheets]
            used.update(assets(book, item["path"]))
    media = {i["path"]: i.get("media-type", "application/octet-stream") for i in book.items}
    kept = sorted(used) or sorted(p for p, t in media.items() if p in book.parts and t not in ("application/xhtml+xml", "application/x-dtbncx+xml"))
    name = f"{slug}.xhtml"
    links = "".join(f'<link rel="stylesheet" type="text/css" href="{escape(s)}"/>' for s in sheets)
    safe, language = escape(title), escape(book.language)
    page = f'<?xml version="1.0" encoding="utf-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml" xml:lang="{language}"><head><title>{safe}</title>{links}</head><body>\n' + "\n".join(pieces) + "\n</body></html>\n"
    ident = hashlib.sha256(page.encode()).hexdigest()[:32]
    manifest = "".join(f'<item id="m{n}" href="{escape(p)}" media-type="{escape(media.get(p, "application/octet-stream"))}"/>' for n, p in enumerate(kept))
    opf = f'<?xml version="1.0" encoding="utf-8"?>\n<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="id">{ident}</dc:identifier><dc:title>{safe}</dc:title><dc:language>{language}</dc:language></metadata><manifest><item id="chapter" href="{name}" media-type="application/xhtml+xml"/><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>{manifest}</manifest><spine toc="ncx"><itemref idref="nav"/><itemref idref="chapter"/></spine></package>'
    nav = f'<?xml version="1.0" encoding="utf-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><title>{safe}</title></head><body><nav epub:type="toc"><ol><li><a href="{name}">{safe}</a></li></ol></nav></body></html>'
    ncx = f'<?xml version="1.0" encoding="utf-8"?>\n<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1"><head><meta name="dtb:uid" content="{ident}"/></head><docTitle><text>{safe}</text></docTitle><navMap><navPoint id="n1"><navLabel><text>{safe}</text></navLabel><content src="{name}"/></navPoint></navMap></ncx>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(zipfile.ZipInfo("mimetype"), "application/epub+zip")
        container = '<?xml version="1.0"?>\n<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'
        for path, data in (("META-INF/container.xml", container), ("content.opf", opf), ("nav.xhtml", nav), ("toc.ncx", ncx), (name, page)):
            z.writestr(zipfile.ZipInfo(path), data)
        for path in kept:
            if path not in (name, "nav.xhtml", "toc.ncx", "content.opf"):
                z.writestr(zipfile.ZipInfo(path), book.parts[path])
    return out.getvalue()
