"""Word documents as markup: paragraphs, headings, lists, tables, links, notes and pictures."""

from __future__ import annotations

import base64
import hashlib
import html as entities
import io
import zipfile

from quire.functions.arrow import refusing
from quire.sources.feeds import safe_xml

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
MOST = 300_000_000  # bytes that a package may unpack to
# Run properties and their elements.
STYLES = (("b", "strong"), ("i", "em"), ("u", "u"), ("strike", "s"))


class _Package:
    def __init__(self, data: bytes):
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
        except zipfile.BadZipFile:
            raise ValueError("not a Word document") from None
        if sum(i.file_size for i in self.zip.infolist()) > MOST:
            raise ValueError("the document unpacks to too much")
        self.names = set(self.zip.namelist())
        if "word/document.xml" not in self.names:
            raise ValueError("not a Word document")

    def xml(self, name: str):
        return safe_xml(self.zip.read(name)) if name in self.names else None


def _value(x, path: str, default=None):
    found = x.find(path) if x is not None else None
    return default if found is None else found.get(f"{W}val", default)


def _on(props, name: str) -> bool:
    x = props.find(W + name) if props is not None else None
    return x is not None and x.get(f"{W}val", "1") not in ("0", "false", "none")


class _Reader:
    def __init__(self, package: _Package):
        self.p = package
        rels = package.xml("word/_rels/document.xml.rels")
        self.rels = {r.get("Id"): r.get("Target") for r in (rels if rels is not None else ())}
        self.styles: dict[str, tuple[str, str]] = {}
        styles = package.xml("word/styles.xml")
        for s in styles if styles is not None else ():
            if s.tag == W + "style":
                self.styles[s.get(W + "styleId")] = ((_value(s, W + "name") or "").lower(), _value(s, W + "basedOn") or "")
        self.formats: dict[tuple[str, str], str] = {}
        numbering = package.xml("word/numbering.xml")
        if numbering is not None:
            abstract = {a.get(W + "abstractNumId"): {lv.get(W + "ilvl"): _value(lv, W + "numFmt", "bullet") for lv in a.iter(W + "lvl")} for a in numbering.iter(W + "abstractNum")}
            for n in numbering.iter(W + "num"):
                for level, kind in abstract.get(_value(n, W + "abstractNumId"), {}).items():
                    self.formats[n.get(W + "numId"), level] = kind
        self.notes: dict[tuple[str, str], tuple] = {}  # by reference and number: the note and the links of its part
        for kind in ("footnote", "endnote"):
            notes, rels = package.xml(f"word/{kind}s.xml"), package.xml(f"word/_rels/{kind}s.xml.rels")
            links = {r.get("Id"): r.get("Target") for r in (rels if rels is not None else ())}
            for n in notes.iter(W + kind) if notes is not None else ():
                if n.get(W + "type") in (None, "normal"):
                    self.notes[f"{W}{kind}Reference", n.get(W + "id")] = (n, links)
        self.used: list[tuple[str, str]] = []
        self.salt = hashlib.sha1(package.zip.read("word/document.xml")).hexdigest()[:6]  # several files may become one book

    def style(self, paragraph) -> str:
        """The name of a paragraph's style, or of one that it is based on, that means something."""
        ident = _value(paragraph, f"{W}pPr/{W}pStyle") or ""
        for _ in range(8):
            name, base = self.styles.get(ident, (ident.lower(), ""))
            if name.startswith(("heading", "title", "quote", "intense quote", "code", "caption")) or not base:
                return name
            ident = base
        return ""

    def run(self, r) -> str:
        out = []
        for x in r:
            if x.tag == W + "t":
                out.append(entities.escape(x.text or "", quote=False))
            elif x.tag == W + "tab":
                out.append(" ")
            elif x.tag in (W + "br", W + "cr"):
                out.append("<br />")
            elif x.tag == W + "drawing":
                for blip in x.iter(A + "blip"):
                    name = "word/" + (self.rels.get(blip.get(R + "embed")) or "").lstrip("/").removeprefix("word/")
                    if name in self.p.names:
                        kind = {"png": "png", "gif": "gif", "svg": "svg+xml"}.get(name.rpartition(".")[2].lower(), "jpeg")
                        out.append(f'<img src="data:image/{kind};base64,{base64.b64encode(self.p.zip.read(name)).decode()}" alt="" />')
            elif (x.tag, x.get(W + "id")) in self.notes:
                self.used.append((x.tag, x.get(W + "id")))
                n = len(self.used)
                out.append(f'<sup id="fnref-{self.salt}-{n}"><a href="#fn-{self.salt}-{n}">{n}</a></sup>')
        text, props = "".join(out), r.find(W + "rPr")
        if not text:
            return ""
        raised = _value(props, W + "vertAlign")
        for name, tag in (*STYLES, *((("vertAlign", {"superscript": "sup", "subscript": "sub"}.get(raised)),) if raised in ("superscript", "subscript") else ())):
            if _on(props, name):
                text = f"<{tag}>{text}</{tag}>"
        return text

    def inline(self, x) -> str:
        out = []
        for c in x:
            if c.tag == W + "r":
                out.append(self.run(c))
            elif c.tag == W + "hyperlink":
                to = self.rels.get(c.get(R + "id")) or (f"#{c.get(W + 'anchor')}" if c.get(W + "anchor") else "")
                out.append(f'<a href="{entities.escape(to)}">{self.inline(c)}</a>' if to else self.inline(c))
            elif c.tag in (W + "ins", W + "smartTag", W + "sdt", W + "sdtContent", W + "fldSimple"):
                out.append(self.inline(c))
        return "".join(out)

    def blocks(self, body) -> list[tuple]:
        """(kind, level, list id, html) of each paragraph and table."""
        out = []
        for x in body:
            if x.tag in (W + "sdt", W + "sdtContent", W + "ins"):
                out += self.blocks(x)
            elif x.tag == W + "tbl":
                rows = "".join("<tr>" + "".join("<td>" + "<br />".join(filter(None, (self.inline(p) for p in c.iter(W + "p")))) + "</td>" for c in r.iter(W + "tc")) + "</tr>" for r in x.iter(W + "tr"))
                out.append(("table", 0, "", f"<table>{rows}</table>"))
            elif x.tag == W + "p":
                text, style, num = self.inline(x).strip(), self.style(x), x.find(f"{W}pPr/{W}numPr")
                if num is not None and _value(num, W + "numId", "0") != "0":
                    level = _value(num, W + "ilvl", "0")
                    ordered = self.formats.get((_value(num, W + "numId"), level), "bullet") not in ("bullet", "none")
                    out.append(("ol" if ordered else "ul", int(level), _value(num, W + "numId"), text))
                elif not text:
                    continue
                elif style.startswith("heading") and style[-1:].isdigit():
                    out.append(("block", 0, "", f"<h{min(int(style[-1]), 6)}>{text}</h{min(int(style[-1]), 6)}>"))
                elif style == "title":
                    out.append(("block", 0, "", f"<h1>{text}</h1>"))
                elif "quote" in style:
                    out.append(("block", 0, "", f"<blockquote><p>{text}</p></blockquote>"))
                elif style.startswith("code"):
                    out.append(("code", 0, "", text))
                elif text in ("* * *", "***", "⁂", "—"):
                    out.append(("block", 0, "", "<hr />"))
                else:
                    out.append(("block", 0, "", f"<p>{text}</p>"))
        return out


def _lists(items: list[tuple]) -> str:
    """Nested lists from (kind, level, list id, html) rows; another list id starts anew."""
    out, open_ = [], []
    for kind, level, ident, text in items:
        while open_ and (open_[-1][1] > level or open_[-1][1] == level and open_[-1][0::2] != (kind, ident)):
            out.append(f"</li></{open_.pop()[0]}>")
        if open_ and open_[-1][1] == level:
            out.append("</li>")
        else:
            out.append(f"<{kind}>")
            open_.append((kind, level, ident))
        out.append(f"<li>{text}")
    while open_:
        out.append(f"</li></{open_.pop()[0]}>")
    return "".join(out)


@refusing
def read_word(data: bytes | None) -> dict:
    """html, title, author and description; ValueError where the data is no Word document."""
    package = _Package(data or b"")
    reader = _Reader(package)
    body = package.xml("word/document.xml").find(W + "body")
    rows, out, at = reader.blocks(body if body is not None else ()), [], 0
    while at < len(rows):
        kind, end = rows[at][0], at + 1
        same = ("ol", "ul") if kind in ("ol", "ul") else ("code",) if kind == "code" else ()
        while end < len(rows) and rows[end][0] in same:
            end += 1
        part = rows[at:end]
        out.append(_lists(part) if kind in ("ol", "ul") else "<pre><code>" + "\n".join(x[3] for x in part) + "</code></pre>" if kind == "code" else part[0][3])
        at = end
    if reader.used:
        items, own = [], reader.rels
        for n, key in enumerate(reader.used, 1):
            note, links = reader.notes[key]
            reader.rels = own | links  # a note's links are those of its own part
            items.append(f'<li id="fn-{reader.salt}-{n}">' + "".join(f"<p>{reader.inline(p).strip()}</p>" for p in note.iter(W + "p")) + f' <a href="#fnref-{reader.salt}-{n}">↩</a></li>')
        out.append(f'<ol class="footnotes">{"".join(items)}</ol>')
    core = package.xml("docProps/core.xml")
    field = lambda n: next((x.text for x in (core.iter() if core is not None else ()) if x.tag.endswith("}" + n) and x.text), None)
    return {"html": "\n".join(out), "title": field("title"), "author": field("creator"), "description": field("description")}
