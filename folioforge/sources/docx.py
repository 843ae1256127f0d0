"""Word documents, read with zipfile and ElementTree."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from html import escape, unescape
from itertools import groupby
from xml.etree import ElementTree

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
DC = "{http://purl.org/dc/elements/1.1/}"
#: Styles of titles, and of lists that are not called so.
TITLES, BULLETS, NUMBERS = ("title", "タイトル"), ("箇条書き", "リスト段落"), ("番号付きリスト",)
#: Suffixes of packed images by media type; others are .img.
IMAGE_SUFFIXES = {"image/jpeg": ".jpg", "image/png": ".png", "image/gif": ".gif", "image/svg+xml": ".svg", "image/webp": ".webp", "image/x-emf": ".emf", "image/x-wmf": ".wmf"}


def opened(raw: bytes | zipfile.ZipFile) -> zipfile.ZipFile:
    """The archive of a file's bytes; one that is open already stays, so that its directory is read once."""
    return raw if isinstance(raw, zipfile.ZipFile) else zipfile.ZipFile(io.BytesIO(raw))


def _member(z: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    return ElementTree.fromstring(z.read(name)) if name in z.NameToInfo else None


def _style_names(z: zipfile.ZipFile) -> dict[str, str]:
    """Names of styles by their ids; an id that has none is its own name."""
    tree = _member(z, "word/styles.xml")
    found = {} if tree is None else {s.get(f"{W}styleId"): s.find(f"{W}name") for s in tree.iter(f"{W}style")}
    return {k: n.get(f"{W}val") or k for k, n in found.items() if n is not None}


def _kind(style: str) -> tuple[str, int]:
    """Kind and level of the paragraphs of a style, by its name without blanks."""
    name = re.sub(r"\s", "", style).lower()
    if name in TITLES:
        return "h1", 1
    if m := re.match("(?:heading|見出し)([1-3])", name):
        return f"h{m[1]}", int(m[1])
    if name in NUMBERS or "list" in name and "number" in name:
        return "ol", 0
    return ("ul", 0) if name in BULLETS or "list" in name else ("p", 0)


def _run(r, notes: dict[str, int]) -> str:
    """A run as markup; ``notes`` counts the references to notes it knows, in their order."""
    text = refs = ""
    for t in r:
        if t.tag == f"{W}t":
            text += escape(t.text or "")
        elif t.tag == f"{W}br":
            text += "<br/>"
        elif t.tag == f"{W}footnoteReference" and t.get(f"{W}id") in notes:
            notes[""] += 1
            refs += f'<a epub:type="noteref" role="doc-noteref" href="#fn-{t.get(f"{W}id")}"><sup>{notes[""]}</sup></a>'
    for mark, tag in (("b", "strong"), ("i", "em")):
        if text and r.find(f"{W}rPr/{W}{mark}") is not None:
            text = f"<{tag}>{text}</{tag}>"
    return refs + text


def _paragraph(p, notes: dict[str, int] | None = None) -> str:
    return "".join(_run(r, notes or {}) for r in p.iter(f"{W}r"))


def blocks(raw: bytes | zipfile.ZipFile, notes: dict[str, str] | None = None) -> list[tuple[int, str, int, str]]:
    """(pos, kind, level, html): h1 to h3, ul, ol, p and tables, in the order of the body; references to notes are numbered links."""
    z = opened(raw)
    names, notes = _style_names(z), dict.fromkeys(footnotes(z) if notes is None else notes, 0) | {"": 0}
    out: list[tuple[int, str, int, str]] = []
    for e in ElementTree.fromstring(z.read("word/document.xml")).find(f"{W}body"):
        if e.tag == f"{W}p":
            s = e.find(f"{W}pPr/{W}pStyle")
            style = s.get(f"{W}val") or "" if s is not None else ""
            kind, level = _kind(names.get(style, style))
            html = _paragraph(e, notes)
            if html.strip():
                out.append((len(out), kind, level, html))
        elif e.tag == f"{W}tbl":
            rows = ["<tr>" + "".join(f"<td>{'<br/>'.join(map(_paragraph, c.iter(f'{W}p')))}</td>" for c in r.iter(f"{W}tc")) + "</tr>" for r in e.iter(f"{W}tr")]
            out.append((len(out), "table", 0, "<table>" + "".join(rows) + "</table>"))
    return out


def footnotes(raw: bytes | zipfile.ZipFile) -> dict[str, str]:
    """Footnotes by id, without separators and blank ones."""
    tree = _member(opened(raw), "word/footnotes.xml")
    if tree is None:
        return {}
    found = {n.get(f"{W}id"): "".join(map(_paragraph, n.iter(f"{W}p"))).strip() for n in tree.iter(f"{W}footnote")}
    return {k: text for k, text in found.items() if k and k not in ("-1", "0") and text}


def properties(raw: bytes | zipfile.ZipFile) -> tuple[str, str]:
    """Title and author, each empty where it is not given."""
    tree = _member(opened(raw), "docProps/core.xml")
    return ("", "") if tree is None else tuple((tree.findtext(f"{DC}{k}") or "").strip() for k in ("title", "creator"))


def images(raw: bytes | zipfile.ZipFile) -> list[tuple[str, str, bytes]]:
    """(name, media type, bytes) of the pictures that the document refers to, in the order of its relations."""
    z = opened(raw)
    relations, types = _member(z, "word/_rels/document.xml.rels"), _member(z, "[Content_Types].xml")
    if relations is None:
        return []
    given = {} if types is None else {(t.get("PartName") or "." + (t.get("Extension") or "")).lower(): t.get("ContentType") or "" for t in types}
    out = []
    for r in relations:
        path = posixpath.normpath(posixpath.join("/word", r.get("Target") or ""))
        if "image" not in (r.get("Type") or "") or r.get("TargetMode") == "External" or path[1:] not in z.NameToInfo:
            continue
        media = given.get(path.lower()) or given.get("." + path.rsplit(".", 1)[-1].lower()) or ""
        out.append((f"docx_img{len(out) + 1:03d}{IMAGE_SUFFIXES.get(media, '.img')}", media, z.read(path[1:])))
    return out


def chapters(raw: bytes | zipfile.ZipFile) -> list[tuple[str, str]]:
    """(title, body) of chapters begun by h1; neighbouring items are one list, and a chapter ends with the notes it refers to."""
    z = opened(raw)
    notes, groups = footnotes(z), [("", [])]
    for _, kind, _, content in blocks(z, notes):
        if kind == "h1":
            groups.append((unescape(re.sub("<[^>]+>", "", content)), []))
        groups[-1][1].append((kind, content))
    out = []
    for title, parts in groups:
        body = []
        for kind, run in groupby(parts, lambda b: b[0]):
            texts = [content for _, content in run]
            body += [f"<{kind}>" + "".join(f"<li>{t}</li>" for t in texts) + f"</{kind}>"] if kind in ("ul", "ol") else texts if kind == "table" else [f"<{kind}>{t}</{kind}>" for t in texts]
        used = dict.fromkeys(k for _, content in parts for k in re.findall('href="#fn-([^"]+)"', content))
        if used:
            body.append('<section epub:type="footnotes" role="doc-footnotes" class="footnotes">')
            body += [f'  <aside epub:type="footnote" role="doc-footnote" id="fn-{k}"><p>{notes[k]}</p></aside>' for k in used]
            body.append("</section>")
        if body:
            out.append((title, "\n    ".join(body)))
    return out
