"""EPUB packages, read and written with zipfile and ElementTree."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterable
from xml.etree import ElementTree

NS = {"c": "urn:oasis:names:tc:opendocument:xmlns:container", "o": "http://www.idpf.org/2007/opf", "d": "http://purl.org/dc/elements/1.1/"}


def package(raw: bytes) -> tuple[dict[str, str], list[tuple[str, str, bytes]], list[tuple[str, str, bytes]]]:
    """Metadata, (id, path, bytes) of documents in reading order, and of images."""
    z = zipfile.ZipFile(io.BytesIO(raw))
    root = ElementTree.fromstring(z.read("META-INF/container.xml")).find(".//c:rootfile", NS).get("full-path")
    tree = ElementTree.fromstring(z.read(root))
    base = posixpath.dirname(root)
    meta = {k: (tree.findtext(f".//d:{k}", "", NS) or "").strip() for k in ("title", "creator", "language")}
    items = {i.get("id"): (posixpath.normpath(posixpath.join(base, i.get("href"))), i.get("media-type") or "") for i in tree.iterfind(".//o:item", NS)}
    names = set(z.namelist())
    order = [r.get("idref") for r in tree.iterfind(".//o:itemref", NS) if r.get("idref") in items] or [k for k, (_, m) in items.items() if "html" in m]
    docs = [(k, items[k][0], z.read(items[k][0])) for k in order if items[k][0] in names and items[k][1] in ("application/xhtml+xml", "")]
    images = [(k, p, z.read(p)) for k, (p, m) in items.items() if m.startswith("image/") and p in names]
    return meta, docs, images


def cover(images: list[tuple[str, str, bytes]]) -> str | None:
    """The path of the first image with "cover" in its id or path."""
    return next((p for k, p, _ in images if "cover" in k.lower() or "cover" in p.lower()), None)


def without_styles(html: str) -> str:
    html = re.sub(r"<link[^>]+rel=[\"']stylesheet[\"'][^>]*>", "", html, flags=re.I)
    return re.sub(r"<style[^>]*>.*?</style>", "", html, flags=re.I | re.S)


def chapters(raw: bytes) -> list[tuple[int, str, str, str]]:
    """(idx by place in the spine, chapter_id, title, html)."""
    out = []
    for k, (_, _, data) in enumerate(package(raw)[1], 1):
        html = without_styles(data.decode("utf-8", "replace"))
        title = re.search(r"<(title|h1|h2)[^>]*>(.*?)</\1>", html, re.I | re.S)
        out.append((k, f"chapter{k:03d}", re.sub("<[^>]+>", "", title[2]).strip() if title else "", html))
    return out


def write(members: Iterable[tuple[str, bool, str | bytes]]) -> bytes:
    """A package of (path, stored, content) in the order given, with fixed times."""
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for path, stored, content in members:
            info = zipfile.ZipInfo(path, (1980, 1, 1, 0, 0, 0))
            info.compress_type = zipfile.ZIP_STORED if stored else zipfile.ZIP_DEFLATED
            z.writestr(info, content)
    return buffer.getvalue()
