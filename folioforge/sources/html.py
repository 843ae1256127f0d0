"""HTML pages as chapters, with the standard library's tolerant parser."""

from __future__ import annotations

import re
from html import escape, unescape
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
DROPPED = frozenset("script style nav header footer".split())
#: Elements before which an open paragraph ends.
BLOCKS = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: Prefixes that pages of packages declare, and characters that XML does not allow.
PREFIXES = ("epub", "xml")
NOT_XML = "[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]"
_NAME = re.compile(r"(?:(\w+):)?[A-Za-z_][\w.-]*", re.A)
#: An ampersand that begins no closed reference.
_OPEN = re.compile(r"&(?!(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);)")


def xml_text(text: str) -> str:
    return re.sub(NOT_XML, "", text)


def _is_name(name: str) -> bool:
    """Whether XML takes a tag or an attribute of this name without further declarations."""
    m = _NAME.fullmatch(name)
    return bool(m) and (m[1] is None or m[1] in PREFIXES)


class _Body(HTMLParser):
    """Collects the title, the author and the markup of each element child of the body."""

    def __init__(self, dropped=DROPPED, loose: bool = False):
        super().__init__(convert_charrefs=True)
        self.away, self.loose = dropped, loose
        self.title = self.author = ""
        self.children: list[tuple[str, str, str]] = []  # (tag, markup, text)
        self.stack: list[str] = []
        self.out: list[str] = []
        self.text: list[str] = []
        self.dropped = 0
        self.has_body = False

    def handle_starttag(self, tag, attrs):
        given = dict(attrs)
        if tag == "meta" and (given.get("name") or "").lower() == "author":
            self.author = given.get("content") or ""
        if tag in self.away:
            self.dropped += 1
        if tag in ("html", "head", "body"):
            self.has_body |= tag == "body"
            return
        if self.dropped or (tag in ("title", "meta", "link") and not self.stack):
            if tag == "title":
                self.stack.append("title")
            return
        if not _is_name(tag):
            return
        if tag in BLOCKS and self.stack and self.stack[-1] == "p":
            self.handle_endtag("p")
        if "title" not in self.stack:
            kept = {k: v for k, v in attrs if _is_name(k)}
            self.out.append(f"<{tag}" + "".join(f' {k}="{escape(v or "")}"' for k, v in kept.items()) + ("/>" if tag in VOID else ">"))
        if tag not in VOID:
            self.stack.append(tag)
        elif not self.stack:
            self._close(tag)

    def handle_endtag(self, tag):
        if tag in self.away:
            self.dropped = max(0, self.dropped - 1)
            return
        if self.dropped or tag not in self.stack:
            return
        while self.stack:
            top = self.stack.pop()
            if top != "title":
                self.out.append(f"</{top}>")
            if top == tag:
                break
        if not self.stack and tag != "title":
            self._close(tag)

    def handle_data(self, data):
        if self.stack and self.stack[-1] == "title":
            self.title += data
        elif self.stack and not self.dropped:
            self.out.append(escape(data, quote=False))
            self.text.append(data)
        elif self.loose and self.has_body and not self.dropped and data.strip():
            self.children.append(("", escape(data, quote=False), data.strip()))

    def _close(self, tag):
        self.children.append((tag, "".join(self.out), "".join(self.text).strip()))
        self.out, self.text = [], []

    def finish(self):
        self.close()
        while self.stack:
            self.handle_endtag(self.stack[0])


def parse(page: str) -> _Body:
    p = _Body()
    p.feed(page)
    p.finish()
    return p


def whole_body(page: str) -> tuple[str, str]:
    """(first heading of level 1 to 3, body) of a page, with all that is in the body but scripts and styles."""
    p = _Body(frozenset(("script", "style")), loose=True)
    p.feed(page)
    p.finish()
    body = "".join(markup for _, markup, _ in p.children)
    head = re.search(r"<h([1-3])(?:\s[^>]*)?>(.*?)</h\1>", body, re.S)
    return unescape(re.sub("<[^>]+>", "", head[2])).strip() if head else p.title.strip(), body


def chapters(page: str, as_written: bool = False) -> list[tuple[int, str, str, str]]:
    """(idx, chapter_id, title, html body); text directly in the body belongs to no element and is left out.

    With ``as_written``, references without their semicolon (``&am``) stay as they stand in the page, in titles
    and bodies; such bodies are no XML.
    """
    if as_written:
        mark = next(c for c in map(chr, range(0xFDD0, 0x110000)) if c not in page)  # passes the parser untouched
        return [(k, i, t.replace(mark, "&"), body.replace(mark, "&")) for k, i, t, body in chapters(_OPEN.sub(mark, page))]
    p = parse(page)
    groups: list[tuple[str, list[str]]] = [(p.title.strip(), [])]
    for tag, markup, text in p.children:
        if tag in ("h1", "h2"):
            groups.append((text, []))
        groups[-1][1].append(markup)
    kept = [g for g in groups if g[1]] or groups
    return [(k, f"chapter{k:03d}", t, "\n".join(c)) for k, (t, c) in enumerate(kept, 1)]
