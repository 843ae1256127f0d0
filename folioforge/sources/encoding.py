"""Encodings by the part of Japanese characters a decoding gives."""

from __future__ import annotations

#: Encodings tried, in order; the last never fails.
CANDIDATES = ("utf-8-sig", "utf-8", "utf-16", "shift_jis", "cp932", "euc_jp", "iso-2022-jp", "latin-1")
#: Hiragana, katakana, kanji, full-width forms.
RANGES = (("\u3040", "\u309f"), ("\u30a0", "\u30ff"), ("\u4e00", "\u9fff"), ("\uff00", "\uffef"))


def japanese_part(text: str, sample: int = 2000) -> float:
    head = text[:sample]
    return sum(any(a <= c <= b for a, b in RANGES) for c in head) / len(head) if head else 0.0


def told(raw: bytes) -> str | None:
    """The encoding that the bytes themselves tell: a byte order mark, no byte above 127, or valid UTF-8 with some."""
    if raw.startswith((b"\xff\xfe", b"\xfe\xff")):
        return "utf-16"
    if b"\x1b$" in raw or b"\0" in raw:
        return None
    try:
        raw.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return "utf-8-sig"


def detect(raw: bytes) -> str:
    """What the bytes tell, else the first candidate with most Japanese characters."""
    if (name := told(raw)) is not None:
        return name
    best, part = "utf-8", -1.0
    for name in CANDIDATES:
        try:
            got = japanese_part(raw.decode(name))
        except (UnicodeDecodeError, LookupError):
            continue
        if got > part:
            best, part = name, got
    return best


def decode(raw: bytes) -> tuple[str, str]:
    """(text, encoding); bytes the encoding does not have become U+FFFD."""
    name = detect(raw)
    return raw.decode(name, errors="replace"), name
