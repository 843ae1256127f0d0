"""Text and markup functions as Column -> Column, all inside Catalyst.

White space means ``[\\s\\u3000]`` throughout, as the ideographic space is not
in Java's ``\\s``; nothing relies on the bare ``trim``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

KANJI = "[\u4e00-\u9fff\u3400-\u4dbf々〆〇ヶ]"
DIGITS = "[0-9０-９]+"
#: Horizontal signs and their vertical presentation forms.
VERTICAL = ("、。「」『』…", "\ufe11\ufe12\ufe41\ufe42\ufe43\ufe44\ufe19")
#: What a chapter heading starts with.
HEADING = (
    "^(?:第[0-9０-９一二三四五六七八九十百千万]+[章節話部編巻]|[一二三四五六七八九十百千]+[、。\\s\u3000]|Chapter[\\s\u3000]*[0-9]+|CHAPTER[\\s\u3000]*[0-9]+"
    "|プロローグ|エピローグ|序章|終章|あとがき|まえがき|はじめに|おわりに)"
)
#: The same for headings of composed pages.
PAGE_HEADING = "^(?:第[0-9０-９一二三四五六七八九十百千万]+[章節話部編巻]|Chapter[\\s\u3000]*[0-9]+|CHAPTER[\\s\u3000]*[0-9]+|プロローグ|エピローグ|序章|終章|はじめに|おわりに|あとがき|まえがき)"
#: Titles by place in a book.
FRONT = ("まえがき", "前書き", "はじめに", "序文", "序章", "プロローグ", "凡例", "謝辞", "献辞", "扉", "preface", "introduction", "prologue", "foreword")
BACK = ("あとがき", "後書き", "おわりに", "終章", "エピローグ", "付録", "参考文献", "索引", "用語集", "年表", "著者紹介", "afterword", "epilogue", "appendix", "glossary", "bibliography")
BACK_ALONE = ("解説", "index")
NUMBERED = "^(?i)(第[0-9０-９一二三四五六七八九十百千万]+[章節話部編巻]|chapter[\\s\u3000]*[0-9]+)"
FULL_WIDTH = "".join(chr(0xFEE0 + ord(c)) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
HALF_WIDTH = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
TAGS_OR_TEXT = "<[^>]+>|[^<]+|<"


def let(value: Column, f) -> Column:
    """``f(value)``, with the value computed once however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, "^[\\s\u3000]+|[\\s\u3000]+$", "")


def is_annotated(c: Column) -> Column:
    """Ruby, notes or a ruby bar within the first 3000 characters."""
    return F.substring(c, 1, 3000).rlike("《[^》]+》|［＃[^\\]]*］|｜")


def ruby(c: Column) -> Column:
    c = F.regexp_replace(c, "｜([^《\n]+)《([^》]+)》", "<ruby>$1<rt>$2</rt></ruby>")
    return F.regexp_replace(c, f"({KANJI}+)《([^》]+)》", "<ruby>$1<rt>$2</rt></ruby>")


def clean_marks(c: Column) -> Column:
    """Without notes and without what follows a gaiji mark up to an ideographic space or line end.

    A note runs to the last closing mark before a ``]``: two notes take the text between them along.
    """
    return F.regexp_replace(F.regexp_replace(c, "［＃[^\\]]*］", ""), "※[^\u3000\n]*", "")


def _heading(c: Column, size: str) -> Column:
    return F.regexp_extract(c, f"(?:［＃{DIGITS}字下げ］)?(.+?)(?:［＃「.+?」は{size}見出し］)", 1)


def heading_level(c: Column) -> Column:
    """h1, h2 or h3 by the first of the large, middle and small heading notes; '' without one."""
    out = F.lit("")
    for level, size in (("h3", "小"), ("h2", "中"), ("h1", "大")):
        out = F.when(c.rlike(f".+?［＃「.+?」は{size}見出し］"), level).otherwise(out)
    return F.when(F.contains(c, F.lit("見出し］")), out).otherwise("")


def heading_title(c: Column, level: Column | None = None) -> Column:
    level = heading_level(c) if level is None else level
    raw = F.when(level == "h1", _heading(c, "大")).when(level == "h2", _heading(c, "中")).otherwise(_heading(c, "小"))
    return ruby(strip(clean_marks(strip(raw))))


def split_note(c: Column) -> Column:
    return F.regexp_replace(c, "(?s)［＃割注］(.+?)［＃割注終わり］", '<span class="warichu">$1</span>')


def inline_note(c: Column) -> Column:
    return F.regexp_replace(c, "（注：([^）]+)）", '<span class="fn-inline" role="doc-footnote">（注：$1）</span>')


def emphasis(c: Column) -> Column:
    """Only the note becomes an element, so the words appear twice."""
    return F.regexp_replace(c, "［＃「([^」]+)」に傍点］", "<em>$1</em>")


def annotated_line(c: Column, level: Column | None = None) -> Column:
    """A line as HTML: headings give their title, other lines all rewrites in order.

    ``level`` is :func:`heading_level` of the line where that is a column already.
    """
    level = heading_level(c) if level is None else level
    body = F.regexp_replace(emphasis(inline_note(split_note(c))), f"［＃{DIGITS}字下げ］", "")
    return F.when(level != "", heading_title(c, level)).otherwise(ruby(clean_marks(body)))


def escape_html(c: Column, quotes: bool = True) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *([('"', "&quot;")] if quotes else [])):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]+>", "")


def on_text_nodes(html: Column, f) -> Column:
    """``f`` applied to what lies between tags; tags stay as they are."""
    parts = F.regexp_extract_all(html, F.lit(TAGS_OR_TEXT), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(F.startswith(p, F.lit("<")), p).otherwise(f(p))), "")


def vertical_forms(html: Column) -> Column:
    return on_text_nodes(html, lambda p: F.translate(p, *VERTICAL))


def collapse_spaces(html: Column) -> Column:
    return on_text_nodes(html, lambda p: F.regexp_replace(p, "[ \t]+", " "))


def normalize_text(c: Column, full_width: bool = False) -> Column:
    """Line ends, optional half-width letters, runs of blanks, blanks at line ends, blank lines.

    Text is expected in NFC; see :func:`folioforge.sources.nfc` for the rest.
    """
    c = F.replace(c, F.lit("\r\n"), F.lit("\n"))
    c = F.translate(c, FULL_WIDTH, HALF_WIDTH) if full_width else c
    c = F.regexp_replace(F.regexp_replace(c, "[ \t]+", " "), "(?m)^[ \t]+|[ \t]+$", "")
    return F.regexp_replace(c, "\n{3,}", "\n\n")


def markdown_inline(html: Column) -> Column:
    """What is left of Markdown emphasis, over the whole HTML, attributes included."""
    for pattern, tag in (("(?s)\\*\\*(.+?)\\*\\*", "strong"), ("(?s)__(.+?)__", "strong"), ("\\*([^*<>\n]+?)\\*", "em"), ("_([^_<>\n]+?)_", "em")):
        html = F.regexp_replace(html, pattern, f"<{tag}>$1</{tag}>")
    return html


def is_upright(token: Column) -> Column:
    """True for what is set upright in one cell: two characters, or three digits or capitals."""
    n = F.length(token)
    return (n <= 2) | ((n <= 3) & (token.rlike("^[0-9]+$") | (token.rlike("[A-Z]") & ~token.rlike("[a-z]"))))


def strip_styles(html: Column) -> Column:
    out = F.regexp_replace(html, "(?is)<link[^>]+rel=[\"']stylesheet[\"'][^>]*>", "")
    return F.regexp_replace(out, "(?is)<style[^>]*>.*?</style>", "")


def safe_id(c: Column) -> Column:
    out = F.regexp_replace(c, "[^a-zA-Z0-9\\-_]", "_")
    return F.when(out == "", "img").otherwise(out)


def chapter_part(title: Column) -> Column:
    """frontmatter, bodymatter or backmatter; a numbered title is always body."""
    t = strip(title)
    low = F.lower(t)
    some = lambda words: reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])
    alone = reduce(lambda a, b: a | b, [(low == w) | F.startswith(low, F.lit(w + "\u3000")) | F.startswith(low, F.lit(w + " ")) for w in BACK_ALONE])
    return F.when(t.rlike(NUMBERED), "bodymatter").when(some(FRONT), "frontmatter").when(some(BACK) | alone, "backmatter").otherwise("bodymatter")


def second_headings(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit("(?i)<h2[^>]*>([^<]*)</h2>"), F.lit(1))


def set_section_type(html: Column, kind: Column) -> Column:
    """epub:type of chapter sections set to ``kind``."""
    has = html.rlike('<section\\b[^>]*epub:type=[^>]*>')
    return F.when(has, F.regexp_replace(html, F.lit('(<section\\b[^>]*?epub:type=")[^"]*(")'), F.concat(F.lit("$1"), kind, F.lit("$2")))).otherwise(
        F.regexp_replace(html, F.lit('(<section\\b[^>]*class="chapter-break"[^>]*?)\\s*>'), F.concat(F.lit('$1 epub:type="'), kind, F.lit('">')))
    )


def inject_styles(html: Column, hrefs: list[str]) -> Column:
    """Links to style sheets that are missing, before </head>; without a head nothing changes."""
    lines = F.array_compact(F.array(*[F.when(~F.contains(html, F.lit(f'rel="stylesheet" href="{h}"')), F.lit(f'  <link rel="stylesheet" href="{h}"/>')) for h in hrefs]))
    at = F.locate("</head>", F.lower(html))
    return F.when((at > 0) & (F.size(lines) > 0), F.concat(F.substring(html, F.lit(1), at - 1), F.array_join(lines, "\n"), F.lit("\n"), F.substring(html, at, F.length(html)))).otherwise(html)


def body_of(html: Column) -> Column:
    return strip(F.regexp_extract(html, "(?is)<body[^>]*>(.*?)</body>", 1))


def japanese_ratio(c: Column, sample: int = 2000) -> Column:
    head = F.substring(c, 1, sample)
    n = F.length(head)
    return F.when(n > 0, F.length(F.regexp_replace(head, "[^\u3040-\u309f\u30a0-\u30ff\u4e00-\u9fff]", "")) / n).otherwise(0.0)


def fitted_size(w: Column, h: Column, max_w: int, max_h: int) -> tuple[Column, Column]:
    """Width and height shrunk to fit, truncated; sizes that fit stay."""
    ratio = F.least(F.lit(max_w) / w, F.lit(max_h) / h)
    fits = (w <= max_w) & (h <= max_h)
    one = F.lit(1)
    return tuple(F.when(fits, x).otherwise(F.greatest(one, F.floor(x * ratio))).cast("int") for x in (w, h))


#: Image types by file extension.
MEDIA = {".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".gif": "image/gif", ".svg": "image/svg+xml", ".webp": "image/webp"}


def media_type(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, "(\\.[^./]+)$", 1))
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in MEDIA.items() for x in kv]), ext)


def wrapped(c: Column, width: int = 12) -> Column:
    """Lines of ``width`` characters."""
    n = F.greatest(F.ceil(F.length(c) / width).cast("int"), F.lit(0))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.substring(c, k * width + 1, F.lit(width)))).otherwise(F.array())


def hiragana(c: Column) -> Column:
    """Katakana as hiragana."""
    return F.translate(c, "".join(map(chr, range(0x30A1, 0x30F7))), "".join(map(chr, range(0x3041, 0x3097))))


#: Marks that hide text or turn its direction.
HIDDEN = "\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u2069\ufeff\u00ad"


def hidden_count(c: Column) -> Column:
    return F.length(c) - F.length(F.regexp_replace(c, f"[{HIDDEN}]", ""))


def mora_estimate(c: Column) -> Column:
    """Small kana 0.5, other kana 1, kanji 2, letters and digits 0.5; rounded up."""
    count = lambda cls: F.length(F.regexp_replace(c, f"[^{cls}]", ""))
    small, kana = count("ぁぃぅぇぉゃゅょっァィゥェォャュョッ"), count("\u3041-\u3096\u30a1-\u30f6ー")
    return F.ceil(small * 0.5 + (kana - small) + count("\u4e00-\u9fff") * 2 + count("A-Za-z0-9") * 0.5)


def head_summary(c: Column, n: int = 200, empty: float = 0.0) -> tuple[Column, Column]:
    """The first ``n`` characters, and their part of the whole to two places; ``empty`` is the part of an empty text, a null text has none."""
    head = F.substring(c, 1, n)
    return head, F.when(F.length(c) == 0, empty).otherwise(F.round(F.length(head) / F.length(c), 2))


def theme_score(title: Column, author: Column, text: Column, words: list[str], with_author: bool = False) -> Column:
    """2 for each word in the title (or author), 1 for each that is only elsewhere."""
    t, a, s = F.lower(title), F.lower(author), F.lower(F.substring(text, 1, 1000))
    corpus = F.concat(t, F.lit(" "), a, F.lit(" "), s)
    where = F.concat(t, a) if with_author else t
    return reduce(lambda x, y: x + y, [F.when(F.contains(corpus, F.lit(w)), F.when(F.contains(where, F.lit(w)), 2).otherwise(1)).otherwise(0) for w in words])
