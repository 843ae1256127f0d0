"""The markup pass over pages: a stream of tags, text, comments and instructions, rewritten inside Catalyst.

A page is cut into tokens by one pattern, each token is rewritten by what it
is, and the tokens are joined again, so comments and quoted attribute values
are never taken for tags.  A page without an element, or with a ``<`` that
begins nothing, comes back unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

ATTRIBUTES = "(?:[^<>\"']|\"[^\"]*\"|'[^']*')*"
TOKENS = rf"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<!{ATTRIBUTES}>|</?[A-Za-z]{ATTRIBUTES}>|[^<]+|<"
#: The style of vertical pages, and what comes before a page.
VERTICAL_STYLE = "writing-mode:vertical-rl;-webkit-writing-mode:vertical-rl;-epub-writing-mode:vertical-rl;text-orientation:mixed;"
PROLOGUE = "<?xml version='1.0' encoding='UTF-8'?>\n<!DOCTYPE html>\n"


def _is_tag(token: Column, name: str) -> Column:
    return token.rlike(rf"^<{name}[\s/>]")


def _attribute(token: Column, name: str) -> Column:
    """The value of an attribute; empty where it is missing."""
    found = F.regexp_extract(token, rf"\s{name}\s*=\s*(\"[^\"]*\"|'[^']*')", 1)
    return F.substring(found, F.lit(2), F.greatest(F.length(found) - 2, F.lit(0)))


def _has(token: Column, name: str) -> Column:
    return token.rlike(rf"\s{name}\s*=")


def _with(token: Column, name: str, value: Column) -> Column:
    """The tag with an attribute set: in its place, or as the last."""
    pair = F.concat(F.lit(f' {name}="'), value, F.lit('"'))
    cut = F.regexp_replace(token, rf"\s{name}\s*=\s*(?:\"[^\"]*\"|'[^']*')", "")
    return F.concat(F.regexp_extract(cut, r"(?s)^(.*?)\s*/?>$", 1), pair, F.regexp_extract(cut, r"(/?>)$", 1))


def _language(token: Column, language: str) -> Column:
    for name in ("lang", "xml:lang"):
        token = F.when(_attribute(token, name) == "", _with(token, name, F.lit(language))).otherwise(token)
    return token


def _vertical(token: Column, style: str) -> Column:
    own = _attribute(token, "style")
    new = F.regexp_replace(F.concat(own, F.lit(";" + style)), "^;+", "")
    return F.when(F.contains(own, F.lit("writing-mode")), token).otherwise(_with(token, "style", new))


def _rewritten(token: Column, language: str, style: str) -> Column:
    # document types and the XML declaration give way to the prologue
    gone = token.rlike(r"(?i)^<!doctype") | token.rlike(r"^<\?xml\s")
    return (
        F.when(gone, "").when(_is_tag(token, "html"), _language(token, language)).when(_is_tag(token, "body"), _vertical(token, style))
        .when(_is_tag(token, "img") & ~_has(token, "alt"), _with(token, "alt", F.lit(""))).otherwise(token)
    )


def page_markup(html: Column, language: str = "ja", style: str = VERTICAL_STYLE) -> Column:
    """A page with declaration and document type, languages on ``html``, the style of ``body``, and an alternative text on every image."""

    def of(tokens: Column) -> Column:
        out = F.array_join(F.transform(tokens, lambda t: _rewritten(t, language, style)), "")
        whole = F.exists(tokens, lambda t: t.rlike("^<[A-Za-z]")) & ~F.exists(tokens, lambda t: t == "<")
        return F.when(whole, F.concat(F.lit(PROLOGUE), F.regexp_replace(out, r"^\s+", ""))).otherwise(html)

    return let(F.regexp_extract_all(html, F.lit(TOKENS), F.lit(0)), of)
