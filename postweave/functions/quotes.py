"""Quoted lines, signatures and line classes as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import escape_html, link_urls

# Quote marks in order of preference, image types that are safe inline.
QUOTE_PREFIXES = ("> ", ">", "| ", "|", ": ", ":")
SAFE_IMAGES = ("image/gif", "image/jpeg", "image/jpg", "image/png", "image/webp", "image/bmp", "image/tiff")
INLINE_IMAGE = r"^\[INLINE_IMAGE:([^:\]]*):([^\]]*)\]$"


def is_quote(line: Column) -> Column:
    return line.rlike("^[>|:]")


def unquote(line: Column) -> Column:
    return F.regexp_replace(line, "^[>|:] ?", "")


def quote_depth(line: Column) -> Column:
    """Marks before the text. Groups repeat possessively: a greedy one takes a frame of the stack at each turn."""
    return F.length(F.replace(F.regexp_extract(line, "^(?:[>|:] ?)++", 0), F.lit(" "), F.lit("")))


def quote_class(line: Column) -> Column:
    depth = quote_depth(line)
    return F.when(depth > 0, F.concat(F.lit("hm-quote-"), F.least(depth, F.lit(9)).cast("string"))).otherwise("")


def quote_prefix(line: Column) -> Column:
    """The mark that the line starts with, with its space; null for others."""
    return F.nullif(F.regexp_extract(line, "^[>|:] ?", 0), F.lit(""))


def default_quote_prefix() -> Column:
    return F.lit("> ")


def is_signature_start(line: Column) -> Column:
    return F.regexp_replace(line, "\r$", "").isin("-- ", "--")


def strip_anchor_tags(line: Column) -> Column:
    """Without <a name ...>...</a>, link text included."""
    return F.regexp_replace(line, "(?is)<a name.*?</a>", "")


def is_safe_base64(c: Column) -> Column:
    """Of its letters alone: data with line breaks or spaces isn't taken for an image."""
    return c.rlike(r"\A[A-Za-z0-9+/=]+\z")


def inline_image(line: Column) -> Column:
    """An <img> for a marked inline image of a safe type; null for others."""
    kind, data = F.regexp_extract(line, INLINE_IMAGE, 1), F.regexp_extract(line, INLINE_IMAGE, 2)
    tag = F.concat(F.lit('<img src="data:'), kind, F.lit(";base64,"), data, F.lit('" alt="inline image">'))
    return F.when(kind.isin(*SAFE_IMAGES) & is_safe_base64(data), tag)


def line_kind(line: Column) -> Column:
    """blank, sig, image, quote (only > marks) or text."""
    return (F.when(F.trim(line) == "", "blank").when(is_signature_start(line), "sig")
            .when(inline_image(line).isNotNull(), "image").when(F.startswith(line, F.lit(">")), "quote").otherwise("text"))


def line_class(line: Column, in_signature: Column | None = None) -> Column:
    """CSS class of a rendered line; after a signature has begun, that of its text."""
    kind = line_kind(line)
    own = (F.when(kind == "blank", "hm-blank").when(kind == "quote", quote_class(line)).when(kind == "image", "hm-image")
           .when(kind == "sig", "hm-sig").otherwise("hm-pg"))
    if in_signature is None:
        return own
    return F.when(in_signature & kind.isin("quote", "text"), "hm-sig-text").otherwise(own)


def render_line(line: Column, css: Column) -> Column:
    """HTML of one line under its class."""
    body = F.coalesce(inline_image(line), link_urls(line))
    return (F.when(css == "hm-blank", F.lit('<div class="hm-blank"></div>')).when(css == "hm-sig", F.lit('<hr class="hm-sig">'))
            .otherwise(F.concat(F.lit('<div class="'), css, F.lit('">'), body, F.lit("</div>"))))


def render_stateless(line: Column, mode: int) -> Column:
    """0: escaped; 1: linked; 2: by class."""
    return {0: escape_html, 1: link_urls, 2: lambda c: render_line(c, line_class(c))}[mode](line)
