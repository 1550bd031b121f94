"""Subject, URL, address and escaping functions as native column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Reply prefixes, URL and address shapes, and caps of the data format.
REPLY_WORDS = "re|fwd?|aw|ang|sv|vs|odp|antw"
REPLY_PREFIX = rf"\s*({REPLY_WORDS})\s*[\[:\]>#]*\s*"
URL = r"""((https?|ftp)://[^\s<>"']+|www\.[^\s<>"']+)"""
ADDRESS = r"([a-zA-Z0-9._%+-]+)@([a-zA-Z0-9.-]+\.[a-zA-Z]{2,})"
#: An address begins where a run of its characters does, or where the last match ended: a search from
#: each place of a long run would take the square of its length.
ADDRESS_FROM = r"(?:(?<![a-zA-Z0-9._%+-])|\G)" + ADDRESS
SUBJECT_BYTES = 2048
URL_BYTES = 4096
LINE_BYTES = 40960

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Unicode white space, as trimming understands it.
SPACE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


#: The same characters, to be trimmed: a pattern that looks for white space before the end would begin at each of a long run.
SPACES = "".join(chr(c) for c in (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def cap_bytes(c: Column, limit: int) -> Column:
    """The longest prefix of at most limit UTF-8 bytes that ends on a character."""
    cut = F.substring(c.cast("binary"), 1, limit)
    # bytes of a split last character: a lead byte that lacks its followers
    whole = F.regexp_replace(F.decode(cut, "ISO-8859-1"), "([À-ÿ][\u0080-¿]{0,2})$", "")
    last = F.regexp_extract(F.decode(cut, "ISO-8859-1"), "([À-ÿ][\u0080-¿]*)$", 1)
    need = F.when(last < "à", 2).when(last < "ð", 3).otherwise(4)
    broken = (F.length(last) > 0) & (F.length(last) < need)
    bytes_ = F.when(broken, F.encode(whole, "ISO-8859-1")).otherwise(cut)
    return F.when(F.octet_length(c) > limit, F.decode(bytes_, "UTF-8")).otherwise(c)


def unre(subject: Column, strict_prefix: bool = False) -> Column:
    """Subject without its reply prefixes. The separator is optional, so that "Request" loses "Re";
    strict_prefix asks for one."""
    return strip(F.regexp_replace(cap_bytes(subject, SUBJECT_BYTES), f"(?iuU)^(?:{_prefix(strict_prefix)})++", ""))


def oneunre(subject: Column, strict_prefix: bool = False) -> Column:
    """Subject without one reply prefix."""
    return strip(F.regexp_replace(cap_bytes(subject, SUBJECT_BYTES), f"(?iuU)^{_prefix(strict_prefix)}", ""))


def _prefix(strict: bool) -> str:
    return REPLY_PREFIX.replace(r"[\[:\]>#]*", r"[\[:\]>#]+") if strict else REPLY_PREFIX


def find_url(line: Column) -> Column:
    """The first URL anywhere in the line, or ''."""
    return F.regexp_extract(line, f"(?iuU){URL}", 0)


def find_urls(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit(f"(?iuU){URL}"), F.lit(0))


def _replace(c: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


# Escapes of the output formats.
ATTRIBUTE_ESCAPES = (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&#39;"))
HTML_ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"), ("\t", "        "))
XML_ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"))
XML_ILLEGAL = "[^\\u0009\\u000A\\u000D\\u0020-\\uD7FF\\uE000-\\uFFFD\\x{10000}-\\x{10FFFF}]"


def escape_html_attr(c: Column) -> Column:
    return _replace(c, ATTRIBUTE_ESCAPES)


def escape_html(c: Column) -> Column:
    return _replace(c, HTML_ESCAPES)


def escape_xml(c: Column) -> Column:
    return F.regexp_replace(_replace(c, XML_ESCAPES), XML_ILLEGAL, "")


def link_urls(line: Column) -> Column:
    """Escaped text with URLs as links. Lines over LINE_BYTES are escaped alone, URLs over
    URL_BYTES too. Native: text between URLs and the URLs are zipped back together."""
    pattern = f"(?iuU){URL}"
    gaps, urls = F.split(line, pattern, -1), F.regexp_extract_all(line, F.lit(pattern), F.lit(0))

    def link(u: Column) -> Column:
        href = F.when(F.startswith(u, F.lit("www.")), F.concat(F.lit("https://"), u)).otherwise(u)
        tag = F.concat(F.lit('<a href="'), escape_html_attr(href), F.lit('" rel="noopener noreferrer">'), escape_html(u), F.lit("</a>"))
        return F.when(F.octet_length(u) > URL_BYTES, escape_html(u)).otherwise(tag)

    woven = F.array_join(F.transform(gaps, lambda g, i: F.concat(
        escape_html(g), F.coalesce(F.when(i < F.size(urls), link(F.get(urls, i))), F.lit("")))), "")
    return F.when((F.octet_length(line) > LINE_BYTES) | (F.size(urls) == 0), escape_html(line)).otherwise(woven)


def obfuscate(c: Column) -> Column:
    """Each ASCII letter, digit and @ as a numeric entity."""
    hidden = lambda x: x.between("@", "Z") | x.between("a", "z") | x.between("0", "9")
    return F.array_join(F.transform(F.split(c, ""), lambda x: F.when(
        hidden(x), F.concat(F.lit("&#"), F.ascii(x).cast("string"), F.lit(";"))).otherwise(x)), "")


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of c, which is computed once: the optimizer doesn't put an element of an array in each place that f has it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def unobfuscate(c: Column) -> Column:
    """Numeric entities as characters; those that name none vanish."""
    pattern = r"&#(\d+);"

    def char(x: Column) -> Column:
        n = x.try_cast("bigint")
        legal = (n > 0) & (n < 0x110000) & ~n.between(0xD800, 0xDFFF)
        wide = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
        return F.when(legal & (n < 128), F.char(n)).when(legal, wide).otherwise("")

    def woven(own: Column) -> Column:
        # a code for each gap but the last
        return F.array_join(F.zip_with(own["gaps"], own["codes"], lambda g, x: F.concat(g, F.coalesce(once(x, char), F.lit("")))), "")

    parts = lambda x: F.struct(F.split(x, pattern, -1).alias("gaps"), F.regexp_extract_all(x, F.lit(pattern), F.lit(1)).alias("codes"))
    return once(c, lambda x: once(parts(x), woven))


def spamify(c: Column, at: str = "_at_", domain: str | None = None, protect: bool = True, protect_id: bool = True) -> Column:
    """Addresses made useless to harvesters; domain replaces theirs, else @ becomes at."""
    if not (protect or protect_id):
        return c
    quote = lambda s: s.replace("\\", "\\\\").replace("$", "\\$")
    if domain is not None:
        return F.regexp_replace(c, ADDRESS_FROM, f"$1@{quote(domain)}")
    return F.regexp_replace(c, ADDRESS_FROM, f"$1{quote(at)}$2") if protect else c


def convchars(c: Column, chars: str) -> Column:
    return F.translate(c, chars, "_" * len(chars)) if chars else c


def stripzone(c: Column) -> Column:
    return F.regexp_replace(strip(c), r"(?<!\s)\s++\([^)]*\)\s*$", "")


def getvalue(c: Column) -> Column:
    return F.when((strip(c) == "") | (ascii_lower(strip(c)) == "none"), None).otherwise(c)


def sanitize_for_search(c: Column) -> Column:
    """Letters, digits, white space and .@-; all white space as spaces."""
    kept = F.regexp_replace(c, r"[^\p{IsAlphabetic}\p{N}.@" + SPACE[1:-1] + "-]", "")
    return F.regexp_replace(kept, SPACE, " ")


def strip_configured_prefix(subject: Column, prefix: str | None) -> Column:
    """The subject of an index row: without the list's own prefix, if anything is left."""
    if not prefix:
        return subject
    rest = strip(F.substring(subject, F.lit(len(prefix) + 1), F.length(subject)))
    return F.when(F.startswith(subject, F.lit(prefix)) & (rest != ""), rest).otherwise(subject)


# FNV-1a, 32 bits.
FNV_OFFSET, FNV_PRIME, MASK = 2166136261, 16777619, 0xFFFFFFFF


def fnv32(data: Column, seed: Column | None = None) -> Column:
    """FNV-1a of a binary column; 64-bit products don't overflow, since the prime is below 2^25."""
    start = F.lit(FNV_OFFSET).cast("bigint") if seed is None else seed
    byte = lambda i: F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("bigint")
    step = lambda h, i: ((h.bitwiseXOR(byte(i))) * F.lit(FNV_PRIME)).bitwiseAND(F.lit(MASK))
    return F.when(F.octet_length(data) > 0, F.aggregate(F.sequence(F.lit(1), F.octet_length(data)), start, step)).otherwise(start)


def message_name(msgnum: Column, msgid: Column, date: Column, nonsequential: bool = False) -> Column:
    """The file stem of a message: its number, or a hash of its id and date."""
    if not nonsequential:
        return F.lpad(msgnum.cast("string"), F.greatest(F.lit(4), F.length(msgnum.cast("string"))), F.lit("0"))
    # eight little-endian bytes of the date
    stamp = F.unhex(F.concat(*[F.lpad(F.hex(F.shiftright(date, 8 * i).bitwiseAND(F.lit(255))), 2, "0") for i in range(8)]))
    buffer = F.when(date != 0, F.concat(F.coalesce(msgid, F.lit("")).cast("binary"), stamp)).otherwise(F.coalesce(msgid, F.lit("")).cast("binary"))
    low = lambda n: F.lower(F.lpad(F.hex(n.bitwiseAND(F.lit(MASK))), 8, "0"))
    return F.concat(low(fnv32(buffer)), low(date))


def message_filename(name: Column, suffix: str = "html") -> Column:
    return F.concat(name, F.lit(f".{suffix}"))


def message_path(folder: Column, name: Column, suffix: str = "html", root: str | None = None) -> Column:
    parts = [F.lit(root)] if root else []
    return F.concat_ws("/", *parts, F.when(folder != "", folder), message_filename(name, suffix))


def message_url(folder: Column, page_folder: Column, name: Column, suffix: str = "html") -> Column:
    """As a link from a page: the folder is left out where the page already lives in it."""
    own = F.coalesce(folder, F.lit(""))
    inside = own == F.coalesce(page_folder, F.lit(""))
    return F.when(inside | (own == ""), message_filename(name, suffix)).otherwise(F.concat(own, F.lit("/"), message_filename(name, suffix)))


def is_rooted_path(c: Column) -> Column:
    """Absolute, or with a drive: never used as a folder."""
    return c.rlike(r"^([/\\]|.:)")


def safe_folder(c: Column) -> Column:
    return F.when(c.contains("..") | is_rooted_path(c), None).otherwise(c)


def matches_existing(a: Column, b: Column) -> Column:
    return strip(a) == strip(b)


# array helpers
def inlist(items: Column, value: Column) -> Column:
    return F.array_contains(items, value)


def inlist_pos(items: Column, value: Column) -> Column:
    """0-based, -1 if absent."""
    return (F.array_position(items, value) - 1).cast("int")


def inlist_regex_pos(patterns: list[str], value: Column) -> Column:
    """Position of the first pattern that matches value, -1 if none."""
    out = None
    for i, p in enumerate(patterns):
        out = F.when(value.rlike(p), i) if out is None else out.when(value.rlike(p), i)
    return F.lit(-1) if out is None else out.otherwise(-1)


def add_to_list(items: Column, more: Column) -> Column:
    """Ordered union without repeats."""
    return F.array_union(items, more)


def strftime_pattern(fmt: str) -> str:
    """A strftime format as a Spark date pattern."""
    # What each conversion is in Spark's pattern letters.
    known = {
        "a": "EEE", "A": "EEEE", "b": "MMM", "B": "MMMM", "d": "dd", "e": "d", "H": "HH", "I": "hh", "j": "DDD", "m": "MM", "M": "mm",
        "p": "a", "S": "ss", "y": "yy", "Y": "yyyy", "z": "xx", "Z": "z", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "D": "MM/dd/yy", "R": "HH:mm", "h": "MMM"}
    out = []
    for m in re.finditer(r"%(.)|([^%]+)|%", fmt, re.S):
        if m[1] == "%":
            out.append("%")
        elif m[1]:
            if m[1] not in known:
                raise ValueError(f"unknown conversion %{m[1]}")
            out.append(known[m[1]])
        else:
            text = m[2] or "%"
            out.append("".join(f"'{t}'" if t.isalpha() else t.replace("'", "''") for t in re.findall(r"[A-Za-z]+|[^A-Za-z]+", text)))
    return "".join(out)
