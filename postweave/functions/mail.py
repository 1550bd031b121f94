"""Header, address and id functions as native expressions over arrays of (name, value)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import parse_mail_date
from .text import ascii_lower, strip


def parse_headers(raw: Column) -> Column:
    """Array of (name, value) in order: names lower-case, folded lines joined, up to a blank line."""
    text = F.regexp_replace(F.regexp_replace(raw, "\r\n", "\n"), r"(?s)\n\n.*$", "")
    lines = F.split(F.regexp_replace(text, r"(?:\G|(?<![ \t]))[ \t]*+\n[ \t]+", " "), "\n")
    cut = F.transform(F.filter(lines, lambda x: F.instr(x, ":") > 0), lambda x: F.struct(
        F.lower(strip(F.substring_index(x, ":", 1))).alias("name"),
        strip(F.substring(x, F.instr(x, ":") + 1, F.length(x))).alias("value")))
    return cut


def find_header(headers: Column, name: str) -> Column:
    """The first value, or null."""
    return F.try_element_at(find_headers(headers, name), F.lit(1))


def find_headers(headers: Column, name: str) -> Column:
    return F.transform(F.filter(headers, lambda h: F.lower(h["name"]) == name.lower()), lambda h: h["value"])


def unfold(raw: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(raw, "\r?\n[ \t]+", " "), "[\r\n]", "")


def address(c: Column) -> Column:
    """(name, email) of a From value: `name <addr>`, `addr (name)`, a bare address or a name."""
    open_ = F.instr(c, "<")
    close = F.instr(F.substring(c, open_, F.length(c)), ">")
    before = F.regexp_replace(strip(F.substring(c, F.lit(1), open_ - 1)), '^"+|"+$', "")
    paren = r"^([^(]*)\(([^)]*)\)?.*$"
    email_p, name_p = strip(F.regexp_extract(c, paren, 1)), strip(F.regexp_extract(c, paren, 2))
    has_paren, whole = F.instr(c, "(") > 0, strip(c)
    name = (F.when(open_ > 0, F.when((open_ > 1) & (before != ""), before))
            .when(has_paren, name_p).when(whole.contains("@"), None).otherwise(whole))
    email = (F.when(open_ > 0, F.when(close > 0, strip(F.substring(c, open_ + 1, close - 2))))
             .when(has_paren, email_p).when(whole.contains("@"), whole))
    return F.struct(name.alias("name"), email.alias("email"))


def normalize_msgid(c: Column) -> Column:
    return ascii_lower(strip(c))


def in_reply_to(value: Column, references: Column) -> Column:
    """The In-Reply-To value as it is, even empty; else the last <id> of References."""
    ids = F.filter(F.split(references, r"\s+"), lambda t: F.startswith(t, F.lit("<")) & F.endswith(t, F.lit(">")))
    return F.coalesce(value, F.try_element_at(ids, F.lit(-1)))


def received_date(headers: Column) -> Column:
    """The first positive date after the last semicolon of a Received header; 0 if none."""
    dates = F.transform(F.filter(find_headers(headers, "received"), lambda v: v.contains(";")), lambda v: parse_mail_date(F.substring_index(v, ";", -1)))
    return F.coalesce(F.try_element_at(F.filter(dates, lambda d: d > 0), F.lit(1)), F.lit(0).cast("bigint"))


def message_date(headers: Column) -> Column:
    """Date, or the first Received date, or 0."""
    own = parse_mail_date(find_header(headers, "date"))
    return F.when(own > 0, own).otherwise(received_date(headers))


def bracketed_ids(text: Column) -> Column:
    """<...> tokens in the text, brackets included, repeats kept."""
    return F.regexp_extract_all(text, F.lit("(<[^>]*>)"), F.lit(1))


def body_lines(text: Column) -> Column:
    """Lines without their ends; a final line end starts no further line; '' has none."""
    lines = F.transform(F.split(F.regexp_replace(text, r"\n\z", ""), "\n", -1), lambda x: F.regexp_replace(x, "\r$", ""))
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(lines)


def is_attachment_line(line: Column) -> Column:
    return F.startswith(line, F.lit("[Attachment: ")) & F.endswith(line, F.lit("]"))


def unflow(text: Column) -> Column:
    """Format=flowed: a line that ends in a space runs on, but for the signature mark."""
    lines = F.split(F.regexp_replace(text, r"\n\z", ""), "\n", -1)
    step = lambda acc, x: F.concat(acc, F.when(x == "-- ", F.concat(x, F.lit("\n"))).when(
        F.endswith(x, F.lit(" ")), F.concat(F.rtrim(x), F.lit(" "))).otherwise(F.concat(x, F.lit("\n"))))
    return F.when(text == "", "").otherwise(F.aggregate(lines, F.lit(""), step))


def content_type(value: Column) -> Column:
    """(type, subtype, params) of a Content-Type value; the last of repeated parameters wins."""
    parts = F.split(value, ";")
    kind = F.lower(strip(F.get(parts, F.lit(0))))
    pairs = F.transform(F.filter(F.slice(parts, 2, F.size(parts)), lambda p: p.contains("=")), lambda p: F.struct(
        F.lower(strip(F.substring_index(p, "=", 1))).alias("k"),
        F.regexp_replace(strip(F.substring(p, F.instr(p, "=") + 1, F.length(p))), '^"(.*)"$|^\'(.*)\'$', "$1$2").alias("v")))
    keys = F.array_distinct(F.transform(pairs, lambda x: x["k"]))
    params = F.map_from_arrays(keys, F.transform(keys, lambda k: F.try_element_at(F.filter(pairs, lambda x: x["k"] == k), F.lit(-1))["v"]))
    return F.struct(F.substring_index(kind, "/", 1).alias("type"), F.when(kind.contains("/"), F.substring_index(kind, "/", -1)).otherwise("").alias("subtype"), params.alias("params"))


def content_disposition(value: Column) -> Column:
    parsed = content_type(value)
    return F.struct(F.lower(strip(F.substring_index(value, ";", 1))).alias("disposition"), parsed["params"].alias("params"))
