"""Predicates over messages and their verdict mask."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import parse_mail_date
from ..functions.mail import body_lines
from ..functions.text import ascii_lower, cap_bytes

# Bits of the verdict, caps of patterns and inputs in bytes.
DELETED, EXPIRED, FILTERED_OUT, REQUIRED, TOO_OLD, TOO_NEW = 1, 2, 4, 8, 16, 32
PATTERN_BYTES, INPUT_BYTES = 512, 65536
#: More patterns of one kind than this are matched in one pass (operators/patterns.py), with the same results.
MANY = 16


def usable(pattern: str) -> bool:
    """Whether a pattern is short enough, and well-formed for the engine that matches it; others are ignored."""
    if len(pattern.encode()) > PATTERN_BYTES:
        return False
    try:
        if (context := SparkContext._active_spark_context) is not None:
            context._jvm.java.util.regex.Pattern.compile(pattern)
            return True
        re.compile(pattern)
        return True
    except (re.error, IllegalArgumentException):
        return False


def capped(c: Column) -> Column:
    return F.when(F.octet_length(c) <= INPUT_BYTES, c).otherwise(cap_bytes(c, INPUT_BYTES))


def _any(parts: list[Column]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | p
    return out


def header_matches(headers: Column, pattern: str) -> Column:
    """`name: value`, the name or the value of any header matches."""
    if not usable(pattern):
        return F.lit(False)
    return F.exists(headers, lambda h: capped(F.concat(h["name"], F.lit(": "), h["value"])).rlike(pattern)
                    | h["name"].rlike(pattern) | capped(h["value"]).rlike(pattern))


def first_header_match(headers: Column, patterns: list[str]) -> Column:
    """Index of the first pattern that a header matches; null if none."""
    out = None
    for i, p in enumerate(patterns):
        hit = header_matches(headers, p)
        out = F.when(hit, i) if out is None else out.when(hit, i)
    return F.lit(None).cast("int") if out is None else out


def body_matches(lines: Column, pattern: str) -> Column:
    return F.exists(lines, lambda x: capped(x).rlike(pattern)) if usable(pattern) else F.lit(False)


def body_match_indices(lines: Column, patterns: list[str]) -> Column:
    """Indices of all patterns that some raw line matches."""
    hits = [F.when(body_matches(lines, p), F.lit(i)) for i, p in enumerate(patterns)]
    return F.filter(F.array(*hits), lambda x: x.isNotNull()) if hits else F.array().cast("array<int>")


def marked_deleted(headers: Column, names: tuple[str, ...]) -> Column:
    low = [n.lower() for n in names]
    return F.exists(headers, lambda h: F.lower(h["name"]).isin(low) & (ascii_lower(F.trim(h["value"])) == "yes")) if low else F.lit(False)


def expired(headers: Column, names: tuple[str, ...], now: int) -> Column:
    low = [n.lower() for n in names]
    return F.exists(headers, lambda h: F.coalesce(F.lower(h["name"]).isin(low) & (parse_mail_date(h["value"]) < now), F.lit(False))) if low else F.lit(False)


def age_mask(date: Column, older: int | None = None, newer: int | None = None) -> Column:
    """Bits for dates strictly before older and strictly after newer; undated rows have none."""
    out = F.lit(0)
    if older is not None:
        out = out + F.when((date > 0) & (date < older), TOO_OLD).otherwise(0)
    if newer is not None:
        out = out + F.when((date > 0) & (date > newer), TOO_NEW).otherwise(0)
    return out


def all_matched(results: Column) -> Column:
    """True for none at all."""
    return F.forall(results, lambda x: x)


@dataclass(frozen=True)
class Rules:
    """What filters a message; dates are seconds, now is given so that runs repeat."""

    deleted: tuple[str, ...] = ("x-no-archive",)
    expires: tuple[str, ...] = ("expires",)
    delete_msgnum: tuple[int, ...] = ()
    delete_older: int | None = None
    delete_newer: int | None = None
    filter_out: tuple[str, ...] = ()
    filter_out_full_body: tuple[str, ...] = ()
    filter_require: tuple[str, ...] = ()
    filter_require_full_body: tuple[str, ...] = ()
    now: int = 0


def _each(where: Column, patterns: tuple[str, ...], in_headers: bool, needed: str) -> list[Column]:
    """Whether each pattern matches; of many, one column: whether any or all (needed) do, which is the same to a verdict."""
    if len(patterns) <= MANY:
        return [header_matches(where, p) if in_headers else body_matches(where, p) for p in patterns]
    from .patterns import PatternSet

    own = PatternSet(list(patterns))
    n = F.size(own.header_hits(where) if in_headers else own.hits(where))
    return [n > 0 if needed == "any" else n == len(patterns)]


def verdict(rules: Rules, msgnum: Column, headers: Column, raw_body: Column, date: Column) -> Column:
    """The bit mask; 0 keeps the message. raw_body is undecoded text."""
    lines = body_lines(raw_body)
    deleted = marked_deleted(headers, rules.deleted)
    if rules.delete_msgnum:
        deleted = deleted | msgnum.isin(list(rules.delete_msgnum))
    out = _any(_each(headers, rules.filter_out, True, "any") + _each(lines, rules.filter_out_full_body, False, "any"))
    require = _each(headers, rules.filter_require, True, "all") + _each(lines, rules.filter_require_full_body, False, "all")
    bit = lambda c, n: F.when(F.coalesce(c, F.lit(False)), n).otherwise(0)
    mask = bit(deleted, DELETED) + bit(expired(headers, rules.expires, rules.now), EXPIRED) + bit(out, FILTERED_OUT)
    mask = mask + age_mask(date, rules.delete_older, rules.delete_newer)
    return (mask + bit(~all_matched(F.array(*require)), REQUIRED) if require else mask).cast("int")


def with_ids(rows: DataFrame, require_msgids: bool = True) -> DataFrame:
    """Rows with a Message-ID header, even an empty one. Applied after numbering."""
    return rows.filter(F.col("msgid").isNotNull()) if require_msgids else rows


def article_state(is_deleted: Column, delete_level: int) -> Column:
    """What a message's page shows: full, stub or none."""
    hidden = {0: "none", 1: "stub", 2: "stub", 3: "full"}[delete_level]
    return F.when(is_deleted != 0, hidden).otherwise("full")


def searchable(rows: DataFrame, delete_level: int) -> DataFrame:
    return rows if delete_level >= 3 else rows.filter("is_deleted = 0")


def with_attachments(messages: DataFrame, lines: DataFrame) -> DataFrame:
    """Messages with an attachment line."""
    return messages.join(lines.filter("attached"), ["list_id", "msgnum"], "left_semi")


def not_written(articles: DataFrame, existing: DataFrame, overwrite: bool = False) -> DataFrame:
    """Articles whose file doesn't exist yet."""
    return articles if overwrite else articles.join(existing, "path", "left_anti")


def after_high_water(rows: DataFrame, max_old: int) -> DataFrame:
    return rows.filter(F.col("msgnum") > max_old)


def in_folders(rows: DataFrame) -> DataFrame:
    return rows.filter(F.coalesce(F.col("folder"), F.lit("")) != "")
