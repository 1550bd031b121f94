"""Mail dates as native expressions: RFC 2822 and its usual deviations, RFC 3339, ctime, plain days.

Seconds since 1970 as bigint; 0 stands for no date, as everywhere in the data model.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip, strftime_pattern

# Zone names of RFC 2822, years 0000 to 9999.
ZONES = {"UT": "+0000", "GMT": "+0000", "Z": "+0000", "EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700"}
LEAST, MOST = -62167219200, 253402300799
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
RFC2822 = r"(?i)^(?:(?:mon|tue|wed|thu|fri|sat|sun)\s*,\s*)?(\d{1,2})\s+([a-z]{3})\s+(\d{2,4})\s+(\d{1,2}):(\d{2})(?::(\d{2}))?\s*([+-]\d{4}|[a-z]+)$"
RFC3339 = r"(?i)^(\d{4})-(\d{2})-(\d{2})[t ](\d{2}):(\d{2}):(\d{2})(?:\.\d+)?(z|[+-]\d{2}:?\d{2})$"
CTIME = r"(?i)^(?:mon|tue|wed|thu|fri|sat|sun)\s+([a-z]{3})\s+(\d{1,2})\s+(\d{2}):(\d{2}):(\d{2})\s+(\d{4})$"
DAY = r"^(\d{4})-(\d{1,2})-(\d{1,2})$"


def month_number(name: Column) -> Column:
    """1 to 12 from an English abbreviation in any case; null for others."""
    at = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.left(name, F.lit(3))))
    return F.when(at > 0, at.cast("int"))


def is_leap(year: Column) -> Column:
    """Julian up to 1752, then Gregorian."""
    gregorian = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    return F.when(year > 1752, gregorian).otherwise(year % 4 == 0)


def _epoch(year: Column, month: Column, day: Column, h: Column, m: Column, s: Column, offset: Column) -> Column:
    """From civil fields, without the session's zone; null where a field is out of range."""
    fields = [x.try_cast("int") for x in (year, month, day, h, m, s)]
    y, mo, d, hh, mm, ss = fields
    days = F.datediff(F.try_to_date(F.format_string("%04d-%02d-%02d", y, mo, d), "yyyy-MM-dd"), F.lit("1970-01-01").cast("date"))
    sane = (hh < 24) & (mm < 60) & (ss <= 60)
    return F.when(sane, days.cast("bigint") * 86400 + hh * 3600 + mm * 60 + ss - offset)


def _offset(zone: Column) -> Column:
    """Seconds east; null for an unknown name. Single letters are taken as UTC."""
    numeric = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ZONES.items() for x in kv]), F.upper(zone)),
                         F.when(zone.rlike("^(?i)[a-ik-z]$"), F.lit("+0000")), F.replace(F.upper(zone), F.lit(":"), F.lit("")))
    ok = numeric.rlike(r"^[+-]\d{4}$")
    secs = F.substring(numeric, 2, 2).try_cast("int") * 3600 + F.substring(numeric, 4, 2).try_cast("int") * 60
    return F.when(ok, F.when(F.startswith(numeric, F.lit("-")), -secs).otherwise(secs))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once; also keeps generated code small."""
    return F.transform(F.array(value), body)[0]


def _parts(c: Column, pattern: str, n: int) -> Column:
    """Array of the pattern's n groups, by one match and one replacement; null if it doesn't match."""
    return F.when(c.rlike(pattern), F.split(F.regexp_replace(c, pattern, "\u0001".join(f"${k}" for k in range(1, n + 1))), "\u0001", -1))


def _rfc2822(c: Column) -> Column:
    def read(p: Column) -> Column:
        part = lambda k: F.get(p, F.lit(k - 1))
        year = part(3).try_cast("int")
        year = F.when(F.length(part(3)) == 2, year + F.when(year < 50, 2000).otherwise(1900)).when(F.length(part(3)) == 3, year + 1900).otherwise(year)
        return _epoch(year, month_number(part(2)), part(1), part(4), part(5), F.coalesce(F.nullif(part(6), F.lit("")), F.lit("0")), _offset(part(7)))

    return let(_parts(c, RFC2822, 7), read)


def _rfc3339(c: Column) -> Column:
    return let(_parts(c, RFC3339, 7), lambda p: _epoch(*[F.get(p, F.lit(k)) for k in range(6)], _offset(F.get(p, F.lit(6)))))


def normalize_zone(c: Column) -> Column:
    """A trailing GMT+2, UTC-5 or GMT+5:30 as a numeric offset."""
    pattern = r"(?i)(?:GMT|UTC)([+-])(\d{1,2})(?::(\d{2}))?$"
    sign, hours, minutes = (F.regexp_extract(c, pattern, k) for k in (1, 2, 3))
    base = F.regexp_replace(c, r"(?i)\s*(?:GMT|UTC)[+-]\d{1,2}(?::\d{2})?$", "")
    fixed = F.concat(base, F.lit(" "), sign, F.lpad(hours, 2, "0"), F.when(minutes == "", "00").otherwise(minutes))
    return F.when(c.rlike(pattern), fixed).otherwise(c)


def without_comments(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?:\G|(?<!\s))\s*+\([^)]*\)\s*", " "))


def parse_mail_date(c: Column, local_offset: int = 0) -> Column:
    """Seconds, or null if the text is no date. local_offset: seconds east that dates without a
    zone are taken in."""
    zero, east = F.lit("0"), F.lit(local_offset)

    def ctime(p: Column) -> Column:
        at = lambda k: F.get(p, F.lit(k))
        return _epoch(at(5), month_number(at(0)), at(1), at(2), at(3), at(4), east)

    def read(text: Column) -> Column:
        return F.coalesce(
            _rfc2822(text), _rfc3339(text), _rfc2822(normalize_zone(text)), let(_parts(text, CTIME, 6), ctime),
            let(_parts(text, DAY, 3), lambda p: _epoch(*[F.get(p, F.lit(k)) for k in range(3)], zero, zero, zero, east)))

    return let(without_comments(strip(c)), read)


def iso_to_secs(c: Column) -> Column:
    """RFC 3339, or the same without a zone as UTC; null otherwise."""
    text = strip(c)
    bare = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$"), F.concat(text, F.lit("Z")))
    return F.coalesce(_rfc3339(text), _rfc3339(bare))


def clamp(ts: Column) -> Column:
    return F.greatest(F.lit(LEAST), F.least(F.lit(MOST), ts))


def _at(ts: Column, utc: bool) -> Column:
    stamp = F.timestamp_seconds(clamp(ts))
    return F.to_utc_timestamp(stamp, F.current_timezone()) if utc else stamp


def secs_to_iso(ts: Column) -> Column:
    return F.date_format(_at(ts, True), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def format_date(ts: Column, fmt: str | None = None, gmtime: bool = False, eurodate: bool = True, isodate: bool = False) -> Column:
    """fmt (strftime) before isodate before eurodate before the US order; a format that isn't
    understood gives the RFC 2822 form."""
    if fmt is not None:
        try:
            pattern = strftime_pattern(fmt)
        except ValueError:
            pattern = "EEE, dd MMM yyyy HH:mm:ss xx"
    elif isodate:
        pattern = "yyyy-MM-dd HH:mm:ss" + ("'Z'" if gmtime else "")
    else:
        pattern = "EEE dd MMM yyyy HH:mm:ss xx" if eurodate else "EEE MMM dd yyyy HH:mm:ss xx"
    if gmtime:
        pattern = pattern.replace("xx", "'+0000'")
    return F.date_format(_at(ts, gmtime), pattern)


def folder_month(ts: Column, utc: bool = False) -> Column:
    return F.date_format(_at(ts, utc), "yyyy-MM")


def folder_year(ts: Column, utc: bool = False) -> Column:
    return F.date_format(_at(ts, utc), "yyyy")


def timezone_offset(ts: Column) -> Column:
    """The session zone's +HHMM at a time."""
    return F.date_format(F.timestamp_seconds(ts), "xx")


def dated_path(fmt: str, now: Column) -> Column:
    """An output folder with %d %D %j %m %M %y of now, which is a timestamp column."""
    # The conversions of folder templates.
    letters = {"d": "dd", "D": "EEE", "j": "DDD", "m": "MM", "M": "MMM", "y": "yyyy"}
    parts, i = [], 0
    while i < len(fmt):
        if fmt[i] == "%" and i + 1 < len(fmt):
            k = fmt[i + 1]
            parts.append(F.date_format(now, letters[k]) if k in letters else F.lit("%" if k == "%" else fmt[i: i + 2]))
            i += 2
        else:
            j = fmt.find("%", i + 1)
            j = len(fmt) if j < 0 else j
            parts.append(F.lit(fmt[i:j]))
            i = j
    return F.concat(*parts) if parts else F.lit("")


def localize(date_text: Column, words: dict[str, str]) -> Column:
    """The first English day name, then the first month name, replaced from words."""
    days, months = "Mon|Tue|Wed|Thu|Fri|Sat|Sun", "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
    table = F.create_map(*[F.lit(x) for kv in words.items() for x in kv]) if words else None

    def swap(c: Column, names: str) -> Column:
        if table is None:
            return c
        pattern = rf"^(.*?)({names})(.*)$"
        found = F.regexp_extract(c, pattern, 2)
        new = F.coalesce(F.try_element_at(table, found), found)
        return F.when(found != "", F.concat(F.regexp_extract(c, pattern, 1), new, F.regexp_extract(c, pattern, 3))).otherwise(c)

    return swap(swap(date_text, days), months)
