"""MIME decoding: encoded words, transfer encodings, charsets, multipart bodies, file names.

Byte-level rules that have no column form. They run in Arrow batches; `parse_message` does all of a
message in one call, so that a body crosses into Python once.
"""

from __future__ import annotations

import base64
import binascii
import re
from dataclasses import dataclass, field
from functools import lru_cache

# Fixed values of the format.
ENCODED_WORD = re.compile(r"=\?([^?]+)\?([BbQq])\?([^?]*)\?=")
SAFE_IMAGES = frozenset("image/gif image/jpeg image/jpg image/png image/webp image/bmp image/tiff".split())
MAX_DEPTH = 16
MAX_FILENAME = 8 * 1024
CHARSET_TYPOS = {"iso-8859-75": "iso-8859-7", "iso885975": "iso-8859-7"}
#: Labels that the web's encoding standard reads as another charset.
ALIASES = {"iso-8859-1": "cp1252", "latin1": "cp1252", "us-ascii": "cp1252", "ascii": "cp1252", "iso-8859-9": "cp1254", "gb2312": "gb18030", "gbk": "gb18030",
           "ks_c_5601-1987": "cp949", "euc-kr": "cp949", "shift_jis": "cp932", "tis-620": "cp874", "windows-874": "cp874", "x-sjis": "cp932", "unicode-1-1-utf-8": "utf-8", "utf8": "utf-8"}
BODY_FALLBACKS = ("windows-1253", "iso-8859-7", "iso-8859-1", "windows-1252")
WORD_FALLBACKS = ("iso-8859-7", "windows-1253", "windows-1252", "iso-8859-1")
HEADER_FALLBACKS = ("windows-1253", "iso-8859-7", "windows-1252", "iso-8859-1")
LOST = "�"


@lru_cache(maxsize=256)
def codec(label: str) -> str | None:
    """Python's codec for a charset label, or None."""
    import codecs

    name = label.strip().lower()
    try:
        return codecs.lookup(ALIASES.get(name, name)).name
    except (LookupError, ValueError):
        return None


def decode_as(data: bytes, label: str) -> str | None:
    """Decoded with U+FFFD for errors; None for an unknown label. Single bytes that Windows code
    pages leave open are control characters, as the web's standard has them."""
    name = codec(label)
    if name is None:
        return None
    if name in ("cp1252", "cp1254", "cp874"):
        return "".join(data[i: i + 1].decode(name, "ignore") or chr(data[i]) for i in range(len(data))) if any(0x80 <= b < 0xA0 for b in data) else data.decode(name, "replace")
    return data.decode(name, "replace")


def first_clean(data: bytes, labels: tuple[str, ...]) -> tuple[str, str] | None:
    """(text, label) of the first charset that leaves nothing unread."""
    for label in labels:
        text = decode_as(data, label)
        if text is not None and LOST not in text:
            return text, label
    return None


def is_greek(text: str) -> bool:
    letters = sum(map(str.isalpha, text))
    return letters > 0 and sum("Ͱ" <= c <= "Ͽ" for c in text) * 100 // letters > 30


def to_text(data: bytes, charset: str) -> str:
    """Declared charset with repairs: mislabelled Greek, typos, and fallbacks."""
    label = CHARSET_TYPOS.get(charset.lower(), charset.lower())
    if label in ("utf-8", "utf8") or data.isascii():
        return data.decode("utf-8", "replace")
    if label in ("iso-8859-1", "iso-8859-15"):
        for greek in ("iso-8859-7", "windows-1253"):
            text = decode_as(data, greek)
            if text and is_greek(text):
                return text
    found = first_clean(data, (label,)) or first_clean(data, WORD_FALLBACKS)
    return found[0] if found else data.decode("utf-8", "replace")


def base64_strict(data: bytes) -> bytes | None:
    """White space aside, only well-formed input."""
    try:
        return base64.b64decode(b"".join(data.split()), validate=True)
    except (binascii.Error, ValueError):
        return None


QP = re.compile(rb"=\r\n|=\n|=[0-9A-Fa-f]{2}|_|\r")


def quoted_printable(data: bytes, underscore: bool = True, soft_breaks: bool = True) -> bytes:
    """Soft breaks and CRs vanish, =XX are bytes, _ is a space (also in bodies, unless switched off)."""
    def one(m: re.Match) -> bytes:
        x = m[0]
        if x == b"_":
            return b" " if underscore else x
        if x == b"\r":
            return b""
        if x.endswith(b"\n"):
            return b"" if soft_breaks else x.replace(b"\r", b"")
        return bytes([int(x[1:], 16)])

    return QP.sub(one, data)


def decode_words(value: str) -> str:
    """RFC 2047 encoded words; neighbours with only white space between them belong together, and
    their bytes too where the charset is the same."""
    out, at, held, charset = [], 0, b"", None
    for m in ENCODED_WORD.finditer(value):
        between = value[at: m.start()]
        joins = charset is not None and not between.strip(" \t\r\n")
        if charset is not None and not (joins and m[1].lower() == charset.lower()):
            out.append(to_text(held, charset))
            held, charset = b"", None
        if not joins:
            out.append(between)
        raw = m[3].encode()
        data = base64_strict(raw) if m[2] in "Bb" else quoted_printable(raw, soft_breaks=False)
        held, charset, at = held + (raw if data is None else data), m[1], m.end()
    if charset is not None:
        out.append(to_text(held, charset))
    return "".join(out) + value[at:]


def uudecode(data: bytes) -> bytes | None:
    """All begin...end blocks, which may hold nothing; None if there is none. A last group isn't cut to the line's count."""
    try:
        lines = data.decode().splitlines()
    except UnicodeDecodeError:
        return None
    out, inside, ended = bytearray(), False, False
    for line in map(str.rstrip, lines):
        if line.startswith("begin "):
            inside = True
        elif line in ("end", "`"):
            inside, ended = False, ended or inside
        elif inside and line:
            raw = line.encode()
            count, got = (raw[0] - 32) & 63, 0
            for i in range(1, len(raw), 4):
                if got >= count:
                    break
                six = [(b - 32) & 63 for b in raw[i: i + 4]]
                bits = 0
                for k in range(4):
                    bits = bits << 6 | (six[k] if k < len(six) else 0)
                out += bits.to_bytes(3, "big")[: len(six) - 1]
                got += len(six) - 1
    return bytes(out) if out or ended else None


@dataclass
class MediaType:
    kind: str
    subtype: str
    params: dict[str, str] = field(default_factory=dict)

    @classmethod
    def parse(cls, value: str) -> MediaType:
        head, *rest = value.split(";")
        kind, _, subtype = head.strip().lower().partition("/")
        params = {}
        for part in rest:
            key, eq, val = part.partition("=")
            if eq:
                val = val.strip()
                if len(val) >= 2 and val[0] == val[-1] and val[0] in "\"'":
                    val = val[1:-1]
                params[key.strip().lower()] = val
        return cls(kind, subtype, params)


def media_type(headers: list[tuple[str, str]]) -> MediaType | None:
    value = next((v for n, v in headers if n.lower() == "content-type"), None)
    return None if value is None else MediaType.parse(value)


def transfer_encoding(headers: list[tuple[str, str]]) -> str:
    return next((v.strip().lower() for n, v in headers if n.lower() == "content-transfer-encoding"), "")


def transferred(body: bytes, encoding: str, underscore: bool = True) -> bytes:
    if encoding == "base64":
        data = base64_strict(body)
        return body if data is None else data
    return quoted_printable(body, underscore) if encoding in ("quoted-printable", "qp") else body


def plain_text(data: bytes, charset: str | None) -> tuple[str, str | None]:
    """(text, charset found)."""
    if charset:
        return to_text(data, charset), charset
    try:
        return data.decode("utf-8"), None
    except UnicodeDecodeError:
        return first_clean(data, BODY_FALLBACKS) or (data.decode("utf-8", "replace"), None)


def unflow(text: str) -> str:
    """RFC 3676 without unstuffing: lines that end in a space run on, but for the signature mark."""
    lines = text.split("\n")
    if lines and lines[-1] == "":
        lines.pop()
    return "".join(x + "\n" if x == "-- " or not x.endswith(" ") else x.rstrip() + " " for x in lines)


@dataclass(frozen=True)
class Options:
    """unfold_parts: read folded part headers whole; body_underscores: _ is a space in bodies; part_breaks: a
    file's line is set off from a text part before it, even from an empty one."""

    unfold_parts: bool = True
    body_underscores: bool = True
    part_breaks: bool = True


def parts_of(body: bytes, boundary: str, options: Options):
    """(headers, body) of each part up to the end mark; parts without a blank line are left out."""
    mark = b"--" + boundary.encode()
    for piece in body.split(mark)[1:]:
        if piece.startswith(b"--"):
            return
        if piece.startswith(b"\r\n"):
            piece = piece[2:]
        elif piece.startswith(b"\n"):
            piece = piece[1:]
        else:
            continue
        gap = re.search(rb"\n\n", piece) or re.search(rb"\r\n\r\n", piece)
        if not gap:
            continue
        try:
            head = piece[: gap.start()].decode()
        except UnicodeDecodeError:
            continue
        if options.unfold_parts:
            head = re.sub(r"\r?\n[ \t]+", " ", head)
        pairs = [(n.strip().lower(), v.strip()) for n, c, v in (line.partition(":") for line in head.splitlines()) if c]
        yield pairs, piece[gap.end():]


def percent_bytes(value: str) -> bytes:
    return re.sub(rb"%([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), value.encode())


def extended_value(value: str) -> str:
    """charset'language'percent-encoded, or percent-encoded alone."""
    charset, *rest = value.split("'", 2)
    if len(rest) == 2:
        return percent_bytes(rest[1]).decode(codec(charset) or "utf-8", "replace")
    return percent_bytes(value).decode("utf-8", "replace")


NUMBERED = re.compile(r"(?:file)?name\*(\d+)(\*?)=(.*)", re.S)
EXTENDED = re.compile(r"(?:file)?name\*=(.*)", re.S)
SIMPLE = re.compile(r"(?:file)?name=(.*)", re.S)


def file_name(headers: list[tuple[str, str]]) -> str | None:
    """Numbered continuations before an extended value before a simple one, header by header."""
    bare = lambda v: v.strip().strip('"').strip("'")
    for name, value in headers:
        if name not in ("content-disposition", "content-type"):
            continue
        params = [p.strip() for p in value.split(";")]
        numbered = sorted(((int(m[1]), extended_value(bare(m[3])) if m[2] else bare(m[3])) for p in params if (m := NUMBERED.fullmatch(p))), key=lambda x: x[0])
        joined = "".join(v for _, v in numbered).encode()[:MAX_FILENAME].decode("utf-8", "ignore")
        if joined:
            return joined
        for p in params:
            if m := EXTENDED.fullmatch(p):
                return extended_value(m[1].strip().strip('"'))
        for p in params:
            if (m := SIMPLE.fullmatch(p)) and bare(m[1]):
                return bare(m[1])
    return None


def image_line(kind: str, body: bytes, encoding: str) -> str | None:
    data = base64_strict(body.strip()) if encoding == "base64" else body or None
    return None if data is None else f"[INLINE_IMAGE:{kind}:{base64.b64encode(data).decode()}]\n"


def decode_body(headers: list[tuple[str, str]], body: bytes, options: Options = Options(), depth: int = 0) -> tuple[str, str | None]:
    """(text, charset) of a message or part."""
    kind = media_type(headers)
    if kind is None:
        return plain_text(body, None)
    if kind.kind == "multipart":
        if depth >= MAX_DEPTH:
            return body.decode("utf-8", "replace"), None
        if "boundary" in kind.params:
            return decode_parts(body, kind, options, depth)
    text, charset = plain_text(transferred(body, transfer_encoding(headers), options.body_underscores), kind.params.get("charset"))
    if kind.params.get("format", "").lower() == "flowed":
        text = unflow(text)
    return text, kind.params.get("charset")


def decode_parts(body: bytes, parent: MediaType, options: Options, depth: int) -> tuple[str, str | None]:
    """Text parts joined; of alternatives the first plain one, else the first HTML one. Images of
    safe types become marked lines, other files a line with their name."""
    out, charset, choices, begun = "", None, {}, False
    note = lambda line: ("\n" if out or begun else "") + line
    for headers, part in parts_of(body, parent.params["boundary"], options):
        kind = next((v.split(";")[0].strip().lower() for n, v in reversed(headers) if n == "content-type"), "")
        attached = next((v.lower().startswith("attachment") for n, v in reversed(headers) if n == "content-disposition"), False)
        image = image_line(kind, part, transfer_encoding(headers)) if kind in SAFE_IMAGES else None
        if image:
            out += note(image)
        elif kind.startswith(("image/", "application/")) or attached:
            name = file_name(headers)
            out += note(f"[Attachment: {name}]\n") if name else ""
        elif kind.startswith(("text/", "multipart/")) or not kind:
            text, found = decode_body(headers, part, options, depth + 1)
            if parent.subtype == "alternative":
                choices.setdefault(kind or "text/plain", (text, found))
            else:
                charset, begun = charset or found, options.part_breaks
                out += ("\n" if out and text else "") + text
    if parent.subtype == "alternative" and (best := choices.get("text/plain") or choices.get("text/html")):
        return best
    return out, charset


def parse_headers(raw: bytes) -> list[tuple[str, str]]:
    out: list[list[str]] = []
    for line in raw.decode("utf-8", "replace").replace("\r\n", "\n").split("\n"):
        if not line.strip("\r"):
            break
        if line[0] in " \t":
            if out:
                out[-1][1] = f"{out[-1][1]} {line.strip()}".strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            out.append([name.strip().lower(), value.strip()])
    return [(n, v) for n, v in out]


def raw_header(raw: bytes, name: str, charset: str | None) -> str | None:
    """A header's first line from its bytes, where UTF-8 failed."""
    m = re.search(rb"(?:^|\n)" + name.encode() + rb":[ \t]*([^\n]*)", raw, re.I)
    if not m or not m[1].strip():
        return None
    data = m[1].rstrip(b"\r")
    try:
        return data.decode()
    except UnicodeDecodeError:
        found = first_clean(data, ((charset,) if charset else ()) + HEADER_FALLBACKS)
        return found[0] if found else None


def parse_message(headers: bytes | None, body: bytes | None, options: Options = Options()) -> dict:
    """Headers in order, decoded text, charset, and Subject and From repaired where they hold
    raw 8-bit bytes."""
    raw = bytes(headers or b"")
    pairs = parse_headers(raw)
    text, charset = decode_body(pairs, bytes(body or b""), options)
    first = lambda n: next((v for k, v in pairs if k == n), None)
    fixed = {}
    for name in ("subject", "from"):
        value = first(name)
        fixed[name] = (raw_header(raw, name, charset) or value) if value and LOST in value else value
    return {"headers": pairs, "body_text": text, "charset": charset, "subject_raw": fixed["subject"], "from_raw": fixed["from"]}
