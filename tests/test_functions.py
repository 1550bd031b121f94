"""Scalar functions, as tables of input and expected value."""

import base64

import pytest
from pyspark.sql import functions as F

from postweave.functions import dates, mail, mime, quotes, text


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.out for r in df.select("i", f(F.col("v")).alias("out")).orderBy("i").collect()]


def check(spark, f, table, kind="string"):
    assert column(spark, [a for a, _ in table], f, kind) == [b for _, b in table]


def test_bare_subjects(spark):
    check(spark, text.unre, [
        ("Re: Hello", "Hello"), ("RE: re: Hello", "Hello"), ("Fwd: Re: x", "x"), ("AW: Antw: y", "y"), ("SV: VS: z", "z"), ("Hello", "Hello"), ("  Re:  ", ""),
        ("Request", "quest"), ("Re[2]: x", "2]: x"), ("Odp: ż", "ż"), ("", ""), (None, None)])
    assert column(spark, ["Re: " + "é" * 2000], text.unre) == ["é" * 1022]
    check(spark, lambda c: text.unre(c, True), [("Request", "Request"), ("Re: Request", "Request")])
    check(spark, text.oneunre, [("Re: Re: x", "Re: x"), ("x", "x")])


def test_capped_bytes(spark):
    for cap in range(1, 9):
        s = "aé漢🙂b"
        want = s.encode()[:cap].decode("utf-8", "ignore") if len(s.encode()) > cap else s
        assert column(spark, [s], lambda c, n=cap: text.cap_bytes(c, n)) == [want]


def test_urls(spark):
    check(spark, text.find_url, [("see http://a.b/c?d=1 now", "http://a.b/c?d=1"), ("WWW.x.org", "WWW.x.org"), ("none", ""), ("ftp://f/<x", "ftp://f/")])
    check(spark, text.link_urls, [
        ("a <b> & \"c\"", "a &lt;b&gt; &amp; &quot;c&quot;"),
        ("go http://x.y/?a&b now", 'go <a href="http://x.y/?a&amp;b" rel="noopener noreferrer">http://x.y/?a&amp;b</a> now'),
        ("www.x.y", '<a href="https://www.x.y" rel="noopener noreferrer">www.x.y</a>'), ("WWW.x.y", '<a href="WWW.x.y" rel="noopener noreferrer">WWW.x.y</a>'),
        ("http://" + "a" * 5000, "http://" + "a" * 5000), ("http://a.b " + "x" * 41000, "http://a.b " + "x" * 41000)])


def test_escapes(spark):
    check(spark, text.escape_html, [("<a href='x'>\t&", "&lt;a href=&#39;x&#39;&gt;        &amp;"), ("", "")])
    check(spark, text.escape_html_attr, [("\"<&'>", "&quot;&lt;&amp;&#39;&gt;")])
    check(spark, text.escape_xml, [("a\x01b'<", "ab&apos;&lt;"), ("🙂￾", "🙂")])


def test_addresses_hidden_and_shown(spark):
    check(spark, text.obfuscate, [("a@b.c", "&#97;&#64;&#98;.&#99;"), ("é!", "é!")])
    check(spark, text.unobfuscate, [(None, None), ("&#0;a&#127;&#128;", "a\x7f\x80"), ("é&#64;", "é@")])
    # one computation of what is hidden, however many entities it has
    plan = spark.range(1).select(text.unobfuscate(text.obfuscate(F.col("id").cast("string"))))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(cast(id") == 1
    check(spark, text.unobfuscate, [("&#97;&#64;x", "a@x"), ("&#128578;", "🙂"), ("&#55296;|&#99999999999;", "|"), ("&#x41;", "&#x41;")])
    check(spark, text.spamify, [("mail joe@x.org now", "mail joe_at_x.org now"), ("no address", "no address")])
    check(spark, lambda c: text.spamify(c, domain="d.e"), [("joe@x.org", "joe@d.e")])
    check(spark, lambda c: text.spamify(c, protect=False, protect_id=False), [("joe@x.org", "joe@x.org")])


def test_small_cleanups(spark):
    check(spark, lambda c: text.convchars(c, "/:"), [("a/b:c", "a_b_c")])
    check(spark, text.stripzone, [("Mon, 1 Jan (CET)", "Mon, 1 Jan"), ("x", "x")])
    check(spark, text.getvalue, [("", None), ("None", None), (" ", None), ("x", "x")])
    check(spark, text.sanitize_for_search, [("a<b>é_1\n2-x.@", "abé1 2-x.@")])
    check(spark, lambda c: text.strip_configured_prefix(c, "[l] "), [("[l] hi", "hi"), ("[l] ", "[l] "), ("hi", "hi")])


def fnv(data):
    h = 2166136261
    for b in data:
        h = (h ^ b) * 16777619 % 2**32
    return h


def test_message_names(spark):
    check(spark, lambda c: text.fnv32(c.cast("binary")), [("", fnv(b"")), ("<a@b>", fnv(b"<a@b>")), ("é", fnv("é".encode()))])
    df = spark.createDataFrame([(7, "<a@b>", 0), (12345, "<a@b>", 1_700_000_000)], "n int, id string, d long")
    got = df.select(text.message_name(F.col("n"), F.col("id"), F.col("d")).alias("a"), text.message_name(F.col("n"), F.col("id"), F.col("d"), True).alias("b")).collect()
    stamp = (1_700_000_000).to_bytes(8, "little")
    assert [r.a for r in got] == ["0007", "12345"]
    assert [r.b for r in got] == [f"{fnv(b'<a@b>'):08x}00000000", f"{fnv(b'<a@b>' + stamp):08x}{1_700_000_000:08x}"]


def test_paths(spark):
    check(spark, text.is_rooted_path, [("/a", True), ("C:x", True), ("\\a", True), ("a/b", False)])
    check(spark, text.safe_folder, [("a/../b", None), ("/x", None), ("2024/01", "2024/01")])


def test_dates(spark):
    check(spark, dates.parse_mail_date, [
        ("Mon, 15 Jan 2024 12:00:00 +0000", 1705320000), ("15 Jan 2024 12:00:00 +0200", 1705312800), ("Mon, 15 Jan 2024 12:00 GMT", 1705320000),
        ("Mon, 15 Jan 2024 12:00:00 -0500 (EST)", 1705338000), ("15 Jan 24 12:00:00 UT", 1705320000), ("2024-01-15T12:00:00Z", 1705320000),
        ("2024-01-15T12:00:00.5+01:00", 1705316400), ("15 Jan 2024 12:00:00 GMT+2", 1705312800), ("15 Jan 2024 12:00:00 UTC-5:30", 1705339800),
        ("Mon Jan 15 12:00:00 2024", 1705320000), ("2024-01-15", 1705276800), ("29 Feb 2023 00:00:00 +0000", None), ("15 Jan 2024 25:00:00 +0000", None),
        ("nonsense", None), ("", None), (None, None), ("15 Foo 2024 12:00:00 +0000", None)])
    check(spark, dates.iso_to_secs, [("2024-01-15T12:00:00", 1705320000), ("2024-01-15T12:00:00+01:00", 1705316400), ("2024-01-15", None)])
    check(spark, dates.secs_to_iso, [(0, "1970-01-01T00:00:00Z"), (1 << 60, "9999-12-31T23:59:59Z")], "long")
    check(spark, lambda c: dates.format_date(c, "%Y %Q", True), [(1705320000, "Mon, 15 Jan 2024 12:00:00 +0000")], "long")
    check(spark, dates.month_number, [("JAN", 1), ("december", 12), ("x", None)])
    check(spark, dates.is_leap, [(1700, True), (1800, False), (2000, True), (2023, False)], "int")
    check(spark, lambda c: dates.localize(c, {"Mon": "Mo", "May": "Mai"}), [("Mon 1 May Mon", "Mo 1 Mai Mon"), ("x", "x")])
    now = F.to_timestamp(F.lit("2024-01-15 00:00:00"))
    assert column(spark, ["x"], lambda c: dates.dated_path("a/%y-%m-%d%%%q", now)) == ["a/2024-01-15%%q"]


def test_headers(spark):
    raw = "From: a\nSubject: one\n two\nX: 1\nx:2\nbroken\n\nBody: no\n"
    got = column(spark, [raw, raw.replace("\n", "\r\n"), ""], mail.parse_headers)
    want = [("from", "a"), ("subject", "one two"), ("x", "1"), ("x", "2")]
    assert [[tuple(h) for h in g] for g in got] == [want, want, []]
    assert mime.parse_headers(raw.encode()) == want
    check(spark, lambda c: mail.find_header(mail.parse_headers(c), "X"), [(raw, "1"), ("a: b", None)])


def test_addresses(spark):
    table = [("Joe <j@x>", ("Joe", "j@x")), ('"Joe B" <j@x>', ("Joe B", "j@x")), ("<j@x>", (None, "j@x")), ("j@x (Joe)", ("Joe", "j@x")), ("j@x", (None, "j@x")),
             ("Joe", ("Joe", None)), ("", ("", None)), ("Joe <j@x", ("Joe", None))]
    assert [tuple(r) for r in column(spark, [a for a, _ in table], mail.address)] == [b for _, b in table]


def test_ids_and_lines(spark):
    check(spark, mail.normalize_msgid, [(" <A@B> ", "<a@b>"), ("É", "É")])
    check(spark, mail.bracketed_ids, [("x <a@b> <c> <d", ["<a@b>", "<c>"]), ("", [])])
    check(spark, mail.body_lines, [("a\r\nb\n", ["a", "b"]), ("", []), ("\n", [""]), ("a\n\n", ["a", ""])])
    check(spark, lambda c: mail.in_reply_to(F.lit(None).cast("string"), c), [("<a> <b> c", "<b>"), ("none", None), (None, None)])
    check(spark, lambda c: mail.in_reply_to(c, F.lit("<r>")), [("", ""), (None, "<r>")])
    for t in ("a \nb\n-- \nc\n", "", "x", "a  \n\nb \n", "\n"):
        assert column(spark, [t], mail.unflow) == [mime.unflow(t) if t else ""]


def test_received_dates(spark):
    raw = "Received: x; nonsense\nReceived: by y; z; 15 Jan 2024 12:00:00 +0000\n"
    check(spark, lambda c: mail.message_date(mail.parse_headers(c)), [(raw, 1705320000), ("Date: 16 Jan 2024 12:00:00 +0000\n" + raw, 1705406400), ("a: b", 0)])


def test_quotes(spark):
    check(spark, quotes.is_quote, [("> a", True), ("|a", True), (": a", True), (" > a", False), ("", False)])
    check(spark, quotes.unquote, [("> a", "a"), (">> a", "> a"), ("|a", "a"), ("a", "a")])
    check(spark, quotes.quote_depth, [("> > a", 2), (">>>a", 3), ("a > b", 0), (">|:x", 3)])
    check(spark, quotes.quote_class, [(">" * 12, "hm-quote-9"), ("a", "")])
    check(spark, quotes.is_signature_start, [("-- ", True), ("--\r", True), ("---", False)])
    check(spark, quotes.strip_anchor_tags, [('x<a name="1">gone</a>y', "xy")])
    check(spark, quotes.inline_image, [("[INLINE_IMAGE:image/png:QUJD]", '<img src="data:image/png;base64,QUJD" alt="inline image">'), ("[INLINE_IMAGE:image/svg+xml:QUJD]", None), ("[INLINE_IMAGE:image/png:\"x]", None)])
    check(spark, quotes.inline_image, [("[INLINE_IMAGE:image/png:QU\r\nJD]", None), ("[INLINE_IMAGE:image/png:QUJD\n]", None)])


def test_long_inline_images(spark, tmp_path):
    """Data of more than 57 bytes, which Spark folds."""
    from postweave import catalog

    url = "http://example.org/" + "a" * 100
    spark.createDataFrame([(3, url)], "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    want = f'<img src="data:image/png;base64,{base64.b64encode(url.encode()).decode()}" alt="inline image">'
    assert [r.html for r in catalog.QUERIES["q13_inline_images"](spark, str(tmp_path)).collect()] == [want]


def test_decoders_hold_a_piece_of_a_batch(spark):
    """However many rows a batch has, what is decoded leaves before the rest is."""
    import pyarrow as pa

    from postweave.functions import register

    done = []
    out = register.in_pieces(iter([pa.array([b"a", None] * 1000), pa.array([], pa.binary())]), lambda b: done.append(b) or b)
    assert len(next(out)) == register.PIECE and len(done) == register.PIECE // 2
    rows = spark.range(0, 3000, 1, 2).select("id", F.when(F.col("id") % 5 > 0, F.concat(F.lit("=41_"), F.col("id").cast("string"))).cast("binary").alias("v"))
    found = rows.select("id", F.decode(register.decode_quoted_printable("v"), "UTF-8").alias("x")).collect()
    assert all(r.x == (f"A {r.id}" if r.id % 5 else None) for r in found) and len(found) == 3000


@pytest.mark.parametrize("raw,want", [
    ("=?utf-8?B?SGVsbG8=?=", "Hello"), ("=?iso-8859-1?Q?caf=E9_x?=", "café x"), ("a =?utf-8?Q?b?= =?utf-8?Q?c?= d", "a bc d"), ("=?utf-8?B?w6k=?=\n =?utf-8?Q?=C3?= =?utf-8?Q?=A9?=", "éé"),
    ("=?utf-8?B?!!!?=", "!!!"), ("plain", "plain"), ("=?utf-8?Q?a?= b =?utf-8?Q?c?=", "a b c"), ("=?iso-8859-7?B?0OHp5A==?=", "Παιδ"), ("=?windows-1252?Q?=80?=", "€"), ("=?x-unknown?Q?=41?=", "A")])
def test_encoded_words(raw, want):
    assert mime.decode_words(raw) == want


def test_transfer_encodings():
    assert mime.quoted_printable(b"a=3D=\nb=\r\nc_d\r\n=ZZ=4") == b"a=bc d\n=ZZ=4"
    assert mime.quoted_printable(b"a_b", underscore=False) == b"a_b"
    assert mime.base64_strict(b"SGVs\nbG8=") == b"Hello" and mime.base64_strict(b"SGVsbG8") is None
    assert mime.uudecode(b"begin 644 x\n#0V%T\n`\nend\n") == b"Cat" and mime.uudecode(b"nothing") is None


def test_uuencoded_nothing_and_zero_bytes(spark, tmp_path):
    """A block of nothing is one; of zero bytes only the padding goes."""
    from postweave import catalog

    assert mime.uudecode(b"begin 644 x\n`\nend\n") == b"" and mime.uudecode(b"begin 644 x\nend\n") == b""
    assert mime.uudecode(b"begin with this\n") is None and mime.uudecode(b"end\n`\n") is None and mime.uudecode(b"") is None
    texts = [None, "", "\x00", "a\x00", "ab\x00\n", "abc\x00\x00", "x" * 45, "é" * 23 + "\x00" * 91]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = catalog.QUERIES["m5_uuencoded"](spark, str(tmp_path)).collect()
    assert [r.decoded for r in sorted(got)] == texts


def test_file_names():
    name = lambda v: mime.file_name([("content-disposition", v)])
    assert name('attachment; filename="a b.pdf"') == "a b.pdf"
    assert name("attachment; filename*=utf-8''%C3%A9.txt") == "é.txt"
    assert name("attachment; filename*1=b.txt; filename*0=a") == "ab.txt"
    assert name("attachment; filename*0*=utf-8''%C3; filename*1=x") is not None
    assert name("inline") is None and len(name("a; filename*0=" + "x" * 9000)) == 8192


def part(kind, body, *more):
    return "\n".join([f"Content-Type: {kind}", *more, "", body]).encode()


def multi(subtype, *parts, end=True):
    body = b"".join(b"--B\n" + p + b"\n" for p in parts) + (b"--B--\n" if end else b"")
    return mime.decode_body([("content-type", f"multipart/{subtype}; boundary=B")], body)


def test_multipart():
    assert multi("alternative", part("text/html", "<b>"), part("text/plain; charset=utf-8", "é"))[0].strip() == "é"
    assert multi("alternative", part("text/html", "<b>"))[0].strip() == "<b>"
    text_, charset = multi("mixed", part("text/plain; charset=iso-8859-1", "a"), part("application/pdf; name=x.pdf", "zz"), part("image/svg+xml", "<svg>"), part("text/plain", "b"), end=False)
    assert text_ == "a\n\n[Attachment: x.pdf]\n\nb\n" and charset == "iso-8859-1"
    image = multi("mixed", part("image/png", "QUJD", "Content-Transfer-Encoding: base64", "Content-Disposition: attachment; filename=p.png"))[0]
    assert image == "[INLINE_IMAGE:image/png:QUJD]\n"
    assert multi("mixed", part("image/png; name=p.png", "???", "Content-Transfer-Encoding: base64"))[0] == "[Attachment: p.png]\n"
    body, kind = b"deep", "text/plain"
    for _ in range(20):
        body, kind = b"--B\nContent-Type: " + kind.encode() + b"\n\n" + body, "multipart/mixed; boundary=B"
    assert mime.decode_body([("content-type", kind)], body)[0]
    assert mime.decode_body([("content-type", 'text/plain; format="flowed"')], b"a \nb\n")[0] == "a b\n"
    assert mime.decode_body([], "Ελληνικά".encode("iso-8859-7"))[0] == "Ελληνικά"


def test_empty_part_before_a_file(spark, tmp_path):
    """An empty text is a part as others are; the file's line is set off from it, unless switched off."""
    from postweave import catalog

    empty, file = part("text/plain", "", "Content-Transfer-Encoding: base64"), part("application/pdf; name=x.pdf", "zz")
    assert multi("mixed", empty, file)[0] == "\n[Attachment: x.pdf]\n" and multi("mixed", file, empty)[0] == "[Attachment: x.pdf]\n"
    body = b"--B\n" + empty + b"\n--B\n" + file + b"\n--B--\n"
    assert mime.decode_body([("content-type", "multipart/mixed; boundary=B")], body, mime.Options(part_breaks=False))[0] == "[Attachment: x.pdf]\n"
    spark.createDataFrame([(1, None), (2, ""), (3, "a\n"), (4, "\x00")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = catalog.QUERIES["m10_multipart_bodies"](spark, str(tmp_path)).collect()
    assert {r.doc_id: r.body for r in got} == {n: t + "\n[Attachment: x.pdf]\n" for n, t in ((1, ""), (2, ""), (3, "a\n"), (4, "\x00"))}


def test_media_types(spark):
    m = mime.MediaType.parse('Text/Plain; Charset="utf-8"; charset=x; format=flowed')
    assert (m.kind, m.subtype, m.params) == ("text", "plain", {"charset": "x", "format": "flowed"})
    got = column(spark, ['Text/Plain; Charset="utf-8"; charset=x; format=flowed', "text"], mail.content_type)
    assert (got[0].type, got[0].subtype, got[0].params) == ("text", "plain", {"charset": "x", "format": "flowed"}) and (got[1].type, got[1].subtype) == ("text", "")


def test_raw_eight_bit_headers():
    raw = "Subject: Καλημέρα\nFrom: Νίκος <n@x>\n".encode("iso-8859-7")
    got = mime.parse_message(raw, b"")
    assert got["subject_raw"] == "Καλημέρα" and got["from_raw"].startswith("Νίκος")
