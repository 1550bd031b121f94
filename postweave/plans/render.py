"""Templates and page rendering."""

from __future__ import annotations

import html as _html
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions.dates import format_date
from ..functions.register import decode_mime_words
from ..functions.text import escape_html, escape_html_attr, escape_xml, message_filename, message_name, message_path, message_url, obfuscate, spamify, strip_configured_prefix
from ..operators.filters import article_state
from ..operators.lines import coalesce_runs, render_lines
from ..sources.locale import word

PROGRAM, VERSION = "postweave", "0.1.0"


def escaped(text: str | None) -> str:
    return _html.escape(text or "").replace("&#x27;", "&#39;").replace("\t", "        ")


@dataclass(frozen=True)
class Page:
    """What a template may name."""

    dir: str = ""
    archives: str | None = None
    about: str | None = None
    charset: str | None = None
    date: str | None = None
    display_date: str | None = None
    email: str | None = None
    filename: str | None = None
    language: str = "en"
    msgid: str | None = None
    label: str = ""
    mailto: str | None = None
    subject: str = ""
    name: str | None = None
    rel_path_to_top: str = ""
    now: str = ""
    url: str = ""


def parsed(template: str) -> list[tuple[str, str]]:
    """The template as ("text", literal) and ("escape", letter), in one pass: what is put in is never
    read again. \\n and \\t are text."""
    out: list[tuple[str, str]] = []
    for m in re.finditer(r"%(.)|\\([nt])|([^%\\]+|.)", template, re.S):
        if m[1] is not None:
            out.append(("escape", m[1]))
        else:
            text = {"n": "\n", "t": "\t"}[m[2]] if m[2] else m[3]
            if out and out[-1][0] == "text":
                out[-1] = ("text", out[-1][1] + text)
            else:
                out.append(("text", text))
    return out


def fill(template: str, page: Page) -> str:
    """A template for one page; unknown escapes stay as they are."""
    e = escaped
    meta = lambda n, v: f'<meta name="{n}" content="{v}" />'
    author = ""
    if page.name is not None:
        author = f'{e(page.name)} &lt;<a href="mailto:{e(page.email)}">{e(page.email)}</a>&gt;' if page.email else e(page.name)
    # The escapes of the template language.
    values = {
        "%": "%", "~": page.dir, "a": page.archives or "", "b": page.about or "",
        "c": f'<meta http-equiv="Content-Type" content="text/html; charset={e(page.charset)}" />\n' if page.charset else "",
        "D": meta("Date", e(page.date)) if page.date is not None else "", "e": e(page.email), "f": e(page.filename), "g": page.now, "G": page.language,
        "h": page.url, "i": e(page.msgid), "l": e(page.label), "m": e(page.mailto), "p": PROGRAM, "s": e(page.subject), "S": meta("Subject", e(page.subject)),
        "A": meta("Author", f"{e(page.name)} ({e(page.email)})") if page.name is not None and page.email is not None else "", "n": e(page.name),
        "d": e(page.display_date), "y": word(page.language, "Author"), "j": word(page.language, "Subject"), "k": word(page.language, "Date"),
        "w": word(page.language, "Generated by"), "N": author, "t": page.rel_path_to_top, "v": VERSION, "u": f'<a href="{page.url}">{PROGRAM} {VERSION}</a>'}
    return "".join(x if kind == "text" else values.get(x, f"%{x}") for kind, x in parsed(template))


def fill_columns(template: str, values: dict[str, Column]) -> Column:
    """A template for every row: one native expression, in which the template is constant text."""
    parts = [F.lit(x) if kind == "text" else F.coalesce(values[x], F.lit("")) if x in values else F.lit(f"%{x}") for kind, x in parsed(template)]
    return F.concat(*parts) if parts else F.lit("")


def fill_cookies(template: str, values: dict[str, str]) -> str:
    """%NAME% (or $NAME$) cookies in one pass; unknown ones stay."""
    return re.sub(r"([%$])([A-Z_]+)\1", lambda m: values.get(m[2], m[0]), template)


def fill_cookie_columns(template: str, values: dict[str, Column]) -> Column:
    """The same for every row."""
    parts, at = [], 0
    for m in re.finditer(r"([%$])([A-Z_]+)\1", template):
        parts += [F.lit(template[at: m.start()]), F.coalesce(values[m[2]], F.lit("")) if m[2] in values else F.lit(m[0])]
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


# Default templates, by cookies.
HEADER = """<!doctype html>
<html lang="%LANG%">
<head>
<meta charset="utf-8">
<title>%TITLE%</title>
%STYLESHEET%%METADATA%</head>
<body>
%BODYHEADER%%BODYHEADEREND%%NAVIGATION%<main>
"""
ARTICLE = "%ARTICLE%\n"
FOOTER = """</main>
<footer>%BODYFOOTER%%GENERATOR%</footer>
</body>
</html>
"""


@dataclass(frozen=True)
class Templates:
    """Texts of the template files that the options name; None for the default."""

    message_header: str | None = None
    message_footer: str | None = None
    index_header: str | None = None
    index_footer: str | None = None
    index_article: str | None = None

    @classmethod
    def load(cls, spark: SparkSession, config: Config) -> Templates:
        """Read by Spark, from any store that it can read."""
        def text(path: str | None) -> str | None:
            return None if path is None else spark.read.text(path, wholetext=True).first()[0]

        return cls(text(config.mhtmlheader), text(config.mhtmlfooter), text(config.ihtmlheader), text(config.ihtmlfooter), text(config.ihtmlhead))


def framed(body: Column, header: str | None, footer: str | None, article: str | None, config: Config, title: Column, navigation: Column, values: dict[str, Column]) -> Column:
    """A whole page: the % templates given, one that isn't given being empty, or else the default ones."""
    if header is not None or footer is not None:
        return F.concat(fill_columns(header or "", values), body, fill_columns(footer or "", values))
    css = config.css_path()
    generator = f"{escaped(word(config.language, 'Generated by'))} {PROGRAM} {VERSION}" if config.showgenerator else ""
    cookies = {
        "LANG": F.lit(escaped(config.language or "en")), "TITLE": title, "STYLESHEET": F.lit(f'<link rel="stylesheet" href="{escaped(css)}">\n' if css else ""),
        "METADATA": values.get("meta", F.lit("")), "BODYHEADER": F.lit(config.bodyheader or ""), "BODYHEADEREND": F.lit(config.bodyheaderend or ""), "NAVIGATION": navigation,
        "ARTICLE": body, "BODYFOOTER": F.lit(config.bodyfooter or ""), "GENERATOR": F.lit(generator)}
    return F.concat(*[fill_cookie_columns(t, cookies) for t in (HEADER, article or ARTICLE, FOOTER)])


def page_values(config: Config, **own: Column) -> dict[str, Column]:
    """The template escapes of a page, constant ones from the options; own ones by their letter."""
    text = lambda v: F.lit(escaped(v))
    url = escaped(config.hmail or "")
    return {
        "%": F.lit("%"), "~": F.lit(config.dir or ""), "a": F.lit(config.archives or ""), "b": F.lit(config.about or ""), "G": F.lit(config.language or "en"),
        "c": F.lit('<meta http-equiv="Content-Type" content="text/html; charset=utf-8" />\n'),
        "g": F.date_format(F.current_timestamp(), "EEE d MMM yyyy HH:mm:ss zzz"), "h": F.lit(url), "l": text(config.label), "m": text(config.mailto), "p": F.lit(PROGRAM), "v": F.lit(VERSION),
        "u": F.lit(f'<a href="{url}">{PROGRAM} {VERSION}</a>'), "y": text(word(config.language, "Author")), "j": text(word(config.language, "Subject")),
        "k": text(word(config.language, "Date")), "w": text(word(config.language, "Generated by")),
        **{c: F.lit("") for c in "DefisSAndNt"}, **own}


def message_values(config: Config) -> dict[str, Column]:
    """The escapes of a message's page."""
    plain = lambda c: F.coalesce(c, F.lit(""))
    meta = lambda n, v: F.concat(F.lit(f'<meta name="{n}" content="'), v, F.lit('" />'))
    name, email, subject = escape_html(plain(decode_mime_words(F.col("name")))), escape_html_attr(plain(F.col("email_addr"))), subject_cell(config)
    has_name, has_email = plain(F.col("name")) != "", plain(F.col("email_addr")) != ""
    top = plain(F.col("rel_path_to_top"))
    return page_values(
        config, e=email, i=escape_html(plain(F.col("msgid"))), s=subject, S=meta("Subject", subject), n=name, d=escape_html(date_cell(config)), t=top,
        f=message_filename(names(config), config.htmlsuffix), D=F.when(F.col("date") > 0, meta("Date", escape_html(date_cell(config)))).otherwise(""),
        A=F.when(has_name & has_email, meta("Author", F.concat(name, F.lit(" ("), email, F.lit(")")))).otherwise(""),
        N=F.when(has_name & has_email, F.concat(name, F.lit(' &lt;<a href="mailto:'), email, F.lit('">'), email, F.lit("</a>&gt;"))).otherwise(name))


def author_cell(config: Config) -> Column:
    """Name with a mail link; the link keeps the address, the shown text may hide it."""
    shown = obfuscate(F.col("email_addr")) if config.email_address_obfuscation else spamify(
        F.col("email_addr"), config.antispam_at, config.antispamdomain, config.spamprotect, config.spamprotect_id)
    shown = shown if config.email_address_obfuscation else escape_html(shown)
    name = escape_html(decode_mime_words(F.col("name")))
    link = F.concat(F.lit('<a href="mailto:'), escape_html_attr(F.col("email_addr")), F.lit('">'), shown, F.lit("</a>"))
    return (F.when(F.coalesce("email_addr", F.lit("")) == "", F.coalesce(name, F.lit("(no author)")))
            .when(F.coalesce("name", F.lit("")) == "", link).otherwise(F.concat(name, F.lit(" &lt;"), link, F.lit("&gt;"))))


def date_cell(config: Config) -> Column:
    return F.when(F.col("date") > 0, format_date(F.col("date"), config.dateformat, config.gmtime, config.eurodate, config.isodate)).otherwise("(no date)")


def subject_cell(config: Config) -> Column:
    return escape_html(strip_configured_prefix(F.coalesce(decode_mime_words(F.col("subject")), F.lit("(no subject)")), config.stripsubject))


def names(config: Config) -> Column:
    return message_name(F.col("msgnum"), F.col("msgid"), F.col("date"), config.nonsequential)


def reply_links(messages: DataFrame, edges: DataFrame, config: Config) -> DataFrame:
    """Per message the links to its replies, in order of discovery; a bounded part of one page."""
    child = messages.select("list_id", F.col("msgnum").alias("child_msgnum"), message_filename(names(config), config.htmlsuffix).alias("_file"), subject_cell(config).alias("_subject"))
    rows = edges.join(child, ["list_id", "child_msgnum"])
    item = F.concat(F.lit('<li><a href="'), F.col("_file"), F.lit('">'), F.col("_subject"), F.lit("</a></li>"))
    own = rows.groupBy("list_id", F.col("parent_msgnum").alias("msgnum")).agg(F.array_sort(F.collect_list(F.struct("seq", item.alias("item")))).alias("_items"))
    return own.select("list_id", "msgnum", F.array_join(F.transform("_items", lambda x: x["item"]), "\n").alias("replies"))


def articles(messages: DataFrame, lines: DataFrame, edges: DataFrame, config: Config, templates: Templates = Templates()) -> DataFrame:
    """path and html of each page that the delete level lets be written."""
    runs = coalesce_runs(render_lines(lines, config.showhtml))
    body = runs.groupBy("list_id", "msgnum").agg(F.array_sort(F.collect_list(F.struct("run", F.concat(F.lit('<div class="'), F.col("css"), F.lit('">'), F.col("html"), F.lit("</div>")).alias("h")))).alias("_runs"))
    body = body.select("list_id", "msgnum", F.array_join(F.transform("_runs", lambda x: x["h"]), "\n").alias("body_html"))
    rows = messages.join(body, ["list_id", "msgnum"], "left").join(reply_links(messages, edges, config), ["list_id", "msgnum"], "left")
    for missing in ("folder", "rel_path_to_top"):
        rows = rows if missing in rows.columns else rows.withColumn(missing, F.lit(None).cast("string"))
    rows = rows.withColumn("_state", article_state(F.col("is_deleted"), config.delete_level)).filter("_state <> 'none'")
    head = F.concat(F.lit('<article id="' + config.fragment_prefix), F.col("msgnum").cast("string"), F.lit('">\n<h1>'), subject_cell(config), F.lit("</h1>\n<p>"),
                    author_cell(config), F.lit(" "), date_cell(config), F.lit("</p>\n"))
    full = F.concat(head, F.coalesce("body_html", F.lit("")), F.when(F.col("replies").isNotNull() & F.lit(config.showreplies), F.concat(F.lit('\n<ul class="replies">\n'), F.col("replies"), F.lit("\n</ul>"))).otherwise(""), F.lit("\n</article>"))
    own = F.when(F.col("_state") == "full", full).otherwise(F.concat(F.lit("<article><h1>"), F.lit("(deleted message)"), F.lit("</h1></article>")))
    title = F.when(F.col("_state") == "full", subject_cell(config)).otherwise("(deleted message)")
    top = F.concat(F.lit('<nav><a href="'), F.coalesce("rel_path_to_top", F.lit("")), F.lit(f'index.{config.htmlsuffix}">{escaped(config.label) or "index"}</a></nav>\n'))
    values = message_values(config)
    html = framed(own, templates.message_header, templates.message_footer, None, config, title, top, {**values, "meta": F.concat(values["A"], values["D"])})
    path = message_path(F.col("folder"), names(config), config.htmlsuffix)
    return rows.select("list_id", "msgnum", F.concat_ws("/", F.col("list_id"), path).alias("path"), html.alias("html"))


def href_of(index: DataFrame, config: Config, within: bool = False) -> Column:
    """A message's link from an index page of the list, or, within, from one in the message's folder."""
    folder = F.col("folder") if "folder" in index.columns and not within else F.lit("")
    return message_url(folder, F.lit(""), names(config), config.htmlsuffix)


def index_row(index: DataFrame, config: Config, within: bool = False) -> Column:
    cells = [F.concat(F.lit('<a href="'), href_of(index, config, within), F.lit('">'), subject_cell(config), F.lit("</a>")), author_cell(config), date_cell(config)]
    return F.concat(F.lit("<tr><td>"), F.concat_ws("</td><td>", *cells), F.lit("</td></tr>")) if config.indextable else F.concat(F.lit("<li>"), F.concat_ws(" ", *cells), F.lit("</li>"))


def index_rows(index: DataFrame, config: Config, within: bool = False) -> DataFrame:
    """Rendered rows of a date, subject or author index, by ord."""
    return index.select("list_id", "ord", "msgnum", index_row(index, config, within).alias("html"))


def overview_xml(messages: DataFrame) -> DataFrame:
    """One <mail> element a message, deleted ones included."""
    field = lambda tag, c: F.concat(F.lit(f"<{tag}>"), escape_xml(F.coalesce(c, F.lit(""))), F.lit(f"</{tag}>"))
    xml = F.concat(F.lit("<mail>"), field("file", F.col("msgnum").cast("string")), field("date", F.col("date").cast("string")), field("fromname", decode_mime_words(F.col("name"))),
                   field("fromemail", F.col("email_addr")), field("subject", decode_mime_words(F.col("subject"))), field("msgid", F.col("msgid")), F.lit("</mail>"))
    return messages.select("list_id", "pos", xml.alias("xml"))
