"""Registered queries over the driver's tables, and their oracle SQL, by inventory id.

There is no mailbox among the tables, so messages are derived from conversations (and lines from
documents) by the same rule on both sides: here with DataFrame functions, in SQL by MESSAGES_SQL.
Every query reads its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import dates, mail, quotes, text
from .operators import dedup, filters, indexes, lines, ranking, search, threads

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str, only: bool = True) -> DataFrame:
    """Messages of five lists. Positions are counted by pieces of conv_id."""
    c = read(spark, sf_dir, "conversations")
    conv, turn = F.col("conv_id"), F.col("turn")
    rows = c.select("conv_id", "turn", "role", F.col("text").alias("body_text"), F.concat(F.lit("list-"), (conv % 5).cast("string")).alias("list_id"))
    rows = ranking.positions(rows, ["list_id"], ["conv_id", "turn"], F.floor(conv / 4096))
    subject = F.concat(F.when(turn == 0, "").when(turn % 2 == 1, "Re: ").otherwise("AW: Re: "), F.when(conv % 11 == 0, "Request ").otherwise("Topic "), (conv % 40).cast("string"))
    reply = F.when((turn > 0) & ((conv + turn) % 3 == 0), F.concat(F.lit(" <"), conv.cast("string"), F.lit("."), (turn - 1).cast("string"), F.lit("@List.Example>")))
    reply = reply.when((conv * 7 + turn) % 29 == 0, F.lit("<missing@elsewhere>"))
    out = rows.select(
        "list_id", "pos", F.col("pos").cast("int").alias("msgnum"), "conv_id", "turn",
        F.concat(F.lit("<"), conv.cast("string"), F.lit("."), turn.cast("string"), F.lit("@list.example>")).alias("msgid"), reply.alias("inreplyto"),
        subject.alias("subject"), F.concat("role", F.lit(" "), (conv % 17).cast("string")).alias("name"),
        F.concat("role", (conv % 17).cast("string"), F.lit("@host"), (conv % 3).cast("string"), F.lit(".example.org")).alias("email_addr"),
        F.when((conv + turn) % 41 == 0, 0).otherwise(F.lit(1_600_000_000).cast("bigint") + conv % 900 * 200_000 + turn * 3600).cast("bigint").alias("date"), "body_text")
    return out.withColumn("unre_subject", text.unre(F.col("subject")))


MESSAGES_SQL = """
m0 AS (SELECT conv_id, turn, role, text AS body_text, concat('list-', conv_id % 5) AS list_id FROM conversations),
m AS (SELECT *, CAST(pos AS INTEGER) AS msgnum,
    trim(regexp_replace(subject, '^(\\s*(re|fwd?|aw|ang|sv|vs|odp|antw)\\s*[\\[:\\]>#]*\\s*)+', '', 'i')) AS unre_subject FROM (
  SELECT list_id, row_number() OVER (PARTITION BY list_id ORDER BY conv_id, turn) - 1 AS pos, conv_id, turn, body_text,
    concat('<', conv_id, '.', turn, '@list.example>') AS msgid,
    CASE WHEN turn > 0 AND (conv_id + turn) % 3 = 0 THEN concat(' <', conv_id, '.', turn - 1, '@List.Example>')
         WHEN (conv_id * 7 + turn) % 29 = 0 THEN '<missing@elsewhere>' END AS inreplyto,
    concat(CASE WHEN turn = 0 THEN '' WHEN turn % 2 = 1 THEN 'Re: ' ELSE 'AW: Re: ' END,
           CASE WHEN conv_id % 11 = 0 THEN 'Request ' ELSE 'Topic ' END, conv_id % 40) AS subject,
    concat(role, ' ', conv_id % 17) AS name, concat(role, conv_id % 17, '@host', conv_id % 3, '.example.org') AS email_addr,
    CAST(CASE WHEN (conv_id + turn) % 41 = 0 THEN 0 ELSE 1600000000 + conv_id % 900 * 200000 + turn * 3600 END AS BIGINT) AS date
  FROM m0))"""

EDGES_SQL = """
n AS (SELECT *, lower(unre_subject) AS key, length(unre_subject) < length(subject) AS is_re FROM m),
w AS (SELECT *, min({'r': CAST(is_re AS INTEGER), 'p': pos}) OVER (PARTITION BY list_id, key ORDER BY pos RANGE BETWEEN 500 PRECEDING AND 1 PRECEDING) AS best FROM n),
edges AS (
  SELECT c.list_id, p.msgnum AS parent_msgnum, c.msgnum AS child_msgnum, 0 AS maybe_reply, 'header' AS kind, c.pos AS seq
  FROM m c JOIN m p ON c.list_id = p.list_id AND lower(trim(c.inreplyto)) = lower(trim(p.msgid))
  UNION ALL
  SELECT list_id, CAST(best.p AS INTEGER), msgnum, 1, 'subject', 1099511627776 + pos
  FROM w WHERE inreplyto IS NULL AND is_re AND unre_subject <> '' AND best IS NOT NULL)"""

# --- joins and threads -------------------------------------------------------------------------


@query("j_reply_edges", f"WITH {MESSAGES_SQL}, {EDGES_SQL} SELECT * FROM edges")
def _reply_edges(spark, d):
    return threads.reply_edges(messages(spark, d))


@query("j1_header_edges", f"WITH {MESSAGES_SQL}, {EDGES_SQL} SELECT * FROM edges WHERE kind = 'header'")
def _header_edges(spark, d):
    return threads.header_edges(messages(spark, d))


@query("j2_unresolved_replies", f"""WITH {MESSAGES_SQL} SELECT list_id, msgnum, inreplyto FROM m c WHERE inreplyto IS NOT NULL
 AND NOT EXISTS (SELECT 1 FROM m p WHERE p.list_id = c.list_id AND lower(trim(p.msgid)) = lower(trim(c.inreplyto)))""")
def _unresolved(spark, d):
    return threads.unresolved_replies(messages(spark, d)).select("list_id", "msgnum", "inreplyto")


@query("j3_subject_look_back", f"WITH {MESSAGES_SQL}, {EDGES_SQL} SELECT * FROM edges WHERE kind = 'subject'")
def _subject_edges(spark, d):
    return threads.subject_edges(messages(spark, d))


QUOTING_SQL = """q AS (SELECT *, concat(body_text, chr(10), 'see <', conv_id, '.', CASE WHEN turn > 1 THEN turn - 2 ELSE turn END, '@list.example> and <x y>') AS quoted FROM m)"""


def _quoting(spark, d):
    m = messages(spark, d)
    back = F.when(F.col("turn") > 1, F.col("turn") - 2).otherwise(F.col("turn"))
    tail = F.concat(F.lit("\nsee <"), F.col("conv_id").cast("string"), F.lit("."), back.cast("string"), F.lit("@list.example> and <x y>"))
    return m, lines.explode_lines(m.withColumn("body_text", F.concat("body_text", tail)))


@query("j4_quoted_id_edges", f"""WITH {MESSAGES_SQL}, {QUOTING_SQL},
t AS (SELECT list_id, pos, msgnum, unnest(regexp_extract_all(quoted, '<[^>\\n]*>')) AS tok FROM q)
SELECT t.list_id, p.msgnum AS parent_msgnum, t.msgnum AS child_msgnum, 1 AS maybe_reply, 'quoted' AS kind, 2199023255552 + t.pos AS seq
FROM t JOIN m p ON p.list_id = t.list_id AND p.msgid = t.tok WHERE p.msgnum <> t.msgnum""")
def _quoted(spark, d):
    return threads.quoted_edges(*_quoting(spark, d))


@query("j5_children", f"""WITH {MESSAGES_SQL}, {EDGES_SQL} SELECT e.list_id, e.parent_msgnum, e.child_msgnum, e.seq, m.subject, m.name
FROM edges e JOIN m ON m.list_id = e.list_id AND m.msgnum = e.child_msgnum""")
def _children(spark, d):
    m = messages(spark, d)
    return threads.children_of(m, threads.reply_edges(m)).select("list_id", "parent_msgnum", "child_msgnum", "seq", "subject", "name")


@query("j6_roots", f"""WITH {MESSAGES_SQL}, {EDGES_SQL} SELECT list_id, msgnum, date FROM m
WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.list_id = m.list_id AND e.child_msgnum = m.msgnum)""")
def _roots(spark, d):
    m = messages(spark, d)
    return threads.roots(m, threads.reply_edges(m)).select("list_id", "msgnum", "date")


@query("j6_replies", f"""WITH {MESSAGES_SQL}, {EDGES_SQL} SELECT list_id, msgnum, date FROM m
WHERE EXISTS (SELECT 1 FROM edges e WHERE e.list_id = m.list_id AND e.child_msgnum = m.msgnum)""")
def _replies(spark, d):
    m = messages(spark, d)
    return threads.replies(m, threads.reply_edges(m)).select("list_id", "msgnum", "date")


@query("j7_folder_edges", f"""WITH {MESSAGES_SQL}, {EDGES_SQL} SELECT list_id, parent_msgnum, child_msgnum, kind, CAST(parent_msgnum // 50 AS VARCHAR) AS folder
FROM edges WHERE parent_msgnum // 50 = child_msgnum // 50""")
def _folder_edges(spark, d):
    m = messages(spark, d)
    return threads.folder_edges(threads.reply_edges(m), indexes.with_folder(m, 50)).select("list_id", "parent_msgnum", "child_msgnum", "kind", "folder")


REPEATED_SQL = "r AS (SELECT * EXCLUDE (msgid), CASE WHEN conv_id % 13 = 0 THEN NULL WHEN conv_id % 7 = 0 THEN ' ' WHEN turn % 3 = 1 THEN upper(concat('<', conv_id, '.0@list.example>')) ELSE msgid END AS msgid FROM m)"


def _repeated(spark, d):
    conv = F.col("conv_id")
    first = F.upper(F.concat(F.lit("<"), conv.cast("string"), F.lit(".0@list.example>")))
    return messages(spark, d).withColumn("msgid", F.when(conv % 13 == 0, None).when(conv % 7 == 0, " ").when(F.col("turn") % 3 == 1, first).otherwise(F.col("msgid")))


@query("j8_first_by_msgid", f"""WITH {MESSAGES_SQL}, {REPEATED_SQL}, k AS (SELECT *, lower(trim(msgid)) AS msgid_key FROM r)
SELECT list_id, pos, msgnum, msgid_key FROM k WHERE coalesce(msgid_key, '') = ''
   OR pos = (SELECT min(pos) FROM k k2 WHERE k2.list_id = k.list_id AND k2.msgid_key = k.msgid_key)""")
def _first_by_msgid(spark, d):
    return dedup.first_by_msgid(_repeated(spark, d)).select("list_id", "pos", "msgnum", "msgid_key")


@query("f12_require_msgids", f"WITH {MESSAGES_SQL}, {REPEATED_SQL} SELECT list_id, msgnum FROM r WHERE msgid IS NOT NULL")
def _with_ids(spark, d):
    return filters.with_ids(_repeated(spark, d)).select("list_id", "msgnum")


@query("j10_localized_words", """WITH w(lang, key, value) AS (VALUES ('en','Author','Author'),('en','Subject','Subject'),('de','Author','Autor'),('de','Subject','Betreff'),
 ('fr','Author','Auteur'),('fr','Subject','Sujet'),('es','Author','Autor'),('es','Subject','Asunto'))
SELECT doc_id, k.key, coalesce(w.value, e.value, k.key) AS value FROM documents CROSS JOIN (VALUES ('Author'),('Subject'),('Unknown')) k(key)
LEFT JOIN w ON w.lang = documents.lang AND w.key = k.key LEFT JOIN w e ON e.lang = 'en' AND e.key = k.key""")
def _localized(spark, d):
    from .sources.locale import locale_table, localized

    rows = read(spark, d, "documents").select("doc_id", "lang", F.explode(F.array(*map(F.lit, ("Author", "Subject", "Unknown")))).alias("key"))
    return localized(rows, locale_table(spark)).select("doc_id", "key", "value")


@query("j11_probe_overlap", f"""WITH {MESSAGES_SQL}, {REPEATED_SQL} SELECT list_id FROM m WHERE pos = 0
 AND EXISTS (SELECT 1 FROM r WHERE r.list_id = m.list_id AND lower(trim(r.msgid)) = lower(trim(m.msgid)))""")
def _probe(spark, d):
    """Lists of the raw messages that a state, whose ids partly differ, knows."""
    from .plans.archive import known_lists

    state = _repeated(spark, d).select("list_id", mail.normalize_msgid(F.col("msgid")).alias("msgid_key"))
    return known_lists(raw_messages(spark, d), state)


@query("t1_thread_walk", f"""WITH RECURSIVE {MESSAGES_SQL}, {EDGES_SQL},
walk AS (
  SELECT list_id, msgnum AS root, msgnum, 0 AS depth, CAST([] AS BIGINT[]) AS path FROM m
  WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.list_id = m.list_id AND e.child_msgnum = m.msgnum)
  UNION ALL
  SELECT w.list_id, w.root, e.child_msgnum, w.depth + 1, list_append(w.path, e.seq) FROM walk w JOIN edges e ON e.list_id = w.list_id AND e.parent_msgnum = w.msgnum)
SELECT list_id, root, msgnum, depth, CAST(row_number() OVER (PARTITION BY list_id, root ORDER BY path) - 1 AS INTEGER) AS ord, depth <= 50 AS shown FROM walk""")
def _thread_walk(spark, d):
    m = messages(spark, d)
    return threads.thread_walk(spark, m, threads.reply_edges(m))


@query("t1_thread_walk_general", ORACLE_SQL["t1_thread_walk"])
def _thread_walk_general(spark, d):
    m = messages(spark, d)
    return threads.thread_walk_general(m, threads.reply_edges(m))


# --- sorts, ranks, groups ----------------------------------------------------------------------


@query("w1_message_numbers", f"WITH {MESSAGES_SQL} SELECT list_id, pos, CAST(100 + 2 * pos AS INTEGER) AS msgnum FROM m")
def _numbers(spark, d):
    return ranking.number_messages(messages(spark, d).select("list_id", "pos"), 100, 2)


@query("w2_dense_positions", f"WITH {MESSAGES_SQL}, {REPEATED_SQL} SELECT list_id, msgnum, row_number() OVER (PARTITION BY list_id ORDER BY pos) - 1 AS pos FROM r WHERE msgid IS NOT NULL")
def _dense(spark, d):
    """Positions after the gate that asks for ids has left gaps."""
    return ranking.dense_positions(filters.with_ids(_repeated(spark, d)).select("list_id", "pos", "msgnum"))


def _index_sql(key: str, desc: str = "") -> str:
    return f"WITH {MESSAGES_SQL} SELECT list_id, msgnum, row_number() OVER (PARTITION BY list_id ORDER BY {key} {desc}, msgnum {desc}) - 1 AS ord FROM m"


for _n, _f, _k in (("date", indexes.date_index, "date"), ("subject", indexes.subject_index, "lower(coalesce(unre_subject, subject, ''))"), ("author", indexes.author_index, "lower(coalesce(name, email_addr, ''))")):
    for _r in (False, True):
        def _index(spark, d, f=_f, r=_r):
            return f(messages(spark, d), r).select("list_id", "msgnum", "ord")

        query(f"o_{_n}_index{'_reversed' if _r else ''}", _index_sql(_k, "DESC" if _r else ""))(_index)


@query("o8_largest_orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def _top(spark, d):
    return ranking.top(read(spark, d, "orders").select("o_orderkey", "o_totalprice"), F.desc("o_totalprice"), "o_orderkey", n=20)


@query("a1_archive_stats", f"WITH {MESSAGES_SQL} SELECT list_id, min(date) AS first_date, max(date) AS last_date, count(*) AS n_messages FROM m GROUP BY list_id")
def _stats(spark, d):
    return indexes.archive_stats(messages(spark, d))


@query("a2_folder_stats", f"""WITH {MESSAGES_SQL} SELECT list_id, CASE WHEN date > 0 THEN strftime(to_timestamp(date), '%Y/%m') ELSE '' END AS folder,
count(*) AS n_messages, min(date) AS first_date, max(date) AS last_date FROM m GROUP BY 1, 2""")
def _folders(spark, d):
    return indexes.folder_stats(indexes.with_folder(messages(spark, d), folder_by_date="%Y/%m"))


@query("a3_monthly", f"""WITH {MESSAGES_SQL} SELECT list_id, strftime(to_timestamp(date), '%Y-%m') AS month, concat(strftime(to_timestamp(date), '%Y-%m'), '.html') AS file,
count(*) AS n_messages, min(date) AS first_date, max(date) AS last_date FROM m GROUP BY ALL""")
def _monthly(spark, d):
    return indexes.monthly(messages(spark, d), utc=True)


@query("a4_yearly", f"""WITH {MESSAGES_SQL} SELECT list_id, strftime(to_timestamp(date), '%Y') AS year, concat('year-', strftime(to_timestamp(date), '%Y'), '.html') AS file,
count(*) AS n_messages, min(date) AS first_date, max(date) AS last_date FROM m GROUP BY ALL""")
def _yearly(spark, d):
    return indexes.yearly(messages(spark, d), utc=True)


@query("a34_calendar_rollup", f"""WITH {MESSAGES_SQL}, c AS (SELECT list_id, strftime(to_timestamp(date), '%Y') AS year, strftime(to_timestamp(date), '%Y-%m') AS month FROM m)
SELECT list_id, year, month, count(*) AS n_messages FROM c GROUP BY GROUPING SETS ((list_id, year, month), (list_id, year), (list_id))""")
def _calendar(spark, d):
    return indexes.calendar_rollup(messages(spark, d), utc=True)


@query("a3_events_by_month", "SELECT strftime(ts, '%Y-%m') AS month, count(*) AS n, sum(value) AS total FROM events GROUP BY 1")
def _events(spark, d):
    return read(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("a5_folders", f"""WITH {MESSAGES_SQL} SELECT list_id, msgnum, CAST(msgnum // 20 AS VARCHAR) AS folder, '../' AS rel_path_to_top FROM m""")
def _folder_of(spark, d):
    return indexes.with_folder(messages(spark, d), 20).select("list_id", "msgnum", "folder", "rel_path_to_top")


@query("a6_latest_folder", f"""WITH {MESSAGES_SQL}, f AS (SELECT list_id, date, pos, CASE WHEN date > 0 THEN strftime(to_timestamp(date), '%Y-%m') END AS folder FROM m)
SELECT list_id, coalesce((SELECT folder FROM f g WHERE g.list_id = f.list_id ORDER BY date DESC, pos DESC LIMIT 1), '.') AS latest_folder FROM f GROUP BY list_id""")
def _latest(spark, d):
    return indexes.latest_folder(indexes.with_folder(messages(spark, d), folder_by_date="%Y-%m"))


@query("a7_largest_msgnum", f"WITH {MESSAGES_SQL} SELECT coalesce(max(msgnum), -1) AS max_msgnum FROM m")
def _largest(spark, d):
    return indexes.largest_msgnum(messages(spark, d))


# --- lines and text ----------------------------------------------------------------------------

# every third line of a document becomes a quotation, by its number
LINES_SQL = """l0 AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '\\n$', ''), chr(10))) AS raw, generate_subscripts(string_split(regexp_replace(text, '\\n$', ''), chr(10)), 1) - 1 AS line_no
  FROM documents WHERE text <> ''),
l AS (SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, concat(CASE line_no % 6 WHEN 1 THEN '> ' WHEN 2 THEN '>> ' WHEN 3 THEN '| > ' WHEN 4 THEN ':' ELSE '' END, raw) AS line FROM l0)"""


def doc_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "documents").select(F.lit("docs").alias("list_id"), F.col("doc_id").alias("msgnum"), F.col("text").alias("body_text"))
    n = F.col("line_no") % 6
    mark = F.when(n == 1, "> ").when(n == 2, ">> ").when(n == 3, "| > ").when(n == 4, ":").otherwise("")
    return lines.explode_lines(rows).withColumn("line", F.concat(mark, "line"))


@query("m_body_lines", f"WITH {LINES_SQL} SELECT doc_id, line_no, line FROM l")
def _lines(spark, d):
    return doc_lines(spark, d).select(F.col("msgnum").alias("doc_id"), "line_no", "line")


@query("q_quote_lines", f"""WITH {LINES_SQL} SELECT doc_id, line_no, regexp_matches(line, '^[>|:]') AS quoted, regexp_replace(line, '^[>|:] ?', '') AS unquoted,
 CAST(length(replace(regexp_extract(line, '^([>|:] ?)+'), ' ', '')) AS INTEGER) AS depth,
 CASE WHEN regexp_matches(line, '^[>|:]') THEN concat('hm-quote-', least(9, length(replace(regexp_extract(line, '^([>|:] ?)+'), ' ', '')))) ELSE '' END AS css FROM l""")
def _quote_lines(spark, d):
    c = F.col("line")
    return doc_lines(spark, d).select(F.col("msgnum").alias("doc_id"), "line_no", quotes.is_quote(c).alias("quoted"), quotes.unquote(c).alias("unquoted"), quotes.quote_depth(c).alias("depth"), quotes.quote_class(c).alias("css"))


@query("q5_usual_quote_prefix", f"""WITH {LINES_SQL}, p AS (SELECT doc_id, regexp_extract(line, '^[>|:] ?') AS p FROM l WHERE regexp_matches(line, '^[>|:]')),
c AS (SELECT doc_id, p, count(*) AS n, list_position(['> ', '>', '| ', '|', ': ', ':'], p) AS o FROM p GROUP BY 1, 2)
SELECT doc_id, max_by(p, n * 100 + o) AS quote_prefix FROM c GROUP BY doc_id""")
def _usual_prefix(spark, d):
    return lines.usual_quote_prefix(doc_lines(spark, d)).select(F.col("msgnum").alias("doc_id"), "quote_prefix")


@query("q7_quoted_percent", f"WITH {LINES_SQL} SELECT doc_id, CAST(count(*) FILTER (WHERE regexp_matches(line, '^[>|:]')) * 100 // count(*) AS INTEGER) AS quoted_percent FROM l GROUP BY doc_id")
def _quoted_percent(spark, d):
    return lines.quoted_percent(doc_lines(spark, d)).select(F.col("msgnum").alias("doc_id"), "quoted_percent")


@query("q10_signature_state", f"""WITH {LINES_SQL}, s AS (SELECT doc_id, line_no, CASE WHEN line_no = 3 THEN '-- ' ELSE line END AS line FROM l)
SELECT doc_id, line_no, max(CAST(line IN ('-- ', '--') AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) = 1 AS in_signature FROM s""")
def _signature(spark, d):
    rows = doc_lines(spark, d).withColumn("line", F.when(F.col("line_no") == 3, "-- ").otherwise(F.col("line")))
    return lines.render_lines(rows, 0).select(F.col("msgnum").alias("doc_id"), "line_no", "in_signature")


@query("q14_line_runs", f"""WITH {LINES_SQL}, c AS (SELECT doc_id, line_no, CASE WHEN trim(line) = '' THEN 'hm-blank' WHEN line IN ('-- ', '--') THEN 'hm-sig' WHEN line LIKE '>%' THEN
 concat('hm-quote-', least(9, length(replace(regexp_extract(line, '^([>|:] ?)+'), ' ', '')))) ELSE 'hm-pg' END AS css FROM l),
g AS (SELECT *, CASE WHEN css = lag(css) OVER (PARTITION BY doc_id ORDER BY line_no) THEN 0 ELSE 1 END AS new FROM c),
r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS run FROM g)
SELECT doc_id, CAST(run AS BIGINT) AS run, css, count(*) AS n_lines FROM r GROUP BY doc_id, run, css""")
def _runs(spark, d):
    return lines.coalesce_runs(lines.render_lines(doc_lines(spark, d), 2)).select(F.col("msgnum").alias("doc_id"), "run", "css", "n_lines")


@query("q11_rendered_lines", f"""WITH {LINES_SQL}, c AS (SELECT doc_id, line_no, line, CASE WHEN trim(line) = '' THEN 'hm-blank' WHEN line IN ('-- ', '--') THEN 'hm-sig' WHEN line LIKE '>%' THEN
 concat('hm-quote-', least(9, length(replace(regexp_extract(line, '^([>|:] ?)+'), ' ', '')))) ELSE 'hm-pg' END AS css FROM l)
SELECT doc_id, line_no, css, CASE css WHEN 'hm-blank' THEN '<div class="hm-blank"></div>' WHEN 'hm-sig' THEN '<hr class="hm-sig">' ELSE concat('<div class="', css, '">',
 replace(replace(replace(replace(replace(replace(line, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;'), chr(9), '        '), '</div>') END AS html FROM c""")
def _rendered(spark, d):
    return lines.render_lines(doc_lines(spark, d), 2).select(F.col("msgnum").alias("doc_id"), "line_no", "css", "html")


@query("q9_anchor_tags", "SELECT page_id, regexp_replace(concat(html, '<A name=x>\n', url, '</a>!'), '(?is)<a name.*?</a>', '', 'g') AS html FROM pages")
def _anchors(spark, d):
    c = F.concat("html", F.lit("<A name=x>\n"), "url", F.lit("</a>!"))
    return read(spark, d, "pages").select("page_id", quotes.strip_anchor_tags(c).alias("html"))


@query("q13_inline_images", """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN concat('<img src="data:image/png;base64,', to_base64(encode(url)), '" alt="inline image">') END AS html FROM pages""")
def _inline(spark, d):
    """Of a safe type, of another type, and of data that isn't base64. Spark folds base64 into lines of 76; a marker is one line."""
    k = F.col("page_id") % 3
    kind, data = F.when(k == 1, "image/svg+xml").otherwise("image/png"), F.translate(F.base64(F.col("url").cast("binary")), "\r\n", "")
    line = F.concat(F.lit("[INLINE_IMAGE:"), kind, F.lit(":"), F.when(k == 2, F.concat(F.lit('"'), data)).otherwise(data), F.lit("]"))
    return read(spark, d, "pages").select("page_id", quotes.inline_image(line).alias("html"))


@query("c18_dated_paths", "SELECT o_orderkey, strftime(o_orderdate, '/a/%Y/%m-%d/%j %b %a %%q%%') AS path FROM orders")
def _dated_paths(spark, d):
    return read(spark, d, "orders").select("o_orderkey", dates.dated_path("/a/%y/%m-%d/%j %M %D %q%%", F.col("o_orderdate")).alias("path"))


HTML_SQL = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '{1}')"


@query("c5_c12_c13_escapes", f"""SELECT page_id, {HTML_SQL.format('html', '&#39;')} AS attr, replace({HTML_SQL.format('html', '&#39;')}, chr(9), '        ') AS body,
 {HTML_SQL.format('html', '&apos;')} AS xml FROM pages""")
def _escapes(spark, d):
    c = F.col("html")
    return read(spark, d, "pages").select("page_id", text.escape_html_attr(c).alias("attr"), text.escape_html(c).alias("body"), text.escape_xml(c).alias("xml"))


URL_SQL = r"""((https?|ftp)://[^\s<>"'']+|www\.[^\s<>"'']+)"""


@query("c4_urls", f"SELECT page_id, regexp_extract(html, '(?i){URL_SQL}', 0) AS first_url, regexp_extract_all(html, '(?i){URL_SQL}', 0) AS urls FROM pages")
def _urls(spark, d):
    return read(spark, d, "pages").select("page_id", text.find_url(F.col("html")).alias("first_url"), text.find_urls(F.col("html")).alias("urls"))


@query("c3_linked_urls", f"""WITH t AS (SELECT page_id, concat('go to ', url, ' or www.', page_id, '.example.org <now>') AS line FROM pages)
SELECT page_id, regexp_replace(regexp_replace(replace(replace(replace(line, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '(https?://[^\\s]+)', '<a href="\\1" rel="noopener noreferrer">\\1</a>', 'g'),
 ' (www\\.[^\\s]+)', ' <a href="https://\\1" rel="noopener noreferrer">\\1</a>', 'g') AS html FROM t""")
def _linked(spark, d):
    line = F.concat(F.lit("go to "), "url", F.lit(" or www."), F.col("page_id").cast("string"), F.lit(".example.org <now>"))
    return read(spark, d, "pages").select("page_id", text.link_urls(line).alias("html"))


@query("c1_bare_subjects", f"WITH {MESSAGES_SQL} SELECT list_id, msgnum, subject, unre_subject, trim(regexp_replace(subject, '^\\s*(re|fwd?|aw|ang|sv|vs|odp|antw)\\s*[\\[:\\]>#]*\\s*', '', 'i')) AS once FROM m")
def _unre(spark, d):
    return messages(spark, d).select("list_id", "msgnum", "subject", "unre_subject", text.oneunre(F.col("subject")).alias("once"))


@query("c8_spamified", r"SELECT doc_id, regexp_replace(text, '([a-zA-Z0-9._%+-]+)@([a-zA-Z0-9.-]+\.[a-zA-Z]{2,})', '\1_at_\2', 'g') AS shown, regexp_replace(text, '([a-zA-Z0-9._%+-]+)@([a-zA-Z0-9.-]+\.[a-zA-Z]{2,})', '\1@hidden.example', 'g') AS moved FROM documents")
def _spamified(spark, d):
    c = F.col("text")
    return read(spark, d, "documents").select("doc_id", text.spamify(c).alias("shown"), text.spamify(c, domain="hidden.example").alias("moved"))


@query("c6_obfuscated", f"""WITH {MESSAGES_SQL} SELECT list_id, msgnum, array_to_string(list_transform(string_split(email_addr, ''),
 lambda c: CASE WHEN regexp_matches(c, '[a-zA-Z0-9@]') THEN concat('&#', ascii(c), ';') ELSE c END), '') AS hidden, email_addr AS shown FROM m""")
def _obfuscated(spark, d):
    hidden = text.obfuscate(F.col("email_addr"))
    return messages(spark, d).select("list_id", "msgnum", hidden.alias("hidden"), text.unobfuscate(hidden).alias("shown"))


@query("c9_c10_c11_cleanups", """SELECT p_partkey, translate(p_name, ' #', '__') AS conv, concat(p_name, ' +0100') AS bare, CASE WHEN p_size % 2 = 0 THEN NULL ELSE p_brand END AS value FROM part""")
def _cleanups(spark, d):
    value = F.when(F.col("p_size") % 4 == 0, "none").when(F.col("p_size") % 2 == 0, " ").otherwise(F.col("p_brand"))
    return read(spark, d, "part").select("p_partkey", text.convchars(F.col("p_name"), " #").alias("conv"),
                                         text.stripzone(F.concat("p_name", F.lit(" +0100 (CET) "))).alias("bare"), text.getvalue(value).alias("value"))


@query("c14_search_text", r"SELECT doc_id, regexp_replace(regexp_replace(text, '[^\p{L}\p{N}\s.@-]', '', 'g'), '\s', ' ', 'g') AS clean FROM documents")
def _clean(spark, d):
    return read(spark, d, "documents").select("doc_id", text.sanitize_for_search(F.col("text")).alias("clean"))


@query("c16_message_names", f"""WITH {MESSAGES_SQL} SELECT list_id, msgnum, lpad(CAST(msgnum AS VARCHAR), greatest(4, length(CAST(msgnum AS VARCHAR)))::INTEGER, '0') AS name FROM m""")
def _names(spark, d):
    return messages(spark, d).select("list_id", "msgnum", text.message_name(F.col("msgnum"), F.col("msgid"), F.col("date")).alias("name"))


@query("c16_fnv32", f"""WITH {MESSAGES_SQL} SELECT list_id, msgnum, CAST(list_reduce(list_transform(string_split(msgid, ''), lambda c: CAST(ascii(c) AS BIGINT)),
 lambda h, b: (xor(h, b) * 16777619) & 4294967295, CAST(2166136261 AS BIGINT)) AS BIGINT) AS fnv FROM m""")
def _fnv(spark, d):
    return messages(spark, d).select("list_id", "msgnum", text.fnv32(F.col("msgid").cast("binary")).alias("fnv"))


@query("c17_c19_paths", f"""WITH {MESSAGES_SQL}, f AS (SELECT *, CAST(msgnum // 20 AS VARCHAR) AS folder, concat(lpad(CAST(msgnum AS VARCHAR), greatest(4, length(CAST(msgnum AS VARCHAR)))::INTEGER, '0'), '.html') AS file FROM m)
SELECT list_id, msgnum, concat(folder, '/', file) AS path, CASE WHEN folder = '1' THEN file ELSE concat(folder, '/', file) END AS url, msgnum % 3 <> 0 AS rooted FROM f""")
def _paths(spark, d):
    m = indexes.with_folder(messages(spark, d), 20)
    name = text.message_name(F.col("msgnum"), F.col("msgid"), F.col("date"))
    return m.select("list_id", "msgnum", text.message_path(F.col("folder"), name).alias("path"), text.message_url(F.col("folder"), F.lit("1"), name).alias("url"),
                    text.is_rooted_path(F.concat(F.when(F.col("msgnum") % 3 == 0, "").when(F.col("msgnum") % 3 == 1, "/").otherwise("c:"), "folder")).alias("rooted"))


@query("c21_array_helpers", """SELECT o_orderkey, o_orderpriority IN ('1-URGENT', '2-HIGH') AS urgent, CASE WHEN o_orderpriority = '1-URGENT' THEN 0 WHEN o_orderpriority = '2-HIGH' THEN 1 ELSE -1 END AS at,
 CASE WHEN o_orderpriority LIKE '%LOW%' THEN 0 WHEN o_orderpriority LIKE '%H%' THEN 1 ELSE -1 END AS pattern_at, list_sort(list_distinct(['O', 'F', o_orderstatus])) AS merged FROM orders""")
def _arrays(spark, d):
    c = F.col("o_orderpriority")
    items = F.array(F.lit("1-URGENT"), F.lit("2-HIGH"))
    merged = F.array_sort(text.add_to_list(F.array(F.lit("O"), F.lit("F")), F.array("o_orderstatus")))
    return read(spark, d, "orders").select("o_orderkey", text.inlist(items, c).alias("urgent"), text.inlist_pos(items, c).alias("at"), text.inlist_regex_pos(["LOW", "H"], c).alias("pattern_at"), merged.alias("merged"))


@query("m12_unflowed", """WITH t AS (SELECT doc_id, CASE WHEN text = '' THEN '' ELSE concat(regexp_replace(text, '\\n$', ''), chr(10)) END AS t FROM documents)
SELECT doc_id, regexp_replace(t, ' +\\n', ' ', 'g') AS flowed FROM t""")
def _unflowed(spark, d):
    return read(spark, d, "documents").select("doc_id", mail.unflow(F.col("text")).alias("flowed"))


@query("m13_safe_images", "SELECT page_id, page_id % 3 = 0 AS safe FROM pages")
def _images(spark, d):
    kind = F.when(F.col("page_id") % 3 == 0, "image/png").when(F.col("page_id") % 3 == 1, "image/svg+xml").otherwise("text/html")
    return read(spark, d, "pages").select("page_id", kind.isin(*quotes.SAFE_IMAGES).alias("safe"))


# --- headers, addresses, dates -----------------------------------------------------------------

HEADERS_SQL = """hd AS (SELECT *, [{'name': 'from', 'value': concat('"', name, '" <', email_addr, '>')}, {'name': 'subject', 'value': subject}, {'name': 'x-no-archive', 'value': CASE WHEN conv_id % 9 = 0 THEN 'YES' ELSE 'no' END}] AS headers FROM m)"""


def _with_headers(spark, d):
    m = messages(spark, d)
    raw = F.concat(F.lit('From: "'), "name", F.lit('" <'), "email_addr", F.lit(">\nSubject: "), "subject", F.lit("\nno colon here\nX-No-Archive:\n "),
                   F.when(F.col("conv_id") % 9 == 0, "YES").otherwise("no"), F.lit("\n\nBody: x\n"))
    return m.withColumn("headers", mail.parse_headers(raw))


@query("p1_p2_p3_headers", f"WITH {MESSAGES_SQL}, {HEADERS_SQL} SELECT list_id, msgnum, list_transform(headers, lambda h: concat(h.name, '=', h.value)) AS headers, subject AS found, CAST([subject] AS VARCHAR[]) AS every FROM hd")
def _headers(spark, d):
    flat = F.transform("headers", lambda h: F.concat(h["name"], F.lit("="), h["value"]))
    return _with_headers(spark, d).select("list_id", "msgnum", flat.alias("headers"), mail.find_header(F.col("headers"), "Subject").alias("found"), mail.find_headers(F.col("headers"), "subject").alias("every"))


@query("p5_addresses", f"""WITH {MESSAGES_SQL} SELECT list_id, msgnum, CASE turn % 4 WHEN 0 THEN name WHEN 1 THEN name WHEN 2 THEN NULL ELSE name END AS name,
 CASE turn % 4 WHEN 3 THEN NULL ELSE email_addr END AS email FROM m""")
def _addresses(spark, d):
    k = F.col("turn") % 4
    form = (F.when(k == 0, F.concat(F.lit('"'), "name", F.lit('" <'), "email_addr", F.lit(">"))).when(k == 1, F.concat("email_addr", F.lit(" ("), "name", F.lit(")")))
            .when(k == 2, F.col("email_addr")).otherwise(F.col("name")))
    who = mail.address(form)
    return messages(spark, d).select("list_id", "msgnum", who["name"].alias("name"), who["email"].alias("email"))


@query("p12_p13_reply_ids", f"WITH {MESSAGES_SQL} SELECT list_id, msgnum, coalesce(inreplyto, msgid) AS irt, lower(trim(coalesce(inreplyto, msgid))) AS key FROM m")
def _reply_ids(spark, d):
    irt = mail.in_reply_to(F.col("inreplyto"), F.concat(F.lit("<first@x> "), "msgid", F.lit(" tail")))
    return messages(spark, d).select("list_id", "msgnum", irt.alias("irt"), mail.normalize_msgid(irt).alias("key"))


@query("p4_unfolded", "SELECT p_partkey, concat(p_name, ' ', p_brand, p_type) AS unfolded FROM part")
def _unfolded(spark, d):
    return read(spark, d, "part").select("p_partkey", mail.unfold(F.concat("p_name", F.lit("\r\n\t "), "p_brand", F.lit("\n"), "p_type")).alias("unfolded"))


@query("d1_d2_d3_parsed_dates", """SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) - CASE o_orderkey % 6 WHEN 0 THEN 7200 WHEN 2 THEN 19800 WHEN 4 THEN -18000 ELSE 0 END AS secs
FROM orders WHERE o_orderdate IS NOT NULL""")
def _parsed(spark, d):
    k, ts = F.col("o_orderkey") % 6, F.col("o_orderdate")
    at = lambda p: F.date_format(ts, p)
    form = (F.when(k == 0, F.concat(at("EEE, d MMM yyyy HH:mm:ss"), F.lit(" +0200 (CEST)"))).when(k == 1, F.concat(at("yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
            .when(k == 2, F.concat(at("d MMM yyyy HH:mm:ss"), F.lit(" GMT+5:30"))).when(k == 3, at("EEE MMM d HH:mm:ss yyyy"))
            .when(k == 4, F.concat(at("EEE, dd MMM yyyy HH:mm:ss"), F.lit(" EST"))).otherwise(F.concat(at("d MMM yy HH:mm:ss"), F.lit(" GMT"))))
    return read(spark, d, "orders").filter("o_orderdate IS NOT NULL").select("o_orderkey", dates.parse_mail_date(form).alias("secs"))


@query("d4_iso_dates", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, CAST(floor(epoch(ts)) AS BIGINT) AS secs FROM events")
def _iso(spark, d):
    iso = dates.secs_to_iso(F.unix_timestamp("ts"))
    return read(spark, d, "events").select("event_id", iso.alias("iso"), dates.iso_to_secs(iso).alias("secs"))


@query("d5_date_formats", """SELECT o_orderkey, strftime(o_orderdate, '%a %d %b %Y %H:%M:%S +0000') AS euro, strftime(o_orderdate, '%a %b %d %Y %H:%M:%S +0000') AS us,
 strftime(o_orderdate, '%Y-%m-%d %H:%M:%SZ') AS iso, strftime(o_orderdate, '%d.%m.%y') AS own FROM orders""")
def _formats(spark, d):
    ts = F.unix_timestamp("o_orderdate")
    return read(spark, d, "orders").select("o_orderkey", dates.format_date(ts, gmtime=True).alias("euro"), dates.format_date(ts, gmtime=True, eurodate=False).alias("us"),
                                           dates.format_date(ts, gmtime=True, isodate=True).alias("iso"), dates.format_date(ts, "%d.%m.%y", True).alias("own"))


@query("d6_d7_calendar", """SELECT DISTINCT year(o_orderdate) AS y, (year(o_orderdate) % 4 = 0 AND year(o_orderdate) % 100 <> 0) OR year(o_orderdate) % 400 = 0 AS leap,
 CAST(month(o_orderdate) AS INTEGER) AS month, CAST(253402300799 AS BIGINT) AS clamped FROM orders""")
def _leap(spark, d):
    o = read(spark, d, "orders")
    return o.select(F.year("o_orderdate").cast("bigint").alias("y"), dates.is_leap(F.year("o_orderdate")).alias("leap"), dates.month_number(F.date_format("o_orderdate", "MMM")).alias("month"),
                    dates.clamp(F.unix_timestamp("o_orderdate") + F.lit(1 << 50)).alias("clamped")).distinct()


@query("c20_localized_dates", """SELECT o_orderkey, concat(CASE strftime(o_orderdate, '%a') WHEN 'Mon' THEN 'Mo' WHEN 'Tue' THEN 'Di' WHEN 'Wed' THEN 'Mi' WHEN 'Thu' THEN 'Do' WHEN 'Fri' THEN 'Fr' WHEN 'Sat' THEN 'Sa' ELSE 'So' END,
 strftime(o_orderdate, ' %d '), CASE strftime(o_orderdate, '%b') WHEN 'Mar' THEN 'Mär' WHEN 'May' THEN 'Mai' WHEN 'Oct' THEN 'Okt' WHEN 'Dec' THEN 'Dez' ELSE strftime(o_orderdate, '%b') END) AS local FROM orders""")
def _local_dates(spark, d):
    from .sources.locale import words_of

    return read(spark, d, "orders").select("o_orderkey", dates.localize(F.date_format("o_orderdate", "EEE dd MMM"), words_of("de")).alias("local"))


# --- filters -----------------------------------------------------------------------------------

RULES = filters.Rules(delete_msgnum=(3, 5), delete_older=1_600_500_000, delete_newer=1_700_000_000, filter_out=("^subject: .*Topic 7$",), filter_require=("Topic|Request 1",),
                      filter_out_full_body=("zzzz",), filter_require_full_body=("[a-e]",), now=1_650_000_000)


@query("f10_verdicts", f"""WITH {MESSAGES_SQL}, {HEADERS_SQL} SELECT list_id, msgnum,
 CAST((CASE WHEN conv_id % 9 = 0 OR msgnum IN (3, 5) THEN 1 ELSE 0 END) + (CASE WHEN regexp_matches(concat('subject: ', subject), '^subject: .*Topic 7$') OR regexp_matches(body_text, 'zzzz') THEN 4 ELSE 0 END)
 + (CASE WHEN date > 0 AND date < 1600500000 THEN 16 ELSE 0 END) + (CASE WHEN date > 1700000000 THEN 32 ELSE 0 END)
 + (CASE WHEN regexp_matches(subject, 'Topic|Request 1') AND regexp_matches(body_text, '[a-e]') THEN 0 ELSE 8 END) AS INTEGER) AS mask FROM hd""")
def _verdicts(spark, d):
    m = _with_headers(spark, d)
    return m.select("list_id", "msgnum", filters.verdict(RULES, F.col("msgnum"), F.col("headers"), F.col("body_text"), F.col("date")).alias("mask"))


@query("f3_f4_pattern_hits", f"""WITH {MESSAGES_SQL} SELECT list_id, msgnum, CASE WHEN regexp_matches(subject, 'Topic 1') THEN 0 WHEN regexp_matches(name, '^user') OR regexp_matches(concat('"', name), '"user') THEN 1 END AS header_hit,
 list_filter([CASE WHEN regexp_matches(body_text, 'the') THEN 0 END, CASE WHEN regexp_matches(body_text, 'Q[0-9]') THEN 1 END], lambda x: x IS NOT NULL) AS body_hits FROM m""")
def _hits(spark, d):
    m = _with_headers(spark, d)
    return m.select("list_id", "msgnum", filters.first_header_match(F.col("headers"), ["Topic 1", '"user']).alias("header_hit"), filters.body_match_indices(mail.body_lines(F.col("body_text")), ["the", "Q[0-9]"]).alias("body_hits"))


@query("f5_f6_marks", f"WITH {MESSAGES_SQL} SELECT list_id, msgnum, conv_id % 9 = 0 AS deleted, date > 0 AND date < 1650000000 AS expired FROM m")
def _marks(spark, d):
    m = _with_headers(spark, d)
    h = F.concat("headers", F.array(F.struct(F.lit("expires").alias("name"), F.when(F.col("date") > 0, dates.secs_to_iso(F.col("date"))).otherwise("never").alias("value"))))
    return m.select("list_id", "msgnum", filters.marked_deleted(F.col("headers"), ("X-No-Archive",)).alias("deleted"), filters.expired(h, ("Expires",), 1_650_000_000).alias("expired"))


@query("f7_age_mask", f"WITH {MESSAGES_SQL} SELECT list_id, msgnum, CASE WHEN date > 0 AND date < 1610000000 THEN 16 ELSE 0 END + CASE WHEN date > 1700000000 THEN 32 ELSE 0 END AS mask FROM m")
def _age(spark, d):
    return messages(spark, d).select("list_id", "msgnum", filters.age_mask(F.col("date"), 1_610_000_000, 1_700_000_000).alias("mask"))


@query("f13_article_states", f"""WITH {MESSAGES_SQL} SELECT list_id, msgnum, CASE WHEN conv_id % 9 = 0 THEN 'none' ELSE 'full' END AS level0, CASE WHEN conv_id % 9 = 0 THEN 'stub' ELSE 'full' END AS level1, CASE WHEN conv_id % 9 = 0 THEN 'stub' ELSE 'full' END AS level2, 'full' AS level3 FROM m""")
def _states(spark, d):
    gone = F.when(F.col("conv_id") % 9 == 0, 1).otherwise(0)
    return messages(spark, d).select("list_id", "msgnum", *[filters.article_state(gone, n).alias(f"level{n}") for n in (0, 1, 2, 3)])


@query("f14_a11_attachments", f"""WITH {MESSAGES_SQL} SELECT list_id, msgnum, conv_id % 4 = 0 AS has_attachment FROM m""")
def _attachments(spark, d):
    m = messages(spark, d).withColumn("body_text", F.concat("body_text", F.when(F.col("conv_id") % 4 == 0, "\n[Attachment: a.pdf]").otherwise("")))
    return indexes.attachment_flags(m, lines.explode_lines(m)).select("list_id", "msgnum", "has_attachment")


@query("k5_attachment_index", f"WITH {MESSAGES_SQL} SELECT list_id, msgnum, row_number() OVER (PARTITION BY list_id ORDER BY date, msgnum) - 1 AS ord FROM m WHERE conv_id % 4 = 0")
def _attachment_index(spark, d):
    m = messages(spark, d).withColumn("body_text", F.concat("body_text", F.when(F.col("conv_id") % 4 == 0, "\n[Attachment: a.pdf]").otherwise("")))
    return indexes.attachment_index(m, lines.explode_lines(m)).select("list_id", "msgnum", "ord")


@query("f15_f16_f17_gates", f"""WITH {MESSAGES_SQL} SELECT list_id, msgnum FROM m WHERE msgnum > 10 AND date > 0 AND msgnum % 5 <> 0""")
def _gates(spark, d):
    m = indexes.with_folder(messages(spark, d), folder_by_date="%Y").withColumn("path", F.concat_ws("/", "list_id", F.col("msgnum").cast("string")))
    there = m.filter("msgnum % 5 = 0").select("path")
    return filters.not_written(filters.in_folders(filters.after_high_water(m, 10)), there).select("list_id", "msgnum")


@query("u_set_operations", f"""WITH {MESSAGES_SQL}, e AS (SELECT list_id, max(msgnum) + 1 AS n FROM m GROUP BY 1)
SELECT list_id, msgnum, pos, msgid FROM m UNION ALL SELECT m.list_id, CAST(m.msgnum + e.n AS INTEGER), m.pos + e.n, concat('again-', m.msgid) FROM m JOIN e USING (list_id)""")
def _appended(spark, d):
    """A state and as many new messages, which go on where each list ended."""
    from .plans.archive import STATE_COLUMNS, appended, continued, ends_of
    from .plans.messages import parse_messages

    state = parse_messages(raw_messages(spark, d)).select(*STATE_COLUMNS)
    again = F.regexp_replace(F.decode("headers", "UTF-8"), "\nMessage-ID: ", "\nMessage-ID: again-").cast("binary")
    new = continued(parse_messages(raw_messages(spark, d).withColumn("headers", again)), ends_of(state))
    return appended(state, new).select("list_id", "msgnum", "pos", "msgid")


# --- search ------------------------------------------------------------------------------------

GRAMS_SQL = r"""t AS (SELECT doc_id, regexp_replace(lower(text), '[^\p{L}\p{N}\s]', '', 'g') AS t FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, length(t)), lambda i: substring(t, i, 2))) AS bigram FROM t WHERE length(t) >= 2)"""


def _postings(spark, d):
    return search.postings(read(spark, d, "documents").select("doc_id", "text"), "doc_id", F.col("text"))


@query("a8_bigram_postings", f"WITH {GRAMS_SQL} SELECT bigram, doc_id FROM g")
def _bigrams(spark, d):
    return _postings(spark, d)


@query("a8_bigram_frequencies", f"WITH {GRAMS_SQL} SELECT bigram, count(*) AS n_docs FROM g GROUP BY bigram")
def _frequencies(spark, d):
    return _postings(spark, d).groupBy("bigram").agg(F.count(F.lit(1)).alias("n_docs"))


@query("a9_search", f"""WITH {GRAMS_SQL} SELECT doc_id, CAST(count(*) AS INTEGER) AS score FROM g WHERE bigram IN ('an', 'nd', 'd ', ' t', 'th', 'he', 'e ', ' z') GROUP BY doc_id HAVING count(*) >= 7""")
def _search(spark, d):
    return search.search_texts(read(spark, d, "documents"), "doc_id", F.col("text"), "and the z")


@query("a9_search_many", rf"""WITH {GRAMS_SQL}, q0 AS (SELECT item_id, regexp_replace(lower(text), '[^\p{{L}}\p{{N}}\s]', '', 'g') AS t FROM benchmark),
q AS (SELECT DISTINCT item_id AS query_id, unnest(list_transform(range(1, length(t)), lambda i: substring(t, i, 2))) AS bigram FROM q0 WHERE length(t) >= 2),
n AS (SELECT query_id, count(*) AS n FROM q GROUP BY 1)
SELECT q.query_id, g.doc_id, CAST(count(*) AS INTEGER) AS score FROM q JOIN g USING (bigram) JOIN n USING (query_id) GROUP BY q.query_id, g.doc_id, n.n HAVING count(*) >= n.n - 1""")
def _search_many(spark, d):
    wanted = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return search.search_many(read(spark, d, "documents"), "doc_id", F.col("text"), wanted)


@query("k10_search_lines", rf"""WITH {MESSAGES_SQL} SELECT concat(msgnum, '|', regexp_replace(regexp_replace(concat_ws(' ', subject, name, email_addr, body_text), '[^\p{{L}}\p{{N}}\s.@-]', '', 'g'), '\s', ' ', 'g')) AS value FROM m""")
def _search_lines(spark, d):
    return search.search_lines(messages(spark, d))


# --- sources, MIME, sinks ----------------------------------------------------------------------


def raw_messages(spark: SparkSession, d: str) -> DataFrame:
    """Messages as raw bytes: encoded subjects, base64 and quoted-printable bodies by turn."""
    m = messages(spark, d)
    b64, qp = F.base64(F.col("body_text").cast("binary")), F.regexp_replace(F.regexp_replace("body_text", "=", "=3D"), "_", "=5F")
    k = F.col("turn") % 3
    kind = F.when(k == 0, "base64").when(k == 1, "quoted-printable").otherwise("8bit")
    head = F.concat(F.lit("From: "), "name", F.lit(" <"), "email_addr", F.lit(">\nSubject: "), "subject", F.lit("\nMessage-ID: "), "msgid",
                    F.when(F.col("inreplyto").isNotNull(), F.concat(F.lit("\nIn-Reply-To: "), F.trim("inreplyto"))).otherwise(""),
                    F.when(F.col("date") > 0, F.concat(F.lit("\nDate: "), dates.format_date(F.col("date"), "%a, %d %b %Y %H:%M:%S %z", True))).otherwise(""),
                    F.lit("\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: "), kind, F.lit("\n"))
    body = F.when(k == 0, b64).when(k == 1, qp).otherwise(F.col("body_text"))
    return m.select("list_id", "pos", F.lit("From sender@example.org Thu Jan  1 00:00:00 1970").alias("from_line"), head.cast("binary").alias("headers"), body.cast("binary").alias("body"))


@query("p10_parsed_messages", f"""WITH {MESSAGES_SQL} SELECT list_id, msgnum, name, email_addr, subject, unre_subject, msgid, trim(inreplyto) AS inreplyto, date, 'utf-8' AS charset, body_text FROM m""")
def _parsed_messages(spark, d):
    from .plans.messages import parse_messages

    return parse_messages(raw_messages(spark, d)).select("list_id", "msgnum", "name", "email_addr", "subject", "unre_subject", "msgid", "inreplyto", "date", "charset", "body_text")


def _scanned(spark: SparkSession, d: str, form: str, start: str = "") -> DataFrame:
    """Writes each list as a mailbox to the shared folder and scans it; start goes before each body."""
    from uuid import uuid4

    from .sources.mbox import read_mailboxes

    at = f"{ranking.shared_dir(spark)}/postweave/mail_{uuid4().hex[:12]}"
    m = messages(spark, d)
    body = F.regexp_replace(F.concat(F.lit(start), "body_text"), "(?m)^(>*From )" if form == "mboxrd" else "(?m)^(From )", ">$1")
    whole = F.concat(F.lit("From a@b Thu Jan  1 00:00:00 1970\nMessage-ID: "), "msgid", F.lit("\nSubject: "), "subject", F.lit("\n\n"), body)
    # a list's messages are ranges of positions, in the order of their files' names
    parts = m.select(whole.alias("value"), "list_id", "pos").repartitionByRange("list_id", "pos").sortWithinPartitions("list_id", "pos")
    parts.select("value", "list_id").write.partitionBy("list_id").text(at)
    raw = read_mailboxes(spark, f"{at}/*", form)
    head = mail.parse_headers(F.decode("headers", "ISO-8859-1"))
    got = raw.select(mail.find_header(head, "message-id").alias("msgid"), mail.find_header(head, "subject").alias("subject"), F.decode("body", "UTF-8").alias("body"))
    return got.join(m.select("msgid", "list_id", "pos"), "msgid")


@query("s1_mailbox_scan", f"""WITH {MESSAGES_SQL} SELECT list_id, pos, msgid, subject, CAST(length(regexp_replace(replace(body_text, chr(13) || chr(10), chr(10)), '(^|\\n)From ', '\\1>From ', 'g')) + 1 AS INTEGER) AS n_chars FROM m""")
def _mailbox_scan(spark, d):
    return _scanned(spark, d, "mboxo").select("list_id", "pos", "msgid", "subject", F.length("body").alias("n_chars"))


@query("s3_mboxrd_scan", f"""WITH {MESSAGES_SQL} SELECT list_id, pos, msgid, concat('From me', chr(10), '>From you', chr(10), replace(body_text, chr(13) || chr(10), chr(10)), chr(10)) AS body FROM m""")
def _mboxrd_scan(spark, d):
    """Quoted envelope marks in bodies, at two levels, come back as they were."""
    return _scanned(spark, d, "mboxrd", "From me\n>From you\n").select("list_id", "pos", "msgid", "body")


@query("m5_uuencoded", "SELECT doc_id, text AS decoded FROM documents")
def _uuencoded(spark, d):
    """Encoded by Python's own codec, 45 bytes a line; a last group keeps its padding, as zeros, which alone are cut."""
    import binascii

    from .functions.register import decode_uuencode

    def one(x: str) -> bytes:
        data = x.encode()
        return b"begin 644 a\n" + b"".join(binascii.b2a_uu(data[i: i + 45], backtick=True) for i in range(0, len(data), 45)) + b"`\nend\n"

    @F.pandas_udf("binary")
    def encoded(values: pd.Series) -> pd.Series:
        return values.map(one, na_action="ignore")

    data = read(spark, d, "documents").select("doc_id", F.pmod(-F.octet_length("text"), F.lit(3)).alias("padding"), decode_uuencode(encoded("text")).alias("data"))
    return data.select("doc_id", F.decode(F.substring("data", F.lit(1), F.octet_length("data") - F.col("padding")), "UTF-8").alias("decoded"))


@query("m11_file_names", "SELECT p_partkey, concat('[Attachment: ', p_name, ' é.pdf]') AS shown FROM part")
def _file_names(spark, d):
    """A name in continued, percent-encoded parts."""
    from .functions.register import parse_rfc822

    body = F.concat(F.lit("--X\nContent-Type: application/pdf\nContent-Disposition: attachment; filename*0*=utf-8''"), F.regexp_replace("p_name", " ", "%20"),
                    F.lit("; filename*1*=%20%C3%A9; filename*2=\".pdf\"\n\nzz\n--X--\n")).cast("binary")
    head = F.lit("Content-Type: multipart/mixed; boundary=X\n").cast("binary")
    return read(spark, d, "part").select("p_partkey", F.trim(F.regexp_replace(parse_rfc822(head, body)["body_text"], "\n", "")).alias("shown"))


@query("p9_raw_headers", "SELECT p_partkey, concat(p_name, ' é') AS subject FROM part")
def _raw_headers(spark, d):
    """A subject in raw Latin-1 bytes, by the body's charset."""
    from .functions.register import parse_rfc822

    head = F.concat(F.lit("X: y\nSubject: ").cast("binary"), F.encode(F.concat("p_name", F.lit(" é")), "ISO-8859-1"), F.lit("\nContent-Type: text/plain; charset=iso-8859-1\n").cast("binary"))
    return read(spark, d, "part").select("p_partkey", F.trim(parse_rfc822(head, F.lit("x").cast("binary"))["subject_raw"]).alias("subject"))


@query("p6_decoded_words", "SELECT p_partkey, p_name AS plain, concat(p_name, p_brand) AS joined FROM part")
def _words(spark, d):
    from .functions.register import decode_mime_words

    word = lambda c, tail="": F.concat(F.lit("=?utf-8?B?"), F.base64(F.col(c).cast("binary")), F.lit("?=" + tail))
    return read(spark, d, "part").select("p_partkey", decode_mime_words(word("p_name")).alias("plain"), decode_mime_words(F.concat(word("p_name", " "), word("p_brand"))).alias("joined"))


@query("m1_content_types", "SELECT page_id, 'text' AS type, 'html' AS subtype, 'utf-8' AS charset, concat('b', page_id) AS boundary FROM pages")
def _content_types(spark, d):
    kind = mail.content_type(F.concat(F.lit('Text/HTML; Charset=latin1; charset="utf-8"; boundary=\'b'), F.col("page_id").cast("string"), F.lit("'")))
    return read(spark, d, "pages").select("page_id", kind["type"].alias("type"), kind["subtype"].alias("subtype"), kind["params"]["charset"].alias("charset"), kind["params"]["boundary"].alias("boundary"))


@query("m3_base64", "SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN text END AS decoded FROM documents")
def _base64(spark, d):
    """Folded lines are decoded; what isn't well-formed is null."""
    from .functions.register import decode_base64

    folded = F.regexp_replace(F.base64(F.col("text").cast("binary")), "(.{60})", "$1\n")
    sent = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("*"), folded)).otherwise(folded)
    return read(spark, d, "documents").select("doc_id", F.decode(decode_base64(sent.cast("binary")), "UTF-8").alias("decoded"))


@query("m4_quoted_printable", "SELECT doc_id, text AS decoded FROM documents")
def _quoted_printable(spark, d):
    """Soft breaks within, and = and _ and all that isn't ASCII as =XX."""
    from .functions.register import decode_quoted_printable

    raw = F.col("text")
    for c in ("=", "_"):
        raw = F.regexp_replace(raw, c, f"={ord(c):02X}")
    soft = F.regexp_replace(raw, "( [a-z]{3})", "$1=\n")
    return read(spark, d, "documents").select("doc_id", F.decode(decode_quoted_printable(soft.cast("binary")), "UTF-8").alias("decoded"))


@query("m7_charsets", "SELECT p_partkey, p_name AS latin, concat(p_name, ' é') AS western FROM part")
def _charsets(spark, d):
    """Bodies in declared charsets, an unknown one among them."""
    from .functions.register import parse_rfc822

    head = lambda c: F.concat(F.lit("Subject: x\nContent-Type: text/plain; charset="), F.lit(c), F.lit("\n")).cast("binary")
    western = F.encode(F.concat("p_name", F.lit(" é")), "ISO-8859-1")
    text = lambda h, b: F.regexp_replace(parse_rfc822(h, b)["body_text"], "\n$", "")
    return read(spark, d, "part").select("p_partkey", text(head("x-unknown"), F.col("p_name").cast("binary")).alias("latin"), text(head("iso-8859-1"), western).alias("western"))


@query("p8_quoted_words", "SELECT p_partkey, concat(p_name, ' é') AS word FROM part")
def _quoted_words(spark, d):
    """Q-encoded words in Latin-1, spaces as _."""
    from .functions.register import decode_mime_words

    word = F.concat(F.lit("=?iso-8859-1?Q?"), F.regexp_replace("p_name", " ", "_"), F.lit("_=E9?="))
    return read(spark, d, "part").select("p_partkey", decode_mime_words(word).alias("word"))


@query("p11_received_dates", """SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) AS secs FROM orders WHERE o_orderdate IS NOT NULL""")
def _received(spark, d):
    """The date after the last semicolon of a Received header."""
    head = F.concat(F.lit("Received: no date here\nReceived: from a.example by b.example; more;\n "), F.date_format("o_orderdate", "EEE, d MMM yyyy HH:mm:ss"), F.lit(" +0000\n"))
    return read(spark, d, "orders").filter("o_orderdate IS NOT NULL").select("o_orderkey", mail.message_date(mail.parse_headers(head)).alias("secs"))


@query("c2_c15_c23_subjects", f"""WITH {MESSAGES_SQL} SELECT list_id, msgnum, trim(regexp_replace(subject, '^\\s*(re|fwd?|aw|ang|sv|vs|odp|antw)\\s*[\\[:\\]>#]*\\s*', '', 'i')) AS once, true AS same FROM m""")
def _once(spark, d):
    c = F.col("subject")
    return messages(spark, d).select("list_id", "msgnum", text.oneunre(c).alias("once"), text.matches_existing(c, F.concat(F.lit(" \t"), c, F.lit("\n"))).alias("same"))


@query("m2_dispositions", "SELECT page_id, concat('a ', page_id, '.pdf') AS filename, page_id % 2 = 0 AS attached FROM pages")
def _dispositions(spark, d):
    kind = F.when(F.col("page_id") % 2 == 0, "Attachment").otherwise("inline")
    found = mail.content_disposition(F.concat(kind, F.lit('; size=9; filename="a '), F.col("page_id").cast("string"), F.lit('.pdf"')))
    return read(spark, d, "pages").select("page_id", found["params"]["filename"].alias("filename"), (found["disposition"] == "attachment").alias("attached"))


@query("m10_multipart_bodies", "SELECT doc_id, concat(text, chr(10), '[Attachment: x.pdf]', chr(10)) AS body FROM documents")
def _multipart(spark, d):
    """A missing text is sent as an empty part, which is a part all the same."""
    from .functions.register import parse_rfc822

    head = F.lit("Content-Type: multipart/mixed; boundary=XX\n").cast("binary")
    body = F.concat(F.lit("--XX\nContent-Type: multipart/alternative;\n boundary=YY\n\n--YY\nContent-Type: text/html\n\n<b>no</b>\n--YY\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: base64\n\n"),
                    F.base64(F.coalesce("text", F.lit("")).cast("binary")), F.lit("\n--YY--\n--XX\nContent-Type: application/pdf; name=x.pdf\n\nzz\n--XX--\n")).cast("binary")
    return read(spark, d, "documents").select("doc_id", parse_rfc822(head, body)["body_text"].alias("body"))


@query("s8_s9_page_metadata", """SELECT page_id, CAST(page_id AS INTEGER) AS msgnum, concat('id', page_id) AS meta_id, url AS meta_subject, CAST(1700000000 + page_id AS BIGINT) AS date FROM pages WHERE page_id % 3 <> 0""")
def _page_metadata(spark, d):
    from .sources.archive import page_metadata

    n = F.col("page_id").cast("string")
    head = F.concat(F.lit('<article id="msg'), n, F.lit('"><!-- subject="'), "url", F.lit('" --><!-- sent="'), dates.secs_to_iso(F.lit(1_700_000_000).cast("bigint") + F.col("page_id")), F.lit('" -->'))
    head = F.when(F.col("page_id") % 3 == 0, head).otherwise(F.concat(head, F.lit('<!-- id="id'), n, F.lit('" -->')))
    pages = read(spark, d, "pages").select("page_id", F.concat(head, "html").alias("html"))
    return page_metadata(pages).select("page_id", "msgnum", "meta_id", "meta_subject", "date")


# the cells of index rows, in SQL
CELLS_SQL = """c AS (SELECT *, concat(lpad(CAST(msgnum AS VARCHAR), greatest(4, length(CAST(msgnum AS VARCHAR)))::INTEGER, '0'), '.html') AS file,
  concat(name, ' &lt;<a href="mailto:', email_addr, '">', replace(email_addr, '@', '_at_'), '</a>&gt;') AS author,
  CASE WHEN date > 0 THEN strftime(to_timestamp(date), '%a %d %b %Y %H:%M:%S +0000') ELSE '(no date)' END AS day FROM m),
h AS (SELECT *, concat('<li><a href="', file, '">', subject, '</a> ', author, ' ', day, '</li>') AS row_html, CAST(msgnum // 20 AS VARCHAR) AS folder FROM c)"""
NAV_SQL = {k: "<nav>" + " ".join(f"<b>{w}</b>" if k == x else f'<a href="{"index" if x == first else x}.html">{w}</a>' for x, w in kinds) + "</nav>"
           for first, kinds in (("thread", (("date", "Date"), ("thread", "Thread"), ("subject", "Subject"), ("author", "Author"), ("attachment", "Attachment"))),) for k in ("date", "subject", "author", "thread", "month", "Folders")}
FOLDER_NAV_SQL = {k: "<nav>" + " ".join(f"<b>{w}</b>" if k == x else f'<a href="{"index" if x == "date" else x}.html">{w}</a>' for x, w in (("date", "Date"), ("thread", "Thread"), ("subject", "Subject"), ("author", "Author"))) + "</nav>"
                  for k in ("date", "subject", "author", "thread")}
HEAD_SQL = "concat('<!doctype html>\n<html lang=\"en\">\n<head>\n<meta charset=\"utf-8\">\n<title>', {title}, '</title>\n', {meta}, '</head>\n<body>\n', {nav}, '\n<main>\n')"
FOOT_SQL = "'\n</main>\n<footer>Generated by postweave 0.1.0</footer>\n</body>\n</html>\n'"
DAY_SQL = "CASE WHEN {0} > 0 THEN strftime(to_timestamp({0}), '%a %d %b %Y %H:%M:%S +0000') ELSE '-' END"


def _pages_sql(rows: str, key: str, file: str, title: str, nav: str, size: int) -> str:
    """rows: a CTE's body with list_id, key columns, ord, row_html and date."""
    return f"""WITH {MESSAGES_SQL}, {CELLS_SQL}, o AS ({rows}), s AS (SELECT {key}, min(date) AS lo, max(date) AS hi, count(*) AS n FROM o GROUP BY {key}),
p AS (SELECT {key}, ord // {size} AS part, string_agg(row_html, chr(10) ORDER BY ord) AS body FROM o GROUP BY ALL)
SELECT concat(list_id, '/', {file}, CASE WHEN part = 0 THEN '' ELSE concat('-', part) END, '.html') AS path,
 concat({HEAD_SQL.format(title=title, meta="''", nav=f"'{nav}'")}, '<p>', n, ' Messages: ', {DAY_SQL.format('lo')}, ' / ', {DAY_SQL.format('hi')}, '</p>\n<ul>\n', body, '\n</ul>', {FOOT_SQL}) AS html
FROM p JOIN s USING ({key})"""


def _config(**own):
    from .config import Config

    return Config(gmtime=True, **own)


@query("k3_index_rows", f"WITH {MESSAGES_SQL}, {CELLS_SQL} SELECT list_id, row_number() OVER (PARTITION BY list_id ORDER BY date, msgnum) - 1 AS ord, msgnum, row_html AS html FROM h")
def _index_rows(spark, d):
    from .plans.render import index_rows

    return index_rows(indexes.date_index(messages(spark, d)), _config())


@query("k8_index_pages", _pages_sql(
    "SELECT *, row_number() OVER (PARTITION BY list_id ORDER BY lower(unre_subject), msgnum) - 1 AS ord FROM h", "list_id", "'subject'", "'Subject'", NAV_SQL["subject"], 50))
def _index_pages(spark, d):
    from .plans.render import index_rows
    from .plans.site import pages_of

    m = messages(spark, d)
    return pages_of(index_rows(indexes.subject_index(m), _config()), "subject", indexes.archive_stats(m), _config(), 50)


@query("k7_monthly_pages", _pages_sql(
    "SELECT *, strftime(to_timestamp(date), '%Y-%m') AS month, row_number() OVER (PARTITION BY list_id, strftime(to_timestamp(date), '%Y-%m') ORDER BY date, msgnum) - 1 AS ord FROM h",
    "list_id, month", "month", "month", NAV_SQL["month"], 20))
def _monthly_pages(spark, d):
    from .plans.site import calendar_pages

    return calendar_pages(messages(spark, d), "month", _config(), 20)


@query("k7_yearly_pages", _pages_sql(
    "SELECT *, strftime(to_timestamp(date), 'year-%Y') AS year, row_number() OVER (PARTITION BY list_id, strftime(to_timestamp(date), '%Y') ORDER BY date, msgnum) - 1 AS ord FROM h",
    "list_id, year", "year", "year", NAV_SQL["month"], 1000))
def _yearly_pages(spark, d):
    from .plans.site import calendar_pages

    return calendar_pages(messages(spark, d), "year", _config())


@query("k6_folder_pages", " UNION ALL ".join(f"SELECT * FROM ({x})" for x in [
    _pages_sql(f"SELECT * EXCLUDE (list_id), concat(list_id, '/', folder) AS list_id, row_number() OVER (PARTITION BY list_id, folder ORDER BY {order}, msgnum) - 1 AS ord FROM h",
               "list_id", f"'{'index' if kind == 'date' else kind}'", f"'{word}'", FOLDER_NAV_SQL[kind], 1000)
    for kind, word, order in (("date", "Date", "date"), ("subject", "Subject", "lower(unre_subject)"), ("author", "Author", "lower(name)"))]))
def _folder_pages(spark, d):
    """Of each folder the date, subject and author index; the thread index is k4's, on a list."""
    from .plans.site import folder_pages

    m = indexes.with_folder(messages(spark, d), 20)
    return folder_pages(m, threads.reply_edges(m), _config()).filter("path NOT LIKE '%/thread%'")


@query("k6_folders_page", f"""WITH {MESSAGES_SQL}, f AS (SELECT list_id, CAST(msgnum // 20 AS VARCHAR) AS folder, count(*) AS n, min(date) AS lo, max(date) AS hi FROM m GROUP BY 1, 2),
l AS (SELECT list_id, string_agg(concat('<li><a href="', folder, '/index.html">', folder, '</a> (', n, ' Messages: ', {DAY_SQL.format('lo')}, ' / ', {DAY_SQL.format('hi')}, ')</li>'), chr(10) ORDER BY folder) AS body,
 sum(n) AS n, min(lo) AS lo, max(hi) AS hi FROM f GROUP BY 1)
SELECT concat(list_id, '/folders.html') AS path, concat({HEAD_SQL.format(title="'folders'", meta="''", nav="'" + NAV_SQL['Folders'] + "'")}, '<p>', n, ' Messages: ', {DAY_SQL.format('lo')}, ' / ', {DAY_SQL.format('hi')}, '</p>\n<ul>\n', body, '\n</ul>', {FOOT_SQL}) AS html FROM l""")
def _folders_page(spark, d):
    from .plans.site import folders_pages

    m = messages(spark, d)
    return folders_pages(indexes.folder_stats(indexes.with_folder(m, 20)), indexes.archive_stats(m), _config(msgsperfolder=20))


@query("k4_thread_pages", ORACLE_SQL["t1_thread_walk"].replace("SELECT list_id, root, msgnum, depth, CAST(", f""", wk AS (SELECT list_id, root, msgnum, depth, row_number() OVER (PARTITION BY list_id, root ORDER BY path) - 1 AS n FROM walk),
{CELLS_SQL}, o AS (SELECT h.list_id, h.date, row_number() OVER (PARTITION BY wk.list_id ORDER BY r.date, wk.root, wk.n) - 1 AS ord,
 concat('<li class="depth-', wk.depth, '"><a href="', h.file, '">', h.subject, '</a> ', h.author, '</li>') AS row_html
 FROM wk JOIN h ON h.list_id = wk.list_id AND h.msgnum = wk.msgnum JOIN m r ON r.list_id = wk.list_id AND r.msgnum = wk.root WHERE wk.depth <= 50),
s AS (SELECT list_id, min(date) AS lo, max(date) AS hi, count(*) AS n FROM m GROUP BY 1), p AS (SELECT list_id, ord // 40 AS part, string_agg(row_html, chr(10) ORDER BY ord) AS body FROM o GROUP BY ALL)
SELECT concat(list_id, '/index', CASE WHEN part = 0 THEN '' ELSE concat('-', part) END, '.html') AS path,
 concat({HEAD_SQL.format(title="'Thread'", meta="''", nav="'" + NAV_SQL['thread'] + "'")}, '<p>', n, ' Messages: ', {DAY_SQL.format('lo')}, ' / ', {DAY_SQL.format('hi')}, '</p>\n<ul>\n', body, '\n</ul>', {FOOT_SQL}) AS html
FROM p JOIN s USING (list_id) -- """))
def _thread_pages(spark, d):
    from .plans.site import pages_of, thread_rows

    m = messages(spark, d)
    walk = threads.thread_walk(spark, m, threads.reply_edges(m))
    return pages_of(thread_rows(walk, m, _config()), "thread", indexes.archive_stats(m), _config(), 40)


@query("k1_articles", f"""WITH {MESSAGES_SQL}, {EDGES_SQL}, {CELLS_SQL},
l AS (SELECT list_id, msgnum, string_agg({HTML_SQL.format('line', '&#39;')}, chr(10) ORDER BY n) AS body FROM
 (SELECT list_id, msgnum, unnest(string_split(regexp_replace(body_text, '\\n$', ''), chr(10))) AS line, generate_subscripts(string_split(regexp_replace(body_text, '\\n$', ''), chr(10)), 1) AS n FROM m WHERE body_text <> '') GROUP BY 1, 2),
a AS (SELECT e.list_id, e.parent_msgnum AS msgnum, string_agg(concat('<li><a href="', c.file, '">', c.subject, '</a></li>'), chr(10) ORDER BY e.seq) AS replies FROM edges e JOIN c ON c.list_id = e.list_id AND c.msgnum = e.child_msgnum GROUP BY 1, 2)
SELECT list_id, msgnum, concat(list_id, '/', file) AS path, concat({HEAD_SQL.format(title="CASE WHEN conv_id % 9 = 0 THEN '(deleted message)' ELSE subject END",
    meta="concat('<meta name=\"Author\" content=\"', name, ' (', email_addr, ')\" />', CASE WHEN date > 0 THEN concat('<meta name=\"Date\" content=\"', day, '\" />') ELSE '' END)", nav="'<nav><a href=\"index.html\">index</a></nav>'")},
 CASE WHEN conv_id % 9 = 0 THEN '<article><h1>(deleted message)</h1></article>' ELSE concat('<article id="msg', msgnum, '">\n<h1>', subject, '</h1>\n<p>', author, ' ', day, '</p>\n',
 CASE WHEN body IS NULL THEN '' ELSE concat('<div class="hm-pg">', body, '</div>') END, CASE WHEN replies IS NULL THEN '' ELSE concat('\n<ul class="replies">\n', replies, '\n</ul>') END, '\n</article>') END, {FOOT_SQL}) AS html
FROM c LEFT JOIN l USING (list_id, msgnum) LEFT JOIN a USING (list_id, msgnum)""")
def _articles(spark, d):
    from .plans.render import articles

    m = messages(spark, d).withColumn("is_deleted", F.when(F.col("conv_id") % 9 == 0, 1).otherwise(0))
    return articles(m, lines.explode_lines(m), threads.reply_edges(m), _config(delete_level=1))


@query("g9_warnings", f"""WITH {MESSAGES_SQL}, {REPEATED_SQL} SELECT list_id, count(*) FILTER (WHERE date <= 0) AS undated, count(*) FILTER (WHERE coalesce(msgid, '') = '') AS without_id,
 count(*) FILTER (WHERE coalesce(name, '') = '') AS without_author, count(*) FILTER (WHERE coalesce(subject, '') = '') AS without_subject FROM r GROUP BY list_id""")
def _warnings(spark, d):
    from .plans.site import warnings

    return warnings(_repeated(spark, d))


@query("k9_overview", f"""WITH {MESSAGES_SQL} SELECT list_id, pos, concat('<mail><file>', msgnum, '</file><date>', date, '</date><fromname>', name, '</fromname><fromemail>', email_addr, '</fromemail><subject>', subject,
 '</subject><msgid>', replace(replace(msgid, '<', '&lt;'), '>', '&gt;'), '</msgid></mail>') AS xml FROM m""")
def _overview(spark, d):
    from .plans.render import overview_xml

    return overview_xml(messages(spark, d))


@query("k12_message_index", f"""WITH {MESSAGES_SQL} SELECT list_id, -1 AS at, concat('0000 ', max(msgnum)) AS value FROM m GROUP BY list_id UNION ALL
 SELECT list_id, msgnum, concat(lpad(CAST(msgnum AS VARCHAR), greatest(4, length(CAST(msgnum AS VARCHAR)))::INTEGER, '0'), ' ', msgid) FROM m""")
def _message_index(spark, d):
    from .plans.sinks import message_index_lines

    return message_index_lines(messages(spark, d), F.col("msgid"))


@query("k6_folder_indexes", f"""WITH {MESSAGES_SQL}, f AS (SELECT *, concat(list_id, '/', CAST(msgnum // 20 AS VARCHAR)) AS own FROM m)
SELECT own AS list_id, msgnum, row_number() OVER (PARTITION BY own ORDER BY date, msgnum) - 1 AS ord FROM f""")
def _folder_indexes(spark, d):
    from .plans.archive import folder_archive

    m = indexes.with_folder(messages(spark, d), 20)
    return folder_archive(m, threads.reply_edges(m))["date_index"].select("list_id", "msgnum", "ord")


@query("i3_incremental_edges", f"WITH {MESSAGES_SQL}, {EDGES_SQL} SELECT * FROM edges WHERE child_msgnum > 20")
def _incremental(spark, d):
    """What an update adds to the edges of each list's first messages: joins of what is new, old messages by their ids."""
    from .plans.messages import parse_messages

    m = ranking.written(parse_messages(raw_messages(spark, d)))
    return threads.edge_delta(m.filter("pos <= 20"), m.filter("pos > 20"))[1]


@query("stream_monthly_counts", f"""WITH {MESSAGES_SQL} SELECT list_id, date // 2592000 * 2592000 AS window_start, count(*) AS n_messages FROM m GROUP BY ALL""")
def _stream_counts(spark, d):
    """The windowed counts over a stream of the conversations, run to its end into a table."""
    from uuid import uuid4

    from .streaming.ingest import monthly_counts_stream

    c, at = read(spark, d, "conversations"), f"{ranking.shared_dir(spark)}/postweave/stream_{uuid4().hex[:12]}"
    stream = spark.readStream.schema(c.schema).parquet(f"{d}/conversations.parquet*")
    conv, turn = F.col("conv_id"), F.col("turn")
    date = F.when((conv + turn) % 41 == 0, 0).otherwise(F.lit(1_600_000_000).cast("bigint") + conv % 900 * 200_000 + turn * 3600)
    rows = stream.select(F.concat(F.lit("list-"), (conv % 5).cast("string")).alias("list_id"), F.timestamp_seconds(date).alias("sent"))
    counts = monthly_counts_stream(rows).select("list_id", F.unix_timestamp("window.start").alias("window_start"), "n_messages")
    run = counts.writeStream.outputMode("complete").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).foreachBatch(
        lambda batch, _: batch.write.mode("overwrite").parquet(f"{at}/counts")).start()
    run.awaitTermination()
    return spark.read.parquet(f"{at}/counts")


from . import stored_queries  # noqa: E402,F401  (registers its queries here)
