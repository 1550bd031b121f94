"""Registered queries over what is stored and updated, over SQL functions, and over files written and read back."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import EDGES_SQL, GRAMS_SQL, LINES_SQL, MESSAGES_SQL, ORACLE_SQL, doc_lines, messages, query, raw_messages, read
from .functions import quotes, register, text
from .operators import ranking, search, threads


def folder(spark: SparkSession, name: str) -> str:
    return f"{ranking.shared_dir(spark)}/postweave/{name}_{uuid4().hex[:12]}"


def _stored(spark: SparkSession, d: str):
    """An archive of each list's first 20 messages, to which two updates add the others: of two lists, then of the rest."""
    from .plans.stored import StoredArchive

    raw, store = ranking.written(raw_messages(spark, d)), StoredArchive(spark, folder(spark, "archive"))
    store.build(raw.filter("pos < 20"))
    late = raw.filter("pos >= 20").withColumn("pos", F.col("pos") - 20)
    two = F.col("list_id").isin("list-1", "list-3")
    store.update(late.filter(two))
    store.update(late.filter(~two))
    return store


@query("i3_stored_edges", f"WITH {MESSAGES_SQL}, {EDGES_SQL} SELECT * FROM edges")
def _stored_edges(spark, d):
    return _stored(spark, d).read("reply_edges")


@query("i3_stored_threads", ORACLE_SQL["t1_thread_walk"])
def _stored_threads(spark, d):
    return _stored(spark, d).read("thread_index").select("list_id", "root", "msgnum", "depth", "ord", "shown")


def _search_index(spark: SparkSession, d: str) -> search.SearchIndex:
    """Two additions and a merge of the first, so that a search meets blocks of both kinds."""
    docs = read(spark, d, "documents").select(F.lit("").alias("scope"), F.col("doc_id").alias("id"), "text")
    index, odd = search.SearchIndex(spark, folder(spark, "search")), F.col("id") % 2 == 1
    index.add(docs.filter(odd), F.col("text"), 0)
    index.merge(1)
    index.add(docs.filter(~odd), F.col("text"), 2)
    return index


@query("a8_posting_blocks", f"WITH {GRAMS_SQL} SELECT bigram, doc_id FROM g")
def _posting_blocks(spark, d):
    return _search_index(spark, d).blocks().select("bigram", F.explode(search.ids_of()).alias("doc_id"))


@query("a9_search_indexed", ORACLE_SQL["a9_search"])
def _search_indexed(spark, d):
    return _search_index(spark, d).search("and the z").select(F.col("id").alias("doc_id"), "score")


def _sql(spark: SparkSession, d: str, sql: str) -> DataFrame:
    """SQL text over the tables, with the library's functions."""
    register.create_functions(spark)
    for name in ("orders", "pages", "conversations"):
        read(spark, d, name).createOrReplaceTempView(name)
    return spark.sql(sql)


@query("sql_mail_dates", """SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) - CASE WHEN o_orderkey % 2 = 0 THEN 7200 ELSE 0 END AS secs
FROM orders WHERE o_orderdate IS NOT NULL""")
def _sql_dates(spark, d):
    return _sql(spark, d, """SELECT o_orderkey, parse_mail_date(CASE WHEN o_orderkey % 2 = 0 THEN date_format(o_orderdate, "EEE, d MMM yyyy HH:mm:ss '+0200 (CEST)'")
ELSE date_format(o_orderdate, "d MMM yy HH:mm:ss 'GMT'") END) AS secs FROM orders WHERE o_orderdate IS NOT NULL""")


@query("sql_linked_urls", ORACLE_SQL["c3_linked_urls"])
def _sql_links(spark, d):
    return _sql(spark, d, "SELECT page_id, linkify(concat('go to ', url, ' or www.', page_id, '.example.org <now>')) AS html FROM pages")


@query("sql_turns_by_subject", """SELECT concat('topic ', conv_id % 40) AS topic, count(*) AS n, count(*) FILTER (turn % 2 = 1) AS n_quoted FROM conversations GROUP BY ALL""")
def _sql_subjects(spark, d):
    return _sql(spark, d, """SELECT bare_subject(concat(CASE WHEN turn > 0 THEN 'AW: Re: ' ELSE '' END, 'topic ', conv_id % 40)) AS topic, count(*) AS n,
count_if(quote_depth(concat(CASE WHEN turn % 2 = 1 THEN '> > ' ELSE '' END, text)) >= 2 AND turn % 2 = 1) AS n_quoted FROM conversations GROUP BY 1""")


def _archive_views(spark: SparkSession, d: str) -> None:
    from .plans.sql import create_views

    m = messages(spark, d)
    edges = threads.reply_edges(m)
    create_views(spark, {"messages": m, "reply_edges": edges, "thread_index": threads.thread_walk(spark, m, edges)})


@query("sql_thread_walk", ORACLE_SQL["t1_thread_walk"])
def _sql_walk(spark, d):
    _archive_views(spark, d)
    return spark.sql("SELECT * FROM thread_walk()")


@query("sql_replies", f"""WITH {MESSAGES_SQL}, {EDGES_SQL} SELECT e.list_id, e.parent_msgnum, e.child_msgnum, e.kind, e.seq, m.subject, m.name, m.date
FROM edges e JOIN m ON m.list_id = e.list_id AND m.msgnum = e.child_msgnum""")
def _sql_replies(spark, d):
    """A table function called for each message."""
    _archive_views(spark, d)
    return spark.sql("""SELECT m.list_id, m.msgnum AS parent_msgnum, r.msgnum AS child_msgnum, r.kind, r.seq, r.subject, r.name, r.date
FROM messages m, LATERAL replies_to(m.list_id, m.msgnum) r""")


@query("s10_k11_header_cache", f"""WITH {MESSAGES_SQL} SELECT list_id, msgnum, name, email_addr, subject, msgid, inreplyto, date, CAST(max(msgnum) OVER (PARTITION BY list_id) AS BIGINT) AS max_msgnum FROM m""")
def _header_cache(spark, d):
    """Written as files of records, one a list, and read back."""
    from .plans.sinks import write_header_cache
    from .sources.archive import read_header_cache

    root = folder(spark, "cache")
    write_header_cache(messages(spark, d), root, "headers.idx", 1)
    found, ends = read_header_cache(spark, f"{root}/*/headers.idx")
    name = F.element_at(F.split("path", "/"), -2)
    return found.join(ends, "path").select(name.alias("list_id"), "msgnum", "name", "email_addr", "subject", "msgid", "inreplyto", "date", "max_msgnum")


@query("k13_message_id_lines", f"WITH {MESSAGES_SQL} SELECT concat('Message-ID: ', msgid) AS value FROM m")
def _id_lines(spark, d):
    """Appended in two runs, of which the second knows half of its lines."""
    from .plans.sinks import append_msgids

    root, m = folder(spark, "ids"), messages(spark, d)
    append_msgids(m.filter("pos % 2 = 0"), root)
    append_msgids(m, root)
    return spark.read.text(f"{root}/msgids")


@query("k16_committed_pages", f"""WITH {MESSAGES_SQL} SELECT concat(list_id, '/', lpad(CAST(msgnum AS VARCHAR), greatest(4, length(CAST(msgnum AS VARCHAR)))::INTEGER, '0'), '.html') AS path, md5(concat('<p>', subject, '</p>')) AS md5 FROM m""")
def _committed_pages(spark, d):
    """Pages as files, put in place by the commit, and read back."""
    from .plans.sinks import write_pages

    root, m = folder(spark, "pages"), messages(spark, d)
    write_pages(m.select(F.concat("list_id", F.lit("/"), text.message_filename(text.message_name(F.col("msgnum"), F.col("msgid"), F.col("date")))).alias("path"),
                         F.concat(F.lit("<p>"), "subject", F.lit("</p>")).alias("html")), root)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.html").load(root)
    return files.select(F.concat_ws("/", F.slice(F.split("path", "/"), -2, 2)).alias("path"), F.md5("content").alias("md5"))


@query("s1_mailbox_stream", f"""WITH {MESSAGES_SQL} SELECT list_id, pos, msgid, subject FROM m""")
def _mailbox_stream(spark, d):
    """Mailboxes as a stream, whose files come in two runs: the second finds new files, and a file that has grown."""
    import os

    from .functions.mail import find_header, parse_headers
    from .plans.sinks import _local
    from .streaming.ingest import mailbox_stream

    at, raw = folder(spark, "boxes"), ranking.written(raw_messages(spark, d))
    land = _local(f"{at}/land")
    os.makedirs(land)
    first = raw.filter((F.col("list_id") == "list-4") | (F.col("list_id") == "list-2") & (F.col("pos") < 7))

    def write(rows: DataFrame) -> None:
        body = F.regexp_replace(F.regexp_replace(F.decode("body", "UTF-8"), "\r\n", "\n"), "(?m)^From ", ">From ")
        whole = F.concat("from_line", F.lit("\n"), F.decode("headers", "UTF-8"), F.lit("\n"), body, F.lit("\n"))

        def one(parts) -> None:
            from itertools import groupby

            for name, own in groupby(parts, lambda r: r["list_id"]):
                with open(f"{land}/{name}.mbox", "a", encoding="utf-8", newline="") as f:
                    f.writelines(r["whole"] for r in own)

        rows.select("list_id", "pos", whole.alias("whole")).repartition("list_id").sortWithinPartitions("list_id", "pos").foreachPartition(one)

    def run() -> None:
        head = parse_headers(F.decode("headers", "ISO-8859-1"))
        rows = mailbox_stream(spark, land).select("list_id", "pos", find_header(head, "message-id").alias("msgid"), find_header(head, "subject").alias("subject"))
        rows.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()

    write(first)
    run()
    write(raw.join(first.select("list_id", "pos"), ["list_id", "pos"], "left_anti"))
    run()
    return spark.read.parquet(f"{at}/rows")


@query("c15_index_subjects", f"""WITH {MESSAGES_SQL} SELECT list_id, msgnum, CASE WHEN starts_with(subject, 'Re: ') AND trim(substr(subject, 5)) <> '' THEN trim(substr(subject, 5)) ELSE subject END AS shown FROM m""")
def _index_subjects(spark, d):
    """Subjects of index rows, without the list's own prefix."""
    return messages(spark, d).select("list_id", "msgnum", text.strip_configured_prefix(F.col("subject"), "Re: ").alias("shown"))


@query("q_single_lines", f"""WITH {LINES_SQL}, h AS (SELECT *, replace(replace(replace(replace(replace(line, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '\'\'', '&#39;') AS escaped FROM l)
SELECT doc_id, line_no, escaped, CASE WHEN trim(line) = '' THEN '<div class="hm-blank"></div>' WHEN line IN ('-- ', '--') THEN '<hr class="hm-sig">' ELSE concat('<div class="',
 CASE WHEN line LIKE '>%' THEN concat('hm-quote-', least(9, length(replace(regexp_extract(line, '^([>|:] ?)+'), ' ', '')))) ELSE 'hm-pg' END, '">', replace(escaped, chr(9), '        '), '</div>') END AS by_class FROM h""")
def _body_lines(spark, d):
    """Each line on its own, escaped and by class; what a signature is followed by isn't known to it."""
    own = doc_lines(spark, d)
    return own.select(F.col("msgnum").alias("doc_id"), "line_no", quotes.render_stateless(F.col("line"), 0).alias("escaped"), quotes.render_stateless(F.col("line"), 2).alias("by_class"))


#: 240 patterns: words by their first three letters.
STARTS = [f" {a}{b}{c}[a-z]*[ .,?]" for a in "bcdfhlmnprst" for b in "aeiou" for c in "lnrs"]
_STARTS_SQL = ", ".join(f"'{p}'" for p in STARTS)


@query("f4_many_patterns", f"""WITH {MESSAGES_SQL}, p AS (SELECT unnest([{_STARTS_SQL}]) AS pattern, unnest(range({len(STARTS)})) AS i)
SELECT list_id, msgnum, CAST(i AS INTEGER) AS pattern FROM m JOIN p ON regexp_matches(body_text, pattern)""")
def _many_patterns(spark, d):
    """One pass over each body for all patterns."""
    from .functions.mail import body_lines
    from .operators.patterns import PatternSet

    m = messages(spark, d)
    return m.select("list_id", "msgnum", F.explode(PatternSet(STARTS).hits(body_lines(F.col("body_text")))).alias("pattern"))


def _streamed_replies(spark: SparkSession, d: str) -> str:
    """The messages as a stream in three runs, turns 2, 5, ... first, so that most parents come after their replies; then
    a message a hundred days later, at which all that waits has expired."""
    from .streaming.replies import ingest_edges

    at = folder(spark, "replies")
    m = messages(spark, d).select("list_id", "pos", "msgnum", "msgid", "inreplyto", "turn")
    m = ranking.written(m)
    for k in range(3):
        rows = m.filter(F.col("turn") % 3 == 2 - k).drop("turn").withColumn("arrived", F.timestamp_seconds(F.lit(1_700_000_000 + 3600 * k)))
        if k == 2:
            tick = spark.range(1).select(F.lit("").alias("list_id"), F.lit(0).cast("bigint").alias("pos"), F.lit(0).alias("msgnum"), F.lit("<tick@x>").alias("msgid"),
                                         F.lit(None).cast("string").alias("inreplyto"), F.timestamp_seconds(F.lit(1_700_000_000 + 8_640_000)).alias("arrived"))
            rows = rows.unionByName(tick)
        rows.write.parquet(f"{at}/land/{k}")
        stream = spark.readStream.schema(rows.schema).parquet(f"{at}/land/*")
        ingest_edges(spark, stream, f"{at}/answers", f"{at}/checkpoint").awaitTermination()
    return f"{at}/answers"


@query("j1_streamed_edges", ORACLE_SQL["j1_header_edges"])
def _streamed_edges(spark, d):
    from .streaming.replies import edges_of

    return edges_of(spark, _streamed_replies(spark, d))


@query("j2_streamed_expired", ORACLE_SQL["j2_unresolved_replies"])
def _streamed_expired(spark, d):
    from .streaming.replies import expired_of

    return expired_of(spark, _streamed_replies(spark, d))
