"""From raw messages to the messages table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.dates import parse_mail_date
from ..functions.mail import address, find_header, in_reply_to, message_date, normalize_msgid, parse_headers
from ..functions.register import parse_rfc822
from ..functions.text import strip, unre
from ..operators.dedup import first_by_msgid
from ..operators.filters import Rules, verdict, with_ids
from ..operators.ranking import dense_positions, number_messages

COLUMNS = ("list_id", "msgnum", "pos", "date_str", "date", "name", "email_addr", "subject", "unre_subject", "msgid", "msgid_key", "inreplyto",
           "charset", "is_deleted", "body_text", "headers")


def rules_of(config: Config, now: int = 0) -> Rules:
    from datetime import datetime, timezone

    def seconds(text: str | None) -> int | None:
        if not text:
            return None
        try:
            at = datetime.fromisoformat(text)
            return int((at if at.tzinfo else at.replace(tzinfo=timezone.utc)).timestamp())
        except ValueError:
            return None  # a threshold that can't be read filters nothing

    return Rules(config.deleted, config.expires, tuple(int(n) for n in config.delete_msgnum if n.isdigit()), seconds(config.delete_older),
                 seconds(config.delete_newer), config.filter_out, config.filter_out_full_body, config.filter_require, config.filter_require_full_body, now)


def parse_messages(raw: DataFrame, config: Config = Config(), now: int = 0, start: int | None = None, kept: DataFrame | None = None) -> DataFrame:
    """messages of raw_messages.

    Rows are gated (ids, repeats) on cheap native header columns before any body goes to Python.
    kept: (list_id, msgid_key) of an archive that the rows are added to.
    """
    text = F.decode(F.col("headers").cast("binary"), "ISO-8859-1")
    gated = number_messages(raw, config.startmsgnum if start is None else start).withColumn("_head", parse_headers(text))
    gated = with_ids(gated.withColumn("msgid", find_header(F.col("_head"), "message-id")), config.require_msgids)
    if config.discard_dup_msgids:
        gated = first_by_msgid(gated, kept)
    else:
        gated = gated.withColumn("msgid_key", normalize_msgid(F.col("msgid")))
    gated = dense_positions(gated.drop("_head"))
    parsed = gated.withColumn("_p", parse_rfc822("headers", "body"))
    h = F.col("_p.headers")
    subject = F.nullif(strip(F.col("_p.subject_raw")), F.lit(""))
    who = address(F.coalesce("_p.from_raw", F.lit("")))
    date = message_date(h)
    raw_body = F.decode(F.col("body"), "ISO-8859-1")
    rows = parsed.select(
        "list_id", "msgnum", "pos", find_header(h, "date").alias("date_str"), F.coalesce(date, F.lit(0)).cast("bigint").alias("date"),
        who["name"].alias("name"), who["email"].alias("email_addr"), subject.alias("subject"), unre(subject).alias("unre_subject"), "msgid", "msgid_key",
        in_reply_to(find_header(h, "in-reply-to"), find_header(h, "references")).alias("inreplyto"), F.col("_p.charset").alias("charset"),
        verdict(rules_of(config, now), F.col("msgnum"), h, raw_body, date).alias("is_deleted"), F.col("_p.body_text").alias("body_text"), h.alias("headers"))
    if config.readone:
        rows = rows.orderBy("list_id", "pos").limit(1)
    return rows


def with_sent_date(rows: DataFrame, column: str = "date_str") -> DataFrame:
    """Adds sent: seconds of a date column of any table, null if it is none."""
    return rows.withColumn("sent", parse_mail_date(F.col(column)))
