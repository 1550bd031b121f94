"""The whole archive as tables, in full builds and in updates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config, check
from ..operators import indexes, lines as line_ops, search, threads
from ..operators.ranking import written
from ..sources.archive import STATE, read_state
from ..sources.mbox import read_mailboxes
from .messages import parse_messages

STATE_COLUMNS = [c.split()[0] for c in STATE.split(", ")]


def derive(spark: SparkSession, messages: DataFrame, config: Config) -> dict[str, DataFrame]:
    """All tables that follow from messages."""
    messages = written(messages)  # parsed once, whatever is derived
    body = line_ops.explode_lines(messages)
    foldered = indexes.with_folder(messages, config.msgsperfolder, config.folder_by_date)
    edges = written(threads.reply_edges(messages, body if config.linkquotes else None, config.searchbackmsgnum))
    depth = config.thrdlevels if 1 <= config.thrdlevels <= 99 else threads.MAX_DEPTH
    out = {
        "messages": foldered, "body_lines": body, "reply_edges": edges, "unresolved": threads.unresolved_replies(messages),
        "date_index": indexes.date_index(foldered, config.reverse), "subject_index": indexes.subject_index(foldered, config.reverse),
        "author_index": indexes.author_index(foldered, config.reverse), "stats": indexes.archive_stats(messages),
        "thread_index": threads.thread_walk_general(messages, edges, depth) if config.linkquotes else threads.thread_walk(spark, messages, edges, depth),
        "folders": indexes.folder_stats(foldered, config.reverse_folders), "quoted_percent": line_ops.quoted_percent(body),
        "postings": search.postings(messages.withColumn("key", F.struct("list_id", "msgnum")), "key", search.searchable_text(F.col("subject"), F.col("name"), F.col("email_addr"), F.col("body_text")))}
    if config.attachmentsindex:
        out["attachment_index"] = indexes.attachment_index(foldered, body)
    if config.monthly_index:
        out["monthly"] = indexes.monthly(messages, config.gmtime)
    if config.yearly_index:
        out["yearly"] = indexes.yearly(messages, config.gmtime)
    return out


def build_archive(spark: SparkSession, source: str | DataFrame, config: Config | None = None, now: int = 0) -> dict[str, DataFrame]:
    """Tables of an archive. source: a path of mailboxes, or raw_messages."""
    config = (config or Config()).finish()
    if wrong := check(config):
        raise ValueError("; ".join(wrong))
    raw = read_mailboxes(spark, source, max_message=config.max_message_size) if isinstance(source, str) else source
    return derive(spark, parse_messages(raw, config, now), config)


def known_lists(raw: DataFrame, state: DataFrame) -> DataFrame:
    """Lists whose first raw message the state already has."""
    from ..functions.mail import find_header, normalize_msgid, parse_headers

    head = parse_headers(F.decode(F.col("headers"), "ISO-8859-1"))
    first = raw.filter("pos = 0").select("list_id", normalize_msgid(find_header(head, "message-id")).alias("msgid_key"))
    return first.join(state, ["list_id", "msgid_key"], "left_semi").select("list_id")


def update_mode(raw: DataFrame, state: DataFrame, increment: int) -> str:
    """full, append, or for -1 what the first message says: known already means a full build."""
    if increment >= 0:
        return "append" if increment else "full"
    return "append" if known_lists(raw, state).isEmpty() else "full"


def ends_of(state: DataFrame) -> DataFrame:
    """list_id and the last number and position of each list."""
    return state.groupBy("list_id").agg(F.max("msgnum").alias("last_msgnum"), F.max("pos").alias("last_pos"))


def continued(new: DataFrame, ends: DataFrame) -> DataFrame:
    """new with numbers and positions that go on where each list ended. The ends are one row a list, which
    Spark broadcasts only if they are few."""
    return new.join(ends, "list_id", "left").withColumn("msgnum", (F.col("msgnum") + F.coalesce(F.col("last_msgnum") + 1, F.lit(0))).cast("int")).withColumn(
        "pos", F.col("pos") + F.coalesce(F.col("last_pos") + 1, F.lit(0))).drop("last_msgnum", "last_pos")


def update_archive(spark: SparkSession, source: str | DataFrame, state_path: str, config: Config | None = None, now: int = 0) -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables over old and new messages, and the new messages alone (what articles are written for).
    The state is not changed, see save_state."""
    config = (config or Config()).finish()
    raw = read_mailboxes(spark, source, max_message=config.max_message_size) if isinstance(source, str) else source
    state = read_state(spark, state_path)
    if update_mode(raw, state, config.increment or 1) == "full":
        new = parse_messages(raw, config, now)
        return derive(spark, new, config), new
    new = written(continued(parse_messages(raw, config, now, 0, state.select("list_id", "msgid_key")), ends_of(state)))
    return derive(spark, appended(state, new), config), new


def appended(state: DataFrame, new: DataFrame) -> DataFrame:
    return state.select(*STATE_COLUMNS).unionByName(new.select(*STATE_COLUMNS))


def save_state(messages: DataFrame, path: str, mode: str = "append") -> None:
    messages.select(*STATE_COLUMNS).write.mode(mode).parquet(path)


def folder_archive(messages: DataFrame, edges: DataFrame, reverse: bool = False) -> dict[str, DataFrame]:
    """The index set of each folder, as of a list `list/folder`; edges only where both ends are in it."""
    own = messages.filter(F.coalesce("folder", F.lit("")) != "").withColumn("list_id", F.concat_ws("/", "list_id", "folder"))
    folders = messages.select("list_id", "msgnum", "folder")
    within = threads.folder_edges(edges, folders).withColumn("list_id", F.concat_ws("/", "list_id", "folder")).drop("folder")
    return {"messages": own, "date_index": indexes.date_index(own, reverse), "subject_index": indexes.subject_index(own, reverse), "author_index": indexes.author_index(own, reverse), "reply_edges": within}

