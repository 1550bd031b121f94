"""Sorted and grouped projections of an archive.

Rank columns come from piecewise ranking (ranking.py), so that a list with a third of all messages
is not sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import folder_month, folder_year, strftime_pattern
from ..functions.text import safe_folder
from .ranking import ordered_positions, positions

#: A piece of the order by date: a day, and of undated rows so many numbers.
RANGE, UNDATED = 86400, 100_000


def subject_key() -> Column:
    """The bare subject, else the subject, in lower case; encoded words stay encoded."""
    return F.lower(F.coalesce("unre_subject", "subject", F.lit("")))


def author_key() -> Column:
    return F.lower(F.coalesce("name", "email_addr", F.lit("")))


def _order(key: Column, tie: str, reverse: bool) -> list[Column]:
    """Exact reversal, ties included, where reverse."""
    order = [key, F.col("msgnum"), F.col(tie)]
    return [c.desc() for c in order] if reverse else order


def date_pieces() -> Column:
    """Pieces of the order by date and number: days; rows without a date (0), which come first of their day by number, are pieces of numbers."""
    undated = F.col("date") == 0
    return F.struct(F.floor(F.col("date") / RANGE), (~undated).cast("int"), F.when(undated, F.floor(F.col("msgnum") / UNDATED)).otherwise(0))


def date_index(messages: DataFrame, reverse: bool = False) -> DataFrame:
    return positions(messages, ["list_id"], _order(F.col("date"), "pos", reverse), date_pieces(), "ord", reverse)


def _by_text(messages: DataFrame, key: Column, reverse: bool) -> DataFrame:
    """Texts have no pieces that hold for all lists ("[list] ..."), so that ranges come from a sample."""
    keyed = messages.withColumn("_key", key)
    return ordered_positions(keyed, ["list_id"], _order(F.col("_key"), "pos", reverse), "ord").drop("_key")


def subject_index(messages: DataFrame, reverse: bool = False) -> DataFrame:
    return _by_text(messages, subject_key(), reverse)


def author_index(messages: DataFrame, reverse: bool = False) -> DataFrame:
    return _by_text(messages, author_key(), reverse)


def archive_stats(messages: DataFrame) -> DataFrame:
    """Least and largest date and the count of each list, over all rows, undated ones as 0."""
    return messages.groupBy("list_id").agg(
        F.coalesce(F.min("date"), F.lit(0)).alias("first_date"), F.coalesce(F.max("date"), F.lit(0)).alias("last_date"), F.count(F.lit(1)).alias("n_messages"))


def folder_of(msgnum: Column, date: Column, msgs_per_folder: int = 0, folder_by_date: str | None = None) -> Column:
    """By number, or by a strftime pattern of the date; null for undated rows and unsafe names."""
    if msgs_per_folder > 0:
        return F.floor(msgnum / msgs_per_folder).cast("string")
    if folder_by_date is None:
        return F.lit(None).cast("string")
    return safe_folder(F.when(date > 0, F.date_format(F.timestamp_seconds(date), strftime_pattern(folder_by_date))))


def path_to_top(folder: Column) -> Column:
    """../ for each level of the folder."""
    depth = F.size(F.filter(F.split(folder, "/"), lambda p: p != ""))
    return F.when(F.coalesce(folder, F.lit("")) == "", "").otherwise(F.repeat(F.lit("../"), depth))


def with_folder(messages: DataFrame, msgs_per_folder: int = 0, folder_by_date: str | None = None) -> DataFrame:
    folder = folder_of(F.col("msgnum"), F.col("date"), msgs_per_folder, folder_by_date)
    return messages.withColumn("folder", folder).withColumn("rel_path_to_top", path_to_top(F.col("folder")))


def folder_stats(messages: DataFrame, reverse: bool = False) -> DataFrame:
    """Count, least and largest date of each folder; rows without one under ''."""
    by = messages.groupBy("list_id", F.coalesce("folder", F.lit("")).alias("folder")).agg(
        F.count(F.lit(1)).alias("n_messages"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    return by.orderBy("list_id", F.col("folder").desc() if reverse else "folder")


def calendar_name(kind: str, utc: bool = False) -> Column:
    """What a message's month or year page is called: 2024-01, year-2024."""
    if kind == "month":
        return F.coalesce(folder_month(F.col("date"), utc), F.lit("0000-00"))
    return F.concat(F.lit("year-"), F.coalesce(folder_year(F.col("date"), utc), F.lit("0000")))


def monthly(messages: DataFrame, utc: bool = False) -> DataFrame:
    """Messages by month; undated ones are of 1970-01."""
    name = calendar_name("month", utc)
    return _calendar(messages, name.alias("month"), F.concat(name, F.lit(".html")))


def yearly(messages: DataFrame, utc: bool = False) -> DataFrame:
    name = calendar_name("year", utc)
    return _calendar(messages, F.substring_index(name, "-", -1).alias("year"), F.concat(name, F.lit(".html")))


def _calendar(messages: DataFrame, key: Column, file: Column) -> DataFrame:
    return messages.groupBy("list_id", key, file.alias("file")).agg(
        F.count(F.lit(1)).alias("n_messages"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def calendar_rollup(messages: DataFrame, utc: bool = False) -> DataFrame:
    """Years, months and the whole list in one pass."""
    rows = messages.select("list_id", folder_year(F.col("date"), utc).alias("year"), folder_month(F.col("date"), utc).alias("month"))
    return rows.rollup("list_id", "year", "month").agg(F.count(F.lit(1)).alias("n_messages")).filter("list_id IS NOT NULL")


def latest_folder(messages: DataFrame) -> DataFrame:
    """Folder of the newest message of each list, the later row of equal dates; '.' without one."""
    return messages.groupBy("list_id").agg(F.coalesce(F.max_by("folder", F.struct("date", "pos")), F.lit(".")).alias("latest_folder"))


def largest_msgnum(messages: DataFrame) -> DataFrame:
    """One row; -1 for no messages."""
    return messages.agg(F.coalesce(F.max("msgnum"), F.lit(-1)).alias("max_msgnum"))


def attachment_index(messages: DataFrame, lines: DataFrame) -> DataFrame:
    from .filters import with_attachments

    return date_index(with_attachments(messages, lines))


def attachment_flags(messages: DataFrame, lines: DataFrame) -> DataFrame:
    own = lines.groupBy("list_id", "msgnum").agg(F.bool_or("attached").alias("has_attachment"))
    return messages.join(own, ["list_id", "msgnum"], "left").withColumn("has_attachment", F.coalesce("has_attachment", F.lit(False)))
