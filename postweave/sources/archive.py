"""Sources that read an archive back: its pages, its state table, its message list."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import iso_to_secs, parse_mail_date

META = ("received", "sent", "name", "email", "subject", "id", "charset", "inreplyto", "isdeleted")


def page_comment(html: Column, key: str) -> Column:
    """The value of a metadata comment; null if the page has none."""
    found = F.regexp_extract(html, f'<!-- {key}="([^"]*)"', 1)
    return F.when(html.contains(f'<!-- {key}="'), found)


def page_msgnum(html: Column, prefix: str = "msg") -> Column:
    """The number in the page's article id, else in an old anchor; null if neither."""
    article = F.nullif(F.regexp_extract(html, rf'<article id="{prefix}(\d+)"', 1), F.lit(""))
    anchor = F.nullif(F.regexp_extract(html, rf'<a name="{prefix}(\d+)"', 1), F.lit(""))
    return F.coalesce(article.try_cast("int"), anchor.try_cast("int"))


def page_metadata(pages: DataFrame, html: str = "html", prefix: str = "msg") -> DataFrame:
    """Metadata comments of pages with an id or a body mark; date is sent, else received, else 0."""
    h = F.col(html)
    rows = pages.select("*", page_msgnum(h, prefix).alias("msgnum"), *[page_comment(h, k).alias(f"meta_{k}") for k in META],
                        h.contains('<!-- body="start"').alias("_body"))
    date = F.coalesce(parse_mail_date(F.col("meta_sent")), parse_mail_date(F.col("meta_received")), F.lit(0))
    return rows.filter(F.col("meta_id").isNotNull() | F.col("_body")).withColumn("date", date.cast("bigint")).drop("_body")


def read_pages(spark: SparkSession, path: str, suffix: str = "html", prefix: str = "msg") -> DataFrame:
    """Pages of an archive folder, subfolders too; the number comes from the file name, else the page."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{suffix}").text(path)
    pages = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("html"))
    stem = F.regexp_extract("path", rf"/(\d+)\.{suffix}$", 1).try_cast("int")
    return page_metadata(pages, prefix=prefix).withColumn("msgnum", F.coalesce(stem, "msgnum")).filter("msgnum > 0").drop("html")


STATE = "list_id string, msgnum int, pos bigint, date_str string, date bigint, name string, email_addr string, subject string, unre_subject string, msgid string, msgid_key string, inreplyto string, charset string, is_deleted int, body_text string"


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """The state table of earlier runs: the header cache with dates and texts kept."""
    return spark.read.schema(STATE).parquet(path)


def read_message_index(spark: SparkSession, path: str) -> DataFrame:
    """(msgnum, name) of a message list file; its first line is `0000 MAX`, from 0 to 100 million."""
    rows = spark.read.text(path).select(F.split("value", " ", 2).alias("p"), (F.monotonically_increasing_id() == 0).alias("_first"))
    rows = rows.select(F.get("p", F.lit(0)).alias("num"), F.get("p", F.lit(1)).alias("name"), "_first")
    # message 0 has the number of the first line too
    rows = rows.select(F.col("num").try_cast("bigint").alias("msgnum"), "name", (F.col("_first") & (F.col("num") == "0000")).alias("_head"))
    top = rows.filter("_head").agg(F.max(F.col("name").try_cast("bigint")).alias("_max"))
    legal = rows.join(F.broadcast(top), F.col("_max").between(0, 100_000_000)).filter("NOT _head AND msgnum IS NOT NULL AND msgnum BETWEEN 0 AND _max AND name <> ''")
    return legal.select(F.col("msgnum").cast("int").alias("msgnum"), "name")


# The fields of a record of the header cache, in order, each ended by a NUL.
CACHE_FIELDS = ("from_date_str", "date_str", "name", "email_addr", "subject", "msgid", "inreplyto", "charset", "from_date", "date", "exp_time", "is_deleted")
CACHE_RAW = ", ".join(["path string, msgnum int", *[f"{f} string" for f in CACHE_FIELDS], "max_msgnum bigint"])


def cache_records(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(key, value) of each record: a key of 4 bytes, a length of 4 bytes (both little-endian) and the value. A record that
    the data don't hold whole ends them."""
    at = 0
    while at + 8 <= len(data):
        key, n = int.from_bytes(data[at: at + 4], "little", signed=True), int.from_bytes(data[at + 4: at + 8], "little")
        if at + 8 + n > len(data):
            return
        yield key, data[at + 8: at + 8 + n]
        at += 8 + n


def decode_cache(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["path", "msgnum", *CACHE_FIELDS, "max_msgnum"]
    schema = pa.schema([("path", pa.string()), ("msgnum", pa.int32()), *[(f, pa.string()) for f in CACHE_FIELDS], ("max_msgnum", pa.int64())])

    def text(field: bytes) -> str | None:
        try:
            return field.decode() or None
        except UnicodeDecodeError:
            return None

    for batch in batches:
        for path, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            rows: list[tuple] = []
            for key, value in cache_records(data.as_py()):
                if key == -1 and (value.strip().lstrip(b"-").isdigit()):
                    rows.append((path, None, *[None] * len(CACHE_FIELDS), int(value)))
                elif key >= 0:
                    fields = [text(f) for f in value.split(b"\0")[: len(CACHE_FIELDS)]]
                    rows.append((path, key, *fields, *[None] * (len(CACHE_FIELDS) - len(fields)), None))
                if len(rows) == 4096:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema)
                    rows = []
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema)


def read_header_cache(spark: SparkSession, path: str, dates_as_numbers: bool = False) -> tuple[DataFrame, DataFrame]:
    """(messages, ends) of header cache files, one for each list: path names the file. ends: path, max_msgnum.

    Records without a Message-ID are left out. Dates were written as ISO texts; dates_as_numbers reads them as
    their writer's own reader does, as numbers, which makes them 0. A file is one task: a record's place isn't known
    before those ahead of it are read."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = files.repartition("path").mapInArrow(decode_cache, CACHE_RAW)
    whole = lambda c: F.coalesce(F.col(c).try_cast("bigint"), F.lit(0).cast("bigint"))
    date = whole if dates_as_numbers else lambda c: F.coalesce(iso_to_secs(F.col(c)), whole(c))
    messages = rows.filter("msgnum IS NOT NULL AND msgid IS NOT NULL").select(
        "path", "msgnum", *CACHE_FIELDS[:8], date("from_date").alias("from_date"), date("date").alias("date"), whole("exp_time").alias("exp_time"), whole("is_deleted").cast("int").alias("is_deleted"))
    return messages, rows.filter("max_msgnum IS NOT NULL").select("path", "max_msgnum")


def _le32(n: Column) -> Column:
    low = n.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))
    return F.unhex(F.concat(*[F.lpad(F.hex(F.shiftright(low, 8 * i).bitwiseAND(F.lit(255))), 2, "0") for i in range(4)]))


def cache_record(messages: DataFrame) -> DataFrame:
    """list_id, msgnum and the record of each message; columns that messages lacks are empty fields."""
    from ..functions.dates import secs_to_iso

    def field(name: str) -> Column:
        if name in ("from_date", "date"):
            return secs_to_iso(F.coalesce(F.col(name), F.lit(0).cast("bigint")) if name in messages.columns else F.lit(0).cast("bigint"))
        if name in ("exp_time", "is_deleted"):
            return F.coalesce(F.col(name).cast("string"), F.lit("0")) if name in messages.columns else F.lit("0")
        return F.coalesce(F.col(name), F.lit("")) if name in messages.columns else F.lit("")

    value = F.concat(*[F.concat(field(f).cast("binary"), F.lit(b"\0")) for f in CACHE_FIELDS])
    return messages.select("list_id", "msgnum", F.concat(_le32(F.col("msgnum")), _le32(F.octet_length(value)), value).alias("record"))


def cache_trailer(max_msgnum: Column, delete_level: int) -> Column:
    """What ends a cache: the largest number under the key -1, then the delete level under its name."""
    last, level = max_msgnum.cast("string").cast("binary"), str(delete_level).encode()
    return F.concat(_le32(F.lit(-1)), _le32(F.octet_length(last)), last, F.lit(b"delete_level\0"), F.lit(len(level).to_bytes(4, "little") + level))
