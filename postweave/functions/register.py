"""Arrow functions over the MIME rules, and their registration for SQL."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BinaryType, StringType, StructField, StructType

from . import dates, mail, mime, quotes, text

HEADERS = ArrayType(StructType([StructField("name", StringType()), StructField("value", StringType())]))
PARSED = StructType([StructField("headers", HEADERS), *[StructField(n, StringType()) for n in ("body_text", "charset", "subject_raw", "from_raw")]])


@pandas_udf(PARSED)
def parse_rfc822(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for headers, bodies in batches:
        rows = [mime.parse_message(h, b) for h, b in zip(headers, bodies)]
        for r in rows:
            r["headers"] = [{"name": n, "value": v} for n, v in r["headers"]]
        yield pd.DataFrame(rows, columns=["headers", "body_text", "charset", "subject_raw", "from_raw"])


@pandas_udf(StringType())
def decode_mime_words(values: pd.Series) -> pd.Series:
    return values.map(mime.decode_words, na_action="ignore")


#: Rows that a function holds results of at once: a batch from Spark may have 10,000.
PIECE = 256


def in_pieces(batches: Iterator[pa.Array], f: Callable[[bytes], bytes | None]) -> Iterator[pa.Array]:
    """f of each value. What is decoded leaves by pieces, so that of a batch only its input is held."""
    for batch in batches:
        for at in range(0, len(batch), PIECE):
            yield pa.array([None if b is None else f(b) for b in batch.slice(at, PIECE).to_pylist()], pa.binary())


@F.arrow_udf(BinaryType())
def decode_quoted_printable(values: Iterator[pa.Array]) -> Iterator[pa.Array]:
    yield from in_pieces(values, mime.quoted_printable)


@F.arrow_udf(BinaryType())
def decode_uuencode(values: Iterator[pa.Array]) -> Iterator[pa.Array]:
    yield from in_pieces(values, mime.uudecode)


@F.arrow_udf(BinaryType())
def decode_base64(values: Iterator[pa.Array]) -> Iterator[pa.Array]:
    yield from in_pieces(values, mime.base64_strict)


FUNCTIONS = {
    "parse_rfc822": parse_rfc822, "decode_mime_words": decode_mime_words, "decode_base64": decode_base64,
    "decode_quoted_printable": decode_quoted_printable, "decode_uuencode": decode_uuencode}


#: Column functions of one text (or, for dates, of seconds) as SQL functions: name, type of the argument, function.
NATIVE = {
    "parse_mail_date": ("STRING", dates.parse_mail_date), "iso_to_secs": ("STRING", dates.iso_to_secs), "secs_to_iso": ("BIGINT", dates.secs_to_iso),
    "linkify": ("STRING", text.link_urls), "bare_subject": ("STRING", text.unre), "find_url": ("STRING", text.find_url), "find_urls": ("STRING", text.find_urls),
    "escape_html": ("STRING", text.escape_html), "escape_xml": ("STRING", text.escape_xml), "obfuscate_address": ("STRING", text.obfuscate),
    "unobfuscate_address": ("STRING", text.unobfuscate), "search_text": ("STRING", text.sanitize_for_search), "mail_address": ("STRING", mail.address),
    "parse_headers": ("STRING", mail.parse_headers), "content_type": ("STRING", mail.content_type), "unflow": ("STRING", mail.unflow),
    "quote_depth": ("STRING", quotes.quote_depth), "line_kind": ("STRING", quotes.line_kind)}


def sql_text(c: Column) -> str:
    """A column expression as SQL text: operators, which Spark prints as functions, are called by their quoted names."""
    literal, operator = r"'(?:[^'\\]|\\.)*'", r"(?<![\w`])(and|or|not|[-+*/%<>=!&|^~]+)\("
    return re.sub(f"(?s){literal}|{operator}", lambda m: f"`{m[1]}`(" if m[1] else m[0], c._jc.node().sql())


def create_functions(spark: SparkSession) -> None:
    """The native functions as temporary SQL functions, whose bodies the optimizer sees: no Python worker."""
    for name, (kind, f) in NATIVE.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x {kind}) RETURN {sql_text(f(F.col('x')))}")


def register(spark: SparkSession) -> None:
    """Makes the functions and the mbox source known to SQL and readers."""
    from ..sources.mbox import MailboxSource

    create_functions(spark)
    for name, f in FUNCTIONS.items():
        spark.udf.register(name, f)
    spark.dataSource.register(MailboxSource)
