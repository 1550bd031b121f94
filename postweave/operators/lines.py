"""Body lines: quotation statistics, running signature state, rendering and run coalescing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.mail import body_lines, is_attachment_line
from ..functions.quotes import QUOTE_PREFIXES, is_quote, is_signature_start, line_class, quote_prefix, render_line
from ..functions.text import escape_html, link_urls


def explode_lines(messages: DataFrame, text: str = "body_text") -> DataFrame:
    """list_id, msgnum, line_no, line, attached. No shuffle: a message explodes where it is."""
    rows = messages.select("list_id", "msgnum", F.posexplode(body_lines(F.col(text))).alias("line_no", "line"))
    return rows.withColumn("attached", is_attachment_line(F.col("line")))


def quoted_percent(lines: DataFrame) -> DataFrame:
    """Whole percent of quoted lines; attachment lines count neither way."""
    own = lines.filter(~F.col("attached")).groupBy("list_id", "msgnum").agg(
        F.sum(is_quote(F.col("line")).cast("bigint")).alias("_q"), F.count(F.lit(1)).alias("_n"))
    return own.select("list_id", "msgnum", F.expr("_q * 100 div _n").cast("int").alias("quoted_percent"))


def quoted_percent_of(text: Column) -> Column:
    """The same of one body, without exploding it."""
    lines = F.filter(body_lines(text), lambda x: ~is_attachment_line(x))
    n = F.size(lines)
    return F.when(n > 0, F.floor(F.size(F.filter(lines, is_quote)) * 100 / n)).otherwise(0).cast("int")


def usual_quote_prefix(lines: DataFrame) -> DataFrame:
    """The most frequent quote mark of each message; of equals the last in the marks' order."""
    rank = F.array_position(F.array(*[F.lit(p) for p in QUOTE_PREFIXES]), F.col("_prefix"))
    own = lines.filter(~F.col("attached")).withColumn("_prefix", quote_prefix(F.col("line"))).filter(F.col("_prefix").isNotNull())
    counted = own.groupBy("list_id", "msgnum", "_prefix").agg(F.count(F.lit(1)).alias("_n"))
    return counted.groupBy("list_id", "msgnum").agg(F.max_by("_prefix", F.struct(F.col("_n"), rank)).alias("quote_prefix"))


def in_order(frame: str = "line_no") -> W:
    return W.partitionBy("list_id", "msgnum").orderBy(frame)


def render_lines(lines: DataFrame, mode: int = 1) -> DataFrame:
    """html and css of each line: 0 escaped, 1 linked, 2 classified, under a running signature
    flag. Attachment lines are left as they are."""
    if mode not in (0, 1, 2):
        raise ValueError("mode is 0, 1 or 2")
    signature = is_signature_start(F.col("line")) & ~F.col("attached")
    rows = lines.withColumn("in_signature", F.max(signature).over(in_order().rowsBetween(W.unboundedPreceding, 0)))
    kind = line_class(F.col("line"), F.col("in_signature")) if mode == 2 else F.when(F.col("in_signature"), "hm-sig-text").otherwise("hm-pg")
    html = {0: lambda: escape_html(F.col("line")), 1: lambda: link_urls(F.col("line")), 2: lambda: render_line(F.col("line"), kind)}[mode]()
    return rows.select("list_id", "msgnum", "line_no", "attached", "in_signature",
                       F.when(F.col("attached"), "hm-attachment").otherwise(kind).alias("css"), F.when(F.col("attached"), F.col("line")).otherwise(html).alias("html"))


def coalesce_runs(rendered: DataFrame) -> DataFrame:
    """Consecutive lines of one class as one run, text joined by line ends."""
    new = F.coalesce((F.lag("css").over(in_order()) != F.col("css")).cast("int"), F.lit(1))
    runs = rendered.withColumn("_new", new).withColumn("run", F.sum("_new").over(in_order().rowsBetween(W.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "html"))), lambda x: x["html"]), "\n")
    return runs.groupBy("list_id", "msgnum", "run", "css").agg(F.count(F.lit(1)).alias("n_lines"), text.alias("html"))
