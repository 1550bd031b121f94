"""Reply edges while messages stream in: children wait for parents that come later.

Both sides of the join are kept as state, by list and id, for the time to live, and are dropped by the watermark, so
that state is bounded by what arrives within it. A child whose parent doesn't come in that time is given out
without one: it has expired, and is counted. State is read and written by key; for state beyond the memory of executors
set spark.sql.streaming.stateStore.providerClass to the RocksDB provider.

messages: list_id, pos, msgnum, msgid, inreplyto and arrived (timestamp, when it was taken in; dates in
headers are no clock). Other columns are left out.

Defined results: an id with several holders gives an edge to each of them in the stream, of which `edges_of` takes the
last by position, as the batch does; null or empty ids have no children; a child whose In-Reply-To is empty
expires; a message that refers to itself is its own parent. A row with a null arrived can't be placed in time, and is
refused where the stream reads it (`raise_error`), not dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.mail import normalize_msgid

ANSWERS = "list_id string, child_msgnum int, child_pos bigint, inreplyto string, parent_msgnum int, parent_pos bigint"


def reply_edges_stream(messages: DataFrame, ttl: str = "30 days", delay: str = "0 seconds", salts: int = 8) -> DataFrame:
    """Rows of ANSWERS: a child with each parent that arrives within ttl before or after it, or, once ttl has
    passed without any, with nulls. delay: how much rows may arrive out of order.

    salts: children of one id are dealt to so many keys, each of which has the parent, so that a parent that a third of
    all messages answer, or wait for, isn't one task."""
    known = F.when(F.col("arrived").isNull(), F.raise_error(F.lit("a message without a time of arrival"))).otherwise(F.col("arrived"))
    rows = messages.select("list_id", F.col("pos").cast("bigint").alias("pos"), F.col("msgnum").cast("int").alias("msgnum"), "msgid", "inreplyto", known.cast("timestamp").alias("arrived"))
    rows = rows.withWatermark("arrived", delay)
    # conditions that look at the time stay above the watermark, so that each side's clock sees all rows
    timed = lambda c: F.when(F.col("arrived").isNotNull(), c).otherwise(False)
    children = rows.filter(timed(F.col("inreplyto").isNotNull())).select(
        "list_id", normalize_msgid(F.col("inreplyto")).alias("_key"), F.pmod("pos", F.lit(salts)).cast("int").alias("_salt"),
        F.col("msgnum").alias("child_msgnum"), F.col("pos").alias("child_pos"), "inreplyto", F.col("arrived").alias("_asked"))
    own = F.coalesce(normalize_msgid(F.col("msgid")), F.lit(""))
    parents = rows.filter(timed(own != "")).select(
        F.col("list_id").alias("_list"), own.alias("_id"), F.col("msgnum").alias("parent_msgnum"), F.col("pos").alias("parent_pos"), F.col("arrived").alias("_came"),
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_at"))
    near = F.expr(f"_came >= _asked - INTERVAL {ttl} AND _came <= _asked + INTERVAL {ttl}")
    same = (F.col("list_id") == F.col("_list")) & (F.col("_key") == F.col("_id")) & (F.col("_salt") == F.col("_at"))
    found = children.join(parents, same & near, "left_outer")
    return found.select("list_id", "child_msgnum", "child_pos", "inreplyto", "parent_msgnum", "parent_pos")


def ingest_edges(spark: SparkSession, messages: DataFrame, root: str, checkpoint: str, ttl: str = "30 days", delay: str = "0 seconds", salts: int = 8) -> StreamingQuery:
    """Runs over all that is there and stops. Answers of a batch are one part of the table under root, which a
    batch that is run again overwrites: each is there once."""
    def save(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("expired", F.col("parent_msgnum").isNull()).write.mode("overwrite").partitionBy("expired").parquet(f"{root}/batch_id={batch_id}")

    answers = reply_edges_stream(messages, ttl, delay, salts)
    return answers.writeStream.option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).foreachBatch(save).start()


def _answers(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(f"{ANSWERS}, batch_id bigint, expired boolean").parquet(root)


def edges_of(spark: SparkSession, root: str) -> DataFrame:
    """The header edges that have been found so far, as `threads.header_edges` gives them."""
    found = _answers(spark, root).filter("NOT expired").groupBy("list_id", "child_msgnum", "child_pos").agg(F.max_by("parent_msgnum", "parent_pos").alias("parent_msgnum"))
    return found.select("list_id", "parent_msgnum", "child_msgnum", F.lit(0).alias("maybe_reply"), F.lit("header").alias("kind"), F.col("child_pos").alias("seq"))


def expired_of(spark: SparkSession, root: str) -> DataFrame:
    """Replies whose time to live passed without a parent."""
    return _answers(spark, root).filter("expired").select("list_id", F.col("child_msgnum").alias("msgnum"), "inreplyto")


def expired_counts(spark: SparkSession, root: str) -> DataFrame:
    return expired_of(spark, root).groupBy("list_id").agg(F.count(F.lit(1)).alias("n_expired"))
