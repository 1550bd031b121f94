"""Structured Streaming: mailbox files as they land, deduplicated, counted and appended.

Threads need parents that may come after their replies, so that they are recomputed from the state
table for the lists that a batch touched (foreachBatch); what needs no such look-back (dedup, counts
by calendar window) runs as stateful streaming operators with watermarks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import Config
from ..plans.archive import STATE_COLUMNS, continued, ends_of
from ..plans.messages import parse_messages
from ..sources.archive import STATE
from ..sources.mbox import RAW_SCHEMA, MailboxSource


def mailbox_stream(spark: SparkSession, path: str, form: str = "mboxo") -> DataFrame:
    spark.dataSource.register(MailboxSource)
    return spark.readStream.format("mbox").option("format", form).load(path)


def raw_stream(spark: SparkSession, path: str) -> DataFrame:
    """raw_messages that another job lands as Parquet: the source for large stores."""
    return spark.readStream.schema(RAW_SCHEMA).parquet(path)


def dedup_stream(messages: DataFrame, delay: str = "7 days") -> DataFrame:
    """First row of each id within the watermark. messages has sent (timestamp), list_id, msgid_key."""
    return messages.withWatermark("sent", delay).dropDuplicatesWithinWatermark(["list_id", "msgid_key"])


def monthly_counts_stream(messages: DataFrame, delay: str = "31 days", width: str = "30 days") -> DataFrame:
    """Messages by list and window; late ones count until the watermark passes their window."""
    return messages.withWatermark("sent", delay).groupBy("list_id", F.window("sent", width)).agg(F.count(F.lit(1)).alias("n_messages"))


ENDS = "list_id string, last_msgnum int, last_pos bigint, batch_id bigint"


def append_batch(spark: SparkSession, batch: DataFrame, batch_id: int, state_path: str, config: Config, now: int = 0) -> None:
    """Adds a batch of raw messages to the state. A batch that is run again after a failure
    overwrites its own part of the table.

    Beside the state each batch writes where every list ends then (state_path + "_ends"), so that numbers go on
    from a row a list; of the state itself only the ids are read."""
    state = spark.read.schema(f"{STATE}, batch_id bigint").parquet(state_path) if _exists(spark, state_path) else spark.createDataFrame([], f"{STATE}, batch_id bigint")
    state, ends_path = state.filter(F.col("batch_id") != batch_id), f"{state_path}_ends"
    known = spark.read.schema(ENDS).parquet(ends_path).filter(F.col("batch_id") < batch_id) if _exists(spark, ends_path) else spark.createDataFrame([], ENDS)
    last = known.agg(F.max("batch_id")).first()[0]
    ends = ends_of(state) if last is None else known.filter(F.col("batch_id") == last).drop("batch_id")
    new = continued(parse_messages(batch, config, now, 0, state.select("list_id", "msgid_key")), ends)
    path = f"{state_path}/batch_id={batch_id}"
    new.select(*STATE_COLUMNS).write.mode("overwrite").parquet(path)
    fresh = ends_of(spark.read.schema(STATE).parquet(path))
    both = ends.unionByName(fresh).groupBy("list_id").agg(F.max("last_msgnum").alias("last_msgnum"), F.max("last_pos").alias("last_pos"))
    both.write.mode("overwrite").parquet(f"{ends_path}/batch_id={batch_id}")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def ingest(spark: SparkSession, stream: DataFrame, state_path: str, checkpoint: str, config: Config | None = None) -> StreamingQuery:
    """Runs over all that is there and stops, as a scheduled job would."""
    config = (config or Config()).finish()
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(
        lambda df, n: append_batch(spark, df, n, state_path, config)).start()
