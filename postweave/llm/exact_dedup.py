"""Exact dedup: a persistent digest index, bucketed and sorted by hash.

New rows meet the index in a sort-merge anti-join whose index side needs no shuffle; the digests
that it lacks are appended. Native: DataFrame functions only.

Defined results: a null text counts as empty; texts are equal when identical after lower-casing
A-Z; of equal texts in one batch the largest doc_id stays (null is less than any), and a digest that
an earlier batch brought stays with that batch's row. Exactly one row of equal texts stays: of rows
repeated with one doc_id that with the largest hash of its own text, and of equal ones any one. An empty
table gives an empty result; columns other than doc_id, text and the row key are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, documents, partitions, text_or_empty

#: row names the row that stays, in the run that brought it.
INDEX_SCHEMA = "digest string, keep_id bigint, run string, row bigint"


def digests(docs: DataFrame, row: str | None = None) -> DataFrame:
    """doc_id, row, the SHA-256 of the normalised text and a hash of the text as it is: 88 bytes a row,
    however long the text."""
    sha = F.sha2(ascii_lower(text_or_empty()).cast("binary"), 256)
    key = F.col(row).cast("bigint") if row else F.monotonically_increasing_id()
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), key.alias("row"), sha.alias("digest"), F.xxhash64("text").alias("own"))


class DigestIndex:
    """digest -> keep_id as a table bucketed and sorted by digest; grows by appends only."""

    def __init__(self, spark: SparkSession, table: str, path: str, run: str, buckets: int | None = None):
        self.spark, self.table, self.path, self.run = spark, table, path, run
        self.buckets = buckets or partitions(spark)
        self._append(spark.createDataFrame([], INDEX_SCHEMA), "ignore")

    def _append(self, rows: DataFrame, mode: str) -> None:
        # one file a bucket and batch: rows are dealt by the hash that bucketing uses
        (rows.repartition(self.buckets, "digest").write.mode(mode).format("parquet")
         .bucketBy(self.buckets, "digest").sortBy("digest").option("path", self.path).saveAsTable(self.table))

    def entries(self) -> DataFrame:
        return self.spark.table(self.table)

    def add(self, batch: DataFrame) -> None:
        """batch: (doc_id, row, digest, own). Appends the digests that the index lacks.

        groupBy combines before its shuffle, so a digest with a third of the rows is one row a task.
        """
        best = batch.groupBy("digest").agg(F.max(F.struct("doc_id", "own", "row")).alias("best"))
        # written, since the optimizer would put the join below the aggregate, and all rows into its shuffle
        best = Scratch(self.spark, "batch").save(best, "best")
        new = best.join(self.entries().hint("merge"), "digest", "left_anti")
        self._append(new.select("digest", F.col("best.doc_id").alias("keep_id"), F.lit(self.run).alias("run"), F.col("best.row").alias("row")), "append")
        self.spark.catalog.refreshTable(self.table)


def dedup(spark: SparkSession, docs: DataFrame, batches: int = 2, row: str | None = None, index: DigestIndex | None = None) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256, and row, its key.

    row: a column of docs that tells its rows apart; by default a number. index: that of earlier runs,
    which goes on: rows whose text it knows aren't kept, and keep_id names the row that it has; by
    default an index of this run alone. The rows come in batches of descending doc_id, as a corpus that
    grows would, so that what the index already holds is the row with the larger doc_id.
    """
    scratch = Scratch(spark, "dedup")
    own = scratch.save(digests(docs, row), "digests")
    if index is None:
        table = f"digest_index_{scratch.tag}"
        scratch.tables.append(table)
        index = DigestIndex(spark, table, scratch.path("index"), scratch.tag)
    index.run = scratch.tag
    low, high = own.agg(F.min("doc_id"), F.max("doc_id")).first()
    if low is not None:
        cuts = [low + (high - low + 1) * k // batches for k in range(batches)]
        for k, a in reversed(list(enumerate(cuts))):
            mine = F.col("doc_id") >= a
            index.add(own.filter(mine & (F.col("doc_id") < cuts[k + 1]) if k + 1 < batches else mine))
    if own.filter("doc_id IS NULL").limit(1).count():
        index.add(own.filter("doc_id IS NULL"))
    sizes = own.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
    # written, so that neither side of the last join is fixed to buckets and a large group can be split
    entries = index.entries().select("digest", "keep_id", F.when(F.col("run") == scratch.tag, F.col("row")).alias("keep_row"))
    groups = scratch.save(entries.join(sizes.hint("merge"), "digest"), "groups")
    return own.join(groups, "digest").select(
        "doc_id", "keep_id", "group_size", F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept"),
        F.col("digest").alias("text_sha256"), "row")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark, documents(spark, sf_dir)).drop("row")


ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
