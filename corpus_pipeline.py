"""The corpus pipeline: toxicity, exact dedup, near dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and returns a
DataFrame, which run() writes as Parquet in the shared folder and reads again; what the stage wrote for it
and what it read then go. All but the last return the columns of documents.

The columns of docs travel in one struct beside what a stage adds, so that extra columns may have any
name. Dedup stages decide by row, not by doc_id: rows are numbered and written first, and of repeated
rows, or rows that share a doc_id, each is judged by its own text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postweave.llm import exact_dedup, jaccard_join, mixing, packing, toxicity
from postweave.llm.common import Scratch, documents, released, whole


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the factorization machine scores below 0.5."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    machine = toxicity.fit_toxicity(spark, docs, labels)
    return released(toxicity.scored(docs, machine).filter("score < 0.5"))


def numbered(spark: SparkSession, docs: DataFrame, name: str) -> DataFrame:
    """doc and row, a number that is fixed by being written."""
    return Scratch(spark, name).save(docs.select(whole(docs), F.monotonically_increasing_id().alias("row")), "rows")


def keep_rows(rows: DataFrame, keep: DataFrame) -> DataFrame:
    return released(rows.join(keep, "row", "left_semi"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays, that with the largest doc_id."""
    rows = numbered(spark, docs, "copies")
    found = exact_dedup.dedup(spark, rows.select("doc.doc_id", "doc.text", "row"), row="row")
    return keep_rows(rows, found.filter("kept").select("row"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the least doc_id (null last). Five-word shingles, similarity 0.8."""
    rows = numbered(spark, docs, "near_copies")
    found = jaccard_join.join(spark, rows.select(F.col("row").alias("doc_id"), "doc.text"), k=5, percent=80)
    groups = found.select(F.col("doc_id").alias("row"), "component_id").join(rows.select("row", "doc.doc_id"), "row")
    least = groups.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))).alias("least"))
    return keep_rows(rows, least.select("least.row"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents so that source, language and topic meet their target shares."""
    return released(mixing.mix(spark, docs).filter("sampled"))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece with its token ids, sequence and offset."""
    return packing.pack(spark, docs, keep_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: Models and tokenizers aren't SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        with Scratch.passing():
            docs = scratch.save(stage(spark, docs, sf_dir), f"stage_{k}")
        scratch.drop(*[f"stage_{i}" for i in range(k)])
    return docs
