"""Document fingerprints: a quartile bucket digest.

Hashed byte triplets of a sliding window of five bytes are counted in 128 buckets; each bucket
says in two bits which quartile of the counts it reached, and one byte holds the length on a log
scale. The difference of two digests is the sum over buckets of the steps between quartiles, three
steps counting double, plus the difference of lengths, bounded; likeness is 1 - difference / most.

Neighbours in descending doc_id meet by a range partitioning: texts are shuffled once, each is
followed by its next one in the same task, and only the edges between tasks are joined afterwards.

Defined results: null and empty texts have the digest of no triplets; texts shorter than three
bytes likewise; of repeated doc_ids the order is by the text's hash; a null doc_id sorts last and
stays null; one row alone is its own next document; an empty table gives no rows; other columns
are ignored. Equal texts have equal digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, arrow_limits, documents, partitions, text_or_empty

BUCKETS = 128
#: The most that lengths add to a difference.
LENGTH_MOST = 48
#: Quartile steps 0..3 as they count in a difference.
STEPS = np.array([0, 1, 2, 6])
MOST = BUCKETS * int(STEPS[-1]) + LENGTH_MOST
# offsets of the two older bytes of each triplet, and its multiplier
TRIPLETS = ((1, 2, 0x9E3779B1), (1, 3, 0x85EBCA77), (2, 3, 0xC2B2AE3D), (2, 4, 0x27D4EB2F))
CHUNK = 1 << 20


def bucket_counts(data: bytes) -> np.ndarray:
    """Counts of hashed triplets: the newest byte of each window with pairs of older ones."""
    total = np.zeros(BUCKETS, np.int64)
    for lo in range(0, max(len(data), 1), CHUNK):
        part = np.frombuffer(data[max(0, lo - 4): lo + CHUNK], np.uint8).astype(np.uint32)
        fresh = min(lo, 4)  # bytes that an earlier chunk has counted as newest
        for i, j, m in TRIPLETS:
            first = max(j, fresh)
            if len(part) > first:
                n = len(part)
                value = part[first:] | part[first - i: n - i] << np.uint32(8) | part[first - j: n - j] << np.uint32(16)
                total += np.bincount((value + np.uint32(1)) * np.uint32(m) >> np.uint32(25), minlength=BUCKETS)
    return total


def digest(data: bytes) -> str:
    counts = bucket_counts(data)
    q1, q2, q3 = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    code = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    body = code[0::4] | code[1::4] << 2 | code[2::4] << 4 | code[3::4] << 6
    size = min(255, int(round(8 * np.log2(len(data) + 1))))
    return f"{size:02x}{body.astype(np.uint8).tobytes().hex()}"


def _codes(fingerprint: str) -> np.ndarray:
    body = np.frombuffer(bytes.fromhex(fingerprint[2:]), np.uint8)
    return np.stack([body >> s & 3 for s in (0, 2, 4, 6)], 1).ravel().astype(np.int64)


def likeness(a: str, b: str) -> float:
    """1 for equal digests; 0 at the largest difference."""
    steps = STEPS[np.abs(_codes(a) - _codes(b))].sum()
    length = min(LENGTH_MOST, 3 * max(0, abs(int(a[:2], 16) - int(b[:2], 16)) - 1))
    return 1.0 - float(steps + length) / MOST


RESULT_FIELDS = [
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
EDGE_FIELDS = [("edge", pa.int32()), ("text", pa.string()), ("pid", pa.int32())]
ROW_SCHEMA = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double, edge int, text string, pid int")
RESULT_SCHEMA = ROW_SCHEMA.split(", edge")[0]


def compare(doc_id, text: str, own: str, after: str, next_print: str) -> tuple:
    n = len(text)
    m = n // 3
    edited = (text[: n - m] + after[:m]).encode()
    other = digest(edited)
    return doc_id, n, hashlib.sha256(edited).hexdigest(), own, other, likeness(own, other), likeness(own, next_print)


def batch_of(rows: list[tuple], fields) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), fields)], [n for n, _ in fields])


def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in descending doc_id. Edge rows: 0 the first of this task, 1 the last."""
    from pyspark import TaskContext

    pid, fields, held = TaskContext.get().partitionId(), RESULT_FIELDS + EDGE_FIELDS, None
    edge = lambda kind, row: (row[0], *[None] * 6, kind, row[1], pid)
    for batch in batches:
        out = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            row = (doc_id, text, digest(text.encode()))
            if held is None:
                out.append(edge(0, row))
            else:
                out.append((*compare(held[0], held[1], held[2], row[1], row[2]), None, None, None))
            held = row
        if out:
            yield batch_of(out, fields)
    if held is not None:
        yield batch_of([edge(1, held)], fields)


def bridge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [compare(r["doc_id"], r["text"], digest(r["text"].encode()), r["after"], digest(r["after"].encode())) for r in batch.to_pylist()]
        if rows:
            yield batch_of(rows, RESULT_FIELDS)


def fingerprint(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    arrow_limits(spark)
    scratch = Scratch(spark, "prints")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    walked = scratch.save(rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).mapInArrow(walk, ROW_SCHEMA), "walked")
    firsts = walked.filter("edge = 0").select("pid", F.col("text").alias("after"))
    lasts = walked.filter("edge = 1").select("pid", "doc_id", "text")
    # one row for each task: which task's first row follows this task's last row
    pids = firsts.select("pid")
    follows = pids.select(F.col("pid"), F.coalesce(F.lead("pid").over(W.orderBy("pid")), F.min("pid").over(W.partitionBy())).alias("to"))
    joined = lasts.join(follows, "pid").join(firsts.withColumnRenamed("pid", "to"), "to").select("doc_id", "text", "after")
    inner = walked.filter("edge IS NULL").drop("edge", "text", "pid")
    return inner.unionByName(joined.mapInArrow(bridge, RESULT_SCHEMA))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint(spark, documents(spark, sf_dir))
