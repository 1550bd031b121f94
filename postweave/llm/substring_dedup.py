"""Substring dedup: a count-min prefilter, then exact groups of the windows estimated repeated.

Pass 1 estimates in how many documents each window occurs, by merged sketches (sketch.py). What is
counted is a window's least k-gram (k two thirds of the window): neighbouring windows mostly share it,
so that about a quarter of the windows are items, and any document with the window has the k-gram,
so that an estimate is never below the window's number of documents. Pass 2 groups, by 128-bit hash,
only windows whose estimate is 2 or more; none is lost. Each chunk sends such a window once, with
its least doc_id, and gets the least doc_id of all back where that is smaller: a window that a third
of the corpus holds is one row a chunk. What is removed follows from the windows of the input alone.

Defined results: null and empty texts have no words; texts shorter than a window are kept whole;
rows repeated with one doc_id don't remove each other (no doc_id is smaller); a null doc_id counts
as larger than all others; any other 64-bit doc_id is legal; an empty table gives no rows; other
columns are ignored. A document of any length is one chunk: a worker holds about 15 times its bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents
from .kernels import U64, Words, rolling, sliding_min
from .sketch import Chunk, Exchange, Layout, batch_of, int_list, squeeze, unsqueeze

#: key -1, with the chunk's number for a hash: the words where the chunk's candidate windows start, and which of its keys each has.
KEY_SCHEMA = "chunk_id bigint, key int, h1 bigint, h2 bigint, doc_id bigint, places binary, keys binary"
RESULT_SCHEMA = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept_text binary"
NO_ID = np.iinfo(np.int64).max


def least_grams(words: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window's first word, run, item of each run): the least k-gram of each window in one document;
    windows side by side with one least k-gram are a run."""
    k = max(1, 2 * size // 3)
    grams = rolling(words.hashes[0], k)
    if len(words.doc) < size:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, U64)
    least = sliding_min(grams, size - k + 1)
    at = np.flatnonzero(words.doc[: len(least)] == words.doc[size - 1:])
    least, doc = least[at], words.doc[at]
    new = np.append(True, (least[1:] != least[:-1]) | (doc[1:] != doc[:-1]))[: len(at)]
    return at, np.cumsum(new) - 1, least[new]


def items(chunk: Chunk, size: int) -> np.ndarray:
    """Each document's least k-grams once: what is counted are documents."""
    words = Words(chunk.data, chunk.offsets, fold=False)
    at, run, least = least_grams(words, size)
    doc = words.doc[at[np.append(True, run[1:] != run[:-1])[: len(run)]]]
    order = np.lexsort((least, doc))
    least, doc = least[order], doc[order]
    return least[np.append(True, (least[1:] != least[:-1]) | (doc[1:] != doc[:-1]))[: len(least)]]


def send_keys(batches: Iterator[pa.RecordBatch], size: int, layout: Layout) -> Iterator[pa.RecordBatch]:
    """Of each chunk's candidate windows the distinct ones, with their least doc_id."""
    for batch in batches:
        for row in range(batch.num_rows):
            chunk, chunk_id = Chunk.of(batch, row), batch.column(batch.schema.names.index("chunk_id"))[row].as_py()
            words = Words(chunk.data, chunk.offsets, fold=False, seeds=(1, 2))
            at, run, least = least_grams(words, size)
            hot = layout.estimates(least, int_list(batch, "cells", row), int_list(batch, "estimates", row))[run] >= 2
            at = at[hot]
            if not len(at):
                continue
            h1, h2 = (rolling(words.hashes[j], size)[at].view(np.int64) for j in (0, 1))
            no_id, ids = chunk.no_id[words.doc[at]], chunk.doc_ids[words.doc[at]]
            order = np.lexsort((ids, no_id, h2, h1))
            new = np.append(True, (np.diff(h1[order]) != 0) | (np.diff(h2[order]) != 0))
            key = np.empty(len(at), np.int32)
            key[order] = np.cumsum(new) - 1
            first = order[new]  # sorted by doc_id within a key: the least
            yield batch_of(KEY_SCHEMA, [[chunk_id], [-1], [chunk_id], [-1], [None], [squeeze(np.diff(at, prepend=0).astype(np.int32))], [squeeze(key)]])
            for i in range(0, len(first), 1 << 16):
                own = first[i: i + (1 << 16)]
                none = pa.nulls(len(own), pa.binary())
                yield batch_of(KEY_SCHEMA, [np.full(len(own), chunk_id), np.arange(i, i + len(own), dtype=np.int32), h1[own], h2[own], pa.array(ids[own], mask=no_id[own]), none, none])


def removed_words(batch: pa.RecordBatch, row: int, words: Words, chunk: Chunk, size: int) -> np.ndarray:
    gone = np.zeros(len(words.doc) + 1, np.int64)
    places, keys = (batch.column(batch.schema.names.index(n))[row].as_py() for n in ("places", "keys"))
    if places:
        at, key = np.cumsum(unsqueeze(places, np.int32)), unsqueeze(keys, np.int32)
        no_id, ids = chunk.no_id[words.doc[at]], chunk.doc_ids[words.doc[at]]
        least, held = np.full(int(key.max()) + 1, NO_ID), np.zeros(int(key.max()) + 1, bool)
        np.minimum.at(least, key[~no_id], ids[~no_id])
        held[key[~no_id]] = True  # some document with an id has it
        answered = int_list(batch, "answered", row)
        least[answered], held[answered] = int_list(batch, "least", row), True
        at = at[held[key] & (no_id | (least[key] < ids))]
        np.add.at(gone, at, 1)
        np.add.at(gone, at + size, -1)
    return np.cumsum(gone[:-1]) > 0


def remove(batches: Iterator[pa.RecordBatch], size: int, texts: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            chunk = Chunk.of(batch, row)
            words = Words(chunk.data, chunk.offsets, fold=False, seeds=())
            gone = removed_words(batch, row, words, chunk, size)
            first = np.searchsorted(words.doc, np.arange(words.n_docs + 1))
            sums = np.concatenate([[0], np.cumsum(gone)])
            n_removed = sums[first[1:]] - sums[first[:-1]]
            shas, kept_texts = [], []
            for i, n in enumerate(n_removed.tolist()):
                own = chunk.data[chunk.offsets[i]: chunk.offsets[i + 1]].tobytes().split()
                if n:
                    own = [w for w, g in zip(own, gone[first[i]: first[i + 1]].tolist()) if not g]
                kept = b" ".join(own)
                shas.append(hashlib.sha256(kept).hexdigest())
                kept_texts.append(kept if texts else None)
            yield batch_of(RESULT_SCHEMA, [chunk.ids(), np.diff(first), n_removed, shas, kept_texts])


def dedup_substrings(spark: SparkSession, docs: DataFrame, size: int = 13, depth: int = 2, texts: bool = False) -> DataFrame:
    """Removes each word covered by a window of size words that starts in a smaller doc_id too.

    depth: rows of the sketch. Returns doc_id, n_words, n_removed, kept_sha256, and with texts the
    kept text in UTF-8.
    """
    ex = Exchange(spark, docs, "substring")
    counts, layout = ex.estimate(lambda chunk: items(chunk, size), depth, 0.3)
    keys = ex.joined(counts).mapInArrow(lambda b: send_keys(b, size, layout), KEY_SCHEMA)
    # exact groups; nulls aren't less than any id, and a chunk's own row goes along in a group of its own
    least = keys.withColumn("least", F.min("doc_id").over(W.partitionBy("h1", "h2")))
    back = least.filter("key < 0 OR (least IS NOT NULL AND (doc_id IS NULL OR least < doc_id))").groupBy("chunk_id").agg(
        F.collect_list(F.when(F.col("key") >= 0, F.col("key").cast("bigint"))).alias("answered"), F.collect_list(F.when(F.col("key") >= 0, F.col("least"))).alias("least"),
        F.first("places", ignorenulls=True).alias("places"), F.first("keys", ignorenulls=True).alias("keys"))
    return ex.joined(ex.scratch.save(back, "least")).mapInArrow(lambda b: remove(b, size, texts), RESULT_SCHEMA)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(spark, documents(spark, sf_dir)).drop("kept_text")


ORACLE_SQL = """
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS pos, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' '))) AS win FROM t WHERE len(w) >= 13),
hit AS (SELECT s.doc_id, s.pos FROM s JOIN (SELECT win, min(doc_id) AS least FROM s GROUP BY win) m USING (win) WHERE m.least < s.doc_id),
gone AS (SELECT DISTINCT doc_id, pos + k AS pos FROM hit, range(13) r(k)),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM t),
kept AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.pos) AS text FROM x LEFT JOIN gone g ON g.doc_id = x.doc_id AND g.pos = x.pos WHERE g.pos IS NULL GROUP BY x.doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT t.doc_id, CAST(len(t.w) AS BIGINT) AS n_words, CAST(coalesce(n.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM t LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""
