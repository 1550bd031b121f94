"""Spelling variant grouping: a symmetric-delete join over the words of a corpus.

Each word emits itself and its distinct single deletions, as 128-bit hashes that cost one step a
letter. Equal keys meet in two equi-joins: a word with the deletions that equal it (a letter more or less), and
deletions of one key at one place with each other (a letter replaced). A place of a key is held
by at most one word for each letter of the alphabet, 90, whatever the corpus, so that no group grows with it, and two near
words share exactly one key. Pairs are then verified as texts, the forms are aggregates, and
roots follow by joining the table of roots with itself, which doubles the way in each round.

Defined results: null and empty texts have no words; a null doc_id counts as an empty one in the
hash; repeated rows count each time; an empty table gives no rows; columns other than doc_id and text are
ignored. Texts and words of any length are legal: texts are read in stretches that cut no word, and a word of L
letters emits L keys of fixed size.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, arrow_limits, documents
from .kernels import U64, letter_stretches, mix, powers, table, text_buffer
from .sketch import batch_of

#: Latin-1 bytes: letters, of which only A-Z are lower-cased; all else breaks words.
RUNS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))
WORD_SCHEMA = "word string, n bigint"
KEY_SCHEMA = "k1 bigint, k2 bigint, slot int, last int, id bigint"
#: Bytes of distinct words that a task holds before it sends their counts.
HELD_BYTES = 32 << 20
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def utf8(run: bytes) -> bytes:
    return run if run.isascii() else run.decode("latin-1").encode()


def count_words(batches: Iterator[pa.RecordBatch], least: int, every: int) -> Iterator[pa.RecordBatch]:
    """Partial counts of the words of each document. A run loses a letter where `every` divides its hash."""
    counts, held = Counter(), 0

    def sent() -> Iterator[pa.RecordBatch]:
        words = list(counts)
        for i in range(0, len(words), 1 << 14):
            part = words[i: i + (1 << 14)]
            yield batch_of(WORD_SCHEMA, [[w.decode("latin-1") for w in part], [counts[w] for w in part]])

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            runs = Counter()
            for part in letter_stretches((text.as_py() or "").encode("latin-1", "replace").translate(RUNS)):
                runs.update(part.split())
            start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
            for run, n in runs.items():
                h = zlib.crc32(utf8(run), start)
                if h % every == 0:
                    at = h % len(run)
                    run = run[:at] + run[at + 1:]
                if len(run) >= least:
                    if run not in counts:
                        held += len(run) + 100
                    counts[run] += n
            if held > HELD_BYTES:
                yield from sent()
                counts, held = Counter(), 0
    yield from sent()


def letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words one after another, and offsets; all are at most U+00FF."""
    data, offsets = text_buffer(column)
    lead = data == 0xC3
    points = data + np.where(np.append(False, lead[:-1])[: len(data)], 0x40, 0).astype(np.uint8)
    before = np.concatenate([[0], np.cumsum(lead)])
    return points[~lead], offsets - before[offsets]


def emit_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, slot, last, id): the word itself with slot -1, and its distinct deletions; leaving out
    any of the letters slot to last, which are equal, gives the same."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        data, at = letters(batch.column(1))
        size = np.diff(at)
        owner = np.repeat(np.arange(len(size)), size)
        local = np.arange(len(data)) - at[owner]
        whole, without = [], []
        for seed, base in enumerate(BASES):
            power, own = powers(base, int(size.max()) + 1), table(seed + 11)[data]
            left = np.concatenate([np.zeros(1, U64), np.cumsum(own * power[local])])
            right = np.concatenate([np.zeros(1, U64), np.cumsum(own * power[np.maximum(local - 1, 0)])])
            whole.append(mix((left[at[1:]] - left[at[:-1]]) ^ size.astype(U64)))
            kept = left[:-1] - left[at[owner]] + right[at[owner + 1]] - right[1:]
            without.append(mix(kept ^ (size[owner] - 1).astype(U64)))
        # letters side by side that are equal are one deletion
        first = np.flatnonzero(np.append(True, (data[1:] != data[:-1]) | (owner[1:] != owner[:-1]))[: len(data)])
        last = np.append(first[1:], len(data)) - 1
        minus = np.full(len(size), -1, np.int32)
        columns = [np.concatenate([w.view(np.int64), d[first].view(np.int64)]) for w, d in zip(whole, without)]
        columns += [np.concatenate([minus, local[first].astype(np.int32)]), np.concatenate([minus, local[last].astype(np.int32)]), np.concatenate([ids, ids[owner[first]]])]
        for i in range(0, len(columns[0]), 1 << 16):
            yield batch_of(KEY_SCHEMA, [c[i: i + (1 << 16)] for c in columns])


def near_pairs(scratch: Scratch, words: DataFrame) -> DataFrame:
    """(a, b, word_b, n_b) for all ordered pairs of words (id, word, n) at distance one."""
    keys = scratch.save(words.select("id", "word").mapInArrow(emit_keys, KEY_SCHEMA), "keys")
    own, cut = keys.filter("slot < 0").select("k1", "k2", F.col("id").alias("a")), keys.filter("slot >= 0")
    longer = own.join(cut.select("k1", "k2", F.col("id").alias("b")), ["k1", "k2"]).select("a", "b")
    placed = cut.select("k1", "k2", F.explode(F.sequence("slot", "last")).alias("slot"), F.col("id").alias("a"))
    replaced = placed.join(placed.withColumnRenamed("a", "b"), ["k1", "k2", "slot"]).filter("a <> b").select("a", "b")
    found = longer.unionByName(longer.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(replaced)
    left = words.select(F.col("id").alias("a"), F.col("word").alias("word_a"))
    right = words.select(F.col("id").alias("b"), F.col("word").alias("word_b"), F.col("n").alias("n_b"))
    return found.join(right, "b").join(left, "a").filter("levenshtein(word_a, word_b, 1) = 1").drop("word_a")


def roots(scratch: Scratch, forms: DataFrame) -> DataFrame:
    """(id, root) from (id, form), form null where there is none: each round a root is taken from its own root, so
    that a chain of n words takes log2(n) rounds. Counts at least double along a chain, so that it ends."""
    now, k = scratch.save(forms.select("id", F.coalesce("form", "id").alias("root")), "roots_0"), 0
    while True:
        up = now.select(F.col("id").alias("root"), F.col("root").alias("next"))
        step = scratch.save(now.join(up, "root").select("id", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), f"roots_{k + 1}")
        scratch.drop(f"roots_{k}")
        k, now = k + 1, step.select("id", "root")
        if step.filter("moved").limit(1).count() == 0:
            return now


def group_variants(spark: SparkSession, docs: DataFrame, least_length: int = 5, least_count: int = 3, ratio: int = 2, every: int = 97) -> DataFrame:
    """One row a word: word, form, root, n, n_near, form_n.

    Words have at least least_length letters and least_count occurrences; the form is the near word of
    largest count, if that is at least ratio times the word's own. Words are read with deletions: one in
    `every` pairs of document and run loses a letter.
    """
    if ratio < 2:
        raise ValueError("a form's count must be at least twice the word's, or chains may not end")
    scratch = Scratch(spark, "spelling")
    arrow_limits(spark)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = rows.mapInArrow(lambda b: count_words(b, least_length, every), WORD_SCHEMA).groupBy("word").agg(F.sum("n").alias("n"))
    words = scratch.save(counted.filter(F.col("n") >= least_count).select(F.monotonically_increasing_id().alias("id"), "word", "n"), "words")
    best = near_pairs(scratch, words).groupBy(F.col("a").alias("id")).agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("less"), F.col("word_b").alias("word"), F.col("b").alias("id"))).alias("best"))
    chosen = F.when(-F.col("best.less") >= ratio * F.col("n"), F.col("best"))
    forms = scratch.save(words.join(best, "id", "left").withColumn("best", chosen).select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.col("best.id").alias("form_id"),
        F.col("best.word").alias("form"), (-F.col("best.less")).alias("form_n")), "forms")
    found = roots(scratch, forms.select("id", F.col("form_id").alias("form")))
    named = forms.join(found, "id").join(words.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root")
    return named.select("word", "form", F.col("root_word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(spark, documents(spark, sf_dir))


ORACLE_SQL = """
WITH crc AS (SELECT list_transform(range(256), lambda b: list_reduce(list_concat([b], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\\x{00C0}-\\x{00FF}]+')) AS run
  FROM documents),
own AS (SELECT id, run, count(*) AS n FROM runs GROUP BY ALL),
bytes AS (
  SELECT id, run, n, flatten(list_transform(string_split(id || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c)::BIGINT - 64] END)) AS b
  FROM own),
hashed AS (
  SELECT run, n, xor(list_reduce(list_concat([4294967295::BIGINT], b), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) AS h
  FROM bytes, crc),
cut AS (
  SELECT CASE WHEN h % 97 = 0 THEN left(run, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM cut WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
dels AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS k FROM (SELECT word, n, unnest(range(length(word)))::INT AS i FROM words)),
pairs AS (
  SELECT DISTINCT a.word, b.word AS near, b.n AS near_n FROM dels a JOIN dels b ON a.k = b.k AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, d.word, d.n FROM words a JOIN dels d ON a.word = d.k
  UNION SELECT d.word, a.word, a.n FROM words a JOIN dels d ON a.word = d.k),
best AS (SELECT word, count(*) AS n_near, min(struct_pack(less := -near_n, word := near)) AS best FROM pairs GROUP BY word),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.less >= 2 * w.n THEN best.word END AS form, CASE WHEN -best.less >= 2 * w.n THEN -best.less END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word),
chains AS (
  WITH RECURSIVE up(word, root) AS (SELECT word, word FROM forms UNION ALL SELECT up.word, f.form FROM up JOIN forms f ON f.word = up.root WHERE f.form IS NOT NULL)
  SELECT up.word, up.root FROM up JOIN forms f ON f.word = up.root WHERE f.form IS NULL)
SELECT f.word, f.form, c.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, CAST(f.form_n AS BIGINT) AS form_n FROM forms f JOIN chains c ON c.word = f.word
"""
