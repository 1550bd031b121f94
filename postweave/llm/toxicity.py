"""Toxicity: a factorization machine over hashed terms.

A document is the set of its lower-cased words and their first bytes, hashed. The terms that most sampled
documents have, and those that go with the label by themselves, get a weight and a vector each; the score is
sigmoid(w0 + sum of weights + sum over pairs of dot products), so that a pair such as an insult and
a mention of a group counts beyond its two words. Labels are learned from rows whose crc32(doc_id)
mod 5 is not 0; nothing but text enters a score.

Bounds: at most about sample_rows labelled rows are fitted (chosen by a hash of doc_id), with at
most `terms` + `common` terms; the model is as large as that and no larger. All rows are scored, whole.

Defined results: null and empty texts get the score of no terms; rows repeated with one doc_id are
scored each; a null doc_id is held out; a null label isn't learned from; without labels every score
is the prior, below 0.5; an empty table gives no rows; other columns pass through in `doc`, whatever
their names. Texts of any length are scored; their terms are worked through in stretches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import Scratch, arrow_limits, documents, whole
from .kernels import BREAKS, FOLD, U64, Words, mix, text_buffer

BITS = 20
PREFIXES = (4, 5, 6)
FOLDS = 5
SAMPLE_ROWS = 20_000
#: Terms of the machine: by their own statistic, and by how many documents have them.
TERMS, COMMON = 2048, 2048
LEAST_CHI2, LEAST_SHARE = 20.0, 0.001
#: Epochs without a better loss after which a trial ends.
PATIENCE = 3
#: Words worked on at a time, so that arrays of terms don't grow with the longest text.
STEP = 1 << 18


def fold(doc_id: Column, folds: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % folds


def below(hashed: Column, share: Column) -> Column:
    """Whether a 64-bit hash falls below a share, with 53 bits: no share above 1e-15 is lost."""
    return F.shiftrightunsigned(hashed, 11) / F.lit(float(1 << 53)) < share


def terms_of(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document, hashed term) of each text, with repeats, for some words at a time: words, and their first
    4, 5 and 6 bytes, which inflected forms share."""
    data, offsets = text_buffer(column)
    words = Words(data, offsets, fold=True, breaks=BREAKS)
    for lo in range(0, len(words.doc), STEP):
        doc, start, end = (x[lo: lo + STEP].astype(np.int64) for x in (words.doc, words.start, words.end))
        docs, terms = [doc], [words.hashes[0][lo: lo + STEP] >> U64(64 - BITS)]
        length, value = end - start, np.zeros(len(start), U64)
        for k in range(1, max(PREFIXES) + 1):
            value = value << U64(8) | FOLD[data[np.minimum(start + k - 1, len(data) - 1)]]
            if k in PREFIXES:
                own = length >= k
                docs.append(doc[own])
                terms.append(mix(value[own] + U64(k << 56)) >> U64(64 - BITS))
        yield np.concatenate(docs), np.concatenate(terms).astype(np.int64)


def distinct_pairs(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(doc.astype(U64) << U64(32) | value.astype(U64))
    return (both >> U64(32)).astype(np.int64), (both & U64(0xFFFFFFFF)).astype(np.int64)


class Machine:
    """w0, weights w and vectors v of the kept terms."""

    def __init__(self, terms: np.ndarray, factors: int, seed: int = 1):
        self.terms, rng = np.sort(terms), np.random.default_rng(seed)
        self.w0, self.w = 0.0, np.zeros(len(terms))
        self.v = rng.normal(0, 0.02, (len(terms), factors))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_at"}

    def kept(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The distinct terms of texts that have a weight, as (document, index), by document."""
        if not hasattr(self, "_at"):
            self._at = np.full(1 << BITS, -1, np.int32)
            self._at[self.terms] = np.arange(len(self.terms))
        docs, found = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for doc, term in terms_of(column):
            at = self._at[term]
            docs.append(doc[at >= 0])
            found.append(at[at >= 0])
        return distinct_pairs(np.concatenate(docs), np.concatenate(found))

    def raw(self, doc: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the sigmoid, and the sums of vectors of each document."""
        linear = np.bincount(doc, self.w[at], n)
        sums = np.stack([np.bincount(doc, self.v[at, f], n) for f in range(self.v.shape[1])], 1)
        squares = np.bincount(doc, (self.v[at] ** 2).sum(1), n)
        return self.w0 + linear + ((sums ** 2).sum(1) - squares) / 2, sums

    def scores(self, doc: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(doc, at, n)[0], -35, 35)))

    def only(self, keep: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs whose term is one of keep (a mask)."""
        own = keep[at]
        return doc[own], at[own]

    def loss(self, doc: np.ndarray, at: np.ndarray, y: np.ndarray) -> float:
        p = np.clip(self.scores(doc, at, len(y)), 1e-9, 1 - 1e-9)
        return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())

    def fit(self, doc: np.ndarray, at: np.ndarray, y: np.ndarray, epochs: int = 30, batch: int = 512, rate: float = 0.1, decay: float = 1e-4, watch=None) -> Machine:
        """Adagrad on the log loss; doc is ascending. watch(machine) is called after each epoch and ends the fit
        when it says so."""
        n, rng = len(y), np.random.default_rng(2)
        prior = (y.sum() + 0.5) / (n + 10)
        self.w0 = float(np.log(prior / (1 - prior)))
        start = np.searchsorted(doc, np.arange(n + 1))
        seen = [1e-8, np.full_like(self.w, 1e-8), np.full_like(self.v, 1e-8)]
        for _ in range(epochs if len(self.w) and n else 0):
            order = rng.permutation(n)
            for lo in range(0, n, batch):
                rows = order[lo: lo + batch]
                size = start[rows + 1] - start[rows]
                own = np.repeat(np.arange(len(rows)), size)
                which = at[np.repeat(start[rows] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())]
                raw, sums = self.raw(own, which, len(rows))
                miss = (1 / (1 + np.exp(-np.clip(raw, -35, 35))) - y[rows]) / len(rows)
                g0 = miss.sum()
                gw = np.bincount(which, miss[own], len(self.w)) + decay * self.w
                pull = miss[own, None] * (sums[own] - self.v[which])
                gv = np.stack([np.bincount(which, pull[:, f], len(self.w)) for f in range(self.v.shape[1])], 1) + decay * self.v
                for k, g in enumerate((g0, gw, gv)):
                    seen[k] = seen[k] + g * g
                self.w0 -= rate * g0 / np.sqrt(seen[0])
                self.w -= rate * gw / np.sqrt(seen[1])
                self.v -= rate * gv / np.sqrt(seen[2])
            if watch and watch(self):
                break
        return self


def chosen(terms: np.ndarray, telling: np.ndarray, factors: int, doc: np.ndarray, at: np.ndarray, y: np.ndarray, epochs: int = 30) -> Machine:
    """The machine over the telling terms alone or over all of them, with the decay and as many epochs
    as do best on a fifth of the rows, fitted again on all rows. terms is sorted."""
    mine = mix(np.arange(len(y)).astype(U64)) % U64(5) != 0
    place = np.where(mine, np.cumsum(mine), np.cumsum(~mine)) - 1
    best = (np.inf, np.ones(len(terms), bool), 1e-4, epochs)
    for keep, decay in ((np.isin(terms, telling), 1e-4), (np.ones(len(terms), bool), 1e-4), (np.ones(len(terms), bool), 3e-3)):
        machine, losses = Machine(terms, factors), []
        own_doc, own_at = machine.only(keep, doc, at)
        fit_on, other = mine[own_doc], ~mine[own_doc]
        rest = (place[own_doc[other]], own_at[other], y[~mine])

        def worse(m: Machine) -> bool:
            losses.append(m.loss(*rest))  # noqa: B023
            return len(losses) > PATIENCE + int(np.argmin(losses))  # noqa: B023

        if keep.any() and mine.any() and not mine.all():
            machine.fit(place[own_doc[fit_on]], own_at[fit_on], y[mine], epochs, decay=decay, watch=worse)
        if losses and min(losses) < best[0] * 0.98:
            best = (min(losses), keep, decay, int(np.argmin(losses)) + 1)
    _, keep, decay, n = best
    machine = Machine(terms, factors)
    machine.fit(*machine.only(keep, doc, at), y, n, decay=decay)
    machine.w[~keep], machine.v[~keep] = 0, 0
    return machine


def chi2(pos, neg, n_pos: int, n_neg: int):
    """Pearson's statistic of a term's presence with the label, from counts (columns or arrays)."""
    n, have = n_pos + n_neg, pos + neg
    return n * (pos * (n_neg - neg) - neg * (n_pos - pos)) ** 2 / (have * (n - have + 1e-9) * max(1, n_pos) * max(1, n_neg))


def labelled(docs: DataFrame, labels: DataFrame, sample_rows: int) -> DataFrame:
    """(y, text) of the sampled rows to learn from: labels are sampled first, so that what is
    broadcast is bounded by sample_rows and no text is shuffled."""
    may = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("y")).filter(
        F.col("y").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), FOLDS) != 0))
    share = min(1.0, sample_rows / max(1, may.count()))
    some = may.filter(below(F.xxhash64("doc_id"), F.lit(share))).groupBy("doc_id").agg(F.max("y").alias("y"))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(some), "doc_id").select("y", "text")


def train(rows: DataFrame, terms: int = TERMS, common: int = COMMON, factors: int = 8) -> Machine:
    """rows: (y, text), bounded by the caller.

    The terms on offer are the `common` ones that most documents have (those in more than half left
    out), whatever their labels, since a term may count only together with another; and `terms` more
    that go with the label by themselves, which may be rare. What a fifth of the rows says decides
    whether the common ones stay."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << BITS), np.int32)
        for b in batches:
            y = np.asarray(b.column(0).to_pylist())
            parts = [distinct_pairs(*part) for part in terms_of(b.column(1))]
            doc, term = distinct_pairs(*[np.concatenate([np.empty(0, np.int64), *x]) for x in zip(*parts)]) if parts else (np.empty(0, np.int64),) * 2
            for k in (0, 1):
                total[k] += np.bincount(term[y[doc] == k], minlength=1 << BITS).astype(np.int32)
        at = np.flatnonzero(total.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[1][at]), pa.array(total[0][at])], ["term", "pos", "neg"])

    sizes = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    n_pos, n_neg = sizes.get(1, 0), sizes.get(0, 0)
    counted = rows.mapInArrow(count, "term bigint, pos int, neg int").groupBy("term").agg(
        F.sum("pos").cast("double").alias("pos"), F.sum("neg").cast("double").alias("neg"))
    # at most one row for each of 2^BITS hashed terms
    have, size = F.col("pos") + F.col("neg"), n_pos + n_neg
    score = chi2(F.col("pos"), F.col("neg"), n_pos, n_neg)
    telling = counted.withColumn("s", score).filter(F.col("s") >= LEAST_CHI2).orderBy(F.desc("s"), "term").limit(terms).select("term")
    frequent = counted.filter((have >= max(3.0, LEAST_SHARE * size)) & (have <= size / 2)).orderBy(have.desc(), "term").limit(common).select("term")
    found = [np.array([r["term"] for r in t.collect()], np.int64) for t in (telling, frequent)]
    machine = Machine(np.unique(np.concatenate(found)), factors)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, at = machine.kept(b.column(1))
            ends = np.searchsorted(doc, np.arange(b.num_rows + 1))
            out = [at[i:j].astype(np.int16).tobytes() for i, j in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["y", "at"])

    got = rows.mapInArrow(reduce, "y int, at binary").collect()
    got.sort(key=lambda r: (r["y"], bytes(r["at"])))  # the same model whatever the order of tasks
    sets = [np.frombuffer(r["at"], np.int16) for r in got]
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    at = np.concatenate([*sets, np.empty(0, np.int16)]).astype(np.int64)
    return chosen(machine.terms, found[0], factors, doc, at, np.array([r["y"] for r in got], float))


def scored(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc, a struct of all columns of docs, and score; extra columns may have any name."""
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0).field("text")
            doc, at = machine.kept(texts)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(machine.scores(doc, at, b.num_rows))], ["doc", "score"])

    rows = docs.select(whole(docs))
    return rows.mapInArrow(apply, StructType([*rows.schema.fields, StructField("score", DoubleType())]))


def fit_toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Machine:
    """The labelled sample is written first, so that docs are read once for it."""
    arrow_limits(spark)
    return train(Scratch(spark, "toxicity").save(labelled(docs, labels, sample_rows), "sample"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    machine = fit_toxicity(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = scored(rows, machine).select("doc.doc_id", "score")
    return found.select("doc_id", (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
