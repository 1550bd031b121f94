"""Language ID: a linear-chain conditional random field over words.

Each word's features are hashed affixes and n-grams (2 to 4 bytes of ^word$) and the word itself as
a lexicon entry; transitions between the languages of neighbouring words are learned with them.
Forward-backward gives each word's distribution, so that code-switched text is labelled word by
word; a document's language is the one with the largest mean.

Learned from text and lang of rows whose crc32(doc_id) mod 4 is not 2. Training sequences join runs
of words from rows of different languages, so that switches are seen. Every language that these rows
have is a label. Bounds of the fit: about SAMPLE_ROWS rows a language, fewer beyond LANGUAGES languages
so that the sample stays as large, and SAMPLE_WORDS words a row on average, taken as runs from anywhere
in the whole texts; the model's size doesn't grow with the number of languages, for which its features are hashed
more coarsely beyond LANGUAGES of them (transitions take 8 bytes a pair of labels). All rows are labelled, whole: long
texts go through the chain in segments whose transfer matrices are combined exactly. Beside the words a worker holds scores of
each distinct word, two distributions for each SEGMENT words, and CELLS cells of what it works on.

Defined results: `und` with score 0 for a null text, one without letters, and where nothing could
be learned; repeated rows are labelled each; a null doc_id isn't held out nor learned from; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, arrow_limits, documents
from .kernels import FOLD, U64, Words, mix, text_buffer
from .toxicity import below, fold

BITS = 17
FOLDS, HELD = 4, 2
SAMPLE_ROWS, SAMPLE_WORDS, LANGUAGES = 600, 160, 64
#: What a word with its space is taken to have, where words are bounded by bytes.
WORD_BYTES = 6
NGRAMS = (2, 3, 4)
#: Words of a segment, and segments that are worked on at a time.
SEGMENT, SLICE = 128, 1024
#: Cells (of words by labels, or of transfer matrices) that are held at a time.
CELLS = 1 << 21
RUNS = (4, 30)


def features(data: np.ndarray, start: np.ndarray, end: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(word, feature) of the words data[start:end]: n-grams of ^word$, which hold the affixes,
    and the whole word."""
    n = end - start + 2
    first = np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else np.empty(0, np.int64)
    word = np.repeat(np.arange(len(n)), n)
    body = FOLD[data[np.clip(np.repeat(start - 1 - first, n) + np.arange(int(n.sum())), 0, max(0, len(data) - 1))]].astype(U64) if len(data) else np.empty(0, U64)
    body[first], body[first + n - 1] = 1, 2
    words, found = [np.arange(len(n))], [mix(np.add.reduceat(mix(body + (np.arange(len(body)) - first[word]).astype(U64) * U64(263)), first)) if len(n) else body]
    for k in NGRAMS:
        if len(body) < k:
            continue
        h = np.full(len(body) - k + 1, k, U64)
        for j in range(k):
            h = h * U64(0x100000001B3) + body[j: len(body) - k + 1 + j]
        inside = word[: len(h)] == word[k - 1:]
        words.append(word[: len(h)][inside])
        found.append(mix(h[inside]))
    return np.concatenate(words), (np.concatenate(found) >> U64(64 - bits)).astype(np.int64)


class Chain:
    """Emission weights by feature, and transition weights, for some labels."""

    def __init__(self, labels: list[str]):
        n = len(labels)
        # fewer features for more labels than LANGUAGES, so that the model stays as large
        self.bits = BITS - max(0, (n - 1) // LANGUAGES).bit_length()
        self.labels, self.weights, self.moves = labels, np.zeros((1 << self.bits, n), np.float32), np.zeros((n, n))

    def emissions(self, word: np.ndarray, found: np.ndarray, n: int) -> np.ndarray:
        return np.stack([np.bincount(word, self.weights[found, k], n) for k in range(len(self.labels))], 1)

    def marginals(self, scores: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Word distributions of sequences laid out one after another (scores: words x labels)."""
        found = np.empty(scores.shape, np.float32)
        for place, p in self.distributions(lambda at: scores[at], length):
            found[place] = p
        return found

    def distributions(self, scores: Callable[[np.ndarray], np.ndarray], length: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(words, their distributions), some at a time; scores gives the scores of words by their places.

        The words are cut into segments of SEGMENT. A sequence of several segments is chained through their transfer
        matrices, each the product of its steps, of which CELLS cells are held at a time, first forwards and then
        backwards; then all segments run from their exact borders, so many at a time that their words have CELLS cells.
        """
        k, parts = len(self.labels), -(-length // SEGMENT)
        total = int(parts.sum())
        seq = np.repeat(np.arange(len(length)), parts)
        rank = np.arange(total) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = np.repeat(np.cumsum(length) - length, parts) + rank * SEGMENT
        size, last = np.minimum(SEGMENT, length[seq] - rank * SEGMENT), int(length.sum()) - 1
        t = np.exp(self.moves - self.moves.max())
        some, held = max(1, min(SLICE, CELLS // (SEGMENT * k))), max(1, CELLS // (k * k))
        norm = lambda x, axes: x / x.sum(axes, keepdims=True)

        def steps(own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Words of some segments, whether they are real, and their weights."""
            place = np.minimum(begin[own, None] + np.arange(SEGMENT), last)
            real = np.arange(SEGMENT) < size[own, None]
            e = scores(place).astype(np.float64)
            e = np.exp(e - e.max(2, keepdims=True))
            return place, real, np.where(real[:, :, None], e, 1.0)

        def transfers(own: np.ndarray) -> np.ndarray:
            """Row: label before the segment, column: its last label."""
            through = np.broadcast_to(np.eye(k), (len(own), k, k)).copy()
            for lo in range(0, len(own), some):
                _, real, e = steps(own[lo: lo + some])
                part = through[lo: lo + some]
                for s in range(int(size[own[lo: lo + some]].max())):
                    on = real[:, s]
                    part[on] = norm((part[on] @ t) * e[on, s][:, None, :], (1, 2))
            return through

        def by(number: np.ndarray) -> list[np.ndarray]:
            """Places of a number, from 1 on."""
            order = np.argsort(number, kind="stable")
            return np.split(order, np.searchsorted(number[order], np.arange(1, int(number.max(initial=0)) + 1)))[1:]

        into, out = np.full((total, k), 1.0 / k), np.full((total, k), 1.0 / k)  # before, and after
        chained = np.flatnonzero(parts[seq] > 1)
        blocks = [chained[lo: lo + held] for lo in range(0, len(chained), held)]
        kept = transfers(blocks[0]) if len(blocks) == 1 else None
        left = parts[seq] - 1 - rank
        for own in blocks:  # the first of a sequence has nothing before it; what follows a segment is in this block or the next
            through = transfers(own) if kept is None else kept
            for at in [np.flatnonzero(rank[own] == 0), *by(np.where(rank[own] > 0, np.minimum(rank[own], np.arange(len(own)) + 1), 0))]:
                go = at[left[own[at]] > 0]
                into[own[go] + 1] = norm(np.einsum("ij,ijk->ik", into[own[go]], through[go]), 1)
        for own in blocks[::-1]:
            through = transfers(own) if kept is None else kept
            back = len(own) - np.arange(len(own))
            for at in [np.flatnonzero(left[own] == 0), *by(np.where(left[own] > 0, np.minimum(left[own], back), 0))]:
                go = at[rank[own[at]] > 0]
                out[own[go] - 1] = norm(np.einsum("ijk,ik->ij", through[go], out[own[go]]), 1)
        for lo in range(0, total, some):
            place, real, e = steps(np.arange(lo, min(total, lo + some)))
            alpha, a, b = np.empty_like(e), into[lo: lo + some], out[lo: lo + some]
            for s in range(SEGMENT):
                a = np.where(real[:, s, None], norm((a @ t) * e[:, s], 1), a)
                alpha[:, s] = a
            for s in range(SEGMENT - 1, -1, -1):
                alpha[:, s] *= b
                b = np.where(real[:, s, None], norm((e[:, s] * b) @ t.T, 1), b)
            yield place[real], norm(alpha, 2)[real].astype(np.float32)

    def fit(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, y: np.ndarray, length: int, epochs: int = 4, batch: int = 64, rate: float = 0.3, decay: float = 1e-6) -> Chain:
        """Sequences of `length` words each; Adagrad on the conditional log likelihood."""
        n, k, rng = len(y) // length, len(self.labels), np.random.default_rng(3)
        seen_w, seen_t = np.full_like(self.weights, 1e-6), np.full_like(self.moves, 1e-6)
        for _ in range(epochs):
            order = rng.permutation(n)
            for lo in range(0, n, batch):
                rows = (order[lo: lo + batch, None] * length + np.arange(length)).ravel()
                word, found = features(data, start[rows], end[rows], self.bits)
                scores, truth = self.emissions(word, found, len(rows)), np.eye(k)[y[rows]]
                p, pair = self.pairs(scores.reshape(-1, length, k))
                miss = ((p.reshape(-1, k) - truth) / len(rows)).astype(np.float32)
                g = np.stack([np.bincount(found, miss[word, j], 1 << self.bits) for j in range(k)], 1).astype(np.float32) + decay * self.weights
                steps = y[rows].reshape(-1, length)
                have = np.zeros((k, k))
                np.add.at(have, (steps[:, :-1].ravel(), steps[:, 1:].ravel()), 1)
                gt = (pair - have) / len(rows) + decay * self.moves
                seen_w += g * g
                seen_t += gt * gt
                self.weights -= rate * g / np.sqrt(seen_w)
                self.moves -= rate * gt / np.sqrt(seen_t)
        return self

    def pairs(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward-backward over equally long sequences: word distributions, and expected counts
        of neighbouring labels."""
        e = np.exp(scores - scores.max(2, keepdims=True))
        t, (n, length, k) = np.exp(self.moves - self.moves.max()), scores.shape
        alpha, beta = np.empty_like(e), np.empty_like(e)
        a = np.full((n, k), 1.0 / k)
        for s in range(length):
            a = (a if s == 0 else a @ t) * e[:, s]
            a = a / a.sum(1, keepdims=True)
            alpha[:, s] = a
        b = np.full((n, k), 1.0 / k)
        for s in range(length - 1, -1, -1):
            beta[:, s] = b
            b = (e[:, s] * b) @ t.T
            b = b / b.sum(1, keepdims=True)
        p = alpha * beta
        # a pair's weights are a product, so that sums over all steps are one of matrices
        before, after = alpha[:, :-1].reshape(-1, k), (e[:, 1:] * beta[:, 1:]).reshape(-1, k)
        weight = ((before @ t) * after).sum(1, keepdims=True)
        return p / p.sum(2, keepdims=True), t * ((before / weight).T @ after)


def has_letters(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a letter: ASCII at once, others only where no ASCII letter is."""
    lower, some = FOLD[data], offsets[1:] > offsets[:-1]
    out = np.zeros(len(some), bool)
    if some.any():
        out[some] = np.logical_or.reduceat((lower >= ord("a")) & (lower <= ord("z")), offsets[:-1][some])
    for i in np.flatnonzero(~out & (offsets[1:] > offsets[:-1])):
        out[i] = any(map(str.isalpha, data[offsets[i]: offsets[i + 1]].tobytes().decode("utf-8", "replace")))
    return out


def label_batch(chain: Chain, column: pa.Array) -> tuple[list[str], np.ndarray]:
    data, offsets = text_buffer(column)
    words = Words(data, offsets, fold=True)
    letters = has_letters(data, offsets)
    n = words.counts()
    sums = np.zeros((len(n), max(1, len(chain.labels))))
    if len(words.doc) and chain.labels:
        _, first, inverse = np.unique(words.hashes[0], return_index=True, return_inverse=True)
        word, found = features(data, words.start[first], words.end[first], chain.bits)
        scores = chain.emissions(word, found, len(first)).astype(np.float32)
        for place, p in chain.distributions(lambda at: scores[inverse[at]], n[n > 0]):
            doc = words.doc[place]
            np.add.at(sums, np.unique(doc), np.add.reduceat(p, np.flatnonzero(np.append(True, doc[1:] != doc[:-1])), axis=0))
    mean = sums / np.maximum(1, n)[:, None]
    best = mean.argmax(1)
    known = letters & (n > 0) & bool(chain.labels)
    return [chain.labels[b] if ok else "und" for b, ok in zip(best, known)], np.where(known, np.clip(mean.max(1), 0, 1), 0.0)


def sample(spark: SparkSession, docs: DataFrame, rows: int, languages: int) -> tuple[list[str], list[tuple[str, str]]]:
    """All languages, and (lang, run of words) to learn from. About `rows` rows a language, and no more in
    all than so many for `languages` of them, are written once; of their whole texts, cut into runs, so many
    runs are taken by a hash that SAMPLE_WORDS words a row are expected."""
    may = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), FOLDS) != HELD))
    found = may.groupBy("lang").count().orderBy("lang").collect()  # the labels of the model
    if not found:
        return [], []
    rows = min(rows, rows * languages / len(found))
    share = F.create_map(*[x for r in found for x in (F.lit(r["lang"]), F.lit(min(1.0, rows / r["count"])))])
    some = Scratch(spark, "language").save(may.filter(below(F.xxhash64("doc_id"), F.try_element_at(share, F.col("lang")))), "sample")
    sizes = some.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("size")).collect()
    take = {r["lang"]: min(1.0, rows * SAMPLE_WORDS * WORD_BYTES / max(1, r["size"])) for r in sizes}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, text, lang in zip(*(c.to_pylist() for c in b.columns)):
                words, at, rng = text.split(), 0, np.random.default_rng(doc_id & 0xFFFFFFFFFFFFFFFF)
                while at < len(words):
                    n = int(rng.integers(*RUNS))
                    if rng.random() < take[lang]:
                        out.append((lang, doc_id, at, " ".join(words[at: at + n])))
                    at += n
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["lang", "doc_id", "at", "words"])

    got = some.mapInArrow(cut, "lang string, doc_id bigint, at bigint, words string").collect()
    return sorted(r["lang"] for r in found), [(r["lang"], r["words"]) for r in sorted(got, key=lambda r: (r["doc_id"], r["at"], r["lang"], r["words"]))]


def fit_language(spark: SparkSession, docs: DataFrame, rows: int = SAMPLE_ROWS, languages: int = LANGUAGES, length: int = 40) -> Chain:
    arrow_limits(spark)
    labels, got = sample(spark, docs, rows, languages)
    # runs of words, dealt so that neighbouring runs are of different rows and often languages
    place = {x: k for k, x in enumerate(labels)}
    runs = [(place[lang], text.split()) for lang, text in got]
    words = [(w, runs[i][0]) for i in np.random.default_rng(4).permutation(len(runs)) for w in runs[i][1]]
    if not words or not labels:
        return Chain([])
    words = words * -(-length // len(words)) if len(words) < length else words
    encoded = [w.encode() for w, _ in words]
    sizes = np.array([len(w) for w in encoded])
    end = np.cumsum(sizes + 1) - 1
    data = np.frombuffer(b" ".join(encoded), np.uint8)
    return Chain(labels).fit(data, end - sizes, end, np.array([y for _, y in words]), length)


def identify(spark: SparkSession, docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    arrow_limits(spark)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score = label_batch(chain, b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(apply, "doc_id bigint, lang_pred string, score double")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = identify(spark, docs, fit_language(spark, docs))
    return found.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), "lang_pred", "score")
