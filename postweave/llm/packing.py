"""Packing by minimum bin slack.

Documents become token ids, cut into full windows and one rest. Only the counts of each length,
at most as many as a window has tokens, go to the planner: for each window it takes the largest
length left and, by a bitset subset-sum over the multiset of the others, the rest that fills it
closest to capacity, with the counts traced back; one such choice is repeated as long as the
counts last. Pieces then find their window by their rank among pieces of their length.

Defined results: null and empty texts are the end id alone; a text of any length is cut into
gapless pieces; rows repeated with one doc_id are packed each; an empty table gives no rows; a
null doc_id stays null; other columns are ignored. Ids are the tokenizer file's at its own settings:
where a text holds the string of one of the file's added tokens, that is its id.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, arrow_limits, documents, partitions

END_ID = 1
PIECE_SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, ids binary"
#: Words whose ids a worker keeps; beyond it the cache starts anew.
CACHE_WORDS = 400_000


#: A space beside other white space (or beside a character that some tables count as such): a run,
#: which is one piece of the vocabulary's own pattern.
RUN = re.compile(r"[\s\u180e\u200b\ufeff] | [\s\u180e\u200b\ufeff]|^ | $")
LONE_SPACE = re.compile(r"(?<=[^\s\u180e\u200b\ufeff]) (?=[^\s\u180e\u200b\ufeff])")


class Tokens(dict):
    """Ids, as little-endian bytes, by a tokenizer file, with its own settings: encode() is what the
    tokenizer gives for the whole text, added tokens of the file included.

    The ids of a space and a word are kept: texts are split at single spaces between characters that
    aren't white space of any kind, where the pattern of a byte-level vocabulary always begins a piece.
    Any other pre-tokenizer, or a normalizer, gets whole texts. Where the file's merges are in the
    order of its ids, words of old scripts (letters that no table of characters has in dispute) go
    to the same merges as ranks, which is much faster for a word alone."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            own = json.load(f)
        before = own.get("pre_tokenizer") or {}
        self.by_words = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not own.get("normalizer")
        added = [t["content"] for t in own.get("added_tokens") or []]
        self.by_words &= not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in own.get("added_tokens") or [])
        self.added = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None

        self.ranks = self.by_words and self.ranked(own["model"])

    @staticmethod
    def ranked(model: dict):
        """The byte-level merges as an encoding by ranks; None where ids aren't ranks."""
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import pre_tokenizers

        if model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            return None
        merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        letters = sorted(pre_tokenizers.ByteLevel.alphabet())
        if merged != sorted(merged) or any(model["vocab"][x] >= merged[0] for x in letters):
            return None
        plain = {ord(x): ord(x) for x in letters if ord(x) < 256}  # the others stand for the bytes left over, in order
        plain |= dict(zip((ord(x) for x in letters if ord(x) >= 256), (b for b in range(256) if b not in plain)))
        names = {i: bytes(plain[ord(c)] for c in t) for t, i in model["vocab"].items() if all(ord(c) in plain for c in t) and (len(t) == 1 or i >= merged[0]) and i <= merged[-1]}
        return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={b: i for i, b in names.items()}, special_tokens={})

    def ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        if self.ranks and word and max(word) < "\u0530":
            out = np.array(self.ranks.encode_ordinary(" " + word), np.uint32).tobytes()
        else:
            out = self.ids(" " + word)
        if len(word) <= 40:
            self[word] = out
        return out

    def encode(self, text: str) -> bytes:
        if not text or not self.by_words:
            return self.ids(text)
        if self.added and self.added.search(text):  # its pieces are tokens, and texts of their own
            return b"".join(self.ids(part) if i % 2 else self.words(part) for i, part in enumerate(self.added.split(text)))
        return self.words(text)

    def words(self, text: str) -> bytes:
        first, *words = LONE_SPACE.split(text) if RUN.search(text) else text.split(" ")
        return self.ids(first) + b"".join(map(self.__getitem__, words))


_TOKENS: dict[str, Tokens] = {}


def cut(batches: Iterator[pa.RecordBatch], path: str | None, capacity: int, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    import public_tokenizers

    path = path or public_tokenizers.path("byte_bpe_50k.json")
    if path not in _TOKENS:
        _TOKENS[path] = Tokens(path)
    tokens, end, step = _TOKENS[path], np.array([END_ID], np.uint32).tobytes(), 4 * capacity
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"]
    types = [pa.int64()] * 5 + [pa.binary()]
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids = tokens.encode(text or "") + end
            for at in range(0, len(ids), step):
                part = ids[at: at + step]
                rows.append((doc_id, at // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4, part if keep_ids else None))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """Lengths, with how many of each, whose sum is the largest that room holds.

    One bitset of reachable sums is kept before each bundle (powers of two of one length) is
    added; walking back through them gives the bundles of the best sum.
    """
    reach, steps, full = 1, [], (1 << (room + 1)) - 1
    for length in sorted((n for n in counts if n <= room and counts[n]), reverse=True):
        left, bundle = min(counts[length], room // length), 1
        while left:
            take = min(bundle, left)
            steps.append((reach, length, take))
            reach |= (reach << (length * take)) & full
            left, bundle = left - take, bundle * 2
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for before, length, take in reversed(steps):
        if not before >> total & 1:
            total -= length * take
            used[length] = used.get(length, 0) + take
    return used


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(how many windows, lengths in each) until nothing is left."""
    left, out = {n: c for n, c in counts.items() if c}, []
    while left:
        seed = max(left)
        rest = dict(left)
        rest[seed] -= 1
        used = best_fill(rest, capacity - seed)
        used[seed] = used.get(seed, 0) + 1
        times = min(left[n] // k for n, k in used.items())
        for n, k in used.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
        out.append((times, used))
    return out


def plan_rows(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, in each window, first window, offset in it), for pieces."""
    rows, taken, window = [], dict.fromkeys(counts, 0), 0
    for times, used in plan(counts, capacity):
        offset = 0
        for n, k in sorted(used.items(), reverse=True):
            rows.append((n, taken[n], taken[n] + k * times, k, window, offset))
            taken[n] += k * times
            offset += n * k
        window += times
    return rows


def ranked(pieces: DataFrame, parts: int) -> DataFrame:
    """Adds rank: from 0 among pieces of one length. A length can hold a large share of all
    pieces, so that it is ranked in parts, and the parts' counts are summed up."""
    dealt = pieces.withColumn("_part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(parts)))
    counts = dealt.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("length").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("length", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(W.partitionBy("length", "_part").orderBy("doc_id", "start"))
    return (dealt.withColumn("_own", own).join(offsets, ["length", "_part"])
            .withColumn("rank", F.col("_before") + F.col("_own") - 1).drop("_part", "_own", "_before"))


def pack(spark: SparkSession, docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, keep_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    tokenizer: a file of the tokenizers library; by default the public 50k byte-level vocabulary.
    """
    arrow_limits(spark)
    scratch = Scratch(spark, "pack")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = scratch.save(rows.mapInArrow(lambda b: cut(b, tokenizer, capacity, keep_ids), PIECE_SCHEMA), "pieces")
    # at most one row for each length up to the capacity
    counts = {n: c for n, c in pieces.groupBy("length").count().collect()}
    where = spark.createDataFrame(plan_rows(counts, capacity) or [(0, 0, 0, 1, 0, 0)], "n bigint, lo bigint, hi bigint, k bigint, window bigint, at bigint")
    found = ranked(pieces, max(4, partitions(spark))).join(
        F.broadcast(where), (F.col("length") == F.col("n")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    place = F.col("rank") - F.col("lo")
    out = found.select("doc_id", "start", "length", "ids_crc32", "doc_tokens",
                       (F.col("window") + F.floor(place / F.col("k"))).cast("bigint").alias("sequence_id"),
                       (F.col("at") + place % F.col("k") * F.col("length")).alias("offset"), "ids")
    return out if keep_ids else out.drop("ids")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, documents(spark, sf_dir))
