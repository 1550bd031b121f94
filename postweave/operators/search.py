"""Bigram index and scored search."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from ..functions.text import SPACE, sanitize_for_search
from .ranking import written


def searchable_text(subject: Column, name: Column, email: Column, body: Column) -> Column:
    return F.concat_ws(" ", subject, name, email, body)


def kept_text(text: Column) -> Column:
    """The lower-cased letters, digits and white space."""
    return F.regexp_replace(F.lower(text), r"[^\p{IsAlphabetic}\p{N}" + SPACE[1:-1] + "]", "")


def bigrams(text: Column) -> Column:
    """Distinct pairs of neighbouring characters of the kept text, in one pass."""
    return F.array_distinct(F.regexp_extract_all(kept_text(text), F.lit(r"(?s)(?=(..))."), F.lit(1)))


def codes_in(kept: str) -> np.ndarray:
    """The distinct pairs of neighbouring characters, ascending, each as one number."""
    points = np.frombuffer(kept.encode("utf-32-le"), "<u4").astype(np.int64)
    return np.unique(points[:-1] << 21 | points[1:])


@F.arrow_udf(ArrayType(LongType()))
def bigram_codes(kept: pa.Array) -> pa.Array:
    """As bigrams of a kept text, in numbers, which compare and hash in one step."""
    return pa.array([None if t is None else codes_in(t) for t in kept.to_pylist()], pa.list_(pa.int64()))


def postings(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """(bigram, key), one row for each distinct bigram of a row: the inverted index."""
    return docs.select(F.explode(bigrams(text)).alias("bigram"), key)


def _bucket(gram: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(buckets)).cast("int")


def store(index: DataFrame, path: str, buckets: int = 64, parts: int = 4) -> None:
    """Writes postings once, by bucket of the bigram: a search reads its bigrams' buckets alone. A bigram
    that nearly all texts have is spread over `parts` files of its bucket."""
    key = [c for c in index.columns if c != "bigram"]
    dealt = index.withColumn("bucket", _bucket(F.col("bigram"), buckets)).withColumn("_part", F.pmod(F.xxhash64(*key), F.lit(parts)))
    dealt.repartition("bucket", "_part").drop("_part").sortWithinPartitions("bucket", "bigram").write.mode("overwrite").partitionBy("bucket").parquet(path)


def stored(spark: SparkSession, path: str, query: str, buckets: int = 64) -> DataFrame:
    """The postings of a query's bigrams, for search: other buckets aren't read."""
    grams = query_bigrams(query)
    own = spark.createDataFrame([(g,) for g in grams] or [("",)], "gram string").select(_bucket(F.col("gram"), buckets)).distinct().collect()
    return spark.read.parquet(path).filter(F.col("bucket").isin([r[0] for r in own])).drop("bucket")


def query_bigrams(query: str) -> list[str]:
    kept = "".join(c for c in query.lower() if c.isalnum() or c.isspace())
    return sorted({kept[i: i + 2] for i in range(len(kept) - 1)})


def search(index: DataFrame, key: str, query: str) -> DataFrame:
    """Keys by how many of the query's bigrams they have, all but one at least. The literal list
    is a filter that reaches the scan; no join."""
    grams = query_bigrams(query)
    hits = index.filter(F.col("bigram").isin(grams)) if grams else index.filter("false")
    scored = hits.groupBy(key).agg(F.countDistinct("bigram").cast("int").alias("score"))
    return scored.filter(F.col("score") >= len(grams) - 1).orderBy(F.desc("score"), key)


def search_texts(docs: DataFrame, key: str, text: Column, query: str) -> DataFrame:
    """As search, over texts without a stored index: each is looked through in place, and only hits
    are sorted. The kept text stands in an array of one, so that it is made once for all bigrams and
    the limit on the score, which the optimizer would otherwise repeat it for."""
    grams = query_bigrams(query)
    score = lambda t: reduce(add, [t.contains(g).cast("int") for g in grams]) if grams else F.lit(0)
    hits = F.filter(F.transform(F.array(kept_text(text)), score), lambda n: (n >= len(grams) - 1) & (n > 0))
    return docs.select(key, F.explode(hits).alias("score")).orderBy(F.desc("score"), key)


#: How many of a query's rarest bigrams choose its candidates.
RARE = 6


def search_many(docs: DataFrame, key: str, text: Column, queries: DataFrame) -> DataFrame:
    """queries: (query_id, query). Scores of all of them over texts, all but one bigram at least.

    A hit lacks one bigram at most, so that of any RARE it has all but one: only texts with as many of a query's
    rarest bigrams are candidates, whose scores are then counted. A text's bigrams move once, to all of its queries."""
    grams = written(docs.select(key, bigram_codes(kept_text(text)).alias("_own")))
    wanted = written(queries.select("query_id", bigram_codes(kept_text(F.col("query"))).alias("_wanted")))
    asked = wanted.select("query_id", F.size("_wanted").alias("_n"), F.explode("_wanted").alias("bigram"))
    found = grams.select(key, F.explode("_own").alias("bigram"))
    # counts combine before their shuffle: a row for each bigram and task
    frequency = found.groupBy("bigram").agg(F.count(F.lit(1)).alias("_docs"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.coalesce("_docs", F.lit(0)), "bigram"))
    rare = asked.join(frequency, "bigram", "left").withColumn("_rank", rank).filter(F.col("_rank") <= RARE)
    rare = written(rare.select("query_id", "bigram", F.greatest(F.lit(1), F.least(F.lit(RARE), "_n") - 1).alias("_least")))
    pairs = found.join(rare, "bigram").repartition(key).groupBy("query_id", key).agg(F.count(F.lit(1)).alias("_c"), F.first("_least").alias("_least"))
    asking = pairs.filter("_c >= _least").groupBy(key).agg(F.collect_list("query_id").alias("_queries"))
    met = asking.join(grams, key).select(key, "_own", F.explode("_queries").alias("query_id")).join(wanted, "query_id")
    scored = met.select("query_id", key, F.size("_wanted").alias("_n"), F.size(F.array_intersect("_own", "_wanted")).alias("score"))
    return scored.filter(F.col("score") >= F.col("_n") - 1).drop("_n")


#: Ids of one block: a bigram that all texts have is a block for so many.
BLOCK_IDS = 1 << 16
BLOCKS = "bigram string, generation bigint, scope string, first bigint, n int, gaps array<int>"


def partial_blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(bigram, scope, _range, ids) of the texts of one batch: what is dealt is a row for a bigram, not for each of its texts."""
    for batch in batches:
        own = batch.filter(batch.column("kept").is_valid()).sort_by([("scope", "ascending"), ("id", "ascending")])
        scopes, ids = own.column("scope").dictionary_encode(), own.column("id").to_numpy()
        codes = [codes_in(t) for t in own.column("kept").to_pylist()]
        if not sum(map(len, codes)):
            continue
        row = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
        code = np.concatenate(codes)
        order = np.argsort(code, kind="stable")
        row, code = row[order], code[order]
        # rows ascend within a bigram, and with them scopes and ids
        scope, part = scopes.indices.fill_null(-1).to_numpy()[row], ids[row] // size
        new = np.flatnonzero(np.diff(code, prepend=-1).astype(bool) | np.diff(scope, prepend=-2).astype(bool) | np.diff(part, prepend=part[0] - 1).astype(bool))
        grams = pa.array([chr(c >> 21) + chr(c & 0x1FFFFF) for c in code[new].tolist()])
        lists = pa.ListArray.from_arrays(pa.array(np.append(new, len(row)), pa.int32()), pa.array(ids[row]))
        yield pa.RecordBatch.from_arrays([grams, own.column("scope").take(pa.array(row[new])), pa.array(part[new]), lists], ["bigram", "scope", "_range", "ids"])


def in_blocks(lists: DataFrame) -> DataFrame:
    """(bigram, scope, first, n, gaps) of all ids, once each, of (bigram, scope, _range, ids)."""
    merged = lists.groupBy("bigram", "scope", "_range").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("_ids"))
    gaps = F.transform(F.slice("_ids", 2, F.size("_ids")), lambda x, i: (x - F.get("_ids", i)).cast("int"))
    return merged.select("bigram", "scope", F.get("_ids", F.lit(0)).alias("first"), F.size("_ids").alias("n"), gaps.alias("gaps"))


def posting_blocks(docs: DataFrame, text: Column) -> DataFrame:
    """(bigram, scope, first, n, gaps): the ascending ids of a bigram in blocks, each its first id and the gaps to
    those that follow. docs: scope (a list, or ''), id. A block is of one range of ids, so that it is bounded
    whatever the bigram."""
    rows = docs.select("scope", F.col("id").cast("bigint").alias("id"), kept_text(text).alias("kept"))
    return in_blocks(rows.mapInArrow(lambda b, size=BLOCK_IDS: partial_blocks(b, size), "bigram string, scope string, _range bigint, ids array<bigint>"))


class SearchIndex:
    """Posting blocks under a path, by bucket of the bigram, in generations: each addition is one, and merging makes one
    of all. A search looks up how many texts its bigrams have, reads the blocks of the two rarest, and of the others only
    blocks that can hold one of the candidates these give."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, path.rstrip("/"), buckets

    def _path(self) -> str:
        """Where the blocks are: the last complete merge, else those of additions alone."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        at = path(f"{self.root}/merged")
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        done = sorted(int(f.getPath().getName()) for f in fs.listStatus(at) if fs.exists(path(f.getPath(), "_SUCCESS"))) if fs.exists(at) else []
        return f"{self.root}/merged/{done[-1]}" if done else f"{self.root}/blocks"

    def blocks(self) -> DataFrame:
        return self.spark.read.schema(f"{BLOCKS}, bucket int").parquet(self._path())

    def add(self, docs: DataFrame, text: Column, generation: int) -> None:
        """docs: scope, id, of texts that the index lacks. An addition that is run again replaces its own blocks."""
        rows = posting_blocks(docs, text).withColumn("generation", F.lit(generation).cast("bigint"))
        self._write(rows, self._path(), "overwrite")

    def _write(self, rows: DataFrame, path: str, mode: str) -> None:
        dealt = rows.withColumn("bucket", _bucket(F.col("bigram"), self.buckets)).hint("rebalance", F.col("bucket"))
        out = dealt.select("bigram", "scope", "first", "n", "gaps", "generation", "bucket").sortWithinPartitions("bucket", "bigram", "scope", "first")
        out.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("generation", "bucket").parquet(path)

    def merge(self, generation: int) -> None:
        """All generations as one, written beside them; searches take it once it is complete."""
        old = self.blocks()
        lists = old.select("bigram", "scope", F.floor(F.col("first") / BLOCK_IDS).alias("_range"), ids_of().alias("ids"))
        rows = in_blocks(lists).withColumn("generation", F.lit(generation).cast("bigint"))
        self._write(rows, f"{self.root}/merged/{generation}", "overwrite")

    def of(self, grams: list[str]) -> DataFrame:
        """The blocks of some bigrams: other buckets aren't opened, and a file is read where its bigrams can be."""
        own = self.spark.createDataFrame([(g,) for g in grams], "gram string").select(_bucket(F.col("gram"), self.buckets)).distinct().collect()
        return self.blocks().filter(F.col("bucket").isin([r[0] for r in own]) & F.col("bigram").isin(grams))

    def frequencies(self, grams: list[str]) -> dict[str, int]:
        """In how many texts each bigram is; of blocks only their counts are read."""
        found = {r.bigram: r.n for r in self.of(grams).groupBy("bigram").agg(F.sum("n").alias("n")).collect()} if grams else {}
        return {g: found.get(g, 0) for g in grams}

    def search(self, query: str) -> DataFrame:
        """(scope, id, score): texts that have all of the query's bigrams but one at most."""
        grams = query_bigrams(query)
        if not grams:
            return self.spark.createDataFrame([], "scope string, id bigint, score int")
        counts = self.frequencies(grams)
        by_count = sorted(grams, key=lambda g: (counts[g], g))
        # a hit lacks one bigram at most, so that it has one of the two rarest
        listed = lambda own: self.of(own).select("bigram", "scope", F.explode(ids_of()).alias("id"))
        rare = written(listed(by_count[:2]))
        parts = [rare]
        if by_count[2:]:
            reach = rare.select("scope", F.floor(F.col("id") / BLOCK_IDS).alias("_range")).distinct()
            near = self.of(by_count[2:]).withColumn("_range", F.floor(F.col("first") / BLOCK_IDS)).join(reach, ["scope", "_range"], "left_semi")
            parts.append(near.select("bigram", "scope", F.explode(ids_of()).alias("id")).join(rare.select("scope", "id").distinct(), ["scope", "id"], "left_semi").select("bigram", "scope", "id"))
        scored = reduce(DataFrame.unionByName, parts).groupBy("scope", "id").agg(F.count_distinct("bigram").cast("int").alias("score"))
        return scored.filter(F.col("score") >= len(grams) - 1)


@F.arrow_udf(ArrayType(LongType()))
def _running(first: pa.Array, gaps: pa.Array) -> pa.Array:
    sizes = np.diff(gaps.offsets.to_numpy()) + 1
    at = np.cumsum(sizes) - sizes
    steps = np.zeros(int(sizes.sum()), np.int64)
    inner = np.ones(len(steps), bool)
    inner[at] = False
    steps[inner] = gaps.flatten().to_numpy()
    sums = np.cumsum(steps)
    ids = sums + np.repeat(first.to_numpy() - sums[at], sizes)
    return pa.ListArray.from_arrays(pa.array(np.append(at, len(steps)), pa.int32()), pa.array(ids))


def ids_of() -> Column:
    """A block's ids again: running sums of its gaps, in one pass over a batch of blocks."""
    return _running(F.col("first"), F.col("gaps"))


def search_lines(messages: DataFrame) -> DataFrame:
    """The flat search file: msgnum|text, one line a message."""
    text = sanitize_for_search(searchable_text(F.col("subject"), F.col("name"), F.col("email_addr"), F.col("body_text")))
    return messages.select(F.concat_ws("|", F.col("msgnum").cast("string"), text).alias("value"))
