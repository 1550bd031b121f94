"""Benchmark decontamination: a positional inverted index of training tokens, asked for test phrases.

Native. The index holds postings (term, slice, document, position); a term is the hash of a word, and a term with many
postings lies in many slices, each of bounded size. A window (the words of a test phrase) is looked up by its
rarest terms: the list of the rarest gives where the window would start, and the lists of the next rarest, shifted
by their offsets in the window, are intersected with it. What is left is compared word by word with the words around
the rarest term's posting, which that posting carries, so that the result is exact whatever hashes do.

A corpus is mostly made of terms that no list asks for; `build` stores all postings, or those of given terms
alone. A test set asks for `lists` terms of each window. How often terms occur is counted over all documents first;
a window with a term that no document has is dropped there.

Defined results: null and empty texts, and texts without words, have no words and are in no window; an item of fewer
words than a window is one window; items without an id mark words as hit and are listed nowhere; items
that share an id are one; documents are told apart by id and text, so that repeated rows give repeated results; an empty table
of documents gives no rows, an empty benchmark no hits; other columns are ignored. Texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, documents, partitions, text_or_empty

#: What stands between words. A split costs a tenth of collecting the words by their own pattern.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The term that ends each document, at the position after its last word; words are never empty.
END = ""
#: Postings of a term in one slice, about.
SLICE_ROWS = 1 << 20
#: Terms (8 bytes each) that are broadcast to the scan of all tokens; a larger set is joined by a shuffle of the tokens.
BROADCAST_TERMS = 1 << 20
DOC = ["d1", "d2"]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), BREAKS, -1), "")


def term(word: Column) -> Column:
    return F.xxhash64(word)


def windows_of(spark: SparkSession, scratch: Scratch, items: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (win, words), and the items that have them (win, item_id)."""
    words = items.select("item_id", words_of(text_or_empty()).alias("all")).filter("size(all) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - size + 1, F.lit(1)))
    each = scratch.save(words.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("all", i, F.lit(size)))).alias("words")).distinct(), "item_windows")
    windows = scratch.save(each.select("words").distinct().select(F.monotonically_increasing_id().alias("win"), "words"), "windows")
    return windows, scratch.save(each.filter("item_id IS NOT NULL").join(windows, "words").select("win", "item_id"), "window_items")


class PositionalIndex:
    """Postings of documents, stored as a table bucketed by (term, slice) and sorted."""

    def __init__(self, scratch: Scratch, docs: DataFrame):
        self.scratch, self.spark = scratch, scratch.spark
        text = text_or_empty().cast("string")
        # a document is known by 128 bits of its id and text: rows need no number that a second scan must repeat
        self.words = docs.select(
            F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("doc_id", text).alias("d1"), F.xxhash64(text, F.lit(13), "doc_id").alias("d2"),
            F.array_append(words_of(text), F.lit(END)).alias("all"))

    def asked(self, tokens: DataFrame, terms: DataFrame) -> DataFrame:
        """Tokens whose term is among terms (term, ...)."""
        small = terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
        return tokens.join(F.broadcast(terms) if small else terms.hint("merge"), "term")

    def counts(self, terms: DataFrame) -> DataFrame:
        """(term, n): occurrences in all documents of those terms that occur."""
        return self.asked(self.words.select(F.explode("all").alias("word")).select(term(F.col("word")).alias("term")), terms).groupBy("term").agg(F.count(F.lit(1)).alias("n"))

    def build(self, terms: DataFrame | None = None, around: int = 0, name: str = "postings") -> DataFrame:
        """Stores postings: term, slice, d1, d2, pos, and of terms marked `rare` the `around` words before and after
        (near), the first of which stands at `since`. terms: (term, n, rare) to store; by default all, with n unknown
        in one slice."""
        tokens = self.words.select("doc_id", *DOC, "all", F.posexplode("all").alias("pos", "word"))
        tokens = tokens.withColumn("term", term(F.col("word")))
        if terms is None:
            found = tokens.withColumns({"n": F.lit(0), "rare": F.lit(False)})
        else:
            found = self.asked(tokens, terms.select("term", "n", "rare"))
        since = F.greatest(F.col("pos") - around, F.lit(0))
        rows = found.select(
            "term", slice_of(F.col("d1"), F.col("n")).alias("slice"), *DOC, "pos", since.alias("since"),
            F.when(F.col("rare"), F.slice("all", since + 1, F.lit(2 * around + 1))).alias("near"), F.when(F.col("word") == END, F.col("doc_id")).alias("doc_id"))
        table, buckets = f"{name}_{self.scratch.tag}", partitions(self.spark)
        (rows.repartition(buckets, "term", "slice").write.format("parquet").option("compression", "zstd")
         .bucketBy(buckets, "term", "slice").sortBy("term", "slice").option("path", self.scratch.path(name)).saveAsTable(table))
        self.scratch.tables.append(table)
        return self.spark.table(table)


def slice_of(d: Column, n: Column) -> Column:
    """The slice of a document in the postings of a term that occurs n times."""
    return F.pmod(d, slices(n))


def slices(n: Column) -> Column:
    return F.floor(n / SLICE_ROWS) + 1


def rarest(windows: DataFrame, counts: DataFrame, lists: int) -> DataFrame:
    """(win, length, asked): of windows whose terms all occur the `lists` rarest terms (n, at, term), rarest first."""
    terms = windows.select("win", F.size("words").alias("length"), F.posexplode("words").alias("at", "word")).withColumn("term", term(F.col("word")))
    each = terms.join(counts, "term").groupBy("win", "length").agg(F.array_sort(F.collect_list(F.struct("n", "at", "term"))).alias("asked"))
    return each.filter("size(asked) = length").select("win", "length", F.slice("asked", 1, lists).alias("asked"))


def candidates(postings: DataFrame, asked: DataFrame, counts: DataFrame) -> DataFrame:
    """(win, asked, d1, d2, start): the rarest term's postings, shifted by its offset. Windows go to each slice of the term."""
    first = asked.select("win", "asked", F.col("asked")[0]["term"].alias("term"), F.col("asked")[0]["at"].alias("at"), F.explode(
        F.sequence(F.lit(0).cast("bigint"), slices(F.col("asked")[0]["n"]) - 1)).alias("slice"))
    return postings.select("term", "slice", *DOC, "pos").join(first, ["term", "slice"]).filter("pos >= at").select(
        "win", "asked", *DOC, (F.col("pos") - F.col("at")).alias("start"))


def intersect(found: DataFrame, postings: DataFrame, k: int) -> DataFrame:
    """Those whose k-th term stands at its offset, or that have no k-th."""
    more = found.filter(F.size("asked") > k).withColumns({"term": F.col("asked")[k]["term"], "pos": F.col("start") + F.col("asked")[k]["at"]})
    met = more.join(postings.select("term", *DOC, "pos"), ["term", *DOC, "pos"], "left_semi")
    return met.drop("term", "pos").unionByName(found.filter(F.size("asked") <= k))


class Search:
    """Phrases of a test set in training documents: the index of what they ask for, and its answers."""

    def __init__(self, spark: SparkSession, docs: DataFrame, items: DataFrame, size: int = 10, lists: int = 3):
        self.scratch, self.size, self.lists = Scratch(spark, "decontamination"), size, lists
        self.windows, self.items = windows_of(spark, self.scratch, items, size)
        index = PositionalIndex(self.scratch, docs)
        end = spark.range(1).select(term(F.lit(END)).alias("term"))
        terms = self.scratch.save(self.windows.select(F.explode("words").alias("word")).select(term(F.col("word")).alias("term")).distinct(), "terms")
        self.counts = self.scratch.save(index.counts(terms), "counts")
        self.asked = self.scratch.save(rarest(self.windows, self.counts, lists), "asked")
        each = self.asked.select(F.posexplode("asked").alias("k", "x")).select("k", "x.term", "x.n")
        wanted = each.groupBy("term").agg(F.max("n").alias("n"), F.min("k").alias("k")).select("term", "n", (F.col("k") == 0).alias("rare"))
        ends = end.select("term", F.lit(1 << 62).alias("n"), F.lit(False).alias("rare"))  # as many slices as may be
        self.postings = index.build(self.scratch.save(wanted.unionByName(ends), "wanted"), size - 1)

    def documents(self) -> DataFrame:
        """(doc_id, d1, d2, n_words), a row for each of the table."""
        return self.postings.filter(F.col("term") == term(F.lit(END))).select("doc_id", *DOC, F.col("pos").cast("bigint").alias("n_words"))

    def phrases(self) -> DataFrame:
        """(win, d1, d2, start, length) of all exact occurrences."""
        found = candidates(self.postings, self.asked, self.counts)
        for k in range(1, self.lists):
            found = intersect(self.scratch.save(found, f"met_{k}"), self.postings, k)
        first = F.col("asked")[0]
        found = self.scratch.save(found.select("win", *DOC, "start", first["term"].alias("term"), (F.col("start") + first["at"]).alias("pos")), "met")
        near = self.postings.filter("near IS NOT NULL").select("term", *DOC, "pos", "since", "near").dropDuplicates(["term", *DOC, "pos"])
        checked = found.join(near, ["term", *DOC, "pos"]).join(self.windows, "win")
        same = (F.col("start") >= F.col("since")) & (F.slice("near", F.greatest(F.col("start") - F.col("since"), F.lit(0)) + 1, F.size("words")) == F.col("words"))
        return checked.filter(same).select("win", *DOC, "start", F.size("words").alias("length")).distinct()

    def near(self, slop: int) -> DataFrame:
        """(win, d1, d2, start, gap): places where the rarest terms of a window all stand within slop words of their
        offsets, measured from the rarest, which gives start; gap is the largest distance. Exact phrases have gap 0."""
        found = candidates(self.postings, self.asked, self.counts).withColumn("gap", F.lit(0)).distinct()
        for k in range(1, self.lists):
            found = self.scratch.save(found, f"near_{slop}_{k}")
            more = found.filter(F.size("asked") > k)
            shifts = more.withColumn("by", F.explode(F.sequence(F.lit(-slop), F.lit(slop)))).withColumns(
                {"term": F.col("asked")[k]["term"], "pos": F.col("start") + F.col("asked")[k]["at"] + F.col("by")})
            met = shifts.join(self.postings.select("term", *DOC, "pos"), ["term", *DOC, "pos"], "left_semi")
            least = met.groupBy("win", "asked", *DOC, "start", "gap").agg(F.min(F.abs("by")).alias("by"))
            found = least.withColumn("gap", F.greatest("gap", "by")).drop("by").unionByName(found.filter(F.size("asked") <= k))
        return found.drop("asked")


def decontaminate(spark: SparkSession, docs: DataFrame, items: DataFrame, size: int = 10, lists: int = 3) -> DataFrame:
    """One row a document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A window is `size` words of an item, which is looked up by its `lists` rarest terms; a word inside an
    occurrence of a window is hit. n_items and items_sha256 are of the items (item_id, text) that have such windows.
    """
    search = Search(spark, docs, items, size, lists)
    met = search.scratch.save(search.phrases(), "phrases")
    end = F.col("start") + F.col("length")
    reached = F.max(end).over(W.partitionBy(*DOC).orderBy("start").rowsBetween(W.unboundedPreceding, -1))
    new = F.greatest(end - F.greatest("start", F.coalesce(reached, F.lit(0))), F.lit(0))
    hits = met.select(*DOC, new.cast("bigint").alias("new")).groupBy(*DOC).agg(F.sum("new").alias("n_hit"))
    listed = met.select(*DOC, "win").distinct().join(search.items, "win").select(*DOC, F.col("item_id").cast("string").alias("item")).distinct()
    lists_of = listed.groupBy(*DOC).agg(F.array_sort(F.collect_list("item")).alias("found"))
    found = hits.join(lists_of, DOC, "left")
    # written: adaptive execution can then see how small it is, or split what many rows share
    found = search.scratch.save(found.select(*DOC, "n_hit", F.size(own := F.coalesce("found", F.array().cast("array<string>"))).alias("n_items"), F.array_join(own, ",").alias("names")), "found")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    return search.documents().join(found, DOC, "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"),
        F.sha2(F.coalesce("names", F.lit("")).cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(spark, documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT dw.r, dw.i, dw.n, win.item_id FROM dw JOIN win ON dw.s = win.s AND dw.n = win.n),
words AS (SELECT r, count(DISTINCT i + k) AS n_hit FROM hit, range(10) t(k) WHERE k < n GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""
