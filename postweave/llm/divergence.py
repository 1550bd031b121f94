"""Source divergence audit: how far the terms of each source are from those of every other source of its language.

Heavy-light split. Terms that many sources of a language have go to dense numpy tiles (a block of terms by two
blocks of sources), which add up the divergence of all pairs of sources. For the rare terms all sources first
count as if they lacked them; terms of one count in one source are corrected together, from a histogram; and
pairs of sources that share a rare term are corrected by its posting list, which is short by definition. The
sums are added exactly: shares are integers, and sums of decimals of 38 digits.

With p the share of a term in a source and q that in another, f = floor((p - q)^2 / q) and

    value(s, t) = sum over heavy terms of f(p_s, p_t)                                            (tiles)
                + L * f(o_s, o_t)                                                              (L light terms, o: shares of an absent term)
                + sum over light terms of s: f(p_s, o_t) - f(o_s, o_t), and the same for t     (histograms)
                + sum over light terms of both: f(p_s, p_t) - f(p_s, o_t) - f(o_s, p_t) + f(o_s, o_t)    (postings)

Defined results: null text, lang and source count as ''; repeated rows count each time; a group without terms
meets all other groups of its language; a language without kept terms gives pairs of value 0; a language of one source has
no pairs; an empty table gives no rows; other columns are ignored. Texts of any length are read in stretches.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, arrow_limits, documents, text_or_empty
from .kernels import letter_stretches
from .sketch import batch_of

#: UTF-8 bytes: ASCII letters, of which A-Z are lower-cased, and all bytes above ASCII; all else breaks terms.
TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0x80 else 32 for b in range(256))
COUNT_SCHEMA = "lang string, source string, term string, n bigint, docs bigint"
#: Distinct terms of groups that a task holds, and those of one batch more, before it sends their counts.
HELD_TERMS = 400_000
SCALE = 1_000_000_000
#: Cells of a dense tile, and sources in a block of one.
TILE_CELLS, SOURCE_BLOCK = 1 << 16, 256
#: Parts into which the sources of a language are repeated, so that a language is no single task.
SALTS = 32


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of occurrences and of documents by group and term; the term '' stands for the group itself."""
    counts, docs = defaultdict(Counter), defaultdict(Counter)

    def sent() -> Iterator[pa.RecordBatch]:
        for (lang, source), seen in docs.items():
            terms, n = list(seen), counts[lang, source]
            for i in range(0, len(terms), 1 << 14):
                part = terms[i: i + (1 << 14)]
                yield batch_of(COUNT_SCHEMA, [[lang] * len(part), [source] * len(part), [t.decode() for t in part], [n[t] for t in part], [seen[t] for t in part]])

    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            own = {b""}
            for part in letter_stretches(text.as_py().encode().translate(TERMS)):
                terms = part.split()
                counts[lang, source].update(terms)
                own.update(terms)
            docs[lang, source].update(own)
        if sum(map(len, docs.values())) > HELD_TERMS:
            yield from sent()
            counts, docs = defaultdict(Counter), defaultdict(Counter)
    yield from sent()


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + terms)), exact for any 64-bit counts."""
    wide = lambda c: c.cast("decimal(20,0)")
    up = (wide(n) + F.lit(1).cast("decimal(1,0)")) * F.lit(SCALE).cast("decimal(10,0)")
    return F.lit(1).cast("bigint") + F.call_function("div", up, wide(total) + wide(terms))


def diverged(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); squares of shares fit in 64 bits."""
    return F.call_function("div", (p - q) * (p - q), q)


def wide(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def tile_sums(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """A tile: sums of f over its terms for all sources of block a against all of block b.

    left: shares (term, source, p) of the sources of both blocks that have a term; right: all sources of both
    blocks (source, block, absent, tile_terms), for the shares of terms that they lack."""
    lang, a, b, _ = key
    names, absent, places = right.source.to_numpy(), right.absent.to_numpy(np.int64), pd.Index(right.source)
    terms, row = np.unique(left.term.to_numpy(str), return_inverse=True)
    p = np.tile(absent, (len(terms) + 1, 1))
    p[row, places.get_indexer(left.source)] = left.p.to_numpy(np.int64)
    # the last row stands for the tile's terms that no source of the two blocks has
    times = np.append(np.ones(len(terms), np.int64), right.tile_terms.iloc[0] - len(terms))[:, None]
    ours, theirs = np.flatnonzero(right.block == a), np.flatnonzero(right.block == b)
    q, out = p[:, theirs], [np.empty(0, np.int64)]
    for s in ours:
        d = p[:, [s]] - q
        out.append(((d * d) // q * times).sum(axis=0))
    return pd.DataFrame({"lang": lang, "source": np.repeat(names[ours], len(theirs)), "other": np.tile(names[theirs], len(ours)), "v": np.concatenate(out)})


def salted(rows: DataFrame, table: DataFrame, *columns: str) -> DataFrame:
    """rows joined with table by language; the table is repeated SALTS times, so that a language is many tasks."""
    copies = table.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(*columns), F.lit(SALTS))).join(copies, ["lang", "salt"]).drop("salt")


def heavy_sums(scratch: Scratch, heavy: DataFrame, groups: DataFrame, sources: int) -> DataFrame:
    """Partial sums of the tiles. A tile holds so many terms that its cells are bounded."""
    blocks = -(-sources // SOURCE_BLOCK)
    per_tile = max(1, TILE_CELLS // min(sources, 2 * SOURCE_BLOCK))
    every = F.sequence(F.lit(0), F.lit(blocks - 1))
    # each source goes to all tiles of its block with another, on either side; that with itself once
    pairs = F.concat(
        F.transform(every, lambda o: F.struct(F.col("block").alias("a"), o.alias("b"))),
        F.transform(F.filter(every, lambda o: o != F.col("block")), lambda o: F.struct(o.alias("a"), F.col("block").alias("b"))))

    def dealt(df: DataFrame) -> DataFrame:
        block = df.withColumn("block", F.pmod(F.xxhash64("source"), F.lit(blocks)).cast("int"))
        return block.withColumn("pair", F.explode(pairs)).withColumns({"a": F.col("pair.a"), "b": F.col("pair.b")}).drop("pair")

    tile = F.pmod(F.xxhash64("term"), F.ceil((F.col("n_terms") - F.col("n_light")) / per_tile))
    heavy = heavy.withColumn("tile", tile)
    tiles = scratch.save(heavy.filter("first").groupBy("lang", "tile").agg(F.count(F.lit(1)).alias("tile_terms")), "tiles")
    left = dealt(heavy.select("lang", "tile", "term", "source", "p"))
    right = dealt(salted(groups.select("lang", "source", "absent"), tiles, "source"))
    keys = ["lang", "a", "b", "tile"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(tile_sums, "lang string, source string, other string, v bigint")
    return found.select("lang", "source", "other", wide(F.col("v")).alias("v"))


def light_sums(light: DataFrame) -> DataFrame:
    """Corrections of pairs that share a rare term, from its posting list."""
    lists = light.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "absent")).alias("list"))
    pairs = F.flatten(F.transform("list", lambda s: F.transform("list", lambda t: F.struct(s.alias("s"), t.alias("t")))))
    each = lists.filter(F.size("list") > 1).select("lang", F.explode(pairs).alias("x")).filter("x.s.source <> x.t.source")
    p, o, q, z = (F.col(f"x.{n}") for n in ("s.p", "s.absent", "t.p", "t.absent"))
    v = wide(diverged(p, q)) - wide(diverged(p, z)) - wide(diverged(o, q)) + wide(diverged(o, z))
    return each.select("lang", F.col("x.s.source").alias("source"), F.col("x.t.source").alias("other"), v.alias("v"))


def against_all(rows: DataFrame, groups: DataFrame, *columns: str) -> DataFrame:
    """rows (lang, source, ...) beside all other sources of their language (other, far: the absent share there)."""
    others = groups.select("lang", F.col("source").alias("other"), F.col("absent").alias("far"))
    return salted(rows, others, "source", *columns).filter("source <> other")


def pair_values(scratch: Scratch, shares: DataFrame, groups: DataFrame, heavy: int, sources: int) -> DataFrame:
    """(lang, source, other, value) for all ordered pairs of sources of a language."""
    light = shares.filter(F.col("holders") <= heavy)
    base = against_all(groups.select("lang", "source", "absent", "n_light"), groups)
    base = base.select("lang", "source", "other", F.coalesce(wide(F.col("n_light")) * wide(diverged(F.col("absent"), F.col("far"))), wide(F.lit(0))).alias("v"))
    histogram = light.groupBy("lang", "source", "p", "absent").agg(F.count(F.lit(1)).alias("terms"))
    met = against_all(histogram, groups, "p")
    p, o, z, h = F.col("p"), F.col("absent"), F.col("far"), wide(F.col("terms"))
    ours = met.select("lang", "source", "other", (h * (wide(diverged(p, z)) - wide(diverged(o, z)))).cast("decimal(38,0)").alias("v"))
    theirs = met.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), (h * (wide(diverged(z, p)) - wide(diverged(z, o)))).cast("decimal(38,0)").alias("v"))
    parts = [base, ours, theirs, light_sums(light), heavy_sums(scratch, shares.filter(F.col("holders") > heavy), groups, sources)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.filter("source <> other").groupBy("lang", "source", "other").agg(F.sum("v").cast("bigint").alias("value"))


def audit(spark: SparkSession, docs: DataFrame, least_docs: int = 3, top: int = 200, heavy: int = 8) -> DataFrame:
    """lang, source, part, item, value, rank: of each group the divergence from every other source of its
    language (`pair`), and the terms in which it most exceeds the language, at most `top` (`term`).

    A language keeps the terms of at least least_docs of its documents; a term that more than `heavy` of its sources
    have is heavy.
    """
    scratch = Scratch(spark, "divergence")
    arrow_limits(spark)
    rows = docs.select(*[text_or_empty(c).cast("string").alias(c) for c in ("lang", "source", "text")])
    # dealt before they are added up: a task's own counts have no repeats to combine
    sent = rows.mapInArrow(count_terms, COUNT_SCHEMA).repartition("lang", "source", "term")
    counts = sent.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = scratch.save(counts, "counts")
    one = W.partitionBy("lang", "term")  # at most a row a source
    seen = counts.filter("term <> ''").select(
        "lang", "source", "term", "n", F.sum("docs").over(one).alias("docs"), F.sum("n").over(one).alias("all_n"),
        F.count(F.lit(1)).over(one).alias("holders"), (F.row_number().over(one.orderBy("source")) == 1).alias("first"))
    kept = scratch.save(seen.filter(F.col("docs") >= least_docs).drop("docs"), "kept")
    langs = kept.filter("first").groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_terms"), F.sum("all_n").alias("lang_n"), F.count_if(F.col("holders") <= heavy).alias("n_light"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.filter("term = ''").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    total = F.coalesce("total", F.lit(0).cast("bigint"))
    groups = scratch.save(groups.select("lang", "source", total.alias("total"), "n_terms", "lang_n", "n_light", share(F.lit(0), total, F.col("n_terms")).alias("absent")), "groups")
    sources = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 1
    shares = kept.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", "holders", "first", "n_terms", "n_light", "absent", share(F.col("n"), F.col("total"), F.col("n_terms")).alias("p"),
        share(F.col("all_n"), F.col("lang_n"), F.col("n_terms")).alias("q"))
    shares = scratch.save(shares, "shares")
    best = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_values(scratch, shares, groups, heavy, sources).select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value", F.row_number().over(best.orderBy(F.desc("value"), "other")).alias("rank"))
    # the limit on row_number is applied in each task before its shuffle, so that a group is at most `top` rows a task
    terms = shares.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), diverged(F.col("p"), F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    return pairs.unionByName(terms)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark, documents(spark, sf_dir))


ORACLE_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
x AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM x GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
own AS (SELECT lang, source, term, count(*) AS n FROM x JOIN kept USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
every AS (SELECT g.lang, g.source, k.term, coalesce(o.n, 0) AS n, k.n AS lang_n FROM g JOIN kept k USING (lang) LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
p AS (
  SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER w + count(*) OVER w)::HUGEINT AS p,
         1 + (1000000000::HUGEINT * (lang_n + 1)) // (sum(lang_n) OVER w + count(*) OVER w)::HUGEINT AS q
  FROM every WINDOW w AS (PARTITION BY lang, source)),
v AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(v.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN v ON v.lang = a.lang AND v.source = a.source AND v.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // q AS BIGINT) FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM parts)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
