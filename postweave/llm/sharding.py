"""Sharding: jump consistent hashing (Lamping and Veach) as one native expression.

The generator key * 2862933555777941757 + 1 (mod 2^64) is carried as two 32-bit halves, because
ANSI arithmetic has no wrapping product. The shard of a key depends on the key and on the number
of shards alone; one shard more takes rows only into itself.

Defined results: a null text has no bytes (size 16, CRC 0); a null doc_id counts as 0; rows
repeated with one doc_id share a shard, each with its own slot; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, documents, partitions, text_or_empty

# The multiplier of the published generator, in 32-bit halves.
MULTIPLIER = 2862933555777941757
M_HIGH, M_LOW = MULTIPLIER >> 32, MULTIPLIER & 0xFFFFFFFF
MASK = 0xFFFFFFFF
#: Jumps that are tried before the loop as long as the number of shards; H(n) are usual.
USUAL_JUMPS = 24


def _long(x: int) -> Column:
    return F.lit(x).cast("bigint")


def _jump(state: Column, n: int) -> Column:
    """One step of the loop; unchanged once j has reached n."""
    hi, lo = state["hi"], state["lo"]
    t0 = lo.bitwiseAND(_long(0xFFFF)) * _long(M_LOW)
    t1 = F.shiftrightunsigned(lo, 16) * _long(M_LOW)
    low = t0 + F.shiftleft(t1.bitwiseAND(_long(0xFFFF)), 16) + _long(1)
    k1 = F.shiftleft((F.shiftrightunsigned(hi, 16) * _long(M_LOW)).bitwiseAND(_long(0xFFFF)), 16) + hi.bitwiseAND(_long(0xFFFF)) * _long(M_LOW)
    high = F.shiftrightunsigned(low, 32) + F.shiftrightunsigned(t1, 16) + (lo * _long(M_HIGH)).bitwiseAND(_long(MASK)) + k1.bitwiseAND(_long(MASK))
    new_hi, new_lo = high.bitwiseAND(_long(MASK)), low.bitwiseAND(_long(MASK))
    done = state["j"] >= _long(n)
    # floor((b + 1) * 2^31 / ((key >> 33) + 1)), in doubles as published; capped: only j < n matters
    j = F.floor((state["j"] + 1).cast("double") * F.lit(float(1 << 31)) / (F.shiftrightunsigned(new_hi, 1) + 1).cast("double"))
    return F.when(done, state).otherwise(F.struct(
        state["j"].alias("b"), F.least(j, _long(1 << 40)).alias("j"), new_hi.alias("hi"), new_lo.alias("lo")))


def _run(start: Column, n: int, steps: int) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, lambda s, _: _jump(s, n))


def jump_hash(key: Column, shards: int) -> Column:
    """The shard, 0 to shards - 1, of a 64-bit key."""
    key = F.coalesce(key.cast("bigint"), _long(0))
    start = F.struct(_long(-1).alias("b"), _long(0).alias("j"), F.shiftrightunsigned(key, 32).alias("hi"), key.bitwiseAND(_long(MASK)).alias("lo"))
    if shards <= USUAL_JUMPS:
        return _run(start, shards, shards)["b"].cast("int")
    # j grows with each step: as many steps as shards always end the loop, and few rows need them
    usual = _run(start, shards, USUAL_JUMPS)
    return F.transform(F.array(usual), lambda s: F.when(s["j"] >= _long(shards), s["b"]).otherwise(_run(s, shards, shards)["b"]))[0].cast("int")


def with_slots(rows: DataFrame, group: str, parts: int) -> DataFrame:
    """Adds slot: gapless from 0 in each group.

    A group can hold a large share of all rows, so that it is ranked in parts: rows within a part,
    and parts by a running sum over (group, part) counts.
    """
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(parts)))
    counts = dealt.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(group, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rank = F.row_number().over(W.partitionBy(group, "_part").orderBy("doc_id", "size", "text_crc32"))
    return (dealt.withColumn("_rank", rank).join(offsets, [group, "_part"])
            .withColumn("slot", F.col("_before") + F.col("_rank") - 1).drop("_part", "_rank", "_before"))


def shard(spark: SparkSession, docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document.

    Texts are read once; what is shuffled is four numbers a row.
    """
    scratch = Scratch(spark, "shard")
    text = text_or_empty()
    doc_id = F.col("doc_id").cast("bigint")
    rows = docs.select(
        doc_id.alias("doc_id"), (F.octet_length(text) + 16).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = scratch.save(rows.select("*", jump_hash(F.col("doc_id"), shards).alias("shard"), jump_hash(F.col("doc_id"), shards + 1).alias("grown_shard")), "rows")
    return with_slots(rows, "shard", max(4, partitions(spark))).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("bigint").alias("slot"), "grown_shard")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark, documents(spark, sf_dir))
