import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from postweave.llm.sharding import jump_hash, shard

from .helpers import ODD, empty, odd


def jump(key, n):
    key, b, j = key & (2**64 - 1), -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & (2**64 - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash_is_the_published_one(spark):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), *range(2, 400), *[i * 2654435761 for i in range(400)]]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 7, 24, 25, 40, 1000):
        assert [r[1] for r in df.select("k", jump_hash(F.col("k"), n)).collect()] == [jump(k, n) for k in keys], n


def test_one_more_shard_moves_rows_only_there(spark):
    got = shard(spark, spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))).collect()
    moved = [r for r in got if r.shard != r.grown_shard]
    assert all(r.grown_shard == 40 for r in moved) and 30 < len(moved) < 130


def test_slots_sizes_and_odd_rows(spark):
    got = shard(spark, odd(spark)).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    want = sorted((str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in ODD)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == want
    assert shard(spark, empty(spark)).collect() == []
