"""Reply edges of a stream against the batch."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from postweave.operators import threads
from postweave.streaming import replies

SCHEMA = "list_id string, pos bigint, msgnum int, msgid string, inreplyto string, arrived timestamp, _key string"
START = datetime(2024, 1, 1)


def landed(spark, tmp_path, parts, ttl="10 days"):
    """Each part is landed and then taken in by a run of its own."""
    land, root = f"file://{tmp_path}/land", f"file://{tmp_path}/answers"
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{land}/{k}")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{land}/*")
        replies.ingest_edges(spark, stream, root, f"file://{tmp_path}/cp", ttl).awaitTermination()
    return root


def test_late_parents_give_the_edges_of_the_batch(spark, tmp_path):
    """Any order of arrival, repeated ids, self references, odd ids, a hot parent; at the end a row that moves time on."""
    rng, rows = random.Random(2), []
    for pos in range(90):
        name = "ab"[pos % 2]
        own = rng.choice([f"<m{pos}@x>", f"<m{pos}@x>", f" <M{max(0, pos - 4)}@X>", None, ""])
        to = rng.choice([None, "", "<none@x>", f"<m{rng.randrange(90)}@x>", f"<m{pos}@x>", "<m7@x>"])
        rows.append((name, pos, pos, own, to))
    rows.append(("b", 90, 90, "<m7@x>", None))
    rng.shuffle(rows)
    parts = [[(*r, START + timedelta(hours=k), "clash") for r in rows[k::3]] for k in range(3)]
    tick = [("", 0, 0, None, None, START + timedelta(days=40), None)]
    root = landed(spark, tmp_path, [*parts, tick])
    batch = spark.createDataFrame([r for p in parts for r in p], SCHEMA)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(replies.edges_of(spark, root)) == key(threads.header_edges(batch))
    want = threads.unresolved_replies(batch).select("list_id", "msgnum", "inreplyto")
    assert key(replies.expired_of(spark, root)) == key(want)
    assert sum(r.n_expired for r in replies.expired_counts(spark, root).collect()) == want.count() > 0


def test_what_comes_after_its_time_has_expired(spark, tmp_path):
    at = lambda day: START + timedelta(days=day)
    parts = [[("a", 0, 0, "<0@x>", "<1@x>", at(0), None), ("a", 5, 5, "<5@x>", "<6@x>", at(0), None)],
             [("a", 6, 6, "<6@x>", None, at(9), None)],
             [("a", 1, 1, "<1@x>", None, at(11), None)],
             [("", 0, 0, None, None, at(40), None)]]
    root = landed(spark, tmp_path, parts)
    assert [(r.parent_msgnum, r.child_msgnum) for r in replies.edges_of(spark, root).collect()] == [(6, 5)]
    assert [tuple(r) for r in replies.expired_of(spark, root).collect()] == [("a", 0, "<1@x>")]


def test_no_rows_and_no_time(spark, tmp_path):
    land = f"file://{tmp_path}/land"
    spark.createDataFrame([], SCHEMA).write.parquet(land)
    run = lambda: replies.ingest_edges(spark, spark.readStream.schema(SCHEMA).parquet(land), f"file://{tmp_path}/answers", f"file://{tmp_path}/cp")
    run().awaitTermination()
    spark.createDataFrame([("a", 0, 0, "<0@x>", None, None, None)], SCHEMA).write.mode("append").parquet(land)
    with pytest.raises(Exception, match="time of arrival"):
        run().awaitTermination()
