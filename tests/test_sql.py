"""An archive through SQL text."""

import pytest
from pyspark.sql import functions as F

from postweave.operators import threads
from postweave.plans.sql import create_views


@pytest.fixture(scope="module")
def views(spark):
    rows = [("l", i, i, f"<{i}>", None if p is None else f"<{p}>", s, "n", "a@b", d, s) for i, p, s, d in (
        (0, None, "one", 1_700_000_000), (1, 0, "two", 1_700_000_100), (2, 1, "three", 0), (3, 0, None, 1_700_100_000), (4, None, "", 1_700_200_000))]
    rows += [("k", 0, 0, "<0>", None, "other", None, None, 1_700_000_000, "other")]
    m = spark.createDataFrame(rows, "list_id string, pos long, msgnum int, msgid string, inreplyto string, subject string, name string, email_addr string, date long, unre_subject string")
    edges = threads.header_edges(m)
    create_views(spark, {"messages": m, "reply_edges": edges, "thread_index": threads.thread_walk_general(m, edges)})
    return m


def test_walks(spark, views):
    walk = lambda sql: [tuple(r) for r in spark.sql(sql).collect()]
    assert walk("SELECT root, msgnum, depth FROM thread_walk('l') ORDER BY root, ord") == [(0, 0, 0), (0, 1, 1), (0, 2, 2), (0, 3, 1), (4, 4, 0)]
    assert walk("SELECT DISTINCT list_id FROM thread_walk() ORDER BY 1") == [("k",), ("l",)]
    assert walk("SELECT * FROM thread_walk('none')") == []
    assert walk("SELECT msgnum, depth, subject FROM thread_of('l', 2) ORDER BY ord") == [(0, 0, "one"), (1, 1, "two"), (2, 2, "three"), (3, 1, None)]
    assert walk("SELECT msgnum FROM thread_of('k', 7)") == []


def test_calls_for_each_row(spark, views):
    got = spark.sql("SELECT m.msgnum, r.msgnum AS child FROM messages m, LATERAL replies_to(m.list_id, m.msgnum) r WHERE m.list_id = 'l'").collect()
    assert sorted(tuple(r) for r in got) == [(0, 1), (0, 3), (1, 2)]
    counts = spark.sql("SELECT m.list_id, m.msgnum, count(r.seq) AS n FROM messages m LEFT JOIN LATERAL replies_to(m.list_id, m.msgnum) r GROUP BY ALL")
    assert sorted(tuple(r) for r in counts.collect()) == [("k", 0, 0), ("l", 0, 2), ("l", 1, 1), ("l", 2, 0), ("l", 3, 0), ("l", 4, 0)]


def test_ranges_of_dates(spark, views):
    sql = "SELECT msgnum FROM messages_between('l', 'Tue, 14 Nov 2023 00:00:00 +0000', '{}') ORDER BY 1"
    assert [r.msgnum for r in spark.sql(sql.format("Wed, 15 Nov 2023 00:00:00 +0000")).collect()] == [0, 1]
    assert [r.msgnum for r in spark.sql(sql.format("Fri, 1 Dec 2023 00:00:00 +0000")).collect()] == [0, 1, 3, 4]
    assert spark.sql(sql.format("no date")).collect() == []


def test_a_table_that_is_missing(spark, views):
    with pytest.raises(ValueError, match="thread_index"):
        create_views(spark, {"messages": views, "reply_edges": views})


def test_a_literal_list_reaches_the_scan(spark, tmp_path, views):
    from postweave.operators.ranking import written

    walk = spark.table("thread_index")
    create_views(spark, {"messages": views, "reply_edges": spark.table("reply_edges"), "thread_index": written(walk)})
    plan = spark.sql("EXPLAIN FORMATTED SELECT msgnum FROM thread_walk('l')").first()[0]
    assert "EqualTo(list_id,l)" in plan and "Exchange" not in plan


def test_undated_messages_of_one_page_are_many_pieces(spark, monkeypatch):
    """A month of messages without a date is numbered as by one sort of it."""
    from postweave.operators import indexes
    from postweave.operators.ranking import positions

    monkeypatch.setattr(indexes, "UNDATED", 7)
    m = spark.range(100).select(F.lit("l").alias("list_id"), F.lit("1970-01").alias("_stem"), (F.col("id") * 37 % 100).cast("int").alias("msgnum"),
                                F.when(F.col("id") % 9 == 0, F.col("id") * 50).otherwise(0).alias("date"), F.col("id").alias("pos"))
    for descending in (False, True):
        order = [F.col(c).desc() if descending else F.col(c) for c in ("date", "msgnum", "pos")]
        got = positions(m, ["list_id", "_stem"], order, indexes.date_pieces(), "ord", descending).select("ord", "date", "msgnum").collect()
        want = sorted(((r.date, r.msgnum) for r in got), reverse=descending)
        assert [(r.date, r.msgnum) for r in sorted(got)] == want and sorted(r.ord for r in got) == list(range(100))
