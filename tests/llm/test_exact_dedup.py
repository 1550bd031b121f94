import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from postweave.llm.common import Scratch
from postweave.llm.exact_dedup import DigestIndex, dedup, digests

from .helpers import ODD, empty, odd

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256((text or "").translate(FOLD).encode()).hexdigest()


def test_groups_and_survivors(spark):
    rows = [(i, f"Text {i % 7}" if i % 3 else f"tExT {i % 7}") for i in range(200)] + [(500, "É"), (501, "é"), (502, None), (503, "")]
    got = {r.doc_id: r for r in dedup(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    groups = defaultdict(list)
    for i, t in rows:
        groups[sha(t)].append(i)
    for i, t in rows:
        own = groups[sha(t)]
        assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (max(own), len(own), i == max(own), sha(t))
    assert got[500].kept and got[501].kept and not got[502].kept


def test_odd_rows(spark):
    got = dedup(spark, odd(spark)).collect()
    assert len(got) == len(ODD)
    assert sum(r.kept for r in got if r.doc_id == 8) == 1 and not any(r.kept for r in got if r.doc_id == 1)
    kept = sorted(r.text_sha256 for r in got if r.kept)
    assert kept == sorted({sha(t) for _, t, *_ in ODD})  # exactly one row of equal texts
    assert dedup(spark, empty(spark)).collect() == []


def test_index_persists_and_anti_joins(spark):
    scratch = Scratch(spark, "t")
    index = DigestIndex(spark, f"i_{scratch.tag}", scratch.path("index"), "first", 4)
    first = digests(spark.createDataFrame([(1, "a"), (2, "b"), (3, "A")], "doc_id long, text string"))
    index.add(first)
    again = DigestIndex(spark, index.table, index.path, "second", 4)
    again.add(digests(spark.createDataFrame([(9, "a"), (8, "c")], "doc_id long, text string")))
    assert {(r.digest, r.keep_id) for r in again.entries().collect()} == {(sha("a"), 3), (sha("b"), 2), (sha("c"), 8)}
    plan = first.groupBy("digest").agg(F.max("doc_id")).join(again.entries().hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan


def test_one_of_repeated_rows_stays(spark):
    cases = {((5, "same text"), (5, "Same text"), (5, "same text")): 1, ((5, "aaa"), (5, "bbb"), (9, "aaa")): 2, ((2**63 - 1, "x"), (-2**63, "X"), (None, "x"), (None, "x")): 1, ((None, "y"), (None, "Y")): 1}
    for rows, n in cases.items():
        got = dedup(spark, spark.createDataFrame(list(rows), "doc_id long, text string")).collect()
        assert len(got) == len(rows) and sum(r.kept for r in got) == n
        for r in got:
            same = [i for i, t in rows if sha(t) == r.text_sha256]
            assert r.group_size == len(same) and r.keep_id == max((i for i in same if i is not None), default=None)
            assert not r.kept or r.doc_id == r.keep_id


def test_a_later_run_keeps_only_what_is_new(spark):
    scratch = Scratch(spark, "t")
    index = DigestIndex(spark, f"i_{scratch.tag}", scratch.path("index"), "first", 4)
    batch = digests(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string"))
    index.add(batch)
    DigestIndex(spark, index.table, index.path, "second", 4).add(batch)
    assert index.entries().count() == 2 and {r.run for r in index.entries().collect()} == {"first"}


def test_an_index_goes_on(spark):
    scratch = Scratch(spark, "t")
    rows = lambda *x: spark.createDataFrame(list(x), "doc_id long, text string")
    index = lambda run: DigestIndex(spark, f"go_{scratch.tag}", scratch.path("go"), run, 4)
    first = dedup(spark, rows((1, "a"), (2, "A"), (3, "b")), index=index("x")).collect()
    assert {(r.doc_id, r.kept, r.keep_id) for r in first} == {(1, False, 2), (2, True, 2), (3, True, 3)}
    again = dedup(spark, rows((2, "A"), (9, "a"), (10, "c"), (10, "c")), index=index("y")).collect()
    assert sorted((r.doc_id, r.keep_id) for r in again) == [(2, 2), (9, 2), (10, 10), (10, 10)] and [r.doc_id for r in again if r.kept] == [10]
