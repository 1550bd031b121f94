"""Updates of a stored archive against full builds."""

import glob
import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from postweave.config import Config
from postweave.operators import search
from postweave.plans.stored import StoredArchive
from postweave.sources.mbox import RAW_SCHEMA

TABLES = ("messages", "reply_edges", "unresolved", "thread_index", "date_index", "subject_index", "author_index", "stats", "folders", "monthly")


def raw_rows(seed, lists=("a", "b", "c d"), n=24):
    """Replies to earlier and to later messages, repeated ids, quoted ids, plain subjects, self references, loops."""
    rng, out = random.Random(seed), []
    for name in lists:
        for pos in range(n):
            ids = [f"<m{max(0, pos + d)}@{name[0]}>" for d in (-1, -2, -7, 3, 11, 0)]
            own = f"<m{rng.choice([pos, pos, pos, pos, pos - 5])}@{name[0]}>"
            head = [f"Message-ID: {own}", f"From: P{pos % 7} <p{pos % 7}@x.org>", f"Subject: {rng.choice(['', 'Re: ', 'AW: '])}topic {rng.randint(0, 9)}", f"Date: {1 + pos % 28} Jan 2024 {pos % 24:02}:00:00 +0000"]
            if rng.random() < 0.5:
                head.append(f"In-Reply-To: {rng.choice([*ids, '<none@x>']).upper()}")
            body = f"text {pos}\n" + (f"> see {rng.choice(ids)}\n" if rng.random() < 0.25 else "")
            out.append((name, pos, "From x", "\n".join([*head, ""]).encode(), body.encode()))
    return out


def shown(store):
    found = {}
    for t in TABLES + (("tokens",) if store.config.linkquotes else ()):
        rows = store.read(t)
        found[t] = sorted(str(sorted(r.asDict().items())) for r in rows.collect())
    return found


def parts_of(rows, cuts, lo, hi):
    """Rows from one cut of each list up to the next, numbered from 0 as a new mailbox is."""
    return [(name, pos - cuts[name][lo], *rest) for name, pos, *rest in rows if cuts[name][lo] <= pos < cuts[name][hi]]


def test_updates_give_what_a_full_build_gives(spark, tmp_path):
    config = lambda: Config(discard_dup_msgids=False, monthly_index=True, searchbackmsgnum=9, msgsperfolder=10)
    rows, cuts = raw_rows(3), {"a": (0, 8, 16, 24), "b": (0, 14, 24, 24), "c d": (0, 24, 24, 24)}
    whole = StoredArchive(spark, f"file://{tmp_path}/whole", config())
    parts = StoredArchive(spark, f"file://{tmp_path}/parts", config())
    whole.build(spark.createDataFrame(rows, RAW_SCHEMA))
    parts.build(spark.createDataFrame(parts_of(rows, cuts, 0, 1), RAW_SCHEMA))
    for k in (1, 2):
        new = parts.update(spark.createDataFrame(parts_of(rows, cuts, k, k + 1), RAW_SCHEMA))
    assert new.count() == 8
    got, want = shown(parts), shown(whole)
    for t in want:
        assert got[t] == want[t], t


def test_an_update_touches_its_lists_alone_and_can_be_repeated(spark, tmp_path, monkeypatch):
    """With quoted ids and ids that come again. The first try fails halfway; nobody can open files of other lists."""
    config = lambda: Config(linkquotes=True, discard_dup_msgids=False, monthly_index=True)
    rows, cuts = raw_rows(8), {"a": (0, 12, 12), "b": (0, 12, 24), "c d": (0, 12, 12)}
    store = StoredArchive(spark, f"file://{tmp_path}/s", config())
    store.build(spark.createDataFrame(parts_of(rows, cuts, 0, 1), RAW_SCHEMA))
    others = [p for p in glob.glob(f"{tmp_path}/s/*/list_id=*/*.parquet") if "list_id=b" not in p]
    assert len(others) >= 2 * len(TABLES)
    kept = {p: open(p, "rb").read() for p in others}
    for p in others:
        os.remove(os.path.join(os.path.dirname(p), f".{os.path.basename(p)}.crc"))
        with open(p, "wb") as f:
            f.write(b"no parquet")
    more, real = spark.createDataFrame(parts_of(rows, cuts, 1, 2), RAW_SCHEMA), StoredArchive._write

    def failing(self, name, *args):
        if name == "date_index":
            raise RuntimeError("lost")
        real(self, name, *args)

    monkeypatch.setattr(StoredArchive, "_write", failing)
    with pytest.raises(RuntimeError):
        store.update(more)
    monkeypatch.setattr(StoredArchive, "_write", real)
    store.update(more)
    assert all(open(p, "rb").read() == b"no parquet" for p in others)
    for p, data in kept.items():
        with open(p, "wb") as f:
            f.write(data)
    whole = StoredArchive(spark, f"file://{tmp_path}/w", config())
    whole.build(spark.createDataFrame([r for r in rows if r[1] < 12 or r[0] == "b"], RAW_SCHEMA))
    got, want = shown(store), shown(whole)
    for t in want:
        assert got[t] == want[t], t


def test_a_list_whose_last_open_reply_is_answered_loses_its_part(spark, tmp_path):
    rows = [("a", 0, "From x", b"Message-ID: <1@a>\nIn-Reply-To: <2@a>\n", b"x\n"), ("b", 0, "From x", b"Message-ID: <1@b>\nIn-Reply-To: <9@b>\n", b"x\n")]
    store = StoredArchive(spark, f"file://{tmp_path}/s")
    store.build(spark.createDataFrame(rows, RAW_SCHEMA))
    assert store.read("unresolved").count() == 2
    store.update(spark.createDataFrame([("a", 0, "From x", b"Message-ID: <2@a>\n", b"y\n")], RAW_SCHEMA))
    assert [r.list_id for r in store.read("unresolved").collect()] == ["b"]
    assert [(r.parent_msgnum, r.child_msgnum) for r in store.read("reply_edges").collect()] == [(1, 0)]


def test_the_search_index_follows_updates(spark, tmp_path):
    """Equal to a look through all texts, after a build, updates (one failed at its end and repeated), a merge and a second build."""
    rows, cuts = raw_rows(6), {"a": (0, 8, 24), "b": (0, 24, 24), "c d": (0, 0, 24)}
    store = StoredArchive(spark, f"file://{tmp_path}/s", Config(discard_dup_msgids=False))

    def same(query):
        m = store.read("messages").withColumn("key", F.struct("list_id", "msgnum"))
        text = search.searchable_text(F.col("subject"), F.col("name"), F.col("email_addr"), F.col("body_text"))
        want = sorted((r.key.list_id, r.key.msgnum, r.score) for r in search.search_texts(m, "key", text, query).collect())
        assert sorted(tuple(r) for r in store.search(query).collect()) == want and want

    store.build(spark.createDataFrame(parts_of(rows, cuts, 0, 1), RAW_SCHEMA))
    same("topic 3")
    more, real = spark.createDataFrame(parts_of(rows, cuts, 1, 2), RAW_SCHEMA), StoredArchive._write

    def failing(name, *args):
        if name == "messages":
            raise RuntimeError("lost")
        real(store, name, *args)

    store._write = failing
    with pytest.raises(RuntimeError):
        store.update(more)
    del store._write
    store.update(more)
    assert store.index.blocks().select("generation").distinct().count() == 2
    same("text 12")
    store.index.merge(1)
    same("text 12")
    store.build(spark.createDataFrame(parts_of(rows, cuts, 0, 1), RAW_SCHEMA))
    same("topic 3")


def test_what_is_independent_runs_side_by_side(spark, tmp_path, monkeypatch):
    """In a build and in an update the search index and a sorted index wait for each other."""
    rows = [("a", k, "From x", f"Message-ID: <{k}@a>\nSubject: t\n".encode(), b"x\n") for k in range(2)]
    store, real, index, meet = StoredArchive(spark, f"file://{tmp_path}/s"), StoredArchive._write, StoredArchive._add_to_index, threading.Barrier(2, timeout=60)

    def write(self, name, *args):
        if name == "date_index":
            meet.wait()
        real(self, name, *args)

    def add(self, *args):
        meet.wait()
        index(self, *args)

    monkeypatch.setattr(StoredArchive, "_write", write)
    monkeypatch.setattr(StoredArchive, "_add_to_index", add)
    store.build(spark.createDataFrame(rows, RAW_SCHEMA))
    store.update(spark.createDataFrame([("a", 0, "From x", b"Message-ID: <9@a>\nIn-Reply-To: <1@a>\n", b"y\n")], RAW_SCHEMA))
    assert sorted(r.msgnum for r in store.read("date_index").collect()) == [0, 1, 2]
    assert store.read("thread_index").count() == 3
