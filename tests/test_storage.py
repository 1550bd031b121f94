"""Search index, page sink, header cache, id lines, SQL functions, mailbox stream."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from postweave.functions import register, text
from postweave.operators import search
from postweave.plans import sinks
from postweave.sources import archive as back
from postweave.streaming import ingest

TEXTS = ["The quick brown fox", "the QUICK, brown-fox jumps", "nothing here", "", None, "quick", "qu qu qu", "brown the fox quick"]


def test_block_postings_find_what_a_scan_finds(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_IDS", 4)
    docs = spark.createDataFrame([("s", i * (1 if i < 30 else 977), TEXTS[i % len(TEXTS)]) for i in range(60)], "scope string, id long, text string")
    index = search.SearchIndex(spark, f"file://{tmp_path}/ix", 8)
    want = {q: sorted((r.id, r.score) for r in search.search_texts(docs, "id", F.col("text"), q).collect()) for q in ("quick", "the fox", "zzz", "", "q", "brown")}
    index.add(docs.filter("id % 3 = 0"), F.col("text"), 0)
    index.add(docs.filter("id % 3 = 1"), F.col("text"), 1)
    for _ in range(2):  # an addition that is run again replaces its own
        index.add(docs.filter("id % 3 = 2"), F.col("text"), 2)
    for k in (None, 3):
        if k:
            index.merge(k)
        for q, hits in want.items():
            assert sorted((r.id, r.score) for r in index.search(q).collect()) == hits, (k, q)
    rows = index.blocks().select("bigram", F.explode(search.ids_of()).alias("id")).collect()
    assert len(rows) == len(set(rows)) == search.postings(docs, "id", F.col("text")).count()
    # buckets of other bigrams aren't opened
    bucket = spark.range(1).select(search._bucket(F.lit("zz"), 8)).first()[0]
    for p in glob.glob(f"{tmp_path}/ix/merged/3/*/bucket=*/*.parquet"):
        if f"bucket={bucket}/" not in p:
            os.remove(os.path.join(os.path.dirname(p), f".{os.path.basename(p)}.crc"))
            open(p, "wb").write(b"no parquet")
    assert index.search("zz").collect() == []


def test_a_long_block_gives_its_ids(spark):
    ids = [k * 3 + (k > 700) for k in range(2000)]
    block = spark.createDataFrame([(ids[0], [b - a for a, b in zip(ids, ids[1:])])], "first long, gaps array<int>")
    assert block.select(search.ids_of().alias("x")).first().x == ids
    assert spark.createDataFrame([(9, [])], "first long, gaps array<int>").select(search.ids_of().alias("x")).first().x == [9]


def test_many_blocks_give_their_ids_in_one_pass(spark):
    """Blocks as long as they get, and an addition deals a row for a bigram, not for each of its texts."""
    import numpy as np
    import pyarrow as pa

    blocks = spark.range(64).select(F.col("id").alias("first"), F.array_repeat(F.lit(1), search.BLOCK_IDS - 1).alias("gaps"))
    ids = search.ids_of()
    assert "aggregate" not in blocks.select(ids)._jdf.queryExecution().optimizedPlan().toString()
    last = blocks.select("first", F.element_at(ids, -1).alias("last")).collect()
    assert all(r.last == r.first + search.BLOCK_IDS - 1 for r in last)
    texts = pa.RecordBatch.from_pydict({"scope": ["a"] * 50 + ["b"] * 50, "id": np.arange(100), "kept": ["abc", "é🙂"] * 49 + ["", None]})
    out = next(search.partial_blocks(iter([texts]), 64)).to_pylist()
    assert [(r["bigram"], r["scope"], r["_range"], len(r["ids"])) for r in out if r["bigram"] == "é🙂"] == [("é🙂", "a", 0, 25), ("é🙂", "b", 0, 7), ("é🙂", "b", 1, 17)]
    assert len(out) == 9


def test_many_queries_find_what_each_finds(spark):
    """Queries of fewer and more bigrams than choose candidates; of a query's rarest all but one are asked for."""
    docs = spark.createDataFrame([(i, TEXTS[i % len(TEXTS)]) for i in range(40)], "id long, text string")
    asked = ["qu", "quick", "the quick brown fox jumps", "brown the fox quick", "zzz", "", "q"]
    found = search.search_many(docs, "id", F.col("text"), spark.createDataFrame(list(enumerate(asked)), "query_id int, query string"))
    assert "array<bigint>" in {t for _, t in found.sparkSession.range(1).select(search.bigram_codes(F.lit("ab"))).dtypes}
    want = {(i, r.id, r.score) for i, q in enumerate(asked) if len(q) > 1 for r in search.search_texts(docs, "id", F.col("text"), q).collect()}
    assert {tuple(r) for r in found.select("query_id", "id", "score").collect()} == want


def test_a_search_makes_the_kept_text_once(spark):
    docs = spark.createDataFrame([(1, "and the z")], "doc_id long, text string")
    plan = search.search_texts(docs, "doc_id", F.col("text"), "and the z")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1


def listed(root):
    return {os.path.relpath(p, root): open(p).read() for p in glob.glob(f"{root}/**/*.html", recursive=True)}


def test_pages_are_put_in_place_all_or_none(spark, tmp_path):
    root = str(tmp_path / "site")
    pages = spark.range(20).select(F.concat(F.lit("l/"), F.col("id").cast("string"), F.lit(".html")).alias("path"), F.concat(F.lit("v1 "), F.col("id").cast("string")).alias("html"))
    sinks.write_pages(pages, root)
    want = {f"l/{k}.html": f"v1 {k}" for k in range(20)}
    assert listed(root) == want
    # a run in which one task fails leaves no page of its own
    bad = pages.withColumn("html", F.when(F.col("path") == "l/13.html", F.raise_error(F.lit("lost")).cast("string")).otherwise("v2"))
    with pytest.raises(Exception):
        sinks.write_pages(bad, root)
    assert listed(root) == want and not [p for p in glob.glob(f"{root}/.staging/*/*") if p.endswith(".page")]
    sinks.write_pages(pages.withColumn("html", F.lit("v3")), root, overwrite=False)
    assert listed(root) == want


def test_a_run_killed_while_it_moves_files_is_finished_by_the_next(tmp_path, monkeypatch):
    base, real, seen = str(tmp_path), os.replace, []

    class Row(dict):
        pass

    import pyspark

    monkeypatch.setattr(pyspark.TaskContext, "get", classmethod(lambda cls: type("T", (), {"partitionId": lambda s: 0, "taskAttemptId": lambda s: 7})()))
    writer = sinks.PageWriter({"path": base}, False)
    message = writer.write([{"path": f"p{k}.html", "html": str(k)} for k in range(9)])

    def dying(a, b):
        if a.endswith(".page"):
            seen.append(a)
            if len(seen) == 4:
                raise KeyboardInterrupt
        real(a, b)

    monkeypatch.setattr(os, "replace", dying)
    with pytest.raises(KeyboardInterrupt):
        writer.commit([message, None])
    assert len(listed(base)) == 3
    monkeypatch.setattr(os, "replace", real)
    assert sinks.finish(base) == 6 and listed(base) == {f"p{k}.html": str(k) for k in range(9)}
    assert sinks.finish(base) == 0 and os.listdir(f"{base}/.staging") == []
    with pytest.raises(ValueError):
        writer.write([{"path": "../x.html", "html": ""}])


def test_header_cache_comes_back_and_its_dates_as_numbers_are_zero(spark, tmp_path):
    rows = [("a", 0, "Ann", "a@x", "Größe", "<1@x>", None, 1_700_000_000, 0), ("a", 3, None, None, "", "<2@x>", "<1@x>", 0, 4), ("b", 70_000, "B", "b@x", "s", None, None, 5, 0)]
    m = spark.createDataFrame(rows, "list_id string, msgnum int, name string, email_addr string, subject string, msgid string, inreplyto string, date long, is_deleted int")
    sinks.write_header_cache(m, f"file://{tmp_path}", "h.idx", 2)
    raw = (tmp_path / "a" / "h.idx").read_bytes()
    first = b"\0\0Ann\0a@x\0Gr\xc3\xb6\xc3\x9fe\0<1@x>\0\0\0" + b"1970-01-01T00:00:00Z\0" + b"2023-11-14T22:13:20Z\0" + b"0\0" * 2
    assert raw.startswith((0).to_bytes(4, "little") + len(first).to_bytes(4, "little") + first)
    assert raw.endswith((-1).to_bytes(4, "little", signed=True) + b"\1\0\0\0" + b"3" + b"delete_level\0" + b"\1\0\0\0" + b"2")
    found, ends = back.read_header_cache(spark, f"file://{tmp_path}/*/h.idx")
    got = sorted((r.msgnum, r.name, r.subject, r.inreplyto, r.date, r.is_deleted) for r in found.collect())
    assert got == [(0, "Ann", "Größe", None, 1_700_000_000, 0), (3, None, None, "<1@x>", 0, 4)]
    assert sorted(r.max_msgnum for r in ends.collect()) == [3, 70_000]
    assert {r.date for r in back.read_header_cache(spark, f"file://{tmp_path}/*/h.idx", True)[0].collect()} == {0}
    (tmp_path / "a" / "h.idx").write_bytes(raw[: len(raw) // 3])  # cut off within a record
    assert back.read_header_cache(spark, f"file://{tmp_path}/a/h.idx")[0].count() <= 1


def test_id_lines_of_a_repeated_run_are_written_once(spark, tmp_path):
    m = spark.createDataFrame([("<1>",), ("<2>",), (None,), ("<2>",)], "msgid string")
    for _ in range(2):
        sinks.append_msgids(m, f"file://{tmp_path}")
    assert sorted(r.value for r in spark.read.text(f"file://{tmp_path}/msgids").collect()) == ["Message-ID: <1>", "Message-ID: <2>"]


def test_native_functions_in_sql_text(spark):
    register.register(spark)
    texts = ["Mon, 1 Jan 2024 10:00:00 +0100", "Re: AW: see http://a.b/c <q@r.s> & 'x'", "> > quoted; a=b", "", None, "x" * 5000, "Subject: a\n b\nTo: c\n\nbody", "&#65;&#x;"]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    df.createOrReplaceTempView("texts")
    for name, (kind, f) in register.NATIVE.items():
        if kind == "STRING":
            assert spark.sql(f"SELECT {name}(x) AS v FROM texts").collect() == df.select(f(F.col("x")).alias("v")).collect(), name
    assert spark.sql("SELECT secs_to_iso(0L) AS v").first().v == "1970-01-01T00:00:00Z"
    assert register.sql_text(F.lit("and(<'(") == F.col("x")) == "`=`('and(<\\'(', x)"


def test_stream_takes_files_of_any_name_once_and_what_files_gain(spark, tmp_path):
    land, body = tmp_path / "land", "From a@b\nMessage-ID: <%s>\n\ntext\n"
    (land / "one").mkdir(parents=True)
    (land / "two").mkdir()

    def run(name):
        rows = ingest.mailbox_stream(spark, f"{land}/*/*.mbox").select("list_id", "pos", F.decode("headers", "UTF-8").alias("h"))
        rows.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
        return sorted((r.list_id, r.pos, r.h.strip()[13:-1]) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    (land / "one" / "m.mbox").write_text(body % "m1")
    assert run(0) == [("m", 0, "m1")]
    (land / "one" / "b.mbox").write_text(body % "b1" + body % "b2")
    assert run(1) == [("b", 0, "b1"), ("b", 1, "b2"), ("m", 0, "m1")]
    (land / "two" / "m.mbox").write_text(body % "other")  # the same base name elsewhere
    with open(land / "one" / "b.mbox", "a") as f:  # and a file that has grown
        f.write(body % "b3")
    want = [("b", 0, "b1"), ("b", 1, "b2"), ("b", 2, "b3"), ("m", 0, "m1"), ("m", 0, "other")]
    assert run(2) == want and run(3) == want
    (land / "one" / "m.mbox").unlink()
    assert run(4) == want


def test_addresses_are_found_where_runs_begin(spark):
    lines = ["a@b.com_x@c.de", "mail a.b@c.org, d@e.fr!", "@x.com", "a@b", "x" * 50 + "@y.zz z@" + "q" * 50]
    got = [r.v for r in spark.createDataFrame([(x,) for x in lines], "x string").select(text.spamify(F.col("x")).alias("v")).collect()]
    import re

    assert got == [re.sub(text.ADDRESS, r"\1_at_\2", x) for x in lines]
