"""Operators on small stores, against loops."""

import random
import re

import pytest
from pyspark.sql import functions as F

from postweave.functions import text
from postweave.operators import dedup, filters, indexes, lines, ranking, search, threads

SCHEMA = "list_id string, pos long, msgnum int, msgid string, inreplyto string, subject string, name string, email_addr string, date long"


def store(spark, rows):
    full = [("l", i, i, r.get("msgid", f"<{i}@x>"), r.get("irt"), r.get("subject", f"s{i}"), r.get("name"), r.get("email"), r.get("date", i * 1000)) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).withColumn("unre_subject", text.unre(F.col("subject")))


def edges(df):
    return {(r.parent_msgnum, r.child_msgnum, r.kind) for r in df.collect()}


def loop_edges(rows, back):
    bare = lambda s: re.sub(r"(?i)^(\s*(re|fwd?|aw|ang|sv|vs|odp|antw)\s*[\[:\]>#]*\s*)+", "", s).strip()
    by_id = {r.get("msgid", f"<{i}@x>").strip().lower(): i for i, r in enumerate(rows)}
    out = set()
    for i, r in enumerate(rows):
        if r.get("irt") is not None:
            p = by_id.get(r["irt"].strip().lower())
            if p is not None and r["irt"].strip():
                out.add((p, i, "header"))
            continue
        s, u = r.get("subject", f"s{i}"), bare(r.get("subject", f"s{i}"))
        if not u or len(u) >= len(s):
            continue
        near = [j for j in range(max(0, i - back), i) if bare(rows[j].get("subject", f"s{j}")).lower() == u.lower()]
        first = [j for j in near if bare(rows[j].get("subject", f"s{j}")) == rows[j].get("subject", f"s{j}")]
        if near:
            out.add(((first or near)[0], i, "subject"))
    return out


@pytest.mark.parametrize("back", [3, 500])
def test_reply_edges_match_the_loop(spark, back):
    rng, rows = random.Random(back), []
    for i in range(400):
        s = rng.choice(("", "Re: ", "AW: re: ", "FWD:")) + rng.choice(("Topic", "topic", "Other", "Request", "Ångström", ""))
        r = {"subject": s}
        if rng.random() < 0.4:
            r["irt"] = rng.choice((f" <{rng.randrange(450)}@X> ", "", "<none>", f"<{i}@x>"))
        rows.append(r)
    assert edges(threads.reply_edges(store(spark, rows), look_back=back)) == loop_edges(rows, back)


def test_look_back_crosses_ranges(spark):
    df = spark.range(25_000).select(F.lit("l").alias("list_id"), F.col("id").alias("pos"), F.col("id").cast("int").alias("msgnum"), F.concat(F.lit("<"), "id", F.lit(">")).alias("msgid"),
                                    F.lit(None).cast("string").alias("inreplyto"), F.when(F.col("id").isin(9_990, 19_400), "Deep").when(F.col("id").isin(10_100, 10_491, 19_899, 19_901), "Re: Deep").otherwise(F.concat(F.lit("n"), "id")).alias("subject"))
    assert edges(threads.subject_edges(df)) == {(9_990, 10_100, "subject"), (10_100, 10_491, "subject"), (19_400, 19_899, "subject"), (19_899, 19_901, "subject")}


def test_quoted_edges(spark):
    m = store(spark, [{}, {}, {}])
    body = spark.createDataFrame([("l", 1, 0, "see <0@x> and <1@x> <0@X>", False), ("l", 2, 0, "<0@x>", True)], "list_id string, msgnum int, line_no int, line string, attached boolean")
    assert edges(threads.quoted_edges(m, body)) == {(0, 1, "quoted")}


def walk(df):
    return [(r.root, r.msgnum, r.depth, r.shown) for r in df.orderBy("root", "ord").collect()]


def test_thread_walks(spark):
    m = store(spark, [{}, {"irt": "<0@x>"}, {"irt": "<0@x>"}, {"irt": "<1@x>"}, {}, {"irt": "<4@x>"}])
    e = threads.reply_edges(m)
    want = [(0, 0, 0, True), (0, 1, 1, True), (0, 3, 2, False), (0, 2, 1, True), (4, 4, 0, True), (4, 5, 1, True)]
    assert walk(threads.thread_walk(spark, m, e, 1)) == want and walk(threads.thread_walk_general(m, e, 1)) == want


def test_cycles_are_walked_once(spark):
    m = store(spark, [{"irt": "<2@x>", "date": 50}, {"irt": "<0@x>"}, {"irt": "<1@x>"}, {"irt": "<3@x>"}, {"irt": "<2@x>"}])
    got = walk(threads.thread_walk_general(m, threads.reply_edges(m)))
    assert sorted(x[1] for x in got) == [0, 1, 2, 3, 4] and [x for x in got if x[0] == 0][:3] == [(0, 0, 0, True), (0, 1, 1, True), (0, 2, 2, True)]


def test_deep_thread(spark):
    m = store(spark, [{"irt": f"<{i - 1}@x>"} if i else {} for i in range(105)])
    got = threads.thread_walk(spark, m, threads.reply_edges(m))
    assert got.count() == 105 and got.agg(F.max("depth")).first()[0] == 104 and got.filter("shown").count() == 51


def test_deep_chain_and_wide_tree(spark):
    """A chain far deeper than a recursion goes, a root with many children, and cycles beside them."""
    n = 2600
    rows = [{"irt": f"<{i - 1}@x>"} if 0 < i < n else {"irt": f"<{n}@x>"} if n < i < n + 300 else {} for i in range(n + 300)]
    rows += [{"irt": f"<{n + 301}@x>"}, {"irt": f"<{n + 300}@x>"}, {"irt": f"<{n + 302}@x>"}]  # two that reply to each other, one to itself
    m = store(spark, rows)
    got = {r.msgnum: (r.root, r.depth, r.ord) for r in threads.thread_walk(spark, m, threads.header_edges(m)).collect()}
    want = {i: (0, i, i) for i in range(n)} | {n: (n, 0, 0)} | {n + k: (n, 1, k) for k in range(1, 300)}
    assert got == want
    general = {r.msgnum: (r.root, r.depth, r.ord) for r in threads.thread_walk_general(m, threads.header_edges(m)).collect()}
    assert {k: v for k, v in general.items() if k < n + 300} == want and general[n + 300] == (n + 300, 0, 0) and general[n + 301] == (n + 300, 1, 1) and general[n + 302] == (n + 302, 0, 0)


def test_components_of_a_long_chain(spark):
    m = store(spark, [{"irt": f"<{i - 1}@x>"} if i % 400 else {} for i in range(800)])
    assert {r.component for r in threads.components(m, threads.header_edges(m)).collect()} == {0, 400}


def test_text_order_without_known_pieces(spark):
    """Subjects that all begin alike are ranked as a sort would, both ways, nulls and ties included."""
    m = store(spark, [{"subject": f"[list] topic {i * 7 % 13}" if i % 9 else None} for i in range(300)])
    rows = sorted(((r.subject or "").lower(), r.msgnum) for r in m.collect())
    assert order(indexes.subject_index(m)) == [n for _, n in rows] and order(indexes.subject_index(m, True)) == [n for _, n in reversed(rows)]


def test_first_by_msgid(spark):
    rows = [{"msgid": x} for x in ("<a>", "<A> ", "", " ", "<b>", "<a>")]
    got = dedup.first_by_msgid(store(spark, rows))
    assert sorted(r.pos for r in got.collect()) == [0, 2, 3, 4]
    kept = spark.createDataFrame([("l", "<b>")], "list_id string, msgid_key string")
    assert sorted(r.pos for r in dedup.first_by_msgid(store(spark, rows), kept).collect()) == [0, 2, 3]


def order(df):
    return [r.msgnum for r in df.orderBy("ord").collect()]


def test_indexes(spark):
    rng = random.Random(1)
    rows = [{"date": rng.choice((0, 5, 10**9 + rng.randrange(10**8))), "subject": rng.choice(("Re: b", "B", "a", "Zé", "é")), "name": rng.choice((None, "Al", "bo")), "email": "e@x"} for _ in range(200)]
    m = store(spark, rows)
    bare = [re.sub("^Re: ", "", r["subject"]).lower() for r in rows]
    keys = {indexes.date_index: lambda i: (rows[i]["date"], i), indexes.subject_index: lambda i: (bare[i], i), indexes.author_index: lambda i: ((rows[i]["name"] or "e@x").lower(), i)}
    for f, k in keys.items():
        want = sorted(range(200), key=k)
        assert order(f(m)) == want and order(f(m, reverse=True)) == want[::-1]


def test_folders_and_stats(spark):
    m = indexes.with_folder(store(spark, [{"date": 0}, {"date": 1705320000}, {"date": 1705320000}, {"date": 1e9.__int__()}]), folder_by_date="%Y/%m")
    assert [(r.folder, r.rel_path_to_top) for r in m.orderBy("msgnum").collect()] == [(None, ""), ("2024/01", "../../"), ("2024/01", "../../"), ("2001/09", "../../")]
    assert [(r.folder, r.n_messages) for r in indexes.folder_stats(m).collect()] == [("", 1), ("2001/09", 1), ("2024/01", 2)]
    assert indexes.latest_folder(m).first().latest_folder == "2024/01"
    s = indexes.archive_stats(m).first()
    assert (s.first_date, s.last_date, s.n_messages) == (0, 1705320000, 4)
    assert indexes.largest_msgnum(m.filter("false")).first()[0] == -1
    assert {r.month for r in indexes.monthly(m, True).collect()} == {"1970-01", "2001-09", "2024-01"}


def test_positions_of_large_groups(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise("cold").alias("g"), F.col("id"))
    got = ranking.positions(df, ["g"], [F.col("id").desc()], F.floor(F.col("id") / 50), "k", descending=True).collect()
    for g in ("hot", "cold"):
        assert [r.id for r in sorted((r for r in got if r.g == g), key=lambda r: r.k)] == sorted((r.id for r in got if r.g == g), reverse=True)
        assert sorted(r.k for r in got if r.g == g) == list(range(sum(r.g == g for r in got)))


def test_verdicts(spark):
    head = "headers array<struct<name:string,value:string>>"
    rows = [([("x-no-archive", "YES")], "a", 5), ([("expires", "1 Jan 2000 00:00:00 +0000")], "a", 5), ([("subject", "spam")], "a", 5), ([("subject", "ok")], "zap\nx", 5), ([], "a", 0), ([], "a", 50), ([("subject", "ok")], "a", 20)]
    df = spark.createDataFrame([(i, h, b, d) for i, (h, b, d) in enumerate(rows)], f"n int, {head}, body string, d long")
    v = lambda r: [x.m for x in df.select("n", filters.verdict(r, F.col("n"), F.col("headers"), F.col("body"), F.col("d")).alias("m")).orderBy("n").collect()]
    assert v(filters.Rules(now=10**9, filter_out=("subject: spam", "["), filter_out_full_body=("^zap$",), delete_older=10, delete_newer=30, delete_msgnum=(6,))) == [1 + 16, 2 + 16, 4 + 16, 4 + 16, 0, 32, 1]
    assert v(filters.Rules(deleted=(), filter_require=("^ok$",), filter_require_full_body=("a",))) == [8, 8, 8, 0 if "a" in "zap" else 8, 8, 8, 0]
    assert v(filters.Rules(deleted=(), filter_require=("(",))) == [8] * 7 and not filters.usable("x" * 600)
    empty = spark.range(1).select(filters.all_matched(F.array().cast("array<boolean>")).alias("m")).first().m
    assert empty


def test_lines(spark):
    m = spark.createDataFrame([("l", 1, "> a\n> b\n|c\ntext\n-- \nme http://x.y\n[Attachment: f]\n"), ("l", 2, "")], "list_id string, msgnum int, body_text string")
    body = lines.explode_lines(m)
    assert body.count() == 7 and body.filter("attached").count() == 1
    assert lines.quoted_percent(body).first().quoted_percent == 50
    assert [r.p for r in m.select(lines.quoted_percent_of(F.col("body_text")).alias("p")).collect()] == [50, 0]
    assert lines.usual_quote_prefix(body).first().quote_prefix == "> "
    shown = {r.line_no: r for r in lines.render_lines(body, 2).collect()}
    assert shown[0].css == "hm-quote-1" and shown[4].css == "hm-sig" and shown[5].css == "hm-sig-text" and shown[6].html == "[Attachment: f]"
    runs = sorted((r.run, r.css, r.n_lines) for r in lines.coalesce_runs(lines.render_lines(body, 2)).collect())
    assert [x[1:] for x in runs] == [("hm-quote-1", 2), ("hm-pg", 2), ("hm-sig", 1), ("hm-sig-text", 1), ("hm-attachment", 1)]


def test_search(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Hello World"), (2, "help!"), (3, ""), (4, "HELLO")], "k int, t string")
    index = search.postings(docs, "k", F.col("t"))
    assert [(r.k, r.score) for r in search.search(index, "k", "hello").collect()] == [(1, 4), (4, 4)]
    assert search.search(index, "k", "h").collect() == [] and search.query_bigrams("ab ab") == ["ab", "b ", " a"] or sorted(search.query_bigrams("ab ab")) == [" a", "ab", "b "]
    path = f"{tmp_path}/index"
    search.store(index, path, 8)
    found = search.stored(spark, path, "hello", 8)
    assert [(r.k, r.score) for r in search.search(found, "k", "hello").collect()] == [(1, 4), (4, 4)]
    assert "bucket" in found._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:80]
    assert [(r.k, r.score) for r in search.search_texts(docs, "k", F.col("t"), "hello").collect()] == [(1, 4), (4, 4)] and search.search_texts(docs, "k", F.col("t"), "h").collect() == []
    many = search.search_many(docs, "k", F.col("t"), spark.createDataFrame([(1, "hello")], "query_id int, query string"))
    assert {(r.k, r.score) for r in many.collect()} == {(1, 4), (4, 4)}
