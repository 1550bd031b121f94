"""Sources, whole builds, updates, sinks, streaming, options."""

import os

import pytest
from pyspark.sql import functions as F

from postweave import config
from postweave.functions.register import register
from postweave.operators.lines import explode_lines
from postweave.plans import archive, render, sinks, site
from postweave.plans.messages import parse_messages
from postweave.sources import archive as back
from postweave.sources import locale, mbox
from postweave.streaming import ingest

SIMPLE = """From alice@example.com Mon Jan 15 12:00:00 2024
From: Alice <alice@example.com>
Subject: Hello World
Date: Mon, 15 Jan 2024 12:00:00 +0000
Message-ID: <msg001@example.com>

Hi all.
>From the start.
From bob@example.com Tue Jan 16 12:00:00 2024
From: Bob <bob@example.com>
Subject: Re: Hello World
Date: Tue, 16 Jan 2024 12:00:00 +0000
Message-ID: <msg002@example.com>
In-Reply-To: <msg001@example.com>

> Hi all.
Hi.
From carol@example.com Wed Jan 17 12:00:00 2024
From: Carol <carol@example.com>
Subject: Test
Date: Wed, 17 Jan 2024 12:00:00 +0000
Message-ID: <msg003@example.com>

[Attachment: x.pdf]
"""


@pytest.fixture
def box(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "simple.mbox").write_text(SIMPLE)
    return str(tmp_path / "in")


def rows(df):
    return sorted((r.list_id, r.pos, r.from_line, bytes(r.headers), bytes(r.body)) for r in df.collect())


def test_both_readers_agree(spark, box):
    with open(f"{box}/odd.mbox", "wb") as f:
        f.write(b"no envelope\r\nA: b\r\n\r\nx\xe9\r\nFrom \xe9 y\r\n\r\nonly a body\r\nFrom z z\nHead: only")
    register(spark)
    exact = spark.read.format("mbox").load(box)
    assert rows(mbox.read_mailboxes(spark, f"file://{box}")) == rows(exact)
    got = [r for r in rows(exact) if r[0] == "odd"]
    assert [(r[3], r[4]) for r in got] == [(b"A: b\n", b"x\xe9\n"), (b"", b"only a body\n"), (b"Head: only", b"")]
    quoted = spark.read.format("mbox").option("format", "mboxrd").load(box)
    assert b"\nFrom the start." in rows(quoted)[-3][4] and b">From the start." in [r for r in rows(exact) if r[0] == "simple"][0][4]


def test_limits():
    assert len(list(mbox.read_messages(iter([b"From a b\n", b"x\n", b"From \n", b"From c d\n"])))) == 2
    with pytest.raises(ValueError):
        list(mbox.read_messages(iter([b"From a b\n", b"x" * 50 + b"\n"]), max_line=20))
    with pytest.raises(ValueError):
        list(mbox.read_messages(iter([b"From a b\n"] + [b"xxxx\n"] * 50), max_message=100))


def test_build(spark, box):
    tables = archive.build_archive(spark, box, config.Config(monthly_index=True, yearly_index=True, linkquotes=True))
    m = {r.msgnum: r for r in tables["messages"].collect()}
    assert [(m[i].name, m[i].email_addr, m[i].subject, m[i].date) for i in range(3)] == [
        ("Alice", "alice@example.com", "Hello World", 1705320000), ("Bob", "bob@example.com", "Re: Hello World", 1705406400), ("Carol", "carol@example.com", "Test", 1705492800)]
    assert [(r.parent_msgnum, r.child_msgnum) for r in tables["reply_edges"].collect()] == [(0, 1)]
    assert [r.msgnum for r in tables["attachment_index"].collect()] == [2] and tables["monthly"].count() == 1
    assert sorted((r.root, r.msgnum, r.depth) for r in tables["thread_index"].collect()) == [(0, 0, 0), (0, 1, 1), (2, 2, 0)]
    with pytest.raises(ValueError):
        archive.build_archive(spark, box, config.Config(folder_by_date="%Y", msgsperfolder=5))


def test_gates_and_options(spark, box):
    raw = mbox.read_mailboxes(spark, box)
    doubled = raw.unionByName(raw.withColumn("pos", F.col("pos") + 3))
    assert sorted((r.msgnum, r.pos) for r in parse_messages(doubled).collect()) == [(0, 0), (1, 1), (2, 2)]
    assert parse_messages(doubled, config.Config(discard_dup_msgids=False)).count() == 6
    assert parse_messages(raw, config.Config(readone=True)).count() == 1
    got = parse_messages(raw, config.Config(filter_out=("^subject: Test$",), startmsgnum=5)).orderBy("pos").collect()
    assert [(r.msgnum, r.is_deleted) for r in got] == [(5, 0), (6, 0), (7, 4)]


def test_update(spark, box, tmp_path):
    state = f"file://{tmp_path}/state"
    archive.save_state(archive.build_archive(spark, box)["messages"], state)
    new = tmp_path / "new"
    new.mkdir()
    (new / "simple.mbox").write_text(SIMPLE.replace("msg001", "msg009").replace("Re: Hello World", "Re: Test").replace("In-Reply-To: <msg009@example.com>\n", ""))
    tables, fresh = archive.update_archive(spark, str(new), state, config.Config(increment=1))
    assert [(r.msgnum, r.msgid) for r in fresh.collect()] == [(3, "<msg009@example.com>")]
    assert sorted(r.msgnum for r in tables["messages"].collect()) == [0, 1, 2, 3]
    known = mbox.read_mailboxes(spark, box)
    assert archive.update_mode(known, back.read_state(spark, state), -1) == "full"
    assert archive.update_mode(mbox.read_mailboxes(spark, str(new)), back.read_state(spark, state), -1) == "append"


def test_pages_and_files(spark, box, tmp_path):
    tables = archive.build_archive(spark, box)
    pages = render.articles(tables["messages"], tables["body_lines"], tables["reply_edges"], config.Config())
    sinks.write_pages(pages, str(tmp_path / "out"))
    page = (tmp_path / "out" / "simple" / "0000.html").read_text()
    assert 'href="0001.html"' in page and "alice_at_example.com" in page and "&gt;From the start." in page and '<article id="msg0">' in page
    gone = tables["messages"].withColumn("is_deleted", F.lit(1))
    for level, n in ((0, 0), (1, 3), (3, 3)):
        assert render.articles(gone, tables["body_lines"], tables["reply_edges"], config.Config(delete_level=level)).count() == n
    with pytest.raises(Exception):
        sinks.write_pages(pages.withColumn("path", F.lit("../../evil")), str(tmp_path / "out"))
    sinks.write_search(tables["messages"], f"file://{tmp_path}/s")
    assert "0|Hello World Alice alice@example.com Hi all." in " ".join(r.value for r in spark.read.text(f"file://{tmp_path}/s/search").collect())
    sinks.write_overview(render.overview_xml(tables["messages"]), f"file://{tmp_path}/s")
    sinks.append_msgids(tables["messages"], f"file://{tmp_path}/s")
    assert spark.read.text(f"file://{tmp_path}/s/msgids").count() == 3
    index = sinks.message_index_lines(tables["messages"], F.col("msgid"))
    index.select("value").coalesce(1).write.text(f"file://{tmp_path}/ix")
    assert {r.msgnum: r.name for r in back.read_message_index(spark, f"file://{tmp_path}/ix").collect()} == {0: "<msg001@example.com>", 1: "<msg002@example.com>", 2: "<msg003@example.com>"}
    sinks.write_tables({"stats": tables["stats"], "messages": tables["messages"]}, f"file://{tmp_path}/t")
    assert spark.read.parquet(f"file://{tmp_path}/t/messages").count() == 3
    sinks.link_latest(str(tmp_path), "latest", "out")
    assert os.path.islink(tmp_path / "latest") and not sinks.is_empty_archive(str(tmp_path)) and sinks.is_empty_archive(str(tmp_path / "none"))
    with pytest.raises(ValueError):
        sinks.link_latest(str(tmp_path), "latest", "../x")
    with sinks.locked(str(tmp_path)), pytest.raises(OSError), sinks.locked(str(tmp_path)):
        pass


def test_site(spark, box, tmp_path):
    c = config.Config(writehaof=True, nonsequential=True, label="My <list>")
    site.write_archive(archive.build_archive(spark, box, c), str(tmp_path / "site"), c)
    home = tmp_path / "site" / "simple"
    assert "My &lt;list&gt;" in (home / "index.html").read_text() and 'class="depth-1"' in (home / "index.html").read_text()
    assert {"index.html", "date.html", "subject.html", "author.html", "attachment.html"} < set(os.listdir(home)) and len(os.listdir(home)) == 8
    with sinks.locked(str(tmp_path / "site")), pytest.raises(OSError):
        site.write_archive(archive.build_archive(spark, box, c), str(tmp_path / "site"), c)
    assert "3 Messages" in (home / "date.html").read_text() and (tmp_path / "site" / "msgindex").is_dir() and (tmp_path / "site" / "overview").is_dir()


def test_one_page_of_folders(spark):
    """However many folders a list has, its page has them all."""
    folders = spark.range(1200).select(F.lit("l").alias("list_id"), F.col("id").cast("string").alias("folder"), F.lit(2).alias("n_messages"), F.lit(1).alias("first_date"), F.lit(9).alias("last_date"))
    stats = spark.createDataFrame([("l", 1, 9, 2400)], "list_id string, first_date long, last_date long, n_messages long")
    page = site.folders_pages(folders, stats, config.Config(gmtime=True)).collect()
    assert [p.path for p in page] == ["l/folders.html"] and page[0].html.count("<li>") == 1200


def test_templates_reach_the_pages(spark, box, tmp_path):
    files = {"mh": "<M %s|%n|%e|%i|%t|%y|%q|%%>\\n", "mf": "</M %p>", "ih": "<I %l %s>", "ia": "[%ARTICLE%]%TITLE% $TITLE$ %NOPE%"}
    for k, v in files.items():
        (tmp_path / k).write_text(v)
    c = config.Config(mhtmlheader=f"file://{tmp_path}/mh", mhtmlfooter=f"file://{tmp_path}/mf", ihtmlheader=f"file://{tmp_path}/ih", label="<L>", msgsperfolder=2, monthly_index=True, yearly_index=True,
                      latest_folder="latest", gmtime=True)
    tables = archive.build_archive(spark, box, c)
    site.write_archive(tables, str(tmp_path / "site"), c)
    home = tmp_path / "site" / "simple"
    page = (home / "0" / "0000.html").read_text()
    assert page.startswith("<M Hello World|Alice|alice@example.com|&lt;msg001@example.com&gt;|../|Author|%q|%>\n<article") and page.endswith("</article></M postweave>")
    index = (home / "date.html").read_text()
    assert index.startswith("<I &lt;L&gt; &lt;L&gt; Date><p>3 Messages") and 'href="0/0000.html"' in index and 'href="1/0002.html"' in index
    # each folder has its own indexes, whose links stay within it; the folders have a page
    assert {"index.html", "subject.html", "author.html", "thread.html", "0000.html", "0001.html"} == set(os.listdir(home / "0"))
    inside = (home / "0" / "index.html").read_text()
    assert 'href="0000.html"' in inside and "0002.html" not in inside and "2 Messages" in inside
    assert '<a href="1/index.html">1</a> (1 Messages' in (home / "folders.html").read_text()
    month, year = (home / "2024-01.html").read_text(), (home / "year-2024.html").read_text()
    assert all(n in x for x in (month, year) for n in ("Alice", "Bob", "Carol")) and "&lt;L&gt; 2024-01" in month
    assert os.readlink(home / "latest") == "1" and (tmp_path / "site" / ".lock").exists()
    # the default frame, and an article template by cookies
    c = config.Config(ihtmlhead=f"file://{tmp_path}/ia", label="L", css="a.css")
    pages = {r.path: r.html for r in site.index_pages(tables, c, render.Templates.load(spark, c)).collect()}
    assert "]L Date L Date %NOPE%" in pages["simple/date.html"] and '<link rel="stylesheet" href="a.css">' in pages["simple/date.html"]
    stub = {r.msgnum: r.html for r in render.articles(tables["messages"].withColumn("is_deleted", F.lit(1)), tables["body_lines"], tables["reply_edges"], config.Config(delete_level=2)).collect()}
    assert "(deleted message)" in stub[0] and "Hi all" not in stub[0]


def test_standard_input(spark):
    import io

    got = mbox.read_stdin(spark, io.BytesIO(SIMPLE.encode())).collect()
    assert len(got) == 3 and {r.list_id for r in got} == {"stdin"}


def test_progress_and_warnings(spark, box, tmp_path, caplog):
    c = config.Config(progress=1, show_warnings=True)
    with caplog.at_level("INFO", "postweave"):
        site.write_archive(archive.build_archive(spark, box, c), str(tmp_path / "s"), c)
    assert [r.getMessage() for r in caplog.records if r.name == "postweave"] == [f"writing {x}" for x in ("tables", "articles", "indexes", "side files", "warnings")]
    assert spark.read.parquet(f"file://{tmp_path}/s/warnings").first().undated == 0


def test_pages_outside_local_folders(spark, box):
    assert not sinks.is_local("s3a://bucket/site") and sinks.is_local("/a/b") and sinks.is_local("file:///a")


def test_words_of_a_user_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(locale, "WORDS", {k: dict(v) for k, v in locale.WORDS.items()})
    (tmp_path / "words.tsv").write_text("pt\tSubject\tAssunto\npt-BR\tDate\tData\nde\tSubject\tThema\nbad line\n")
    locale.load_words(spark, f"file://{tmp_path}/words.tsv")
    assert locale.word("pt_BR.UTF-8", "Date") == "Data" and locale.word("pt", "Date") == "Date" and locale.word("pt-br", "Subject") == "Assunto" and locale.word("de", "Subject") == "Thema"
    assert locale.words_of("fr")["Jan"] == "jan"


def test_read_pages(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "0007.html").write_text('<!-- id="a@b" --><!-- sent="2024-01-15T12:00:00Z" -->')
    (tmp_path / "p" / "x.html").write_text('<article id="msg9"><!-- body="start" -->')
    (tmp_path / "p" / "y.html").write_text("nothing")
    got = {r.msgnum: (r.meta_id, r.date) for r in back.read_pages(spark, f"file://{tmp_path}/p").collect()}
    assert got == {7: ("a@b", 1705320000), 9: (None, 0)}


def test_templates():
    page = render.Page(subject="<S>", name="N", email="n@x", language="de", label="%s", msgid="<i>")
    assert render.fill(r"%s|%n|%N|%y|%l|%%|%q|\n%i", page) == '&lt;S&gt;|N|N &lt;<a href="mailto:n@x">n@x</a>&gt;|Autor|%s|%|%q|\n&lt;i&gt;'
    assert render.fill_cookies("$A$ $B$", {"A": "$B$"}) == "$B$ $B$" and render.fill_cookies("%A%%B% 100%", {"A": "%B%", "B": "b"}) == "%B%b 100%"
    assert render.parsed("a%%b\\nc%") == [("text", "a"), ("escape", "%"), ("text", "b\nc%")]


def test_streaming(spark, box, tmp_path):
    raw = mbox.read_mailboxes(spark, box)
    land, state = f"file://{tmp_path}/land", f"file://{tmp_path}/st"
    raw.filter("pos < 2").coalesce(1).write.mode("append").parquet(land)
    for _ in range(2):
        ingest.ingest(spark, ingest.raw_stream(spark, land), state, f"file://{tmp_path}/cp").awaitTermination()
        raw.coalesce(1).write.mode("append").parquet(land)
    got = back.read_state(spark, state)
    assert sorted(r.msgid for r in got.collect()) == ["<msg001@example.com>", "<msg002@example.com>", "<msg003@example.com>"]
    stream = ingest.mailbox_stream(spark, box)
    q = stream.writeStream.format("memory").queryName("boxes").trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/cp2").start()
    q.awaitTermination()
    assert spark.table("boxes").count() == 3


def test_windows_and_late_rows(spark, tmp_path):
    src = f"file://{tmp_path}/src"
    df = spark.createDataFrame([("l", "a", "2024-01-01 00:00:00"), ("l", "a", "2024-01-02 00:00:00"), ("l", "b", "2024-03-01 00:00:00")], "list_id string, msgid_key string, t string").select("list_id", "msgid_key", F.to_timestamp("t").alias("sent"))
    df.coalesce(1).write.parquet(src)
    read = lambda: spark.readStream.schema(df.schema).parquet(src)
    for name, stream, mode, n in (("d", ingest.dedup_stream(read()), "append", 2), ("c", ingest.monthly_counts_stream(read()), "complete", 2)):
        stream.writeStream.format("memory").queryName(f"w_{name}").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
        assert spark.table(f"w_{name}").count() == n


def test_options():
    c = config.load("reverse = on\nset showhtml = 2\nfilter_out = a b\nlabel : x=y\ndirmode = 755\nlanguage=NONE\n", {"HM_REVERSE": "off", "HM_LABEL": "env", "X": "1"}, ["showhtml=1", "overwrite=1"], {"label": "flag"})
    assert (c.reverse, c.showhtml, c.filter_out, c.label, c.dirmode, c.overwrite, c.language) == (True, 1, ("a", "b"), "flag", 0o755, True, None)
    assert c.skip_headers[-3:] == ("from", "date", "subject") and config.Config(css="a.css", dir="/x/").css_path() == "/x/a.css"
    for key, value in (("usetable", "1"), ("nope", "1"), ("showhtml", "7"), ("reverse", "maybe"), ("increment", "x")):
        with pytest.raises(config.ConfigError):
            config.Config().set(key, value)
    found = config.validate("# c\nbad line\nnope = 1\nshowhr = 1\nshowhtml = 5\nfolder_by_date = %Y\nmsgsperfolder = 9\nmbox_shortened = on\nincrement = 1\ndir = a/../b\ndefaultindex = zzz\n")
    assert [(d.line, d.severity) for d in found] == [(2, "error"), (3, "warning"), (4, "warning"), (5, "error"), (8, "error"), (8, "error"), (7, "error"), (10, "error"), (11, "error")]
    assert config.check(config.Config(mbox_shortened=True, increment=1)) and not config.check(config.Config())


def test_locales(spark):
    assert locale.resolve("DE_at") == "de" and locale.resolve("german") == "de" and locale.resolve("xx") == "en"
    assert locale.word("fr", "Subject") == "Sujet" and locale.word("fr", "Nothing") == "Nothing" and "es" in locale.known_languages()
    df = spark.createDataFrame([("de", "Date"), ("xx", "Date"), ("de", "Zzz")], "lang string, key string")
    assert sorted(r.value for r in locale.localized(df, locale.locale_table(spark)).collect()) == ["Date", "Datum", "Zzz"]


def test_exploded_lines_need_no_shuffle(spark):
    m = spark.createDataFrame([("l", 1, "a")], "list_id string, msgnum int, body_text string")
    assert "Exchange" not in explode_lines(m)._jdf.queryExecution().executedPlan().toString()
