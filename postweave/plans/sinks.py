"""Writers of pages and files. Tables are the product; these are thin."""

from __future__ import annotations

import json
import os
import re
import shutil
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import groupby
from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..operators.search import search_lines
from ..sources.archive import cache_record, cache_trailer


def _local(path: str) -> str:
    return re.sub("^file:(//)?", "", path)


def is_local(root: str) -> bool:
    """A folder that Python can open, which on a cluster must be one that all executors share."""
    return ":" not in root or root.startswith("file:")


class PageWritten(WriterCommitMessage):
    """The list of what one task has staged, and how many files that are."""

    def __init__(self, listing: str, pages: int):
        self.listing, self.pages = listing, pages


class PageWriter(DataSourceWriter):
    """Files of (path, html) under a root, all or none.

    Tasks stage files under .staging/<run>, each attempt in a folder of its own, and list them; the commit first writes which listings
    count, then moves the files to their places. A run that fails before that leaves no page; one that is
    killed while files are moved is finished by the next (`finish`), before it writes its own."""

    def __init__(self, options: dict, overwrite: bool):
        self.base, self.run = os.path.abspath(_local(options["path"])), uuid4().hex
        self.mode, self.dirmode, self.keep = int(options.get("filemode", 0o644)), int(options.get("dirmode", 0o755)), options.get("keep", "false") == "true"
        self.home = os.path.join(self.base, STAGING, self.run)
        finish(self.base)

    def write(self, rows: Iterator) -> PageWritten:
        from pyspark import TaskContext

        own = os.path.join(self.home, f"{TaskContext.get().partitionId()}-{TaskContext.get().taskAttemptId()}")
        os.makedirs(own, exist_ok=True)
        n, listing = 0, os.path.join(own, "listing")
        with open(listing, "w", encoding="utf-8") as out:
            for r in rows:
                at = os.path.abspath(os.path.join(self.base, r["path"]))
                if os.path.commonpath([self.base, at]) != self.base or STAGING in os.path.relpath(at, self.base).split(os.sep):
                    raise ValueError(f"{r['path']} leaves the archive")
                if self.keep and os.path.exists(at):
                    continue
                staged = os.path.join(own, f"{n}.page")
                with open(staged, "w", encoding="utf-8") as f:
                    f.write(r["html"])
                os.chmod(staged, self.mode)
                out.write(json.dumps([staged, at, self.dirmode]) + "\n")
                n += 1
        return PageWritten(listing, n)

    def commit(self, messages: list[PageWritten | None]) -> None:
        os.makedirs(self.home, exist_ok=True)
        with open(f"{self.home}/commit.part", "w", encoding="utf-8") as f:
            f.writelines(f"{m.listing}\n" for m in messages if m)
        os.replace(f"{self.home}/commit.part", f"{self.home}/commit")
        finish(self.base)

    def abort(self, messages: list[PageWritten | None]) -> None:
        shutil.rmtree(self.home, ignore_errors=True)


STAGING = ".staging"


def finish(base: str) -> int:
    """Moves what committed runs have staged to its place, also if some of it was moved before, and
    drops what they leave; returns how many files were moved. Runs that haven't committed stay as they are."""
    moved, home = 0, os.path.join(base, STAGING)
    for run in sorted(os.listdir(home)) if os.path.isdir(home) else []:
        commit = os.path.join(home, run, "commit")
        if not os.path.exists(commit):
            continue
        with open(commit, encoding="utf-8") as listings:
            for listing in listings.read().splitlines():
                with open(listing, encoding="utf-8") as f:
                    for line in f:
                        staged, at, dirmode = json.loads(line)
                        if os.path.exists(staged):
                            os.makedirs(os.path.dirname(at), mode=dirmode, exist_ok=True)
                            os.replace(staged, at)
                            moved += 1
        shutil.rmtree(os.path.join(home, run))
    return moved


class PageSink(DataSource):
    """pages.write.format("pages").mode("append").save(root); options: filemode, dirmode (numbers), keep (existing files stay)."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def writer(self, schema, overwrite: bool) -> PageWriter:
        return PageWriter(self.options, overwrite)


def write_pages(pages: DataFrame, root: str, mode: int = 0o644, overwrite: bool = True, name: str = "pages", dirmode: int = 0o755) -> None:
    """One file for each row of (path, html), staged where the rows are and put in place when all are whole.
    In a store that only Spark can write, root/name gets them as a table instead."""
    if not is_local(root):
        pages.select("path", "html").write.mode("overwrite").parquet(f"{root}/{name}")
        return
    pages.sparkSession.dataSource.register(PageSink)
    (pages.select("path", "html").write.format("pages").mode("append").option("filemode", str(mode)).option("dirmode", str(dirmode))
     .option("keep", str(not overwrite).lower()).save(_local(root)))


def write_tables(tables: dict[str, DataFrame], root: str) -> None:
    """Every table under root/name; messages by list."""
    for name, df in tables.items():
        out = df.write.mode("overwrite")
        (out.partitionBy("list_id") if name == "messages" else out).parquet(f"{root}/{name}")


def write_search(messages: DataFrame, root: str) -> None:
    search_lines(messages).write.mode("overwrite").text(f"{root}/search")


def write_overview(rows: DataFrame, root: str) -> None:
    rows.select(F.col("xml").alias("value")).write.mode("overwrite").text(f"{root}/overview")


def message_index_lines(messages: DataFrame, names) -> DataFrame:
    """For each list `0000 MAX`, then `num name`, in order."""
    top = messages.groupBy("list_id").agg(F.lit(-1).alias("at"), F.concat(F.lit("0000 "), F.coalesce(F.max("msgnum"), F.lit(0)).cast("string")).alias("value"))
    own = messages.select("list_id", F.col("msgnum").alias("at"), F.concat_ws(" ", F.lpad(F.col("msgnum").cast("string"), F.greatest(F.lit(4), F.length(F.col("msgnum").cast("string"))), F.lit("0")), names).alias("value"))
    return top.unionByName(own).orderBy("list_id", "at")


def append_msgids(messages: DataFrame, root: str) -> None:
    """Adds the lines of ids that the files under root/msgids lack: a run that is repeated adds none."""
    spark, path = messages.sparkSession, f"{root}/msgids"
    lines = messages.filter("msgid IS NOT NULL").select(F.concat(F.lit("Message-ID: "), F.col("msgid")).alias("value")).distinct()
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        lines = lines.join(spark.read.text(path), "value", "left_anti")
    lines.write.mode("append").text(path)


def write_header_cache(messages: DataFrame, root: str, name: str = "headers.idx", delete_level: int = 0) -> None:
    """Each list's header cache, root/list/name: records by number, then the largest number. A file is written by one task, row by
    row, beside its place and moved there when it is whole."""
    base = _local(root)
    last = messages.groupBy("list_id").agg(F.coalesce(F.max("msgnum"), F.lit(0)).alias("_max"))
    ends = last.select("list_id", F.lit(None).cast("int").alias("msgnum"), cache_trailer(F.col("_max"), delete_level).alias("record"))
    rows = cache_record(messages).unionByName(ends).repartition("list_id").sortWithinPartitions("list_id", F.col("msgnum").asc_nulls_last())

    def write(parts: Iterator) -> None:
        for list_id, own in groupby(parts, lambda r: r["list_id"]):
            at = os.path.join(base, list_id, name)
            os.makedirs(os.path.dirname(at), exist_ok=True)
            with open(f"{at}.part", "wb") as f:
                f.writelines(bytes(r["record"]) for r in own)
            os.replace(f"{at}.part", at)

    rows.foreachPartition(write)


def link_latest(root: str, name: str, target: str) -> None:
    """root/name as a link to a folder of root; nothing that isn't a link is replaced."""
    if ".." in target.split("/") or os.path.isabs(target) or "/" in name:
        raise ValueError("the link must stay in the archive")
    at = os.path.join(_local(root), name)
    if os.path.lexists(at):
        if not os.path.islink(at):
            raise ValueError(f"{at} is no link")
        os.unlink(at)
    os.symlink(target, at)


def write_latest(latest: DataFrame, root: str, name: str) -> None:
    """Each list's link to the folder of its newest message; latest: a row a list."""
    def write(rows: Iterator) -> None:
        for r in rows:
            home = os.path.join(_local(root), r["list_id"])
            if r["latest_folder"] != "." and os.path.isdir(os.path.join(home, r["latest_folder"])):
                link_latest(home, name, r["latest_folder"])

    latest.select("list_id", "latest_folder").foreachPartition(write)


def is_empty_archive(root: str) -> bool:
    base = _local(root)
    return not os.path.isdir(base) or not any(not n.startswith(".") for n in os.listdir(base))


@contextmanager
def locked(root: str):
    """An exclusive lock of an archive on the driver; an error if another run holds it."""
    import fcntl

    os.makedirs(_local(root), exist_ok=True)
    with open(os.path.join(_local(root), ".lock"), "w") as f:
        fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
        yield
