"""A stored archive that is updated in place: tables by list, of which an update reads and writes the lists it touches.

Messages are appended. Edges change by delta joins (new children with all parents, old children with new parents);
threads are walked anew where an edge came or went; sorted indexes and counts of a touched list are taken from its
messages. A touched list's part of a table is replaced as a whole by dynamic partition overwrite, other lists' parts are
neither read nor written.

Messages are written last. An update that fails before is repeated as it was, with the same numbers: what it had
already written is written again.

What doesn't depend on each other (edges with their walk, each sorted index, the search index) is run side by side, since
each is many jobs of which the small ones leave most cores free.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import partial, reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..config import Config, check
from ..operators import indexes, lines as line_ops, search, threads
from ..operators.ranking import written
from ..sources.mbox import read_mailboxes
from .archive import STATE_COLUMNS, continued, ends_of
from .messages import parse_messages

#: What an index row needs of its message.
ROW = ["list_id", "msgnum", "pos", "date_str", "date", "name", "email_addr", "subject", "unre_subject", "msgid", "is_deleted", "folder", "rel_path_to_top"]

#: Tables of which an update may take a list's last row; those of messages only grow.
MAY_LOSE = ("tokens", "reply_edges", "unresolved", "thread_index")
#: Jobs that run side by side.
AT_ONCE = 4


def at_once(spark: SparkSession, jobs: list[Callable[[], None]]) -> None:
    """Runs all jobs, the first ones first; the first error is raised when all have ended."""
    with ThreadPoolExecutor(AT_ONCE) as pool:
        runs = [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]
    for run in runs:
        run.result()


class StoredArchive:
    """Tables under root: messages, tokens (ids quoted in texts), reply_edges, unresolved, thread_index, date_index,
    subject_index, author_index, stats, folders, and monthly and yearly where they are configured; and a search index,
    to which an update adds the new messages alone."""

    def __init__(self, spark: SparkSession, root: str, config: Config | None = None):
        self.spark, self.root, self.config = spark, root.rstrip("/"), (config or Config()).finish()
        if wrong := check(self.config):
            raise ValueError("; ".join(wrong))

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def read(self, name: str, lists: list[str] | None = None) -> DataFrame:
        """A table, or the parts of some lists; other parts aren't opened."""
        schema = StructType.fromJson(self._json(self.spark.read.text(self.path(f"schema/{name}")).first().value))
        rows = self.spark.read.schema(schema).parquet(self.path(name))
        return rows if lists is None else rows.filter(F.col("list_id").isin(lists) if lists else F.lit(False))

    @staticmethod
    def _json(text: str) -> dict:
        import json

        return json.loads(text)

    def _write(self, name: str, rows: DataFrame, lists: list[str] | None = None, mode: str = "overwrite") -> None:
        """Replaces the parts of the lists in rows; without lists the whole table. Parts are split by size, not one task a list. Of lists, those without
        rows lose their part; rows are computed twice for that, where a table may lose some."""
        own = [f for f in rows.schema.fields if f.name != "list_id"]
        if lists is None:
            schema = StructType([*own, StructField("list_id", StringType())]).json()
            self.spark.range(1).select(F.lit(schema).alias("value")).coalesce(1).write.mode("overwrite").text(self.path(f"schema/{name}"))
        out = rows.select(*[f.name for f in own], "list_id").hint("rebalance", F.col("list_id"))
        out.write.mode(mode).option("partitionOverwriteMode", "static" if lists is None else "dynamic").partitionBy("list_id").parquet(self.path(name))
        if lists and mode == "overwrite" and name in MAY_LOSE:
            left = {r[0] for r in rows.select("list_id").distinct().collect()}
            for gone in set(lists) - left:
                at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(name))
                escape = self.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
                fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
                fs.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at, f"list_id={escape(gone)}"), True)

    def _raw(self, source: str | DataFrame) -> DataFrame:
        return read_mailboxes(self.spark, source, max_message=self.config.max_message_size) if isinstance(source, str) else source

    def _projections(self, messages: DataFrame) -> dict[str, DataFrame]:
        """Sorted indexes and counts of whole lists."""
        c = self.config
        rows = indexes.with_folder(messages, c.msgsperfolder, c.folder_by_date).select(*ROW)
        out = {
            "date_index": indexes.date_index(rows, c.reverse), "subject_index": indexes.subject_index(rows, c.reverse), "author_index": indexes.author_index(rows, c.reverse),
            "stats": indexes.archive_stats(messages), "folders": indexes.folder_stats(rows, c.reverse_folders)}
        if c.monthly_index:
            out["monthly"] = indexes.monthly(messages, c.gmtime)
        if c.yearly_index:
            out["yearly"] = indexes.yearly(messages, c.gmtime)
        return out

    def _walk(self, messages: DataFrame, edges: DataFrame) -> DataFrame:
        depth = self.config.thrdlevels if 1 <= self.config.thrdlevels <= 99 else threads.MAX_DEPTH
        return threads.thread_walk_general(messages, edges, depth) if self.config.linkquotes else threads.thread_walk(self.spark, messages, edges, depth)

    def _tokens(self, messages: DataFrame) -> DataFrame:
        return threads.quoted_tokens(messages, line_ops.explode_lines(messages))

    @property
    def index(self) -> search.SearchIndex:
        """Posting blocks by list and number; `merge` makes one generation of all."""
        return search.SearchIndex(self.spark, self.path("search"))

    def _add_to_index(self, new: DataFrame, generation: int) -> None:
        text = search.searchable_text(F.col("subject"), F.col("name"), F.col("email_addr"), F.col("body_text"))
        self.index.add(new.select(F.col("list_id").alias("scope"), F.col("msgnum").alias("id"), text.alias("text")), F.col("text"), generation)

    def search(self, query: str) -> DataFrame:
        """(list_id, msgnum, score) of messages with all of the query's bigrams but one at most, from the index alone."""
        return self.index.search(query).select(F.col("scope").alias("list_id"), F.col("id").cast("int").alias("msgnum"), "score")

    def build(self, source: str | DataFrame, now: int = 0) -> None:
        """All tables from mailboxes (a path, or raw_messages). Overwrites what is there."""
        messages = written(parse_messages(self._raw(source), self.config, now).select(*STATE_COLUMNS))
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path("search"))
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

        def linked() -> None:
            tokens = written(self._tokens(messages)) if self.config.linkquotes else None
            edges = written(threads.header_edges(messages).unionByName(threads.subject_edges(messages, self.config.searchbackmsgnum)))
            if tokens is not None:
                edges = written(edges.unionByName(threads._token_edges(tokens, threads._holders(messages, F.col("msgid")))))
                self._write("tokens", tokens)
            self._write("reply_edges", edges)
            self._write("thread_index", self._walk(messages, edges))

        def unresolved() -> None:
            self._write("unresolved", threads.unresolved_replies(messages).select("list_id", "msgnum", "inreplyto"))

        sorted_ones = [partial(self._write, name, rows) for name, rows in self._projections(messages).items()]
        at_once(self.spark, [linked, partial(self._add_to_index, messages, 0), unresolved, *sorted_ones])
        self._write("messages", messages)

    def update(self, source: str | DataFrame, now: int = 0) -> DataFrame:
        """Adds raw messages, which are numbered on from where each list ends; returns the new messages.

        The driver holds the names of the touched lists, as it does those of their mailboxes."""
        raw = self._raw(source)
        lists = sorted(r[0] for r in raw.select("list_id").distinct().collect())
        old = self.read("messages", lists)
        ends = written(ends_of(old))
        new = written(continued(parse_messages(raw, self.config, now, 0, old.select("list_id", "msgid_key")), ends).select(*STATE_COLUMNS))
        # the same when the update is repeated, another for each later one: lists and where they ended (a row a list)
        known = {r.list_id: r.last_msgnum for r in ends.select("list_id", "last_msgnum").collect()}
        state = "\n".join(f"{name}\t{known.get(name, -1)}" for name in lists)
        generation = int.from_bytes(hashlib.sha256(state.encode()).digest()[:7], "big") + 1
        # of what they write, these read messages alone, which come last
        sorted_ones = [partial(self._write, name, rows, lists) for name, rows in self._projections(old.unionByName(new)).items()]
        at_once(self.spark, [partial(self._relink, old, new, lists), partial(self._add_to_index, new, generation), *sorted_ones])
        self._write("messages", new, lists, "append")
        return new

    def _relink(self, old: DataFrame, new: DataFrame, lists: list[str]) -> None:
        """Edges, open replies, walks and tokens of the lists, by what new messages change of them."""
        quoting = self.config.linkquotes
        new_tokens = written(self._tokens(new)) if quoting else None
        # a failed run may have left its own rows behind: children and tokens of new messages are dropped first
        is_new = new.select("list_id", F.col("msgnum").alias("child_msgnum"))
        old_tokens = self.read("tokens", lists).join(is_new, ["list_id", "child_msgnum"], "left_anti") if quoting else None
        edges = self.read("reply_edges", lists).join(is_new, ["list_id", "child_msgnum"], "left_anti").join(
            new.select("list_id", F.col("msgnum").alias("parent_msgnum")), ["list_id", "parent_msgnum"], "left_anti")
        gone, fresh = threads.edge_delta(old, new, self.config.searchbackmsgnum, old_tokens=old_tokens, new_tokens=new_tokens)
        gone, fresh = written(gone), written(fresh)
        ended = ["list_id", "kind", "parent_msgnum"]
        now_edges = written(edges.join(gone, ended, "left_anti").unionByName(fresh))
        lost = edges.join(gone, ended, "left_semi")
        ends = [df.select("list_id", F.col(c).alias("msgnum")) for df in (lost, fresh) for c in ("parent_msgnum", "child_msgnum")]
        changed = written(reduce(DataFrame.unionByName, [*ends, new.select("list_id", "msgnum")]).distinct())
        nodes = written(old.select("list_id", "msgnum", "date").unionByName(new.select("list_id", "msgnum", "date")))
        before = written(self.read("thread_index", lists).join(new.select("list_id", "msgnum"), ["list_id", "msgnum"], "left_anti"))
        touched = written(threads.touched_messages(nodes, before, now_edges, changed))
        own = now_edges.join(touched.withColumnRenamed("msgnum", "child_msgnum"), ["list_id", "child_msgnum"], "left_semi")
        walked = self._walk(written(nodes.join(touched, ["list_id", "msgnum"], "left_semi")), written(own))
        walk = written(before.join(touched, ["list_id", "msgnum"], "left_anti").unionByName(walked.select(*before.columns)))
        ids = new.select("list_id", threads.normalize_msgid(F.col("msgid")).alias("key"))
        waiting = self.read("unresolved", lists).join(new.select("list_id", "msgnum"), ["list_id", "msgnum"], "left_anti").withColumn("key", threads.normalize_msgid(F.col("inreplyto")))
        still = waiting.join(ids, ["list_id", "key"], "left_anti").drop("key")
        answered = fresh.filter("kind = 'header'").select("list_id", F.col("child_msgnum").alias("msgnum"))
        orphans = new.filter("inreplyto IS NOT NULL").select("list_id", "msgnum", "inreplyto").join(answered, ["list_id", "msgnum"], "left_anti")
        tables = {"reply_edges": now_edges, "unresolved": written(still.unionByName(orphans)), "thread_index": walk}
        if quoting:
            tables["tokens"] = written(old_tokens.unionByName(new_tokens))
        for name, rows in tables.items():
            self._write(name, rows, lists)
