"""Mailbox sources.

`read_mailboxes` is the scan for large stores: Spark's own text reader, cut at "\\nFrom ", so that
files of any size and on any file system are split among tasks, and positions are counted without
bringing a mailbox together. `MailboxSource` is a Python data source with the reader's exact limits
(one task a file; also as a stream), for mailboxes on a file system that Python can open.
"""

from __future__ import annotations

import glob
import os
import re
import sys
from collections.abc import Iterator
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..operators.ranking import positions, shared_dir

RAW_SCHEMA = "list_id string, pos bigint, from_line string, headers binary, body binary"
MAX_MESSAGE = 100 << 20
MAX_LINE = 10 << 20
FORMATS = ("mboxo", "mboxrd", "mboxcl", "mboxcl2")


def is_envelope(line: bytes) -> bool:
    return line.startswith(b"From ") and len(line) > 5


def split_message(raw: bytes) -> tuple[str, bytes, bytes]:
    """(envelope, headers, body): headers end at the first blank line; without one all is headers."""
    envelope, _, rest = raw.partition(b"\n")
    if rest.startswith(b"\n"):
        headers, body = b"", rest[1:]
    else:
        headers, gap, body = rest.partition(b"\n\n")
        headers += b"\n" if gap else b""
    return envelope.decode("utf-8", "replace").rstrip(), headers, body


def unescape(body: bytes) -> bytes:
    return re.sub(rb"(?m)^>(>*From )", rb"\1", body)


def read_messages(lines: Iterator[bytes], form: str = "mboxo", max_message: int = MAX_MESSAGE, max_line: int = MAX_LINE) -> Iterator[tuple[str, bytes, bytes]]:
    """Messages of one mailbox. The first line is an envelope, whatever it says; a line or message
    over its limit ends the scan with an error, and its message is never returned."""
    held: list[bytes] = []
    size = 0

    def done() -> tuple[str, bytes, bytes]:
        envelope, headers, body = split_message(b"".join(held))
        return envelope, headers, unescape(body) if form == "mboxrd" else body

    for line in lines:
        if len(line) > max_line:
            raise ValueError(f"a line is longer than {max_line} bytes")
        line = line[:-2] + b"\n" if line.endswith(b"\r\n") else line
        if held and is_envelope(line.rstrip(b"\n")):
            yield done()
            held, size = [], 0
        size += len(line)
        if size > max_message:
            raise ValueError(f"a message is longer than {max_message} bytes")
        held.append(line)
    if held:
        yield done()


def list_name(path: str) -> str:
    return re.sub(r"\.(mbox|mbx|txt)$", "", os.path.basename(path))


def paths_of(path: str) -> list[str]:
    path = re.sub("^file:(//)?", "", path)
    if os.path.isdir(path):
        return sorted(p for p in glob.glob(f"{path}/*") if os.path.isfile(p) and not os.path.basename(p).startswith(("_", ".")))
    return sorted(glob.glob(path))


class MailboxFile(InputPartition):
    """A mailbox, of which the messages that begin before byte `after` are known."""

    def __init__(self, path: str, after: int = 0):
        self.path, self.after = path, after


class MailboxReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.form = options["path"], options.get("format", "mboxo").lower()
        if self.form not in FORMATS:
            raise ValueError(f"format {self.form!r} is none of {', '.join(FORMATS)}")
        self.limit = int(options.get("maxMessageSize", MAX_MESSAGE))

    def partitions(self) -> list[MailboxFile]:
        return [MailboxFile(p) for p in paths_of(self.path)]

    def read(self, partition: MailboxFile) -> Iterator[tuple]:
        begins: list[int] = []
        with open(partition.path, "rb") as f:
            for pos, (envelope, headers, body) in enumerate(read_messages(noted(f, begins), self.form, self.limit)):
                if begins[pos] >= partition.after:
                    yield list_name(partition.path), pos, envelope, headers, body


def noted(lines: Iterator[bytes], begins: list[int]) -> Iterator[bytes]:
    """The lines, while begins gets the byte where each message begins."""
    at = 0
    for line in lines:
        if at == 0 or is_envelope(line.rstrip(b"\r\n")):
            begins.append(at)
        at += len(line)
        yield line


class MailboxStream(DataSourceStreamReader):
    """Mailbox files of a folder as they land, in any order of names: a partition for each, read on executors.

    An offset is a ledger, the (size, time) of each file that the folder holds then, so that it has a row a file:
    move files away that are done with. The driver lists files and opens none. Of a file that has grown, the messages
    that begin in its new part follow, numbered on; a file that was replaced (it shrank, or has another time at its
    old size) is new. A file that is removed leaves the ledger."""

    def __init__(self, options: dict):
        self.reader = MailboxReader(options)

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        files = {}
        for p in paths_of(self.reader.path):
            try:
                at = os.stat(p)
            except FileNotFoundError:
                continue  # moved away meanwhile
            files[p] = [at.st_size, at.st_mtime_ns]
        return {"files": files}

    def partitions(self, start: dict, end: dict) -> list[MailboxFile]:
        out = []
        for p, (size, time) in sorted(end["files"].items()):
            was = start["files"].get(p)
            if was is None or size < was[0] or size == was[0] and time != was[1]:
                out.append(MailboxFile(p))
            elif size > was[0]:
                out.append(MailboxFile(p, was[0]))
        return out

    def read(self, partition: MailboxFile) -> Iterator[tuple]:
        return self.reader.read(partition)

    def commit(self, end: dict) -> None:
        pass


class MailboxSource(DataSource):
    """spark.read.format("mbox").load(path); options: format, maxMessageSize."""

    @classmethod
    def name(cls) -> str:
        return "mbox"

    def schema(self) -> str:
        return RAW_SCHEMA

    def reader(self, schema) -> MailboxReader:
        return MailboxReader(self.options)

    def streamReader(self, schema) -> MailboxStream:
        return MailboxStream(self.options)


def read_stdin(spark: SparkSession, stream=None, name: str = "stdin", form: str = "mboxo", max_message: int = MAX_MESSAGE) -> DataFrame:
    """raw_messages of one mailbox that comes as a stream of bytes, by default standard input. It is
    copied to the shared folder in blocks, so that tasks can share it, and is one list, `name`."""
    path = f"{shared_dir(spark)}/postweave/in_{uuid4().hex[:12]}/{name}.mbox"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at)
    try:
        while block := (stream or sys.stdin.buffer).read(1 << 20):
            out.write(bytearray(block))
    finally:
        out.close()
    return read_mailboxes(spark, path, form, max_message)


def read_mailboxes(spark: SparkSession, path: str, form: str = "mboxo", max_message: int = MAX_MESSAGE) -> DataFrame:
    """raw_messages of all mailboxes under path, one list for each file."""
    text = spark.read.option("lineSep", "\nFrom ").text(path).select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"))
    rows = positions(text, ["path"], ["at"], "block")
    rows = rows.join(rows.groupBy("path").agg(F.max("pos").alias("_last")), "path")
    # one character a byte, so that raw 8-bit text passes through string functions unharmed
    raw = F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    # the separator takes the mark of every message but the first, whose first line stays as it is
    raw = F.when(F.col("pos") > 0, F.concat(F.lit("From "), raw)).otherwise(raw)
    # and the line end of every message but the last
    raw = F.regexp_replace(F.when(F.col("pos") < F.col("_last"), F.concat(raw, F.lit("\n"))).otherwise(raw), "\r\n", "\n")
    rest = F.substring(raw, F.instr(F.concat(raw, F.lit("\n")), "\n") + 1, F.length(raw))
    gap = F.instr(rest, "\n\n")
    headers = F.when(F.startswith(rest, F.lit("\n")), "").when(gap > 0, F.left(rest, gap)).otherwise(rest)
    body = F.when(F.startswith(rest, F.lit("\n")), F.substring(rest, F.lit(2), F.length(rest))).when(gap > 0, F.substring(rest, gap + 2, F.length(rest))).otherwise("")
    if form == "mboxrd":
        body = F.regexp_replace(body, "(?m)^>(>*From )", "$1")
    too_long = F.raise_error(F.concat(F.lit("a message is longer than the limit in "), F.col("path")))
    checked = F.when(F.octet_length("value") > max_message, too_long.cast("string")).otherwise(raw)
    return rows.filter(F.length("value") > 0).select(
        F.regexp_replace(F.substring_index("path", "/", -1), r"\.(mbox|mbx|txt)$", "").alias("list_id"), "pos",
        F.make_valid_utf8(F.encode(F.rtrim(F.substring_index(checked, "\n", 1)), "ISO-8859-1").cast("string")).alias("from_line"),
        F.encode(headers, "ISO-8859-1").alias("headers"), F.encode(body, "ISO-8859-1").alias("body"))
