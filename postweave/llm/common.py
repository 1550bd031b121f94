"""Shared helpers: scratch tables in the cluster's shared folder, Arrow limits, null-safe text."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one Arrow batch handed to Python; one longer row still travels alone.
ARROW_BYTES = 4 << 20
#: What is opened within Scratch.passing().
_passing: ContextVar[list[Scratch] | None] = ContextVar("passing", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.

    Where that is unset, the folder set by SparkContext.setCheckpointDir. Only if there is none either and all
    tasks run on this machine (local tests) a temporary folder is used; on a cluster that is an error, since
    executors would write to folders that the others can't read.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.postweave.scratch", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='postweave-')}"
        spark.conf.set("spark.postweave.scratch", found)
    return found.rstrip("/")


def arrow_limits(spark: SparkSession) -> None:
    """Bounds what one Arrow batch holds, so that long texts don't add up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")


class Scratch:
    """Written intermediate tables of one query: they cut lineage and survive lost executors.

    A returned DataFrame reads them when it is run, so that they stay until the Spark application ends:
    then the folders and the catalog's tables are dropped.
    """

    _open: list[Scratch] = []

    def __init__(self, spark: SparkSession, name: str):
        if not Scratch._open:
            atexit.register(Scratch.drop_all)
        Scratch._open.append(self)
        if (held := _passing.get()) is not None:
            held.append(self)
        self.spark, self.tables = spark, []
        self.tag = f"{name}_{uuid.uuid4().hex[:12]}"
        self.root = f"{shared_dir(spark)}/postweave/{self.tag}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        df.write.option("compression", codec).parquet(self.path(name))
        return self.load(df, name)

    def load(self, df: DataFrame, name: str) -> DataFrame:
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def bucketed(self, df: DataFrame, name: str, buckets: int, key: str) -> DataFrame:
        """Saved as a table bucketed by key, whose joins by key don't move it."""
        table = f"{name}_{self.tag}"
        (df.write.format("parquet").option("compression", "uncompressed").bucketBy(buckets, key)
         .option("path", self.path(name)).saveAsTable(table))
        self.tables.append(table)
        return self.spark.table(table)

    @classmethod
    def drop_all(cls) -> None:
        """Drops what all queries of this process have written, where their session still lives."""
        while cls._open:
            cls._open.pop().drop_own()

    @classmethod
    @contextmanager
    def passing(cls) -> Iterator[None]:
        """Drops at its end what queries have written within it; their results must be written by then."""
        token = _passing.set([])
        try:
            yield
        finally:
            held = _passing.get()
            _passing.reset(token)
            for scratch in held:
                cls._open.remove(scratch)
                scratch.drop_own()

    def drop_own(self) -> None:
        if self.spark.sparkContext._jsc is not None:
            for table in self.tables:
                self.spark.sql(f"DROP TABLE IF EXISTS {table}")
            self.drop("")

    def drop(self, *names: str) -> None:
        """Deletes tables that no later plan reads."""
        for name in names:
            if (table := f"{name}_{self.tag}") in self.tables:
                self.spark.sql(f"DROP TABLE IF EXISTS {table}")
                self.tables.remove(table)
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(name).rstrip("/"))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def whole(docs: DataFrame) -> Column:
    """All columns of docs in one, `doc`, so that names added beside it can't clash with them."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias("doc")


def released(rows: DataFrame) -> DataFrame:
    """The columns of docs again."""
    return rows.select("doc.*")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
