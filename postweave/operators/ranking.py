"""Ranks within large groups without bringing a group into one task."""

from __future__ import annotations

import atexit
import uuid
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def positions(rows: DataFrame, group: list[str], order: list, part: str | Column, name: str = "pos", descending: bool = False) -> DataFrame:
    """Adds name: 0, 1, ... within group by order.

    part cuts a group into pieces that follow the order (a prefix or range of its first key); rows
    are ranked within a piece, and pieces are offset by the running sum of their counts.
    """
    part = F.col(part) if isinstance(part, str) else part
    dealt = rows.withColumn("_part", part)
    sizes = dealt.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    parts_order = F.col("_part").desc() if descending else F.col("_part")
    before = W.partitionBy(*group).orderBy(parts_order).rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*[F.col(g).alias(f"_g_{g}") for g in group], F.col("_part").alias("_g_part"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rank = F.row_number().over(W.partitionBy(*group, "_part").orderBy(*order))
    same = F.col("_part").eqNullSafe(F.col("_g_part"))
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    return (dealt.withColumn("_rank", rank).join(offsets, same)
            .withColumn(name, F.col("_before") + F.col("_rank") - 1).drop("_rank", "_before", "_part", "_g_part", *[f"_g_{g}" for g in group]))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or the folder of
    SparkContext.setCheckpointDir. Only where there is none and all tasks run on this machine (local
    tests) a temporary one is used; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.postweave.shared", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        found = f"file://{tempfile.mkdtemp(prefix='postweave-')}"
        spark.conf.set("spark.postweave.shared", found)
    return found.rstrip("/")


#: Tables of this process, which go when it ends: DataFrames read them until then.
_written: list[tuple[SparkSession, str]] = []


def drop_written() -> None:
    while _written:
        spark, path = _written.pop()
        if spark.sparkContext._jsc is not None:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame) -> DataFrame:
    """df from a table in the shared folder: computed once, and not lost with an executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/postweave/tables/{uuid.uuid4().hex}"
    if not _written:
        atexit.register(drop_written)
    _written.append((spark, path))
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ordered_positions(rows: DataFrame, group: list[str], order: list, name: str = "pos") -> DataFrame:
    """As positions, for orders without pieces that are known beforehand: rows are sorted over all
    groups by ranges that Spark takes from a sample, so that no group and no key is one task, and
    numbered in that order; a group's first number is taken away."""
    numbered = written(rows.orderBy(*group, *order).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33).alias("_part")
    sizes = numbered.groupBy(part).agg((F.max("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("_n"))
    # one row for each task that sorted
    before = sizes.select(F.col("_part"), F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    placed = numbered.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
    first = placed.groupBy(*group).agg(F.min(name).alias("_first")).select(*[F.col(g).alias(f"_g_{g}") for g in group], "_first")
    same = reduce(and_, [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in group])
    return placed.join(first, same).withColumn(name, F.col(name) - F.col("_first")).drop("_id", "_part", "_before", "_first", *[f"_g_{g}" for g in group])


def number_messages(rows: DataFrame, start: int = 0, step: int = 1) -> DataFrame:
    """msgnum from the source position; rows that are dropped later keep their number used."""
    return rows.withColumn("msgnum", (F.lit(start) + F.lit(max(1, step)) * F.col("pos")).cast("int"))


def dense_positions(rows: DataFrame, size: int = 100_000) -> DataFrame:
    """pos again without gaps, after rows were dropped."""
    held = rows.withColumnRenamed("pos", "_pos").withColumn("_range", F.floor(F.col("_pos") / size))
    return positions(held, ["list_id"], ["_pos"], "_range").drop("_pos", "_range")


def top(rows: DataFrame, *order, n: int = 1) -> DataFrame:
    """The first n rows by order: partial top-n in each task, then one merge."""
    return rows.orderBy(*order).limit(n)
