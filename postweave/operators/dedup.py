"""First-wins dedup by Message-ID."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.mail import normalize_msgid


def first_by_msgid(rows: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """The first row of each id by pos, and none whose id is in kept (list_id, msgid_key) already.

    Rows without an id, or with a blank one, are all kept. The first position is an aggregate that
    combines before its shuffle, so that an id with a third of the rows is one row a task.
    """
    keyed = rows.withColumn("msgid_key", normalize_msgid(F.col("msgid")))
    has = F.coalesce(F.col("msgid_key") != "", F.lit(False))
    first = keyed.filter(has).groupBy(F.col("list_id").alias("_l"), F.col("msgid_key").alias("_k")).agg(F.min("pos").alias("_first"))
    same = (F.col("list_id") == F.col("_l")) & (F.col("msgid_key") == F.col("_k"))
    unique = keyed.filter(has).join(first, same).filter("pos = _first").drop("_l", "_k", "_first").unionByName(keyed.filter(~has))
    return unique if kept is None else unique.join(kept.select("list_id", "msgid_key"), ["list_id", "msgid_key"], "left_anti")
