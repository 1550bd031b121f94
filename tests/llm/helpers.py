"""Rows that every operator must take: nulls, empty and long texts, ties, repeats, clashing names."""

ODD = [
    (1, "Alpha beta gamma delta epsilon. " * 3, "en", "a"), (1, "Alpha beta gamma delta epsilon. " * 3, "en", "a"),
    (2, None, None, None), (3, "", "de", "a"), (4, " \t\n", "de", "b"), (None, "no id at all, only text", "en", None), (None, None, "en", "b"),
    (-5, "é Ü ß 漢字 🙂 mixed" * 2, "fr", "c"), (6, "x" * 70_000, "es", "c"), (7, "one two three " * 9_000, "en", "a"), (8, "ALPHA BETA GAMMA DELTA EPSILON. " * 3, "en", "a")]
SCHEMA = "doc_id long, text string, lang string, source string"


def odd(spark):
    """With extra columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, SCHEMA).withColumn("n_chars", F.length("text").cast("long"))
    for name in ("shard", "digest", "pid", "length", "score", "tokens", "rank", "_part", "size", *sorted(internal_names())):
        if name not in df.columns:
            df = df.withColumn(name, F.lit("clash"))
    return df


def internal_names():
    """Each column name that the sources of the operators and of the pipeline give to a column."""
    import glob
    import os
    import re

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    found = set()
    for path in [*glob.glob(f"{root}/postweave/llm/*.py"), *glob.glob(f"{root}/corpus_pipeline.py")]:
        with open(path) as f:
            text = f.read()
        found |= set(re.findall(r"""(?:alias|withColumn|withColumnRenamed)\(f?["']([A-Za-z_]\w*)["']""", text))
        found |= set(re.findall(r"(\w+) (?:bigint|string|double|int|binary|array<bigint>)\b", text))
    return found - {"doc_id", "text", "lang", "source", "n_chars"}


def empty(spark):
    return odd(spark).filter("false")
