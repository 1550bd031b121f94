"""Patterns in one pass against each pattern alone."""

import random
import time

import pytest
from pyspark.sql import functions as F

from postweave.operators import filters
from postweave.operators.patterns import PatternSet, required

PATTERNS = [
    "the", "^Topic [0-9]+$", "(?i)VIAGRA", "(cat|dog)s?", "(?:foo|ba[rz])+qux", "a{0,3}b", "a{2,}bcd", "x*", "", "[[]x", r"\bword\b", "(un", r"k\w+ey", "(?i:MiXed) case", "ab(?=cd)", "(?<!a)bcd",
    "(?>atom)ic", "po++sse", "q(r(s(t|uv)))", r"\.", r"é+t", "^$", "[a-c]x|zz", "long " * 20, "x" * 600, "ß", "(?i)straße", "a|b", r"tab\tbed", "[^a]the", r"\h+dogs", r"(?x) the # x"]


def text_of(rng):
    words = ["the", "Topic 12", "viagra", "VIAGRA", "dogs", "foobarqux", "baqux", "b", "aabcd", "bcd", "word", "sword", "key", "kidney", "mixed case", "MIXED case", "abcd", "atomic", "posse", "pooosse", "qrst", "qruv",
             ".", "ét", "ax", "zz", "long " * 20, "STRASSE", "straße", "tab\tbed", "", " "]
    return [rng.choice(["", " "]).join(rng.choices(words, k=rng.randint(0, 4))) for _ in range(rng.randint(0, 6))]


def test_one_pass_is_each_pattern_alone(spark):
    rng = random.Random(5)
    rows = [(k, text_of(rng)) for k in range(300)] + [(300, None), (301, []), (302, [None, "the dogs", "the dogs"]), (303, ["y" * 70_000 + "the"]), (304, ["the " * 40_000])]
    df = spark.createDataFrame(rows, "id int, lines array<string>").repartition(3)
    got = df.select("id", PatternSet(PATTERNS).hits(F.col("lines")).alias("one"), filters.body_match_indices(F.col("lines"), PATTERNS).alias("each")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.one == r.each, r.id
    assert set().union(*[r.one for r in got]) >= set(range(len(PATTERNS))) - {9, 11, 24}
    assert PatternSet([]).hits(F.col("lines")) is not None and df.select(PatternSet([]).hits(F.col("lines")).alias("x")).first().x == []


def test_headers(spark):
    h = [("Subject", "Re: the Offer"), ("X-Spam", "yes"), ("List", None)]
    df = spark.createDataFrame([(h,), ([],), (None,)], "headers array<struct<name string, value string>>")
    patterns = ["^subject: re", "(?i)^subject: re", "^X-Spam$", "^yes$", "(?i)offer$", "nothing"]
    got = [r[0] for r in df.select(PatternSet(patterns).header_hits(F.col("headers"))).collect()]
    each = [[i for i, p in enumerate(patterns) if r[f"p{i}"]] for r in df.select(*[filters.header_matches(F.col("headers"), p).alias(f"p{i}") for i, p in enumerate(patterns)]).collect()]
    assert got == each == [[1, 2, 3, 4], [], []]


def test_a_verdict_over_many_patterns_is_that_over_few(spark):
    rng = random.Random(9)
    rows = [(k, [("Subject", rng.choice(["win 7", "ok 12", "list 3 x"])), ("From", f"p{k % 5}")], "\n".join(rng.choices(["buy 3", "hello", "stop 44", ""], k=4))) for k in range(60)]
    df = spark.createDataFrame(rows, "msgnum int, headers array<struct<name string, value string>>, body string")
    many = tuple(f"none{k}" for k in range(filters.MANY))
    ask = lambda rules: [r[0] for r in df.select(filters.verdict(rules, F.col("msgnum"), F.col("headers"), F.col("body"), F.lit(0))).collect()]
    few = filters.Rules(filter_out=("win [0-9]",), filter_out_full_body=("^stop 4+$",), filter_require=("^Subject",), filter_require_full_body=("hello|buy",))
    more = filters.Rules(filter_out=("win [0-9]", *many), filter_out_full_body=(*many, "^stop 4+$"), filter_require=("^Subject",) * 20, filter_require_full_body=("hello|buy",) * 20)
    assert ask(few) == ask(more) and len(set(ask(few))) == 4


def test_texts_that_must_be_there():
    assert required("abc.*Defgh[0-9]xy") == {"defgh"}
    assert required("(abc|de)f+") == {"abc", "de"}
    assert required("x?y*|abc") == required("[a-z]+") == required("[a[bc]d]efg") == required(r"(?iu)kelvin") == frozenset()
    assert required("(?:abcd)?x") == {"x"}
    assert required("(?P<n>abc)(?P=n)") == {"abc"}
    assert all(len(t) <= 32 for t in required("x" * 500))


@pytest.mark.parametrize("n", [500])
def test_many_patterns_cost_little_more_than_few(spark, n):
    """The least of four passes each, over sets that are built before: 500 patterns, a hundred times as many pairs to
    match, within three times 5."""
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9))) for _ in range(4000)]
    rows = [(k, [" ".join(rng.choices(words[:3500], k=12)) for _ in range(40)]) for k in range(1500)]
    df = spark.createDataFrame(rows, "id int, lines array<string>").repartition(4).cache()
    df.count()
    patterns = [rf"(?i)\b{w}[0-9]*$" if k % 2 else f"{w} +{w[::-1]}" for k, w in enumerate(rng.sample(words, n))]

    def least(own):
        took, hits = [], PatternSet(own).hits(F.col("lines"))
        for _ in range(4):
            t = time.perf_counter()
            df.select(hits.alias("h")).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - t)
        return min(took)

    few, many = least(patterns[:5]), least(patterns)
    print(f"5 patterns {few:.2f} s, {n} patterns {many:.2f} s")
    assert many < 3 * few
    df.unpersist()
