"""Each stage on its own input, against brute force."""

import os
import random
from collections import Counter

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from postweave.llm.common import Scratch  # noqa: E402

from .helpers import empty, odd  # noqa: E402
from .test_exact_dedup import sha  # noqa: E402
from .test_jaccard_join import brute  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng, home = random.Random(7), tmp_path_factory.mktemp("tables")
    words = [f"{a}{b}" for a in "bcdfghklm" for b in ("an", "eno", "ing", "ou", "tion", "ara")]
    rows = []
    for i in range(500):
        w = rng.choices(words, k=rng.randint(20, 120))
        if rng.random() < 0.15:
            w.insert(3, "grobian")
        rows.append((i, " ".join(w), rng.choice(("en", "de")), f"src{min(3, rng.randint(0, 9))}"))
    for i in range(500, 560):
        text = rows[rng.randrange(500)][1]
        rows.append((i, text.upper() if i % 2 else text + " tail", "en", "src0"))
    rows += [(600, None, None, None), (601, "", "en", "src1"), (None, "lost " * 9, "en", "src1")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{home}/documents.parquet")
    spark.createDataFrame([(i, int("grobian" in t)) for i, t, *_ in rows if i is not None and t and i % 3], "doc_id long, toxic int").write.parquet(f"{home}/labels.parquet")
    return str(home)


def as_rows(df):
    return Counter((r.doc_id, r.text, r.lang, r.source) for r in df.select("doc_id", "text", "lang", "source").collect())


def checked(name, before, out, columns):
    """A stage's rows (multisets of them) against brute force on its own input."""
    if name != "packing":
        assert out.columns == columns
        kept = as_rows(out)
        assert not kept - before  # rows of the input, none of them more often
    if name == "toxicity":
        assert sum(n for (_, t, *_), n in kept.items() if "grobian" in (t or "").lower()) <= 2
        assert {r: n for r, n in before.items() if "grobian" not in (r[1] or "").lower()} == {r: n for r, n in kept.items() if "grobian" not in (r[1] or "").lower()}
    elif name == "exact dedup":
        best = {}
        for i, t, *_ in before:
            best[sha(t)] = max(best.get(sha(t), -2**64), -2**64 if i is None else i)
        assert Counter((sha(t), -2**64 if i is None else i) for (i, t, *_), n in kept.items() for _ in range(n)) == Counter(best.items())
    elif name == "n-gram Jaccard join":
        every = list(before.elements())
        want = brute([(k, r[1]) for k, r in enumerate(every)], 5, 80)
        groups = {}
        for k, (_, c) in want.items():
            groups.setdefault(c, []).append(every[k])
        order = lambda r: (r[0] is None, r[0] or 0)
        assert sorted(map(str, (order(r) for r in kept.elements()))) == sorted(str(min(order(r) for r in g)) for g in groups.values())
    elif name == "mixing":
        assert 0.5 < sum(kept.values()) / max(1, sum(before.values())) <= 1 or sum(before.values()) < 40
    else:
        rows = out.collect()
        assert {r.doc_id for r in rows} == {i for i, *_ in before}
        assert all(len(np.frombuffer(bytes(r.ids), np.uint32)) == r.length for r in rows)


def test_stages(spark, tables):
    scratch, docs = Scratch(spark, "t"), spark.read.parquet(f"{tables}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "n-gram Jaccard join", "mixing", "packing"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, out = as_rows(docs), scratch.save(stage(spark, docs, tables), f"s{k}")
        checked(name, before, out, COLUMNS)
        docs = out


@pytest.mark.parametrize("k", range(5))
def test_stages_on_odd_rows(spark, tables, k):
    """Nulls, empty and long texts, repeated rows, and columns of every name that the sources use."""
    name, stage = corpus_pipeline.STAGES[k]
    docs = odd(spark)
    assert len(docs.columns) > 60
    out = stage(spark, docs, tables)
    checked(name, as_rows(docs), out, docs.columns)
    if name != "packing":
        extra = [c for c in docs.columns if c not in COLUMNS]
        assert all(set(r) <= {"clash"} for r in out.select(extra).collect())


def test_an_empty_table(spark, tables):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty(spark), tables)
        assert out.collect() == [] and (name == "packing" or out.columns == empty(spark).columns)


def test_repeated_rows_and_shared_ids(spark, tables):
    def stays(stage, rows):
        docs = spark.createDataFrame([(*r, "en", "s", len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
        return sorted((r.doc_id, r.text) for r in stage(spark, docs, tables).collect())

    assert stays(corpus_pipeline.drop_copies, [(5, "same text"), (5, "same text")]) == [(5, "same text")]
    assert stays(corpus_pipeline.drop_copies, [(5, "aaa"), (5, "bbb"), (9, "aaa")]) == [(5, "bbb"), (9, "aaa")]
    long = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    assert stays(corpus_pipeline.drop_near_copies, [(5, long), (5, long)]) == [(5, long)]
    assert stays(corpus_pipeline.drop_near_copies, [(5, long), (5, "quite another text"), (9, long + " end")]) == [(5, long), (5, "quite another text")]


def test_no_guard_in_the_pipeline():
    source = open(os.path.join(os.path.dirname(corpus_pipeline.__file__), "corpus_pipeline.py")).read()
    assert "except" not in source


def test_run_leaves_the_last_stage_alone(spark, tables):
    """What earlier stages wrote, their results included, is gone when the pipeline has run."""
    at = spark.conf.get("spark.checkpoint.dir").removeprefix("file://") + "/postweave"
    files = lambda: {f"{d}/{x}" for d, _, names in os.walk(at) for x in names if x.endswith(".parquet")}
    before = files()
    out = corpus_pipeline.run(spark, tables)
    left = {f.rsplit("/", 2)[1] for f in files() - before}
    assert left == {"stage_4"} and out.count() > 0
