import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from postweave.llm import decontamination
from postweave.llm.common import Scratch
from postweave.llm.decontamination import END, PositionalIndex, Search, decontaminate, term

from .helpers import ODD, empty, odd

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, size=10):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[i: i + size]), set()).add(item)
    out = []
    for doc_id, text in docs:
        w, hit, seen = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[i: i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    seen |= {str(x) for x in own if x is not None}
        out.append((str(doc_id), len(w), len(hit), len(seen), hashlib.sha256(",".join(sorted(seen)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def found(df):
    return sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect())


def corpus(seed=5):
    rng = random.Random(seed)
    vocabulary = ["the"] * 60 + ["of"] * 30 + [f"w{k}" for k in range(40)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([1, 3, 9, 10, 11, 25]))) for i in range(30)] + [(7, "Other Words, same id w1"), (None, text(12)), (50, None), (51, "?!"), (52, "the"), (53, "é漢字 ÜBER w1 w2")]
    docs = []
    for d in range(60):
        parts = [text(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 2)):
            own = (rng.choice(items)[1] or "").split()
            parts += [" ".join(own[rng.randint(0, 3):]), text(rng.randint(0, 9))]
        docs.append((d if d % 11 else None, " ".join(parts).upper() if d % 2 else ", ".join(parts)))
    return [*docs, docs[3], docs[3], (900, None), (901, ""), (902, items[3][1])], items


def tables(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("size, lists, rows, terms", [(10, 3, 1 << 20, 1 << 20), (10, 1, 1 << 20, 1 << 20), (4, 2, 5, 0), (3, 9, 1 << 20, 1 << 20)])
def test_hits_and_items_against_brute_force(spark, monkeypatch, size, lists, rows, terms):
    monkeypatch.setattr(decontamination, "SLICE_ROWS", rows)
    monkeypatch.setattr(decontamination, "BROADCAST_TERMS", terms)
    docs, items = corpus(size)
    assert found(decontaminate(spark, *tables(spark, docs, items), size, lists)) == brute(docs, items, size)


def test_near_places_hold_the_rarest_terms_within_slop(spark):
    docs = [(1, "x alpha beta gamma delta y"), (2, "alpha very beta gamma delta"), (3, "alpha 1 2 3 4 beta gamma"), (4, "delta gamma beta alpha"), (5, "beta gamma delta epsilon alpha")]
    search = Search(spark, *tables(spark, docs, [(1, "Alpha beta gamma delta")]), size=4, lists=3)
    ids = {(r.d1, r.d2): r.doc_id for r in search.documents().collect()}
    asked = [x.at for x in search.asked.first().asked]

    def brute_near(text, slop):
        w, out = text.split(), set()
        for i, x in enumerate(w):
            own = ["alpha", "beta", "gamma", "delta"]
            if x == own[asked[0]] and i >= asked[0]:
                start = i - asked[0]
                gaps = [min((abs(j - start - a) for j, y in enumerate(w) if y == own[a]), default=99) for a in asked]
                if max(gaps) <= slop:
                    out.add((start, max(gaps)))
        return out

    for slop in (0, 1, 3):
        got = {(ids[r.d1, r.d2], r.start, r.gap) for r in search.near(slop).collect()}
        assert got == {(d, *x) for d, text in docs for x in brute_near(text, slop)}, slop


def test_an_index_of_all_tokens_has_each_at_its_place(spark):
    docs = [(1, "A b, a"), (2, None)]
    index = PositionalIndex(Scratch(spark, "all"), tables(spark, docs, [(1, "x")])[0]).build()
    names = {r.t: r.w for r in spark.createDataFrame([("a",), ("b",), (END,)], "w string").select("w", term(F.col("w")).alias("t")).collect()}
    assert sorted((names[r.term], r.pos, r.doc_id or 0) for r in index.collect()) == [("", 0, 2), ("", 3, 1), ("a", 0, 0), ("a", 2, 0), ("b", 1, 0)]


def test_odd_rows_and_empty_tables(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon alpha beta gamma delta epsilon alpha"), (2, "x" * 70_000), (3, "one two three " * 5)], "item_id long, text string").withColumn("term", F.lit("clash")).withColumn("win", F.lit(1))
    want = brute([(r[0], r[1]) for r in ODD], [tuple(r)[:2] for r in items.collect()])
    assert found(decontaminate(spark, odd(spark), items)) == want
    assert decontaminate(spark, empty(spark), items).collect() == []
    assert found(decontaminate(spark, odd(spark), items.filter("false"))) == brute([(r[0], r[1]) for r in ODD], [])
