"""The join against brute force: families of near copies, copies, short and empty texts."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from postweave.llm import jaccard_join
from postweave.llm.jaccard_join import join, least_overlap, prefix_length

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, percent):
    sets = {i: shingles(t, k) for i, t in rows}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    posts = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            posts[x].append(i)
    for i, s in sets.items():
        common = defaultdict(int)
        for x in s:
            for j in posts[x]:
                if j > i:
                    common[j] += 1
        for j, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def corpus(seed, families, copies):
    rng, rows = random.Random(seed), []
    vocabulary = [f"w{i}" for i in range(400)]
    passage = rng.choices(vocabulary, k=30)
    for _ in range(families):
        base = rng.choices(vocabulary, k=rng.choice((3, 20, 60, 120)))
        if rng.random() < 0.3:
            base = passage + base
        for _ in range(rng.randint(1, copies)):
            words = list(base)
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append(" ".join(words) if rng.random() < 0.7 else "  ".join(words).upper() + "\n")
    return list(enumerate([*rows, "", None, " \t\n", "one", "One", "two words", "é é é é é"]))


@pytest.mark.parametrize("k,percent,seed", [(4, 85, 1), (5, 80, 2)])
def test_matches_brute_force(spark, monkeypatch, k, percent, seed):
    # small blocks and weights, so that groups are split as large ones are
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 4)
    monkeypatch.setattr(jaccard_join, "QUERY_SETS", 3)
    rows = [(2**63 - 1 if i == 7 else i, t) for i, t in corpus(seed, 30, 14)]
    got = join(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), k=k, percent=percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, k, percent)


def test_edges_of_the_input(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, n int, rep string")
    assert join(spark, empty).collect() == []
    rows = spark.createDataFrame([(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (None, "a b c d e f", "x"), (-7, None, None)], "doc_id long, text string, tokens string")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in join(spark, rows).collect())
    assert got == [("-7", 0, "-7"), ("1", 2, "1"), ("1", 2, "1"), ("None", 2, "None")]


def test_bounds():
    for n in range(1, 300):
        assert least_overlap(n, 85) * 100 >= 85 * n > (least_overlap(n, 85) - 1) * 100
        assert 1 <= prefix_length(n, 85) <= n


def test_every_link_is_counted(spark, monkeypatch):
    """Links within a family of near copies, in one block and across blocks, and copies."""
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 4)
    monkeypatch.setattr(jaccard_join, "QUERY_SETS", 3)
    rows = corpus(3, 12, 14)
    sets = {i: shingles(t, 4) for i, t in rows}
    pairs = {(i, j) for i in sets for j in sets if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = {i: sum(i in p for p in pairs) for i in sets}
    assert {r.doc_id: r.n_links for r in join(spark, docs, k=4, percent=85).collect()} == want and max(want.values()) > 4
    first = {i: min(j for j in sets if sets[j] == sets[i]) for i in sets}
    listed = [tuple(sorted(p)) for p in jaccard_join.links(spark, docs, k=4, percent=85).select("rep", "other").collect()]
    assert len(listed) == len(set(listed)) and set(listed) == {tuple(sorted((first[i], first[j]))) for i, j in pairs if first[i] != first[j]}


def test_sets_that_share_an_id_are_both_joined(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 4)
    base = [f"w{i}" for i in range(60)]
    rows = [(5, " ".join(base)), (5, " ".join(base[:-1] + ["z"])), (9, " ".join(base[:-1] + ["z", "y"])), (3, "quite another text of its own " * 3), (5, "short")]
    got = join(spark, spark.createDataFrame(rows, "doc_id long, text string"), k=4, percent=85).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got) == [(3, 6, 3, 0), (5, 1, 5, 0), (5, 57, 5, 2), (5, 57, 5, 2), (9, 58, 5, 2)]


def test_a_large_family(spark):
    """A family of near copies: entries of the matrix and pairs of groups stay below its size, and
    each set is put to few groups."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(base[:j] + [f"x{i}"] + base[j:])) for i in range(3000) for j in (rng.randrange(100),)]
    rows += [(3000 + i, " ".join(rng.choices(base, k=60))) for i in range(300)]
    counts = {}
    got = join(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(4), k=4, percent=85, counts=counts).collect()
    assert {r.component_id for r in got if r.doc_id < 3000} == {0}
    assert {r.n_links for r in got if r.doc_id < 3000} == {2999}
    # 12 pieces of the family at least: each set queries half of them, not each other set
    assert counts["distinct"] >= 3000 and counts["opened"] <= counts["queries"] < 3000 * 20
    assert counts["matrix"] <= counts["prefixes"] < 30 * 3000


def test_overlaps():
    rng = np.random.default_rng(5)
    for size, width in ((6, 40), (90, 12), (40, 3000)):
        a, b = ([np.unique(rng.integers(0, width, rng.integers(1, 30))).astype(np.uint64) for _ in range(size)] for _ in range(2))
        want = [[len(np.intersect1d(x, y)) for y in b] for x in a]
        assert (jaccard_join.overlaps(a, b, step=7) == np.array(want)).all()


def test_a_common_footer_makes_no_pairs(spark):
    """Texts of their own with one footer and one near copy each: what is put to other pivots follows the near copies,
    not the pairs of pivots that the footer's tokens make."""
    rng, footer, rows = random.Random(4), " ".join(f"f{i}" for i in range(12)), []
    for i in range(1500):
        words = [f"w{rng.randrange(10**6)}" for _ in range(40)]
        rows += [" ".join(words) + " " + footer, " ".join(words[:-1] + ["z"]) + " " + footer]
    counts = {}
    got = join(spark, spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4), k=4, percent=80, counts=counts).collect()
    assert {r.doc_id: (r.component_id, r.n_links) for r in got} == {i: (i - i % 2, 1) for i in range(3000)}
    assert counts["matrix"] <= counts["distinct"] and counts["pairs"] <= 1500
