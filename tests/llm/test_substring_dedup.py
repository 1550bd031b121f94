import hashlib
import random
import re

import numpy as np
import pytest

from postweave.llm import sketch
from postweave.llm.kernels import SPACES, Words, rolling, sliding_min, stretches
from postweave.llm.sketch import Layout
from postweave.llm.substring_dedup import dedup_substrings

from .helpers import ODD, empty, odd


def brute(rows, size):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    rank = lambda i: float("inf") if i is None else i
    least = {}
    for i, w in words:
        for j in range(len(w) - size + 1):
            k = tuple(w[j:j + size])
            least[k] = min(least.get(k, float("inf")), rank(i))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for j in range(len(w) - size + 1):
            if least[tuple(w[j:j + size])] < rank(i):
                gone[j:j + size] = [True] * size
        out.append((i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("size,depth,chunk", [(13, 2, 2000), (5, 1, 8 << 20)])
def test_matches_brute_force(spark, monkeypatch, size, depth, chunk):
    monkeypatch.setattr(sketch.Exchange.__init__, "__defaults__", (chunk,))
    monkeypatch.setattr(sketch, "POSITION", 4)  # narrow: many collisions, which cost no result
    rng = random.Random(size)
    vocabulary = [f"w{i}" for i in range(150)] + ["É", "x y"]
    passages = [rng.choices(vocabulary, k=rng.randint(10, 60)) for _ in range(4)]
    rows = []
    for i in rng.sample(range(10_000), 80):
        parts = [rng.choice(passages) if rng.random() < 0.5 else rng.choices(vocabulary, k=rng.randint(0, 40)) for _ in range(rng.randint(0, 4))]
        rows.append((i, rng.choice((" ", "\n", " \t ")).join(w for p in parts for w in p)))
    rows += [(20_000, None), (20_001, ""), (None, " ".join(passages[0])), (None, " ".join(passages[0])), rows[0]]
    rows += [(2**63 - 1, " ".join(passages[1])), (-2**63, " ".join(passages[2] + ["own"])), (20_002, "a " * 40), (20_003, "a " * 30 + "b")]
    got = dedup_substrings(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), size=size, depth=depth, texts=True).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == brute(rows, size)
    assert all(hashlib.sha256(bytes(r.kept_text)).hexdigest() == r.kept_sha256 for r in got)


def test_odd_rows(spark):
    got = dedup_substrings(spark, odd(spark)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == brute([(i, t) for i, t, *_ in ODD], 13)
    assert dedup_substrings(spark, empty(spark)).collect() == []


@pytest.mark.parametrize("depth", [1, 2])
def test_estimates_are_never_low(spark, monkeypatch, depth):
    monkeypatch.setattr(sketch, "POSITION", 3)
    rng = np.random.default_rng(0)
    layout = Layout(depth, 20)  # far too narrow: many collisions
    chunks = [rng.integers(0, 300, 200).astype(np.uint64) for _ in range(4)]
    sent = []
    for k, items in enumerate(chunks):
        cells, n = np.unique(layout.pack(items), return_counts=True)
        sent += [(int(c), k, int(x)) for c, x in zip(cells, n)]
    back = layout.merged(spark.createDataFrame(sent, sketch.CELL_SCHEMA)).collect()
    true = np.bincount(np.concatenate(chunks).astype(int), minlength=300)
    for k, items in enumerate(chunks):
        own = [r for r in back if r.chunk_id == k]
        found = layout.estimates(items, np.array([r.cell for r in own]), np.array([r.estimate for r in own]))
        assert (found >= true[items.astype(int)]).all()


def test_one_shuffle_merges_all_rows_of_the_sketch(spark):
    plan = Layout(2, 300).merged(spark.createDataFrame([(1, 1, 1)], sketch.CELL_SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Window") >= 2


def test_long_texts_in_stretches():
    """Words and hashes don't depend on where stretches end, one long word included."""
    rng = random.Random(3)
    text = " ".join(rng.choice(("a", "bcd", "x" * 40, "é")) for _ in range(400)).encode() + b" " + b"y" * 900 + b"z tail"
    data, offsets = np.frombuffer(text + b"next doc", np.uint8), np.array([0, 0, len(text), len(text) + 8])
    whole, cut = Words(data, offsets, True, (1, 2)), Words(data, offsets, True, (1, 2), limit=64)
    for name in ("doc", "start", "end"):
        assert (getattr(whole, name) == getattr(cut, name)).all()
    assert all((a == b).all() for a, b in zip(whole.hashes, cut.hashes))
    assert max(b - a for a, b in stretches(data, offsets, 64, SPACES)) == 901 and len(whole.doc) == 404


def test_sliding_min():
    x = np.random.default_rng(1).integers(0, 99, 50)
    for n in (1, 2, 3, 6, 7):
        assert sliding_min(x, n).tolist() == [x[i: i + n].min() for i in range(51 - n)]


def test_rolling_is_by_content():
    h = np.arange(1, 50, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in (1, 2, 3, 4, 5, 13):
        both = rolling(np.concatenate([h, h]), k)
        assert len(both) == 2 * len(h) - k + 1 and (both[: len(h) - k + 1] == both[len(h):][: len(h) - k + 1]).all()
        assert len(np.unique(rolling(h, k))) == len(h) - k + 1


def test_words_of_bytes():
    text = "a bb c\x0b\x0cd e  f".encode()
    w = Words(np.frombuffer(text + b"g", np.uint8), np.array([0, len(text), len(text) + 1, len(text) + 1]), fold=False)
    got = [(int(d), (text + b"g")[s:e].decode()) for d, s, e in zip(w.doc, w.start, w.end)]
    assert got == [(0, "a"), (0, "bb c"), (0, "d e"), (0, "f"), (1, "g")]
