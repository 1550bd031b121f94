import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from postweave.llm.spelling import emit_keys, group_variants

from .helpers import ODD, empty, odd

LETTERS = re.compile("[A-Za-zÀ-ÿ]+")


def one_apart(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows, least=5, count=3, ratio=2, every=97):
    n = Counter()
    for doc_id, text in rows:
        for run in LETTERS.findall(text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run[:h % len(run)] + run[h % len(run) + 1:] if h % every == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= least and c >= count}
    near = {w: [x for x in n if one_apart(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n[form[w]] if form[w] else 0) for w in n)


def found(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in df.collect())


def test_all_near_words_forms_and_roots_against_brute_force(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("abé") for _ in range(rng.randint(4, 7))) for _ in range(160)] + ["aaaaaa", "aaaaa", "aaaaaaa", "aabaa", "abbba", "abba"]
    rows = [(i if i % 9 else None, " ".join(rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=300)) + " A漢B x÷y") for i in range(12)]
    got = found(group_variants(spark, spark.createDataFrame(rows, "doc_id long, text string"), every=5))
    assert got == brute(rows, every=5)
    assert sum(r[4] for r in got) > 100 and any(r[1] for r in got)


def test_forms_lead_to_a_root_over_many_steps(spark):
    words = ["abcdefgh"[: 5] + "x" * k for k in range(9)]
    rows = [(1, " ".join(w for k, w in enumerate(words) for _ in range(3 << k)))]
    got = found(group_variants(spark, spark.createDataFrame(rows, "doc_id long, text string"), every=1 << 40))
    assert got == brute(rows, every=1 << 40)
    assert {r[2] for r in got} == {words[-1]}


def test_a_very_long_word_emits_its_deletions_in_linear_space(spark):
    long = "".join(random.Random(1).choices("abcdefgh", k=60_000))
    rows = [(i, f"{long} {long[:30_000]}{long[30_001:]} {long} {long[:9]}z{long[10:]}") for i in range(3)]
    got = found(group_variants(spark, spark.createDataFrame(rows, "doc_id long, text string"), every=1 << 40))
    assert [(r[2] == long, r[3], r[4]) for r in sorted(got, key=lambda r: r[3])] == [(True, 3, 1), (True, 3, 1), (True, 6, 2)]


def test_keys_of_equal_strings_are_equal():
    words = ["abca", "bca", "aca", "aba", "abc", "aab", "ab", "éab"]
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(words))), pa.array(words)], ["id", "word"])
    keys = {}
    for part in emit_keys([batch]):
        for k1, k2, slot, last, i in zip(*[c.to_pylist() for c in part.columns]):
            for at in range(slot, last + 1) if slot >= 0 else [-1]:
                keys.setdefault((k1, k2), set()).add(words[i] if at < 0 else words[i][:at] + words[i][at + 1:])
    assert all(len(v) == 1 for v in keys.values())
    assert len(keys) == len({w for v in keys.values() for w in v})


def test_odd_rows_and_an_empty_table(spark):
    assert found(group_variants(spark, odd(spark))) == brute([(r[0], r[1]) for r in ODD])
    assert group_variants(spark, empty(spark)).collect() == []
